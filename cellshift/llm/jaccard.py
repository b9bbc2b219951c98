"""Documents linked by the Jaccard similarity of their word n-grams, by grouped prefixes.

Each document is a set of hashed shingles in one global order, shingles that very many
documents share last. Two sets that are similar enough share a shingle among the first
few of both (prefix filter). Documents with equal sets are one node; nodes with equal
prefixes and size are one group, and only groups are looked up by their prefixes. Group
pairs pass filters on size, place and a bitmap of the sets (all exact: they only drop
pairs that cannot be similar), then their members are compared by their texts.

A cluster of n copies would give n * n pairs. So first each node is compared with one
hub, the smallest group of each of its prefix shingles; components of those links are
found, and in a second pass only nodes of different components are paired. No link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.llm.components import components
from cellshift.llm.frequent import hot_runs, is_hot
from cellshift.llm.shared import discard, keyed, materialise
from cellshift.llm.words import LOWER, U, Words, between, mix, pieces, prefix_sums, runs, signed

_PIECE = 4 << 20
_BITS = 512
# Sets of more than LARGE shingles fill a bitmap of 512 bits, so they have a wide one too.
LARGE, _WIDE_BITS = 1000, 8192
# What white space of ASCII does not separate.
WORD = r"[^\x20\x09-\x0D]"
_SALT = U(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], n: int, hot: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text its sorted set of n-word shingles; fewer words are one shingle."""
    words = Words(texts, LOWER)
    hashes = words.hashes()
    grams, whole = runs(hashes, n), words.whole(n)
    order = grams >> U(1)
    if hot is not None:
        order |= is_hot(grams, hot).astype(U) << U(63)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    first = words.first[short]
    single = mix(between(prefix_sums(hashes), first, first + words.count[short]) + words.count[short].astype(U)) >> U(1)
    out = []
    for a, count in zip(words.first.tolist(), words.count.tolist(), strict=True):
        out.append(np.unique(order[a : a + count][whole[a : a + count]]))
    for i, x in zip(short.tolist(), single, strict=True):
        out[i] = np.array([x], U)
    return out


def _least_overlap(n: np.ndarray, least: int) -> np.ndarray:
    """Shingles that a set of n shares with any set similar to it."""
    return -(-least * n // 100)


def _bitmap(s: np.ndarray, bits: int) -> list[int]:
    """For each of so many classes of shingles whether the set has an odd number of them."""
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _index(n_shingles: int, least: int, hot: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch, "text", _PIECE):
                sets = shingle_sets(texts, n_shingles, hot)
                n = np.array([len(s) for s in sets])
                prefixes = [s[: len(s) - _least_overlap(len(s), least) + 1] for s in sets]
                node, group, bits, wide = [], [], [], []
                for s, p in zip(sets, prefixes, strict=True):
                    if not len(s):
                        node.append(None), group.append(None), bits.append(None), wide.append(None)
                        continue
                    node.append(np.array([mix(s).sum(), mix(s ^ _SALT).sum()]).tobytes())
                    group.append(np.array([mix(p).sum(), mix(p ^ _SALT).sum() + U(len(s))]).tobytes())
                    bits.append(_bitmap(s, _BITS))
                    wide.append(_bitmap(s, _WIDE_BITS) if len(s) > LARGE else None)
                yield pa.record_batch(
                    [
                        rows.column("id"),
                        rows.column("k1"),
                        rows.column("k2"),
                        pa.array(n, pa.int32()),
                        pa.array(node, pa.binary()),
                        pa.array(group, pa.binary()),
                        pa.array([signed(p).tolist() if len(p) else None for p in prefixes], pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                        pa.array(wide, pa.list_(pa.int64())),
                    ],
                    names=["id", "k1", "k2", "n", "node", "grp", "prefix", "bits", "wide"],
                )

    return index


def _may_link(least: int, n1: Column, n2: Column, overlap: Column) -> Column:
    """Whether an overlap of so much is enough: 100 o >= least (n1 + n2 - o)."""
    return (100 + least) * overlap >= least * (n1 + n2)


def _bitmap_overlap(n1: Column, n2: Column, bits1: Column, bits2: Column) -> Column:
    """The most that two sets can share. Each bit that differs is an element of one only."""
    differ = sum(F.bit_count(bits1[i].bitwiseXOR(bits2[i])) for i in range(_BITS // 64))
    return F.floor((n1 + n2 - differ) / 2)


def _narrowed(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """pairs (a, b) without those of large sets whose wide bitmaps rule them out."""
    large = nodes.where(F.col("n") > LARGE).select("v", "n", "wide")
    both = pairs.join(large.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a", "left")
    both = both.join(large.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b", "left")
    apart = F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
    overlap = F.floor((F.col("na") + F.col("nb") - differ) / 2)
    fits = F.col("wa").isNull() | F.col("wb").isNull() | _may_link(least, F.col("na"), F.col("nb"), overlap)
    return materialise(both.where(fits).select("a", "b"))


def _compare(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n_shingles: int, least: int) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar enough."""
    met = materialise(pairs)
    pairs = _narrowed(met, nodes, least)
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    keys = nodes.join(wanted, "v").select("v", "k1", "k2")
    found = texts.select("k1", "k2", "text").join(keys, ["k1", "k2"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            text = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.record_batch({"v": batch.column("v"), "z": pa.array([pack(t) for t in text], pa.binary())})

    # Repeated rows have one key and so one node: any of them will do.
    kept = materialise(found.mapInArrow(packed, "v long, z binary").dropDuplicates(["v"]))
    both = pairs.join(kept.select(F.col("v").alias("a"), F.col("z").alias("za")), "a").join(
        kept.select(F.col("v").alias("b"), F.col("z").alias("zb")), "b"
    )

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, U))
        for batch in batches:
            ok = []
            for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                if za != last[0]:
                    last = (za, shingle_sets([unpack(za)], n_shingles)[0])
                y = shingle_sets([unpack(zb)], n_shingles)[0]
                shared = len(np.intersect1d(last[1], y, assume_unique=True))
                ok.append(100 * shared >= least * (len(last[1]) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    similar_pairs = materialise(both.select("a", "b", "za", "zb").mapInArrow(similar, "a long, b long"))
    discard(met, pairs, kept)
    return similar_pairs


def link(docs: DataFrame, n_shingles: int = 5, least: int = 80, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row of docs: (id, k1, k2, n_shingles, class, component_id).

    Rows are linked if their sets of distinct n-word shingles, lower-cased in ASCII,
    have a Jaccard similarity of `least` percent or more. Fewer words are one shingle;
    null and empty texts have an empty set and are linked with nothing. component_id is
    the smallest id that links reach, class is the component itself (null for empty
    sets). Shingles are compared by 63 bits of hash.
    """
    texts = keyed(docs, id_column, text_column)
    hot = hot_runs(texts, n_shingles, LOWER)
    id_type = texts.schema["id"].dataType.simpleString()
    sets = materialise(
        texts.select("id", "k1", "k2", "text").mapInArrow(
            _index(n_shingles, least, hot),
            f"id {id_type}, k1 long, k2 long, n int, node binary, grp binary, prefix array<long>, bits array<long>, wide array<long>",
        )
    )
    real = sets.where("n > 0")
    groups = materialise(
        real.groupBy("grp")
        .agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), (F.min("node") < F.max("node")).alias("several"))
        .withColumn("g", F.monotonically_increasing_id())
    )
    nodes = real.groupBy("node").agg(
        F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.min(F.struct("k1", "k2")).alias("key")
    )
    nodes = materialise(
        nodes.join(groups.select("grp", "g"), "grp").select(
            "node", F.monotonically_increasing_id().alias("v"), "g", "n", "bits", "wide", "key.k1", "key.k2"
        )
    )
    entries = _prefix_entries(groups, least)
    # Pass one: each member of a group against the smallest group at each of its shingles,
    # and against the first node of its own group.
    hubs = nodes.groupBy("g").agg(F.min(F.struct("v", "n", "bits")).alias("hub"))
    looked_up = (
        entries.where("g <> hub_g AND 100 * hub_n >= n * " + str(least))
        .select("g", F.col("hub_g").alias("to"))
        .union(groups.select("g", "g"))
        .distinct()
        .join(hubs.select(F.col("g").alias("to"), "hub"), "to")
    )
    stars = (
        looked_up.join(nodes.select("g", "v", "n", "bits"), "g")
        .where("v <> hub.v")
        .where(_may_link(least, F.col("n"), F.col("hub.n"), _bitmap_overlap(F.col("n"), F.col("hub.n"), F.col("bits"), F.col("hub.bits"))))
        .select(F.col("hub.v").alias("a"), F.col("v").alias("b"))
        .distinct()
    )
    stars = _compare(stars, nodes, texts, n_shingles, least)
    roots = components(stars)
    # Pass two: whatever the links so far have not joined.
    rest = _compare(_open_pairs(entries, nodes, roots, least), nodes, texts, n_shingles, least)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    discard(groups, entries, stars, rest)
    classes = nodes.join(roots.withColumnRenamed("node", "v"), "v", "left").select("node", F.coalesce("root", "v").alias("class"))
    rows = sets.select("id", "k1", "k2", "n", "node").join(classes, "node", "left")
    least_id = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("component_id"))
    return rows.join(least_id, "class", "left").select(
        "id", "k1", "k2", F.col("n").cast("long").alias("n_shingles"), "class", F.coalesce("component_id", "id").alias("component_id")
    )


def _prefix_entries(groups: DataFrame, least: int) -> DataFrame:
    """(shingle, g, n, pos, early, hub_n, hub_g) of the prefixes, where nodes share one.

    Nodes of one group share their whole prefix, so its first shingle is enough for them.
    early: the shingle may be the first that the set shares with one as large or larger.
    """
    early = F.col("pos") <= F.col("n") - F.ceil(2 * least * F.col("n") / (100 + least))
    each = groups.select("g", "n", "several", F.posexplode("prefix").alias("pos", "shingle")).withColumn("early", early)
    at = Window.partitionBy("shingle")
    hub = F.min(F.when(F.col("early"), F.struct("n", "g"))).over(at)
    each = each.withColumn("many", F.count("*").over(at)).withColumn("hub", hub)
    return materialise(
        each.where("(many > 1 OR (several AND pos = 0)) AND hub IS NOT NULL").select(
            "shingle", "g", "n", "pos", "early", F.col("hub.n").alias("hub_n"), F.col("hub.g").alias("hub_g")
        )
    )


def _open_pairs(entries: DataFrame, nodes: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a prefix shingle."""
    rooted = nodes.join(roots.withColumnRenamed("node", "v"), "v", "left").select(
        "g", "v", "bits", F.coalesce("root", "v").alias("root")
    )
    each = entries.select("shingle", "g", "n", "pos", "early").join(rooted, "g")
    mixed = (
        each.groupBy("shingle")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("shingle")
    )
    each = materialise(each.join(mixed, "shingle"))
    a = each.where("early").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("v", "n", "pos", "bits", "root")])
    b = each.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("v", "n", "pos", "bits", "root")])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    ahead = F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b"))
    fits = (
        (F.col("root_a") != F.col("root_b"))
        & ((n_a < n_b) | ((n_a == n_b) & (F.col("v_a") < F.col("v_b"))))
        & (100 * n_a >= least * n_b)
        & _may_link(least, n_a, n_b, ahead)
        & _may_link(least, n_a, n_b, _bitmap_overlap(n_a, n_b, F.col("bits_a"), F.col("bits_b")))
    )
    same = a.join(b, (a["shingle"] == b["shingle"]) & fits)
    return same.select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct()


def keep_one(docs: DataFrame, n_shingles: int = 5, least: int = 80, id_column="doc_id", text_column="text") -> DataFrame:
    """The rows of docs, of linked ones only the first by id; equal rows count as linked.

    Rows with null or empty texts all stay.
    """
    linked = link(docs, n_shingles, least, id_column, text_column)
    first = (
        linked.where(F.col("class").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("class")
        .agg(F.min(F.struct("k1", "k2")).alias("key"))
        .select("key.k1", "key.k2", F.lit(True).alias("stays"))
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = keyed(docs, id_column, text_column, [whole])
    # Equal rows share a key, so one of them is taken; texts without words are no copies.
    one = rows.join(first, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
    return one.union(rows.where(~F.col("text").rlike(WORD)).select("row.*"))
