"""Token sequences of one length from documents, by non-negative least squares.

Documents are cut at the window; what is left over, one rest a document, is only known
by its length. The combinations of up to three lengths that fill a window are enumerated,
and how often to use each is the non-negative least squares fit to the histogram of
lengths. The fit is rounded to what there is, and the rest packed greedily, longest
first. All of that works on a histogram of at most `window` bins, on the driver. Which
piece goes where follows from its rank among pieces of its length: counted per bucket,
summed over buckets and looked up in the plan, so nothing is ever gathered or sorted as
a whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tiktoken.registry import ENCODINGS

from cellshift.llm.shared import keyed, materialise

# Fixed format: how this vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str) -> tiktoken.Encoding:
    """Token ids as the tokenizers library gives them for the vocabulary file at `path`.

    Built from the merges in the file on an engine for ranks, which is three times faster
    on the same vocabulary and equal to it (a test compares them). Kept where that
    library keeps its own, for the life of a worker.
    """
    if path in ENCODINGS:
        return ENCODINGS[path]
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    ENCODINGS[path] = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return ENCODINGS[path]


def cut(docs: DataFrame, tokenizer: str, window: int = 1024, ids: bool = False, end: int = 0,
        id_column="doc_id", text_column="text") -> DataFrame:
    """Pieces (k1, k2, id, start, length, ids_crc32, doc_tokens[, ids]) of all documents.

    A document is its token ids and the id `end`; null and empty texts are that id alone.
    ids_crc32 is taken over unsigned little-endian 32-bit ids, `ids` holds those bytes.
    The result is written, as it is read three times.
    """
    texts = keyed(docs, id_column, text_column)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            of, start, length, crc, total, body = [], [], [], [], [], []
            texts = batch.column("text").cast(pa.string()).to_pylist()
            for i, text in enumerate(texts):
                tokens = np.array([*encode(text, allowed_special="all"), end], "<u4")
                for a in range(0, len(tokens), window):
                    piece = tokens[a : a + window].tobytes()
                    of.append(i), start.append(a), length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece)), total.append(len(tokens))
                    if ids:
                        body.append(piece)
            rows = pa.array(of, pa.int64())
            columns = {c: batch.column(c).take(rows) for c in ("k1", "k2", "id")}
            columns |= {
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()),
            }
            yield pa.record_batch(columns | ({"ids": pa.array(body, pa.binary())} if ids else {}))

    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"k1 long, k2 long, id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    return materialise(texts.select("k1", "k2", "id", "text").mapInArrow(tokenize, schema + ", ids binary" * ids))


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that there are and that fill the window."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    return np.stack([a, b, c], axis=1)[there[c]]


def fit_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 of least squares between what the combinations use and the histogram.

    Accelerated projected gradient; a combination uses up to three bins, so no matrix is
    ever made. Bin 0 stands for "none" and counts for nothing.
    """
    target = histogram.astype(float).copy()
    target[0] = 0

    def used(x):
        out = sum(np.bincount(combos[:, i], x, len(target)) for i in range(3))
        out[0] = 0
        return out

    def back(r):
        return r[combos].sum(axis=1)

    probe = np.ones(len(combos))
    for _ in range(20):
        probe = back(used(probe))
        norm = np.linalg.norm(probe)
        probe /= norm or 1
    step = 1 / (norm * 1.05 or 1)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(used(y) - target))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how often)] that uses each piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern, most):
        need = {n: pattern.count(n) for n in pattern}
        times = min([most, *(left[n] // k for n, k in need.items())])
        if times > 0:
            for n, k in need.items():
                left[n] -= k * times
            out.append((tuple(pattern), int(times)))

    if left[window]:
        take([window], left[window])
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = fit_counts(combos, left)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            take([int(n) for n in combos[i] if n], int(round(x[i])))
    while left.any():
        pattern, room, spare = [], window, left.copy()
        while (fits := np.flatnonzero(spare[: room + 1])).size:
            n = int(fits[-1])
            k = int(min(spare[n], room // n))
            pattern += [n] * k
            spare[n] -= k
            room -= n * k
        take(pattern, int(left.max()))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: (length, rank from, copies, sequence, offset).

    Pieces of the rank on take `copies` places of each sequence from `sequence` on, the
    first of them at `offset`.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in dict.fromkeys(pattern):
            copies = pattern.count(n)
            rows.append((n, taken.get(n, 0), copies, sequence, offset))
            taken[n] = taken.get(n, 0) + copies * times
            offset += n * copies
        sequence += times
    rows.sort()
    names = ("length", "rank", "copies", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pack(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """The pieces of `cut` with sequence_id and offset.

    Sequences hold at most `window` tokens, without gaps, padding only at their end.
    Equal pieces may swap places. No pieces, no sequences.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most `window` rows
    histogram = np.zeros(window + 1, np.int64)
    for n, count in counted:
        histogram[n] = count
    shared = spark.sparkContext.broadcast(slots(plan(histogram, window)))
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2", "start"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "bucket").count()
    before = sums.select(
        "length",
        "bucket",
        (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"),
    )
    within = Window.partitionBy("length", "bucket").orderBy("k1", "k2", "start")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)
    ranked = ranked.select(*pieces.columns, "rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table["length"] << 44) | table["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            at = np.maximum(at, 0)
            nth = rank - table["rank"][at]
            sequence = table["sequence"][at] + nth // table["copies"][at]
            offset = table["offset"][at] + nth % table["copies"][at] * length
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, ids: bool = True, **columns) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset) of all pieces."""
    return pack(cut(docs, tokenizer, window, ids, **columns), window).drop("k1", "k2")
