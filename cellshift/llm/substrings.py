"""Repeated stretches of words, counted exactly by super-k-mers.

Every window of `size` words has a minimiser, the least hash of the runs of `run` words
in it. Consecutive windows that share it are one super-k-mer: they travel as one string
to the bucket of the minimiser. Equal windows have equal minimisers, so each meets its
equals in one bucket, where the windows are sorted by hash, equal neighbours compared
byte by byte, and those that occur more than once reported back.

* Equal super-k-mers of one piece of a partition travel once. All windows of such a one
  are known to be repeated, so what comes back is never more than one answer for each
  string that was sent, and no bucket gathers the places of a passage which a third of
  all documents share.
* Runs of words that very many texts share are used as minimisers only where there is no
  other, so text next to a common passage is spread over many buckets.
* Strings for one bucket leave a task in one compressed block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.frequent import hot_runs, is_hot
from cellshift.llm.shared import keyed, materialise
from cellshift.llm.words import U, Words, between, mix, pieces, prefix_sums, runs

_PIECE = 4 << 20
_BLOCK = "bucket int, strings binary, places binary"
_PLACE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("from", "<i4"), ("to", "<i4")])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values; the last n - 1 places are void."""
    out, width = x.copy(), 1
    while width * 2 <= n:
        np.minimum(out[:-width], out[width:].copy(), out=out[:-width])
        width *= 2
    if n > width and len(out) > n - width:
        np.minimum(out[: width - n], out[n - width :].copy(), out=out[: width - n])
    return out


def super_kmers(words: Words, size: int, run: int, hot: np.ndarray):
    """(first, last, minimiser) of the super-k-mers: words where the windows start."""
    least = runs(words.hashes(), run) >> U(1)
    least |= is_hot(runs(words.hashes(), run), hot).astype(U) << U(63)
    least = sliding_min(least, size - run + 1)
    starts = np.flatnonzero(words.whole(size))
    if not len(starts):
        return starts, starts, np.zeros(0, U)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (least[starts[1:]] != least[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], least[starts[first]]


def _send(size: int, run: int, hot: np.ndarray, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for rows, texts in pieces(batch, "text", _PIECE):
                words = Words(texts)
                first, last, least = super_kmers(words, size, run, hot)
                if not len(first):
                    continue
                doc = words.doc[first]
                place = np.zeros(len(first), _PLACE)
                for k in ("k1", "k2"):
                    place[k] = rows.column(k).to_numpy(zero_copy_only=False)[doc]
                place["from"] = first - words.first[doc]
                place["to"] = last - words.first[doc] + size
                a, b = words.start[first].tolist(), words.end[last + size - 1].tolist()
                same: dict[bytes, list[int]] = {}
                for i in range(len(first)):
                    same.setdefault(words.bytes[a[i] : b[i]], []).append(i)
                repeated = [i for at in same.values() if len(at) > 1 for i in at]
                bucket = (mix(least) % U(buckets)).astype(np.int64)
                out = []
                if repeated:
                    out.append((int(bucket[repeated[0]]), None, pack(place[repeated].tobytes())))
                # A string that came more than once needs no answer: it has no place.
                place["to"][repeated] = -1
                strings = sorted(((int(bucket[at[0]]), at[0], s) for s, at in same.items()), key=lambda x: x[:2])
                for to, some in groupby(strings, key=lambda x: x[0]):
                    some = list(some)
                    body = b"\n".join(s for _, _, s in some)
                    out.append((to, pack(body), pack(place[[i for _, i, _ in some]].tobytes())))
                yield pa.record_batch(
                    [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
                    names=["bucket", "strings", "places"],
                )

    return send


def repeated_windows(body: bytes, size: int, twice: np.ndarray):
    """(string, first, last): stretches of windows that the strings hold more than once.

    body: strings between line feeds; twice: for each, whether it stands for several.
    first and last are windows, counted within the string.
    """
    joined = np.frombuffer(body, np.uint8)
    gaps = np.flatnonzero((joined == 32) | (joined == 10))
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(joined)]])
    string = np.concatenate([[0], np.cumsum(joined[gaps] == 10)])
    sums = prefix_sums(joined.astype(U) + U(1))
    hashes = mix(between(sums, start, end) ^ (end - start).astype(U))
    at = np.flatnonzero(string[: len(string) - size + 1] == string[size - 1 :])
    windows = mix(between(prefix_sums(hashes), at, at + size))
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    n = np.bincount(group) if len(group) else np.zeros(0, int)
    several = np.zeros(len(n), bool)
    several[group[twice[string[at[order]]]]] = True
    is_repeated = np.zeros(len(at), bool)
    is_repeated[order] = (n > 1)[group] | several[group]
    # Equal hashes are compared; should any differ, their group is told apart by the words.
    heads = np.flatnonzero(new)
    a, b = start[at], end[at + size - 1]
    for g in np.flatnonzero(n > 1).tolist():
        members = order[heads[g] : heads[g] + n[g]].tolist()
        one = body[a[members[0]] : b[members[0]]]
        if any(body[a[i] : b[i]] != one for i in members[1:]):
            by_words: dict[bytes, list[int]] = {}
            for i in members:
                by_words.setdefault(body[a[i] : b[i]], []).append(i)
            for same in by_words.values():
                is_repeated[same] = len(same) > 1 or bool(twice[string[at[same[0]]]])
    found = np.flatnonzero(is_repeated)
    if not len(found):
        return found, found, found
    first_word = np.concatenate([[0], np.flatnonzero(np.diff(string)) + 1])
    of, offset = string[at[found]], at[found] - first_word[string[at[found]]]
    new = np.ones(len(found), bool)
    new[1:] = (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(new)
    return of[head], offset[head], offset[np.append(head[1:], len(found)) - 1]


def _receive(size: int):
    def answer(blocks: list[tuple]) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        known = [np.frombuffer(unpack(p), _PLACE) for s, p in blocks if s is None]
        sent = [(unpack(s), np.frombuffer(unpack(p), _PLACE)) for s, p in blocks if s is not None]
        if sent:
            place = np.concatenate([p for _, p in sent])
            of, first, last = repeated_windows(b"\n".join(s for s, _ in sent), size, place["to"] < 0)
            found = place[of]
            found["to"] = np.where(found["to"] < 0, -1, found["from"] + last + size)
            found["from"] += first.astype(np.int32)
            known.append(found[found["to"] >= 0])
        return np.concatenate(known)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket; one bucket at a time is unpacked.
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for _, blocks in groupby(rows, key=lambda r: r[0]):
            found = answer([(s, p) for _, s, p in blocks])
            yield pa.record_batch({name: pa.array(np.ascontiguousarray(found[name])) for name in _PLACE.names})

    return receive


def repeated_stretches(texts: DataFrame, size: int = 35, run: int = 3, buckets_per_partition: int = 8) -> DataFrame:
    """(k1, k2, from, to): word stretches of `texts` (k1, k2, text) covered by windows
    that start more than once in all texts. Stretches may overlap."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_runs(texts, run)
    sent = texts.select("k1", "k2", "text").mapInArrow(
        _send(size, run, hot, partitions * buckets_per_partition), _BLOCK
    )
    dealt = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(_receive(size), "k1 long, k2 long, from int, to int"))


def dedup_substrings(docs: DataFrame, size: int = 35, run: int = 3, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row of docs: (id, n_words, n_removed, kept), kept the words that stay, by spaces.

    Words are what white space of ASCII separates. A word goes if it lies in a window of
    `size` words whose words, in order, start anywhere else too; windows are judged on
    the input. Null and empty texts have no words, texts shorter than a window lose
    none, and rows that repeat lose what they share.
    """
    texts = keyed(docs, id_column, text_column)
    found = repeated_stretches(texts, size, run).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("from", "to")).alias("gone")
    )
    both = texts.join(found, ["k1", "k2"], "left").select("k1", "k2", "text", "id", F.col("gone.from").alias("a"), F.col("gone.to").alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, a, b in zip(texts, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if a:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    words = [w for w, depth in zip(words, np.cumsum(edge).tolist(), strict=False) if not depth]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    id_type = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(cut, f"id {id_type}, n_words long, n_removed long, kept string")
