"""Repeated and nearly repeated lines, by a deletion-neighbourhood join.

The edit distance counts words put in, left out or replaced; its bound is one. Two lines
within it share a variant: the line itself, or the line without one of its words. So each
line emits the hashes of its variants, equal hashes meet, the earliest line of each is
compared with the others, and a line goes if an earlier one is within the bound.

* Equal lines are one line from the start, known by their earliest place.
* Lines within one edit have the same first or the same last half. Only lines that share
  a half with another one emit variants, which keeps the neighbourhood small.
* Variants meet with the place of the word that is missing. Lines with one variant and
  one place differ at most in that word, so each needs comparing with the earliest only,
  never with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellshift.llm.shared import discard, keyed, materialise
from cellshift.llm.words import U, Words, between, mix, pieces, powers, prefix_sums, signed

_PIECE = 4 << 20
_FRONT, _BACK, _SECOND = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)
_BASE = 0x9E3779B97F4A7C15 | 1


def _split(rows: pa.RecordBatch, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of the texts, the text and the number of each."""
    split = [t.split(b"\n") for t in texts]
    count = np.array([len(s) for s in split])
    doc = np.repeat(np.arange(len(texts)), count)
    return [x for s in split for x in s], doc, np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)


def _hash_lines(min_words: int):
    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch, "text", _PIECE):
                lines, doc, number = _split(rows, texts)
                words = Words(lines)
                hashes = words.hashes()
                sums, other = prefix_sums(hashes), prefix_sums(mix(hashes ^ _SECOND))
                kept = np.flatnonzero(words.count)
                a, n = words.first[kept], words.count[kept]
                halves = []
                for half in (n // 2, (n + 1) // 2):
                    size = half.astype(U)
                    halves.append(mix(between(sums, a, a + half) + size * _FRONT))
                    halves.append(mix(between(sums, a + n - half, a + n) + size * _BACK))
                near = n >= min_words
                # Halves of an even number of words are the same twice.
                used = np.stack([near, near, near & (n % 2 == 1), near & (n % 2 == 1)], axis=1)
                ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
                values = signed(np.ascontiguousarray(np.stack(halves, axis=1)[used]))
                at = pa.array(doc[kept])
                yield pa.record_batch(
                    [
                        *[rows.column(c).take(at) for c in ("id", "k1", "k2")],
                        pa.array(number[kept], pa.int32()),
                        pa.array(signed(mix(between(sums, a, a + n) + n.astype(U)))),
                        pa.array(signed(mix(between(other, a, a + n)))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    ],
                    names=["id", "k1", "k2", "line", "h1", "h2", "halves"],
                )

    return hash_lines


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of chosen lines (column wanted) of each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        at, number, line = [], [], []
        for i, (text, wanted) in enumerate(zip(texts, batch.column("wanted").to_pylist(), strict=True)):
            lines = text.split(b"\n")
            for w in wanted:
                at.append(i), number.append(w), line.append(lines[w])
        at = pa.array(at, pa.int64())
        yield pa.record_batch(
            [*[batch.column(c).take(at) for c in ("id", "k1", "k2")], pa.array(number, pa.int32()), pa.array(line, pa.binary())],
            names=["id", "k1", "k2", "line", "words"],
        )


def variants(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, missing, hash): each line, missing -1, and each line without word `missing`."""
    words = Words(lines)
    sums = prefix_sums(words.hashes())
    a, n = words.first, words.count
    missing = np.arange(words.total) - a[words.doc]
    start, stop = a[words.doc], (a + n)[words.doc]
    here = np.arange(words.total)
    power = powers(int(n.max(initial=0)) + 1, _BASE)
    short = between(sums, start, here) + between(sums, here + 1, stop) * power[missing]
    return (
        np.concatenate([np.arange(len(lines)), words.doc]),
        np.concatenate([np.full(len(lines), -1), missing]),
        mix(np.concatenate([between(sums, a, a + n), short])),
    )


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, lines in pieces(batch, "words", _PIECE):
            line, missing, hashes = variants(lines)
            at = pa.array(line)
            yield pa.record_batch(
                [*[rows.column(c).take(at) for c in ("id", "k1", "k2", "line")], pa.array(missing, pa.int32()), pa.array(signed(hashes))],
                names=["id", "k1", "k2", "line", "missing", "variant"],
            )


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("words").to_pylist(), batch.column("earlier").to_pylist(), strict=True)
        ok = pa.array([within_one_edit(a.split(), b.split()) for a, b in both], pa.bool_())
        yield batch.select(["h1", "h2"]).filter(ok)


def find_lines(texts: DataFrame, min_words: int = 8) -> DataFrame:
    """(k1, k2, gone): numbers of the lines that go, for the texts (id, k1, k2, text) with any.

    Places are compared by id, then the hash of the text, then the line's number.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "k1", "k2", "text")
    lines = materialise(
        rows.mapInArrow(_hash_lines(min_words), f"id {id_type}, k1 long, k2 long, line int, h1 long, h2 long, halves array<long>")
    )
    place = F.struct("id", "k2", "line", "k1")
    distinct = materialise(
        lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("halves").alias("halves"))
    )
    # Lines that share a half with another one.
    half = distinct.select("h1", "h2", "first", F.explode("halves").alias("half"))
    half = half.withColumn("many", F.count("*").over(Window.partitionBy("half")))
    chosen = half.where("many > 1").select("h1", "h2", "first").distinct()
    wanted = chosen.groupBy("first.k1", "first.k2").agg(F.collect_list("first.line").alias("wanted"))
    # Repeated rows hold the same lines; any of them will do.
    cut = rows.join(wanted, ["k1", "k2"]).mapInArrow(_cut_out, f"id {id_type}, k1 long, k2 long, line int, words binary")
    cut = materialise(cut.dropDuplicates(["k1", "k2", "line"]))
    met = cut.mapInArrow(_neighbourhood, f"id {id_type}, k1 long, k2 long, line int, missing int, variant long")
    met = met.select("variant", "missing", place.alias("at"))
    whole = F.col("missing") < 0
    same, close = Window.partitionBy("variant"), Window.partitionBy("variant", "missing")
    met = (
        met.withColumn("whole", F.min(F.when(whole, F.col("at"))).over(same))
        .withColumn("longer", F.min(F.when(~whole, F.col("at"))).over(same))
        .withColumn("peer", F.min("at").over(close))
    )
    # A whole line meets the lines that are it and one word; those meet it and each other.
    ahead = F.when(whole, F.col("longer")).otherwise(F.least("whole", "peer"))
    pairs = met.where(ahead < F.col("at")).select("at", ahead.alias("before"))
    pairs = materialise(pairs.distinct())
    left = cut.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("line").alias("a3"), "words")
    right = cut.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("line").alias("b3"), F.col("words").alias("earlier"))
    compared = pairs.join(left, (F.col("at.k1") == F.col("a1")) & (F.col("at.k2") == F.col("a2")) & (F.col("at.line") == F.col("a3")))
    compared = compared.join(right, (F.col("before.k1") == F.col("b1")) & (F.col("before.k2") == F.col("b2")) & (F.col("before.line") == F.col("b3")))
    compared = compared.join(chosen.select("h1", "h2", "first"), F.col("first") == F.col("at"))
    near = materialise(compared.select("h1", "h2", "words", "earlier").mapInArrow(_verify, "h1 long, h2 long").distinct())
    decided = distinct.select("h1", "h2", "first").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    gone = (
        lines.select("id", "k1", "k2", "line", "h1", "h2")
        .join(decided, ["h1", "h2"])
        .where(F.col("near") | (place != F.col("first")))
    )
    gone = materialise(gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone")))
    discard(lines, distinct, cut, pairs, near)
    return gone


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        kept, before, removed = [], [], []
        for text, gone in zip(texts, batch.column("gone").to_pylist(), strict=True):
            lines = text.split(b"\n")
            before.append(len(lines) if text else 0)
            if gone:
                bad = set(gone)
                lines = [x for i, x in enumerate(lines) if i not in bad]
            removed.append(before[-1] - (len(lines) if text else 0))
            kept.append(b"\n".join(lines))
        names = [c for c in batch.schema.names if c not in ("text", "gone")]
        yield pa.record_batch(
            [*[batch.column(c) for c in names], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())],
            names=[*names, "kept", "n_lines", "n_removed"],
        )


def dedup_lines(docs: DataFrame, min_words: int = 8, id_column="doc_id", text_column="text", keep: list = ()) -> DataFrame:
    """Per row of docs: (id, *keep, kept, n_lines, n_removed), kept the text of the lines that stay.

    Lines end at line feeds; their words are what white space of ASCII separates. A line
    goes if the same words, or, for lines of `min_words` words or more on both sides,
    words within one edit, are in an earlier line, by id, then text, then place; lines
    are judged on the input. Lines without words stay. Null and empty texts have no
    lines. Of repeated rows, which cannot be told apart, all keep the same lines; null
    ids come first.
    """
    texts = keyed(docs, id_column, text_column, list(keep))
    both = texts.join(find_lines(texts, min_words), ["k1", "k2"], "left").drop("k1", "k2")
    schema = StructType([f for f in both.schema if f.name not in ("text", "gone")])
    schema = schema.add("kept", "string").add("n_lines", "long").add("n_removed", "long")
    return both.mapInArrow(_drop, schema)
