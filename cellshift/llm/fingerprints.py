"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band, which is a band of
inverse document frequency. A text's terms in it are sorted; random subsets of the
lexicon, a term is in one with a chance of 1 in 2**level, each give the hash of the
text's terms in that subset. Subsets are used at the two levels at which one or two terms
of the text are to be expected, so a change that spares them spares the hash, in texts
of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cellshift.llm.shared import keyed
from cellshift.llm.words import LETTERS, U, Words, mix, pieces, signed

SUBSETS = 16
_PIECE = 4 << 20
_SEEDS = mix(np.arange(1, SUBSETS + 1).astype(U) * U(0x9E3779B97F4A7C15))


def fit_lexicon(docs: DataFrame, least_share: float = 1 / 5000, most_share: float = 1 / 20, text_column="text") -> np.ndarray:
    """Sorted hashes of the terms in least_share to most_share of all rows, in two at least.

    The number of terms is bounded whatever the corpus: frequencies of documents add up
    to the mean number m of distinct terms in a document times the documents, so not more
    than m / least_share terms reach the least share. Terms are runs of letters, digits
    and what is not ASCII, in lower case.
    """
    texts = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in pieces(batch, "text", _PIECE):
                words = Words(some, LETTERS)
                hashes = words.hashes()
                order = np.lexsort((hashes, words.doc))
                h, d = hashes[order], words.doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                terms, n = np.unique(h[new], return_counts=True)
                yield pa.record_batch({"term": pa.array(signed(terms)), "n": pa.array(n.astype(np.int64))})

    held = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("held"))
    low, high = max(2, int(np.ceil(rows * least_share))), max(2, int(rows * most_share))
    band = held.where(F.col("held").between(low, high)).select("term").toPandas()["term"]
    return np.sort(band.to_numpy(np.int64).view(U))


def fingerprint(text: bytes, terms: np.ndarray) -> str:
    """level:hashes;level:hashes of 32 bits each, 0 for an empty subset; terms sorted.

    Without terms in the lexicon it is the hash of the whole text.
    """
    if not len(terms):
        return "text:" + xxhash.xxh64(text).hexdigest()
    level = max(0, round(np.log2(len(terms))))
    out = []
    draw = mix(terms[None, :] ^ _SEEDS[:, None])
    for at in sorted({max(0, level - 1), level}):
        chosen = (draw >> U(64 - at)) == 0 if at else np.ones(draw.shape, bool)
        hashes = [xxhash.xxh32(terms[c].tobytes()).intdigest() or 1 if c.any() else 0 for c in chosen]
        out.append(f"{at}:" + "".join(f"{h:08x}" for h in hashes))
    return ";".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among subsets that hold terms of either, on common levels."""
    if a == b:
        return 1.0
    x, y = (dict(part.split(":") for part in s.split(";")) for s in (a, b))
    same = used = 0
    for level in x.keys() & y.keys() - {"text"}:
        for i in range(0, len(x[level]), 8):
            p, q = x[level][i : i + 8], y[level][i : i + 8]
            used += p != "00000000" or q != "00000000"
            same += p == q != "00000000"
    return same / used if used else 0.0


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon

    def __call__(self, texts: list[bytes]) -> list[str]:
        words = Words(texts, LETTERS)
        hashes = words.hashes()
        known = np.zeros(len(hashes), bool)
        if len(self.lexicon):
            known = self.lexicon[np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)] == hashes
        h, d = hashes[known], words.doc[known]
        cuts = np.searchsorted(d, np.arange(len(texts) + 1))
        return [fingerprint(t, np.unique(h[a:b])) for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]


def fingerprints(docs: DataFrame, lexicon: np.ndarray, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row of docs: (id, fingerprint). Equal texts have equal ones; null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = keyed(docs, id_column, text_column).select("id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(shared.value)
        for batch in batches:
            for part, some in pieces(batch, "text", _PIECE):
                yield pa.record_batch([part.column("id"), pa.array(of(some))], names=["id", "fingerprint"])

    return rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def _edit(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edited_neighbours(docs: DataFrame, lexicon: np.ndarray, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row of docs: (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next smaller id, by text hash among equal ids
    and null ids last; after the last comes the first. `edited` is the text with its last
    third replaced by as much of the next one's beginning. Rows are dealt out by ranges
    of ids; the first row of a range also goes, to look at, to the range before. Ids are
    whole numbers.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_column, text_column).withColumn("o", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    # One number for each range, and below one id for each: neither grows with the rows.
    bounds = np.unique(np.array(rows.approxQuantile("o", steps, 0.1 / ranges) if steps else [], np.float64))

    @F.pandas_udf(LongType())
    def range_of(o):
        return pd.Series(len(bounds) - np.searchsorted(bounds, o.to_numpy(), side="left"))

    dealt = rows.withColumn("at", range_of("o"))
    heads = dict(tuple(r) for r in dealt.groupBy("at").agg(F.max("o")).collect())
    order = sorted(heads)
    shown = [(heads[at], order[i - 1]) for i, at in enumerate(order)]
    peek = spark.createDataFrame(shown, "o long, at long") if shown else spark.createDataFrame([], "o long, at long")
    looked = dealt.drop("at").join(F.broadcast(peek), "o").withColumn("look", F.lit(1))
    both = dealt.withColumn("look", F.lit(0)).unionByName(looked)
    both = both.select("at", "look", "o", "k2", "k1", "id", "text").repartition(ranges, "at")
    both = both.sortWithinPartitions("at", "look", F.desc("o"), "k2", "k1")
    shared = spark.sparkContext.broadcast(lexicon)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(shared.value)
        held = None  # the last row of the piece before
        for batch in batches:
            for part, some in pieces(batch, "text", _PIECE):
                at, look = part.column("at").to_pylist(), part.column("look").to_pylist()
                ids, prints = part.column("id").to_pylist(), of(some)
                queue = [] if held is None else [held]
                queue += [(a, x, i, t.decode(), p) for a, x, i, t, p in zip(at, look, ids, some, prints, strict=True)]
                out = [(r, q) for r, q in zip(queue, queue[1:], strict=False) if not r[1]]
                held = queue[-1]
                edits = [_edit(r[3], q[3]) for r, q in out]
                marks = of([e.encode() for e in edits])
                yield pa.record_batch(
                    {
                        "id": pa.array([r[2] for r, _ in out], part.column("id").type),
                        "n_chars": pa.array([len(r[3]) for r, _ in out], pa.int64()),
                        "edited": pa.array(edits, pa.string()),
                        "fingerprint": pa.array([r[4] for r, _ in out], pa.string()),
                        "edited_fingerprint": pa.array(marks, pa.string()),
                        "near_edited": pa.array([likeness(r[4], m) for (r, _), m in zip(out, marks, strict=True)], pa.float64()),
                        "near_next": pa.array([likeness(r[4], q[4]) for r, q in out], pa.float64()),
                    }
                )

    id_type = rows.schema["id"].dataType.simpleString()
    return both.mapInArrow(
        follow,
        f"id {id_type}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
