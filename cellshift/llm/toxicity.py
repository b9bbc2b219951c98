"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Learning rates are kept per coordinate, and the L1 term leaves most weights at exactly
zero: what is broadcast are the others, at most one for each hash value. The model is
fitted on a bounded sample of labelled rows (`rows`), one row of each of the ids with the
least hashes, in one task; features are made, and texts scored, wherever the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cellshift.llm.shared import keyed, materialise
from cellshift.llm.words import LETTERS, U, Words, mix, pieces

BITS = 20
# Words of a family share their beginning, so a word counts as a whole and by this much.
STEM_BYTES = 5
SAMPLE_ROWS = 12_000
_PIECE = 4 << 20


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words, stems, pairs of neighbours, and pairs one word apart."""
    hashes = words.hashes()
    docs, found = [words.doc, words.doc], [hashes, mix(words.hashes(STEM_BYTES) ^ U(1))]
    for gap in (1, 2):
        if words.total > gap:
            same = words.doc[gap:] == words.doc[:-gap]
            docs.append(words.doc[gap:][same])
            found.append(mix(hashes[:-gap] * U(2 * gap + 1) + hashes[gap:])[same])
    return np.concatenate(docs), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


class Ftrl:
    """One weight for each feature; features are there or not."""

    def __init__(self, alpha=1.0, beta=1.0, l1=5.0, l2=0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)  # the last one is always there
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 6,
        id_column="doc_id", text_column="text", label_column="toxic") -> DataFrame:
    """(feature, weight) of the weights that are not zero; feature 2**BITS is the bias.

    labels: (id, 0 or 1), of which `rows` are taken; ids labelled twice count as 1 if one
    label is 1, null labels and labels without a document not at all. Of the documents of
    one id the one with the least hash of its text counts. Without labels the result is empty.
    """
    chosen = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("label_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("label"))
        .withColumn("rank", F.xxhash64("label_id"))
        .orderBy("rank", "label_id")
        .limit(rows)
    )
    # Bounded by `rows`, hence broadcast.
    texts = keyed(docs, id_column, text_column).join(F.broadcast(materialise(chosen)), F.col("id") == F.col("label_id"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in pieces(batch, "text", _PIECE):
                doc, feature = features(Words(some, LETTERS))
                pairs = np.unique((doc << BITS) | feature)
                cuts = np.searchsorted(pairs >> BITS, np.arange(len(some) + 1))
                lists = [np.unique(pairs[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch(
                    [part.column("rank"), part.column("k2"), part.column("label"), pa.array([x.tobytes() for x in lists], pa.binary())],
                    names=["rank", "k2", "label", "features"],
                )

    made = texts.select("rank", "k2", "label", "text").mapInArrow(sketch, "rank long, k2 long, label int, features binary")
    # One row for each id, cut before the shuffle: an id may hold any share of all rows.
    nth = F.row_number().over(Window.partitionBy("rank").orderBy("k2"))
    made = made.withColumn("nth", nth).where("nth = 1").drop("nth")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)), key=lambda r: r[:2])
        model = Ftrl()
        for _ in range(epochs):
            for _, _, label, at in rows:
                model.learn(np.frombuffer(at, np.int32), label)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.record_batch({"feature": pa.array(at), "weight": pa.array(w[at])})

    # All of the bounded sample meets in one task.
    return materialise(made.repartition(1).mapInArrow(train, "feature long, weight double"))


def score(docs: DataFrame, model: DataFrame, id_column="doc_id", text_column="text", keep: list = ()) -> DataFrame:
    """Per row of docs: (id, k1, k2, score, *keep), score between 0 and 1.

    Null and empty texts get what the bias alone says, and 0.5 without a model.
    """
    known = model.collect()  # at most 2**BITS + 1 rows
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in known])
    rows = keyed(docs, id_column, text_column, list(keep))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[[at for at, _ in shared.value]] = [weight for _, weight in shared.value]
        for batch in batches:
            for part, some in pieces(batch, "text", _PIECE):
                doc, feature = features(Words(some, LETTERS))
                counts = w[feature] != 0
                pairs = np.unique((doc[counts] << BITS) | feature[counts])
                total = np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], len(some)) + w[-1]
                columns = [c for c in part.schema.names if c != "text"]
                yield pa.record_batch([*[part.column(c) for c in columns], pa.array(sigmoid(total))], names=[*columns, "score"])

    kept = [f for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(judge, StructType([*kept, StructField("score", DoubleType())]))


def drop_toxic(docs: DataFrame, model: DataFrame, bar: float = 0.7, id_column="doc_id", text_column="text") -> DataFrame:
    """The rows of docs that score below the bar, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = score(docs, model, id_column, text_column, [whole])
    return scored.where(F.col("score") < bar).select("row.*")
