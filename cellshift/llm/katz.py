"""Language-model scores by Katz backoff over pairs of words.

Counts are discounted by Good-Turing, and what that takes from the successors of a word
goes to all other words by their own probabilities, with a weight that makes the sum
exactly one. `fit` writes three tables:

    words       (word, wid, c), numbered by falling count, so a count follows from a number
    grams       (bucket, body): pairs of words with their counts, packed
    histories   (wid, weight, more): log10 of a word's backoff weight, and whether its
                successors are divided by one more than their sum

A pair's bucket is that of its first word; a frequent word has as many buckets as its count
asks for, so none grows with the corpus, and their number does. Texts are read in pieces
of some megabytes (`coded`): a piece sends each distinct pair once to its bucket, when
fitting with its count, when scoring as a question, which the bucket answers in order.

Tokens are words, A-Z in lower case, split at white space of ASCII, and one end for each
text; the first token follows a start that is no token. Words that were not learnt share
what the discount leaves of all probability. A history that was not learnt has weight one.
Null and empty texts are one end; repeated rows count each time; with nothing to learn from
every token has probability one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cellshift.llm.coded import cut, packed, plain_words, unpacked, vocabulary, with_numbers
from cellshift.llm.shared import discard, materialise
from cellshift.llm.words import U, mix

END = " "  # words hold no blank
START, UNKNOWN = -1, -2  # numbers of no word
MOST_DISCOUNTED = 5  # greater counts are taken as they are
_BUCKET = 1_000_000  # tokens a bucket on average
_PART = 500_000  # tokens of one history in one of its buckets
_AT_ONCE = 1 << 20  # pairs looked up together
_R = range(1, MOST_DISCOUNTED + 1)


@dataclass(frozen=True)
class Discount:
    """share[r]: the part of a count of r that is left."""

    share: tuple[float, ...]
    turing: bool

    @staticmethod
    def of(n: list[int]) -> Discount:
        """From the numbers n[r] of events counted r times, r up to MOST_DISCOUNTED + 1.

        Katz's form of Good-Turing. Where it gives no discount, as on tables that are too
        small or full of copies, an absolute one takes its place: n1 / (n1 + 2 n2), between
        0.1 and 0.9.
        """
        k, n1 = MOST_DISCOUNTED, n[1]
        if all(n[1 : k + 2]) and (common := (k + 1) * n[k + 1] / n1) < 1:
            share = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in _R]
            if all(0 < s < 1 for s in share):
                return Discount((1.0, *share), True)
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n[2]))) if n1 else 0.5
        return Discount((1.0, *[(r - d) / r for r in _R]), False)

    def counts(self, c: np.ndarray) -> np.ndarray:
        """The counts after the discount."""
        return np.where(c <= MOST_DISCOUNTED, np.array(self.share)[np.minimum(c, MOST_DISCOUNTED)], 1.0) * c


@dataclass(frozen=True)
class Known:
    """What tasks know of a model.

    `counts` are the distinct counts of words, falling, `firsts` the least number that has
    each, `many` how many words do: no more than the root of twice the tokens.
    """

    counts: np.ndarray
    firsts: np.ndarray
    many: np.ndarray
    texts: int
    buckets: int = 1
    of_words: Discount | None = None
    of_pairs: Discount | None = None

    @property
    def tokens(self) -> int:
        return int((self.counts * self.many).sum())

    @property
    def distinct(self) -> int:
        return int(self.many.sum())

    def count(self, wid: np.ndarray) -> np.ndarray:
        """How often a word was learnt, and how many starts were."""
        if not len(self.counts):
            return np.zeros(len(wid), np.int64)
        at = np.maximum(np.searchsorted(self.firsts, wid, "right") - 1, 0)
        return np.where(wid >= 0, self.counts[at], np.where(wid == START, self.texts, 0))

    def chances(self, wid: np.ndarray) -> np.ndarray:
        """The probability of each word by itself, and of all unknown ones together.

        If the discount takes nothing, since all words are frequent, one more token is
        counted and was unknown.
        """
        if not self.tokens:
            return np.ones(len(wid))
        taken = float(((self.counts - self.of_words.counts(self.counts)) * self.many).sum())
        taken, whole = (taken, self.tokens) if taken > 0 else (1.0, self.tokens + 1)
        c = self.count(wid)
        return np.where(c > 0, self.of_words.counts(c), taken) / whole

    def bucket(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        parts = self.parts(w1).astype(U)
        part = mix(w2.view(U)) % parts
        return (mix(mix(w1.view(U)) + part) % U(self.buckets)).astype(np.int64)

    def parts(self, w1: np.ndarray) -> np.ndarray:
        """How many buckets the successors of a word may lie in."""
        return 1 + self.count(w1) // _PART


@dataclass(frozen=True)
class Katz:
    words: DataFrame
    grams: DataFrame
    histories: DataFrame
    known: Known
    coded: DataFrame
    steps: tuple[DataFrame, ...]

    def discard(self) -> None:
        """Delete the tables."""
        discard(*self.steps)


@dataclass(frozen=True)
class Pairs:
    """The distinct pairs of a piece, by bucket, and where its tokens find them."""

    w1: np.ndarray
    w2: np.ndarray
    times: np.ndarray
    at: np.ndarray  # of each token its pair
    bucket: np.ndarray

    @staticmethod
    def of(tokens: bytes, sizes: np.ndarray, wids: bytes, known: Known, only: np.ndarray | None = None) -> Pairs:
        """Pairs whose first word is unknown are left out: -1 for their tokens. `only`: texts to take."""
        t, wids = unpacked(tokens).astype(np.int64), unpacked(wids, np.int64)
        if only is not None:
            t, sizes = t[np.repeat(only, sizes)], sizes[only]
        n = len(wids)
        before = np.empty_like(t)
        before[1:] = t[:-1]
        before[np.cumsum(sizes) - sizes] = n
        wids = np.append(wids, START)
        # Unknown words are one word.
        place = np.where(wids == UNKNOWN, n + 1, np.arange(n + 1))
        key, at, times = np.unique(before * (n + 2) + place[t], return_inverse=True, return_counts=True)
        wids = np.append(wids, UNKNOWN)
        w1, w2 = wids[key // (n + 2)], wids[key % (n + 2)]
        asked = np.flatnonzero(w1 != UNKNOWN)
        bucket = known.bucket(w1[asked], w2[asked])
        if known.buckets < 1 << 16:
            bucket = bucket.astype(np.uint16)  # sorted by digits
        order = np.lexsort((w1[asked], bucket))
        back = np.full(len(key), -1)
        back[asked[order]] = np.arange(len(order))
        asked = asked[order]
        return Pairs(w1[asked], w2[asked], times[asked], back[at], bucket[order].astype(np.int64))

    def blocks(self, *also: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, body) of the pairs, and of further values for each."""
        heads = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(heads, [*heads[1:], len(self.bucket)], strict=False):
            yield int(self.bucket[a]), _body(self.w1[a:b], self.w2[a:b], *[v[a:b] for v in also])


def _body(w1: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of long; the first one is in order, so its steps are kept."""
    return packed(np.concatenate([np.diff(w1, prepend=0), *others]))


def _columns(body: bytes, n: int) -> list[np.ndarray]:
    first, *others = unpacked(body, np.int64).reshape(n, -1)
    return [np.cumsum(first), *others]


def _pieces(batch: pa.RecordBatch, known: Known, learn: bool = False) -> Iterator[tuple[int, Pairs]]:
    for i in range(batch.num_rows):
        tokens, sizes, wids = (batch.column(c)[i] for c in ("tokens", "sizes", "wids"))
        only = batch.column("marked")[i].values.to_numpy(zero_copy_only=False) if learn else None
        yield i, Pairs.of(tokens.as_py(), sizes.values.to_numpy().astype(np.int64), wids.as_py(), known, only)


def _number(words: DataFrame) -> tuple[DataFrame, Known]:
    """(word, wid, c) by falling count, and what follows from the counts alone."""
    ordered = words.orderBy(F.desc("c"), "word").withColumn("wid", F.monotonically_increasing_id())
    numbered = materialise(ordered.select("word", "wid", "c"))
    levels = numbered.groupBy("c").agg(F.min("wid"), F.count("*")).orderBy(F.desc("c")).collect()
    counts, firsts, many = (np.array([r[i] for r in levels], np.int64) for i in range(3))
    ends = numbered.where(F.col("word") == END).select("c").first()
    n = [0] * (MOST_DISCOUNTED + 2)
    for c, m in zip(counts.tolist(), many.tolist(), strict=True):
        if c < len(n):
            n[c] = m
    return numbered, Known(counts, firsts, many, ends[0] if ends else 0, of_words=Discount.of(n))


def _cut(docs: DataFrame, learn: Column, id_column: str, text_column: str) -> DataFrame:
    columns = F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.lit(None).cast("string").alias("grp")
    return cut(docs.select(*columns, F.coalesce(learn, F.lit(False)).alias("marked")), plain_words, END)


def _coded(texts: DataFrame, words: DataFrame) -> DataFrame:
    return with_numbers(texts, words.select("word", "wid"), UNKNOWN)


_FACTS = [*[f"m{r}" for r in range(1, MOST_DISCOUNTED + 2)], "rest"]


def fit(docs: DataFrame, learn: Column | None = None, id_column="doc_id", text_column="text") -> Katz:
    """The model of the rows of docs for which `learn` is true, of all if it is not given.

    Its tables are written; `Katz.discard` deletes them. All rows are kept in the model's numbers,
    for `score_own`.
    """
    texts = _cut(docs, F.lit(True) if learn is None else learn, id_column, text_column)
    words, known = _number(vocabulary(texts).where("c > 0").select("word", "c"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = replace(known, buckets=max(partitions, known.tokens // _BUCKET))
    coded = _coded(texts, words)
    discard(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, pairs in _pieces(batch, known, learn=True):
                blocks = list(pairs.blocks(pairs.times))
                yield pa.record_batch(
                    [pa.array([b for b, _ in blocks], pa.int64()), pa.array([x for _, x in blocks], pa.binary())],
                    names=["bucket", "body"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket, and one for each history in it."""
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True))
        for bucket, blocks in groupby(rows, key=lambda r: r[0]):
            w1, w2, c = (np.concatenate(x) for x in zip(*(_columns(body, 3) for _, body in blocks), strict=True))
            order = np.lexsort((w2, w1))
            w1, w2, c = w1[order], w2[order], c[order]
            heads = np.flatnonzero((np.diff(w1, prepend=UNKNOWN - 1) != 0) | (np.diff(w2, prepend=UNKNOWN - 1) != 0))
            w1, w2, c = w1[heads], w2[heads], np.add.reduceat(c, heads)
            heads = np.flatnonzero(np.diff(w1, prepend=UNKNOWN - 1))
            facts = [np.add.reduceat((c == r).astype(np.int64), heads) for r in range(1, MOST_DISCOUNTED + 2)]
            facts.append(np.add.reduceat(np.where(c > MOST_DISCOUNTED, c, 0), heads))
            low = np.add.reduceat(known.chances(w2), heads)
            nothing = lambda kind, n: pa.nulls(n, kind)
            n = len(heads)
            yield pa.record_batch(
                [pa.array([bucket], pa.int64()), pa.array([_body(w1, w2, c)], pa.binary()), *[nothing(pa.int64(), 1)] * (len(facts) + 1), nothing(pa.float64(), 1)],
                names=["bucket", "body", "wid", *_FACTS, "low"],
            )
            yield pa.record_batch(
                [nothing(pa.int64(), n), nothing(pa.binary(), n), pa.array(w1[heads]), *map(pa.array, facts), pa.array(low)],
                names=["bucket", "body", "wid", *_FACTS, "low"],
            )

    longs = ", ".join(f"{name} long" for name in ["wid", *_FACTS])
    dealt = coded.select("marked", "tokens", "sizes", "wids").mapInArrow(send, "bucket long, body binary")
    dealt = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    counted = materialise(dealt.mapInArrow(count, f"bucket long, body binary, {longs}, low double"))
    each = counted.where("wid is not null").groupBy("wid").agg(*[F.sum(c).alias(c) for c in [*_FACTS, "low"]])
    totals = each.agg(*[F.sum(c) for c in _FACTS[:-1]]).first()
    known = replace(known, of_pairs=Discount.of([0, *[n or 0 for n in totals]]))
    histories = materialise(each.select("wid", *_weight(known.of_pairs)))
    grams = counted.where("bucket is not null").select("bucket", "body")
    return Katz(words, grams, histories, known, coded, (words, counted, histories, coded))


def _weight(discount: Discount) -> list[Column]:
    """log10 of what the discount takes, over what the seen successors leave of all words.

    If it takes nothing, since all successors are frequent, one more is counted that was
    none of them.
    """
    whole = sum((F.col(f"m{r}") * r for r in _R), F.col("rest"))
    taken = sum((F.col(f"m{r}") * (r * (1 - discount.share[r])) for r in _R), F.lit(0.0))
    more = taken <= 0
    left = F.when(more, F.lit(1.0)).otherwise(taken) / (whole + more.cast("int"))
    return [F.log10(left / (1 - F.col("low"))).alias("weight"), more.alias("more")]


def score(docs: DataFrame, model: Katz, id_column="doc_id", text_column="text") -> DataFrame:
    """`score_own` for other texts."""
    texts = _cut(docs, F.lit(False), id_column, text_column)
    coded = _coded(texts, model.words)
    discard(texts)
    return _score(coded, model)


def score_own(model: Katz) -> DataFrame:
    """Per row given to `fit`, learnt from or not: (id, n_tokens, n_known, base_score, score).

    score is log10 of the model's probability of the text. base_score takes each token by
    itself, with half an occurrence added to those of every learnt word and of one other; n_known
    counts the tokens that were learnt.
    """
    return _score(model.coded, model)


def _score(coded: DataFrame, model: Katz) -> DataFrame:
    known = model.known
    partitions = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, pairs in _pieces(batch, known):
                blocks = list(pairs.blocks())
                piece = pa.array([batch.column("piece")[i].as_py()] * len(blocks), pa.int64())
                yield pa.record_batch(
                    [pa.array([b for b, _ in blocks], pa.int64()), piece, pa.array([x for _, x in blocks], pa.binary())],
                    names=["bucket", "piece", "body"],
                )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each history goes to all buckets of its successors, in packs."""
        for batch in batches:
            wid, weight, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("wid", "weight", "more"))
            parts = known.parts(wid)
            at = np.repeat(np.arange(len(wid)), parts)
            part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            bucket = (mix(mix(wid[at].view(U)) + part.astype(U)) % U(known.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, at = bucket[order], at[order]
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            bodies = [packed(np.concatenate([wid[x], weight[x].view(np.int64), more[x]])) for x in np.split(at, heads[1:])]
            yield pa.record_batch([pa.array(bucket[heads]), pa.array(bodies[: len(heads)], pa.binary())], names=["bucket", "body"])

    asked = coded.select("piece", "tokens", "sizes", "wids").mapInArrow(ask, "bucket long, piece long, body binary")
    grams = model.grams.select("bucket", F.lit(-1).cast("long").alias("piece"), "body")
    placed = model.histories.mapInArrow(place, "bucket long, body binary").withColumn("piece", F.lit(-2).cast("long"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "piece", "body")), strict=True))
        for bucket, some in groupby(rows, key=lambda r: r[0]):
            learnt = Learnt()
            asked: list[tuple[int, list[np.ndarray]]] = []
            for _, piece, body in some:
                if piece == -2:
                    learnt.histories.append(unpacked(body, np.int64).reshape(3, -1))
                elif piece == -1:
                    learnt.grams = _columns(body, 3)
                else:
                    asked.append((piece, _columns(body, 2)))
                    if sum(len(q[0]) for _, q in asked) > _AT_ONCE:
                        yield learnt.answers(bucket, asked)
                        asked = []
            yield learnt.answers(bucket, asked)

    # In a bucket histories come first, then pairs, then questions.
    dealt = placed.unionByName(grams).unionByName(asked).repartition(partitions, "bucket").sortWithinPartitions("bucket", "piece")
    answers = materialise(dealt.mapInArrow(answer, "piece long, bucket long, counts binary, weights binary"))
    by_piece = answers.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts", "weights"))).alias("answers"))
    own = coded.schema["ids"].dataType.elementType
    result = StructType([StructField("id", own), *[StructField(c, LongType()) for c in ("n_tokens", "n_known")],
                         *[StructField(c, DoubleType()) for c in ("base_score", "score")]])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, pairs in _pieces(batch, known):
                tokens, wids = unpacked(batch.column("tokens")[i].as_py()), unpacked(batch.column("wids")[i].as_py(), np.int64)
                wid = wids[tokens]
                c = known.count(wid)
                alone = np.log10(known.chances(wid))
                total = np.zeros(0, np.int64), np.zeros(0)
                found = batch.column("answers")[i]
                if found.is_valid:
                    each = found.as_py()
                    total = (np.concatenate([unpacked(a["counts"], np.int64) for a in each]),
                             np.concatenate([unpacked(a["weights"], np.float64) for a in each]))
                chances = _chances(pairs, *total, known)
                of_pair = np.append(chances, 0.0)[pairs.at]
                unseen = np.append(total[0] == 0, True)[pairs.at]
                sizes = batch.column("sizes")[i].values.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                base = np.log10((c + 0.5) / (known.tokens + 0.5 * (known.distinct + 1)))
                sums = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, of_pair + np.where(unseen, alone, 0.0))]
                yield pa.record_batch([batch.column("ids")[i].values, pa.array(sizes), *map(pa.array, sums)], names=result.names)

    rows = coded.select("piece", "ids", "sizes", "tokens", "wids").join(by_piece, "piece", "left")
    return rows.mapInArrow(add_up, result)


class Learnt:
    """What a bucket holds: histories (wid, bits of the weight, more) in any order, and pairs in theirs."""

    def __init__(self):
        self.histories: list[np.ndarray] = []
        self.grams = [np.zeros(0, np.int64)] * 3
        self.wid: np.ndarray | None = None

    def _order(self) -> None:
        known = np.concatenate([np.zeros((3, 0), np.int64), *self.histories], axis=1)
        known = known[:, np.argsort(known[0])]
        self.wid, self.weight, self.more = known[0], known[1].view(np.float64), known[2] > 0
        self.seconds = np.unique(self.grams[1])
        # One number for a pair, in the order of pairs: all first words are histories.
        self.keys = self._key(np.searchsorted(self.wid, self.grams[0]), np.searchsorted(self.seconds, self.grams[1]))

    def _key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * (len(self.seconds) + 1) + second

    def find(self, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pairs, below zero if `more`, and weights of their first words."""
        if self.wid is None:
            self._order()
        if not len(self.wid):
            return np.zeros(len(w1), np.int64), np.zeros(len(w1))
        at = np.minimum(np.searchsorted(self.wid, w1), len(self.wid) - 1)
        is_history = self.wid[at] == w1
        counts = np.zeros(len(w1), np.int64)
        if len(self.keys):
            second = np.minimum(np.searchsorted(self.seconds, w2), len(self.seconds) - 1)
            key = self._key(at, second)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            seen = is_history & (self.seconds[second] == w2) & (self.keys[place] == key)
            counts = np.where(seen, self.grams[2][place], 0) * np.where(self.more[at], -1, 1)
        return counts, np.where(is_history, self.weight[at], 0.0)

    def answers(self, bucket: int, asked: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        """For each question the counts, and weights for the pairs that were not seen."""
        pairs = [np.concatenate([np.zeros(0, np.int64), *(q[i] for _, q in asked)]) for i in (0, 1)]
        ends = np.cumsum([len(q[0]) for _, q in asked])[:-1]
        counts, weights = (np.split(x, ends) for x in self.find(*pairs))
        n = len(asked)
        return pa.record_batch(
            [pa.array([piece for piece, _ in asked], pa.int64()), pa.array([bucket] * n, pa.int64()),
             pa.array([packed(c) for c in counts[:n]], pa.binary()),
             pa.array([packed(w[c == 0]) for c, w in zip(counts[:n], weights[:n], strict=True)], pa.binary())],
            names=["piece", "bucket", "counts", "weights"],
        )


def _chances(pairs: Pairs, counts: np.ndarray, weights: np.ndarray, known: Known) -> np.ndarray:
    """log10 of the probability of the pairs that were seen, and of the weight for the others."""
    out = np.zeros(len(counts))
    seen = counts != 0
    if known.of_pairs and seen.any():
        c = counts[seen]
        whole = known.count(pairs.w1[seen]) + (c < 0)
        out[seen] = np.log10(known.of_pairs.counts(np.abs(c)) / whole)
    out[~seen] = weights
    return out
