"""Phrases whose words keep together, best first, by branch and bound.

A phrase grows from its first word. Cut behind that word, no phrase scores more than
1000 n / f(first word), since it is no more frequent than its rest. So the frontier are
first words, and those with the best bounds, the rarest, come first. A wave takes the best part
of each language's frontier and grows it, a word at a time and only where the prefix is
frequent; then it scores what it found. A language is settled when the bounds that are left
lie below its last score that counts; all phrases that tie with it are found by then.

Words that are frequent enough are numbered by rising count, so a wave is a range of
numbers for each language. A level of a wave is one pass over the numbered corpus (`coded`) and
one aggregate, combined before its shuffle. Of earlier levels tasks see a bitmap of fixed size
over hashes of phrases: a false positive costs a row that the aggregate throws away.
Phrases are compared by their words, and all counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellshift.llm.coded import cut, group_of, unpacked, vocabulary, with_numbers, words_and_breaks
from cellshift.llm.shared import discard, materialise
from cellshift.llm.words import U, mix

MAP_BITS = 26  # a bitmap has 8 MB, whatever the corpus
FIRST_WAVE, GROWTH = 1 / 64, 8  # share of the occurrences of frequent words
LEAST_WAVE = 4_000_000  # occurrences that are not worth a wave of their own
_WORD = 8  # bytes of a word's number in a phrase
_ROWS = 1 << 18
_FOUND = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)), exact while 1000 a n has no more than 38 digits."""
    a, n, l, r = (c.cast("decimal(19,0)") for c in (a, n, l, r))  # noqa: E741
    thousand = F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", thousand * a * n, l * r)


def _sequence(row: dict) -> np.ndarray:
    """Numbers of the words of a piece, 0 for rare words, for breaks and at the end of texts."""
    words = np.append(unpacked(row["wids"], np.int64), 0)[unpacked(row["tokens"])]  # a break is -1
    return np.insert(words, np.cumsum(row["sizes"]), 0)


def _phrases(w: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where phrases start whose first word lies in the range, and their words."""
    at = np.flatnonzero((w >= max(low, 1)) & (w <= high))
    at = at[at + size <= len(w)]
    for i in range(1, size):
        at = at[w[at + i] > 0]
    return at, [w[at + i] for i in range(size)]


def _hash(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), len(words), U)
    for column in words:
        h = mix(h ^ column.view(U))
    return h


def _grams(words: list[np.ndarray]) -> pa.Array:
    body = np.stack(words, axis=1).astype("<i8", order="C")
    n, size = body.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (size * _WORD)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def bitmap(grams: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A bit for the hash of each `gram`, in 2**bits / 64 words: no more rows are collected."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[bytes]] = {}
            for gram in batch.column("gram").to_pylist():
                by_size.setdefault(len(gram) // _WORD, []).append(gram)
            for size, some in by_size.items():
                table = np.frombuffer(b"".join(some), "<i8").reshape(-1, size)
                bit = _hash([np.ascontiguousarray(column) for column in table.T]) >> U(64 - bits)
                word = (U(1) << (bit & U(63))).view(np.int64)
                yield pa.record_batch({"slot": pa.array((bit >> U(6)).astype(np.int64)), "word": pa.array(word)})

    found = grams.select("gram").mapInArrow(slots, "slot long, word long").groupBy("slot").agg(F.bit_or("word"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for slot, word in found.collect():
        out[slot] = word
    return out.view(U)


def _is_in(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> U(64 - 6 - (len(known).bit_length() - 1))
    return (known[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1


def _over_pieces(coded: DataFrame, find: Callable, schema: str) -> DataFrame:
    """(grp, *schema): what `find(sequence, grp)` gives for each piece, as columns."""
    names = ["grp", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                columns = find(_sequence(row), row["grp"])
                for a in range(0, len(columns[0]), _ROWS):
                    part = [c.slice(a, _ROWS) for c in columns]
                    yield pa.record_batch([pa.array([row["grp"]] * len(part[0]), pa.string()), *part], names=names)

    return coded.select("grp", "tokens", "sizes", "wids").mapInArrow(run, f"grp string, {schema}")


def grow(coded: DataFrame, ranges: dict[str, tuple[int, int]], size: int, prefixes: np.ndarray | None, least: int, last: bool) -> DataFrame:
    """(grp, gram, a, inside): phrases of `size` words that occur `least` times, with first words
    in the language's range of numbers and with known prefixes.

    inside: one word stands before all occurrences, or one behind all, so that a longer
    phrase is as frequent. Not so for the `last` level: there are no longer phrases.
    """
    known = None if prefixes is None else coded.sparkSession.sparkContext.broadcast(prefixes)

    def find(w: np.ndarray, grp: str) -> list[pa.Array]:
        at, words = _phrases(w, size, *ranges.get(grp, (1, 0)))
        if known is not None:
            take = _is_in(known.value, _hash(words[:-1]))
            at, words = at[take], [c[take] for c in words]
        around = np.concatenate([[0], w, [0]])
        return [_grams(words), pa.array(around[at]), pa.array(around[at + size + 1])]

    def one(c: str) -> Column:
        return (F.min(c) == F.max(c)) & (F.min(c) > 0)

    each = _over_pieces(coded, find, "gram binary, before long, behind long")
    inside = F.lit(False) if last else one("before") | one("behind")
    return each.groupBy("grp", "gram").agg(F.count("*").alias("a"), inside.alias("inside")).where(F.col("a") >= least)


def occurrences(coded: DataFrame, wanted: DataFrame, sizes: range) -> DataFrame:
    """(grp, gram, a): how often the phrases `wanted` (grp, gram), of these sizes, occur."""
    known = coded.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def find(w: np.ndarray, grp: str) -> list[pa.Array]:
        found = []
        for size in sizes:
            _, words = _phrases(w, size, 1, np.iinfo(np.int64).max)
            take = _is_in(known.value, _hash(words))
            found.append(_grams([c[take] for c in words]))
        return [pa.concat_arrays(found)]

    each = _over_pieces(coded, find, "gram binary").groupBy("grp", "gram").agg(F.count("*").alias("a"))
    return each.join(wanted.select("grp", "gram"), ["grp", "gram"], "left_semi")


def _cuts(found: DataFrame) -> DataFrame:
    """A row for each cut after the first k words, with both parts."""
    size = F.octet_length("gram") / _WORD
    cuts = found.select("grp", "gram", "a", F.explode(F.sequence(F.lit(1), size.cast("int") - 1)).alias("k"))
    at = F.col("k") * _WORD
    return cuts.withColumn("first", F.substring("gram", F.lit(1), at)).withColumn(
        "rest", F.substring("gram", at + 1, F.octet_length("gram"))
    )


def _with_count(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    known = counts.select("grp", F.col("gram").alias(part), F.col("a").alias(name))
    return cuts.join(known, ["grp", part])


@dataclass
class Frontier:
    """A language's first words that are not grown, by rising count: (least count, numbers,
    occurrences) of each part. `least_score` is the last score that counts, once there are
    enough."""

    n: int
    parts: list[tuple[int, tuple[int, int], int]]
    least_score: int = -1

    def pop(self, share: float, all_words: int) -> tuple[int, int] | None:
        """The range of numbers with the best bounds, about `share` of all occurrences or LEAST_WAVE."""
        taken: list[tuple[int, int]] = []
        size = 0
        while self.parts and (not taken or size < max(share * all_words, LEAST_WAVE)):
            least, numbers, words = self.parts[0]
            if 1000 * self.n // least < self.least_score:
                self.parts.clear()  # settled
                break
            taken.append(numbers)
            size += words
            self.parts.pop(0)
        return (taken[0][0], taken[-1][1]) if taken else None


def _number(spark: SparkSession, vocab: DataFrame, least: int) -> tuple[DataFrame, dict[str, Frontier]]:
    """(grp, word, c, wid) of frequent words by rising count, and each language's frontier.

    A language is a small dimension: the driver holds a few hundred numbers for each one that has
    a frequent word.
    """
    ordered = vocab.where(F.col("c") >= least).orderBy("c", "grp", "word")
    words = materialise(ordered.withColumn("wid", F.monotonically_increasing_id() + 1))
    totals = {r[0]: r[1] for r in vocab.groupBy("grp").agg(F.sum("c")).join(words.select("grp").distinct(), "grp").collect()}
    parts = words.groupBy("grp", F.floor(F.log2("c") * 4).alias("part")).agg(
        F.min("c"), F.min("wid"), F.max("wid"), F.sum("c")
    )
    frontiers = {grp: Frontier(n, []) for grp, n in totals.items()}
    for grp, _, low, first, last, size in sorted(parts.collect()):
        frontiers[grp].parts.append((low, (first, last), size))
    return words, frontiers


def _wave(coded: DataFrame, words: DataFrame, frontiers: dict[str, Frontier], ranges: dict, least: int, longest: int) -> DataFrame:
    """(grp, gram, a, l, r, n, score) of the phrases of a wave that are not inside others and whose
    score may count."""
    levels: list[DataFrame] = []
    prefixes = None
    for size in range(2, longest + 1):
        levels.append(materialise(grow(coded, ranges, size, prefixes, least, size == longest)))
        if size < longest:
            prefixes = bitmap(levels[-1])
            if not prefixes.any():
                break
    single = words.select("grp", _number_as_gram().alias("gram"), F.col("c").alias("a"))
    prefix_counts = reduce(DataFrame.unionByName, [level.select("grp", "gram", "a") for level in levels], single)
    known = coded.sparkSession.createDataFrame([(g, f.n, f.least_score) for g, f in frontiers.items()], "grp string, n long, least_score long")
    survivors = reduce(DataFrame.unionByName, levels).where(~F.col("inside"))
    cuts = _with_count(_cuts(survivors), prefix_counts, "first", "l").join(F.broadcast(known), "grp")
    score = exact_score(*(F.col(c) for c in ("a", "n", "l", "r"))).alias("score")
    # Cut before its last word a phrase can be scored at once, which rules most of them out.
    ends = _with_count(cuts.where(F.octet_length("rest") == _WORD), single, "rest", "r")
    open_ones = ends.where(score >= F.col("least_score")).select("grp", "gram")
    cuts = materialise(cuts.join(open_ones, ["grp", "gram"], "left_semi"))
    wanted = materialise(cuts.where(F.octet_length("rest") > _WORD).select("grp", F.col("rest").alias("gram")).distinct())
    rests = single.unionByName(occurrences(coded, wanted, range(2, longest)))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    scored = _with_count(cuts, rests, "rest", "r").withColumn("score", score).groupBy("grp", "gram", "a", "n", "least_score").agg(best)
    scored = scored.select("grp", "gram", "a", "best.l", "best.r", "n", "best.score").where(F.col("score") >= F.col("least_score"))
    result = materialise(scored)
    discard(*levels, cuts, wanted)
    return result


def _number_as_gram() -> Column:
    """The bytes of the number, last first, as in phrases."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex("wid"), 16, "0"), F.lit("(..)"))), ""))


def _least_scores(found: DataFrame, most: int) -> dict[str, int]:
    """The last score that counts, for languages with enough phrases."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score")))
    top = found.select("grp", "score", rank.alias("rank")).where(F.col("rank") <= most)
    counted = top.groupBy("grp").agg(F.min("score").alias("score"), F.count("*").alias("many"))
    return {r[0]: r[1] for r in counted.where(F.col("many") == most).collect()}


def _spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the phrase's words, joined by a blank."""
    place = F.explode(F.sequence(F.lit(0), (F.octet_length("gram") / _WORD).cast("int") - 1))
    each = found.select("grp", "gram", place.alias("place"))
    each = each.withColumn("word_gram", F.substring("gram", F.col("place") * _WORD + 1, F.lit(_WORD)))
    named = words.select("grp", _number_as_gram().alias("word_gram"), "word")
    together = each.join(named, ["grp", "word_gram"]).groupBy("grp", "gram").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    phrase = F.array_join(F.col("words.word"), " ").alias("phrase")
    return found.join(together.select("grp", "gram", phrase), ["grp", "gram"])


def collocations(docs: DataFrame, most: int = 2000, least: int = 100, longest: int = 5, text_column="text", lang_column="lang") -> DataFrame:
    """Of each language the `most` best phrases: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and split into pieces at `.,;:!?` and line ends, pieces into
    words at blanks and tabs. n words of the language, phrases of 2 to `longest` words that
    occur a >= `least` times. A phrase's score is that of its worst cut, into parts that
    occur l and r times: floor(1000 a n / (l r)); of equal cuts the first one. A phrase that lies
    in a longer one of the same frequency is left out. Order: score and a falling, then the
    phrase by its bytes. Null texts hold nothing, a null language is `und`, repeated rows
    count each time. The result is written, and read from there.
    """
    spark = docs.sparkSession
    texts = docs.select(F.lit(0).alias("id"), F.col(text_column).alias("text"), group_of(F.col(lang_column)).alias("grp"), F.lit(True).alias("marked"))
    pieces = cut(texts, words_and_breaks)
    vocab = materialise(vocabulary(pieces))
    words, frontiers = _number(spark, vocab, least)
    coded = with_numbers(pieces, words, 0)
    discard(pieces, vocab)
    sizes = {grp: sum(size for *_, size in f.parts) for grp, f in frontiers.items()}
    waves: list[DataFrame] = []
    share = FIRST_WAVE
    while ranges := {g: taken for g, f in frontiers.items() if (taken := f.pop(share, sizes[g]))}:
        waves.append(_wave(coded, words, frontiers, ranges, least, longest))
        for grp, score in _least_scores(reduce(DataFrame.unionByName, waves), most).items():
            frontiers[grp].least_score = score
        share = min(1, share * GROWTH)
    discard(coded)
    if not waves:
        return spark.createDataFrame([], _FOUND)
    limits = spark.createDataFrame([(g, f.least_score) for g, f in frontiers.items()], "grp string, least_score long")
    found = reduce(DataFrame.unionByName, waves).join(F.broadcast(limits), "grp").where(F.col("score") >= F.col("least_score"))
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _spelled(found, words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    result = materialise(ranked.select(F.col("grp").alias("lang"), F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))
    discard(words, *waves)
    return result
