"""Texts as numbers of words, in pieces of a few megabytes.

A piece lists its distinct words once and then refers to them, so what meets over the
corpus is a word per piece, not a word per occurrence: a word in every text is no hot key.
They meet in buckets of words, to which a piece sends one packed row each.
Memory follows a piece, which is as long as `_PIECE` or as the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.shared import discard, materialise
from cellshift.llm.words import LOWER, pieces

BREAK, SKIP = -1, -2
_PIECE = 6 << 20
_BUCKET = 250_000  # words with numbers in a bucket on average, if there are that many
_BREAKS = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else LOWER[c] for c in range(256))


def plain_words(texts: pa.Array) -> pa.Array:
    """The words of each text: A-Z in lower case, split at white space of ASCII."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def words_and_breaks(texts: pa.Array) -> pa.Array:
    """The same, and a full stop for every break: words end at blanks, tabs and breaks, and hold
    none of them."""
    return pc.ascii_split_whitespace(pa.array([t.translate(_BREAKS).replace(b".", b" . ") for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string()))


def packed(numbers: np.ndarray) -> bytes:
    """Byte by byte of all numbers, compressed: the upper bytes are nearly all alike."""
    numbers = np.ascontiguousarray(numbers)
    planes = numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(body: bytes, kind=np.int32) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def cut(texts: DataFrame, words_of: Callable[[pa.Array], pa.Array], closing: str | None = None) -> DataFrame:
    """(piece, grp, ids, marked, sizes, tokens, words, times) of rows (id, text, grp, marked), materialised.

    tokens are places in `words`, packed, `sizes` tokens for each of `ids` in their order, and
    times is how often each word occurs in marked texts. Each text ends with the word
    `closing`, if given. Null texts are empty ones. Texts without words are kept as well.
    """
    rows = texts.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "grp", "marked")
    known = rows.schema["id"].dataType.simpleString()

    def one(part: pa.RecordBatch, grp: str | None) -> list[pa.Array]:
        lists = words_of(part.column("text").cast(pa.string()))
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        t = coded.indices.to_numpy().astype(np.int32)
        words = coded.dictionary.to_pylist()
        # No word is empty: what white space at the ends of a text leaves is skipped.
        special = {"": SKIP, **({".": BREAK} if words_of is words_and_breaks else {})}
        places = np.array([special.get(w, 0) for w in words], np.int32)
        places[places == 0] = np.arange((places == 0).sum())
        t = places[t] if len(words) else t
        doc = np.repeat(np.arange(len(sizes)), sizes)[t != SKIP]
        t, words = t[t != SKIP], [w for w in words if w not in special]
        sizes = np.bincount(doc, minlength=len(sizes))
        if closing is not None:
            t, sizes, words = np.insert(t, np.cumsum(sizes), len(words)), sizes + 1, [*words, closing]
            doc = np.repeat(np.arange(len(sizes)), sizes)
        counted = part.column("marked").to_numpy(zero_copy_only=False)[doc] & (t >= 0)
        times = np.bincount(t[counted], minlength=len(words))
        return [
            pa.array([grp], pa.string()),
            _listed(part.column("id")),
            _listed(part.column("marked")),
            _listed(pa.array(sizes, pa.int32())),
            pa.array([packed(t.astype(np.int32))], pa.binary()),
            _listed(pa.array(words, pa.string())),
            _listed(pa.array(times, pa.int64())),
        ]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in pieces(batch, "text", _PIECE):
                of = part.column("grp")
                for grp in of.unique().to_pylist():
                    own = part.filter(pc.is_null(of) if grp is None else pc.equal(of, grp))
                    yield pa.record_batch(one(own, grp), names=["grp", "ids", "marked", "sizes", "tokens", "words", "times"])

    made = rows.mapInArrow(
        number,
        f"grp string, ids array<{known}>, marked array<boolean>, sizes array<int>, tokens binary, words array<string>, times array<bigint>",
    )
    return materialise(made.select(F.monotonically_increasing_id().alias("piece"), "*"))


def _listed(values: pa.Array) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def vocabulary(cut_texts: DataFrame) -> DataFrame:
    """(grp, word, c): how often each word occurs, counted by piece first."""
    each = cut_texts.select("grp", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    return each.groupBy("grp", "word").agg(F.sum("times").alias("c"))


def with_numbers(cut_texts: DataFrame, words: DataFrame, missing: int) -> DataFrame:
    """cut_texts with `wids`, packed: for each of the words of a piece its number, or `missing`.

    words: (grp, word, wid), without grp if the texts are one group. The words and times are
    dropped. Words meet their numbers in buckets: a piece sends each bucket its words as one packed
    row, as a row for every word of a piece would be several times as much to shuffle. The numbers
    are written before they meet the tokens, so that the shuffle of the words is gone by then.
    """
    grouped = "grp" in words.columns
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, words.count() // _BUCKET)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, grp, words in zip(*(batch.column(c) for c in ("piece", "grp", "words")), strict=True):
                own = words.values.cast(pa.binary()).to_pylist()
                if not own:
                    continue
                bucket = np.fromiter(map(crc32, own), np.int64, len(own)) % buckets
                order = np.argsort(bucket, kind="stable")
                heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                parts = np.split(order, heads[1:])
                n = len(parts)
                yield pa.record_batch(
                    [pa.array(bucket[order][heads]), pa.array([piece.as_py()] * n, pa.int64()), pa.array([grp.as_py()] * n, pa.string()),
                     pa.array([_joined([own[i] for i in part]) for part in parts], pa.binary()), pa.nulls(n, pa.int64()),
                     pa.array([packed(np.diff(part, prepend=0).astype(np.int32)) for part in parts], pa.binary())],
                    names=["bucket", "piece", "grp", "body", "wid", "places"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a bucket the words with numbers come first, then the questions."""
        at, known = None, {}
        for batch in batches:
            found = []
            rows = (batch.column(c).to_pylist() for c in ("bucket", "piece", "grp", "body", "wid", "places"))
            for bucket, piece, grp, body, wid, places in zip(*rows, strict=True):
                if bucket != at:
                    at, known = bucket, {}
                own = known.setdefault(grp if grouped else None, {})
                if places is None:
                    own[body] = wid
                else:
                    wids = np.array([own.get(w, missing) for w in _apart(body)], np.int64)
                    found.append((piece, places, packed(wids)))
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["piece", "places", "wids"])

    shape = "bucket long, piece long, grp string, body binary, wid long, places binary"
    asked = cut_texts.select("piece", "grp", "words").mapInArrow(ask, shape)
    word = F.col("word").cast("binary")
    numbered = words.select(
        (F.crc32(word) % buckets).alias("bucket"),
        F.lit(-1).cast("long").alias("piece"),
        (F.col("grp") if grouped else F.lit(None)).cast("string").alias("grp"),
        word.alias("body"),
        F.col("wid").cast("long").alias("wid"),
        F.lit(None).cast("binary").alias("places"),
    )
    dealt = numbered.unionByName(asked).repartition(partitions, "bucket").sortWithinPartitions("bucket", "piece")
    answers = materialise(dealt.mapInArrow(answer, "piece long, places binary, wids binary"))
    by_piece = answers.groupBy("piece").agg(F.collect_list(F.struct("places", "wids")).alias("answers"))
    rows = cut_texts.select("*", F.size("words").alias("n_words")).drop("words", "times").join(by_piece, "piece", "left")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, each in zip(*(batch.column(c) for c in ("n_words", "answers")), strict=True):
                wids = np.full(n.as_py(), missing, np.int64)
                for a in each.as_py() or ():
                    wids[np.cumsum(unpacked(a["places"]))] = unpacked(a["wids"], np.int64)
                found.append(packed(wids))
            kept = batch.drop_columns(["n_words", "answers"])
            yield kept.append_column("wids", pa.array(found, pa.binary()))

    schema = rows.drop("n_words", "answers").schema.add("wids", "binary")
    result = materialise(rows.mapInArrow(put, schema))
    discard(answers)
    return result


def _joined(words: list[bytes]) -> bytes:
    """No word holds a line end: all words end there."""
    return packed(np.frombuffer(b"\n".join(words), np.uint8))


def _apart(body: bytes) -> list[bytes]:
    return unpacked(body, np.uint8).tobytes().split(b"\n")


def group_of(column: Column) -> Column:
    """The column as text, null as `und`."""
    return F.coalesce(column.cast("string"), F.lit("und"))
