"""Benchmark passages in training text, by a distributed positional inverted index.

`build_index` stores postings (text, term, place) of the terms that the test items use.
`phrase_matches` ranks the terms of each item window by how often the index holds them,
starts from the lists of the rarest ones, shifts each list by the term's offset and
keeps the places where all lists meet; what is left is compared word by word.
`proximity_matches` lets the shifted places differ.

Everything is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.shared import ascii_lower, keyed, materialise, small_side

# What separates words: ASCII that is neither a letter nor a digit.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
# Index entry that each text has once, also an empty one.
_TEXT_ITSELF = ""


def words_of(text: Column) -> Column:
    """'' and then the words of text, lower-cased in ASCII; null and empty: only ''."""
    # Upper-case letters are gone here, so the class above may hold their codes.
    bare = F.trim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_SEPARATORS))
    return F.when(bare == "", F.array(F.lit(""))).otherwise(
        F.split(F.concat(F.lit(" "), bare), SEPARATOR)
    )


def item_windows(items: DataFrame, size: int, id_column="item_id", text_column="text"):
    """(windows, owners): distinct windows (wid, words) and who has them (wid, item).

    A window is `size` consecutive words; an item with fewer, but not none, is one
    window. Null and empty items have none; repeated items share their windows.
    """
    words = items.select(
        F.col(id_column).cast("string").alias("item"), words_of(F.col(text_column)).alias("w")
    ).where("size(w) > 1")
    starts = F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("w") - size + 1))
    each = words.select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")
    ).select(F.xxhash64(F.concat_ws(" ", "words")).alias("wid"), "words", "item")
    each = materialise(each.distinct())
    return (
        materialise(each.groupBy("wid", "words").agg(F.lit(1).alias("one")).drop("one")),
        materialise(each.select("wid", "item").distinct()),
    )


def build_index(docs: DataFrame, terms: DataFrame, id_column="doc_id", text_column="text"):
    """Postings (k1, k2, id, n_words, term, place) of the given terms (column term: hash).

    place counts words from 0; each text has one more entry for the term '' at -1.
    Each file of the index holds all postings of its own texts, so that building it
    needs no shuffle. It is written to the shared folder.
    """
    tokens = keyed(docs, id_column, text_column).withColumn("w", words_of(F.col("text")))
    tokens = tokens.select(
        "k1", "k2", "id", (F.size("w") - 1).cast("long").alias("n_words"), F.posexplode("w")
    ).select("k1", "k2", "id", "n_words", F.xxhash64("col").alias("term"), (F.col("pos") - 1).alias("place"))
    return materialise(tokens.join(small_side(terms), "term", "left_semi"))


def vocabulary(windows: DataFrame) -> DataFrame:
    """Hashes of the terms of the windows and of the entry that each text has."""
    terms = windows.select(F.explode("words").alias("t"))
    nothing = windows.sparkSession.range(1).select(F.lit(_TEXT_ITSELF).alias("t"))
    return materialise(terms.union(nothing).select(F.xxhash64("t").alias("term")).distinct())


def anchors(index: DataFrame, windows: DataFrame, rarest: int) -> DataFrame:
    """(term, wid, offset, n_anchors, nth): the rarest terms of each window.

    A window with a term that the index does not hold cannot occur and has no anchors.
    """
    uses = windows.select("wid", F.size("words").alias("n"), F.posexplode("words")).select(
        "wid", "n", F.xxhash64("col").alias("term"), F.col("pos").alias("offset")
    )
    uses = uses.groupBy("wid", "n", "term").agg(F.min("offset").alias("offset"))
    held = index.groupBy("term").agg(F.count("*").alias("held"))
    # At most `size` terms a window, so the lists below are bounded.
    ranked = (
        uses.join(held, "term", "left")
        .groupBy("wid")
        .agg(
            F.array_sort(F.collect_list(F.struct("held", "offset", "term"))).alias("terms"),
            F.bool_and(F.col("held").isNotNull()).alias("all_held"),
        )
        .where("all_held")
        .withColumn("terms", F.slice("terms", 1, rarest))
    )
    return materialise(
        ranked.select("wid", F.size("terms").alias("n_anchors"), F.posexplode("terms")).select(
            "wid", "n_anchors", F.col("pos").alias("nth"), "col.offset", "col.term"
        )
    )


def _shifted(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Places where a window would start if an anchor found there belongs to it."""
    return index.join(small_side(chosen), "term").select(
        "k1", "k2", "wid", "n_anchors", "nth", (F.col("place") - F.col("offset")).alias("at")
    )


def _checked(docs: DataFrame, windows: DataFrame, found: DataFrame, keep: Column, slack: int,
             id_column: str, text_column: str) -> DataFrame:
    """(k1, k2, wid, at, n) of those candidates whose words pass `keep`."""
    # A text's candidates: at most one for each of its places and each window there.
    per_text = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("wid", "at", "n")).alias("found"))
    texts = keyed(docs, id_column, text_column).select("k1", "k2", "text").join(per_text, ["k1", "k2"])
    # Repeated rows would yield the same candidates again; distinct comes below.
    spans = texts.withColumn("w", words_of(F.col("text"))).select(
        "k1",
        "k2",
        F.explode(
            F.transform(
                "found",
                lambda c: F.struct(
                    c.wid.alias("wid"),
                    c["at"].alias("at"),
                    c["n"].alias("n"),
                    F.slice(
                        "w",
                        F.greatest(c["at"] - slack, F.lit(0)) + 2,
                        c["n"] + F.least(c["at"], F.lit(slack)) + slack,
                    ).alias("seen"),
                ),
            )
        ).alias("c"),
    ).select("k1", "k2", "c.*")
    return (
        spans.join(small_side(windows), "wid").where(keep).select("k1", "k2", "wid", "at", "n").distinct()
    )


def phrase_matches(docs: DataFrame, index: DataFrame, windows: DataFrame, rarest: int = 3,
                   id_column="doc_id", text_column="text") -> DataFrame:
    """(k1, k2, wid, at, n): each window of n words that a text has from word `at` on."""
    lists = _shifted(index, anchors(index, windows, rarest))
    met = (
        lists.groupBy("k1", "k2", "wid", "at", "n_anchors")
        .agg(F.expr("bit_or(shiftleft(1L, nth))").alias("lists"))
        .where("lists = shiftleft(1L, n_anchors) - 1 AND at >= 0")
    )
    sizes = windows.select("wid", F.size("words").alias("n"))
    found = materialise(met.join(small_side(sizes), "wid").select("k1", "k2", "wid", "at", "n"))
    return _checked(docs, windows, found, F.col("seen") == F.col("words"), 0, id_column, text_column)


def proximity_matches(docs: DataFrame, index: DataFrame, windows: DataFrame, slack: int = 5,
                      share: float = 0.8, rarest: int = 3, id_column="doc_id", text_column="text"):
    """(k1, k2, wid, at, n): windows whose words are near each other, in any order.

    The shifted places of all anchors lie within `slack` words, and at least `share` of
    the window's distinct words are between `slack` words before `at`, their first
    place, and as many behind its end. Places are taken in strides of `slack` and the
    stride before, so each near set of places meets in one group.
    """
    lists = _shifted(index, anchors(index, windows, rarest))
    stride = F.floor(F.col("at") / slack)
    met = (
        lists.withColumn("stride", F.explode(F.array(stride, stride - 1)))
        .groupBy("k1", "k2", "wid", "stride", "n_anchors")
        .agg(F.expr("bit_or(shiftleft(1L, nth))").alias("lists"), F.min("at").alias("at"))
        .where("lists = shiftleft(1L, n_anchors) - 1")
        .withColumn("at", F.greatest("at", F.lit(0)))
    )
    sizes = windows.select("wid", F.size("words").alias("n"))
    found = materialise(met.join(small_side(sizes), "wid").select("k1", "k2", "wid", "at", "n").distinct())
    enough = F.size(F.array_intersect("seen", "words")) >= share * F.size(F.array_distinct("words"))
    return _checked(docs, windows, found, enough, slack, id_column, text_column)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 3,
                  id_column="doc_id", text_column="text") -> DataFrame:
    """Per row of docs: (id, k1, k2, n_words, n_hit, items) with items a sorted array.

    A word is hit if it lies in an occurrence of a window of any item. Null and empty
    texts have no words; equal rows get equal results; without items nothing is hit.
    """
    windows, owners = item_windows(items, size)
    index = build_index(docs, vocabulary(windows), id_column, text_column)
    matches = phrase_matches(docs, index, windows, rarest, id_column, text_column)
    covered = F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    hits = (
        matches.join(small_side(owners), "wid")
        .groupBy("k1", "k2")
        .agg(
            F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
            F.array_sort(F.collect_set("item")).alias("items"),
        )
    )
    texts = index.where(F.col("term") == F.xxhash64(F.lit(_TEXT_ITSELF))).select("k1", "k2", "id", "n_words")
    return texts.join(hits, ["k1", "k2"], "left").select(
        "id",
        "k1",
        "k2",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, **columns) -> DataFrame:
    """The rows of docs without a hit word, with all their columns."""
    hit = contamination(docs, items, size, **columns).where("n_hit > 0").select("k1", "k2").distinct()
    hit = materialise(hit)  # frees the texts that were shuffled to find it
    id_column, text_column = columns.get("id_column", "doc_id"), columns.get("text_column", "text")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return keyed(docs, id_column, text_column, [whole]).join(hit, ["k1", "k2"], "left_anti").select("row.*")
