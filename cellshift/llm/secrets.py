"""Secrets in text: a trigram index names the texts worth a rule's regular expression.

From each rule's expression `trigram_query` derives which trigrams any match must hold,
as alternatives of sets. The index holds postings (trigram, text) for the trigrams that
some rule asks for; a text whose postings satisfy a rule is a candidate and is matched.
Rules without mandatory trigrams are matched everywhere.

Everything is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.llm.shared import keyed

_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` is long enough.

    The pattern is read by Java and by Python, so it keeps to what both have.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed patterns. A run of the class is found whole, so {24,} is the same as + with a
# check of the length behind it, and so for access keys, which end where the run ends.
# An assignment is not: a match that fails takes its text away from later ones.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams: a match holds all of one of them.

    An empty list means that nothing is mandatory.
    """
    needs: list[list[frozenset[str]]] = []
    open_strings = _walk(_parser.parse(pattern), [""], needs)
    _close(open_strings, needs)
    # One set of alternatives is enough to be right; the fewest alternatives with the
    # most trigrams select best.
    return min(needs, key=lambda alts: (len(alts), -min(map(len, alts))), default=[])


def _walk(nodes, strings: list[str], needs: list) -> list[str]:
    """The strings that may end where `nodes` end, each known since the last gap."""
    for kind, arg in nodes:
        if kind is op.LITERAL:
            more = [chr(arg)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            more = [chr(c) for _, c in arg]
        elif kind is op.SUBPATTERN:
            strings = _walk(arg[3], strings, needs)
            continue
        elif kind is op.BRANCH:
            more = _exact(arg[1])
        elif kind is op.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
            more = None if (once := _exact([arg[2]])) is None else ["", *once]
        elif kind is op.AT:
            continue
        else:
            more = None
        if more is None or len(strings) * len(more) > _MOST_STRINGS:
            _close(strings, needs)
            strings = [""] if more is None else more
        else:
            strings = [a + b for a, b in itertools.product(strings, more)]
    return strings


def _exact(branches) -> list[str] | None:
    """All strings that the branches match, if they are few and known."""
    out: list[str] = []
    for branch in branches:
        lost: list = []
        strings = _walk(branch, [""], lost)
        if lost or any(k not in (op.LITERAL, op.IN, op.SUBPATTERN, op.BRANCH, op.MAX_REPEAT) for k, _ in branch):
            return None
        out += strings
    return out if len(out) <= _MOST_STRINGS else None


def _close(strings: list[str], needs: list) -> None:
    alternatives = [
        frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in map(str.lower, strings)
    ]
    if all(alternatives):
        needs.append(list(dict.fromkeys(alternatives)))


def build_index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, k1, k2) of the given lower-case trigrams in `texts` (k1, k2, text)."""
    low = texts.select("k1", "k2", F.lower("text").alias("low"))
    there = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    return low.select("k1", "k2", F.explode(F.array_compact(F.array(*there))).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, kinds): texts that satisfy the trigram query of at least one rule.

    Lists are intersected by counting: a set of n trigrams is there if n of its postings
    meet in one text. The counts are made per text, so that a trigram which most texts
    hold never gathers in one place.
    """
    wanted = [
        (gram, rule.kind, f"{rule.kind}{i}", len(grams))
        for rule in rules
        for i, grams in enumerate(trigram_query(rule.pattern))
        for gram in sorted(grams)
    ]
    terms = index.sparkSession.createDataFrame(wanted, "gram string, kind string, alternative string, n int")
    return (
        index.join(F.broadcast(terms), "gram")  # as many rows as the rules have trigrams
        .groupBy("k1", "k2", "kind", "alternative", "n")
        .agg(F.count_distinct("gram").alias("met"))
        .where("met = n")
        .groupBy("k1", "k2")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def matches(text: Column, rule: Rule, nth: int) -> Column:
    """array<struct<s, nth, e, kind>> of the rule's matches, in code points."""
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part"),
    )
    nothing = F.array().cast("array<struct<s:int,nth:int,e:int,kind:string>>")

    def step(state, x):
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("s"), F.lit(nth).alias("nth"), end.alias("e"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.char_length(x["part"]) >= rule.least, F.concat(state["out"], F.array(span)))
        return F.struct(end.alias("at"), kept.otherwise(state["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda s: s["out"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(nothing)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column="doc_id", text_column="text") -> DataFrame:
    """Per row of docs: (id, text, spans), spans sorted by start and then by rule.

    A span is struct<s, nth, e, kind>: code points, end exclusive, nth the rule's place.
    Null texts are empty ones; without a match spans is an empty array; equal rows get
    equal spans.
    """
    texts = keyed(docs, id_column, text_column)
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = tuple(rule for rule in rules if queries[rule.kind])
    grams = sorted({g for alternatives in queries.values() for a in alternatives for g in a})
    if grams:
        texts = texts.join(candidates(build_index(texts, grams), indexed), ["k1", "k2"], "left")
    spans = [
        F.when(F.array_contains("kinds", rule.kind), matches(F.col("text"), rule, nth)).otherwise(
            F.array().cast("array<struct<s:int,nth:int,e:int,kind:string>>")
        )
        if queries[rule.kind]
        else matches(F.col("text"), rule, nth)
        for nth, rule in enumerate(rules)
    ]
    return texts.select("id", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"])), ","
    )
