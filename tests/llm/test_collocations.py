import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cellshift.llm import collocations
from cellshift.llm.collocations import exact_score
from cellshift.llm.queries import op11_collocations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, gram binary, c long, word string, n int, rank int"


def brute(docs, most, least, longest=5):
    """The contract over dictionaries of word tuples."""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = {q for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[q := p[i : i + k]] <= f[p]}
        rows = []
        for p in set(found) - inside:
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):  # noqa: E741
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def made(spark, docs):
    return spark.createDataFrame([(i, t, lang, b"", 1, "w", 2, 3) for i, (t, lang) in enumerate(docs)], SCHEMA)


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def texts(seed, many, langs=("en", "de", None, "und", "")):
    rng = random.Random(seed)
    fixed = ["New York City hall", "a a a a a a a", "Öl und Gas", "x\x1cy z", "one two three four five six seven"]
    out = []
    for _ in range(many):
        words = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        joined = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        out.append((joined, rng.choice(langs)))
    return out


@pytest.mark.parametrize("most, least_wave", [(3, 500), (2000, 10**6)])
def test_against_brute_force(spark, monkeypatch, most, least_wave):
    monkeypatch.setattr(collocations, "LEAST_WAVE", least_wave)
    docs = [*texts(1, 150), (None, "en"), ("", None), (" \t.\n", "fr"), ("one. two", "xx"), *texts(2, 1) * 12, (" ".join(f"w{i % 7}" for i in range(30000)), "en")]
    found = collocations.collocations(made(spark, docs).repartition(3), most=most, least=8)
    assert rows(found) == brute(docs, most, 8)


def test_ties_at_the_last_rank(spark):
    docs = [(" . ".join(f"a{i} b{i}" for i in range(40)), "en")] * 5 + [("c d . " * 9, "en")]
    found = rows(collocations.collocations(made(spark, docs), most=7, least=5))
    assert found == brute(docs, 7, 5)
    assert {r[2] for r in found} >= {"a0 b0", "a1 b1", "a10 b10"}


def test_stops_when_settled(spark, monkeypatch):
    """Frequent first words are not grown once rarer ones have settled a language."""
    grown = []
    real = collocations._wave

    def spy(coded, words, frontiers, ranges, *rest):
        grown.append(dict(ranges))
        return real(coded, words, frontiers, ranges, *rest)

    monkeypatch.setattr(collocations, "_wave", spy)
    monkeypatch.setattr(collocations, "LEAST_WAVE", 100)
    rare = [(" . ".join(f"a{i} b{i}" for i in range(30)), "en")] * 5
    common = [("the of the and of the " * 300, "en")] * 5
    docs = rare + common
    found = rows(collocations.collocations(made(spark, docs), most=10, least=5))
    assert found == brute(docs, 10, 5)
    words = 60 + 3
    assert max(high for wave in grown for _, high in wave.values()) < words


def test_nothing_frequent(spark):
    docs = [("a b c", "en"), (None, None)]
    assert rows(collocations.collocations(made(spark, docs), least=2)) == set()
    assert rows(collocations.collocations(made(spark, docs).where("false"))) == set()


def test_scores_beyond_64_bits(spark):
    cases = [(100, 10**15, 100, 100), (7, 5, 3, 2), (10**13, 10**16, 10**14, 10**13), (3 * 10**9, 8 * 10**12, 5 * 10**9, 3 * 10**9 + 1), (999, 10**16 - 1, 1000, 999)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, n long, l long, r long")
    found = df.select("i", exact_score(*(F.col(c) for c in "anlr")).alias("s")).collect()
    assert {r.i: r.s for r in found} == {i: 1000 * a * n // (l * r) for i, (a, n, l, r) in enumerate(cases)}  # noqa: E741


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAP_BITS", 7)
    monkeypatch.setattr(collocations.bitmap, "__defaults__", (7,))
    docs = texts(5, 60)
    assert rows(collocations.collocations(made(spark, docs), most=20, least=6)) == brute(docs, 20, 6)


def test_query(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(op11_collocations(spark, SF)) == brute(docs, 2000, 100)
