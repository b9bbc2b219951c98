"""Fingerprints, toxicity and packing."""


import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cellshift.llm import fingerprints, packing, toxicity
from cellshift.llm.queries import tokenizer
from cellshift.llm.shared import keyed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_edited_neighbours(docs_of, odd):
    docs = docs_of([p for p in odd if p[0] not in (7, 13, None)])
    lexicon = fingerprints.fit_lexicon(docs, most_share=0.9)
    rows = {r["id"]: r for r in fingerprints.edited_neighbours(docs, lexicon).collect()}
    texts = {i: t or "" for i, t in odd if i in rows}
    order = sorted(texts, reverse=True)
    for i, after in zip(order, order[1:] + order[:1]):
        n = len(texts[i]) // 3
        assert rows[i]["edited"] == texts[i][: len(texts[i]) - n] + texts[after][:n]
        assert rows[i]["n_chars"] == len(texts[i])
        assert rows[i]["near_next"] == fingerprints.likeness(rows[i]["fingerprint"], rows[after]["fingerprint"])
        for name in ("near_edited", "near_next"):
            assert 0 <= rows[i][name] <= 1
    assert rows[1]["fingerprint"] == rows[5]["fingerprint"] and rows[2]["fingerprint"] == rows[3]["fingerprint"]
    alone = {r["id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs, lexicon).collect()}
    assert alone == {i: r["fingerprint"] for i, r in rows.items()}


def test_fingerprints_of_odd_rows(docs_of, odd):
    docs = docs_of(odd)
    found = fingerprints.edited_neighbours(docs, fingerprints.fit_lexicon(docs)).collect()
    assert len(found) == len(odd)
    one = docs_of([(1, "ab cd")])
    assert [r["edited"] for r in fingerprints.edited_neighbours(one, fingerprints.fit_lexicon(one)).collect()] == ["ab ca"]
    none = docs_of([])
    assert fingerprints.edited_neighbours(none, fingerprints.fit_lexicon(none)).collect() == []


def test_edits_are_nearer_than_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = fingerprints.edited_neighbours(docs, fingerprints.fit_lexicon(docs)).collect()
    mean = lambda name: sum(r[name] for r in rows) / len(rows)
    assert mean("near_edited") > 0.15 > 0.05 > mean("near_next")


def test_toxicity(spark, docs_of, odd):
    rng = random.Random(7)
    words = [f"n{i}" for i in range(300)]
    pairs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["vilelike", "vileness", "grim"])
        pairs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(5, None), (None, 1), (99999, 1), (0, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = marked.where(~toxicity.held_out(marked.doc_id))
    model = toxicity.fit(docs_of(pairs), learnt)
    unseen = [(10_000 + i, t) for i, t in pairs[:30]] + odd
    scored = toxicity.score(docs_of(pairs + unseen), model).collect()
    assert len(scored) == len(pairs) + len(unseen)
    of = defaultdict(list)
    for r in scored:
        of[r["id"]].append(r["score"])
    test = [(i, y) for i, y in labels[:600] if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((of[i][0] >= 0.7) == bool(y) for i, y in test)
    assert right >= 0.97 * len(test)
    assert all(0 <= s <= 1 for x in of.values() for s in x)
    assert of[10_006][0] in of[6] and None not in of[2]
    kept = toxicity.drop_toxic(docs_of(pairs), model)
    assert kept.columns == docs_of([]).columns and 480 <= kept.count() <= 560
    # Without labels or documents.
    empty = toxicity.fit(docs_of(pairs), marked.limit(0))
    assert {r["score"] for r in toxicity.score(docs_of(odd), empty).collect()} == {0.5}
    assert toxicity.score(docs_of([]), toxicity.fit(docs_of([]), learnt)).collect() == []


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=5.0, l2=0.1, epochs=6):
    """One coordinate at a time, features by name: the score function of (words, label) in order."""
    z, n = defaultdict(float), defaultdict(float)

    def features(words):
        pairs = [(gap, a, b) for gap in (1, 2) for a, b in zip(words, words[gap:])]
        return {("bias",)} | {("word", w) for w in words} | {("stem", w[:5]) for w in words} | set(pairs)

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return ((l1 if z[f] > 0 else -l1) - z[f]) / ((beta + n[f] ** 0.5) / alpha + l2)

    def score(words):
        return 1 / (1 + math.exp(-sum(weight(f) for f in features(words))))

    for _ in range(epochs):
        for words, label in rows:
            g = score(words) - label
            for f in features(words):
                w = weight(f)
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w
                n[f] += g * g
    return score


def test_ftrl_against_a_plain_one(spark, docs_of):
    rng = random.Random(3)
    words = ["alpha", "betaish", "betaing", "gam", "deltas", "eps", "zetas", "etas"]
    pairs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(400)]
    bad = lambda text: int("betai" in text and "gam" in text)
    labels = spark.createDataFrame([(i, bad(t)) for i, t in pairs], "doc_id long, toxic int")
    ranks = {r[0]: r[1] for r in labels.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    # The first of the sample holds most rows; the text with the least hash is learnt from.
    hot = min(ranks, key=ranks.get)
    pairs += [(hot, f"gam alpha {rng.choice(words)} {'eps ' * (i % 90)}") for i in range(600)]
    docs = docs_of(pairs)
    hashes = {(r["id"], r["text"]): r["k2"] for r in keyed(docs, "doc_id", "text").collect()}
    least = {}
    for i, t in pairs:
        least[i] = min(least.get(i, t), t, key=lambda x: hashes[i, x])
    order = sorted(least, key=ranks.get)[:300]
    score = plain_ftrl([(least[i].split(), bad(pairs[i][1])) for i in order])
    model = toxicity.fit(docs, labels, rows=300)
    assert model.count() > 20
    for r in toxicity.score(docs, model, keep=[F.col("text").alias("own")]).collect():
        assert r["score"] == pytest.approx(score(r["own"].split()), abs=1e-9)


def test_tokens_are_those_of_the_tokenizers_library(odd):
    from tokenizers import Tokenizer

    given = Tokenizer.from_file(tokenizer())
    own = packing.encoder(tokenizer())
    texts = [t for _, t in odd if t] + ["<|endoftext|> x", "日本 🙂\u0000   it's 12 345", "  \n\n "]
    for t in texts:
        assert own.encode(t, allowed_special="all") == given.encode(t, add_special_tokens=False).ids


def unpacked(rows, window=1024):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert set(sequences) == set(range(len(sequences)))
    return len(sequences)


def test_packing(docs_of, odd):
    rows = packing.pack_documents(docs_of(odd), tokenizer()).collect()
    unpacked(rows)
    own = packing.encoder(tokenizer())
    expected = sorted(np.array([*own.encode(t or ""), 0], "<u4").tobytes() for _, t in odd)
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    # Rows that repeat, or share an id and a length, give the same starts twice.
    got = []
    for (i, n), parts in pieces.items():
        copies = sum(start == 0 for start, _ in parts)
        parts.sort()
        for c in range(copies):
            got.append(b"".join(x for _, x in parts[c::copies]))
            assert len(got[-1]) == 4 * n
    assert sorted(got) == expected
    assert packing.pack_documents(docs_of([]), tokenizer()).collect() == []


@pytest.mark.parametrize("total", [0, 1, 50, 20_000])
def test_plans_use_each_piece_once(total):
    rng = np.random.default_rng(total)
    h = np.bincount(1 + rng.integers(0, 256, total), minlength=257)
    used, sequences = np.zeros(257, int), 0
    for pattern, times in packing.plan(h, 256):
        assert sum(pattern) <= 256 and times > 0
        sequences += times
        for n in pattern:
            used[n] += times
    assert (used == h).all()
    if total >= 20_000:
        assert (h * np.arange(257)).sum() > 0.99 * 256 * sequences
