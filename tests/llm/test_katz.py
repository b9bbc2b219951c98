import math
import re
from collections import Counter, defaultdict

import pytest

from cellshift.llm import katz
from cellshift.llm.katz import Discount
from cellshift.llm.queries import op12_lm_scoring

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


class Brute:
    """Katz backoff over pairs in dictionaries, a token at a time."""

    def __init__(self, texts):
        self.c1, self.c2 = Counter(), defaultdict(Counter)
        for t in texts:
            before = None
            for w in tokens(t):
                self.c1[w] += 1
                self.c2[before][w] += 1
                before = w
        self.n = sum(self.c1.values())
        self.d1 = self._share(Counter(self.c1.values()))
        self.d2 = self._share(Counter(c for after in self.c2.values() for c in after.values()))
        self.taken = self._kept(self.c1, self.d1)
        self.wholes = {h: self._kept(after, self.d2)[1] for h, after in self.c2.items()}
        self.weights = {h: self._weight(h) for h in self.c2}

    @staticmethod
    def _share(n):
        share = {}
        if all(n[r] for r in range(1, 7)) and 6 * n[6] < n[1]:
            common = 6 * n[6] / n[1]
            share = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, 6)}
        if not share or not all(0 < s < 1 for s in share.values()):
            d = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
            share = {r: (r - d) / r for r in range(1, 6)}
        return share

    def _kept(self, counts, share):
        taken = math.fsum(c * (1 - share.get(c, 1)) for c in counts.values())
        total = sum(counts.values())
        return (taken, total) if taken > 0 else (1.0, total + 1)

    def alone(self, w):
        if not self.n:
            return 1.0
        taken, whole = self.taken
        return self.c1[w] * self.d1.get(self.c1[w], 1) / whole if self.c1[w] else taken / whole

    def _weight(self, h):
        taken, whole = self._kept(self.c2[h], self.d2)
        return taken / whole / (1 - math.fsum(self.alone(w) for w in self.c2[h]))

    def chance(self, h, w):
        if h not in self.c2:
            return self.alone(w)
        c = self.c2[h][w] if w in self.c2[h] else 0
        if not c:
            return self.weights[h] * self.alone(w)
        return c * self.d2.get(c, 1) / self.wholes[h]

    def row(self, text):
        t = tokens(text)
        total = math.fsum(math.log10(self.chance(h, w)) for h, w in zip([None, *t], t, strict=False))
        base = math.fsum(math.log10((self.c1[w] + 0.5) / (self.n + 0.5 * (len(self.c1) + 1))) for w in t)
        return len(t), sum(self.c1[w] > 0 for w in t), pytest.approx(base, abs=1e-6), pytest.approx(total, abs=1e-6)


def check(docs, model, expected_of, scored=None):
    found = (scored or katz.score(docs, model)).collect()
    expected = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    by_row = sorted(found, key=lambda r: (repr(r.id), r.n_tokens))
    expected.sort(key=lambda r: (repr(r[0]), len(tokens(r[1]))))
    assert len(found) == len(expected)
    for r, (i, text) in zip(by_row, expected, strict=True):
        assert r.id == i
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == expected_of(text)


def test_against_brute_force(docs_of, odd):
    docs = docs_of([*odd, (20, "new words only"), (21, "A-B É  x\x1cy")]).repartition(3)
    learnt = [t for i, t in odd if i != 13]
    model = katz.fit(docs.where("doc_id is null or doc_id not in (13, 20, 21)"))
    brute = Brute(learnt)
    check(docs, model, brute.row)
    model.discard()


def test_sums_to_one(docs_of, odd):
    """Every history, also one never seen: all learnt words and the unknown one."""
    model = katz.fit(docs_of(odd))
    brute = Brute([t for _, t in odd])
    for h in [*brute.c2, "never seen"]:
        assert math.fsum(brute.chance(h, w) for w in [*brute.c1, "unknown"]) == pytest.approx(1, abs=1e-12)
    words = {r.word: r.wid for r in model.words.collect()} | {None: katz.START}
    weights = {r.wid: 10**r.weight for r in model.histories.collect()}
    assert {h: weights[words[h]] for h in brute.c2} == pytest.approx(brute.weights)
    counted = {}
    for row in model.grams.collect():
        for a, b, c in zip(*katz._columns(row.body, 3), strict=True):
            assert (int(a), int(b)) not in counted
            counted[int(a), int(b)] = int(c)
    assert counted == {(words[h], words[w]): c for h, after in brute.c2.items() for w, c in after.items()}


def test_split_histories_and_small_buckets(docs_of, odd, monkeypatch):
    monkeypatch.setattr(katz, "_PART", 7)
    monkeypatch.setattr(katz, "_BUCKET", 100)
    docs = docs_of(odd)
    model = katz.fit(docs.where("doc_id < 9"))
    assert model.known.buckets > 20 and model.known.parts(model.known.firsts).max() > 5
    brute = Brute([t for i, t in odd if i is not None and i < 9])
    check(docs, model, brute.row)
    own = katz.fit(docs, learn=docs.doc_id < 9)
    check(docs, own, brute.row)
    check(docs, own, brute.row, katz.score_own(own))


def test_frequent_words_only(docs_of):
    """Nothing is discounted, yet unknown words keep a chance."""
    docs = docs_of([(i, "a b a b") for i in range(30)] + [(99, "b c")])
    model = katz.fit(docs.where("doc_id < 99"))
    assert all(r.more for r in model.histories.collect())
    check(docs, model, Brute(["a b a b"] * 30).row)


def test_nothing_to_learn_from(docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    model = katz.fit(docs.where("false"))
    check(docs, model, Brute([]).row)
    assert katz.score(docs.where("false"), model).collect() == []


def test_discounts():
    n = [0, 1000, 300, 140, 80, 50, 35]
    d = Discount.of(n)
    assert d.turing and all(a < b for a, b in zip(d.share[1:], d.share[2:], strict=False))
    # Katz: what is taken from all counts is n1.
    assert sum(n[r] * r * (1 - d.share[r]) for r in range(1, 6)) == pytest.approx(1000)
    assert not Discount.of([0, 10, 300, 140, 80, 50, 35]).turing
    assert not Discount.of([0] * 7).turing


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 5 = 1 as held").collect()
    brute = Brute([r.text for r in docs if not r.held])
    found = {r.doc_id: r for r in op12_lm_scoring(spark, SF).collect()}
    assert len(found) == len(docs)
    for d in docs:
        r = found[d.doc_id]
        assert (r.held_out, r.train_tokens) == (d.held, brute.n)
        assert (r.n_tokens, r.n_known, r.base_score, r.score) == brute.row(d.text)
    assert sum(r.score for r in found.values() if r.held_out) > sum(r.base_score for r in found.values() if r.held_out)
