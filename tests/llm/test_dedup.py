"""Substring, line and near-copy dedup against brute force."""

import hashlib
from collections import Counter

from cellshift.llm import jaccard, lines, substrings


def sha(words):
    return hashlib.sha256(words).hexdigest()


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_substrings(docs_of, odd):
    words = [(i, (t or "").encode().split()) for i, t in odd]
    seen = Counter(b" ".join(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    expected = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - 34):
            if seen[b" ".join(w[j : j + 35])] > 1:
                gone |= set(range(j, j + 35))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), kept.decode()))
    assert any(n for _, _, n, _ in expected)
    found = substrings.dedup_substrings(docs_of(odd))
    assert collected(found, "id", "n_words", "n_removed", "kept") == sorted(expected, key=repr)
    assert substrings.dedup_substrings(docs_of([])).collect() == []


def test_equal_hashes_of_unequal_windows_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substrings, "mix", lambda x: np.zeros(len(x), np.uint64))
    body = b"a b c\nb c d\na b c"
    of, first, last = substrings.repeated_windows(body, 3, np.zeros(3, bool))
    assert list(zip(of.tolist(), first.tolist(), last.tolist())) == [(0, 0, 0), (2, 0, 0)]


def edits(a, b):
    """Edit distance over words, up to 2."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_lines(docs_of, odd):
    pairs = [(i, t) for i, t in odd if i is not None and i != 8 and i != 9]
    extra = [
        (20, "one two three four five six seven eight nine"),
        (21, "one two three four five six seven eight\nanother line"),
        (22, "one two three FOUR five six seven eight nine\nfew words here\nfew words there"),
        (23, "zero one two three four five six seven eight nine ten"),
    ]
    pairs += extra
    # Of (13, x) given twice neither is earlier.
    split = [(i, n, x.encode().split()) for i, t in dict.fromkeys(pairs) for n, x in enumerate((t or "").split("\n"))]
    order = sorted({(i, n) for i, n, _ in split})
    gone = set()
    for i, n, w in split:
        for j, m, v in split:
            if w and (j, m) < (i, n) and i != 7 and j != 7:
                if v == w or (min(len(v), len(w)) >= 8 and abs(len(v) - len(w)) < 2 and edits(v, w) <= 1):
                    gone.add((i, n))
    assert order and gone
    found = lines.dedup_lines(docs_of([p for p in pairs if p[0] != 7]))
    expected = []
    for i, t in pairs:
        if i != 7:
            own = (t or "").split("\n") if t else []
            expected.append((i, len(own), "\n".join(x for n, x in enumerate(own) if (i, n) not in gone)))
    assert collected(found, "id", "n_lines", "kept") == sorted(expected, key=repr)
    whole = lines.dedup_lines(docs_of(odd))
    assert whole.count() == len(odd)
    assert lines.dedup_lines(docs_of([])).collect() == []


def test_within_one_edit():
    a = b"a b c d".split()
    for b in ("a b c d", "a b c", "b c d", "a x c d", "a b c d e", "x a b c d"):
        assert lines.within_one_edit(a, b.encode().split()), b
    for b in ("a b", "b a c d", "a x y d", "a b c d e f"):
        assert not lines.within_one_edit(a, b.encode().split()), b


def linked(rows, n, least):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * union:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(x)] = min(ids.get(root(x), i), i)
    return [(i, len(sets[x]), ids.get(root(x))) for x, (i, _) in enumerate(rows)]


def test_jaccard(docs_of, odd):
    near = [(30 + i, " ".join(("w%d" % (j if j != 3 * i else j + 100)) for j in range(60))) for i in range(6)]
    pairs = odd + near
    found = jaccard.link(docs_of(pairs), 4, 85)
    assert collected(found, "id", "n_shingles", "component_id") == sorted(linked(pairs, 4, 85), key=repr)
    assert jaccard.link(docs_of([]), 4, 85).collect() == []


def test_jaccard_links_inside_a_prefix_group(docs_of):
    # Of each three, two differ in the last word and are linked; one differs in the last
    # two and is not. Mostly all have one prefix, which no other text shares.
    pairs = []
    for i in range(60):
        words = [f"t{i}x{j}" for j in range(16)]
        for k, end in enumerate((["h", "h"], [words[14], "x"], [words[14], "y"])):
            pairs.append((3 * i + k, " ".join(words[:14] + end)))
    found = jaccard.link(docs_of(pairs), 4, 85)
    expected = linked(pairs, 4, 85)
    assert [c for _, _, c in expected[:3]] == [0, 1, 1]
    assert collected(found, "id", "n_shingles", "component_id") == sorted(expected, key=repr)


def test_one_document_of_each_group_stays(docs_of, odd):
    odd = [p for p in odd if p[0] != 7]  # two texts under one id
    docs = docs_of(odd)
    found = jaccard.keep_one(docs)
    assert found.columns == docs.columns
    groups = linked(odd, 5, 80)
    kept = Counter(r["doc_id"] for r in found.collect())
    assert kept[1] == 1 and kept[5] == 0 and kept[13] == 1 and kept[10] == 1 and kept[11] == 0
    assert kept[2] == kept[3] == kept[4] == 1 and kept[None] == 2
    wordless = sum(not n for _, n, _ in groups)
    assert found.count() == wordless + len({c if c is not None else "null" for _, n, c in groups if n})
