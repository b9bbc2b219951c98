"""Secret scan, URL decisions, chats and decontamination."""

import hashlib
import re

from pyspark.sql import functions as F

from cellshift.llm import chat, decontaminate, secrets, urls
from cellshift.llm.components import components
from cellshift.llm.queries import URL_RULES

KEY = "AKIA" + "Q2" * 8
ODD_SECRETS = [
    (1, f"é🙂 token:token:abcdefgh password=12345 PassWord = \"abc/def+1\" {KEY}"),
    (2, None),
    (3, ""),
    (4, "api_key: 0123456789abcdef01234567 apikey=xyz"),
    (5, f"token={KEY}" + "f" * 30),
    (5, f"token={KEY}" + "f" * 30),
    (6, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " secret"),
    (7, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-1 " * 3),
    (8, "x " * 5000 + "passwd='longenough'"),
    (None, "secret:=  nope secret=  yes-it.is"),
]


def brute(text):
    rules = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("forge", r"gh[opusr]_[A-Za-z0-9]{36,}", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ]
    found = [
        (m.start(), nth, m.end(), kind)
        for nth, (kind, pattern, group, least) in enumerate(rules)
        for m in re.finditer(pattern, text or "", re.ASCII)
        if len(m[group]) >= least
    ]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def test_secrets(docs_of):
    found = secrets.find_secrets(docs_of(ODD_SECRETS)).select("id", secrets.spelled(F.col("spans")).alias("s"))
    expected = sorted(((i, ",".join(brute(t))) for i, t in ODD_SECRETS), key=repr)
    assert sorted(((r["id"], r["s"]) for r in found.collect()), key=repr) == expected
    assert secrets.find_secrets(docs_of([])).collect() == []
    full = secrets.find_secrets(docs_of(ODD_SECRETS), (secrets.RULES[2],))
    assert full.count() == len(ODD_SECRETS)


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.RULES[0].pattern)
    assert frozenset({"api", "pik", "ike", "key"}) in secrets.trigram_query(secrets.RULES[0].pattern)
    assert secrets.trigram_query("(abc|d+)x") == []
    assert secrets.trigram_query("(?:abcd)?efg") == [frozenset({"efg"}), frozenset({"abc", "bcd", "cde", "def", "efg"})]
    for rule in secrets.RULES:
        for _, text in ODD_SECRETS:
            for m in re.finditer(rule.pattern, text or "", re.ASCII):
                low, alternatives = m[0].lower(), secrets.trigram_query(rule.pattern)
                assert not alternatives or any(all(g in low for g in a) for a in alternatives)


def test_url_decisions(spark):
    link = '<html><LINK rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://a.net/en/1", link.format("https://B.net/fr/1")),
        (2, "https://b.net/fr/1/", None),
        (3, "http://c.org/x?utm_source=q#top", '<meta http-equiv="refresh" content="0; url=http://www.a.net/en/1?ref=z">'),
        (4, "https://www.a.net/en/1", link.format("/en/2")),
        (5, "https://www.a.net/en/2", link.format("//a.net/en/1")),
        (6, None, link.format("http://b.net/fr/1")),
        (7, "no scheme", ""),
        (8, "http://WWW.Example.com/en/x", ""),
        (9, "http://blog.example.com/en/x", ""),
        (10, "http://example.com", ""),
        (11, "http://shop.com/y", link.format("http://b.net/fr/1")),
        (12, "http://d.org/", link.format("http://shop.com/y")),
        (12, "http://d.org/", link.format("http://shop.com/y")),
        (13, "http://e.org/", ""),
    ]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, verdict string")
    found = {r["page_id"]: r for r in urls.judge_pages(df, URL_RULES).collect()}
    verdicts = {i: r["verdict"] for i, r in found.items()}
    # 1, 2, 3, 4, 5, 11 and 12 are one class; 11 is allowed by a rule, 2 blocked by one.
    assert verdicts == {
        1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow",
        8: "allow", 9: "block", 10: "allow", 11: "allow", 12: "allow", 13: "allow",
    }
    assert found[8]["host"] == "www.example.com" and found[8]["rule"] == "www.example.com/en/"
    assert found[7]["host"] == found[7]["path"] == "" and found[10]["rule"] is None
    without = urls.judge_pages(df.where("page_id not in (11, 12)"), URL_RULES)
    assert {r["page_id"]: r["verdict"] for r in without.collect()}[4] == "block"
    given = spark.createDataFrame([("http://e.org/", "http://b.net/fr/1")], "source string, target string")
    sent = {r["page_id"]: r["verdict"] for r in urls.judge_pages(df.where("page_id in (2, 13)"), URL_RULES, given).collect()}
    assert sent == {2: "block", 13: "block"}
    assert urls.judge_pages(df.limit(0), URL_RULES).collect() == []


def test_targets_that_are_no_pages(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://short.org/a", link.format("http://x.net/es/y")),
        (2, "http://short.org/b", '<meta http-equiv="refresh" content="0; url=http://shop.com/y">'),
        (3, "http://y.net/es/z", link.format("http://short.org/b")),
        (4, "http://short.org/c", ""),
        (5, "http://z.net/es", link.format("http://z.net/es/")),
        (6, "http://short.org/d", link.format("mailto:x@x.net")),
        (7, "http://short.org/e", link.format("/e?u=http://x.net/es/y")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    given = spark.createDataFrame([("http://short.org/c", "http://w.net/fr/1")], "source string, target string")
    found = {r["page_id"]: r["verdict"] for r in urls.judge_pages(df, URL_RULES, given).collect()}
    assert found == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}


def test_relative_targets(spark):
    cases = [
        ("http://a.org/b/c", "next.html", "http://a.org/b/next.html"),
        ("http://a.org/b/c?q=1", "../x", "http://a.org/x"),
        ("http://a.org/b/c?q=1#f", "?p=2", "http://a.org/b/c?p=2"),
        ("http://a.org", "x/./y/..", "http://a.org/x/"),
        ("http://a.org/b/", "../../x?u=../v", "http://a.org/x?u=../v"),
        ("http://a.org/b/c", "/d/../e", "http://a.org/e"),
        ("https://a.org/b/c", "//d.org/e", "https://d.org/e"),
        ("http://a.org/b/c", "https://d.org/e", "https://d.org/e"),
        ("http://a.org/b/c", "javascript:x", None),
    ]
    df = spark.createDataFrame([(u, f'<link rel="canonical" href="{t}">', e) for u, t, e in cases], "url string, html string, e string")
    for r in df.select("url", "e", urls.declared_target(F.col("url"), F.col("html")).alias("found")).collect():
        assert r["found"] == ([r["e"]] if r["e"] else []), r


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60, 1) if i not in (20, 41)] + [(5, 5), (None, 3), (100, 99)]
    found = components(spark.createDataFrame(chain, "a long, b long"))
    roots = dict(found.collect())
    expected = {i: 0 if i <= 20 else 21 if i <= 41 else 42 for i in range(61)} | {99: 99, 100: 99}
    assert roots == expected and found.count() == len(roots)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


CONTROL = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 0, "user", CONTROL),
    (1, 1, "assistant", CONTROL + "\u001b1\u001b"),
    (2, 0, "system", "be [SYS] brief"),
    (2, 1, "user", ""),
    (2, 2, "assistant", None),
    (3, 0, "assistant", "first"),
    (3, 0, "tool\nx", "[ROLE] a\nb [/ROLE]"),
    (3, 1, None, "no role"),
    (4, 5, "user", "asked"),
    (None, 0, "user", "x"),
    (None, 1, "assistant", "y" * 50_000),
    (1, 1, "assistant", CONTROL + "\u001b1\u001b"),
]


def test_chats(spark):
    turns = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted int")
    chats = chat.format_chats(turns).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.learnt_text(F.col("segments")))
    rows = {r["conv_id"]: r for r in chats.collect()}
    for i, row in rows.items():
        said = sorted((t, r or "", x or "") for c, t, r, x in TURNS if c == i)
        assert [(r["role"], r["text"]) for r in row["back"]] == [(r, x) for _, r, x in said]
        assert row["learnt"] == "".join(x for _, r, x in said if r == "assistant")
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
    assert {i: r["valid"] for i, r in rows.items()} == {1: False, 2: True, 3: False, 4: False, None: True}
    assert rows[3]["state"] == "wrong" and rows[4]["state"] == "asked"
    assert chat.format_chats(turns.limit(0)).collect() == []


ITEMS = [(1, "One two three, four five six seven eight nine ten ELEVEN twelve"), (2, "tiny item"), (3, None), (4, "..."), (2, "tiny item"), (5, "é two three, four five six seven eight nine ten")]
TEXTS = [
    (1, "x ONE-two three four_five six seven eight nine ten eleven y tiny item"),
    (2, None),
    (3, ""),
    (4, "...!"),
    (5, "one two three four five six seven eight nine"),
    (6, "TINY Item tiny item " * 30),
    (6, "TINY Item tiny item " * 30),
    (7, "É two three four five six seven eight nine ten"),
    (8, "é two three four five six seven eight nine ten"),
    (None, "two three four five six seven eight nine ten eleven twelve"),
    (9, "filler " * 3000 + "three four five six seven eight nine ten eleven twelve"),
    (10, "ten nine eight seven six five four three two one eleven"),
]


def word_list(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, docs_of):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, wid int")
    windows = set()
    for i, t in ITEMS:
        w = word_list(t)
        windows |= {(str(i), tuple(w[j : j + 10])) for j in range(max(1, len(w) - 9)) if w}
    expected = []
    for i, t in TEXTS:
        w, hit, who = word_list(t), set(), set()
        for item, window in windows:
            for j in range(len(w) - len(window) + 1):
                if tuple(w[j : j + len(window)]) == window:
                    hit |= set(range(j, j + len(window)))
                    who.add(item)
        expected.append((i, len(w), len(hit), tuple(sorted(who))))
    found = decontaminate.contamination(docs_of(TEXTS), items).collect()
    assert sorted(((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found), key=repr) == sorted(expected, key=repr)
    kept = decontaminate.drop_contaminated(docs_of(TEXTS), items)
    assert kept.columns == docs_of([]).columns
    assert sorted((r["doc_id"] for r in kept.collect())) == sorted(i for i, _, n, _ in expected if not n)
    assert decontaminate.contamination(docs_of([]), items).collect() == []
    clean = decontaminate.contamination(docs_of(TEXTS), items.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r["n_hit"] for r in clean)


def test_proximity(spark, docs_of):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    texts = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
        (2, "beta alpha gamma well delta epsilon zeta eta theta iota kappa"),
        (3, "alpha beta gamma delta epsilon " + "far " * 40 + "zeta eta theta iota kappa"),
        (4, "alpha beta gamma"),
    ]
    docs = docs_of(texts)
    windows, _ = decontaminate.item_windows(items, 10)
    index = decontaminate.build_index(docs, decontaminate.vocabulary(windows))
    names = {(r["k1"], r["k2"]): r["id"] for r in index.collect()}
    near = decontaminate.proximity_matches(docs, index, windows, slack=3)
    assert {names[r["k1"], r["k2"]] for r in near.collect()} == {1, 2}
    exact = decontaminate.phrase_matches(docs, index, windows)
    assert {(names[r["k1"], r["k2"]], r["at"]) for r in exact.collect()} == {(1, 0)}


def test_hash_of_no_spans(docs_of):
    found = secrets.find_secrets(docs_of([(1, "nothing")])).select(F.sha2(secrets.spelled(F.col("spans")), 256).alias("h"))
    assert found.first()["h"] == hashlib.sha256(b"").hexdigest()
