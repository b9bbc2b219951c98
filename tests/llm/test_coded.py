import json
import os
import subprocess
import sys

import pytest

from cellshift.llm import coded
from cellshift.llm.coded import cut, plain_words, unpacked, with_numbers

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("bucket", [2, 10**6])
@pytest.mark.parametrize("grouped", [True, False])
def test_numbers_of_words(spark, monkeypatch, bucket, grouped):
    """Words of other groups, words without a number, texts without words, more buckets than tasks."""
    monkeypatch.setattr(coded, "_BUCKET", bucket)
    texts = [(1, "a b É x\x1cy a", "en"), (2, "a c d", "fr"), (3, " \n", "de"), (4, None, "en"), (5, " ".join(f"w{i}" for i in range(3000)), "fr")]
    texts = spark.createDataFrame([(*t, True) for t in texts], "id long, text string, grp string, marked boolean").repartition(3)
    pieces = cut(texts, plain_words, None if grouped else " ")
    numbers = [("en", "a", 10), ("fr", "a", 2**40), ("en", "É", 12), ("en", "x\x1cy", 13), ("de", "a", 14)] if grouped else [
        ("", "a", 10), ("", " ", 11), ("", "É", 12), ("", "x\x1cy", 13)]
    numbers += [("fr" if grouped else "", f"w{i}", 1000 + i) for i in range(0, 3000, 2)]
    words = spark.createDataFrame(numbers, "grp string, word string, wid long")
    found = with_numbers(pieces, words if grouped else words.drop("grp"), -7).collect()
    numbers = {(g, w): n for g, w, n in numbers}
    named = {r.piece: (r.grp, r.words) for r in pieces.collect()}
    assert {r.piece for r in found} == set(named) and len(found) == len(named)
    for r in found:
        grp, own = named[r.piece]
        assert unpacked(r.wids, "int64").tolist() == [numbers.get((grp if grouped else "", w), -7) for w in own]


SHUFFLES = """
import random, sys
from pyspark.sql import SparkSession, functions as F
from cellshift.llm import katz
folder = sys.argv[1]
conf = {"master": "local[4]", "ui.enabled": "false", "eventLog.enabled": "true", "eventLog.dir": f"file://{folder}/log", "eventLog.rolling.enabled": "false",
        "eventLog.compress": "false", "checkpoint.dir": f"{folder}/shared", "sql.warehouse.dir": f"{folder}/warehouse", "sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map={f"spark.{k}": v for k, v in conf.items()}).getOrCreate()
rng = random.Random(1)
texts = [" ".join(f"w{i}" for i in rng.sample(range(60_000), 40_000)) for _ in range(8)]
docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
pieces = katz._cut(docs, F.lit(True), "doc_id", "text")
words, _ = katz._number(katz.vocabulary(pieces).select("word", "c"))
spark.sparkContext.setJobGroup("numbers", "numbers")
assert katz._coded(pieces, words).agg(F.sum(F.size("sizes"))).first()[0] == 8
spark.stop()
"""


def test_words_are_shuffled_packed(tmp_path):
    """A piece's words take little more of a shuffle than their letters, compressed, and come back as numbers."""
    (tmp_path / "log").mkdir()
    subprocess.run([sys.executable, "-c", SHUFFLES, str(tmp_path)], cwd=ROOT, check=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    (log,) = (tmp_path / "log").iterdir()
    events = [json.loads(line) for line in log.read_text().splitlines()]
    stages = {e["Stage Info"]["Stage ID"] for e in events if e["Event"] == "SparkListenerStageSubmitted" and (e.get("Properties") or {}).get("spark.jobGroup.id") == "numbers"}
    tasks = [e["Task Metrics"] for e in events if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages]
    written = sum(t["Shuffle Write Metrics"]["Shuffle Bytes Written"] for t in tasks)
    assert 0 < written / (8 * 40_000) < 9  # 5.8 bytes; 14.7 with a row for every word of a piece
