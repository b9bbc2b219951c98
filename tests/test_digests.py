import random

import pytest
from helpers import files_read, rows
from pyspark.sql import functions as F

from cellshift import changes_by_differential
from cellshift.sources.digests import (
    _bucket,
    _levels,
    changes_by_digests,
    differing_buckets,
    load_digest_snapshot,
    read_buckets,
    store_digest_snapshot,
)


def dump(seed, n=2000, same=()):
    rng = random.Random(seed)
    made = {(f"r{i % 97}", f"c{i}"): (rng.choice("xyz"), rng.randrange(3)) for i in range(n) if rng.random() < 0.9}
    return [(k, c, v, t) for (k, c), (v, t) in made.items()] + list(same)


@pytest.mark.parametrize("unique", [True, False])
def test_the_same_as_reading_all(spark, cells, tmp_path, unique):
    base = str(tmp_path)
    old, new = cells(*dump(1)), cells(*dump(2))
    store_digest_snapshot(old, base, 1, 40)
    store_digest_snapshot(new, base, 2, 40)
    assert rows(changes_by_digests(spark, base, 1, 2, unique=unique)) == rows(changes_by_differential(old, new))
    assert rows(changes_by_digests(spark, base, 1, 2, ["del"])) == rows(changes_by_differential(old, new, ["del"]))
    assert rows(load_digest_snapshot(spark, base, 2)) == rows(new)


def test_reads_the_buckets_that_differ(spark, cells, tmp_path):
    base, n = str(tmp_path), 300
    old = cells(*dump(3, 6000)).withColumn("b", _bucket(n)).cache()
    hit = F.col("b").isin(5, 77, 299)
    new = old.withColumn("value", F.when(hit, F.lit("new")).otherwise(F.col("value"))).drop("b")
    store_digest_snapshot(old.drop("b"), base, 1, n)
    store_digest_snapshot(new, base, 2, n)
    assert differing_buckets(spark, base, 1, 2) == [5, 77, 299]
    changes = changes_by_digests(spark, base, 1, 2, unique=True)
    assert changes.count() == old.where(hit).count() > 0
    stored = files_read(load_digest_snapshot(spark, base, 1))
    read = files_read(read_buckets(spark, base, 1, [5, 77, 299]))
    assert 3 <= read <= stored / 30


def test_order_and_repeats(spark, cells, tmp_path):
    """Digests do not depend on order, but on how often a cell is there."""
    base = str(tmp_path)
    made = dump(4, 300)
    store_digest_snapshot(cells(*made), base, 1, 16)
    store_digest_snapshot(cells(*made[::-1]).repartition(7), base, 2, 16)
    store_digest_snapshot(cells(*made, made[0]), base, 3, 16)
    assert differing_buckets(spark, base, 1, 2) == []
    assert rows(changes_by_digests(spark, base, 1, 2)) == []
    assert len(differing_buckets(spark, base, 1, 3)) == 1
    assert rows(changes_by_digests(spark, base, 1, 3)) == []  # the same cell twice is no change


def test_empty_and_missing_snapshots(spark, cells, tmp_path):
    base = str(tmp_path)
    store_digest_snapshot(cells(*dump(5, 50)), base, 1, 16)
    store_digest_snapshot(cells(*dump(5, 50)).where("false"), base, 2, 16)
    assert rows(changes_by_digests(spark, base, 1, 3)) == []
    found = changes_by_digests(spark, base, 1, 2)
    assert {r.op for r in found.collect()} == {"del"} and found.count() == len(dump(5, 50))
    store_digest_snapshot(cells(*dump(5, 50)), base, 4, 300)
    with pytest.raises(ValueError):
        changes_by_digests(spark, base, 1, 4)


def test_levels():
    assert [_levels(n) for n in (1, 2, 16, 17, 256, 257, 4096)] == [1, 2, 2, 3, 3, 4, 4]
