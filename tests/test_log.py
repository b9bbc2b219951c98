import random

import pytest
from helpers import plan, rows

from cellshift import changes_by_log
from cellshift.functions.cells import drop_system, hex_to_string, ops_from_flags
from cellshift.operators import log
from pyspark.sql import functions as F

SHOWN = ["op", "row_key", "super_column", "column_name", "value", "ts"]


def collapse(mutations, mode, scope):
    """One row at a time, lists in memory: what the plans must agree with."""
    by_row = {}
    for m in mutations:
        by_row.setdefault(m[0], []).append(m)
    found = []
    for key, row in by_row.items():

        def gone_at(sup):
            """Newest deletion that reaches cells of this super column."""
            times = [
                ts
                for _, s, c, op, _, ts, _ in row
                if op == "del" and c is None
                and (scope == "row" or s is None or s == sup)
            ]
            return max(times, default=None)

        kept = {}
        for _, s, c, op, value, ts, seq in row:
            d = gone_at(s)
            if len(row) == 1 or d is None or ts > d:
                kept.setdefault((s, c), []).append((ts, seq, op, value))
            elif mode == "classified" and op == "ins" and ts < d:
                kept.setdefault((s, c), []).append((d, -1, "del", "tombstone"))
        for (s, c), versions in kept.items():
            versions.sort(key=lambda v: v[:2])
            ts, _, op, value = versions[-1]
            if mode == "upsert":
                op = "upsert" if op == "ins" else op
            elif op == "ins" and len(versions) > 1 and versions[-2][2] == "ins":
                op = "upd"
            found.append((op, key, s, c, value, ts))
    return sorted(found, key=repr)


def random_log(seed, supers):
    rnd = random.Random(seed)
    made = []
    for seq in range(600):
        key = f"r{min(rnd.randint(0, 120), rnd.randint(0, 120))}"
        ts = rnd.randint(1, 12)  # many equal time stamps
        sup = rnd.choice(supers)
        kind = rnd.random()
        if kind < 0.08:
            made.append((key, None, None, "del", None, ts, seq))
        elif kind < 0.16 and sup is not None:
            made.append((key, sup, None, "del", None, ts, seq))
        else:
            op = "del" if rnd.random() < 0.25 else "ins"
            made.append((key, sup, rnd.choice("abc"), op, f"v{seq}", ts, seq))
    return made


@pytest.mark.parametrize("mode", ["classified", "upsert"])
@pytest.mark.parametrize("scope", ["row", "super"])
@pytest.mark.parametrize("supers", [[None], ["s", "t"]])
def test_random_logs(mutations, mode, scope, supers):
    made = random_log(11, supers)
    expected = collapse(made, mode, scope)
    assert {r[0] for r in expected} >= ({"ins", "upd", "del"} if mode == "classified" else {"upsert"})
    assert rows(changes_by_log(mutations(*made), mode, scope), *SHOWN) == expected


def test_the_order_of_rows_does_not_matter(mutations):
    made = random_log(3, [None, "s"])
    expected = rows(changes_by_log(mutations(*made)))
    random.Random(4).shuffle(made)
    assert rows(changes_by_log(mutations(*made).repartition(7))) == expected


def classified(frame, *columns):
    return rows(changes_by_log(frame), *(columns or ("op", "column_name", "value", "ts")))


def test_single_mutations_pass_through(mutations):
    frame = mutations(
        ("deleted", None, None, "del", None, 5, 0),
        ("inserted", None, "a", "ins", "v", 5, 1),
        ("removed", None, "a", "del", "v", 5, 2),
    )
    assert classified(frame, "op", "row_key", "column_name", "value") == [
        ("del", "deleted", None, None),
        ("del", "removed", "a", "v"),
        ("ins", "inserted", "a", "v"),
    ]
    assert rows(changes_by_log(frame, "upsert"), "op") == [("del",), ("del",), ("upsert",)]


def test_a_deleted_row_leaves_tombstones_or_nothing(mutations):
    frame = mutations(
        ("r", None, "a", "ins", "1", 1, 0),
        ("r", None, "a", "ins", "2", 2, 1),
        ("r", None, "b", "del", "3", 2, 2),
        ("r", None, None, "del", None, 5, 3),
    )
    assert classified(frame) == [("del", "a", "tombstone", 5)]
    assert changes_by_log(frame, "upsert").count() == 0


def test_a_mutation_at_the_deletion_time_is_dropped(mutations):
    frame = mutations(
        ("r", None, "a", "ins", "1", 5, 0),
        ("r", None, None, "del", None, 5, 1),
        ("r", None, "b", "ins", "2", 6, 2),
    )
    assert classified(frame) == [("ins", "b", "2", 6)]


def test_a_cell_written_again_after_a_deletion_is_an_insertion(mutations):
    frame = mutations(
        ("r", None, "a", "ins", "1", 1, 0),
        ("r", None, None, "del", None, 5, 1),
        ("r", None, "a", "ins", "2", 6, 2),
    )
    assert classified(frame) == [("ins", "a", "2", 6)]


def test_insertion_over_insertion_is_an_update(mutations):
    frame = mutations(
        ("r", None, "a", "ins", "1", 1, 0),
        ("r", None, "a", "ins", "2", 2, 1),
        ("r", None, "b", "del", "1", 1, 2),
        ("r", None, "b", "ins", "2", 2, 3),
        ("r", None, "c", "ins", "1", 1, 4),
        ("r", None, "c", "del", "2", 2, 5),
    )
    expected = [("del", "c", "2", 2), ("ins", "b", "2", 2), ("upd", "a", "2", 2)]
    assert classified(frame) == expected
    assert rows(log.net_changes(frame), "op", "column_name", "value", "ts") == expected


def test_the_later_read_record_wins_a_tie(mutations):
    frame = mutations(("r", None, "a", "ins", "1", 1, 0), ("r", None, "a", "del", "2", 1, 1))
    assert classified(frame) == [("del", "a", "2", 1)]
    assert rows(log.latest_mutations(frame), "value") == [("2",)]


def test_super_deletions(mutations):
    frame = mutations(
        ("r", "s", "a", "ins", "1", 1, 0),
        ("r", "t", "a", "ins", "2", 2, 1),
        ("r", None, "a", "ins", "3", 2, 2),
        ("r", "s", None, "del", None, 5, 3),
        ("r", "t", None, "del", None, 3, 4),
        ("r", "s", "a", "ins", "4", 6, 5),
    )
    assert rows(log.key_deletions(frame), "row_key", "deleted_at") == [("r", 5)]
    assert rows(log.super_deletions(frame), "super_column", "deleted_at") == [("s", 5), ("t", 3)]
    assert rows(log.super_tombstones(frame), *SHOWN) == sorted(
        [
            ("del", "r", "s", "a", "tombstone", 5),
            ("ins", "r", "t", "a", "2", 2),
            ("ins", "r", None, "a", "3", 2),
            ("del", "r", "t", None, None, 3),
        ],
        key=repr,
    )


def test_unknown_mode(mutations):
    with pytest.raises(ValueError):
        changes_by_log(mutations(), "net")


def test_hot_cells_are_cut_before_the_shuffle(spark, mutations):
    text = plan(changes_by_log(mutations(("r", None, "a", "ins", "1", 1, 0))))
    partial = text.index("row_number(), 2, Partial")
    assert "Exchange" in text[:partial] and "row_number(), 2, Final" in text[:partial]
    assert "partial_min" in text and "partial_max" in text


def test_filters(spark):
    frame = spark.createDataFrame(
        [("app", 0), ("system", 0), ("local", 0), (None, 0), ("app", 1), ("app", 2), ("app", 3),
         ("app", 4), ("app", 8), ("app", 9), ("app", 16)],
        "keyspace string, flag int",
    )
    assert drop_system(frame).count() == 8
    accepted, rejected = ops_from_flags(drop_system(frame))
    assert rows(accepted, "op") == [("del",), ("ins",), ("ins",)]
    assert rows(rejected, "flag") == [(2,), (3,), (4,), (8,), (9,)]


def test_hex_to_string(spark):
    frame = spark.createDataFrame([("4142",), ("41427",), ("c3a9",), ("",)], "h string")
    assert rows(frame.select(hex_to_string(F.col("h")))) == sorted(
        [("AB",), ("AB",), ("\xc3\xa9",), ("",)], key=repr
    )
