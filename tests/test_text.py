import time

from helpers import rows

from cellshift import parse_log, parse_log_records, render_changes, render_log
from cellshift.functions.cells import split_audit_name
from cellshift.functions.text import parse_audit_values, parse_bootstrap, render_lines
from cellshift.model import as_changes
from cellshift.operators.log import latest_mutations
from cellshift.sources.mutation_log import read_log, rejected_log_lines, split_log, write_log
from cellshift.sources.tombstones import export_cells

LIVE = "[-2147483648][-9223372036854775808][1]"


def one(df, style):
    return tuple(render_changes(df, style).first())


def test_styles(cells, tracking):
    standard = as_changes(cells(("r", "c", "v", 7)), "upd")
    supers = as_changes(cells(("r", "s", "c", "v", 7)), "ins")
    assert one(standard, "change") == ("upd/ks/data/r/null/c", "v")
    assert one(supers, "change") == ("ins/ks/data/r/s/c", "v")
    assert one(supers, "log") == ("ins/ks/data/r/s/c", "v-7")
    assert one(standard, "tracking") == ("upd/ks/data/r/c", "v")
    assert one(standard, "snapshot") == ("ks/data/r/null/c", "7/v")
    assert one(supers, "differential") == ("ks/data/r/s/c", "7/v/ins")
    assert one(standard, "record") == ("ks/data/r", "upd/null/c/v/7")
    assert one(standard, "audit_bootstrap") == ("r", "c:7")
    assert one(standard, "tracking_bootstrap") == ("r", "c:v:7")
    audit = split_audit_name(cells(("r", "audit:c", "v", 7)))
    assert one(audit, "audit") == ("r/null/c", "audit:v-7")
    lines = render_lines(render_changes(standard, "tracking"), ":")
    assert rows(lines) == [("upd/ks/data/r/c:v",)]


AWKWARD = ["v", "", "a/b", "x-3", "p:q", "two\nlines", "é/-7/"]


def test_log_records_round_trip(mutations):
    made = mutations(
        *[("r/x", None, "c", "ins", v, 5, i) for i, v in enumerate(AWKWARD)],
        ("r", "s", None, "del", None, -6, 90),
        ("r", None, None, "del", None, 7, 91),
    )
    records = render_changes(made, "record", keep=["seq"])
    assert rows(parse_log_records(records)) == rows(made)


def test_audit_values_round_trip(cells):
    made = [("r/x", "s", "c", v, i) for i, v in enumerate(AWKWARD)] + [("r", "audit:c", "v", 7)]
    split = split_audit_name(cells(*made))
    parsed = parse_audit_values(render_changes(split, "audit"))
    assert rows(parsed) == rows(split, *parsed.columns)


def test_bootstrap_records_round_trip(cells):
    made = cells(*[("r", "c", v, i - 2) for i, v in enumerate(AWKWARD)])
    full = parse_bootstrap(render_changes(made, "tracking_bootstrap"), True)
    assert rows(full) == rows(made, *full.columns)
    named = cells(("r", "a:b", "v", 7))
    short = parse_bootstrap(render_changes(named, "audit_bootstrap"), False)
    assert rows(short) == [("r", "a:b", 7)]


def test_log_line_shapes(mutations):
    made = mutations(
        ("r", None, "c", "ins", "v", 5_000_000, 0),
        ("r", None, "c", "del", "v", 5_000_000, 1),
        ("r", None, None, "del", None, 5_000_000, 2),
    )
    assert rows(render_log(made)) == [
        (f"[ks][r][1][data][true]{LIVE}[c][0][5000000][v]",),
        (f"[ks][r][1][data][true]{LIVE}[c][1][5000000][v]",),
        ("[ks][r][1][data][true][5][5000000][0]",),
    ]
    supers = mutations(
        ("r", "s", "c", "ins", "v", 5_000_000, 0),
        ("r", "s", None, "del", None, 5_000_000, 1),
        ("r", None, None, "del", None, 5_000_000, 2),
    )
    assert rows(render_log(supers, True)) == [
        (f"[ks][r][1][data][true]{LIVE}[s][0][5][5000000]",),
        (f"[ks][r][1][data][true]{LIVE}[s][1]{LIVE}[c][0][5000000][v]",),
        ("[ks][r][1][data][true][5][5000000][0]",),
    ]


def test_log_text_round_trip(spark, mutations, tmp_path):
    values = ["v", "", "a][b", "[x]", "]["]
    kept = ["keyspace", "column_family", "row_key", "super_column", "column_name", "op", "value", "ts"]
    for is_super in (False, True):
        sup = "s" if is_super else None
        made = mutations(
            *[("r", sup, "c", "ins", v, i, i) for i, v in enumerate(values)],
            ("r", sup, "c", "del", "gone", 50, 50),
            ("r", None, None, "del", None, 51, 51),
            *([("r", "s", None, "del", None, 52, 52)] if is_super else []),
        )
        path = str(tmp_path / f"log{is_super}")
        write_log(made, path, is_super)
        parsed = read_log(spark, path, is_super)
        assert rows(parsed, *kept) == rows(made, *kept)
        write_log(made.limit(1), path, is_super)
        assert read_log(spark, path, is_super).count() == made.count() + 1


def test_read_order_breaks_ties(spark):
    text = [f"[ks][r][1][data][true]{LIVE}[c][0][5][v{i}]" for i in range(3)]
    lines = spark.createDataFrame([(t,) for t in text], "value string").coalesce(1)
    found = parse_log(lines).orderBy("seq").select("value").collect()
    assert [r[0] for r in found] == ["v0", "v1", "v2"]


def test_unreadable_lines_are_rejected(spark):
    text = [
        f"[ks][r][1][data][true]{LIVE}[c][0][5][v]",
        f"[ks][r][1][data][true]{LIVE}[c][4][5][v]",
        "",
        "[a][b]",
    ]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    assert rows(parse_log(lines), "value") == [("v",)]
    assert rows(rejected_log_lines(lines)) == sorted([(t,) for t in text[1:]], key=repr)


def test_bad_numbers_are_rejected(spark):
    live = "[-2147483648][-9223372036854775808][1]"
    bad = [
        f"[ks][r][1][data][true]{live}[c][0][soon][v]",
        f"[ks][r][1][data][true]{live}[c][x][5][v]",
        "[ks][r][1][data][true][1][never][0]",
        "[ks][r]",
    ]
    good = f"[ks][r][1][data][true]{live}[c][0][5][v]"
    lines = spark.createDataFrame([(x,) for x in [*bad, good]], "value string")
    assert rows(parse_log(lines), "column_name", "ts") == [("c", 5)]
    assert rows(rejected_log_lines(lines), "value") == sorted((x,) for x in bad)
    both = split_log(lines)
    assert rows(both.where("rejected is not null"), "rejected", "ts") == sorted((x, None) for x in bad)
    assert rows(both.where("rejected is null"), "column_name", "ts") == [("c", 5)]


def test_the_later_file_wins_whatever_its_size(spark, mutations, tmp_path):
    path = str(tmp_path / "log")
    many = [("r", None, f"c{i}", "ins", "x" * 50, 7, 0) for i in range(2000)]
    write_log(mutations(("r", None, "c", "ins", "first", 7, 0)), path)
    time.sleep(1.1)
    write_log(mutations(*many, ("r", None, "c", "ins", "last", 7, 0)), path)
    time.sleep(1.1)
    write_log(mutations(("r", None, "d", "ins", "other", 7, 0)), path)
    found = latest_mutations(read_log(spark, path)).where("column_name = 'c'")
    assert rows(found, "value") == [("last",)]


def test_export(spark):
    schema = (
        "keyspace string, column_family string, row_key string, super_column string, "
        "column_name string, value string, ts bigint, is_deleted boolean, deleted_at bigint, "
        "super_deleted_at bigint"
    )
    made = [
        ("r", None, "a", "v", 5, False, None, None),
        ("r", None, "b", "v", 5, True, 6, None),
        ("r", "s", "a", "v", 5, False, None, None),
        ("r", "s", "b", "v", 5, True, 5, None),
        ("r", "t", "a", "v", 5, False, None, 7),
        ("r", "t", "b", "v", 5, True, 5, 7),
        ("r", "u", None, None, None, False, None, 8),
    ]
    frame = spark.createDataFrame([("ks", "data", *r) for r in made], schema)
    live = "-9223372036854775808"
    assert rows(export_cells(frame)) == sorted(
        [
            ("st/r/a/5/false:v",),
            ("st/r/b/6/true:null",),
            (f"su/r/s/{live}/a/5/false:v",),
            (f"su/r/s/{live}/b/5/true:null",),
            ("su/r/t/7:null",),
            ("su/r/u/8:null",),
        ],
        key=repr,
    )
