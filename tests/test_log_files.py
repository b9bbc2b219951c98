"""The log as a data source: ranges of bytes, places, and segments that grow."""

import os
import random

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellshift import changes_by_log, current_changes, load_log, log_lines, log_source, parse_log, read_log, register_log_source
from cellshift import render_log, run_cycle, split_log, write_log
from cellshift.sources import log_files
from cellshift.sources.log_files import _LINE, _RECORD, _starts

PIECES = [b"\n", b"\r", b"\r\n", b"]", b"[", b"]\n[", b"a", b"bc", b"]\r\n["]


@pytest.mark.parametrize("between", [_LINE, _RECORD])
def test_ranges_cover_a_file_once(monkeypatch, between):
    """However a file is cut and read, each record is found once, by the range it begins in."""
    rng = random.Random(5)
    for _ in range(300):
        monkeypatch.setattr(log_files, "_READ_BYTES", rng.randint(1, 9))
        data = b"".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        cuts = [0, *sorted(rng.sample(range(1, len(data)), min(3, len(data) - 1))), len(data)] if len(data) > 1 else [0, len(data)]
        found = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            read = lambda at, n: data[at: at + n]
            found += [r for f, _, r in _starts(read, len(data), start, between) if f < end]
        expected = between.split(data)
        assert found == (expected[:-1] if expected[-1] == b"" else expected), (data, cuts)


@pytest.mark.parametrize("block", [150, 1 << 20])
def test_it_reads_what_read_log_reads(spark, mutations, tmp_path, block):
    made = [(f"r{i % 9}", None, "c" if i % 5 else None, "ins" if i % 5 else "del", f"v{i}é" if i % 5 else None, i % 4, i) for i in range(80)]
    write_log(mutations(*made).repartition(3), str(tmp_path))
    lines = [b"no record", b"", b"[x][y]"]
    (tmp_path / "other").write_bytes(b"\r\n".join(lines))
    (tmp_path / "empty").write_bytes(b"")
    columns = ["row_key", "column_name", "op", "value", "ts"]
    assert rows(load_log(spark, str(tmp_path), block_bytes=block), *columns) == rows(read_log(spark, str(tmp_path)), *columns)
    found = split_log(log_source(spark.read, f"file:{tmp_path}", block_bytes=block)).where("rejected is not null")
    assert rows(found, "rejected") == [("",), ("[x][y]",), ("no record",)]


def test_places_order_equal_times(spark, mutations, tmp_path):
    """Later files and later bytes are newer, over any ranges."""
    for part in range(3):
        lines = [("r", None, c, "ins", f"{part}-{i}", 1, 0) for i in range(40) for c in "ab"]
        text = "\n".join(r[0] for r in render_log(mutations(*lines).coalesce(1)).collect())
        file = tmp_path / f"{9 - part}.log"
        file.write_text(text + "\n")
        os.utime(file, (1000 + part, 1000 + part))
    found = load_log(spark, str(tmp_path), block_bytes=50)
    assert found.rdd.getNumPartitions() > 50
    assert rows(changes_by_log(found, "upsert"), "column_name", "value") == [("a", "2-39"), ("b", "2-39")]
    seq = [r.seq for r in found.collect()]
    assert len(set(seq)) == 240 and max(seq) >> log_files.BYTE_BITS == 2


def test_tasks_do_not_grow_with_the_log(spark, mutations, tmp_path):
    """However small the range asked for; a task reads little more than its range."""
    (tmp_path / "log").write_bytes(b"[ks][r][1]\n" * 60_000)
    lines = log_source(register_log_source(spark) or spark.read, str(tmp_path), block_bytes=100)
    assert lines.rdd.getNumPartitions() <= log_files.RANGES
    assert lines.count() == 60_000


def test_values_with_line_breaks(spark, mutations, tmp_path):
    values = ["]\n[", "\n", "a\r\nb", "][\n]", "x]", "", "\x1b\n\x1b[", "]\n", "é\n[" * 50]
    made = mutations(*[(f"r{i}", None, "c", "ins", v, i, i) for i, v in enumerate(values)], ("d", None, None, "del", None, 9, 9))
    write_log(made.coalesce(2), str(tmp_path), escape=True)
    for block in (40, 1 << 20):
        found = load_log(spark, str(tmp_path), escaped=True, block_bytes=block)
        assert rows(found, "row_key", "value", "ts") == rows(made, "row_key", "value", "ts")


def test_no_files(spark, tmp_path):
    assert load_log(spark, str(tmp_path)).collect() == []
    with pytest.raises(PySparkException):
        load_log(spark, str(tmp_path / "nowhere")).collect()


def test_a_stream_of_segments_that_grow(spark, mutations, tmp_path):
    register_log_source(spark)
    log, made = tmp_path / "log", []
    log.mkdir()

    def append(name, *new, half=b""):
        made.extend(new)
        with open(log / name, "ab") as f:
            for (line,) in render_log(mutations(*new).coalesce(1)).collect():
                f.write(line.encode() + b"\n")
            f.write(half)

    def cycle():
        lines = log_source(spark.readStream, str(log), block_bytes=40)
        run_cycle(split_log(lines), str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
        assert rows(current_changes(spark, str(tmp_path / "cp"))) == rows(changes_by_log(mutations(*made)))

    append("1.log", ("r", None, "a", "ins", "1", 1, 0), ("r", None, "b", "ins", "1", 1, 1))
    cycle()
    line = render_log(mutations(("r", None, "b", "ins", "2", 2, 4))).first()[0].encode()
    # The last segment grows, by a line that is not whole yet; nothing new; a next segment.
    append("1.log", ("r", None, "a", "ins", "2", 1, 2), half=line[:9])
    cycle()
    cycle()
    with open(log / "1.log", "ab") as f:
        f.write(line[9:] + b"\n")
    made.append(("r", None, "b", "ins", "2", 2, 4))
    append("2.log", ("r", None, None, "del", None, 2, 5), ("r", None, "c", "ins", "1", 3, 6))
    cycle()
    append("0.log", ("r", None, "z", "ins", "1", 3, 7))
    append("2.log", ("r", None, "z", "ins", "1", 3, 8))
    with pytest.raises(Exception, match="turned up"):
        cycle()


def test_lines_of_a_batch_and_their_columns(spark, mutations, tmp_path):
    write_log(mutations(("r", None, "a", "ins", "1", 1, 0)), str(tmp_path))
    register_log_source(spark)
    assert log_source(spark.read, str(tmp_path)).columns == ["value", "seq"]
    assert log_source(spark.readStream, str(tmp_path)).columns == log_lines(spark.readStream, str(tmp_path)).columns
    assert parse_log(log_source(spark.read, str(tmp_path))).select(F.max("seq")).first()[0] == 0
