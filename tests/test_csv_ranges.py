"""Files read in byte ranges give the rows that reading them whole gives."""

import csv
import io
import random

import pytest

from opinara.sources import csv_ranges, uploads


@pytest.fixture
def tiny_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def whole(spark, path):
    raw = spark.read.options(**uploads.csv_options()).csv(path)
    return raw.columns, sorted(tuple(v or "" for v in r) for r in raw.collect())


def in_ranges(spark, path):
    rows = uploads.read_csv(spark, path)
    return rows.columns, sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_written_files(spark, tmp_path, tiny_ranges, seed):
    draw = random.Random(seed)
    pieces = ["a", "bc", ",", '"', "\n", "é", " ", "x" * 30, "\n\n", '",\n"', "\r\n", ""]
    want = []
    for name in ("one.csv", "two.csv"):
        out = io.StringIO()
        kind = draw.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])
        writer = csv.writer(out, quoting=kind, lineterminator=draw.choice(["\n", "\r\n"]))
        writer.writerow(["id", "te\nxt", "more"])
        rows = [(str(n), *("".join(draw.choices(pieces, k=draw.randint(0, 8))) for _ in range(2))) for n in range(60)]
        writer.writerows(rows)
        want += rows
        (tmp_path / name).write_bytes(out.getvalue().encode())
    assert csv_ranges.ranges(csv_ranges.lines_of(spark, str(tmp_path))).where("inside").count() > 10
    columns, found = in_ranges(spark, str(tmp_path))
    assert columns == ["id", "te\nxt", "more"] and found == sorted(want)


@pytest.mark.parametrize(
    "content",
    [
        'a,b\n5" pipe,6" pipe\n7,"says ""so"", twice\n\n"\n', "a,b\r\n1,2\r\n\r\n3,4", '\n\na,b\n\n1,2\n', "﻿a,b\n1,2\n",
        'a,b\n1\n1,2,3\n"",""\n', 'a,b\n1,"never closed\n2,3\n4,5', "a,b\n", 'a,a\n1,2\n', 'a,\n1,2\n', "a,b\n1, \"x\"\n \n2,\"y\n\"\n",
        '"a","b"\n"' + "long line\n" * 40 + '",1\n2,"' + "no end " * 40 + '"\n',
    ],
)
def test_odd_files(spark, tmp_path, tiny_ranges, content):
    path = tmp_path / "x.csv"
    path.write_bytes(content.encode())
    assert in_ranges(spark, str(path)) == whole(spark, str(path))


def test_states_of_lines():
    # (line, open after it from a record's start, open after it from within a quoted field)
    for line, outside, inside in [
        (b"a,b", False, True), (b'"', True, False), (b'a,"b', True, False), (b'5" x,y', False, False), (b'","', False, True),
        (b'""', False, True), (b'"a""b",c', False, False), (b'x","y', True, True), (b'",a"b', False, False),
    ]:
        assert (csv_ranges.open_after(line, False), csv_ranges.open_after(line, True)) == (outside, inside), line


def test_a_file_is_many_tasks(spark, tmp_path, tiny_ranges):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "".join(f'{n},"text\n{n}"\n' for n in range(200)))
    assert csv_ranges.ranges(csv_ranges.lines_of(spark, str(path))).count() > 50
    assert uploads.read_csv(spark, str(path)).count() == 200
