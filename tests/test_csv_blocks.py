"""CSV files with line breaks in quoted fields, cut into blocks of any size."""

import csv
import io
import os
import random
import tempfile

import pytest

from statsmith.sources import read_table
from statsmith.sources.csv_blocks import block_states, block_summary, records


def make(seed, rows):
    r = random.Random(seed)
    words = ["plain", 'say "hi"', "two\nlines", "a\r\nb", "", " x ", ",", '"', "é日本", "\n\n", "end\n", '\n"quoted"\n,']
    return [[str(i), "".join(r.choice(words) for _ in range(r.randint(0, 6))) or "-", r.choice(["p", "q\nr"])] for i in range(rows)]


def write(folder, name, rows, line_end="\n", header=("id", "text", "kind")):
    f = io.StringIO(newline="")
    csv.writer(f, lineterminator=line_end).writerows([header, *rows])
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(f.getvalue())
    return path


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, n) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("size", "line_end"), [(37, "\n"), (200, "\r\n"), (5000, "\n")])
def test_blocks_of_any_size(spark, small_blocks, size, line_end):
    folder = tempfile.mkdtemp(prefix="statsmith-csv-")
    rows = make(size, 150)
    path = write(folder, "t.csv", rows, line_end)
    small_blocks(size)
    assert records(spark, path).rdd.getNumPartitions() > 3 or size > 1000
    got = read_table(spark, path)
    assert got.dtypes == [("id", "bigint"), ("text", "string"), ("kind", "string")]
    assert sorted(map(tuple, got.collect())) == sorted((int(i), t, k) for i, t, k in rows)


def test_fields_longer_than_blocks_and_several_files(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="statsmith-csv-")
    rows = [["1", "x\n" * 400, "a"], ["2", '"\n' * 300, "b"], ["3", "short", "c"], ["4", "y\nz", "d"]]
    write(folder, "a.csv", rows[:2])
    write(folder, "b.csv", rows[2:])
    small_blocks(64)
    got = read_table(spark, folder)
    assert sorted(map(tuple, got.collect())) == [(int(i), t, k) for i, t, k in rows]


def test_owners(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="statsmith-csv-")
    path = write(folder, "t.csv", [["1", "line\n" * 100, "a"], ["2", "b", "c"]])
    small_blocks(100)
    states = block_states(block_summary(spark, path)).collect()
    assert len(states) >= 3 and {r["owner"] for r in states} == {0}


def test_header_over_two_lines_dots_and_missing_fields(spark):
    folder = tempfile.mkdtemp(prefix="statsmith-csv-")
    path = write(folder, "t.csv", [["1", "x\ny", "NA"], ["2", "", "w"]], header=("id", "te\nxt", "k.nd"))
    got = read_table(spark, path)
    assert got.columns == ["id", "te\nxt", "k.nd"]
    assert sorted(map(tuple, got.collect())) == [(1, "x\ny", None), (2, None, "w")]
