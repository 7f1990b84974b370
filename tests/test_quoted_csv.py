"""CSV with quoted line breaks, read in many splits, against the reader that gives a file to one task."""

from __future__ import annotations

import csv
import random

import pytest

from chartloom.sources import notes as src, quoted_csv


def write(path, rows, newline="\n", end=True):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator=newline)
        writer.writerow(["ROW_ID", "SUBJECT_ID", "HADM_ID", "TEXT"])
        writer.writerows(rows)
    if not end:
        with open(path, "rb+") as out:
            out.seek(-len(newline), 2)
            out.truncate()


def text(rng):
    kind = rng.randrange(8)
    if kind == 0:
        return ""
    if kind == 1:
        return "\n" * rng.randint(1, 400)  # breaks alone, longer than a split
    return "".join(rng.choice(['a', 'b', ' ', ',', '"', '""', '\n', '\r\n', '\n\n', 'é', '",\n"', "x,y\n"]) for _ in range(rng.randint(0, 300)))


def make(seed, n):
    rng = random.Random(seed)
    return [(k, rng.randrange(50), f"h{k}", text(rng)) for k in range(n)]


@pytest.fixture
def split_bytes(spark):
    def choose(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield choose
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,size,newline,end", [(1, 400, "\n", True), (2, 997, "\r\n", True), (3, 200, "\n", False), (4, 5000, "\r\n", False)])
def test_rows_equal_the_one_task_reader(spark, tmp_path, split_bytes, seed, size, newline, end):
    files = [make(seed * 10 + k, 150) for k in range(2)]
    for k, rows in enumerate(files):
        write(tmp_path / f"{k}.csv", rows, newline, end)
    split_bytes(size)
    lines = quoted_csv._lines(spark, str(tmp_path))
    splits = quoted_csv.split_states(lines).collect()
    assert len(splits) >= 8 and {r.inside for r in splits} == {True, False}
    got = quoted_csv.read(spark, str(tmp_path))
    assert rows_of(got) == sorted(((str(k), str(s), h, t or None) for rows in files for k, s, h, t in rows), key=repr)
    if newline == "\n":  # else the other reader changes the line breaks of the texts
        one = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
        assert got.columns == one.columns and rows_of(got) == rows_of(one)


def test_fifty_splits_of_one_file(spark, tmp_path, split_bytes):
    rows = make(9, 600)
    write(tmp_path / "notes.csv", rows)
    size = (tmp_path / "notes.csv").stat().st_size
    split_bytes(size // 50)
    lines = quoted_csv._lines(spark, str(tmp_path / "notes.csv"))
    assert lines.rdd.getNumPartitions() >= 50
    got = src.read_notes(spark, str(tmp_path / "notes.csv"), "text", extra={"row_id": "bigint"}, fmt="csv", multiline=True)
    assert {r.row_id: (r.subject_id, r.hadm_id, r.text) for r in got.collect()} == {k: (s, h, t) for k, s, h, t in rows}


def test_one_record_over_many_splits_and_a_long_header(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_text('"id\n\n\n\n\n\n\n\n\n\n\n","text"\n1,"' + "line\n" * 500 + '"\n\n2,b\n3,"open\n to the end')
    split_bytes(100)
    one = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    got = quoted_csv.read(spark, str(tmp_path))
    assert got.columns == one.columns and rows_of(got)[:2] == rows_of(one)[:2] and got.count() == 3


def test_files_without_rows(spark, tmp_path):
    write(tmp_path / "a.csv", [])
    assert quoted_csv.read(spark, str(tmp_path)).count() == 0
