from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from chartloom.session import cut_lineage, shared_dir
from chartloom.sources import notes as src, sinks

CSV = '''ROW_ID,SUBJECT_ID,HADM_ID,TEXT,SEMTYPES
1,10,h1,"first line
second ""quoted"" line",T1
2,10,h2,,T2
3,11,h3,plain,
4,12,h4,last,T1 T2
'''


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "notes.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_notes(spark, csv):
    df = src.read_notes(spark, csv, "TEXT", with_semtypes=True, extra={"row_id": "bigint"}, fmt="csv")
    assert df.dtypes == [
        ("subject_id", "bigint"), ("hadm_id", "string"), ("row_id", "bigint"), ("text", "string"), ("semtypes", "string"),
    ]
    assert [r["text"] for r in df.orderBy("row_id").collect()] == ['first line\nsecond "quoted" line', "", "plain", "last"]
    joined = src.choose_variant(df, "text", with_semtypes=True).orderBy("row_id").collect()
    assert [r["text"] for r in joined] == ['first line\nsecond "quoted" line T1', "T2", "plain", "last T1 T2"]
    with pytest.raises(ValueError):
        src.read_notes(spark, csv, "BODY", fmt="csv")


def test_admission_times(spark, tmp_path):
    path = tmp_path / "adm.csv"
    path.write_text("SUBJECT_ID,HADM_ID,ADMITTIME,OTHER\n1,5,2101-10-20 19:08:00,x\n1,6,,y\n")
    rows = src.read_admissions(spark, str(path), "csv").orderBy("hadm_id").collect()
    assert str(rows[0]["admittime"]) == "2101-10-20 19:08:00" and rows[1]["admittime"] is None


def test_line_numbers_and_ranges(spark, tmp_path):
    spark.range(1000).repartition(5).sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    numbered = src.number_rows(spark.read.parquet(str(tmp_path / "t")))
    lines = [r["line"] for r in numbered.collect()]
    assert sorted(lines) == list(range(1, 1001))
    assert src.skip_ranges(numbered, "line", [1, 11, 500, 1001]).count() == 489
    with pytest.raises(ValueError):
        src.skip_ranges(numbered, "line", [1])


def test_preview(spark):
    assert [r["id"] for r in src.preview(spark.range(50), ["id"], 3).collect()] == [0, 1, 2]


def test_line_list(spark, tmp_path):
    path = tmp_path / "types.txt"
    path.write_text("T1\n T2 \n\nT3")
    assert sorted(r["semtype"] for r in src.read_line_list(spark, str(path)).collect()) == ["T1", "T2", "T3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\n\"c\"", "train"), (2, "d", "test")], "subject_id long, text string, split string")
    path = sinks.write_table(df, str(tmp_path / "out"), "csv")
    assert path.endswith(".csv")
    back = src.read_table(spark, path, {"subject_id": "bigint", "text": "string"}, "csv")
    assert sorted(back.collect()) == [(1, 'a,b\n"c"'), (2, "d")]
    assert sinks.write_table(df, str(tmp_path / "again.csv"), "csv").count(".csv") == 1
    parts = sinks.write_splits(df, str(tmp_path / "parts"))
    assert {d for d in os.listdir(parts) if d.startswith("split=")} == {"split=test", "split=train"}
    report = sinks.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.json(report).first()["n"] == 2


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert cut_lineage(spark.range(5)).count() == 5


def test_local_sessions_may_use_a_temporary_folder(monkeypatch):
    from types import SimpleNamespace

    def fake(master, configured=None):
        conf = SimpleNamespace(get=lambda *_: configured)
        context = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(fake("yarn", "hdfs:///x")) == "hdfs:///x"
    assert shared_dir(fake("local[2]")).startswith("/tmp/run-") and shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))
    with pytest.raises(ValueError):
        shared_dir(fake("yarn"))


def test_lines_of_several_files_follow_their_names(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a1\na2\n")
    (tmp_path / "b.txt").write_text("b1\nb2\nb3\nb4\nb5\n")
    numbered = src.number_rows(spark.read.text(str(tmp_path)))
    assert [r.value for r in numbered.orderBy("line").collect()] == ["a1", "a2", "b1", "b2", "b3", "b4", "b5"]
    assert sorted(r.line for r in numbered.collect()) == list(range(1, 8))
