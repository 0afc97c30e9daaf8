import datetime as dt
import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from panelforge.operators.guards import GuardError, checked_write
from panelforge.sources import files
from panelforge.streaming import daily


def test_records_and_sequence(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt") as f:
        f.write("id,p\n1,2.5\nbroken,x\n3,4.5\n2,1.0\n")
    got = files.read_records(spark, str(tmp_path / "r.csv.gz"), "id int, p double", sequence="seq").orderBy("seq").collect()
    assert [r.id for r in got] == [1, 3, 2]


def test_series_and_months(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,X\n2010-01-04,1.0\n2010-01-29,.\n2010-02-01,3.6\n")
    got = files.read_series(spark, str(tmp_path / "s.csv"), "v")
    assert [(r.date, r.v) for r in got.orderBy("date").collect()] == [(dt.date(2010, 1, 4), 1.0), (dt.date(2010, 1, 29), None), (dt.date(2010, 2, 1), 3.6)]
    rf = {r.year_month: r.rf_monthly for r in files.risk_free(got.filter("v is not null"), "v").collect()}
    assert abs(rf["2010-02"] - 0.003) < 1e-12
    df = spark.createDataFrame([("201001", 2), ("2010-01-31", 1), ("201002", 3), ("x", 4)], "d string, v int")
    assert sorted((r.year_month, r.v) for r in files.by_month(df, "d", "2010-01").collect()) == [("2010-01", 1)]


def test_sniffing(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.csv", "x")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", "x")
    found = [files.sniff(x) for x in (b"PAR1..", gzip.compress(b"x"), box.getvalue(), sheet.getvalue(), b"a,b\n1,2", b"hello")]
    assert found == ["parquet", "gzip", "zip", "xlsx", "csv", "unknown"]
    with pytest.raises(GuardError):
        files.lower_columns(spark.createDataFrame([(1, 2)], ["A ", "b"]).toDF("A", " a"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2019, 1, 1), 1.0), (dt.date(2022, 1, 1), None)], "d date, v double")
    files.write_by_period(df, str(tmp_path / "p"), "d", 2022, 2022)
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["period=dev", "period=holdout"]
    with pytest.raises(GuardError):
        files.write_by_period(df, str(tmp_path / "q"), "d", 2022, 2021)
    assert files.split_write(df, F.col("v") > 0, str(tmp_path / "k"), str(tmp_path / "x")) == {"kept": 1, "dropped": 1}
    assert checked_write(df, str(tmp_path / "w"), 2) == 2
    with pytest.raises(GuardError):
        checked_write(df, str(tmp_path / "w2"), 3)
    assert not (tmp_path / "w2").exists()
    for rows, mode in ((3, "overwrite"), (2, "error")):  # what stands there stays
        with pytest.raises(GuardError):
            checked_write(df, str(tmp_path / "w"), rows, mode=mode)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2 and checked_write(df.limit(1), str(tmp_path / "w"), 1, mode="overwrite") == 1
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1 and checked_write(df, str(tmp_path / "w"), mode="overwrite") == 2
    assert {x.name for x in tmp_path.iterdir()} == {"p", "k", "x", "w"}
    assert files.split_write(df.limit(0), F.col("v") > 0, str(tmp_path / "k0"), str(tmp_path / "x0")) == {"kept": 0, "dropped": 0} and spark.read.parquet(str(tmp_path / "x0")).columns == df.columns
    with pytest.raises(GuardError):
        files.read_panel(spark, str(tmp_path / "w"), until=("d", dt.date(2021, 12, 31)))
    marked = files.with_metadata(df, "v", {"panel": "x"})
    marked.write.parquet(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).schema["v"].metadata == {"panel": "x"}
    assert files.content_hash(df) == files.content_hash(df.orderBy(F.desc("d"))) != files.content_hash(df.limit(1))
    assert files.config_hash({"a": 1, "b": 2}) == files.config_hash({"b": 2, "a": 1})
    assert '"counts":{"kept":1}' in files.stage_report("s", {"kept": 1}, {})


def test_streaming_daily(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    daily.run_once(daily.streaming_daily(stream, "user_id", "ts", "value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    both = out.join(batch, ["day", "user_id"])
    assert out.count() > 0 and both.count() == out.count() and both.filter((out.n != batch.n) | (F.abs(F.col("vwap") - F.col("m")) > 1e-9)).count() == 0
