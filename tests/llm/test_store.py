from pathlib import Path

import pytest

from panelforge.llm import _store


def test_written_tables_stay_and_go(spark):
    df = spark.range(10)
    kept = _store.durable(df, "ten")
    folder = Path(_store._application_folder(spark).removeprefix("file:"))
    assert kept.count() == 10 and kept.dtypes == df.dtypes and any(folder.iterdir())
    assert _store.durable(df.limit(0), "none").count() == 0
    _store.forget(spark)
    assert not folder.exists()
    assert _store.durable(df, "again").count() == 10


def test_tables_on_the_way_go(spark):
    passing = []

    def make():
        passing.append(_store.durable(spark.range(5), "passing"))
        return _store.settled(lambda: passing[0].selectExpr("id + 1 id"), spark, "inner")

    out = _store.settled(make, spark, "out")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    assert not Path(passing[0].inputFiles()[0].removeprefix("file:")).exists()


def test_batches_are_kept_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    _store.small_batches(spark)
    assert spark.conf.get(key) == str(_store.BATCH_BYTES)
    spark.conf.set(key, "1048576")
    _store.small_batches(spark)
    assert spark.conf.get(key) == "1048576"
    spark.conf.set(key, before)


def test_an_unset_folder_is_made_once():
    from types import SimpleNamespace

    none = SimpleNamespace(get=lambda *a: None)
    on = lambda master: SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, applicationId="unset", master=master))
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _store.shared_folder(on(master))
    bare = on("local[4]")
    assert _store.shared_folder(bare) == _store.shared_folder(bare) and Path(_store.shared_folder(bare)).is_dir()
