"""Versions of marts: a reader sees all of one, whatever writers do or leave undone."""

import pytest
from pyspark.sql import functions as F

from meterlens.plans import marts as L
from meterlens.sources.versions import Conflict, Manifest, Store


@pytest.fixture()
def days(spark):
    def make(*rows):
        return spark.createDataFrame([(d, k, float(v)) for d, k, v in rows], "d string, key string, v double").select(
            F.to_date("d").alias("usage_date"), "key", "v")
    return make


def found(df):
    return sorted((str(r.usage_date), r.key, r.v) for r in df.collect())


def test_versions_keep_untouched_days(spark, days, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.current() is None and store.open("t") is None
    store.replace({"t": days(("2024-01-01", "a", 1), ("2024-01-02", "a", 2), ("2024-01-02", None, 3))}, {"t": ["v"]})
    second = store.change(lambda base: {"t": days(("2024-01-02", "b", 9), ("2024-01-03", "b", 4))}, {"t": ["v"]})
    assert found(store.open("t")) == [("2024-01-01", "a", 1.0), ("2024-01-02", "b", 9.0), ("2024-01-03", "b", 4.0)]
    assert found(store.open("t", "2024-01-02", "2024-01-02")) == [("2024-01-02", "b", 9.0)]
    assert (second.number, second.rows("t"), second.total("t", "v"), second.total("t", "v", "2024-01-03")) == (2, 3, 14.0, 4.0)
    assert len(store.open("t", "2024-01-03", "2024-01-09").inputFiles()) == 1


def test_open_reader_sees_its_version(spark, days, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace({"t": days(("2024-01-01", "a", 1))})
    reader, old = store.open("t"), store.current()
    store.change(lambda base: {"t": days(("2024-01-01", "a", 2))})
    assert found(reader) == found(store.open("t", manifest=old)) == [("2024-01-01", "a", 1.0)]
    assert found(store.open("t")) == [("2024-01-01", "a", 2.0)]


def test_aborted_run_changes_nothing_and_is_cleaned(spark, days, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace({"t": days(("2024-01-01", "a", 1))})
    broken = days(("2024-01-01", "a", 5)).withColumn("v", F.raise_error(F.lit("disk full")).cast("double"))
    with pytest.raises(Exception, match="disk full"):
        store.change(lambda base: {"t": broken})
    store.stage({"t": days(("2024-01-01", "a", 6))})  # a run that ended before it named its write
    assert found(store.open("t")) == [("2024-01-01", "a", 1.0)]
    store.clean()
    assert len(list((tmp_path / "data").iterdir())) == 2, "the aborted write is gone, a young one stays"
    gone = store.clean(seconds=0)
    assert len(gone) == 1 and len(list((tmp_path / "data").iterdir())) == 1
    assert found(store.open("t")) == [("2024-01-01", "a", 1.0)]


def test_two_writers_conflict(spark, days, tmp_path):
    store = Store(spark, str(tmp_path))
    base = store.replace({"t": days(("2024-01-01", "a", 1))})

    def late(_):
        store.change(lambda b: {"t": days(("2024-01-02", "a", 2))})
        return {"t": days(("2024-01-03", "a", 3))}
    with pytest.raises(Conflict):
        store.change(late)
    assert found(store.open("t")) == [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0)] and base.number == 1


def test_upsert_leaves_no_staged_rows(spark, tables, tmp_path):
    root, name = str(tmp_path), "daily_usage_summary"
    rows = L.daily_usage_summary(tables.usage, tables.list_prices, "2024-01-01", "2024-01-05")
    L.write_mart(rows, root, name)
    L.upsert_mart(rows.filter("usage_date = '2024-01-03'"), root, name)
    L.upsert_mart(rows.limit(0), root, name)
    named = {x["write"] for x in Store(spark, f"{root}/{name}").current().of(name).values()}
    assert {p.name for p in (tmp_path / name / "data").iterdir()} == named and len(named) == 2
    assert L.open_mart(spark, root, name).count() == 5
    assert Manifest().total(name, "total_spend") == 0
