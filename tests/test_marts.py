"""Written marts, routing, input checks and incremental loads."""

from datetime import date

from pyspark.sql import functions as F

from meterlens.plans import marts as L
from meterlens.plans import quality as D
from meterlens.plans import spend as S
from meterlens.session import cut_lineage
from meterlens.sources.catalog import ParquetTables, available, input_status
from meterlens.streaming.ingest import load_new_files, read_bronze

W = ("2023-08-04", "2024-01-30")


def test_write_upsert_and_read(spark, tables, tmp_path):
    root = str(tmp_path)
    marts = L.build_marts(tables, *W)
    for name in ("daily_usage_summary", "daily_query_stats", "cost_per_query"):
        L.write_mart(marts[name], root, name)
    assert L.open_mart(spark, root, "cost_per_query").count() == marts["cost_per_query"].count()
    live = marts["daily_usage_summary"]
    mart = L.open_mart(spark, root, "daily_usage_summary")
    assert D.mart_vs_live(mart, live).first().status == "pass"
    # a correction of one day and a new day
    late = live.filter("usage_date = '2024-01-30'").withColumn("total_spend", F.col("total_spend") + 1)
    new = live.filter("usage_date = '2024-01-29'").withColumn("usage_date", F.lit("2024-01-31").cast("date"))
    L.upsert_mart(late.unionByName(new), root, "daily_usage_summary")
    again = L.open_mart(spark, root, "daily_usage_summary")
    assert again.count() == live.count() + 1
    check = D.mart_vs_live(again, live).first()
    assert (check.status, check.mismatched_dates) == ("fail", 2)
    fresh = L.freshness(again, "daily_usage_summary", "2024-02-02").first()
    assert (fresh.max_date, fresh.days_behind) == (date(2024, 1, 31), 2)


def test_upsert_keeps_other_keys_of_a_day(spark, tables, tmp_path):
    root = str(tmp_path)
    mart = L.daily_product_breakdown(tables.usage, tables.list_prices, *W)
    L.write_mart(mart, root, "daily_product_breakdown")
    L.upsert_mart(mart.filter("product_category = 'SQL'").withColumn("total_dbus", F.lit(0)), root, "daily_product_breakdown")
    after = L.open_mart(spark, root, "daily_product_breakdown")
    assert after.count() == mart.count()
    assert after.filter("product_category = 'SQL'").agg(F.sum("total_dbus")).first()[0] == 0
    assert after.filter("product_category != 'SQL'").agg(F.sum("total_dbus")).first() == mart.filter("product_category != 'SQL'").agg(F.sum("total_dbus")).first()


def test_mart_equals_live(tables):
    live = S.billing_summary(tables.usage, tables.list_prices, *W).first()
    mart = L.read_summary(L.daily_usage_summary(tables.usage, tables.list_prices, *W), *W).first()
    assert (live.total_spend, live.total_dbus, live.days_in_range) == (mart.total_spend, mart.total_dbus, mart.days_in_range)


def test_mart_or_live(spark, tables, tmp_path):
    live, mart = (spark.createDataFrame([(n,)], "total_spend int") for n in (7, 3))
    for report, total, wanted in ((None, 5.0, 7), (mart, None, 7), (mart, 0.0, 7), (mart, 3.0, 3)):
        assert L.mart_or_live(report, lambda: live, total).first()[0] == wanted
    root, name = str(tmp_path), "daily_usage_summary"
    assert L.mart_total(spark, root, name, *W) is None and L.open_mart(spark, root, name) is None
    rows = L.daily_usage_summary(tables.usage, tables.list_prices, *W)
    L.write_mart(rows, root, name)
    wanted = rows.filter("usage_date between '2023-12-01' and '2023-12-31'").agg(F.sum("total_spend"), F.count("*")).first()
    assert round(L.mart_total(spark, root, name, "2023-12-01", "2023-12-31"), 6) == round(float(wanted[0]), 6)
    assert L.open_mart(spark, root, name, "2023-12-01", "2023-12-31").count() == wanted[1]
    assert L.mart_total(spark, root, name, "2020-01-01", "2020-12-31") == 0
    assert L.open_mart(spark, root, name, "2020-01-01", "2020-12-31").count() == 0
    fresh, gone = L.freshness_of(spark, root, [name, "gone"], "2024-02-02").collect()
    assert (fresh.row_count, fresh.min_date, fresh.max_date, fresh.days_behind) == (rows.count(), date(2023, 8, 4), date(2024, 1, 30), 3)
    assert tuple(gone) == ("gone", 0, None, None, None)


def test_choice_and_freshness_run_no_job(spark, tables, tmp_path):
    root, name = str(tmp_path), "daily_product_breakdown"
    L.write_mart(L.daily_product_breakdown(tables.usage, tables.list_prices, *W), root, name)
    report = L.read_by_product(L.open_mart(spark, root, name, *W), *W)
    context = spark.sparkContext
    context.setJobGroup("planning", "no job may run")
    L.mart_or_live(report, lambda: None, L.mart_total(spark, root, name, *W))
    L.freshness_of(spark, root, [name], "2024-02-02")
    assert not list(context.statusTracker().getJobIdsForGroup("planning"))
    context.setJobGroup("rest", "")


def test_refresh_keeps_the_history_window(spark, tables, tmp_path):
    assert L.history_window("2024-01-30", 10) == ("2024-01-20", "2024-01-30")
    made = L.refresh_marts(tables, str(tmp_path), "2024-01-30", 10)
    assert set(made) == set(L.MART_KEYS) and all(m.number == 1 for m in made.values())
    assert sorted(made["daily_usage_summary"].of("daily_usage_summary"))[0] == "2024-01-20"


def test_inputs(spark, tables, tmp_path):
    tables.workspaces.write.parquet(str(tmp_path / "workspaces"))
    stored = ParquetTables(spark, str(tmp_path))
    assert stored.workspaces.count() == 22 and stored.clusters is None
    status = {r.name: (r.exists, r.row_count) for r in input_status(spark, {"workspaces": f"{tmp_path}/workspaces", "gone": f"{tmp_path}/gone"}).collect()}
    assert status == {"workspaces": (True, 22), "gone": (False, None)}
    assert not available(spark, str(tmp_path / "gone"))


def test_lineage_cut_keeps_rows(spark, tables):
    assert cut_lineage(tables.workspaces).count() == 22


def test_parquet_files_load_once_and_may_widen(spark, tmp_path):
    inbox, target, ckpt = (str(tmp_path / n) for n in ("inbox", "bronze", "ckpt"))
    spark.createDataFrame([(1, 2.5)], "id int, cost double").coalesce(1).write.mode("append").parquet(f"{inbox}/a")
    assert load_new_files(spark, inbox, target, ckpt).count() == 1
    assert load_new_files(spark, inbox, target, ckpt).count() == 1
    spark.createDataFrame([(2, 3.5, "x")], "id int, cost double, team string").coalesce(1).write.parquet(f"{inbox}/b")
    rows = load_new_files(spark, inbox, target, ckpt).orderBy("id").collect()
    assert [(r.id, r.cost, r.team) for r in rows] == [(1, 2.5, None), (2, 3.5, "x")]


def test_later_loads_open_new_files_only(spark, tmp_path):
    inbox, target, ckpt = tmp_path / "inbox", str(tmp_path / "bronze"), str(tmp_path / "ckpt")
    for n, (columns, row) in enumerate([("id int, cost double", (1, 2.5)), ("id int, team string", (2, "x")), ("id int, cost double, day date", (3, 4.5, date(2024, 1, 1)))]):
        for old in inbox.rglob("*.parquet"):  # what was loaded before can no longer be read
            old.chmod(0o644)
            old.write_bytes(b"gone")
        spark.createDataFrame([row], columns).coalesce(1).write.parquet(f"{inbox}/{n}")
        assert load_new_files(spark, str(inbox), target, ckpt).count() == n + 1
    rows = [(r.id, r.cost, r.team, r.day) for r in read_bronze(spark, target).orderBy("id").collect()]
    assert rows == [(1, 2.5, None, None), (2, None, "x", None), (3, 4.5, None, date(2024, 1, 1))]
    for part in (tmp_path / "bronze").rglob("part-*.parquet"):
        part.write_bytes(b"gone")
    assert read_bronze(spark, target).columns == ["id", "cost", "_loaded_at", "team", "day"], "columns come from the log"


def test_csv_files_match_by_header(spark, tmp_path):
    inbox, target, ckpt = tmp_path / "inbox", str(tmp_path / "bronze"), str(tmp_path / "ckpt")
    inbox.mkdir()
    (inbox / "a.csv").write_text("Date,Cost\n2024-01-01,1\n2024-01-02,2\n")
    assert load_new_files(spark, str(inbox), target, ckpt, "csv").count() == 2
    # reordered columns, a new one, and a cost that no longer looks like an integer
    (inbox / "b.csv").write_text("Cost,Team,Date\n3.7,red,2024-01-03\n")
    (inbox / "c.csv").write_text("Date,Cost\n2024-01-04,4\n")
    rows = load_new_files(spark, str(inbox), target, ckpt, "csv").orderBy("Date").collect()
    assert [(str(r.Date), r.Team) for r in rows] == [("2024-01-01", None), ("2024-01-02", None), ("2024-01-03", "red"), ("2024-01-04", None)]
    assert load_new_files(spark, str(inbox), target, ckpt, "csv").count() == 4


def test_csv_with_a_given_schema(spark, tmp_path):
    from pyspark.sql import types as T
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("Cost,Date\n1,2024-01-01\n2.5,2024-01-02\n")
    schema = T.StructType([T.StructField("Cost", T.DoubleType()), T.StructField("Date", T.DateType())])
    rows = load_new_files(spark, str(inbox), str(tmp_path / "t"), str(tmp_path / "c"), "csv", schema).orderBy("Date").collect()
    assert [(r.Cost, r.Date) for r in rows] == [(1.0, date(2024, 1, 1)), (2.5, date(2024, 1, 2))]
