"""Exact distinct counts over any range of days, from sets kept per day."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from meterlens.plans import distinct as X


def frame(spark, rows):
    return spark.createDataFrame(rows, "d string, kind string, value string").select(F.to_date("d").alias("usage_date"), "kind", "value")


def counts(spark, root, kind, start, end):
    return X.count_distinct(spark, root, kind, start, end).first()[0]


def test_ranges_count_as_the_rows_do(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"2024-01-{1 + rng.randrange(20):02d}", rng.choice("ab"), f"v{int(rng.paretovariate(0.4)) % 5000}") for _ in range(6000)]
    rows += [("2024-01-05", "a", None), ("2024-01-05", "a", "hot"), *[("2024-01-05", "a", "hot")] * 2000]
    early = [r for r in rows if r[0] <= "2024-01-12"]
    X.add_days(str(tmp_path), frame(spark, early))
    X.add_days(str(tmp_path), frame(spark, [r for r in rows if r[0] > "2024-01-12"]))
    for start, end in (("2024-01-01", "2024-01-20"), ("2024-01-05", "2024-01-05"), ("2024-01-10", "2024-01-15"), ("2024-02-01", "2024-02-02")):
        for kind in "ab":
            wanted = {v for d, k, v in rows if k == kind and start <= d <= end and v is not None}
            assert counts(spark, str(tmp_path), kind, start, end) == len(wanted)
    by_day = {str(r.usage_date): r.distinct_values for r in X.count_distinct(spark, str(tmp_path), "a", "2024-01-01", "2024-01-20", ["usage_date"]).collect()}
    assert by_day == {d: len({v for e, k, v in rows if (e, k) == (d, "a") and v}) for d in {r[0] for r in rows if r[1] == "a"}}


def test_values_keep_their_numbers(spark, tmp_path):
    root = str(tmp_path)
    X.add_days(root, frame(spark, [("2024-01-02", "a", f"v{i}") for i in range(300)]))
    first = dict(X.store_of(spark, root).open(X.IDS).select("value", "number").collect())
    X.add_days(root, frame(spark, [("2024-01-02", "a", f"v{i}") for i in range(200, 500)] + [("2024-01-01", "a", "v7")]))
    second = dict(X.store_of(spark, root).open(X.IDS).select("value", "number").collect())
    assert {v: second[v] for v in first} == first and len(set(second.values())) == len(second) == 500
    assert max(second.values()) < 500 * 3, "numbers are dense"
    # the day was replaced, not added to
    assert counts(spark, root, "a", "2024-01-02", "2024-01-02") == 300
    assert counts(spark, root, "a", "2024-01-01", "2024-01-02") == 301
    X.add_days(root, frame(spark, []))
    assert X.store_of(spark, root).current().number == 2


def test_members_of_the_bill(spark, tables, tmp_path):
    days = ("2024-01-01", "2024-01-10")
    some = SimpleNamespace(usage=tables.usage, query_history=tables.query_history)
    X.add_days(str(tmp_path), X.members_of(some, *days))
    used = tables.usage.filter("usage_date between '2024-01-03' and '2024-01-09' and usage_quantity > 0")
    assert counts(spark, str(tmp_path), "workspace", "2024-01-03", "2024-01-09") == used.select("workspace_id").distinct().count()
    assert counts(spark, str(tmp_path), "sku", "2024-01-03", "2024-01-09") == used.select("sku_name").distinct().count()
