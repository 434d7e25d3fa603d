"""Exact distinct counts from marts: a set of values per day, as bitmaps over dense numbers.

Counts of days do not add up, sets do.  Every value gets a number once, for good; the
values of a day are bitmaps of these numbers, and a range's distinct count is the
number of bits in the union of its days.  Numbers are dense within PARTS parts, so
numbering needs no task that sees all values, and a bitmap holds 32,768 numbers in 4 KB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.sources.versions import DAY, Manifest, Store

#: Parts that number their values for themselves.
PARTS = 64
IDS, SETS = "value_numbers", "daily_sets"


def _part(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(PARTS))


def _numbered(known: DataFrame | None, values: DataFrame) -> DataFrame:
    """(kind, value, number) of the values not yet known; numbers go on where their part ended."""
    new, last = values, None
    if known is not None:
        new = values.join(known.select("kind", "value"), ["kind", "value"], "left_anti")
        last = known.groupBy("kind", _part(F.col("value")).alias("_part")).agg(F.max("number").alias("_last"))
    rank = F.row_number().over(W.partitionBy("kind", "_part").orderBy("value")) - 1
    ranked = new.withColumn("_part", _part(F.col("value"))).withColumn("_rank", rank)
    if last is None:
        return ranked.select("kind", "value", (F.col("_rank") * PARTS + F.col("_part")).cast("long").alias("number"))
    start = F.coalesce(F.floor(F.col("_last") / PARTS) + 1, F.lit(0))
    return ranked.join(last, ["kind", "_part"], "left").select(
        "kind", "value", ((start + F.col("_rank")) * PARTS + F.col("_part")).cast("long").alias("number"))


def store_of(spark: SparkSession, root: str) -> Store:
    return Store(spark, f"{root}/distinct_values")


def add_days(root: str, pairs: DataFrame) -> Manifest:
    """Write the sets of the days of ``pairs`` (usage_date, kind, value); days that are there already are replaced.

    Null values are no members of a set, as in a distinct count.  The numbers of new values are kept with the day they were first written on.
    """
    spark = pairs.sparkSession
    store = store_of(spark, root)
    base = store.current()
    pairs = pairs.select(F.col(DAY).cast("date").alias(DAY), "kind", F.col("value").cast("string").alias("value")).where(
        F.col("value").isNotNull() & F.col(DAY).isNotNull()).distinct()
    staged = store.stage({"_pairs": pairs})  # read twice below
    pairs = store.open("_pairs", manifest=Manifest(days=staged))
    if pairs is None:
        return base or Manifest()
    known = store.open(IDS, manifest=base) if base else None
    first_day = min(staged["_pairs"])
    new = _numbered(known, pairs.select("kind", "value").distinct()).withColumn(DAY, F.lit(first_day).cast("date"))
    old_here = store.open(IDS, first_day, first_day, base) if base else None
    here = new if old_here is None else new.unionByName(old_here.select(*new.columns))
    numbers = store.stage({IDS: here})
    kept = (base.days.get(IDS, {}) if base else {}) | numbers[IDS]
    all_numbers = store.open(IDS, manifest=Manifest(days={IDS: kept})).select("kind", "value", "number")
    sets = (pairs.join(all_numbers, ["kind", "value"])
            .groupBy(DAY, "kind", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("members")))
    try:
        made = store.stage({SETS: sets})
        return store.commit(base, {IDS: kept, SETS: (base.days.get(SETS, {}) if base else {}) | made[SETS]})
    finally:
        store.discard(staged)


def count_distinct(spark: SparkSession, root: str, kind: str, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """The exact number of distinct values of a kind over days, both ends included; ``by`` keeps columns such as the day."""
    sets = store_of(spark, root).open(SETS, start, end).where(F.col("kind") == kind)
    unions = sets.groupBy(*(by or []), "bucket").agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("n"))
    return unions.groupBy(*(by or [])).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("distinct_values"))


def members_of(tables, start: str, end: str) -> DataFrame:
    """(usage_date, kind, value) of the marts' distinct counts: workspaces and SKUs with usage, users with queries."""
    from meterlens.operators.allocate import started_in
    from meterlens.operators.pricing import in_window
    used = in_window(tables.usage, start, end)
    who = F.coalesce("executed_by", "executed_as_user_id")

    def kind(df: DataFrame, day: Column, name: str, value: Column) -> DataFrame:
        return df.select(day.alias(DAY), F.lit(name).alias("kind"), value.cast("string").alias("value"))
    return (kind(used, F.col("usage_date"), "workspace", F.col("workspace_id"))
            .unionByName(kind(used, F.col("usage_date"), "sku", F.col("sku_name")))
            .unionByName(kind(started_in(tables.query_history, start, end), F.to_date("start_time"), "query_user", who)))
