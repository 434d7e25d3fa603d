"""Hourly machine prices (K19), joined from a price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price of a machine that is not listed.
DEFAULT_HOURLY_COST = 0.50
CLOUDS = ("AWS", "AZURE", "GCP")


def with_hourly_price(rows: DataFrame, prices: DataFrame, machine: str, cloud: Column, name: str) -> DataFrame:
    """``rows`` with the hourly price of the type in column ``machine``.

    ``prices`` has one row per (cloud, instance_type) with ``hourly_cost``.  An unknown cloud tries AWS, then Azure; a
    machine without a price costs DEFAULT_HOURLY_COST.  Reports call this on one row per cluster.
    """
    listed = prices.groupBy(F.col("instance_type").alias("_machine")).agg(
        *[F.max(F.when(F.upper("cloud") == c, F.col("hourly_cost"))).alias(f"_{c}") for c in CLOUDS])
    on = F.upper(F.coalesce(cloud, F.lit("")))
    price = F.coalesce("_AWS", "_AZURE")
    for c in CLOUDS:
        price = F.when(on == c, F.col(f"_{c}")).otherwise(price)
    return (rows.join(listed, F.col(machine) == F.col("_machine"), "left")
            .withColumn(name, F.coalesce(price, F.lit(DEFAULT_HOURLY_COST)))
            .drop("_machine", *[f"_{c}" for c in CLOUDS]))
