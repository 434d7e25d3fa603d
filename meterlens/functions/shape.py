"""Small result-shaping helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.operators.joins import join_spread


def grand_total(df: DataFrame, value: str) -> Column:
    """The sum of a column of a grouped report, as a scalar for the same report.

    The report's rows are not computed twice: the subquery asks for every column, so what it shuffles is exactly what the
    report shuffles, and Spark runs that stage once for both.  With the one column it needs, pruning would make it
    another plan, and the bill would be read again.
    """
    whole = df.agg(F.sum(F.col(value).cast("double")).alias("total"), F.max(F.struct(*df.columns)).alias("every_column"))
    return whole.select(F.struct("total", "every_column")).scalar()["total"]


def latest_rows(log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last row of each key in a change log, as an aggregate and not a sorted window; all columns come from that row."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), "change_time").alias("_row")).select(key, "_row.*")


def share_of_total(df: DataFrame, value: str, name: str = "percentage", digits: int | None = None) -> DataFrame:
    """Percent of the grand total, 0 when the total is 0.

    The total is a scalar subquery over the (already grouped) report, not a
    window without a partition, so no task has to hold the whole report.
    """
    total = grand_total(df, value)
    percent = F.coalesce(F.try_divide(100 * F.col(value).cast("double"), total), F.lit(0.0))
    return df.withColumn(name, percent if digits is None else F.round(percent, digits))


def top(df: DataFrame, by: str | Column, n: int | None, *ties: str) -> DataFrame:
    """Largest ``n`` rows; ``ties`` make the cut unique.  ``None`` keeps every row, for reports that add them up."""
    if n is None:
        return df
    key = F.col(by) if isinstance(by, str) else by
    return df.orderBy(key.desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


def wide(df: DataFrame, key: str, names: str, value: str, columns: list[str]) -> DataFrame:
    """One row per key, one column per listed name, 0 where there is no row.

    A name that is not listed adds to the column "Other"; without such a column it is an error, so nothing is lost.
    """
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns]
    rest = (F.lit("Other") if "Other" in columns else
            F.raise_error(F.concat(F.lit(f"{names} without a column: "), F.coalesce(names, F.lit("null")))).cast("string"))
    named = df.withColumn(names, F.when(F.col(names).isin(*columns), F.col(names)).otherwise(rest))
    return named.groupBy(key).pivot(names, columns).agg(F.sum(value)).select(key, *filled).orderBy(key)


def names_of(df: DataFrame, column: str) -> list[str]:
    """The distinct names a pivot spreads over: a label set, read at the edge of a report."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


#: Most values a listing puts in one array.
VALUES_PER_ROW = 100_000


def listed_values(pairs: DataFrame, key: str, value: str, alias: str, per_row: int = VALUES_PER_ROW) -> DataFrame:
    """Distinct values per key as sorted arrays.

    A key with more than ``per_row`` values takes several rows, numbered by
    ``part`` and filled by a hash of the value, so no array grows with the data
    and no value is left out.
    """
    distinct = pairs.select(key, value).distinct()
    counts = distinct.groupBy(key).agg(F.count("*").alias("_values"))
    rows_of = counts.select(key, "_values", F.ceil(F.col("_values") / per_row).alias("_rows"))
    placed = join_spread(distinct, rows_of, [key], F.coalesce(F.col(value), F.lit("")), counts=counts, rows="_values")
    part = F.pmod(F.xxhash64(value), F.col("_rows")).alias("part")
    return placed.groupBy(key, part).agg(F.array_sort(F.collect_list(value)).alias(alias)).orderBy(key, "part")


def one_row(*parts: DataFrame) -> DataFrame:
    """Put several one-row frames side by side without a join."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def flat(df: DataFrame, digits: int = 4) -> DataFrame:
    """Plain columns for comparison and export: doubles, longs and strings (dates and times as ISO text)."""
    out: list[Column] = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, T.IntegralType):
            c = c.cast("long")
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.concat_ws("|", c)
        elif isinstance(t, T.MapType):
            entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"]))
            c = F.concat_ws("|", entries)
        elif isinstance(t, T.StructType):
            out += [F.col(f"`{field.name}`.`{n}`").alias(f"{field.name}_{n}") for n in t.names]
            continue
        out.append(c.alias(field.name))
    return df.select(*out)
