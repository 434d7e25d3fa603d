"""Points against intervals, where a key may have very many intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a time bucket; price versions live for weeks.
BUCKET_SECONDS = 30 * 86400


def _bucket(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(at) / seconds)


def join_intervals(points: DataFrame, intervals: DataFrame, keys: list[tuple[str, str]], at: str, start: str, end: str,
                   how: str = "left", seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Join each point to the intervals of its key that hold it, both ends included.

    Time is cut into buckets, an interval has a row for each bucket it touches, and the bucket is part of the equi-join
    key: a point is compared with the versions of its own bucket, not with all that its key ever had.  A point lies in
    one bucket, so no pair is found twice.  Intervals with a null or negative range hold nothing.  ``keys`` are pairs of column names;
    columns of the intervals must not be named like those of the points.
    """
    valid = intervals.filter(F.col(start) <= F.col(end))
    spread = valid.withColumn("_of_interval", F.explode(F.sequence(_bucket(F.col(start), seconds), _bucket(F.col(end), seconds))))
    marked = points.withColumn("_of_point", _bucket(F.col(at), seconds))
    equal = [marked[a] == spread[b] for a, b in keys] + [F.col("_of_point") == F.col("_of_interval")]
    on = reduce(lambda a, b: a & b, equal) & marked[at].between(spread[start], spread[end])
    return marked.join(spread, on, how).drop("_of_point", "_of_interval")
