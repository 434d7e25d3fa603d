"""Join helper for keys of which one may own a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that are spread.  A key behind them in the order of size owns less than one part in this many of all rows.
HOT_KEYS = 1000
#: Rows one task takes without trouble: a hot key gets a partition for each so many.
TASK_ROWS = 100_000


def hot_keys(counts: DataFrame, keys: list[str], rows: str, task_rows: int = TASK_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """The keys with the most rows, with their ``rows`` and ``_copies``: how many tasks their rows are worth, 2 or more.

    ``counts`` has one row per key.  At most ``most`` keys are found, whatever the size of the data.  Null keys match
    nothing and are left out.  Every column of ``counts`` is asked for, as the last of the ties: what this shuffles is then what
    the caller's own use of ``counts`` shuffles, and Spark runs that stage once for both.
    """
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    ties = [c for c in counts.columns if c not in (rows, *keys)]
    largest = counts.filter(has_key).orderBy(F.desc(rows), *keys, *ties).limit(most)
    copies = F.ceil(F.col(rows) / task_rows).cast("int")
    return largest.select(*keys, rows, copies.alias("_copies")).filter(F.col("_copies") > 1)


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], spread_by: Column, how: str = "inner",
                counts: DataFrame | None = None, rows: str = "rows", task_rows: int = TASK_ROWS, partitions: int | None = None) -> DataFrame:
    """Join a large frame to one row per key, spreading each hot key over as many partitions as its rows ask for.

    ``small`` may have several rows per key; if they make far more rows than are read, ``partitions`` keeps Spark from
    packing all of a small input into one task, or broadcasting one side and reading the other in one.

    ``counts`` holds the number of rows of ``big`` per key (column ``rows``); a caller that groups ``big`` anyway passes
    it, and keeps ``rows`` in ``small`` if that is made of it.  Hot keys are few (see ``hot_keys``), so both sides learn theirs from a
    broadcast of at most HOT_KEYS rows: a salt taken from a unique column of the large side splits the key, and its row of
    the small side is repeated once per salt value.  Other keys are joined as they are; rows with a null key match nothing
    and are dealt to all partitions.  The result is exactly that of the plain join, without ``rows``.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count("*").alias(rows))
    hot = hot_keys(counts, keys, rows, task_rows)
    copies = F.coalesce("_copies", F.lit(1))
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.pmod(F.xxhash64(spread_by), F.when(no_key, F.lit(HOT_KEYS)).otherwise(copies)).cast("int")
    salted = big.join(F.broadcast(hot.drop(rows)), keys, "left").withColumn("_salt", salt).drop("_copies")
    same = [*keys, rows] if rows in small.columns else keys
    repeated = (small.join(F.broadcast(hot.select(*same, "_copies")), same, "left")
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies", rows))
    if partitions is not None:
        salted, repeated = (side.repartition(partitions, *keys, "_salt") for side in (salted.hint("merge"), repeated))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
