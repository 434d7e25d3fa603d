"""Operator 1: shards along a Hilbert curve over several metadata columns.

Each dimension is cut into 2^bits levels of about equal counts, the levels are
mapped to the cell's place on a Hilbert curve, rows are ordered by that place, and
the order is cut into runs of equal length.  Neighbours on the curve are neighbours
in every dimension, so each shard has narrow ranges of all of them and a filter on
any one skips most files.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import stored

#: Rows one piece of a cell should have, and the most pieces a cell is split into.
PIECE_ROWS, MOST_PIECES = 512, 1 << 16


def curve_tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """Steps of the curve in ``n`` dimensions.

    At entry corner ``e`` and direction ``d``, the sub-cube with corner bits ``l`` is number W, and is
    passed with corner E and direction D; all three at index ``(e * n + d) * 2^n + l``.
    """
    size, mask = 1 << n, (1 << n) - 1
    right = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & mask
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    ones = lambda i: ((i + 1) & -(i + 1)).bit_length() - 1  # noqa: E731  trailing one bits
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(size)]
    turn = [0 if i == 0 else ones(i - 1 + i % 2) % n for i in range(size)]
    w, e_next, d_next = [], [], []
    for e in range(size):
        for d in range(n):
            for bits in range(size):
                at = rank[right(bits ^ e, d + 1)]
                w.append(at)
                e_next.append(e ^ left(entry[at], d + 1))
                d_next.append((d + turn[at] + 1) % n)
    return w, e_next, d_next


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Place on the curve of a cell given by one level (0 to 2^bits - 1) per dimension."""
    n = len(levels)
    if n == 1:
        return levels[0].cast("long")
    w, e, d = (F.array(*map(F.lit, x)) for x in curve_tables(n))
    corner = lambda i: reduce(lambda a, b: a + b, [
        F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), j) for j, x in enumerate(levels)])
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))

    def step(s: Column, bit: Column) -> Column:
        at = (s["e"] * n + s["d"]) * (1 << n) + bit + 1
        return F.struct((s["h"] * (1 << n) + F.element_at(w, at)).alias("h"), F.element_at(e, at).alias("e"),
                        F.element_at(d, at).alias("d"))

    return F.aggregate(F.array(*[corner(i) for i in range(bits - 1, -1, -1)]), start, step)["h"]


def _codes(df: DataFrame, dims: list[str]) -> list[Column]:
    """Dimensions as numbers in the order of their values.

    A text becomes the number of the six bytes after what all texts of the column begin with.
    """
    texts = [c for c in dims if isinstance(df.schema[c].dataType, T.StringType)]
    ends = df.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(texts) for n, f in (("a", F.min), ("z", F.max))]
                  ).first() if texts else None
    out = []
    for c in dims:
        if c in texts:
            i = texts.index(c)
            low, high = (ends[f"{n}{i}"].encode() if ends[f"{n}{i}"] else b"" for n in "az")
            same = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            six = F.hex(F.substring(F.col(c).cast("binary"), same + 1, 6))
            out.append(F.conv(F.rpad(six, 12, "0"), 16, 10).cast("double"))
        else:
            out.append(F.col(c).cast("double"))
    return out


def with_levels(df: DataFrame, dims: list[str], bits: int) -> tuple[DataFrame, list[str]]:
    """``df`` with one level column per dimension; null is level 0.  Borders come from all rows."""
    codes = _codes(df, dims)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(code, shares, 10_000).alias(f"c{i}") for i, code in enumerate(codes)]).first()
    names = [f"_level{i}" for i in range(len(dims))]
    for i, (name, code) in enumerate(zip(names, codes)):
        above = [F.when(code > F.lit(x), 1).otherwise(0) for x in sorted(set(cuts[f"c{i}"] or []))]
        df = df.withColumn(name, reduce(lambda a, b: a + b, above, F.lit(0)))
    return df, names


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, spread_by: list[Column], bits: int = 5) -> DataFrame:
    """``df`` with ``hilbert`` (place of the cell), ``shard`` (0 to n_shards - 1) and ``slot`` (from 0, gapless).

    Shard sizes differ by one row at most.  Within a cell rows are in the order of a hash of ``spread_by``
    (expressions that tell rows apart), so any hot cell is cut into pieces of equal share; ties in all of
    them are told apart arbitrarily.  Nulls are level 0 of their dimension.  An empty table gives an empty
    result, fewer rows than shards leave shards empty.  Columns named like the three new ones are replaced;
    names starting with ``_level``, ``_piece`` or ``_hash`` are reserved.

    Tables of cells have at most 2^(bits * len(dims)) rows, 32,768 by default: they are the only thing broadcast.
    """
    if bits * len(dims) > 18:
        raise ValueError("more than 2^18 cells: use fewer bits")
    kept = [c for c in df.columns if c not in ("hilbert", "shard", "slot")]
    rows, levels = with_levels(df.select(*kept), dims, bits)
    rows = rows.withColumn("_hash", F.xxhash64(*spread_by))
    cells = rows.groupBy(*levels).agg(F.count("*").alias("_cell_rows"))
    cells = cells.withColumn("hilbert", hilbert_index([F.col(c) for c in levels], bits))
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("_before", F.coalesce(F.sum("_cell_rows").over(along), F.lit(0)))
                   .withColumn("_all", F.sum("_cell_rows").over(Window.partitionBy()))
                   .withColumn("_pieces", F.least(F.ceil(F.col("_cell_rows") / PIECE_ROWS), F.lit(MOST_PIECES))), "cells")

    placed = rows.join(F.broadcast(cells.select(*levels, "hilbert", "_pieces")), levels)
    placed = placed.withColumn("_piece", F.pmod("_hash", "_pieces")).drop(*levels, "_pieces")
    sizes = placed.groupBy("hilbert", "_piece").agg(F.count("*").alias("_piece_rows"))
    within = Window.partitionBy("hilbert").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_piece_rows").over(within), F.lit(0))).drop("_piece_rows")
    starts = (sizes.join(F.broadcast(cells.select("hilbert", "_before", "_all")), "hilbert")
              .select("hilbert", "_piece", (F.col("_before") + F.col("_ahead")).alias("_from"), "_all"))
    order = Window.partitionBy("hilbert", "_piece").orderBy("_hash", *spread_by)
    ranked = (placed.join(starts, ["hilbert", "_piece"])
              .withColumn("_rank", F.col("_from") + F.row_number().over(order) - 1))
    ranked = ranked.withColumn("shard", F.expr(f"CAST((_rank * {n_shards}) DIV _all AS INT)"))
    first = F.expr(f"(shard * _all + {n_shards - 1}) DIV {n_shards}")
    return ranked.select(*kept, "hilbert", "shard", (F.col("_rank") - first).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Sharded rows as one folder per shard, each sorted along the curve, so that file statistics are narrow."""
    (df.repartitionByRange("shard", "hilbert", "slot").sortWithinPartitions("shard", "hilbert", "slot")
     .write.partitionBy("shard").parquet(path))
