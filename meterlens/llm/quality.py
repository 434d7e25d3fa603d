"""Operator 8: quality scores from document statistics.

Random Fourier features of about twenty statistics approximate a Gaussian kernel;
ridge regression on them is solved from normal equations that tasks sum up, and an
isotonic step turns raw scores into probabilities.  Only text statistics enter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import remainder, stored
from meterlens.llm.words import SPACED, Words, text_bytes

FEATURES, WIDTH, RIDGE, BINS, SEED = 384, 2.5, 1e-3, 1000, 7
#: Tasks of the fit; each sends one matrix of FEATURES^2 numbers, row by row, to be summed.
FIT_TASKS = 64

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SIGNS = [b".", b",", b"!", b"?", b"|", b"#$%&*@^~<>{}[]=+\\/_", b"\"'()-:;", b"\n"]


def statistics(column: pa.Array, words: Words | None = None) -> np.ndarray:
    """One row of statistics per text; null and empty texts give a row like any other.  ``words`` are its spaced words, if known."""
    data, offsets = text_bytes(column)
    n, sizes = len(column), np.diff(offsets)
    counts = np.zeros((n, 256))
    at = 0
    while at < n:  # histograms of as many texts as make up 2 MB
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20), "right")) - 1)
        owner = np.repeat(np.arange(to - at, dtype=np.int64) * 256, sizes[at:to])
        counts[at:to] = np.bincount(owner + data[offsets[at]:offsets[to]], minlength=(to - at) * 256).reshape(-1, 256)
        at = to
    words = words or Words(column, SPACED)
    n_words, owner = np.diff(words.first), words.owner()
    length = (words.end - words.start).astype(float)
    per_text = lambda x: np.bincount(owner, x, minlength=n)
    some = np.maximum(n_words, 1)
    mean = per_text(length) / some
    deviation = np.sqrt(np.maximum(per_text(length ** 2) / some - mean ** 2, 0))
    same = np.zeros(len(owner))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    ordered = words.hash.copy()  # by text, then hash
    for a, b in zip(words.first, words.first[1:]):
        ordered[a:b].sort()
    fresh = np.ones(len(owner))
    fresh[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    distinct = per_text(fresh)
    first = words.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    last = words.data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    letters = (counts[:, _UPPER].sum(1) + counts[:, _LOWER].sum(1) + counts[:, 128:].sum(1))
    chars = np.maximum(sizes, 1)
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    signs = [share(counts[:, list(s)].sum(1), some) for s in _SIGNS]
    return np.column_stack([
        np.log1p(n_words), np.log1p(sizes), mean.clip(0, 50), deviation.clip(0, 50), distinct / some,
        distinct / np.sqrt(some), share(per_text(same), n_words), share(counts[:, _UPPER].sum(1), letters),
        share(counts[:, _DIGIT].sum(1), chars), share(counts[:, 128:].sum(1), chars), share(letters, chars),
        share(per_text((first >= 65) & (first <= 90)), n_words),
        share(per_text((last < 48) | ((last > 57) & (last < 65))), n_words),
        share(per_text(length <= 2), n_words), share(per_text(length >= 12), n_words), *signs])


N_STATISTICS = 15 + len(_SIGNS)


def _statistics_lists(text: pa.Array) -> pa.Array:
    values = statistics(text).astype(np.float32)
    flat = pa.array(values.ravel(), type=pa.float32())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), flat)


def statistics_column(text: Column) -> Column:
    return F.arrow_udf(_statistics_lists, "array<float>")(text)


def fourier(values: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / WIDTH, (values.shape[1], FEATURES))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = ((values - mean) / scale).clip(-6, 6)
    return np.column_stack([np.cos(z @ w + shift) * np.sqrt(2 / FEATURES), np.ones(len(z))])


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Nondecreasing rates closest to positive / weight, by pooling neighbours."""
    blocks: list[list[float]] = []
    for w, p in zip(weight, positive):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, p2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + p2, blocks[-1][2] + k]
    return np.concatenate([np.full(k, p / w) for w, p, k in blocks]) if blocks else np.zeros(0)


def _sums(mean: np.ndarray, scale: np.ndarray):
    """Normal equations of the rows of one task: one output row per feature."""
    def run(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if len(batch):
                z = fourier(np.stack(batch["stats"].to_numpy()).astype(float), mean, scale)
                total += z.T @ np.column_stack([z, batch["label"].to_numpy()])
        yield pd.DataFrame({"i": np.arange(FEATURES + 1), "row": list(total)})
    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [rows["i"].iloc[0]], "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0)]})


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, held_fold: int = 0, calibration_fold: int = 4,
                   threshold: float = 0.3) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row of ``df``.

    Labels of rows whose id falls in ``held_fold`` (crc32 of the id as text, modulo ``folds``) are never used;
    those in ``calibration_fold`` fit the isotonic step, the rest the ridge regression.  Null labels and
    labels without a document are ignored, several labels of an id are averaged.  Without labels every score
    is 0.5.  Null and empty texts are scored from their (zero) statistics; rows stay repeated if they are.
    """
    fold = remainder(F.col(id_col), folds)
    narrow = stored(df.select(F.col(id_col).alias("id"), fold.alias("fold"), statistics_column(F.col(text_col)).alias("stats")),
                    "statistics")
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
             .dropna().groupBy("id").agg(F.avg("label").alias("label")))
    known = stored(narrow.where(F.col("fold") != held_fold).join(marks, "id").select("fold", "stats", "label"), "labelled")
    fit = known.where(F.col("fold") != calibration_fold)
    moments = fit.select(F.posexplode("stats")).groupBy("pos").agg(
        F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    if not moments:
        return narrow.select(F.col("id").alias(id_col), (F.col("fold") == held_fold).alias("held_out"),
                             F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    mean = np.array([r.m for r in moments])
    scale = np.maximum(np.array([r.s for r in moments]), 1e-6)
    rows = (fit.select("stats", "label").coalesce(FIT_TASKS).mapInPandas(_sums(mean, scale), "i int, row array<double>")
            .groupBy("i").applyInPandas(_added, "i int, row array<double>").orderBy("i").collect())
    equations = np.array([r.row for r in rows])
    penalty = np.eye(FEATURES + 1) * RIDGE * equations[-1, FEATURES]
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(equations[:, :-1] + penalty / FEATURES, equations[:, -1])

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(fourier(np.stack(stats.to_numpy()).astype(float), mean, scale) @ weights)

    held = known.where(F.col("fold") == calibration_fold)
    held = fit if held.isEmpty() else held
    place = F.round(F.greatest(F.least(raw("stats"), F.lit(1.5)), F.lit(-0.5)) * BINS)
    bins = held.select(place.alias("at"), "label").groupBy("at").agg(
        F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("at").collect()
    knots = np.array([r.at for r in bins]) / BINS
    rates = isotonic(np.array([r.n for r in bins], float), np.array([r.p for r in bins], float))

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        z = fourier(np.stack(stats.to_numpy()).astype(float), mean, scale) @ weights
        return pd.Series(np.interp(z, knots, rates).clip(0, 1))

    return narrow.select(F.col("id").alias(id_col), (F.col("fold") == held_fold).alias("held_out"),
                         score("stats").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
