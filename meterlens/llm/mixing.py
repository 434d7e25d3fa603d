"""Operator 3: mix documents to target domain weights by soft membership.

A classifier learned from a labelled table gives each document posteriors over
domains.  Nonnegative rates per document are then fitted by projected gradient
descent, every step one distributed sum, such that the expected tokens of each
domain match the targets and rates stay as near to 1 as that allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, stored
from meterlens.llm.quality import N_STATISTICS, statistics
from meterlens.llm.words import SPACED, Words

#: Hashed words counted besides the statistics, most steps of the fit, weight penalty.
BUCKETS, FIT_STEPS, PENALTY = 512, 40, 1e-3
#: Tasks of a step of the fit; each sends one matrix of features by features, row by row, to be summed.  Loss a step can still win at the end.
FIT_TASKS, LEAST_GAIN = 48, 1e-9
#: Rows of features multiplied at a time, at least, if a task has them.
BLOCK_ROWS = 1024
#: Weight of staying near rate 1, most steps, and the largest share of tokens a domain may be off at the end.
CLOSENESS, STEPS, TOLERANCE = 1e-3, 60, 1e-4


def features(text: pa.Array, words: Words | None = None) -> np.ndarray:
    words = words or Words(text, SPACED)
    place = words.owner() * BUCKETS + (words.hash >> np.uint64(20)).astype(np.int64) % BUCKETS
    counts = np.bincount(place, minlength=len(text) * BUCKETS).reshape(len(text), BUCKETS)
    return np.column_stack([statistics(text, words), np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))]).astype(np.float32)


def _packed(x: np.ndarray) -> pa.Array:
    size = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _unpacked(packed: pa.Array) -> np.ndarray:
    """Rows of features; every packed row has the same size, none is null."""
    packed = packed.cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int64)[packed.offset:packed.offset + len(packed) + 1]
    width = (at[-1] - at[0]) // (4 * max(len(packed), 1))
    return np.frombuffer(data, np.float32, width * len(packed), at[0]).reshape(len(packed), width)


def _packed_features(text: pa.Array) -> pa.Array:
    return _packed(features(text))


def _counted_features(text: pa.Array) -> pa.Array:
    words = Words(text, SPACED)
    return pa.StructArray.from_arrays([pa.array(np.diff(words.first), pa.int64()), _packed(features(text, words))], ["n_tokens", "x"])


def _blocks(batches):
    """Features and domain numbers of the rows of some batches at a time."""
    x, y, n = [], [], 0
    for b in batches:
        if b.num_rows:
            x.append(_unpacked(b.column("x")))
            y.append(b.column("y").to_numpy())
            n += b.num_rows
        if n >= BLOCK_ROWS:
            yield np.concatenate(x), np.concatenate(y)
            x, y, n = [], [], 0
    if n:
        yield np.concatenate(x), np.concatenate(y)


class Examples:
    """Features ``x`` (packed) and domain number ``y`` of every labelled id, as a stored table; iterating reads the features one by one."""

    def __init__(self, rows: DataFrame):
        self.rows, self.n = rows, rows.count()

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        return (bytes(r.x) for r in self.rows.select("x").toLocalIterator())

    def summed(self, add, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        """Sums over all examples of the arrays that ``add(x, y)`` gives for a batch; tasks add up theirs first."""
        def run(batches):
            total = [np.zeros(s) for s in shapes]
            for x, y in _blocks(batches):
                for t, more in zip(total, add(x.astype(float), y)):
                    t += more
            flat = [row for t in total for row in t.reshape(-1, t.shape[-1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["i", "row"])
        def merged(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i, row in zip(b["i"], b["row"]):
                    total[i] = total[i] + row if i in total else row
            if total:
                yield pd.DataFrame({"i": list(total), "row": list(total.values())})
        schema = "i int, row array<double>"
        found = self.rows.select("x", "y").coalesce(FIT_TASKS).mapInArrow(run, schema).repartition("i").mapInPandas(merged, schema).collect()
        rows, out = iter([np.array(r.row) for r in sorted(found, key=lambda r: r.i)]), []
        for s in shapes:
            out.append(np.stack([next(rows) for _ in range(int(np.prod(s[:-1])))]).reshape(s))
        return out


def _weighted(z: np.ndarray, weight: np.ndarray, variance: bool) -> np.ndarray:
    """Sum of the weighted squares of the rows of ``z``.  A variance has a root, and a matrix times itself costs half."""
    if variance:
        z = z * np.sqrt(np.maximum(weight, 0))[:, None]
        return z.T @ z
    return z.T @ (z * weight[:, None])


class Classifier:
    """Softmax regression on standardised features, fitted by Newton steps, each one pass over all examples."""

    def __init__(self, domains: list[str], x: Examples | None = None, y: None = None):
        self.domains, self.weights = domains, None
        if x is None or not len(x):
            return
        width = N_STATISTICS + BUCKETS
        plain, squares = x.summed(lambda x, y: (x.sum(0)[None], (x ** 2).sum(0)[None]), [(1, width), (1, width)])
        self.mean = plain[0] / len(x)
        self.scale = np.maximum(np.sqrt(np.maximum(squares[0] / len(x) - self.mean ** 2, 0)), 1e-4)
        self.weights = self._fitted(x, width + 1)

    def _fitted(self, examples: Examples, width: int) -> np.ndarray:
        """The weights of least loss.  They add up to 0 over the domains, so steps are taken along the columns of ``free``."""
        k, n = len(self.domains), len(examples)
        if k < 2:
            return np.zeros((width, k))
        free = np.linalg.svd(np.ones((1, k)))[2][1:].T
        pairs = [(r, s) for r in range(k - 1) for s in range(r + 1)]

        def at(w: np.ndarray):
            def add(x: np.ndarray, y: np.ndarray):
                z = self._rows(x)
                p = self._softmax(z @ w)
                slope = z.T @ ((p - np.eye(k)[y]) @ free)
                mean = p @ free
                bends = [_weighted(z, p @ (free[:, r] * free[:, s]) - mean[:, r] * mean[:, s], r == s) for r, s in pairs]
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                return [np.array([[loss]]), slope.T, *bends]
            loss, slope, *bends = examples.summed(add, [(1, 1), (k - 1, width), *[(width, width)] * len(pairs)])
            b = w @ free
            bend = np.zeros(((k - 1) * width, (k - 1) * width))
            for (r, s), m in zip(pairs, bends):
                for i, j in {(r, s), (s, r)}:
                    bend[i * width:(i + 1) * width, j * width:(j + 1) * width] = m / n
            bend += PENALTY * np.eye(len(bend))
            return loss[0, 0] / n + PENALTY / 2 * (b ** 2).sum(), slope.ravel() / n + PENALTY * b.T.ravel(), bend

        w = np.zeros((width, k))
        loss, slope, bend = at(w)
        step = -np.linalg.solve(bend, slope)
        for _ in range(FIT_STEPS):
            gain = -(slope @ step) / 2
            if gain < LEAST_GAIN:
                break
            new = w + step.reshape(k - 1, width).T @ free.T
            found = at(new)
            if found[0] > loss:  # too far
                step = step / 2
                continue
            w, (loss, slope, bend) = new, found
            step = -np.linalg.solve(bend, slope)
        return w

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([((x - self.mean) / self.scale).clip(-8, 8), np.ones(len(x))])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features."""
        if self.weights is None:
            return np.full((len(x), len(self.domains)), 1 / len(self.domains))
        return self._softmax(self._rows(x) @ self.weights)


def train(df: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str) -> Classifier:
    """Learn from all ids of ``labelled`` (id, domain); ids without a text and unknown domains are ignored.

    An id that repeats in ``df`` counts once, by the text with the smallest hash.
    """
    return _learned(df.select(id_col, F.xxhash64(text_col).alias("_h"), F.arrow_udf(_packed_features, "binary")(text_col).alias("_x")),
                    labelled, domains, id_col)


def _learned(rows: DataFrame, labelled: DataFrame, domains: list[str], id_col: str) -> Classifier:
    """:func:`train` from rows of id, ``_h`` (hash of the text) and ``_x`` (its packed features)."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    marks = (labelled.select(id_col, "domain").where(F.col("domain").isin(domains))
             .groupBy(id_col).agg(F.min("domain").alias("domain")).select(id_col, number.cast("int").alias("y")))
    known = (rows.join(marks, id_col).groupBy(id_col).agg(F.min("y").alias("y"), F.min_by("_x", "_h").alias("x")))
    return Classifier(domains, Examples(stored(known.select("y", "x"), "examples")))


def rates(p: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """A document's rate after the steps so far; it depends on its posteriors and the steps' domain vectors only."""
    x = np.ones(len(p))
    for g in gradients:
        x = np.maximum(0.0, x - (p @ g + CLOSENESS * (x - 1)) / (1 + CLOSENESS))
    return x


def fit_rates(members: DataFrame, targets: np.ndarray, total: float | None = None) -> list[np.ndarray]:
    """Domain vectors of the projected-gradient steps; ``members`` has ``n_tokens`` and ``p`` (array of posteriors).

    Minimises r' W r + CLOSENESS * sum(t (x - 1)^2) / T over x >= 0, where r = (expected domain tokens - targets) / T and W
    inverts the posteriors' second moments, so that one step of size 1 is exact until rates reach 0.
    """
    k = len(targets)
    p, t = F.col("p"), F.col("n_tokens").cast("double")
    sums = members.agg(F.sum(t).alias("t"), *[F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    if not sums.t:
        return []
    moments = np.array([[sums[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) / sums.t
    weight = np.linalg.inv(moments + 1e-6 * np.eye(k))
    wanted = targets / targets.sum() * (total or sums.t) / sums.t
    gradients: list[np.ndarray] = []
    before = np.full(k, np.inf)
    for _ in range(STEPS):
        now = [g for g in gradients]

        @F.pandas_udf("double")
        def rate(p: pd.Series) -> pd.Series:
            return pd.Series(rates(np.stack(p.to_numpy()), now))

        x = members.withColumn("x", rate("p"))
        have = x.agg(*[F.sum(t * F.col("x") * p[i]).alias(f"e{i}") for i in range(k)]).first()
        residual = np.array([have[f"e{i}"] for i in range(k)]) / sums.t - wanted
        if np.abs(residual).max() < TOLERANCE or np.abs(residual - before).max() < TOLERANCE / 20:
            break
        gradients.append(weight @ residual)
        before = residual
    return gradients


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        total: float | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``posteriors`` (by domain, in the order of the sorted names), ``rate`` and ``copies``.

    ``copies`` is the rate rounded up or down by a hash of id and text, so its mean over documents is the rate;
    0 drops the document.  ``total`` is the wanted sum of tokens (default: what there is).  Without labelled
    rows all posteriors are equal and, targets being out of reach, rates are the least-squares compromise.  Null and empty
    texts have no tokens and weigh nothing; their rate follows from their posteriors.  Columns of the new names are replaced.
    """
    prepared(df.sparkSession)
    domains = sorted(targets)
    new = ("n_tokens", "posteriors", "rate", "copies")
    kept = [c for c in df.columns if c not in new]
    featured = stored(df.select(*kept, F.arrow_udf(_counted_features, "struct<n_tokens:bigint,x:binary>")(F.col(text_col)).alias("_m")), "features")
    model = df.sparkSession.sparkContext.broadcast(_learned(
        featured.select(id_col, F.xxhash64(text_col).alias("_h"), F.col("_m.x").alias("_x")), labelled, domains, id_col))

    @F.arrow_udf("array<double>")
    def posteriors(x: pa.Array) -> pa.Array:
        p = model.value.posteriors(_unpacked(x).reshape(len(x), N_STATISTICS + BUCKETS))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))

    narrow = stored(featured.select(F.col("_m.n_tokens").alias("n_tokens"), posteriors("_m.x").alias("p")), "members")
    gradients = fit_rates(narrow, np.array([targets[d] for d in domains], float), total)

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(rates(np.stack(p.to_numpy()), gradients))

    part = F.pmod(F.xxhash64(id_col, text_col, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (featured.select(*kept, F.col("_m.n_tokens").alias("n_tokens"), posteriors("_m.x").alias("posteriors"))
            .withColumn("rate", rate("posteriors"))
            .withColumn("copies", (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")))


def mixed_documents(df: DataFrame, labelled: DataFrame, targets: dict[str, float], **more) -> DataFrame:
    """Every document as many times as its copies say; the column names that :func:`mix` adds, ``_copy`` and ``_m`` are reserved."""
    return (mix(df, labelled, targets, **more)
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*df.columns))


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain: ``high`` or ``low`` by the quality label; rows without one are left out."""
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).dropna()


