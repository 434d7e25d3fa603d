"""Operator 6: nearest vectors by hierarchical navigable small-world graphs.

Distinct vectors are dealt into shards by a hash.  Each shard gets a graph of its own,
built and searched with array operations over many points at a time and stored as flat
neighbour arrays.  Queries come in blocks of bounded size, which are broadcast; every task
searches the graphs it reads for all of a block and returns the nearest of all its graphs.
Scores are cosines in double precision of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, stored

#: Vectors of a shard, queries searched together, components of the queries broadcast together.
SHARD_VECTORS, BLOCK_QUERIES, BLOCK_VALUES = 4096, 256, 1 << 20
#: Links of a point on upper layers (twice that on the lowest), candidates while building, beam while searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 96
#: Points inserted together, points whose links are chosen together, points of a beam whose links are followed together.
BATCH, CHOSEN, FOLLOWED = 256, 128, 8
#: Pieces in which equal vectors are first counted.
SALTS = 64
#: Most tasks per core: while graphs are built (more if a task had more than FILE_GRAPHS), and while a block of queries is searched.
BUILD_TASKS, FILE_GRAPHS, SEARCH_TASKS = 16, 16, 8


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def picked(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``a[i, at[i, j]]`` for all i and j; flat positions are faster than ``np.take_along_axis``."""
    flat = at + np.arange(len(a))[:, None] * a.shape[1]
    return a.reshape(-1, *a.shape[2:]).take(flat, 0, mode="clip")


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once; (points, similarities) of ``width`` columns, best first, -1 where none."""
    q, n, most = len(queries), len(x), min(FOLLOWED, width)
    found, found_sims = np.full((q, width), -1), np.full((q, width), -np.inf, np.float32)
    points, sims, closed = found.copy(), found_sims.copy(), np.ones((q, width), bool)
    points[:, 0], closed[:, 0] = entry, False
    sims[:, 0] = np.einsum("qd,qd->q", x[entry], queries)
    # 0 where a query has not seen a point, else where in its row of neighbours it saw it last; the last column is for no point.
    seen = np.zeros(q * (n + 1), np.uint16)
    rows = np.arange(q)
    seen[rows * (n + 1) + entry] = 1
    number = np.arange(1, most * links.shape[1] + 1, dtype=np.uint16)
    while True:
        open_sims = np.where(closed, -np.inf, sims)
        at = np.argpartition(-open_sims, most - 1, 1)[:, :most]
        is_open = picked(open_sims, at) > -np.inf
        going = is_open.any(1)
        if not going.all():
            found[rows[~going]], found_sims[rows[~going]] = points[~going], sims[~going]
            if not going.any():
                break
            rows, queries, points, sims, closed, at, is_open = (a[going] for a in (rows, queries, points, sims, closed, at, is_open))
        np.put_along_axis(closed, at, True, 1)
        near = links.take(picked(points, at), 0, mode="clip")
        near[~is_open] = -1
        near = near.reshape(len(rows), -1)
        place = np.where(near >= 0, near, n) + rows[:, None] * (n + 1)
        fresh = (near >= 0) & (seen[place] == 0)
        seen[place] = number
        fresh &= seen[place] == number
        new = np.flatnonzero(fresh)
        s = np.full(near.shape, -np.inf, np.float32)
        s.ravel()[new] = np.einsum("nd,nd->n", x.take(near.ravel().take(new), 0, mode="clip"),
                                   queries.take(new // near.shape[1], 0, mode="clip"))
        all_sims = np.concatenate([sims, s], 1)
        top = np.argpartition(-all_sims, width - 1, 1)[:, :width]
        sims = picked(all_sims, top)
        points = picked(np.concatenate([points, near], 1), top)
        closed = picked(np.concatenate([closed, ~fresh], 1), top)
    found[np.isneginf(found_sims)] = -1
    order = np.argsort(-found_sims, 1, kind="stable")
    return picked(found, order), picked(found_sims, order)


def spread_links(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links per row: a candidate counts if it is nearer to the point than to any link taken before.

    Places left free go to the nearest of the others.  ``candidates`` may hold -1, the point itself and repeats.
    """
    if len(own) > CHOSEN:
        return np.concatenate([spread_links(x, own[a:a + CHOSEN], candidates[a:a + CHOSEN], most) for a in range(0, len(own), CHOSEN)])
    near = x.take(candidates, 0, mode="clip")
    sims = np.matmul(near, x[own][:, :, None])[:, :, 0]
    sims[(candidates < 0) | (candidates == own[:, None])] = -np.inf
    order = np.argsort(-sims, 1, kind="stable")
    candidates, sims, near = picked(candidates, order), picked(sims, order), picked(near, order)
    by_id = np.argsort(candidates, 1, kind="stable")
    sorted_ids = picked(candidates, by_id)
    repeat = np.zeros(candidates.shape, bool)
    np.put_along_axis(repeat, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
    usable = ~repeat & ~np.isneginf(sims)
    hides = np.matmul(near, near.transpose(0, 2, 1)) >= sims[:, None, :]
    free, left = usable.copy(), np.full(len(own), most)
    taken = np.zeros(candidates.shape, bool)
    for k in range(candidates.shape[1]):
        taken[:, k] = free[:, k] & (left > 0)
        left -= taken[:, k]
        free &= ~(hides[:, k] & taken[:, k:k + 1])
    place = np.argsort(np.where(taken, 0, np.where(usable, 1, 2)), 1, kind="stable")[:, :most]
    out = picked(np.where(usable, candidates, -1), place)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build_layer(x: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Links (positions in x, -1 for none) of the ``points``, inserted in this order, batch by batch.

    Candidates of a point are the nearest of all points inserted before it, and of its batch: a shard is small
    enough to compare them all, which is cheaper than a search for them and misses none.
    """
    links = np.full((len(x), most), -1)
    at, size = 0, 1
    while at < len(points):
        new = points[at:at + size]
        near = new[np.argsort(-(x[new] @ x[new].T), 1)[:, :most + 1]]
        if at:
            before = np.argpartition(-(x[new] @ x[points[:at]].T), min(BUILD_BEAM, at) - 1, 1)[:, :BUILD_BEAM]
            near = np.concatenate([points[before], near], 1)
        links[new] = spread_links(x, new, near, most)
        # Links back; a full list keeps the best spread of old and new.
        to, source = links[new].ravel(), np.repeat(new, most)
        to, source = to[to >= 0], source[to >= 0]
        closeness = np.einsum("ed,ed->e", x[to], x[source])
        order = np.lexsort((-closeness, to))
        to, source = to[order], source[order]
        group = np.unique(to, return_index=True)
        number = np.arange(len(to)) - np.repeat(group[1], np.diff(np.append(group[1], len(to))))
        back = np.full((len(group[0]), most), -1)
        few = number < most
        back[np.searchsorted(group[0], to[few]), number[few]] = source[few]
        if len(back):
            links[group[0]] = spread_links(x, group[0], np.concatenate([links[group[0]], back], 1), most)
        at += len(new)
        size = min(BATCH, at)
    return links


def build_graph(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (points, links).  Every point is on the last layer, one in LINKS of each on the one above."""
    x = unit(vectors)
    n = len(x)
    level = np.floor(-np.log(np.random.default_rng(n).uniform(size=n) + 1e-12) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    out = []
    for layer in range(level.max(), -1, -1):
        points = order[:int((level >= layer).sum())]
        links = build_layer(x, points, LINKS * (1 if layer else 2))
        out.append((points, links[points]))
    return out


class Graph:
    """A stored graph opened for searches."""

    def __init__(self, row):
        self.vectors = np.frombuffer(row.vectors).reshape(-1, row.dim)
        self.length = np.linalg.norm(self.vectors, axis=1)
        self.x = unit(self.vectors)
        self.ids, self.ends = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ends, np.int64)
        self.starts = np.append(0, self.ends[:-1])
        self.layers = []
        for points, links, width in zip(row.points, row.links, row.widths):
            points = np.frombuffer(points, np.int32)
            self.layers.append(np.full((len(self.x), width), -1))
            self.layers[-1][points] = np.frombuffer(links, np.int32).reshape(-1, width)
            if len(self.layers) == 1:
                self.first = points[0]

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest points, at least, found for each unit vector and their similarities, best first, -1 where there are fewer."""
        entry = np.full(len(q), self.first)
        for links in self.layers[:-1]:
            entry = beam(self.x, links, q, entry, 8)[0][:, 0]
        return beam(self.x, self.layers[-1], q, entry, max(SEARCH_BEAM, k))

    def better(self, ids: np.ndarray, queries: np.ndarray, best: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
        """The ``k`` best (row of the queries, score, id) of each query, of those in ``best`` and those found here."""
        near, sims = self.search(unit(queries), k + 1)
        row, score, other = best
        count = np.bincount(row, minlength=len(ids))
        least = np.full(len(ids), -np.inf)
        least[count == k] = score[np.cumsum(count)[count == k] - 1]
        slack = (queries.shape[1] + 16) * 2.0 ** -22  # far above the rounding of the similarities
        r, c = np.nonzero((near >= 0) & (sims >= (least - slack)[:, None]))
        p = near[r, c]
        s = np.einsum("nd,nd->n", self.vectors[p], queries[r]) / (self.length[p] * np.linalg.norm(queries, axis=1)[r])
        n = self.ends[p] - self.starts[p]
        found = self.ids[np.repeat(self.starts[p] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        r, s = np.repeat(r, n), np.repeat(s, n)
        is_other = found != ids[r]
        row, score, other = (np.concatenate(x) for x in ((row, r[is_other]), (score, s[is_other]), (other, found[is_other])))
        order = np.lexsort((other, -score, row))
        row = row[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[first], score[order][first], other[order][first]


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    layers = build_graph(vectors)
    ids = [np.asarray(x, np.int64) for x in rows["ids"]]
    return pd.DataFrame([{
        "shard": rows["shard"].iloc[0], "dim": vectors.shape[1], "vectors": vectors.tobytes(),
        "ids": np.concatenate(ids).tobytes(), "ends": np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes(),
        "points": [p.astype(np.int32).tobytes() for p, _ in layers],
        "links": [n.astype(np.int32).tobytes() for _, n in layers], "widths": [int(n.shape[1]) for _, n in layers]}])


INDEX = ("shard int, dim int, vectors binary, ids binary, ends binary, points array<binary>, links array<binary>, "
         "widths array<int>")


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector with its ``most`` smallest ids; a hot vector is first counted in pieces."""
    salted = rows.distinct().withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["_key", "vector", "_salt"], ["_key", "vector"]):
        order = Window.partitionBy(*keys).orderBy("id")
        salted = (salted.withColumn("_key", F.xxhash64("vector")).withColumn("_n", F.row_number().over(order))
                  .where(F.col("_n") <= most))
    return salted.groupBy("_key", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(vectors: DataFrame, id_col: str, vector_col: str, most_ids: int) -> tuple[DataFrame, int]:
    """One stored row per shard, and how many shards there are."""
    spark = prepared(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    found = stored(distinct_vectors(rows, most_ids), "vectors")
    shards = max(1, -(-found.count() // SHARD_VECTORS))
    tasks = min(shards, max(BUILD_TASKS * spark.sparkContext.defaultParallelism, -(-shards // FILE_GRAPHS)))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionByRange(tasks, "shard")  # as many graphs to every task, which a hash would not give
    index = dealt.groupBy("shard", F.size("vector").alias("_dim")).applyInPandas(_build, INDEX)
    return stored(index, "graphs"), shards


def _search(sent: Broadcast, k: int, pieces: int):
    """Searches the graphs of a task for the queries of a block; a graph's row is for every ``pieces``-th of them."""
    def run(batches):
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        best: dict[tuple, tuple[np.ndarray, ...]] = {}

        def own(dim: int, piece: int, at: int) -> tuple[np.ndarray, np.ndarray]:
            return tuple(x[piece::pieces][at:at + BLOCK_QUERIES] for x in sent.value[dim])
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.dim in sent.value:
                    graph = Graph(row)
                    for at in range(0, len(sent.value[row.dim][0][row.piece::pieces]), BLOCK_QUERIES):
                        key = (row.dim, row.piece, at)
                        best[key] = graph.better(*own(*key), best.get(key, none), k)
        for key, (row, score, other) in best.items():
            yield pd.DataFrame({"query_id": own(*key)[0][row], "vec_id": other, "score": score})
    return run


def _by_length(block: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The ids and the vectors of each length."""
    rows = block.select("id", "vector").toArrow().combine_chunks()
    if not rows.num_rows:
        return {}
    vectors = rows["vector"].chunk(0)
    ids, at, values = rows["id"].to_numpy().astype(np.int64), vectors.offsets.to_numpy(), vectors.values.to_numpy()
    dims = np.diff(at)
    return {int(dim): (ids[dims == dim], values[at[:-1][dims == dim][:, None] + np.arange(dim)]) for dim in np.unique(dims)}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row, by cosine, ties to the smaller id.

    A query's own id is no candidate.  Rows with a null id, and vectors that are null, empty, zero or hold
    null or non-finite components take no part, as vectors or as queries.  Rows equal in id and vector count
    once.  Vectors of different lengths are never compared.  With no vectors or queries the result is empty.

    Of equal vectors the k + 1 smallest ids are indexed: no other copy can be among the k nearest.
    """
    index, shards = build_index(vectors, id_col, vector_col, k + 1)
    spark = index.sparkSession.sparkContext
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = stored(asked.where(usable(F.col("vector")) & F.col("id").isNotNull()).distinct(), "queries")
    n, values = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-values // BLOCK_VALUES))
    # With fewer graphs than cores, a graph is searched by several tasks, each for a part of the block.
    pieces = max(1, min(-(-2 * spark.defaultParallelism // shards), n // blocks // BLOCK_QUERIES))
    if pieces > 1:
        index = index.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).repartition(shards * pieces)
    else:
        index = index.withColumn("piece", F.lit(0)).coalesce(SEARCH_TASKS * spark.defaultParallelism)
    found = None
    for b in range(blocks):  # a block has about BLOCK_VALUES components: what is collected and broadcast is bounded by it
        sent = spark.broadcast(_by_length(asked.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == b)))
        of_block = stored(index.mapInPandas(_search(sent, k, pieces), "query_id long, vec_id long, score double"), "found")
        found = of_block if found is None else found.unionByName(of_block)
        sent.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")
