"""Operator 11: hard negatives by cover trees over norm-augmented candidates.

Vectors become whole numbers.  With one more component, the square root of what their
squared length lacks of the largest one, all candidates of a shard lie on one sphere,
and the order by inner product with an anchor is the order by angle.  A shard is a cover
tree: the centre of a node is one of its vectors, children's centres are picked farthest
first until they cover the node at half its radius (or are FAN, or as many as fill leaves), every vector belongs to
the nearest, and each node has the radius that covers all below it.  Centre and radius
bound the inner products of a node from both sides.  A search takes nodes best first,
skips those outside all of the anchor's windows and those that cannot better what is
found, and computes leaves exactly in whole numbers.

Equal vectors of one label are one candidate with its smallest ids, as many as can ever
be returned.  Trees are stored once; anchors come in blocks of bounded size, which are
broadcast, and every task searches the trees it reads for all of a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, stored

#: Components of all vectors of one shard, and of one block of anchors.
SHARD_VALUES, BLOCK_VALUES = 1 << 23, 1 << 22
#: Vectors of a shard of a table too small to need several, so that small tables still use all cores.
LEAST_SHARD = 2048
#: Most children of a node, and most vectors of a leaf.
FAN, LEAF = 32, 512
#: Whole components are kept within these bounds.
LARGEST = 1 << 24
#: Added to angles and bounds, far above the rounding of doubles.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-3
#: Stands for a null id; it comes after all others.
NO_ID = (1 << 63) - 1
MIXED = -(1 << 63)


class Tree:
    """A shard: vectors in leaf order and nodes as flat arrays, the children of a node side by side."""

    FIELDS = (("centre", np.int64), ("angle", np.float64), ("start", np.int64), ("stop", np.int64), ("first", np.int64),
              ("children", np.int64), ("label", np.int64))

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, id_at: np.ndarray, nodes: dict[str, np.ndarray]):
        self.vectors, self.labels, self.ids, self.id_at, self.nodes = vectors, labels, ids, id_at, nodes
        self.wide = vectors.astype(np.float64)
        self.longest = float(np.sqrt((self.wide ** 2).sum(1).max(initial=0)))
        self.centres = self.wide[nodes["centre"]]
        self.looked = 0

    @classmethod
    def build(cls, vectors: np.ndarray, labels: np.ndarray, ids: list[np.ndarray]) -> Tree:
        wide = vectors.astype(np.float64)
        square = (wide ** 2).sum(1)
        lifted = np.concatenate([wide, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1)
        longest = float(np.sqrt(square.max(initial=0)))
        order: list[np.ndarray] = []
        nodes: list[list] = [[0, 0.0, 0, 0, 0, 0, MIXED]]
        todo = [(0, np.arange(len(vectors)), 0, None)]
        placed = 0
        while todo:  # depth first, so that the vectors of a node are side by side
            at, members, centre, parts = todo.pop()
            if parts is None:
                far = _distance(lifted, members, centre)
                radius = float(far.max())
                own = labels[members]
                angle = np.pi if longest == 0 else 2 * np.arcsin(min(1.0, radius / (2 * longest)))
                nodes[at][:7] = [centre, float(angle), placed, 0, 0, 0, int(own[0]) if (own == own[0]).all() else MIXED]
                if len(members) <= LEAF or radius == 0:
                    order.append(members)
                    placed += len(members)
                    nodes[at][3] = placed
                    continue
                parts = _split(lifted, members, centre, far)
                nodes[at][4:6] = [len(nodes), len(parts)]
                nodes += [[0, 0.0, 0, 0, 0, 0, MIXED] for _ in parts]
                todo.append((at, members[:0], centre, ()))
                todo += [(nodes[at][4] + k, part, c, None) for k, (part, c) in reversed([*enumerate(parts)])]
            else:
                nodes[at][3] = placed
        order = np.concatenate(order)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat = {name: np.array([n[k] for n in nodes], kind) for k, (name, kind) in enumerate(cls.FIELDS)}
        flat["centre"] = back[flat["centre"]]
        own_ids = [ids[i] for i in order]
        return cls(vectors[order], labels[order], np.concatenate(own_ids), np.cumsum([0] + [len(x) for x in own_ids]), flat)

    def row(self, shard: int) -> dict:
        arrays = {"vectors": self.vectors.astype(np.int32), "labels": self.labels, "ids": self.ids, "id_at": self.id_at.astype(np.int64), **self.nodes}
        return {"shard": shard, "width": self.vectors.shape[1], **{k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}}

    @classmethod
    def from_row(cls, row: dict) -> Tree:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        labels = read("labels", np.int64)
        return cls(read("vectors", np.int32).reshape(len(labels), row["width"]), labels, read("ids", np.int64), read("id_at", np.int64),
                   {name: read(name, kind) for name, kind in cls.FIELDS})

    def _bounds(self, anchor: np.ndarray, length: float, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product any vector of each node can have."""
        most = length * self.longest
        if most == 0:
            return np.zeros(nodes.stop - nodes.start), np.zeros(nodes.stop - nodes.start)
        theta = np.arccos(np.clip(self.centres[nodes] @ anchor / most, -1, 1))
        spread = self.nodes["angle"][nodes] + ANGLE_SLACK
        return (most * np.cos(np.minimum(np.pi, theta + spread)) - SCORE_SLACK - 1e-9 * most,
                most * np.cos(np.maximum(0, theta - spread)) + SCORE_SLACK + 1e-9 * most)

    def _scores(self, anchor: np.ndarray, whole: np.ndarray, length: float, rows: slice) -> np.ndarray:
        if length * self.longest < 2 ** 52:
            return (self.wide[rows] @ anchor).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ whole

    def search(self, anchor: np.ndarray, windows: list[tuple[int, int]], count: int, label: int, same: bool,
               skip: int | None = None) -> list[list[tuple[int, int]]]:
        """For each window (low, high) the first ``count`` (score, id) in it, by score downwards, then id.

        Only rows of ``label`` count, or (not ``same``) only those of others; never those of the id ``skip``.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        if not len(self.labels):
            return found
        whole = np.zeros(self.vectors.shape[1], np.int64)
        whole[:len(anchor)] = anchor[:len(whole)]
        wide = whole.astype(np.float64)
        length = float(np.sqrt((wide ** 2).sum()))

        def wanted(low: float, high: float) -> bool:
            return any(high >= a and low <= b and (len(f) < count or high >= -f[-1][0]) for (a, b), f in zip(windows, found))
        top = max(b for _, b in windows)
        low, high = self._bounds(wide, length, slice(0, 1))
        heap = [(-high[0], low[0], 0)]
        while heap:
            bound, low, at = heapq.heappop(heap)
            if not wanted(low, -bound):
                continue
            if children := int(self.nodes["children"][at]):
                below = slice(first := int(self.nodes["first"][at]), first + children)
                lows, highs = self._bounds(wide, length, below)
                own = self.nodes["label"][below]
                for k in np.flatnonzero((own == MIXED) | ((own == label) == same)):
                    heapq.heappush(heap, (-highs[k], lows[k], first + int(k)))
                continue
            rows = slice(int(self.nodes["start"][at]), int(self.nodes["stop"][at]))
            self.looked += rows.stop - rows.start
            scores = self._scores(wide, whole, length, rows)
            least = [max(a, -f[-1][0]) if len(f) >= count else a for (a, _), f in zip(windows, found)]
            hits = np.flatnonzero((scores >= min(least)) & (scores <= top) & ((self.labels[rows] == label) == same))
            if not len(hits):
                continue
            hits = hits[np.argsort(-scores[hits], kind="stable")]
            of_hits = scores[hits]
            for w, ((a, b), f) in enumerate(zip(windows, found)):
                first = np.searchsorted(-of_hits, -b, side="left")
                last = np.searchsorted(-of_hits, -least[w], side="right")
                most = count + (skip is not None)
                if last - first > most:  # the best rows, and all that tie with the last of them
                    last = np.searchsorted(-of_hits, -of_hits[first + most - 1], side="right")
                if first < last:
                    for i in hits[first:last]:
                        j = rows.start + i
                        f += [(-int(scores[i]), int(x)) for x in self.ids[self.id_at[j]:self.id_at[j + 1]] if x != skip]
                    f.sort()
                    del f[count:]
        return [[(-s, x) for s, x in f] for f in found]


def _distance(lifted: np.ndarray, members: np.ndarray, centre: int) -> np.ndarray:
    return np.sqrt(((lifted[members] - lifted[centre]) ** 2).sum(1))


def _split(lifted: np.ndarray, members: np.ndarray, centre: int, far: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Children as (members, centre): the node's own centre first, then what lies farthest from all chosen ones."""
    radius, nearest, owner, centres = float(far.max()), far.copy(), np.zeros(len(members), np.int64), [centre]
    most = min(FAN, -(-2 * len(members) // LEAF))  # so that leaves are not much smaller than they may be
    while len(centres) < most and nearest.max() > radius / 2:
        new = int(members[nearest.argmax()])
        d = _distance(lifted, members, new)
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(centres)
        centres.append(new)
    parts = [(members[owner == k], c, nearest[owner == k]) for k, c in enumerate(centres)]
    out = []
    for part, c, d in parts:
        if len(part) > 3 * len(members) // 4:  # a dense middle among outliers: its inner and its outer half
            by = np.argsort(d, kind="stable")
            out += [(part[by[:len(by) // 2]], c), (part[by[len(by) // 2:]], c)]
        elif len(part):
            out.append((part, c))
    return out


_TREE = "shard int, width int, vectors binary, labels binary, ids binary, id_at binary, " + ", ".join(f"{n} binary" for n, _ in Tree.FIELDS)
_TREE_ARROW = pa.schema([("shard", pa.int32()), ("width", pa.int32())] + [(n, pa.binary()) for n in ("vectors", "labels", "ids", "id_at", *(f[0] for f in Tree.FIELDS))])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    at = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy()[at[0]:at[-1]], np.diff(at)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    ids = rows["ids"].chunk(0)
    at = ids.offsets.to_numpy()
    values = ids.values.to_numpy()
    tree = Tree.build(_matrix(rows["vec"].chunk(0)), rows["label"].to_numpy(), [values[a:z] for a, z in zip(at, at[1:])])
    return pa.Table.from_pylist([tree.row(rows["shard"][0].as_py())], _TREE_ARROW)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Tree.from_row({name: batch.column(name)[i].as_py() for name in batch.schema.names})


_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
_BATCH = 65536


def _searches(block, search):
    """Runs ``search(tree, anchor number, row of the block)``, which gives (window, score, id), for all trees and anchors."""
    def run(batches):
        out: list[tuple] = []
        for tree in _trees(batches):
            for row in block.value:
                out += [(row[0], *x) for x in search(tree, row)]
                if len(out) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_FOUND)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_FOUND)
    return run


def _of_label(count: int):
    def search(tree: Tree, row):
        _, own, label, vector = row
        return [(0, s, x) for s, x in tree.search(vector, [(-NO_ID, NO_ID)], count, label, True, own)[0]]
    return search


def _in_windows(count: int, low: int, high: int):
    def search(tree: Tree, row):
        _, label, vector, scores = row
        windows = [(-(-low * s // high), s) for s in scores]
        return [(w, s, x) for w, rows in zip(scores, tree.search(vector, windows, count, label, False)) for s, x in rows]
    return search


def _first(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc()))
    return df.withColumn("rank", place).where(F.col("rank") <= count)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part, each once; components are floor(scale * x), kept within LARGEST."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return (df.where(F.col(label_col).isNotNull() & x.isNotNull() & finite)
            .select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("vec"))
            .distinct())


def forest(rows: DataFrame, keep: int) -> DataFrame:
    """Stored cover trees, one row each, over (id, label, vec); of equal vectors and labels the ``keep`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    alike = rows.withColumn("_place", place).where(F.col("_place") <= keep).groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    alike = stored(alike, "candidates")
    n, values = alike.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    cores = alike.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-values // SHARD_VALUES), min(-(-n // LEAST_SHARD), cores))
    dealt = alike.withColumn("shard", F.pmod(F.xxhash64("label", "vec"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return stored(dealt.groupBy("shard").applyInArrow(_build, _TREE), "trees")


def hard_negatives(df: DataFrame, anchors: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor and positive, its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for whose id ``anchors`` holds.  An anchor's positives are the first ``n_positives`` rows of
    its label and of another id; for each, the first ``n_negatives`` rows of other labels with
    ``low * positive_score <= high * negative_score <= high * positive_score`` are returned, best first, ties by smaller id.
    A positive with a negative score has none.  Rows with a null label or a null, partly null or not finite vector take no part.  Equal rows count
    once; a null id comes after all others and is returned as null; missing components of shorter vectors are 0; components beyond
    2^24 after scaling count as 2^24.  An empty table gives an empty result; further columns are ignored, and no name is reserved.
    """
    spark = prepared(df.sparkSession).sparkContext
    rows = stored(whole_vectors(df, id_col, vector_col, label_col, scale), "vectors")
    trees = forest(rows, max(n_positives + 1, n_negatives))
    own = stored(rows.where(anchors(F.when(F.col("id") != NO_ID, F.col("id")))), "anchors")
    n, widest = own.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    blocks = max(1, -(-n * max(1, widest) // BLOCK_VALUES))
    own = stored(own.withColumns({"anchor": F.monotonically_increasing_id(), "block": F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks))}), "anchors")
    out = None
    for b in range(blocks):  # a block has about BLOCK_VALUES components: what is collected and broadcast is bounded by it
        block = own.where(F.col("block") == b).select("anchor", "id", "label", "vec").toArrow()
        vectors = [np.array(v, np.int64) for v in block["vec"].to_pylist()]
        numbers, ids, labels = (block[c].to_pylist() for c in ("anchor", "id", "label"))
        if not numbers:
            continue
        sent = spark.broadcast(list(zip(numbers, ids, labels, vectors)))
        schema = "anchor bigint, window bigint, score bigint, id bigint"
        positives = stored(_first(trees.mapInArrow(_searches(sent, _of_label(n_positives)), schema), ["anchor"], n_positives), "positives")
        scores: dict[int, set] = {}
        for number, score in zip(*(c.to_pylist() for c in positives.where("score >= 0").select("anchor", "score").toArrow().columns)):
            scores.setdefault(number, set()).add(score)
        with_windows = spark.broadcast([(i, label, v, sorted(scores[i], reverse=True)) for i, label, v in zip(numbers, labels, vectors) if i in scores])
        negatives = _first(trees.mapInArrow(_searches(with_windows, _in_windows(n_negatives, low, high)), schema), ["anchor", "window"], n_negatives)
        negatives = stored(negatives, "negatives")
        pairs = positives.select("anchor", F.col("id").alias("positive"), F.col("score").alias("window")).join(
            negatives.select("anchor", "window", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative")), ["anchor", "window"])
        out = pairs if out is None else out.unionByName(pairs)
        for sent_block in (sent, with_windows):
            sent_block.unpersist()
    if out is None:
        out = rows.limit(0).select(F.lit(0).cast("long").alias("anchor"), F.col("id").alias("positive"), F.col("id").alias("window"),
                                   F.lit(1).alias("rank"), F.col("id").alias("negative_score"), F.col("id").alias("negative"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.join(own.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        named("anchor_id").alias("anchor_id"), named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"),
        F.col("window").alias("positive_score"), "negative_score")
