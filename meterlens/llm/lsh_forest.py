"""Operator 4: near-duplicate documents by an LSH forest of MinHash signatures.

A document is its set of five-word shingles.  Equal sets become one node first.  A
node has a signature of 96 minima, and 24 trees each order all nodes by the signature
read from another position on.  Nodes that share the first three values of a tree's
order form a region; regions with many nodes go deeper until they are small.  Nodes
next to each other in a region's order are candidates; their full sets are compared,
and verified links are joined into components.  A few trees come first, then all of
them for what is not joined yet, so that a large group gets a few links a node.
Candidates between components that no verified link has joined are then taken from
whole regions, and compared too.  At last
every region of the first depth that was too large is compared whole: all its pairs of
different components, block by block, on full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, stored
from meterlens.llm.words import SPACED, Words, grams, mixed

SHINGLE_WORDS = 5
#: Values of a signature; tree t reads them from position 4 * t on.
VALUES, TREES, STRIDE = 96, 24, 4
#: Depths a region is cut at, one after the other, while it has more than REGION nodes.
DEPTHS, REGION = (3, 4, 6, 8, 12, 16), 64
#: Places apart in a region of nodes compared in the first rounds, and in the last; trees of the first round.
NEAR, FAR, FIRST_TREES = 1, REGION - 1, 6
#: Places of the rounds after the first, over all trees.
ROUNDS = (NEAR, FAR)
#: Agreeing values below which a pair cannot have the wanted similarity (about 4.5 standard errors below 0.75).
LEAST_AGREEMENT = 0.55
#: Links (16 bytes each) that one task joins at last.
LINKS_PER_TASK = 500_000
#: Nodes, and shingles of all of them, about which a block of a crowded region has; shingles counted at a time.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 1024, 1_000_000, 4096

_FACTORS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = grams(Words(text, SPACED), SHINGLE_WORDS)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c:e]) for e, c in zip(ends, counts)]


def _node(shingles: np.ndarray) -> int:
    """One number for a whole set, order aside; null sets have none."""
    total = mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(np.array([total]))[0].astype(np.int64))


def _sketches(text: pa.Array) -> pa.Array:
    sets = _sets(text)
    some = [i for i, s in enumerate(sets) if len(s)]
    values = np.zeros((len(sets), VALUES), np.uint32)
    if some:
        flat = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        for k, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(flat * factor, starts)
            values[some, k] = (mixed(least) >> np.uint64(32)).astype(np.uint32)
    has = np.zeros(len(sets), bool)
    has[some] = True
    ends = np.concatenate([[0], np.cumsum(np.where(has, VALUES, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[has].ravel().view(np.int32)))
    return pa.StructArray.from_arrays(
        [pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), lists],
        ["n", "node", "signature"])


def _node_and_set(text: pa.Array) -> pa.Array:
    sets = _sets(text)
    return pa.array([{"node": _node(s) if len(s) else None, "shingles": s.view(np.int64)} for s in sets],
                    pa.struct([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))]))


def _read_from(tree: Column, depth: int, first: int = 0) -> Column:
    """Values ``first`` to ``depth`` of the signature as a tree orders them."""
    round_trip = F.concat("signature", F.slice("signature", 1, DEPTHS[-1] + 4))
    return F.slice(round_trip, tree * STRIDE + 1 + first, F.lit(depth - first))


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, tree, tail, node) of all regions with two nodes or more, where ``tail`` orders a region; (key, node) of crowded ones.

    A crowded region has more than REGION nodes at the first depth.  Whatever is still too large at the last depth - nodes of almost equal signatures - is dealt into blocks at
    random, differently in each tree.
    """
    rows = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    first = DEPTHS[0]
    shared = _shared(rows.select("node", "tree", _key(first).alias("key")), first)
    crowded = shared.where(F.col("size") > REGION).select("key", "node")
    # one row per node meets its signature, whatever the number of its regions; from here on rows carry it along
    places = shared.groupBy("node").agg(F.collect_list(F.struct("tree", "key", "size")).alias("places"))
    signed = stored(places.join(nodes.select("node", "n", "signature"), "node"), "signed")
    small = F.col("p.size") <= REGION
    rows = signed.select("node", "n", "signature", F.explode("places").alias("p"))
    kept = ("node", "n", "signature")
    out = rows.where(small).select(*kept, "p.tree", "p.key", F.lit(first).alias("depth"))
    rows = rows.where(~small).select(*kept, "p.tree")
    some = not crowded.isEmpty()
    for depth in DEPTHS[1:] if some else ():
        shared = _shared(rows.select(*kept, "tree", _key(depth).alias("key")), depth)
        last = depth == DEPTHS[-1]
        blocks = F.ceil(F.col("size") / (REGION // 2)).cast("int")
        block = F.when(F.col("size") > REGION, F.pmod(F.xxhash64("node", "tree", F.lit("block")), blocks)).otherwise(0)
        done = shared if last else shared.where(F.col("size") <= REGION)
        out = out.unionByName(done.select(*kept, "tree", F.xxhash64("key", block).alias("key") if last else F.col("key"),
                                          F.lit(depth).alias("depth")))
        rows = shared.where(F.col("size") > REGION).select(*kept, "tree")
        if last or rows.isEmpty():
            break
    tails = F.concat(*[F.when(F.col("depth") == d, _read_from(F.col("tree"), d + 4, d)).otherwise(F.array()) for d in DEPTHS])
    return out.select("key", "tree", tails.alias("tail"), "node", "n", _packed("signature").alias("sketch")), crowded


def _key(depth: int) -> Column:
    return F.xxhash64("tree", F.lit(depth), _read_from(F.col("tree"), depth))


def _shared(keyed: DataFrame, depth: int) -> DataFrame:
    """Rows whose key another row has too, with the ``size`` of that region."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(keyed.join(counts, "key"), f"shared{depth}")


def _packed(signature: str) -> Column:
    """The lowest eight bits of every value."""
    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        rows = values.flatten().to_numpy().astype(np.uint8).reshape(-1, VALUES)
        return pa.array([r.tobytes() for r in rows], pa.binary())
    return pack(signature)


def _pairs(span: int, percent: int, trees: int):
    """Candidate pairs up to ``span`` places apart in a region.

    If only the first ``trees`` trees give pairs, all give the nodes that any later round may compare.
    """
    def run(batches):
        carry = None
        for batch in batches:
            old = 0 if carry is None else len(carry)
            rows = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            key, tree, n, node, group = (rows[c].to_numpy() for c in ("key", "tree", "n", "node", "group"))
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, VALUES)
            near, far = [], []
            for step in range(1, min(FAR if trees < TREES else span, len(rows) - 1) + 1):
                same = key[:-step] == key[step:]
                if not same.any():
                    break
                i = np.flatnonzero(same & (group[:-step] != group[step:]))
                j = i + step
                i, j = i[j >= old], j[j >= old]
                fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[fits], j[fits]
                fits = (sketch[i] == sketch[j]).mean(1) >= LEAST_AGREEMENT
                i, j = i[fits], j[fits]
                if trees < TREES:
                    far += [node[i], node[j]]
                if step <= span:
                    first = tree[i] < trees
                    near.append((node[i[first]], node[j[first]]))
            if near:
                x, y = np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near])
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pd.DataFrame({"x": both[0], "y": both[1]})
            if far:
                one = np.unique(np.concatenate(far))
                yield pd.DataFrame({"x": one, "y": one})
            carry = rows.iloc[-FAR:]
    return run


def _candidates(found: DataFrame, span: int, percent: int, trees: int = TREES) -> DataFrame:
    """Distinct candidate pairs x < y of rows (key, tree, tail, node, n, sketch, group); of fewer ``trees``, also lone nodes as x = y."""
    dealt = found.repartition("key").sortWithinPartitions("key", "tail", "node")
    return dealt.drop("tail").mapInPandas(_pairs(span, percent, trees), "x long, y long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("x"), F.col("shingles").alias("s"))
    b = sets.select(F.col("node").alias("y"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    return (pairs.join(a, "x").join(b, "y").withColumn("_common", common)
            .where(100 * F.col("_common") >= percent * (F.size("s") + F.size("t") - F.col("_common"))).select("x", "y"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    flat = [np.concatenate(sets) for sets in (a, b)]
    owner = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (a, b)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    at = [np.searchsorted(both, f) for f in flat]
    hit = [both[np.minimum(i, len(both) - 1)] == f for i, f in zip(at, flat)]
    at, owner = [i[h] for i, h in zip(at, hit)], [o[h] for o, h in zip(owner, hit)]
    for first in range(0, len(both), COLUMNS):
        parts = []
        for i, o, sets in zip(at, owner, (a, b)):
            here = (i >= first) & (i < first + COLUMNS)
            part = np.zeros((len(sets), min(COLUMNS, len(both) - first)), np.float32)
            part[o[here], i[here] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _spanning(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few places of ``linked`` as join the groups ``a`` of its rows and ``b`` of its columns as all do."""
    names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, out = np.arange(len(names)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    while True:
        top = np.array([root(x) for x in range(len(names))])[where]
        linked = linked & (top[:len(a), None] != top[None, len(a):])
        rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(rows):
            return out
        for i, j in [*zip(rows, linked[rows].argmax(1)), *zip(linked[:, columns].argmax(0), columns)]:
            x, y = root(where[i]), root(where[len(a) + j])
            if x != y:
                parent[x] = y
                out.append((int(i), int(j)))


def _compare_blocks(percent: int):
    """Links between two blocks of a region, or within one, as far as they join groups."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, group, own = (rows[c].to_numpy() for c in ("node", "group", "own"))
        lists = rows["shingles"].chunk(0)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat[s:e] for s, e in zip(at[:-1], at[1:])]
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        one, other = np.flatnonzero(own == low), np.flatnonzero(own == high)
        pairs = []
        if len(one) and len(other):
            common = _common([sets[i] for i in one], [sets[i] for i in other]).astype(np.int64)
            n = np.diff(at).astype(np.int64)
            linked = 100 * common >= percent * (n[one][:, None] + n[other][None, :] - common)
            pairs = [sorted((int(node[one[i]]), int(node[other[j]]))) for i, j in _spanning(linked, group[one], group[other])]
        return pa.table({"x": pa.array([p[0] for p in pairs], pa.int64()), "y": pa.array([p[1] for p in pairs], pa.int64())})
    return run


def crowded_links(crowded: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links x < y that join components as all links within the crowded regions (key, node) do.

    Nodes of a region's largest component are compared with its other nodes only, and these with each other too.
    Both are dealt into blocks, and each pair of blocks is a group of its own.
    """
    grouped = crowded.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("group"))
    several = grouped.groupBy("key").agg(F.min("group").alias("_least"), F.max("group").alias("_most")).where("_least <> _most").select("key")
    grouped = grouped.join(several, "key", "left_semi")  # other regions have nothing left to join
    grouped = stored(grouped.join(sets.select("node", F.size("shingles").alias("n")), "node"), "crowded")
    parts = grouped.groupBy("key", "group").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"))
    sums = parts.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("group", F.struct("n", "group")).alias("major"),
                                    F.max(F.struct("n", "group", "nodes")).alias("most"), F.sum("nodes").alias("nodes"), F.sum("n").alias("n"))

    def blocks(nodes: Column, n: Column) -> Column:
        return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    sums = sums.where("groups > 1").select(
        "key", "major", blocks(F.col("nodes") - F.col("most.nodes"), F.col("n") - F.col("most.n")).alias("rest"),
        blocks(F.col("most.nodes"), F.col("most.n")).alias("of_major"))
    is_major, deal = F.col("group") == F.col("major"), F.xxhash64("node", "key", F.lit("block"))
    own = F.when(is_major, F.col("rest") + F.pmod(deal, F.col("of_major"))).otherwise(F.pmod(deal, F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(is_major, F.col("rest") - 1).otherwise(F.col("rest") + F.col("of_major") - 1))
    dealt = (grouped.join(sums, "key").withColumn("own", own).withColumn("other", F.explode(others))
             .select("node", "key", "group", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    dealt = dealt.join(sets, "node")
    return dealt.groupBy("key", "low", "high").applyInArrow(_compare_blocks(percent), "x long, y long").distinct()


def _joined_in_task(batches):
    """Labels of the nodes of a bounded number of links: the least node that links lead to."""
    links = [b.to_pydict() for b in batches if b.num_rows]
    if not links:
        return
    x, y = (np.concatenate([np.array(b[c], np.int64) for b in links]) for c in "xy")
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, label = at[:len(x)], at[len(x):], np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    for first in range(0, len(names), 65536):
        part = slice(first, first + 65536)
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[label[part]])], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; nodes have one label if links join them.

    While there are more than LINKS_PER_TASK links, a round gives every node to a neighbour or itself - the one that a hash
    picks, which shortens chains whatever their order - and keeps the links between those, so that rounds get smaller.  The
    rest, now of bounded size, is joined in one task.
    """
    edges, steps = stored(links.select("x", "y").where("x <> y").distinct(), "links"), []
    while edges.count() > LINKS_PER_TASK:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        around = both.groupBy("x").agg(F.min(ranked("y")).alias("near"), F.first(ranked("x")).alias("own"))
        step = stored(around.select(F.col("x").alias("node"), F.least("near", "own")["to"].alias("label")), "step")
        steps.append(step)
        a = step.select(F.col("node").alias("x"), F.col("label").alias("a"))
        b = step.select(F.col("node").alias("y"), F.col("label").alias("b"))
        edges = stored(edges.join(a, "x").join(b, "y").where("a <> b").select(
            F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "links")
    labels = stored(edges.repartition(1).mapInArrow(_joined_in_task, "node long, label long"), "labels")
    for step in steps[::-1]:
        beyond = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = stored(step.join(beyond, "label", "left").select("node", F.coalesce("beyond", "label").alias("label")), "labels")
    return labels


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links (x, y) between nodes, found on the components that these join."""
    a = labels.select(F.col("node").alias("x"), F.col("label").alias("a"))
    b = labels.select(F.col("node").alias("y"), F.col("label").alias("b"))
    between = links.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("a", "x").alias("x"), F.coalesce("b", "y").alias("y"))
    new = components(between)
    beyond = new.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
    moved = labels.join(beyond, "label", "left").select("node", F.coalesce("beyond", "label").alias("label"))
    return stored(moved.unionByName(new.join(labels, "node", "left_anti")), "labels")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (smallest id of its component), ``kept``.

    Two documents are linked if 100 * common >= percent * union of their shingle sets; a document with fewer
    than five words has its whole sequence as its one shingle, and one without words (null or empty text) is
    linked with nothing and keeps its own id.  Rows may repeat and ids may repeat or be null: a null id counts
    as larger than any other, and ``kept`` compares it null-safely.  An empty table gives an empty result.

    Two nodes are compared if any of the TREES orders has them in one region.  Candidate rows are bounded, at most
    2 * FAR a node and tree; nodes of a crowded region that are not yet in its largest component are compared with
    all of the region, and only links that join components leave the task.
    """
    prepared(df.sparkSession)
    sketch = F.arrow_udf(_sketches, "struct<n:bigint,node:bigint,signature:array<int>>")(F.col(text_col))
    docs = stored(df.select(F.col(id_col).alias("id"), sketch.alias("s")).select("id", "s.*"), "sketches")
    nodes = stored(docs.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")

    found, crowded = regions(nodes.select("node", "n", "signature"))
    found = stored(found, "regions")
    first = stored(_candidates(found.withColumn("group", F.col("node")), NEAR, percent, FIRST_TREES), "candidates")
    wanted = first.select(F.explode(F.array("x", "y")).alias("node")).unionByName(crowded.select("node")).distinct()
    ids = stored(nodes.join(wanted, "node", "left_semi").select(F.col("least").alias("_wanted")).distinct(), "wanted")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        ids, F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")
    full = F.arrow_udf(_node_and_set, "struct<node:bigint,shingles:array<bigint>>")(F.col("_text"))
    sets = stored(texts.select(full.alias("s")).select("s.*").where("node IS NOT NULL").dropDuplicates(["node"]), "sets")

    tried = first.where("x < y")
    labels = components(_links(tried, sets, percent))
    for span in ROUNDS:
        grouped = found.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")
        more = stored(_candidates(grouped, span, percent).join(tried, ["x", "y"], "left_anti"), "candidates")
        verified = stored(_links(more, sets, percent), "verified")
        tried = tried.unionByName(more)
        if not verified.isEmpty():
            labels = joined_up(labels, verified)
    if not crowded.isEmpty():
        last = stored(crowded_links(crowded, labels, sets, percent), "verified")
        if not last.isEmpty():
            labels = joined_up(labels, last)

    least = nodes.select("node", "least")
    of_label = labels.join(least, "node").groupBy("label").agg(F.min("least").alias("first"))
    joined = labels.join(of_label, "label").select("node", "first")
    named = least.join(joined, "node", "left").select("node", F.coalesce("first", "least").alias("component_id"))
    return (docs.select("id", "n", "node").join(named, "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``df`` with one document of each component; documents without words all stay.

    Rows of one id and text are one document, of which one row stays.  Null ids are equal to each other; an empty table gives an
    empty result; the column name ``_id`` is reserved.
    """
    names = near_duplicates(df, id_col, text_col, percent).select(id_col, "kept").where("kept").distinct()
    kept = df.join(names.select(F.col(id_col).alias("_id")), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates([id_col, text_col])
