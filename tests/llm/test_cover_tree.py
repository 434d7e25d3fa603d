"""Hard negatives by cover trees against all pairs."""

import math

import numpy as np
import pytest

from meterlens.llm import cover_tree
from meterlens.llm.cover_tree import Tree


def plain(rows, n_positives=5, n_negatives=5, low=80, high=100, scale=256):
    clean = set()
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.add((float("inf") if i is None else i, label, tuple(math.floor(max(-2.0**24, min(2.0**24, scale * x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    back = lambda i: None if i == float("inf") else i
    out = []
    for i, label, v in clean:
        if i == float("inf") or i % 100:
            continue
        scored = [(-dot(v, w), j, other) for j, other, w in clean]
        for s, j, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:n_positives]:
            fits = sorted((t, k) for t, k, other in scored if other != label and low * -s <= high * -t <= high * -s)[:n_negatives]
            out += [(i, back(j), r + 1, back(k), -s, -t) for r, (t, k) in enumerate(fits)]
    return sorted(out, key=str)


def ours(df, **more):
    return sorted(map(tuple, cover_tree.hard_negatives(df, lambda i: i % 100 == 0, **more).collect()), key=str)


def clustered(rng, n, width, clusters, spread):
    centres = rng.normal(size=(clusters, width))
    out = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, width))
    return out / np.linalg.norm(out, axis=1, keepdims=True) * rng.uniform(0.5, 2, size=(n, 1))


@pytest.mark.parametrize("spread", [0.05, 3])
def test_tree_covers_and_searches_exactly(spread):
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * clustered(rng, 3000, 16, 20, spread)).astype(np.int64)
    vectors[:400] = vectors[0]
    vectors[400:450] = 0
    labels = rng.integers(4, size=len(vectors))
    tree = Tree.from_row(Tree.build(vectors, labels, [np.array([i]) for i in range(len(vectors))]).row(0))
    assert sorted(tree.ids) == list(range(len(vectors))) and (vectors[tree.ids] == tree.vectors).all() and (labels[tree.ids] == tree.labels).all()
    nodes = tree.nodes
    for anchor in (vectors[0], vectors[1000], np.zeros(16, np.int64), -vectors[7]):
        scores = tree.vectors @ anchor
        length = float(np.linalg.norm(anchor))
        low, high = tree._bounds(anchor.astype(float), length, slice(0, len(nodes["start"])))
        for k, (a, z) in enumerate(zip(nodes["start"], nodes["stop"])):
            assert low[k] <= scores[a:z].min() and scores[a:z].max() <= high[k]
            assert nodes["label"][k] == cover_tree.MIXED or (tree.labels[a:z] == nodes["label"][k]).all()
            if nodes["children"][k]:
                below = range(nodes["first"][k], nodes["first"][k] + nodes["children"][k])
                assert [nodes["start"][c] for c in below] + [z] == [a] + [nodes["stop"][c] for c in below]
            else:
                assert z - a <= cover_tree.LEAF or (tree.vectors[a:z] == tree.vectors[a]).all()
        for same, skip, windows in ((True, 1000, [(-10**9, 10**9)]), (False, None, [(0, 10**9), (1000, 30000), (30001, 40000), (5, 4)])):
            rows = [(int(s), int(i)) for s, i, x in zip(scores, tree.ids, tree.labels) if (x == 2) == same and i != skip]
            wanted = [sorted((r for r in rows if a <= r[0] <= b), key=lambda r: (-r[0], r[1]))[:5] for a, b in windows]
            assert tree.search(anchor, windows, 5, 2, same, skip) == wanted


def test_search_skips_most_of_a_clustered_shard():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * clustered(rng, 20000, 32, 100, 0.1)).astype(np.int64)
    tree = Tree.build(vectors, np.zeros(len(vectors), np.int64), [np.array([i]) for i in range(len(vectors))])
    tree.looked = 0
    for i in range(0, 2000, 100):
        assert tree.search(vectors[i], [(-10**12, 10**12)], 5, 0, True)[0][0][0] == (vectors @ vectors[i]).max()
    assert tree.looked < 0.1 * 20 * len(vectors)


def test_negatives_match_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = clustered(rng, 700, 6, 12, 0.3).round(3)
    vectors[::3] = vectors[0]
    rows = [(i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(vectors)]
    rows += rows[:120] + [(None, vectors[0].tolist(), 1), (None, vectors[0].tolist(), 2), (701, None, 1), (702, [1.0, None], 1),
                          (703, [float("nan")] * 6, 1), (704, [float("inf")] * 6, 1), (705, vectors[1].tolist(), None), (706, [], 1), (800, [], 2),
                          (900, [1e300, -1e300], 0), (901, [1e30], 0), (902, [0.5] * 9, 1), (1000, [0.5] * 9, 0), (100, vectors[5].tolist(), 2)]
    frame = lambda rows: spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, shard int, score int")
    assert ours(frame(rows)) == plain(rows)
    monkeypatch.setattr(cover_tree, "BLOCK_VALUES", 12)
    monkeypatch.setattr(cover_tree, "LEAST_SHARD", 60)
    more = {"n_positives": 3, "n_negatives": 7, "low": 50, "high": 110, "scale": 100}
    assert ours(frame(rows), **more) == plain(rows, **more)
    assert ours(frame([])) == ours(frame(rows[1:50])) == ours(frame([(0, [1.0], 1)])) == []
