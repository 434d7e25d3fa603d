"""The other operators against brute force on small tables: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_data import SMALL, documents  # noqa: F401
from meterlens.llm import common, decontaminate, hilbert, hnsw, language, lsh_forest, mixing, quality, secrets, url_rules
from meterlens.llm.queries import ORACLES, QUERIES

SHINGLE = r"[^\x20\x09-\x0D]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", list(ORACLES))
def test_registered_queries_match_their_sql(spark, name):
    import harness
    found, wanted = harness.spark_rows(QUERIES[name](spark, SMALL)), harness.duck_rows(harness.duck(SMALL), ORACLES[name])
    assert harness.difference(found, wanted) is None


# -- sharding

def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (4, 1)):
        cells = spark.range(1 << n * bits).select(*[F.expr(f"CAST(shiftright(id, {i * bits}) % {1 << bits} AS INT)").alias(f"c{i}") for i in range(n)])
        rows = cells.select("*", hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << n * bits))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_slots_gapless(spark):
    frame = spark.range(1003).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 50).alias("n_chars"), F.lit(1).alias("shard"))
    for df in (frame, frame.unionByName(frame.limit(50)), frame.limit(5)):
        rows = hilbert.hilbert_shards(df, ["source", "n_chars"], 40, [F.col("doc_id")]).collect()
        by_shard = {}
        for r in rows:
            by_shard.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == df.count() and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
        sizes = [len(by_shard.get(s, [])) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and set(by_shard) <= set(range(40))
        last = {}
        for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
            assert last.get("h", 0) <= r.hilbert
            last["h"] = r.hilbert
    assert hilbert.hilbert_shards(frame.limit(0), ["source", "n_chars"], 40, [F.col("doc_id")]).count() == 0


# -- decontamination

def brute_hits(text, windows, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    words = re.findall(pattern, (text or "").translate(LOWER))
    hit, items = set(), set()
    for window, ids in windows.items():
        k = len(window)
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) == window:
                hit.update(range(i, i + k))
                items |= ids
    return len(words), len(hit), items


def test_contamination_against_brute_force(spark):
    rng = random.Random(5)
    bench = [(i, prose(rng, rng.choice([3, 9, 10, 25]), 60)) for i in range(30)] + [(90, None), (91, ""), (92, "one"), (93, "ONE"), (94, "-?-"), (3, "a b c")]
    windows = {}
    for i, t in bench:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        for at in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[at:at + 10]), set()).add(str(i))
    docs = [(i, prose(rng, 40, 60) + (" " + (bench[i % 30][1]).upper().replace(" ", ", ") if i % 2 else "") + " " + prose(rng, 10)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "ünd one"), (103, "x" * 200_000 + " " + bench[4][1])]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for most in (500_000, 40):
        rows = {r.doc_id: r.f for r in frame.select("doc_id", decontaminate.contamination(F.col("text"), benchmark, most=most).alias("f")).collect()}
        for i, t in docs:
            n, hit, items = brute_hits(t, windows)
            assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, hit, sorted(items))
    assert decontaminate.remove_contaminated(frame, benchmark).count() == sum(not brute_hits(t, windows)[1] for _, t in docs)
    cleaned = decontaminate.remove_contaminated(frame, benchmark, spans=True).collect()
    assert len(cleaned) == len(docs) and {r.text for r in cleaned if r.doc_id == 102} == {"ünd "}
    assert decontaminate.remove_contaminated(frame, benchmark.limit(0)).count() == len(docs)
    assert decontaminate.remove_contaminated(frame.limit(0), benchmark).count() == 0


# -- mixing

def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    t = rng.integers(0, 400, 500)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    targets = np.array([0.5, 0.3, 0.2])
    gradients = mixing.fit_rates(members, targets)
    x = mixing.rates(p, gradients)
    assert x.min() >= 0 and np.allclose((t * x) @ p / t.sum(), targets, atol=2e-3)
    direct = np.ones(500)  # the same minimum by many small plain steps
    weight = np.linalg.inv((p * t[:, None]).T @ p / t.sum() + 1e-6 * np.eye(3))
    for _ in range(3000):
        residual = (t * direct) @ p / t.sum() - targets
        direct = np.maximum(0, direct - 0.3 * (p @ (weight @ residual) + mixing.CLOSENESS * (direct - 1)))
    assert np.abs(direct - x).max() < 0.05
    assert mixing.fit_rates(members.limit(0), targets) == []


def test_mixing_odd_rows(spark, documents):
    rows = [(i, f"good words number {i} " * 5 if i % 2 else f"BAD!! {i}!! " * 7) for i in range(80)] + [(None, "x"), (900, None), (901, ""), (3, "again")]
    labels = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(60)] + [(None, "good"), (7, None), (8, "other")], "doc_id long, domain string")
    out = mixing.mix(documents(rows), labels, {"good": 0.5, "bad": 0.5}).collect()
    assert len(out) == len(rows) and all(r.copies >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in out)
    assert {r.copies - int(r.rate) for r in out} <= {0, 1}
    mixed = mixing.mixed_documents(documents(rows), labels, {"good": 0.5, "bad": 0.5})
    assert mixed.count() == sum(r.copies for r in out) and mixed.columns == documents(rows).columns
    assert mixing.mix(documents(rows), labels.limit(0), {"good": 0.5, "bad": 0.5}).count() == len(rows)
    assert mixing.mix(documents([]), labels, {"good": 0.5, "bad": 0.5}).count() == 0


def test_mixing_learns_one_text_of_an_id(spark, documents, monkeypatch):
    rows = [(i, f"good words number {i} " * 5 if i % 2 else f"BAD!! {i}!! " * 7) for i in range(40)] + [(7, f"copy {k % 20}") for k in range(200)]
    labels = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(40)], "doc_id long, domain string")
    seen, made = [], mixing.Classifier
    monkeypatch.setattr(mixing, "Classifier", lambda domains, x=None, y=None: seen.append(sorted(map(bytes, x))) or made(domains, x, y))
    for order in (rows, rows[::-1]):
        mixing.train(documents(order), labels, ["bad", "good"], "doc_id", "text")
    assert len(seen[0]) == 40 and seen[0] == seen[1]


def test_mixing_learns_from_all_labelled_rows(spark, documents):
    rng = random.Random(23)
    words = ["plain word here and there".split(), "BAD junk!! 12 $$ noise".split()]
    rows = [(i, " ".join(rng.choices(words[rng.random() < (0.2 if i % 2 else 0.7)], k=6))) for i in range(9000)]
    labels = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i, _ in rows], "doc_id long, domain string")
    model = mixing.train(documents(rows), labels, ["bad", "good"], "doc_id", "text")
    x, y = mixing.features(pa.array([t for _, t in rows])), np.array([i % 2 for i, _ in rows])
    assert np.allclose(model.mean, x.mean(0, dtype=float), atol=1e-9) and np.allclose(model.scale, np.maximum(x.std(0, dtype=float), 1e-4), atol=1e-6)
    z, p = model._rows(x), model.posteriors(x)
    slope = z.T @ (p - np.eye(2)[y]) / len(y) + mixing.PENALTY * model.weights  # 0 where the loss over all rows is least
    assert np.abs(slope).max() < 1e-4


def test_mixing_splits_a_text_once(monkeypatch):
    rng = random.Random(29)
    texts = [prose(rng, 30, 12), "a A a b", prose(rng, 30, 12), "", None, " ", "b", "b c"]
    column = pa.array(["cut", *texts]).slice(1)
    made, hashes = [], mixing.Words._hashes
    monkeypatch.setattr(mixing.Words, "_hashes", lambda self: made.append(1) or hashes(self))
    counted = mixing._counted_features(column)
    assert len(made) == 1
    split = [re.findall(SHINGLE, (t or "").translate(LOWER)) for t in texts]
    assert counted.field("n_tokens").to_pylist() == [len(w) for w in split]
    x = mixing._unpacked(counted.field("x"))
    assert np.array_equal(x, mixing.features(column)) and np.array_equal(mixing._unpacked(counted.field("x").slice(2, 3)), x[2:5])
    assert np.allclose(x[:, 4], [len(set(w)) / max(len(w), 1) for w in split])  # share of distinct words
    assert mixing._unpacked(mixing._packed(x[:0])).size == 0


def test_mixing_learns_three_domains(spark, documents):
    rng = random.Random(31)
    words = ["plain word here and there".split(), "BAD junk!! 12 $$ noise".split(), "word noise 7 (other) there".split()]
    rows = [(i, " ".join(rng.choices(words[i % 3 if rng.random() < 0.7 else rng.randrange(3)], k=6))) for i in range(2500)]
    labels = spark.createDataFrame([(i, "abc"[i % 3]) for i, _ in rows], "doc_id long, domain string")
    model = mixing.train(documents(rows), labels, ["a", "b", "c"], "doc_id", "text")
    x, y = mixing.features(pa.array([t for _, t in rows])), np.array([i % 3 for i, _ in rows])
    slope = model._rows(x).T @ (model.posteriors(x) - np.eye(3)[y]) / len(y) + mixing.PENALTY * model.weights
    assert np.abs(slope).max() < 1e-4


def test_sums_of_the_fit_over_more_partitions_than_sums(spark):
    examples = mixing.Examples(spark.createDataFrame([(i % 2, bytearray(np.full(3, i, np.float32).tobytes())) for i in range(10)], "y int, x binary"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        total, = examples.summed(lambda x, y: (x.sum(0)[None],), [(1, 3)])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert total.tolist() == [[45.0] * 3]


# -- near-duplicates

def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(SHINGLE, (t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= 75 * (len(sets[a]) + len(sets[b]) - common_):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(sets[a]), least.get(root(a))) for a, (i, _) in enumerate(rows)), key=repr)


def test_near_duplicates_against_brute_force(documents):
    rng = random.Random(9)
    common_part = prose(rng, 50)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([30, 60, 200])).split()
        for c in range(rng.choice([1, 2, 5, 90 if g == 3 else 3])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000 + k, prose(rng, 60) + " " + common_part) for k in range(80)]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5004, "one two three"), (5005, "y " * 50_000), (None, "one two"),
             (5006, rows[0][1].upper()), (5006, rows[0][1].upper())]
    found = lsh_forest.near_duplicates(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = lsh_forest.one_of_each(documents(rows))
    classes = {c for i, n, c in brute_components(rows) if n}
    assert kept.count() == len(classes) + 2 and kept.columns == documents(rows).columns
    assert lsh_forest.near_duplicates(documents([])).count() == 0
    assert lsh_forest.near_duplicates(documents([(1, None), (None, None)])).filter("kept").count() == 2


def test_near_duplicates_of_one_template(documents):
    rng = random.Random(31)
    template, rows = prose(rng, 100, 10 ** 6), []
    for g in range(300):  # 600 documents at 0.73 of each other, but two and two at 0.78
        start = prose(rng, 4, 10 ** 9)
        rows += [(len(rows) + c, f"{template} {start} {prose(rng, 14, 10 ** 9)}") for c in range(2)]
    found = lsh_forest.near_duplicates(documents(rows)).collect()
    wanted = brute_components(rows)
    assert [c for _, _, c in sorted(wanted)] == [i // 2 * 2 for i in range(600)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == wanted


def test_blocks_of_a_crowded_region(spark):
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(40), rng.choice([4, 30, 32, 34]))) for _ in range(200)]
    few, many, nodes = lsh_forest.COLUMNS, lsh_forest.BLOCK_NODES, range(200)
    try:
        lsh_forest.COLUMNS, lsh_forest.BLOCK_NODES = 7, 30
        got = lsh_forest.crowded_links(spark.createDataFrame([(1, i) for i in nodes], "key long, node long"),
                                       spark.createDataFrame([(i, 0) for i in range(0, 200, 3)], "node long, label long"),
                                       spark.createDataFrame([(i, sets[i]) for i in nodes], "node long, shingles array<long>"), 75).collect()
    finally:
        lsh_forest.COLUMNS, lsh_forest.BLOCK_NODES = few, many
    linked = {(a, b) for b in nodes for a in range(b) if 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})}
    assert {(r.x, r.y) for r in got} <= linked

    def labels(pairs):
        name = [0 if i % 3 == 0 else i for i in nodes]
        for a, b in pairs:
            old, new = max(name[a], name[b]), min(name[a], name[b])
            name = [new if n == old else n for n in name]
        return name
    assert labels((r.x, r.y) for r in got) == labels(sorted(linked))


@pytest.mark.parametrize("in_task", [500_000, 12])
def test_components_of_any_shape(spark, in_task, monkeypatch):
    monkeypatch.setattr(lsh_forest, "LINKS_PER_TASK", in_task)
    import networks_of_links as shapes
    rng = random.Random(8)
    for name, links in shapes.all_of(rng).items():
        frame = spark.createDataFrame(links, "x long, y long")
        half = len(links) // 2
        first = lsh_forest.components(frame.limit(0) if not half else spark.createDataFrame(links[:half], "x long, y long"))
        rest = spark.createDataFrame(links[half:], "x long, y long")
        for labels in (lsh_forest.components(frame), lsh_forest.joined_up(first, rest)):
            found = dict(map(tuple, labels.collect()))
            assert len(found) == labels.count()
            wanted = shapes.joined(links)
            assert found.keys() == wanted.keys(), name
            classes = {}
            for node, label in found.items():
                classes.setdefault(label, set()).add(wanted[node])
                assert found[label] == label
            assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(wanted.values())), name


def test_large_groups_get_few_links(spark, documents, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.003 else f"x{rng.randrange(10**9)}" for w in base)) for i in range(1200)]
    made, verify = [], lsh_forest._links

    def counted(pairs, sets, percent):
        out = common.stored(verify(pairs, sets, percent), "counted")
        made.append(out.count())
        return out
    monkeypatch.setattr(lsh_forest, "_links", counted)
    found = lsh_forest.near_duplicates(documents(rows)).collect()
    distinct = len({t for _, t in rows})
    assert {r.component_id for r in found if r.n_shingles > 100} == {0}
    assert sum(made) <= 4 * distinct, (made, distinct)


def test_nodes_meet_their_signature_once(spark, documents):
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.002 else f"x{rng.randrange(10**9)}" for w in base)) for i in range(300)]
    sketch = F.arrow_udf(lsh_forest._sketches, "struct<n:bigint,node:bigint,signature:array<int>>")("text")
    nodes = common.stored(documents(rows).select(sketch.alias("s")).select("s.*").dropDuplicates(["node"]), "nodes")
    found, crowded = lsh_forest.regions(nodes)
    places = found.groupBy("node", "tree").count().collect()
    assert len(places) > 20 * nodes.count() / 2 and all(r["count"] == 1 for r in places) and not crowded.isEmpty()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # signatures travel along


# -- URLs

def test_url_rules(spark):
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/en/x", "block"), ("org/fr/", "allow"), (None, "block"),
                                   ("noslash", "block"), ("same.com/q", "allow"), ("same.com/q", "block")], "rule string, verdict string")
    cases = [("http://a.example.net/en/xy", "a.example.net", "/en/xy", "a.example.net/en/x", "block"), ("http://B.EXAMPLE.net/en/?x=/y", "b.example.net", "/en/", "example.net/en/", "allow"),
             ("https://example.net/EN/", "example.net", "/EN/", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"), ("http://subnet/", "subnet", "/", None, "allow"),
             ("ftp://org/fr/1#f", "org", "/fr/1", "org/fr/", "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("mailto:a@b.net/", "", "", None, "allow"),
             ("http://same.com/q", "same.com", "/q", "same.com/q", "block"), ("x://y://z.net/", "y:", "//z.net/", None, "allow"),
             ("http://" + "s." * 300 + "net/" + "p" * 5000, "s." * 300 + "net", "/" + "p" * 5000, "net/", "block")]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)] + [(0, cases[0][0], "clash")], "page_id long, url string, host string")
    rows = url_rules.judge_urls(pages, rules).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == cases[r.page_id]
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# -- vectors

def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 6000)]
    x[1000:3000] = x[1000]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(7001, None), (7002, []), (7003, [0.0] * 16), (7004, [float("nan")] + [1.0] * 15), (7005, [None] + [1.0] * 15), (None, [1.0] * 16), (5, rows[5][1]), (7050, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")
    found = hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(range(0, 6000, 50))
    hits = 0
    for q, own in by_query.items():
        own.sort(key=lambda r: r["rank"])
        s = unit @ unit[q]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 and r.vec_id != q for r in own)
        s[q] = -9
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(6000), -np.round(s, 12)))[:5].tolist()))
    assert hits / (5 * len(by_query)) >= 0.9
    assert [r.vec_id for r in sorted(by_query[1000], key=lambda r: r["rank"])] == [1001, 1002, 1003, 1004, 1005]
    few = vectors.where("vec_id < 3")
    assert hnsw.nearest(few, few).count() == 6 and hnsw.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [64, 4096])
def test_queries_meet_graphs_in_blocks_of_bounded_size(spark, monkeypatch, shard):
    # A join of graphs with a copy of every query per graph would be planned by the size of the queries alone, and all copies broadcast.
    for name, value in (("SHARD_VECTORS", shard), ("BLOCK_VALUES", 512), ("BLOCK_QUERIES", 8)):
        monkeypatch.setattr(hnsw, name, value, raising=False)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 if i % 10 == 7 else 6).tolist()) for i in range(400)] + [(5, rng.normal(size=6).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert hnsw.nearest(vectors, vectors.where("vec_id % 2 = 1"))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    sent, by_length = [], hnsw._by_length
    monkeypatch.setattr(hnsw, "_by_length", lambda block: sent.append(by_length(block)) or sent[-1])
    found = {}
    for r in hnsw.nearest(vectors, vectors.where("vec_id % 2 = 1")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert len(sent) > 1 and all(0 < sum(v.size for _, v in block.values()) <= 2 * 512 for block in sent)
    assert sorted(i for block in sent for ids, _ in block.values() for i in ids) == sorted(i for i, _ in rows if i % 2)
    cosine = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    for q in {i for i, _ in rows if i % 2}:
        scored = [(-cosine(a, b), j) for i, a in rows if i == q for j, b in rows if j != q and len(a) == len(b)]
        assert found[q] == [(j, round(-s, 9)) for s, j in sorted(scored)[:5]]


# -- quality

def test_isotonic():
    w, p = np.array([1.0, 2, 1, 4]), np.array([1.0, 0, 1, 4])
    assert quality.isotonic(w, p).tolist() == [pytest.approx(1 / 3)] * 2 + [1, 1]


def test_quality_scores(spark, documents):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60).capitalize() + "." if i % 2 else "| ".join(prose(rng, 20).upper().split())) for i in range(400)]
    rows += [(None, "some text"), (901, None), (902, ""), (903, "z" * 300_000), (3, rows[3][1])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (7, None), (10 ** 6, 1)], "doc_id long, quality int")
    out = quality.quality_scores(documents(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.95
    assert {r.score for r in quality.quality_scores(documents(rows), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(documents([]), labels).count() == 0


# -- secrets

def test_secrets(spark, documents):
    rng = random.Random(2)
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    digest = hashlib.sha1(b"x").hexdigest()
    cases = [(f"é Password = 'hunter22' x", "assign:2:22", ""), ("token: abc", "", ""), ("secret=token:abcdefgh", "", ""), (f"x AKIA{'A1' * 8} y", "access:2:22", "random:2:22"),
             (f"k {token} z", "", f"random:2:42"), (f"sha {digest}", "hex:4:44", ""), ("123e4567-e89b-12d3-a456-426614174000", "", ""),
             ("customer_identifier_2024-release-notes", "", ""), ("thisisaverylongwordwithoutdigits", "", ""), (None, "", ""), ("", "", ""),
             (f'API_KEY="{token}"', "assign:0:49", "random:9:49"), ("paſſword=hunter22", "", "")]
    rows = documents([(i, c[0]) for i, c in enumerate(cases)] + [(0, cases[0][0])])
    out = rows.select("doc_id", "text", secrets.secrets(spark, F.col("text")).alias("f")).select("doc_id", "text", "f.*").collect()
    for r in out:
        _, base, more = cases[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(x for x in (base, more) if x)
        assert r.n_assign + r.n_access + r.n_hex == (base != "")
    assert secrets.redact(cases[11][0], "assign:0:49,random:9:49") == '[SECRET]"'
    brute = [m.span() for m in re.finditer(r"[0-9a-f]+", digest + "g" + digest[:24] + "gabc") if m.end() - m.start() >= 24]
    assert brute == [m.span() for m in secrets.HEX.finditer(digest + "g" + digest[:24] + "gabc")]


def test_secrets_of_letters_and_behind_paths(spark, documents):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    path = "downloads/releases/production/customer-documentation/"
    keys = ["".join(rng.choices(alphabet, k=24)) for alphabet in (letters, letters[:26], letters + "0123456789") for _ in range(20)]
    with_slash = ["".join(rng.choices(letters + "0123456789", k=14)) + "/" + "".join(rng.choices(letters + "0123456789", k=14)) for _ in range(10)]
    digest, uuid = hashlib.sha256(b"x").hexdigest().upper(), "123e4567-e89b-12d3-a456-426614174000"
    clean = ["getElementsByTagNameAndAttributeValue", "customer_identifier_release_notes", "tmp_buf_ptr_idx_cnt_str", path + "index", digest, uuid,
             "HAVE_CONFIG_H_INCLUDED_X", "-" * 30, "2024-01-01/2024-12-31/00", path + "release-2024-notes"]
    texts = [f"k {k} z" for k in keys] + [f"k {path}{k} z" for k in keys + with_slash] + [f"k {path}{keys[-1]}/documentation z"] + clean
    out = documents(list(enumerate(texts))).select("doc_id", secrets.secrets(spark, F.col("text")).alias("f")).select("doc_id", "f.spans").collect()
    for r in out:
        text = texts[r.doc_id]
        if text in clean:
            assert r.spans == "", text
            continue
        key = next(k for k in keys + with_slash if k in text)
        [(kind, a, z)] = [s.split(":") for s in r.spans.split(",")]
        assert kind == "random" and int(a) <= text.index(key) and int(z) >= text.index(key) + len(key), text


def test_secret_patterns_take_linear_time():
    import time
    enc = secrets.encoding(secrets.load_vocabulary(secrets.DEFAULT_VOCABULARY))
    for text in ("see " + "data/" * 10_000 + "v1b2 end", "ab_" * 10_000 + "a1b2", "Ab-" * 10_000 + "!", "9f" * 10_000 + "g"):
        began = time.process_time()
        secrets.base_spans(text), secrets.random_spans(text, enc, secrets.MOST_CHARS_PER_TOKEN)
        assert time.process_time() - began < 2


# -- languages

def test_probabilities_sum_to_one(spark, documents):
    rows = [(i, ("the cat sat on that mat " if i % 2 else "der hund und die katze ") * 3) for i in range(40)]
    frame = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = language.fit(frame, "text", "lang")
    letters = np.array([ord(c) for c in sorted({c for _, t in rows for c in t}) + ["q"]], np.uint64)  # every letter, and one for all others
    assert model.alphabet == len(letters) - 1
    context = (np.uint64(ord("t")) << np.uint64(32)) | (np.uint64(ord("h")) << np.uint64(16)) | np.uint64(ord("e"))
    sums = np.exp(model.log_probabilities((context << np.uint64(16)) | letters)).sum(0)
    assert sums == pytest.approx([1, 1], abs=1e-5)


def test_languages(documents):
    rng = random.Random(6)
    words = {"en": "the cat sat on a mat and then went home with that dog".split(), "de": "der hund und die katze gehen nach hause mit einem ball".split()}
    rows = [(i, " ".join(rng.choices(words["en" if i % 2 else "de"], k=rng.choice([3, 20, 60])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "123 !!"), (903, "Der HUND " * 100_000), (None, "the cat"), (3, rows[3][1])]
    frame = documents(rows).withColumn("lang", F.when(F.col("doc_id") > 800, F.lit(None)).when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    frame = frame.withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in language.languages(frame).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") for i in range(300)) and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and out[902].score == 0 and out[902].rejected
    assert sum(out[i].rejected for i in range(300)) == 0
    foreign = language.languages(frame.unionByName(frame.limit(1).withColumn("doc_id", F.lit(950)).withColumn("text", F.lit("żółć gęślą jaźń " * 30)).withColumn("lang", F.lit(None))))
    assert foreign.where("doc_id = 950").first().rejected
    assert {r.lang_pred for r in language.languages(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(frame.limit(0)).count() == 0


def test_language_thresholds_come_from_all_texts(spark, documents):
    rng = random.Random(17)
    words = {"en": "the cat sat on a mat and then went home with that dog".split(), "de": "der hund und die katze gehen nach hause mit einem ball".split()}
    rows = [(i, " ".join(rng.choices(words["en" if i % 2 else "de"], k=rng.choice([1, 2, 4])))) for i in range(16_000)] + [(16_000, "12"), (16_002, None)]
    rows += [(20_000 + i, "qqq qq") for i in range(30)]  # few and far out, in German
    frame = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = language.fit(frame, "text", "lang")
    entropy, size, letters = model.cross_entropies([t or "" for _, t in rows])
    some = letters > 0
    entropy, size, truth = entropy[some], size[some], np.array([model.langs.index("en" if i % 2 else "de") for i, _ in rows])[some]
    own = entropy[np.arange(len(truth)), truth]
    assert model.center == pytest.approx([np.median(own[truth == k]) for k in range(2)], abs=1e-8)
    assert model.border == pytest.approx(2 * max(np.quantile(model.farness(entropy, truth, size), 0.999), 0.5), abs=1e-7)
    z = -entropy * np.sqrt(size)[:, None]
    fits = [np.mean(z[np.arange(len(truth)), truth] * t - np.logaddexp.reduce(z * t, axis=1)) for t in language.TEMPERATURES]
    assert max(fits) - fits[list(language.TEMPERATURES).index(model.temperature)] < 1e-8


# -- pipeline

def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, common.stored(stage(spark, kept, SMALL), name)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {r.doc_id for r in before.collect()}
        if name == "near_dedup":
            components = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(before).collect()}
            assert {r.doc_id for r in kept.collect()} == {i for i, c in components.items() if i == c}
        if name == "decontamination":
            found = before.select("doc_id", decontaminate.contamination(F.col("text"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).alias("f"))
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.where("f.n_hit = 0").collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len(rows) > 100 and all(texts[r.doc_id] == r.text for r in rows)
    sizes = np.bincount([r.shard for r in rows], minlength=40)
    assert sizes.max() - sizes.min() <= 1
