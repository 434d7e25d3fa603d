"""Katz scores against a direct evaluation of the definition, and their sums over the vocabulary."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_data import SMALL, documents  # noqa: F401
from meterlens.llm import katz


def words(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["</s>"]


class Direct:
    """The model by the book: dictionaries of counts, recursion per token."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>"] + w[:-1], w))
        self.n = sum(self.uni.values())
        self.d1, self.d2 = (self.discount(Counter(x.values())) for x in (self.uni, self.bi))
        self.unseen = 1 - sum(self.d1(c) * c for c in self.uni.values()) / self.n if self.n else 1.0
        self.history = Counter()
        self.after = {}
        for (h, w), c in self.bi.items():
            self.history[h] += c
            self.after.setdefault(h, []).append(w)

    @staticmethod
    def discount(n):
        out, k = {}, 5
        rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        for r in range(1, k + 1):
            out[r] = 1 - 0.5 / r
            if n[1] and n[r] and rest < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                out[r] = d if 0 < d < 1 else out[r]
        return lambda c: out.get(c, 0.999)

    def p1(self, w):
        return self.d1(self.uni[w]) * self.uni[w] / self.n if w in self.uni else self.unseen

    def p(self, w, h):
        if (h, w) in self.bi:
            c = self.bi[h, w]
            return self.d2(c) * c / self.history[h]
        if h not in self.history:
            return self.p1(w)
        kept = sum(self.d2(self.bi[h, x]) * self.bi[h, x] for x in self.after[h]) / self.history[h]
        return (1 - kept) / (1 - sum(self.p1(x) for x in self.after[h])) * self.p1(w)

    def score(self, text):
        w = words(text)
        return sum(math.log10(self.p(b, a)) for a, b in zip(["<s>"] + w[:-1], w))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for w in words(text))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def check(frame, rows):
    model = Direct([t for i, t in rows if not held(i)])
    found = sorted(katz.katz_scores(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    wanted = sorted(((i, held(i), len(words(t)), sum(w in model.uni for w in words(t)), model.n, model.base(t), model.score(t))
                     for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted):
        assert tuple(f)[:5] == w[:5]
        assert f.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert f.score == pytest.approx(w[6], rel=1e-9, abs=1e-9)
    return model


def random_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.9))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=int(rng.expovariate(0.03))))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, "W1 w1  \t W2"), (3, rows[3][1]), (3, rows[3][1]), (None, "w1 w2 w3"), (4, "other text")]


def test_scores_are_the_models(documents):
    rows = random_rows(1)
    check(documents(rows), rows)


def test_small_blocks_and_frequent_words(documents, monkeypatch):
    """Tasks run in this process' forked workers only if set there, so the helpers are driven directly."""
    import pandas as pd
    rows = random_rows(2)
    monkeypatch.setattr(katz, "BLOCK", 300)
    monkeypatch.setattr(katz, "PART", 200)
    frequent = np.array(sorted({katz.END, *np.unique(katz.tokens(__import__("pyarrow").array([t or "" for _, t in rows]))[0])[:40].tolist()}), np.uint64)
    key = np.arange(len(rows)) * 7919 + 3
    train = np.array([not held(i) for i, _ in rows])
    frame = pd.DataFrame({"key": key, "train": train, "text": [t or "" for _, t in rows]})
    counts = next(katz._counted(frequent)([frame]))["n"].to_numpy()
    batches = [frame.iloc[a:a + 9].reset_index(drop=True) for a in range(0, len(frame), 9)]
    blocks = pd.concat(list(katz._blocks(5, frequent)(batches)))
    assert len(blocks) > 10
    open_sums = pd.concat([katz._gather(5, 3, frequent, counts)(own) for _, own in blocks.groupby("bucket")])
    numbers = sum(katz.unpack(a, np.int64) for a in open_sums[open_sums["kind"] == "counts"]["a"])
    k = katz.constants(numbers, counts, int(train.sum()))
    model = Direct([t for (_, t), own in zip(rows, train) if own])
    assert (k.tokens, k.words) == (model.n, len(model.uni))
    more = pd.concat([katz._corrections(k)(own) for _, own in
                      open_sums[open_sums["kind"].isin(["history", "unseen"])].groupby("bucket")]).groupby("key")["more"].sum()
    for _, own in open_sums[open_sums["kind"] == "doc"].groupby("bucket"):
        for r in katz._totals(k)(own).itertuples():
            i = int(np.flatnonzero(key == r.key)[0])
            score = r.part + more.get(r.key, 0.0) - math.log10(k.texts)
            assert score == pytest.approx(model.score(rows[i][1]), rel=1e-9)
            assert r.base == pytest.approx(model.base(rows[i][1]), rel=1e-9)


def test_probabilities_sum_to_one():
    model = Direct([t for _, t in random_rows(3)])
    for h in ["<s>", *list(model.history)[:20]]:
        assert sum(model.p(w, h) for w in model.uni) + model.p("never seen", h) == pytest.approx(1)


def test_nothing_to_learn_from(documents):
    held_ids = [i for i in range(40) if held(i)]
    rows = [(i, "a b c") for i in held_ids]
    assert {tuple(r)[1:] for r in katz.katz_scores(documents(rows)).collect()} == {(True, 4, 0, 0, 4 * math.log10(0.5 / 0.5), 0.0)}
    assert katz.katz_scores(documents([])).count() == 0


def test_real_documents(spark):
    from meterlens.llm.queries import QUERIES
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    check(frame, rows)
    found = QUERIES["op7_katz_backoff"](spark, SMALL).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert found["sum(score)"] > found["sum(base_score)"]
