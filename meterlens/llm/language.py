"""Operator 10: language of a text by character models.

Per language, an interpolated Kneser-Ney model of characters (order 4) over letters
and single spaces.  Counts of all training texts are summed in Spark; the finished
model is a set of arrays sorted by hash, bounded by the number of hash slots, which
executors search for the distinct n-grams of each batch.  The language of the lowest
cross-entropy per character wins; texts unlike any training text are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, remainder, stored
from meterlens.llm.words import mixed

ORDER = 4
#: Hash slots per order, which bounds the model: 2^22 slots of 8 + 4 x languages bytes, and the same for contexts.
SLOT_BITS = 22
#: Characters handled at a time; a longer text is read in pieces of this size.
PIECE = 1 << 20
#: Temperatures tried.  Entropies are counted in units of 1 / UNITS nats, in steps of so many units one after the other.
TEMPERATURES, UNITS, STEPS = np.geomspace(0.05, 20, 40), 1_000_000_000, (1_000_000, 1_000, 1)
#: A text is rejected when it lies this many times farther out than 99.9 % of the training texts.
REJECT_AT = 2.0

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of lower-cased letters and single spaces, as 4 x 16 bits; per text where they begin, and its letters."""
    gap = " \0\0\0"
    joined = "\0\0\0" + gap.join(t.replace("\0", " ") for t in texts) + gap
    code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, border = _letter_table()[code], code == 0
    keep = letter | border
    keep[1:] |= letter[:-1]
    code, letter, border = code[keep], letter[keep], border[keep]
    code = np.where(letter, np.maximum(code & 0xFFFF, 1), 32).astype(np.uint64)
    key = code.copy()
    for back in (1, 2, 3):
        key[back:] |= code[:-back] << np.uint64(16 * back)
    ends = np.cumsum(border)  # three borders before each text
    text, first = ends // 3 - 1, np.searchsorted(ends, 3 * np.arange(1, len(texts) + 2))
    inside = ~border
    counts = np.bincount(text[inside], minlength=len(texts) + 1)[:len(texts)]
    n_letters = np.bincount(text[letter], minlength=len(texts) + 1)[:len(texts)]
    return key[inside], np.concatenate([[0], np.cumsum(counts)]), n_letters


def pieces(texts: list[str]):
    """Groups of (number of the text, part of it) with at most PIECE characters."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), PIECE):
            part = t[at:at + PIECE]
            if size + len(part) > PIECE and group:
                yield group
                group, size = [], 0
            group.append((i, part))
            size += len(part)
    if group:
        yield group


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, at = np.unique(np.concatenate(keys), return_inverse=True)
    return flat, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def count_grams(batches):
    """(lang, gram, n) of one task, each gram once."""
    found: dict[str, tuple[list, list]] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            keys, counts = found.setdefault(lang, ([], []))
            for group in pieces(list(texts)):
                k, n = np.unique(grams([t for _, t in group])[0], return_counts=True)
                keys.append(k)
                counts.append(n)
            if len(keys) > 16:
                found[lang] = tuple([x] for x in _merged(keys, counts))
    for lang, (keys, counts) in found.items():
        k, n = _merged(keys, counts)
        for at in range(0, len(k), 100_000):
            yield pd.DataFrame({"lang": lang, "gram": k[at:at + 100_000].view(np.int64), "n": n[at:at + 100_000]})


def slots(keys: np.ndarray, order: int, bits: int = SLOT_BITS) -> np.ndarray:
    return (mixed(keys + np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _to_slots(batches):
    for b in batches:
        for kind in ("gram", "context"):
            own = b[b["kind"] == kind]
            for order, rows in own.groupby("ord"):
                place = slots(rows["key"].to_numpy().view(np.uint64), int(order) + (100 if kind == "context" else 0))
                yield rows.assign(key=place)


@dataclass
class Model:
    langs: list[str]
    discount: np.ndarray          #: orders x languages
    grams: list[tuple]            #: per order: sorted slots, counts per language
    contexts: list[tuple]         #: per order: sorted slots, (sum, number of followers) per language
    alphabet: int
    temperature: float = 1.0
    center: np.ndarray | None = None
    border: float = np.inf

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logs, one row per 4-gram, one column per language."""
        p = np.full((len(keys), len(self.langs)), 1.0 / (self.alphabet + 1))
        for n in range(1, ORDER + 1):
            gram = keys & np.uint64((1 << 16 * n) - 1)
            count = _found(self.grams[n - 1], slots(gram, n))
            both = _found(self.contexts[n - 1], slots(gram >> np.uint64(16), n + 100))
            total, followers = np.split(both, 2, axis=1)
            d = self.discount[n - 1]
            mixture = (np.maximum(count - d, 0) + d * followers * p) / np.maximum(total, 1)
            p = np.where(total > 0, mixture, p)
        return np.log(np.maximum(p, 1e-12))

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character (text x language), characters, letters."""
        total = np.zeros((len(texts), len(self.langs)))
        size, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for group in pieces(texts):
            owner = np.array([i for i, _ in group])
            keys, first, own_letters = grams([t for _, t in group])
            flat, at = np.unique(keys, return_inverse=True)
            logs = self.log_probabilities(flat)
            text = np.repeat(owner, np.diff(first))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(text, logs[at, k], minlength=len(texts))
            np.add.at(size, owner, np.diff(first))
            np.add.at(letters, owner, own_letters)
        return -total / np.maximum(size, 1)[:, None], size, letters

    def farness(self, entropy: np.ndarray, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Nats per character above the usual for the language; short texts, whose mean is unsure, count less."""
        return (entropy[np.arange(len(best)), best] - self.center[best]) * np.sqrt(np.minimum(size, 200) / 200)

    def predict(self, texts: list[str]) -> pd.DataFrame:
        entropy, size, letters = self.cross_entropies(texts)
        best = entropy.argmin(1)
        z = -entropy * np.sqrt(np.maximum(size, 1))[:, None] * self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        none = letters == 0
        far = self.farness(entropy, best, size) > self.border
        return pd.DataFrame({"lang_pred": np.where(none, "und", np.array(self.langs, object)[best]),
                             "score": np.where(none, 0.0, 1 / z.sum(1)), "rejected": none | far,
                             "cross_entropy": entropy.min(1)})


def _found(table: tuple, place: np.ndarray) -> np.ndarray:
    keys, values = table
    at = np.minimum(np.searchsorted(keys, place), len(keys) - 1)
    return values[at] * (keys[at] == place)[:, None]


def fit(rows: DataFrame, text_col: str, lang_col: str) -> Model | None:
    """A model of every non-null language of ``rows``; None if there is none."""
    spark = prepared(rows.sparkSession)
    known = rows.where(F.col(lang_col).isNotNull()).select(
        F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    top = stored(known.mapInPandas(count_grams, "lang string, gram long, n long")
                 .groupBy("lang", F.col("gram").alias("key")).agg(F.sum("n").alias("n")), "grams")
    orders, level = [], top.withColumn("ord", F.lit(ORDER))
    for n in range(ORDER, 0, -1):
        orders.append(level.select("lang", "ord", "key", "n"))
        if n > 1:  # lower orders count what precedes, not how often
            shorter = F.col("key").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))
            level = (level.groupBy("lang", shorter.alias("_short")).agg(F.count("*").alias("n"))
                     .select("lang", F.col("_short").alias("key"), "n", F.lit(n - 1).alias("ord")))
    counts = orders[0]
    for more in orders[1:]:
        counts = counts.unionByName(more)
    counts = stored(counts, "counts")
    ones = counts.groupBy("ord", "lang").agg(
        F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"),
        F.count("*").alias("types")).collect()
    if not ones:
        return None
    langs = sorted({r.lang for r in ones})
    column = {name: i for i, name in enumerate(langs)}
    discount = np.full((ORDER, len(langs)), 0.5)
    for r in ones:
        discount[r.ord - 1, column[r.lang]] = min(max(r.one / max(r.one + 2 * r.two, 1), 0.1), 0.95)
    contexts = (counts.groupBy("ord", "lang", F.shiftrightunsigned("key", 16).alias("key"))
                .agg(F.sum("n").cast("double").alias("a"), F.count("*").cast("double").alias("b")))
    both = (counts.select(F.lit("gram").alias("kind"), "ord", "lang", "key", F.col("n").cast("double").alias("a"),
                          F.lit(0.0).alias("b"))
            .unionByName(contexts.select(F.lit("context").alias("kind"), "ord", "lang", "key", "a", "b")))
    schema = "kind string, ord int, lang string, key long, a double, b double"
    # Numbers only: the driver holds one row per slot and language, and no strings.
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    table = (both.mapInPandas(_to_slots, schema).groupBy("kind", "ord", "key", "lang")
             .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
             .select((F.col("kind") == "context").alias("context"), F.col("ord").cast("byte"), F.col("key").cast("int"),
                     number.cast("short").alias("lang"), F.col("a").cast("float"), F.col("b").cast("float")).toArrow())
    context, order, key, lang, a, b = (table.column(c).to_numpy() for c in ("context", "ord", "key", "lang", "a", "b"))
    made = {"gram": [], "context": []}
    for kind in made:
        for n in range(1, ORDER + 1):
            own = (context == (kind == "context")) & (order == n)
            keys, at = np.unique(key[own].astype(np.int64), return_inverse=True)
            values = np.zeros((len(keys), len(langs) * (1 + (kind == "context"))), np.float32)
            values[at, lang[own]] = a[own]
            if kind == "context":
                values[at, lang[own] + len(langs)] = b[own]
            made[kind].append((keys, values))
    del table, context, order, key, lang, a, b
    model = Model(langs, discount, made["gram"], made["context"], len(made["gram"][0][0]))
    return _calibrated(model, known, spark)


def _quantiles(rows: DataFrame, share: float) -> dict[int, float]:
    """Per ``group`` of ``rows`` (group int, v long) the quantile of all its values ``v``, as numpy interpolates it.

    Values are counted in ever finer steps, the finer ones only where the wanted ranks lie, so the driver gets bounded counts.
    """
    ranks: dict[int, list[int]] = {}
    inside: dict[int, list[tuple[int, int]]] = {}  # per group and wanted rank: the step it lies in, and how many values lie below that
    weight: dict[int, float] = {}
    for unit in STEPS:
        near = rows
        if inside:
            steps = sorted({(g, at) for g, both in inside.items() for at, _ in both})
            known = F.broadcast(rows.sparkSession.createDataFrame(steps, "group int, _step long"))
            near = rows.withColumn("_step", F.expr(f"v div {1000 * unit}")).join(known, ["group", "_step"])
        counted: dict[int, list[tuple[int, int]]] = {}
        for r in near.groupBy("group", F.expr(f"v div {unit}").alias("at")).agg(F.count("*").alias("n")).collect():
            counted.setdefault(r["group"], []).append((r["at"], r["n"]))
        for g, steps in counted.items():
            at, n = (np.array(x, np.int64) for x in zip(*sorted(steps)))
            if unit == STEPS[0]:
                spot = share * (n.sum() - 1)
                ranks[g], weight[g] = [int(np.floor(spot)), int(np.ceil(spot))], spot - np.floor(spot)
            found = []
            for i, rank in enumerate(ranks[g]):
                below = 0
                own = np.ones(len(at), bool)
                if g in inside:
                    step, below = inside[g][i]
                    own = np.trunc(at / 1000).astype(np.int64) == step
                ends = below + np.cumsum(n[own])
                k = int(np.searchsorted(ends, rank, "right"))
                found.append((int(at[own][k]), int(ends[k] - n[own][k])))
            inside[g] = found
    return {g: (low + (high - low) * weight[g]) / UNITS for g, ((low, _), (high, _)) in inside.items()}


def _calibrated(model: Model, known: DataFrame, spark) -> Model:
    """Fit the temperature by likelihood, and the rejection border, on all training texts with letters.

    Tasks add up the likelihood at every temperature tried; medians and the border come from counts of all values.
    """
    shared = spark.sparkContext.broadcast(model)
    number = {x: i for i, x in enumerate(model.langs)}

    def own_entropies(batches):
        total, texts = np.zeros(len(TEMPERATURES)), 0
        for b in batches:
            entropy, size, letters = shared.value.cross_entropies(list(b["text"]))
            some = letters > 0
            entropy, size, truth = entropy[some], size[some], b["lang"][some].map(number).to_numpy(np.int32)
            own = entropy[np.arange(len(truth)), truth]
            ahead = (own[:, None] - entropy) * np.sqrt(size)[:, None]
            for i, t in enumerate(TEMPERATURES):  # log of the softmax, shifted by its largest term
                most = (ahead * t).max(1, initial=0.0)
                total[i] -= (most + np.log(np.exp(ahead * t - most[:, None]).sum(1))).sum()
            texts += len(truth)
            yield pd.DataFrame({"group": truth, "size": size, "v": np.floor(own * UNITS).astype(np.int64), "fits": None})
        yield pd.DataFrame({"group": [None], "size": [texts], "v": [None], "fits": [total.tolist()]})

    all_of = stored(known.mapInPandas(own_entropies, "group int, size long, v long, fits array<double>"), "entropies")
    rows = all_of.where("fits IS NULL")
    fits = all_of.where("fits IS NOT NULL").agg(
        F.sum("size").alias("n"), *[F.sum(F.col("fits")[i]).alias(f"t{i}") for i in range(len(TEMPERATURES))]).first()
    model.center = np.full(len(model.langs), np.log(model.alphabet + 1))
    if not fits.n:
        return model
    for group, median in _quantiles(rows, 0.5).items():
        model.center[group] = median
    best = -np.inf
    for i, t in enumerate(TEMPERATURES):
        if fits[f"t{i}"] / fits.n > best + 1e-9:
            best, model.temperature = fits[f"t{i}"] / fits.n, float(t)
    center = F.array(*[F.lit(float(c)) for c in model.center])
    far = (F.col("v") / UNITS - center[F.col("group")]) * F.sqrt(F.least("size", F.lit(200)) / 200)  # as Model.farness
    border = _quantiles(rows.select(F.lit(0).alias("group"), F.floor(far * UNITS).alias("v")), 0.999)[0]
    model.border = REJECT_AT * max(border, 0.5)
    return model


def predict_language(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score``, ``rejected`` and ``cross_entropy`` (existing ones are replaced).

    Null texts and texts without a letter are ``und`` with score 0 and rejected; equal cross-entropies go to the first
    language by name.  Without a model everything is ``und``.  The column name ``_p`` is reserved.
    """
    new = ("lang_pred", "score", "rejected", "cross_entropy")
    kept = [c for c in df.columns if c not in new]
    if model is None:
        return df.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"),
                         F.lit(None).cast("double").alias("cross_entropy"))
    shared = prepared(df.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean, cross_entropy double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return shared.value.predict(text.fillna("").tolist())

    return df.select(*kept, predict(text_col).alias("_p")).select(*kept, *[f"_p.{c}" for c in new])


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              folds: int = 3, held_fold: int = 1) -> DataFrame:
    """``df`` with the predictions of a model learned from the rows outside ``held_fold``.

    A null id counts as empty text when folds are dealt; repeated rows are learned and predicted as often as they are there.
    """
    rest = remainder(F.col(id_col), folds)
    return predict_language(df, fit(df.where(rest != held_fold), text_col, lang_col), text_col)
