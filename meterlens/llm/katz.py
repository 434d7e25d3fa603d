"""Operator 7: Katz backoff bigram scores.

P(w | h) is the Good-Turing discounted relative frequency of a bigram seen in the
training documents, and alpha(h) * P(w) otherwise; P(w) is the discounted unigram with
one place for all unseen words, and alpha(h) makes the probabilities after h sum to 1.

Texts are counted where they are read; bigrams travel as packed arrays, dealt by their
second word, so that one task has all occurrences of a bigram and the count of its
word.  Logarithms of a text's score add up, and all that is not known there - alpha of
a history, and the discounts - is left open as a few counts per text and is filled in
after a second, smaller exchange dealt by history and by text.  Very frequent words
are dealt by both words, and their counts are told to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, remainder, stored
from meterlens.llm.words import SPACED, Words, mixed

#: Counts up to this are discounted as Good and Turing say; larger ones keep KEPT of their mass.
MOST, KEPT = 5, 0.999
#: Words are told apart by 48 bits of their hash.  The end of a text is a word, its start a history.
END, START = 1, 2
#: Tokens of one packed block, tokens one task should gather and take at a time, texts of one group at the end.
BLOCK, GATHERED, PART, TEXTS = 600_000, 3_000_000, 250_000, 20_000
#: A word with this share of a task's tokens may be frequent; there are at most as many frequent words as LEAST says.
LOCAL_SHARE, LEAST = 1 / 20_000, 1 / 10_000

#: Open counts of a text: two sums of logs (of the base; of bigrams and words over MOST, less those of histories), tokens,
#: known tokens, seen bigrams by count 1..MOST and above, words of unseen bigrams by count 0..MOST and above.
COLUMNS = 4 + (MOST + 1) + (MOST + 2)
PACKED = "kind string, bucket int, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary"
PACKED_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in "abcdefgh"]])
CORRECTIONS_ARROW = pa.schema([("key", pa.int64()), ("more", pa.float64())])


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack48(array: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(array.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :6])


def unpack48(data: bytes) -> np.ndarray:
    short = unpack(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = short
    return out.view(np.uint64).ravel()


def packed_rows(rows: pd.DataFrame, columns: str):
    """The packed arrays of some columns, row by row."""
    return zip(*[rows[c] for c in columns])


def in_arrow(run, schema: pa.Schema):
    """``run`` over a group that stays where Arrow holds it: cells are buffers, not copies of them."""
    def of_table(table: pa.Table) -> pa.Table:
        cells = {c: [v.as_buffer() for v in table[c]] for c in "abcdefgh"}
        out = run(pd.DataFrame({"kind": table["kind"].to_pylist(), **cells}, dtype=object))
        out = pa.Table.from_pandas(out, schema, preserve_index=False)
        pa.default_memory_pool().release_unused()
        return out
    return of_table


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one end per text, the word before each (or the start), and the text each is in."""
    words = Words(text, SPACED)
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(len(counts)), counts + 1)
    w = np.full(len(owner), END, np.uint64)
    is_word = np.ones(len(owner), bool)
    ends = np.cumsum(counts + 1) - 1
    is_word[ends] = False
    w[is_word] = np.maximum(words.hash >> np.uint64(16), np.uint64(3))
    h = np.full(len(owner), START, np.uint64)
    h[1:] = w[:-1]
    h[1:][~is_word[:-1]] = START
    return w, h, owner


def _texts(batch: pd.DataFrame) -> pa.Array:
    return pa.array(batch["text"].tolist(), pa.string())


def _merged(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)


def _frequent(batches):
    """Words that may be frequent, with their counts in this task; and, as word 0, its tokens."""
    found, size = [], 0
    for batch in batches:
        w = tokens(_texts(batch))[0]
        size += len(w)
        found.append(np.unique(w, return_counts=True))
        if len(found) > 16:
            found = [_merged(found)]
    if found:
        words, counts = _merged(found)
        some = counts >= LOCAL_SHARE * size
        yield pd.DataFrame({"w": np.append(words[some].astype(np.int64), 0), "n": np.append(counts[some], size)})


def _counted(frequent: np.ndarray):
    """Training occurrences of the frequent words in this task."""
    def run(batches):
        total = np.zeros(len(frequent), np.int64)
        for batch in batches:
            own = batch[batch["train"]]
            w = tokens(_texts(own))[0]
            at = np.minimum(np.searchsorted(frequent, w), len(frequent) - 1)
            total += np.bincount(at[frequent[at] == w], minlength=len(frequent))
        yield pd.DataFrame({"w": frequent.astype(np.int64), "n": total})
    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _blocks(buckets: int, frequent: np.ndarray):
    """Occurrences of each block of texts as sorted arrays, one row per bucket."""
    def flush(parts: list, docs: np.ndarray, train: np.ndarray):
        w, h, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
        parts.clear()
        order = np.lexsort((h, w))  # stable: texts stay in order
        w, h, d = w[order], h[order], d[order]
        entry = _starts(w, h, d)
        count = np.diff(np.append(entry, len(w))).astype(np.uint32)
        w, h, d = w[entry], h[entry], d[entry]
        gram = _starts(w, h)
        sizes = np.diff(np.append(gram, len(w)))
        gw, gh = w[gram], h[gram]
        place = mixed(gw)
        hot = _is_in(frequent, gw)
        place[hot] = mixed(gw[hot] * np.uint64(3) + mixed(gh[hot]))
        place = (place % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        borders = np.searchsorted(place[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            own = order[borders[b]:borders[b + 1]]
            if not len(own):
                continue
            word = _starts(gw[own])
            total = int(sizes[own].sum())
            entries = np.repeat(gram[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(total)
            used, local = np.unique(d[entries], return_inverse=True)
            rows.append({"kind": "block", "bucket": b, "a": pack48(gw[own][word]),
                         "b": pack(np.diff(np.append(word, len(own))).astype(np.uint32)), "c": pack48(gh[own]),
                         "d": pack(sizes[own].astype(np.uint32)), "e": pack(local.astype(np.uint32)),
                         "f": pack(count[entries]), "g": pack(docs[used]), "h": pack(train[used])})
        yield pd.DataFrame(rows)

    def run(batches):
        parts, docs, train, size = [], [], [], 0
        for batch in batches:
            w, h, owner = tokens(_texts(batch))
            parts.append((w, h, (owner + sum(map(len, docs))).astype(np.uint32)))
            docs.append(batch["key"].to_numpy())
            train.append(batch["train"].to_numpy())
            size += len(w)
            if size >= BLOCK:
                yield from flush(parts, np.concatenate(docs), np.concatenate(train))
                parts, docs, train, size = [], [], [], 0
        if size:
            yield from flush(parts, np.concatenate(docs), np.concatenate(train))
    return run


def _part(rows: pd.DataFrame, part: int, parts: int) -> tuple[np.ndarray, ...]:
    """Word, word before, text and count of every occurrence whose word falls in this part, sorted by the words."""
    found, first = [], 0
    for a, b, c, d, e, f, h in packed_rows(rows, "abcdefh"):
        words, per_word, per_gram = unpack48(a), unpack(b, np.uint32), unpack(d, np.uint32)
        words = np.repeat(words, per_word)
        own = words % np.uint64(parts) == part
        entries = np.repeat(own, per_gram)
        found.append((np.repeat(words[own], per_gram[own]), np.repeat(unpack48(c)[own], per_gram[own]),
                      (unpack(e, np.uint32)[entries] + np.uint32(first)).astype(np.int32),
                      unpack(f, np.uint32)[entries].astype(np.int32)))
        first += len(unpack(h, bool))
    w, h, d, c = (np.concatenate([f[k] for f in found]) for k in range(4))
    del found
    order = np.lexsort((h, w))
    w, h = w[order], h[order]
    return w, h, d[order], c[order]


def _summed(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of equal names added."""
    order = np.argsort(names, kind="stable")
    first = _starts(names[order])
    return names[order][first], np.add.reduceat(values[:, order], first, axis=1) if len(first) else values


def _history_rows(h: np.ndarray, r: np.ndarray, c1: np.ndarray, buckets: int, frequent: np.ndarray) -> list[tuple]:
    """Sums per history over bigrams seen in training: how many have each count, and whose words have each count."""
    order = np.argsort(h, kind="stable")
    h, r, c1 = h[order], r[order], c1[order]
    first = _starts(h)
    if not len(first):
        return []
    names, stats = h[first], np.empty((2 * MOST + 2, len(first)), np.int64)
    for at, x in ((0, r), (MOST, c1)):
        for k in range(1, MOST + 1):
            stats[at + k - 1] = np.add.reduceat((x == k).astype(np.int32), first)
        stats[2 * MOST + at // MOST] = np.add.reduceat(np.where(x > MOST, x, 0), first)
    shared = _is_in(frequent, names) | (names == START)
    place = (mixed(names) % np.uint64(buckets)).astype(np.int64)
    out = []
    for b in range(buckets):
        own = shared | (place == b)
        if own.any():
            kind = np.uint32 if stats[:, own].max() < 2 ** 32 else np.uint64
            out.append(("history", b, pack48(names[own]), pack(stats[:, own].astype(kind)), str(kind().nbytes).encode(), b""))
    return out


def _gather(buckets: int, groups: int, frequent: np.ndarray, frequent_counts: np.ndarray):
    """What one bucket knows: open counts per text, sums per history, unseen bigrams, and counts of counts.

    Words are taken in parts of about PART occurrences, since all that is computed here is per word or adds up.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([unpack(x, np.int64) for x, in packed_rows(rows, "g")])
        train = np.concatenate([unpack(x, bool) for x, in packed_rows(rows, "h")])
        parts = -(-sum(len(unpack(x, np.uint32)) for x, in packed_rows(rows, "e")) // PART)
        logs, sizes = np.zeros((2, len(doc))), np.zeros((COLUMNS - 2, len(doc)), np.uint32)
        numbers = np.zeros(2 * MOST + 8, np.int64)
        out, unseen = [], []
        for part in range(parts):
            w, h, d, c = _part(rows, part, parts)
            if not len(w):
                continue
            learned = np.where(train[d], c, 0)
            gram, word = _starts(w, h), _starts(w)
            r_gram = np.add.reduceat(learned, gram, dtype=np.int64)
            c_word = np.add.reduceat(learned, word, dtype=np.int64)
            hot_at = np.minimum(np.searchsorted(frequent, w[word]), len(frequent) - 1)
            hot = frequent[hot_at] == w[word]
            c_word = np.where(hot, frequent_counts[hot_at], c_word)
            r = np.repeat(r_gram, np.diff(np.append(gram, len(w))))
            c1 = np.repeat(c_word, np.diff(np.append(word, len(w))))
            seen = r > 0

            def add(row: np.ndarray, values: np.ndarray, where=slice(None)) -> None:
                row += np.bincount(d[where], values[where], len(doc)).astype(row.dtype)
            log_c1 = np.log10(np.maximum(c1, 1))
            add(logs[0], c * np.log10(c1 + 0.5))
            add(logs[1], c * (np.where(seen, np.where(r > MOST, np.log10(np.maximum(r, 1)), 0), np.where(c1 > MOST, log_c1, 0))
                              - np.where(w == END, 0, log_c1)))
            add(sizes[0], c)
            add(sizes[1], c * (c1 > 0))
            for k in range(1, MOST + 2):
                add(sizes[1 + k], c, seen & (np.minimum(r, MOST + 1) == k))
            for k in range(MOST + 2):
                add(sizes[3 + MOST + k], c, ~seen & (np.minimum(c1, MOST + 1) == k))

            some = r_gram > 0
            big_r, big_c = r_gram[some], c1[gram][some]
            out += _history_rows(h[gram][some], big_r, big_c, buckets, frequent)
            u = np.flatnonzero(~seen)
            unseen.append((h[u], d[u], c[u]))
            plain = ~hot & (c_word > 0)
            numbers += np.concatenate([np.bincount(np.minimum(big_r, MOST + 2), minlength=MOST + 3),
                                       np.bincount(np.minimum(c_word[plain], MOST + 2), minlength=MOST + 3),
                                       [c_word[plain].sum(), plain.sum()]]).astype(np.int64)

        out.append(("counts", 0, pack(numbers), b"", b"", b""))
        place = (mixed(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        borders = np.searchsorted(place[order], np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(borders)):
            own = order[borders[g]:borders[g + 1]]
            out.append(("doc", int(g), pack(doc[own]), pack(logs[:, own]), pack(sizes[:2, own]), pack(sizes[2:, own])))
        del logs, sizes
        # Occurrences of bigrams not seen in training: alpha of their history is still open.
        # They are dealt bucket by bucket, so that only one bucket's are sorted and copied at a time.
        places = []
        for hu, du, _ in unseen:
            spread = _is_in(frequent, hu) | (hu == START)
            places.append((np.where(spread, mixed(doc[du].view(np.uint64)), mixed(hu)) % np.uint64(buckets)).astype(np.uint32))
        for b in range(buckets):
            hu, du, cu = (np.concatenate([x[k][p == b] for x, p in zip(unseen, places)] or [np.zeros(0, np.int64)]) for k in range(3))
            if not len(hu):
                continue
            du = doc[du]
            order = np.lexsort((du, hu))
            hu, du, cu = hu[order], du[order], cu[order]
            first = _starts(hu, du)
            hu, du, cu = hu[first], du[first], np.add.reduceat(cu, first)
            name = _starts(hu)
            out.append(("unseen", b, pack48(hu[name]), pack(np.diff(np.append(name, len(hu))).astype(np.uint32)),
                        pack(du), pack(cu.astype(np.uint32))))
        return pd.DataFrame([(*o, b"", b"", b"", b"") for o in out], columns=["kind", "bucket", *"abcdefgh"])
    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factors of counts 1..MOST from counts of counts n[1..MOST + 1], and KEPT for all above.

    Where the counts of counts give no factor between 0 and 1, half a count is taken off instead.
    """
    out = 1 - 0.5 / np.arange(1, MOST + 1)
    if n[1] > 0:
        rest = (MOST + 1) * n[MOST + 1] / n[1]
        for r in range(1, MOST + 1):
            if n[r] > 0 and rest < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
                if 0 < d < 1:
                    out[r - 1] = d
    return np.append(out, KEPT)


@dataclass
class Constants:
    """What the whole corpus says: training tokens, texts and words, and the discounts of both orders."""

    tokens: int
    texts: int
    words: int
    gram_discounts: np.ndarray
    word_discounts: np.ndarray
    unseen: float  #: probability of all unseen words together

    def alpha(self, stats: np.ndarray) -> np.ndarray:
        """Backoff weight and count of histories from their sums (see _gather), one column each."""
        r = np.arange(1, MOST + 1)[:, None]
        by_r, by_c, big_r, big_c = stats[:MOST], stats[MOST:2 * MOST], stats[2 * MOST], stats[2 * MOST + 1]
        count = (by_r * r).sum(0) + big_r
        kept = (by_r * r * self.gram_discounts[:MOST, None]).sum(0) + KEPT * big_r
        below = ((by_c * r * self.word_discounts[:MOST, None]).sum(0) + KEPT * big_c) / max(self.tokens, 1)
        return np.maximum(1 - kept / count, 1e-12) / np.maximum(1 - below, 1e-12), count


def constants(numbers: np.ndarray, frequent_counts: np.ndarray, texts: int) -> Constants:
    known = frequent_counts[frequent_counts > 0]
    n_gram, n_word = numbers[:MOST + 3], numbers[MOST + 3:2 * MOST + 6] + np.bincount(
        np.minimum(known, MOST + 2), minlength=MOST + 3)
    total, words = int(numbers[-2] + known.sum()), int(numbers[-1] + len(known))
    by_word = discounts(n_word)
    r = np.arange(1, MOST + 1)
    low = n_word[1:MOST + 1]
    kept = (low * r * by_word[:MOST]).sum() + KEPT * (total - (low * r).sum())
    return Constants(total, texts, words, discounts(n_gram), by_word, 1 - kept / total if total else 1.0)


def _alphas(k: Constants, known: pd.DataFrame, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Histories of this part, sorted, and log10 of alpha(h) c(h)."""
    names, stats = [np.zeros(0, np.uint64)], [np.zeros((2 * MOST + 2, 0), np.int64)]
    for a, b, c in packed_rows(known, "abc"):
        name = unpack48(a)
        own = name % np.uint64(parts) == part
        names.append(name[own])
        stats.append(unpack(b, np.uint32 if bytes(c) == b"4" else np.uint64).reshape(2 * MOST + 2, -1)[:, own])
    names, sums = _summed(np.concatenate(names), np.concatenate(stats, axis=1, dtype=np.int64, casting="unsafe"))
    if not len(names):
        return names, np.zeros(0)
    alpha, count = k.alpha(sums)
    return names, np.log10(alpha) + np.log10(count)


def _corrections(k: Constants):
    """Key of the text and log10 of alpha(h) c(h) for its bigrams not seen in training; histories are taken in parts.

    One row per text and history: Spark adds them up per text, first within a task.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known, unseen = (rows[rows["kind"] == kind] for kind in ("history", "unseen"))
        parts = max(1, -(-sum(len(unpack48(x)) for x, in packed_rows(rows, "a")) // PART))
        docs, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for part in range(parts):
            names, logs = _alphas(k, known, part, parts)
            if not len(names):
                continue
            for a, b, c, d in packed_rows(unseen, "abcd"):
                h = unpack48(a)
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                found = names[at] == h
                per_history = unpack(b, np.uint32)
                own = np.repeat(found, per_history)
                docs.append(unpack(c, np.int64)[own])
                sums.append(np.repeat(logs[at[found]], per_history[found]) * unpack(d, np.uint32)[own])
        return pd.DataFrame({"key": np.concatenate(docs), "more": np.concatenate(sums)})
    return run


def _totals(k: Constants):
    """Per text: tokens, known tokens, base score, and the score but for alpha."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([unpack(x, np.int64) for x in rows["a"]])
        logs = np.concatenate([unpack(x, np.float64).reshape(2, -1) for x in rows["b"]], axis=1)
        sizes = np.concatenate([unpack(x, np.uint32).reshape(2, -1) for x in rows["c"]], axis=1)
        counts = np.concatenate([unpack(x, np.uint32).reshape(2 * MOST + 3, -1) for x in rows["d"]], axis=1).astype(float)
        r = np.arange(1, MOST + 1)
        of_gram = np.append(np.log10(k.gram_discounts[:MOST] * r), np.log10(KEPT))
        size = np.log10(max(k.tokens, 1))
        of_word = np.concatenate([[np.log10(max(k.unseen, 1e-300))], np.log10(k.word_discounts[:MOST] * r) - size,
                                  [np.log10(KEPT) - size]])
        score = logs[1] + of_gram @ counts[:MOST + 1] + of_word @ counts[MOST + 1:]
        base = logs[0] - sizes[0] * np.log10(k.tokens + 0.5 * (k.words + 1))
        key, at = np.unique(doc, return_inverse=True)
        add = lambda x: np.bincount(at, x, len(key))
        return pd.DataFrame({"key": key, "n_tokens": add(sizes[0]).astype(np.int64), "n_known": add(sizes[1]).astype(np.int64),
                             "base": add(base), "part": add(score)})
    return run


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model is learned from rows whose id is not in ``held_fold`` (crc32 of the id as text, modulo ``folds``).
    Null texts are empty and have one token, the end.  Rows may repeat; each counts.  Without training rows every
    token is an unseen word of probability 1.  Scores of a text depend on sums in floating point only.
    """
    spark = prepared(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), folds) != held_fold).alias("train"), text.alias("text"))
    rows = rows.select("id", "train", F.xxhash64("id", "text").alias("key"), "text")
    texts = stored(rows.select("id", "train", "key"), "texts")
    n_texts, n_train = texts.agg(F.count("*"), F.coalesce(F.count_if("train"), F.lit(0))).first()

    found = rows.select("text").mapInPandas(_frequent, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = stored(found, "frequent")
    size = found.where("w = 0").first()
    size = size.n if size else 0
    buckets = max(4, -(-size // GATHERED))
    least = max(1 / (4 * buckets), LEAST) * size
    frequent = np.array(sorted({END, *[r.w for r in found.where((F.col("w") > 2) & (F.col("n") >= least)).collect()]}), np.uint64)
    counted = (rows.select("train", "text").mapInPandas(_counted(frequent), "w long, n long")
               .groupBy("w").agg(F.sum("n").alias("n")).collect())
    exact = {r.w: r.n for r in counted}
    counts = np.array([exact.get(int(w), 0) for w in frequent], np.int64)

    groups = max(1, -(-n_texts // TEXTS))
    blocks = rows.select("key", "train", "text").mapInPandas(_blocks(buckets, frequent), PACKED)
    gathered = in_arrow(_gather(buckets, groups, frequent, counts), PACKED_ARROW)
    open_sums = stored(blocks.groupBy("bucket").applyInArrow(gathered, PACKED), "open")
    numbers = np.zeros(2 * MOST + 8, np.int64)
    for r in open_sums.where("kind = 'counts'").select("a").toLocalIterator():
        numbers += unpack(r.a, np.int64)
    k = constants(numbers, counts, n_train)

    more = (open_sums.where("kind IN ('history', 'unseen')").groupBy("bucket")
            .applyInArrow(in_arrow(_corrections(k), CORRECTIONS_ARROW), "key long, more double")
            .groupBy("key").agg(F.sum("more").alias("more")))
    totals = (open_sums.where("kind = 'doc'").groupBy("bucket")
              .applyInPandas(_totals(k), "key long, n_tokens long, n_known long, base double, part double"))
    same = texts.groupBy("key").agg(F.count("*").alias("copies"))
    sums = (totals.join(more, "key", "left").join(same, "key")
            .select("key", *[(F.col(c) / F.col("copies")).alias(c) for c in ("n_tokens", "n_known", "base", "part", "more")]))
    start = -float(np.log10(max(n_train, 1)))
    return texts.join(sums, "key").select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), F.round("n_tokens").cast("long").alias("n_tokens"),
        F.round("n_known").cast("long").alias("n_known"), F.lit(k.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("part") + F.coalesce("more", F.lit(0.0)) + start).alias("score"))
