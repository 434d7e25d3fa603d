"""Operator 2: benchmark decontamination by word windows.

A benchmark item's windows are its runs of ``size`` words (a shorter, non-empty item
is one window).  Their hashes are broadcast, the windows of every whole document are
looked up, a hash hit is confirmed word by word, and spans or documents are removed.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import ascii_lower
from meterlens.llm.words import ALNUM, Words, gram_hashes

#: Fixed by the definition of a word: runs of these, after A-Z are lower-cased.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Windows in one broadcast (about 150 bytes each); a larger benchmark takes several.
WINDOWS_PER_BROADCAST = 500_000
#: Slots of the bitmap that is asked before the sorted hashes are.
BITMAP_BITS = 20

FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>,clean:string>"


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct (item, words of one window joined by spaces)."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(1))
    item = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (size - 1), F.lit(1)))
    return (benchmark.select(item.alias("item"), words.alias("_w")).where(F.size("_w") > 0)
            .select("item", "_w", F.explode(starts).alias("_at"))
            .select("item", F.array_join(F.slice("_w", F.col("_at"), F.lit(size)), " ").alias("window")).distinct())


def _broadcasts(windows: DataFrame, most: int) -> list[Broadcast]:
    """The windows as sorted hashes with their words and items, at most ``most`` in each broadcast."""
    sums = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    blocks = -(-sums.count() // most)
    out = []
    for block in range(blocks):
        rows = sums.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        tables = {}
        for length in sorted({len(r.window.split(" ")) for r in rows}):
            own = [r for r in rows if len(r.window.split(" ")) == length]
            words = Words(pa.array([r.window for r in own]), ALNUM)
            hashes = gram_hashes(words.hash, length)[words.first[:-1]]
            bitmap = np.zeros(1 << BITMAP_BITS, bool)
            bitmap[hashes >> np.uint64(64 - BITMAP_BITS)] = True
            known: dict[int, list] = {}
            for h, r in zip(hashes.tolist(), own):
                known.setdefault(h, []).append((r.window.encode(), tuple(r.items)))
            tables[length] = (bitmap, np.sort(hashes), known)
        out.append(windows.sparkSession.sparkContext.broadcast(tables))
    return out


def _hits(words: Words, tables: dict) -> list[tuple[int, int, tuple]]:
    """Confirmed (first word, number of words, items)."""
    out, owner = [], None
    for length, (bitmap, hashes, known) in tables.items():
        found = gram_hashes(words.hash, length)
        at = np.flatnonzero(bitmap[found >> np.uint64(64 - BITMAP_BITS)])
        place = np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)
        at = at[hashes[place] == found[at]]
        if len(at):
            owner = words.owner() if owner is None else owner
            at = at[owner[at] == owner[at + length - 1]]
        for i in at.tolist():
            text = b" ".join(words.text(j) for j in range(i, i + length))
            out += [(i, length, items) for window, items in known[int(found[i])] if window == text]
    return out


def _finder(broadcasts: list[Broadcast]):
    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        words = Words(text, ALNUM)
        hit = np.zeros(len(words.start), bool)
        items: dict[int, set] = {}
        for b in broadcasts:
            for first, length, found in _hits(words, b.value):
                hit[first:first + length] = True
                items.setdefault(int(np.searchsorted(words.first, first, "right")) - 1, set()).update(found)
        rows = []
        for i, t in enumerate(text):
            a, z = int(words.first[i]), int(words.first[i + 1])
            row = {"n_words": z - a, "n_hit": 0, "items": [], "spans": [], "clean": None}
            if i in items:
                raw, base = t.as_py().encode(), int(words.offsets[i])
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:z], [False]]).astype(np.int8)))
                spans = [(int(words.start[a + s]) - base, int(words.end[a + e - 1]) - base)
                         for s, e in zip(edges[::2], edges[1::2])]
                kept = [raw[x:y] for x, y in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)])]
                chars = lambda n: len(raw[:n].decode())
                row |= {"n_hit": int(hit[a:z].sum()), "items": sorted(items[i]), "clean": b"".join(kept).decode(),
                        "spans": [{"start": chars(s), "end": chars(e)} for s, e in spans]}
            rows.append(row)
        return pa.array(rows, type=pa.struct([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("clean", pa.string())]))
    return find


def contamination(text: Column | str, benchmark: DataFrame, size: int = 10, id_col: str = "item_id",
                  text_col: str = "text", most: int = WINDOWS_PER_BROADCAST) -> Column:
    """What of ``text`` occurs in the benchmark, as a struct.

    ``n_words``; ``n_hit``: words inside any occurrence of a window; ``items``: ids (as strings, sorted) of
    items with an occurring window; ``spans``: hit parts (code points, end exclusive); ``clean``: the text
    without them (null where nothing was hit).  Null and empty texts have no words.  Null benchmark texts
    have no windows, a null id is the item ``null``, repeated items and windows count once, and an empty
    benchmark hits nothing.
    """
    return _finder(_broadcasts(item_windows(benchmark, id_col, text_col, size), most))(text)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, spans: bool = False, text_col: str = "text",
                        **more) -> DataFrame:
    """``df`` without contaminated documents, or with only the hit spans cut out of their texts.

    Null and empty texts stay as they are, repeated rows stay repeated; the column name ``_found`` is reserved.
    """
    found = df.withColumn("_found", contamination(F.col(text_col), benchmark, **more))
    if not spans:
        return found.where("_found.n_hit = 0").select(*df.columns)
    return found.select(*[F.coalesce("_found.clean", F.col(c)).alias(c) if c == text_col else F.col(c) for c in df.columns])


