"""Operator 13: repair of conversation structure by a persistent audit DP.

A conversation should read ``(s?(ua)+)?`` in role initials.  Every row is kept, given
another role or deleted, and rows are inserted, at least cost; of equally cheap audits
(the edits' initials in order) the ASCII-least counts.  The DP has four states: nothing
yet, after the system row, after the user, after the assistant.  Its audits are linked
nodes that share their prefixes; each knows its ancestors 1, 2, 4, ... steps back and a
rolling hash.  Two audits are compared at their longest common prefix, found by
descending through these ancestors; a hash names a node only once parent and letter
are verified, so that equal audits are one node.

Rows are counted when equal, then sorted by range of (conversation, turn, row), so a
conversation of any size is spread over tasks.  A task streams its range in segments of
at most SEGMENT rows.  Whole conversations are finished there.  Of a conversation cut by
a border each segment gives the cheapest audit between any two states, and segments
are joined pair by pair in a tree.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import prepared, stored

#: Most rows, and characters of text, of one segment (one longer text is a segment of its own).
SEGMENT, SEGMENT_CHARS = 4096, 16 << 20
#: Segments joined by one task at a time, as a power of two.
FAN_BITS = 6

START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = 4, (START, ASSISTANT)
#: (from, to) by the initial of a row that is kept, made user or assistant, or inserted.
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51

BLANK, DUPLICATE, TRUNCATED, FINE = range(4)


class Audits:
    """Strings that share prefixes: numbers of nodes, 0 being the empty string."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]
        self.named: dict[int, list[int]] = {}

    def longer(self, node: int, letter: str) -> int:
        """The node of ``node`` and one more letter; the same one each time."""
        key = (self.hash[node] * _BASE + ord(letter)) % _PRIME
        there = self.named.setdefault(key, [])
        for other in there:
            if self.letter[other] == letter and self.up[other][0] == node:
                return other
        new, up = len(self.letter), [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        for column, value in ((self.letter, letter), (self.depth, self.depth[node] + 1), (self.hash, key), (self.up, tuple(up))):
            column.append(value)
        there.append(new)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of ``depth`` letters."""
        while (steps := self.depth[node] - depth) > 0:
            node = self.up[node][steps.bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether string ``a`` comes before string ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Row(NamedTuple):
    role: str
    text: str
    fault: int


Best = list  # per state: (cost, node), or None


def _offer(audits: Audits, best: Best, state: int, cost: int, node: int, letter: str) -> None:
    now = best[state]
    if now is None or cost <= now[0]:
        node = audits.longer(node, letter)
        if now is None or cost < now[0] or audits.less(node, now[1]):
            best[state] = (cost, node)


def _with_inserts(audits: Audits, best: Best) -> Best:
    """What rows inserted at this place add; two in a row at most can pay."""
    out = list(best)
    for initial in "ua":
        for a, b in STEPS[initial]:
            if (from_ := (out if initial == "a" else best)[a]) is not None:
                _offer(audits, out, b, from_[0] + INSERT, from_[1], "I")
    return out


def _with_row(audits: Audits, best: Best, initial: str, fault: int) -> Best:
    out: Best = [None] * STATES
    for state, entry in enumerate(best):
        if entry is not None:
            _offer(audits, out, state, entry[0] + DELETE, entry[1], "D")
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT_OFF if fault == TRUNCATED else 0
    for letter, cost, initials in (("K", more, initial), ("R", REROLE + more, "ua")):
        for i in initials:
            for a, b in STEPS.get(i, ()):
                if best[a] is not None:
                    _offer(audits, out, b, best[a][0] + cost, best[a][1], letter)
    return out


def cheapest(rows: list[tuple[str, int]], start: int = START) -> list[tuple[int, str] | None]:
    """Cost and ASCII-least cheapest audit of rows (initial, fault) from one state to each state."""
    audits = Audits()
    best: Best = [None] * STATES
    best[start] = (0, 0)
    best = _with_inserts(audits, best)
    for initial, fault in rows:
        best = _with_inserts(audits, _with_row(audits, best, initial, fault))
    return [None if e is None else (e[0], audits.text(e[1])) for e in best]


def _least(entries: list) -> tuple[int, str] | None:
    return min((e for e in entries if e is not None), default=None)


def joined(a: list, b: list) -> list:
    """Audits between all states (START * STATES + END) over two segments in a row."""
    out = []
    for start in range(STATES):
        for end in range(STATES):
            out.append(_least([(x[0] + y[0], x[1] + y[1]) for mid in range(STATES)
                               if (x := a[start * STATES + mid]) is not None and (y := b[mid * STATES + end]) is not None]))
    return out


class Mender:
    """Applies an audit to rows, in parts if need be: the repaired lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> list[str]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out.append(self._as_needed("user:", "assistant:"))
            self.at += 1
        return out

    def _as_needed(self, user: str, assistant: str) -> str:
        line, self.state = (assistant, ASSISTANT) if self.state == USER else (user, USER)
        return line

    def lines(self, rows: list[Row]) -> list[str]:
        out = []
        for row in rows:
            out += self._inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "R":
                out.append(self._as_needed(f"user:{row.text}", f"assistant:{row.text}"))
            elif edit == "K":
                out.append(f"{row.role}:{row.text}")
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row.role[0]]
        return out + self._inserted()


#: What a segment tells of itself; ``between`` holds cost and audit from each state to each.
_COUNTS = [(n, pa.int64()) for n in ("rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
_ENTRY = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_LINE = pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int8())])
_SUMMARY = [*_COUNTS, ("first", pa.string()), ("last", pa.string()), ("between", pa.list_(_ENTRY))]
_SEGMENT = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("whole", pa.bool_()), *_SUMMARY,
                      ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("lines", pa.list_(_LINE))])
_MERGED = pa.schema([("conv", pa.int64()), ("place", pa.int64()), *_SUMMARY])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.int8(): "tinyint", pa.string(): "string", pa.bool_(): "boolean",
             pa.list_(_ENTRY): "array<struct<cost:bigint,audit:string>>", pa.list_(_LINE): "array<struct<role:string,text:string,fault:tinyint>>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _illegal(a: str, b: str) -> int:
    return int(a + b not in ("su", "ua", "au"))


class _Segment:
    """Rows of one conversation, in order, as they arrive."""

    def __init__(self, conv: int | None):
        self.conv, self.lines, self.chars = conv, [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, row: Row, turn: int | None) -> None:
        self.lines.append(row)
        self.chars += len(row.text) + len(row.role)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def full(self) -> bool:
        return len(self.lines) >= SEGMENT or self.chars >= SEGMENT_CHARS

    def summary(self) -> dict:
        initials, faults = [r.role[:1] for r in self.lines], [r.fault for r in self.lines]
        return {"conv": self.conv, "rows": len(faults), "low": self.low, "high": self.high, "turns": self.turns,
                "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                "illegal": sum(map(_illegal, initials, initials[1:])),
                "first": initials[0] if initials else None, "last": initials[-1] if initials else None}

    def finished(self) -> dict:
        if not self.lines:
            return self.summary() | {"whole": True, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        ends = cheapest([(r.role[:1], r.fault) for r in self.lines])
        cost, audit = _least([ends[e] for e in ENDS])
        text = "\n".join(Mender(audit).lines(self.lines))
        return self.summary() | {"whole": True, "cost": cost, "audit": audit,
                                 "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}

    def opened(self) -> dict:
        rows = [(r.role[:1], r.fault) for r in self.lines]
        between = [e for start in range(STATES) for e in cheapest(rows, start)]
        return self.summary() | {"whole": False, "between": _entries(between), "lines": [r._asdict() for r in self.lines]}


def _entries(between: list) -> list:
    return [None if e is None else {"cost": e[0], "audit": e[1]} for e in between]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a range of rows sorted by conversation, turn and row; equal rows come as one with their number."""
    now, first, cut, place, part = None, True, False, 0, 0
    out: list[dict] = []

    def closed(seg: _Segment, last: bool) -> None:
        nonlocal first, place, cut
        whole = not (first or last or cut)
        out.append((seg.finished() if whole else seg.opened()) | {"part": part, "place": place})
        place += 1

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("part", "conv", "turn", "role", "text", "fault", "again", "copies")]
        for part, conv, turn, role, text, fault, again, copies in zip(*columns):
            if now is None:
                now = _Segment(conv)
            elif now.conv != conv:
                closed(now, False)
                now, first, cut = _Segment(conv), False, False
            for k in range(copies):
                if now.full():
                    cut = True
                    closed(now, False)
                    now = _Segment(conv)
                now.add(Row(role, text, fault if fault == BLANK else DUPLICATE if again or k else fault), turn)
                if out and (len(out) >= 1024 or not out[-1]["whole"]):
                    yield pa.RecordBatch.from_pylist(out, _SEGMENT)
                    out.clear()
    if now is not None:
        closed(now, True)
    yield pa.RecordBatch.from_pylist(out, _SEGMENT)


def _merged(rows: pa.Table) -> pa.Table:
    """Segments in order as one."""
    parts = sorted(rows.to_pylist(), key=lambda r: r["place"])
    full = [p for p in parts if p["rows"]]
    out = dict((full or parts)[0])
    for p in full[1:]:
        out["illegal"] += p["illegal"] + _illegal(out["last"], p["first"])
        out["turns"] += p["turns"] - int(p["turns"] > 0 and p["low"] == out["high"])
        out["low"] = p["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if p["high"] is None else p["high"]
        out["last"] = p["last"]
        for n in ("rows", "blank", "duplicate", "truncated"):
            out[n] += p[n]
    betweens = [[None if e is None else (e["cost"], e["audit"]) for e in p["between"]] for p in (full or parts[:1])]
    while len(betweens) > 1:
        betweens = [joined(*betweens[i:i + 2]) if i + 1 < len(betweens) else betweens[i] for i in range(0, len(betweens), 2)]
    out["between"] = _entries(betweens[0])
    out["place"] = parts[0]["place"] >> FAN_BITS
    return pa.Table.from_pylist([{k: out[k] for k in _MERGED.names}], _MERGED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of repaired conversations whose audit comes first and whose segments follow, one segment at a time."""
    conv, mender, digest, any_line = None, None, None, False
    schema = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        for i in range(batch.num_rows):
            audit = batch.column("audit")[i].as_py()
            if audit is not None:
                if mender is not None:
                    yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)
                conv, mender, digest, any_line = batch.column("conv")[i].as_py(), Mender(audit), hashlib.sha256(), False
                continue
            for line in mender.lines([Row(**r) for r in batch.column("lines")[i].as_py()]):
                digest.update((b"\n" if any_line else b"") + line.encode("utf-8", "surrogatepass"))
                any_line = True
    if mender is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``copies``: some dropped (0), emptied, cut off, repeated (2) or given another role.

    Which is decided by the checksum of ``conv_id:turn``; a null in any column reads as one space there.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("copies"))


def _fault(text: Column) -> Column:
    """BLANK, TRUNCATED or FINE, by the last character that is no white space."""
    last = F.substring(F.rtrim(F.translate(text, "\t\n\v\f\r", "     ")), -1, 1)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).cast("tinyint")


def repaired(df: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text and, if given, ``copies``): faults, cheapest audit, digest.

    Rows are taken by turn (nulls first), rows of one turn by role and then by an arbitrary order that depends on the text only.
    ``copies`` says how often a row is there (once, if there is no such column); a conversation without rows has zeros, an empty audit
    and the digest of nothing.  Null roles and texts read as one space; rows of a null conversation are one conversation.
    ``gaps`` wraps around like any long.  An empty table gives an empty result; further columns, whatever their names, are ignored.
    A conversation may have up to about 2^31 rows, since its audit is one string; its digest is made by one task that reads one segment
    at a time.
    """
    prepared(df.sparkSession)
    copies = F.col("copies") if "copies" in df.columns else F.lit(1).cast("long")
    rows = df.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                     F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    gone = F.col("copies") == 0
    rows = rows.withColumns({"role": F.when(gone, "").otherwise(F.col("role")), "text": F.when(gone, "").otherwise(F.col("text"))})
    told = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = stored(rows.withColumn("told", told).groupBy("conv", "turn", "told").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies")), "rows")

    seen = rows.where("copies > 0").groupBy(F.col("conv").alias("_conv"), F.col("told").alias("_told")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("_first"), F.count("*").alias("_times")).where("_times > 1")
    again = F.col("_first").isNotNull() & ~F.struct(F.col("turn").isNotNull().alias("some"), "turn").eqNullSafe(F.col("_first"))
    told_rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("told") == F.col("_told")), "left").select(
        "conv", "turn", "role", "told", "text", _fault(F.col("text")).alias("fault"), again.alias("again"), "copies")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("told").asc()]
    ranges = told_rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = stored(ranges.mapInArrow(_segments, _ddl(_SEGMENT)), "segments")

    cut = found.where("NOT whole")
    bounds = cut.agg(F.max("part").alias("parts"), F.max("place").alias("places")).first()
    ends = F.filter(F.array(*[F.struct(F.col("between")[e]["cost"].alias("cost"), F.col("between")[e]["audit"].alias("audit")) for e in ENDS]),
                    lambda e: e["cost"].isNotNull())
    if bounds["parts"] is not None:
        bits = bounds["places"].bit_length()
        merged = cut.select("conv", (F.shiftleft(F.col("part").cast("long"), bits) + F.col("place")).alias("place"), *[n for n, _ in _SUMMARY])
        for _ in range(0, bits + bounds["parts"].bit_length() + 1, FAN_BITS):
            merged = stored(merged.groupBy("conv", F.shiftright("place", FAN_BITS)).applyInArrow(_merged, _ddl(_MERGED)), "merged")
        merged = merged.select("*", F.array_min(ends).alias("best")).select("*", "best.cost", "best.audit")
        audits = merged.select("conv", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("place"), "audit")
        to_mend = audits.withColumn("lines", F.lit(None).cast(cut.schema["lines"].dataType)).unionByName(
            cut.withColumn("audit", F.lit(None).cast("string")).select("conv", "part", "place", "audit", "lines"))
        digests = to_mend.repartition("conv").sortWithinPartitions("conv", "part", "place").mapInArrow(_digests, "_conv bigint, repaired_sha256 string")
        joined_up = merged.join(digests, F.col("conv").eqNullSafe(F.col("_conv")))
        found = found.where("whole").select(*[n for n, _ in _COUNTS], "conv", "cost", "audit", "repaired_sha256").unionByName(
            joined_up.select(*[n for n, _ in _COUNTS], "conv", "cost", "audit", "repaired_sha256"))
    wide = F.col("high").cast("decimal(38,0)") - F.col("low") + 1 - F.col("turns")
    wrapped = F.when(wide >= F.expr(f"{1 << 63}BD"), wide - F.expr(f"{1 << 64}BD")).otherwise(wide)
    gaps = F.coalesce(wrapped, F.lit(0)).cast("long")
    return found.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        "repaired_sha256")
