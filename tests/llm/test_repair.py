"""Conversation repair against exhaustive search and a plain dictionary DP."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from llm_data import SMALL
from meterlens.llm import repair
from meterlens.llm.queries import QUERIES

WHITE = "\t\n\v\f\r "
PATTERN = re.compile("(s?(ua)+)?")


def plain_audit(rows):
    """Cost and least audit of (initial, fault), as strings per state of a dictionary."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserts(best):
        for _ in range(3):
            for (state, i), to in moves.items():
                if i != "s" and state in best:
                    c, t = best[state]
                    best[to] = min(best.get(to, (9e9, "")), (c + 2, t + "I"))
        return best
    best = inserts({"": (0, "")})
    for initial, fault in rows:
        new = {}
        for state, (c, t) in best.items():
            options = [(c + 3, t + "D", state)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options += [(c + more, t + "K", moves[state, initial])] if (state, initial) in moves else []
                options += [(c + 2 + more, t + "R", moves[state, i]) for i in "ua" if (state, i) in moves]
            for cost, text, to in options:
                new[to] = min(new.get(to, (9e9, "")), (cost, text))
        best = inserts(new)
    return min(best[s] for s in ("", "a") if s in best)


def searched_audit(rows):
    """The same by trying every string of edits."""
    found = []
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            shape = "?" * gaps[0] + "".join((r[0] or "#" if e == "K" else "?" if e == "R" else "") + "?" * g
                                            for e, r, g in zip(edits, rows, gaps[1:]))
            wanted = ("s" if shape[:1] == "s" else "") + "ua" * len(shape)
            if (len(shape) - (shape[:1] == "s")) % 2 or shape == "s" or any(x not in ("?", w) for x, w in zip(shape, wanted)):
                continue
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[a] for a in audit)
            cost += sum(f == "truncated" and e != "D" for e, (_, f) in zip(edits, rows))
            found.append((cost, audit))
    return min(found)


def plain(rows):
    """conv_id -> the contract's columns, from damaged rows (conv_id, turn, role, text, copies)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r, x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = text.strip(WHITE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit = plain_audit(list(zip(initials, faults)))
        lines, state, at = [], "", 0
        needed = lambda: "assistant" if state == "u" else "user"
        for edit in audit:
            if edit == "I":
                lines.append(f"{needed()}:")
            elif edit == "R":
                lines.append(f"{needed()}:{own[at][2]}")
            elif edit == "K":
                lines.append(f"{own[at][1]}:{own[at][2]}")
            state = lines[-1][0] if edit != "D" else state
            at += edit != "I"
        assert PATTERN.fullmatch("".join(x[0] for x in lines))
        out[conv] = ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out.append((conv, turn, "user" if hit == 4 else role, text, {0: 0, 3: 2}.get(hit, 1)))
    return out


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_audits_are_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = [(rng.choice("ssuuaa "), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(5))]
        faults = {"": repair.FINE, "truncated": repair.TRUNCATED, "blank": repair.BLANK, "duplicate": repair.DUPLICATE}
        ends = repair.cheapest([(i, faults[f]) for i, f in rows])
        ours = min(ends[e] for e in repair.ENDS if ends[e])
        assert ours == plain_audit(rows) == searched_audit(rows)


def test_longest_common_prefixes():
    rng, audits, texts = random.Random(5), repair.Audits(), {}
    for _ in range(300):
        text = "".join(rng.choice("DK") for _ in range(rng.randrange(40)))
        node = 0
        for letter in text:
            node = audits.longer(node, letter)
        assert texts.setdefault(text, node) == node and audits.text(node) == text
    for a, b in itertools.product(texts, repeat=2):
        assert audits.less(texts[a], texts[b]) == (a < b)


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(repair, "_PRIME", 3)
    test_longest_common_prefixes()
    test_audits_are_cheapest_and_least(9)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    said = ["Yes.", "No", " \t", "", None, "Why?\n", "é! ", "a\x0bb", "Yes.", "long " * 3000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), rng.choice(["system", "user", "assistant", "tool", "", None, "user"]),
                         rng.choice(said)))
    rows += [(7, 1, "user", "again.")] * 40 + [(8, t, "user", "hot.") for t in range(300)]
    rows += [(9, t % 50, rng.choice(["user", "assistant"]), f"t{rng.randrange(400)}{rng.choice(['.', ''])}") for t in range(900)]
    rows += [(70, 2**63 - 1, "user", "x."), (70, -2**63, "user", "y.")]
    return rows


@pytest.mark.parametrize("segment", [3, 64, 4096])
def test_repair_matches_plain_python(spark, odd_rows, segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    # tasks run in other processes: the limit goes with the function
    monkeypatch.setattr(repair._Segment, "full", lambda self: len(self.lines) >= segment)
    df = spark.createDataFrame([(r, 1, *x) for r, x in enumerate(odd_rows)], "part int, told int, conv_id long, turn long, role string, text string")
    ours, wanted = found(repair.repaired(repair.damaged(df))), plain(plain_damage(odd_rows))
    wrap = lambda g: (g + 2**63) % 2**64 - 2**63
    assert ours == {k: (wrap(v[0]), *v[1:]) for k, v in wanted.items()}


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(repair.damaged(df)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert found(repair.repaired(repair.damaged(df))) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_registered_repair_matches_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_conversation_repair"](spark, SMALL)) == plain(plain_damage(rows))
