"""Personal data: the pattern kinds against plain regular expressions, the added kinds against hand-made cases."""

import hashlib
import random
import re
import time

import pytest

from llm_data import SMALL, documents  # noqa: F401
from meterlens.llm import private
from meterlens.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [*[("email", *m.span()) for m in EMAIL.finditer(text)],
            *[("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
            *[("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and passes_luhn(digits(m[0]))],
            *[("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]]


def base_of(text):
    return [s for s in private.Finder(text).spans() if s[0] in private.BASE_KINDS]


def added(text):
    return [(k, text[a:z]) for k, a, z in private.Finder(text).spans() if k not in private.BASE_KINDS]


def test_pattern_kinds_match_regular_expressions():
    rng = random.Random(1)
    for alphabet in ("a@.", "a@.-_ ", "12.", "0125.. ", "12 -", "+12 ().-", "ab1.@+ -é(\n", "+1@a.:/ "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert base_of(text) == plain_base(text), text
    cards = []
    for n in (15, 16, 17, 18, 19, 20):
        for _ in range(50):
            head = "".join(rng.choice("0123456789") for _ in range(n - 1))
            digits = next(head + d for d in "0123456789" if passes_luhn(head + d))
            cards.append(rng.choice(["", " ", "-"]).join([digits[:4], digits[4:8], digits[8:]]))
    for card in cards:
        for text in (f"pay {card}.", f"é{card}", f"{card} 1", f"1-{card}", f"{card}--{card}", f"{card}x{card}"):
            assert base_of(text) == plain_base(text), text


def test_added_kinds():
    assert added("mail jürgen@exämple.de now") == [("email_intl", "jürgen@exämple.de")]
    assert added("ann.b (at) mail [dot] example (dot) org!") == [("email_masked", "ann.b (at) mail [dot] example (dot) org")]
    assert added("ann[at]example.org.") == [("email_masked", "ann[at]example.org")]
    assert added("see https://ann:pa55@example.org/x, http://example.org:80/") == [("login", "ann:pa55")]
    assert added("host 2001:db8::8a2e:370:7334, std::cout, d::c, 12::30") == [("ip6", "2001:db8::8a2e:370:7334")]
    one, two = "4845168114407329", "4929348385146306"
    assert added(f"{one} {two}") == [("card_part", one), ("card_part", two)]
    assert added(f"{one[:4]} {one[4:8]} {one[8:12]} {one[12:]} 99 88") == [("card_part", f"{one[:4]} {one[4:8]} {one[8:12]} {one[12:]}")]
    assert added("Phone: (017) 555-7713, telling 5550000000") == [("phone_cued", "(017) 555-7713")]
    assert added("SSN 123-45-6789 ssn: 000-12-3456") == [("ssn", "123-45-6789")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 is it") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("iban DE89370400440532013001") == [("account", "DE89370400440532013001")]
    assert added("Account no. 12-345678 90, accounting 99999999, my account is old") == [("account", "12-345678 90")]
    assert added("plain text with 12 numbers, 3.5 and a@b") == []


@pytest.mark.parametrize("unit", ["a", "a@", "1.", "1", "1 ", "+1", ":", "a::", "account ", "account 12-", "http://", "x:y", "é@é.", "a(at)", "(at)a.a",
                                  "phone 1", "iban DE89 ", "4845168114407329 ", "://x:y@", "a@b.c"])
def test_long_runs_take_linear_time(unit):
    for end in ("", "@", "@b.c"):
        short = unit * 300 + end
        assert base_of(short) == plain_base(short)
    began = time.process_time()
    found = private.Finder(unit * (200_000 // len(unit)) + "@").spans()
    assert time.process_time() - began < 10
    for kind in private.KINDS:
        own = [s for s in found if s[0] == kind]
        assert all(a[2] <= b[1] for a, b in zip(own, own[1:]))


def test_scan_of_odd_rows(spark, documents):  # noqa: F811
    rows = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (4, "é+12345678 a@b.c"), (None, "1.2.3.4"), (5, "x " * 100_000 + "ann@example.org")]
    df = documents(rows).withColumn("spans", private.personal_data("text")).withColumn("masked", private.masked("text", "spans"))
    got = sorted(((r.doc_id, r.text, [tuple(s) for s in r.spans], r.masked) for r in df.collect()), key=str)
    assert got == sorted(((i, t, private.Finder(t or "").spans(), m) for (i, t), m in zip(rows, [
        None, "", "[EMAIL]", "[EMAIL]", "é[PHONE] [EMAIL]", "[IP]", "x " * 100_000 + "[EMAIL]"])), key=str)
    assert documents(rows).limit(0).select(private.personal_data("text")).collect() == []


def test_registered_scan_matches_regular_expressions(spark):
    texts = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op12_anchor_pii"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in private.BASE_KINDS)
        as_text = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        assert r.spans == as_text(private.Finder(texts[r.doc_id] or "").spans())
        assert set(filter(None, as_text(base).split(","))) <= set(r.spans.split(","))
