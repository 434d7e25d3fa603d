"""Operator 12: personal data in texts, by anchors and local parsers.

One Aho-Corasick pass over a text finds anchors: at-signs and their spelled forms,
plus signs before digits, digits, scheme separators, double colons, and cue words such
as ``IBAN`` or ``phone``.  At each anchor a deterministic parser expands to the
boundaries of one kind of span and validates it: labels of a domain, parts of an
address, check digits of a card or account.  No parser looks further than the span it
builds, and none starts inside a span of its own kind, so a text takes linear time.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of the pattern kinds, then what the anchors add.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_intl", "email_masked", "login", "ip6", "card_part", "phone_cued", "ssn", "iban", "account")
KINDS = BASE_KINDS + ADDED_KINDS

#: Cue words, in lower case; they also count in capitals and with a capital first letter.
CUES = {
    "phone_cued": ("phone", "telephone", "tel", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono"),
    "ssn": ("ssn", "social security", "social security number"),
    "account": ("iban", "account", "acct", "bank account", "routing", "passport", "konto", "kontonummer", "compte", "cuenta"),
}
MASKED_AT = ("(at)", "[at]", "{at}", " at the domain ")

# Boundaries of the kinds; each is matched at one place and reads every character once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_DOMAIN = re.compile(r"[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"[\x20().0-9-]+")
CUED_PHONE = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
AFTER_CUE = re.compile(r"(?:[\x20_-]?(?:number|numero|nummer|no|nr|num|id))?\.?[\x20\t]{0,3}[:=#]?[\x20\t]{0,3}(?![\x20\t])", re.IGNORECASE)
GROUP = re.compile(r"[A-Za-z0-9]{1,34}(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}([\x20-]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
IP6_CHARS = frozenset("0123456789abcdefABCDEF:.")
DOT_MARKS = re.compile(r"[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|\.)[\x20]?", re.IGNORECASE)
LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@")
#: Characters a part before a spelled at-sign, a login or an address with colons may have at most.
LONGEST_LOCAL, LONGEST_LOGIN, LONGEST_IP6 = 64, 512, 45

SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _automaton() -> ahocorasick.Automaton:
    anchors: dict[str, tuple[str, ...]] = {}
    for what, words in [("@", ["@"]), ("+", [f"+{d}" for d in range(10)]), ("digit", [str(d) for d in range(10)]), ("://", ["://"]), ("::", ["::"])]:
        for word in words:
            anchors[word] = (what, "")
    for word in MASKED_AT:
        for form in {word, word.upper()}:
            anchors[form] = ("masked", "")
    for kind, words in CUES.items():
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                anchors[form] = ("cue", kind)
    out = ahocorasick.Automaton()
    for word, (what, kind) in anchors.items():
        out.add_word(word, (what, kind, len(word)))
    out.make_automaton()
    return out


_automata: list[ahocorasick.Automaton] = []


def anchors(text: str) -> Iterator[tuple[int, tuple[str, str, int]]]:
    """(end, (what, kind, length)) of every anchor, by its last character."""
    if not _automata:
        _automata.append(_automaton())
    return _automata[0].iter(text)


#: What a doubled digit adds, by its byte.
_TWICE = bytes(2 * (c - 48) - 9 * (c > 52) if 48 <= c <= 57 else 0 for c in range(256))


def luhn(digits: str) -> bool:
    back = digits.encode()[::-1]
    return (sum(back[::2]) - 48 * len(back[::2]) + sum(back[1::2].translate(_TWICE))) % 10 == 0


def _is_card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_byte(part: str) -> bool:
    return len(part := part.lstrip("0")) < 4 and int(part or 0) <= 255


def _is_iban(value: str) -> bool:
    return bool(IBAN.fullmatch(value)) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _cards_of(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Cards that stand side by side in a run of too many digits: whole groups of it."""
    groups = [m.span() for m in DIGITS.finditer(text, start, stop)]
    i = 0
    while i < len(groups):
        digits, j = "", i
        while j < len(groups) and len(digits) + groups[j][1] - groups[j][0] <= 19:
            digits += text[slice(*groups[j])]
            j += 1
            if _is_card(digits):
                yield groups[i][0], groups[j - 1][1]
                i = j - 1
                break
        i += 1


def _wordlike(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Finder:
    """Spans of one text; ``free`` is how far each kind has been read."""

    def __init__(self, text: str):
        self.text, self.found, self.free = text, [], dict.fromkeys(KINDS, 0)
        self.colons_read = 0

    def add(self, kind: str, start: int, stop: int) -> None:
        self.found.append((kind, start, stop))
        self.free[kind] = max(self.free[kind], stop)

    def at_sign(self, at: int) -> None:
        text, start = self.text, at
        while start > self.free["email"] and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            self.add("email", start, domain.end())
        self.wide_email(at)

    def wide_email(self, at: int) -> None:
        """Addresses with letters beyond ASCII, which the plain kind misses or cuts."""
        text, start = self.text, at
        while start > self.free["email_intl"] and (text[start - 1] in LOCAL or (text[start - 1] > "\x7f" and text[start - 1].isalnum())):
            start -= 1
        while start < at and text[start] in ".-%+":
            start += 1
        domain = WIDE_DOMAIN.match(text, at + 1)
        if start < at and domain and not (text[start:at] + domain[0]).isascii():
            self.add("email_intl", start, domain.end())

    def masked_at(self, start: int, stop: int) -> None:
        """``name (at) host (dot) org``, with single spaces around the marks."""
        text, left = self.text, start - (text_space(self.text, start - 1))
        first = left
        while first > max(0, left - LONGEST_LOCAL, self.free["email_masked"]) and text[first - 1] in LOCAL:
            first -= 1
        right = stop + text_space(text, stop)
        label = LABEL.match(text, right)
        if first == left or not label:
            return
        end, labels = label.end(), 1
        while (dot := DOT_MARKS.match(text, end)) and (label := LABEL.match(text, dot.end())) and (dot[0] == "." or len(dot[0]) > 2):
            end, labels = label.end(), labels + 1
        if labels > 1:
            self.add("email_masked", first, end)

    def plus(self, at: int) -> None:
        run = PHONE_RUN.match(self.text, at + 2)
        if not run:
            return
        stop = at + 2 + len(run[0].rstrip(" ().-"))
        if stop > at + 3 and 8 <= sum(c in "0123456789" for c in self.text[at:stop]) <= 15:
            self.add("phone", at, stop)

    def digit(self, at: int) -> None:
        text = self.text
        if at >= self.free["ip"]:
            run = IP.match(text, at)
            if run and all(map(_is_byte, run[0].split("."))):
                self.add("ip", *run.span())
            self.free["ip"] = run.end() if run else DIGITS.match(text, at).end()
        if at >= self.free["card"]:
            run = CARD.match(text, at)
            self.free["card"] = run.end() if run else at + 1
            if run:
                digits = re.sub("[^0-9]", "", run[0]) if len(run[0]) <= 40 else ""
                if _is_card(digits):
                    self.add("card", *run.span())
                elif len(run[0]) > 19:
                    for span in _cards_of(text, *run.span()):
                        self.add("card_part", *span)

    def scheme(self, stop: int) -> None:
        """Name and password before the host of a URL."""
        login = LOGIN.match(self.text, stop, stop + LONGEST_LOGIN)
        if login and stop >= self.free["login"]:
            self.add("login", stop, login.end() - 1)

    def colons(self, at: int) -> None:
        text, start, stop = self.text, at, at + 2
        if at < self.colons_read:
            return
        while start > max(at - LONGEST_IP6, self.free["ip6"]) and text[start - 1] in IP6_CHARS:
            start -= 1
        while stop < min(len(text), at + LONGEST_IP6) and text[stop] in IP6_CHARS:
            stop += 1
        self.colons_read = stop
        value = text[start:stop].rstrip(".")
        stop = start + len(value)
        if _wordlike(text, start - 1) or _wordlike(text, stop) or len(re.findall("[0-9A-Fa-f]+", value)) < 3:
            return
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return
        self.add("ip6", start, stop)

    def cue(self, kind: str, start: int, stop: int) -> None:
        """What follows a cue word: a number of its kind."""
        text = self.text
        if _wordlike(text, start - 1) or (stop < len(text) and text[stop].isalpha()):
            return
        lead = AFTER_CUE.match(text, stop)
        if not lead or lead.end() == stop:
            return
        at = lead.end()
        if kind == "phone_cued":
            run = CUED_PHONE.match(text, at, at + 40)
            if run and at >= self.free[kind] and 7 <= sum(c.isdigit() for c in run[0]) <= 15 and not _wordlike(text, run.end()):
                self.add(kind, *run.span())
        elif kind == "ssn":
            if (run := SSN.match(text, at)) and at >= self.free[kind]:
                self.add(kind, *run.span())
        else:
            self.account(at)

    def account(self, at: int) -> None:
        """Groups with digits, one separator between them; the most of them that make an account number."""
        text, groups, size = self.text, [], 0
        while (group := GROUP.match(text, at)) and any(c in "0123456789" for c in group[0]) and size + len(group[0]) <= 34:
            groups.append(group.span())
            size += len(group[0])
            if group.end() == len(text) or text[group.end()] not in " -":
                break
            at = group.end() + 1
        for n in range(len(groups), 0, -1):
            start, stop = groups[0][0], groups[n - 1][1]
            if start >= self.free["iban"] and _is_iban("".join(text[slice(*g)] for g in groups[:n])):
                return self.add("iban", start, stop)
        if groups and groups[0][0] >= self.free["account"]:
            start, stop = groups[0][0], groups[-1][1]
            if sum(c in "0123456789" for c in text[start:stop]) >= 6:
                self.add("account", start, stop)

    def spans(self) -> list[tuple[str, int, int]]:
        for end, (what, kind, length) in anchors(self.text):
            start = end + 1 - length
            if what == "digit":
                if start >= self.free["ip"] or start >= self.free["card"]:
                    self.digit(start)
            elif what == "@":
                self.at_sign(start)
            elif what == "+":
                self.plus(start)
            elif what == "masked":
                self.masked_at(start, end + 1)
            elif what == "://":
                self.scheme(end + 1)
            elif what == "::":
                self.colons(start)
            else:
                self.cue(kind, start, end + 1)
        return sorted(set(self.found), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def text_space(text: str, at: int) -> int:
    return int(0 <= at < len(text) and text[at] == " ")


def _found(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "stop": z} for k, a, z in Finder(t or "").spans()] for t in texts.to_pylist()], _SPANS)


def personal_data(text: Column | str) -> Column:
    """Spans of each whole text: an array of (kind, start, stop) in code points, stop exclusive, by kind as listed, then start.

    Spans of one kind do not overlap, those of different kinds may.  Null and empty texts have none; texts of
    any length are read whole, and a text's spans depend on that text only, whatever else is in the table.
    """
    return F.arrow_udf(_found, SPANS)(text)


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column | str, spans: Column | str) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest, names all."""
    @F.arrow_udf("string")
    def mask(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, rows in zip(texts.to_pylist(), found.to_pylist()):
            parts, at = [], 0
            for s in sorted(rows or (), key=lambda s: (s["start"], -s["stop"], KINDS.index(s["kind"]))):
                if s["start"] >= at:
                    parts += [t[at:s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["stop"])
            out.append(None if t is None else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())
    return mask(text, spans)
