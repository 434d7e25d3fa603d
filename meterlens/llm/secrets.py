"""Operator 9: secrets in texts, by patterns and by token efficiency.

Patterns find assignments, access keys and long hex strings.  What a byte-pair
vocabulary packs badly - few characters per token - is random: such strings are
reported too, unless they are digests, UUIDs, numbers or plain identifiers.  A run
is tested whole, without the readable words around it, and part by part, so that a
path does not hide the key behind it.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed patterns.  Letters of the assignment's names match in either case (ASCII only).
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Strings whose token efficiency is tested.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_SIZES = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
ONE_HEX = re.compile(r"([0-9a-f]+|[0-9A-F]+)\Z")
#: Names and numbers joined by separators, such as ``customer_id-2024`` or ``src/main/App``.
IDENTIFIER = re.compile(r"[=+/_-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})([=+/_-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[=+/_-]*\Z")
PART, LONG_WORD = re.compile("[A-Za-z0-9]+"), re.compile("[A-Za-z]{4,}")
#: Parts that say nothing by themselves: short ones and numbers.
SMALL_PART = re.compile(r"([A-Za-z0-9]{1,3}|[0-9]{1,8})\Z")
#: Random base-62 text has 1.3 to 1.9 characters a token, prose over 3.
MOST_CHARS_PER_TOKEN = 2.2

FOUND = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>"
_encodings: dict[bytes, tiktoken.Encoding] = {}


def load_vocabulary(path: str) -> bytes:
    """The vocabulary file; only the driver reads it, executors get it by broadcast (under 2 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    key = hashlib.sha256(vocabulary).digest()
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def packs_badly(text: str, enc: tiktoken.Encoding, most: float) -> bool:
    return len(text) < most * len(enc.encode_ordinary(text))


def is_known(text: str, enc: tiktoken.Encoding, most: float) -> bool:
    """Digests, UUIDs, numbers and identifiers: random to look at, or badly packed, yet no secrets.

    Words of an identifier are packed well by themselves; only its separators and short names are not.
    """
    if ONE_HEX.match(text) and len(text) in DIGEST_SIZES or UUID.match(text) or not re.search("[A-Za-z]", text):
        return True
    words = LONG_WORD.findall(text)
    return bool((IDENTIFIER.match(text) or not re.search("[0-9]", text))
                and sum(map(len, words)) >= most * sum(len(enc.encode_ordinary(w)) for w in words))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def core_of(text: str, parts: list[tuple[int, int]], enc: tiktoken.Encoding, most: float) -> tuple[int, int]:
    """Where ``text`` begins and ends without the readable words at both its ends."""
    def after_words(of: list[tuple[int, int]]) -> int:
        n = 0
        for i, (a, z) in enumerate(of):
            if SMALL_PART.match(text[a:z]):
                continue
            if not text[a:z].isalpha() or packs_badly(text[a:z], enc, most):
                break
            n = i + 1
        return n
    first, last = after_words(parts), len(parts) - after_words(parts[::-1])
    if first >= last:
        return 0, 0
    return parts[first][0] if first else 0, parts[last - 1][1] if last < len(parts) else len(text)


def random_spans(text: str, enc: tiktoken.Encoding, most: float) -> list[tuple[str, int, int]]:
    """Badly packed runs; of a run that is well packed as a whole, its badly packed core, or else parts."""
    out = []
    for m in CANDIDATE.finditer(text):
        parts = [p.span() for p in PART.finditer(m[0])]
        for spans in ([(0, len(m[0]))], [core_of(m[0], parts, enc, most)] if len(parts) > 1 else [], parts):
            found = [(a, z) for a, z in spans if CANDIDATE.fullmatch(m[0][a:z])
                     and not is_known(m[0][a:z], enc, most) and packs_badly(m[0][a:z], enc, most)]
            out += [("random", m.start() + a, m.start() + z) for a, z in found]
            if found:
                break
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{a}:{z}" for kind, a, z in spans)


def secrets(spark: SparkSession, text: Column | str, vocabulary: str = DEFAULT_VOCABULARY,
            most_chars_per_token: float = MOST_CHARS_PER_TOKEN) -> Column:
    """Secrets of each whole text, as a struct.

    ``n_assign``, ``n_access``, ``n_hex`` count the pattern kinds; ``base_sha256`` is the digest of their
    ``kind:start:end`` list; ``spans`` lists these and the ``random`` strings in the same form (code points, end exclusive,
    by start, then kind).  Spans of different kinds may overlap.  Null and empty texts have none.
    """
    vocab = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        enc, rows = encoding(vocab.value), []
        for t in texts.to_pylist():
            base = base_spans(t or "")
            rows.append({**{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS[:3]},
                         "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                         "spans": joined(base + random_spans(t or "", enc, most_chars_per_token))})
        return pa.array(rows, type=pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                                              ("base_sha256", pa.string()), ("spans", pa.string())]))
    return find(text)


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """``text`` with every listed span replaced by ``mark``; overlapping spans become one."""
    out, at = [], 0
    for a, z in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]])
