"""Array words against plain Python."""

import re

import numpy as np
import pyarrow as pa

from meterlens.llm import words as W

TEXTS = ["The cat. THE Cat", None, "", "  \t\x0b ", "ünï-çödé a1B2 \x00x", "one", "a b c d e f", "x" * 300 + " " + "y" * 299]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_words_and_hashes():
    for kind, pattern in ((W.SPACED, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for texts in (TEXTS, TEXTS[::-1], TEXTS * 3):
            found = W.Words(pa.array(texts, pa.string()), kind)
            seen = {}
            for i, t in enumerate(texts):
                wanted = re.findall(pattern, lowered(t))
                at = range(found.first[i], found.first[i + 1])
                assert [found.text(j).decode() for j in at] == wanted
                for j, w in zip(at, wanted):
                    assert seen.setdefault(w, found.hash[j]) == found.hash[j]
            assert len(set(seen.values())) == len(seen)


def test_hash_does_not_depend_on_place(monkeypatch):
    texts = ["alpha beta gamma", "beta", "longer text with beta inside it"]
    whole = W.Words(pa.array(texts), W.SPACED)
    monkeypatch.setattr(W, "PIECE", 7)
    assert (W.Words(pa.array(texts), W.SPACED).hash == whole.hash).all()
    assert (W.Words(pa.array(texts).slice(1), W.SPACED).hash == whole.hash[3:]).all()


def test_grams():
    texts = ["a b c d", None, "a b", "b c d", ""]
    found = W.Words(pa.array(texts, pa.string()), W.SPACED)
    hashes, counts = W.grams(found, 3)
    assert counts.tolist() == [2, 0, 1, 1, 0]
    assert hashes[1] == hashes[3] and len(np.unique(hashes)) == 3


def test_many_words_do_not_collide():
    found = W.Words(pa.array([" ".join(f"{i:x}" for i in range(200_000))]), W.SPACED)
    assert len(np.unique(found.hash)) == 200_000 and len(np.unique(W.gram_hashes(found.hash, 5))) == 199_996
