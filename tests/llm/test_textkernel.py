import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import textkernel as K


def plain(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))


def test_words_match_a_regular_expression():
    r = random.Random(1)
    texts = ["".join(r.choice("aB \n\té.") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "  ", "x"]
    at, raw = K.buffers(pa.array(texts, pa.string()))
    h, first = K.words(raw, at)
    seen = {}
    for i, t in enumerate(texts):
        want = plain((t or "").encode())
        mine = h[first[i] : first[i + 1]]
        assert len(mine) == len(want)
        for a, b in zip(want, mine, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_long_text_gives_the_same_words():
    t = ("some Words and " * 40_000).encode() + b"y" * (3 * K.SEGMENT) + b" end " + b"z" * K.SEGMENT
    raw = np.frombuffer(t, np.uint8)
    h, _ = K.words(raw, np.array([0, len(t)]))
    assert len(h) == len(plain(t))
    short, _ = K.words(np.frombuffer(b"some words and end", np.uint8), np.array([0, 18]))
    assert list(h[:3]) == list(short[:3]) and h[-2] == short[3]


def test_shingles():
    h, _ = K.words(np.frombuffer(b"a b c d e f a b c d e", np.uint8), np.array([0, 21]))
    assert len(K.shingles(h)) == 6
    assert len(K.shingles(h[:3])) == 1 and len(K.shingles(h[:0])) == 0


def test_a_word_has_one_hash_wherever_it_stands():
    n = K.SEGMENT
    for size in (7, 8, 9, 1000, n - 1, n, n + 1, 2 * n + 3):
        word = bytes(97 + i * i % 26 for i in range(size))
        seen = set()
        for text, k in ((word, 0), (b"ab " + word, 1), (word + b" ab", 0), (b"x" * (n - 3) + b" " + word + b"\ty " + b"z" * n, 1)):
            raw = np.frombuffer(b"pad" + text, np.uint8)
            h, first = K.words(raw, np.array([3, 3 + len(text)]))
            assert len(h) == len(text.split()) and list(first) == [0, len(h)]
            seen.add(int(h[k]))
        assert len(seen) == 1
