"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache
def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids(text: str | None, name: str, end: int) -> np.ndarray:
    found = tokenizer(name).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, end], "<u4")


def pieces(docs, name="word_bpe_49k.json", end=1, capacity=4096):
    for doc_id, text in docs:
        own = ids(text, name, end)
        for k, a in enumerate(range(0, len(own), capacity)):
            part = own[a:a + capacity]
            yield doc_id, k, a, len(part), zlib.crc32(part.tobytes())


def shingles(text: str | None, word: re.Pattern) -> set:
    w = word.findall((text or "").translate(ASCII_LOW))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def items_found(docs, items, share=75):
    held = {i: shingles(t, ALNUM) for i, t in items}
    for d, t in docs:
        own = shingles(t, ALNUM)
        for i, want in held.items():
            n = len(own & want)
            if n and 100 * n >= share * len(want):
                yield d, i, n, len(want)


def near_components(docs):
    """(doc_id, set size, component) by comparing all pairs."""
    sets = [(d, shingles(t, SPACED)) for d, t in docs]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    lowest = {}
    for k, (d, _) in enumerate(sets):
        lowest[find(k)] = min(lowest.get(find(k), d), d)
    return [(d, len(s), lowest[find(k)]) for k, (d, s) in enumerate(sets)]


def quality(text: str | None):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), failed)


def license_base(text: str | None):
    w = ALNUM.findall((text or "").translate(ASCII_LOW))
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl",
               ("all", "rights", "reserved"): "reserved"}
    at = sorted((i, label) for p, label in phrases.items() for i in range(len(w))
                if tuple(w[i:i + len(p)]) == p)
    labels = ",".join(sorted({x for _, x in at}))
    return (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, labels)
