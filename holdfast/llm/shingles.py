"""Word shingles of UTF-8 texts as 64-bit hashes, computed in numpy over Arrow buffers.

A word's hash is a polynomial over its bytes (A-Z lower-cased), finished by a mixer together with
its length; a shingle's hash combines the hashes of its words by position. A text with fewer words
than a shingle has the whole word sequence as its one shingle; a text without words, an empty or a
null one has none. Texts are taken SLICE bytes at a time, a longer one by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
SLICE = 1 << 18

_BASE = 0x5851F42D4C957F2D
_FOLD = np.arange(256, dtype="u1")
_FOLD[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
_PLACE = _mix(np.arange(1, 65, dtype="u8") * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

# Bytes that stand between words: white space only, or everything but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SIGNS = np.ones(256, bool)
SIGNS[48:58] = SIGNS[97:123] = SIGNS[65:91] = SIGNS[128:] = False


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset:][:len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `size` bytes: (from, to)."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1)
        yield k, end
        k = end


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray,
                ) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a text's end also ends a word
    before = np.append(False, inside[:-1])
    after = np.append(inside[1:], False)
    begins = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTE[_FOLD[data]] * _powers(len(data), _BASE), out=sums[1:])
    back = _powers(len(data), pow(_BASE, -1, 1 << 64))
    value = (sums[ends] - sums[begins]) * back[begins]
    words = _mix(value + (ends - begins).astype("u8") * np.uint64(0xA24BAED4963EE407))
    return words, np.diff(np.searchsorted(begins, offsets))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray,
                   width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in text order, number of shingles of each text, repeated ones included)."""
    words, counts = word_hashes(data, offsets, between)
    place = _PLACE[:width]
    edges = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(words) - width + 1)
    value = np.zeros(n, "u8")
    for k in range(width):
        value += words[k:n + k] * place[k]
    owner = np.repeat(np.arange(len(counts)), counts)
    full = owner[:n] == owner[width - 1:] if n else np.zeros(0, bool)
    of, found = owner[:n][full], _mix(value[full])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        sums = np.zeros(len(short), "u8")
        for k in range(width - 1):
            has = counts[short] > k
            sums[has] += words[edges[short[has]] + k] * place[k]
        ones = _mix(sums + counts[short].astype("u8") * np.uint64(0x2545F4914F6CDD1D))
        order = np.argsort(np.concatenate([of, short]), kind="stable")
        of, found = np.concatenate([of, short])[order], np.concatenate([found, ones])[order]
    return found, np.bincount(of, minlength=len(counts)).astype("i8")


def text_sets(column: pa.Array, between: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, offsets = text_buffers(column)
    for a, b in text_slices(offsets):
        own = offsets[a:b + 1]
        found, counts = shingle_hashes(data[own[0]:own[-1]], own - own[0], between, width)
        at = 0
        for n in counts.tolist():
            yield np.unique(found[at:at + n])
            at += n
