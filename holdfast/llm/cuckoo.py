"""A cuckoo filter over 64-bit hashes, whole arrays at a time in numpy.

A key's 16-bit fingerprint lies in one of two buckets of four slots; either bucket follows from the
other and the fingerprint, so a full bucket's occupant can move to its other one without its key.
Every key put in holds one slot, so taking it out again leaves the filter as if it had never been
there. There are no false negatives; keys never put in are met with a chance of about 1e-4. Keys
that find no place open a further table of the same size.
"""

from __future__ import annotations

import numpy as np

BUCKETS, SLOTS = 1 << 14, 4
CAPACITY = BUCKETS * SLOTS * 85 // 100  # keys that are sure to find places in one table
TURNS = 200


def _spots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and first bucket of each key."""
    keys = keys.view("u8")
    prints = (keys >> np.uint64(48)).astype("u2")
    return np.maximum(prints, 1), (keys & np.uint64(BUCKETS - 1)).astype("i8")


def _other(prints: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at ^ ((prints.astype("i8") * 0x5BD1E995 >> 7 & BUCKETS - 2) + 1)


def _rank(sorted_values: np.ndarray) -> np.ndarray:
    """Place of each entry among its equals."""
    new = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return np.arange(len(sorted_values)) - np.repeat(new, np.diff(np.append(
        new, len(sorted_values))))


def _place(table: np.ndarray, prints: np.ndarray, at: np.ndarray):
    """Put fingerprints into the table; returns those (and their buckets) left over."""
    draw = np.random.default_rng(len(prints))
    for _ in range(TURNS):
        if not len(prints):
            break
        order = np.argsort(at, kind="stable")
        prints, at = prints[order], at[order]
        rank = _rank(at)
        free = table[at] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, 3)]
        table[at[fits], slot[fits]] = prints[fits]
        prints, at, rank = prints[~fits], at[~fits], rank[~fits]
        # one newcomer a bucket takes a slot of a full bucket; who had it moves on
        lead = np.flatnonzero(np.append(True, at[1:] != at[:-1])[:len(at)])
        taken = draw.integers(0, SLOTS, len(lead))
        bucket = at[lead]
        moved = table[bucket, taken].copy()
        table[bucket, taken] = prints[lead]
        prints[lead] = moved
        at = _other(prints, at)
    return prints, at


class Cuckoo:
    def __init__(self, raw: bytes | None = None):
        flat = np.frombuffer(raw or b"", "u2").copy()
        self.tables = list(flat.reshape(-1, BUCKETS, SLOTS))

    def to_bytes(self) -> bytes:
        return b"".join(t.tobytes() for t in self.tables)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, at = _spots(keys)
        found = np.zeros(len(keys), bool)
        for table in self.tables:
            for bucket in (at, _other(prints, at)):
                found |= (table[bucket] == prints[:, None]).any(axis=1)
        return found

    def insert(self, keys: np.ndarray) -> None:
        prints, at = _spots(keys)
        k = 0
        while len(prints):
            if k == len(self.tables):
                self.tables.append(np.zeros((BUCKETS, SLOTS), "u2"))
            prints, at = _place(self.tables[k], prints, at)
            k += 1

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were put in; equal ones as often as given."""
        prints, at = _spots(keys)
        pair = np.minimum(at, _other(prints, at)) << 16 | prints
        order = np.argsort(pair, kind="stable")
        prints, at, turn = prints[order], at[order], _rank(pair[order]) if len(pair) else pair
        for k in range(int(turn.max(initial=-1)) + 1):
            left, bucket = prints[turn == k], at[turn == k]
            for table in self.tables:
                for _ in range(2):
                    hit = table[bucket] == left[:, None]
                    found = hit.any(axis=1)
                    table[bucket[found], hit.argmax(axis=1)[found]] = 0
                    left, bucket = left[~found], _other(left, bucket)[~found]
