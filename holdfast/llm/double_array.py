"""Double-array tries over symbol sequences, built and walked whole arrays at a time in numpy.

A symbol is written as DIGITS base-256 digits, so a node has at most 256 children. A state is a
slot; the child by digit d of state s is slot base[s] + d, and is there if check[slot] is s. Nodes
with many children get 256 slots of their own, largest first; the rest are dropped into the gaps in
rounds, all nodes with one number of children at once, those that collide trying again.
"""

from __future__ import annotations

import numpy as np

RADIX = 256
MANY = 12  # children from which a node gets its own window


def digits_needed(n_symbols: int) -> int:
    return 1 if n_symbols <= RADIX else 2 if n_symbols <= RADIX ** 2 else 3


def split_digits(symbols: np.ndarray, digits: int) -> list[np.ndarray]:
    """The digits of symbols, highest first."""
    return [symbols >> 8 * k & 255 for k in reversed(range(digits))]


def _tree(rows: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(parent, digit) of every node but the root (node 0), children of a node side by side."""
    parents, labels = [np.zeros(1, "i8")], [np.zeros(1, "i8")]
    at, n = np.zeros(len(rows), "i8"), 1
    for column in range(rows.shape[1]):
        there = rows[:, column] >= 0
        rows, at = rows[there], at[there]
        for digit in split_digits(rows[:, column], digits):
            edges, at = np.unique(at * RADIX + digit, return_inverse=True)
            parents.append(edges // RADIX)
            labels.append(edges % RADIX)
            at = at + n
            n += len(edges)
    return np.concatenate(parents), np.concatenate(labels)


class DoubleArray:
    def __init__(self, base: np.ndarray, check: np.ndarray, digits: int):
        self.base, self.check, self.digits = base, check, digits

    @classmethod
    def of(cls, rows: np.ndarray, n_symbols: int) -> DoubleArray:
        """Trie of the rows of symbol numbers; a negative number ends a row early."""
        digits = digits_needed(n_symbols)
        parent, label = _tree(rows, digits)
        kids = np.bincount(parent[1:], minlength=len(parent))
        order = np.argsort(-kids, kind="stable")
        many = order[kids[order] >= MANY]
        few = order[(kids[order] < MANY) & (kids[order] > 0)]
        size = 1 + RADIX * (len(many) + 1) + int(kids[few].sum()) * 3 // 2 + 64
        used = np.zeros(size + RADIX, bool)
        used[0] = True  # the root
        base = np.zeros(len(parent), "i8")
        base[many] = 1 + RADIX * np.arange(len(many))
        by_parent = np.argsort(parent[1:], kind="stable") + 1
        first = np.cumsum(kids) - kids
        own = kids[parent] >= MANY
        own[0] = False
        used[base[parent[own]] + label[own]] = True
        draw = np.random.default_rng(1)
        for k in range(MANY - 1, 0, -1):
            nodes = few[kids[few] == k]
            labels = label[by_parent[first[nodes][:, None] + np.arange(k)]]
            while len(nodes):
                tried = draw.integers(1, size, len(nodes))
                slots = tried[:, None] + labels
                open_ = np.flatnonzero(~used[slots].any(axis=1))
                taker = np.full(size + RADIX, -1, "i4")
                taker[slots[open_].ravel()] = np.repeat(open_, k)
                won = open_[(taker[slots[open_]] == open_[:, None]).all(axis=1)]
                used[slots[won].ravel()] = True
                base[nodes[won]] = tried[won]
                lost = np.ones(len(nodes), bool)
                lost[won] = False
                nodes, labels = nodes[lost], labels[lost]
        state = base[parent] + label
        state[0] = 0
        bases, check = np.zeros(size + RADIX, "i4"), np.full(size + RADIX, -1, "i4")
        bases[state] = base
        check[state[1:]] = state[parent[1:]]
        check[0] = -2
        return cls(bases, check, digits)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more symbol each, and which of the inputs (by place) have one."""
        at = np.arange(len(states))
        for k in reversed(range(self.digits)):
            nxt = self.base[states] + (symbols >> 8 * k & 255)
            there = self.check[nxt] == states
            states, at, symbols = nxt[there], at[there], symbols[there]
        return states, at

    def spell(self, states: np.ndarray, length: int) -> np.ndarray:
        """The symbol numbers on the way to each state, `length` of them."""
        out = np.zeros((len(states), length), "i8")
        for column in reversed(range(length)):
            for k in range(self.digits):
                up = self.check[states]
                out[:, column] |= (states - self.base[up]).astype("i8") << 8 * k
                states = up
        return out
