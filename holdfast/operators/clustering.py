"""Weighted k-means of many resamples, starts and cluster counts in the same passes.

A run is one (cluster count, resample, start). Starts are drawn by squared distance: in one pass per
centre every run keeps the point with the largest key log(u) / (weight x squared distance), which is
an exact weighted draw that tasks can combine by their maximum. Every Lloyd step is one pass that
sums weights and points by run and nearest centre; runs whose centres stand still drop out. What
comes back per pass has the size of the centres. Per (count, resample) the start of least cost stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

STEPS = 300
STILL = 1e-9  # largest move of a centre that ends a run


@dataclass(frozen=True)
class Run:
    k: int
    resample: int
    start: int


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys.view("u8") ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("f8") / float(1 << 53)


def _passed(points: DataFrame, work: Callable, combine: Callable) -> list:
    """work(x, w, keys) -> arrays, per batch; combined over batches, then over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(
                    batch.num_rows, -1) for c in ("x", "w")]
                new = work(*flat, batch.column("key").to_numpy())
                total = new if total is None else combine(total, new)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([[v.tobytes() for v in total]], pa.list_(pa.binary()))], names=["sums"])

    return [[np.frombuffer(v) for v in row["sums"]]
            for row in points.select("x", "w", "key").mapInArrow(
                run, "sums array<binary>").collect()]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def _starts(points: DataFrame, runs: Sequence[Run], seed: int, d: int) -> list[np.ndarray]:
    centres = [np.zeros((0, d)) for _ in runs]
    for turn in range(max(r.k for r in runs)):
        open_ = [(i, centres[i]) for i, r in enumerate(runs) if r.k > turn]

        def best(x: np.ndarray, w: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
            out = []
            for i, held in open_:
                run = runs[i]
                far = _distances(x, held).min(axis=1) if len(held) else np.ones(len(x))
                u = _uniform(keys, seed + 104729 * turn + 7919 * run.start + run.resample + 31 * run.k)
                with np.errstate(divide="ignore"):
                    key = np.log(np.maximum(u, 1e-300)) / (w[:, run.resample] * far)
                key[w[:, run.resample] * far <= 0] = -np.inf
                at = int(np.argmax(key))
                out.append(np.concatenate([[key[at]], x[at]]))
            return [np.stack(out)]

        def larger(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
            return [np.where((a[0][:, :1] >= b[0][:, :1]), a[0], b[0])]

        found = [[v[0].reshape(len(open_), d + 1)] for v in _passed(points, best, larger)]
        top = found[0][0] if found else np.full((len(open_), d + 1), -np.inf)
        for other in found[1:]:
            top = larger([top], other)[0]
        for (i, held), row in zip(open_, top):
            # fewer distinct points than centres: the rest stand on the last one
            new = row[1:] if np.isfinite(row[0]) else (held[-1] if len(held) else np.zeros(d))
            centres[i] = np.vstack([held, new])
    return centres


def weighted_kmeans(points: DataFrame, counts: Sequence[int], n_resamples: int, seed: int,
                    starts: int = 10) -> dict[tuple[int, int], np.ndarray]:
    """Centres by (k, resample). points: x array<double>, w array<double> with one weight for each
    resample, key long. Read once per pass, so hand over a stored table."""
    head = points.select(F.size("x")).first()
    if head is None:
        return {}
    d = head[0]
    runs = [Run(k, r, s) for k in counts for r in range(n_resamples) for s in range(starts)]
    centres = _starts(points, runs, seed, d)
    cost = np.full(len(runs), np.inf)
    moving = list(range(len(runs)))
    for _ in range(STEPS):
        going = [(i, centres[i]) for i in moving]

        def step(x: np.ndarray, w: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
            out = []
            for i, held in going:
                far = _distances(x, held)
                at, weight = far.argmin(axis=1), w[:, runs[i].resample]
                sums = np.zeros((len(held), d + 2))
                sums[:, 0] = np.bincount(at, weight, len(held))
                sums[:, 1] = np.bincount(at, weight * far[np.arange(len(x)), at], len(held))
                for c in range(d):
                    sums[:, 2 + c] = np.bincount(at, weight * x[:, c], len(held))
                out.append(sums)
            return out

        parts = _passed(points, step, lambda a, b: [p + q for p, q in zip(a, b)])
        still = []
        for at, (i, held) in enumerate(going):
            sums = sum(p[at] for p in parts).reshape(len(held), d + 2)
            cost[i] = sums[:, 1].sum()
            full = sums[:, 0] > 0
            new = held.copy()
            new[full] = sums[full, 2:] / sums[full, :1]
            if np.abs(new - held).max() > STILL:
                still.append(i)
            centres[i] = new
        moving = still
        if not moving:
            break
    best: dict[tuple[int, int], int] = {}
    for i, r in enumerate(runs):
        at = (r.k, r.resample)
        if at not in best or cost[i] < cost[best[at]]:
            best[at] = i
    return {at: centres[i] for at, i in best.items()}


def nearest(x: Column, centres: Sequence[np.ndarray]) -> Column:
    """Array with the number of the nearest centre of each set; the first of equal ones."""
    held = [np.array(c) for c in centres]

    def label(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        rows = np.stack(values.to_numpy())
        return pd.Series(list(np.stack([_distances(rows, c).argmin(axis=1) for c in held], axis=1)))

    return F.pandas_udf(label, ArrayType(LongType()))(x)
