"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: pattern packing by non-negative least squares. The histogram of piece lengths is the only
thing the driver sees (at most `capacity` numbers). Patterns of a few lengths that fill a sequence
but for at most capacity / SLACK tokens are enumerated, repeat counts are fitted to the histogram by
non-negative least squares and rounded (whole parts first, then the largest remainders), as far as
the histogram holds the patterns' pieces; lengths that are left are fitted again. What no pattern
takes is packed best-fit-decreasing, still on the histogram. Pieces then
look up their place: a piece's rank among the pieces of its length says which pattern slot, and
which repeat of the pattern, it takes. No task ever holds the pieces of one length.

Cases: a null text counts as empty and becomes one piece of the end id alone; a text longer than
the capacity is cut into full pieces and one last piece; repeated rows are packed as often as they
occur, null ids included; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.tables import id_and_text
from holdfast.llm.tokens import encoder, text_groups
from holdfast.session import stage

CAPACITY = 4096
PARTNERS = 24  # second lengths tried for each first length
DEEPEST = 12  # lengths in a pattern at most
ROUNDS = 200  # of the least-squares fit at most
CLOSE = 1e-4  # change of the residual at which it ends
FITS = 2  # fits on what is left, at most
SLACK = 1024

Run = tuple[int, int]  # (length, how often in a row)
Pattern = tuple[Run, ...]


# ------------------------------------------------------------------------------ pieces
def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY,
                     spaced: bool = False, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per piece of a document's ids: doc_id, piece, start, length, ids_crc32, and its
    place (part, k): the k-th piece of its length in write task `part`."""
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([source.schema["doc_id"], *[
        T.StructField(n, t) for n, t in (
            ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
            ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("k", T.LongType()))]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                flat, counts = encoder(vocabulary, spaced).ids(texts[a:b])
                of, rows, at = [], [], 0
                for row, n in enumerate(counts.tolist()):
                    ids = np.append(flat[at:at + n], end_id).astype("<u4")
                    at += n
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        own = ids[start:start + capacity]
                        of.append(a + row)
                        rows.append((piece, start, len(own), zlib.crc32(own.tobytes()), part,
                                     int(seen[len(own)])))
                        seen[len(own)] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of, pa.int64())), *columns],
                    names=schema.names)

    return source.mapInArrow(cut, schema)


# ---------------------------------------------------------------------- patterns, driver
def enumerate_patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of a few lengths: each length as the longest, with partners spread over the
    shorter ones, then the longest that still fits until nothing does."""
    found = set()
    for first in lengths[::-1].tolist():
        room = capacity - first
        top = int(np.searchsorted(lengths, min(first, room), "right"))
        picks = np.unique(np.linspace(0, top - 1, PARTNERS).round().astype(int)) if top else []
        if not len(picks):
            found.add((first,))
        for second in lengths[picks].tolist() if len(picks) else []:
            pattern, left = [first, second], room - second
            while len(pattern) < DEEPEST and left >= lengths[0]:
                pattern.append(int(lengths[np.searchsorted(lengths, left, "right") - 1]))
                left -= pattern[-1]
            found.add(tuple(sorted(pattern, reverse=True)))
    return sorted(found)


def fit_repeats(patterns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray,
                capacity: int) -> np.ndarray:
    """x >= 0 that brings the patterns' total lengths near the histogram, in weighted least
    squares; multiplicative steps keep x non-negative. Lengths weigh by their tokens: short
    pieces fill gaps later anyway."""
    row = np.concatenate([np.searchsorted(lengths, p) for p in patterns])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    weight = lengths / capacity
    add = lambda at, values, n: np.bincount(at, values, n)
    want = add(col, (weight * counts)[row], len(patterns))
    waste = np.array([capacity - sum(p) for p in patterns]) / capacity
    x = np.full(len(patterns), counts.sum() / max(1, len(row)))
    before = np.inf
    for _ in range(ROUNDS):
        have = add(row, x[col], len(lengths))
        residual = float((weight * (have - counts) ** 2).sum())
        if before - residual < CLOSE * residual:
            break
        before = residual
        x *= want / (add(col, (weight * have)[row], len(patterns)) * (1 + waste) + 1e-12)
    return x


def take_patterns(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """One fit on the histogram `left`; what its rounded repeats use is taken out of it."""
    lengths = np.array(sorted(left))
    counts = np.array([left[k] for k in lengths.tolist()], float)
    patterns = [p for p in enumerate_patterns(lengths, capacity)
                if len(p) > 1 and sum(p) >= capacity - capacity // SLACK]
    if not patterns:
        return []
    fitted = fit_repeats(patterns, lengths, counts, capacity)
    whole = np.floor(fitted)
    # fuller patterns first among equal remainders, so that gaps stay few
    full = np.array([sum(p) for p in patterns])
    taken: dict[int, int] = {}
    for order, times in ((np.lexsort((-full, -whole)), whole),
                         (np.lexsort((-full, whole - fitted)), np.ones(len(whole)))):
        for k in order.tolist():
            n = int(times[k])
            if not n:
                break
            need = [(x, patterns[k].count(x)) for x in dict.fromkeys(patterns[k])]
            n = min(n, *(left.get(x, 0) // m for x, m in need))
            if n:
                taken[k] = taken.get(k, 0) + n
                for x, m in need:
                    left[x] -= n * m
                    if not left[x]:
                        del left[x]
    return [(tuple((x, patterns[k].count(x)) for x in dict.fromkeys(patterns[k])), n)
            for k, n in taken.items()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are one group with a count."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            fits = room // length
            if at == len(rooms):
                pattern, have = (), max(1, left // fits)
            else:
                pattern, have = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            full = min(have, left // fits)
            if full:
                put(room - fits * length, (*pattern, (length, fits)), full)
                left -= full * fits
            if full < have:
                take = left  # less than one bin's fill
                if take:
                    put(room - take * length, (*pattern, (length, take)), 1)
                    left = 0
                rest = have - full - (1 if take else 0)
                if rest and pattern:
                    put(room, pattern, rest)
    return [x for lot in groups.values() for x in lot]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that together hold exactly the pieces of the histogram."""
    left = {k: n for k, n in histogram.items() if n > 0}
    planned = []
    if capacity in left:
        planned.append((((capacity, 1),), left.pop(capacity)))
    for _ in range(FITS):
        found = take_patterns(left, capacity) if left else []
        if not found:
            break
        planned += found
    return planned + best_fit(left, capacity)


def slot_table(planned: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, sequences before, offset in the sequence, places per sequence),
    sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in planned:
        offset = 0
        for length, often in pattern:
            rows.append((length, rank.get(length, 0), sequence, offset, often))
            rank[length] = rank.get(length, 0) + times * often
            offset += length * often
        sequence += times
    return np.array(sorted(rows), "i8").reshape(-1, 5)


# ----------------------------------------------------------------------------- operator
def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to staged pieces (columns length, part, k; length <= capacity).

    The slot table is broadcast: it has at most `PARTNERS` rows per length of the histogram and
    place in a pattern, so its size depends on the capacity, never on the corpus.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    per_part = stage(per_part.select(
        "part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
        "pack-counts")
    histogram = {r["length"]: r["n"] for r in
                 per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(
        slot_table(plan_sequences(histogram, capacity)))
    kept = [c for c in pieces.columns if c not in ("part", "k")]
    placed = pieces.join(per_part.drop("n"), ["part", "length"]).select(
        *kept, (F.col("before") + F.col("k")).alias("rank"))
    schema = T.StructType([*[placed.schema[c] for c in kept],
                           T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    shift = 1 << 44  # ranks stay below; lengths take the bits above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset, often = table.value.T
        key = length * shift + first
        for batch in batches:
            own = batch.column("length").to_numpy(zero_copy_only=False).astype("i8")
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype("i8")
            at = np.searchsorted(key, own * shift + rank, "right") - 1
            step = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 pa.array(sequence[at] + step // often[at]),
                 pa.array(offset[at] + step % often[at] * own)], names=schema.names)

    return placed.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY,
                   spaced: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenised_pieces(docs, vocabulary, end_id, capacity, spaced, id_col, text_col)
    packed = pack(stage(pieces, "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                         "offset")
