"""MinHash near-duplicates: every link with Jaccard similarity >= t of five-word shingle sets.

Method: multi-index Hamming join. A text's signature is SYMBOLS minima of b = 32 bits each, and
the distance of two signatures is the number of symbols that differ. With CHUNKS chunks and at
most ERRORS differing symbols allowed, some chunk of a close pair has at most ERRORS // CHUNKS
errors (pigeonhole), so the join enumerates, per chunk, every way to leave that many symbols out
and hashes the rest to a key: all pairs within the distance share a key. At Jaccard 0.75 a pair
is further apart than ERRORS = 11 of 16 with probability below 4e-5. Links are confirmed on the
full shingle sets.

Texts with equal sets form one class first, so copies never meet each other in a key. Within a key
no group is expanded into all its pairs:
1. each key has a hub, its most typical member (the one whose keys are shared most); every class
   is compared with one hub only, the one it shares most keys with, and confirmed links are folded
   into components;
2. keys whose members are all in one component are done. In the others, members of different
   components are compared in blocks of bounded size, by signature and by a finer sketch (one
   permutation, BINS bins, cut five deviations below the threshold). For ROUNDS rounds only each
   class's most similar partner outside its component is confirmed and folded in;
3. at last every pair that is still across components and passes is confirmed. This rest is exact,
   whatever the rounds before it left: no group or partner is capped.

Cases: null, empty and wordless texts have an empty set, no links and are kept; texts with fewer
than five words are one shingle; repeated rows share a component; a null id takes the smallest
other id of its component, else null; ties have one result, as only sets and ids decide; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import shingles as sh
from holdfast.llm.components import components, extended
from holdfast.llm.tables import id_and_text, packed_rows
from holdfast.session import few_files, stage

THRESHOLD = 75  # per cent
SYMBOLS, CHUNKS, ERRORS = 16, 4, 11
BINS = 1024
BLOCK = 1024
ROUNDS = 2

_PER = SYMBOLS // CHUNKS
_KEPT = _PER - ERRORS // CHUNKS
#: Which symbols each key is made of.
COMBOS = np.array([[c * _PER + k for k in pick] for c in range(CHUNKS)
                   for pick in combinations(range(_PER), _KEPT)])
_MULTIPLY = sh._mix(np.arange(101, 101 + SYMBOLS, dtype="u8")) | np.uint64(1)
_ADD = sh._mix(np.arange(901, 901 + SYMBOLS, dtype="u8"))
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = (np.arange(BINS, dtype="u8") << _SHIFT)


# ----------------------------------------------------------------------------- profiles
def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, print (digest of the set; null if empty) and sig (bytes)."""
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("print", T.BinaryType()),
                           T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, sigs = [], [], []
            for own in sh.text_sets(batch.column(1), sh.SPACE):
                sizes.append(len(own))
                prints.append(_print(own) if len(own) else None)
                sigs.append(_signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(sigs, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _print(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _signature(own: np.ndarray) -> bytes:
    low = np.empty(SYMBOLS, "u8")
    for a in range(0, len(own), 1 << 16):  # a very long text in parts
        part = (own[None, a:a + (1 << 16)] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1)
        low = np.minimum(low, part) if a else part
    return sh._mix(low).astype("<u4").tobytes()


def _sketch(own: np.ndarray) -> bytes:
    """Per bin of the leading bits, a byte of the smallest hash in it; 0 where there is none."""
    at = np.searchsorted(own, _EDGES)
    first = own[np.minimum(at, len(own) - 1)]
    held = (at < len(own)) & (first >> _SHIFT == np.arange(BINS, dtype="u8"))
    return np.where(held, 1 + sh._mix(first) % np.uint64(255), 0).astype("u1").tobytes()


# -------------------------------------------------------------------------------- keys
def keys(classes: DataFrame) -> DataFrame:
    """(key, combo, node): one row per class and way to leave symbols of a chunk out."""
    salts = sh._mix(np.arange(1, len(COMBOS) + 1, dtype="u8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1), "<u4").astype("u8")
            value = np.tile(salts, (len(sig), 1))
            for k in range(_KEPT):
                value = sh._mix(value * np.uint64(31) + sig[:, COMBOS[:, k]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.ravel().view("i8")),
                 pa.array(np.tile(np.arange(len(COMBOS), dtype="i4"), len(sig))),
                 pa.array(np.repeat(batch.column(0).to_numpy(), len(COMBOS)))],
                names=["key", "combo", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, combo int, node long")


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


# ------------------------------------------------------------------------------ compare
def _near(sig_a, sig_b, n_a, n_b) -> np.ndarray:
    """Which pairs are within the signature distance, and of sizes that can reach the threshold."""
    out = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * THRESHOLD
    return out & ((sig_a == sig_b).sum(axis=1) >= SYMBOLS - ERRORS)


def _margin(x, y, n_a, n_b) -> np.ndarray:
    """By how much the sketches' similarity is above the least one that must be confirmed.

    The m bins in use are a sample of the union without replacement, so the deviation shrinks as
    m nears the union's size (at the threshold (n_a + n_b) / (1 + t)).
    """
    t = THRESHOLD / 100
    m = np.maximum(1, ((x != 0) | (y != 0)).sum(axis=1))
    same = ((x == y) & (x != 0)).sum(axis=1)
    left = np.maximum(0.02, 1 - m * (1 + t) / (n_a + n_b))
    return same / m - t + 5 * np.sqrt(t * (1 - t) / m * left) + 0.02


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked, by signature."""
    one = pairs.join(classes.select(*[F.col(c).alias(c + "_b") for c in ("node", "n", "sig")]
                                    ).withColumnRenamed("node_b", "b"), "b")
    both = one.join(classes.select(*[F.col(c).alias(c + "_a") for c in ("node", "n", "sig")]
                                   ).withColumnRenamed("node_a", "a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _near(*(_matrix(batch.column(c), "<u4") for c in ("sig_a", "sig_b")),
                           *(batch.column(c).to_numpy() for c in ("n_a", "n_b")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(c).to_numpy()[ok]) for c in "ab"], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(
        run, "a long, b long")


def cross_pairs(members: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (a, b) of different components within a key that may be linked.

    members: key, combo, node, comp, n, sig, sketch. Keys with more than BLOCK members are split
    into blocks, and each pair of blocks is a group of its own. best_only: for each a the most
    similar b; else all, each once.
    """
    sizes = members.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "key").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    dealt = dealt.select("key", "low", "high", "own", "combo", "node", "comp", "n", "sig",
                         "sketch")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, margin) of the group's pairs that pass."""
        get = lambda c: table.column(c).to_numpy()
        comp, n, own = get("comp"), get("n"), get("own")
        apart = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        sig = _matrix(table.column("sig").combine_chunks(), "<u4")
        sketch = _matrix(table.column("sketch").combine_chunks(), "u1")
        combo = int(table.column("combo")[0].as_py())
        found = []
        step = max(1, (1 << 16) // len(comp))
        for k in range(0, len(comp), step):
            rows = np.arange(k, min(k + step, len(comp)))
            keep = (rows[:, None] < np.arange(len(comp))) & (comp[rows][:, None] != comp)
            if apart:
                keep &= own[rows][:, None] != own
            i, j = np.nonzero(keep)
            i = rows[i]
            ok = _near(sig[i], sig[j], n[i], n[j])
            i, j = i[ok], j[ok]
            if len(i):  # the first key a pair shares reports it
                first = (sig[i] == sig[j])[:, COMBOS].all(axis=2).argmax(axis=1) == combo
                i, j = i[first], j[first]
            for c in range(0, len(i), 8192):
                a, b = i[c:c + 8192], j[c:c + 8192]
                over = _margin(sketch[a], sketch[b], n[a], n[b])
                pick = over >= 0
                found.append((a[pick], b[pick], over[pick]))
        if not found:
            return (np.zeros(0, "i8"),) * 3
        a, b, over = (np.concatenate(x) for x in zip(*found))
        if best_only and len(a):
            a, b, over = np.append(a, b), np.append(b, a), np.append(over, over)
            order = np.lexsort((b, -over, a))
            order = order[np.append(True, a[order][1:] != a[order][:-1])]
            a, b, over = a[order], b[order], over[order]
        node = get("node")
        return node[a], node[b], over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("key", "low", "high")):
            if table.num_rows > 1:
                a, b, over = compare(table)
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(b), pa.array(over.astype("f8"))],
                        names=["a", "b", "over"])

    pairs = dealt.mapInArrow(run, "a long, b long, over double")
    if not best_only:
        return pairs.select("a", "b")
    return pairs.groupBy("a").agg(F.max(F.struct("over", (-F.col("b")).alias("b"))).alias(
        "best")).select("a", (-F.col("best.b")).alias("b"))


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of sorted rows; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8")
                          for c in by])
        edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(),
                 batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            mark = tuple(marks[:, a])
            if held and mark != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = mark
    if held:
        yield pa.Table.from_batches(held)


# ------------------------------------------------------------------------------ confirm
def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. texts: node, text."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            names, keep = batch.column("b").to_pylist(), []
            # rows come by b; the set of a text that many are compared with is made once
            fresh = [k for k, b in enumerate(names) if k == 0 or b != names[k - 1]]
            sets_b = dict(zip(fresh, sh.text_sets(batch.column("text_b").take(
                pa.array(fresh, pa.int64())), sh.SPACE)))
            for k, set_a in enumerate(sh.text_sets(batch.column("text_a"), sh.SPACE)):
                if k in sets_b:
                    last, known = names[k], sets_b.pop(k)
                both = len(np.intersect1d(set_a, known, assume_unique=True))
                keep.append(100 * both >= THRESHOLD * (len(set_a) + len(known) - both))
            ok = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("a").to_numpy()[ok]),
                 pa.array(batch.column("b").to_numpy()[ok])], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


# ----------------------------------------------------------------------------- operator
def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    ) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs_profile = stage(profiles(docs, id_col, text_col), "profiles")
    # rows of one class have equal sets, so any row's n and sig are the class's
    made = docs_profile.where(F.col("print").isNotNull()).groupBy("print").agg(
        F.min("doc_id").alias("first_id"), F.any_value(F.struct(
            F.col("n_shingles").alias("n"), "sig")).alias("any"))
    classes = stage(few_files(made.select(F.monotonically_increasing_id().alias("node"), "print",
                                          "first_id", "any.*")), "classes")
    comps = near_components(docs, classes, id_col, text_col)
    lowest = classes.select("node", "first_id").join(comps, "node").groupBy("comp").agg(
        F.min("first_id").alias("lowest"))
    named = classes.select("node", "print", "first_id").join(comps, "node", "left").join(
        lowest, "comp", "left").select(
        "print", F.coalesce("lowest", "first_id").alias("component_id"))
    out = docs_profile.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_components(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, comp) of the classes that have a link: exactly the right components."""
    all_keys = stage(keys(classes), "keys")
    crowded = all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(few_files(all_keys.join(crowded, "key")), "shared-keys")
    typical = shared.groupBy("node").agg(F.sum("size").alias("score"))
    scored = shared.select("key", "node").join(typical, "node")
    hubs = scored.groupBy("key").agg(
        F.max(F.struct("score", (-F.col("node")).alias("node"))).alias("hub")).select(
        "key", (-F.col("hub.node")).alias("b"))
    # each class meets the one hub that it shares most keys with
    to_hub = shared.select("key", F.col("node").alias("a")).join(hubs, "key").where(
        "a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("same")).groupBy("a").agg(
        F.max(F.struct("same", (-F.col("b")).alias("b"))).alias("best")).select(
        "a", (-F.col("best.b")).alias("b"))
    star = stage(few_files(promising(to_hub, classes)), "star")

    wanted = shared.select("node").distinct()
    texts = stage(_texts(docs, classes.join(wanted, "node", "left_semi"), id_col, text_col),
                  "near-texts")
    comps = components(stage(confirm(star, texts), "star-links"))
    for _ in range(ROUNDS):
        best = stage(cross_pairs(_members(shared, comps, texts), True), "best-pairs")
        comps = extended(comps, stage(confirm(best, texts), "best-links"))
    rest = stage(cross_pairs(_members(shared, comps, texts), False), "cross-pairs")
    return extended(comps, stage(confirm(rest, texts), "cross-links"))


def _members(shared: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of keys that hold more than one component."""
    placed = shared.select("key", "combo", "node").join(comps, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")
                                          ).where("low < high").select("key")
    return placed.join(open_keys, "key").join(texts.drop("text"), "node")


def _texts(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n, sig, sketch, text) of the given classes, one text each: the row that the class
    was named by."""
    source = id_and_text(docs, id_col, text_col)
    met = source.join(classes.withColumnRenamed("first_id", "_id"),
                      F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "node", "n", "sig", "print", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows of one id come to one task, so repeated rows pass once
        for batch in batches:
            at, sketches = [], []
            for k, (own, digest, node) in enumerate(zip(
                    sh.text_sets(batch.column("text"), sh.SPACE),
                    batch.column("print").to_pylist(), batch.column("node").to_pylist())):
                if node not in seen and len(own) and _print(own) == digest:
                    seen.add(node)
                    at.append(k)
                    sketches.append(_sketch(own))
            at = pa.array(at, pa.int64())
            columns = {c: batch.column(c).take(at) for c in ("node", "n", "sig", "text")}
            columns["sketch"] = pa.array(sketches, pa.binary())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    names = ["node", "n", "sig", "sketch", "text"]
    return met.mapInArrow(run, "node long, n long, sig binary, sketch binary, text string")


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       ) -> DataFrame:
    """One document of each component (the one with the smallest id), with all its columns."""
    kept = link_components(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("first")).distinct()
    return packed_rows(docs, id_col).join(
        kept, F.col("key").eqNullSafe(F.col("first")), "left_semi").select("row.*")
