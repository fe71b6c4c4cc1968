"""Benchmark decontamination: which documents contain a test item.

Method: size-partitioned MinHash containment search. Items are partitioned by their number of
five-word shingles; an item of a partition with sizes up to m keeps its `floor((1 - t) m) + 1`
smallest hashed shingles as its sketch. A document whose shingles cover the share t of an item
misses at most `floor((1 - t) m)` of them, so it holds at least one element of the sketch: the
search has no false negatives, however long the document. Candidates are then confirmed by exact
containment over all their shingles. Words are runs of letters and digits, A-Z lower-cased, so
punctuation around a passage does not hide it.

The benchmark is the small side. Up to `broadcast_shingles` hashes it is sent to the tasks and the
documents are read once, without a shuffle; a larger one is met by a join on the sketch elements.

Cases: null or wordless texts contain nothing, and such items are in nothing; a text of fewer than
five words is one shingle, so a tiny item matches only an equal tiny document; repeated rows are
reported once per (document id, item id); equal items are reported each; empty tables give an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import shingles as sh
from holdfast.llm.tables import id_and_text, packed_rows
from holdfast.session import stage

THRESHOLD = 0.75
BROADCAST_SHINGLES = 2_000_000
COLUMNS = ("n_found", "n_item", "containment")


def size_class(n: int) -> int:
    """Upper size of the partition an item of n shingles belongs to: powers of two."""
    return 1 << max(0, int(n) - 1).bit_length()


def sketch_size(n: int, threshold: float) -> int:
    return min(n, int((1 - threshold) * size_class(n) + 1e-9) + 1)


def item_shingles(benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """item_id, n_item, shingle, in_sketch: one row per distinct shingle of an item."""
    source = id_and_text(benchmark, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    schema = T.StructType([source.schema["item_id"], *[T.StructField(n, t) for n, t in (
        ("n_item", T.LongType()), ("shingle", T.LongType()), ("in_sketch", T.BooleanType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(sh.text_sets(batch.column(1), sh.SIGNS)):
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(n, k))), pa.array(np.full(n, n)),
                     pa.array(own.view("i8")),
                     pa.array(np.arange(n) < sketch_size(n, threshold))], names=schema.names)

    return source.mapInArrow(run, schema).distinct()


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
               broadcast_shingles: int = BROADCAST_SHINGLES, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_found, n_item, containment for every pair at or above the threshold."""
    items = stage(item_shingles(benchmark, threshold), "items")
    source = id_and_text(docs, id_col, text_col)
    if items.count() <= broadcast_shingles:
        found = _by_broadcast(source, items, threshold)
    else:
        found = _by_join(source, items, threshold)
    return found.select("doc_id", "item_id", "n_found", "n_item",
                        (F.col("n_found") / F.col("n_item")).alias("containment")).distinct()


def _by_broadcast(source: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    rows = items.orderBy("shingle", "item_id").toArrow()
    item_type = items.schema["item_id"]
    names = rows.column("item_id").combine_chunks().dictionary_encode()
    item = names.indices.fill_null(len(names.dictionary)).to_numpy()
    label = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)])
    size = np.zeros(len(label), "i8")
    size[item] = rows.column("n_item").to_numpy()
    hashed = rows.column("shingle").to_numpy().view("u8")
    order = np.argsort(hashed, kind="stable")
    hashed, item = hashed[order], item[order]
    chosen = np.unique(hashed[rows.column("in_sketch").to_numpy()[order]])
    shared = source.sparkSession.sparkContext.broadcast((hashed, item, size, label, chosen))
    schema = T.StructType([source.schema["doc_id"], item_type,
                           T.StructField("n_found", T.LongType()),
                           T.StructField("n_item", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, item, size, label, chosen = shared.value
        hint = np.zeros(1 << 22, bool)  # first test: leading bits of the sketch elements
        hint[chosen >> np.uint64(42)] = True
        for batch in batches:
            data, offsets = sh.text_buffers(batch.column(1))
            for a, b in sh.text_slices(offsets):
                own = offsets[a:b + 1]
                found, counts = sh.shingle_hashes(data[own[0]:own[-1]], own - own[0], sh.SIGNS)
                edges = np.concatenate([[0], np.cumsum(counts)])
                at = np.flatnonzero(hint[found >> np.uint64(42)])
                at = at[np.isin(found[at], chosen)]
                rows = []
                for k in np.unique(np.searchsorted(edges, at, "right") - 1).tolist():
                    held = np.unique(found[edges[k]:edges[k + 1]])
                    hits = item[np.isin(hashed, held)]
                    n = np.bincount(hits, minlength=len(size))
                    rows += [(a + k, i, n[i]) for i in np.flatnonzero(
                        (n > 0) & (n >= threshold * size - 1e-9)).tolist()]
                if rows:
                    doc, which, n = (np.array(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc)), label.take(pa.array(which)),
                         pa.array(n), pa.array(size[which])], names=schema.names)

    return source.mapInArrow(run, schema)


def _by_join(source: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for a benchmark too large to broadcast."""
    schema = T.StructType([source.schema["doc_id"], T.StructField("row", T.LongType()),
                           T.StructField("shingle", T.LongType())])
    numbered = stage(source.withColumn("row", F.monotonically_increasing_id()), "numbered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(sh.text_sets(batch.column(1), sh.SIGNS)):
                at = pa.array(np.full(len(own), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at),
                     pa.array(own.view("i8"))], names=schema.names)

    held = numbered.mapInArrow(run, schema)
    sketch = items.where("in_sketch").select("shingle", "item_id", "n_item")
    pairs = held.join(sketch, "shingle").select("row", "doc_id", "item_id", "n_item").distinct()
    pairs = stage(pairs, "pairs")
    near = held.join(pairs.select("row").distinct(), "row", "left_semi")
    wanted = near.join(items.select("shingle", "item_id"), "shingle").select("row", "item_id")
    # null item ids have to meet each other
    joined = wanted.alias("w").join(pairs.alias("p"), (F.col("w.row") == F.col("p.row"))
                                    & F.col("w.item_id").eqNullSafe(F.col("p.item_id")))
    counted = joined.groupBy("p.row", "p.doc_id", "p.item_id", "p.n_item").agg(
        F.count(F.lit(1)).alias("n_found"))
    return counted.where(F.col("n_found") >= threshold * F.col("n_item") - 1e-9).select(
        "doc_id", "item_id", "n_found", "n_item")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = find_items(docs, benchmark, threshold, id_col=id_col, text_col=text_col)
    bad = found.select(F.col("doc_id").alias("bad")).distinct()
    return packed_rows(docs, id_col).join(
        bad, F.col("key").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
