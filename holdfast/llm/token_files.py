"""Token ids as files: frequency-ranked, byte-aligned variable-length integers.

Format. A dataset is a folder with two Parquet tables. `ranks` holds one row per id in use,
ordered by falling corpus frequency: rank 0 is the commonest id. `blocks` holds runs of
documents in ascending id order; a block has its file part, its number there, the ids before it in
the part, the documents' ids and token counts, one control byte per four tokens and the payload.
A control byte holds four two-bit widths (bytes less one, lowest pair first); the payload holds the
ranks, little-endian, in those widths. A reader looks each control byte up in 256-row tables for
its four widths and their sum, so decoding is table lookups and one gather in numpy.

Scale: ids are staged once, counted by partial sums, range-partitioned by document id (equal ids
spread by a salt) and encoded partition by partition. The driver sees the rank table (bounded by
the vocabulary) and one token total per file part.

Cases: a null text is empty and holds the end id alone; null document ids sort first; repeated
rows are written as often as they occur; an empty table gives an empty dataset; further columns
are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.tables import id_and_text
from holdfast.llm.tokens import encoder, text_groups
from holdfast.session import shared_dir, stage

BLOCK_TOKENS = 1 << 18
PART_TOKENS = 1 << 26

# byte widths of the four tokens of each control byte, and where each begins
WIDTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
BEGINS = np.cumsum(WIDTHS, axis=1) - WIDTHS
TOTALS = WIDTHS.sum(axis=1)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, payload) of non-negative ranks below 2^32."""
    ranks = np.asarray(ranks, "<u4")
    more = sum((ranks > edge).view("u1") for edge in (0xFF, 0xFFFF, 0xFFFFFF))
    pairs = np.append(more, np.zeros(-len(ranks) % 4, "u1")).reshape(-1, 4)
    control = pairs[:, 0] | pairs[:, 1] << 2 | pairs[:, 2] << 4 | pairs[:, 3] << 6
    bytes4 = ranks.view("u1").reshape(-1, 4)
    return control.tobytes(), bytes4[np.arange(4, dtype="u1") <= more[:, None]].tobytes()


def decode(control: bytes, payload: bytes, n: int) -> np.ndarray:
    """The n ranks of one encode()."""
    keys = np.frombuffer(control, "u1")
    ends = np.cumsum(TOTALS[keys])
    begin = ((ends - TOTALS[keys])[:, None] + BEGINS[keys]).ravel()[:n]
    width = WIDTHS[keys].ravel()[:n]
    data = np.append(np.frombuffer(payload, "u1"), np.zeros(4, "u1"))
    out = data[begin].astype("<u4")
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        out[more] |= data[begin[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


# ------------------------------------------------------------------------------- writing
def id_type_of(vocabulary: str, end_id: int, spaced: bool = True) -> str:
    """Two bytes an id where the whole vocabulary fits into them, else four."""
    largest = max(encoder(vocabulary, spaced).largest_id, end_id)
    return "<u2" if largest <= 0xFFFF else "<u4"


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool = True,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids (end id last) as little-endian bytes of `id_type_of` the vocabulary."""
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    kind = np.dtype(id_type_of(vocabulary, end_id, spaced))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                flat, counts = encoder(vocabulary, spaced).ids(texts[a:b])
                ids = np.insert(flat.astype(kind), np.cumsum(counts), end_id)
                ends = np.append(0, np.cumsum(counts + 1)) * kind.itemsize
                rows = pa.Array.from_buffers(pa.binary(), b - a, [
                    None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows],
                                                 names=schema.names)

    return source.mapInArrow(run, schema)


def _flat_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and where each row's begin (and the last one's end)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], "i8")[column.offset:][:len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[at[0]:at[-1]].view(kind)
    return data, (at - at[0]) // np.dtype(kind).itemsize


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """How often each id occurs in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, "i8")
        for batch in batches:
            own = np.bincount(_flat_ids(batch.column(0), kind)[0])
            total, own = (total, own) if len(total) >= len(own) else (own, total)
            total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])],
                                         names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int,
                      spaced: bool = True, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Write the whole dataset to `folder` in ascending document id order."""
    spark = docs.sparkSession
    ids = stage(token_ids(docs, vocabulary, end_id, spaced, id_col, text_col), "token-ids")
    stored = id_type_of(vocabulary, end_id, spaced)
    counted = [(r["id"], r["n"]) for r in id_counts(ids, stored).collect()]
    order = sorted(counted, key=lambda x: (-x[1], x[0]))
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(order)],
                          "rank long, id long, n long").coalesce(1).write.parquet(
        f"{folder}/ranks")
    rank_of = np.zeros(max((i for i, _ in order), default=0) + 1, "u4")
    rank_of[[i for i, _ in order]] = np.arange(len(order))
    known = spark.sparkContext.broadcast(rank_of)
    kind = ids.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("before", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
        T.StructField("control", T.BinaryType()), T.StructField("payload", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held, names, sizes, tokens = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held, names, sizes, tokens
            control, payload = encode(known.value[np.concatenate(held)])
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]),
                pa.array([names], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([control]), pa.array([payload])], names=schema.names)
            block, before = block + 1, before + tokens
            held, names, sizes, tokens = [], [], [], 0
            return out

        for batch in batches:
            id_type = batch.column(0).type
            flat, at = _flat_ids(batch.column(1), stored)
            at = at.tolist()
            for name, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                held.append(flat[a:b])
                names.append(name)
                sizes.append(b - a)
                tokens += b - a
                if tokens >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    # parts follow the corpus: about PART_TOKENS each, and no fewer than other exchanges have
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
            -(-sum(n for _, n in counted) // PART_TOKENS))
    # rows of one repeated id are alike for the result, so a salt may order and spread them
    ordered = ids.withColumn("salt", F.xxhash64("ids", F.monotonically_increasing_id()))
    ordered = ordered.repartitionByRange(n, F.asc_nulls_first("doc_id"), "salt")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "salt").drop("salt")
    ordered.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(
        f"{folder}/blocks")


# ------------------------------------------------------------------------------- reading
def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids as an array, if asked) of each document,
    decoded from the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # bounded by the vocabulary
    id_of = np.zeros(len(ranks) + 1, "<u4")
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    stored = spark.read.parquet(f"{folder}/blocks")
    base, at = {}, 0
    for r in stored.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"),
                                               lambda a, x: a + x).alias("n")).groupBy(
            "part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base[r["part"]] = at
        at += r["n"]
    known = spark.sparkContext.broadcast((id_of, base))
    schema = T.StructType([
        T.StructField("doc_id", stored.schema["doc_ids"].dataType.elementType),
        *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")],
        *([T.StructField("ids", T.ArrayType(T.LongType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = known.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                sizes = row["n_tokens"].values.to_numpy()
                found = table[decode(row["control"].as_py(), row["payload"].as_py(),
                                     int(sizes.sum()))]
                ends = np.cumsum(sizes)
                starts = ends - sizes
                own = [found[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                begin = first[row["part"].as_py()] + row["before"].as_py()
                columns = [row["doc_ids"].values, pa.array(begin + starts), pa.array(sizes),
                           pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                if ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return stored.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, spaced: bool = True,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, vocabulary, end_id, spaced, id_col, text_col)
    return read_token_files(docs.sparkSession, folder)
