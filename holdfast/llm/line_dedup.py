"""Reversible line deduplication: sharded cuckoo filters before exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least
MIN_CHARS code points count. A key found in at least MIN_DOCS documents loses its lines everywhere
but in the document with the largest id. An index holds, under one folder, in generations:

* `refs`: one row for each (key, document) pair, the references;
* `keys`: for each key a generation touched, the documents that hold it and the largest of them;
* `filters`: a cuckoo filter per shard of key space over the keys now held (see `cuckoo`);
* `gone`, `docs`: ids of documents taken out or put in.

Inserting a batch probes the filters first. A key they don't know is new and needs no look at the
stored counts; the others, true or false hits, are joined with them, so counts stay exact. Keys
that are new go into the filters. Deleting documents recounts their keys from the references that
remain and takes keys without any out of the filters. So an index after deletions decides as one
that never held the documents, and they can be put in again.

Scale: references are made distinct on (key, document), so a line of a third of all documents is
spread; its count and largest id are partial sums. Keys, not lines, meet the filters: a shard has
one row for each key, and shards double when they fill up. Keys held by more than 1/HEAVY of all
references are at most HEAVY; they are broadcast, so the join that tells documents their lines
never gathers a hot key. A key is a 128-bit digest.

Cases: a null or empty text is one empty line; a null id holds no reference, and its row keeps all
lines; rows of one id are one document; an id already held is left as it is by `insert`, an unknown
one by `delete`; empty batches change nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.cuckoo import CAPACITY, Cuckoo
from holdfast.llm.tables import id_and_text
from holdfast.session import stage

MIN_CHARS, MIN_DOCS = 20, 3
WHITE = b" \t\n\v\f\r"
LEAST_SHARDS = 16
HEAVY = 100_000
KEY = ["hi", "lo"]


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a UTF-8 line's key; None if the key is too short to count."""
    key = line.strip(WHITE).lower()  # bytes: ASCII letters only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return md5(key, usedforsecurity=False).digest()


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo): the distinct keys of each row's lines."""
    rows = docs.where(F.col("doc_id").isNotNull())
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{line_key(line, min_chars) for line in raw.split(b"\n")} - {None}
                     for raw in _bytes(batch.column(1))]
            keys = np.frombuffer(b"".join(k for own in found for k in own), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(found)), [len(own) for own in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(keys[:, 0].copy()),
                 pa.array(keys[:, 1].copy())], names=["doc_id", *KEY])

    return rows.mapInArrow(run, f"doc_id {id_type}, hi long, lo long")


class LineIndex:
    """An index under `folder`, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS):
        self.spark, self.folder = spark, folder
        self.min_docs, self.min_chars = min_docs, min_chars
        self.generation, self.shards, self.n_keys, self.n_refs = 0, LEAST_SHARDS, 0, 0
        self.written: dict[str, list[int]] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index as its last finished change left it."""
        last = spark.read.parquet(f"{folder}/state").orderBy(F.desc("generation")).first()
        index = cls(spark, folder, last["min_docs"], last["min_chars"])
        index.generation, index.shards = last["generation"], last["shards"]
        index.n_keys, index.n_refs = last["n_keys"], last["n_refs"]
        index.written = {k: list(v) for k, v in last["written"].items()}
        return index

    # --------------------------------------------------------------------------- tables
    def _write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{self.generation}"
        df.write.mode("overwrite").parquet(path)  # what an unfinished change left goes
        self.written.setdefault(name, []).append(self.generation)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, name: str) -> DataFrame | None:
        """All generations of a table, with column `gen`."""
        out = None
        for g in self.written.get(name, []):
            one = self.spark.read.parquet(f"{self.folder}/{name}/{g}").withColumn("gen", F.lit(g))
            out = out.unionByName(one) if out is not None else one
        return out

    def _commit(self) -> None:
        written = F.map_from_entries(F.array(*[
            F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v"))
            for k, v in self.written.items()]))
        self.spark.range(1).select(
            F.lit(self.generation).alias("generation"), F.lit(self.shards).alias("shards"),
            F.lit(self.n_keys).cast("long").alias("n_keys"),
            F.lit(self.n_refs).cast("long").alias("n_refs"),
            F.lit(self.min_docs).alias("min_docs"), F.lit(self.min_chars).alias("min_chars"),
            written.alias("written")).write.mode("append").parquet(f"{self.folder}/state")

    def _latest(self, name: str, by: list[str], *values: str) -> DataFrame | None:
        """Rows of the last generation that wrote each key."""
        rows = self._read(name)
        if rows is None or len(self.written[name]) == 1:
            return rows
        return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "gen").alias("x")).select(
            *by, *[F.col(f"x.{v}") for v in values])

    def keys(self) -> DataFrame | None:
        """(hi, lo, n, top) of every key some document holds: the exact counts."""
        rows = self._latest("keys", KEY, "n", "top")
        return rows if rows is None else rows.where("n > 0")

    def _live(self, name: str) -> DataFrame:
        """Rows of `refs` or `docs` whose document was not taken out since."""
        rows, gone = self._read(name), self._read("gone")
        if gone is None:
            return rows
        last = gone.groupBy("doc_id").agg(F.max("gen").alias("out"))
        return rows.join(last, "doc_id", "left").where("out IS NULL OR gen > out").drop("out")

    # -------------------------------------------------------------------------- filters
    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.col("hi").bitwiseAND(F.lit(self.shards - 1)))

    def _filters(self) -> DataFrame:
        rows = self._latest("filters", ["shard", "of"], "slots")
        if rows is None:
            return self.spark.createDataFrame([], "shard long, slots binary")
        return rows.where(F.col("of") == self.shards).select("shard", "slots")

    def _probe(self, keys: DataFrame) -> DataFrame:
        """Keys with `maybe`: false where the filters are sure that no document holds the key."""
        def run(own: pa.Table, filters: pa.Table) -> pa.Table:
            raw = filters["slots"][0].as_py() if len(filters) else None
            known = Cuckoo(raw).has(own["lo"].to_numpy())
            return own.append_column("maybe", pa.array(known))

        rows = self._sharded(keys)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(
            run, f"{schema}, maybe boolean").drop("shard")

    def _update_filters(self, put: DataFrame | None, out: DataFrame | None,
                        rebuild: bool = False) -> None:
        of = self.shards

        def run(own: pa.Table, filters: pa.Table) -> pa.Table:
            kept = Cuckoo(filters["slots"][0].as_py() if len(filters) else None)
            new = own["put"].to_numpy()
            keys = own["lo"].to_numpy()
            kept.delete(keys[~new])
            kept.insert(keys[new])
            shard = own["shard"][:1]  # none where nothing changes: the stored filter stays
            return pa.table([shard, pa.array([of] * len(shard), pa.int64()),
                             pa.array([kept.to_bytes()] * len(shard), pa.binary())],
                            names=["shard", "of", "slots"])

        old = self._filters().limit(0) if rebuild else self._filters()
        rows = [df.select(*KEY, F.lit(flag).alias("put"))
                for df, flag in ((put, True), (out, False)) if df is not None]
        keys = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        touched = self._sharded(keys).groupBy("shard").cogroup(old.groupBy("shard"))
        self._write("filters", touched.applyInArrow(run, "shard long, of long, slots binary"))

    # -------------------------------------------------------------------------- changes
    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Put in the documents that are not held."""
        docs = id_and_text(docs, id_col, text_col)
        known = self.keys()
        ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        refs = references(docs, self.min_chars).distinct()
        if known is not None:  # narrow rows meet the held ids; texts stay where they are
            held_ids = self._live("docs").select("doc_id").distinct()
            ids = ids.join(held_ids, "doc_id", "left_anti")
            refs = refs.join(held_ids, "doc_id", "left_anti")
        self.generation += 1
        refs = self._write("refs", refs.select("doc_id", *KEY))
        self._write("docs", ids)
        touched = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"),
                                         F.max("doc_id").alias("top"))
        if known is None:
            changed = touched.withColumn("fresh", F.lit(True))
        else:
            probed = stage(self._probe(touched), "probed")
            held = known.select(*KEY, F.col("n").alias("n0"), F.col("top").alias("top0"))
            hits = probed.where("maybe").join(held, KEY, "left").select(
                *KEY, (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"),
                F.greatest("top", "top0").alias("top"), F.col("n0").isNull().alias("fresh"))
            changed = probed.where("NOT maybe").select(
                *KEY, "n", "top", F.lit(True).alias("fresh")).unionByName(hits)
        changed = self._write("keys", changed)
        self.n_refs += refs.count()
        self.n_keys += changed.where("fresh").count()
        if self.n_keys > self.shards * CAPACITY:
            while self.n_keys > self.shards * CAPACITY * 3 // 4:
                self.shards *= 2
            self._update_filters(self.keys(), None, rebuild=True)
        else:
            self._update_filters(changed.where("fresh"), None)
        self._commit()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take out the documents of these ids, as if they had never been put in."""
        if not self.generation:
            return
        gone = stage(ids.select(F.col(id_col).alias("doc_id")).distinct().join(
            self._live("docs").select("doc_id").distinct(), "doc_id", "left_semi"), "gone")
        self.generation += 1
        live = stage(self._live("refs").select("doc_id", *KEY), "refs")
        leaving = live.join(gone, "doc_id", "left_semi")
        touched = leaving.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_out"))
        staying = live.join(gone, "doc_id", "left_anti").groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        changed = self._write("keys", touched.join(staying, KEY, "left").select(
            *KEY, F.coalesce("n", F.lit(0)).alias("n"), "top", F.lit(False).alias("fresh")))
        self.n_refs -= leaving.count()
        self._write("gone", gone)
        emptied = changed.where("n = 0")
        self.n_keys -= emptied.count()
        self._update_filters(None, emptied)
        self._commit()

    # ------------------------------------------------------------------------ decisions
    def droppings(self) -> DataFrame:
        """(doc_id, hi, lo): the lines a held document loses."""
        repeated = stage(self.keys().where(F.col("n") >= self.min_docs), "repeated")
        heavy = F.col("n") * HEAVY >= self.n_refs
        refs = self._live("refs").select("doc_id", *KEY)
        few = F.broadcast(repeated.where(heavy).select(*KEY, F.col("top").alias("heavy_top")))
        seen = refs.join(few, KEY, "left")
        rare = repeated.where(~heavy).select(*KEY, "top")
        return seen.where("heavy_top IS NOT NULL AND doc_id <> heavy_top").select(
            "doc_id", *KEY).unionByName(
            seen.where("heavy_top IS NULL").join(rare, KEY).where("doc_id <> top").select(
                "doc_id", *KEY))

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
        """doc_id, text (lines kept, joined by \\n), n_lines (before) and n_dropped of each row."""
        docs = id_and_text(docs, id_col, text_col)
        if not self.generation:
            lost = docs.select("doc_id", F.array().cast(LOST).alias("lost")).limit(0)
        else:
            lost = self.droppings().groupBy("doc_id").agg(
                F.collect_list(F.struct(*KEY)).alias("lost"))
        rows = docs.join(stage(lost, "lost"), "doc_id", "left").select("doc_id", "text", "lost")
        id_type = rows.schema["doc_id"].dataType.simpleString()
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, sizes, dropped = [], [], []
                for raw, own in zip(_bytes(batch.column(1)), _digests(batch.column(2))):
                    lines = raw.split(b"\n")
                    kept = [x for x in lines if line_key(x, min_chars) not in own] if own else lines
                    texts.append(b"\n".join(kept) if own else raw)
                    sizes.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()),
                     pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())],
                    names=["doc_id", "text", "n_lines", "n_dropped"])

        return rows.mapInArrow(
            run, f"doc_id {id_type}, text string, n_lines long, n_dropped long")


LOST = "array<struct<hi:long,lo:long>>"


def _digests(column: pa.Array) -> Iterable[set[bytes]]:
    """The digests of each row's keys."""
    flat = column.flatten()
    raw = np.stack([flat.field(k).to_numpy() for k in (0, 1)], axis=1).tobytes()
    at = 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        yield {raw[k:k + 16] for k in range(at, at + 16 * n, 16)}
        at += 16 * n


def build(docs: DataFrame, folder: str, batches: int = 2, id_col: str = "doc_id",
          text_col: str = "text") -> LineIndex:
    """An index over all of `docs`, put in as `batches` parts of hashed ids (same end result)."""
    index = LineIndex(docs.sparkSession, folder)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(batches))
    for k in range(batches):
        index.insert(docs.where(part == k), id_col, text_col)
    return index
