"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as UTF-8 bytes: ASCII letters lower-cased, every run of other ASCII signs one
blank, bytes of other alphabets as they are. All n-grams of NGRAMS bytes are hashed into BUCKETS.
The model is a log-probability matrix (buckets x languages) and log priors; it is broadcast, as
its size depends on parameters and the label set only. Scoring adds up matrix rows of a text's
n-grams, in numpy, over Arrow buffers, without a Python string per row.

Training reads a bounded sample: about `sample_per_language` rows of each language, picked by a
hash of the id (all rows of a rarer language). Prediction reads whole texts of all rows.

Cases: a null or empty text, or one without a letter, is `und` with score 0; null labels are not
learned from; ties go to the language that comes first in the alphabet; repeated rows are scored
as often as they occur; without any labelled row every text is `und`; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.tables import id_and_text, small_batches

NGRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SMOOTHING = 0.5
SAMPLE_PER_LANGUAGE = 5000
MAX_LANGUAGES = 1000
SLICE = 1 << 18  # bytes scored at once

_FOLD = np.full(256, 32, "u1")
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # BUCKETS x languages


# ------------------------------------------------------------------------------ n-grams
def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset:][:len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _grams(data: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owners) of the n-grams of each order, blanks folded, none across two texts."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    folded, owner = folded[keep].astype("u8"), owner[keep]
    value = np.zeros(len(folded), "u8")
    for order in range(1, max(NGRAMS) + 1):
        n = len(folded) - order + 1
        if n <= 0:
            return
        value = value[:n] * np.uint64(257) + folded[order - 1:] + np.uint64(1)
        if order in NGRAMS:
            mixed = (value + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype("i8")
            whole = owner[:n] == owner[order - 1:]
            yield bucket[whole], owner[:n][whole]


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in runs of about SLICE bytes: (first text, bytes, text number of each byte)."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
        own = offsets[k:end + 1]
        yield k, data[own[0]:own[-1]], np.repeat(np.arange(end - k), np.diff(own))
        k = end


# ----------------------------------------------------------------------------- training
def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id", learn: Column | None = None,
          sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows with a label for which `learn` holds."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[text_col].cast("string").alias("text"),
                       docs[lang_col].cast("string").alias("lang"),
                       docs[id_col].cast("string").alias("key"),
                       (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in
             rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; at most {MAX_LANGUAGES} can be told apart")
    if not languages:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), "f4"))
    draw = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit(7)), F.lit(1_000_000))
    share = F.lit(None).cast("double")
    shares = F.create_map(*[F.lit(x) for k in languages for x in (
        k, min(1.0, sample_per_language / sizes[k]) * 1_000_000)])
    share = F.element_at(shares, F.col("lang"))
    sample = rows.where(draw < share).select("text", "lang")
    number = {k: n for n, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), "i8")
        for batch in batches:
            label = np.array([number[x] for x in batch.column(1).to_pylist()], "i8")
            for first, data, owner in _slices(*_buffers(batch.column(0))):
                for bucket, of in _grams(data, owner):
                    total += np.bincount(label[first + of] * BUCKETS + bucket,
                                         minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])],
            names=["lang", "bucket", "n"])

    # at most languages x BUCKETS rows come back, as one vector per language
    counted = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((BUCKETS, len(languages)))
    total[counted.column("bucket").to_numpy(), counted.column("lang").to_numpy()] = (
        counted.column("n").to_numpy())
    total += SMOOTHING
    return Model(languages, np.full(len(languages), -np.log(len(languages))),
                 np.log(total / total.sum(axis=0)).astype("f4"))


# ------------------------------------------------------------------------------ scoring
def score_texts(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language numbers, posterior of that language) of each text."""
    n, m = len(column), len(model.languages)
    sums = np.tile(model.log_prior, (n, 1))
    for first, data, owner in _slices(*_buffers(column)):
        for bucket, of in _grams(data, owner):
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            if len(of):
                sums[first + of[edges]] += np.add.reduceat(
                    model.log_prob[bucket], edges, axis=0, dtype="f8")
    best = sums.argmax(axis=1) if m else np.zeros(n, "i8")
    odds = np.exp(sums - sums.max(axis=1, keepdims=True)) if m else np.ones((n, 1))
    return best, 1.0 / odds.sum(axis=1)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             ) -> DataFrame:
    """Per row: the id, lang_pred and score."""
    source = id_and_text(docs, id_col, text_col).withColumn(
        "known", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if model.languages
        else F.lit(False))
    return _scored(source, model)


def _scored(source: DataFrame, model: Model, text_col: str = "text",
            kept: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to the kept columns (all but text and known, if not said)."""
    kept = kept or [c for c in source.columns if c not in (text_col, "known")]
    schema = T.StructType([*[source.schema[c] for c in kept],
                           T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    shared = source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], object)
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(bool)
            best, score = score_texts(shared.value, batch.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 pa.array(np.where(known, names[best], "und"), pa.string()),
                 pa.array(np.where(known, score, 0.0))], names=schema.names)

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is in some learned language, with all their columns."""
    small_batches(docs.sparkSession)
    # columns go by place, so no name can clash, and the text goes once
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = F.col(names[docs.columns.index(text_col)])
    source = plain.withColumn("known", F.coalesce(
        text.cast("string").rlike(r"\p{L}"), F.lit(False)))
    scored = _scored(source, model, names[docs.columns.index(text_col)], names)
    return scored.where(F.col("lang_pred") != "und").select(*names).toDF(*docs.columns)
