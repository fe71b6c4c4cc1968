"""Quality rules of documents: base counts of each text, and cross-document line frequency.

Method: every line is normalised (lower case, digits as 0, runs of anything else but letters as one
blank) and hashed; the distinct texts of a host that hold a line are counted; lines above the
limit are removed, and a document that is left with too little of its words is rejected. Exact
copies count once, so a document is not condemned by its own copies.

All of it is DataFrame expressions. Counts are pre-aggregated on the map side before any shuffle;
the frequent lines meet the documents through an equi join on (host, line), which Spark may split.

Cases: a null or empty text has no words, fails the base rule and is not kept; a null host is a
host of its own; a line without letters or digits is never counted; repeated rows each get their
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.session import stage

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows
WINDOW = 3
MAX_TEXTS_PER_HOST = 30  # distinct texts of a host that may hold a line
MIN_LEFT = 30  # per cent of its words that a document must keep
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _repeated(words: str, grams: str, size: int) -> Column:
    """Words inside windows that occur twice or more; grams: hashed windows in text order."""
    ordered = F.sort_array(F.transform(F.col(grams), lambda g, i: F.struct(
        g.alias("g"), i.alias("i"))))

    def met_before_or_after(sorted_grams: Column) -> Column:
        return F.transform(F.filter(sorted_grams, lambda e, k: F.coalesce(
            F.get(sorted_grams, k - 1)["g"] == e["g"], F.lit(False)) | F.coalesce(
            F.get(sorted_grams, k + 1)["g"] == e["g"], F.lit(False))), lambda e: e["i"])

    # a one-element transform binds the sorted array once for all the lookups in it
    places = F.sort_array(F.get(F.transform(F.array(ordered), met_before_or_after), F.lit(0)))

    def covered(sorted_places: Column) -> Column:
        return F.aggregate(F.transform(sorted_places, lambda p, k: F.least(
            F.lit(size), F.coalesce(F.get(sorted_places, k + 1) - p, F.lit(size)))),
            F.lit(0).cast("long"), lambda a, x: a + x)

    any_twice = F.size(F.array_distinct(grams)) < F.size(grams)
    return F.when(any_twice, F.get(F.transform(F.array(places), covered), F.lit(0))).otherwise(
        F.lit(0).cast("long"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("words", words_of(body))
    last = F.size("words") - WINDOW
    hashed = split.withColumn("grams", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            *[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(
        F.array().cast("array<bigint>")))
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")
    counted = hashed.withColumn("lines", lines).withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(body, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))
                      ).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": _repeated("words", "grams", WINDOW)})
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("words", "grams", "lines")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}", "0"),
                                   r"[^\p{L}0]+", " "))


def _line_hashes(text: Column) -> Column:
    """(hash, words) of each line that has a letter or digit; equal lines stay."""
    own = F.transform(F.split(text, "\n"), normalised)
    return F.transform(F.filter(own, lambda x: x != ""), lambda x: F.struct(
        F.xxhash64(x).alias("line"),
        (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source", max_texts: int = MAX_TEXTS_PER_HOST,
          min_left: int = MIN_LEFT) -> DataFrame:
    """Per row: the id, the base counts, base_failed, words_removed, line_words and kept."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"),
                         F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"))
    body = F.coalesce(F.col("text"), F.lit(""))
    profiled = base_counts(source.withColumns({
        "copy": F.md5(body), "held": _line_hashes(body)})).drop("text").withColumn(
        "row", F.monotonically_increasing_id())
    rows = stage(profiled, "quality")
    each = rows.select("row", "host", "copy", F.explode("held").alias("x")).select(
        "row", "host", "copy", "x.*")
    texts = each.select("host", "line", "copy").distinct()
    common = texts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts")).where(
        F.col("texts") > max_texts)
    removed = each.join(common, ["host", "line"], "left_semi").groupBy("row").agg(
        F.sum("words").alias("words_removed"))
    total = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = rows.withColumn("line_words", total).drop("held", "copy").join(removed, "row", "left")
    out = out.withColumn("words_removed", F.coalesce("words_removed", F.lit(0)).cast("long"))
    left = 100 * (F.col("line_words") - F.col("words_removed")) >= min_left * F.col("line_words")
    return out.withColumn("kept", ~F.col("base_failed") & left).drop("row", "host")
