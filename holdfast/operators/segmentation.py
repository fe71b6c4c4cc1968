"""The segmentation run: candidates, their stability under refits, and the choice among them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import MCDA_CRITERIA, SETTINGS, Settings
from holdfast.functions.quantiles import weighted_medians
from holdfast.operators import segments as sg
from holdfast.operators.clustering import nearest, weighted_kmeans
from holdfast.operators.response import member_weights
from holdfast.session import stage

ONE_SEGMENT = "all_customers"


def candidate_labels(frame: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(customer_id, w, method, segment_id, refits): each customer's segment by RFM rules and by k-means
    of every k, and its segment in a refit of each on every bootstrap resample; w counts the
    customer's copies in each resample."""
    n = settings.stability_resamples
    drawn = member_weights(frame, n, settings.seeds["segments"])
    matrix = sg.segment_matrix(frame, settings)
    x = F.array(*[F.col(c) for c in settings.segment_features])
    rows = stage(matrix.select("customer_id", x.alias("x")).join(drawn, "customer_id").join(
        frame.select("customer_id", "rfm_recency_days", "rfm_monetary_cents"), "customer_id"
    ).select("*", F.xxhash64("customer_id").alias("key")), "segment-rows")
    every = F.concat(F.array(F.lit(1.0)), F.col("w"))
    centres = weighted_kmeans(rows.select("x", every.alias("w"), "key"), settings.kmeans_k, n + 1,
                              settings.seeds["segments"], settings.kmeans_starts)
    active = rows.where(F.col("rfm_recency_days") <= settings.lapsed_after_days)
    cuts = weighted_medians(active, "rfm_monetary_cents", [F.lit(1), *[
        F.get("w", F.lit(r)).cast("long") for r in range(n)]])
    tiers = F.array(*[sg.rfm_tier(F.lit(cut or 0.0), settings) for cut in cuts])
    found = [rows.select("customer_id", "w", F.lit("rfm_rules").alias("method"),
                         tiers.alias("all"))]
    if centres:
        found += [rows.select("customer_id", "w", F.lit(f"kmeans_k{k}").alias("method"), nearest(
            F.col("x"), [centres[k, r] for r in range(n + 1)]).alias("all"))
            for k in settings.kmeans_k]
    return stage(reduce(DataFrame.unionByName, found).select(
        "customer_id", "w", "method", F.get("all", F.lit(0)).alias("segment_id"),
        F.slice("all", 2, n).alias("refits")), "segment-labels")


def stability(labels: DataFrame) -> DataFrame:
    """(method, stability): mean adjusted Rand index of a method's labels and its refits, over the
    copies of each resample."""
    each = labels.select("method", F.col("segment_id").alias("a"), F.posexplode(
        F.arrays_zip("w", "refits")).alias("resample", "x")).select(
        "method", "resample", "a", F.col("x.refits").alias("b"), F.col("x.w").alias("w")).where(
        "w > 0")
    return sg.adjusted_rand(each, ["method", "resample"]).groupBy("method").agg(
        F.avg("ari").alias("stability"))


def scorecard(labels: DataFrame, matrix: DataFrame, stable: DataFrame, readable: Column,
              settings: Settings = SETTINGS) -> DataFrame:
    """Per method: its criteria, whether it is viable, its TOPSIS closeness and rank among the
    viable ones, and whether it is chosen. Where none is viable a row `all_customers` is.

    labels: method, customer_id, segment_id; stable: method, stability; readable: the
    interpretability of `method`.
    """
    balance = sg.viability(sg.size_balance(labels, ["method"]), settings)
    points = labels.select("method", "customer_id", "segment_id").join(matrix, "customer_id")
    known = balance.join(sg.silhouettes(points, ["method"], settings), "method").join(
        stable, "method").withColumn("interpretability", readable)
    card = stage(known, "scorecard")
    long = card.where("viable").select(F.lit(0).alias("group"), F.col("method").alias(
        "alternative"), F.inline(F.array(*[F.struct(
            F.lit(c).alias("criterion"), F.col(c).cast("double").alias("value"))
            for c in MCDA_CRITERIA])))
    ranked = sg.rank_alternatives(sg.topsis(long)).select(
        F.col("alternative").alias("method"), "closeness", "rank")
    out = card.join(ranked, "method", "left").withColumn(
        "chosen", F.coalesce(F.col("rank") == 1, F.lit(False)))
    rest = [f for f in out.schema.fields if f.name not in ("method", "chosen")]
    one = card.agg(F.coalesce(F.bool_or("viable"), F.lit(False)).alias("any")).where(
        "NOT any").select(F.lit(ONE_SEGMENT).alias("method"), F.lit(True).alias("chosen"), *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    return out.unionByName(one)


def interpretability(values: dict[str, float]) -> Column:
    """The recorded judgement of a method's family, `kmeans` for every k."""
    return F.when(F.col("method").startswith("kmeans"), values["kmeans"]).otherwise(
        values["rfm_rules"])


@dataclass
class Segmentation:
    card: DataFrame
    segments: DataFrame  # customer_id, segment_id, segment_name
    chosen: str


def run_segmentation(frame: DataFrame, settings: Settings = SETTINGS) -> Segmentation:
    """Fit all candidates, score them, and name the segments of the chosen one."""
    labels = candidate_labels(frame, settings)
    card = stage(scorecard(labels, sg.segment_matrix(frame, settings), stability(labels),
                           interpretability(settings.interpretability), settings), "card")
    head = card.where("chosen").select("method").first()
    chosen = head["method"] if head else ONE_SEGMENT
    own = labels.where(F.col("method") == chosen).select("customer_id", "segment_id")
    if chosen == ONE_SEGMENT:
        named = frame.select("customer_id", F.lit(0).cast("long").alias("segment_id"),
                             F.lit(ONE_SEGMENT).alias("segment_name"))
    elif chosen == "rfm_rules":
        names = F.create_map(*[F.lit(x) for kv in sg.RFM_NAMES.items() for x in kv])
        named = own.withColumn("segment_name", names[F.col("segment_id").cast("int")])
    else:
        names = sg.name_clusters(frame.join(own, "customer_id"))
        named = own.join(names, "segment_id")
    return Segmentation(card, stage(named.select("customer_id", "segment_id", "segment_name"),
                                    "segments"), chosen)
