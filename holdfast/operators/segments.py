"""Customer segmentation: RFM tiers, k-means, quality criteria and a TOPSIS ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import MCDA_CRITERIA, SETTINGS, Settings
from holdfast.functions.numbers import day_index, ratio
from holdfast.functions.quantiles import weighted_medians
from holdfast.operators.clustering import nearest, weighted_kmeans
from holdfast.session import stage

RFM_NAMES = {0: "new_or_browsing", 1: "lapsed_buyer", 2: "active_buyer", 3: "loyal_high_value"}
BROWSER_NAMES = ("engaged_browsers", "occasional_browsers", "light_browsers")


def snapshot(grid: DataFrame, events: DataFrame, day: int,
             settings: Settings = SETTINGS) -> DataFrame:
    """Grid rows of one day for customers seen before it, with their exposures before it."""
    seen_day = day_index(F.col("ts"), settings.start_date)
    before = events.where(seen_day < day)
    seen = before.groupBy("customer_id").agg(
        F.count_if(F.col("type") == "campaign_exposure").alias("contacts_total"))
    # the count exists exactly for customers seen before, so the join is also the semi join
    return grid.where(F.col("day") == day).join(seen, "customer_id")


def rfm_tier(spend_cut: Column, settings: Settings = SETTINGS) -> Column:
    recency = F.col("rfm_recency_days")
    return (F.when(recency.isNull(), 0).when(recency > settings.lapsed_after_days, 1)
            .when(F.col("rfm_monetary_cents") > spend_cut, 3).otherwise(2)).cast("long")


def rfm_segments(frame: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Never ordered / lapsed / active / active above the median spend of actives."""
    active = frame.where(F.col("rfm_recency_days") <= settings.lapsed_after_days)
    cut = F.lit(weighted_medians(active, "rfm_monetary_cents", [F.lit(1)])[0] or 0.0)
    names = F.create_map(*[F.lit(x) for kv in RFM_NAMES.items() for x in kv])
    return frame.withColumn("segment_id", rfm_tier(cut, settings)).withColumn(
        "segment_name", names[F.col("segment_id").cast("int")])


def segment_matrix(frame: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(customer_id, x1..xn): capped recency, log1p, standardised with the population sd."""
    cap = settings.recency_cap_days
    raw = []
    for name in settings.segment_features:
        value = F.col(name).cast("double")
        if name == "rfm_recency_days":
            value = F.least(F.coalesce(value, F.lit(cap)), F.lit(cap))
        raw.append(F.log1p(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))).alias(name))
    logs = frame.select("customer_id", *raw)
    stats = logs.agg(F.struct(*[x for n in settings.segment_features for x in (
        F.avg(n).alias(f"m_{n}"),
        F.coalesce(F.nullif(F.stddev_pop(n), F.lit(0.0)), F.lit(1.0)).alias(f"s_{n}"))]).alias("s"))
    s = stats.scalar()
    return logs.withColumn("_s", s).select("customer_id", *[
        ((F.col(n) - F.col(f"_s.m_{n}")) / F.col(f"_s.s_{n}")).alias(n)
        for n in settings.segment_features])


def kmeans_labels(matrix: DataFrame, counts: Sequence[int], seed: int,
                  settings: Settings = SETTINGS) -> DataFrame:
    """(k, customer_id, segment_id) for every cluster count, the best of several starts each."""
    x = F.array(*[F.col(n) for n in settings.segment_features])
    points = stage(matrix.select("customer_id", x.alias("x"), F.array(F.lit(1.0)).alias("w"),
                                 F.xxhash64("customer_id").alias("key")), "points")
    centres = weighted_kmeans(points, counts, 1, seed, settings.kmeans_starts)
    held = [centres[k, 0] for k in counts] if centres else [[[0.0]]] * len(counts)
    return points.select("customer_id", F.posexplode(nearest(F.col("x"), held)).alias(
        "at", "segment_id")).select(F.element_at(F.array(*[F.lit(k) for k in counts]), F.col(
            "at") + 1).alias("k"), "customer_id", "segment_id")


# --------------------------------------------------------------------------------- criteria
def shares(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    counts = labels.groupBy(*group, "segment_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group)) if group else None
    if total is None:
        return counts.withColumn("share", ratio(F.col("n"), counts.agg(F.sum("n")).scalar()))
    return counts.withColumn("share", ratio(F.col("n"), total))


def size_balance(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Entropy of the shares over its maximum; one segment scores 0."""
    s = F.col("share")
    return shares(labels, group).groupBy(*group).agg(
        F.coalesce(-F.sum(s * F.log(s)) / F.nullif(F.log(F.count(F.lit(1)).cast("double")),
                                                   F.lit(0.0)), F.lit(0.0)).alias("size_balance"),
        F.count(F.lit(1)).alias("n_segments"), F.min("share").alias("min_share"))


def viability(balance: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return balance.withColumn("viable", (F.col("n_segments") <= settings.max_segments) & (
        F.col("min_share") >= settings.min_segment_share))


def adjusted_rand(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of columns `a`, `b` (optional weight `w`) from their contingency."""
    w = F.col("w") if "w" in pairs.columns else F.lit(1)
    cell = pairs.groupBy(*group, "a", "b").agg(F.sum(w).cast("double").alias("n"))
    two = lambda n: n * (n - 1) / 2
    rows = cell.groupBy(*group, "a").agg(F.sum("n").alias("n"))
    cols = cell.groupBy(*group, "b").agg(F.sum("n").alias("n"))
    key = list(group)
    parts = [
        cell.groupBy(*key).agg(F.sum(two(F.col("n"))).alias("both"), F.sum("n").alias("n")),
        rows.groupBy(*key).agg(F.sum(two(F.col("n"))).alias("sum_a")),
        cols.groupBy(*key).agg(F.sum(two(F.col("n"))).alias("sum_b"))]
    names = ("both", "n", "sum_a", "sum_b")
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    one = stacked.groupBy(*key).agg(*[F.max(c).alias(c) for c in names])
    expected = F.col("sum_a") * F.col("sum_b") / F.nullif(two(F.col("n")), F.lit(0.0))
    top = (F.col("sum_a") + F.col("sum_b")) / 2
    return one.select(*key, F.coalesce(
        (F.col("both") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def silhouettes(points: DataFrame, group: Sequence[str],
                settings: Settings = SETTINGS) -> DataFrame:
    """Mean silhouette of all points of each group under squared Euclidean distance.

    The mean squared distance of a point x to a cluster of n points with sum S and squared norms
    Q is |x|^2 + Q / n - 2 x.S / n, so three sums per cluster replace all pairs. A point alone in
    its cluster scores 0; fewer than two clusters score -1.
    """
    names = list(settings.segment_features)
    norm = sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))
    per = points.groupBy(*group, "segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
        F.array(*[F.sum(n) for n in names]).alias("s"))
    # one row a group, with as many structs as it has clusters; groups are the compared methods
    clusters = F.broadcast(per.groupBy(*group).agg(F.collect_list(
        F.struct("segment_id", "n", "q", "s")).alias("_c")))
    x = F.array(*[F.col(n) for n in names])

    def mean_to(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(x, c["s"], lambda a, b: a * b), F.lit(0.0),
                          lambda acc, v: acc + v)
        return norm + c["q"] / c["n"] - 2 * dot / c["n"]

    placed = points.select(*group, "segment_id", *names).join(clusters, list(group))
    mine = F.get(F.filter("_c", lambda c: c["segment_id"] == F.col("segment_id")), F.lit(0))
    inside = mean_to(mine) * mine["n"] / (mine["n"] - 1)
    outside = F.array_min(F.transform(F.filter(
        "_c", lambda c: c["segment_id"] != F.col("segment_id")), mean_to))
    top = F.greatest(inside, outside)
    score = F.when(F.size("_c") < 2, -1.0).when(mine["n"] < 2, 0.0).otherwise(
        F.coalesce((outside - inside) / F.nullif(top, F.lit(0.0)), F.lit(0.0)))
    return placed.groupBy(*group).agg(F.coalesce(F.avg(score), F.lit(-1.0)).alias("silhouette"))


def silhouette(points: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return silhouettes(points.withColumn("_one", F.lit(0)), ["_one"], settings).select("silhouette")


# ----------------------------------------------------------------------------------- TOPSIS
def base_weights(criteria: dict[str, tuple[float, str]]) -> Column:
    total = sum(w for w, _ in criteria.values())
    pairs = [F.lit(x) for c, (w, _) in criteria.items() for x in (c, w / total)]
    return F.create_map(*pairs)[F.col("criterion")]


def topsis(values: DataFrame, criteria: dict[str, tuple[float, str]] = MCDA_CRITERIA,
           group: Sequence[str] = ("group",), weight: Column | None = None) -> DataFrame:
    """Closeness per (group, alternative) from long rows (group, alternative, criterion, value).

    All groups at once: every step is an aggregate per (group, criterion) or per (group,
    alternative). `weight` overrides the criterion's share of the total weight.
    """
    weight = base_weights(criteria) if weight is None else weight
    cost = [c for c, (_, d) in criteria.items() if d != "benefit"]
    signed = F.when(F.col("criterion").isin(*cost), -F.col("weighted")).otherwise(
        F.col("weighted")) if cost else F.col("weighted")
    per = Window.partitionBy(*group, "criterion")
    norm = F.coalesce(F.nullif(F.sqrt(F.sum(F.col("value") * F.col("value")).over(per)),
                               F.lit(0.0)), F.lit(1.0))
    w = values.withColumn("weighted", F.col("value") / norm * weight)
    w = w.withColumn("v", signed).withColumn("ideal", F.max("v").over(per)).withColumn(
        "anti", F.min("v").over(per))
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    d = w.groupBy(*group, "alternative").agg(
        F.sqrt(F.sum(sq("v", "ideal"))).alias("d_plus"),
        F.sqrt(F.sum(sq("v", "anti"))).alias("d_minus"))
    return d.select(*group, "alternative", F.coalesce(
        F.col("d_minus") / F.nullif(F.col("d_plus") + F.col("d_minus"), F.lit(0.0)), F.lit(0.0))
        .alias("closeness"))


def _winner() -> Column:
    """Best closeness (to 12 places), then the first name."""
    return F.min_by("alternative", F.struct(
        (-F.round("closeness", 12)).alias("c"), F.col("alternative").alias("a")))


def rank_alternatives(scores: DataFrame, group: Sequence[str] = ("group",)) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(
        F.round("closeness", 12).desc(), F.col("alternative"))
    return scores.withColumn("rank", F.row_number().over(order).cast("long"))


def sensitivity(values: DataFrame, criteria: dict[str, tuple[float, str]] = MCDA_CRITERIA,
                factor: float = SETTINGS.sensitivity_factor,
                group: Sequence[str] = ("group",)) -> DataFrame:
    """Winner when each weight in turn is scaled by (1 - factor) and (1 + factor).

    The rows fan out once over the fixed list of changes; one TOPSIS ranks them all.
    """
    raw = {c: w for c, (w, _) in criteria.items()}
    changes = [("", 1.0)] + [(c, f) for c in sorted(raw) for f in (1 - factor, 1 + factor)]
    listed = F.array(*[F.struct(
        F.lit(c).alias("changed"), F.lit(f).alias("weight_factor"),
        F.lit(sum(w * (f if n == c else 1.0) for n, w in raw.items())).alias("total"))
        for c, f in changes])
    fanned = values.select("*", F.explode(listed).alias("_c")).select(
        *values.columns, "_c.*")
    own = F.create_map(*[F.lit(x) for kv in raw.items() for x in kv])[F.col("criterion")]
    scaled = own * F.when(F.col("criterion") == F.col("changed"), F.col("weight_factor")
                          ).otherwise(F.lit(1.0)) / F.col("total")
    keys = [*group, "changed", "weight_factor"]
    winners = topsis(fanned, criteria, keys, scaled).groupBy(*keys).agg(_winner().alias("winner"))
    base = winners.where("changed = ''").select(*group, F.col("winner").alias("_base"))
    return winners.where("changed <> ''").join(base, list(group)).select(
        *group, F.col("changed").alias("criterion"), "weight_factor", "winner",
        (F.col("winner") == F.col("_base")).alias("winner_unchanged"))


def name_clusters(frame: DataFrame) -> DataFrame:
    """(segment_id, segment_name): buyer clusters first, then browsers, by mean visits."""
    profile = frame.groupBy("segment_id").agg(
        F.avg(F.when(F.col("rfm_recency_days").isNotNull(), 1.0).otherwise(0.0)).alias("bought"),
        F.avg("session_visits_count").alias("visits"))
    kind = F.col("bought") >= 0.5
    order = Window.partitionBy(kind).orderBy(F.col("visits").desc(), "segment_id")
    rank = F.row_number().over(order)
    listed = F.array(*[F.lit(n) for n in BROWSER_NAMES])
    name = F.when(kind & (rank == 1), "buyers").when(
        kind, F.concat(F.lit("buyers_"), rank.cast("string"))).otherwise(
        F.coalesce(F.try_element_at(listed, rank),
                   F.concat(F.lit("browsers_"), rank.cast("string"))))
    return profile.withColumn("segment_name", name).select("segment_id", "segment_name")
