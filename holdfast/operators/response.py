"""Response models: calibrated bootstrap ensembles of P(purchase | context, action).

Two families share one interface: `members(df)` adds a map column `archetype:bps -> array of
member probabilities`. The logistic family is fitted by Newton steps over all members at once and
scored by one Arrow batch function; the tree family is grown from histograms of all members.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from holdfast.config import ACTION_CATALOG, SETTINGS, Settings
from holdfast.functions.draws import draw_bits
from holdfast.operators.boosting import (
    Boosted,
    Growth,
    Lookup,
    attribution_difference,
    boost,
    feature_cuts,
    raw_scores,
)
from holdfast.operators.bootstrap import index_customers
from holdfast.session import stage

ARCHETYPES = tuple(name for name, *_ in ACTION_CATALOG)
TINY_SD = 1e-9
PLATT_C = 1e6
NEWTON_STOP = 1e-9
SUM_WIDTH = 64  # partial sums per block that meet in one task on the first level


# ------------------------------------------------------------------------------ preparation
def standardiser(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, scale, constant): population moments, tiny spreads replaced by 1. One
    aggregate."""
    aggs = [F.struct(F.lit(n).alias("feature"), F.avg(n).alias("mean"),
                     F.when(F.stddev_pop(n) < TINY_SD, F.lit(1.0)).otherwise(F.stddev_pop(n))
                     .alias("scale"), (F.stddev_pop(n) < TINY_SD).alias("constant"))
            .alias(f"s{i}") for i, n in enumerate(features)]
    row = train.agg(*aggs)
    return row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(features))])))


def member_weights(customers: DataFrame, n_members: int, seed: int | str) -> DataFrame:
    """(customer_id, w): one bootstrap count per member, drawn at customer level."""
    indexed = index_customers(customers)
    n = indexed.agg(F.count(F.lit(1))).scalar()
    picks = indexed.select(F.col("slot").alias("j"), F.explode(
        F.sequence(F.lit(0), F.lit(n_members - 1))).alias("member"))
    drawn = picks.select("member", F.pmod(
        draw_bits(seed, F.col("member"), F.col("j")), n).alias("slot"))
    counts = drawn.groupBy("slot").agg(*[
        F.count_if(F.col("member") == m).cast("double").alias(f"w{m}") for m in range(n_members)])
    zero = [F.coalesce(f"w{m}", F.lit(0.0)) for m in range(n_members)]
    return indexed.join(counts, "slot", "left").select("customer_id", F.array(*zero).alias("w"))


def z_array(features: Sequence[str], mean: Sequence[float], scale: Sequence[float]) -> Column:
    return F.array(*[(F.col(f) - F.lit(float(m))) / F.lit(float(s))
                     for f, m, s in zip(features, mean, scale, strict=True)])


def logistic_design(df: DataFrame, archetypes: Sequence[str] = ARCHETYPES) -> DataFrame:
    """Add `design`: z, action flags, flags x z, depth, depth x z (needs `z`, `archetype`,
    `discount_bps`)."""
    flags = F.array(*[F.when(F.col("archetype") == a, 1.0).otherwise(0.0)
                      for a in archetypes if a != "none"])
    depth = F.col("discount_bps") / F.lit(10_000.0)
    inter = F.flatten(F.transform("_flags", lambda f: F.transform("z", lambda x: x * f)))
    return df.withColumn("_flags", flags).withColumn("design", array_to_vector(F.concat(
        F.col("z"), F.col("_flags"), inter, F.array(depth),
        F.transform("z", lambda x: x * depth)))).drop("_flags")


def _matrix(cols: Sequence[pa.Array]) -> np.ndarray:
    """(row, column) numbers of a batch; null is nan."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1)


def _lists(rows: np.ndarray) -> pa.Array:
    """One list for each row."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()),
                                    pa.array(np.ascontiguousarray(rows).ravel()))


# --------------------------------------------------------------------------------- logistic
@dataclass
class LogisticMember:
    intercept: float
    coef: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)


@dataclass
class LogisticEnsemble:
    features: list[str]
    mean: list[float]
    scale: list[float]
    members_: list[LogisticMember] = field(default_factory=list)
    archetypes: tuple[str, ...] = ARCHETYPES
    family: str = "logistic"

    @property
    def actions(self) -> list[str]:
        return [a for a in self.archetypes if a != "none"]

    @property
    def n_members(self) -> int:
        return len(self.members_)

    def _split(self, coef: np.ndarray):
        p, k = len(self.features), len(self.actions)
        base, alpha, rest = coef[:p], coef[p:p + k], coef[p + k:]
        return base, alpha, rest[:k * p].reshape(k, p), rest[k * p], rest[k * p + 1:]

    def slopes(self, archetype: str, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Per member: logit intercept and slope on z for one arm, calibration included."""
        offs, rows = [], []
        for m in self.members_:
            base, alpha, gamma, delta, eta = self._split(m.coef)
            off, row = m.intercept + delta * depth, base + eta * depth
            if archetype != "none":
                k = self.actions.index(archetype)
                off, row = off + alpha[k], row + gamma[k]
            a, b = m.platt
            offs.append(a * off + b)
            rows.append(a * row)
        return np.array(offs), np.array(rows)

    def member_probabilities(self, arms: Sequence[tuple[str, int]]) -> Column:
        """Array column: member probabilities of every arm, arm after arm.

        One vectorised matrix product per Arrow batch; the model (a few thousand numbers) goes
        along with the function.
        """
        parts = [self.slopes(a, bps / 10_000) for a, bps in arms]
        offsets = np.concatenate([o for o, _ in parts])
        weights = np.concatenate([r for _, r in parts], axis=0)
        mean, scale = np.array(self.mean), np.array(self.scale)

        def score(*cols: pa.Array) -> pa.Array:
            logit = ((_matrix(cols) - mean) / scale) @ weights.T + offsets
            return _lists(1.0 / (1.0 + np.exp(-logit)))

        udf = F.arrow_udf(score, ArrayType(DoubleType()))
        return udf(*[F.col(f"_x_{f}") for f in self.features])

    def members(self, df: DataFrame, columns: dict[str, Column],
                arms: Sequence[tuple[str, int]], out: str = "members") -> DataFrame:
        """Add `out`: map `archetype:bps` -> member probabilities."""
        n = self.n_members
        wide = df.select("*", *[columns[f].alias(f"_x_{f}") for f in self.features])
        wide = wide.withColumn("_flat", self.member_probabilities(arms))
        keys = F.array(*[F.lit(f"{a}:{bps}") for a, bps in arms])
        values = F.array(*[F.slice("_flat", i * n + 1, n) for i in range(len(arms))])
        return wide.withColumn(out, F.map_from_arrays(keys, values)).select(
            *[c for c in df.columns if c != out], out)

    def attributions(self, z: Column, archetype: Column, depth: Column) -> Column:
        """(feature, weight): exact share of each feature in the uplift logit, member mean,
        plus `action:<archetype>`, the arm's own effect."""
        split = [self._split(m.coef) for m in self.members_]
        gamma = np.mean([s[2] for s in split], axis=0)
        alpha = np.mean([s[1] for s in split], axis=0)
        delta = float(np.mean([s[3] for s in split]))
        eta = np.mean([s[4] for s in split], axis=0)
        lits = lambda row: F.array(*[F.lit(float(v)) for v in row])
        slopes = F.create_map(*[x for k, a in enumerate(self.actions)
                                for x in (F.lit(a), lits(gamma[k]))])[archetype]
        own = F.create_map(*[F.lit(x) for k, a in enumerate(self.actions)
                             for x in (a, float(alpha[k]))])[archetype]
        lean = F.zip_with(slopes, lits(eta), lambda g, e: g + e * depth)
        per = F.zip_with(lean, z, lambda s, x: s * x)
        names = F.array(*[F.lit(f) for f in self.features])
        return F.concat(
            F.zip_with(names, per, lambda f, w: F.struct(f.alias("feature"), w.alias("weight"))),
            F.array(F.struct(F.concat(F.lit("action:"), archetype).alias("feature"),
                             (own + F.lit(delta) * depth).alias("weight"))))


def top_attributions(attributions: Column, k: int = SETTINGS.attribution_top_k) -> Column:
    """The k largest by absolute weight (then name), zeros dropped, rounded to 6 places."""
    keyed = F.transform(F.filter(attributions, lambda a: F.abs(a["weight"]) > 0),
                        lambda a: F.struct((-F.abs(a["weight"])).alias("neg"),
                                           a["feature"].alias("feature"),
                                           a["weight"].alias("weight")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda a: F.struct(
        a["feature"].alias("feature"), F.round(a["weight"], 6).alias("weight")))


def global_importance(log: DataFrame, model: LogisticEnsemble,
                      archetype: str = "recommend") -> DataFrame:
    """Mean absolute attribution over the whole test split."""
    head = log.where(F.col("split") == "test")
    z = z_array(model.features, model.mean, model.scale)
    each = head.withColumn("z", z).select(F.inline(model.attributions(
        F.col("z"), F.lit(archetype), F.lit(0.0))))
    return each.groupBy("feature").agg(F.avg(F.abs("weight")).alias("mean_abs_attribution"))


def platt(scored: DataFrame, raw: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a near-unregularised one-feature logistic fit."""
    one = scored.select(F.array(raw).alias("raw"), F.col(label).alias("label"))
    return platt_all(one, 1)[0]


def platt_all(scored: DataFrame, n_members: int, steps: int = 100) -> list[tuple[float, float]]:
    """The fits of all members at once, by Newton steps from the base rate: each step is one
    aggregate of six sums per member over (raw: array of scores, label). A step that raises the
    loss is halved."""
    rate = scored.agg(F.avg("label")).first()[0]
    if rate is None:
        return [(1.0, 0.0)] * n_members
    start = float(np.log(np.clip(rate, 1e-12, 1 - 1e-12) / (1 - np.clip(rate, 1e-12, 1 - 1e-12))))
    at = np.tile([0.0, start], (n_members, 1))
    held, least = at.copy(), np.full(n_members, np.inf)
    for _ in range(steps):
        sums = []
        for m in range(n_members):
            x = F.get("raw", F.lit(m))
            score = F.lit(float(at[m, 0])) * x + F.lit(float(at[m, 1]))
            p = 1 / (1 + F.exp(-score))
            w, r = p * (1 - p), F.col("label") - p
            loss = F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score))) - (
                F.col("label") * score)
            sums += [F.sum(v) for v in (w * x * x, w * x, w, r * x, r, loss)]
        row = np.array([v or 0.0 for v in scored.agg(*sums).first()]).reshape(n_members, 6)
        moved = 0.0
        for m, (xx, x1, one, gx, g1, loss) in enumerate(row):
            cost = PLATT_C * loss + at[m, 0] ** 2 / 2
            if cost > least[m] * (1 + 1e-12):
                step = (held[m] - at[m]) / 2
            else:
                held[m], least[m] = at[m], cost
                hessian = PLATT_C * np.array([[xx, x1], [x1, one]]) + np.diag([1.0, 1e-9])
                step = np.linalg.solve(hessian, PLATT_C * np.array([gx, g1]) - [at[m, 0], 0.0])
            at[m] = at[m] + step
            moved = max(moved, float((np.abs(step) / (1 + np.abs(at[m]))).max()))
        if moved < 1e-9:
            break
    return [(float(a), float(b)) for a, b in at]


def _arm_blocks(data: DataFrame, beta: np.ndarray, n_arms: int, p: int) -> np.ndarray:
    """Per (arm, member): the weighted Gram matrix and gradient of (1, z, depth, depth * z).

    A row touches only its own arm's interaction columns, which repeat (1, z), so these small
    blocks hold all of the design's Gram matrix. Partial sums are per task; two levels of grouped
    sums fold them, and what comes back has the size of the model.
    """
    n_members, d = beta.shape[0], 2 * p + 2
    size = d * d + d
    shared = data.sparkSession.sparkContext.broadcast(beta)

    def partial(batches):
        total = np.zeros((n_arms, n_members, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            z, w = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1)
                    for c in ("z", "w"))
            depth, y, arm = (batch.column(c).to_numpy() for c in ("depth", "label", "arm"))
            base = np.column_stack([np.ones(len(z)), z])
            # rows of one arm and depth: the columns with the depth are its multiples of the others
            for k, deep in np.unique(np.column_stack([arm, depth]), axis=0).tolist():
                k, own = int(k), (arm == k) & (depth == deep)
                x, times = base[own], np.array([1.0, deep])
                for m in range(n_members):
                    slopes = times @ shared.value[m, k].reshape(2, p + 1)
                    prob = 1 / (1 + np.exp(-(x @ slopes)))
                    weight = w[own, m] * prob * (1 - prob)
                    total[k, m, :d * d] += np.kron(np.outer(times, times), (
                        x * weight[:, None]).T @ x).ravel()
                    total[k, m, d * d:] += np.kron(times, x.T @ (w[own, m] * (y[own] - prob)))
        slot = TaskContext.get().partitionId() % SUM_WIDTH
        for k in range(n_arms):
            for m in range(n_members):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([m]), pa.array([slot]),
                     pa.array([total[k, m].tobytes()])], names=["arm", "member", "slot", "sums"])

    def fold(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(v) for v in table.column("sums").to_pylist())
        return pa.table({"arm": table.column("arm")[:1], "member": table.column("member")[:1],
                         "slot": table.column("slot")[:1], "sums": [sums.tobytes()]})

    schema = "arm long, member long, slot long, sums binary"
    parts = data.mapInArrow(partial, schema)
    once = parts.groupBy("arm", "member", "slot").applyInArrow(fold, schema)
    out = np.zeros((n_arms, n_members, size))
    for r in once.groupBy("arm", "member").applyInArrow(fold, schema).collect():
        out[r["arm"], r["member"]] = np.frombuffer(r["sums"])
    return out


def _places(p: int, n_actions: int, arm: int) -> tuple[np.ndarray, np.ndarray]:
    """Where (1, z, depth, depth * z) of a row with that arm stand in (intercept, coef), and where
    its repeated (1, z) stand; arm 0 has none."""
    base, alpha = 1 + np.arange(p), 1 + p
    gamma, delta = alpha + n_actions, alpha + n_actions + n_actions * p
    first = np.concatenate([[0], base, [delta], delta + 1 + np.arange(p)])
    if not arm:
        return first, np.zeros(0, int)
    k = arm - 1
    return first, np.concatenate([[alpha + k], gamma + k * p + np.arange(p)])


def fit_logistic(log: DataFrame, features: Sequence[str], settings: Settings = SETTINGS,
                 max_iter: int | None = None) -> LogisticEnsemble:
    """Bootstrap ensemble on the train split, calibrated on validation.

    Resamples are row weights, so no data is copied per member. The penalty matches
    `C * sum(loss) + |w|^2 / 2`, without the intercept. All members take Newton steps together,
    one pass over the data each; a fit that has not converged fails.
    """
    train = log.where("split = 'train'")
    # a constant feature must be exactly 0: its spread is only rounding noise
    moments = {r["feature"]: (r["mean"], float("inf") if r["constant"] else r["scale"])
               for r in standardiser(train, features).collect()}
    model = LogisticEnsemble(list(features), [moments[f][0] for f in features],
                             [moments[f][1] for f in features])
    z = z_array(model.features, model.mean, model.scale)
    arms = ["none", *model.actions]
    p, k, n = len(features), len(model.actions), settings.ensemble_size
    arm = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col("archetype")) - 1
    made = log.where("split IN ('train', 'validation')").select(
        "customer_id", "split", arm.alias("arm"), z.alias("z"),
        (F.col("discount_bps") / F.lit(10_000.0)).alias("depth"),
        F.col("converted").cast("double").alias("label"))
    weights = member_weights(train, n, settings.seeds["models"])
    data = made.where("split = 'train'").join(weights, "customer_id").drop(
        "customer_id", "split").persist()
    places = [_places(p, k, a) for a in range(len(arms))]
    width = 1 + p + k + k * p + 1 + p
    beta = np.zeros((n, width))
    limit = max_iter or settings.logistic_max_iter
    penalty = np.append(0.0, np.ones(width - 1))

    def per_arm() -> np.ndarray:
        """Coefficients of (1, z, depth, depth * z) by member and arm."""
        out = np.zeros((n, len(arms), 2 * p + 2))
        for a, (first, own) in enumerate(places):
            out[:, a] = beta[:, first]
            out[:, a, :len(own)] += beta[:, own]
        return out

    try:
        for _ in range(limit):
            blocks = _arm_blocks(data, per_arm(), len(arms), p)
            d, moved, pull = 2 * p + 2, 0.0, 0.0
            for m in range(n):
                hessian, slope = np.zeros((width, width)), np.zeros(width)
                for a, (first, own) in enumerate(places):
                    gram, grad = blocks[a, m, :d * d].reshape(d, d), blocks[a, m, d * d:]
                    r = len(own)
                    hessian[np.ix_(first, first)] += gram
                    hessian[np.ix_(first, own)] += gram[:, :r]
                    hessian[np.ix_(own, first)] += gram[:r]
                    hessian[np.ix_(own, own)] += gram[:r, :r]
                    slope[first] += grad
                    slope[own] += grad[:r]
                c = settings.logistic_c
                gradient = c * slope - penalty * beta[m]
                step = np.linalg.solve(c * hessian + np.diag(penalty + 1e-12), gradient)
                beta[m] += step
                moved = max(moved, float(np.abs(step).max()))
                pull = max(pull, float(np.abs(gradient).max()))
            # a resample of one class has no finite intercept: there the gradient fades instead
            if moved < NEWTON_STOP or pull < NEWTON_STOP:
                break
        else:
            raise RuntimeError(f"the response fit moved {moved:g} after {limit} steps")
    finally:
        data.unpersist()
    model.members_ = [LogisticMember(float(b[0]), b[1:].copy()) for b in beta]
    scores = F.array(*[_raw(coef) for coef in per_arm_rows(per_arm(), n)])
    valid = made.where("split = 'validation'").select(scores.alias("raw"), "label").persist()
    try:
        for member, fit in zip(model.members_, platt_all(valid, n)):
            member.platt = fit
    finally:
        valid.unpersist()
    return model


def per_arm_rows(coefficients: np.ndarray, n: int) -> list[list[list[float]]]:
    return [coefficients[m].tolist() for m in range(n)]


def _raw(by_arm: list[list[float]]) -> Column:
    """Linear score of a row (arm, z, depth) from its arm's coefficients."""
    p = (len(by_arm[0]) - 2) // 2
    table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in by_arm])
    own = F.element_at(table, (F.col("arm") + 1).cast("int"))
    dot = lambda begin: F.aggregate(
        F.zip_with(F.slice(own, begin, p), F.col("z"), lambda a, b: a * b), F.lit(0.0),
        lambda acc, v: acc + v)
    return F.get(own, F.lit(0)) + dot(2) + F.col("depth") * (F.get(own, F.lit(p + 1)) + dot(p + 3))


# ------------------------------------------------------------------------------------ trees
@dataclass
class TreeEnsemble:
    """Boosted trees (see `boosting`), calibrated; the arm is a categorical feature."""

    features: list[str]
    boosted: Boosted | None = None
    platt: list[tuple[float, float]] = field(default_factory=list)
    archetypes: tuple[str, ...] = ARCHETYPES
    family: str = "gbm"

    @property
    def n_members(self) -> int:
        return len(self.platt)

    def inputs(self, columns: dict[str, Column] | None = None) -> tuple[Column, Column, Column]:
        """(features and depth as an array, arm code, depth) of rows with archetype and bps."""
        columns = columns or {f: F.col(f) for f in self.features}
        depth = F.col("discount_bps") / F.lit(10_000.0)
        arms = F.array(*[F.lit(a) for a in self.archetypes])
        return (F.array(*[columns[f].cast("double") for f in self.features], depth),
                (F.array_position(arms, F.col("archetype")) - 1).cast("int"), depth)

    def design(self, df: DataFrame) -> DataFrame:
        """Add `design`: features, archetype code (categorical), depth."""
        numeric, arm, depth = self.inputs()
        values = F.slice(numeric, 1, len(self.features))
        return df.withColumn("design", array_to_vector(F.concat(
            values, F.array(arm.cast("double"), depth))))

    def score(self, df: DataFrame) -> DataFrame:
        """Add `p`: array of member probabilities of the row's own arm."""
        numeric, arm, _ = self.inputs()
        line = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                         for a, b in self.platt])
        return df.withColumn("_raw", raw_scores(self.boosted, numeric, arm)).withColumn(
            "p", F.zip_with("_raw", line, lambda r, k: 1 / (1 + F.exp(-(k["a"] * r + k["b"]))))
        ).drop("_raw")

    def members(self, df: DataFrame, columns: dict[str, Column],
                arms: Sequence[tuple[str, int]], out: str = "members") -> DataFrame:
        """Add `out`: map `archetype:bps` -> member probabilities of every context row."""
        wide = df.select("*", *[columns[f].cast("double").alias(f"_x_{f}") for f in self.features])
        codes = [self.archetypes.index(a) for a, _ in arms]
        depths = [bps / 10_000.0 for _, bps in arms]
        slope, level = np.array(self.platt).T[:, :, None]
        lookup, n = Lookup.of(self.boosted), self.n_members

        def score(*cols: pa.Array) -> pa.Array:
            raw = lookup.raw_by_arm(_matrix(cols), list(zip(codes, depths)))
            return _lists((1 / (1 + np.exp(-(raw * slope + level)))).reshape(
                len(codes) * n, -1).T)

        flat = F.arrow_udf(score, ArrayType(DoubleType()))(*[
            F.col(f"_x_{f}") for f in self.features])
        keys = F.array(*[F.lit(f"{a}:{bps}") for a, bps in arms])
        values = F.array(*[F.slice("_flat", i * n + 1, n) for i in range(len(arms))])
        return wide.withColumn("_flat", flat).withColumn(
            out, F.map_from_arrays(keys, values)).select(
            *[c for c in df.columns if c != out], out)

    def attributions(self, df: DataFrame, out: str = "attributions") -> DataFrame:
        """Add `out`: (feature, weight) array, the exact parts of each feature in the difference
        of the calibrated logits of the row's arm and of `none`, member mean; the arm and its
        depth are `action:<archetype>`."""
        numeric, arm, depth = self.inputs()
        slopes = [a for a, _ in self.platt]
        names = F.concat(F.array(*[F.lit(f) for f in self.features]),
                         F.array(F.concat(F.lit("action:"), F.col("archetype"))))
        none = self.archetypes.index("none")
        return df.withColumn("_parts", attribution_difference(
            self.boosted, slopes, numeric, arm, depth, none)).withColumn(out, F.zip_with(
                names, "_parts", lambda f, w: F.struct(f.alias("feature"), w.alias("weight")))
        ).drop("_parts")


def fit_trees(log: DataFrame, features: Sequence[str], settings: Settings = SETTINGS,
              rounds: int | None = None) -> TreeEnsemble:
    """Boosted bootstrap ensemble on the train split, calibrated on validation."""
    model = TreeEnsemble(list(features))
    train, valid = log.where("split = 'train'"), log.where("split = 'validation'")
    weights = member_weights(train, settings.ensemble_size, settings.seeds["models"])
    numeric, arm, depth = model.inputs()
    key = F.xxhash64("customer_id", "day")
    y = F.col("converted").cast("double")
    rows = stage(train.select("customer_id", numeric.alias("numeric"), arm.alias("arm"),
                              y.alias("y"), key.alias("key")).join(weights, "customer_id"),
                 "tree-rows")
    cuts = feature_cuts(train.withColumn("_depth", depth), [*features, "_depth"])
    model.boosted = boost(rows, cuts, settings.ensemble_size, Growth(
        rounds or settings.gbm_rounds, settings.gbm_step, settings.gbm_leaves,
        settings.gbm_min_leaf_rows, settings.gbm_row_share, settings.gbm_feature_share,
        settings.gbm_l2, settings.seeds["models"]))
    held = stage(valid.select(raw_scores(model.boosted, numeric, arm).alias("raw"),
                              y.alias("label")), "tree-held")
    model.platt = platt_all(held, settings.ensemble_size)
    return model


def mean_probability(members: Column) -> Column:
    return F.aggregate(members, F.lit(0.0), lambda a, x: a + x) / F.size(members)


def predicted_uplift(members: Column, arm: Column) -> Column:
    """P(arm) - P(none) from the same ensemble."""
    return mean_probability(members[arm]) - mean_probability(members["none:0"])
