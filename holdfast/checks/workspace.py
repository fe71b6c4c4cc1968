"""Stage hand-overs for one test folder: each stage is written once and read back."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.draws import uniform
from holdfast.operators import context as cx
from holdfast.operators import features as ft
from holdfast.operators import mart as ma
from holdfast.operators import mart_checks as mc
from holdfast.operators import quality as q
from holdfast.operators import segments as sg
from holdfast.operators.candidates import catalog_candidates, with_candidates
from holdfast.operators.rules import apply_rules
from holdfast.plans import replay as rp
from holdfast.session import stage, tune
from holdfast.sources import fixtures as fx

REPLAYED = ("do_nothing", "always_discount", "top_seller", "rules_only", "oracle_upper_bound")
ML_POLICY = "rules_only"  # stands in for the model policy in reports over rule-based replays


class Workspace:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = SETTINGS):
        self.spark, self.root, self.settings = tune(spark), root, settings

    # ------------------------------------------------------------------------- sources
    def table(self, name: str) -> DataFrame:
        return fx.read_table(self.spark, self.root, name)

    @cached_property
    def catalog(self) -> DataFrame:
        return fx.catalog(self.spark, self.root)

    @cached_property
    def inventory(self) -> DataFrame:
        return fx.inventory(self.spark, self.root, self.settings)

    @cached_property
    def raw(self) -> DataFrame:
        return fx.raw_events(self.spark, self.root)

    @cached_property
    def events(self) -> DataFrame:
        """Canonical events with the payload parsed once, in columns."""
        events = stage(q.decode(fx.events(self.spark, self.root)), "events")
        ft.require_span(events, self.settings)
        return events

    # ------------------------------------------------------------------------- quality
    @cached_property
    def checked(self) -> DataFrame:
        return stage(q.check_contract(self.raw), "checked")

    @cached_property
    def good(self) -> DataFrame:
        return q.contract_survivors(self.checked)

    @cached_property
    def violations(self) -> DataFrame:
        return q.gate_violations(self.good, q.GateInputs(self.catalog), self.settings)

    @cached_property
    def decisive(self) -> DataFrame:
        return stage(q.decisive_gate(self.violations), "decisive")

    @cached_property
    def landed(self) -> DataFrame:
        return stage(q.landed_events(self.good, self.decisive), "landed")

    @cached_property
    def rejects(self) -> DataFrame:
        rows = q.contract_rejects(self.checked).unionByName(
            q.gate_rejects(self.good, self.decisive))
        return stage(q.keep_first(rows.drop("event_id"), ["reject_id"], ["reject_id"]), "rejects")

    # ---------------------------------------------------------------- features, contexts
    @cached_property
    def grid(self) -> DataFrame:
        return stage(ft.feature_grid(self.events, self.settings), "grid", partition_by="day")

    @cached_property
    def all_contexts(self) -> DataFrame:
        days = self.settings.experiment_days
        ctx = cx.contexts(self.grid, self.events, self.catalog, self.inventory, days,
                          self.settings)
        return stage(ctx, "contexts", partition_by="day")

    @property
    def contexts(self) -> DataFrame:
        return cx.grid_rows(self.all_contexts, self.settings.decision_days)

    @property
    def judged(self) -> DataFrame:
        return apply_rules(with_candidates(self.contexts))

    def with_probabilities(self, contexts: DataFrame) -> DataFrame:
        """The fixture's probability table as the map column `p`."""
        listed = catalog_candidates()
        return contexts.withColumn("p", F.map_from_entries(F.transform(listed, lambda c: F.struct(
            c["candidate_id"], fx.purchase_probability(c["candidate_id"], c["archetype"])))))

    # -------------------------------------------------------------------- replay, mart
    @cached_property
    def log(self) -> DataFrame:
        ctx = self.with_probabilities(self.contexts)
        return stage(rp.replay(ctx, REPLAYED, self.settings), "replay")

    @cached_property
    def experiment(self) -> DataFrame:
        features = cx.model_columns(self.categories, self.settings)
        ctx = self.with_probabilities(self.all_contexts)
        return stage(rp.experiment_log(ctx, features, self.settings), "experiment")

    @cached_property
    def random_log(self) -> DataFrame:
        ctx = self.with_probabilities(self.all_contexts)
        return stage(rp.replay(ctx, [rp.RANDOM], self.settings), "random")

    @cached_property
    def categories(self) -> list[str]:
        """Category names: the model's one-hot columns, a configured short list."""
        return [r.category for r in self.catalog.select("category").distinct()
                .orderBy("category").collect()]

    @cached_property
    def overrides(self) -> DataFrame:
        """Two calls for some decisions; the later one wins."""
        made = self.log.where((F.col("decision_id") != "")
                              & (uniform("ov", F.col("decision_id")) < 0.05))
        ranks = F.when(uniform("ov2", F.col("decision_id")) < 0.1,
                       F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        rows = made.select("decision_id", "customer_id", "day", "candidate_id",
                           F.explode(ranks).alias("rank"))
        at = F.lit(self.settings.start_date).cast("timestamp")
        return stage(rows.select(
            F.concat_ws("#", "decision_id", F.col("rank").cast("string")).alias("override_id"),
            "decision_id", "customer_id", "day", F.col("candidate_id").alias("original_candidate"),
            F.lit("email_delayed").alias("override_candidate"),
            F.concat_ws(" ", F.lit("manager call"), F.col("rank").cast("string")).alias("reason"),
            F.lit("operator").alias("operator"),
            (at + F.make_interval(hours=F.col("rank"))).alias("created_at")), "overrides")

    @cached_property
    def snapshot(self) -> DataFrame:
        return stage(sg.snapshot(self.grid, self.events, self.settings.train_end_day,
                                 self.settings), "snapshot")

    @cached_property
    def segments(self) -> DataFrame:
        return sg.rfm_segments(self.snapshot, self.settings).select(
            "customer_id", "segment_id", "segment_name")

    @cached_property
    def mart_events(self) -> DataFrame:
        return ma.mart_events(self.events, self.catalog, self.settings)

    @cached_property
    def tables(self) -> mc.Tables:
        t: mc.Tables = {"replay": self.log}
        t["dim_date"] = ma.dim_date(self.spark, self.settings)
        t["dim_action"] = ma.dim_action(self.spark)
        t["dim_policy"] = ma.dim_policy(self.log, ML_POLICY)
        t["dim_customer"] = stage(ma.dim_customer(
            self.mart_events, ma.mart_categories(self.catalog), self.segments, self.settings),
            "dim_customer")
        keyed = stage(ma.keyed_replay(self.log, t["dim_policy"], t["dim_customer"],
                                      t["dim_date"], t["dim_action"]), "keyed")
        t["fct_decisions"] = ma.fct_decisions(keyed, self.overrides)
        t["fct_outcomes"] = ma.fct_outcomes(keyed)
        t["rpt_policy_kpis"] = ma.rpt_policy_kpis(ma.star(
            t["fct_decisions"], t["fct_outcomes"], t["dim_policy"], t["dim_action"]))
        return t

    @property
    def star(self) -> DataFrame:
        t = self.tables
        return ma.star(t["fct_decisions"], t["fct_outcomes"], t["dim_policy"], t["dim_action"])

    @cached_property
    def scored(self) -> DataFrame:
        """Predictions of the probability table on the experiment, with outcomes."""
        day = F.col("day")
        split = F.when(day < self.settings.train_end_day, "train").when(
            day < self.settings.validation_end_day, "validation").otherwise("test")
        return self.random_log.select(
            F.lit("table").alias("family"), split.alias("split"), "customer_id", "day",
            "archetype", F.col("p_action").alias("p"), F.col("converted").alias("y"))


_OPEN: dict[tuple, Workspace] = {}


def workspace(spark: SparkSession, root: str) -> Workspace:
    """One workspace per (application, folder), so stages are shared between reports."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, root)
    return _OPEN[key]
