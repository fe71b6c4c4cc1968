"""Raw events to landed events and rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.numbers import ratio
from holdfast.operators import quality as q
from holdfast.session import stage
from holdfast.sources.tables import keep_first


@dataclass(frozen=True)
class Ingested:
    events: DataFrame
    rejects: DataFrame
    summary: DataFrame


def ingest(raw: DataFrame, catalog: DataFrame, existing: DataFrame | None = None,
           existing_rejects: DataFrame | None = None, last_seen: DataFrame | None = None,
           settings: Settings = SETTINGS, hand_over: bool = True) -> Ingested:
    """Contract split, gates, landing. Landing twice changes nothing.

    Survivors, rejects, gates and summary all read the checked rows. With `hand_over` those
    rows and the (few) gate verdicts go through storage once, so JSON is parsed once however
    many outputs are written; without it everything stays one lazy plan.
    """
    keep = stage if hand_over else (lambda df, _name: df)
    checked = keep(q.check_contract(raw), "checked")
    good = q.contract_survivors(checked)
    violations = q.gate_violations(good, q.GateInputs(catalog, last_seen), settings)
    decisive = keep(q.decisive_gate(violations), "decisive")
    landed = q.landed_events(good, decisive, existing)
    by_contract = q.contract_rejects(checked)
    by_gate = q.gate_rejects(good, decisive)
    new_rejects = by_contract.unionByName(by_gate).drop("event_id")
    all_rejects = new_rejects if existing_rejects is None else new_rejects.unionByName(
        existing_rejects)
    rejects = keep_first(all_rejects, ["reject_id"], ["reject_id"])
    return Ingested(landed, rejects,
                    ingest_summary(checked, landed, violations, decisive, settings))


def ingest_summary(checked: DataFrame, landed: DataFrame, violations: DataFrame,
                   decisive: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row: rows in, landed and quarantined by stage, rate, gates failed and passed."""
    counts = checked.agg(F.count(F.lit(1)).alias("rows_in"),
                         F.count_if(F.size("errors") > 0).alias("rows_rejected_contract"))
    kept = landed.agg(F.count(F.lit(1)).alias("rows_landed"))
    bad = decisive.agg(F.count(F.lit(1)).alias("rows_rejected_semantic"))
    failed = violations.agg(F.array_sort(F.collect_set("gate")).alias("failed"))
    every = F.array(*[F.lit(g) for g in sorted(settings.semantic_gates)])
    quarantined = F.col("rows_rejected_contract") + F.col("rows_rejected_semantic")
    # four one-row aggregates folded into one row
    names = ("rows_in", "rows_rejected_contract", "rows_landed", "rows_rejected_semantic",
             "failed")
    stacked = counts
    for part in (kept, bad, failed):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(*[F.max(n).alias(n) for n in names])
    return row.select(
        "rows_in", "rows_landed", "rows_rejected_contract", "rows_rejected_semantic",
        quarantined.alias("rows_quarantined"),
        F.coalesce(ratio(quarantined, F.col("rows_in")), F.lit(0.0)).alias("reject_rate"),
        F.array_join("failed", ",").alias("gates_failed"),
        F.array_join(F.array_except(every, F.col("failed")), ",").alias("gates_passed"))


def reject_rate_gate(summary: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The rate check as a row: observed, ceiling (inclusive), passed."""
    return summary.select(
        "rows_in", "rows_quarantined", "reject_rate",
        F.lit(settings.max_reject_rate).alias("max_reject_rate"),
        (F.col("reject_rate") <= settings.max_reject_rate).alias("passed"))
