"""Violation queries over the mart: every returned row is a fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings

Tables = dict[str, DataFrame]


class MartTestFailure(AssertionError):
    pass


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _violation(df: DataFrame, check: str, key: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), key.cast("string").alias("key"))


def unique_keys(t: Tables) -> DataFrame:
    specs = [
        ("dim_date", "dim_date", ["date_key"]), ("dim_customer", "dim_customer", ["customer_id"]),
        ("dim_action", "dim_action", ["candidate_id"]), ("dim_policy", "dim_policy", ["policy"]),
        ("fct_decisions", "fct_decisions", ["decision_key"]),
        ("fct_decisions_grain", "fct_decisions", ["policy_key", "customer_key", "date_key"]),
        ("fct_outcomes", "fct_outcomes", ["decision_key"]),
    ]
    return _union([
        _violation(t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                   name, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
        for name, table, keys in specs])


def not_null_keys(t: Tables) -> DataFrame:
    specs = [
        ("fct_decisions", "decision_key",
         ["decision_key", "policy_key", "customer_key", "date_key", "action_key"]),
        ("fct_outcomes", "decision_key", ["decision_key"]),
        ("dim_customer", "customer_id", ["customer_key", "customer_id"]),
        ("dim_date", "day_index", ["date_key"]),
    ]
    return _union([
        _violation(t[table].where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])),
                   table, F.col(key))
        for table, key, cols in specs])


def referential_integrity(t: Tables) -> DataFrame:
    specs = [("fct_decisions", "customer_key", "dim_customer"),
             ("fct_decisions", "action_key", "dim_action"),
             ("fct_decisions", "date_key", "dim_date"),
             ("fct_decisions", "policy_key", "dim_policy"),
             ("fct_outcomes", "decision_key", "fct_decisions")]
    return _union([
        _violation(t[fact].join(t[dim].select(key), key, "left_anti"), f"{fact}.{key}",
                   F.col("decision_key"))
        for fact, key, dim in specs])


def row_counts(t: Tables, settings: Settings = SETTINGS) -> DataFrame:
    """Counts that must agree: facts with their source, dimensions with theirs."""
    count = lambda name: t[name].agg(F.count(F.lit(1)).alias("n"))
    pairs = [("fct_decisions vs source", count("fct_decisions"), count("replay")),
             ("fct_outcomes vs fct_decisions", count("fct_outcomes"), count("fct_decisions")),
             ("dim_policy vs summary", count("dim_policy"), t["replay"].agg(
                 F.count_distinct("policy").alias("n")))]
    rows = [left.select(F.lit(name).alias("check_name"), F.col("n").alias("mart_rows"),
                        right.scalar().alias("source_rows")) for name, left, right in pairs]
    rows.append(count("dim_date").select(
        F.lit("dim_date vs horizon").alias("check_name"), F.col("n").alias("mart_rows"),
        F.lit(settings.horizon_days).cast("long").alias("source_rows")))
    every = _union(rows)
    empty = count("fct_decisions").where("n = 0").select(
        F.lit("fct_decisions empty").alias("check_name"), F.lit(0).cast("long")
        .alias("mart_rows"), F.lit(1).cast("long").alias("source_rows"))
    return every.where("mart_rows <> source_rows").unionByName(empty)


def business_rules(t: Tables, settings: Settings = SETTINGS) -> DataFrame:
    """Discount ceiling, KPI reconciliation (0.05), waste only on redeemed discounts."""
    above = t["fct_decisions"].join(F.broadcast(t["dim_action"].where(
        F.col("discount_bps") > settings.max_discount_bps)), "action_key")
    logged = t["replay"].groupBy("policy").agg(
        (F.sum("profit_cents") / 100).alias("logged_eur"))
    kpi = t["rpt_policy_kpis"].join(logged, "policy").where(
        F.abs(F.col("profit_eur") - F.col("logged_eur")) > 0.05)
    odd = t["fct_outcomes"].where(F.col("is_wasted_discount") & ~F.col("converted"))
    return _union([
        _violation(above, "discount above ceiling", F.col("decision_key")),
        _violation(kpi, "kpi profit mismatch", F.col("policy")),
        _violation(odd, "wasted discount not redeemed", F.col("decision_key"))])


CHECKS = {
    "test_unique_keys": unique_keys,
    "test_not_null_keys": not_null_keys,
    "test_referential_integrity": referential_integrity,
    "test_row_counts": row_counts,
    "test_business_rules": business_rules,
}


def violations(t: Tables) -> DataFrame:
    """All checks as one (test, check_name, key) table."""
    parts = []
    for name, check in CHECKS.items():
        found = check(t)
        key = (F.col("key") if "key" in found.columns else F.concat_ws(
            "|", F.col("mart_rows").cast("string"), F.col("source_rows").cast("string")))
        parts.append(found.select(F.lit(name).alias("test"), "check_name", key.alias("key")))
    return _union(parts)


def gate_report(t: Tables) -> DataFrame:
    """Violation count per test, zero included, and row count per mart table."""
    found = violations(t).groupBy("test").agg(F.count(F.lit(1)).alias("n"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows:" + name).alias("item"), "n") for name, df in sorted(t.items())]
    # every test is listed because each contributes a zero next to its violations
    anchor = t["dim_policy"].agg(F.lit(0).cast("long").alias("n"))
    zeros = [anchor.select(F.lit(name).alias("test"), "n") for name in CHECKS]
    tests = _union([found, *zeros]).groupBy("test").agg(F.sum("n").alias("n")).select(
        F.concat(F.lit("violations:"), "test").alias("item"), "n")
    return _union([tests, *counts])


def require_clean(t: Tables) -> None:
    """Fail the build when any violation exists."""
    bad = violations(t).limit(3).collect()
    if bad:
        raise MartTestFailure("; ".join(f"{r.test}: {r.check_name} {r.key}" for r in bad))
