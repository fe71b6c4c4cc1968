"""BI measures: aggregate columns that work under any grouping of the star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import ratio, share


def _rows() -> Column:
    return F.count(F.lit(1))


def decision_measures() -> dict[str, Column]:
    c = F.col
    pred, true = F.avg("uplift_estimate"), F.avg("true_uplift")
    return {
        "decisions": _rows(),
        "contact_rate": share(c("is_contact")),
        "restraint_rate": share(c("is_restraint")),
        "discount_rate": share(c("is_discount")),
        "conversions": F.count_if("converted"),
        "conversion_rate": share(c("converted")),
        "profit": F.sum("profit_eur"),
        "expected_profit": F.sum("expected_profit_eur"),
        "profit_vs_doing_nothing":
            F.sum("expected_profit_eur") - F.sum("expected_profit_if_nothing_eur"),
        "discount_cost": F.sum("discount_cost_eur"),
        "avg_predicted_uplift": pred,
        "avg_true_uplift": true,
        "uplift_error_pp": (pred - true) * 100,
        "wasted_discount_share": ratio(
            F.count_if("is_wasted_discount"), F.count_if(c("converted") & c("is_discount"))),
        "no_incentive_rate": ratio(
            F.count_if(c("would_buy_anyway") & ~c("is_discount")), F.count_if("would_buy_anyway")),
        "mean_regret_cents": F.avg("regret_eur") * 100,
        "overrides": F.count_if("is_overridden"),
        "override_rate": share(c("is_overridden")),
        "avg_confidence": F.avg("confidence"),
        "customers": F.count_distinct("customer_key"),
    }


def model_measures() -> dict[str, Column]:
    test_all = (F.col("split") == "test") & (F.col("archetype") == "all")
    return {"brier_test": F.avg(F.when(test_all, F.col("brier"))),
            "ece_test": F.avg(F.when(test_all, F.col("ece")))}


def customer_measures() -> dict[str, Column]:
    """Averages over dimension rows, not over decisions."""
    return {"customers_listed": _rows(), "avg_clv_estimate": F.avg("clv_12m_estimate_eur")}


def measures(df: DataFrame, *dims: str, names: list[str] | None = None,
             catalog: dict[str, Column] | None = None) -> DataFrame:
    """The chosen measures of `catalog` by `dims` (no dims: the grand total)."""
    catalog = catalog or decision_measures()
    return df.groupBy(*dims).agg(*[catalog[n].alias(n) for n in names or catalog])
