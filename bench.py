"""Times the stages a daily run goes through; prints one JSON line.

Each stage reads what the stage before it wrote, as in production. Nothing is reused between
runs: the workspace writes to a fresh folder.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from holdfast.checks import queries as reports  # noqa: E402
from holdfast.checks.workspace import ML_POLICY, REPLAYED, Workspace  # noqa: E402
from holdfast.operators import evaluation, gateway, mart_checks  # noqa: E402
from holdfast.operators import candidates as ac  # noqa: E402
from holdfast.operators import policies as po  # noqa: E402
from holdfast.operators import rules as ru  # noqa: E402
from holdfast.session import make_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(ws: Workspace) -> dict:
    return {
        "events": lambda: ws.events,
        "ingest_contract": lambda: ws.checked,
        "ingest_land": lambda: (ws.landed, ws.rejects),
        "features": lambda: ws.grid,
        "contexts": lambda: ws.all_contexts,
        "decisions": lambda: run(po.choose(po.baseline(
            ru.apply_rules(ac.with_candidates(ws.all_contexts)), "rules_only")).select(
            "customer_id", "day", "chosen_id", "score_gap")),
        "expected_value": lambda: run(po.choose(reports._ev_scored(ws), 0.5).select(
            "customer_id", "day", "chosen_id", "best")),
        "experiment": lambda: ws.experiment,
        "replay": lambda: ws.log,
        "evaluate": lambda: run(evaluation.policy_summary(ws.log, REPLAYED,
                                                          ml_policy=ML_POLICY)),
        "gateway": lambda: run(gateway.adjudicate(evaluation.readouts(
            ws.log, "top_seller", ["rules_only", "do_nothing"], 8))),
        "segments": lambda: run(ws.segments),
        "mart": lambda: run(ws.tables["rpt_policy_kpis"]),
        "mart_tests": lambda: run(mart_checks.gate_report(ws.tables)),
        "train_logistic": lambda: reports._fitted(ws),
    }


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    ws = Workspace(spark, root)
    times = {}
    for name, step in stages(ws).items():
        begin = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "daily_run_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(root)}))
    spark.stop()


if __name__ == "__main__":
    main()
