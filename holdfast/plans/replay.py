"""Policy replay over decision days with contact feedback, and the randomised experiment.

A contact made on an earlier day counts in later caps, penalties and features. For policies
that do not price with a model, earlier contacts can only matter through the weekly contact
cap, so each day has two possible picks: one with the cap open, one with it closed. Both are
narrow columns. A customer's days (at most one row per decision day) then fold in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import CONSTRAINTS, SETTINGS, Settings
from holdfast.functions.ids import decision_id
from holdfast.operators import policies as po
from holdfast.operators.candidates import with_candidates
from holdfast.operators.context import WEEK
from holdfast.operators.outcomes import chosen, price, replay_rows
from holdfast.operators.rules import apply_rules, contact_windows
from holdfast.session import stage

CAP_CLOSED = 1 << 30
CONFIG_HASH = "settings-v1"
RANDOM, ORACLE = "random", "oracle_upper_bound"


def _picks(judged: DataFrame, policies: Sequence[str], settings: Settings) -> Column:
    """Array of (policy, candidate id, contact) for the survivors at hand."""
    out = []
    for name in policies:
        if name == RANDOM:
            wanted = po.random_pick(settings.seeds["experiment"])
        elif name == ORACLE:
            wanted = po.hindsight_pick(F.col("p"))["candidate_id"]
        else:
            wanted = po.settle(po.BASELINES[name]()[0])
        wanted = F.coalesce(wanted, F.lit("none"))
        found = chosen(F.col("survivors"), wanted)
        out.append(F.struct(F.lit(name).alias("policy"), wanted.alias("id"),
                            F.coalesce(found["contact"], F.lit(False)).alias("contact")))
    return F.array(*out)


def contact_cap(specs=CONSTRAINTS) -> tuple[int, int]:
    for _name, kind, mode, _precedence, params in specs:
        if kind == "frequency_cap" and mode == "hard":
            return int(params["max_contacts"]), int(params["window_days"])
    return CAP_CLOSED, WEEK


def _fold(days: Column, index: Column, cap: int, window: int,
          windows: Sequence[int]) -> Column:
    """Walk one customer's days: pick by cap state, remember contact days."""
    own = "".join(f"own_{w}d:bigint," for w in windows)
    empty = F.array().cast("array<bigint>")
    start = F.struct(
        empty.alias("made"),
        F.array().cast(f"array<struct<chosen_id:string,{own}own_total:bigint>>").alias("out"))

    def within(made: Column, day: Column, width: int) -> Column:
        return F.size(F.filter(made, lambda d: day - d <= width)).cast("long")

    def step(acc: Column, x: Column) -> Column:
        seen = x[f"contacts_{window}d"] + within(acc["made"], x["day"], window)
        pick = F.when(seen >= cap, F.get(x["closed"], index)).otherwise(F.get(x["open"], index))
        row = F.struct(pick["id"].alias("chosen_id"),
                       *[within(acc["made"], x["day"], w).alias(f"own_{w}d") for w in windows],
                       F.size(acc["made"]).cast("long").alias("own_total"))
        made = F.when(pick["contact"], F.concat(acc["made"], F.array(x["day"]))).otherwise(
            acc["made"])
        return F.struct(made.alias("made"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(days, start, step)["out"]


def replay(contexts: DataFrame, policies: Sequence[str],
           settings: Settings = SETTINGS, specs: Sequence[tuple] = CONSTRAINTS) -> DataFrame:
    """Replay rule-based policies; `contexts` carries `p`, the probability map, and a contact
    counter for each of `contact_windows(specs)`.

    One exchange on customer. Every (policy, customer, day) comes back with the contact
    counters its own history implies, judged and priced.
    """
    base = contexts.columns
    cap, window = contact_cap(specs)
    windows, counter = contact_windows(specs), f"contacts_{window}d"
    open_ = apply_rules(with_candidates(
        contexts.withColumn("_seen", F.col(counter)).withColumn(
            counter, F.lit(0).cast("long"))), specs)
    open_ = open_.withColumn("open", _picks(open_, policies, settings))
    shut = apply_rules(with_candidates(open_.withColumn(
        counter, F.lit(CAP_CLOSED).cast("long"))), specs)
    shut = shut.withColumn("closed", _picks(shut, policies, settings)).withColumn(
        counter, F.col("_seen"))
    entry = F.struct("day", *[c for c in base if c not in ("customer_id", "day")],
                     "open", "closed")
    # arrays are bounded by the number of decision days; `p` holds no order, so it sorts apart
    grouped = shut.groupBy("customer_id").agg(F.collect_list(entry).alias("days"))
    sorted_days = F.array_sort("days", lambda a, b: (a["day"] - b["day"]).cast("int"))
    walked = grouped.withColumn("days", sorted_days).select(
        "customer_id", "days",
        F.posexplode(F.array(*[F.lit(p) for p in policies])).alias("_i", "policy"))
    walked = walked.withColumn("_out", _fold(F.col("days"), F.col("_i"), cap, window,
                                               windows))
    rows = walked.select("policy", "customer_id", "_out",
                         F.posexplode("days").alias("_at", "_d"))
    flat = rows.select(
        "policy", "customer_id", "_d.day",
        *[F.col(f"_d.{c}").alias(c) for c in base if c not in ("customer_id", "day")],
        F.get(F.col("_out"), F.col("_at")).alias("_o"))
    return finish(flat.select("*", "_o.*").drop("_o"), settings, specs)


def add_own_contacts(rows: DataFrame, specs: Sequence[tuple] = CONSTRAINTS) -> DataFrame:
    """Add the policy's own contacts to the business's exposures."""
    spans = [*[f"{w}d" for w in contact_windows(specs)], "total"]
    return rows.withColumns({f"contacts_{s}": F.col(f"contacts_{s}") + F.col(f"own_{s}")
                             for s in spans}).drop(*[f"own_{s}" for s in spans])


def finish(rows: DataFrame, settings: Settings = SETTINGS,
           specs: Sequence[tuple] = CONSTRAINTS) -> DataFrame:
    """Judge with full contact history, rank for the runner-up, price, flatten."""
    judged = apply_rules(with_candidates(add_own_contacts(rows, specs)), specs)
    scored = po.choose(po.preference_scores(
        judged.withColumn("_keep", F.col("chosen_id")), F.col("_keep"), F.lit("")))
    # with no survivor at all `none` stands in
    scored = scored.withColumn("chosen_id", F.coalesce("_keep", F.lit("none")))
    as_of = F.date_add(F.lit(settings.start_date), F.col("day").cast("int")).cast("timestamp")
    is_engine = ~F.col("policy").isin(RANDOM, ORACLE)
    made = scored.withColumn("decision_id", F.when(is_engine, decision_id(
        F.col("customer_id"), as_of, F.col("policy"), F.lit(CONFIG_HASH), F.lit("")))
        .otherwise(F.lit(""))).withColumn(
        "runner_up", F.when(is_engine, F.coalesce("runner.candidate_id", F.lit("")))
        .otherwise(F.lit("")))
    return replay_rows(price(made, settings))


def experiment_log(contexts: DataFrame, features: dict[str, Column],
                   settings: Settings = SETTINGS) -> DataFrame:
    """Randomised assignment among survivors; only what a business can observe is kept."""
    rows = replay(contexts, [RANDOM], settings)
    split = F.when(F.col("day") < settings.train_end_day, "train").when(
        F.col("day") < settings.validation_end_day, "validation").otherwise("test")
    log = rows.select(
        "customer_id", "day", split.alias("split"), "primary_category", "candidate_id",
        "archetype", "discount_bps", "contact", "n_survivors", "prior_contacts", "converted",
        F.col("recent_contacts_7d").alias("_c7"))
    known = contexts.select("customer_id", "day", *[
        c.alias(n) for n, c in features.items() if n not in ("contacts_7d", "contacts_total")])
    wide = log.join(known, ["customer_id", "day"])
    own = {"contacts_7d": F.col("_c7").cast("double"),
           "contacts_total": F.col("prior_contacts").cast("double")}
    return wide.select(*log.columns[:-1], *[own.get(n, F.col(n)).alias(n) for n in features])


def replay_with_model(contexts: DataFrame, policy: str, score: Callable[[DataFrame], DataFrame],
                      settings: Settings = SETTINGS, days: Sequence[int] | None = None,
                      min_confidence: float | None = None, model_versions: str = "",
                      specs: Sequence[tuple] = CONSTRAINTS) -> DataFrame:
    """Replay a model policy day by day.

    Its features read the contacts made so far, so days are rounds. The state is one short
    array of contact days per customer, handed over through storage after every round: no
    lineage builds up and a lost executor replays one round.
    """
    days = list(days or settings.decision_days)
    spark = contexts.sparkSession
    state = spark.createDataFrame([], "customer_id string, made array<bigint>")
    done = None
    for day in days:
        today = contexts.where(F.col("day") == day).join(state, "customer_id", "left")
        made = F.coalesce("made", F.array().cast("array<bigint>"))
        for width in contact_windows(specs):
            since = F.lit(day - width)
            today = today.withColumn(f"own_{width}d", F.size(F.filter(
                made, lambda d: d >= since)).cast("long"))  # noqa: B023 (read at once)
        today = today.withColumn("own_total", F.size(made).cast("long")).withColumn(
            "made", made).withColumn("policy", F.lit(policy))
        judged = apply_rules(with_candidates(add_own_contacts(today, specs)), specs)
        picked = po.choose(score(judged), min_confidence)
        as_of = F.date_add(F.lit(settings.start_date), F.lit(int(day))).cast("timestamp")
        picked = picked.withColumn("decision_id", decision_id(
            F.col("customer_id"), as_of, F.col("policy"), F.lit(CONFIG_HASH),
            F.lit(model_versions)))
        picked = picked.withColumn("confidence", F.round("best.win_rate", 6)).withColumn(
            "uplift_estimate", F.round("best.uplift", 8)).withColumn(
            "expected_profit_estimate_cents", F.round("best.expected_profit_cents", 4)
        ).withColumn("runner_up", F.coalesce("runner.candidate_id", F.lit("")))
        flat = replay_rows(price(picked, settings))
        rows = stage(flat, f"replay-{day}")
        done = rows if done is None else done.unionByName(rows)
        contacted = rows.where("contact").select(
            "customer_id", F.array(F.lit(day).cast("long")).alias("made"))
        state = stage(state.unionByName(contacted).groupBy("customer_id").agg(
            F.array_sort(F.flatten(F.collect_list("made"))).alias("made")), f"state-{day}")
    return done
