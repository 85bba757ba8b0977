"""Alert rules, evaluation state machine, routing and life cycle.

Rules are data (UDF-03).  Metric observations are matched to the enabled
rules of the same name by an equi-join (JN-06), the operator string
becomes a comparison (PRJ-12), and the consecutive-failure / cooldown machine
(ST-04) runs per rule with ``applyInPandas``.  The groups are metric *time
series* (one row per evaluation tick), so their size is set by the time span
and tick length, not by the data volume behind each tick.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE_SCHEMA = ("name string, metric_name string, operator string, threshold double, severity string, "
               "alert_type string, enabled boolean, consecutive_failures int, cooldown_period int, "
               "notification_channels array<string>")

# Default rule set (fixed values of this library; cooldown in seconds).
DEFAULT_RULES = [
    ("high_error_rate", "error_rate", ">", 0.05, "high", "system", True, 3, 3600, ["logging", "email"]),
    ("slow_responses", "avg_response_time", ">", 1.2, "medium", "performance", True, 2, 1800, ["logging"]),
    ("p95_latency", "p95_response_time", ">=", 3.0, "high", "performance", True, 2, 1800, ["webhook"]),
    ("high_cpu", "cpu_percent", ">", 80.0, "critical", "system", True, 1, 7200, ["logging", "webhook"]),
    ("high_memory", "memory_percent", ">", 90.0, "critical", "system", True, 1, 7200, ["email"]),
    ("low_traffic", "requests", "<", 1.0, "low", "availability", False, 5, 600, ["logging"]),
]


def rules_table(spark: SparkSession, rules=None) -> DataFrame:
    """Rules as data; ``rule_order`` keeps the registration order (used by routing)."""
    rows = [tuple(r) + (i,) for i, r in enumerate(rules or DEFAULT_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA + ", rule_order int")


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """PRJ-12: operator string -> comparison; unknown operator -> false."""
    return (F.when(op == ">", value > threshold).when(op == "<", value < threshold)
            .when(op == ">=", value >= threshold).when(op == "<=", value <= threshold)
            .when(op == "==", value == threshold).when(op == "!=", value != threshold)
            .otherwise(F.lit(False)))


def long_metrics(df: DataFrame, ts: str, metric_cols) -> DataFrame:
    """Wide metric table -> (ts, metric_name, value)."""
    return df.select(F.col(ts).alias("ts"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("value")) for c in metric_cols]))
        .alias("m")).select("ts", "m.metric_name", "m.value").where(F.col("value").isNotNull())


def match_rules(metrics_long: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-06 + PRJ-12: every observation against the enabled rules of its metric."""
    r = rules.where("enabled")
    j = metrics_long.join(r, "metric_name")          # rules are a user's table: Spark broadcasts it while it is small
    return j.withColumn("violated", F.coalesce(compare(F.col("value"), F.col("operator"), F.col("threshold")),
                                               F.lit(False)))


EVAL_SCHEMA = ("name string, ts timestamp_ntz, metric_name string, value double, threshold double, "
               "severity string, alert_type string, failures int, fired boolean")


def _rule_machine(pdf: pd.DataFrame) -> pd.DataFrame:
    """ST-04 batch twin: counter++ on violation, fire when count >= N and the
    last fire is older than the cooldown (strict), reset on fire and on pass."""
    pdf = pdf.sort_values(["ts"], kind="mergesort")
    need = int(pdf["consecutive_failures"].iloc[0])
    cooldown = pd.Timedelta(seconds=int(pdf["cooldown_period"].iloc[0]))
    count, last_fire = 0, None
    fails, fired = [], []
    for ts, v in zip(pdf["ts"], pdf["violated"]):
        f = False
        if v:
            count += 1
            if count >= need and (last_fire is None or ts - last_fire > cooldown):
                f = True
                last_fire = ts
                count = 0
        else:
            count = 0
        fails.append(count)
        fired.append(f)
    out = pdf[["name", "ts", "metric_name", "value", "threshold", "severity", "alert_type"]].copy()
    out["failures"] = pd.Series(fails, index=pdf.index, dtype="int32")
    out["fired"] = fired
    return out


def evaluate_rules(matched: DataFrame) -> DataFrame:
    """ST-04 / WIN-02 with feedback: per-rule state machine over the tick series."""
    cols = ["name", "ts", "metric_name", "value", "threshold", "severity", "alert_type",
            "consecutive_failures", "cooldown_period", "violated"]
    return matched.select(*cols).groupBy("name").applyInPandas(_rule_machine, EVAL_SCHEMA)


def fired_alerts(evaluated: DataFrame) -> DataFrame:
    """MON-08: fired rows with a deterministic id (replay-safe)."""
    f = evaluated.where("fired")
    return f.select(F.md5(F.concat_ws(",", "name", "metric_name", F.col("ts").cast("string"))).alias("alert_id"),
                    "ts", "name", "severity", "alert_type", "metric_name",
                    F.col("value").alias("current_value"), F.col("threshold").alias("threshold_value"),
                    F.concat(F.lit("Alert: "), F.col("name")).alias("title"))


def route(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """JN-07: 'logging' plus the channels of the first rule (registration order,
    enabled or not) with the same metric or the same alert type; one row per
    distinct (alert, channel)."""
    first = F.min(F.struct("rule_order", "notification_channels"))       # one row a metric, one a type
    by_metric = rules.groupBy("metric_name").agg(first.alias("_m"))
    by_type = rules.groupBy("alert_type").agg(first.alias("_t"))
    j = alerts.join(by_metric, "metric_name", "left").join(by_type, "alert_type", "left")
    chosen = F.when(F.col("_t.rule_order") < F.col("_m.rule_order"), F.col("_t")).otherwise(F.coalesce("_m", "_t"))
    chans = F.array_union(F.array(F.lit("logging")), F.coalesce(chosen["notification_channels"], F.array().cast("array<string>")))
    return j.select(*[F.col(c) for c in alerts.columns], F.explode(chans).alias("channel"))


def lifecycle(events: DataFrame, as_of: Column) -> DataFrame:
    """MON-07: latest status event per alert; suppression ends at ``suppressed_until``."""
    latest = events.groupBy("alert_id").agg(
        F.max_by(F.struct("status", "actor", "suppressed_until", "event_ts"),
                 F.struct("event_ts", "seq")).alias("s"))
    st = F.col("s.status")
    effective = F.when((st == "suppressed") & (F.col("s.suppressed_until") <= as_of), "active").otherwise(st)
    return latest.select("alert_id", effective.alias("status"), F.col("s.actor").alias("actor"),
                         F.col("s.event_ts").alias("updated_at"),
                         (effective != "resolved").alias("is_active"))


def status_intervals(events: DataFrame) -> DataFrame:
    """MON-07: how long each status of an alert holds: alert_id, status, actor, valid_from, valid_to (exclusive, null: open).

    ``events``: alert_id, status, actor, suppressed_until, event_ts, seq.  A suppression that nothing ends
    before expires: from ``suppressed_until`` on the alert is active again.  Of events at the same time the
    one with the highest ``seq`` holds."""
    nxt = F.lead("event_ts").over(Window.partitionBy("alert_id").orderBy("event_ts", "seq"))     # a few events an alert
    e = events.withColumn("next", nxt)
    expires = F.coalesce((F.col("status") == "suppressed") & F.col("suppressed_until").isNotNull()
                         & (F.col("next").isNull() | (F.col("suppressed_until") < F.col("next"))), F.lit(False))
    first = F.struct("status", "actor", F.col("event_ts").alias("valid_from"),
                     F.when(expires, F.greatest("event_ts", "suppressed_until")).otherwise(F.col("next")).alias("valid_to"))
    second = F.when(expires, F.struct(F.lit("active").alias("status"), F.lit("expiry").alias("actor"),
                                      F.greatest("event_ts", "suppressed_until").alias("valid_from"), F.col("next").alias("valid_to")))
    out = e.select("alert_id", F.explode(F.array_compact(F.array(first, second))).alias("i")).select("alert_id", "i.*")
    return out.where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def status_as_of(intervals: DataFrame, as_of: list[str]) -> DataFrame:
    """MON-07: the status of each alert that exists at each of the given times; ``is_active``: not resolved."""
    times = F.array(*[F.lit(t).cast("timestamp_ntz") for t in as_of])
    holds = (F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to")))
    return intervals.select("*", F.explode(times).alias("as_of")).where(holds).withColumn("is_active", F.col("status") != "resolved")


# ---- UDF-03: predicates as text ------------------------------------------------
#: Expressions of Spark's analysed plan that a rule may hold.
ALLOWED = {"Alias", "AttributeReference", "Literal", "Cast", "And", "Or", "Not", "EqualTo", "EqualNullSafe", "GreaterThan",
           "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "IsNull", "IsNotNull", "IsNaN", "Add", "Subtract", "Multiply",
           "Divide", "Remainder", "UnaryMinus", "UnaryPositive", "Abs", "Coalesce", "If", "CaseWhen", "Least", "Greatest", "Round",
           "Floor", "Ceil", "Sqrt", "Log", "Exp", "Pow", "Lower", "Upper", "Like", "StartsWith", "EndsWith", "Contains",
           "Between", "With", "CommonExpressionDef", "CommonExpressionRef"}     # the last four make up BETWEEN


class ForbiddenPredicate(ValueError):
    """A predicate holds something that a rule may not hold."""


def checked_predicate(df: DataFrame, text: str) -> Column:
    """The boolean column of a rule's text over the columns of ``df``.

    The text is parsed and analysed by Spark, and every expression of the analysed plan must be on the
    allow-list: no subqueries, user functions, reflection, aggregates, windows, generators or random values."""
    planned = df.select(F.expr(text).alias("p"))
    plan = planned._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "Project" or not plan.child().sameResult(df._jdf.queryExecution().analyzed()):
        raise ForbiddenPredicate(f"not a row-wise expression: {text}")
    names: set[str] = set()

    def walk(e) -> None:
        names.add(e.getClass().getSimpleName())
        children = e.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan.projectList().head())
    if names - ALLOWED:
        raise ForbiddenPredicate(f"{', '.join(sorted(names - ALLOWED))} in: {text}")
    if planned.schema["p"].dataType.simpleString() != "boolean":
        raise ForbiddenPredicate(f"not a condition: {text}")
    return F.expr(text)


def match_predicates(metrics: DataFrame, ts: str, rules: dict[str, str]) -> DataFrame:
    """UDF-03: ts, name, violated of each rule (name -> predicate text) at each tick; a null condition is no violation."""
    checked = [F.struct(F.lit(n).alias("name"), F.coalesce(checked_predicate(metrics, t), F.lit(False)).alias("violated"))
               for n, t in rules.items()]
    return metrics.select(F.col(ts).alias("ts"), F.explode(F.array(*checked)).alias("r")).select("ts", "r.*")
