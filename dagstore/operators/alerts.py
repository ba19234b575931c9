"""Alert rules over samples (name, labels map<string,string>, offset, ts_us, value), evaluated on a grid of time.

A rule is evaluated at every multiple of step seconds at which its series say something; it fires once its condition
has held at every evaluation for as long as the rule says.  An evaluation without a value is not true, so a gap begins
anew.  Label conditions are regular expressions that match the whole value; a label that is missing is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagstore.operators.monitor import SECOND, increases, rate_at

STEP = 15  # seconds between evaluations
STALE = 300  # seconds after which a gauge's last sample says nothing any more

# fixed values: the rules' metrics, labels, windows, bounds and durations (seconds)
RULES = {
    "instance_down": {"kind": "gauge", "metric": "up", "is": 0, "for": 120},
    "git_latency": {"kind": "mean", "metric": "git_request_duration_seconds", "window": 300, "above": 2, "traffic": 0.05, "for": 600},
    "object_write_latency": {"kind": "mean", "metric": "object_write_duration_seconds", "window": 300, "above": 0.5, "traffic": 0.1, "for": 600},
    "rpc_latency": {"kind": "mean", "metric": "rpc_request_duration_seconds", "window": 300, "above": 1, "traffic": 0.05, "for": 600},
    "auth_failures": {"kind": "rate", "metric": "auth_requests_total", "labels": {"result": "unauthenticated|forbidden"}, "window": 300, "above": 5, "for": 600},
    "tenant_denied": {"kind": "rate", "metric": "tenant_denied_total", "window": 300, "above": 1, "for": 600},
    "webhook_failures": {"kind": "share", "metric": "webhook_deliveries_total", "labels": {"result": "failed"}, "by": ["instance"], "window": 600, "above": 0.2, "traffic": 0.01, "for": 600},
    "sync_failing": {"kind": "rate", "metric": "sync_total", "labels": {"result": "failed"}, "window": 900, "above": 0, "for": 900},
    "quota_denials": {"kind": "rate", "metric": "quota_denied_total", "by": ["instance", "resource"], "window": 600, "above": 0, "for": 900},
    "cas_contention": {"kind": "quotient", "metric": "ref_cas_retries_total", "of": "ref_updates_total", "window": 300, "above": 1, "traffic": 0.1, "for": 900},
    "no_leader": {"kind": "gauge", "metric": "raft_leader", "is": 0, "for": 60},
    "elections_flapping": {"kind": "changes", "metric": "raft_term", "window": 900, "above": 3, "for": 0},
    "apply_lag": {"kind": "difference", "metric": "raft_commit_index", "of": "raft_last_applied", "above": 1000, "for": 300},
    "prepared_locks_stuck": {"kind": "gauge", "metric": "prepared_locks", "above": 0, "for": 900},
    "txn_aborts": {"kind": "rate", "metric": "txn_aborted_total", "by": ["instance"], "window": 600, "above": 1, "for": 600},
}
LEAST = 0.001  # a rate that divides counts as so much at least


def series_of(labels: Column) -> Column:
    """Labels as one text, by name."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def select(samples: DataFrame, metric: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The metric's samples whose labels match, with series."""
    out = samples.filter(F.col("name") == metric)
    for key, pattern in (labels or {}).items():
        out = out.filter(F.rlike(F.coalesce(F.element_at("labels", F.lit(key)), F.lit("")), F.lit(f"^(?:{pattern})$")))
    return out.withColumn("series", series_of(F.col("labels")))


def by_labels(points: DataFrame, by: list[str] | None, value: str = "rate") -> DataFrame:
    """The sum of points (series, at) over series that agree in the labels by; without by, each series alone."""
    if by is None:
        return points
    kept = F.map_filter(F.from_json("series", "map<string,string>"), lambda k, _: k.isin(by))
    return points.withColumn("series", series_of(kept)).groupBy("series", "at").agg(F.sum(value).alias(value))


def instants(samples: DataFrame, step: int) -> DataFrame:
    """series, at and value: a gauge's last sample at every evaluation, until the next one or until it is stale."""
    w = Window.partitionBy("series").orderBy("ts_us", "offset")
    until = F.least(F.coalesce(F.lead("ts_us").over(w) - 1, F.lit(1 << 62)), F.col("ts_us") + (STALE * SECOND - 1))
    grid = step * SECOND
    spans = samples.select("series", "value", F.ceil(F.col("ts_us") / grid).alias("first"), F.floor(until / grid).alias("last"))
    each = spans.filter("first <= last").select("series", "value", F.explode(F.sequence("first", "last")).alias("k"))
    return each.select("series", (F.col("k") * step).alias("at"), "value")


def changes_at(samples: DataFrame, window: int, step: int) -> DataFrame:
    """series, at and value: how often a gauge took another value within the window that ends at each evaluation."""
    w = Window.partitionBy("series").orderBy("ts_us", "offset")
    moved = samples.withColumn("moved", F.coalesce((F.lag("value").over(w) != F.col("value")).cast("int"), F.lit(0)))
    first = (F.floor(F.col("ts_us") / (step * SECOND)) + 1) * step
    ends = F.explode(F.sequence(first, first + (window - step), F.lit(step).cast("bigint"))).alias("at")
    return moved.select("series", "moved", ends).groupBy("series", "at").agg(F.sum("moved").cast("double").alias("value"))


def points(samples: DataFrame, rule: dict, step: int = STEP) -> DataFrame:
    """series, at, value and active: the rule's expression at every evaluation."""
    kind, metric, labels, window = rule["kind"], rule["metric"], rule.get("labels"), rule.get("window")
    bound = (F.col("value") == rule["is"]) if "is" in rule else (F.col("value") > rule["above"])
    rates = lambda name, match=None: by_labels(rate_at(select(samples, name, match), ["series"], window, step), rule.get("by"))
    if kind == "gauge":
        out = instants(select(samples, metric, labels), step)
    elif kind == "changes":
        out = changes_at(select(samples, metric, labels), window, step)
    elif kind == "rate":
        out = rates(metric, labels).withColumnRenamed("rate", "value")
    elif kind == "difference":
        other = instants(select(samples, rule["of"], labels), step).withColumnRenamed("value", "other")
        out = instants(select(samples, metric, labels), step).join(other, ["series", "at"]).withColumn("value", F.col("value") - F.col("other"))
    else:  # one rate by another, where there is traffic
        upper, lower = {"mean": (f"{metric}_sum", f"{metric}_count"), "share": (metric, metric), "quotient": (metric, rule.get("of"))}[kind]
        up = rates(upper, labels).withColumnRenamed("rate", "up")
        out = up.join(rates(lower), ["series", "at"]).withColumn("value", F.col("up") / F.greatest("rate", F.lit(LEAST)))
        bound = bound & (F.col("up" if kind == "share" else "rate") > rule["traffic"])
    return out.select("series", "at", "value", bound.alias("active"))


def evaluate(samples: DataFrame, rule: dict, step: int = STEP) -> DataFrame:
    """series, at, value, active and firing of every evaluation at which the rule has a value."""
    found = points(samples, rule, step)
    w = Window.partitionBy("series").orderBy("at")
    begins = F.col("active") & ~(F.coalesce(F.lag("active").over(w), F.lit(False)) & (F.col("at") - F.lag("at").over(w) == step))
    since = F.max(F.when(F.col("begins"), F.col("at"))).over(w)
    out = found.withColumn("begins", F.coalesce(begins, F.col("active"))).withColumn("since", since)
    return out.select("series", "at", "value", "active", (F.col("active") & (F.col("at") - F.col("since") >= rule.get("for", 0))).alias("firing"))


def alerts(samples: DataFrame, rules: dict[str, dict] | None = None, step: int = STEP) -> DataFrame:
    """rule, series, at and value of every evaluation at which a rule fires."""
    out = None
    for name, rule in (RULES if rules is None else rules).items():
        fired = evaluate(samples, rule, step).filter("firing").select(F.lit(name).alias("rule"), "series", "at", "value")
        out = fired if out is None else out.unionByName(fired)
    return out
