"""Queries over alert rules: every kind of rule over samples made of events, with bounds that these samples meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from dagstore.operators import alerts
from dagstore.plans import fixtures as fx
from dagstore.plans.fixtures import sql
from dagstore.plans.registry import query

STEP = 60
VIEWS, CLICKS = "name = 'view'", "name = 'click'"
FAILED = f'{VIEWS} AND "offset" % 3 = 1'
MATCH = f'{CLICKS} AND "offset" % 3 IN (1, 2)'

LABELLED = """, m AS (SELECT name, "offset", ts_us, gauge, counter, total, '{"instance":"i' || instance || '","result":"' || ['ok', 'failed', 'denied']["offset" % 3 + 1] || '"}' AS series, '{"instance":"i' || instance || '"}' AS by_instance FROM samples)"""


def labelled(spark, d, value, result=True):
    """Samples with labels instance and, where results tell series apart, result."""
    s = fx.samples(spark, d).withColumn("tens", F.floor(F.col("gauge") / 10).cast("double"))
    pairs = [F.lit("instance"), F.concat(F.lit("i"), "instance")]
    if result:
        pairs += [F.lit("result"), F.element_at(F.array(F.lit("ok"), F.lit("failed"), F.lit("denied")), (F.col("offset") % 3 + 1).cast("int"))]
    return s.select("name", F.create_map(*pairs).alias("labels"), "offset", "ts_us", F.col(value).alias("value"))


def _rates(series: str, seconds: int, value: str = "counter", where: str = "true", by: str = "series") -> str:
    """SQL of the rate of every series, summed by another."""
    g = STEP * 1_000_000
    return f"""SELECT s, "at", sum(r) AS rate FROM (SELECT {series} AS k, any_value({by}) AS s, "at", sum(up) / {seconds} AS r FROM (
        SELECT *, unnest(generate_series((ts_us // {g} + 1) * {STEP}, (ts_us // {g} + 1) * {STEP} + {seconds - STEP}, {STEP})) AS "at" FROM (
        SELECT *, CASE WHEN lag({value}) OVER w IS NULL THEN 0 WHEN {value} >= lag({value}) OVER w THEN {value} - lag({value}) OVER w ELSE {value} END AS up
        FROM m WHERE {where} WINDOW w AS (PARTITION BY {series} ORDER BY ts_us, "offset"))) GROUP BY {series}, "at") GROUP BY s, "at\""""


def _instants(series: str, name: str) -> str:
    g = STEP * 1_000_000
    return f"""SELECT series, unnest(generate_series(a, b)) * {STEP} AS "at", gauge AS value FROM (SELECT {series} AS series, gauge, (ts_us + {g - 1}) // {g} AS a,
        least(coalesce(lead(ts_us) OVER (PARTITION BY {series} ORDER BY ts_us, "offset") - 1, 4611686018427387904), ts_us + 299999999) // {g} AS b FROM m WHERE name = '{name}') WHERE a <= b"""


def _held(points: str, duration: int) -> str:
    """SQL of evaluate() over points (series, at, value, active)."""
    return f"""SELECT series, "at", round(value, 6) AS value, active, active AND "at" - max(CASE WHEN begins THEN "at" END) OVER (PARTITION BY series ORDER BY "at") >= {duration} AS firing FROM (
        SELECT *, active AND NOT coalesce(lag(active) OVER w AND "at" - lag("at") OVER w = {STEP}, false) AS begins FROM ({points}) WINDOW w AS (PARTITION BY series ORDER BY "at"))"""


def _evaluate(spark, d, rule, value="counter", result=True):
    found = alerts.evaluate(labelled(spark, d, value, result), rule, STEP)
    return found.withColumn("value", F.round("value", 6)).withColumn("firing", F.coalesce("firing", F.lit(False)))


def _rule(name: str, body: str, rule: dict, value: str = "counter", result: bool = True) -> None:
    text = sql(LABELLED + f" SELECT series, \"at\", value, active, coalesce(firing, false) AS firing FROM ({_held(body, rule['for'])})", "samples")
    query(name, text)(lambda spark, d: _evaluate(spark, d, rule, value, result))


_rule("alert_gauge_above", f"SELECT *, value > 5 AS active FROM ({_instants('by_instance', 'view')})", {"kind": "gauge", "metric": "view", "above": 5, "for": 180}, "gauge", False)
_rule("alert_gauge_is", f"SELECT *, value = 0 AS active FROM ({_instants('by_instance', 'error').replace('gauge AS value', 'floor(gauge / 10) AS value')})", {"kind": "gauge", "metric": "error", "is": 0, "for": 120}, "tens", False)
_rule(
    "alert_rate_label_regex",
    f"SELECT s AS series, \"at\", rate AS value, rate > 0.004 AS active FROM ({_rates('series', 600, where=MATCH)})",
    {"kind": "rate", "metric": "click", "labels": {"result": "failed|denied"}, "window": 600, "above": 0.004, "for": 120},
)
_rule("alert_rate_by", "SELECT s AS series, \"at\", rate AS value, rate > 0.005 AS active FROM (" + _rates("series", 900, where="name = 'view'", by="by_instance") + ")", {"kind": "rate", "metric": "view", "by": ["instance"], "window": 900, "above": 0.005, "for": 300})
_rule(
    "alert_share",
    f"SELECT a.s AS series, a.\"at\", a.rate / greatest(b.rate, 0.001) AS value, a.rate / greatest(b.rate, 0.001) > 0.2 AND a.rate > 0.001 AS active FROM ({_rates('series', 900, where=FAILED, by='by_instance')}) a JOIN ({_rates('series', 900, where=VIEWS, by='by_instance')}) b ON a.s = b.s AND a.\"at\" = b.\"at\"",
    {"kind": "share", "metric": "view", "labels": {"result": "failed"}, "by": ["instance"], "window": 900, "above": 0.2, "traffic": 0.001, "for": 240},
)
_rule(
    "alert_quotient",
    f"SELECT a.s AS series, a.\"at\", a.rate / greatest(b.rate, 0.001) AS value, a.rate / greatest(b.rate, 0.001) > 1 AND b.rate > 0.001 AS active FROM ({_rates('by_instance', 1800, where=VIEWS, by='by_instance')}) a JOIN ({_rates('by_instance', 1800, where=CLICKS, by='by_instance')}) b ON a.s = b.s AND a.\"at\" = b.\"at\"",
    {"kind": "quotient", "metric": "view", "of": "click", "window": 1800, "above": 1, "traffic": 0.001, "for": 120},
    result=False,
)
_rule(
    "alert_difference",
    f"SELECT a.series, a.\"at\", a.value - b.value AS value, a.value - b.value > 1 AS active FROM ({_instants('by_instance', 'view')}) a JOIN ({_instants('by_instance', 'click')}) b ON a.series = b.series AND a.\"at\" = b.\"at\"",
    {"kind": "difference", "metric": "view", "of": "click", "above": 1, "for": 60},
    "gauge",
    False,
)
_rule(
    "alert_changes",
    f"""SELECT series, "at", CAST(sum(c) AS DOUBLE) AS value, sum(c) > 3 AS active FROM (SELECT by_instance AS series, c, unnest(generate_series((ts_us // {STEP * 1000000} + 1) * {STEP}, (ts_us // {STEP * 1000000} + 1) * {STEP} + {3600 - STEP}, {STEP})) AS "at" FROM (
        SELECT *, CASE WHEN floor(gauge / 10) <> lag(floor(gauge / 10)) OVER (PARTITION BY by_instance ORDER BY ts_us, "offset") THEN 1 ELSE 0 END AS c FROM m WHERE name = 'error')) GROUP BY series, "at\"""",
    {"kind": "changes", "metric": "error", "window": 3600, "above": 3, "for": 0},
    "tens",
    False,
)
