"""Monitoring rules over samples (name, labels..., ts_us, value): rates, ratios, changes, durations, alerts.

A rate here is the sum of a counter's increases within the window, divided by the window's seconds; a value below its
predecessor is a reset, whose increase is the value itself.  (Evaluators that extrapolate to the window's edges give
slightly different figures.)  Windows end at each sample and are half open: a sample exactly a window old is out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def increases(samples: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Adds increase: by how much the counter rose since the series' last sample, resets taken out (0 at the first)."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy("ts_us", "offset"))
    up = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return samples.withColumn("increase", up.cast("double"))


def trailing_sum(samples: DataFrame, series: list[str], seconds: int, value: str, out: str) -> DataFrame:
    """Adds the sum of value over the window that ends at each sample, those of the same time included.

    Time is cut into spans of a window's length, so a window is the part of its own span up to the sample, and that of
    the span before after the sample's time less the window.  Both are running sums within a span: each row is added
    once however many share a window, and a series meets in as many tasks as it has spans.  Nothing is subtracted.
    """
    width = seconds * SECOND
    span = F.floor(F.col("ts_us") / width).cast("bigint")
    points = samples.select(*series, "ts_us", span.alias("__span"), value).groupBy(*series, "__span", "ts_us").agg(F.sum(value).alias("__sum"))
    points = points.withColumn("__at", F.col("ts_us"))
    asked = points.filter("ts_us is not null").select(*series, (F.col("__span") - 1).alias("__span"), "ts_us", F.lit(None).cast(dict(points.dtypes)["__sum"]).alias("__sum"), (F.col("ts_us") - width).alias("__at"))
    both = points.withColumn("__own", F.lit(True)).unionByName(asked.withColumn("__own", F.lit(False)))
    w = Window.partitionBy(*series, "__span")
    until = F.sum("__sum").over(w.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    after = F.sum("__sum").over(w.orderBy((-F.col("__at")).alias("__back")).rangeBetween(Window.unboundedPreceding, -1))
    sums = both.withColumns({"__until": until, "__after": after}).select(*series, "ts_us", F.when(F.col("__own"), F.col("__until")).otherwise(F.col("__after")).alias("__part"))
    sums = sums.groupBy(*series, "ts_us").agg(F.sum("__part").alias(out))
    keys = [*series, "ts_us"]
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], out)
    on = [samples[k].eqNullSafe(sums[f"__{k}"]) for k in keys]
    return samples.join(sums, on, "left").drop(*[f"__{k}" for k in keys])


def rate(samples: DataFrame, series: list[str], seconds: int, value: str = "value", out: str = "rate") -> DataFrame:
    """Adds the rate over the window that ends at each sample."""
    summed = trailing_sum(increases(samples, series, value), series, seconds, "increase", out)
    return summed.withColumn(out, F.col(out) / seconds).drop("increase")


def rate_at(samples: DataFrame, series: list[str], seconds: int, step: int, value: str = "value", out: str = "rate") -> DataFrame:
    """series, at (seconds, multiples of step) and rate of each window of seconds that ends there and has a sample.

    Each sample is counted into the seconds / step windows that hold it: one aggregation, no frame over a whole series.
    """
    up = increases(samples, series, value)
    first = (F.floor(F.col("ts_us") / (step * SECOND)) + 1) * step
    ends = F.explode(F.sequence(first, first + (seconds - step), F.lit(step).cast("bigint"))).alias("at")
    return up.select(*series, "increase", ends).groupBy(*series, "at").agg((F.sum("increase") / seconds).alias(out))


def mean_latency(sums: DataFrame, counts: DataFrame, series: list[str], seconds: int, step: int, above: float, min_rate: float) -> DataFrame:
    """series, at, mean and firing: rate of sums by rate of counts (0.001 at least), where both are over their bounds."""
    j = rate_at(sums, series, seconds, step, out="s").join(rate_at(counts, series, seconds, step, out="c"), [*series, "at"])
    mean = F.col("s") / F.greatest("c", F.lit(0.001))
    return j.select(*series, "at", mean.alias("mean"), ((mean > above) & (F.col("c") > min_rate)).alias("firing"))


def failure_ratio(samples: DataFrame, series: list[str], label: str, bad: str, by: list[str], seconds: int, step: int) -> DataFrame:
    """by, at, and the share of the rate whose label matches a regular expression as a whole."""
    r = rate_at(samples, [*series], seconds, step)
    failed = F.sum(F.when(F.rlike(label, F.lit(f"^(?:{bad})$")), F.col("rate")).otherwise(0.0))
    return r.groupBy(*by, "at").agg(failed.alias("failed"), (failed / F.greatest(F.sum("rate"), F.lit(0.001))).alias("ratio"))


def sum_rate(samples: DataFrame, series: list[str], by: list[str], seconds: int, step: int) -> DataFrame:
    return rate_at(samples, series, seconds, step).groupBy(*by, "at").agg(F.sum("rate").alias("rate"))


def ratio(a: DataFrame, b: DataFrame, on: list[str], floor: float = 0.001) -> DataFrame:
    """rate of a by rate of b (floor at least) where their labels and time agree."""
    j = a.select(*on, "at", F.col("rate").alias("a")).join(b.select(*on, "at", F.col("rate").alias("b")), [*on, "at"])
    return j.select(*on, "at", (F.col("a") / F.greatest("b", F.lit(floor))).alias("ratio"))


def changes(samples: DataFrame, series: list[str], seconds: int, value: str = "value") -> DataFrame:
    """Adds changes: how often the gauge took another value within the window that ends at each sample."""
    order = Window.partitionBy(*series).orderBy("ts_us", "offset")
    before = F.lag(value).over(order)
    marked = samples.withColumn("__changed", F.when(before.isNotNull() & (before != F.col(value)), 1).otherwise(0))
    return trailing_sum(marked, series, seconds, "__changed", "changes").drop("__changed")


def held_for(points: DataFrame, series: list[str], condition: Column, at: str, duration: int) -> DataFrame:
    """Adds pending_since (first point of the present run of true) and firing: the run is as long as duration (units of at)."""
    order = Window.partitionBy(*series).orderBy(at)
    on = points.withColumn("__on", F.coalesce(condition, F.lit(False)))
    island = F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(order)
    on = on.withColumn("__run", island)
    since = F.min(F.when(F.col("__on"), F.col(at))).over(Window.partitionBy(*series, "__run").orderBy(at))
    return on.withColumn("pending_since", F.when(F.col("__on"), since)).withColumn("firing", F.col("__on") & (F.col(at) - since >= duration)).drop("__on", "__run")


def latest(samples: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*series).agg(F.max_by(value, F.struct("ts_us", "offset")).alias(value))


def gauge_total(samples: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """Sum and greatest of the series' last values."""
    return latest(samples, series, value).agg(F.sum(value).alias("total"), F.max(value).alias("greatest"))


def gauge_difference(samples: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """Last value of gauge a less that of b, by the labels on."""
    last = latest(samples.filter(F.col("name").isin(a, b)), ["name", *on])
    return last.groupBy(*on).agg((F.max(F.when(F.col("name") == a, F.col("value"))) - F.max(F.when(F.col("name") == b, F.col("value")))).alias("difference"))
