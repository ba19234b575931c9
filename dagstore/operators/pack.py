"""Packs: order, candidate window, delta selection, fan-out table, cache residency."""

from __future__ import annotations

import zlib
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagstore.functions import delta
from dagstore.operators.reflog import ordered_fold
from dagstore.session import materialize

WINDOW, DEPTH = 250, 50


def numbered(objects: DataFrame) -> DataFrame:
    """Adds rank (from 1, per type) in pack order: name hash, then size descending, then id.

    Ranks are dealt out by range: rows are range-partitioned in order, partitions' counts are summed, so no type is
    ever sorted in one task.
    """
    order = [F.col("git_type"), F.col("name_hash"), F.col("size").desc(), F.col("id")]
    n = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(objects.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "order")
    w = Window.partitionBy("git_type").orderBy("__part")
    ahead = placed.groupBy("git_type", "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__ahead", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("git_type", "__part").orderBy(*order[1:]))
    return placed.withColumn("__row", own).join(ahead, ["git_type", "__part"]).withColumn("rank", (F.col("__row") + F.col("__ahead")).cast("long")).drop("__part", "__row", "__ahead")


def candidates(ranked: DataFrame, window: int = WINDOW) -> DataFrame:
    """id and base: for each object the up to window objects of its type before it.

    Ranks are cut into blocks of window; an object meets its own block and the one before by an equi-join.
    """
    block = F.floor((F.col("rank") - 1) / window).cast("long")
    a = ranked.select("git_type", F.col("id"), F.col("rank"), F.explode(F.array(block, block - 1)).alias("block"))
    b = ranked.select("git_type", F.col("id").alias("base"), F.col("rank").alias("base_rank"), block.alias("block"))
    j = a.join(b, ["git_type", "block"])
    return j.filter((F.col("base_rank") < F.col("rank")) & (F.col("base_rank") >= F.col("rank") - window)).select("id", "base", (F.col("rank") - F.col("base_rank")).alias("distance"))


def select_deltas(ranked: DataFrame, window: int = WINDOW, depth: int = DEPTH, block: int = 2000) -> DataFrame:
    """id, base, delta_size and depth of the objects worth storing as deltas (ranked: git_type, rank, id, content).

    Down the order, each object takes the base among the window before it that gives the smallest delta, smaller than
    itself, in a chain of at most depth; it is stored if it is smaller still when compressed.  The order is cut into
    runs of block objects, each one task that also reads the window before its run, so no boundary loses a base.  A run
    can't know how long the chains before it are, so it tells the bases with a smaller delta, smallest first, down to one
    whose chain has room however long those are; an ordered fold over these numbers, one task a type without contents,
    then takes the first whose chain has room.
    """
    last = F.floor((F.col("rank") - 1 + window) / block)
    read = ranked.select("git_type", "rank", "id", "content", F.explode(F.sequence(F.floor((F.col("rank") - 1) / block), last)).alias("run"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        recent = delta.DeltaWindow(window)
        longest: deque[int] = deque(maxlen=window)  # what the chains of the window may have at most, nearest first
        for row in pdf.sort_values("rank").itertuples():
            content, most = bytes(row.content or b""), depth
            if (row.rank - 1) // block == row.run:
                most, whole, tried = 0, None, []
                for size, distance, base, d in sorted(((len(d), distance, base, d) for distance, base, d in recent.encode(content) if len(d) < len(content)), key=lambda x: x[:2]):
                    whole = len(zlib.compress(content)) if whole is None else whole
                    good = len(zlib.compress(d)) < whole and delta.apply_delta(base, d) == content
                    tried.append((distance, size, good))
                    if good:
                        most = max(most, min(depth, longest[distance - 1] + 1))
                    if longest[distance - 1] < depth:  # its chain has room for certain: none after it can be taken
                        break
                distances, sizes, serves = zip(*tried, strict=True) if tried else ((), (), ())
                out.append((row.git_type, row.rank, row.id, list(distances), list(sizes), list(serves)))
            recent.push(content)
            longest.appendleft(most)
        return pd.DataFrame(out, columns=["git_type", "rank", "id", "distances", "sizes", "serves"])

    kind = dict(ranked.dtypes)
    found = read.groupBy("git_type", "run").applyInPandas(run, f"git_type {kind['git_type']}, rank bigint, id {kind['id']}, distances array<int>, sizes array<int>, serves array<boolean>")

    def step(recent: deque, row: tuple) -> tuple[deque, tuple]:
        name, distances, sizes, serves = row[-4:]
        base, size, chain = None, None, 0
        for distance, n, good in zip(distances, sizes, serves, strict=True):
            other, below = recent[distance - 1]
            if below < depth:  # the smallest with room decides, stored or not
                if good:
                    base, size, chain = other, n, below + 1
                break
        recent.appendleft((name, chain))
        return recent, (name, base, size, chain)

    ddl = f"git_type {kind['git_type']}, rank bigint, id {kind['id']}, base {kind['id']}, delta_size bigint, depth int"
    folded = ordered_fold(found, "git_type", "rank", lambda: deque(maxlen=window), step, ddl)
    return folded.filter("base is not null").select("id", "base", "delta_size", "depth")


def fanout(objects: DataFrame) -> DataFrame:
    """256 rows: how many hex ids begin with at most a byte's value (bucket, n, running)."""
    first = F.conv(F.substring("sha1", 1, 2), 16, 10).cast("int")
    n = objects.groupBy(first.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = objects.sparkSession.range(256).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left")
    filled = every.select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.withColumn("running", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def resident(entries: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """Cache entries (key, last_used, bytes) with kept: the newest that fit both bounds, the older evicted."""
    w = Window.orderBy(F.col("last_used").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    kept = (F.row_number().over(Window.orderBy(F.col("last_used").desc(), "key")) <= max_entries) & (F.sum("bytes").over(w) <= max_bytes)
    return entries.withColumn("kept", kept)


def repack_check(objects: DataFrame, packed: DataFrame) -> DataFrame:
    """Ids that a new pack lacks; deleting the old copies is safe only if there are none."""
    return objects.select("id").join(packed.select("id"), "id", "left_anti")


def repack_stats(objects: DataFrame, deltas: DataFrame) -> DataFrame:
    """objects, deltified, bytes before and bytes with deltas in place."""
    j = objects.select("id", "size").join(deltas.select("id", "delta_size"), "id", "left")
    return j.agg(F.count(F.lit(1)).alias("objects"), F.count("delta_size").alias("deltified"), F.sum("size").alias("bytes_before"), F.sum(F.coalesce("delta_size", "size")).alias("bytes_after"))
