"""Logs of versioned pointers: replay, point-in-time views, and folds of compare-and-swap operations.

``ordered_fold`` is the one stateful building block: rows are dealt out and sorted by key and offset, and a state
machine runs down each partition with only the current key's state in memory, however long the key's log is.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since_checkpoint(log: DataFrame) -> DataFrame:
    """The entries from the last checkpoint on: a checkpoint holds all that came before."""
    last = log.filter("kind = 'checkpoint'").agg(F.max("offset").alias("__at"))
    return log.join(F.broadcast(last), F.coalesce(F.col("__at"), F.col("offset")) <= F.col("offset")).drop("__at")


def latest_per_key(log: DataFrame, key: str, offset: str = "offset", tombstones: str = "kind = 'delete'") -> DataFrame:
    """The last entry of each key, if it is no tombstone."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), offset).alias("__last"))
    return last.select(key, "__last.*").filter(f"not ({tombstones})")


def as_of(log: DataFrame, key: str, offset: int) -> DataFrame:
    """The table as it was right after an offset."""
    return latest_per_key(log.filter(F.col("offset") <= offset), key)


def versions(log: DataFrame) -> DataFrame:
    """The version of every accepted put: from 1, one more each time, anew after a delete (name, offset, kind)."""
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("offset")
    lives = log.withColumn("life", F.sum(F.when(F.col("kind") == "delete", 1).otherwise(0)).over(w))
    return lives.filter("kind <> 'delete'").withColumn("version", F.row_number().over(Window.partitionBy("name", "life").orderBy("offset")).cast("long")).drop("life")


def ordered_fold(df: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], schema: str, partitions: int | None = None) -> DataFrame:
    """step(state, row) -> (state, output row) down each key's rows in order; schema: key and order first, then the outputs."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartition(n, key).sortWithinPartitions(key, order)
    names = [part.split()[0] for part in schema.split(", ")]
    columns = df.columns
    at = columns.index(key), columns.index(order)

    def run(batches):
        now, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                row = tuple(None if x is pd.NaT or x is None or (isinstance(x, float) and x != x) else x for x in row)
                if row[at[0]] != now:
                    now, state = row[at[0]], start()
                state, result = step(state, row)
                out.append((row[at[0]], row[at[1]], *result))
            yield pd.DataFrame(out, columns=names)

    return sorted_.mapInPandas(run, schema)


class Slot:
    """A pointer's committed value, and the transaction and target staged under a lock.

    Version 0 with a lock is a placeholder: the pointer was never created, and first is the target that its first
    prepare named.  Version 0 without one is no slot at all.
    """

    __slots__ = ("target", "version", "txn", "staged", "first")

    def __init__(self) -> None:
        self.target = self.txn = self.staged = self.first = None
        self.version = 0


def cas_step(replicated: bool) -> Callable[[Slot, tuple], tuple[Slot, tuple]]:
    """One operation (kind, txn, target, expected) on a slot; the last four columns of the log.

    put and delete compare and swap.  prepare votes: no if another transaction holds the lock or the committed value is
    not the expected one, else it locks (its own transaction may prepare again).  commit and abort settle a lock of
    their own transaction and leave any other alone; a commit that finds no slot is answered like an abort, and the
    abort of a placeholder removes it.  A single node answers puts and deletes with conflict while a lock is held.
    Replicated ones don't look at locks, take a placeholder for existing, and drop the lock with what they overwrite.
    """

    def step(slot: Slot, row: tuple) -> tuple[Slot, tuple]:
        kind, txn, target, expected = row[-4:]
        locked = slot.txn is not None
        if kind == "prepare":
            holds = slot.version == 0 if expected is None else slot.version > 0 and slot.target == expected
            if not holds or (locked and slot.txn != txn):
                return slot, ("no", slot.version)
            if slot.version == 0 and not locked:
                slot.first = target
            slot.txn, slot.staged = txn, target
            return slot, ("yes", slot.version)
        if kind in ("commit", "abort"):
            own = locked and slot.txn == txn
            if kind == "abort":
                if own:
                    slot.txn = slot.staged = slot.first = None
                return slot, ("aborted", slot.version)
            if not locked and slot.version == 0:
                return slot, ("aborted", 0)
            if own:
                slot.target, slot.version = slot.staged, slot.version + 1
                slot.txn = slot.staged = slot.first = None
            return slot, ("ok", slot.version)
        there, current = slot.version > 0, slot.target
        if locked and not replicated:
            return slot, ("conflict", slot.version)
        if locked and not there:
            there, current = True, slot.first
        if kind == "delete":
            if not there:
                return slot, ("notfound", 0)
            if current != expected:
                return slot, ("conflict", slot.version)
            return Slot(), ("ok", 0)
        if there and (expected is None or current != expected):
            return slot, ("conflict", slot.version)
        if not there and expected is not None:
            return slot, ("notfound", 0)
        version = slot.version + 1
        slot = Slot()
        slot.target, slot.version = target, version
        return slot, ("ok", slot.version)

    return step


def cas_fold(log: DataFrame, replicated: bool = False) -> DataFrame:
    """name, offset, outcome and the version after it, of every operation (name, offset, kind, txn, target, expected)."""
    return ordered_fold(log.select("name", "offset", "kind", "txn", "target", "expected"), "name", "offset", Slot, cas_step(replicated), "name string, offset bigint, outcome string, version bigint")


def atomic_batches(batch: DataFrame, refs: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """Each operation of each batch (batch, name, target, expected) against refs (name, target, version).

    A batch is applied if every operation holds, else not at all; conflict tells each operation that did not.  A name
    twice in one batch is a conflict of that batch.
    """
    now = refs.select("name", F.col("target").alias("current"), "version")
    held = F.lit(False)
    ops = batch.join(now, "name", "left")
    if locked is not None:
        ops = ops.join(locked.select("name", F.lit(True).alias("__locked")), "name", "left")
        held = F.coalesce(F.col("__locked"), F.lit(False))
    from pyspark.sql import Window

    twice = F.count(F.lit(1)).over(Window.partitionBy("batch", "name")) > 1
    ok = ~held & ~twice & F.when(F.col("expected").isNull(), F.col("current").isNull()).otherwise(F.coalesce(F.col("current") == F.col("expected"), F.lit(False)))
    each = ops.withColumn("conflict", ~ok)
    per = each.groupBy("batch").agg(F.bool_and(~F.col("conflict")).alias("applied"))
    return each.join(per, "batch").select("batch", "name", "conflict", "applied", F.when(F.col("applied"), F.coalesce("version", F.lit(0)) + 1).alias("version"))


def txn_decisions(log: DataFrame) -> DataFrame:
    """txn, decision (the first terminal one, else Pending) and ended of a log (txn, offset, kind Begin/Commit/Abort/End)."""
    terminal = F.col("kind").isin("Commit", "Abort")
    first = F.min_by(F.when(terminal, F.col("kind")), F.when(terminal, F.col("offset")))
    return log.groupBy("txn").agg(F.coalesce(first, F.lit("Pending")).alias("decision"), F.bool_or(F.col("kind") == "End").alias("ended"))


def resolver_actions(locks: DataFrame, decisions: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """What a sweep does with every prepared lock (name, txn, staged_hlc).

    An undecided transaction is left alone while fresh, else recorded as aborted before its lock is released; a
    committed one rolls forward and alone is forgotten afterwards.
    """
    from dagstore.functions.hashing import hlc_wall_ms

    j = locks.join(decisions.filter("not ended").select("txn", "decision"), "txn", "left")
    open_ = F.coalesce(F.col("decision"), F.lit("Pending")) == "Pending"
    stale = F.lit(ttl_ms == 0) | (F.lit(now_ms) - hlc_wall_ms(F.col("staged_hlc")) >= ttl_ms)
    action = F.when(open_ & ~stale, "wait").when(open_, "abort_then_release").when(F.col("decision") == "Commit", "roll_forward").otherwise("release")
    return j.select("name", "txn", action.alias("action"), (action == "roll_forward").alias("forget"))


def coordinate(ops: DataFrame) -> DataFrame:
    """Two-phase commit of transactions (txn, shard, name, vote): path, coordinator, decision, and how far prepare went.

    One shard is a plain batch.  Otherwise prepares go by (shard, name) and stop at the first no.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("txn").orderBy("shard", "name")
    numbered = ops.withColumn("k", F.row_number().over(w)).withColumn("no_before", F.coalesce(F.max(F.when(~F.col("vote"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.groupBy("txn").agg(
        F.when(F.count_distinct("shard") == 1, "batch").otherwise("two_phase").alias("path"),
        F.min("shard").alias("coordinator"),
        F.when(F.bool_and("vote"), "Commit").otherwise("Abort").alias("decision"),
        F.sum(F.when(F.col("no_before") == 0, 1).otherwise(0)).alias("prepares"),
    )


def two_phase(ops: DataFrame, refs: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """What two-phase commits of independent transactions do: ops (txn, shard, name, target, expected) against refs (name, target, version).

    Per operation: vote (null where an earlier no stopped the prepares, which go by shard and name), decision, and outcome
    (committed, released, or untouched) with the pointer's version afterwards.  locked: names that others hold.
    """
    from pyspark.sql import Window

    now = refs.select("name", F.col("target").alias("current"), F.col("version").alias("before"))
    j = ops.join(now, "name", "left")
    held = F.lit(False)
    if locked is not None:
        j = j.join(locked.select("name", F.lit(True).alias("held")).distinct(), "name", "left")
        held = F.coalesce("held", F.lit(False))
    holds = F.when(F.col("expected").isNull(), F.col("current").isNull()).otherwise(F.coalesce(F.col("current") == F.col("expected"), F.lit(False)))
    w = Window.partitionBy("txn").orderBy("shard", "name")
    j = j.withColumn("would", ~held & holds).withColumn("stopped", F.coalesce(F.bool_or(~F.col("would")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    j = j.withColumn("all_yes", F.bool_and("would").over(Window.partitionBy("txn")))
    outcome = F.when(F.col("all_yes"), "committed").when(F.col("would") & ~F.col("stopped"), "released").otherwise("untouched")
    version = F.coalesce("before", F.lit(0)) + F.when(F.col("all_yes"), 1).otherwise(0)
    return j.select("txn", "shard", "name", F.when(~F.col("stopped"), F.col("would")).alias("vote"), F.when(F.col("all_yes"), "Commit").otherwise("Abort").alias("decision"), outcome.alias("outcome"), version.cast("long").alias("version"))


def snapshot(log: DataFrame, key: str) -> DataFrame:
    """All live entries as one table: what a snapshot is built of, and what installing it replaces everything by."""
    return latest_per_key(since_checkpoint(log).filter("kind <> 'checkpoint'"), key)


def install(log: DataFrame, state: DataFrame, at: int) -> DataFrame:
    """The log after a snapshot of the state at an offset is installed: the state's entries, then what came later."""
    return state.withColumn("offset", F.lit(at).cast("bigint")).unionByName(log.filter(F.col("offset") > at))


def hlc_ticks(ticks: DataFrame) -> DataFrame:
    """node, offset and hlc of every tick (node, offset, wall_ms): the wall clock's, or one more than the last if that is not above it.

    In closed form: the greatest over the node's ticks so far of the wall's value less its place, plus the place.
    """
    from pyspark.sql import Window

    from dagstore.functions.hashing import hlc_of_ms

    w = Window.partitionBy("node").orderBy("offset")
    placed = ticks.withColumn("place", F.row_number().over(w))
    ahead = F.max(hlc_of_ms(F.col("wall_ms")) - F.col("place")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("node", "offset", (ahead + F.col("place")).alias("hlc"))


def token_bucket(requests: DataFrame, rate: float | None, burst: float | None = None) -> DataFrame:
    """tenant, offset, allowed and tokens left of every request (tenant, offset, at_us), in order of offset.

    A tenant starts full; tokens flow in at rate a second up to burst (the rate itself if none is given, 1 at least);
    no rate, or 0, never denies.
    """
    if not rate:
        return requests.select("tenant", "offset", F.lit(True).alias("allowed"), F.lit(0.0).alias("tokens"))
    top = float(rate) if burst is None else max(1.0, float(burst))

    def step(state: list, row: tuple) -> tuple[list, tuple]:
        at = row[-1]
        tokens, last = state if state else (top, at)
        tokens = min(tokens + max(0, at - last) / 1e6 * rate, top)
        allowed = tokens >= 1.0
        tokens = tokens - 1.0 if allowed else tokens
        return [tokens, at], (allowed, tokens)

    return ordered_fold(requests.select("tenant", "offset", "at_us"), "tenant", "offset", list, step, "tenant bigint, offset bigint, allowed boolean, tokens double")
