"""Leases: rows that live until a time, renewed, released or left to expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagstore.functions.names import normal_tenant, workspace_of_ref
from dagstore.operators.reflog import latest_per_key


def is_live(now_ms: Column | int) -> Column:
    return F.col("expires_at_ms") > now_ms


def live(leases: DataFrame, now_ms: int, tenant: str | None = None) -> DataFrame:
    out = leases.filter(is_live(F.lit(now_ms)))
    return out if tenant is None else out.filter(normal_tenant(F.col("tenant_id")) == normal_tenant(F.lit(tenant)))


def expired(leases: DataFrame, now_ms: int) -> DataFrame:
    return leases.filter(F.col("expires_at_ms") <= now_ms)


def state(log: DataFrame) -> DataFrame:
    """Current leases of a log (offset, id, kind put/renew/tombstone, ...): the last entry of each id, tombstones gone."""
    return latest_per_key(log, "id", tombstones="kind = 'tombstone'")


def lifecycle(log: DataFrame, ttl_ms: int) -> DataFrame:
    """id, generation, created and expiry of every lease of a log (offset, id, kind, at_ms): put is generation 1,
    each renewal one more and a fresh expiry, a tombstone ends it; renewals of no lease do nothing."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("offset")
    born = log.withColumn("__birth", F.max(F.when(F.col("kind").isin("put", "tombstone"), F.struct("offset", "kind"))).over(w))
    alive = born.filter("__birth.kind = 'put' and kind <> 'tombstone'")
    last = born.groupBy("id").agg(F.max(F.col("__birth")).alias("b")).filter("b.kind = 'put'").select("id", F.col("b.offset").alias("born"))
    return (
        alive.join(last, "id")
        .filter("__birth.offset = born")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("generation"), F.min_by("at_ms", "offset").alias("created_at_ms"), (F.max_by("at_ms", "offset") + ttl_ms).alias("expires_at_ms"))
    )


def workspace_refs(leases: DataFrame, refs: DataFrame, now_ms: int) -> DataFrame:
    """The refs of live leases' workspaces, by the id in the ref's name."""
    mine = refs.withColumn("id", workspace_of_ref(F.col("name"))).filter("id is not null")
    return mine.join(live(leases, now_ms).select("id"), "id", "left_semi")


def workspace_views(leases: DataFrame, refs: DataFrame, now_ms: int) -> DataFrame:
    """Each live lease with its refs nested, in order of name; a lease without refs has none."""
    mine = refs.withColumn("id", workspace_of_ref(F.col("name"))).filter("id is not null")
    nested = mine.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "target", "version"))).alias("refs"))
    return live(leases, now_ms).join(nested, "id", "left")


def owned(leases: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (id, tenant) with found: whether the lease exists and is the caller's; the two failures look the same."""
    mine = leases.select("id", normal_tenant(F.col("tenant_id")).alias("tenant"), F.lit(True).alias("__mine")).distinct()
    return calls.withColumn("tenant", normal_tenant(F.col("tenant"))).join(mine, ["id", "tenant"], "left").select(*calls.columns, F.coalesce("__mine", F.lit(False)).alias("found"))


def commit_mapping(mapping: DataFrame, workspace_refs_: DataFrame, durable: DataFrame) -> DataFrame:
    """What a commit swaps: mapping (source, destination), the workspace's target, and the durable target expected (null: none yet).

    A source that the workspace lacks is skipped.
    """
    src = workspace_refs_.select(F.col("name").alias("source"), F.col("target"))
    dst = durable.select(F.col("name").alias("destination"), F.col("target").alias("expected"))
    return mapping.join(src, "source").join(dst, "destination", "left").select("source", "destination", "target", "expected")
