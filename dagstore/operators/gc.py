"""Garbage collection: roots, mark, sweep, the statistics, and tenants' usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagstore.functions.names import is_durable, normal_tenant, tenant_of_ref
from dagstore.operators import graph, leases as leases_


def roots(refs: DataFrame, leases: DataFrame, now_ms: int, prepared: DataFrame | None = None) -> DataFrame:
    """Ids that hold what they reach: durable refs, refs of live leases' workspaces, and staged targets of prepared locks."""
    out = refs.filter(is_durable(F.col("name"))).select(F.col("target").alias("id"))
    out = out.unionByName(leases_.workspace_refs(leases, refs, now_ms).select(F.col("target").alias("id")))
    if prepared is not None:
        out = out.unionByName(prepared.select(F.col("staged_target").alias("id")))
    return out


def mark(edges: DataFrame, root_ids: DataFrame, bases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reachable ids (missing roots count), and those to keep: closed under delta bases too."""
    reached = graph.reachable(edges, root_ids)  # written tables: reading them again walks nothing again
    return reached, reached if bases is None else graph.with_delta_bases(reached, bases)


def sweep(objects: DataFrame, keep: DataFrame, now_s: int, grace_s: int) -> DataFrame:
    """Loose objects outside keep, with swept: false while young or of unknown age; packed objects are never swept."""
    age = F.greatest(F.lit(now_s) - F.col("mtime_s"), F.lit(0))
    return objects.filter("loose").join(keep.select("id").distinct(), "id", "left_anti").withColumn("swept", F.coalesce(age >= grace_s, F.lit(False)))


def stats(objects: DataFrame, reached: DataFrame, garbage: DataFrame) -> DataFrame:
    """One row: scanned, reachable (before delta bases), reclaimed, bytes_freed, skipped_grace."""
    scanned = objects.agg(F.count_distinct("id").alias("scanned"))
    reach = reached.agg(F.count_distinct("id").alias("reachable"))
    swept = garbage.agg(
        F.count_if("swept").alias("reclaimed"),
        F.coalesce(F.sum(F.when(F.col("swept"), F.col("size"))), F.lit(0)).alias("bytes_freed"),
        F.count_if(~F.col("swept")).alias("skipped_grace"),
    )
    return scanned.crossJoin(reach).crossJoin(swept)  # three single rows


def mark_sweep(objects: DataFrame, edges: DataFrame, refs: DataFrame, leases: DataFrame, now_ms: int, grace_s: int, bases: DataFrame | None = None, prepared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The sweep's candidates and the statistics."""
    reached, keep = mark(edges, roots(refs, leases, now_ms, prepared), bases)
    garbage = sweep(objects, keep, now_ms // 1000, grace_s)
    return garbage, stats(objects, reached, garbage)


def tenant_usage(objects: DataFrame, edges: DataFrame, refs: DataFrame, bases: DataFrame | None = None, close_delta_bases: bool = True) -> DataFrame:
    """tenant, objects and bytes under its durable refs; what two tenants share counts for each; packed objects have no bytes.

    One traversal tagged by tenant.  close_delta_bases False gives the measure that leaves delta bases out.
    """
    seeds = refs.filter(is_durable(F.col("name"))).select(tenant_of_ref(F.col("name")).alias("tenant"), F.col("target").alias("id"))
    found = graph.closure(edges, seeds, tags=("tenant",)).select("tenant", "id")
    if close_delta_bases and bases is not None:
        links = bases.filter("base is not null").select(F.col("id").alias("src"), F.col("base").alias("dst"))
        found = graph.closure(links, found, tags=("tenant",)).select("tenant", "id")
    sized = found.join(objects.select("id", F.when(F.col("loose"), F.col("size")).otherwise(0).alias("size")), "id")
    return sized.groupBy("tenant").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


def quota_denials(requests: DataFrame, usage: DataFrame, max_bytes: int, max_objects: int, enabled: bool = True) -> DataFrame:
    """Requests (tenant) with denied: by the last measured usage, at or over a limit; unknown usage and root pass."""
    tenant = normal_tenant(F.col("tenant"))
    j = requests.withColumn("tenant", tenant).join(usage.select("tenant", "objects", "bytes"), "tenant", "left")
    over = (F.coalesce("bytes", F.lit(0)) >= max_bytes) | (F.coalesce("objects", F.lit(0)) >= max_objects)
    return j.select(*requests.columns, (F.lit(enabled) & (F.col("tenant") != "root") & over).alias("denied"))


def rollup(per_node: DataFrame) -> DataFrame:
    """Sums over the nodes (node, status, and the statistics) that answered, and how many did not."""
    ok = F.col("status") == "ok"
    fields = ("scanned", "reachable", "reclaimed", "bytes_freed", "skipped_grace")
    return per_node.agg(*[F.coalesce(F.sum(F.when(ok, F.col(f))), F.lit(0)).alias(f) for f in fields], F.count_if(ok).alias("nodes_ok"), F.count_if(~ok).alias("nodes_failed"))
