"""Stores and tiers: id scans, idempotent writes, quorum, batch requests, tiering and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_ids(loose: DataFrame, packed: DataFrame) -> DataFrame:
    return loose.select("id").union(packed.select("id")).distinct()


def sha1_index(loose: DataFrame, packed: DataFrame) -> DataFrame:
    """sha1 -> id; where both know a sha1, the pack's entry counts."""
    both = loose.select("sha1", "id", F.lit(0).alias("p")).union(packed.select("sha1", "id", F.lit(1).alias("p")))
    return both.groupBy("sha1").agg(F.max_by("id", F.struct("p", "id")).alias("id"))


def exists(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """wanted (id) with found."""
    there = objects.select("id", F.lit(True).alias("__there")).distinct()
    return wanted.join(there, "id", "left").select(*wanted.columns, F.coalesce("__there", F.lit(False)).alias("found"))


def new_objects(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming objects by id, once each, that the store lacks: writing them twice changes nothing."""
    return incoming.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def quorum(acks: DataFrame, peers: int) -> DataFrame:
    """id, acks and durable of object writes (id, node, ack): a majority of the peers and the node itself."""
    return acks.groupBy("id").agg(F.sum(F.col("ack").cast("int")).alias("acks")).withColumn("durable", F.col("acks") >= (peers + 1) // 2 + 1)


def lfs_batch(requested: DataFrame, store: DataFrame, operation: str = "download") -> DataFrame:
    """Per requested object (oid, size): what the batch answer says.

    download: a link where the store has it, else a 404; upload: nothing to do where the store has it, else a link.
    """
    there = store.select("oid", F.col("size").alias("stored_size")).dropDuplicates(["oid"])
    j = requested.join(there, "oid", "left")
    has = F.col("stored_size").isNotNull()
    action = F.when(has, "download").otherwise("404") if operation == "download" else F.when(has, "skip").otherwise("upload")
    return j.select("oid", F.coalesce("stored_size", "size").alias("size"), action.alias("action"))


def tier_candidates(local_packs: DataFrame, markers: DataFrame) -> DataFrame:
    """Local packs that no marker says are in the cold tier."""
    return local_packs.join(markers.select("pack"), "pack", "left_anti")


def recovery_plan(remote: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remote packs to bring back, and those that can't be.

    remote: pack, has_body; local: pack, has_index, has_body, has_marker.  Whole is a local index with a body or marker;
    the rest is fetched, and one without a remote body is an error.
    """
    whole = local.filter("has_index and (has_body or has_marker)").select("pack")
    missing = remote.join(whole, "pack", "left_anti")
    return missing.filter("has_body").select("pack"), missing.filter("not has_body").select("pack")


def tier_stats(packs: DataFrame) -> DataFrame:
    return packs.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def member_diff(current: DataFrame, target: DataFrame) -> DataFrame:
    """node and change (added, removed) from one membership to another."""
    added = target.select("node").subtract(current.select("node")).withColumn("change", F.lit("added"))
    return added.union(current.select("node").subtract(target.select("node")).withColumn("change", F.lit("removed")))


def imported_refs(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Refs (name, sha1) of an upstream whose object came along, with its id; others are skipped."""
    return refs.join(index.select("sha1", "id"), "sha1").select("name", "sha1", "id")


def export_branches(refs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Branches to push upstream: all under refs/heads/, or those named."""
    out = refs.filter(F.startswith("name", F.lit("refs/heads/"))).withColumn("branch", F.substring("name", 12, 1 << 30))
    return out if wanted is None else out.filter(F.col("branch").isin(wanted))


def cluster_list(per_shard: DataFrame, prefix: str, shards: int) -> DataFrame:
    """Refs under a prefix from all shards that may have some (shard, name, target), one of each name, in order."""
    from dagstore.functions.hashing import prefix_shard, shard_number

    under = F.startswith("name", F.lit(prefix))
    out = per_shard.filter(under)
    key = prefix_shard(prefix)
    if key is not None:  # a shard that is worked out from names is so only for those under the prefix
        out = out.filter(F.when(under, F.col("shard")) == shard_number(key, shards))
    return out.groupBy("name").agg(F.min("target").alias("target")).orderBy("name")


def replicas_of(refs: DataFrame, shard_map: DataFrame, shards: int) -> DataFrame:
    """Every ref with the nodes that hold its shard and the one to forward to (the least)."""
    from dagstore.functions.hashing import shard_for

    nodes = shard_map.groupBy("shard").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.min("node_id").alias("forward_to"))
    return refs.withColumn("shard", shard_for(F.col("name"), shards)).join(nodes, "shard", "left")


def group_by_shard(ops: DataFrame, shards: int) -> DataFrame:
    """txn, shard and the sorted names of a transaction's operations (txn, name) on each shard."""
    from dagstore.functions.hashing import shard_for

    return ops.withColumn("shard", shard_for(F.col("name"), shards)).groupBy("txn", "shard").agg(F.array_sort(F.collect_set("name")).alias("names"))
