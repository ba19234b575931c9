"""Read queries of a version store: authorisation, negotiation, full, partial, incremental and shallow fetches.

objects: id, git_type, size.  edges: src, dst, kind ('parent', 'tree', 'tag').  wants, haves: id, ord (client order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagstore.functions.names import blob_filter_limit
from dagstore.operators import graph


def unadvertised(wants: DataFrame, tips: DataFrame) -> DataFrame:
    return wants.join(tips.select("id"), "id", "left_anti")


def unauthorised_wants(wants: DataFrame, tips: DataFrame, edges: DataFrame) -> DataFrame:
    """Wants that no tip is or reaches.  The closure is walked only if some want is no tip itself."""
    rest = unadvertised(wants, tips)
    if rest.isEmpty():
        return rest
    return rest.join(graph.reachable(edges, tips.select("id")).select("id"), "id", "left_anti")


def first_violation(wants: DataFrame, tips: DataFrame, edges: DataFrame) -> DataFrame:
    """The first unauthorised want in client order, as one row (null if all are authorised)."""
    return unauthorised_wants(wants, tips, edges).agg(F.min_by("id", "ord").alias("id"))


def common(haves: DataFrame, objects: DataFrame) -> DataFrame:
    return haves.join(objects.select("id"), "id", "left_semi")


def last_common(haves: DataFrame, objects: DataFrame) -> DataFrame:
    """The have to acknowledge: the last in client order that the store holds."""
    return common(haves, objects).agg(F.max_by("id", "ord").alias("id"))


def apply_blob_filter(found: DataFrame, wants: DataFrame, spec: str | None) -> DataFrame:
    """Drops blobs (type 3) by the filter, unless wanted by name: all of them, or those over the limit (equal stays)."""
    if spec is None:
        return found
    limit = blob_filter_limit(F.lit(spec))
    asked = wants.select("id", F.lit(True).alias("__asked")).distinct()
    blob = (F.col("git_type") == 3) & F.col("__asked").isNull() & limit.isNotNull()
    drop = blob & F.when(limit < 0, F.lit(True)).otherwise(F.col("size") > limit)
    return found.join(asked, "id", "left").filter(~F.coalesce(drop, F.lit(False))).drop("__asked")


def pack_objects(objects: DataFrame, edges: DataFrame, wants: DataFrame, exclude: DataFrame | None = None, spec: str | None = None) -> DataFrame:
    """The objects to send: all held ones that wants reach without entering exclude, then the blob filter."""
    reached = graph.closure(edges, wants, exclude).select("id")
    return apply_blob_filter(objects.join(reached, "id", "left_semi"), wants, spec)


def incremental(objects: DataFrame, edges: DataFrame, wants: DataFrame, haves: DataFrame, spec: str | None = None) -> DataFrame:
    """What the client lacks: everything under its common haves is excluded."""
    return pack_objects(objects, edges, wants, graph.reachable(edges, common(haves, objects).select("id")).select("id"), spec)


def shallow_commits(objects: DataFrame, edges: DataFrame, wants: DataFrame, depth: int, exclude: DataFrame | None = None) -> DataFrame:
    """id, depth (from 1) and boundary of the commits within depth of the wants; the least depth counts.

    boundary: at the last depth with a parent held and not excluded.
    """
    held = objects.select("id")
    parents = edges.filter("kind = 'parent'").join(held, F.col("dst") == held.id, "left_semi")
    if exclude is not None:
        parents = parents.join(exclude.select(F.col("id").alias("dst")), "dst", "left_anti")
    found = graph.closure(parents, wants.select("id"), exclude, max(1, depth) - 1).join(held, "id", "left_semi")
    going_on = parents.select(F.col("src").alias("id")).distinct().withColumn("__more", F.lit(True))
    out = found.withColumn("depth", F.col("depth") + 1).join(going_on, "id", "left")
    return out.select("id", "depth", ((F.col("depth") == max(1, depth)) & F.col("__more").isNotNull()).alias("boundary"))


def shallow_pack(objects: DataFrame, edges: DataFrame, wants: DataFrame, depth: int, exclude: DataFrame | None = None) -> DataFrame:
    """The commits within depth and the whole trees of each."""
    commits = shallow_commits(objects, edges, wants, depth, exclude).select("id")
    reached = graph.closure(edges.filter("kind <> 'parent'"), commits, exclude).select("id")
    return objects.join(reached, "id", "left_semi")


def deepen(objects: DataFrame, edges: DataFrame, wants: DataFrame, client_shallow: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects to send, new boundaries, and old boundaries that are passed: the walk goes through old boundaries."""
    commits = shallow_commits(objects, edges, wants, depth)
    held = graph.held_by_boundary(edges, client_shallow)
    reached = graph.closure(edges.filter("kind <> 'parent'"), commits.select("id"), held).select("id")
    passed = commits.filter(F.col("depth") < max(1, depth)).join(client_shallow.select("id"), "id", "left_semi").select("id")
    return objects.join(reached, "id", "left_semi"), commits.filter("boundary").select("id"), passed


def advertisement(refs: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refs in order of name with their object, and the refs whose object is missing (an error to report)."""
    held = objects.select(F.col("id").alias("target"))
    return refs.join(held, "target", "left_semi").orderBy("name"), refs.join(held, "target", "left_anti")


def default_branch(refs: DataFrame) -> DataFrame:
    """The head of each segment (segment, client_name): main, else master, else the first name."""
    rank = F.when(F.col("client_name") == "refs/heads/main", 0).when(F.col("client_name") == "refs/heads/master", 1).otherwise(2)
    return refs.groupBy("segment").agg(F.min(F.struct(rank.alias("r"), F.col("client_name").alias("n"))).alias("m")).select("segment", F.col("m.n").alias("head"))


def disconnected(referenced: DataFrame, pushed: DataFrame, stored: DataFrame) -> DataFrame:
    """Referenced ids that are neither pushed nor stored; any of them rejects the whole push."""
    return referenced.select("id").distinct().join(pushed.select("id").unionByName(stored.select("id")), "id", "left_anti")
