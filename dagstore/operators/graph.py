"""Fixpoints over an edge table (src, dst, kind): reachability, bounded depth, chains.

Every operator is one semi-naive loop: the frontier is joined to the edges, made distinct, and what was visited
before is taken out by an anti join.  The edges are written once.  Each round appends one written table of visited rows;
after MERGE rounds the tables of a level become one of the next, so a row is rewritten as often as the logarithm of
the rounds, and an anti join reads few tables.  The loop ends with the first empty frontier.  All tables' sizes are
known, so Spark broadcasts a small frontier and leaves the edges where they are.  Columns that tag a traversal (tenant,
segment, root) ride along, so many traversals are one.

Chains, where every node has one base, take ``chain_depth``'s pointer doubling: log2(limit) joins instead of rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagstore.session import discard, materialize

MERGE = 8
CODEC = "zstd"  # of the tables written: ids are alike, and there may be as many rows as traversals times ids


def closure(edges: DataFrame, seeds: DataFrame, exclude: DataFrame | None = None, max_depth: int | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """id, the tags and depth (least number of steps from a seed) of all that seeds (id, tags) reach, seeds included.

    Seeds count even if no edge or object knows them.  What is in exclude (id) is neither entered nor passed through.
    """
    keys = [*tags, "id"]
    edges = materialize(edges.select("src", "dst"), "edges", CODEC)
    barred = None if exclude is None else materialize(exclude.select("id").distinct(), "barred", CODEC)

    def admit(df: DataFrame) -> DataFrame:
        return df if barred is None else df.join(barred, "id", "left_anti")

    level = materialize(admit(seeds.select(*keys).distinct()).withColumn("depth", F.lit(0)), "closure", CODEC)
    parts: list[list[DataFrame]] = [[level]]  # tables of one round, of MERGE rounds, of MERGE ** 2 rounds, ...
    depth = 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        step = admit(level.join(edges, level.id == edges.src).select(*tags, F.col("dst").alias("id")).distinct())
        level = materialize(step.join(_union(parts).select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)), "closure", CODEC)
        parts[0].append(level)
        for k in range(len(parts)):
            if len(parts[k]) <= MERGE:
                break
            *old, last = parts[k]  # the last may be the frontier
            merged = materialize(_union([old]), "closure", CODEC)
            discard(*old)
            parts[k] = [last]
            if k + 1 == len(parts):
                parts.append([])
            parts[k + 1].append(merged)
    discard(edges, *([barred] if barred is not None else []))
    return _union(parts)


def _union(parts: list[list[DataFrame]]) -> DataFrame:
    out, *rest = [p for ps in parts for p in ps]
    for p in rest:
        out = out.unionByName(p)
    return out


def reachable(edges: DataFrame, seeds: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    return closure(edges, seeds, tags=tags).drop("depth")


def with_delta_bases(ids: DataFrame, bases: DataFrame) -> DataFrame:
    """ids (id) closed under delta bases (id, base), to the fixpoint: whoever keeps an object keeps what it is stored against."""
    return closure(bases.filter("base is not null").select(F.col("id").alias("src"), F.col("base").alias("dst")), ids).drop("depth")


def chain_depth(bases: DataFrame, limit: int = 50) -> DataFrame:
    """id and depth of every delta chain: the number of bases below an object, at most limit; null where the chain loops.

    Pointer doubling: after k joins every id knows where 2 ** k steps lead and how many there were before the chain's
    end.  A chain that has no end within the number of its ids loops, or leads into a loop.
    """
    links = materialize(bases.select("id", "base"), "chains")
    n = links.count()
    now = materialize(links.select("id", F.col("base").alias("to"), F.when(F.col("base").isNull(), 0).otherwise(1).cast("bigint").alias("steps")), "jumps")
    reach = 1
    while reach <= n and not now.filter("to is not null").isEmpty():
        further = now.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        new = materialize(now.join(further, "to", "left").select("id", F.col("then").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "jumps")
        discard(now)
        now, reach = new, 2 * reach
    return now.select("id", F.when(F.col("to").isNull(), F.least("steps", F.lit(limit))).alias("depth"))


def would_cycle(bases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of proposed (id, base): those whose base already rests on the id, directly or through others."""
    reach = closure(bases.filter("base is not null").select(F.col("id").alias("src"), F.col("base").alias("dst")), pairs.select(F.col("base").alias("id"), F.col("base").alias("start")), tags=("start",))
    hit = reach.select(F.col("start").alias("base"), "id").distinct()
    return pairs.join(hit, ["id", "base"], "left_semi")


def held_by_boundary(edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """What a shallow client holds of its boundary commits: each and its whole tree, not its ancestors."""
    return closure(edges.filter("kind <> 'parent'"), boundaries).drop("depth")


def name_hashes(edges: DataFrame) -> DataFrame:
    """The name hash of every tree child; of several names the least hash (a fixed choice among any order)."""
    from dagstore.functions.hashing import name_hash

    return edges.filter("kind = 'tree' and name is not null").groupBy(F.col("dst").alias("id")).agg(F.min(name_hash(F.col("name").cast("string"))).alias("name_hash"))
