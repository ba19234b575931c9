"""Parsers of object content: commits, tags and trees, over bytes that need not be UTF-8.

Headers of commits and tags are read by regular expressions over a one-byte-per-character view, inside the JVM; trees,
whose entries hold raw ids, by an Arrow function that gives one row per entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMIT, TREE, BLOB, TAG = 1, 2, 3, 4
GITLINK = "160000"


def _header(content: Column) -> Column:
    """The lines before the first blank one, each begun by a line feed."""
    text = F.decode(content, "ISO-8859-1")
    return F.concat(F.lit("\n"), F.substring_index(F.concat(F.lit("\n"), text), "\n\n", 1))


def commit_tree(content: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(_header(content), "\ntree ([0-9a-fA-F]{40})(?=\n|$)", 1), F.lit("")))


def commit_parents(content: Column) -> Column:
    """Array of parents in order; malformed lines left out."""
    return F.transform(F.regexp_extract_all(_header(content), F.lit("\nparent ([0-9a-fA-F]{40})(?=\n|$)"), 1), F.lower)


def tag_object(content: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(_header(content), "\nobject ([0-9a-fA-F]{40})(?=\n|$)", 1), F.lit("")))


def parse_tree(content: bytes) -> Iterator[tuple[str, bytes, str]]:
    """(mode, name, sha1 hex) of each entry; a truncated tail ends the tree."""
    at = 0
    while at < len(content):
        space = content.find(b" ", at)
        nul = content.find(b"\0", space + 1)
        if space < 0 or nul < 0 or nul + 21 > len(content):
            return
        yield content[at:space].decode("latin-1"), content[space + 1 : nul], content[nul + 1 : nul + 21].hex()
        at = nul + 21


def tree_entries(trees: DataFrame, id_col: str = "id") -> DataFrame:
    """id, ord, mode, name, sha1 of every entry of trees (id, content)."""
    kind = dict(trees.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = [(i, k, m, n, s) for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (m, n, s) in enumerate(parse_tree(c or b""))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())], names=[id_col, "ord", "mode", "name", "sha1"])

    return trees.select(id_col, "content").mapInArrow(run, f"{id_col} {kind}, ord int, mode string, name binary, sha1 string")


def object_edges(objects: DataFrame) -> DataFrame:
    """src, dst, kind, name, mode between ids, from objects (id, sha1, git_type, content).

    Submodule links lead out of the store and are left out; a child that the store lacks has no edge.
    """
    commits = objects.filter(F.col("git_type") == COMMIT)
    none = F.lit(None)
    links = (
        commits.select(F.col("id").alias("src"), commit_tree(F.col("content")).alias("sha1"), F.lit("tree").alias("kind"))
        .unionByName(commits.select(F.col("id").alias("src"), F.explode(commit_parents(F.col("content"))).alias("sha1"), F.lit("parent").alias("kind")))
        .unionByName(objects.filter(F.col("git_type") == TAG).select(F.col("id").alias("src"), tag_object(F.col("content")).alias("sha1"), F.lit("tag").alias("kind")))
        .filter("sha1 is not null")
        .select("*", none.cast("binary").alias("name"), none.cast("string").alias("mode"))
    )
    entries = tree_entries(objects.filter(F.col("git_type") == TREE)).filter(F.col("mode") != GITLINK)
    links = links.unionByName(entries.select(F.col("id").alias("src"), "sha1", F.lit("tree").alias("kind"), "name", "mode"))
    index = objects.groupBy("sha1").agg(F.min("id").alias("dst"))
    return links.join(index, "sha1").select("src", "dst", "kind", "name", "mode")
