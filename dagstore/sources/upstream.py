"""Exports of another store, metric texts, and the cold tier's files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}


def parse_export(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(sha1 hex, type, content) of a batch export: a line of sha1, type and size, the content, a line feed, and so on."""
    at = 0
    while at < len(data):
        line = data.find(b"\n", at)
        head = data[at:line].decode("ascii", "replace").split(" ") if line >= 0 else []
        if len(head) != 3 or not re.fullmatch("[0-9a-fA-F]{40}", head[0]) or head[1] not in KINDS or not re.fullmatch("[0-9]+", head[2]):
            raise ValueError(f"bad header at byte {at}")
        end = line + 1 + int(head[2])
        if end + 1 > len(data):
            raise ValueError("truncated content")
        yield head[0].lower(), KINDS[head[1]], data[line + 1 : end]
        at = end + 1


def read_exports(files: DataFrame) -> DataFrame:
    """path, ordinal, sha1, git_type and content of exports (path, content), as the binaryFile source gives them."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(parse_export(content or b""))
                columns = [[path] * len(rows), range(len(rows)), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "ordinal", "sha1", "git_type", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, ordinal bigint, sha1 string, git_type int, content binary")


def read_ref_lines(lines: DataFrame) -> DataFrame:
    """name and sha1 of lines (value) of a name, a blank and a SHA-1; lines without a blank say nothing, a bad SHA-1 is an error."""
    pair = lines.filter(F.contains("value", F.lit(" "))).select(F.substring_index("value", " ", 1).alias("name"), F.trim(F.expr("substr(value, instr(value, ' ') + 1)")).alias("sha1"))
    good = F.rlike("sha1", F.lit("^[0-9a-fA-F]{40}$"))
    return pair.select("name", F.when(good, F.lower("sha1")).otherwise(F.raise_error(F.concat(F.lit("bad SHA-1 of "), "name")).cast("string")).alias("sha1"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metric_lines(samples: DataFrame) -> DataFrame:
    """One line of exposition text (value) per series of samples (name, labels map<string,string>, value), labels by name."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    some = F.coalesce(F.size("labels"), F.lit(0)) > 0
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    return samples.select(F.concat("name", F.when(some, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), number).alias("value"))


def read_metric_lines(lines: DataFrame) -> DataFrame:
    """name, labels and value of exposition text (value); comments and blank lines say nothing, a value that is no number is null."""
    v = F.col("value")
    text = lines.filter(~F.rlike(v, F.lit(r"^\s*(#.*)?$")))
    pattern = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
    keys, values = (F.regexp_extract_all(F.regexp_extract(v, r"^[a-zA-Z_:][a-zA-Z0-9_:]*\{(.*)\} [^ }]+$", 1), F.lit(pattern), k) for k in (1, 2))
    plain = F.transform(values, lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\0")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\")))
    return text.select(F.regexp_extract(v, r"^([a-zA-Z_:][a-zA-Z0-9_:]*)", 1).alias("name"), F.map_from_arrays(keys, plain).alias("labels"), F.substring_index(v, " ", -1).try_cast("double").alias("value"))


class Tier:
    """Objects by key under a prefix of any file system that Hadoop opens (an object store, HDFS, a folder)."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.prefix = spark, prefix.rstrip("/")
        jvm = spark._jvm
        self._path = lambda key: jvm.org.apache.hadoop.fs.Path(f"{self.prefix}/{key}")
        self.fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, key: str, data: bytes) -> None:
        out = self.fs.create(self._path(key), True)
        try:
            out.write(data)
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        at = self.fs.open(self._path(key))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(at))
        finally:
            at.close()

    def head(self, key: str) -> int | None:
        """The size, or None if there is no such key."""
        path = self._path(key)
        return self.fs.getFileStatus(path).getLen() if self.fs.exists(path) else None

    def list(self) -> list[str]:
        """Keys in order; driver-side, as the plans of tiering read them by list_frame()."""
        return sorted(r.key for r in self.list_frame().collect())

    def list_frame(self) -> DataFrame:
        """key and bytes of everything under the prefix, as a table."""
        if not self.fs.exists(self._path("")):
            return self.spark.createDataFrame([], "key string, bytes bigint")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.prefix)
        root = self.fs.makeQualified(self._path("")).toString().rstrip("/")
        return files.select(F.substring("path", len(root) + 2, 1 << 20).alias("key"), F.col("length").alias("bytes"))

    def delete(self, key: str) -> None:
        self.fs.delete(self._path(key), False)
