"""Shared plumbing: the shared folder for written tables, Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from dagstore.session import discard, materialize, shared_dir, small_batches

__all__ = ["discard", "materialize", "shared_dir"]

#: Rows decoded to Python objects at once.
SLICE_ROWS = 128
#: Bytes decoded at once, unless one row has more: words and ids of a slice take many times its bytes.
SLICE_BYTES = 1 << 20

def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_forget: dict[str, Callable[[], None]] = {}


def keeps(module: str, forget: Callable[[], None]) -> None:
    """Names how to drop what a module keeps in a Python worker from task to task."""
    _forget[module] = forget


def _return_memory() -> None:
    """Hands freed memory back to the system: idle workers stay alive beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with small batches, so that a batch of very long texts stays bounded; every plan asks for the same size.

    A worker serves every operator in turn: what other operators keep in it goes before a task, freed memory after.
    """
    owner = fn.__module__

    def run(batches):
        for module, forget in _forget.items():
            if module != owner:
                forget()
        try:
            yield from fn(batches)
        finally:
            _return_memory()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Every row of the batches in order, in slices of at most rows rows and size bytes, or of one longer row."""
    for b in batches:
        waiting = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def to_batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: further columns of any name can't clash downstream."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores after it as it takes to clash with no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def drop_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df whose values in the columns of keys are not among keys (null matches null), every column of df kept.

    The keys are written first: their size is then known, so that Spark broadcasts them only below its threshold.
    """
    names = {k: fresh(df, f"drop_{k}") for k in keys.columns}
    b = materialize(keys.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()]).distinct(), "dropped")
    on = [df[f"`{k}`"].eqNullSafe(b[f"`{n}`"]) for k, n in names.items()]
    return df.join(b, on, "left_anti")


def keep_first(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each key that repeats, the least in all columns; rows with a null key stay."""
    n, row = fresh(df, "n"), fresh(df, "row")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(key).isNotNull() & (F.col(n) > 1))
    many = materialize(counts.select(key), "repeated")
    again = df.join(many.withColumnRenamed(key, fresh(df, "many")), df[key] == F.col(fresh(df, "many")), "left_semi")
    first = again.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(row))
    return drop_rows(df, many).unionByName(first.select(f"{row}.*"))


def filter_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows for which keep()(values of column) is true, all columns passed through unshuffled."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    schema, at = arrow_schema(ddl), df.columns.index(column)

    def run(batches):
        test = keep()
        for b in slices(batches):
            mask = pa.array(test(b.column(at).to_pylist()), pa.bool_())
            kept = b.filter(mask)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, schema, strict=True)], schema=schema)

    return map_arrow(df, run, ddl)
