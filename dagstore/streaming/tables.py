"""Streams kept as tables: log replay by upsert, snapshots, and maintenance on a timer.

A table is a folder of numbered versions, each a whole Parquet table; a version counts once its successor folder is
complete, so a reader always finds the newest complete one.  A micro-batch that is replayed after a failure writes the
version of its own number again, and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, oldest first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    where = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not where.exists(root):
        return []
    found = [s.getPath() for s in where.listStatus(root)]
    return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and where.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version (below a number), or None before the first."""
    found = [v for v in versions(spark, path) if below is None or v < below]
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the newest keep versions; how many went."""
    old = versions(spark, path)[:-keep] if keep else []
    for v in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


def replay(log: DataFrame, path: str, checkpoint: str, key: str, offset: str = "offset", trigger: dict | None = None) -> StreamingQuery:
    """Keeps path as the last entry of each key of a streamed log, tombstones included (a later, older entry must not undo them).

    read_live() leaves them out.  A checkpoint entry needs no special care: its entries come with offsets of their own.
    """
    columns = log.columns

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path, number)
        both = batch.select(*columns) if before is None else before.select(*columns).unionByName(batch.select(*columns))
        rest = [c for c in columns if c != key]
        last = both.groupBy(key).agg(F.max_by(F.struct(*rest), offset).alias("last")).select(key, "last.*")
        last.write.mode("overwrite").parquet(f"{path}/v{number}")
        forget(spark, path)

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_live(spark: SparkSession, path: str, tombstones: str = "kind = 'delete'") -> DataFrame:
    return current(spark, path).filter(f"not ({tombstones})")


def periodically(source: DataFrame, job: Callable[[SparkSession, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs job(session, number) for every micro-batch of source: a sweep, a compaction, a collection on a timer.

    source is any stream that ticks (the rate source, or the log itself); its rows don't matter to the job.
    """
    return source.writeStream.foreachBatch(lambda batch, number: job(batch.sparkSession, number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def compact(spark: SparkSession, log_path: str, key: str, parse: Callable[[DataFrame], DataFrame], unparse: Callable[[DataFrame], DataFrame], larger_than: int) -> bool:
    """Replaces a framed log of more than larger_than segments by a checkpoint of its live entries."""
    from dagstore.operators.reflog import snapshot
    from dagstore.session import materialize
    from dagstore.sources import frames

    log = frames.read_log(spark, log_path)
    if log.select("segment").distinct().count() <= larger_than:
        return False
    state = materialize(unparse(snapshot(parse(log), key)), "snapshot")  # read wholly before the log goes
    frames.write_checkpoint(state, log_path)
    return True
