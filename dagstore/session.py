"""Sessions, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 16 << 20  # bytes that a writer of a table holds before they go out
#: Rows and bytes (where Spark knows the setting) of an Arrow batch handed to Python; bound a worker's memory with whole texts in a batch.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20

_fallback: list[str] = []
_written: dict[str, None] = {}  # tables of materialize(), oldest first


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is meant for; on a cluster pass the cluster's own master and partitions."""
    b = SparkSession.builder.master(master).appName("dagstore")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only a session on one machine may leave it unset: it gets a temporary folder of its own, gone when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="dagstore-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return _fallback[0]


def small_batches(spark: SparkSession) -> None:
    """Plans of the session hand Python small Arrow batches; every plan asks for the same size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).options(**{"compression": codec} if codec else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._dagstore_path = path
    _written[path] = None
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_dagstore_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end every table that materialize() wrote within, but those handed to the function it gives."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._dagstore_path)
        return df

    yield keep
    for path in [p for p in _written if p not in before and p not in kept]:
        _delete(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes every table that materialize() wrote and that is still there, once the results that read them are written."""
    for path in list(_written):
        _delete(spark, path)
