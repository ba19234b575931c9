"""Streams against the batch operators over the same rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from dagstore.operators import policy, reflog
from dagstore.plans import fixtures
from dagstore.sources import frames
from dagstore.streaming import state, tables


@pytest.fixture
def parts(spark, sf_dir, tmp_path):
    """Writes a table as several files in order of offset, and reads them as a stream of a file a batch."""

    def stream(df, n=3, order="offset"):
        where = str(tmp_path / uuid.uuid4().hex)
        top = df.agg(F.max(order)).first()[0] + 1
        for k in range(n):
            part = df.filter((F.col(order) >= top * k // n) & (F.col(order) < top * (k + 1) // n))
            part.coalesce(1).write.mode("append").parquet(where)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)

    return stream


def run(spark, df, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_replay(spark, sf_dir, parts, tmp_path):
    log = fixtures.ref_log(spark, sf_dir).filter("kind in ('put', 'delete')").select("name", "offset", "kind", "target")
    path = str(tmp_path / "table")
    query = tables.replay(parts(log), path, str(tmp_path / "checkpoint"), "name")
    query.awaitTermination()
    expected = sorted(map(tuple, reflog.latest_per_key(log, "name").select("name", "offset", "kind", "target").collect()))
    assert sorted(map(tuple, tables.read_live(spark, path).select("name", "offset", "kind", "target").collect())) == expected
    assert 1 <= len(tables.versions(spark, path)) <= 2


def test_token_bucket(spark, sf_dir, parts):
    from dagstore.functions import hashing
    from dagstore.plans.registry import table

    requests = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tenant"), F.col("event_id").alias("offset"), hashing.micros(F.col("ts")).alias("at_us"))
    expected = {(r.tenant, r.offset): (r.allowed, round(r.tokens, 6)) for r in reflog.token_bucket(requests, 0.00001, 2).collect()}
    assert {x[0] for x in expected.values()} == {True, False}
    assert {(r.tenant, r.offset): (r.allowed, round(r.tokens, 6)) for r in run(spark, state.token_bucket(parts(requests), 0.00001, 2))} == expected


def test_leases(spark, parts):
    minute = 60_000
    log = [("a", 1, "put", 0), ("a", 2, "renew", 5), ("a", 3, "tombstone", 8), ("a", 4, "renew", 9), ("b", 5, "put", 10), ("c", 6, "put", 11), ("c", 7, "renew", 30), ("d", 8, "put", 40), ("z", 9, "put", 90), ("z", 10, "renew", 95)]
    df = spark.createDataFrame(log, "id string, offset bigint, kind string, minute bigint").select("id", "offset", "kind", F.timestamp_millis((F.col("minute") + 1000) * minute).alias("at"))
    rows = sorted((r.id, r.event, r.generation, r.created_at_ms // minute - 1000, r.expires_at_ms // minute - 1000) for r in run(spark, state.leases(parts(df, 5), 10 * minute)))
    assert [r for r in rows if r[0] == "a"] == [("a", "put", 1, 0, 10), ("a", "release", 2, 0, 15), ("a", "renew", 2, 0, 15)]
    assert [r for r in rows if r[0] == "b"] == [("b", "expire", 1, 10, 20), ("b", "put", 1, 10, 20)]
    assert [r for r in rows if r[0] == "c"] == [("c", "expire", 1, 11, 21), ("c", "put", 1, 11, 21)]  # the renewal came too late
    assert ("d", "expire", 1, 40, 50) in rows and [r[1] for r in rows if r[0] == "z"] == ["put", "renew"]


def test_emit(spark, sf_dir, parts):
    events = fixtures.lease_log(spark, sf_dir).select("offset", F.col("tenant_id"), "kind")
    hooks = spark.createDataFrame([(1, "t0", [], True), (2, "t1", ["renew"], True), (3, "t1", [], False), (4, "", ["put", "renew"], True)], "id int, tenant_id string, events array<string>, active boolean")
    expected = sorted((r.hook_id, r.offset) for r in policy.webhook_matches(hooks, events).collect())
    assert expected and sorted((r.hook_id, r.offset) for r in run(spark, state.emit(parts(events), hooks))) == expected


def test_framed_log_as_stream_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    records = lambda a, b: spark.range(a, b).select(F.concat(F.col("id") % 7, F.lit("|"), F.col("id")).cast("binary").alias("payload"), "id")
    for a in (0, 50, 100):
        frames.append_log(records(a, a + 50), path, "id")
    frames.register(spark)
    stream = spark.readStream.format("framelog").load(path)
    query = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    frames.append_log(records(150, 170), path, "id")
    query.processAllAvailable()
    query.stop()
    assert sorted(int(bytes(r.payload).split(b"|")[1]) for r in spark.table("frames").collect()) == list(range(170))

    f = F.split(F.decode("payload", "UTF-8"), "\\|")
    parse = lambda df: df.select(f[0].alias("key"), f[1].cast("bigint").alias("offset"), F.lit("put").alias("kind"))
    unparse = lambda df: df.select(F.concat("key", F.lit("|"), "offset").cast("binary").alias("payload"))
    assert not tables.compact(spark, path, "key", parse, unparse, 100)
    assert tables.compact(spark, path, "key", parse, unparse, 3)
    assert sorted(r.offset for r in parse(frames.read_log(spark, path)).collect()) == list(range(163, 170))


def test_periodic_job(spark, tmp_path):
    ran = []
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = tables.periodically(ticks, lambda s, n: ran.append(n), str(tmp_path / "c"), {"processingTime": "1 second"})
    query.awaitTermination(8)
    query.stop()
    assert len(ran) >= 2 and ran == sorted(ran)
