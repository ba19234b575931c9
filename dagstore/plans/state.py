"""Queries over leases, logs, transactions, policies and monitoring samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from dagstore.functions import hashing
from dagstore.functions.blake3 import blake3_udf
from dagstore.operators import leases, monitor, policy, reflog
from dagstore.plans import fixtures as fx
from dagstore.plans.fixtures import sql
from dagstore.plans.registry import query, table
from dagstore.session import small_batches

SERIES = ["name", "instance"]


# leases and workspaces


@query("lease_live", sql("SELECT id, tenant_id, generation, expires_at_ms FROM leases WHERE expires_at_ms > (SELECT now_ms FROM now)", "leases", "now"))
def lease_live(spark, d):
    return leases.live(fx.leases(spark, d), fx.now_ms(spark, d)).select("id", "tenant_id", "generation", "expires_at_ms")


@query("lease_expired", sql("SELECT id, created_at_ms, expires_at_ms FROM leases WHERE expires_at_ms <= (SELECT now_ms FROM now)", "leases", "now"))
def lease_expired(spark, d):
    return leases.expired(fx.leases(spark, d), fx.now_ms(spark, d)).select("id", "created_at_ms", "expires_at_ms")


@query("lease_state", sql('SELECT id, tenant_id, kind, at_ms, "offset" FROM lease_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY "offset" DESC) = 1 AND kind <> \'tombstone\'', "lease_log"))
def lease_state(spark, d):
    return leases.state(fx.lease_log(spark, d)).select("id", "tenant_id", "kind", "at_ms", "offset")


@query("lease_lifecycle", sql("SELECT id, generation, created_at_ms, expires_at_ms FROM leases", "leases"))
def lease_lifecycle(spark, d):
    return fx.leases(spark, d).select("id", "generation", "created_at_ms", "expires_at_ms")


WS = "SELECT name, target, version, split_part(name, '/', 3) AS id FROM refs WHERE starts_with(name, 'refs/workspaces/')"
LIVE = "SELECT id FROM leases WHERE expires_at_ms > (SELECT now_ms FROM now)"


@query("workspace_refs", sql(f"SELECT name, target, id FROM ({WS}) WHERE id IN ({LIVE})", "leases", "refs", "now"))
def workspace_refs(spark, d):
    return leases.workspace_refs(fx.leases(spark, d), fx.refs(spark, d), fx.now_ms(spark, d)).select("name", "target", "id")


@query("workspace_views", sql(f"SELECT l.id, count(w.name) AS n_refs, coalesce(string_agg(w.name || '=' || w.target, ',' ORDER BY w.name), '') AS refs FROM ({LIVE}) l LEFT JOIN ({WS}) w ON w.id = l.id GROUP BY l.id", "leases", "refs", "now"))
def workspace_views(spark, d):
    v = leases.workspace_views(fx.leases(spark, d), fx.refs(spark, d), fx.now_ms(spark, d))
    each = F.transform("refs", lambda r: F.concat_ws("=", r["name"], r["target"]))
    return v.select("id", F.coalesce(F.size("refs"), F.lit(0)).cast("long").alias("n_refs"), F.concat_ws(",", each).alias("refs"))


@query("commit_mapping", sql("SELECT s.name AS source, m.destination, s.target, t.target AS expected FROM (SELECT DISTINCT 'refs/workspaces/' || lpad(lower(to_hex(user_id)), 32, '0') || '/heads/main' AS source, 'refs/heads/c' || user_id AS destination FROM events) m JOIN refs s ON s.name = m.source LEFT JOIN refs t ON t.name = m.destination", "refs"))
def commit_mapping(spark, d):
    who = table(spark, d, "events").select("user_id").distinct()
    mapping = who.select(F.concat(F.lit("refs/workspaces/"), fx.workspace_id(), F.lit("/heads/main")).alias("source"), F.concat(F.lit("refs/heads/c"), "user_id").alias("destination"))
    r = fx.refs(spark, d)
    return leases.commit_mapping(mapping, r.filter(F.startswith("name", F.lit("refs/workspaces/"))), r.filter(F.startswith("name", F.lit("refs/heads/"))))


# logs


@query("log_replay_latest", sql('SELECT name, target, "offset" FROM (SELECT * FROM ref_log WHERE kind IN (\'put\', \'delete\')) QUALIFY row_number() OVER (PARTITION BY name ORDER BY "offset" DESC) = 1 AND kind <> \'delete\'', "ref_log"))
def log_replay_latest(spark, d):
    log = fx.ref_log(spark, d).filter("kind in ('put', 'delete')")
    return reflog.latest_per_key(log, "name").select("name", "target", "offset")


@query("log_replay_checkpoint", 'SELECT event_id AS "offset", CASE WHEN event_id % 4000 = 0 THEN \'checkpoint\' ELSE event_type END AS kind FROM events WHERE event_id >= (SELECT max(event_id) FROM events WHERE event_id % 4000 = 0)')
def log_replay_checkpoint(spark, d):
    kind = F.when(F.col("event_id") % 4000 == 0, "checkpoint").otherwise(F.col("event_type"))
    return reflog.since_checkpoint(table(spark, d, "events").select(F.col("event_id").alias("offset"), kind.alias("kind")))


@query("ref_as_of", sql('SELECT name, target, "offset" FROM (SELECT * FROM ref_log WHERE kind IN (\'put\', \'delete\') AND "offset" <= 5000) QUALIFY row_number() OVER (PARTITION BY name ORDER BY "offset" DESC) = 1 AND kind <> \'delete\'', "ref_log"))
def ref_as_of(spark, d):
    log = fx.ref_log(spark, d).filter("kind in ('put', 'delete')")
    return reflog.as_of(log, "name", 5000).select("name", "target", "offset")


@query("ref_versions", sql('SELECT name, "offset", row_number() OVER (PARTITION BY name, life ORDER BY "offset") AS version FROM (SELECT *, count(*) FILTER (WHERE kind = \'delete\') OVER (PARTITION BY name ORDER BY "offset") AS life FROM ref_log WHERE kind IN (\'put\', \'delete\')) WHERE kind = \'put\'', "ref_log"))
def ref_versions(spark, d):
    return reflog.versions(fx.ref_log(spark, d).filter("kind in ('put', 'delete')")).select("name", "offset", "version")


@query("cas_fold_single")
def cas_fold_single(spark, d):
    return reflog.cas_fold(fx.ref_log(spark, d))


@query("cas_fold_replicated")
def cas_fold_replicated(spark, d):
    return reflog.cas_fold(fx.ref_log(spark, d), replicated=True)


BATCH = "SELECT event_id // 4 AS batch, 'refs/heads/c' || (user_id % 50 * 2) AS name, 't' || event_id AS target, CASE WHEN event_id % 2 = 1 THEN 'm:' || (user_id % 50 * 2) || ':' || (event_id % 5) END AS expected FROM events"


@query("atomic_batch", sql(f", b AS ({BATCH}), e AS (SELECT b.batch, b.name, r.version, count(*) OVER (PARTITION BY b.batch, b.name) > 1 OR NOT CASE WHEN b.expected IS NULL THEN r.target IS NULL ELSE coalesce(r.target = b.expected, false) END AS conflict FROM b LEFT JOIN refs r ON r.name = b.name) SELECT batch, name, conflict, NOT bool_or(conflict) OVER w AS applied, CASE WHEN NOT bool_or(conflict) OVER w THEN coalesce(version, 0) + 1 END AS version FROM e WINDOW w AS (PARTITION BY batch)", "refs"))
def atomic_batch(spark, d):
    k = F.col("user_id") % 50 * 2
    batch = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 4).alias("batch"),
        F.concat(F.lit("refs/heads/c"), k).alias("name"),
        F.concat(F.lit("t"), "event_id").alias("target"),
        F.when(F.col("event_id") % 2 == 1, F.concat_ws(":", F.lit("m"), k, F.col("event_id") % 5)).alias("expected"),
    )
    return reflog.atomic_batches(batch, fx.refs(spark, d))


DECISIONS = "SELECT txn, coalesce(arg_min(kind, \"offset\") FILTER (WHERE kind IN ('Commit', 'Abort')), 'Pending') AS decision, bool_or(kind = 'End') AS ended FROM txn_log GROUP BY txn"


@query("txn_decisions", sql(DECISIONS, "txn_log"))
def txn_decisions(spark, d):
    return reflog.txn_decisions(fx.txn_log(spark, d))


@query("resolver_actions", sql(f""", d AS ({DECISIONS}), l AS (SELECT 'refs/heads/u' || user_id AS name, txn, epoch_us(ts) // 1000 AS ms FROM txn_log WHERE \"offset\" % 8 = 3),
    j AS (SELECT l.name, l.txn, coalesce(d.decision, 'Pending') AS decision, (SELECT now_ms FROM now) - ms >= 864000000 AS stale FROM l LEFT JOIN d ON d.txn = l.txn AND NOT d.ended)
    SELECT name, txn, CASE WHEN decision = 'Pending' AND NOT stale THEN 'wait' WHEN decision = 'Pending' THEN 'abort_then_release' WHEN decision = 'Commit' THEN 'roll_forward' ELSE 'release' END AS action, decision = 'Commit' AS forget FROM j""", "txn_log", "now"))
def resolver_actions(spark, d):
    log = fx.txn_log(spark, d)
    locks = log.filter("offset % 8 = 3").select(F.concat(F.lit("refs/heads/u"), "user_id").alias("name"), "txn", hashing.hlc_of_ms(hashing.millis(F.col("ts"))).alias("staged_hlc"))
    return reflog.resolver_actions(locks, reflog.txn_decisions(log), fx.now_ms(spark, d), 864_000_000)


@query("two_phase_commit", """WITH o AS (SELECT event_id // 8 AS txn, CAST(user_id % 4 AS INTEGER) AS shard, event_id, event_type <> 'error' AS vote FROM events WHERE event_id % 8 < 3),
    n AS (SELECT *, coalesce(bool_or(NOT vote) OVER (PARTITION BY txn ORDER BY shard, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM o)
    SELECT txn, CASE WHEN count(DISTINCT shard) = 1 THEN 'batch' ELSE 'two_phase' END AS path, min(shard) AS coordinator, CASE WHEN bool_and(vote) THEN 'Commit' ELSE 'Abort' END AS decision, count(*) FILTER (WHERE NOT stopped) AS prepares FROM n GROUP BY txn""")
def two_phase_commit(spark, d):
    e = table(spark, d, "events").filter("event_id % 8 < 3")
    ops = e.select(F.floor(F.col("event_id") / 8).alias("txn"), (F.col("user_id") % 4).cast("int").alias("shard"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("name"), (F.col("event_type") != "error").alias("vote"))
    return reflog.coordinate(ops)


@query("token_bucket")
def token_bucket(spark, d):
    e = table(spark, d, "events")
    requests = e.select((F.col("user_id") % 10).alias("tenant"), F.col("event_id").alias("offset"), hashing.micros(F.col("ts")).alias("at_us"))
    return reflog.token_bucket(requests, 0.0005, 5)


# policies


@query("api_keys_live", "SELECT c_custkey AS key_id, c_custkey % 3 <> 1 AS may_write FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey * 1000 > 500000)")
def api_keys_live(spark, d):
    k = F.col("c_custkey")
    scopes = F.when(k % 3 == 0, F.array(F.lit("admin"))).when(k % 3 == 1, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("write")))
    keys = table(spark, d, "customer").select(k.alias("key_id"), (k % 7 == 0).alias("revoked"), F.when(k % 5 != 0, k * 1000).alias("expires_at_ms"), scopes.alias("scopes"))
    return keys.filter(policy.key_live(500_000)).select("key_id", policy.may(F.col("scopes"), "write").alias("may_write"))


def _hooks_and_events(spark, d):
    k = F.col("s_suppkey")
    kinds = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("view"))).otherwise(F.array(F.lit("error"), F.lit("purchase")))
    hooks = table(spark, d, "supplier").select(k.alias("id"), (k % 10).alias("tenant_id"), kinds.alias("events"), (k % 4 != 0).alias("active"))
    events = table(spark, d, "events").select((F.col("user_id") % 10).alias("tenant_id"), F.col("event_type").alias("kind"), "event_id")
    return hooks, events


@query("webhook_fanout", "SELECT s_suppkey AS hook_id, count(*) AS n_events FROM supplier JOIN events ON user_id % 10 = s_suppkey % 10 WHERE s_suppkey % 4 <> 0 AND (s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND event_type = 'view') OR (s_suppkey % 3 = 2 AND event_type IN ('error', 'purchase'))) GROUP BY s_suppkey")
def webhook_fanout(spark, d):
    return policy.webhook_counts(*_hooks_and_events(spark, d))


@query("webhook_signature")
def webhook_signature(spark, d):
    """Every delivery with its signature; a hook's secret is the SHA-256 of its id. No SQL: DuckDB has no such hash."""
    hooks, events = _hooks_and_events(spark, d)
    secret = F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))
    return policy.signed_deliveries(hooks.withColumn("secret", secret), events.withColumn("body", F.to_json(F.struct("event_id", "kind"))))


@query("content_hash")
def content_hash(spark, d):
    """The content hash of every document. No SQL: DuckDB has no such hash."""
    small_batches(spark)
    return table(spark, d, "documents").select("doc_id", blake3_udf()(F.col("text").cast("binary")).alias("hash"))


PATHS = ["/healthz", "/a/git-upload-pack", "/a/git-receive-pack", "/raft/append", "/rpc", "/a/info/lfs/objects/batch", "/metrics"]


@query("request_classes", f"WITH r AS (SELECT event_id, {PATHS!r}[event_id % 7 + 1] AS path, CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method FROM events) SELECT event_id, CASE WHEN path IN ('/healthz', '/metrics') THEN 'public' WHEN starts_with(path, '/raft/') THEN 'internal' ELSE 'client' END AS class, method = 'POST' AND path NOT IN ('/a/git-upload-pack', '/a/info/lfs/objects/batch', '/rpc') AS is_write FROM r")
def request_classes(spark, d):
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("event_id") % 7 + 1).cast("int"))
    method = F.when(F.col("event_id") % 3 == 0, "GET").otherwise("POST")
    r = table(spark, d, "events").select("event_id", path.alias("path"), method.alias("method"))
    return r.select("event_id", policy.request_class(F.col("path")).alias("class"), policy.is_write(F.col("method"), F.col("path")).alias("is_write"))


# monitoring


def _rates(value: str = "counter", seconds: int = 300, step: int = 60) -> str:
    """SQL of rate_at."""
    return f"""SELECT name, instance, \"at\", sum(up) / {seconds} AS rate FROM (
        SELECT name, instance, up, unnest(generate_series((ts_us // {step * 1_000_000} + 1) * {step}, (ts_us // {step * 1_000_000} + 1) * {step} + {seconds - step}, {step})) AS \"at\" FROM (
        SELECT *, CASE WHEN lag({value}) OVER w IS NULL THEN 0 WHEN {value} >= lag({value}) OVER w THEN {value} - lag({value}) OVER w ELSE {value} END AS up
        FROM samples WINDOW w AS (PARTITION BY name, instance ORDER BY ts_us, \"offset\"))) GROUP BY name, instance, \"at\""""


def _samples(spark, d, value):
    return fx.samples(spark, d).withColumn("value", F.col(value))


@query("rate_by_label", sql("SELECT name, instance, \"offset\", round(sum(up) OVER (PARTITION BY name, instance ORDER BY ts_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) / 3600, 9) AS rate FROM (SELECT *, CASE WHEN lag(counter) OVER w IS NULL THEN 0 WHEN counter >= lag(counter) OVER w THEN counter - lag(counter) OVER w ELSE counter END AS up FROM samples WINDOW w AS (PARTITION BY name, instance ORDER BY ts_us, \"offset\"))", "samples"))
def rate_by_label(spark, d):
    return monitor.rate(_samples(spark, d, "counter"), SERIES, 3600).select(*SERIES, "offset", F.round("rate", 9).alias("rate"))


@query("sum_rate", sql(f"SELECT name, \"at\", round(sum(rate), 9) AS rate FROM ({_rates(seconds=600)}) GROUP BY name, \"at\"", "samples"))
def sum_rate(spark, d):
    return monitor.sum_rate(_samples(spark, d, "counter"), SERIES, ["name"], 600, 60).select("name", "at", F.round("rate", 9).alias("rate"))


@query("mean_latency", sql(f"SELECT s.name, s.instance, s.\"at\", round(s.rate / greatest(c.rate, 0.001), 9) AS mean, s.rate / greatest(c.rate, 0.001) > 2 AND c.rate > 0.004 AS firing FROM ({_rates('total')}) s JOIN ({_rates()}) c USING (name, instance, \"at\")", "samples"))
def mean_latency(spark, d):
    found = monitor.mean_latency(_samples(spark, d, "total"), _samples(spark, d, "counter"), SERIES, 300, 60, 2, 0.004)
    return found.withColumn("mean", F.round("mean", 9))


@query("failure_ratio", sql(f"SELECT instance, \"at\", round(f, 9) AS failed, round(f / greatest(t, 0.001), 9) AS ratio FROM (SELECT instance, \"at\", coalesce(sum(rate) FILTER (WHERE name IN ('error', 'view')), 0) AS f, sum(rate) AS t FROM ({_rates(seconds=600)}) GROUP BY instance, \"at\")", "samples"))
def failure_ratio(spark, d):
    found = monitor.failure_ratio(_samples(spark, d, "counter"), SERIES, "name", "error|view", ["instance"], 600, 60)
    return found.select("instance", "at", F.round("failed", 9).alias("failed"), F.round("ratio", 9).alias("ratio"))


@query("cas_contention", sql(f"SELECT a.instance, a.\"at\", round(a.rate / greatest(b.rate, 0.001), 9) AS ratio FROM (SELECT * FROM ({_rates(seconds=3600)}) WHERE name = 'error') a JOIN (SELECT * FROM ({_rates(seconds=3600)}) WHERE name = 'purchase') b ON a.instance = b.instance AND a.\"at\" = b.at", "samples"))
def cas_contention(spark, d):
    s = _samples(spark, d, "counter")
    conflicts, all_ = (monitor.sum_rate(s.filter(F.col("name") == n), SERIES, ["instance"], 3600, 60) for n in ("error", "purchase"))
    return monitor.ratio(conflicts, all_, ["instance"]).withColumn("ratio", F.round("ratio", 9))


@query("changes_over_window", sql("SELECT name, instance, \"offset\", CAST(sum(c) OVER (PARTITION BY name, instance ORDER BY ts_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM (SELECT *, CASE WHEN term <> lag(term) OVER (PARTITION BY name, instance ORDER BY ts_us, \"offset\") THEN 1 ELSE 0 END AS c FROM (SELECT *, floor(gauge / 20) AS term FROM samples))", "samples"))
def changes_over_window(spark, d):
    s = fx.samples(spark, d).withColumn("value", F.floor(F.col("gauge") / 20))
    return monitor.changes(s, SERIES, 86_400).select(*SERIES, "offset", "changes")


@query("alert_for_duration", sql("""SELECT name, instance, \"offset\", CASE WHEN lit THEN since END AS pending_since, lit AND \"offset\" - since >= 40 AS firing FROM (
    SELECT *, min(CASE WHEN lit THEN \"offset\" END) OVER (PARTITION BY name, instance, run ORDER BY \"offset\") AS since FROM (
    SELECT *, coalesce(gauge > 5, false) AS lit, count(*) FILTER (WHERE NOT coalesce(gauge > 5, false)) OVER (PARTITION BY name, instance ORDER BY \"offset\") AS run FROM samples))""", "samples"))
def alert_for_duration(spark, d):
    found = monitor.held_for(fx.samples(spark, d), SERIES, F.col("gauge") > 5, "offset", 40)
    return found.select(*SERIES, "offset", "pending_since", F.coalesce("firing", F.lit(False)).alias("firing"))


LATEST = 'SELECT name, instance, arg_max(gauge, "offset") AS value FROM samples GROUP BY name, instance'


@query("gauge_latest_sum", sql(f"SELECT round(sum(value), 4) AS total, max(value) AS greatest FROM ({LATEST})", "samples"))
def gauge_latest_sum(spark, d):
    return monitor.gauge_total(_samples(spark, d, "gauge"), SERIES).withColumn("total", F.round("total", 4))


@query("apply_lag", sql(f"SELECT a.instance, round(a.value - b.value, 6) AS difference FROM ({LATEST}) a JOIN ({LATEST}) b ON a.instance = b.instance AND a.name = 'view' AND b.name = 'click'", "samples"))
def apply_lag(spark, d):
    return monitor.gauge_difference(_samples(spark, d, "gauge"), "view", "click", ["instance"]).withColumn("difference", F.round("difference", 6))
