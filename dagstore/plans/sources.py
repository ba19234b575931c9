"""Queries over sources, sinks and what no other query reaches: packs, framed logs, exports, parsers, clocks, closures from bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dagstore.functions import content, delta, hashing, names
from dagstore.operators import graph, leases, monitor, pack, reflog
from dagstore.plans import fixtures as fx
from dagstore.plans.fixtures import sql
from dagstore.plans.registry import query, table
from dagstore.session import materialize, shared_dir, small_batches
from dagstore.sources import frames, packs, upstream

TEXTS = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"
BLOB = "sha1('blob ' || octet_length(encode(text)) || chr(0) || text)"


def texts(spark, d):
    small_batches(spark)  # of whole texts
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))


def packed(spark, d, per_pack=200):
    """All documents as packs in order of id, each text against the one before it where that saves bytes."""
    from pyspark.sql import Window

    t = texts(spark, d).withColumn("pack", F.floor(F.col("doc_id") / per_pack).cast("string"))
    w = Window.partitionBy("pack").orderBy("doc_id", "content")
    t = t.withColumn("rank", F.row_number().over(w)).withColumn("before", F.lag("content").over(w))
    t = t.withColumn("delta", delta.encode_udf()(F.col("before"), F.col("content")))
    smaller = F.octet_length("delta") * 2 < F.octet_length("content")
    objects = t.select("pack", "rank", F.lit(3).alias("git_type"), "content", F.when(smaller, F.col("rank") - 1).alias("base_rank"), F.when(smaller, F.col("delta")).alias("delta"))
    return materialize(packs.write_packs(objects), "packs")


@query("pack_round_trip", f"SELECT CAST(doc_id // 200 AS VARCHAR) AS pack, {BLOB} AS sha1, sha256(text) AS id, octet_length(encode(text)) AS size, 3 AS git_type, count(*) AS copies FROM ({TEXTS}) GROUP BY doc_id // 200, text")
def pack_round_trip(spark, d):
    back = packs.read_packs(packed(spark, d))
    return back.groupBy("pack", "sha1", "id", F.octet_length("content").cast("long").alias("size"), "git_type").agg(F.count(F.lit(1)).alias("copies"))


@query("pack_index", f"SELECT CAST(doc_id // 200 AS VARCHAR) AS pack, {BLOB} AS sha1, count(*) AS entries, true AS agree FROM ({TEXTS}) GROUP BY doc_id // 200, text")
def pack_index(spark, d):
    p = packed(spark, d)
    index, side = packs.read_indexes(p), packs.read_sidecars(p)
    both = index.join(side.select("pack", "offset", F.col("sha1").alias("other")), ["pack", "offset"], "full_outer")
    return both.groupBy("pack", "sha1").agg(F.count(F.lit(1)).alias("entries"), F.bool_and(F.col("sha1").eqNullSafe(F.col("other"))).alias("agree"))


@query("pack_sidecar", f"SELECT CAST(doc_id // 200 AS VARCHAR) AS pack, sha256(text) AS id, {BLOB} AS sha1, 3 AS git_type, count(*) AS n FROM ({TEXTS}) GROUP BY doc_id // 200, text")
def pack_sidecar(spark, d):
    return packs.read_sidecars(packed(spark, d)).groupBy("pack", "id", "sha1", "git_type").agg(F.count(F.lit(1)).alias("n"))


@query("thin_pack", f"SELECT doc_id, {BLOB} AS sha1, octet_length(encode(text)) AS size FROM ({TEXTS})")
def thin_pack(spark, d):
    """Each text as a pack of one delta, whose base only the store has."""
    import pyarrow as pa

    small_batches(spark)
    base = F.encode(F.concat(F.substring("text", 20, 400), F.lit("base")), "UTF-8")
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", base.alias("base"), F.col("text").cast("binary").alias("content"))
    t = t.select("doc_id", "base", hashing.git_id(F.lit("blob"), F.col("base")).alias("sha1"), delta.encode_udf()("base", "content").alias("delta"))

    def run(batches):
        for b in batches:
            ids, shas, ds = (b.column(k).to_pylist() for k in range(3))
            made = [packs.write_pack([(3, b"")], [bytes.fromhex(s)], [x])[0] for s, x in zip(shas, ds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids], pa.string()), pa.array(made, pa.binary())], names=["pack", "content"])

    thin = t.select("doc_id", "sha1", "delta").mapInArrow(run, "pack string, content binary")
    store = t.select("sha1", F.lit(3).alias("git_type"), F.col("base").alias("content")).dropDuplicates(["sha1"])
    return packs.read_packs(thin, store).select(F.col("pack").cast("bigint").alias("doc_id"), "sha1", F.octet_length("content").cast("long").alias("size"))


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat_ws("|", "event_id", "event_type", "user_id").cast("binary").alias("payload"), "event_id")


def _fields(df):
    f = F.split(F.decode("payload", "UTF-8"), "\\|")
    return df.select(f[0].cast("bigint").alias("event_id"), f[1].alias("event_type"), f[2].cast("bigint").alias("user_id"))


@query("log_frames", "SELECT event_id, event_type, user_id FROM events")
def log_frames(spark, d):
    path = f"{shared_dir(spark).removeprefix('file://')}/log-{uuid.uuid4().hex}"
    log = _log(spark, d)
    half = log.agg(F.max("event_id")).first()[0] // 2
    frames.append_log(log.filter(F.col("event_id") <= half), path, "event_id")
    frames.append_log(log.filter(F.col("event_id") > half), path, "event_id")
    return _fields(frames.read_log(spark, path))


@query("log_checkpoint", "SELECT max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, user_id FROM events GROUP BY user_id")
def log_checkpoint(spark, d):
    path = f"{shared_dir(spark).removeprefix('file://')}/log-{uuid.uuid4().hex}"
    log = _log(spark, d)
    frames.append_log(log, path, "event_id")
    last = _fields(frames.read_log(spark, path)).groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e"))
    frames.write_checkpoint(last.select(F.concat_ws("|", "e.event_id", "e.event_type", "user_id").cast("binary").alias("payload")), path)
    return _fields(frames.read_log(spark, path))


@query("export_parse", f"SELECT doc_id, {BLOB} AS sha1, 3 AS git_type, sha256(text) AS id FROM ({TEXTS})")
def export_parse(spark, d):
    t = texts(spark, d)
    sha1 = hashing.git_id(F.lit("blob"), F.col("content"))
    head = F.concat(sha1, F.lit(" blob "), F.octet_length("content").cast("string"), F.lit("\n")).cast("binary")
    files = t.select(F.col("doc_id").cast("string").alias("path"), F.concat(head, "content", F.lit("\n").cast("binary")).alias("content"))
    return upstream.read_exports(files).select(F.col("path").cast("bigint").alias("doc_id"), "sha1", "git_type", hashing.object_id(F.col("content")).alias("id"))


@query("export_refs", "SELECT 'refs/heads/u' || c_custkey AS name, sha1(c_name) AS sha1 FROM customer")
def export_refs(spark, d):
    line = F.concat(F.lit("refs/heads/u"), "c_custkey", F.lit(" "), F.upper(F.sha1(F.col("c_name").cast("binary"))), F.lit(" "))
    return upstream.read_ref_lines(table(spark, d, "customer").select(line.alias("value")).union(spark.createDataFrame([("no blank",)], "value string").select(F.lit("noblank"))))


@query("metric_text", sql("SELECT name || '{instance=\"i' || instance || '\",note=\"a\\\"b\"} ' || n AS value FROM (SELECT name, instance, count(*) AS n FROM samples GROUP BY name, instance)", "samples"))
def metric_text(spark, d):
    counts = fx.samples(spark, d).groupBy("name", "instance").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return upstream.metric_lines(counts.select("name", F.create_map(F.lit("note"), F.lit('a"b'), F.lit("instance"), F.concat(F.lit("i"), "instance")).alias("labels"), "value"))


@query("metric_text_read", sql("SELECT name, 'i' || instance AS instance, 'a\"b' AS note, CAST(count(*) AS DOUBLE) AS value FROM samples GROUP BY name, instance", "samples"))
def metric_text_read(spark, d):
    back = upstream.read_metric_lines(metric_text(spark, d).union(spark.range(1).select(F.lit("# a remark"))))
    return back.select("name", F.col("labels")["instance"].alias("instance"), F.col("labels")["note"].alias("note"), "value")


# objects by id, through chains of deltas


@query("point_read", f"SELECT {BLOB} AS sha1, octet_length(encode(text)) AS size FROM (SELECT text FROM ({TEXTS}) ORDER BY doc_id LIMIT 1)")
def point_read(spark, d):
    """One object of the packs by its SHA-1: the index tells the pack, and only that one is opened."""
    p = packed(spark, d)
    wanted = texts(spark, d).orderBy("doc_id").limit(1).select(hashing.git_id(F.lit("blob"), F.col("content")).alias("sha1"))
    where = packs.read_indexes(p).join(F.broadcast(wanted), "sha1").select("pack", "sha1", "offset")  # one row
    found = packs.read_packs(p.join(where.select("pack").distinct(), "pack", "left_semi")).join(where, ["pack", "sha1", "offset"])
    return found.select("sha1", F.octet_length("content").cast("long").alias("size")).distinct()


@query("header_projection", sql("SELECT sha1, git_type, count(*) AS n FROM objects GROUP BY sha1, git_type", "objects"))
def header_projection(spark, d):
    """Type and SHA-1 from the sidecars alone: no content is read."""
    return packs.read_sidecars(packed(spark, d).select("pack", "sidecar")).select("sha1", "git_type").distinct().withColumn("n", F.lit(1).cast("long"))


@query("ref_lookup", sql("SELECT name, target, version FROM refs WHERE name = 'refs/heads/c4' AND version > 0", "refs"))
def ref_lookup(spark, d):
    return fx.refs(spark, d).filter("name = 'refs/heads/c4' and version > 0")


@query("batch_write_ids", f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, sha256(text) AS id FROM ({TEXTS})")
def batch_write_ids(spark, d):
    """Ids of a batch in its order, numbered by ranges without a global sort in one task."""
    t = texts(spark, d).select(F.lit(0).alias("git_type"), F.col("doc_id").alias("name_hash"), F.lit(0).alias("size"), F.col("doc_id").cast("string").alias("id"), hashing.object_id(F.col("content")).alias("oid"))
    return pack.numbered(t).select((F.col("rank") - 1).alias("ordinal"), F.col("name_hash").alias("doc_id"), F.col("oid").alias("id"))


# from bytes to closures


def _tree_objects(spark, d):
    """Blobs of turns, a tree a turn with that blob and a submodule link, a commit a turn, a tag for every last turn: as bytes, named by SHA-1."""
    git = lambda kind, c: hashing.git_id(F.lit(kind), c)
    t = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", F.col("text").cast("binary").alias("blob")).withColumn("blob_sha1", git("blob", F.col("blob")))
    entry = lambda mode, name, sha: F.concat(F.lit(f"{mode} {name}\0").cast("binary"), F.unhex(sha))
    t = t.withColumn("tree", F.concat(entry("100644", "text", F.col("blob_sha1")), entry("160000", "link", F.sha1(F.lit("elsewhere").cast("binary")))))
    t = t.withColumn("tree_sha1", git("tree", F.col("tree")))
    head = F.concat(F.lit("tree "), "tree_sha1", F.lit("\nauthor "), "conv_id", F.lit(":"), "turn", F.lit("\n\nparent 0000000000000000000000000000000000000000\n"))
    t = t.withColumn("commit", head.cast("binary")).withColumn("commit_sha1", git("commit", F.col("commit")))
    objects = t.select(F.col("blob_sha1").alias("sha1"), F.lit(3).alias("git_type"), F.col("blob").alias("content"))
    objects = objects.unionByName(t.select(F.col("tree_sha1").alias("sha1"), F.lit(2).alias("git_type"), F.col("tree").alias("content")))
    objects = objects.unionByName(t.select(F.col("commit_sha1").alias("sha1"), F.lit(1).alias("git_type"), F.col("commit").alias("content")))
    tag = F.concat(F.lit("object "), "commit_sha1", F.lit("\ntype commit\n\nnote")).cast("binary")
    tags = t.filter("turn = 0").select(git("tag", tag).alias("sha1"), F.lit(4).alias("git_type"), tag.alias("content"))
    every = objects.unionByName(tags).dropDuplicates(["sha1"])
    return materialize(every.withColumn("id", F.concat(F.lit("x"), "sha1")), "objects"), tags


@query("closure_from_bytes", """WITH t AS (SELECT conv_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob FROM conversations WHERE text IS NOT NULL AND turn = 0)
    SELECT git_type, n FROM (SELECT 3 AS git_type, count(DISTINCT blob) AS n FROM t UNION ALL SELECT 2, count(DISTINCT blob) FROM t UNION ALL SELECT 1, count(*) FROM t UNION ALL SELECT 4, count(*) FROM t)""")
def closure_from_bytes(spark, d):
    """Objects' bytes to edges to what the tags reach: tag, commit, tree and blob; the submodule's commit is never an edge."""
    objects, tags = _tree_objects(spark, d)
    edges = content.object_edges(objects)
    reached = graph.reachable(edges, tags.select(F.concat(F.lit("x"), "sha1").alias("id")))
    return objects.join(reached, "id", "left_semi").groupBy("git_type").agg(F.count(F.lit(1)).alias("n"))


@query("edge_kinds", """WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), b AS (SELECT DISTINCT text FROM t)
    SELECT kind, mode, name, n FROM (SELECT 'tree' AS kind, '' AS mode, '' AS name, count(*) AS n FROM t UNION ALL SELECT 'tree', '100644', 'text', count(*) FROM b UNION ALL SELECT 'tag', '', '', count(*) FROM t WHERE turn = 0)""")
def edge_kinds(spark, d):
    edges = content.object_edges(_tree_objects(spark, d)[0])
    return edges.groupBy("kind", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce(F.decode("name", "UTF-8"), F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("tree_children_in_repo", "SELECT r_regionkey AS id, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def tree_children_in_repo(spark, d):
    from dagstore.plans.objects import tree_entries

    return tree_entries(spark, d).filter(F.col("mode") != content.GITLINK).select("id", "name")


@query("tag_object", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN sha1(c_name) END AS object FROM customer")
def tag_object(spark, d):
    sha = F.sha1(F.col("c_name").cast("binary"))
    good = F.concat(F.lit("object "), F.upper(sha), F.lit("\ntype commit\n\nobject x"))
    raw = F.when(F.col("c_custkey") % 3 != 0, good).otherwise(F.concat(F.lit("type commit\nobject short\n\nobject "), sha)).cast("binary")
    return table(spark, d, "customer").select("c_custkey", content.tag_object(raw).alias("object"))


@query("name_hash_propagation", "SELECT sha1(n_name) AS id, min(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(substr(n_name, i, 1)) AS BIGINT))), lambda h, c: CASE WHEN c = 32 THEN h ELSE ((h >> 2) + (c << 24)) & 4294967295 END)) AS name_hash FROM nation GROUP BY n_name")
def name_hash_propagation(spark, d):
    edges = table(spark, d, "nation").select(F.sha1(F.col("n_name").cast("binary")).alias("dst"), F.lit("tree").alias("kind"), F.col("n_name").cast("binary").alias("name"))
    return graph.name_hashes(edges)


@query("would_cycle", sql(", c(id, start) AS (SELECT id, id FROM turns UNION SELECT b.base, c.start FROM c JOIN bases b ON b.id = c.id WHERE b.base IS NOT NULL) SELECT p.id, p.base FROM (SELECT 'm:' || conv_id || ':0' AS id, 'm:' || conv_id || ':' || turn AS base FROM turns) p JOIN c ON c.start = p.base AND c.id = p.id", "turns", "bases", recursive=True))
def would_cycle(spark, d):
    pairs = fx.turns(spark, d).select(F.concat_ws(":", F.lit("m"), "conv_id", F.lit(0)).alias("id"), F.col("id").alias("base"))
    return graph.would_cycle(fx.bases(spark, d), pairs)


@query("warm_segments", sql(""", tips AS (SELECT DISTINCT regexp_extract(name, '^refs/(.*?)(heads/|tags/)', 1) AS segment, target AS id FROM refs),
    c(segment, id) AS (SELECT segment, id FROM tips UNION SELECT c.segment, e.dst FROM c JOIN history e ON e.src = c.id) SELECT segment, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM c JOIN store USING (id) GROUP BY segment""", "refs", "history", "store", recursive=True))
def warm_segments(spark, d):
    """What a clone of each segment sends: one traversal of all segments, tagged."""
    seeds = fx.refs(spark, d).select(names.segment_of_ref(F.col("name")).alias("segment"), F.col("target").alias("id"))
    found = graph.closure(fx.history(spark, d), seeds, tags=("segment",)).select("segment", "id")
    return found.join(fx.store(spark, d).select("id", "size"), "id").groupBy("segment").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


@query("repack_stats", sql("SELECT count(*) AS objects, count(*) FILTER (WHERE size % 3 = 0) AS deltified, CAST(sum(size) AS BIGINT) AS bytes_before, CAST(sum(CASE WHEN size % 3 = 0 THEN size // 2 ELSE size END) AS BIGINT) AS bytes_after FROM objects", "objects"))
def repack_stats(spark, d):
    o = fx.objects(spark, d)
    return pack.repack_stats(o, o.filter("size % 3 = 0").select("id", F.floor(F.col("size") / 2).alias("delta_size")))


@query("advertisement_missing", sql("SELECT name, target FROM refs WHERE target NOT IN (SELECT id FROM store)", "refs", "store"))
def advertisement_missing(spark, d):
    from dagstore.operators import fetch

    return fetch.advertisement(fx.refs(spark, d), fx.store(spark, d))[1].select("name", "target")


# names, ids, clocks


@query("workspace_names", "SELECT user_id, 'refs/workspaces/' || w || '/heads/x' AS stored, 'refs/heads/x' AS client, CASE WHEN user_id % 5 = 0 THEN 'refs/heads/x' ELSE 'refs/tenants/t' || (user_id % 3) || '/heads/x' END AS durable FROM (SELECT DISTINCT user_id, lpad(lower(to_hex(user_id)), 32, '0') AS w FROM events)")
def workspace_names(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    stored = names.workspace_ref(fx.workspace_id(), F.lit("refs/heads/x"))
    tenant = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("user_id") % 3))
    return users.select("user_id", stored.alias("stored"), names.client_ref(stored).alias("client"), names.durable_ref(F.lit("refs/heads/x"), tenant).alias("durable"))


@query("workspace_shards", "SELECT DISTINCT user_id, true AS together FROM events")
def workspace_shards(spark, d):
    """A workspace's shard is that of its refs."""
    users = table(spark, d, "events").select("user_id").distinct()
    ref = F.concat(F.lit("refs/workspaces/"), fx.workspace_id(), F.lit("/heads/main"))
    return users.select("user_id", (hashing.shard_for_workspace(fx.workspace_id(), 7) == hashing.shard_for(ref, 7)).alias("together"))


@query("id_codecs", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN sha1(c_name) END AS sha1, CASE WHEN c_custkey % 4 = 0 THEN sha1(c_name) END AS strict FROM customer")
def id_codecs(spark, d):
    sha, k = F.sha1(F.col("c_name").cast("binary")), F.col("c_custkey") % 4
    given = F.when(k == 0, sha).when(k == 1, F.concat(F.lit(" "), F.upper(sha))).when(k == 2, F.substring(sha, 1, 39)).otherwise(F.concat(F.lit("g"), F.substring(sha, 2, 39)))
    return table(spark, d, "customer").select("c_custkey", names.hex_id(given, 20).alias("sha1"), F.lower(F.hex(names.parse_sha1(given))).alias("strict"))


@query("fnv_hashes", sql("SELECT name, lpad(lower(to_hex(CAST(h AS UBIGINT))), 16, '0') AS h FROM (SELECT name, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, octet_length(encode(name)) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS HUGEINT))), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) AS h FROM refs)", "refs"))
def fnv_hashes(spark, d):
    return fx.refs(spark, d).select("name", hashing.fnv_hex(F.col("name")).alias("h"))


@query("hlc_ticks", "WITH RECURSIVE e AS (SELECT user_id % 4 AS node, event_id, epoch_us(ts) // 86400000000 AS ms, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS k FROM events), t(node, k, event_id, hlc) AS (SELECT node, k, event_id, ms * 1048576 FROM e WHERE k = 1 UNION ALL SELECT e.node, e.k, e.event_id, greatest(e.ms * 1048576, t.hlc + 1) FROM t JOIN e ON e.node = t.node AND e.k = t.k + 1) SELECT node, event_id AS \"offset\", hlc FROM t")
def hlc_ticks(spark, d):
    """A clock that only moves once a day: between, ticks count up."""
    wall = F.floor(hashing.micros(F.col("ts")) / 86_400_000_000).cast("bigint")
    return reflog.hlc_ticks(table(spark, d, "events").select((F.col("user_id") % 4).alias("node"), F.col("event_id").alias("offset"), wall.alias("wall_ms")))


@query("inflate_bounded", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS id FROM ({TEXTS})")
def inflate_bounded(spark, d):
    """Contents whose stated size is right come back; one that is too small or too large gives nothing."""
    import zlib

    pack_ = F.pandas_udf(lambda s: s.map(lambda x: zlib.compress(bytes(x))), "binary")
    t = texts(spark, d).withColumn("size", F.octet_length("content") + F.when(F.col("doc_id") % 3 == 1, 1).when(F.col("doc_id") % 3 == 2, -1).otherwise(0))
    return t.select("doc_id", F.sha2(delta.inflate_udf()(pack_("content"), "size"), 256).alias("id"))


# leases and transactions that other queries leave out


@query("lease_live_for_tenant", sql("SELECT id, tenant_id FROM leases WHERE expires_at_ms > (SELECT now_ms FROM now) AND tenant_id = ''", "leases", "now"))
def lease_live_for_tenant(spark, d):
    return leases.live(fx.leases(spark, d), fx.now_ms(spark, d), "root").select("id", "tenant_id")


@query("lease_ownership", sql("SELECT DISTINCT c.id, c.tenant, coalesce(c.tenant = CASE WHEN l.tenant_id = '' THEN 'root' ELSE l.tenant_id END, false) AS found FROM (SELECT DISTINCT lpad(lower(to_hex(user_id)), 32, '0') AS id, CASE WHEN user_id % 2 = 0 THEN 'root' ELSE 't' || (user_id % 3) END AS tenant FROM events) c LEFT JOIN leases l ON l.id = c.id", "leases"))
def lease_ownership(spark, d):
    tenant = F.when(F.col("user_id") % 2 == 0, "").otherwise(F.concat(F.lit("t"), F.col("user_id") % 3))
    calls = table(spark, d, "events").select(fx.workspace_id().alias("id"), tenant.alias("tenant")).distinct()
    return leases.owned(fx.leases(spark, d), calls)


@query("live_count", sql("SELECT count(*) AS leases FROM leases WHERE expires_at_ms > (SELECT now_ms FROM now)", "leases", "now"))
def live_count(spark, d):
    return leases.live(fx.leases(spark, d), fx.now_ms(spark, d)).agg(F.count(F.lit(1)).alias("leases"))


OPS = "SELECT event_id // 4 AS txn, CAST(user_id % 3 AS INTEGER) AS shard, 'refs/heads/c' || (user_id % 50 * 2) AS name, 't' || event_id AS target, CASE WHEN event_id % 2 = 1 THEN 'm:' || (user_id % 50 * 2) || ':' || (event_id % 5) END AS expected, event_id FROM events"


@query("two_phase_apply", sql(f""", o AS (SELECT o.*, r.version, NOT (o.name = 'refs/heads/c8') AND CASE WHEN o.expected IS NULL THEN r.target IS NULL ELSE coalesce(r.target = o.expected, false) END AS would FROM (SELECT txn, shard, name, min(target) AS target, min(expected) AS expected FROM ({OPS}) GROUP BY ALL) o LEFT JOIN refs r ON r.name = o.name),
    s AS (SELECT *, coalesce(bool_or(NOT would) OVER (PARTITION BY txn ORDER BY shard, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped, bool_and(would) OVER (PARTITION BY txn) AS yes FROM o)
    SELECT txn, shard, name, CASE WHEN NOT stopped THEN would END AS vote, CASE WHEN yes THEN 'Commit' ELSE 'Abort' END AS decision, CASE WHEN yes THEN 'committed' WHEN would AND NOT stopped THEN 'released' ELSE 'untouched' END AS outcome, coalesce(version, 0) + CAST(yes AS BIGINT) AS version FROM s""", "refs"))
def two_phase_apply(spark, d):
    k = F.col("user_id") % 50 * 2
    ops = table(spark, d, "events").select(
        F.floor(F.col("event_id") / 4).alias("txn"),
        (F.col("user_id") % 3).cast("int").alias("shard"),
        F.concat(F.lit("refs/heads/c"), k).alias("name"),
        F.concat(F.lit("t"), "event_id").alias("target"),
        F.when(F.col("event_id") % 2 == 1, F.concat_ws(":", F.lit("m"), k, F.col("event_id") % 5)).alias("expected"),
    )
    ops = ops.groupBy("txn", "shard", "name").agg(F.min("target").alias("target"), F.min("expected").alias("expected"))
    return reflog.two_phase(ops, fx.refs(spark, d), spark.createDataFrame([("refs/heads/c8",)], "name string"))


@query("snapshot_install", sql('SELECT name, target, "offset" FROM (SELECT * FROM ref_log WHERE kind IN (\'put\', \'delete\')) QUALIFY row_number() OVER (PARTITION BY name ORDER BY "offset" DESC) = 1 AND kind <> \'delete\'', "ref_log"))
def snapshot_install(spark, d):
    """A snapshot at an offset, installed, and the rest of the log after it give the table that the whole log gives."""
    log = fx.ref_log(spark, d).filter("kind in ('put', 'delete')").select("name", "offset", "kind", "target")
    state = reflog.snapshot(log.filter("offset <= 4000"), "name").withColumnRenamed("offset", "was")
    again = reflog.install(log.withColumn("was", F.col("offset")), state.withColumn("offset", F.lit(0)).select("name", "offset", "kind", "target", "was"), 4000)
    return reflog.latest_per_key(again, "name").select("name", "target", F.col("was").alias("offset"))


@query("gauge_by_label_regex", sql("SELECT name, round(sum(r), 9) AS rate, \"at\" FROM (SELECT name, instance, \"at\", sum(up) / 600 AS r FROM (SELECT *, unnest(generate_series((ts_us // 60000000 + 1) * 60, (ts_us // 60000000 + 1) * 60 + 540, 60)) AS \"at\" FROM (SELECT *, CASE WHEN lag(counter) OVER w IS NULL THEN 0 WHEN counter >= lag(counter) OVER w THEN counter - lag(counter) OVER w ELSE counter END AS up FROM samples WHERE name IN ('view', 'click') WINDOW w AS (PARTITION BY name, instance ORDER BY ts_us, \"offset\"))) GROUP BY name, instance, \"at\") GROUP BY name, \"at\"", "samples"))
def gauge_by_label_regex(spark, d):
    s = fx.samples(spark, d).withColumn("value", F.col("counter")).filter(F.rlike("name", F.lit("^(?:view|cl.*)$")))
    return monitor.sum_rate(s, ["name", "instance"], ["name"], 600, 60).withColumn("rate", F.round("rate", 9))
