"""Queries over objects, names and the object graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from dagstore.functions import content, delta, hashing, names
from dagstore.operators import fetch, gc, graph, pack, storage
from dagstore.plans import fixtures as fx
from dagstore.plans.fixtures import sql
from dagstore.plans.registry import query, table
from dagstore.session import small_batches


@query("object_identity", "SELECT sha256(text) AS oid, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS sha1, octet_length(encode(text)) AS size, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def object_identity(spark, d):
    t = table(spark, d, "documents").filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return t.select(hashing.object_id(F.col("text")).alias("oid"), hashing.git_id(F.lit("blob"), F.col("text")).alias("sha1"), F.octet_length("text").cast("long").alias("size"), "copies")


@query("object_dedup_groups", "SELECT copies, count(*) AS n_groups FROM (SELECT count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)) GROUP BY copies")
def object_dedup_groups(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.groupBy(hashing.object_id(F.col("text")).alias("oid")).agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("n_groups"))


@query("id_scan_union", sql("SELECT id FROM objects", "objects"))
def id_scan_union(spark, d):
    o = fx.objects(spark, d)
    return storage.all_ids(o.filter("loose"), o.filter("not loose or size % 2 = 0"))


@query("sha1_index", sql("SELECT sha1, min(id) AS id FROM objects GROUP BY sha1", "objects"))
def sha1_index(spark, d):
    o = fx.objects(spark, d)
    return storage.sha1_index(o.filter("loose"), o)


@query("exists_bulk", "SELECT DISTINCT l.doc_id, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 2 = 0) AS found FROM labels l")
def exists_bulk(spark, d):
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    held = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return storage.exists(wanted, held).withColumnRenamed("id", "doc_id")


@query("new_objects", "SELECT DISTINCT sha256(text) AS id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)")
def new_objects(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", hashing.object_id(F.col("text")).alias("id"))
    return storage.new_objects(t.select("id"), t.filter("doc_id % 2 = 0").select("id"))


@query("missing_objects", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def missing_objects(spark, d):
    referenced = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return fetch.disconnected(referenced, orders.filter("id % 3 = 1"), orders.filter("id % 3 = 2"))


# names

REFS = "SELECT name, target, version FROM refs"


@query("ref_prefix_list", sql("SELECT name, target FROM refs WHERE starts_with(name, 'refs/heads/') AND version > 0", "refs"))
def ref_prefix_list(spark, d):
    return fx.refs(spark, d).filter(F.startswith("name", F.lit("refs/heads/")) & (F.col("version") > 0)).select("name", "target")


@query("ref_tenant_of", sql("SELECT name, coalesce(nullif(regexp_extract(name, '^refs/tenants/([^/]+)/', 1), ''), 'root') AS tenant, coalesce(nullif(regexp_extract(name, '^refs/workspaces/([^/]+)/', 1), ''), '-') AS workspace, NOT starts_with(name, 'refs/workspaces/') AS durable FROM refs", "refs"))
def ref_tenant_of(spark, d):
    n = F.col("name")
    return fx.refs(spark, d).select("name", names.tenant_of_ref(n).alias("tenant"), F.coalesce(names.workspace_of_ref(n), F.lit("-")).alias("workspace"), names.is_durable(n).alias("durable"))


@query("segment_list", sql("SELECT DISTINCT regexp_extract(name, '^refs/(.*?)(heads/|tags/)', 1) AS segment FROM refs", "refs"))
def segment_list(spark, d):
    return fx.refs(spark, d).select(names.segment_of_ref(F.col("name")).alias("segment")).distinct().orderBy("segment")


@query("ref_presented", sql("SELECT name, 'refs/' || substr(name, 6 + length(seg)) AS client, 'refs/' || seg || substr('refs/' || substr(name, 6 + length(seg)), 6) AS stored FROM (SELECT name, regexp_extract(name, '^refs/(.*?)(heads/|tags/)', 1) AS seg FROM refs)", "refs"))
def ref_presented(spark, d):
    seg = names.segment_of_ref(F.col("name"))
    out = fx.refs(spark, d).select("name", seg.alias("seg")).withColumn("client", names.present_ref(F.col("name"), F.col("seg")))
    return out.select("name", "client", names.store_ref(F.col("client"), F.col("seg")).alias("stored"))


@query("ref_name_valid", "SELECT page_id, starts_with(n, 'refs/') AND NOT contains(n, '..') AND NOT contains(n, '//') AND NOT regexp_matches(n, '[\\x00-\\x1f\\x7f]') AS valid FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE 'refs/heads/' || CASE WHEN page_id % 5 = 1 THEN url ELSE regexp_replace(url, '^https?://', '') END || CASE WHEN page_id % 7 = 0 THEN '..x' ELSE '' END END AS n FROM pages)")
def ref_name_valid(spark, d):
    url, k = F.col("url"), F.col("page_id") % 5
    n = F.when(k == 0, url).otherwise(F.concat(F.lit("refs/heads/"), F.when(k == 1, url).otherwise(F.regexp_replace(url, "^https?://", "")), F.when(F.col("page_id") % 7 == 0, "..x").otherwise("")))
    return table(spark, d, "pages").select("page_id", names.valid_ref_name(n).alias("valid"))


@query("ref_default_branch", sql("""SELECT segment, substr(min(r || client), 2) AS head FROM (SELECT seg AS segment, client, CASE client WHEN 'refs/heads/main' THEN '0' WHEN 'refs/heads/master' THEN '1' ELSE '2' END AS r FROM
    (SELECT seg, 'refs/' || substr(name, 6 + length(seg)) AS client FROM (SELECT name, regexp_extract(name, '^refs/(.*?)(heads/|tags/)', 1) AS seg FROM refs))) GROUP BY segment""", "refs"))
def ref_default_branch(spark, d):
    r = fx.refs(spark, d).withColumn("segment", names.segment_of_ref(F.col("name")))
    return fetch.default_branch(r.select("segment", names.present_ref(F.col("name"), F.col("segment")).alias("client_name")))


@query("blob_filter_parse", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN -1 WHEN 1 THEN page_id WHEN 2 THEN page_id * 1024 WHEN 3 THEN page_id * 1048576 WHEN 4 THEN 9223372036854775807 END AS max_bytes FROM pages")
def blob_filter_parse(spark, d):
    p, k = F.col("page_id"), F.col("page_id") % 6
    spec = F.when(k == 0, "blob:none").when(k == 5, F.concat(F.lit("tree:"), p)).when(k == 4, "blob:limit=99999999999999999999g").otherwise(F.concat(F.lit("blob:limit="), p, F.when(k == 2, "k").when(k == 3, "M").otherwise("")))
    return table(spark, d, "pages").select("page_id", names.blob_filter_limit(spec).alias("max_bytes"))


@query("upload_cache_key", sql("SELECT segment, sha256(segment || chr(0) || list_aggregate(list_sort(list(target)), 'string_agg', ',')) AS key FROM (SELECT regexp_extract(name, '^refs/(.*?)(heads/|tags/)', 1) AS segment, target FROM refs WHERE NOT starts_with(name, 'refs/workspaces/')) GROUP BY segment", "refs"))
def upload_cache_key(spark, d):
    r = fx.refs(spark, d).filter(names.is_durable(F.col("name"))).groupBy(names.segment_of_ref(F.col("name")).alias("segment")).agg(F.collect_list("target").alias("wants"))
    return r.select("segment", names.cache_key(F.col("segment"), F.col("wants")).alias("key"))


@query("blocked_ips", """WITH ips AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events),
t AS (SELECT event_id, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS e FROM ips)
SELECT event_id, a || '.' || b || '.' || c || '.' || e AS ip, a IN (10, 127) OR a BETWEEN 224 AND 239 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR (a + b + c + e = 0) OR (a + b + c + e = 1020) AS blocked FROM t""")
def blocked_ips(spark, d):
    from dagstore.operators.policy import blocked_ip

    n = (F.col("event_id") * 2654435761) % 4294967296
    part = lambda k: F.floor(n / k).cast("bigint") % 256
    e = table(spark, d, "events").select("event_id", F.concat_ws(".", part(16777216), part(65536), part(256), part(1)).alias("ip"))
    return e.withColumn("blocked", blocked_ip(F.col("ip")))


FNV = """list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, octet_length(encode({k})) + 1), lambda i: CAST(ascii(substr({k}, i, 1)) AS HUGEINT))), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)"""
KEY = "CASE WHEN regexp_matches(name, '^refs/(heads|tags)/') THEN 'refs/' || regexp_extract(name, '^refs/([^/]*/[^/]*)', 1) WHEN regexp_matches(name, '^refs/[^/]*/') THEN regexp_extract(name, '^refs/([^/]*/[^/]*)', 1) ELSE name END"


@query("shard_for_ref", sql(f"SELECT name, CAST({FNV.format(k='k')} % 4 AS INTEGER) AS shard FROM (SELECT name, {KEY} AS k FROM refs)", "refs"))
def shard_for_ref(spark, d):
    return fx.refs(spark, d).select("name", hashing.shard_for(F.col("name"), 4).alias("shard"))


@query("shard_counts", sql(f"SELECT shard, count(*) AS n_refs FROM (SELECT CAST({FNV.format(k='k')} % 7 AS INTEGER) AS shard FROM (SELECT {KEY} AS k FROM refs)) GROUP BY shard", "refs"))
def shard_counts(spark, d):
    return fx.refs(spark, d).groupBy(hashing.shard_for(F.col("name"), 7).alias("shard")).agg(F.count(F.lit(1)).alias("n_refs"))


@query("cluster_ref_list", sql("SELECT name, target FROM refs WHERE starts_with(name, 'refs/tenants/t1/')", "refs"))
def cluster_ref_list(spark, d):
    r = fx.refs(spark, d).withColumn("shard", hashing.shard_for(F.col("name"), 4))
    return storage.cluster_list(r.select("shard", "name", "target"), "refs/tenants/t1/", 4)


@query("replica_placement", sql(f"SELECT name, shard, array_to_string([shard * 10, shard * 10 + 1, shard * 10 + 2], ',') AS nodes, shard * 10 AS forward_to FROM (SELECT name, CAST({FNV.format(k='k')} % 4 AS INTEGER) AS shard FROM (SELECT name, {KEY} AS k FROM refs))", "refs"))
def replica_placement(spark, d):
    shard_map = spark.range(12).select((F.col("id") % 4).cast("int").alias("shard"), ((F.col("id") % 4) * 10 + F.floor(F.col("id") / 4)).cast("int").alias("node_id"))
    out = storage.replicas_of(fx.refs(spark, d).select("name"), shard_map, 4)
    return out.select("name", "shard", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "forward_to")


@query("txn_shard_groups", f"SELECT txn, shard, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT txn, name, CAST({FNV.format(k='name')} % 2 AS INTEGER) AS shard FROM (SELECT event_id // 8 AS txn, 'refs/heads/u' || user_id AS name FROM events)) GROUP BY ALL")
def txn_shard_groups(spark, d):
    ops = table(spark, d, "events").select(F.floor(F.col("event_id") / 8).alias("txn"), F.concat(F.lit("refs/heads/u"), F.col("user_id")).alias("name"))
    return storage.group_by_shard(ops, 2).withColumn("names", F.array_join("names", ","))


# graph

REACH = ", {c}(id) AS (SELECT id FROM ({seeds}) UNION SELECT e.dst FROM {c} JOIN {edges} e ON e.src = {c}.id{where})"


@query("reachable_closure", sql(REACH.format(c="c", seeds="SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'x:gone'", edges="wide", where="") + " SELECT id FROM c", "wide", recursive=True))
def reachable_closure(spark, d):
    seeds = table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("id"))
    return graph.reachable(fx.wide(spark, d), seeds.union(spark.createDataFrame([("x:gone",)], "id string")))


@query("closure_sizes_by_root", sql(", c(tag, id) AS (SELECT DISTINCT src, src FROM wide WHERE starts_with(src, 'n:') UNION SELECT c.tag, e.dst FROM c JOIN wide e ON e.src = c.id) SELECT tag, count(*) AS n_ids FROM c GROUP BY tag", "wide", recursive=True))
def closure_sizes_by_root(spark, d):
    edges = fx.wide(spark, d)
    seeds = edges.filter(F.startswith("src", F.lit("n:"))).select(F.col("src").alias("id"), F.col("src").alias("tag"))
    return graph.reachable(edges, seeds, ["tag"]).groupBy("tag").agg(F.count(F.lit(1)).alias("n_ids"))


@query("delta_base_closure", sql(", c(id) AS (SELECT id FROM bases WHERE base IS NOT NULL AND id LIKE 'm:%:2' UNION SELECT b.base FROM c JOIN bases b ON b.id = c.id WHERE b.base IS NOT NULL) SELECT id FROM c", "bases", recursive=True))
def delta_base_closure(spark, d):
    b = fx.bases(spark, d)
    return graph.with_delta_bases(b.filter("base is not null and id like 'm:%:2'").select("id"), b)


@query("delta_chain_depth", sql("SELECT id, turn % 3 AS depth FROM turns", "turns"))
def delta_chain_depth(spark, d):
    return graph.chain_depth(fx.bases(spark, d)).select("id", F.col("depth").cast("long").alias("depth"))


HEADS = "SELECT target AS id FROM refs WHERE NOT starts_with(name, 'refs/workspaces/')"


def heads(spark, d):
    return fx.refs(spark, d).filter(names.is_durable(F.col("name"))).select(F.col("target").alias("id"))


@query("pack_objects_clone", sql(REACH.format(c="c", seeds=HEADS, edges="history", where="") + " SELECT id, git_type, size FROM store WHERE id IN (SELECT id FROM c)", "store", "history", "refs", recursive=True))
def pack_objects_clone(spark, d):
    return fetch.pack_objects(fx.store(spark, d), fx.history(spark, d), heads(spark, d)).select("id", "git_type", "size")


CUT = "SELECT id FROM turns WHERE turn = 2 AND conv_id % 3 = 0"


@query("pack_objects_excluding", sql(f", cut AS ({CUT}), c(id) AS (SELECT id FROM ({HEADS}) WHERE id NOT IN (SELECT id FROM cut) UNION SELECT e.dst FROM c JOIN history e ON e.src = c.id WHERE e.dst NOT IN (SELECT id FROM cut)) SELECT id, git_type, size FROM store WHERE id IN (SELECT id FROM c)", "store", "history", "refs", recursive=True))
def pack_objects_excluding(spark, d):
    cut = fx.turns(spark, d).filter("turn = 2 and conv_id % 3 = 0").select("id")
    return fetch.pack_objects(fx.store(spark, d), fx.history(spark, d), heads(spark, d), cut).select("id", "git_type", "size")


@query("partial_clone_blob_none", sql(REACH.format(c="c", seeds=HEADS, edges="history", where="") + " SELECT id, git_type, size FROM store WHERE id IN (SELECT id FROM c) AND git_type <> 3", "store", "history", "refs", recursive=True))
def partial_clone_blob_none(spark, d):
    return fetch.pack_objects(fx.store(spark, d), fx.history(spark, d), heads(spark, d), spec="blob:none").select("id", "git_type", "size")


@query("partial_clone_blob_limit", sql(f", w AS ({HEADS} UNION ALL SELECT min(blob) FROM turns WHERE octet_length(encode(text)) > 300)" + REACH.format(c="c", seeds="SELECT id FROM w", edges="history", where="") + " SELECT id, git_type, size FROM store WHERE id IN (SELECT id FROM c) AND (git_type <> 3 OR size <= 300 OR id IN (SELECT id FROM w))", "store", "history", "refs", recursive=True))
def partial_clone_blob_limit(spark, d):
    named = fx.turns(spark, d).filter(F.octet_length("text") > 300).agg(F.min("blob").alias("id"))
    return fetch.pack_objects(fx.store(spark, d), fx.history(spark, d), heads(spark, d).union(named), spec="blob:limit=300").select("id", "git_type", "size")


WANTS = "SELECT id, conv_id * 100 + turn AS ord FROM turns WHERE turn <= 1"


@query("unauthorised_wants", sql(REACH.format(c="c", seeds=HEADS, edges="history", where="") + f" SELECT id, ord FROM ({WANTS}) WHERE id NOT IN (SELECT id FROM c)", "history", "refs", recursive=True))
def unauthorised_wants(spark, d):
    wants = fx.turns(spark, d).filter("turn <= 1").select("id", (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))
    return fetch.unauthorised_wants(wants, heads(spark, d), fx.history(spark, d))


@query("first_violation", sql(REACH.format(c="c", seeds=HEADS, edges="history", where="") + f" SELECT arg_min(id, ord) AS id FROM ({WANTS}) WHERE id NOT IN (SELECT id FROM c)", "history", "refs", recursive=True))
def first_violation(spark, d):
    wants = fx.turns(spark, d).filter("turn <= 1").select("id", (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))
    return fetch.first_violation(wants, heads(spark, d), fx.history(spark, d))


HAVES = "SELECT 'm:' || conv_id || ':' || (turn + conv_id % 2 * 20) AS id, conv_id AS ord FROM turns WHERE turn = 1"


def haves(spark, d):
    t = fx.turns(spark, d).filter("turn = 1")
    return t.select(F.concat_ws(":", F.lit("m"), "conv_id", F.col("turn") + F.col("conv_id") % 2 * 20).alias("id"), F.col("conv_id").alias("ord"))


@query("incremental_fetch", sql(f", h AS ({HAVES}), x(id) AS (SELECT id FROM h WHERE id IN (SELECT id FROM store) UNION SELECT e.dst FROM x JOIN history e ON e.src = x.id), c(id) AS (SELECT id FROM ({HEADS}) WHERE id NOT IN (SELECT id FROM x) UNION SELECT e.dst FROM c JOIN history e ON e.src = c.id WHERE e.dst NOT IN (SELECT id FROM x)) SELECT id, git_type, size FROM store WHERE id IN (SELECT id FROM c)", "store", "history", "refs", recursive=True))
def incremental_fetch(spark, d):
    return fetch.incremental(fx.store(spark, d), fx.history(spark, d), heads(spark, d), haves(spark, d)).select("id", "git_type", "size")


@query("fetch_ack", sql(f"SELECT arg_max(id, ord) AS id FROM ({HAVES}) WHERE id IN (SELECT id FROM store)", "store"))
def fetch_ack(spark, d):
    return fetch.last_common(haves(spark, d), fx.store(spark, d))


DEPTHS = ", w AS ({heads}), c(id, depth) AS (SELECT DISTINCT id, 1 FROM w WHERE id IN (SELECT id FROM store) UNION SELECT e.dst, c.depth + 1 FROM c JOIN history e ON e.src = c.id AND e.kind = 'parent' WHERE c.depth < {n}), s AS (SELECT id, min(depth) AS depth FROM c GROUP BY id)"


@query("shallow_commits", sql(DEPTHS.format(heads=HEADS, n=3) + " SELECT id, CAST(depth AS BIGINT) AS depth, depth = 3 AND EXISTS (SELECT 1 FROM history e WHERE e.src = s.id AND e.kind = 'parent') AS boundary FROM s", "store", "history", "refs", recursive=True))
def shallow_commits(spark, d):
    return fetch.shallow_commits(fx.store(spark, d), fx.history(spark, d), heads(spark, d), 3).withColumn("depth", F.col("depth").cast("long"))


@query("shallow_boundary", sql(DEPTHS.format(heads=HEADS, n=2) + " SELECT id FROM s WHERE depth = 2 AND EXISTS (SELECT 1 FROM history e WHERE e.src = s.id AND e.kind = 'parent')", "store", "history", "refs", recursive=True))
def shallow_boundary(spark, d):
    return fetch.shallow_commits(fx.store(spark, d), fx.history(spark, d), heads(spark, d), 2).filter("boundary").select("id")


@query("shallow_pack", sql(DEPTHS.format(heads=HEADS, n=2) + " SELECT id, git_type, size FROM store WHERE id IN (SELECT id FROM s UNION SELECT e.dst FROM s JOIN history e ON e.src = s.id AND e.kind = 'tree')", "store", "history", "refs", recursive=True))
def shallow_pack(spark, d):
    return fetch.shallow_pack(fx.store(spark, d), fx.history(spark, d), heads(spark, d), 2).select("id", "git_type", "size")


OLD = "SELECT 'm:' || conv_id || ':' || (max(turn) - 1) AS id FROM turns WHERE conv_id % 2 = 0 GROUP BY conv_id HAVING max(turn) > 0"


@query("deepen_delta", sql(DEPTHS.format(heads=HEADS, n=4) + f""", old AS ({OLD}), held AS (SELECT id FROM old UNION SELECT e.dst FROM old JOIN history e ON e.src = old.id AND e.kind = 'tree'),
    sent AS (SELECT id FROM s WHERE id NOT IN (SELECT id FROM held) UNION SELECT e.dst FROM s JOIN history e ON e.src = s.id AND e.kind = 'tree' WHERE s.id NOT IN (SELECT id FROM held) AND e.dst NOT IN (SELECT id FROM held))
    SELECT 'object' AS what, id FROM store WHERE id IN (SELECT id FROM sent)
    UNION ALL SELECT 'shallow', id FROM s WHERE depth = 4 AND EXISTS (SELECT 1 FROM history e WHERE e.src = s.id AND e.kind = 'parent')
    UNION ALL SELECT 'unshallow', s.id FROM s JOIN old ON s.id = old.id WHERE depth < 4""", "store", "history", "refs", recursive=True))
def deepen_delta(spark, d):
    t = fx.turns(spark, d).filter("conv_id % 2 = 0").groupBy("conv_id").agg(F.max("turn").alias("turn")).filter("turn > 0")
    old = t.select(F.concat_ws(":", F.lit("m"), "conv_id", F.col("turn") - 1).alias("id"))
    sent, shallow, passed = fetch.deepen(fx.store(spark, d), fx.history(spark, d), heads(spark, d), old, 4)
    tag = lambda name, df: df.select(F.lit(name).alias("what"), "id")
    return tag("object", sent).union(tag("shallow", shallow)).union(tag("unshallow", passed))


@query("boundary_held", sql(f", old AS ({OLD}) SELECT id FROM old UNION SELECT e.dst FROM old JOIN history e ON e.src = old.id AND e.kind = 'tree'", "history"))
def boundary_held(spark, d):
    t = fx.turns(spark, d).filter("conv_id % 2 = 0").groupBy("conv_id").agg(F.max("turn").alias("turn")).filter("turn > 0")
    return graph.held_by_boundary(fx.history(spark, d), t.select(F.concat_ws(":", F.lit("m"), "conv_id", F.col("turn") - 1).alias("id")))


@query("ref_advertisement", sql("SELECT name, target FROM refs WHERE target IN (SELECT id FROM store)", "refs", "store"))
def ref_advertisement(spark, d):
    return fetch.advertisement(fx.refs(spark, d), fx.store(spark, d))[0].select("name", "target")


# garbage collection

ROOTS = """, live AS (SELECT l.* FROM leases l, now WHERE l.expires_at_ms > now.now_ms),
roots AS (SELECT target AS id FROM refs WHERE NOT starts_with(name, 'refs/workspaces/')
  UNION ALL SELECT r.target FROM refs r JOIN live ON regexp_extract(r.name, '^refs/workspaces/([^/]+)/', 1) = live.id{more}),
reach(id) AS (SELECT id FROM roots UNION SELECT e.dst FROM reach JOIN history e ON e.src = reach.id),
keep(id) AS (SELECT id FROM reach UNION SELECT b.base FROM keep JOIN bases b ON b.id = keep.id WHERE b.base IS NOT NULL),
garbage AS (SELECT s.*, greatest(now.now_ms // 1000 - s.mtime_s, 0) >= 86400 AS swept FROM store s, now WHERE s.loose AND s.id NOT IN (SELECT id FROM keep))"""
STATS = " SELECT (SELECT count(DISTINCT id) FROM store) AS scanned, (SELECT count(*) FROM reach) AS reachable, count(*) FILTER (WHERE swept) AS reclaimed, CAST(coalesce(sum(size) FILTER (WHERE swept), 0) AS BIGINT) AS bytes_freed, count(*) FILTER (WHERE NOT swept) AS skipped_grace FROM garbage"
GC = ("store", "history", "refs", "bases", "leases", "now")
PREPARED = " UNION ALL SELECT id FROM turns WHERE conv_id % 10 = 5 AND turn = 1"


def collect(spark, d, prepared=None):
    return gc.mark_sweep(fx.store(spark, d), fx.history(spark, d), fx.refs(spark, d), fx.leases(spark, d), fx.now_ms(spark, d), fx.GRACE_S, fx.bases(spark, d), prepared)


def staged(spark, d):
    return fx.turns(spark, d).filter("conv_id % 10 = 5 and turn = 1").select(F.col("id").alias("staged_target"))


@query("gc_mark_sweep", sql(ROOTS.format(more="") + STATS, *GC, recursive=True))
def gc_mark_sweep(spark, d):
    return collect(spark, d)[1]


@query("gc_garbage_ids", sql(ROOTS.format(more="") + " SELECT id, swept FROM garbage", *GC, recursive=True))
def gc_garbage_ids(spark, d):
    return collect(spark, d)[0].select("id", "swept")


@query("gc_cluster_prepared_roots", sql(ROOTS.format(more=PREPARED) + STATS, *GC, recursive=True))
def gc_cluster_prepared_roots(spark, d):
    return collect(spark, d, staged(spark, d))[1]


@query("gc_stats_rollup", "SELECT CAST(sum(n) FILTER (WHERE ok) AS BIGINT) AS scanned, CAST(sum(r) FILTER (WHERE ok) AS BIGINT) AS reclaimed, CAST(sum(b) FILTER (WHERE ok) AS BIGINT) AS bytes_freed, count(*) FILTER (WHERE ok) AS nodes_ok, count(*) FILTER (WHERE NOT ok) AS nodes_failed FROM (SELECT l_suppkey % 10 <> 3 AS ok, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, CAST(sum(l_quantity) AS BIGINT) AS b FROM lineitem GROUP BY l_suppkey)")
def gc_stats_rollup(spark, d):
    status = F.when(F.col("l_suppkey") % 10 != 3, "ok").otherwise("error")
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), status.alias("status")).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("l_returnflag") == "R").alias("reclaimed"), F.sum("l_quantity").cast("long").alias("bytes_freed"))
    return gc.rollup(per.withColumn("reachable", F.lit(0)).withColumn("skipped_grace", F.lit(0))).select("scanned", "reclaimed", "bytes_freed", "nodes_ok", "nodes_failed")


USAGE = """, reach(tenant, id) AS (SELECT coalesce(nullif(regexp_extract(name, '^refs/tenants/([^/]+)/', 1), ''), 'root'), target FROM refs WHERE NOT starts_with(name, 'refs/workspaces/')
  UNION SELECT r.tenant, e.dst FROM reach r JOIN history e ON e.src = r.id),
keep(tenant, id) AS (SELECT tenant, id FROM reach UNION SELECT k.tenant, b.base FROM keep k JOIN bases b ON b.id = k.id WHERE b.base IS NOT NULL),
usage AS (SELECT tenant, count(*) AS objects, CAST(sum(CASE WHEN loose THEN size ELSE 0 END) AS BIGINT) AS bytes FROM {which} JOIN store USING (id) GROUP BY tenant)"""
PLACES = ("store", "history", "refs", "bases")


def usage(spark, d, close):
    return gc.tenant_usage(fx.store(spark, d), fx.history(spark, d), fx.refs(spark, d), fx.bases(spark, d), close)


@query("tenant_usage", sql(USAGE.format(which="keep") + " SELECT tenant, objects, bytes FROM usage", *PLACES, recursive=True))
def tenant_usage(spark, d):
    return usage(spark, d, True)


@query("tenant_usage_cluster", sql(USAGE.format(which="reach") + " SELECT tenant, objects, bytes FROM usage", *PLACES, recursive=True))
def tenant_usage_cluster(spark, d):
    return usage(spark, d, False)


@query("quota_denials", sql(USAGE.format(which="keep") + " SELECT event_id, t.tenant, t.tenant <> 'root' AND (coalesce(u.objects, 0) >= 200 OR coalesce(u.bytes, 0) >= 10000) AS denied FROM (SELECT event_id, CASE WHEN user_id % 5 = 4 THEN 'root' ELSE 't' || (user_id % 5) END AS tenant FROM events) t LEFT JOIN usage u ON u.tenant = t.tenant", *PLACES, recursive=True))
def quota_denials(spark, d):
    tenant = F.when(F.col("user_id") % 5 == 4, "").otherwise(F.concat(F.lit("t"), F.col("user_id") % 5))
    r = table(spark, d, "events").select("event_id", tenant.alias("tenant"))
    return gc.quota_denials(r, usage(spark, d, True), 10000, 200).withColumn("tenant", names.normal_tenant(F.col("tenant")))


# storage

@query("quorum_writes", "SELECT doc_id AS id, sum(a) AS acks, sum(a) >= 3 AS durable FROM (SELECT doc_id, CAST((doc_id * 7 + n * 13) % 5 < 3 AS BIGINT) AS a FROM documents, range(5) r(n)) GROUP BY doc_id")
def quorum_writes(spark, d):
    nodes = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("node")
    acks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), nodes).withColumn("ack", (F.col("id") * 7 + F.col("node") * 13) % 5 < 3)
    return storage.quorum(acks, 4)


@query("lfs_batch", "SELECT l.doc_id AS oid, coalesce(d.n_chars, 0) AS size, CASE WHEN d.doc_id IS NULL THEN '404' ELSE 'download' END AS action FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT doc_id, max(n_chars) AS n_chars FROM documents WHERE doc_id % 2 = 0 GROUP BY doc_id) d USING (doc_id)")
def lfs_batch(spark, d):
    asked = table(spark, d, "labels").select(F.col("doc_id").alias("oid"), F.lit(0).cast("long").alias("size")).distinct()
    held = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("oid"), F.col("n_chars").alias("size"))
    return storage.lfs_batch(asked, held)


@query("tier_candidates", "SELECT doc_id AS pack FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tier_candidates(spark, d):
    return storage.tier_candidates(table(spark, d, "documents").select(F.col("doc_id").alias("pack")), table(spark, d, "labels").select(F.col("doc_id").alias("pack")))


@query("recover_plan", "SELECT d.doc_id AS pack, CASE WHEN d.doc_id % 11 <> 0 THEN 'fetch' ELSE 'lost' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality = 1 AND (l.toxic = 0 OR d.doc_id % 2 = 0), FALSE)")
def recover_plan(spark, d):
    remote = table(spark, d, "documents").select(F.col("doc_id").alias("pack"), (F.col("doc_id") % 11 != 0).alias("has_body"))
    local = table(spark, d, "labels").select(F.col("doc_id").alias("pack"), (F.col("quality") == 1).alias("has_index"), (F.col("toxic") == 0).alias("has_body"), (F.col("doc_id") % 2 == 0).alias("has_marker"))
    got, lost = storage.recovery_plan(remote, local)
    return got.withColumn("action", F.lit("fetch")).union(lost.withColumn("action", F.lit("lost")))


@query("tier_stats", "SELECT count(*) AS packs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tier_stats(spark, d):
    packs = table(spark, d, "documents").select(F.col("doc_id").alias("pack"), F.col("n_chars").alias("bytes"))
    return storage.tier_stats(storage.tier_candidates(packs, table(spark, d, "labels").select(F.col("doc_id").alias("pack"))))


@query("member_diff", "SELECT node, change FROM (SELECT DISTINCT s_suppkey AS node, 'added' AS change FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0 UNION ALL SELECT DISTINCT s_suppkey, 'removed' FROM supplier WHERE s_nationkey % 2 <> 0 AND s_suppkey % 3 = 0)")
def member_diff(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "node")
    return storage.member_diff(s.filter("node % 3 = 0"), s.filter("s_nationkey % 2 = 0"))


@query("import_refs", sql("SELECT p.url AS name, o.sha1, o.id FROM pages p JOIN documents d ON d.doc_id = p.page_id AND d.text IS NOT NULL JOIN objects o ON o.id = sha256(d.text) WHERE p.page_id % 4 <> 0", "objects"))
def import_refs(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", hashing.git_id(F.lit("blob"), F.col("text")).alias("sha1"))
    refs = table(spark, d, "pages").filter("page_id % 4 <> 0").join(docs, F.col("page_id") == F.col("doc_id")).select(F.col("url").alias("name"), "sha1")
    return storage.imported_refs(refs, fx.objects(spark, d).select("sha1", "id"))


@query("export_branches", sql("SELECT substr(name, 12) AS branch, target FROM refs WHERE name IN ('refs/heads/c0', 'refs/heads/c4', 'refs/heads/c8')", "refs"))
def export_branches(spark, d):
    return storage.export_branches(fx.refs(spark, d), ["c0", "c4", "c8", "c2"]).select("branch", "target")


# packs

NAME_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(source) + 1), lambda i: CAST(ascii(substr(source, i, 1)) AS BIGINT))), lambda h, c: ((h >> 2) + (c << 24)) & 4294967295)"
RANKED = f"SELECT doc_id AS id, l AS git_type, h AS name_hash, n_chars AS size, row_number() OVER (PARTITION BY l ORDER BY h, n_chars DESC, doc_id) AS rank FROM (SELECT doc_id, coalesce(lang, '') AS l, n_chars, {NAME_HASH} AS h FROM (SELECT * REPLACE (coalesce(source, '') AS source) FROM documents))"


def ranked(spark, d):
    docs = table(spark, d, "documents").withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    return pack.numbered(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("git_type"), hashing.name_hash(F.col("source")).alias("name_hash"), F.col("n_chars").alias("size")))


@query("pack_order", RANKED)
def pack_order(spark, d):
    return ranked(spark, d)


@query("delta_candidates", f"WITH r AS ({RANKED}) SELECT a.id, count(*) AS n_candidates, max(a.rank - b.rank) AS furthest FROM r a JOIN r b ON a.git_type = b.git_type AND b.rank BETWEEN a.rank - 250 AND a.rank - 1 GROUP BY a.id")
def delta_candidates(spark, d):
    return pack.candidates(ranked(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("distance").alias("furthest"))


@query("pack_fanout", sql("SELECT b.bucket, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY b.bucket) AS BIGINT) AS running FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range(256)) b LEFT JOIN (SELECT CAST('0x' || substr(sha1, 1, 2) AS INTEGER) AS bucket, count(*) AS n FROM objects GROUP BY 1) USING (bucket)", "objects"))
def pack_fanout(spark, d):
    return pack.fanout(fx.objects(spark, d))


@query("repack_check", sql("SELECT id FROM objects WHERE size % 5 = 0", "objects"))
def repack_check(spark, d):
    o = fx.objects(spark, d)
    return pack.repack_check(o, o.filter("size % 5 <> 0"))


@query("delta_selection")
def delta_selection(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    o = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("git_type"), hashing.name_hash(F.col("source")).alias("name_hash"), F.col("n_chars").alias("size"), F.col("text").cast("binary").alias("content"))
    return pack.select_deltas(pack.numbered(o))


@query("lru_residency", "SELECT key, row_number() OVER w <= 60 AND sum(bytes) OVER w <= 200000 AS kept FROM (SELECT user_id AS key, max(event_id) AS last_used, CAST(floor(sum(value) * 10) AS BIGINT) AS bytes FROM events GROUP BY user_id) WINDOW w AS (ORDER BY last_used DESC, key)")
def lru_residency(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("last_used"), F.floor(F.sum("value") * 10).cast("long").alias("bytes"))
    return pack.resident(e, 60, 200000).select("key", "kept")


@query("tree_entries", "SELECT r_regionkey AS id, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS ord, CASE WHEN n_nationkey % 5 = 0 THEN '160000' ELSE '100644' END AS mode, n_name AS name, sha1(n_name) AS sha1 FROM region JOIN nation ON n_regionkey = r_regionkey")
def tree_entries(spark, d):
    n = table(spark, d, "nation")
    mode = F.when(F.col("n_nationkey") % 5 == 0, "160000").otherwise("100644")
    entry = F.concat(mode.cast("binary"), F.lit(" ").cast("binary"), F.col("n_name").cast("binary"), F.lit(b"\0"), F.unhex(F.sha1(F.col("n_name").cast("binary"))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.hex(entry).alias("e")))), lambda x: x["e"])
    trees = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.unhex(F.concat_ws("", rows)).alias("content"))
    return content.tree_entries(trees).withColumn("name", F.decode("name", "UTF-8"))


@query("commit_headers", "SELECT conv_id, turn, sha1(text) AS tree, CASE WHEN turn > 0 THEN sha1('p' || (turn - 1)) ELSE '' END AS parents FROM conversations WHERE text IS NOT NULL")
def commit_headers(spark, d):
    c = table(spark, d, "conversations").filter("text is not null")
    sha = lambda x: F.sha1(x.cast("binary"))
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("parent "), sha(F.concat(F.lit("p"), F.col("turn") - 1)), F.lit("\n"))).otherwise("")
    raw = F.concat(F.lit("tree "), sha(F.col("text")), F.lit("\n"), parent, F.lit("author a <a@b> 0 +0000\n\nparent 00\n")).cast("binary")
    return c.select("conv_id", "turn", content.commit_tree(raw).alias("tree"), F.concat_ws(",", content.commit_parents(raw)).alias("parents"))


@query("delta_round_trip", "SELECT doc_id, sha256(text) AS oid, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL")
def delta_round_trip(spark, d):
    small_batches(spark)
    t = F.col("text").cast("binary")
    base = F.encode(F.concat(F.substring("text", 20, 400), F.lit("base")), "UTF-8")
    packed = table(spark, d, "documents").filter("text is not null").select("doc_id", base.alias("base"), delta.encode_udf()(base, t).alias("delta"))
    back = packed.select("doc_id", delta.apply_udf()(F.col("base"), F.col("delta")).alias("raw"))
    return back.select("doc_id", F.sha2("raw", 256).alias("oid"), F.octet_length("raw").cast("long").alias("size"))
