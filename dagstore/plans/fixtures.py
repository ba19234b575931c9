"""The data model's tables built from the driver's tables, in Spark and (``SQL``) for the oracle.

objects are documents; the wide graph is region > nation > customer > order > part, supplier; commit chains are
conversations, whose blobs are their texts; leases, logs, samples and requests are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagstore.functions.hashing import git_id, millis, micros, object_id
from dagstore.plans.registry import table

TTL_MS = 3 * 86_400_000
GRACE_S = 86_400
BORN_S = 1_700_000_000

SQL = {
    "objects": """SELECT sha256(text) AS id, min(sha1('blob ' || octet_length(encode(text)) || chr(0) || text)) AS sha1, 3 AS git_type,
        octet_length(encode(text)) AS size, min(1700000000 + doc_id * 60) AS mtime_s, bool_or(doc_id % 3 <> 0) AS loose
        FROM documents WHERE text IS NOT NULL GROUP BY text""",
    "wide": """SELECT DISTINCT src, dst, 'tree' AS kind FROM (
        SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
        UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
        UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
        UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
        UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem)""",
    "turns": "SELECT conv_id, turn, text, 'm:' || conv_id || ':' || turn AS id, 'b:' || sha256(text) AS blob FROM conversations WHERE text IS NOT NULL",
    "history": """SELECT a.id AS src, b.id AS dst, 'parent' AS kind FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
        UNION ALL SELECT id, blob, 'tree' FROM turns""",
    "store": """SELECT id, 1 AS git_type, CAST(100 + turn AS BIGINT) AS size, 1700000000 + conv_id * 3600 AS mtime_s, (conv_id + turn) % 5 <> 0 AS loose FROM turns
        UNION ALL SELECT blob, 3, min(octet_length(encode(text))), min(1700000000 + conv_id * 3600), bool_or(turn % 4 <> 3) FROM turns GROUP BY blob
        UNION ALL SELECT 'd:' || doc_id, 3, octet_length(encode(text)), 1706500000 + doc_id * 100, doc_id % 4 <> 0 FROM documents WHERE text IS NOT NULL""",
    "bases": "SELECT id, CASE WHEN turn % 3 <> 0 THEN 'm:' || conv_id || ':' || (turn - 1) END AS base FROM turns",
    "refs": """SELECT CASE WHEN conv_id % 4 = 0 THEN 'refs/heads/c' || conv_id ELSE 'refs/tenants/t' || (conv_id % 3) || '/heads/c' || conv_id END AS name,
        'm:' || conv_id || ':' || max(turn) AS target, max(turn) + 1 AS version FROM turns WHERE conv_id % 2 = 0 GROUP BY conv_id
        UNION ALL SELECT DISTINCT 'refs/workspaces/' || lpad(lower(to_hex(user_id)), 32, '0') || '/heads/main', 'm:' || ((user_id * 7) % 300) || ':0', 1 FROM events""",
    "now": "SELECT max(epoch_us(ts)) // 1000 AS now_ms FROM events",
    "lease_log": """SELECT event_id AS \"offset\", lpad(lower(to_hex(user_id)), 32, '0') AS id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 't' || (user_id % 3) END AS tenant_id,
        CASE event_type WHEN 'signup' THEN 'put' WHEN 'click' THEN 'renew' ELSE 'tombstone' END AS kind, epoch_us(ts) // 1000 AS at_ms
        FROM events WHERE event_type IN ('signup', 'click', 'error')""",
    "births": """SELECT *, max(CASE WHEN kind IN ('put', 'tombstone') THEN \"offset\" END) OVER (PARTITION BY id ORDER BY \"offset\") AS birth FROM lease_log""",
    "leases": """SELECT l.id, any_value(l.tenant_id) AS tenant_id, count(*) AS generation, arg_min(l.at_ms, l.\"offset\") AS created_at_ms, arg_max(l.at_ms, l.\"offset\") + 259200000 AS expires_at_ms
        FROM births l JOIN (SELECT id, max(birth) AS last FROM births GROUP BY id) x ON l.id = x.id AND l.birth = x.last
        JOIN lease_log p ON p.id = l.id AND p.\"offset\" = x.last AND p.kind = 'put' GROUP BY l.id""",
    "ref_log": """SELECT 'refs/heads/u' || user_id AS name, event_id AS \"offset\",
        CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'prepare' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'commit' ELSE 'abort' END END AS kind,
        'x' || (event_id // 64 % 3) AS txn, 't' || event_id AS target,
        CASE WHEN event_type = 'signup' THEN NULL ELSE 't' || max(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS expected
        FROM events""",
    "txn_log": """SELECT event_id // 8 AS txn, event_id AS \"offset\", user_id, ts,
        CASE WHEN event_id % 8 = 0 THEN 'Begin' WHEN event_id % 8 = 7 THEN CASE WHEN event_type = 'view' THEN 'End' ELSE 'Noop' END
        WHEN event_type = 'purchase' THEN 'Commit' WHEN event_type = 'error' THEN 'Abort' ELSE 'Noop' END AS kind FROM events""",
    "samples": """SELECT event_id AS \"offset\", event_type AS name, user_id % 4 AS instance, epoch_us(ts) AS ts_us, value AS gauge,
        CAST((row_number() OVER w - 1) % 50 + 1 AS DOUBLE) AS counter,
        CAST((row_number() OVER w - 1) % 50 + 1 AS DOUBLE) * 3 AS total
        FROM events WINDOW w AS (PARTITION BY event_type, user_id % 4 ORDER BY event_id)""",
}

_NEEDS = {"history": ["turns"], "store": ["turns"], "bases": ["turns"], "refs": ["turns"], "births": ["lease_log"], "leases": ["births"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body over the named tables and those they need."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    glue = "" if not body.lstrip().startswith(",") else body.lstrip()[1:]
    rest = f",\n{glue}" if glue else f"\n{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{rest}"


def objects(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "documents").filter("text is not null")
    per = text.groupBy("text").agg(F.min(F.lit(BORN_S) + F.col("doc_id") * 60).alias("mtime_s"), F.bool_or(F.col("doc_id") % 3 != 0).alias("loose"))
    return per.select(object_id(F.col("text")).alias("id"), git_id(F.lit("blob"), F.col("text")).alias("sha1"), F.lit(3).alias("git_type"), F.octet_length("text").cast("long").alias("size"), "mtime_s", "loose")


def wide(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n, a, ac, b, bc: table(spark, d, n).select(key(a, ac).alias("src"), key(b, bc).alias("dst"))
    out = t("nation", "r:", "n_regionkey", "n:", "n_nationkey").union(t("customer", "n:", "c_nationkey", "c:", "c_custkey")).union(t("orders", "c:", "o_custkey", "o:", "o_orderkey"))
    out = out.union(t("lineitem", "o:", "l_orderkey", "p:", "l_partkey")).union(t("lineitem", "o:", "l_orderkey", "s:", "l_suppkey"))
    return out.distinct().withColumn("kind", F.lit("tree"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", "text", F.concat_ws(":", F.lit("m"), "conv_id", "turn").alias("id"), F.concat(F.lit("b:"), object_id(F.col("text"))).alias("blob"))


def history(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("conv_id", "turn", "id", "blob")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("id").alias("dst"))
    parents = t.join(before, ["conv_id", "turn"]).select(F.col("id").alias("src"), "dst", F.lit("parent").alias("kind"))
    return parents.union(t.select("id", "blob", F.lit("tree")))


def store(spark: SparkSession, d: str) -> DataFrame:
    t, docs = turns(spark, d), table(spark, d, "documents")
    born = F.lit(BORN_S) + F.col("conv_id") * 3600
    commits = t.select("id", F.lit(1).alias("git_type"), (F.lit(100) + F.col("turn")).cast("long").alias("size"), born.alias("mtime_s"), ((F.col("conv_id") + F.col("turn")) % 5 != 0).alias("loose"))
    blobs = t.groupBy("blob").agg(F.min(F.octet_length("text")).cast("long").alias("size"), F.min(born).alias("mtime_s"), F.bool_or(F.col("turn") % 4 != 3).alias("loose"))
    blobs = blobs.select(F.col("blob").alias("id"), F.lit(3).alias("git_type"), "size", "mtime_s", "loose")
    lost = docs.filter("text is not null").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.lit(3).alias("git_type"), F.octet_length("text").cast("long").alias("size"), (F.lit(1_706_500_000) + F.col("doc_id") * 100).alias("mtime_s"), (F.col("doc_id") % 4 != 0).alias("loose"))
    return commits.unionByName(blobs).unionByName(lost)


def bases(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("id", F.when(F.col("turn") % 3 != 0, F.concat_ws(":", F.lit("m"), "conv_id", F.col("turn") - 1)).alias("base"))


def workspace_id():
    return F.lpad(F.lower(F.hex(F.col("user_id"))), 32, "0")


def refs(spark: SparkSession, d: str) -> DataFrame:
    heads = turns(spark, d).filter("conv_id % 2 = 0").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    name = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("refs/heads/c"), F.col("conv_id"))).otherwise(F.concat(F.lit("refs/tenants/t"), F.col("conv_id") % 3, F.lit("/heads/c"), F.col("conv_id")))
    durable = heads.select(name.alias("name"), F.concat_ws(":", F.lit("m"), "conv_id", "turn").alias("target"), (F.col("turn") + 1).alias("version"))
    users = table(spark, d, "events").select("user_id").distinct()
    ws = users.select(F.concat(F.lit("refs/workspaces/"), workspace_id(), F.lit("/heads/main")), F.concat(F.lit("m:"), (F.col("user_id") * 7) % 300, F.lit(":0")), F.lit(1).cast("long"))
    return durable.union(ws)


def now_ms(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").agg(F.max(millis(F.col("ts")))).first()[0]


def lease_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "click", "renew").otherwise("tombstone")
    tenant = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("user_id") % 3))
    e = table(spark, d, "events").filter(F.col("event_type").isin("signup", "click", "error"))
    return e.select(F.col("event_id").alias("offset"), workspace_id().alias("id"), tenant.alias("tenant_id"), kind.alias("kind"), millis(F.col("ts")).alias("at_ms"))


def leases(spark: SparkSession, d: str) -> DataFrame:
    from dagstore.operators.leases import lifecycle

    log = lease_log(spark, d)
    return lifecycle(log, TTL_MS).join(log.select("id", "tenant_id").distinct(), "id")


def ref_log(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    t = F.col("event_type")
    kind = F.when(t.isin("signup", "purchase"), "put").when(t == "error", "delete").when(t == "click", "prepare").when(F.col("event_id") % 2 == 0, "commit").otherwise("abort")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(t.isin("signup", "purchase"), F.col("event_id"))).over(w)
    return e.select(
        F.concat(F.lit("refs/heads/u"), F.col("user_id")).alias("name"),
        F.col("event_id").alias("offset"),
        kind.alias("kind"),
        F.concat(F.lit("x"), F.floor(F.col("event_id") / 64) % 3).alias("txn"),
        F.concat(F.lit("t"), F.col("event_id")).alias("target"),
        F.when(t != "signup", F.concat(F.lit("t"), last)).alias("expected"),
    )


def txn_log(spark: SparkSession, d: str) -> DataFrame:
    e, k, t = table(spark, d, "events"), F.col("event_id") % 8, F.col("event_type")
    kind = F.when(k == 0, "Begin").when((k == 7) & (t == "view"), "End").when(k == 7, "Noop").when(t == "purchase", "Commit").when(t == "error", "Abort").otherwise("Noop")
    return e.select(F.floor(F.col("event_id") / 8).alias("txn"), F.col("event_id").alias("offset"), "user_id", "ts", kind.alias("kind"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    n = (F.row_number().over(Window.partitionBy("event_type", F.col("user_id") % 4).orderBy("event_id")) - 1) % 50 + 1
    return e.select(F.col("event_id").alias("offset"), F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("instance"), micros(F.col("ts")).alias("ts_us"), F.col("value").alias("gauge"), n.cast("double").alias("counter")).withColumn("total", F.col("counter") * 3)
