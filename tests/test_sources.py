"""Formats byte by byte: frames torn and corrupt, packs malformed, exports, metric texts, the cold tier, alert rules, addresses, shards."""

import hashlib
import random
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dagstore.functions import delta
from dagstore.operators import alerts, graph, policy
from dagstore.sources import frames, packs, upstream


def test_frames_torn_and_corrupt():
    payloads = [b"", b"one", b"two" * 100]
    data = b"".join(map(frames.encode_frame, payloads))
    assert frames.read_frames(data) == (payloads, len(data))
    for cut in range(len(data)):  # wherever a write stops, the whole frames before it count
        found, end = frames.read_frames(data[:cut])
        assert found == payloads[: len(found)] and end <= cut and data[:end] == b"".join(map(frames.encode_frame, found))
    for at in (8 + 4, len(data) - 1):
        with pytest.raises(frames.CorruptLog):
            frames.read_frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    assert struct.unpack("<II", frames.encode_frame(b"abc")[:8]) == (3, zlib.crc32(b"abc"))


def test_log_files(spark, tmp_path):
    whole = b"".join(frames.encode_frame(b"%d" % k) for k in range(5))
    (tmp_path / "a.log").write_bytes(whole + frames.encode_frame(b"torn")[:-1])
    rows = frames.decode_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.ordinal, bytes(r.payload)) for r in rows] == [(k, b"%d" % k) for k in range(5)] and rows[-1].end == len(whole)
    (tmp_path / "b.log").write_bytes(whole[:-1] + b"?")
    with pytest.raises(Exception, match="CRC differs"):
        frames.decode_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()


def test_log_order_and_replacement(spark, tmp_path):
    path = str(tmp_path / "log")
    assert frames.read_log(spark, path).count() == 0
    for a in (0, 40):
        frames.append_log(spark.range(a, a + 40).select(F.col("id").cast("string").cast("binary").alias("payload"), "id"), path, "id")
    order = {s: k for k, s in enumerate(frames._manifest(path))}
    rows = sorted(frames.read_log(spark, path).collect(), key=lambda r: (order[r.segment], r.ordinal))
    assert [int(bytes(r.payload)) for r in rows] == list(range(80))
    frames.write_checkpoint(spark.createDataFrame([(b"all",)], "payload binary"), path)
    assert [bytes(r.payload) for r in frames.read_log(spark, path).collect()] == [b"all"]
    assert len(list((tmp_path / "log").glob("*.frames"))) == 1


def objects(seed=1, n=30):
    r = random.Random(seed)
    base = bytes(r.randrange(97, 123) for _ in range(400))
    out = []
    for _ in range(n):
        cut = r.randrange(400)
        out.append((r.choice([1, 2, 3, 4]), base[:cut] + bytes(r.randrange(97, 123) for _ in range(r.randrange(30))) + base[cut:]))
    return [*out, (3, b""), (3, b"x" * 70000)]


def test_pack_round_trip_with_deltas():
    objs = objects()
    bases, data = [], []
    for k, (_, c) in enumerate(objs):
        same = [j for j in range(k) if objs[j][0] == objs[k][0]]
        bases.append(same[-1] if same and k % 3 else None)
        data.append(delta.encode_delta(objs[bases[-1]][1], c) if bases[-1] is not None else b"")
    pack, offsets = packs.write_pack(objs, bases, data)
    found = packs.resolve(packs.entries(pack))
    assert [(t, c) for _, t, _, c in found] == objs and [o for o, _, _, _ in found] == offsets
    assert any(e.kind == packs.BACK for e in packs.entries(pack))
    names = [n for _, _, n, _ in found]
    assert names == [hashlib.sha1(packs.KINDS[t] + b" %d\0" % len(c) + c).digest() for t, c in objs]
    index = packs.read_index(packs.write_index(pack, names, offsets))
    assert sorted(index) == index and {(n, o) for n, o, _ in index} == set(zip(names, offsets, strict=True))
    ends = {e.offset: e.end for e in packs.entries(pack)}
    assert all(zlib.crc32(pack[o : ends[o]]) == crc for _, o, crc in index)
    rows = [(hashlib.sha256(c).digest(), n, t, o) for (t, c), n, o in zip(objs, names, offsets, strict=True)]
    assert packs.read_sidecar(packs.write_sidecar(rows)) == rows and packs.ROW.size == 61


def test_thin_pack_needs_its_base():
    base, content = b"base " * 40, b"base " * 40 + b"more"
    name = packs.sha1_of(3, base)
    thin, _ = packs.write_pack([(3, b"")], [name], [delta.encode_delta(base, content)])
    assert packs.resolve(packs.entries(thin), {name: (3, base)}.get)[0][3] == content
    with pytest.raises(packs.CorruptPack):
        packs.resolve(packs.entries(thin))
    assert packs.missing_bases(packs.entries(thin)) == {name}


def signed(body):
    return body + hashlib.sha1(body).digest()


def test_malformed_packs():
    head = lambda n: b"PACK" + struct.pack(">II", 2, n)
    bomb = packs.write_header(3, 10) + zlib.compress(b"0" * 10_000_000)
    huge = packs.write_header(3, 1 << 40) + zlib.compress(b"x")
    far = packs.write_header(6, 3) + delta.write_offset(5000) + zlib.compress(b"abc")
    for body in (b"", b"PACK", signed(b"PUCK" + head(0)[4:]), signed(b"PACK" + struct.pack(">II", 3, 0)), head(0) + bytes(20), signed(head(1)), signed(head(1) + bomb), signed(head(1) + huge), signed(head(0) + b"rest"), signed(head(1) + packs.write_header(5, 0)), signed(head(1) + packs.write_header(7, 1) + b"short"), signed(head(1) + packs.write_header(3, 5) + zlib.compress(b"abc"))):
        with pytest.raises(packs.CorruptPack):
            packs.entries(body)
    with pytest.raises(packs.CorruptPack):
        packs.resolve(packs.entries(signed(head(1) + far)))
    with pytest.raises(packs.CorruptPack):
        packs.read_sidecar(struct.pack("<I", 3) + bytes(61))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes(data):
    """Arbitrary bytes are read or refused, never anything else."""
    for fn in (lambda: packs.entries(signed(b"PACK" + struct.pack(">II", 2, 2) + data)), lambda: packs.read_index(data), lambda: packs.read_sidecar(data), lambda: delta.apply_delta(b"base", data), lambda: list(upstream.parse_export(data))):
        try:
            fn()
        except ValueError:
            pass


@given(st.integers(0, 2**50))
def test_varints(n):
    assert delta.read_size(delta.write_size(n), 0) == (n, len(delta.write_size(n)))
    assert delta.read_offset(delta.write_offset(n), 0) == (n, len(delta.write_offset(n)))


def test_inflate():
    z = zlib.compress(b"abc" * 1000)
    assert delta.inflate(z, 3000) == b"abc" * 1000 and delta.inflate(zlib.compress(b""), 0) == b""
    for data, size in ((z, 2999), (z, 3001), (z[:-5], 3000)):
        with pytest.raises(ValueError):
            delta.inflate(data, size)


def test_exports(spark):
    sha = "0123456789abcdef" * 2 + "01234567"
    good = f"{sha} blob 5\nab\ncd\n".encode() + f"{sha} tag 0\n\n".encode()
    assert list(upstream.parse_export(good)) == [(sha, 3, b"ab\ncd"), (sha, 4, b"")]
    for bad in (good[:-1], b"x", f"{sha} blub 1\na\n".encode(), f"{sha[1:]} blob 1\na\n".encode(), f"{sha} blob x\na\n".encode()):
        with pytest.raises(ValueError):
            list(upstream.parse_export(bad))
    with pytest.raises(Exception, match="bad SHA-1"):
        upstream.read_ref_lines(spark.createDataFrame([("refs/heads/x nothex",)], "value string")).collect()


def test_metric_texts(spark):
    rows = [("a_total", {"z": 'q"\\\n', "b": "1"}, 2.0), ("up", {}, 0.5)]
    lines = upstream.metric_lines(spark.createDataFrame(rows, "name string, labels map<string,string>, value double"))
    assert [r.value for r in lines.collect()] == ['a_total{b="1",z="q\\"\\\\\\n"} 2', "up 0.5"]
    back = upstream.read_metric_lines(lines.union(spark.createDataFrame([("# HELP x",), ("",)], "value string"))).collect()
    assert [(r.name, r.labels, r.value) for r in back] == rows


def test_tier(spark, tmp_path):
    tier = upstream.Tier(spark, f"file://{tmp_path}/cold")
    assert tier.list() == [] and tier.head("a") is None
    tier.put("p/a.pack", b"\x00\xff12")
    tier.put("p/b.pack", b"")
    tier.put("p/b.pack", b"new")
    assert tier.list() == ["p/a.pack", "p/b.pack"] and tier.get("p/a.pack") == b"\x00\xff12" and tier.head("p/b.pack") == 3
    tier.delete("p/a.pack")
    tier.delete("p/none")
    assert [tuple(r) for r in tier.list_frame().collect()] == [("p/b.pack", 3)]


def test_blocked_addresses(spark):
    import ipaddress

    blocked = ["127.0.0.1", "10.1.2.3", "100.64.0.1", "100.127.255.255", "169.254.169.254", "172.31.0.1", "192.168.1.1", "0.0.0.0", "255.255.255.255", "224.0.0.1", "203.0.113.9", "::1", "::", "fc00::1", "fdff::", "fe80::1", "febf::1", "ff02::1", "::ffff:7f00:1", "::ffff:127.0.0.1", "0:0:0:0:0:ffff:a00:1", "::FFFF:c0a8:0101", "0:0:0:0:0:0:0:1"]
    free = ["8.8.8.8", "100.63.0.1", "100.128.0.1", "172.32.0.1", "2001:4860:4860::8888", "fec0::1", "::ffff:8.8.8.8", "::ffff:808:808", "fbff::1", "::2", "1::", "not an address", "1:2:3", "::1::2"]
    df = spark.createDataFrame([(x,) for x in blocked + free], "ip string").withColumn("b", policy.blocked_ip(F.col("ip")))
    assert {r.ip for r in df.collect() if r.b} == set(blocked)
    r = random.Random(2)
    some = [str(ipaddress.IPv6Address(r.getrandbits(128) >> r.choice([0, 64, 112]))) for _ in range(200)] + [str(ipaddress.IPv6Address((0xFC00 + r.randrange(0x400)) << 112)) for _ in range(100)]
    inside = [ipaddress.ip_network(n) for n in ("fc00::/7", "fe80::/10", "ff00::/8", "::1/128", "::/128")]
    found = spark.createDataFrame([(x,) for x in some], "ip string").withColumn("b", policy.blocked_ip(F.col("ip"))).collect()
    assert all(x.b == any(ipaddress.ip_address(x.ip) in n for n in inside) for x in found)


def test_golden_shards(spark):
    from dagstore.functions import hashing

    golden = [("refs/heads/main", "7fd6d37e3f9f177d", 1, 1, 1), ("refs/tags/v1", "48a8d1d00cb9fa33", 1, 0, 3), ("refs/tenants/acme/heads/main", "814e9bd3e3de93ed", 1, 2, 1), ("refs/workspaces/00ff/heads/main", "9d156b50b4247eec", 0, 1, 0), ("refs/notes", "40906c71b95bdbaa", 0, 2, 2)]
    df = spark.createDataFrame([(g[0],) for g in golden], "name string")
    n = F.col("name")
    found = df.select("name", hashing.fnv_hex(hashing.namespace_key(n)), *[hashing.shard_for(n, k) for k in (2, 3, 4)]).collect()
    assert [tuple(r) for r in found] == golden


def test_chains(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), ("lost", "gone")] + [(f"l{k}", f"l{k - 1}" if k else None) for k in range(80)]
    df = spark.createDataFrame(links, "id string, base string")
    found = {r.id: r.depth for r in graph.chain_depth(df).collect()}
    assert [found[k] for k in ("a", "b", "c", "x", "y", "z", "self", "lost", "l0", "l49", "l79")] == [0, 1, 2, None, None, None, None, 1, 0, 49, 50]
    ids = spark.createDataFrame([("l79",), ("z",)], "id string")
    assert {r.id for r in graph.with_delta_bases(ids, df).collect()} == {*(f"l{k}" for k in range(80)), "x", "y", "z"}


def test_long_closure_merges(spark):
    n = 75
    edges = spark.createDataFrame([(str(k), str(k + 1), "parent") for k in range(n)] + [("10", "3", "parent"), ("75", "0", "parent")], "src string, dst string, kind string")
    found = {r.id: r.depth for r in graph.closure(edges, spark.createDataFrame([("0",)], "id string")).collect()}
    assert found == {str(k): k for k in range(n + 1)}


def test_alert_rules(spark):
    """Synthetic samples, 15 s apart, that fire every rule after its time and none before."""
    rows = []

    def sample(name, labels, value, until=2400, start=0):
        rows.extend((name, labels, len(rows) + k, t * 1_000_000, float(value(t))) for k, t in enumerate(range(start, until, 15)))

    i = {"instance": "n1"}
    sample("up", i, lambda t: 0 if t >= 600 else 1)
    for m in ("git_request", "object_write", "rpc_request"):
        sample(f"{m}_duration_seconds_sum", i, lambda t: 3.0 * t)
        sample(f"{m}_duration_seconds_count", i, lambda t: 1.0 * t)
    sample("auth_requests_total", i | {"result": "forbidden"}, lambda t: 6 * t)
    sample("auth_requests_total", i | {"result": "ok"}, lambda t: 60 * t)
    sample("tenant_denied_total", i, lambda t: 2 * t)
    sample("webhook_deliveries_total", i | {"result": "failed"}, lambda t: 0.3 * t)
    sample("webhook_deliveries_total", i | {"result": "ok"}, lambda t: 0.7 * t)
    sample("sync_total", i | {"result": "failed", "op": "import"}, lambda t: t // 300)
    sample("quota_denied_total", i | {"resource": "bytes"}, lambda t: t // 100)
    sample("ref_cas_retries_total", i, lambda t: 4 * t)
    sample("ref_updates_total", i, lambda t: 2 * t)
    sample("raft_leader", i | {"shard": "0"}, lambda t: 0)
    sample("raft_leader", i | {"shard": "1"}, lambda t: 2)
    sample("raft_term", i, lambda t: t // 200)
    sample("raft_commit_index", i, lambda t: 10 * t + 2000)
    sample("raft_last_applied", i, lambda t: 10 * t)
    sample("prepared_locks", i, lambda t: 1)
    sample("txn_aborted_total", i, lambda t: 1.5 * t)
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, offset bigint, ts_us bigint, value double")
    first = {}
    series = {}
    for r in alerts.alerts(df, step=15).groupBy("rule").agg(F.min("at").alias("at"), F.collect_set("series").alias("s")).collect():
        first[r.rule], series[r.rule] = r["at"], set(r.s)
    assert set(first) == set(alerts.RULES)
    assert series["auth_failures"] == {'{"instance":"n1","result":"forbidden"}'} and series["no_leader"] == {'{"instance":"n1","shard":"0"}'}
    assert series["quota_denials"] == {'{"instance":"n1","resource":"bytes"}'} and series["webhook_failures"] == {'{"instance":"n1"}'}
    assert first["instance_down"] == 600 + 120 and first["no_leader"] == 60 and first["prepared_locks_stuck"] == 900 and first["apply_lag"] == 300
    for name, rule in alerts.RULES.items():
        assert first[name] >= rule["for"], name
    lower = spark.createDataFrame([(a, b, c, d, e / 100) for a, b, c, d, e in rows if not a.startswith(("up", "raft_leader", "sync", "quota", "prepared", "raft_term"))], df.schema)
    assert alerts.alerts(lower, {k: r for k, r in alerts.RULES.items() if r["kind"] in ("rate", "difference") and r["above"] >= 1}, 15).isEmpty()
    gap = spark.createDataFrame([("up", i, k, t * 1_000_000, 0.0) for k, t in enumerate([0, 15, 30, 600, 615])], df.schema)
    assert alerts.alerts(gap, {"d": {"kind": "gauge", "metric": "up", "is": 0, "for": 400}}, 15).isEmpty()  # stale after 300 s, so it begins anew


@pytest.mark.parametrize("name", ["pack_round_trip", "pack_index", "inflate_bounded", "thin_pack", "delta_round_trip", "content_hash"])
def test_whole_texts_come_in_small_batches(spark, sf_dir, name):
    from dagstore.plans import catalogue
    from dagstore.session import ARROW_BYTES, ARROW_ROWS

    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}
    for key in settings:
        spark.conf.unset(key)
    catalogue.QUERIES[name](spark, sf_dir)
    assert {key: int(spark.conf.get(key)) for key in settings} == settings
    rows = spark.range(5000, numPartitions=1).select("id", F.repeat(F.lit("x"), 20000).alias("text"))
    sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()]
    assert sum(sizes) == 5000 and max(sizes) * 20000 <= 2 * ARROW_BYTES  # the bytes count as well as the rows


def test_cluster_list_works_out_few_shards(spark):
    from dagstore.functions import hashing
    from dagstore.operators import storage

    key = "tenants/t1"
    assert [hashing.shard_number(key, n) for n in (4, 7)] == list(spark.range(1).select(*[hashing.shard_of_key(F.lit(key), n) for n in (4, 7)]).first())
    names = spark.createDataFrame([("refs/tenants/t1/heads/a", "x"), ("refs/tenants/t1/heads/a", "w"), ("refs/workspaces/b/heads/main", "y"), ("refs/tenants/t12/a", "z")], "name string, target string")
    # a shard that fails for any name elsewhere is never asked for
    shard = F.when(F.startswith("name", F.lit("refs/tenants/t1/")), hashing.shard_for(F.col("name"), 4)).otherwise(F.raise_error(F.lit("asked")).cast("int"))
    found = storage.cluster_list(names.withColumn("shard", shard), "refs/tenants/t1/", 4)
    assert [tuple(r) for r in found.collect()] == [("refs/tenants/t1/heads/a", "w")]
