"""Every registered query against its DuckDB oracle, and those without one against plain Python."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from dagstore.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(v[i]) for i in order] for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(name, spark, duck, sf_dir):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(catalogue.ORACLES[name])
    assert found == rows([c[0] for c in r.description], r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_token_bucket(spark, sf_dir, duck):
    tokens, last, expected = {}, {}, {}
    for event, user, us in duck.execute("SELECT event_id, user_id, epoch_us(ts) FROM events ORDER BY event_id").fetchall():
        t = user % 10
        now = min(5.0, tokens.get(t, 5.0) + max(0, us - last.get(t, us)) / 1e6 * 0.0005)
        expected[event] = now >= 1
        tokens[t], last[t] = now - (now >= 1), us
    found = {r.offset: r.allowed for r in catalogue.QUERIES["token_bucket"](spark, sf_dir).collect()}
    assert found == expected


def by_hand(rows, replicated):
    """The log operation by operation over a dictionary of slots: name -> [committed (target, version), lock (txn, target) or None]."""
    slots, out = {}, {}
    for name, offset, kind, txn, target, expected in rows:
        slot = slots.get(name)
        committed = slot[0] if slot else None
        lock = slot[1] if slot else None
        real = committed if committed and committed[1] else None
        if kind == "prepare":
            fits = (real is None) if expected is None else (real is not None and real[0] == expected)
            if (lock and lock[0] != txn) or not fits:
                out[name, offset] = ("no", committed[1] if committed else 0)
            else:
                slots[name] = [committed or (target, 0), (txn, target)]
                out[name, offset] = ("yes", slots[name][0][1])
        elif kind == "commit":
            if slot is None:
                out[name, offset] = ("aborted", 0)
            else:
                if lock and lock[0] == txn:
                    slots[name] = [(lock[1], committed[1] + 1), None]
                out[name, offset] = ("ok", slots[name][0][1])
        elif kind == "abort":
            if lock and lock[0] == txn:
                if committed[1] == 0:
                    del slots[name]
                else:
                    slots[name] = [committed, None]
            out[name, offset] = ("aborted", slots[name][0][1] if name in slots else 0)
        elif lock and not replicated:
            out[name, offset] = ("conflict", committed[1])
        elif kind == "delete":
            if committed is None:
                out[name, offset] = ("notfound", 0)
            elif committed[0] != expected:
                out[name, offset] = ("conflict", committed[1])
            else:
                del slots[name]
                out[name, offset] = ("ok", 0)
        elif committed is None and expected is not None:
            out[name, offset] = ("notfound", 0)
        elif committed is not None and committed[0] != expected:
            out[name, offset] = ("conflict", committed[1])
        else:
            slots[name] = [(target, (committed[1] if committed else 0) + 1), None]
            out[name, offset] = ("ok", slots[name][0][1])
    return out


@pytest.mark.parametrize("replicated", [False, True])
def test_cas_folds_over_the_whole_log(spark, sf_dir, replicated):
    from dagstore.plans import fixtures

    log = [tuple(r) for r in fixtures.ref_log(spark, sf_dir).select("name", "offset", "kind", "txn", "target", "expected").collect()]
    expected = by_hand(sorted(log, key=lambda r: r[1]), replicated)
    assert {x[0] for x in expected.values()} == {"ok", "conflict", "notfound", "yes", "no", "aborted"}
    found = catalogue.QUERIES["cas_fold_replicated" if replicated else "cas_fold_single"](spark, sf_dir)
    assert {(r.name, r.offset): (r.outcome, r.version) for r in found.collect()} == expected


def test_cas_random_logs(spark):
    import random

    from dagstore.operators.reflog import cas_fold

    r = random.Random(3)
    pick = lambda: r.choice([None, "a", "b", "c"])
    log = [(f"n{k % 40}", k, r.choice(["put", "delete", "prepare", "commit", "abort"]), r.choice("xy"), r.choice("abc"), pick()) for k in range(4000)]
    df = spark.createDataFrame(log, "name string, offset bigint, kind string, txn string, target string, expected string")
    for replicated in (False, True):
        found = {(x.name, x.offset): (x.outcome, x.version) for x in cas_fold(df, replicated).collect()}
        assert found == by_hand(log, replicated)


def test_deltas_rebuild(spark, sf_dir):
    from dagstore.functions.delta import apply_delta, encode_delta

    for base, target in [(b"", b""), (b"abc" * 50, b"abc" * 40 + b"x"), (b"q" * 70000, b"q" * 70001), (b"", b"new")]:
        assert apply_delta(base, encode_delta(base, target)) == target


def test_fanout_counts_before_it_joins(spark):
    from dagstore.operators import policy

    hooks = spark.createDataFrame([(1, 7, [], True), (1, 7, ["a"], True), (2, 7, ["b", "c"], True), (3, 7, [], False), (4, 8, ["z"], True)], "id bigint, tenant_id int, events array<string>, active boolean")
    events = spark.createDataFrame([(7, "a"), (7, "a"), (7, "b"), (7, None), (8, "a"), (None, "a")], "tenant_id int, kind string")
    found = policy.webhook_counts(hooks, events)
    assert {tuple(r) for r in found.collect()} == {(1, 6), (2, 1)}
    plan = catalogue.QUERIES["webhook_fanout"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")  # events are counted below the join


def test_windows_are_sums_of_spans(spark, sf_dir):
    import random

    from dagstore.operators import monitor

    r = random.Random(3)
    second = monitor.SECOND
    times = [r.randrange(-30 * second, 90 * second) for _ in range(150)] + [k * 10 * second + j for k in range(-2, 8) for j in (-1, 0, 0, 1)] + [None, None]
    rows = [(r.choice(["a", "b", None]), k, t, r.choice([None, 1.0, 2.0, 5.0])) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "name string, offset bigint, ts_us bigint, value double")
    found = {x.offset: x["sum"] for x in monitor.trailing_sum(df, ["name"], 10, "value", "sum").collect()}
    for name, offset, t, _ in rows:
        held = [v for n, _, u, v in rows if n == name and v is not None and ((u is None) if t is None else u is not None and t - 10 * second < u <= t)]
        assert found[offset] == (sum(held) if held else None)
    for query, frame in (("changes_over_window", 86_400), ("rate_by_label", 3600)):  # no row adds up its whole window again
        plan = catalogue.QUERIES[query](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame" in plan and f"-{frame * second - 1}" not in plan
