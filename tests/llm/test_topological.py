"""The order of calls is the same whatever the size of their conversation."""

import random

from dagstore.llm import toolcalls


def brute_force(rows):
    """The ready call of least position first; the calls in order take the positions in order."""
    left, done, order = {c: (p, set(ps)) for c, p, ps in rows}, set(), []
    while ready := [(p, c) for c, (p, ps) in left.items() if ps <= done]:
        c = min(ready)[1]
        order.append((c, left.pop(c)[0]))
        done.add(c)
    return dict.fromkeys(left) | dict(zip((c for c, _ in order), sorted(p for _, p in order), strict=True))


def found(spark, groups):
    rows = [(conv, *r) for conv, rs in groups.items() for r in rs]
    df = spark.createDataFrame(rows, "conv_id bigint, call_id string, position bigint, parents array<string>")
    return {(r.conv_id, r.call_id): r.topo_order for r in toolcalls.topological(df).collect()}


def test_small_and_cyclic(spark):
    r = random.Random(2)
    groups = {conv: [(str(k), 10 * k, [str(r.randrange(20)) for _ in range(r.randrange(2))]) for k in range(20)] for conv in range(6)}
    assert found(spark, groups) == {(conv, c): o for conv, rs in groups.items() for c, o in brute_force(rs).items()}


def test_long_chain_backwards(spark):
    n = 20_001  # every call waits for the next but one
    rows = [(str(k), 10 * k, [str(k + 2)] if k + 2 < n else []) for k in range(n)]
    at = {str(k): k for k in range(n)}
    order = sorted((o, at[c]) for (_, c), o in found(spark, {1: rows}).items())
    assert [o for o, _ in order] == [10 * k for k in range(n)]  # positions themselves, as in small conversations
    place = {k: i for i, (_, k) in enumerate(order)}
    assert all(place[k + 2] < place[k] for k in range(n - 2))
