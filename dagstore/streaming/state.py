"""Stateful streams: leases with their expiry, token buckets, and events for whoever listens.

State is a few numbers a key.  Within a micro-batch a key's rows are put in order of their offset; across micro-batches
they come in the order of the log, as its source delivers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dagstore.operators import policy

LEASES = "id string, event string, generation bigint, created_at_ms bigint, expires_at_ms bigint"


def _all(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    found = list(parts)
    return pd.concat(found).sort_values("offset") if found else pd.DataFrame()


def leases(log: DataFrame, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """What happens to each lease of a streamed log (id, offset, kind put/renew/tombstone, at timestamp): put, renew, release, expire.

    put begins at generation 1; a renewal is one more, with a fresh expiry; a tombstone releases; when the watermark
    (the latest time less the delay) passes a lease's expiry, it expires.  Renewals of no lease say nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        lease = state.get if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], "expire", *lease))
            state.remove()
        else:
            for kind, at in _all(parts)[["kind", "at_ms"]].itertuples(index=False):
                if lease and kind != "put" and at >= lease[2]:
                    out.append((key[0], "expire", *lease))  # it ran out before this entry
                    lease = None
                if kind == "put":
                    lease = (1, at, at + ttl_ms)
                elif lease and kind == "renew":
                    lease = (lease[0] + 1, lease[1], at + ttl_ms)
                elif lease:
                    out.append((key[0], "release", *lease))
                    lease = None
                    continue
                else:
                    continue
                out.append((key[0], kind, *lease))
            if lease:
                state.update(lease)
                state.setTimeoutTimestamp(max(lease[2], state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["id", "event", "generation", "created_at_ms", "expires_at_ms"])

    timed = log.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("id").applyInPandasWithState(step, LEASES, "generation bigint, created_at_ms bigint, expires_at_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket(requests: DataFrame, rate: float | None, burst: float | None = None) -> DataFrame:
    """tenant, offset, allowed and tokens of streamed requests (tenant, offset, at_us), as operators.reflog.token_bucket has them."""
    if not rate:
        return requests.select("tenant", "offset", F.lit(True).alias("allowed"), F.lit(0.0).alias("tokens"))
    top = float(rate) if burst is None else max(1.0, float(burst))
    kind = dict(requests.dtypes)["tenant"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (top, None)
        out = []
        for offset, at in _all(parts)[["offset", "at_us"]].itertuples(index=False):
            tokens = min(tokens + (max(0, at - last) if last is not None else 0) / 1e6 * rate, top)
            allowed = tokens >= 1.0
            tokens, last = tokens - allowed, at
            out.append((key[0], offset, allowed, tokens))
        state.update((tokens, int(last)))
        yield pd.DataFrame(out, columns=["tenant", "offset", "allowed", "tokens"])

    ddl = f"tenant {kind}, offset bigint, allowed boolean, tokens double"
    return requests.groupBy("tenant").applyInPandasWithState(step, ddl, "tokens double, last bigint", "append", GroupStateTimeout.NoTimeout)


def emit(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Streamed events (tenant_id, kind, ...) once for each active webhook of their tenant that takes them: a stream-static join."""
    return policy.webhook_matches(hooks, events)
