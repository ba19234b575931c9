"""Object identity, clocks, and FNV-1a sharding without leaving the JVM.

A 64-bit FNV hash is carried as two unsigned 32-bit halves, so no product overflows a signed BIGINT: the prime is
2**40 + 435, and h * prime mod 2**64 is h * 435 plus the low 24 bits of h moved up by 40.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF
HLC_BITS = 20


def object_id(content: Column) -> Column:
    """SHA-256 of the content (the stand-in for a content hash that is no builtin)."""
    return F.sha2(content, 256)


def git_id(kind: Column, content: Column) -> Column:
    """SHA-1 of '<kind> <length> NUL <content>'."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(kind, F.lit(" "), F.octet_length(raw).cast("string"), F.lit("\0")).cast("binary"), raw))


def _byte(raw: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")


def fnv1a64(x: Column) -> Column:
    """struct<hi bigint, lo bigint> of the unsigned 64-bit FNV-1a of a string's bytes."""
    raw = x.cast("binary")
    n = F.octet_length(raw)
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(_byte(raw, i))
        product = lo * 435
        hi = (acc["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(LOW))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(LOW)).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    return F.aggregate(steps, start, step)


def fnv_hex(x: Column) -> Column:
    h = fnv1a64(x)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def namespace_key(name: Column) -> Column:
    """What of a ref's name decides its shard: <a>/<b> of refs/<a>/<b>/..., with refs/ before it for heads and tags."""
    pair = F.regexp_extract(name, "^refs/([^/]*/[^/]*)", 1)
    return (
        F.when(F.rlike(name, F.lit("^refs/(heads|tags)/")), F.concat(F.lit("refs/"), pair))
        .when(F.rlike(name, F.lit("^refs/[^/]*/")), pair)
        .when(F.startswith(name, F.lit("refs/")), F.substring(name, 6, 1 << 30))
        .otherwise(name)
    )


def prefix_shard(prefix: str) -> str | None:
    """The namespace key that all names under a prefix share, or None if they may lie on any shard.

    Only a prefix that ends its third segment pins a key: refs/heads/ma may go on as another name.
    """
    parts = prefix.split("/")
    if parts[0] != "refs" or len(parts) < 4 or not parts[1] or not parts[2]:
        return None
    return "/".join(parts[:3]) if parts[1] in ("heads", "tags") else "/".join(parts[1:3])


def shard_of_key(key: Column, shards: int) -> Column:
    h = fnv1a64(key)
    return (((h["hi"] % shards) * ((1 << 32) % shards) + h["lo"] % shards) % shards).cast("int")


def shard_number(key: str, shards: int) -> int:
    """shard_of_key of one key, in plain Python."""
    h = 0xCBF29CE484222325
    for byte in key.encode():
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return h % shards


def shard_for(name: Column, shards: int) -> Column:
    return shard_of_key(namespace_key(name), shards)


def shard_for_workspace(workspace: Column, shards: int) -> Column:
    """The shard of the workspace's refs."""
    return shard_of_key(F.concat(F.lit("workspaces/"), workspace), shards)


def name_hash(name: Column) -> Column:
    """The 32-bit hash by which similar names lie near: every further byte counts most, white space not at all."""
    raw = name.cast("binary")
    n = F.octet_length(raw)
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        c = _byte(raw, i)
        new = (F.shiftright(h, 2) + F.shiftleft(c, 24)).bitwiseAND(F.lit(LOW))
        return F.when(c.isin(9, 10, 12, 13, 32), h).otherwise(new)

    return F.aggregate(steps, F.lit(0).cast("bigint"), step)


def hlc_wall_ms(hlc: Column) -> Column:
    return F.shiftright(hlc, HLC_BITS)


def hlc_of_ms(ms: Column) -> Column:
    return ms * (1 << HLC_BITS)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("bigint")
