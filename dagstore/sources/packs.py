"""Packs of objects: reading with deltas resolved, thin packs against a store, writing, the index and the sidecar.

A pack is PACK, version 2 and the number of objects (4 bytes each, big-endian); then, per object, a header of type and
size, for deltas the base (a distance back in the pack, or a SHA-1), and the zlib-compressed content; at the end the
SHA-1 of all that.  One pack is one row and one task's work, so packs are cut to a size on writing (``write_packs``), as
their offsets of 31 bits ask for anyway.  Sizes are checked against the header while decompressing, so a small stream
that would inflate to gigabytes is an error and costs no memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagstore.functions import delta as deltas
from dagstore.functions.hashing import git_id, object_id
from dagstore.session import small_batches

# fixed values of the formats
MAGIC, VERSION = b"PACK", 2
INDEX_MAGIC = b"\xfftOc"
KINDS = {1: b"commit", 2: b"tree", 3: b"blob", 4: b"tag"}
BACK, NAMED = 6, 7  # a delta whose base is so far back; one whose base is named by SHA-1
OBJECT_LIMIT = 1 << 30
LARGEST = 1 << 31  # offsets from here on don't fit an index entry
ROW = struct.Struct("<32s20sBQ")  # a sidecar's row: id, SHA-1, type, offset


class CorruptPack(ValueError):
    pass


@dataclass
class Entry:
    offset: int
    kind: int
    base: int | bytes | None  # an offset, a SHA-1, or none
    data: bytes  # the content, or the delta
    end: int


def sha1_of(kind: int, content: bytes) -> bytes:
    return hashlib.sha1(b"%s %d\0" % (KINDS[kind], len(content)) + content).digest()


def write_header(kind: int, size: int) -> bytes:
    out, rest = bytearray([kind << 4 | size & 15]), size >> 4
    while rest:
        out[-1] |= 0x80
        out.append(rest & 0x7F)
        rest >>= 7
    return bytes(out)


def read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Type, size, and where the header ends."""
    shift, first = 4, True
    kind = size = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptPack("truncated or overlong object header")
        byte = data[at]
        at += 1
        if first:
            kind, size, first = byte >> 4 & 7, byte & 15, False
        else:
            size |= (byte & 0x7F) << shift
            shift += 7
        if byte < 0x80:
            return kind, size, at


def _inflate(data: memoryview, size: int) -> tuple[bytes, int]:
    """Exactly size bytes, and how many compressed ones they took."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, size + 1)
        if len(out) == size and not d.eof:
            out += d.decompress(d.unconsumed_tail, 1)
    except zlib.error as e:
        raise CorruptPack(f"inflate: {e}") from None
    if len(out) != size or not d.eof:
        raise CorruptPack("decompressed size differs from the stated one")
    return out, len(data) - len(d.unused_data)


def entries(pack: bytes) -> list[Entry]:
    """The objects of a pack as they are stored, in order."""
    if len(pack) < 32 or pack[:4] != MAGIC:
        raise CorruptPack("no pack")
    version, count = struct.unpack_from(">II", pack, 4)
    if version != VERSION:
        raise CorruptPack(f"version {version}")
    if hashlib.sha1(memoryview(pack)[:-20]).digest() != pack[-20:]:
        raise CorruptPack("checksum differs")
    out, at, view = [], 12, memoryview(pack)[:-20]
    for _ in range(count):
        start = at
        kind, size, at = read_header(view, at)
        if size > OBJECT_LIMIT:
            raise CorruptPack("object over the limit")
        base: int | bytes | None = None
        if kind == BACK:
            distance, at = deltas.read_offset(view, at)
            base = start - distance
        elif kind == NAMED:
            if at + 20 > len(view):
                raise CorruptPack("truncated base")
            base, at = bytes(view[at : at + 20]), at + 20
        elif kind not in KINDS:
            raise CorruptPack(f"unknown type {kind}")
        data, used = _inflate(view[at:], size)
        at += used
        out.append(Entry(start, kind, base, data, at))
    if at != len(view):
        raise CorruptPack("bytes after the last object")
    return out


def resolve(found: Iterable[Entry], store: Callable[[bytes], tuple[int, bytes] | None] = lambda sha1: None) -> list[tuple[int, int, bytes, bytes]]:
    """(offset, type, sha1, content) of each; a base comes before its deltas, or from the store (a thin pack)."""
    by_offset: dict[int, tuple[int, bytes]] = {}
    by_name: dict[bytes, tuple[int, bytes]] = {}
    out = []
    for e in found:
        if e.base is None:
            kind, content = e.kind, e.data
        else:
            base = by_offset.get(e.base) if isinstance(e.base, int) else by_name.get(e.base) or store(e.base)
            if base is None:
                raise CorruptPack("base neither before the delta nor in the store")
            kind, content = base[0], deltas.apply_delta(base[1], e.data)
        name = sha1_of(kind, content)
        by_offset[e.offset] = by_name[name] = (kind, content)
        out.append((e.offset, kind, name, content))
    return out


def missing_bases(found: list[Entry]) -> set[bytes]:
    """SHA-1s that deltas name; those of objects of the pack itself are among them, as only resolving tells."""
    return {e.base for e in found if isinstance(e.base, bytes)}


def write_pack(objects: list[tuple[int, bytes]], bases: list[int | bytes | None] | None = None, data: list[bytes] | None = None) -> tuple[bytes, list[int]]:
    """The pack of objects (type, content) and their offsets.

    bases[k] stores object k as the delta data[k] against an earlier object (its place in objects) or a SHA-1.
    """
    out, offsets = bytearray(MAGIC + struct.pack(">II", VERSION, len(objects))), []
    for k, (kind, content) in enumerate(objects):
        base = bases[k] if bases else None
        if len(out) >= LARGEST:
            raise CorruptPack("pack over the largest offset")
        offsets.append(len(out))
        if base is None:
            out += write_header(kind, len(content)) + zlib.compress(content)
        elif isinstance(base, int):
            out += write_header(BACK, len(data[k])) + deltas.write_offset(offsets[k] - offsets[base]) + zlib.compress(data[k])
        else:
            out += write_header(NAMED, len(data[k])) + base + zlib.compress(data[k])
    return bytes(out + hashlib.sha1(out).digest()), offsets


def write_index(pack: bytes, names: list[bytes], offsets: list[int]) -> bytes:
    """The index of a pack: fan-out table, sorted SHA-1s, CRCs of the stored bytes, offsets, both checksums."""
    bounds = sorted(offsets)
    ends = dict(zip(bounds, [*bounds[1:], len(pack) - 20], strict=True))
    rows = sorted((n, o, zlib.crc32(memoryview(pack)[o : ends[o]])) for n, o in zip(names, offsets, strict=True))
    running = [0] * 256
    for n, _, _ in rows:
        running[n[0]] += 1
    for k in range(1, 256):
        running[k] += running[k - 1]
    out = INDEX_MAGIC + struct.pack(">I256I", VERSION, *running) + b"".join(r[0] for r in rows)
    out += struct.pack(f">{len(rows)}I", *(r[2] for r in rows)) + struct.pack(f">{len(rows)}I", *(r[1] for r in rows)) + pack[-20:]
    return out + hashlib.sha1(out).digest()


def read_index(index: bytes) -> list[tuple[bytes, int, int]]:
    """(sha1, offset, crc) in order of sha1."""
    if index[:4] != INDEX_MAGIC or hashlib.sha1(index[:-20]).digest() != index[-20:]:
        raise CorruptPack("no index")
    running = struct.unpack_from(">256I", index, 8)
    n, at = running[-1], 8 + 1024
    if len(index) != at + 28 * n + 40:
        raise CorruptPack("index of another size")
    names = [index[at + 20 * k : at + 20 * k + 20] for k in range(n)]
    if any(sum(x[0] <= b for x in names) != running[b] for b in {x[0] for x in names}):
        raise CorruptPack("fan-out differs")
    return list(zip(names, struct.unpack_from(f">{n}I", index, at + 24 * n), struct.unpack_from(f">{n}I", index, at + 20 * n), strict=True))


def write_sidecar(rows: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """rows: id, SHA-1, type, offset."""
    return struct.pack("<I", len(rows)) + b"".join(ROW.pack(*r) for r in rows)


def read_sidecar(data: bytes) -> list[tuple[bytes, bytes, int, int]]:
    if len(data) < 4 or len(data) < 4 + ROW.size * (n := struct.unpack_from("<I", data)[0]):
        raise CorruptPack("truncated sidecar")
    return [ROW.unpack_from(data, 4 + ROW.size * k) for k in range(n)]


# over DataFrames


def pack_numbers(objects: DataFrame, per_pack: int = 10_000) -> DataFrame:
    """Adds pack: runs of per_pack objects in pack order (ranked: git_type, rank)."""
    return objects.withColumn("pack", F.concat_ws("-", F.col("git_type").cast("string"), F.floor((F.col("rank") - 1) / per_pack).cast("string")))


PACKED = "pack string, objects bigint, content binary, index binary, sidecar binary"


def write_packs(objects: DataFrame) -> DataFrame:
    """pack, objects, content, index and sidecar of objects (pack, rank, git_type int, content, base_rank, delta).

    An object whose base_rank is not null is stored as its delta against the object of that rank, if that one is in the
    same pack, else whole.  A pack is one task's work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        place = {r: k for k, r in enumerate(pdf["rank"])}
        objects = [(int(t), bytes(c)) for t, c in zip(pdf["git_type"], pdf["content"], strict=True)]
        bases = [place.get(int(b)) if b == b and b is not None else None for b in pdf["base_rank"]]
        data = [bytes(d) if b is not None else b"" for b, d in zip(bases, pdf["delta"], strict=True)]
        content, offsets = write_pack(objects, bases, data)
        names = [sha1_of(*o) for o in objects]
        rows = [(hashlib.sha256(c).digest(), n, t, o) for (t, c), n, o in zip(objects, names, offsets, strict=True)]
        return pd.DataFrame({"pack": [pdf["pack"].iloc[0]], "objects": [len(objects)], "content": [content], "index": [write_index(content, names, offsets)], "sidecar": [write_sidecar(rows)]})

    small_batches(objects.sparkSession)
    return objects.select("pack", "rank", "git_type", "content", "base_rank", "delta").groupBy("pack").applyInPandas(run, PACKED)


OBJECTS = "pack string, offset bigint, git_type int, sha1 string, id string, content binary"


def _rows(pack: str, found: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = [
        pa.array([pack] * len(found), pa.string()),
        pa.array([o for o, _, _, _ in found], pa.int64()),
        pa.array([t for _, t, _, _ in found], pa.int32()),
        pa.array([n.hex() for _, _, n, _ in found], pa.string()),
        pa.array([hashlib.sha256(c).hexdigest() for _, _, _, c in found], pa.string()),
        pa.array([c for _, _, _, c in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["pack", "offset", "git_type", "sha1", "id", "content"])


def read_packs(packs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The objects of packs (pack, content), deltas resolved; store (sha1 hex, git_type, content) holds thin packs' bases.

    A thin pack's bases are joined to it by their names, as many as it has deltas at most.
    """

    def names(batches):
        for b in batches:
            for pack, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                wanted = sorted(x.hex() for x in missing_bases(entries(content)))
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(wanted), pa.string()), pa.array(wanted, pa.string())], names=["pack", "sha1"])

    small_batches(packs.sparkSession)
    packs = packs.select(F.col("pack").cast("string").alias("pack"), "content")
    if store is None:
        whole = packs.withColumn("bases", F.array().cast("array<struct<sha1:string,git_type:int,content:binary>>"))
    else:
        wanted = packs.mapInArrow(names, "pack string, sha1 string")
        held = wanted.join(store.select("sha1", F.col("git_type").cast("int").alias("git_type"), "content"), "sha1")
        whole = packs.join(held.groupBy("pack").agg(F.collect_list(F.struct("sha1", "git_type", "content")).alias("bases")), "pack", "left")

    def run(batches):
        for b in batches:
            for pack, content, bases in zip(*(c.to_pylist() for c in b.columns), strict=True):
                have = {bytes.fromhex(x["sha1"]): (x["git_type"], x["content"]) for x in bases or ()}
                yield _rows(pack, resolve(entries(content), have.get))

    return whole.select("pack", "content", "bases").mapInArrow(run, OBJECTS)


def read_indexes(packs: DataFrame) -> DataFrame:
    """pack, sha1, offset and crc of the entries of packs' indexes (pack, index)."""

    def run(batches):
        for b in batches:
            for pack, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = read_index(index)
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(rows), pa.string()), pa.array([r[0].hex() for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["pack", "sha1", "offset", "crc"])

    small_batches(packs.sparkSession)
    return packs.select(F.col("pack").cast("string"), "index").mapInArrow(run, "pack string, sha1 string, offset bigint, crc bigint")


def read_sidecars(packs: DataFrame) -> DataFrame:
    """pack, id, sha1, git_type and offset of the rows of packs' sidecars (pack, sidecar)."""

    def run(batches):
        for b in batches:
            for pack, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = read_sidecar(sidecar)
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(rows), pa.string()), pa.array([r[0].hex() for r in rows], pa.string()), pa.array([r[1].hex() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=["pack", "id", "sha1", "git_type", "offset"])

    small_batches(packs.sparkSession)
    return packs.select(F.col("pack").cast("string"), "sidecar").mapInArrow(run, "pack string, id string, sha1 string, git_type int, offset bigint")


def identities(objects: DataFrame, kind: str = "blob") -> DataFrame:
    """objects (content) with id and sha1, worked out in the JVM."""
    return objects.withColumn("id", object_id(F.col("content"))).withColumn("sha1", git_id(F.lit(kind), F.col("content")))
