"""Binary deltas in the copy/insert form of version-control packs, their varints, and bounded decompression.

A delta is base size, result size, then operations: a byte with its top bit set copies from the base (the low seven
bits tell which of four offset and three size bytes follow, size 0 meaning 65536); any other byte inserts as many
literal bytes.  These run inside Arrow and pandas functions; ``apply_udf`` and ``inflate_udf`` are their columns.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

BLOCK = 16  # bytes of an indexed block of the base
PRINT_BITS = 20  # of a block's fingerprint
TRIES = 64  # places of a block that are tried
LONGEST_COPY = 0x10000
LIMIT = 2 << 30


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """A size in groups of seven bits, least first; and where it ends."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated or overlong size")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def write_size(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def read_offset(data: bytes, at: int) -> tuple[int, int]:
    """A backward distance: most significant group first, one added for each group that follows."""
    if at >= len(data):
        raise ValueError("truncated distance")
    value = data[at] & 0x7F
    while data[at] >= 0x80:
        at += 1
        if at >= len(data) or value > 1 << 56:
            raise ValueError("truncated or overlong distance")
        value = (value + 1 << 7) | data[at] & 0x7F
    return value, at + 1


def write_offset(value: int) -> bytes:
    groups = [value & 0x7F]
    while value >= 0x80:
        value = (value >> 7) - 1
        groups.append(value & 0x7F | 0x80)
    return bytes(reversed(groups))


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The result of a delta; ValueError if it doesn't fit the base, its own sizes or the limit."""
    size, at = read_size(delta, 0)
    wanted, at = read_size(delta, at)
    if size != len(base):
        raise ValueError("delta is for another base")
    if wanted > LIMIT:
        raise ValueError("result over the limit")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            fields = []
            for bit in range(7):
                if op >> bit & 1:
                    if at >= len(delta):
                        raise ValueError("truncated copy")
                    fields.append(delta[at])
                    at += 1
                else:
                    fields.append(0)
            start, n = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or LONGEST_COPY
            if start + n > len(base):
                raise ValueError("copy beyond the base")
            out += base[start : start + n]
        elif op:
            if at + op > len(delta):
                raise ValueError("truncated insert")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("operation 0 is reserved")
        if len(out) > wanted:
            raise ValueError("result longer than stated")
    if len(out) != wanted:
        raise ValueError("result shorter than stated")
    return bytes(out)


class DeltaIndex:
    """The blocks of a base, to write many deltas against it."""

    def __init__(self, base: bytes):
        self.base = base
        self.places: dict[bytes, list[int]] = {}
        for at in range(0, len(base) - BLOCK + 1, BLOCK):
            where = self.places.setdefault(base[at : at + BLOCK], [])
            if len(where) < TRIES:
                where.append(at)

    def encode(self, target: bytes, hits: Iterable[int] | None = None) -> bytes:
        """A delta that makes target; at every place the longest match of its block's places is copied.

        hits are the places of target that hold a block of the base, in order; without them all places are looked at.
        """
        base, places, out, at = self.base, self.places, bytearray(write_size(len(self.base)) + write_size(len(target))), 0
        if hits is None:
            hits = [k for k in range(len(target) - BLOCK + 1) if target[k : k + BLOCK] in places]
        for hit in hits:
            if hit < at:
                continue
            start, n = -1, 0
            for where in places[target[hit : hit + BLOCK]]:
                k = _common(base, where, target, hit)
                if k > n:
                    start, n = where, k
            back = 0  # the match may begin within what was to be inserted
            while hit - back > at and start - back > 0 and base[start - back - 1] == target[hit - back - 1]:
                back += 1
            _flush(out, bytearray(target[at : hit - back]))
            _copies(out, start - back, n + back)
            at = hit + n
        _flush(out, bytearray(target[at:]))
        return bytes(out)


def _prints(data: bytes) -> np.ndarray:
    """A fingerprint of the block at every place."""
    if len(data) < BLOCK:
        return np.empty(0, np.int64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return (words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - PRINT_BITS)).astype(np.int64)


class DeltaWindow:
    """The last size bases and one index of all their blocks: a target is looked through once for all of them."""

    def __init__(self, size: int):
        self.size, self.first = size, 0
        self.bases: deque[DeltaIndex] = deque()
        self.owners: dict[bytes, list[int]] = {}  # by block the numbers of the bases that have it, oldest first
        self.prints = np.zeros(1 << PRINT_BITS, np.int32)  # how many blocks have a fingerprint: most places of a target have none

    def push(self, base: bytes) -> None:
        if len(self.bases) == self.size:
            old = self.bases.popleft()
            np.subtract.at(self.prints, _prints(old.base)[::BLOCK], 1)
            for block in old.places:
                who = self.owners[block]
                if len(who) == 1:
                    del self.owners[block]
                else:
                    del who[0]
            self.first += 1
        index, number, owners = DeltaIndex(base), self.first + len(self.bases), self.owners
        np.add.at(self.prints, _prints(base)[::BLOCK], 1)
        for block in index.places:
            who = owners.get(block)
            if who is None:
                owners[block] = [number]
            else:
                who.append(number)
        self.bases.append(index)

    def encode(self, target: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        """Distance (1 for the last base), base and delta of every base that shares a block with target, in no order.

        The delta against any other base only inserts, so it is longer than target.
        """
        owners, held = self.owners, {}
        for at in np.flatnonzero(self.prints[_prints(target)]).tolist():
            block = target[at : at + BLOCK]
            if block in owners:
                held.setdefault(block, []).append(at)
        shared: dict[int, list[list[int]]] = {}
        for block, where in held.items():
            for number in owners[block]:
                shared.setdefault(number, []).append(where)
        for number, lists in shared.items():
            index = self.bases[number - self.first]
            yield self.first + len(self.bases) - number, index.base, index.encode(target, sorted(chain.from_iterable(lists)))


def _common(a: bytes, i: int, b: bytes, j: int) -> int:
    n, top = 0, min(len(a) - i, len(b) - j)
    step = 1024
    while n < top:
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n = min(top, n + step)
        elif step == 1:
            break
        else:
            step = max(1, step // 8)
    return n


def _flush(out: bytearray, literal: bytearray) -> None:
    for k in range(0, len(literal), 127):
        part = literal[k : k + 127]
        out.append(len(part))
        out += part
    literal.clear()


def _copies(out: bytearray, start: int, n: int) -> None:
    while n:
        part = min(n, LONGEST_COPY)
        op, fields = 0x80, bytearray()
        for bit, byte in enumerate([*start.to_bytes(4, "little"), *(part % LONGEST_COPY).to_bytes(3, "little")]):
            if byte:
                op |= 1 << bit
                fields.append(byte)
        out.append(op)
        out += fields
        start, n = start + part, n - part


def encode_delta(base: bytes, target: bytes) -> bytes:
    return DeltaIndex(base).encode(target)


def inflate(data: bytes, size: int) -> bytes:
    """Decompressed bytes of exactly the stated size; nothing beyond it is ever held."""
    d = zlib.decompressobj()
    out = d.decompress(data, size + 1)
    if len(out) != size or not (d.eof or (not d.decompress(d.unconsumed_tail, 1) and d.eof)):
        raise ValueError("decompressed size differs from the stated one")
    return out


def _try(fn, *args):
    try:
        return fn(*args)
    except (ValueError, zlib.error, TypeError):
        return None


def _apply(base: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([_try(apply_delta, bytes(b), bytes(d)) if b is not None and d is not None else None for b, d in zip(base, delta, strict=True)], dtype=object)


def _encode(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([encode_delta(bytes(b), bytes(t)) if b is not None and t is not None else None for b, t in zip(base, target, strict=True)], dtype=object)


def _inflate(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([_try(inflate, bytes(d), int(n)) if d is not None and n == n else None for d, n in zip(data, size, strict=True)], dtype=object)


def apply_udf():
    """Column function (base, delta) -> result, null where the delta is malformed."""
    return F.pandas_udf(_apply, "binary")


def encode_udf():
    return F.pandas_udf(_encode, "binary")


def inflate_udf():
    return F.pandas_udf(_inflate, "binary")
