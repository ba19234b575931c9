"""Media columns: Netpbm and BMP images as bytes, numpy arrays, NPY tiles and difference hashes.

``decode`` reads P1-P6 and uncompressed 8/24/32-bit BMP.  ``area_resize`` averages exact (fractional) areas
from an integral image that is evaluated at the cell borders only, in blocks of rows, so a tall image needs
memory for its own bytes and little more.  ``store_payloads`` writes any text's UTF-8 bytes as 8-bit samples,
reads them back and derives the features from what was read.

Defined results: a null or empty text is one row of zero samples; equal texts give equal values; repeated rows
are repeated in the result; an empty table gives an empty table; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from dagstore.llm import runtime as rt

WIDTH = 64  # samples in a row of a stored payload
TILE = 32  # side of an NPY tile
BLOCK = 4096  # rows of an image held as floats at once

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_netpbm(a: np.ndarray) -> bytes:
    """P5 for (h, w), P6 for (h, w, 3), of uint8."""
    h, w = a.shape[:2]
    kind = b"P5" if a.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, w, h) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """8-bit grey palette for (h, w), 24-bit for (h, w, 3); rows bottom-up, padded to 4 bytes."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    body = a if grey else a[:, :, ::-1].reshape(h, w * 3)
    pad = -body.shape[1] % 4
    rows = np.pad(body[::-1], ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8)
    table = palette.tobytes() if grey else b""
    start = 54 + len(table)
    return b"BM" + struct.pack("<IHHI", start + len(rows), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(rows), 2835, 2835, 256 if grey else 0, 0) + table + rows


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("truncated Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if len(head) > 2 else 1
    depth = 3 if kind in (3, 6) else 1
    if kind == 1:
        digits = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = 1 - np.array([c - 48 for c in digits if c in b"01"][: w * h], np.int64)
        top = 1
    elif kind in (2, 3):
        values = np.array(data[at:].split()[: w * h * depth], np.int64)
    elif kind == 4:
        raw = np.frombuffer(data, np.uint8, h * -(-w // 8), at + 1).reshape(h, -1)
        values = 1 - np.unpackbits(raw, axis=1)[:, :w].astype(np.int64).ravel()
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at + 1)
    if values.size != w * h * depth:
        raise ValueError("truncated Netpbm samples")
    if top != 255:
        values = np.rint(values.astype(np.float64) * 255 / top)
    out = values.astype(np.uint8, copy=False)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed 8, 24 and 32-bit BMP")
    up, h, step = h > 0, abs(h), bits // 8
    stride = -(-w * step // 4) * 4
    rows = np.frombuffer(data, np.uint8, h * stride, start).reshape(h, stride)[:, : w * step]
    rows = rows[::-1] if up else rows
    if bits == 8:
        table = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, :3]
        if (table == table[:, :1]).all():
            return table[:, 0][rows]
        return table[:, ::-1][rows]
    return rows.reshape(h, w, step)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    """uint8 samples, (h, w) grey or (h, w, 3) RGB."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _integral_at(a: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Rows of the vertical integral image at fractional borders (ascending), linear between whole rows."""
    out = np.zeros((len(borders), a.shape[1]))
    run = np.zeros(a.shape[1])
    for at in range(0, a.shape[0], BLOCK):
        part = a[at : at + BLOCK]
        inside = np.flatnonzero((borders >= at) & (borders < at + len(part)))
        if inside.size:
            cum = np.cumsum(part, axis=0, dtype=np.float64)
            whole = np.floor(borders[inside]).astype(np.int64) - at
            above = np.where(whole[:, None] > 0, cum[whole - 1], 0.0)
            out[inside] = run + above + (borders[inside] - at - whole)[:, None] * part[whole]
            run = run + cum[-1]
        else:
            run = run + part.sum(axis=0, dtype=np.float64)
    out[borders >= a.shape[0]] = run
    return out


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each cell's exact area, as float64 (h, w)."""
    if a.ndim == 3:
        a = a.mean(axis=2)
    ys, xs = np.arange(h + 1) * (a.shape[0] / h), np.arange(w + 1) * (a.shape[1] / w)
    bands = np.diff(_integral_at(a, ys), axis=0)
    cells = np.diff(_integral_at(bands.T, xs), axis=0).T
    return cells / ((a.shape[0] / h) * (a.shape[1] / w))


def difference_hash(a: np.ndarray) -> int:
    """64 bits: is a cell of the 8 x 9 area means darker than its right neighbour."""
    g = np.rint(area_resize(a, 8, 9) * 1024)
    return int.from_bytes(np.packbits(g[:, :-1] < g[:, 1:]).tobytes(), "big")


def npy_tile(a: np.ndarray, side: int = TILE) -> bytes:
    """A side x side uint8 tile in NPY format."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(a, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def features(media: bytes) -> tuple[np.ndarray, bytes, str]:
    a = decode(media)
    tile = npy_tile(a)
    return a, tile, f"dhash:{difference_hash(a):016x};tile:{zlib.crc32(tile):08x}"


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fmt: str = "pgm", keep: bool = True) -> DataFrame:
    """One row per input row: the stored image and what its decoded samples give.

    keep adds the binary columns media and tile; without them only the digests leave the Python workers.
    """
    ddl = f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary, tile binary" * keep

    schema = rt.arrow_schema(ddl)

    def run(batches):
        encode = {"pgm": encode_netpbm, "bmp": encode_bmp}[fmt]
        for b in rt.slices(batches):
            ids, rows = b.column(0).to_pylist(), []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                n = len(raw)
                raw += bytes(-n % WIDTH if n else WIDTH)
                media = encode(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH))
                a, tile, feature = features(media)
                back = a.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature, *((media, tile) if keep else ())))
            yield rt.to_batch(schema, [ids, *map(list, zip(*rows, strict=True))])

    return rt.map_arrow(rt.only(df, id_col, text_col), run, ddl)


def load_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Features of stored images; undecodable bytes give a null feature."""
    ddl = "media_sha256 string, height int, width int, channels int, feature string, tile binary"

    schema = rt.arrow_schema(ddl)

    def run(batches):
        for b in rt.slices(batches):
            rows = []
            for media in b.column(0).to_pylist():
                try:
                    a, tile, feature = features(media or b"")
                    rows.append((hashlib.sha256(media).hexdigest(), a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, feature, tile))
                except (ValueError, struct.error, IndexError):
                    rows.append((hashlib.sha256(media or b"").hexdigest(), None, None, None, None, None))
            yield rt.to_batch(schema, list(map(list, zip(*rows, strict=True))))

    return rt.map_arrow(rt.only(df, media_col), run, ddl)
