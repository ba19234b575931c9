"""Every image form decoded, area means against sums of pixels, tiles and hashes by their definition."""

import io
import struct

import numpy as np
import pytest

from dagstore.llm import media


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(5)
    return r.integers(0, 256, (7, 13), np.uint8), r.integers(0, 256, (6, 5, 3), np.uint8)


def test_netpbm(images):
    grey, rgb = images
    text = lambda a: b" ".join(b"%d" % v for v in a.ravel())
    assert (media.decode(b"P2 # a remark\n13 7\n255\n" + text(grey)) == grey).all()
    assert (media.decode(b"P3\n5 6\n#x\n255\n" + text(rgb)) == rgb).all()
    assert (media.decode(media.encode_netpbm(grey)) == grey).all() and (media.decode(media.encode_netpbm(rgb)) == rgb).all()
    bits = grey % 2
    assert (media.decode(b"P1\n13 7\n" + b"".join(b"%d" % v for v in bits.ravel())) == 255 * (1 - bits)).all()
    assert (media.decode(b"P4\n13 7\n" + np.packbits(bits, axis=1).tobytes()) == 255 * (1 - bits)).all()
    wide = grey.astype(">u2") * 257
    assert (media.decode(b"P5\n13 7\n65535\n" + wide.tobytes()) == grey).all()
    small = grey % 8
    assert (media.decode(b"P5\n13 7\n7\n" + small.tobytes()) == np.rint(small * (255 / 7))).all()


def test_bmp(images):
    grey, rgb = images
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    h, w = rgb.shape[:2]
    bgra = np.dstack([rgb[:, :, ::-1], np.full((h, w), 9, np.uint8)])
    head = b"BM" + struct.pack("<IHHI", 54 + bgra.nbytes, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 32, 0, bgra.nbytes, 0, 0, 0, 0)
    assert (media.decode(head + bgra.tobytes()) == rgb).all()  # 32 bits, top row first


def test_bad_bytes(spark, images):
    good = media.encode_netpbm(images[0])
    bad = [None, b"", b"P", b"P5", b"P5 2 2 255\n1", b"P9 1 1", b"BM", b"BM" + b"\0" * 60, good[:-1], b"GIF89a"]
    df = spark.createDataFrame([(b,) for b in [*bad, good, media.encode_bmp(images[1])]], "media binary")
    rows = media.load_media(df).collect()
    assert len(rows) == len(bad) + 2 and sum(r.feature is not None for r in rows) == 2
    assert {(r.height, r.width, r.channels) for r in rows if r.feature} == {(7, 13, 1), (6, 5, 3)}


def test_area_means():
    r = np.random.default_rng(6)
    for h, w, th, tw in [(7, 13, 8, 9), (64, 3, 4, 5), (1, 1, 8, 9), (9000, 2, 7, 3), (10, 10, 5, 5)]:
        a = r.integers(0, 256, (h, w), np.uint8)
        fine = np.kron(a.astype(float), np.ones((th, tw)))  # every pixel cut into th x tw parts: cells are whole parts
        expected = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(a, th, tw), expected)


def test_hash_and_tile():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert media.difference_hash(ramp) == 2**64 - 1 and media.difference_hash(ramp[:, ::-1]) == 0
    tile = np.load(io.BytesIO(media.npy_tile(np.full((5, 9), 77, np.uint8))))
    assert tile.shape == (32, 32) and tile.dtype == np.uint8 and (tile == 77).all()


@pytest.mark.parametrize("fmt", ["pgm", "bmp"])
def test_stored_text_comes_back(spark, fmt):
    texts = ["", None, "abc", "x" * 64, "é" * 1000, "\U0001f600" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in media.store_payloads(df, fmt=fmt).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert media.decode(bytes(r.media)).tobytes() == raw + bytes(r.payload_bytes - len(raw))
        assert r.media_bytes == len(r.media) and np.load(io.BytesIO(bytes(r.tile))).shape == (32, 32)
