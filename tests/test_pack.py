"""Delta selection against a fold of all objects one by one."""

import random
import zlib

import duckdb

from dagstore.functions.delta import apply_delta, encode_delta
from dagstore.operators import pack
from dagstore.plans import catalogue


def brute_force(rows, window, depth):
    """rows: (git_type, rank, id, content)."""
    out, recent = set(), {}
    for kind, _, name, content in sorted(rows):
        near, best = recent.setdefault(kind, []), None
        for base, whole, chain in near[: -window - 1 : -1]:
            if chain < depth:
                d = encode_delta(whole, content)
                if len(d) < len(content if best is None else best[1]):
                    best = (base, d, chain + 1, whole)
        if best and len(zlib.compress(best[1])) < len(zlib.compress(content)) and apply_delta(best[3], best[1]) == content:
            out.add((name, best[0], len(best[1]), best[2]))
            near.append((name, content, best[2]))
        else:
            near.append((name, content, 0))
    return out


def test_no_boundary_loses_a_base(spark):
    r = random.Random(5)
    texts = [bytes(r.randrange(97, 123) for _ in range(300)) for _ in range(4)]
    rows, at = [], {"a": 0, "b": 0}
    for i in range(120):
        kind, k = "ab"[i % 3 == 0], r.randrange(4)
        at[kind] += 1
        cut = r.randrange(1, 299)
        texts[k] = texts[k][:cut] + bytes(r.randrange(97, 123) for _ in range(r.randrange(9))) + texts[k][cut + r.randrange(5) :]
        rows.append((kind, at[kind], str(i), texts[k] if i % 7 else b"short"))
    df = spark.createDataFrame(rows, "git_type string, rank bigint, id string, content binary")
    for window, depth, block in [(9, 3, 10), (12, 50, 5), (40, 2, 16)]:
        expected = brute_force(rows, window, depth)
        assert len(expected) > 40
        assert {tuple(x) for x in pack.select_deltas(df, window, depth, block).collect()} == expected


def test_registered_window(spark, sf_dir):
    ranked = catalogue.QUERIES["pack_order"](spark, sf_dir).collect()
    texts = {i: t.encode() for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' WHERE text IS NOT NULL").fetchall()}
    assert len(texts) == len(ranked)
    # ids are text in delta_selection, which decides between equal sizes of a source
    order = sorted(ranked, key=lambda x: (x.git_type, x.name_hash, -x["size"], str(x.id)))
    rows = [(x.git_type, k, str(x.id), texts[x.id]) for k, x in enumerate(order)]
    expected = brute_force(rows, 250, 50)
    assert expected != brute_force(rows, 10, 50)
    assert {tuple(x) for x in catalogue.QUERIES["delta_selection"](spark, sf_dir).collect()} == expected


def test_window_gives_the_deltas_of_all_bases():
    from dagstore.functions.delta import DeltaWindow

    r, window, near = random.Random(8), DeltaWindow(7), []
    texts = [b"", b"short", b"a" * 400, b"exactly 16 bytes", *(bytes(r.choice(b"abc") for _ in range(r.randrange(20, 300))) for _ in range(20))]
    texts += [t[:k] + b"new" + t[k:] for t in texts for k in (0, len(t) // 2)]
    r.shuffle(texts)
    for text in texts:
        found = {distance: (base, d) for distance, base, d in window.encode(text)}
        for distance, base in enumerate(near, 1):
            d = encode_delta(base, text)
            assert found.get(distance, (base, d)) == (base, d)
            assert distance in found or len(d) > len(text)  # left out are those that only insert
        window.push(text)
        near = [text, *near][:7]
    assert set().union(*(i.places for i in window.bases)) == set(window.owners) and window.prints.sum() == sum(len(x) // 16 for x in near)
