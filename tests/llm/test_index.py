"""Phrase and proximity search over the positional index, block by block, against a scan."""

import random

import pytest

from dagstore.llm import decontaminate as dc


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(k, text(r.randrange(0, 60))) for k in range(80)] + [(80, None), (7, text(30)), (None, text(40))]
    items = [(100 + k, text(r.randrange(1, 9))) for k in range(15)]
    # planted: whole items, and items with a word more or less in between
    docs += [(200 + k, f"{text(5)} {t} {text(5)}") for k, (_, t) in enumerate(items)]
    return docs + docs[:3], items


def windows(items, n):
    for i, t in items:
        w = dc.words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            yield i, w[k : k + n]


def scan(docs, items, n, slop):
    out = []
    for i, t in docs:
        w = dc.words(t)
        at = {x: [k for k, y in enumerate(w) if y == x] for x in set(w)}
        hit, found = set(), set()
        for item, p in windows(items, n):
            for s in range(-slop - len(p), len(w) + slop):
                if s < len(w) and s + len(p) > 0 and all(any(abs(k - s - j) <= slop for k in at.get(x, ())) for j, x in enumerate(p)):
                    hit.update(range(max(0, s), min(len(w), s + len(p))))
                    found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,slop,block_bytes", [(4, 0, 1 << 20), (4, 0, 40), (3, 1, 1 << 20), (3, 2, 60)])
def test_search(spark, corpus, window, slop, block_bytes):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert block_bytes > 100 or len(list(dc.blocks(b, block_bytes=block_bytes))) > 2
    got = dc.decontaminate(d, b, window, block_bytes=block_bytes, slop=slop)
    expected = scan(docs, items, window, slop)
    assert sum(len(x[3]) for x in expected) > 15
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()), key=repr) == expected


def test_index_holds_every_token_once(spark, corpus):
    docs, _ = corpus
    index = dc.build_index(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    found = []
    for r in index:
        terms = [t for t, n in zip(r.terms, [b - a for a, b in zip([0, *r.ends], r.ends, strict=False)], strict=True) for _ in range(n)]
        words = dict(zip(r.places, terms, strict=True))
        assert list(r.terms) == sorted(set(r.terms)) and sorted(words) == list(range(sum(r.n_words)))
        at = 0
        for i, n in zip(r.ids, r.n_words, strict=True):
            found.append((i, [words[k] for k in range(at, at + n)]))
            at += n
    assert sorted(found, key=repr) == sorted(((i, [dc.term(w) for w in dc.words(t)]) for i, t in docs), key=repr)
