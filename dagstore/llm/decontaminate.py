"""Benchmark decontamination over a distributed positional inverted index of the training tokens.

``build_index`` stores every token of every document once, whatever the benchmark holds.  The index is cut into
segments of documents that lie together (SLICE_BYTES of text at most, or one longer document); within a segment it maps
each term, by a 64-bit hash, to its posting list: the ascending places of all its occurrences, documents laid end to
end.  No list is longer than its segment's text, and no term's list meets in one task.

``search`` asks for a block of phrases.  ``term_counts`` adds up each of their terms' postings over all segments; a
phrase's terms are taken from the rarest on.  The rarest term's places less its offset are the candidate starts, and each
further list, less its own offset, is intersected with them.  With slop 0 a start survives if the list has the exact
place (an exact phrase); else if it has one at most slop away (a proximity match: every term within slop of its place).
A match lies in one document.

The benchmark comes to the driver block by block, BLOCK_BYTES of text at most at a time (or one item), so what is
broadcast is bounded; each block is one pass over the stored index.

Words are runs of a-z, 0-9 and anything outside ASCII, after lower-casing A-Z.  A window is WINDOW consecutive words
of an item, or all of a shorter one.  Defined results: a null or empty text has no words and no hits; items without
words or id have no windows; repeated documents repeat, as do rows with a null id; repeated items count once, and rows
that share an id are one item; an empty benchmark marks nothing, an empty table gives an empty table; other columns of
either table, of whatever name, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt

WINDOW = 8
MIN_ITEMS = 2
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 300_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def term(word: bytes) -> int:
    """The term's number in the index."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class _Numbers(dict):
    """Words numbered as they come, and the term of each number."""

    def __init__(self) -> None:
        super().__init__()
        self.terms: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self.terms.append(term(word))
        n = self[word] = len(self.terms) - 1
        return n


_kept: list[_Numbers] = []
rt.keeps(__name__, _kept.clear)


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items as lists of (id, text), each list of at most block_bytes of text (or one item), read as they are asked for."""
    rows, size = [], 0
    for r in rt.only(items, id_col, text_col).dropna().distinct().orderBy(id_col, text_col).toLocalIterator():
        n = len(r[1].encode("utf-8", "surrogatepass"))
        if rows and size + n > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield rows


class Phrases:
    """The windows of a block of items: distinct term sequences, and the items that hold each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.items = window, []
        split = [(item, words(text)) for item, text in items]
        self.terms = np.array(sorted({term(w) for _, ws in split for w in set(ws)}), np.int64)
        at = {int(t): k for k, t in enumerate(self.terms)}
        found: dict[tuple, set] = {}
        for item, ws in split:
            if ws:
                seq = [at[term(w)] for w in ws]
                self.items.append(item)
                for k in range(max(1, len(seq) - window + 1)):
                    found.setdefault(tuple(seq[k : k + window]), set()).add(len(self.items) - 1)
        self.sequences = list(found)
        self.holders = [sorted(x) for x in found.values()]

    def ordered(self, counts: dict[int, int]) -> dict[str, np.ndarray]:
        """Arrays for find(): each window's terms and offsets from the rarest term on (counts: by place in terms), and windows by rarest term."""
        n, m = len(self.sequences), self.window
        length = np.array([len(s) for s in self.sequences], np.int64)
        terms, offset = np.zeros((n, m), np.int64), np.zeros((n, m), np.int64)
        for k, s in enumerate(self.sequences):
            order = sorted(range(len(s)), key=lambda i: (counts.get(s[i], 0), s[i], i))
            order += [order[0]] * (m - len(s))  # a shorter window's first term again, which changes nothing
            terms[k], offset[k] = [s[o] for o in order], order
        by = np.argsort(terms[:, 0], kind="stable") if n else np.zeros(0, np.int64)
        begin = np.searchsorted(terms[by, 0], np.arange(len(self.terms) + 1)) if n else np.zeros(len(self.terms) + 1, np.int64)
        flat = np.array([i for h in self.holders for i in h], np.int64)
        ends = np.cumsum([0] + [len(h) for h in self.holders])
        return {"hashes": self.terms, "length": length, "term": terms, "offset": offset, "by": by, "begin": begin, "holder": flat, "ends": ends}


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per segment: segment (unique), ids, n_words (of its documents), terms, ends (of each term's list in places), places."""
    ddl = f"segment bigint, ids array<{dict(df.dtypes)[id_col]}>, n_words array<bigint>, terms array<bigint>, ends array<int>, places array<int>"
    schema = rt.arrow_schema(ddl)

    def row(values: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind.value_type), type=kind)

    def run(batches):
        context = TaskContext.get()
        segment = (context.partitionId() if context else 0) << 40
        for b in rt.slices(batches):
            if not b.num_rows:
                continue
            if not _kept or len(_kept[0]) > CACHE_WORDS:
                _kept[:] = [_Numbers()]
            numbers = _kept[0]
            split = [words(t) for t in b.column(1).to_pylist()]
            n = np.array([len(s) for s in split], np.int64)
            total = int(n.sum())
            key = np.fromiter((k for s in split for k in map(numbers.__getitem__, s)), np.int64, total) << 32 | np.arange(total)
            key.sort()
            number = key >> 32
            last = np.flatnonzero(np.append(number[1:] != number[:-1], True)) if total else np.zeros(0, np.int64)
            hashes = np.array(numbers.terms, np.int64)[number[last]] if total else np.zeros(0, np.int64)
            first = np.append(0, last[:-1] + 1)[: len(last)]
            by = np.argsort(hashes)
            size = (last + 1 - first)[by]
            ends = np.cumsum(size)
            places = (key & 0xFFFFFFFF)[np.repeat(first[by] - (ends - size), size) + np.arange(total)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment], pa.int64()),
                    row(b.column(0), schema.field(1).type),
                    row(pa.array(n), schema.field(2).type),
                    row(pa.array(hashes[by]), schema.field(3).type),
                    row(pa.array(ends.astype(np.int32)), schema.field(4).type),
                    row(pa.array(places.astype(np.int32)), schema.field(5).type),
                ],
                schema=schema,
            )
            segment += 1

    return rt.map_arrow(rt.only(df, id_col, text_col), run, ddl)


def _rows(b: pa.RecordBatch, *columns: int) -> Iterator[list[np.ndarray]]:
    """The list columns of each row as arrays."""
    for i in range(b.num_rows):
        yield [b.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in columns]


def _held(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of hashes a segment's terms hold, and where."""
    at = np.searchsorted(terms, hashes)
    there = np.flatnonzero((at < len(terms)) & (np.append(terms, 0)[at] == hashes))
    return there, at[there]


def term_counts(index: DataFrame, phrases: Phrases) -> dict[int, int]:
    """Occurrences of the phrases' terms over all documents, by their place in phrases.terms: one row per term comes to the driver."""
    shared = index.sparkSession.sparkContext.broadcast(phrases.terms)

    def run(batches):
        hashes = shared.value
        sums = np.zeros(len(hashes), np.int64)
        for b in batches:
            for terms, ends in _rows(b, 0, 1):
                there, at = _held(hashes, terms)
                ends = ends.astype(np.int64)
                sums[there] += ends[at] - np.append(0, ends)[at]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["term", "n"])

    found = {r[0]: r[1] for r in rt.map_arrow(index.select("terms", "ends"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()}
    shared.unpersist()
    return found


def find(q: dict[str, np.ndarray], n_words: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows found in a segment, the document of each and its start there; a window that begins before its document starts at 0."""
    none = np.zeros(0, np.int64)
    held, at = _held(q["hashes"], terms)
    here = np.zeros(len(q["hashes"]), bool)
    here[held] = True
    if not len(q["by"]) or not len(held):
        return none, none, none
    ends = ends.astype(np.int64)
    begins = np.append(0, ends)[at]
    size = ends[at] - begins
    total = int(n_words.sum())
    span = total + 1
    stops = np.cumsum(size)
    place = places[np.repeat(begins - (stops - size), size) + np.arange(int(size.sum()))].astype(np.int64)
    keys = np.repeat(held, size) * span + place  # ascending: held ascends, and so do a term's places
    possible = here[q["term"]].all(axis=1)
    windows = q["by"][possible[q["by"]]]
    firsts = q["term"][windows, 0]
    lo, hi = np.searchsorted(keys, firsts * span), np.searchsorted(keys, (firsts + 1) * span)
    per = hi - lo
    posting = np.repeat(lo - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    win = np.repeat(windows, per)
    at_place = keys[posting] % span
    doc_end = np.cumsum(n_words)
    doc = np.searchsorted(doc_end, at_place, side="right")
    start = at_place - q["offset"][win, 0]
    if slop:  # the start itself may be off by slop
        off = np.tile(np.arange(-slop, slop + 1), len(win))
        win, doc, start = (np.repeat(x, 2 * slop + 1) for x in (win, doc, start))
        start = start + off
    low, high = (doc_end - n_words)[doc], doc_end[doc] - 1
    for j in range(1, q["term"].shape[1]):
        if not len(win):
            break
        wanted = start + q["offset"][win, j]
        least, most = np.maximum(wanted - slop, low), np.minimum(wanted + slop, high)
        base = q["term"][win, j] * span
        near = np.searchsorted(keys, base + least)
        keep = (least <= most) & (near < len(keys)) & (keys[np.minimum(near, len(keys) - 1)] <= base + most)
        win, doc, start, low, high = win[keep], doc[keep], start[keep], low[keep], high[keep]
    inside = (start <= high) & (start + q["length"][win] > low)
    found = np.unique(np.stack((doc[inside], np.maximum(0, start - low)[inside], win[inside])), axis=1)
    return found[2], found[0], found[1]


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """segment, ordinal, item_ids (as strings, sorted), starts and lengths (words) of the windows found, per document that holds any."""
    ddl = "segment bigint, ordinal int, item_ids array<string>, starts array<int>, lengths array<int>"
    schema = rt.arrow_schema(ddl)
    names = [str(i) for i in phrases.items]
    shared = index.sparkSession.sparkContext.broadcast((phrases.ordered(term_counts(index, phrases)), names))

    def run(batches):
        q, names = shared.value
        for b in batches:
            out: dict[tuple[int, int], tuple[set, list, list]] = {}
            for segment, row in zip(b.column(0).to_pylist(), _rows(b, 1, 2, 3, 4), strict=True):
                n = row[0].astype(np.int64)
                for w, d, s in zip(*(x.tolist() for x in find(q, n, *row[1:], slop)), strict=True):
                    items, starts, lengths = out.setdefault((segment, d), (set(), [], []))
                    items.update(names[i] for i in q["holder"][q["ends"][w] : q["ends"][w + 1]])
                    starts.append(s)
                    lengths.append(min(int(q["length"][w]), int(n[d]) - s))
            if out:
                yield rt.to_batch(schema, [[k[0] for k in out], [k[1] for k in out], *([f(v[i]) for v in out.values()] for i, f in ((0, sorted), (1, list), (2, list)))])

    return rt.map_arrow(index.select("segment", "n_words", "terms", "ends", "places"), run, ddl)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """id, n_words, n_hit (words inside found windows), item_ids (as strings, sorted), n_items and contaminated, one row per document row."""
    index = rt.materialize(build_index(docs, id_col, text_col), "postings")
    hits = None
    for rows in blocks(benchmark, block_bytes=block_bytes):
        found = rt.materialize(search(index, Phrases(rows, window), slop), "hits")
        hits = found if hits is None else hits.unionByName(found)
    each = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "doc"))
    each = each.select("segment", "ordinal", F.col("doc.ids").alias(id_col), F.col("doc.n_words").alias("n_words"))
    if hits is None:
        none = F.array().cast("array<string>")
        out = each.select(id_col, "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"))
    else:
        out = each.join(merge_blocks(hits), ["segment", "ordinal"], "left").select(id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_items") >= min_items)


def merge_blocks(hits: DataFrame) -> DataFrame:
    """segment, ordinal, n_hit and item_ids from the hits of all blocks: items together, hit words counted once.

    What meets for a document is one row from each block.
    """
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "lengths"))))
    g = hits.groupBy("segment", "ordinal").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))

    def step(acc, x):
        end = x["starts"] + x["lengths"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["starts"]))
        return F.struct((acc["n"] + more).cast("long").alias("n"), F.greatest(acc["end"], end).cast("int").alias("end"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    return g.select("segment", "ordinal", F.aggregate("spans", zero, step)["n"].alias("n_hit"), F.array_sort("item_ids").alias("item_ids"))
