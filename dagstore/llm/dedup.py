"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures: one permutation sigma of the 32-bit universe scatters a document's shingles; a second one, pi, circularly
shifted by k, gives coordinate k: the least pi(sigma(shingle) + k * STEP mod 2**32).  Two permutations thus make all
COORDINATES coordinates.  They are cut into BANDS bands; documents equal in a band meet in its bucket.

No bucket is ever expanded into all its pairs:

1. Documents of one shingle set are one *text*, represented by the least id; copies never meet in a bucket.
2. In each bucket, HUBS texts with the most bucket-mates overall are its hubs; every member is paired with them.  The
   base of a group of near copies has the most, so one round links nearly all of the group.
3. Pairs are verified on full sets (100 * intersection >= 75 * union), and linked texts joined into components.
4. What could still be missed are pairs of non-hubs of one bucket in different components.  The texts of such buckets
   go through an exact positional prefix filter (``residual_pairs``); the few pairs that pass it are verified too.

So every pair that shares a band is either verified, within one component already, or proven not to link.  Pairs of
similarity 0.75 share no band with a chance under 1e-5 (32 bands of 4), nearer ones with a far smaller one.

Hot buckets and hubs: members stay rows, joined on the bucket key (a side that AQE may split); pairs of one hub are
salted in blocks of BLOCK members, the hub's set being repeated for each block.  In step 4 the smaller text of a pair
must share one of its rarest n / 7 shingles, the larger one of its rarest quarter; so a passage that many texts share
pairs them only where it is nearly all of the smaller one.

Words: runs without ASCII white space, A-Z lower-cased.  Set: distinct 5-word shingles, or the whole sequence of fewer
words; a null, empty or blank text has the empty set and links with nothing.  Defined results: rows with one doc_id are
one node, whatever their texts: it has the links of each, and so joins their groups; a null doc_id takes part in no link
but those of its text, and is kept only if no other document has its component; an empty table gives an empty table; other
columns, of whatever name, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt

SHINGLE = 5
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
HUBS = 4
BLOCK = 128
STEP = np.uint32(0x9E3779B1)
CACHE_WORDS = 300_000


class _Hashes(dict):
    """64-bit hashes of words, worked out once each."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()
rt.keeps(__name__, _hashes.clear)


def _mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit universe."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mix(h + w[j : j + n])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(b)
    return x ^ (x >> np.uint32(16))


SHIFTS = (np.arange(COORDINATES, dtype=np.uint32) * STEP)[:, None]


def signature(sets: np.ndarray, block: int = 512) -> np.ndarray:
    """The circulant MinHash coordinates of a non-empty set."""
    at = _permute((sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(at), block):
        np.minimum(out, _permute(at[k : k + block] + SHIFTS, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> list[int]:
    """A 64-bit key of each band and its number."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h + rows[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64).tolist()


def set_key(sets: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sets.tobytes())


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_key (128 bits, null for the empty set), n_shingles and bands of each row."""
    ddl = "doc_id bigint, set_key binary, n_shingles bigint, bands array<bigint>"
    schema = rt.arrow_schema(ddl)

    def run(batches):
        for b in rt.slices(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(t)
                out.append((i, set_key(s), len(s), bands(signature(s))) if len(s) else (i, None, 0, []))
            yield rt.to_batch(schema, list(map(list, zip(*out, strict=True))))

    return rt.map_arrow(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run, ddl)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and set (ascending hashes) of the documents whose id is among ids."""
    ddl = "doc_id bigint, set array<bigint>"
    schema = rt.arrow_schema(ddl)

    def run(batches):
        for b in rt.slices(batches):
            sets = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)), type=schema.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], schema=schema)

    wanted = docs.join(ids.distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates()
    return rt.map_arrow(wanted, run, ddl)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, id) whose sets are linked, as (a, b).  Pairs of one hub are dealt out in blocks of BLOCK.

    No side is broadcast, whatever its size: none has a bound, and the plan is the same at every size.
    """
    per = pairs.groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("salts"))
    salted = pairs.join(per, "hub").select("hub", "id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    sets = sets.hint("merge")
    hubs = per.join(sets, per.hub == sets.doc_id).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("set").alias("hub_set"))
    both = salted.join(sets, salted.id == sets.doc_id).select("hub", "salt", "id", "set").join(hubs.hint("merge"), ["hub", "salt"])
    shared = F.size(F.array_intersect("set", "hub_set")).cast("long")
    linked = both.filter(100 * shared >= 75 * (F.size("set") + F.size("hub_set") - shared))
    return linked.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every end of an edge (a, b), a < b.

    Alternates large-star and small-star steps until neither changes an edge; every step joins on ids alone and is
    written to the shared folder.
    """
    now = rt.materialize(edges.select("a", "b"), "edges")
    state = None
    while True:
        # large star: every larger neighbour of a node is joined to the node's least neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: a node and its smaller neighbours are joined to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new = rt.materialize(small, "edges")
        after = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rt.discard(now)
        now = new
        if state == after:
            break
        state = after
    # what is left is a star from each component's least id
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)


def link(docs: DataFrame, texts: DataFrame, same: DataFrame) -> DataFrame:
    """The component (id, component) of every linked representative.

    docs: doc_id, text; texts: doc_id (of the representative), bands; same: representatives (a, b) that are one node.
    """
    entries = texts.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = rt.materialize(entries.join(crowded, "key"), "members")
    degree = members.groupBy("id").agg(F.sum("m").alias("degree"))
    w = Window.partitionBy("key").orderBy(F.col("degree").desc(), "id")
    hubs = members.select("key", "id").join(degree, "id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= HUBS)
    hubs = rt.materialize(hubs.select("key", F.col("id").alias("hub")), "hubs")
    first = members.select("key", "id").join(hubs, "key").filter("id <> hub").select("hub", "id").distinct()
    first = rt.materialize(first, "pairs")
    ids = first.select(F.col("hub").alias("doc_id")).union(first.select(F.col("id").alias("doc_id")))
    sets = rt.materialize(full_sets(docs, ids), "sets")
    links = rt.materialize(verify(first, sets).union(same), "links")
    rt.discard(hubs, first)
    groups = rt.materialize(components(links), "components")

    # pairs of non-hubs of one bucket in different components
    labelled = members.filter(F.col("m") > HUBS + 1).select("key", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    open_ = rt.materialize(labelled.join(mixed, "key", "left_semi").select("id", "component").distinct(), "open")
    second = rt.materialize(residual_pairs(open_, sets), "pairs")
    more = rt.materialize(verify(second, sets), "links")
    rt.discard(members, open_, second, sets)
    if not more.isEmpty():
        old, groups = groups, rt.materialize(components(links.union(more)), "components")
        rt.discard(old)
    rt.discard(links, more)
    return groups


def residual_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (hub, id) of open_ (id, component) in different components that could be linked, by a positional prefix filter.

    Shingles are put in one order, from the rarest among these documents on.  Linked sets share a shingle within the
    first n - ceil(0.75 * n) + 1 of each; if their first common one stands at places i and j, they share at most
    min(n - i, n' - j) in all, which must reach 3 / 7 of n + n'.
    """
    own = sets.join(open_.select(F.col("id").alias("doc_id"), "component"), "doc_id").withColumn("k", F.xxhash64("set")).dropDuplicates(["doc_id", "k"])
    every = own.select(F.col("doc_id").alias("id"), "k", "component", F.size("set").alias("n"), F.explode("set").alias("h"))
    frequency = every.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id", "k").orderBy("df", "h")
    placed = every.join(frequency, "h").withColumn("at", F.row_number().over(w) - 1)
    head = placed.filter("df > 1 and at <= n - ceil(0.75 * n)").select("h", "id", "component", "n", "at")
    per = head.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("several"))
    head = rt.materialize(head.join(per.filter("several > 1").select("h", "main"), "h"), "prefixes")
    # the smaller text stands first; a shingle's largest component never meets itself
    small, large = head.filter("7 * at <= n"), head
    linkable = F.expr("x.component <> y.component and x.n <= y.n and 7 * least(x.n - x.at, y.n - y.at) >= 3 * (x.n + y.n)")

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.alias("x").join(y.alias("y"), (F.col("x.h") == F.col("y.h")) & linkable)
        return both.select(F.least("x.id", "y.id").alias("hub"), F.greatest("x.id", "y.id").alias("id"))

    other, main = "component <> main", "component = main"
    return pairs(small.filter(other), large).union(pairs(small.filter(main), large.filter(other))).distinct()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marks = rt.materialize(fingerprint(df, id_col, text_col), "marks")
    texts = marks.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    bands_of = marks.select("set_key", "doc_id", "bands").filter("set_key is not null")
    reps = texts.join(bands_of, (texts.set_key == bands_of.set_key) & (texts.rep == bands_of.doc_id)).select(texts.set_key, F.col("rep").alias("doc_id"), "bands").dropDuplicates(["set_key"])
    # an id with several texts is one node: the representatives of its texts belong together
    several = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    rows = marks.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct()
    of_id = rt.materialize(rows.join(texts.select("set_key", "rep"), "set_key", "left"), "several")
    least = of_id.groupBy("doc_id").agg(F.min("rep").alias("a"))
    same = of_id.join(least, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
    groups = link(docs, reps.select("doc_id", "bands"), same)
    rep_component = texts.join(groups, texts.rep == groups.id, "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    # and where one of its texts has no shingles, that row goes with the others
    of_rep = least.filter("a is not null").join(groups, least.a == groups.id, "left").select("doc_id", F.coalesce("component", "a").alias("component"))
    return label(marks, rep_component, of_rep)


def label(marks: DataFrame, rep_component: DataFrame, of_id: DataFrame) -> DataFrame:
    """Every row's component: by its text; a row without shingles by its id's other texts, or its own id."""
    rows = marks.select("doc_id", "set_key", "n_shingles")
    named = rows.filter("set_key is not null").join(rep_component, "set_key", "left").select("doc_id", "n_shingles", "component")
    empty = rows.filter("set_key is null").join(of_id, "doc_id", "left").select("doc_id", "n_shingles", "component")
    component = F.coalesce("component", "doc_id")
    return named.union(empty).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
