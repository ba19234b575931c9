"""Best-fit packing of documents into sequences of bounded length, after Martello-Toth reduction.

A document is its token ids and the separator id; only documents longer than a sequence are cut.  Item sizes are
integers from 1 to the capacity, so the whole instance is a histogram of at most ``capacity`` counts, whatever the
corpus holds; that histogram alone comes to the driver.  There

* ``reduce_instance`` fixes sets that dominate every alternative, class by class with their multiplicities: a full
  piece alone; an item that no other item fits alone; a pair that fills a sequence exactly; a pair where no third
  item could join; and, where no three further items fit, the pair that outweighs every two further items, or the
  fullest triple if its larger item is the largest that fits and no two items of sizes between its two fit as well;
* ``best_fit_decreasing`` packs what remains, largest class first, each into the fullest sequences that hold it.

Both give *runs* (size, first rank, count, items per sequence, first sequence, offset): the k-th item of a size has
its place by arithmetic.  Ranks within a size are dealt out without gathering a size in one task: every piece is written
with a salt of its own, counted up in its task, so repeated rows differ too; items are counted by (size, salt), the
salts' offsets summed, and rows numbered within (size, salt).

``WordTokenizer`` knows the pre-tokenisation of one kind of vocabulary; texts go whole through any other.

Defined results: a null text is the empty text, one piece of the separator alone; repeated rows are packed like
any others, as are rows with a null id; an empty table gives an empty table; other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import bisect
import codecs
import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt

CAPACITY = 4096
SEPARATOR = 1
CACHE_WORDS, CACHE_RUNS = 250_000, 150_000  # ids kept in a worker; then it starts anew
LONG_WORD = 64

#: Runs that the vocabulary's own pattern makes of plain Latin words without apostrophes.
RUN = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+| ")
#: Anything but printable Latin characters below U+0250 that lower case maps one to one; the apostrophe starts contractions.
ODD = re.compile("[^ !-&(-~\xa1-\u012f\u0131-\u024f]")


def _byte_chars() -> str:
    """The printable stand-ins of byte-level BPE: a printable byte for itself, the others from U+0100 on; a space stays."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    table = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
    return "".join(" " if b == 32 else table[b] for b in range(256))


BYTE_CHARS = _byte_chars()


class Store(dict):
    """Keys by number, and the ids of each in one buffer.  A key asked for that isn't there gets the next number and waits in new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.at, self.size, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4"), 0

    def __missing__(self, key: str) -> int:
        k = self[key] = len(self)
        self.new.append(key)
        return k

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the keys that wait, in turn."""
        n, first = len(self), len(self) - len(sizes)
        while n > len(self.at):
            self.at, self.size = np.append(self.at, np.zeros_like(self.at)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.at[first:n], self.size[first:n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.new = []

    def gather(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each key, and all ids in turn."""
        size = self.size[keys]
        ends = np.cumsum(size)
        return size, self.ids[np.repeat(self.at[keys] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _as_bytes(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", BYTE_CHARS)[0]


def _after_bar(ids: np.ndarray, bar: int) -> np.ndarray:
    return ids[1:] if len(ids) and ids[0] == bar else ids


class WordTokenizer:
    """Ids of a text as little-endian uint32 bytes, for the lower-cased word-end BPE whose tokens never cross white space.

    A text's ids are those of its words in turn; ids of words are kept.  A new word of plain Latin script needs none
    of the tokenizer's normalisation beyond lower case, so it is cut into runs of letters, single digits and runs of
    other signs, and only new runs go through the BPE model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.runs_only = Tokenizer(self.tokenizer.model)
        self.runs_only.pre_tokenizer = WhitespaceSplit()
        self.bar = self._run_ids("|")
        self.words, self.runs = Store(), self._runs()

    def _runs(self) -> Store:
        runs = Store()
        for key, ids in ((" ", []), ("|", self.bar)):
            runs[key]
            runs.add(np.array([len(ids)]), np.array(ids, "<u4"))
        return runs

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run_ids(self, run: str) -> list[int]:
        return self.runs_only.encode(_as_bytes(run), add_special_tokens=False).ids

    def _learn_runs(self) -> None:
        """Ids of new runs by one call over all of them, a bar between each two; a run that holds a bar itself goes alone."""
        new = self.runs.new
        ids = np.array(self.runs_only.encode_batch_fast([_as_bytes(" | ".join(r for r in new if "|" not in r))], add_special_tokens=False)[0].ids, "<u4")
        bars = np.flatnonzero(ids == self.bar[0])
        if not any("|" in r for r in new):
            self.runs.add(np.diff(np.concatenate(([-1], bars, [len(ids)]))) - 1, np.delete(ids, bars))
            return
        parts = iter(np.split(ids, bars))
        every = [np.array(self._run_ids(r), "<u4") if "|" in r else _after_bar(next(parts), self.bar[0]) for r in new]
        self.runs.add(np.array([len(e) for e in every]), np.concatenate(every))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = RUN.findall(" ".join(words).lower())
        keys = np.fromiter(map(self.runs.__getitem__, runs), np.int64, len(runs))
        if self.runs.new:
            self._learn_runs()
        size, ids = self.runs.gather(keys)
        done = np.concatenate(([0], np.cumsum(size)))
        return np.diff(np.concatenate(([0], done[np.flatnonzero(keys == 0)], [done[-1]]))), ids

    def _learn(self) -> None:
        new = self.words.new
        odd = {w for w in new if len(w) > LONG_WORD or ODD.search(w)} if max(map(len, new)) > LONG_WORD or ODD.search(" ".join(new)) else ()
        if not odd:
            self.words.add(*self._plain(new))
            return
        plain = [w for w in new if w not in odd]
        sizes, ids = self._plain(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, "<u4"))
        parts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        every = [np.frombuffer(self.encode(w), "<u4") if w in odd else next(parts) for w in new]
        self.words.add(np.array([len(e) for e in every]), np.concatenate(every))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words = Store()
        if len(self.runs) > CACHE_RUNS:
            self.runs = self._runs()
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        keys = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.words.new:
            self._learn()
        size, ids = self.words.gather(keys)
        ends = (4 * np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class PlainTokenizer:
    """Ids of whole texts by any vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


# fixed values: how a vocabulary must normalise and cut texts for WordTokenizer
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_words(path: str) -> bool:
    """Does the vocabulary lower-case texts and cut them as WordTokenizer does, no token crossing white space."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    cut = (found.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = cut and cut[0].get("pattern") == {"Regex": SPLIT} and cut[0].get("invert") and cut[0].get("behavior") == "Removed"
    raw = len(cut) == 2 and cut[1].get("type") == "ByteLevel" and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
    return bool(split and raw and (found.get("normalizer") or {}).get("normalizers") == NORMALIZERS and found["model"].get("end_of_word_suffix") == "</w>")


_tokenizers: dict[str, WordTokenizer | PlainTokenizer] = {}
rt.keeps(__name__, _tokenizers.clear)


def tokenizer(path: str) -> WordTokenizer | PlainTokenizer:
    """The worker's own tokenizer, kept with its words from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path) if cuts_words(path) else PlainTokenizer(path)
    return _tokenizers[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False, salts: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32; with keep_ids the ids as a binary column; with salts a column salt below that number."""
    ddl = f"{id_col} {dict(df.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids + ", salt int" * bool(salts)
    path = vocabulary or default_vocabulary()

    schema = rt.arrow_schema(ddl)

    def run(batches):
        tok, end, context = tokenizer(path), separator.to_bytes(4, "little"), TaskContext.get()
        count = context.partitionId() if context else 0
        for b in rt.slices(batches):
            out = []
            for i, raw in zip(b.column(0).to_pylist(), tok.encode_texts([t or "" for t in b.column(1).to_pylist()]), strict=True):
                raw += end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    out.append((i, k, a // 4, len(part) // 4, zlib.crc32(part), *((part,) if keep_ids else ()), *((count % salts,) if salts else ())))
                    count += 1
            yield rt.to_batch(schema, list(map(list, zip(*out, strict=True))))

    return rt.map_arrow(rt.only(df, id_col, text_col), run, ddl)


Run = tuple[int, int, int, int, int, int]  # size, first rank, count, items per sequence, first sequence, offset


class Plan:
    """Runs of placed items; counts of each size still to place."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used, self.runs, self.sequences = capacity, {s: c for s, c in counts.items() if c}, dict.fromkeys(counts, 0), [], 0

    def place(self, size: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((size, self.used[size], count, per, sequence, offset))
        self.used[size] += count
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int], times: int) -> None:
        """times sequences, each with one item of every size named (a size may be named twice)."""
        offset = 0
        for s in sizes:
            self.place(s, times, 1, self.sequences, offset)
            offset += s
        self.sequences += times


def _smallest(left: list[int], counts: dict[int, int], n: int, but: dict[int, int]) -> list[int]:
    """The n smallest items left, without those in but."""
    out: list[int] = []
    for s in left:
        take = min(n - len(out), counts[s] - but.get(s, 0))
        out += [s] * max(0, take)
        if len(out) >= n:
            break
    return out


def reduce_instance(plan: Plan) -> int:
    """Fixes dominating sets until no class gives one; returns the number of sequences fixed."""
    before, again = plan.sequences, True
    while again:
        again = False
        for big in sorted(plan.left, reverse=True):
            while big in plan.left:
                fixed = _dominating(plan, big)
                if not fixed:
                    break
                need: dict[int, int] = {}
                for s in fixed:
                    need[s] = need.get(s, 0) + 1
                times = min(plan.left[s] // k for s, k in need.items())
                plan.fix(fixed, times)
                again = True
    return plan.sequences - before


def _dominating(plan: Plan, big: int) -> list[int] | None:
    """A set with the item big that dominates every feasible set with it, or None if none is proven."""
    room, counts = plan.capacity - big, plan.left
    sizes = sorted(counts)
    few = _smallest(sizes, counts, 3, {big: 1})
    if not few or few[0] > room:
        return [big]
    if room in counts and (room != big or counts[big] > 1):
        return [big, room]
    at = bisect.bisect_right(sizes, room) - 1
    while sizes[at] == big and counts[big] < 2:
        at -= 1
    best = sizes[at]
    if len(few) < 2 or few[0] + few[1] > room:
        return [big, best]
    if len(few) > 2 and few[0] + few[1] + few[2] <= room:
        return None  # three more items fit: no set is proven to dominate
    total, pair = _best_pair(sizes, counts, room, big)
    if best >= total:
        return [big, best]
    # the fullest triple dominates if its larger item is the largest that fits and no two items of sizes between fit
    between = _smallest(sizes[bisect.bisect_right(sizes, min(pair)) : bisect.bisect_left(sizes, best)], counts, 2, {big: 1})
    return [big, *pair] if max(pair) == best and (len(between) < 2 or sum(between) > room) else None


def _best_pair(sizes: list[int], counts: dict[int, int], room: int, big: int) -> tuple[int, list[int]]:
    """The two further items of largest sum within room."""
    left = lambda s: counts[s] - (s == big)
    lo, hi, total, pair = 0, len(sizes) - 1, -1, []
    while lo <= hi:
        a, b = sizes[lo], sizes[hi]
        if a + b > room or not left(b):
            hi -= 1
        elif not left(a) or (a == b and left(a) < 2):
            lo += 1
        else:
            if a + b >= total:
                total, pair = a + b, [b, a]
            lo += 1
    return total, pair


def best_fit_decreasing(plan: Plan) -> None:
    """Each class, largest first, into the fullest sequences that hold it; then into new ones."""
    rooms: dict[int, list[list[int]]] = {}  # room left -> [first sequence, number of sequences]
    order: list[int] = []

    def open_(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append([first, n])

    for size in sorted(plan.left, reverse=True):
        while size in plan.left:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                room, first, n = plan.capacity, plan.sequences, -(-plan.left[size] // (plan.capacity // size))
                plan.sequences += n
            else:
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            per, count = room // size, plan.left[size]
            whole = min(n, count // per)
            offset = plan.capacity - room
            if whole:
                plan.place(size, whole * per, per, first, offset)
                open_(room - per * size, first, whole)
            rest = count - whole * per
            if whole < n and rest:
                plan.place(size, rest, rest, first + whole, offset)
                open_(room - rest * size, first + whole, 1)
                whole += 1
            open_(room, first + whole, n - whole)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The runs of a packing of counts[size] items of each size, and its number of sequences."""
    plan = Plan(counts, capacity)
    reduce_instance(plan)
    best_fit_decreasing(plan)
    return plan.runs, plan.sequences


def assign(pieces: DataFrame, runs: list[Run]) -> DataFrame:
    """pieces without salt, with sequence_id and offset: each item by its rank within its size (columns length and salt)."""
    w = Window.partitionBy("length").orderBy("salt")
    ahead = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("length", "salt", (F.sum("n").over(w) - F.col("n")).alias("ahead"))
    names = [c for c in pieces.columns if c != "salt"]
    order = [F.col(f"`{c}`") for c in names if c != "ids"]
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(ahead, ["length", "salt"])
    # at most a few runs for each of the capacity's sizes, whatever the corpus holds
    runs = sorted(runs)
    table = [np.array([r[k] for r in runs], np.int64) for k in range(6)]
    ddl = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != "salt") + ", sequence_id bigint, offset bigint"
    where = names.index("length")
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    schema = rt.arrow_schema(ddl)

    def run(batches):
        import pyarrow as pa

        size, first, _, per, sequence, offset = shared.value
        keys = size << 44 | first
        for b in batches:
            length = b.column(where).to_numpy().astype(np.int64)
            rank = b.column(len(names)).to_numpy().astype(np.int64)
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            k = rank - first[at]
            new = [sequence[at] + k // per[at], offset[at] + k % per[at] * length]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(b.columns[: len(names)], schema, strict=False)], *map(pa.array, new)], schema=schema)

    cols = [*[F.col(f"`{c}`") for c in names], F.col("row") + F.col("ahead")]
    return rt.map_arrow(ranked.select(*cols), run, ddl)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: tokenize(), then sequence_id and offset."""
    salts = max(2, rt.partitions(df.sparkSession))
    id_ = "doc_id" if id_col.lower() in ("row", "ahead", "n") else id_col  # names of our own
    docs = df.select(F.col(f"`{id_col}`").alias(id_), F.col(f"`{text_col}`").alias("text"))
    pieces = rt.materialize(tokenize(docs, id_, "text", vocabulary, capacity, separator, keep_ids, salts), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    runs, _ = solve(counts, capacity)
    return assign(pieces, runs).withColumnRenamed(id_, id_col)
