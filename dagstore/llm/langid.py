"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A profile is the PROFILE most frequent character n-grams (1 to 3 letters, words padded by blanks) in rank order.  A
language's profile adds up the counts over its labelled documents; a document's profile comes from its whole text.  The distance to a language is the sum, over the document's n-grams, of how far each is out of place
in the language's profile (PROFILE for one that it lacks); the nearest language is predicted, ties by name.

``keep_known`` learns profiles and limits from every labelled document.  ``train`` and ``identify`` use at most SAMPLE
documents of each language, those with the least hash of their id; the sample is the only bounded part, and every text
is scored whole.  ``score`` is the nearest language's margin: second distance over the
sum of the two nearest (0.5: no preference; 1: alone or an exact match).

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything where nothing was
learned; documents with a null lang are never learned from; of training rows of one id and lang the least text counts;
rows with a null id are predicted, not learned from; repeated rows repeat; an empty table gives an empty table; other
columns, of whatever name, don't matter.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt

PROFILE = 300
SAMPLE = 3000
UNKNOWN = "und"
SIGMAS = 4  # standard deviations above the mean distance of labelled texts from which a text is like no language
HELD = 1 << 18  # n-grams whose counts a task holds before they go out, whatever alphabets its texts are in
LEAST = 30  # labelled texts and pieces of a length from which its distances are judged
PIECES = (1, 2, 4, 8, 16, 32)  # words of the pieces of labelled texts that show how far short texts lie
_BITS = 18  # all letters of Unicode, numbered, take no more

_numbers: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """The number of every code point among the letters, in their order, from 1; 0 for what is no letter."""
    global _numbers
    if _numbers is None:
        _numbers = np.zeros(sys.maxunicode + 1, np.int64)
        letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
        assert len(letters) < 1 << _BITS
        _numbers[letters] = np.arange(1, len(letters) + 1)
    return _numbers


def ngrams(text: str | None) -> np.ndarray:
    """Keys of all 1- to 3-grams of the words of a text, with repetition."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([0], letter_table()[codes], [0]))
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    three = (a << 2 * _BITS | b << _BITS | c)[b != 0]
    two = codes[:-1] << _BITS | codes[1:]
    return np.concatenate((codes[codes != 0], two | 1 << 60, three | 1 << 61))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys in rank order, ties by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


def profile(text: str | None, size: int = PROFILE) -> np.ndarray:
    keys = np.sort(ngrams(text))
    if not len(keys):
        return keys
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    if len(keys) > 4 * size:  # the counts of the most frequent decide, ties included
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return ranked(keys, counts, size)


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.every = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(self.every) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            p = np.array(profiles[lang], np.int64)
            self.rank[np.searchsorted(self.every, p), j] = np.arange(len(p))

    def distances(self, p: np.ndarray) -> np.ndarray:
        """Of a document's profile to every language's."""
        at = np.searchsorted(self.every, p)
        at = np.where((at < len(self.every)) & (np.append(self.every, 0)[at] == p), at, len(self.every))
        rank = self.rank[at]
        return np.where(rank < 0, self.size, np.abs(rank - np.arange(len(p))[:, None])).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the distance as a share of the largest possible."""
        p = profile(text, self.size)
        if not len(p) or not self.langs:
            return UNKNOWN, 0.0, 1.0
        d = self.distances(p)
        order = np.argsort(d, kind="stable")
        near, most = float(d[order[0]]), float(self.size * len(p))
        second = float(d[order[1]]) if len(d) > 1 else most
        return self.langs[order[0]], second / (near + second) if near + second else 1.0, near / most

    def distance(self, text: str | None) -> tuple[int, float]:
        """The size of a text's profile (0 without a letter) and the nearest language's distance as a share of the largest."""
        p = profile(text, self.size)
        if not len(p) or not self.langs:
            return 0, 1.0
        return len(p), float(self.distances(p).min()) / (self.size * len(p))


class Limits:
    """How far a text may lie from every language: SIGMAS above the mean of labelled texts, more where short texts lie farther.

    sums: log2 size of a profile (0: whole labelled texts of any size) -> number, sum and sum of squares of distances.
    With fewer than LEAST labelled texts max_distance alone holds; it bounds every limit.
    """

    def __init__(self, sums: dict[int, tuple[int, float, float]], max_distance: float):
        found = {k: min(max_distance, x / n + SIGMAS * max(0.0, xx / n - (x / n) ** 2) ** 0.5) for k, (n, x, xx) in sums.items() if n >= LEAST}
        self.least = found.pop(0, max_distance)
        self.by_size = found

    def __call__(self, size: int) -> float:
        return max(self.least, self.by_size.get(int(size).bit_length(), 0.0))


def sample(df: DataFrame, by: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """by and id of at most bound ids of each value of by: those with the least hash; null ids are left out.

    A threshold on the hash, set from the counts, comes first, so that only about twice the bound is ever sorted.
    """
    df = only_distinct(df, by, id_col)
    n = rt.materialize(df.groupBy("by").agg(F.count(F.lit(1)).alias("n")), "counts")  # its size is known: no shuffle by what may be a hot value
    hashed = df.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).join(n, "by").filter(F.col("h") < (F.lit(1 << 30) * F.lit(2.0 * bound) / F.col("n")))
    w = Window.partitionBy("by").orderBy("h", "id")
    return hashed.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= bound).select(F.col("by").alias(by), F.col("id").alias(id_col))


def only_distinct(df: DataFrame, by: str, id_col: str) -> DataFrame:
    return df.select(F.col(f"`{by}`").alias("by"), F.col(f"`{id_col}`").alias("id")).filter("id is not null").distinct()


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, train: Column | None, id_col: str, text_col: str, bound: int) -> DataFrame:
    """label (0/1) and text of at most bound labelled documents whose id meets train (a condition on the id column).

    Several labels of an id count as their mean rounded; of its texts the least stands for it.
    """
    rows = rt.only(labels, id_col, label_col).dropna()
    if train is not None:
        rows = rows.filter(train)
    one = rt.materialize(rows.groupBy(id_col).agg(F.round(F.avg(label_col)).cast("int").alias("label")), "labels")
    chosen = sample(one.select(F.lit(0).alias("all"), F.col(f"`{id_col}`").alias("id")), "all", bound, "id")
    found = rt.materialize(one.withColumnRenamed(id_col, "id").join(chosen.select("id"), "id"), "sample")  # at most bound rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(found), "id")
    return texts.groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language of docs; at most size n-grams of each come to the driver."""

    def run(batches):
        sums: dict[str, dict[int, int]] = {}

        def out():
            for lang, own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "key", "n"])
            sums.clear()

        for b in rt.slices(batches):
            langs = np.array(b.column(0).to_pylist(), object)
            texts = np.array(b.column(1).to_pylist(), object)
            for lang in set(langs):
                keys = np.concatenate([ngrams(t) for t in texts[langs == lang]])
                keys, counts = np.unique(keys, return_counts=True)
                own = sums.setdefault(lang, {})
                for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                    own[k] = own.get(k, 0) + c
            if sum(map(len, sums.values())) > HELD:
                yield from out()
        yield from out()

    pairs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rt.map_arrow(pairs, run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= size).select("lang", "key", "k").collect():
        out.setdefault(r[0], []).append((r[2], r[1]))
    return {lang: [key for _, key in sorted(found)] for lang, found in out.items()}


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, bound: int = SAMPLE) -> DataFrame:
    """id, lang_pred, score and distance (0 to 1), one row per row of docs; profiles learned from training's rows."""
    return score(docs, train(training, id_col, text_col, lang_col, size, bound), id_col, text_col, size)


def train(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, bound: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles learned from a bounded sample of the labelled rows of training."""
    return learn(_labelled(training, id_col, text_col, lang_col, bound), lang_col, text_col, size)


def _labelled(training: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int) -> DataFrame:
    labelled = rt.only(training, id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = rt.materialize(sample(labelled.select(id_col, lang_col), lang_col, bound, id_col), "sample")  # bound ids of each language
    return labelled.join(chosen, [id_col, lang_col], "left_semi").groupBy(id_col, lang_col).agg(F.min(text_col).alias(text_col))


def _every_labelled(training: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang and text of all labelled documents; only texts of an id and lang that repeat are shuffled, for the least."""
    rows = training.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = rows.select("id", "lang").dropna().groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n"))
    many = rt.materialize(counts.filter("n > 1").select("id", "lang"), "repeated")
    labelled = rows.dropna()
    again = labelled.join(many, ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    return labelled.join(many, ["id", "lang"], "left_anti").unionByName(rt.materialize(again, "least"))


def limits(docs: DataFrame, profiles: dict[str, list[int]], max_distance: float, text_col: str = "text") -> Limits:
    """From the distances of docs' texts and of pieces from their middle; a few sums a size come to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        model, sums = Classifier(shared.value), {}
        for b in rt.slices(batches):
            for text in b.column(0).to_pylist():
                words = text.split()
                half = len(words) // 2
                for k, part in enumerate((text, *(" ".join(words[half : half + n]) for n in PIECES if half + n < len(words)))):
                    size, x = model.distance(part)
                    for key in (size.bit_length(), 0)[: 1 + (k == 0)] if size else ():
                        own = sums.setdefault(key, [0, 0.0, 0.0])
                        own[0], own[1], own[2] = own[0] + 1, own[1] + x, own[2] + x * x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([v[i] for v in sums.values()], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64())))], names=["size", "n", "x", "xx"])

    found = rt.map_arrow(docs.select(text_col), run, "size int, n bigint, x double, xx double").groupBy("size").agg(F.sum("n"), F.sum("x"), F.sum("xx"))
    return Limits({r[0]: (r[1], r[2], r[3]) for r in found.collect()}, max_distance)


def keep_known(docs: DataFrame, training: DataFrame, max_distance: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that have letters and are about as near to a learned language as the labelled rows.

    What is too far is told by Limits; max_distance (0 to 1) is too far for any text.
    """
    labelled = _every_labelled(training, id_col, text_col, lang_col)
    profiles = learn(labelled)
    limit = limits(labelled, profiles, max_distance)
    shared = docs.sparkSession.sparkContext.broadcast((profiles, limit))

    def keep():
        profiles, limit = shared.value
        model = Classifier(profiles)

        def known(text: str | None) -> bool:
            size, distance = model.distance(text)
            return size > 0 and (distance < limit(size) or distance == 0)

        return lambda texts: [known(t) for t in texts]

    return rt.filter_rows(docs, text_col, keep)


def score(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    ddl = f"{id_col} {dict(docs.dtypes)[id_col]}, lang_pred string, score double, distance double"
    schema = rt.arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # size n-grams of each language

    def run(batches):
        model = Classifier(shared.value, size)
        for b in rt.slices(batches):
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            yield rt.to_batch(schema, [b.column(0).to_pylist(), *([list(x) for x in zip(*found, strict=True)] or [[], [], []])])

    return rt.map_arrow(rt.only(docs, id_col, text_col), run, ddl)
