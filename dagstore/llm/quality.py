"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE words.  Every passage is encoded by language-neutral features: shares of
character classes and of pairs of classes, word lengths, capitals, repeated and adjacent equal words.  A hidden layer
embeds each passage; gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted
sum of the embeddings is scored by a logistic unit.  All weights are learned together from the documents' labels.

Training uses at most SAMPLE labelled documents, those with the least hash of their id, and of each at most PASSAGES
passages spread evenly over its whole text (the documented bounds of what comes to the driver); the passes over them are
EPOCHS, however many there are.  Every passage of every whole text is scored.

Defined results: a null or empty text is one empty passage, scored like any other; where nothing can be learned (no
labels, or one class alone) every score is the share of label 1, 0.5 without labels; several labels of a document
count as their mean rounded; of training rows of one id the least text counts; rows with a null id are scored, not
learned from; repeated rows repeat; an empty table gives an empty table; other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt
from dagstore.llm.langid import training_rows

PASSAGE = 48
SAMPLE = 4000
PASSAGES = 64
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY = 150, 0.02, 1e-4

# character classes: white space, lower, upper, digit, stop or comma, bar, other sign, quote or dash, beyond ASCII
CLASSES = 9


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.int64)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[97:123], t[65:91], t[48:58], t[128:] = 1, 2, 3, 8
    t[[ord(c) for c in ".,;:?"]] = 4
    t[ord("|")] = 5
    t[[ord(c) for c in "'\"()-"]] = 7
    return t


TABLE = _class_table()
FEATURES = CLASSES + CLASSES * CLASSES + 8


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (passages, FEATURES), and the number of passages of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    cls = TABLE[data]
    size = np.array([len(r) + 1 for r in raws])
    doc_of_byte = np.repeat(np.arange(len(raws)), size)
    space = cls == 0
    begins = ~space & np.append(True, space[:-1] | (np.diff(doc_of_byte) > 0))
    at = np.flatnonzero(begins)
    word_doc = doc_of_byte[at]
    n_words = np.bincount(word_doc, minlength=len(raws))
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(per_doc) - per_doc
    word_in_doc = np.arange(len(at)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    word_passage = first[word_doc] + word_in_doc // PASSAGE
    total = int(per_doc.sum())
    # a byte is in the passage of the last word begun in its document, or the document's first
    begun = np.cumsum(begins) - 1
    passage = np.where((begun >= 0) & (word_doc[np.maximum(begun, 0)] == doc_of_byte), word_passage[np.maximum(begun, 0)], first[doc_of_byte]) if len(at) else first[doc_of_byte]
    chars = np.bincount(passage, minlength=total).astype(float)
    x = np.zeros((total, FEATURES))
    x[:, :CLASSES] = np.bincount(passage * CLASSES + cls, minlength=total * CLASSES).reshape(total, CLASSES) / np.maximum(1, chars)[:, None]
    pair = (passage[1:] * CLASSES * CLASSES + cls[:-1] * CLASSES + cls[1:])[doc_of_byte[1:] == doc_of_byte[:-1]]
    x[:, CLASSES : CLASSES + CLASSES**2] = np.bincount(pair, minlength=total * CLASSES**2).reshape(total, -1) / np.maximum(1, chars)[:, None]
    if len(at):
        letter = (data | np.where(cls == 2, 32, 0)).astype(np.uint64)
        in_word = np.where(space, np.uint64(0), (letter + np.uint64(1)) * _powers(len(data), at))
        code = np.add.reduceat(in_word, at)
        length = np.add.reduceat((~space & (cls != 8)).astype(np.int64) + (data >= 192), at).astype(float)
        words = np.bincount(word_passage, minlength=total).astype(float)
        some = np.maximum(1, words)
        same = np.append(False, (code[1:] == code[:-1]) & (word_passage[1:] == word_passage[:-1]))
        order = np.lexsort((code, word_passage))
        new = np.append(True, (code[order][1:] != code[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1]))
        caps = np.add.reduceat((cls == 2).astype(np.int64), at)
        signs = np.add.reduceat(((cls == 6) | (cls == 5)).astype(np.int64), at)
        share = lambda flag: np.bincount(word_passage, flag, total) / some
        x[:, -8] = words / PASSAGE
        x[:, -7] = share(length) / 10
        x[:, -6] = share((length - (share(length)[word_passage])) ** 2) / 30
        x[:, -5] = share(same)
        x[:, -4] = np.bincount(word_passage[order], new, total) / some
        x[:, -3] = share((caps >= 2) & (caps >= length * 0.5))
        x[:, -2] = share(signs > 0)
        x[:, -1] = share(length >= 16)
    return x, per_doc


def _powers(n: int, at: np.ndarray) -> np.ndarray:
    """Odd multipliers by place in the word."""
    place = np.arange(n) - np.repeat(np.append(0, at), np.diff(np.concatenate(([0], at, [n]))))
    mult = np.cumprod(np.full(64, 6364136223846793005, np.uint64))
    return mult[place & 63] + place.astype(np.uint64)


class Attention:
    """The model; bags are runs of rows of x with the given lengths."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(seed: int = 7) -> dict[str, np.ndarray]:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        return {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.w, np.cumsum(n) - n
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = ((t * g) @ w["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        attention = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(attention[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip((z @ w["c"])[:, 0] + w["d"][0], -30, 30)))
        return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "p": p, "at": at}

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, n)
        dp = ((f["p"] - y) / len(y))[:, None]
        dz = np.repeat(dp @ w["c"].T, n, axis=0)
        s = (dz * f["h"]).sum(axis=1)
        de = (f["attention"] * (s - np.repeat(np.add.reduceat(f["attention"] * s, f["at"]), n)))[:, None]
        dtg = de @ w["a"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["attention"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dp, "d": dp.sum(axis=0)}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over shuffled batches of bags, in a fixed order."""
        r = np.random.default_rng(11)
        m, v, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        at, size = np.cumsum(n) - n, 256
        for epoch in range(epochs):
            order = r.permutation(len(n))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in range(0, len(n), size):
                bag = order[k : k + size]
                rows = np.repeat(at[bag] - (np.cumsum(n[bag]) - n[bag]), n[bag]) + np.arange(n[bag].sum())
                step += 1
                for name, d in self.gradient(x[rows], n[bag], y[bag]).items():
                    d = d + DECAY * self.w[name]
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    self.w[name] = self.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "label", passages: int = PASSAGES) -> dict:
    """Weights from rows (text, label 0/1), a bounded sample; at most passages passages of each come to the driver."""
    ddl = "label int, n int, x binary"
    schema = rt.arrow_schema(ddl)

    def run(batches):
        for b in rt.slices(batches):
            labels, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            x, n = encode(texts)
            bags = [x[e - k : e][np.arange(min(k, passages)) * k // min(k, passages)] for e, k in zip(np.cumsum(n), n, strict=True)]
            yield rt.to_batch(schema, [labels, [len(g) for g in bags], [g.astype(np.float32).tobytes() for g in bags]])

    rows = rt.map_arrow(labelled.select(F.col(label_col).cast("int").alias("label"), text_col), run, ddl).toLocalIterator()
    bags: list[np.ndarray] = []
    y: list[int] = []
    for r in rows:
        bags.append(np.frombuffer(r[2], np.float32).reshape(r[1], FEATURES))
        y.append(r[0])
    share = sum(y) / len(y) if y else 0.5
    if share in (0, 1) or not y:
        return {"share": share}
    order = sorted(range(len(bags)), key=lambda k: (bags[k].tobytes(), y[k]))  # whatever order the rows came in
    x, n, y_ = np.concatenate([bags[k] for k in order]), np.array([len(bags[k]) for k in order]), np.array([y[k] for k in order], float)
    bags.clear()
    mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-3
    model = Attention(Attention.start())
    model.fit(np.clip((x - mean) / scale, -8, 8).astype(np.float32), n, y_)
    return {"share": share, "mean": mean, "scale": scale, "weights": model.w}


def score_texts(texts: list[str | None], model: dict) -> list[float]:
    if "weights" not in model:
        return [float(model["share"])] * len(texts)
    x, n = encode(texts)
    return Attention(model["weights"]).forward(np.clip((x - model["mean"]) / model["scale"], -8, 8), n)["p"].tolist()


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """id and score of every row of docs; learned from the labels whose id meets train (a condition on the id column)."""
    model = learn(training_rows(docs, labels, label_col, train, id_col, text_col, bound))
    return score(docs, model, id_col, text_col)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ddl = f"{id_col} {dict(docs.dtypes)[id_col]}, score double"
    schema, shared = rt.arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in rt.slices(batches, 64):
            yield rt.to_batch(schema, [b.column(0).to_pylist(), score_texts(b.column(1).to_pylist(), shared.value)])

    return rt.map_arrow(rt.only(docs, id_col, text_col), run, ddl)
