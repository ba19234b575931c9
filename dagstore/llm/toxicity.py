"""Toxicity by a weighted finite-state pattern grammar.

A document's words become symbols, clause by clause, by a lexical transducer: a deterministic automaton over letters
whose accepting states hold learned weights (an entry is a whole word or a stem, which accepts every longer word; the
longest entry decides) rewrites insulting words to INSULT with their weight; closed-class words become THREAT, TARGET
(a person), NOT and SAID, any other word OTHER.  Four weighted transducers over these symbols are composed into one
machine, state by state and arc by arc:

* **negation** rewrites a match within REACH symbols after NOT to a negated one;
* **reported speech** rewrites any other match within REACH after SAID to a reported one;
* **target** rewrites a match with a TARGET within REACH before or after it to an aimed one.  It is nondeterministic,
  guessing what comes after the match, and only the path that guessed right is accepted;
* **pattern** accepts a clause by one of its matches, with the weights NEGATED, REPORTED and AIMED as it was rewritten.
  Threats that nobody is the target of, or that are denied or told, are passed over: such words have other uses.  So a
  clause has one accepted path per match.

A clause scores, for every kind of match, the sum over accepted paths of the product of their weights (the real
semiring).  What a document is scored by are these sums over its matched clauses, how many clauses match, and their
share of all clauses and words, put through a logistic unit.  A word alone never counts: it does as the match of its
clause, whose other words decide the kind.  An insult without a target is a match too, as most planted ones are; how
much each kind counts the unit learns.

The closed-class word lists are given; the insult lexicon, with its weights, and the logistic unit are learned from at
most SAMPLE labelled documents (those with the least hash of their id), exact copies counted once.  A lexicon entry
makes up 1 / DENSITY of the words of each of at least 0.5 % of the toxic documents, so there are at most 1400 / 0.005
entries whatever the corpus holds; every whole text is scored.

Defined results: a null or empty text has no clauses and the score of none; without labels, or with one class alone,
nothing is learned and every score is the share of label 1 (0 without labels); several labels of an id count as their
mean rounded; of training rows of one id the least text counts; rows with a null id are scored, not learned from;
repeated rows repeat; an empty table gives an empty table; other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt
from dagstore.llm.langid import training_rows

SAMPLE = 12000
STEM = (3, 4, 5, 6, 7, 8)  # lengths of stems that are weighed beside whole words
MIN_RATIO = 6.0  # times likelier in toxic documents than in others
MIN_SIGMA = 3.0  # standard errors of the log of that ratio by which it must differ from 0
DENSITY = 200  # an entry marks a training document that holds it at least once in so many words
REACH = 3  # symbols that a negation, a target or a verb of speech reaches over
NEGATED, REPORTED, AIMED = 0.5, 0.7, 1.5

# fixed values: closed classes of the four languages
TARGETS = set("you your yours you're youre u ya yourself he she him her his hers they them their we us our du dich dir dein deine ihr euch euer sie ihn ihm er tu te toi ton ta tes vous votre vos il elle lui leur tú ti usted ustedes vosotros él ella ellos ellas".split())
THREATS = set("kill kills killed killing hurt hurts destroy murder shoot stab beat burn töten töte umbringen schlagen vernichten tuer tue tuerai frapper détruire mourir matar mataré golpear destruir morir".split())
NEGATIONS = set("not no never nobody none neither nor cannot don't dont isn't isnt aren't wasn't won't nicht kein keine keinen nie niemals ne pas jamais aucun aucune ni nunca jamás ningún ninguna tampoco".split())
REPORTS = set("said says say saying wrote writes told tells claimed claims called calls quoted quote according sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split())

WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[.!?;\n]+")
INSULT, THREAT, TARGET, NOT, SAID, OTHER, END = range(7)
HIT = -1  # written for the match that accepts a clause

#: Kinds of match: what each word is, whether it is aimed, and whether it is negated or reported.
KINDS = ("bare insult", "aimed insult", "turned insult", "aimed threat", "bare threat")
FEATURES = len(KINDS) - 1 + 4

Symbol = int | tuple[int, bool, int]  # a match: INSULT or THREAT, aimed, and what turned it: NOT, SAID or 0
Arc = tuple[int, Symbol, float]  # next state, output, weight


class Transducer:
    """States numbered from 0, the start; arcs[state][symbol]: the arcs that read it; accepting states, each with a name."""

    def __init__(self, arcs: list[dict[Symbol, list[Arc]]], accepting: dict[int, object]):
        self.arcs, self.accepting = arcs, accepting

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes.  Only states that can be reached are made."""
        number, todo, arcs, accepting = {(0, 0): 0}, [(0, 0)], [], {}
        while todo:
            p, q = state = todo.pop(0)
            own: dict[Symbol, list[Arc]] = {}
            for symbol, choices in self.arcs[p].items():
                for p2, middle, weight in choices:
                    for q2, out, more in other.arcs[q].get(middle, ()):
                        nxt = (p2, q2)
                        if nxt not in number:
                            number[nxt] = len(number)
                            todo.append(nxt)
                        own.setdefault(symbol, []).append((number[nxt], out, weight * more))
            arcs.append(own)
            if p in self.accepting and q in other.accepting:
                accepting[number[state]] = other.accepting[q]
        return Transducer(arcs, accepting)


def _marker(trigger: int) -> Transducer:
    """Rewrites matches within REACH symbols after the trigger to ones it turned; state k: k symbols of reach left."""
    arcs: list[dict[Symbol, list[Arc]]] = []
    for left in range(REACH + 1):
        after = max(0, left - 1)
        own: dict[Symbol, list[Arc]] = {s: [(REACH if s == trigger else after, s, 1.0)] for s in (TARGET, NOT, SAID, OTHER)}
        for word in (INSULT, THREAT):
            plain, turned = (word, False, 0), (word, False, trigger)
            own[word] = own[plain] = [(after, turned if left else plain, 1.0)]
            if trigger != NOT:  # read after negation: a match is turned once
                own[word, False, NOT] = [(after, (word, False, NOT), 1.0)]
        arcs.append(own)
    return Transducer(arcs, dict.fromkeys(range(REACH + 1)))


def _target() -> Transducer:
    """Marks matches near a TARGET as aimed.

    A state holds how far a target before reaches, in how many symbols one must come, and for how many none may.
    """
    states = [(b, e, f) for b in range(REACH + 1) for e in range(REACH + 1) for f in range(REACH + 1)]
    number = {s: k for k, s in enumerate(states)}
    arcs: list[dict[Symbol, list[Arc]]] = []
    for before, expect, forbid in states:
        own: dict[Symbol, list[Arc]] = {}
        down = lambda n: max(0, n - 1)
        if not forbid:
            own[TARGET] = [(number[REACH, 0, 0], TARGET, 1.0)]
        if expect != 1:  # else the target was to come now
            for s in (NOT, SAID, OTHER):
                own[s] = [(number[down(before), down(expect), down(forbid)], s, 1.0)]
            for word in (INSULT, THREAT):
                for turned in (0, NOT, SAID):
                    aimed, bare = (word, True, turned), (word, False, turned)
                    if before:
                        own[bare] = [(number[down(before), down(expect), down(forbid)], aimed, 1.0)]
                    else:
                        own[bare] = [(number[0, min(REACH, down(expect) or REACH), down(forbid)], aimed, 1.0)]
                        own[bare].append((number[0, down(expect), REACH], bare, 1.0))
        arcs.append(own)
    return Transducer(arcs, {number[s]: None for s in states if not s[1]})


def kind_of(match: tuple[int, bool, int]) -> int:
    word, aimed, turned = match
    if word == INSULT:
        return 2 if turned else 1 if aimed else 0
    return 3 if aimed and not turned else 4


def _pattern() -> Transducer:
    """Accepts by one match: state 0 has none yet, state 1 + k one of kind k; matches that are passed over cost nothing."""
    every = [(w, a, t) for w in (INSULT, THREAT) for a in (False, True) for t in (0, NOT, SAID)]
    arcs: list[dict[Symbol, list[Arc]]] = []
    for state in range(len(KINDS)):
        own: dict[Symbol, list[Arc]] = {s: [(state, s, 1.0)] for s in (TARGET, NOT, SAID, OTHER, *every)}
        for m in every if state == 0 else ():
            if kind_of(m) < len(KINDS) - 1:
                own[m].append((1 + kind_of(m), HIT, (AIMED if m[1] else 1.0) * {NOT: NEGATED, SAID: REPORTED}.get(m[2], 1.0)))
        arcs.append(own)
    return Transducer(arcs, {1 + k: k for k in range(len(KINDS) - 1)})


class Lexicon:
    """The entries as a deterministic automaton over letters; the longest accepting one decides."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        for entries, at in ((words, self.word), (stems, self.stem)):
            for entry, weight in entries.items():
                state = 0
                for letter in entry:
                    if letter not in self.next[state]:
                        self.next.append({})
                        self.next[state][letter] = len(self.next) - 1
                    state = self.next[state][letter]
                at[state] = weight

    def weight(self, word: str) -> float:
        state, found = 0, 0.0
        for letter in word:
            state = self.next[state].get(letter, -1)
            if state < 0:
                return found
            found = self.stem.get(state, found)
        return self.word.get(state, found)


_machine: list[Transducer] = []


def machine() -> Transducer:
    if not _machine:
        _machine.append(_marker(NOT).then(_marker(SAID)).then(_target()).then(_pattern()))
    return _machine[0]


class Grammar:
    """The lexical transducer and the composed machine; what each word and each run of symbols gives is worked out once."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], limit: int = 200_000):
        self.lexicon, self.machine, self.limit = Lexicon(words, stems), machine(), limit
        self.symbols: dict[str, tuple[int, float]] = {}
        self.known: dict[tuple, list[float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        got = self.symbols.get(word)
        if got is None:
            w = word.lower()
            weight = self.lexicon.weight(w)
            kind = END if w[0] in ".!?;\n" else INSULT if weight > 0 else THREAT if w in THREATS else TARGET if w in TARGETS else NOT if w in NEGATIONS else SAID if w in REPORTS else OTHER
            if len(self.symbols) >= self.limit:
                self.symbols.clear()
            got = self.symbols[word] = (kind, weight if kind == INSULT else 1.0)
        return got

    def paths(self, clause: Iterable[tuple[int, float]]) -> list[float]:
        """For each kind, the sum of the weights of the paths that accept a clause (symbol, weight) by a match of it."""
        now = {0: 1.0}
        for symbol, weight in clause:
            after: dict[int, float] = {}
            for state, sum_ in now.items():
                for nxt, out, factor in self.machine.arcs[state].get(symbol, ()):
                    after[nxt] = after.get(nxt, 0.0) + sum_ * factor * (weight if out == HIT else 1.0)
            now = after
        out = [0.0] * (len(KINDS) - 1)
        for state, sum_ in now.items():
            if state in self.machine.accepting:
                out[self.machine.accepting[state]] += sum_
        return out

    def clause(self, symbols: list[tuple[int, float]]) -> list[float]:
        """paths() of a clause, once for each that differs within reach of its matches."""
        hits = [k for k, s in enumerate(symbols) if s[0] <= THREAT]
        key = tuple(symbols[max(0, hits[0] - REACH) : hits[-1] + REACH + 1])
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            got = self.known[key] = self.paths(key)
        return got

    def clauses(self, text: str | None) -> tuple[list[list[float]], int, int]:
        """What each clause with a match sums to, the number of all clauses, and of words."""
        words, get = WORD.findall(text or ""), self.symbols.get
        found = [get(w) or self.symbol(w) for w in words]
        ends = [k for k, s in enumerate(found) if s[0] == END]
        hits = [k for k, s in enumerate(found) if s[0] <= THREAT]
        out, done = [], -1
        for k in hits:
            if k > done:
                at = bisect.bisect_left(ends, k)
                begin, done = ends[at - 1] + 1 if at else 0, ends[at] if at < len(ends) else len(found)
                out.append(self.clause(found[begin:done]))
        return [c for c in out if any(c)], len(ends) + 1, len(found) - len(ends)

    def features(self, text: str | None) -> list[float]:
        found, clauses, words = self.clauses(text)
        sums = [sum(c[k] for c in found) for k in range(len(KINDS) - 1)]
        total = sum(sums)
        return [*map(math.log1p, sums), math.log1p(total), math.log1p(len(found)), math.log1p(10 * total / (clauses + 2)), math.log1p(DENSITY * total / (words + 20))]


def _entries(text: str) -> list[str]:
    """The words of a text, lower-cased, and their stems (a trailing * marks one), that make up 1 / DENSITY of its words."""
    words = Counter(w.lower() for w in WORD.findall(text) if w[0].isalpha())
    found = words.copy()
    for w, n in words.items():
        for k in STEM:
            if len(w) > k:
                found[w[:k] + "*"] += n
    least = words.total() / DENSITY
    return [e for e, n in found.items() if n >= least]


def learn_lexicon(labelled: DataFrame, n_toxic: int, n_other: int, text_col: str = "text") -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic documents, with weights.

    labelled: (label, text), exact copies removed.
    """

    def run(batches):
        sums: dict[str, list[int]] = {}
        for b in rt.slices(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e in _entries(text or ""):
                    sums.setdefault(e, [0, 0])[label] += 1
        keep = [(e, n[1], n[0]) for e, n in sums.items()]
        for k in range(0, len(keep), 10_000):
            part = list(zip(*keep[k : k + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], names=["entry", "toxic", "other"])

    least = max(3, round(0.005 * n_toxic))
    toxic, other = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = toxic / n_toxic / (other / n_other)
    sigma = F.log(odds) / F.sqrt(1 / toxic + 1 / other)
    rows = (
        rt.map_arrow(labelled.select("label", text_col), run, "entry string, toxic bigint, other bigint")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter((F.col("toxic") >= least) & (sigma >= MIN_SIGMA))
        .select("entry", "toxic", odds.alias("odds"))
        .filter(F.col("odds") >= MIN_RATIO)
        .collect()
    )
    return weigh({e: o for e, _, o in rows})


def weigh(odds: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with weights, from the odds of entries."""
    words, stems = {}, {}
    for e, o in sorted(odds.items()):
        weight = math.log(o) / math.log(MIN_RATIO)
        if e.endswith("*"):
            stems[e[:-1]] = weight
        else:
            words[e] = weight
    for s in sorted(stems, key=len, reverse=True):  # a shorter stem of no less weight says it all
        if any(s[:n] in stems and stems[s[:n]] >= 0.9 * stems[s] for n in STEM if n < len(s)):
            del stems[s]
    return words, stems


def fit_unit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton's method, the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) / len(x) + ridge * np.diag([*np.full(x.shape[1] - 1, 1.0), 1e-6])
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * np.append(w[:-1], 0))
        w = w - step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(labelled: DataFrame, text_col: str = "text") -> dict:
    """The model from rows (label 0/1, text): lexicon, then the logistic unit over clause features."""
    one = rt.materialize(labelled.select("label", text_col).groupBy(text_col).agg(F.max("label").cast("int").alias("label")).select("label", text_col), "labelled")
    n = {r[0]: r[1] for r in one.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return {"share": toxic / (toxic + other) if toxic + other else 0.0}
    words, stems = learn_lexicon(one, toxic, other, text_col)
    ddl = "label int, x array<double>"
    schema = rt.arrow_schema(ddl)

    def run(batches):
        grammar = Grammar(words, stems)
        for b in rt.slices(batches):
            yield rt.to_batch(schema, [b.column(0).to_pylist(), [grammar.features(t) for t in b.column(1).to_pylist()]])

    rows = sorted((r[0], tuple(r[1])) for r in rt.map_arrow(one, run, ddl).toLocalIterator())
    rt.discard(one)
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float)
    return {"words": words, "stems": stems, "unit": fit_unit(x, y).tolist()}


def score_texts(texts: list[str | None], model: dict, grammar: Grammar | None) -> list[float]:
    if grammar is None:
        return [float(model["share"])] * len(texts)
    w = np.array(model["unit"])
    x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), FEATURES)
    return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).tolist()


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    ddl = f"{id_col} {dict(docs.dtypes)[id_col]}, score double"
    schema, shared = rt.arrow_schema(ddl), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        grammar = Grammar(model["words"], model["stems"]) if "unit" in model else None
        for b in rt.slices(batches):
            yield rt.to_batch(schema, [b.column(0).to_pylist(), score_texts(b.column(1).to_pylist(), model, grammar)])

    return rt.map_arrow(rt.only(docs, id_col, text_col), run, ddl)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """id and score of every row of docs; learned from the labels whose id meets train (a condition on the id column)."""
    model = learn(training_rows(docs, labels, label_col, train, id_col, text_col, bound))
    return score(docs, model, id_col, text_col)
