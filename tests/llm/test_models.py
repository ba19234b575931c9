"""The trained operators' inner workings against plain definitions."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from dagstore.llm import langid, quality, toxicity


# language ID


def plain_profile(text, size):
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    found = Counter()
    for w in text.split():
        for n in (1, 2, 3):
            padded = w if n == 1 else f" {w} "
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    return found


def spelled(key):
    n = 3 if key >> 61 else 2 if key >> 60 else 1
    letters = {int(v): chr(c) for c, v in enumerate(langid.letter_table()) if v} if not SPELL else SPELL
    SPELL.update(letters)
    key &= (1 << 60) - 1
    return "".join(SPELL.get(key >> langid._BITS * k & (1 << langid._BITS) - 1, " ") for k in range(n - 1, -1, -1))


SPELL: dict[int, str] = {}


@pytest.mark.parametrize("text", ["", None, "a", "Ab, ab!", "été - 中文 x", "\U00030000\U00030001", "\U00100041", "one two three two one " * 9, "İstanbul ẞ"])
def test_ngrams(text):
    assert Counter(spelled(int(k)) for k in langid.ngrams(text)) == plain_profile(text, 300)


def test_rank_order_distance():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6)))
    texts = {lang: " ".join(word() for _ in range(300)) for lang in ("de", "en", "fr")}
    profiles = {lang: langid.profile(t).tolist() for lang, t in texts.items()}
    model = langid.Classifier(profiles)
    for n in (1, 5, 400):
        text = " ".join(word() for _ in range(n))
        own = langid.profile(text).tolist()
        expected = {lang: sum(abs(k - p.index(g)) if g in p else langid.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        assert dict(zip(model.langs, model.distances(np.array(own)).tolist(), strict=True)) == expected
        assert model.predict(text)[0] == min(sorted(expected), key=expected.get)
    assert model.predict("12 !") == ("und", 0.0, 1.0)


def test_sample_is_bounded_and_deterministic(spark):
    rows = [(k % 50, "t" if k % 3 else "other", "de" if k % 5 else "en") for k in range(600)] + [(None, "t", "de"), (1, None, "de"), (2, "t", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for order in (df, df.repartition(7)):
        found = [tuple(x) for x in langid._labelled(order, "doc_id", "text", "lang", 6).collect()]
        assert sorted(Counter(x[1] for x in found).values()) == [6, 6] and len({x[:2] for x in found}) == 12
        assert sorted(found) == sorted(set(found))
    assert {x[2] for x in found} <= {"t", "other"}


# quality


def test_passages_are_those_of_the_text():
    r = random.Random(2)
    texts = [None, "", "one", "a  b\n", " ".join(r.choice(["ab", "Cd", "12", "é,", "x|y", "LOUD", "so-called"]) for _ in range(200)), "w " * 96]
    x, n = quality.encode(texts)
    assert n.tolist() == [max(1, -(-len((t or "").split()) // quality.PASSAGE)) for t in texts]
    begins = np.cumsum(n) - n
    for k, t in enumerate(texts):  # a text is encoded alike whatever stands beside it
        alone, m = quality.encode([t])
        assert np.allclose(x[begins[k] : begins[k] + n[k]], alone)
    words = texts[4].split()
    for p in range(n[4]):
        part = words[p * quality.PASSAGE : (p + 1) * quality.PASSAGE]
        row = x[begins[4] + p]
        assert np.isclose(row[-8], len(part) / quality.PASSAGE)
        assert np.isclose(row[-7] * 10, np.mean([len(w) for w in part]), atol=0.05)
        assert np.isclose(row[-5], sum(a == b for a, b in itertools.pairwise(part)) / len(part))
        assert np.isclose(row[-4], len({w.lower() for w in part}) / len(part), atol=0.05)


def test_attention_forward_and_gradient():
    g = np.random.default_rng(0)
    n = np.array([1, 4, 2])
    x, y = g.normal(size=(7, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.Attention(quality.Attention.start())
    w, at = model.w, 0
    p = model.forward(x, n)["p"]
    for k, m in enumerate(n):  # one bag at a time, as defined
        h = np.tanh(x[at : at + m] @ w["W"] + w["b"])
        e = (np.tanh(h @ w["V"]) * (1 / (1 + np.exp(-h @ w["U"])))) @ w["a"]
        a = np.exp(e) / np.exp(e).sum()
        assert np.isclose(p[k], 1 / (1 + np.exp(-((a * h).sum(axis=0) @ w["c"] + w["d"])))[0])
        at += m
    loss = lambda: -np.mean(y * np.log(model.forward(x, n)["p"]) + (1 - y) * np.log(1 - model.forward(x, n)["p"]))
    for name, d in model.gradient(x, n, y).items():
        at = tuple(0 for _ in d.shape)
        old = w[name][at]
        w[name][at] = old + 1e-5
        up = loss()
        w[name][at] = old - 1e-5
        down = loss()
        w[name][at] = old
        assert np.isclose(d[at], (up - down) / 2e-5, atol=1e-6), name


# toxicity


def by_definition(clause):
    """Sums over matches, each weighed by what stands near it."""
    out = [0.0] * 4
    for k, (s, weight) in enumerate(clause):
        if s not in (toxicity.INSULT, toxicity.THREAT):
            continue
        reach = toxicity.REACH
        before = [x for x, _ in clause[max(0, k - reach) : k]]
        aimed = toxicity.TARGET in before or toxicity.TARGET in [x for x, _ in clause[k + 1 : k + 1 + reach]]
        turned = toxicity.NOT in before or toxicity.SAID in before
        factor = (toxicity.NEGATED if toxicity.NOT in before else toxicity.REPORTED if turned else 1) * (toxicity.AIMED if aimed else 1)
        kind = toxicity.kind_of((s, aimed, int(turned)))
        if kind < 4:
            out[kind] += weight * factor
    return out


def test_composed_machine_against_definition():
    g = toxicity.Grammar({}, {})
    r = random.Random(8)
    for _ in range(3000):
        clause = [(s, 1.0 + r.randrange(4) if s == toxicity.INSULT else 1.0) for s in (r.choice([0, 0, 1, 2, 3, 4, 5, 5, 5]) for _ in range(r.randrange(1, 12)))]
        assert np.allclose(g.paths(clause), by_definition(clause)), clause
        if any(s <= 1 for s, _ in clause):
            assert g.clause(clause) == pytest.approx(by_definition(clause))


def test_clauses_of_a_text():
    g = toxicity.Grammar({"oaf": 2.0}, {"dolt": 3.0})
    kinds = lambda t: [[round(x, 6) for x in c] for c in g.clauses(t)[0]]
    assert kinds("An oaf. Nothing here! You are a doltish oaf") == [[2.0, 0, 0, 0], [2.0, 4.5, 0, 0]]
    assert kinds("You are not an oaf; you are no oaf") == [[0, 0, 1.0, 0], [0, 0, 1.5, 0]]
    assert kinds("She said: oaf") == [[0, 0, 2.1, 0]]
    assert kinds("I will hurt you; they beat the eggs for us all") == [[0, 0, 0, 1.5], [0, 0, 0, 1.5]]
    assert kinds("beat the eggs") == kinds("") == kinds(None) == kinds("a dol, a loaf") == []
    assert g.clauses("One. Two three!")[1:] == (3, 3)
    assert len(g.features("x")) == toxicity.FEATURES


def test_longest_entry_decides():
    lexicon = toxicity.Lexicon({"abc": 5.0, "abcd": 1.0}, {"ab": 2.0, "abcde": 4.0})
    assert [lexicon.weight(w) for w in ("a", "ab", "abc", "abcd", "abcx", "abcdefg", "xabc", "")] == [0, 2, 5, 1, 2, 4, 0, 0]
