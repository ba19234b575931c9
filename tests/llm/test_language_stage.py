"""The pipeline's language stage rejects what lies farther than labelled texts do."""

import base64
import random
import string
from collections import Counter

import corpus_pipeline
from dagstore.llm import langid
from tests.llm import tables
from tests.llm.test_models import plain_profile, spelled

DANISH = "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Enhver har krav på alle de rettigheder og friheder, som nævnes i denne erklæring, uden forskelsbehandling af nogen art."
HUNGARIAN = "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek."


def test_unknown_latin_texts_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = random.Random(9)
    words = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(n))
    planted = [DANISH, HUNGARIAN, *(words(string.ascii_lowercase, n) for n in (40, 400, 4000)), words("0123456789abcdef", 400), base64.b64encode(r.randbytes(3000)).decode()]
    rows = [(-1 - k, t, None, None, len(t)) for k, t in enumerate(planted)]
    short = [(t.split()[0], t) for (t,) in docs.select("text").filter("length(text) > 100 and lang = 'en'").limit(20).collect()]
    rows += [(-100 - k, " ".join(t.split()[3:9]), None, None, 1) for k, (_, t) in enumerate(short)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, df, sf_dir).select("doc_id").collect()}
    assert not {k for k in kept if -100 < k < 0}
    assert {x.doc_id for x in docs.filter("text rlike '[a-zA-Z]'").select("doc_id").collect()} <= kept
    assert len({k for k in kept if k <= -100}) == len(short)


def test_few_labelled_texts_reject_little(spark, sf_dir):
    docs = spark.createDataFrame([(k, t, "en" if k < 2 else None, None, len(t)) for k, t in enumerate(["one text alone", "and another", "a third text, not labelled", "Ѳѳѵ"])], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    assert sorted(x.doc_id for x in corpus_pipeline.language_id(spark, docs, sf_dir).collect()) == [0, 1, 2]


def test_all_labelled_texts_are_learned_from(spark, sf_dir):
    """Half the documents of a language are Greek: those that a sample of SAMPLE documents would leave out."""
    ids = spark.range(2 * langid.SAMPLE).selectExpr("id as doc_id", "'xx' as lang")
    inside = {r.doc_id for r in langid.sample(ids, "lang", langid.SAMPLE).collect()}
    assert len(inside) == langid.SAMPLE
    latin, greek = "the committee met in the morning", "η επιτροπή συνήλθε το πρωί"
    rows = [(k, latin if k in inside else greek, "xx", None, 1) for k in range(2 * langid.SAMPLE)]
    rows += [(-1, greek, None, None, 1), (-2, latin, None, None, 1), (-3, "комитет собрался утром", None, None, 1)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, tables.DOCUMENTS), sf_dir)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {*range(2 * langid.SAMPLE), -1, -2}


def test_repeated_labelled_rows_count_once(spark):
    rows = [(k % 50, "t" if k % 3 else "other", "de" if k % 5 else "en") for k in range(600)] + [(100, "alone", "de"), (100, "alone", "en"), (None, "t", "de"), (1, None, "de"), (2, "t", None), (3, None, "fr"), (3, None, "fr")]
    expected = sorted({(k, lang): min(t for i, t, g in rows if (i, g) == (k, lang) and t is not None) for k, t, lang in rows if None not in (k, t, lang)}.items())
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for order in (df, df.repartition(7)):
        assert sorted(((r.id, r.lang), r.text) for r in langid._every_labelled(order, "doc_id", "text", "lang").collect()) == expected


def test_counts_that_go_out_early_add_up(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 50)
    r = random.Random(4)
    rows = [(lang, " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 7))) for _ in range(40))) for lang, letters in (("de", "abcäöü"), ("el", "αβγδε")) for _ in range(400)]
    found = langid.learn(spark.createDataFrame(rows, "lang string, text string").coalesce(2), size=100)
    for lang in ("de", "el"):
        counts = sum((plain_profile(t, 0) for g, t in rows if g == lang), Counter())
        assert [counts[spelled(k)] for k in found[lang]] == sorted(counts.values(), reverse=True)[:100]
