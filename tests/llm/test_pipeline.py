"""Every stage of the pipeline on its own input: what it drops, what it keeps, and that run() is the stages in turn."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm import tables
from tests.llm.test_brute_force import words

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
D = "/root/testdata/sf0.01"


def some(spark, extra=()):
    r = "The committee met in the morning and spoke at length about the roads, the school and the new bridge over the river."
    rows = [(k, f"{r} Item {k} was put off until spring, since {k * 37} members were away and letter {k * 11} was late.", "en", "s", 150) for k in range(40)]
    return spark.createDataFrame([*rows, *extra], tables.DOCUMENTS)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_decontamination(spark, sf_dir):
    items = [t for _, t in sorted(duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet' WHERE text IS NOT NULL").fetchall())]
    passage = " ".join(items[0].split()[:8])
    planted = [(100, f"Some words before. {items[0]} And after.", "en", "s", 1), (101, f"x {passage} y", None, None, 1), (None, items[1], "en", None, 1), (5, f"again id 5 {items[2]}", "en", "s", 1)]
    clean = [(102, "y " + " ".join(items[0].split()[:7]) + " z", "en", "s", 1), (None, "clean without an id", None, None, 1), (103, None, None, None, None), (104, "", None, None, 0), (3, "a row of the same id", "en", None, 1)]
    df = some(spark, planted + clean)
    kept = STAGES["decontamination"](spark, df, sf_dir)
    assert kept.columns == COLUMNS
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, some(spark, clean).collect()), key=repr)


def test_decontamination_of_the_driver_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{D}/benchmark.parquet' WHERE text IS NOT NULL").fetchall()]
    windows = {tuple(w[k : k + 8]) for w in items for k in range(max(1, len(w) - 7) if w else 0)}
    lengths = {len(w) for w in windows}

    def held(text):
        w = words(text)
        return any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))

    rows = docs.select("doc_id", "text").collect()
    expected = sorted((r.doc_id for r in rows if not held(r.text)), key=repr)
    assert 0.9 * len(rows) < len(expected) < len(rows)
    assert ids(STAGES["decontamination"](spark, docs, D)) == expected


def test_near_dedup(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(100))
    copies = [(200, text, "en", "s", 1), (201, text, "en", "s", 1), (202, text + " end", "en", "s", 1), (202, text + " end", "en", "s", 1), (None, text, None, None, 1), (203, None, None, None, None), (204, "", None, None, 0), (205, "", None, None, 0)]
    kept = STAGES["near_dedup"](spark, some(spark, copies), sf_dir)
    assert kept.columns == COLUMNS
    assert ids(kept) == sorted([*range(40), 200, 203, 204, 205, None], key=repr)


def test_secrets(spark, sf_dir):
    hidden = "k: password = hunter2secret, end"
    rows = [(300, hidden, "en", "s", len(hidden)), (300, hidden, "en", "s", len(hidden)), (301, None, None, None, None), (302, "", None, None, 0), (None, "AKIA" + "Q" * 20, None, None, 24)]
    found = {(r.doc_id, r.text, r.n_chars) for r in STAGES["secrets"](spark, some(spark, rows), sf_dir).filter("doc_id >= 300 or doc_id is null").collect()}
    assert found == {(300, "k: [REDACTED], end", 18), (301, None, None), (302, "", 0), (None, "[REDACTED]", 10)}
    assert STAGES["secrets"](spark, some(spark), sf_dir).exceptAll(some(spark)).isEmpty()


def test_language_id_on_odd_rows(spark, sf_dir):
    rows = [(400, None, None, None, None), (401, "", None, None, 0), (402, "12 34 !", None, None, 7), (None, "The committee met in the morning and spoke", None, None, 1), (403, "\U00030000" * 50, None, None, 50)]
    kept = STAGES["language_id"](spark, some(spark, rows * 2), sf_dir)
    assert kept.columns == COLUMNS and ids(kept) == sorted([*range(40), None, None], key=repr)


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    where = tmp_path_factory.mktemp("none")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_empty(name, spark, sf_dir, empty):
    df = tables.with_extra(spark.createDataFrame(tables.document_rows(), tables.DOCUMENTS))
    found = STAGES[name](spark, df, sf_dir)
    rows = found.collect()
    if name != "packing":
        assert found.columns == df.columns
        assert all(r.salt == 7 for r in rows)
    assert rows and STAGES[name](spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).collect() == []


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
    expected = {(r.doc_id, r.n) for r in docs.selectExpr("doc_id", "length(text) as n").collect()}
    found = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert found == {i for i, _ in expected}
