"""Small tables made to break operators: nulls, repeats, ties, odd texts, and further columns whose names might clash."""

from pyspark.sql import functions as F

EXTRA = ["id", "n", "row", "salt", "ahead", "segment", "ids", "by", "k", "h", "label", "component", "set_key", "text_key", "drop_doc_id", "many", "__n", "hub", "key"]
BASE = " ".join(f"word{i}" for i in range(60))
DEEP = '<tool_call>{"id":"deep","name":"t","arguments":' + "[" * 100_000 + "]" * 100_000 + "}</tool_call>"


def document_rows():
    texts = [None, "", " ", "one two", "one two", BASE, BASE + " tail", "x" * 200_000, "été \U0001f600 中文", "\x00nul", "password = hunter2secret", "AKIA" + "A" * 20 + " " + "0123456789abcdef" * 3, "a " * 30_000, "\U00030000 \U00100041"]
    rows = [(i, t, None if i % 3 else "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, BASE, "en", "s", 1)] * 2  # repeated rows, and an id with the same text again
    rows += [(5, "another text altogether of the same id", "de", "s", 1), (20, "another text altogether of the same id", None, None, 2)]
    rows += [(3, "", None, None, 0), (30, "", None, None, 0), (30, BASE + " tail", None, None, 0)]
    rows += [(None, BASE, "en", None, 3), (None, None, None, None, None), (None, "only without an id", "en", None, 3), (None, "only without an id", "en", None, 3)]
    return rows


def benchmark_rows(rows):
    own = [(900, " ".join(f"word{i}" for i in range(3, 15))), (900, "one two"), (901, None), (None, "one two"), (902, ""), (903, "one"), (903, "one"), (904, "... !"), (905, " ".join(f"word{i}" for i in range(20, 40)))]
    return [*rows, *own]


def page_rows():
    body = "<p>The council met on Monday, and after a long debate it voted for the plan.</p>" * 8
    good = f"<html><body><nav>Menu</nav><article><h1>T</h1>{body}</article></body></html>"
    htmls = [None, "", " ", "plain text, no tags at all.", good, good, "<p>cut off <b>here", "<<<>>><", "<!-- never closed", "<script>only()</script>", "<div" * 50, f"<article>{body}<p>a &amp; b&nbsp;&#x43; &unknown;", "<p>" * 3000 + "deep, text. " * 20, body * 300]
    return [(k, f"u{k}", h) for k, h in enumerate(htmls)] + [(4, "u4", good), (None, None, good)]


def call(**v):
    import json

    return f"<tool_call>{json.dumps(v)}</tool_call>"


def answer(**v):
    import json

    return f"<tool_response>{json.dumps(v)}</tool_response>"


def conversation_rows():
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", ""), (1, 3, "assistant", None), (None, 0, "user", "x"), (1, None, "user", "x"), (2, 1 << 60, "user", "x"), (1, 0, "user", "hello"), (3, 0, None, "x"), (3, 1, "assistant", "to none")]
    args = {"turn": 1, "prompt": "p"}
    rows += [
        (10, 0, "tool", call(id="a", name="reply", arguments=args) + call(id="b", name="reply", arguments={"turn": -1, "prompt": "", "more": 1}, parents=["a", "gone"]) + answer(id="a", content="first")),
        (10, 1, "tool", answer(id="a", content={"z": 1.0, "a": [1, 2.5]}) + answer(id="lost", content=None) + call(id="a", name="later", arguments={})),
        (11, 0, "tool", call(id="late", name="reply", arguments=args, parents=["early"])),
        (11, 1, "tool", call(id="early", name="reply", arguments=args)),
        (12, 0, "tool", call(id="x", name="reply", arguments=args, parents=["y"]) + call(id="y", name="reply", arguments=args, parents=["x"]) + call(id="z", name="unheard", arguments=3, parents=["y"])),
        (13, 0, "tool", "<tool_call>{bad</tool_call><tool_call>[1]</tool_call><tool_response>nope</tool_response>" + DEEP),
        (14, 0, "tool", '<tool_call>{"id":"\\ud800","name":"\\ud801","arguments":{"k\\ud802":"\\ud803"},"parents":["\\ud800"]}</tool_call>'),
    ]
    return rows


def with_extra(df):
    return df.select("*", *[F.lit(7).alias(c) for c in EXTRA if c not in df.columns])


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, sf_dir, where, extra=True):
    """The edge tables as a directory like the driver's."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 0), (7, 1, 0), (8, 0, 1), (12, 0, 0), (99, 1, 1)]
    tables = {
        "documents": spark.createDataFrame(document_rows(), DOCUMENTS),
        "benchmark": spark.createDataFrame(benchmark_rows([tuple(r) for r in read("benchmark").select("item_id", "text").collect()]), "item_id bigint, text string"),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "pages": spark.createDataFrame(page_rows(), "page_id bigint, url string, html string"),
        "conversations": spark.createDataFrame(conversation_rows(), "conv_id bigint, turn bigint, role string, text string"),
    }
    for name, df in tables.items():
        (with_extra(df) if extra else df).write.parquet(f"{where}/{name}.parquet")
    return str(where)
