"""Tool calls with identifiers of their own: linking, order, schemas, canonical JSON."""

import json
import random

import pytest

from dagstore.llm import queries as llm
from dagstore.llm import toolcalls
from tests.llm import tables


@pytest.fixture(scope="module")
def rows(spark, sf_dir, tmp_path_factory):
    where = tables.write(spark, sf_dir, tmp_path_factory.mktemp("links"))
    return {(r.conv_id, r.call_id): r for r in llm.op1_tool_call_linking(spark, where).collect()}


def test_shared_and_orphaned_identifiers(rows):
    a = rows[10, "a"]
    assert (a.status, a.name, a.n_calls, a.n_results, a.valid) == ("linked", "reply", 2, 2, True)  # the earliest of each
    assert json.loads(a.json) == {"id": "a", "name": "reply", "arguments": {"turn": 1, "prompt": "p"}, "result": "first"}
    assert (rows[10, "lost"].status, rows[10, "lost"].json) == ("orphan", '{"id":"lost","result":"null"}')
    b = rows[10, "b"]
    assert (b.status, b.n_parents, b.valid) == ("unanswered", 1, False)  # a parent that isn't there doesn't count
    assert set(b.errors.split(",")) == {"/prompt:minLength", "/turn:minimum", "/more:additionalProperties"}
    assert (10, "gone") not in rows


def test_order_and_cycles(rows):
    assert rows[11, "early"].topo_order < rows[11, "late"].topo_order
    assert [rows[12, c].topo_order for c in "xyz"] == [None] * 3  # on a cycle, and behind it
    assert rows[12, "x"].errors == "cycle" and rows[12, "z"].errors == "unknown,cycle"


def test_malformed_deep_and_surrogates(rows):
    found = {k[1]: r for k, r in rows.items() if k[0] == 13}
    assert sorted(found) == ["13:0.1", "13:0.2", "13:0.3", "13:0.4"]
    assert [found[f"13:0.{k}"].errors for k in (1, 2, 4)] == ["json"] * 3 and found["13:0.3"].status == "orphan"
    r = rows[14, "\\ud800"]
    assert r.name == "\\ud801" and r.errors == "unknown,cycle" and r.n_parents == 1
    assert json.loads(r.json)["arguments"] == {"k\ud802": "\ud803"}


def test_dialogue_edges(rows):
    assert (rows[1, "1:0"].n_calls, rows[1, "1:0"].n_results, rows[1, "1:0"].status) == (2, 1, "linked")
    assert rows[1, "1:2"].errors == "/prompt:minLength" and rows[1, "1:2"].n_parents == 1
    assert rows[3, "3:0"].status == "orphan"
    assert not [k for k in rows if k[0] in (None, 2)]


def test_canonical():
    assert toolcalls.canonical({"b": 1.0, "a": [True, None, 2.5, -0.0], "ü": "x\n"}) == '{"a":[true,null,2.5,0],"b":1,"ü":"x\\n"}'
    r = random.Random(4)

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        if kind == 6:
            return {r.choice("abcü\"\\") * r.randrange(3): value(depth - 1) for _ in range(r.randrange(4))}
        return [None, r.random() < 0.5, r.randrange(-5, 5), r.randrange(9) / 4, "x" * r.randrange(3)][kind]

    for _ in range(300):
        v = value(4)
        text = toolcalls.canonical(v)
        assert json.loads(text) == v and toolcalls.canonical(json.loads(text)) == text
    assert toolcalls.too_deep("[" * 101 + "]" * 101) and not toolcalls.too_deep("[" * 100 + "]" * 100) and not toolcalls.too_deep('["' + "[" * 500 + '"]')


def test_schema():
    schema = {"type": "object", "properties": {"l": {"type": "array", "items": {"type": ["integer", "null"], "maximum": 3}, "maxItems": 2}, "e": {"enum": ["x", 1]}, "s": {"type": "string", "pattern": "^a", "maxLength": 2}}}
    broken = lambda v: toolcalls.violations(v, schema)
    assert broken({"l": [1, None], "e": 1, "s": "ab"}) == []
    assert broken({"l": [4, True, "x"], "e": True, "s": "bcd"}) == ["/l:maxItems", "/l/0:maximum", "/l/1:type", "/l/2:type", "/e:enum", "/s:maxLength", "/s:pattern"]
    assert broken([]) == ["/:type"]
