"""Tool-call linking for chat transcripts.

``records`` reads calls and results out of message texts: ``<tool_call>{"id", "name", "arguments", "parents"}</tool_call>``
blocks, ``<tool_response>{"id", "content"}</tool_response>`` blocks, and, with dialogue=True, the dialogue itself: a
user turn is a call of ``reply`` with the turn's text, the assistant turn after it is that call's result, and the call
depends on the user turn two turns before.  ``link`` then

* joins calls and results by (conversation, identifier), each side grouped first, so a call repeated or answered many
  times is one row with counts and nothing is gathered in a list;
* orders calls topologically: where every dependency is earlier than its call, the position is the order (a conversation
  of any length, no group); a conversation with a dependency on a later call, whatever its size, is sorted in one task
  that reads its identifiers and positions alone; calls on or behind a cycle have no order;
* validates arguments against JSON schemas (type, enum, required, properties, additionalProperties, items, bounds);
* serialises every call with its result as canonical JSON: keys sorted, no spaces, integral numbers without a fraction.

Defined results: of calls (results) with one identifier the earliest, then least in text, stands for all; a result
without a call is an ``orphan`` row, a call without a result ``unanswered``; malformed blocks, which those nested deeper
than DEPTH are too, are calls with the error ``json`` and a name of null; an unpaired surrogate in JSON stays the escape it
was; null texts say nothing, an empty one is an empty prompt; rows with a null conversation or turn, or a turn beyond
LAST_TURN, are ignored; repeated rows count in n_calls and n_results; an empty table gives an empty table; other columns,
of whatever name, don't matter.
"""

from __future__ import annotations

import heapq
import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagstore.llm import runtime as rt

STRIDE = 1 << 20  # positions within a turn
LAST_TURN = 1 << 42
DEPTH = 100  # of nested arrays and objects

BLOCK = re.compile(r"<tool_(call|response)>(.*?)</tool_\1>", re.S)

#: Schemas by tool name; what op1 validates against.
REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    "additionalProperties": False,
}


def canonical(value: object) -> str:
    """Canonical JSON text of a parsed value."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        return v

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_SURROGATE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """text with unpaired surrogates, which no UTF-8 string can hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def too_deep(text: str) -> bool:
    """Is JSON text nested deeper than DEPTH."""
    if text.count("[") + text.count("{") <= DEPTH:
        return False
    depth = 0
    for c in re.findall(r"[\[\]{}]", _STRINGS.sub("", text)):
        depth += 1 if c in "[{" else -1
        if depth > DEPTH:
            return True
    return False


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or (isinstance(v, float) and v.is_integer())),
}


def violations(value: object, schema: dict, at: str = "") -> list[str]:
    """What a value breaks of a schema, as path:rule, in order of the schema."""
    out: list[str] = []
    kind = schema.get("type")
    if kind is not None and not any(_TYPES[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{at or '/'}:type"]
    if "enum" in schema and not any(type(value) is type(e) and value == e for e in schema["enum"]):
        out.append(f"{at or '/'}:enum")
    if isinstance(value, str):
        out += [f"{at or '/'}:{k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", math.inf))) if bad]
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at or '/'}:pattern")
    if _TYPES["number"](value):
        out += [f"{at or '/'}:{k}" for k, bad in (("minimum", value < schema.get("minimum", -math.inf)), ("maximum", value > schema.get("maximum", math.inf))) if bad]
    if isinstance(value, list):
        out += [f"{at or '/'}:{k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", math.inf))) if bad]
        for i, v in enumerate(value) if "items" in schema else ():
            out += violations(v, schema["items"], f"{at}/{i}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{k}:required" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}/{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}/{k}:additionalProperties")
    return out


RECORD = "conv_id bigint, kind string, position bigint, call_id string, name string, body string, parents array<string>"


def _embedded(conv: int, turn: int, text: str) -> list[tuple]:
    out = []
    for k, m in enumerate(BLOCK.finditer(text), 1):
        try:
            v = {} if too_deep(m[2]) else json.loads(m[2])
            if not isinstance(v, dict):
                raise ValueError
        except ValueError:
            v = {}
        call_id = v.get("id")
        call_id = f"{conv}:{turn}.{k}" if call_id is None else escaped(str(call_id))
        if m[1] == "call":
            name = v.get("name")
            refs = v.get("parents")
            out.append((conv, "call", turn * STRIDE + k, call_id, escaped(str(name)) if name is not None else None, canonical(v["arguments"]) if "arguments" in v else None, [escaped(str(p)) for p in refs] if isinstance(refs, list) else []))
        else:
            content = v.get("content")
            out.append((conv, "result", turn * STRIDE + k, call_id, None, escaped(content) if isinstance(content, str) else canonical(content), []))
    return out


def records(turns: DataFrame, dialogue: bool = True) -> DataFrame:
    """Calls and results of messages (conv_id, turn, role, text)."""
    schema = rt.arrow_schema(RECORD)

    def run(batches):
        for b in rt.slices(batches):
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text is None or conv is None or turn is None or abs(turn) > LAST_TURN:
                    continue
                if "<tool_" in text:
                    out += _embedded(conv, turn, text)
                if dialogue and role == "user":
                    body = canonical({"prompt": text, "turn": turn})
                    out.append((conv, "call", turn * STRIDE, f"{conv}:{turn}", "reply", body, [f"{conv}:{turn - 2}"] if turn >= 2 else []))
                elif dialogue and role == "assistant" and turn >= 1:
                    out.append((conv, "result", turn * STRIDE, f"{conv}:{turn - 1}", None, text, []))
            if out:
                yield rt.to_batch(schema, list(map(list, zip(*out, strict=True))))

    return rt.map_arrow(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), run, RECORD)


def _sorted_group(rows: list[tuple[str, int, list[str]]]) -> dict[str, int | None]:
    """Kahn's order of (call, position, parents), earliest position first: the calls in order take the positions in order."""
    waits = {c: sum(1 for p in set(ps)) for c, _, ps in rows}
    at = {c: p for c, p, _ in rows}
    after: dict[str, list[str]] = {}
    for c, _, ps in rows:
        for p in set(ps):
            after.setdefault(p, []).append(c)
    ready = [(at[c], c) for c, n in waits.items() if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        _, c = heapq.heappop(ready)
        order.append(c)
        for d in after.get(c, ()):
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, (at[d], d))
    places = sorted(at[c] for c in order)
    return dict.fromkeys(at) | dict(zip(order, places, strict=True))


def topological(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, n_parents (known ones) and topo_order of calls (conv_id, call_id, position, parents)."""
    calls = rt.materialize(calls.select("conv_id", "call_id", "position", "parents"), "calls")
    wanted = calls.select("conv_id", "call_id", "position", F.explode(F.array_distinct("parents")).alias("parent"))
    known = calls.select("conv_id", F.col("call_id").alias("parent"), F.col("position").alias("parent_position"))
    edges = wanted.join(known, ["conv_id", "parent"])
    counts = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_parents"))
    late = rt.materialize(edges.filter("parent_position >= position").select("conv_id").distinct(), "late")
    base = calls.join(counts, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "position", F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"))
    if late.isEmpty():
        return base.select("conv_id", "call_id", "n_parents", F.col("position").alias("topo_order"))
    known_parents = edges.groupBy("conv_id", "call_id").agg(F.collect_set("parent").alias("parents"))
    nodes = calls.select("conv_id", "call_id", "position")

    def sort(pdf):
        order = _sorted_group(list(zip(pdf["call_id"], pdf["position"], [list(p) if p is not None else [] for p in pdf["parents"]], strict=True)))
        pdf["topo_order"] = [order[c] for c in pdf["call_id"]]
        pdf["topo_order"] = pdf["topo_order"].astype("Int64")
        return pdf[["conv_id", "call_id", "topo_order"]]

    grouped = nodes.join(late, "conv_id", "left_semi").join(known_parents, ["conv_id", "call_id"], "left").groupBy("conv_id").applyInPandas(sort, "conv_id bigint, call_id string, topo_order bigint")
    again = grouped.withColumn("again", F.lit(True))
    out = base.join(again, ["conv_id", "call_id"], "left")
    return out.select("conv_id", "call_id", "n_parents", F.when(F.col("again"), F.col("topo_order")).otherwise(F.col("position")).alias("topo_order"))


OUTPUT = "conv_id bigint, call_id string, status string, name string, topo_order bigint, n_parents bigint, n_calls bigint, n_results bigint, valid boolean, errors string, json string"


def link(found: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per identifier of the records found; see the module's text."""
    found = rt.materialize(found, "records")
    key = ["conv_id", "call_id"]
    first = F.min(F.struct("position", F.coalesce("body", F.lit("")).alias("text"), "name", "body", "parents"))
    calls = found.filter("kind = 'call'").groupBy(*key).agg(first.alias("c"), F.count(F.lit(1)).alias("n_calls"))
    answer = F.min(F.struct("position", "body"))
    results = found.filter("kind = 'result'").groupBy(*key).agg(answer.alias("r"), F.count(F.lit(1)).alias("n_results"))
    order = topological(calls.select(*key, "c.position", "c.parents"))
    both = calls.join(order, key).join(results, key, "full_outer")
    flat = both.select(
        "conv_id",
        "call_id",
        "c.name",
        "c.body",
        F.col("r.body").alias("content"),
        "topo_order",
        F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
    )
    schema = rt.arrow_schema(OUTPUT)

    def run(batches):
        for b in rt.slices(batches):
            out = []
            for r in b.to_pylist():
                status = "orphan" if not r["n_calls"] else "linked" if r["n_results"] else "unanswered"
                errors: list[str] = []
                if r["n_calls"]:
                    arguments = json.loads(r["body"]) if r["body"] is not None else None
                    if r["name"] is None or r["body"] is None:
                        errors.append("json")
                    elif r["name"] not in schemas:
                        errors.append("unknown")
                    else:
                        errors += violations(arguments, schemas[r["name"]])
                    if r["topo_order"] is None:
                        errors.append("cycle")
                    call = {"id": r["call_id"], "name": r["name"], "arguments": arguments}
                else:
                    call = {"id": r["call_id"]}
                if r["n_results"]:
                    call["result"] = r["content"]
                out.append((r["conv_id"], r["call_id"], status, r["name"], r["topo_order"], r["n_parents"], r["n_calls"], r["n_results"], bool(r["n_calls"]) and not errors, ",".join(errors), canonical(call)))
            if out:
                yield rt.to_batch(schema, list(map(list, zip(*out, strict=True))))

    return rt.map_arrow(flat, run, OUTPUT)


#: link() over a dialogue table that has no embedded blocks.
DIALOGUE_SQL = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n_calls FROM t WHERE role = 'user' GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS text, count(*) AS n_results FROM t WHERE role = 'assistant' AND turn >= 1 GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
       coalesce(c.conv_id, r.conv_id) || ':' || coalesce(c.turn, r.turn) AS call_id,
       CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       CASE WHEN c.conv_id IS NOT NULL THEN 'reply' END AS name,
       c.turn * 1048576 AS topo_order,
       CAST(p.conv_id IS NOT NULL AS BIGINT) AS n_parents,
       coalesce(c.n_calls, 0) AS n_calls,
       coalesce(r.n_results, 0) AS n_results,
       c.conv_id IS NOT NULL AND c.text <> '' AND c.turn >= 0 AS valid,
       concat_ws(',', CASE WHEN c.text = '' THEN '/prompt:minLength' END, CASE WHEN c.turn < 0 THEN '/turn:minimum' END) AS errors,
       '{' || CASE WHEN c.conv_id IS NULL THEN '' ELSE '"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},' END
           || '"id":"' || coalesce(c.conv_id, r.conv_id) || ':' || coalesce(c.turn, r.turn) || '"'
           || CASE WHEN c.conv_id IS NULL THEN '' ELSE ',"name":"reply"' END
           || CASE WHEN r.conv_id IS NULL THEN '' ELSE ',"result":' || to_json(r.text) END || '}' AS json
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
LEFT JOIN c AS p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
"""
