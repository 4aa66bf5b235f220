"""Chat transcripts as canonical JSON, with tool calls linked to their results.

An assistant message whose text is a JSON object with `tool_calls` (each an id, a name and arguments) holds calls; a message of the
role `tool` whose text is a JSON object with `tool_call_id` is a result. Calls and results are hash-joined by conversation
and identifier. Arguments may name other calls as "$<id>"; a call comes after those it names. The order is a topological one given by columns to sort
by (anchor, depth, turn, item): the anchor of a call is the last turn of itself and the calls it names, directly or through others, and a result is anchored
at its call. Calls of one anchor that name each other are told apart by depth. It needs no group of a conversation's rows in one place, however
long a conversation is. A call that names calls of earlier turns only, as in any real chat, is placed at once, however long the chain;
rounds are needed for calls that name later turns (one for each that follows the other), and for those of one anchor.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: By tool: its parameters' JSON types, and those that must be given.
SCHEMAS: dict[str, dict] = {
    "search": {"types": {"query": "string", "limit": "integer"}, "required": ["query"]},
    "calculate": {"types": {"expression": "string"}, "required": ["expression"]},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, text as it is. A ValueError for what UTF-8 JSON can't hold: NaN, infinities, lone surrogates."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def fault(tool: str | None, arguments: object, schemas: dict[str, dict]) -> str | None:
    """What is wrong with a call's arguments, the first of: unknown tool, no object, missing, unexpected, wrong type."""
    if tool not in schemas:
        return "unknown tool"
    if not isinstance(arguments, dict):
        return "arguments are no object"
    schema = schemas[tool]
    for name in schema.get("required", []):
        if name not in arguments:
            return f"missing {name}"
    for name, value in sorted(arguments.items()):
        if name not in schema["types"]:
            return f"unexpected {name}"
        kind = schema["types"][name]
        if value is None or not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number")):
            return f"{name} is no {kind}"
    return None


#: JSON that is nested deeper is taken as text: what is read must be written again, inside of other objects.
DEPTH = 1000


def parts_of(value: object) -> Iterator[tuple[object, int]]:
    """All values within a value, with their depths, without recursion."""
    todo = [(value, 1)]
    while todo:
        part, depth = todo.pop()
        yield part, depth
        inner = part.values() if isinstance(part, dict) else part if isinstance(part, list) else ()
        todo += [(x, depth + 1) for x in inner]


def read(text: str) -> object:
    """A JSON value that can be written again; a ValueError for any other text."""
    try:
        value = json.loads(text)
        if any(depth > DEPTH for _, depth in parts_of(value)):
            raise ValueError("nested too deep")
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


def named(value: object) -> set[str]:
    """Identifiers of the calls that arguments name."""
    return {x[1:] for x, _ in parts_of(value) if isinstance(x, str) and x.startswith("$") and len(x) > 1}


def items_of(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(item, kind, call_id, tool, fault, names, json) of a message: itself, its calls, or a result."""
    text = text or ""
    try:
        value = read(text) if text.lstrip()[:1] == "{" else None
    except ValueError:
        value = None
    if isinstance(value, dict) and role == "tool" and isinstance(value.get("tool_call_id"), str):
        out = {"content": value.get("content"), "role": "tool", "tool_call_id": value["tool_call_id"]}
        return [(0, "result", value["tool_call_id"], None, None, [], canonical(out))]
    calls = value.get("tool_calls") if isinstance(value, dict) and role == "assistant" else None
    if not isinstance(calls, list):
        return [(0, "message", None, None, None, [], canonical({"content": text, "role": role}))]
    out = [(0, "message", None, None, None, [], canonical({"content": value.get("content"), "role": role}))]
    for i, call in enumerate(calls, 1):
        call = call if isinstance(call, dict) else {}
        tool, arguments = call.get("name"), call.get("arguments")
        if isinstance(arguments, str):
            with contextlib.suppress(ValueError):
                arguments = read(arguments)
        key = call.get("id") if isinstance(call.get("id"), str) else None
        tool = tool if isinstance(tool, str) else None
        out.append((i, "call", key, tool, fault(tool, arguments, schemas), sorted(named(arguments)), canonical({"arguments": arguments, "id": key, "name": tool, "type": "call"})))
    return out


def format_chats(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """One row per item: conv_id, turn, item, role, kind, call_id, tool, status, linked_turn, anchor, depth, json.

    kind: message, call or result. status of a call: invalid: <why> (its arguments), unanswered, cyclic (it has no place in its anchor, since it names itself through others, or names such a
    call there) or ok; of a result: orphan (no such call) or ok; of a message: ok. Of calls with one identifier in a conversation the first counts, the others are
    invalid: repeated id; every result of an identifier is linked. Names of calls that aren't there are ignored. linked_turn: the call's of a result, the first result's of a call. Null text counts as
    empty; rows with null conv_id or turn keep their rows and link with nothing. Text that isn't such JSON, or can't be written as UTF-8 JSON again (NaN, lone
    surrogates), or is nested over DEPTH deep, is a plain message; arguments like that stay the string they are. Very long texts are parsed whole. Repeated rows are messages of their own.
    Other columns are not read. An empty table gives an empty result.
    """
    schema = "conv_id long, turn long, role string, item int, kind string, call_id string, tool string, fault string, names array<string>, json string"
    arrow = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("item", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("tool", pa.string()), ("fault", pa.string()), ("names", pa.list_(pa.string())), ("json", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, r, *x) for c, t, r, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True) for x in items_of(r, text, schemas)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    items = messages.select("conv_id", "turn", "role", "text").mapInArrow(parse, schema).withColumn("id", F.monotonically_increasing_id())
    items = materialise(items, "chat-items")
    key = ["conv_id", "call_id"]
    place = F.struct("turn", "item", "id")
    calls = items.where("kind = 'call' AND conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL")
    first = calls.groupBy(*key).agg(F.min(place).alias("p"), F.min_by("names", place).alias("names"))
    answers = items.where("kind = 'result' AND conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(*key).agg(F.min("turn").alias("answered"))
    first = first.join(answers, key, "left").select(*key, F.col("p.id").alias("first_id"), F.col("p.turn").alias("call_turn"), "answered", "names")
    state = materialise(first.select(*key, "first_id", "call_turn", "answered", "names", F.col("call_turn").alias("anchor")), "calls")
    edges = state.select("conv_id", F.col("call_id"), F.explode(F.array_distinct("names")).alias("named")).join(state.select("conv_id", F.col("call_id").alias("named")), ["conv_id", "named"])
    edges = materialise(edges, "call-names")
    # Anchors: a round for each time that a later turn is named.
    of_named = lambda c: state.select("conv_id", F.col("call_id").alias("named"), F.col(c).alias("a"))
    while True:
        later = edges.join(of_named("anchor"), ["conv_id", "named"]).groupBy(*key).agg(F.max("a").alias("a"))
        raised = materialise(later.join(state.select(*key, "anchor"), key).where("a > anchor").select(*key, "a"), "raised")
        if raised.isEmpty():
            break
        state = materialise(state.join(raised, key, "left").withColumn("anchor", F.coalesce("a", "anchor")).drop("a"), "calls")
    # Depths, level by level, among calls of one anchor.
    near = edges.join(of_named("anchor"), ["conv_id", "named"]).join(state.select(*key, "anchor"), key).where("a = anchor").select(*key, "named")
    near = materialise(near, "names-within-anchors")
    state = materialise(state.withColumn("depth", F.lit(0)).withColumn("cyclic", F.lit(False)), "calls")
    open_calls = materialise(near.select(*key).distinct(), "open-calls")
    while not open_calls.isEmpty():
        blocked = near.join(open_calls.select("conv_id", F.col("call_id").alias("named")), ["conv_id", "named"], "left_semi").select(*key).distinct()
        ready = materialise(open_calls.join(blocked, key, "left_anti"), "ready-calls")
        if ready.isEmpty():  # what is left names itself, or such calls
            state = state.join(open_calls.withColumn("left", F.lit(True)), key, "left").withColumn("cyclic", F.coalesce("left", "cyclic")).drop("left")
            state = materialise(state, "calls")
            break
        before = near.join(ready, key).join(of_named("depth"), ["conv_id", "named"]).groupBy(*key).agg(F.max("a").alias("d"))
        state = state.join(before, key, "left").withColumn("depth", F.coalesce(F.col("d") + 1, "depth")).drop("d")
        state = materialise(state, "calls")
        open_calls = materialise(open_calls.join(ready, key, "left_anti"), "open-calls")
    alone = F.col("call_id").isNull() | F.col("conv_id").isNull()  # most rows: they take no part in the join, so no task gets all of them
    places = state.drop("names")
    linked = items.where(~alone).join(places, key, "left")
    linked = linked.unionByName(items.where(alone), allowMissingColumns=True)
    is_call, is_result = F.col("kind") == "call", (F.col("kind") == "result") & F.col("turn").isNotNull()
    status = (
        F.when(is_call & F.col("fault").isNotNull(), F.concat(F.lit("invalid: "), "fault"))
        .when(is_call & F.col("call_id").isNull(), F.lit("invalid: no id"))
        .when(is_call & (F.col("first_id") != F.col("id")), F.lit("invalid: repeated id"))
        .when(is_call & F.col("cyclic"), F.lit("cyclic"))
        .when(is_call & F.col("answered").isNull(), F.lit("unanswered"))
        .when((F.col("kind") == "result") & (F.col("first_id").isNull() | F.col("turn").isNull()), F.lit("orphan"))
        .otherwise(F.lit("ok"))
    )
    tied = (is_call & (F.col("first_id") == F.col("id"))) | (is_result & F.col("first_id").isNotNull())
    anchor = F.coalesce(F.when(tied, F.col("anchor")), "turn")
    depth = F.when(tied, 2 * F.col("depth") + F.when(is_result, 2).otherwise(1)).otherwise(F.lit(0))
    link = F.when(is_result, F.col("call_turn")).when(is_call & tied, F.col("answered"))
    return linked.select("conv_id", "turn", "item", "role", "kind", "call_id", "tool", status.alias("status"), link.alias("linked_turn"), anchor.alias("anchor"), depth.cast("int").alias("depth"), "json")
