"""Chat formatting with linked tool calls, as canonical JSON.

An assistant's message may hold calls, ``<tool_call>{"id", "name", "arguments"}</tool_call>``; a
message of role ``tool`` holds a result, ``{"tool_call_id", "content"}``. Calls and results are
joined by conversation and identifier. A message is ordered after everything it needs: a result
after its call, a call after the results of the calls that its arguments name as
``{"$ref": "<id>"}``. Each message stays a row of its own, so that no conversation is gathered:
only its links are, and those of a conversation with many are ordered layer by layer in joins.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm._shared import drop, save, sorted_runs
from tamis.session import ship

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
HALVES = re.compile("[\ud800-\udfff]")
LINKS = 10_000  # a conversation's links that are ordered in one task; one of more goes layer by layer
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space and no escapes but those it must have (half surrogates among them)."""
    return HALVES.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


#: Keywords that say nothing of validity.
NOTES = frozenset("$comment $id $schema default deprecated description examples readOnly title writeOnly".split())
KEYWORDS = NOTES | frozenset("type enum const required properties additionalProperties items minItems maxItems uniqueItems minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum".split())
LIMITS = {"minimum": operator.lt, "exclusiveMinimum": operator.le, "maximum": operator.gt, "exclusiveMaximum": operator.ge}
FORMATS = {
    "date": re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"),
    "date-time": re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)"),
    "uuid": re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
}


def known_schema(schema: object, at: str = "$") -> None:
    """Raise ValueError where a schema holds a keyword or format that ``breaches`` would pass over."""
    if isinstance(schema, bool) or not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema of keywords")
    unknown = sorted(set(schema) - KEYWORDS)
    if unknown or schema.get("format", "date") not in FORMATS:
        raise ValueError(f"{at}: unknown keywords or format: {unknown or schema['format']}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    for name, part in schema.get("properties", {}).items():
        known_schema(part, f"{at}.{name}")
    for key in ("items", "additionalProperties"):
        if key in schema and not isinstance(schema[key], bool):
            known_schema(schema[key], f"{at}.{key}")


def breaches(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (the keywords of ``KEYWORDS``); a reference to a result breaks nothing."""
    if _is_ref(value):
        return []
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out: list[str] = []
    same = canonical(value) if "enum" in schema or "const" in schema else ""  # JSON's equality: true is not 1
    if "enum" in schema and same not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the allowed values")
    if "const" in schema and same != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        out += _object_breaches(value, schema, at)
    elif isinstance(value, list):
        out += _sized(len(value), schema, "Items", at)
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: repeated items")
        if isinstance(schema.get("items"), dict):
            for i, x in enumerate(value):
                out += breaches(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        out += _sized(len(value), schema, "Length", at)
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: not of the pattern")
        if "format" in schema and not FORMATS[schema["format"]].fullmatch(value):
            out.append(f"{at}: not a {schema['format']}")
    elif _is(value, "number"):
        out += [f"{at}: beyond the {k}" for k, beyond in LIMITS.items() if k in schema and beyond(value, schema[k])]
    return out


def _object_breaches(value: dict, schema: dict, at: str) -> list[str]:
    known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    out = [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
    for k in sorted(value):
        if k in known:
            out += breaches(value[k], known[k], f"{at}.{k}")
        elif isinstance(more, dict):
            out += breaches(value[k], more, f"{at}.{k}")
        elif not more:
            out.append(f"{at}.{k}: not allowed")
    return out


def _sized(n: int, schema: dict, what: str, at: str) -> list[str]:
    out = [f"{at}: under min{what}"] if n < schema.get(f"min{what}", 0) else []
    return [*out, f"{at}: over max{what}"] if n > schema.get(f"max{what}", n) else out


def _is_ref(value: object) -> bool:
    """Whether the value stands for another call's result."""
    return isinstance(value, dict) and set(value) == {"$ref"} and _identifier(value["$ref"])


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, TYPES.get(kind, ()))


def _refs(value: object) -> list[str]:
    if isinstance(value, dict):
        return [value["$ref"]] if _is_ref(value) else [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _strict(text: str) -> object:
    def refuse(x: str) -> None:
        raise ValueError(x)

    try:
        return json.loads(text, parse_constant=refuse)
    except RecursionError:
        raise ValueError("nested too deep") from None


def _identifier(value: object) -> bool:
    return isinstance(value, str) and not HALVES.search(value)


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> dict:
    """A message's canonical JSON, its calls (id, breaches, references) and the call whose result it is."""
    text, calls, result, faults = text or "", [], None, []
    message: dict = {"role": role or ""}
    if role == "tool":
        try:
            got = _strict(text)
            result = got["tool_call_id"] if isinstance(got, dict) and _identifier(got.get("tool_call_id")) else None
        except ValueError:
            got = None
        if result is None:
            faults.append("result without an identifier")
            message["content"] = text
        else:
            message |= {"tool_call_id": result, "content": got.get("content")}
    else:
        made = []
        for body in CALL.findall(text) if role == "assistant" and "<tool_call>" in text else ():
            try:
                call = _strict(body)
            except ValueError:
                call = None
            if not isinstance(call, dict) or not _identifier(call.get("id")) or not _identifier(call.get("name")):
                faults.append("call without an identifier or a name, or not JSON")
                continue
            arguments = call.get("arguments", {})
            wrong = breaches(arguments, schemas[call["name"]]) if call["name"] in schemas else ["unknown tool"]
            made.append({"id": call["id"], "name": call["name"], "arguments": arguments})
            calls.append({"call_id": call["id"], "wrong": wrong, "needs": sorted(set(_refs(arguments)))})
        if made or faults:
            message["tool_calls"] = made
            text = CALL.sub("", text).strip()
        message["content"] = text
    return {"message": canonical(message), "calls": calls, "result_of": result, "faults": faults}


CALLS = T.ArrayType(T.StructType([T.StructField("call_id", T.StringType()), T.StructField("wrong", T.ArrayType(T.StringType())), T.StructField("needs", T.ArrayType(T.StringType()))]))
_ARROW_CALLS = pa.list_(pa.struct([("call_id", pa.string()), ("wrong", pa.list_(pa.string())), ("needs", pa.list_(pa.string()))]))


def format_chats(messages: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", at_once: int = LINKS) -> DataFrame:
    """(conv, turn, role, place, step, message, n_calls, n_linked, n_faults) for every message.

    Sorted by conversation, ``place``, ``step`` and turn, every result comes after the message of
    its call, and every call after the results that it refers to (after the call, where there is
    no result); ``place`` is the turn itself and ``step`` 0 where nothing moves a message, and a
    moved one takes the place of what it waits for, at a later step. ``n_calls`` counts a
    message's calls, ``n_linked`` those that have a result (for a result: 1 if its call is there).
    Faults are: calls or results that can't be read, an identifier called or answered before in
    the conversation (the first, by turn, counts) or twice at one turn, calls without a result,
    results without a call, unknown tools, arguments that break their schema, references to no
    call, and calls that wait for themselves in a circle or for such calls (their messages, and
    results to them, keep their turn). Null roles and texts count as empty; messages of a null
    conversation or turn link with nothing and keep their place. Equal rows are each kept, but
    repeat their identifiers. Other columns aren't read; an empty table gives no rows. A schema
    with a keyword that isn't checked raises ValueError.
    """
    for name, tool in schemas.items():
        known_schema(tool, name)
    ship(messages.sparkSession)
    names = [conv_col, turn_col, role_col]
    here = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([here.schema["conv"], T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("message", T.StringType()), T.StructField("calls", CALLS), T.StructField("result_of", T.StringType()), T.StructField("faults", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(r, t, schemas) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("role"), pa.array([m["message"] for m in made], pa.string()), pa.array([m["calls"] for m in made], _ARROW_CALLS), pa.array([m["result_of"] for m in made], pa.string()), pa.array([len(m["faults"]) for m in made], pa.int32())], names=schema.names)

    parsed = save(here.mapInArrow(run, schema))
    there = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    calls = parsed.where(there).select("conv", "turn", F.explode("calls").alias("c")).select("conv", "turn", "c.*")
    own = calls.groupBy("conv", "turn", "call_id").agg((F.count("*") - 1).alias("again"), F.max(F.size("wrong")).alias("wrong"))
    results = parsed.where(there & F.col("result_of").isNotNull()).groupBy("conv", "turn", F.col("result_of").alias("call_id")).agg((F.count("*") - 1).alias("again"))
    called = own.groupBy("conv", "call_id").agg(F.min("turn").alias("called"))
    linked = save(called.join(results.groupBy("conv", "call_id").agg(F.min("turn").alias("answered")), ["conv", "call_id"], "full"))
    told = linked.where("called IS NOT NULL").select("conv", F.col("call_id").alias("needed"), F.coalesce("answered", "called").alias("source"))
    needs = save(calls.select("conv", "turn", "call_id", F.explode("needs").alias("needed")).distinct().join(told, ["conv", "needed"], "left").select("conv", "turn", "call_id", "source"))
    after = results.join(linked.where("called IS NOT NULL"), ["conv", "call_id"]).select("conv", "turn", F.col("called").alias("source"))
    placed = _settle(save(needs.where("source IS NOT NULL").select("conv", "turn", "source").union(after).distinct()), at_once)
    lost = needs.groupBy("conv", "turn", "call_id").agg(F.sum(F.col("source").isNull().cast("int")).alias("lost"))
    stuck = placed.where("circle").select("conv", "turn", F.lit(1).alias("stuck"))
    stand = own.join(linked, ["conv", "call_id"]).join(lost, ["conv", "turn", "call_id"], "left").join(stuck, ["conv", "turn"], "left")
    waits = F.coalesce("lost", F.lit(0)) + F.when(F.col("lost").isNotNull(), F.coalesce("stuck", F.lit(0))).otherwise(0) + F.col("answered").isNull().cast("int")
    of_calls = stand.groupBy("conv", "turn").agg(
        F.sum(F.col("answered").isNotNull().cast("long")).alias("call_links"), F.sum((F.col("wrong") + F.col("again") + F.when(F.col("turn") == F.col("called"), waits).otherwise(1)).cast("long")).alias("call_faults")
    )
    of_results = results.join(linked, ["conv", "call_id"]).groupBy("conv", "turn").agg(
        F.max(F.col("called").isNotNull().cast("long")).alias("result_links"), F.max((F.col("called").isNull() | (F.col("turn") != F.col("answered")) | (F.col("again") > 0)).cast("long")).alias("result_faults")
    )
    # written first, so that few marks are broadcast by their known size and the messages stay where they are
    marks = save(of_calls.join(of_results, ["conv", "turn"], "full").join(placed, ["conv", "turn"], "full"))
    out = parsed.join(marks, ["conv", "turn"], "left")
    is_call, is_result = F.size("calls") > 0, F.col("result_of").isNotNull()
    of_kind = lambda call, result: F.when(is_call, F.coalesce(call, F.lit(0))).when(is_result, F.coalesce(result, F.lit(0))).otherwise(F.lit(0))
    return out.select(
        F.col("conv").alias(names[0]),
        F.col("turn").alias(names[1]),
        F.coalesce("role", F.lit("")).alias(names[2]),
        F.when(is_call | is_result, F.coalesce("place", "turn")).otherwise(F.col("turn")).alias("place"),
        F.when(is_call | is_result, F.coalesce("step", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("step"),
        "message",
        F.size("calls").cast("long").alias("n_calls"),
        of_kind("call_links", "result_links").cast("long").alias("n_linked"),
        (F.col("faults") + of_kind("call_faults", "result_faults")).cast("long").alias("n_faults"),
    )


def ordered(turns: list[int], sources: list[int]) -> dict[int, tuple[int, int]]:
    """{turn: (place, step)} of the messages that wait for others (turns[i] for sources[i]), but for those in circles or behind them."""
    waits: dict[int, set[int]] = {}
    users: dict[int, list[int]] = {}
    for t, s in set(zip(turns, sources, strict=True)):
        waits.setdefault(t, set()).add(s)
        users.setdefault(s, []).append(t)
    key = {s: (s, 0) for s in users if s not in waits}
    ready, out = list(key), {}
    best: dict[int, tuple[int, int]] = {}
    while ready:
        s = ready.pop()
        for t in users.get(s, ()):
            best[t] = max(best.get(t, key[s]), key[s])
            waits[t].discard(s)
            if not waits[t]:
                place, step = best[t]
                key[t] = out[t] = (t, 0) if t > place else (place, step + 1)
                ready.append(t)
    return out


def _settle(edges: DataFrame, at_once: int) -> DataFrame:
    """(conv, turn, place, step, circle) of the messages that wait for others: (conv, turn, source).

    Conversations of ``at_once`` links at most are ordered whole. The links of longer ones are
    taken layer by layer: a layer holds the messages whose sources are placed. What never comes
    free waits in a circle.
    """
    sizes = save(edges.groupBy("conv").count().where(F.col("count") > at_once).select("conv"))
    schema = T.StructType([edges.schema["conv"], *(T.StructField(c, T.LongType()) for c in ("turn", "place", "step")), T.StructField("circle", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in sorted_runs(batches, ["conv"]):
            turn, source = rows.column("turn").to_pylist(), rows.column("source").to_pylist()
            made = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                found = ordered(turn[lo:hi], source[lo:hi])
                made += [(lo, t, *found.get(t, (t, 0)), t not in found) for t in sorted(set(turn[lo:hi]))]
            at, *columns = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column("conv").combine_chunks().take(pa.array(at)), *map(pa.array, columns)], names=schema.names)

    whole = edges.join(sizes, "conv", "left_anti").repartition("conv").sortWithinPartitions("conv").mapInArrow(run, schema)
    if sizes.isEmpty():
        return save(whole)
    layers = [save(whole)]
    left = save(edges.join(sizes, "conv", "left_semi"))
    waiting = save(left.select("conv", "turn").distinct())
    free = F.struct(F.col("source").alias("place"), F.lit(0).cast("long").alias("step"))
    # sources that wait for nothing are known from the start; the others as they are placed
    ready = save(left.join(waiting.withColumnRenamed("turn", "source"), ["conv", "source"], "left_anti").select("conv", "turn", "source", free.alias("free")))
    count = left.groupBy("conv", "turn").agg(F.count("*").alias("n"))
    while not ready.isEmpty():
        done = ready.groupBy("conv", "turn").agg(F.count("*").alias("known"), F.max("free").alias("free")).join(count, ["conv", "turn"]).where("known = n")
        moved = F.col("free.place") >= F.col("turn")
        layer = save(done.select("conv", "turn", F.when(moved, F.col("free.place")).otherwise(F.col("turn")).alias("place"), F.when(moved, F.col("free.step") + 1).otherwise(0).cast("long").alias("step"), F.lit(False).alias("circle")))
        was = ready
        more = left.join(layer.select("conv", F.col("turn").alias("source"), F.struct("place", "step").alias("free")), ["conv", "source"]).select("conv", "turn", "source", "free")
        still = ready.join(layer.select("conv", "turn"), ["conv", "turn"], "left_anti")
        fresh = save(still.unionByName(more))
        drop(was)
        layers.append(layer)
        if layer.isEmpty():
            break
        ready = fresh
    placed = layers[0]
    for layer in layers[1:]:
        placed = placed.unionByName(layer)
    rest = waiting.join(placed.select("conv", "turn"), ["conv", "turn"], "left_anti")
    return save(placed.unionByName(rest.select("conv", "turn", F.col("turn").alias("place"), F.lit(0).cast("long").alias("step"), F.lit(True).alias("circle"))))


SQL = """
SELECT conv_id, turn, coalesce(role, '') AS role, turn AS place, 0::BIGINT AS step,
       '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, ''))::VARCHAR || '}' AS message,
       0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_faults
FROM conversations
"""
