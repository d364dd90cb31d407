"""Chat formatting: linking tool calls with their results.

Calls and results join by conversation and identifier. Calls are ordered topologically by the results that
they need, their arguments are validated against the schemas of the tools, and each becomes one line of
canonical JSON (keys in order of code points, no spaces, nothing escaped that need not be).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only

CELL = 256
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema a value breaks: type, enum, const, required, properties,
    additionalProperties, items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum."""
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items")
        for i, x in enumerate(value if "items" in schema else []):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: range")
    return out


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, level: 0 for calls that need no other call of their conversation, else one more
    than the largest level of those they need. Calls in or behind a cycle have no row.

    Each round settles the calls whose needs are all settled, so there are as many rounds as levels.
    """
    nodes = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    needs = needs.join(nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"])  # others are not calls
    left = scratch.table(needs, "needs")
    done = scratch.table(nodes.join(left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    settled, level = done, 0
    while True:
        level += 1
        rest = scratch.table(left.join(done.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"), "needs")
        free = left.select("conv_id", "call_id").distinct().join(rest.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        done = scratch.table(free.withColumn("level", F.lit(level)), "level")
        if done.isEmpty():
            return settled
        settled, left = settled.unionByName(done), rest


def _positions(d: DataFrame) -> DataFrame:
    """Adds position: the place of a call in its conversation by level, turn and call_id, from 0.

    Counted over cells of turns first, so that a long conversation is never sorted in one task.
    """
    d = d.withColumn("unsettled", F.col("level").isNull()).withColumn("cell", F.floor(F.col("turn") / CELL))
    keys = ["conv_id", "unsettled", "level", "cell"]
    before = Window.partitionBy("conv_id").orderBy("unsettled", "level", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.select(*[F.col(k).alias(f"c_{k}") for k in keys], "before")
    same = [d[k].eqNullSafe(cells[f"c_{k}"]) for k in keys]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "call_id", "arguments")) - 1
    d = d.join(cells, same[0] & same[1] & same[2] & same[3])
    return d.withColumn("position", (F.col("before") + inside).cast("long"))


def link(spark: SparkSession, calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row for each row of ``calls`` (conv_id, turn, call_id, name, arguments as JSON text, needs as
    an array of call_ids) with the first of its ``results`` (conv_id, turn, call_id, content):

    level, position (see ``levels``; calls of a cycle have no level and come last), n_results,
    status (linked, or open without result), valid and errors by the schema of ``tools`` for the name, and
    json. Arguments that are null or no JSON, unknown tools, and calls without name are not valid. A call
    with a null conv_id or call_id has no result and needs nothing. Repeated call rows each have a row;
    of several results the one with the smallest turn, then content, counts. Empty tables give no rows.
    """
    scratch = Scratch(spark, "calls")
    calls = only(calls, conv_id="long", turn="long", call_id="string", name="string", arguments="string", needs="array<string>")
    results = only(results, conv_id="long", turn="long", call_id="string", content="string")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    d = calls.join(first, ["conv_id", "call_id"], "left").join(levels(calls.filter("conv_id is not null and call_id is not null"), scratch), ["conv_id", "call_id"], "left")
    d = d.withColumn("level", F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")))
    d = _positions(d).select("conv_id", "turn", "call_id", "name", "arguments", "level", "position", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("r.content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, call, name, text, n, content in zip(*(b[c].to_pylist() for c in ("conv_id", "call_id", "name", "arguments", "n_results", "content")), strict=True):
                try:
                    arguments = json.loads(text) if text is not None else None
                    errors = violations(arguments, tools[name]) if name in tools else [f"unknown tool {name}"]
                except ValueError:
                    arguments, errors = text, ["arguments are no JSON"]
                result = {"content": content} if n else None
                out.append((canonical({"arguments": arguments, "call_id": call, "conv_id": conv, "name": name, "result": result}), not errors, "; ".join(errors)))
            names = ["conv_id", "turn", "call_id", "level", "position", "n_results"]
            kinds = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=[*names, "json", "valid", "errors"])

    out = d.mapInArrow(run, "conv_id long, turn long, call_id string, level int, position long, n_results long, json string, valid boolean, errors string")
    return out.withColumn("status", F.when(F.col("n_results") > 0, "linked").otherwise("open"))


#: The tool that the turns of ``conversations`` are calls of.
REPLY = {
    "type": "object",
    "required": ["text", "turn", "after"],
    "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": ["string", "null"]}},
    "additionalProperties": False,
}
EXCHANGE = 8


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations``: a user's turn is a call of the tool ``reply``, and an
    assistant's turn is the result of the call one turn before. In each exchange of ``EXCHANGE`` turns a
    call needs the one two turns before."""
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), t)
    after = F.when(F.col("turn") % EXCHANGE > 1, name(F.col("turn") - 2))
    arguments = F.to_json(F.struct("text", "turn", after.alias("after")), {"ignoreNullFields": "false"})
    calls = turns.filter("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array_compact(F.array(after)).alias("needs"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
