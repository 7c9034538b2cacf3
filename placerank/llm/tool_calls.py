"""Chat formatting: tool calls and their results, linked, ordered, validated and written as canonical JSON.

Calls and results are joined by conversation and identifier. A call comes after those it depends on: its level is the length
of the longest chain of dependencies below it, so (level, turn, call_id) is a topological order of a conversation. Levels
are found without gathering a conversation: each call follows the deepest of its dependencies, chain lengths come by pointer
doubling (joins on identifiers, as many as the logarithm of the longest chain), and this is repeated until no level
changes, which for chains and trees is at once."""

import json
import math
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY = ["conv_id", "call_id"]
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _number(value: float) -> str:
    """A finite number as canonical JSON writes it: its shortest digits, plain from 1e-6 up to 1e21."""
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    if 1e-6 <= abs(value) < 1e21:
        return format(Decimal(repr(value)), "f")
    digits, _, power = repr(value).partition("e")
    return f"{digits}e{int(power):+d}"


def canonical(value) -> str:
    """JSON with keys sorted by UTF-16 code units, no spaces, and numbers by `_number`. Raises ValueError for what JSON cannot
    hold."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value == int(value)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def read_schema(text: str) -> dict | bool:
    """A JSON Schema of the keywords that `invalid` knows; others are ignored. Raises ValueError if it is none."""
    schema = json.loads(text, parse_constant=_no_constants)
    _check_schema(schema)
    return schema


def _check_schema(schema) -> None:
    def need(good: bool, what: str) -> None:
        if not good:
            raise ValueError(f"schema: {what}")

    need(isinstance(schema, (dict, bool)), "neither an object nor true or false")
    if isinstance(schema, bool):
        return
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    need(isinstance(kinds, list) and all(isinstance(k, str) and k in {*_KINDS, "integer", "number"} for k in kinds), "type")
    need("type" not in schema or bool(kinds), "type")
    need(isinstance(schema.get("enum", []), list), "enum")
    need(isinstance(schema.get("required", []), list) and all(isinstance(k, str) for k in schema.get("required", [])), "required")
    need(isinstance(schema.get("properties", {}), dict), "properties")
    for bound in ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"):
        need(_is(schema.get(bound, 0), "number") and math.isfinite(schema.get(bound, 0)), bound)
    for below in [*schema.get("properties", {}).values(), schema.get("items", True), schema.get("additionalProperties", True)]:
        _check_schema(below)


def invalid(value, schema: dict | bool, at: str = "$") -> str | None:
    """The first place where a value breaks a JSON Schema (true, false, type, enum, const, required, properties,
    additionalProperties, items, bounds of numbers and lengths), or None."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    # Equal as JSON: 1 and 1.0 are, 1 and true are not.
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]) or \
            "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not an allowed value"
    if _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            return f"{at}: wrong length"
    if isinstance(value, list) and "items" in schema:
        return next((e for i, v in enumerate(value) if (e := invalid(v, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in sorted(schema.get("required", [])):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            rule = known.get(k, schema.get("additionalProperties", True))
            if rule is False:
                return f"{at}.{k}: not known"
            if e := invalid(value[k], rule, f"{at}.{k}"):
                return e
    return None


def _no_constants(name: str):
    raise ValueError(name)


def _arguments(text: str | None):
    """(value, its canonical JSON, None) of arguments, or (None, their text as JSON, error) if they are not JSON that can be written."""
    try:
        value = json.loads(text or "{}", parse_constant=_no_constants)
        written = canonical(value)
        written.encode()
        return value, written, None
    except UnicodeEncodeError:
        error = "not Unicode"
    except RecursionError:
        error = "too deep"
    except ValueError as e:
        error = "not JSON" if "JSON number" not in str(e) else "not a JSON number"
    return None, canonical(text), error


def _finish(batches):
    """Validates, decides on the status and writes the record of each linked call."""
    schemas: dict[str, dict | bool | None] = {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            arguments, written, error = _arguments(r["arguments"])
            if r["schema"] is not None and r["schema"] not in schemas:
                try:
                    schemas[r["schema"]] = read_schema(r["schema"])
                except (ValueError, RecursionError):
                    schemas[r["schema"]] = None
            schema = schemas.get(r["schema"])
            if error is None and schema is not None:
                try:
                    error = invalid(arguments, schema)
                except RecursionError:
                    error = "too deep"
            status = "invalid_arguments" if error else "ok"
            if not r["n_calls"]:
                status, error = "orphan_result", None
            elif r["call_id"] is None or r["conv_id"] is None:
                status, error = "no_id", None
            elif r["level"] is None:
                status, error = "cycle", None
            elif r["schema"] is None:
                status, error = "unknown_tool", None
            elif schema is None:
                status, error = "bad_schema", None
            elif status == "ok" and not r["n_results"]:
                status = "missing_result"
            elif status == "ok" and r["result_turn"] is not None and r["call_turn"] is not None \
                    and r["result_turn"] < r["call_turn"]:
                status = "result_before_call"
            rest = canonical({"conversation": r["conv_id"], "id": r["call_id"], "name": r["name"], "result": r["content"]})
            rows.append({"conv_id": r["conv_id"], "call_id": r["call_id"], "level": r["level"],
                         "turn": r["result_turn"] if status == "orphan_result" else r["call_turn"], "name": r["name"],
                         "n_calls": r["n_calls"], "n_results": r["n_results"], "status": status, "error": error,
                         "record": f'{{"arguments":{written},{rest[1:]}'})
        yield pa.RecordBatch.from_pylist(rows, _OUT)


_OUT = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("level", pa.int64()), ("turn", pa.int64()),
                  ("name", pa.string()), ("n_calls", pa.int64()), ("n_results", pa.int64()), ("status", pa.string()),
                  ("error", pa.string()), ("record", pa.string())])
_DDL = "conv_id long, call_id string, level long, turn long, name string, n_calls long, n_results long, status string, " \
       "error string, record string"


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct `calls`; level is null for calls on, or behind, a circle.

    `needs` has conv_id, call_id and needed_id; needs of calls that do not exist are ignored."""
    nodes = stored(calls.select(*KEY).distinct(), "calls")
    there = nodes.select("conv_id", F.col("call_id").alias("needed_id"))
    edges = stored(needs.join(nodes, KEY).join(there, ["conv_id", "needed_id"]).select(*KEY, "needed_id").distinct(), "needs")
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, int(largest).bit_length())
    level = nodes.withColumn("level", F.lit(0).cast("long"))
    while True:
        # Calls without a level count as the deepest, so whatever needs them follows them and loses its own.
        below = level.select("conv_id", F.col("call_id").alias("needed_id"), "level")
        deepest = edges.join(below, ["conv_id", "needed_id"]).groupBy(*KEY).agg(
            F.max(F.struct(F.coalesce("level", F.lit((1 << 62))).alias("level"), "needed_id"))["needed_id"].alias("jump"))
        chain = stored(nodes.join(deepest, KEY, "left").select(
            *KEY, "jump", F.col("jump").isNotNull().cast("long").alias("d")), "chains")
        # Calls that have come to the end of their chain are put aside. After that many doublings only those behind a
        # circle still have somewhere to go.
        ended, moving = [chain.where(F.col("jump").isNull())], chain.where(F.col("jump").isNotNull())
        for _ in range(rounds):
            if moving.isEmpty():
                break
            on = reduce(DataFrame.unionByName, ended, moving).select(
                "conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("d").alias("more"))
            moved = stored(moving.join(on, ["conv_id", "jump"], "left").select(
                *KEY, F.col("next").alias("jump"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")), "chains")
            ended.append(moved.where(F.col("jump").isNull()))
            moving = moved.where(F.col("jump").isNotNull())
        chain = reduce(DataFrame.unionByName, ended, moving).select(*KEY, "jump", "d")
        stuck = F.col("jump").isNotNull()
        new = stored(chain.select(*KEY, F.when(~stuck, F.col("d")).alias("level")), "levels")
        changed = new.join(level.withColumnRenamed("level", "old"), KEY).where(~F.col("level").eqNullSafe(F.col("old")))
        if changed.isEmpty():
            return new
        level = new


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame, needs: DataFrame) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, call_id, level, turn, name, n_calls, n_results,
    status, error, record.

    calls: conv_id, turn, call_id, name, arguments (JSON text, null for {}). results: conv_id, turn, call_id, content. tools: name,
    schema (JSON text). needs: conv_id, call_id, needed_id. Of repeated calls or results with one identifier the earliest
    counts (by turn, then by the other columns) and their number is given. Calls and results without a
    conversation or identifier link to nothing and are returned one by one: calls with status no_id, results as
    orphan_result. Status is the first that holds of orphan_result, no_id, cycle, unknown_tool, bad_schema (the tool's schema is
    none), invalid_arguments (with an error), missing_result, result_before_call, ok. Arguments that are no JSON, hold a number
    beyond all doubles or half a surrogate pair are invalid and stand in the record as text. Empty tables and extra columns are fine."""
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.where(named).groupBy(*KEY).agg(
        F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    first = stored(first.select(*KEY, F.col("c.turn").alias("call_turn"), "c.name", "c.arguments", "n_calls"), "calls")
    answered = results.where(named).groupBy(*KEY).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answered = answered.select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    schemas = tools.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("schema").alias("schema"))
    linked = first.join(levels(first, needs), KEY).join(answered, KEY, "full")
    loose = calls.where(~named).select(
        "conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", F.lit(1).cast("long").alias("n_calls"))
    lost = results.where(~named).select(
        "conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    whole = linked.unionByName(loose, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True).join(schemas, "name", "left")
    ready = whole.select(F.col("conv_id").cast("long"), "call_id", F.col("level").cast("long"), F.col("call_turn").cast("long"),
                         F.col("result_turn").cast("long"), "name", "arguments", "content", "schema",
                         *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_calls", "n_results")])
    return ready.mapInArrow(_finish, _DDL)


#: The tools that turns of plain conversations are read as calls of.
TOOLS = [
    ("answer", '{"type":"object","required":["prompt","turn"],"additionalProperties":false,"properties":'
               '{"prompt":{"type":"string","minLength":1,"maxLength":400},"turn":{"type":"integer","minimum":0}}}'),
    ("continue", '{"type":"object","required":["prompt","turn"],"properties":'
                 '{"prompt":{"type":"string","minLength":1},"turn":{"type":"integer","maximum":5}}}'),
]


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and needs of conversations without tools: each turn of a user is a call (answer in the first two turns,
    continue or follow later), the next turn of an assistant its result, and a call needs the one two turns before. Turns of
    other roles (system prompts) are neither calls nor results and have no rows."""
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    users = conversations.where(F.col("role") == "user")
    calls = users.select(
        "conv_id", "turn", name(turn).alias("call_id"),
        F.when(turn < 2, "answer").when(turn % 4 < 3, "continue").otherwise("follow").alias("name"),
        F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt"))).alias("arguments"))
    results = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    needs = users.select("conv_id", name(turn).alias("call_id"), name(turn - 2).alias("needed_id"))
    return calls, results, needs


def digest(conversations: DataFrame) -> DataFrame:
    """The linked calls of whole conversations."""
    calls, results, needs = from_turns(conversations)
    tools = conversations.sparkSession.createDataFrame(TOOLS, "name string, schema string")
    return link_tool_calls(calls, results, tools, needs)
