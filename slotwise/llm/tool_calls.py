"""Chat formatting: linking of tool calls with their results.

Calls and results are hash-joined by (conversation, identifier), ordered
topologically by their declared dependencies, their arguments are validated
against JSON schemas joined by tool name, and each call is serialised as
canonical JSON (sorted keys, no spaces, no escapes beyond what JSON needs).

Tables
* calls: conv_id, turn, pos, call_id, name, arguments (JSON text), depends_on (array of ids)
* results: conv_id, turn, call_id, content
* schemas: name, schema (JSON text; type, required, properties,
  additionalProperties, items, enum, minimum, maximum, minLength, maxLength)

Order: by (level, turn, pos).  Where every dependency precedes its call, the
page order already is topological and the level is 0.  Only conversations with
a dependency on a later call get levels, by rounds of removing the calls whose
dependencies are placed; calls on a cycle keep a null level and the error
``cycle``.

Aggregates by (conversation, identifier) are partial before the shuffle and no
conversation is collected or windowed, so one conversation may hold any share
of the rows.

Defined cases: equal rows count once; a call without identifier has status
``no_id``; of several calls with one identifier the first owns it, the others
are ``duplicate_id``; of several results the first after the call is linked,
others are ``repeated_result``; results before their call are ``early_result``
and without a call ``orphan_result``; broken JSON arguments are an error and
are kept as a JSON string, as are arguments that JSON text can hold but canonical JSON
in UTF-8 cannot (numbers beyond a double, lone surrogates, nesting beyond the parser's
depth); a schema that is no schema (broken text, a rule of the wrong type) is the error
``schema`` at its path and its other rules still apply; of several schemas of one tool the
smallest text applies, with the error ``several_schemas``; a dependency on an unknown
identifier is an error and does not order.  Empty tables give an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import column, materialise, read_table

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(f"{text} is beyond a double")
    return value


def canonical(value: Any) -> str:
    """Canonical JSON: sorted keys, no white space, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parse_json(text: str | None) -> Any:
    """Value of a strict JSON text that canonical JSON in UTF-8 can hold; ValueError otherwise."""
    if text is None:
        raise ValueError("no JSON")
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
        canonical(value).encode()
    except RecursionError as deep:
        raise ValueError("nested too deep") from deep
    return value


def read_arguments(text: str | None) -> tuple[Any, list[str]]:
    """(value, errors) of an arguments text; arguments may come as JSON in a string."""
    try:
        value = parse_json(text)
    except ValueError:
        return text, ["json:$"]
    if isinstance(value, str):
        try:
            value = parse_json(value)
        except ValueError:
            pass
    return value, []


def read_schema(text: str) -> Any:
    """Schema of a JSON text; None, which is no schema, if it is broken."""
    try:
        return parse_json(text)
    except ValueError:
        return None


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _texts(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(k, str) for k in x)


#: What the value of each known rule must be.
_RULES = {
    "type": lambda x: (isinstance(x, str) and x in _TYPES) or (_texts(x) and all(k in _TYPES for k in x)),
    "enum": lambda x: isinstance(x, list),
    "required": _texts,
    "properties": lambda x: isinstance(x, dict),
    "additionalProperties": lambda x: isinstance(x, (bool, dict)),
    "items": lambda x: isinstance(x, (bool, dict)),
    **dict.fromkeys(("minLength", "maxLength", "minimum", "maximum"), _number),
}


def violations(value: Any, schema: Any, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``, as ``rule:path`` in sorted order.

    ``true`` allows every value and ``false`` none.  Anything else that is no object, and
    every rule whose own value is of the wrong type, is ``schema:path``.
    """
    if schema is True:
        return []
    if schema is False:
        return [f"false:{at}"]
    if not isinstance(schema, dict):
        return [f"schema:{at}"]
    rules = {k: v for k, v in schema.items() if k in _RULES and _RULES[k](v)}
    out = [f"schema:{at}"] * any(k in _RULES and k not in rules for k in schema)
    if "type" in rules:
        kinds = rules["type"] if isinstance(rules["type"], list) else [rules["type"]]
        if not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
            return sorted([*out, f"type:{at}"])
    if "enum" in rules and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in rules["enum"]):
        out.append(f"enum:{at}")
    if isinstance(value, str):
        out += [f"minLength:{at}"] * (len(value) < rules.get("minLength", 0)) + [f"maxLength:{at}"] * (len(value) > rules.get("maxLength", len(value)))
    elif _number(value):
        out += [f"minimum:{at}"] * (value < rules.get("minimum", value)) + [f"maximum:{at}"] * (value > rules.get("maximum", value))
    elif isinstance(value, dict):
        known, other = rules.get("properties", {}), rules.get("additionalProperties", True)
        out += [f"required:{at}.{k}" for k in rules.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif other is False:
                out.append(f"unknown:{at}.{k}")
            else:
                out += violations(v, other, f"{at}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += violations(v, rules.get("items", True), f"{at}[{i}]")
    return sorted(out)


def check_arguments(value: Any, schema: Any) -> list[str]:
    """:func:`violations`, with the error ``depth`` where both are nested too deep to compare."""
    try:
        return violations(value, schema)
    except RecursionError:
        return ["depth:$"]


def _object(text: Column) -> Column:
    """True for texts that begin like a JSON object after white space."""
    return F.coalesce(F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), F.lit(False))


def _calls_in(text: Column) -> Column:
    """The items of ``tool_calls`` as JSON texts; null for any other text."""
    return F.when(_object(text), F.from_json(text, "tool_calls array<string>")["tool_calls"])


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text) whose text is JSON tool traffic.

    Assistant texts ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``
    (also nested in ``function``) hold calls; tool texts
    ``{"tool_call_id", "content"}`` hold results, any other tool text is a result
    without identifier.  Other messages hold none.
    """
    m = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    raw = _calls_in(F.col("text"))
    each = m.filter(F.col("role") == "assistant").select("conv_id", "turn", F.posexplode(raw).alias("pos", "raw"))

    def get(name: str):
        return F.coalesce(F.get_json_object("raw", f"$.{name}"), F.get_json_object("raw", f"$.function.{name}"))

    calls = each.select(
        "conv_id", "turn", "pos", get("id").alias("call_id"), get("name").alias("name"), get("arguments").alias("arguments"),
        F.from_json(get("depends_on"), "array<string>").alias("depends_on"),
    )
    found = {k: F.when(_object(F.col("text")), F.get_json_object("text", f"$.{k}")) for k in ("tool_call_id", "content")}
    results = m.filter(F.col("role") == "tool").select(
        "conv_id", "turn", found["tool_call_id"].alias("call_id"), F.when(found["tool_call_id"].isNull(), F.coalesce(found["content"], "text")).otherwise(found["content"]).alias("content")
    )
    return calls, results


def _levels(owners: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls of conversations with a forward dependency; null on cycles."""
    forward = edges.filter("forward").select("conv_id").distinct()
    todo = materialise(owners.select("conv_id", "call_id").join(forward, "conv_id", "left_semi"))
    links = materialise(edges.select("conv_id", "call_id", "dep").join(forward, "conv_id", "left_semi"))
    placed, level = None, 0
    while todo.limit(1).count():
        waiting = links.select("conv_id", "call_id").distinct()
        ready = materialise(todo.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            stuck = todo.withColumn("level", F.lit(None).cast("int"))
            return stuck if placed is None else placed.unionByName(stuck)
        placed = ready if placed is None else placed.unionByName(ready)
        done = ready.select("conv_id", "call_id")
        todo = materialise(todo.join(done, ["conv_id", "call_id"], "left_anti"))
        links = materialise(links.join(done.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_anti").select("conv_id", "call_id", "dep"))
        level += 1
    return todo.withColumn("level", F.lit(None).cast("int")) if placed is None else placed


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per unlinked result.

    Columns: conv_id, turn, pos, call_id, name, level, status, errors (sorted
    array), canonical (JSON text of the call with its result).
    """
    ident = ["conv_id", "call_id"]
    calls = materialise(calls.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("pos").cast("int").alias("pos"), F.col("call_id").cast("string").alias("call_id"),
        "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"),
    ).distinct())
    results = materialise(results.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), F.col("content").cast("string").alias("content")).distinct())
    owners = materialise(calls.filter(F.col("call_id").isNotNull()).groupBy(*ident).agg(F.min(F.struct("turn", "pos")).alias("first")))

    with_call = results.join(owners, ident, "left")
    after = with_call.filter(F.col("turn") >= F.col("first.turn"))
    linked = after.groupBy(*ident).agg(F.min(F.struct("turn", "content")).alias("result"))
    lone = with_call.join(linked, ident, "left").withColumn(
        "status",
        F.when(F.col("call_id").isNull(), "no_id").when(F.col("first").isNull(), "orphan_result")
        .when(F.col("turn").isNull() | (F.col("turn") < F.col("first.turn")), "early_result")
        .when(F.struct("turn", "content").eqNullSafe(F.col("result")), "linked").otherwise("repeated_result"),
    ).filter(F.col("status") != "linked")

    own = calls.join(owners, ident, "left").withColumn("own", F.coalesce(F.struct("turn", "pos") == F.col("first"), F.lit(False)))
    deps = own.filter("own").select(*ident, "first", F.explode("depends_on").alias("dep"))
    target = owners.select("conv_id", F.col("call_id").alias("dep"), F.col("first").alias("dep_first"))
    edges = materialise(deps.join(target, ["conv_id", "dep"], "left").withColumn("forward", F.coalesce(F.col("dep_first") >= F.col("first"), F.lit(False))))
    unknown = edges.filter(F.col("dep_first").isNull()).groupBy(*ident).agg(F.collect_set(F.concat(F.lit("unknown_dependency:"), "dep")).alias("unknown"))
    levels = _levels(owners, edges.filter(F.col("dep_first").isNotNull()))

    marked = (
        own.join(linked, ident, "left").join(unknown, ident, "left").join(levels.withColumn("levelled", F.lit(True)), ident, "left")
        .join(schemas.groupBy("name").agg(F.min("schema").alias("schema"), (F.min("schema") < F.max("schema")).alias("several")), "name", "left")
        .select(
            "conv_id", "turn", "pos", "call_id", "name", "arguments", "schema", "several",
            F.when(F.col("own"), F.col("result")).alias("result"), F.when(F.col("own"), F.coalesce("unknown", F.array().cast("array<string>"))).alias("unknown"),
            F.when(F.col("levelled").isNull() | ~F.col("own"), F.lit(0)).otherwise(F.col("level")).alias("level"),
            F.when(F.col("call_id").isNull(), "no_id").when(~F.col("own"), "duplicate_id").when(F.col("result").isNull(), "no_result").otherwise("linked").alias("status"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemas_seen: dict[str, Any] = {}
        for batch in batches:
            errors, texts = [], []
            for row in batch.select(["call_id", "name", "arguments", "schema", "several", "result", "unknown", "level"]).to_pylist():
                found = list(row["unknown"] or [])
                if row["level"] is None:
                    found.append("cycle")
                value, broken = read_arguments(row["arguments"])
                found += broken
                if not broken:
                    if row["schema"] is None:
                        found.append("unknown_tool")
                    else:
                        if row["schema"] not in schemas_seen:
                            schemas_seen[row["schema"]] = read_schema(row["schema"])
                        found += check_arguments(value, schemas_seen[row["schema"]])
                        found += ["several_schemas"] * row["several"]
                errors.append(sorted(found))
                made = {"arguments": value, "id": row["call_id"], "name": row["name"]}
                if row["result"] is not None:
                    made["result"] = row["result"]["content"]
                texts.append(canonical(made))
            keep = ["conv_id", "turn", "pos", "call_id", "name", "level", "status"]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], [*keep, "errors", "canonical"])

    kind = calls.schema["conv_id"].dataType.simpleString()
    made = marked.mapInArrow(run, f"conv_id {kind}, turn long, pos int, call_id string, name string, level int, status string, errors array<string>, canonical string")
    none = F.lit(None)
    return made.unionByName(lone.select(
        "conv_id", "turn", none.cast("int").alias("pos"), "call_id", none.cast("string").alias("name"), none.cast("int").alias("level"), "status",
        F.array().cast("array<string>").alias("errors"), none.cast("string").alias("canonical"),
    ))


# fixed values: the tools that the turns of ``conversations`` stand for
TURN_SCHEMAS = {
    "answer": {
        "type": "object", "required": ["prompt", "turn", "words"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "maximum": 60}},
    },
    "configure": {
        "type": "object", "required": ["prompt", "turn", "words"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "maxLength": 200}, "turn": {"type": "integer"}, "words": {"type": "integer"}},
    },
}


def turns_as_traffic(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as tool traffic: a user (system) turn calls ``answer`` (``configure``) with its text,
    an assistant turn without ``tool_calls`` is the result of the call one turn before, in JSON or not; a call
    depends on the call two turns before."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))

    def ident(turn):
        return F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), turn.cast("string"))

    prompt = F.coalesce("text", F.lit(""))
    words = F.size(F.split(prompt, " "))
    calls = m.filter(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", F.lit(0).alias("pos"), ident(F.col("turn")).alias("call_id"), F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"),
        F.to_json(F.struct(prompt.alias("prompt"), F.col("turn").alias("turn"), words.alias("words"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(ident(F.col("turn") - 2))).alias("depends_on"),
    )
    results = m.filter((F.col("role") == "assistant") & _calls_in(F.col("text")).isNull()).select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Tool traffic of every conversation: JSON tool messages, and plain turns read as calls and results."""
    messages = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    json_calls, json_results = parse_messages(messages)
    calls, results = turns_as_traffic(messages)
    schemas = spark.createDataFrame([(k, canonical(v)) for k, v in TURN_SCHEMAS.items()], "name string, schema string")
    out = link_calls(calls.unionByName(json_calls), results.unionByName(json_results), schemas)
    return out.withColumn("errors", F.array_join("errors", ","))


OP7_SQL = r"""
WITH m AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), calls AS (
  SELECT conv_id, turn, 'c-' || conv_id || '-' || turn AS call_id,
         CASE WHEN role = 'user' THEN 'answer' ELSE 'configure' END AS name, coalesce(text, '') AS prompt,
         len(string_split(coalesce(text, ''), ' ')) AS words
  FROM m WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, turn, 'c-' || conv_id || '-' || (turn - 1) AS call_id, text AS content FROM m WHERE role = 'assistant'
), joined AS (
  SELECT c.*, r.call_id IS NOT NULL AS has, r.content, d.call_id IS NULL AND c.turn >= 2 AS lost
  FROM calls c LEFT JOIN results r USING (conv_id, call_id)
  LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.turn = c.turn - 2
), rows_ AS (
  SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, call_id, name, CAST(0 AS INTEGER) AS level,
         CASE WHEN has THEN 'linked' ELSE 'no_result' END AS status,
         concat_ws(',',
           CASE WHEN name = 'configure' AND length(prompt) > 200 THEN 'maxLength:$.prompt' END,
           CASE WHEN name = 'answer' AND words > 60 THEN 'maximum:$.words' END,
           CASE WHEN name = 'answer' AND length(prompt) < 1 THEN 'minLength:$.prompt' END,
           CASE WHEN lost THEN 'unknown_dependency:c-' || conv_id || '-' || (turn - 2) END) AS errors,
         '{"arguments":{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"turn":' || turn || ',"words":' || words || '},"id":"' || call_id || '","name":"' || name || '"'
         || CASE WHEN has THEN ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') ELSE '' END || '}' AS canonical
  FROM joined
  UNION ALL
  SELECT r.conv_id, r.turn, NULL, r.call_id, NULL, NULL, 'orphan_result', '', NULL
  FROM results r LEFT JOIN calls c USING (conv_id, call_id) WHERE c.call_id IS NULL
)
SELECT * FROM rows_
"""
