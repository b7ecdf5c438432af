"""Chat formatting: tool calls linked with their results.

Calls and results are joined by the call's identifier, with a hash join whose
sides Spark partitions.  A message must come after what it depends on (a result
after its call, a call after the results that it names); otherwise messages
keep the order of their turns.  Arguments are checked against the tool's JSON
schema, and every message becomes a line of canonical JSON: sorted keys, no
blanks, whole numbers without a fraction.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .numbering import number_rows

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Words that hold one schema, a list of schemas, or schemas by name.
_ONE = {"additionalProperties", "items", "not", "if", "then", "else", "contains", "propertyNames"}
_LISTS = {"anyOf", "oneOf", "allOf", "prefixItems"}
_NAMED = {"properties", "patternProperties", "$defs", "definitions"}
_PLAIN = {"type", "enum", "const", "$ref", "required", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
          "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "minContains",
          "maxContains", "minProperties", "maxProperties", "dependentRequired"}
#: Words that say nothing of the value.
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$comment", "$schema",
          "format", "contentEncoding", "contentMediaType"}


def check_schema(schema, root=None) -> None:
    """Raise ValueError for a word that :func:`valid` does not know, and for a
    $ref that leads nowhere in the schema."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"no schema: {schema!r}")
    unknown = schema.keys() - _ONE - _LISTS - _NAMED - _PLAIN - _NOTES
    if unknown:
        raise ValueError(f"schema words without a check: {sorted(unknown)}")
    kinds = schema.get("type", [])
    wrong = {*(kinds if isinstance(kinds, list) else [kinds])} - _TYPES.keys() - {"number", "integer"}
    if wrong:
        raise ValueError(f"unknown types: {sorted(wrong)}")
    for word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
        if not _number(schema.get(word, 1)):
            raise ValueError(f"{word} is no number: {schema[word]!r}")
    seen = [schema]
    while isinstance(seen[-1], dict) and "$ref" in seen[-1]:
        seen.append(_pointed(root, seen[-1]["$ref"]))
        if any(s is seen[-1] for s in seen[:-1]):
            raise ValueError(f"$ref leads back to itself: {schema['$ref']}")
    below = [schema[w] for w in _ONE & schema.keys()]
    below += [s for w in _LISTS & schema.keys() for s in schema[w]]
    below += [s for w in _NAMED & schema.keys() for s in schema[w].values()]
    for s in below:
        check_schema(s, root)
    for p in [*schema.get("patternProperties", ()), *([schema["pattern"]] if "pattern" in schema else ())]:
        re.compile(p)


def _pointed(root, ref: str):
    """The schema that a reference inside ``root`` (#/...) names."""
    at = root
    if ref != "#" and not ref.startswith("#/"):
        raise ValueError(f"$ref to another document: {ref}")
    for step in ref.split("/")[1:]:
        step = unquote(step).replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(step)] if isinstance(at, list) else at[step]
        except (KeyError, IndexError, TypeError, ValueError):
            raise ValueError(f"$ref leads nowhere: {ref}") from None
    return at


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def valid(value, schema, root=None) -> bool:
    """Does a JSON value fit a schema?  Implemented are the words of _ONE,
    _LISTS, _NAMED and _PLAIN ($ref inside the schema only); _NOTES do not
    restrict, and any other word raises ValueError."""
    if root is None:
        check_schema(schema)
        root = schema
    if isinstance(schema, bool):
        return schema

    def fits(x, s) -> bool:
        return valid(x, s, root)

    number = _number(value)
    kind = schema.get("type")
    if kind is not None:
        whole = number and (isinstance(value, int) or value.is_integer())
        if not any(number if k == "number" else whole if k == "integer" else isinstance(value, _TYPES[k])
                   for k in (kind if isinstance(kind, list) else [kind])):
            return False
    same = canonical(value) if {"enum", "const"} & schema.keys() else None
    if "enum" in schema and same not in map(canonical, schema["enum"]) or "const" in schema and same != canonical(schema["const"]):
        return False
    if "$ref" in schema and not fits(value, _pointed(root, schema["$ref"])):
        return False
    if not (all(fits(value, s) for s in schema.get("allOf", ())) and ("anyOf" not in schema or any(fits(value, s) for s in schema["anyOf"]))
            and ("oneOf" not in schema or sum(fits(value, s) for s in schema["oneOf"]) == 1)
            and not ("not" in schema and fits(value, schema["not"]))):
        return False
    if "if" in schema and not fits(value, schema.get("then" if fits(value, schema["if"]) else "else", True)):
        return False
    if number:
        step = schema.get("multipleOf")
        return (schema.get("minimum", value) <= value <= schema.get("maximum", value)
                and schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf)
                and (step is None or math.isfinite(value) and Fraction(str(value)) % Fraction(str(step)) == 0))
    if isinstance(value, str):
        return (schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf)
                and ("pattern" not in schema or re.search(schema["pattern"], value) is not None))
    if isinstance(value, list):
        first = schema.get("prefixItems", ())
        inside = sum(fits(x, schema["contains"]) for x in value) if "contains" in schema else None
        return (schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf)
                and all(map(fits, value, first)) and all(fits(x, schema.get("items", True)) for x in value[len(first):])
                and (inside is None or schema.get("minContains", 1) <= inside <= schema.get("maxContains", math.inf))
                and not (schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value)))
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        other = [k for k in value if k not in known and not any(re.search(p, k) for p in patterns)]
        return (all(k in value for k in schema.get("required", ()))
                and schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf)
                and all(x in value for k, needed in schema.get("dependentRequired", {}).items() if k in value for x in needed)
                and all(fits(k, schema.get("propertyNames", True)) for k in value)
                and all(fits(value[k], s) for k, s in known.items() if k in value)
                and all(fits(x, s) for p, s in patterns.items() for k, x in value.items() if re.search(p, k))
                and all(fits(value[k], schema.get("additionalProperties", True)) for k in other))
    return True


def _whole(value):
    if isinstance(value, float) and math.isfinite(value) and value == math.floor(value) and abs(value) < 2 ** 53:
        return int(value)
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return json.dumps(_whole(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def read_arguments(text: str | None, schema: dict | None) -> tuple:
    """(value, valid) of a call's arguments.  What is no JSON (also numbers that
    are not finite, and escapes of half a character) or nested too deep to read
    stays the text, and is not valid; so are arguments without a schema."""
    try:
        value = json.loads(text or "")
        json.dumps(value, allow_nan=False, ensure_ascii=False).encode()
        canonical(value)
        return value, schema is not None and valid(value, schema, schema)
    except (ValueError, RecursionError):
        return text, False


def _settle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``nodes`` (conv_id, node, ``at``: place of its own) with ``at`` raised to
    at least that of each node before it, one step deeper, and the nodes left
    that follow or belong to a cycle (None: there are none).

    A round takes the places of the nodes before; a node before that waits for
    one node only is passed over, so a chain halves in each round and other
    graphs lose at least their first layer.  A round in which no node is done
    leaves cycles and what follows them."""
    open_edges, waiting = stored(edges.withColumn("steps", F.lit(1).cast("long")), "open"), None
    nodes = stored(nodes, "places")
    while True:
        waits = stored(open_edges.groupBy("conv_id", "node").agg(
            F.count(F.lit(1)).alias("n"), F.min("before").alias("next"), F.max("steps").alias("more")), "waits")
        left = waits.count()
        if not left:
            return nodes, None
        if left == waiting:
            return nodes, waits.select("conv_id", "node")
        waiting = left
        here = nodes.join(waits, ["conv_id", "node"], "left").select(
            "conv_id", F.col("node").alias("before"), F.col("at").alias("b"), "n", "next", "more")
        met = stored(open_edges.join(here, ["conv_id", "before"]), "met")
        raised = met.groupBy("conv_id", "node").agg(
            F.max(F.struct(F.col("b.due").alias("due"), (F.col("b.depth") + F.col("steps")).alias("depth"))).alias("b"))
        nodes = stored(nodes.join(raised, ["conv_id", "node"], "left").select(
            "conv_id", "node", F.greatest("at", "b").alias("at")), "places")
        one = F.col("n") == 1
        open_edges = stored(met.where("n is not null").select(
            "conv_id", "node", F.when(one, F.col("next")).otherwise(F.col("before")).alias("before"),
            (F.col("steps") + F.when(one, F.col("more")).otherwise(0)).alias("steps"))
            .groupBy("conv_id", "node", "before").agg(F.max("steps").alias("steps")), "open")


def cycle_members(nodes: list, befores: list) -> list:
    """The nodes of links (node, before) that reach themselves."""
    follow, back = {}, {}
    for n, b in zip(nodes, befores):
        follow.setdefault(n, []).append(b)
        back.setdefault(b, []).append(n)
    done, order = set(), []
    for start in follow:  # nodes in the order in which a walk leaves them
        walk = [] if start in done else [(start, iter(follow[start]))]
        done.add(start)
        while walk:
            step = next((b for b in walk[-1][1] if b not in done), None)
            if step is None:
                order.append(walk.pop()[0])
            else:
                done.add(step)
                walk.append((step, iter(follow.get(step, ()))))
    seen, out = set(), []
    for start in reversed(order):  # what reaches back to a start is of one strong component
        group, at = [start] if start not in seen else [], 0
        seen.add(start)
        while at < len(group):
            for n in back.get(group[at], ()):
                if n not in seen:
                    seen.add(n)
                    group.append(n)
            at += 1
        if len(group) > 1 or group and start in follow.get(start, ()):
            out += group
    return out


def _cyclic(edges: DataFrame, left: DataFrame) -> DataFrame:
    """(conv_id, node): the members of cycles among the nodes ``left``.  What
    merely follows a cycle is taken off first, so a task has the cycles of a
    conversation and the ways between them."""
    ends = left.select("conv_id", F.col("node").alias("before"))
    core = stored(edges.join(left, ["conv_id", "node"], "left_semi").join(ends, ["conv_id", "before"], "left_semi"), "core")
    turned = core.select("conv_id", F.col("before").alias("node"), F.col("node").alias("before"))
    origin = F.struct(F.lit(0).cast("long").alias("due"), F.lit(0).cast("long").alias("depth")).alias("at")
    _, held = _settle(left.select("conv_id", "node", origin), turned)
    core = core.join(held, ["conv_id", "node"], "left_semi").join(
        held.withColumnRenamed("node", "before"), ["conv_id", "before"], "left_semi").select("conv_id", "node", "before")

    def members(links: pa.Table) -> pa.Table:
        found = cycle_members(links.column("node").to_pylist(), links.column("before").to_pylist())
        return pa.table({"conv_id": pa.array([links.column("conv_id")[0].as_py()] * len(found), pa.string()),
                         "node": pa.array(found, pa.string())})

    return stored(core.groupBy("conv_id").applyInArrow(members, "conv_id string, node string"), "cyclic")


def raise_to_dependencies(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, ``node``, and ``after``: the nodes that must
    come before) with ``due`` and ``depth``: in the order of (due, depth, turn)
    each message comes after all it depends on, along chains of any length.
    Where nothing is out of turn, due is the turn and depth 0.  Members of
    cycles (``cyclic``) keep their turn; what follows them comes after them."""
    now = stored(messages, "messages")
    places = stored(now.groupBy("conv_id", "node").agg(F.max("turn").alias("late_due")), "places")
    timed = places.where("late_due is not null")  # a null turn comes first and waits for nothing
    edges = stored(now.select("conv_id", "node", F.explode("after").alias("before")).distinct()
                   .join(timed, ["conv_id", "node"])
                   .join(timed.select("conv_id", F.col("node").alias("before"), F.col("late_due").alias("b")),
                         ["conv_id", "before"])
                   .select("conv_id", "node", "before", (F.col("b") >= F.col("late_due")).alias("late")), "dependencies")
    moved = stored(edges.where("late").select("conv_id").distinct(), "out-of-turn")
    if not moved.limit(1).count():
        return now.join(places.withColumnRenamed("late_due", "due"), ["conv_id", "node"]).select(
            *now.columns, "due", F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"))
    edges = stored(edges.drop("late").join(moved, "conv_id", "left_semi"), "dependencies")
    own = F.struct(F.col("late_due").alias("due"), F.lit(0).cast("long").alias("depth")).alias("at")
    nodes = timed.join(moved, "conv_id", "left_semi").select("conv_id", "node", own)
    settled, left = _settle(nodes, edges)
    cyclic = None
    if left is not None:
        cyclic = _cyclic(edges, left).withColumn("cyclic", F.lit(True))
        settled, _ = _settle(nodes, edges.join(cyclic, ["conv_id", "node"], "left_anti"))
    placed = now.join(places, ["conv_id", "node"]).join(settled, ["conv_id", "node"], "left")
    placed = placed.join(cyclic, ["conv_id", "node"], "left") if cyclic is not None else placed.withColumn("cyclic", F.lit(False))
    stuck = F.coalesce("cyclic", F.lit(False))
    return placed.select(*now.columns,
                         F.when(stuck, F.col("turn")).otherwise(F.coalesce("at.due", "late_due")).alias("due"),
                         F.when(stuck, F.lit(0)).otherwise(F.coalesce("at.depth", F.lit(0))).cast("long").alias("depth"),
                         stuck.alias("cyclic"))


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, position, turn, role, call_id, status, args_valid, line), one
    row per message of ``messages`` (conv_id, turn, role, content, call_id,
    name, arguments as JSON text, needs: ids of calls whose results it uses).

    A message with a name is a call, one with a call_id alone a result.
    ``status``: a call is answered, unanswered, or ambiguous (several calls of
    its conversation share the id); a result is linked, orphan (no such call)
    or ambiguous; other messages are plain; messages in a dependency cycle are
    cyclic.  ``args_valid`` is null for messages that are no calls, false for
    arguments that are no JSON, fail the schema, or name a tool without one;
    a schema with a word that is not implemented raises ValueError.
    ``line`` is the message as canonical JSON; null fields are left out, and
    arguments that are no JSON stay text.

    Null ids, turns, roles and contents are allowed: a null conversation is one
    of its own, a null turn comes first, and a call without an id is
    unanswered.  Repeated rows are kept.  Columns of other names are not read;
    no rows give no rows.
    """
    small_batches(messages.sparkSession)
    for schema in schemas.values():
        check_schema(schema)
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                        "content", "call_id", "name", "arguments", "needs")
    is_call, is_result = F.col("name").isNotNull(), F.col("name").isNull() & F.col("call_id").isNotNull()
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    m = (m.withColumn("conv", conv)
         .withColumn("kind", F.when(is_call, "call").when(is_result, "result").otherwise("plain"))
         .withColumn("needs", F.coalesce(F.filter("needs", lambda x: x.isNotNull()), F.array().cast("array<string>"))))
    m = stored(m, "chat")
    # the hash join by identifier: what each id stands for, then each message with it
    links = stored(m.where(F.col("call_id").isNotNull()).groupBy("conv", "call_id").agg(
        F.count(F.when(F.col("kind") == "call", 1)).alias("calls"),
        F.count(F.when(F.col("kind") == "result", 1)).alias("results")), "links")
    m = m.join(links, ["conv", "call_id"], "left")
    status = (F.when(F.col("kind") == "plain", "plain").when(F.col("calls") > 1, "ambiguous")
              .when(F.col("kind") == "call", F.when(F.col("results") > 0, "answered").otherwise("unanswered"))
              .otherwise(F.when(F.col("calls") > 0, "linked").otherwise("orphan")))
    node = (F.when(F.col("call_id").isNull(), F.concat(F.lit("m:"), F.coalesce(F.col("turn").cast("string"), F.lit("-"))))
            .otherwise(F.concat(F.substring("kind", 1, 1), F.lit(":"), F.col("call_id"))))
    after = (F.when(F.col("kind") == "result", F.array(F.concat(F.lit("c:"), F.col("call_id"))))
             .when(F.col("kind") == "call", F.transform("needs", lambda x: F.concat(F.lit("r:"), x)))
             .otherwise(F.array().cast("array<string>")))
    linked = m.select("conv", "conv_id", "turn", "role", "content", "call_id", "name", "arguments", "kind",
                      status.alias("status"), node.alias("node"), after.alias("after"))
    ordered = raise_to_dependencies(linked.withColumnRenamed("conv_id", "id").withColumnRenamed("conv", "conv_id"))
    numbered = number_rows(ordered.drop("after", "node"), ["conv_id"],
                           ["due", "depth", "turn", "kind", "role", "call_id", "content", "arguments"], "position")

    def write(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            valid_, lines = [], []
            for role, content, call_id, name, arguments in zip(*columns[3:8]):
                line = {"role": role, "content": content}
                ok = None
                if name is not None:
                    value, ok = read_arguments(arguments, schemas.get(name))
                    line["tool_call"] = {k: v for k, v in (("id", call_id), ("name", name), ("arguments", value))
                                         if v is not None}
                elif call_id is not None:
                    line["tool_call_id"] = call_id
                valid_.append(ok)
                lines.append(canonical({k: v for k, v in line.items() if v is not None}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 2, 3, 5, 8)), pa.array(valid_, pa.bool_()), pa.array(lines, pa.string())],
                ["conv_id", "position", "turn", "role", "call_id", "status", "args_valid", "line"])

    return numbered.select(F.col("id").alias("conv_id"), "position", "turn", "role", "content", "call_id", "name",
                           "arguments", F.when(F.col("cyclic"), "cyclic").otherwise(F.col("status")).alias("status")
                           ).mapInArrow(write, "conv_id long, position long, turn long, role string, call_id string, "
                                               "status string, args_valid boolean, line string")


def exchanges(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): a user's
    turn calls the tool ``reply`` with the text, and uses the reply before it;
    an assistant's turn is the result of the turn before it."""
    def call(turn: Column) -> Column:
        return F.concat_ws("-", "conv_id", turn.cast("string"))

    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", "role", F.when(~user | F.col("role").isNull(), F.col("text")).alias("content"),
        F.when(user, call(F.col("turn"))).when(assistant, call(F.col("turn") - 1)).alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, F.to_json(F.struct(F.length("text").alias("n_chars"), "text"))).alias("arguments"),
        F.when(user, F.array(call(F.col("turn") - 2))).alias("needs"))


#: Schema of the tool ``reply``.
REPLY = {"reply": {"type": "object", "required": ["n_chars", "text"], "additionalProperties": False,
                   "properties": {"n_chars": {"type": "integer", "minimum": 1},
                                  "text": {"type": "string", "minLength": 1}}}}
