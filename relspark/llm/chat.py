"""Tool-call linking in chat logs.

Calls and results are read from messages, joined by (conversation, call id), ordered so that a call
follows the calls whose results it uses, validated against the schema of their tool, and written as
canonical JSON (sorted keys, no spaces, UTF-8).

A message whose text is a JSON object counts as calls if the role is ``assistant`` and it has
``tool_calls`` (a list of ``{"id", "name", "arguments", "depends"}``), as a result if the role is
``tool`` and it has ``tool_call_id``. With ``plain=True`` other turns are linked too: a user's turn
calls ``reply`` with its text as ``prompt``, a system's turn calls ``instruct``, and an assistant's
turn is the result of the turn before; a user's turn depends on the user's turn two before.

Order: (turn, index) is a topological order unless a call depends on a later one. Such forward
references raise the call's key to that of what it depends on, one deeper, round by round and only
in the conversations that have any; a call that would go deeper than its conversation has forward
references lies on or behind a cycle and is marked ``cyclic``. The key (order_turn, order_index,
order_depth) orders a conversation without any task holding all of it.

Defined results: a null conversation id is a conversation of its own; a null turn sorts first, as -1; a
null or empty text is an empty prompt; of calls that repeat an id the first by (turn, index) counts
and n_calls says how many there are; of several results likewise. A result without a call has the
status ``orphan``, a call without a result ``unanswered``. Text that isn't valid JSON is plain text, and so is
JSON with NaN, Infinity or more depth than the parser takes; halves of surrogate pairs stay as escapes.
What can be neither gets a row of its own with the status ``unlinked``, no call id, and its content as
the result: a message whose role is null or none of the four, a tool's message without a
``tool_call_id``, and an entry of ``tool_calls`` that isn't an object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep, shared_dir

SCHEMAS = {
    "reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}}, "required": ["prompt"], "additionalProperties": False},
    "instruct": {"type": "object", "properties": {"prompt": {"type": "string"}}, "required": ["prompt"], "additionalProperties": False},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


def unpaired(text: str) -> str:
    """The text with halves of surrogate pairs, which UTF-8 can't hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return unpaired(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` violates of a JSON schema: type, enum, required, properties, additionalProperties, items, lengths, bounds."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        fits = isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    else:
        fits = kind is None or isinstance(value, _TYPES[kind])
    if not fits:
        return [f"{at}: not of type {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    measured = len(value) if isinstance(value, str) else value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minimum", "maximum")
    if measured is not None and measured < schema.get(low, measured):
        found.append(f"{at}: under {low} {schema[low]}")
    if measured is not None and measured > schema.get(high, measured):
        found.append(f"{at}: over {high} {schema[high]}")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in problems(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            found += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in known]
        found += [x for k in sorted(value) if k in known for x in problems(value[k], known[k], f"{at}.{k}")]
    return found


def _parsed(role: str | None, text: str) -> tuple[list, dict | None]:
    """The entries of ``tool_calls`` and the result that a message holds, if its text is such JSON."""
    if role in ("assistant", "tool") and text.lstrip()[:1] == "{":
        try:
            value = json.loads(text, parse_constant=_no_number)
            canonical(value)  # what can't be written again, for its depth or a number beyond doubles, counts as text
        except (ValueError, RecursionError):
            return [], None
        calls = value.get("tool_calls")
        if role == "assistant" and isinstance(calls, list):
            return calls, None
        if role == "tool" and "tool_call_id" in value:
            return [], value
    return [], None


def events(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", plain: bool = True) -> DataFrame:
    """One row for each call (is_call), each result (not is_call) and all that is neither (is_call is null) of the messages."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("idx", pa.int32()), ("is_call", pa.bool_()), ("call_id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("depends", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                conv, turn, role, text = r["conv"], r["turn"], r["role"], r["text"]
                calls, result = _parsed(role, text)
                for i, c in enumerate(calls):
                    if not isinstance(c, dict):
                        out.append((conv, turn, i, None, None, None, canonical(c), []))
                        continue
                    wants = c.get("depends")
                    out.append((conv, turn, i, True, unpaired(str(c.get("id"))), unpaired(str(c.get("name"))), canonical(c.get("arguments")), [unpaired(str(x)) for x in wants] if isinstance(wants, list) else []))
                if result is not None:
                    out.append((conv, turn, 0, False, unpaired(str(result["tool_call_id"])), None, canonical(result.get("content")), []))
                elif role not in ("user", "system", "assistant"):
                    out.append((conv, turn, 0, None, None, None, canonical(text), []))
                elif plain and not any(isinstance(c, dict) for c in calls):
                    if role in ("user", "system"):
                        out.append((conv, turn, 0, True, f"turn-{turn}", "reply" if role == "user" else "instruct", canonical({"prompt": text}), [f"turn-{turn - 2}"] if role == "user" and turn >= 2 else []))
                    elif role == "assistant":
                        out.append((conv, turn, 0, False, f"turn-{turn - 1}", None, canonical(text), []))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, "conv long, turn long, idx int, is_call boolean, call_id string, name string, body string, depends array<string>")


def _ordered(calls: DataFrame, folder: str) -> DataFrame:
    """conv, call_id, order_turn, order_index, order_depth, cyclic of every call."""
    own = calls.select("conv", "call_id", "turn", "idx", "depends")
    wants = own.select("conv", "call_id", "turn", "idx", F.explode("depends").alias("need")).distinct()
    target = own.select(F.col("conv").alias("c"), F.col("call_id").alias("need_id"), F.col("turn").alias("t"), F.col("idx").alias("i"))
    edges = wants.join(target, F.col("conv").eqNullSafe(F.col("c")) & (F.col("need") == F.col("need_id")))
    ahead = edges.where(F.struct("t", "i") >= F.struct("turn", "idx"))
    forward = keep(ahead.groupBy("conv").agg(F.count("*").alias("most")), "forward", folder)
    plainly = own.select("conv", "call_id", F.col("turn").alias("order_turn"), F.col("idx").alias("order_index"), F.lit(0).alias("order_depth"), F.lit(False).alias("cyclic"))
    if forward.isEmpty():
        return plainly
    own = own.alias("o").join(forward.alias("f"), F.col("o.conv").eqNullSafe(F.col("f.conv"))).select("o.conv", "call_id", "turn", "idx", "most")
    needed = keep(edges.alias("o").join(forward.alias("f"), F.col("o.conv").eqNullSafe(F.col("f.conv"))).select("o.conv", "call_id", "need"), "needed", folder)
    state = keep(own.select("conv", "call_id", "most", F.struct(F.col("turn").alias("t"), F.col("idx").alias("i"), F.lit(0).alias("d")).alias("key")), "state0", folder)
    turn = 0
    while True:
        turn += 1
        at = state.select(F.col("conv").alias("c"), F.col("call_id").alias("need"), F.col("key").alias("k"))
        raised = needed.join(at, needed.conv.eqNullSafe(at.c) & (needed.need == at.need)).select("conv", "call_id", F.struct(F.col("k.t").alias("t"), F.col("k.i").alias("i"), (F.col("k.d") + 1).alias("d")).alias("k"))
        raised = raised.groupBy(F.col("conv").alias("rc"), F.col("call_id").alias("ri")).agg(F.max("k").alias("k"))
        after = state.join(raised, state.conv.eqNullSafe(raised.rc) & (state.call_id == raised.ri), "left")
        key = F.when(F.col("k").isNotNull() & (F.col("k") > F.col("key")) & (F.col("key.d") <= F.col("most")), F.col("k")).otherwise(F.col("key"))
        after = keep(after.select("conv", "call_id", "most", key.alias("key"), (key != F.col("key")).alias("moved")), f"state{turn}", folder)
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    moved = state.select("conv", "call_id", F.col("key.t").alias("order_turn"), F.col("key.i").alias("order_index"), F.col("key.d").alias("order_depth"), (F.col("key.d") > F.col("most")).alias("cyclic"))
    rest = plainly.alias("p").join(forward.alias("f"), F.col("p.conv").eqNullSafe(F.col("f.conv")), "left_anti")
    return rest.unionByName(moved)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS, **columns) -> DataFrame:
    """One row for each call id and each orphan result id of each conversation, and for all that is unlinked."""
    folder = shared_dir(messages.sparkSession)
    found = keep(events(messages, **columns), "events", folder)
    keys = ["conv", "call_id"]
    # the first of equal ids, found by partial aggregates before the rows are shuffled
    first = lambda *names: F.min(F.struct("turn", "idx", *names)).alias("x")
    calls = found.where("is_call").groupBy(*keys).agg(first("name", "body", "depends"), F.count("*").alias("n_calls")).select(*keys, "x.*", "n_calls")
    calls = keep(calls, "calls", folder)
    results = found.where("NOT is_call").groupBy(*keys).agg(first("body"), F.count("*").alias("n_results")).select(F.col("conv").alias("rc"), F.col("call_id").alias("ri"), F.col("x.turn").alias("result_turn"), F.col("x.body").alias("result"), "n_results")
    order = _ordered(calls, folder).withColumnsRenamed({"conv": "oc", "call_id": "oi"})
    calls = calls.drop("depends", "turn", "idx").join(order, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("oi"))).drop("oc", "oi")
    both = calls.join(results, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full")
    status = F.when(F.col("call_id").isNull(), "orphan").when(F.col("ri").isNull(), "unanswered").otherwise("linked")
    rows = both.select(
        F.coalesce("conv", "rc").alias("conv_id"),
        F.coalesce("call_id", "ri").alias("call_id"),
        "name",
        status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "result_turn",
        F.coalesce("order_turn", "result_turn").alias("order_turn"),
        F.coalesce("order_index", F.lit(0)).alias("order_index"),
        F.coalesce("order_depth", F.lit(0)).alias("order_depth"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.col("body").alias("arguments"),
        "result",
    )
    nothing, no = F.lit(None).cast("string"), F.lit(0).cast("long")
    loose = found.where("is_call IS NULL").select(F.col("conv").alias("conv_id"), "call_id", "name", F.lit("unlinked").alias("status"), no.alias("n_calls"), no.alias("n_results"), F.col("turn").alias("result_turn"), F.col("turn").alias("order_turn"), F.col("idx").alias("order_index"), F.lit(0).alias("order_depth"), F.lit(False).alias("cyclic"), nothing.alias("arguments"), F.col("body").alias("result"))
    rows = rows.unionByName(loose)
    made = rows.drop("arguments", "result")
    schema = made.select("*", F.lit(False).alias("valid"), F.lit(None).cast("string").alias("error"), F.lit("").alias("json")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, error, text = [], [], []
            for r in batch.select(["conv_id", "call_id", "name", "arguments", "result"]).to_pylist():
                arguments = json.loads(r["arguments"]) if r["arguments"] is not None else None
                if r["name"] is None:
                    wrong = ["no call"]
                else:
                    wrong = problems(arguments, schemas[r["name"]]) if r["name"] in schemas else [f"unknown tool {r['name']}"]
                valid.append(not wrong)
                error.append(unpaired("; ".join(wrong)) or None)
                text.append(canonical({"conv_id": r["conv_id"], "id": r["call_id"], "name": r["name"], "arguments": arguments, "result": json.loads(r["result"]) if r["result"] is not None else None}))
            kept = batch.drop_columns(["arguments", "result"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(valid, pa.bool_()), pa.array(error, pa.string()), pa.array(text, pa.string())], [*kept.schema.names, "valid", "error", "json"])

    return rows.mapInArrow(run, schema)


def chat_query(spark, sf_dir: str) -> DataFrame:
    """Linked, ordered, validated and serialised calls of all conversations."""
    return link_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
