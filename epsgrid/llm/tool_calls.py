"""Tool-call linking: calls and their results, in dependency order, validated, as canonical JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.llm.common import map_arrow, pick, prepare


def canonical(value) -> str:
    """JSON with sorted keys, no white space, plain characters; numbers that are whole lose
    their fraction."""

    def plain(x):
        if isinstance(x, float) and abs(x) < 2 ** 53 and x == int(x):
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return text.encode("utf-8", "replace").decode()  # half a surrogate pair is no character


def parse(text: str):
    """JSON text as a value; ValueError for numbers that are not finite and for nesting too deep."""

    def finite(x):
        v = float(x)
        if v in (float("inf"), float("-inf")) or v != v:
            raise ValueError(x)
        return v

    try:
        value = json.loads(text, parse_constant=finite, parse_float=finite)
        canonical(value)
        return value
    except RecursionError:
        raise ValueError("nested too deep") from None


TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a value has against a schema: type, enum, const, minimum, maximum, minLength,
    maxLength, required, properties, additionalProperties, items."""
    out, kinds = [], schema.get("type")
    if kinds is not None:
        def is_a(k):
            if k in ("integer", "number"):
                number = isinstance(value, (int, float)) and not isinstance(value, bool)
                return number and (k == "number" or value % 1 == 0)
            return isinstance(value, TYPES[k])
        if not any(is_a(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: range")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{at}: length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                out += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    return sorted(out)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): the longest chain of calls that a call waits for; null on a cycle
    or behind one.  ``calls`` has a row for every link (conv_id, call_id, after_id); an
    ``after_id`` that names no call is ignored.

    A call that waits for one other points at it, and pointer doubling takes it to the top of
    its chain in rounds that grow with the logarithm of the chain: a call that waits for none
    or for several.  The latter are then peeled level by level, each once all it waits for
    is known.  A conversation with a large share of all calls is many keys, not one group.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("after_id"))
    edges = (calls.select(*key, "after_id").where(F.col("after_id").isNotNull()).distinct()
             .join(known, ["conv_id", "after_id"], "left_semi").checkpoint())
    waits = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("links"), F.min("after_id").alias("up"))
    one = F.col("links") == 1
    state = (nodes.join(waits, key, "left")
             .select(*key, F.when(one, F.col("up")).otherwise(F.col("call_id")).alias("top"),
                     F.when(one, 1).otherwise(0).cast("long").alias("dist"), F.coalesce("links", F.lit(0)).alias("links"))
             .withColumn("end", F.col("links") != 1).checkpoint())
    n, step = state.count(), 1
    ends = state.select("conv_id", F.col("call_id").alias("top"), F.col("end").alias("top_end"))
    state = state.join(ends, ["conv_id", "top"]).checkpoint()
    while step <= n and not state.where(~F.col("top_end")).isEmpty():
        above = state.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("top2"),
                             F.col("dist").alias("dist2"), F.col("top_end").alias("end2"))
        state = (state.drop("top_end").join(above, ["conv_id", "top"])
                 .select(*key, F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"), "links",
                         "end", F.col("end2").alias("top_end")).checkpoint())
        step *= 2
    # calls that wait for several: links to the tops of the chains they wait for
    several = state.where(F.col("links") > 1).select(*key)
    top = state.select("conv_id", F.col("call_id").alias("after_id"), "top", (F.col("dist") + 1).alias("far"), "top_end")
    left = edges.join(several, key, "left_semi").join(top, ["conv_id", "after_id"]).select(*key, "top", "far", "top_end").checkpoint()
    depth = state.where(F.col("links") == 0).select("conv_id", F.col("call_id").alias("top"), F.lit(0).cast("long").alias("depth")).checkpoint()
    while not left.isEmpty():
        ready = (left.join(depth, ["conv_id", "top"], "left").groupBy(*key)
                 .agg(F.max(F.col("far") + F.col("depth")).alias("depth"),
                      F.count_if(F.col("depth").isNull() | ~F.col("top_end")).alias("open"))
                 .where("open = 0").select("conv_id", F.col("call_id").alias("top"), "depth").checkpoint())
        if ready.isEmpty():
            break  # what is left waits for a cycle
        depth = depth.unionByName(ready)
        left = left.join(ready.select("conv_id", F.col("top").alias("call_id")), key, "left_anti").checkpoint()
    return (state.join(depth, ["conv_id", "top"], "left")
            .select(*key, F.when(F.col("top_end"), F.col("depth") + F.col("dist")).alias("depth")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: (conv_id, call_id, name, turn, depth, status, problems, result_turn,
    n_results, json).

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON text), after_id (the call
    whose result it uses, or null); ``results`` has conv_id, call_id, turn, content.  They are
    hash-joined by (conv_id, call_id).  Ordering by (conv_id, depth, turn, call_id) puts
    every call after those it depends on.  ``status`` is ``ok``, ``invalid`` (arguments break
    the schema, are no JSON (numbers that are not finite and nesting too deep included), or the name
    is unknown), ``unanswered`` (no result), ``cycle``
    (no order exists) - the worst of them, in the order cycle, invalid, unanswered - and ``json`` the
    canonical call with its first result.

    Several results of a call: the earliest turn counts (ties: the smallest content), all are
    counted.  Repeated calls are linked row by row; a call waits for the after_id of every row of
    it, and all its rows have the depth of the longest chain.  Calls with a null conv_id or call_id match
    no result and have depth 0; null arguments are ``{}``, a null name is unknown.  Results
    without a call are left out.  Other columns are ignored; empty tables work.
    """
    prepare(calls.sparkSession)
    calls = pick(calls, "conv_id", "call_id", "turn", "name", "arguments", "after_id")
    results = pick(results, "conv_id", "call_id", "turn", "content")
    first = (results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id")
             .agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")))
    named = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    level = depths(named).withColumn("known", F.lit(True))
    rows = (calls.join(first, ["conv_id", "call_id"], "left").join(level, ["conv_id", "call_id"], "left")
            .select("conv_id", "call_id", "name", "turn",
                    F.when(F.col("known"), F.col("depth")).otherwise(F.lit(0)).alias("depth"), "arguments",
                    "after_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"),
                    F.coalesce("n_results", F.lit(0)).alias("n_results")))

    def run(batches):
        for batch in batches:
            out = {"status": [], "problems": [], "json": []}
            for r in batch.to_pylist():
                try:
                    args = parse(r["arguments"] or "{}")
                    found = problems(args, schemas[r["name"]]) if r["name"] in schemas else ["name: unknown"]
                except ValueError:
                    args, found = None, ["$: no JSON"]
                out["status"].append("cycle" if r["depth"] is None else "invalid" if found
                                     else "unanswered" if not r["n_results"] else "ok")
                out["problems"].append(";".join(found))
                out["json"].append(canonical({
                    "arguments": args, "id": r["call_id"], "name": r["name"], "result": r["content"],
                    **({"after": r["after_id"]} if r["after_id"] is not None else {})}))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(v, pa.string()) for v in out.values()]],
                [*names, *out])

    names = ["conv_id", "call_id", "name", "turn", "depth", "result_turn", "n_results"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", status string, problems string, json string"
    return map_arrow(rows, run, schema)
