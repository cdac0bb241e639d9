"""Chat formatting: tool calls and their results.

Method: calls and results meet in a hash join on (conversation, identifier); messages get an order in which every
message follows those it depends on; arguments are validated against the tools' schemas; each message is serialised
as canonical JSON (keys in order, no blanks).  Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ORACLES, register, table
from folio.session import materialise

#: kind of a variant's value as schemas name it
TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number"}


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, call (turn, name, arguments), result (turn, content), status.

    ``calls`` has conv_id, turn, call_id, name, arguments; ``results`` conv_id, turn, call_id, content.  Of several calls, or
    results, with one identifier the first by turn (then by content) counts; the number of others is in ``extra_calls`` and
    ``extra_results``, and :func:`repeated` gives them.  ``status`` is linked, no_result or no_call.  A null conversation or identifier links to nothing:
    such rows come through as no_result or no_call, each on its own.
    """
    call = F.struct("turn", "name", "arguments")
    result = F.struct("turn", "content")
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = calls.where(keyed).groupBy("conv_id", "call_id").agg(F.min(call).alias("call"), (F.count(F.lit(1)) - 1).alias("extra_calls"))
    first_result = results.where(keyed).groupBy("conv_id", "call_id").agg(F.min(result).alias("result"), (F.count(F.lit(1)) - 1).alias("extra_results"))
    both = first_call.hint("shuffle_hash").join(first_result.hint("shuffle_hash"), ["conv_id", "call_id"], "full")  # one row a key on either side
    status = F.when(F.col("call").isNull(), "no_call").when(F.col("result").isNull(), "no_result").otherwise("linked")
    linked = both.select("conv_id", "call_id", "call", "result", F.coalesce("extra_calls", F.lit(0)).alias("extra_calls"), F.coalesce("extra_results", F.lit(0)).alias("extra_results"), status.alias("status"))
    types = dict(linked.dtypes)
    zero = F.lit(0).cast("bigint")
    lone_call = calls.where(~keyed).select("conv_id", "call_id", call.cast(types["call"]).alias("call"), F.lit(None).cast(types["result"]).alias("result"), zero.alias("extra_calls"), zero.alias("extra_results"), F.lit("no_result").alias("status"))
    lone_result = results.where(~keyed).select("conv_id", "call_id", F.lit(None).cast(types["call"]).alias("call"), result.cast(types["result"]).alias("result"), zero.alias("extra_calls"), zero.alias("extra_results"), F.lit("no_call").alias("status"))
    return linked.unionByName(lone_call).unionByName(lone_result)


def repeated(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, kind (call, result) and json of the calls and results that :func:`link` does not take, as their identifier was met before."""
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def others(rows: DataFrame, kind: str, *fields: str) -> DataFrame:
        told = rows.where(keyed).groupBy("conv_id", "call_id", *fields).agg(F.count(F.lit(1)).alias("n"))  # equal rows as one
        first = told.groupBy("conv_id", "call_id").agg(F.min(F.struct(*fields)).alias("first"), F.sum("n").alias("m")).where("m > 1")
        times = F.col("n") - F.when(F.struct(*fields).eqNullSafe(F.col("first")), 1).otherwise(0)
        return told.join(first, ["conv_id", "call_id"]).where(times > 0).select(
            "conv_id", "call_id", F.lit(kind).alias("kind"), F.explode(F.array_repeat(F.to_json(F.struct(*sorted(fields))), times.cast("int"))).alias("json"))

    return others(calls, "call", "turn", "name", "arguments").unionByName(others(results, "result", "turn", "content"))


def ordered(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, node, turn) with ``at`` and ``depth``: sorted by these, every node follows what it depends on.

    ``depends`` has conv_id, node, needs.  A node keeps its turn unless something it needs comes no earlier; then it
    follows that at once.  Rounds run only while something is out of order.  ``cyclic`` marks nodes that wait for
    themselves or for such nodes; they keep their turn.
    """
    place = materialise(nodes.select("conv_id", "node", "turn", F.col("turn").alias("at"), F.lit(0).alias("depth")))
    needs = depends.join(nodes.select("conv_id", F.col("node").alias("needs")), ["conv_id", "needs"], "left_semi").distinct()
    needs = materialise(needs.where(F.col("node") != F.col("needs")))
    own = materialise(depends.where(F.col("node") == F.col("needs")).select("conv_id", "node").distinct())
    sizes = materialise(needs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("links")))
    while True:
        before = place.select("conv_id", F.col("node").alias("needs"), F.struct("at", (F.col("depth") + 1).alias("depth")).alias("after"))
        late = (
            needs.join(before, ["conv_id", "needs"]).groupBy("conv_id", "node").agg(F.max("after").alias("after"))
            .join(place.select("conv_id", "node", F.struct("at", "depth").alias("now")), ["conv_id", "node"]).where("now < after")
            .join(sizes, "conv_id").where("after.depth <= links").select("conv_id", "node", "after"))
        late = materialise(late)
        if late.isEmpty():
            break
        moved = place.join(late, ["conv_id", "node"], "left")
        place = materialise(moved.select("conv_id", "node", "turn", F.coalesce("after.at", "at").alias("at"), F.coalesce("after.depth", "depth").alias("depth")))
    before = place.select("conv_id", F.col("node").alias("needs"), F.struct("at", "depth").alias("then"))
    late = needs.join(before, ["conv_id", "needs"]).join(place.select("conv_id", "node", F.struct("at", "depth").alias("now")), ["conv_id", "node"]).where("now <= then")
    waiting = materialise(needs.join(late.select("conv_id").distinct(), "conv_id", "left_semi"))
    n, left = -1, waiting.count()
    while left != n:  # what needs nothing that waits is free; what is left waits for itself
        waiting = materialise(waiting.join(waiting.select("conv_id", F.col("node").alias("needs")).distinct(), ["conv_id", "needs"], "left_semi"))
        n, left = left, waiting.count()
    stuck = waiting.select("conv_id", "node").unionByName(own).distinct().withColumn("cyclic", F.lit(True))
    out = place.join(stuck, ["conv_id", "node"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return out.select("conv_id", "node", "turn", F.when(F.col("cyclic"), F.col("turn")).otherwise(F.col("at")).alias("at"), F.when(F.col("cyclic"), 0).otherwise(F.col("depth")).alias("depth"), "cyclic")


def kind(value: Column) -> Column:
    """Type of a variant's value, in the words of a schema."""
    raw = F.schema_of_variant(value)
    out = F.when(raw.startswith("ARRAY"), "array").when(raw.startswith("OBJECT"), "object").when(raw.startswith("DECIMAL"), "number")
    for spark_type, name in TYPES.items():
        out = out.when(raw == spark_type, name)
    return out.otherwise(raw)


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``canonical`` (arguments as canonical JSON, null if they are no JSON object) and ``errors``, sorted.

    ``schemas`` has a row for each tool: name and params, an array of (name, type, required).  Errors: no_object,
    unknown_tool, missing:<param>, unknown:<param>, type:<param>.  A whole number also fits ``number``.
    """
    wide = calls.join(schemas.select("name", "params"), "name", "left").withColumn("_v", F.try_parse_json("arguments"))
    wide = wide.withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    plain = F.when(F.col("_object"), F.from_json("arguments", "map<string,string>"))
    fields = F.map_keys(plain)
    given = F.from_json("arguments", "map<string,variant>")
    value = lambda p: kind(given[p])
    params = F.coalesce("params", F.array().cast(schemas.schema["params"].dataType))
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(fields, p["name"])), lambda p: F.concat(F.lit("missing:"), p["name"]))
    unknown = F.transform(F.array_except(fields, F.transform(params, lambda p: p["name"])), lambda n: F.concat(F.lit("unknown:"), n))
    fits = lambda p: (value(p["name"]) == p["type"]) | ((p["type"] == "number") & (value(p["name"]) == "integer"))
    wrong = F.transform(F.filter(params, lambda p: F.array_contains(fields, p["name"]) & ~fits(p)), lambda p: F.concat(F.lit("type:"), p["name"]))
    errors = (
        F.when(~F.col("_object"), F.array(F.lit("no_object")))
        .when(F.col("params").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.sort_array(F.concat(missing, unknown, wrong))))
    return wide.withColumns({"canonical": F.when(F.col("_object"), F.to_json("_v")), "errors": errors}).drop("_v", "_object", "params")


def _json(*fields: Column) -> Column:
    """JSON object of columns given in the order of their names; null fields are left out."""
    return F.to_json(F.struct(*fields))


def call_json(canonical: Column, arguments: Column, call_id: Column, name: Column) -> Column:
    """A call; arguments that are no object are kept as a string."""
    rest = _json(call_id.alias("id"), name.alias("name"), F.lit("assistant").alias("role"))
    raw = F.concat(F.lit('{"arguments":'), canonical, F.lit(","), F.regexp_replace(rest, r"^\{", ""))
    return F.coalesce(raw, _json(arguments.alias("arguments"), call_id.alias("id"), name.alias("name"), F.lit("assistant").alias("role")))


def format_chat(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: DataFrame, depends: DataFrame) -> DataFrame:
    """conv_id, at, depth, kind (call, result, message), call_id, status, errors, cyclic, json, extra: one row a message.

    ``extra`` tells how many further calls, or results, have the identifier; :func:`repeated` gives them.

    ``messages`` has conv_id, turn, role, content; ``depends`` conv_id, call_id, needs: the call uses the result of call
    ``needs``.  Sorted by (at, depth, kind, call_id) a conversation has every result after its call and every call after
    the results it uses.  Rows, not one value a conversation, so a conversation may be of any size.  Repeated messages
    are repeated; empty tables give no rows; other columns play no part.
    """
    linked = materialise(link(calls, results))
    told = linked.where("call is not null").select("conv_id", "call_id", "status", F.col("extra_calls").alias("extra"), "call.*")
    checked = validated(told, schemas)
    call_rows = checked.select(
        "conv_id", F.concat(F.lit("call "), "call_id").alias("node"), "turn", F.lit("call").alias("kind"), "call_id", "status", "errors", "extra",
        call_json(F.col("canonical"), F.col("arguments"), F.col("call_id"), F.col("name")).alias("json"))
    none = F.array().cast("array<string>")
    result_rows = linked.where("result is not null").select(
        "conv_id", F.concat(F.lit("result "), "call_id").alias("node"), "result.turn", F.lit("result").alias("kind"), "call_id", "status", none.alias("errors"), F.col("extra_results").alias("extra"),
        _json(F.col("result.content").alias("content"), F.col("call_id").alias("id"), F.lit("tool").alias("role")).alias("json"))
    rows = materialise(call_rows.unionByName(result_rows))
    own = linked.where("status = 'linked'").select("conv_id", F.concat(F.lit("result "), "call_id").alias("node"), F.concat(F.lit("call "), "call_id").alias("needs"))
    used = depends.select("conv_id", F.concat(F.lit("call "), "call_id").alias("node"), F.concat(F.lit("result "), "needs").alias("needs"))
    keyed = F.col("conv_id").isNotNull() & F.col("node").isNotNull()
    at = ordered(rows.where(keyed).select("conv_id", "node", "turn"), own.unionByName(used)).drop("turn")
    names = ["conv_id", "at", "depth", "kind", "call_id", "status", "errors", "cyclic", "json", "extra"]
    placed = rows.where(keyed).join(at, ["conv_id", "node"]).select(names)
    loose = rows.where(~keyed).withColumns({"at": F.col("turn"), "depth": F.lit(0), "cyclic": F.lit(False)}).select(names)
    plain = messages.select(
        "conv_id", F.col("turn").alias("at"), F.lit(0).alias("depth"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("status"),
        none.alias("errors"), F.lit(False).alias("cyclic"), _json(F.col("content").alias("content"), F.col("role").alias("role")).alias("json"), F.lit(0).cast("bigint").alias("extra"))
    return placed.unionByName(loose).unionByName(plain)


def tool_schemas(spark) -> DataFrame:
    param = "array<struct<name string, type string, required boolean>>"
    both = [("query", "string", True), ("turn", "integer", True)]
    return spark.createDataFrame([("search", both), ("lookup", [*both, ("page", "number", False)])], f"name string, params {param}")


@register
def op5_chat(spark, sf):
    """Every assistant turn is told as a tool call, every user turn after the first as the result of the call before it."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    size = F.length("text") % 7
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("export")), (F.col("conv_id") % 3 + 1).cast("int"))
    whole = F.to_json(F.struct("turn", F.col("text").alias("query")))
    arguments = (
        F.when(size == 0, F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), F.col("text").alias("query"))))
        .when(size == 1, F.to_json(F.struct(F.col("text").alias("query"))))
        .when(size == 2, F.to_json(F.struct("turn", F.col("text").alias("query"), F.lit(1.5).alias("page"))))
        .when(size == 3, F.concat(F.lit("query="), "text")).otherwise(whole))
    identifier = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    asks = (F.col("role") == "assistant") & F.col("turn").isNotNull()
    answers = (F.col("role") == "user") & (F.col("turn") > 0)
    calls = conv.where(asks).select("conv_id", "turn", identifier(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    told = F.when(F.length("text") % 5 == 0, F.col("turn") - 2).otherwise(F.col("turn"))  # some results are told before their call
    results = conv.where(answers).select("conv_id", told.alias("turn"), identifier(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    messages = conv.where(~F.coalesce(asks | answers, F.lit(False))).select("conv_id", "turn", "role", F.col("text").alias("content"))
    depends = calls.select("conv_id", "call_id", identifier(F.col("turn") - 2).alias("needs"))
    out = format_chat(calls, results, messages, tool_schemas(spark), depends)
    return out.withColumn("errors", F.array_join("errors", " "))


ORACLES["op5_chat"] = """
WITH c AS (SELECT *, 'c' || conv_id || '-' || turn AS id, length(text) % 7 AS s FROM conversations),
calls AS (
  SELECT conv_id, turn, id, ['search', 'lookup', 'export'][conv_id % 3 + 1] AS name, s, text,
         CASE s WHEN 0 THEN json_object('query', text, 'turn', CAST(turn AS VARCHAR)) WHEN 1 THEN json_object('query', text)
                WHEN 2 THEN json_object('page', 1.5::DOUBLE, 'query', text, 'turn', turn) WHEN 3 THEN json_object('a', 'query=' || text)
                ELSE json_object('query', text, 'turn', turn) END AS args
  FROM c WHERE role = 'assistant'
),
results AS (
  SELECT conv_id, CASE WHEN length(text) % 5 = 0 THEN turn - 2 ELSE turn END AS turn, 'c' || conv_id || '-' || (turn - 1) AS id, text
  FROM c WHERE role = 'user' AND turn > 0
),
one_call AS (SELECT conv_id, id, min(turn) AS turn, arg_min(c, turn) AS c, count(*) - 1 AS extra FROM calls c GROUP BY ALL),
one_result AS (SELECT conv_id, id, min(turn) AS turn, arg_min(r, turn) AS r, count(*) - 1 AS extra FROM results r GROUP BY ALL)
SELECT c.conv_id, c.turn AS at, 0 AS depth, 'call' AS kind, c.id AS call_id, CASE WHEN r.id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       CASE WHEN c.c.s = 3 THEN 'no_object' WHEN c.c.name = 'export' THEN 'unknown_tool' WHEN c.c.s = 0 THEN 'type:turn' WHEN c.c.s = 1 THEN 'missing:turn'
            WHEN c.c.s = 2 AND c.c.name = 'search' THEN 'unknown:page' ELSE '' END AS errors, false AS cyclic,
       '{"arguments":' || CASE WHEN c.c.s = 3 THEN CAST(json_extract(c.c.args, '$.a') AS VARCHAR) ELSE CAST(c.c.args AS VARCHAR) END
       || ',"id":"' || c.id || '","name":"' || c.c.name || '","role":"assistant"}' AS json, c.extra
FROM one_call c LEFT JOIN one_result r ON r.conv_id = c.conv_id AND r.id = c.id
UNION ALL
SELECT r.conv_id, CASE WHEN r.turn < c.turn OR r.turn = c.turn THEN c.turn ELSE r.turn END, CASE WHEN r.turn <= c.turn THEN 1 ELSE 0 END, 'result', r.id,
       CASE WHEN c.id IS NULL THEN 'no_call' ELSE 'linked' END, '', false,
       '{"content":' || CAST(to_json(r.r.text) AS VARCHAR) || ',"id":"' || r.id || '","role":"tool"}', r.extra
FROM one_result r LEFT JOIN one_call c ON r.conv_id = c.conv_id AND r.id = c.id
UNION ALL
SELECT conv_id, turn, 0, 'message', NULL, NULL, '', false, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}', 0
FROM c WHERE NOT (role = 'assistant' OR (role = 'user' AND turn > 0))
"""
