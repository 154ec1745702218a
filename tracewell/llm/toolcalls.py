"""Chat formatting with linked tool calls, in DataFrame functions only.

A message may hold calls, `<tool_call>{"id", "name", "arguments"}</tool_call>`, and results,
`<tool_result>{"id", "content"}</tool_result>`; a message of role `tool` whose whole text is a
JSON object is a result. Arguments may name the result of another call of the conversation as
`{"$ref": "<id>"}`. Calls and results meet by a hash join on conversation and identifier, calls
get a level above all calls they refer to, arguments are checked against the tool's schema, and
every message, call and result becomes one line of canonical JSON: keys sorted at every depth,
no blanks.

One row per event, never one per conversation: a conversation may hold a third of all rows, and
sorting by (conv_id, turn, kind, place) gives the conversation back.

Defined results: null texts are empty messages; null roles are `user`; broken JSON is a
call with `error = 'json'`, never a failure; of repeated identifiers in a conversation the
earliest place counts for links (null turns first, one copy of repeated rows) and the others have
`error = 'duplicate'`; calls on a cycle or
above one have a null level and `error = 'cycle'`; a reference to nothing is `'reference'`.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
MARKED = r"(?s)<tool_(call|result)>.*?</tool_(call|result)>"
REFERENCE = r'"\$ref":"((?:[^"\\]|\\.)*)"'
KEY = ["conv_id", "id"]
SCHEMA = "name string, parameter string, type string, required boolean"


def _canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text, null where it is none: variants keep keys sorted."""
    return F.to_json(F.try_parse_json(text))


def events(messages: DataFrame) -> DataFrame:
    """Messages, calls and results as rows: conv_id, turn, kind, place, role, id, name, body."""
    base = messages.select(
        "conv_id", "turn",
        F.coalesce(F.col("role"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = (F.col("role") == "tool") & F.col("text").rlike(r"(?s)^\s*\{.*\}\s*$")
    found = F.concat(
        F.transform(
            F.regexp_extract_all("text", F.lit(CALL), F.lit(1)),
            lambda body, i: F.struct(F.lit("call").alias("kind"), i.alias("place"), body.alias("body")),
        ),
        F.transform(
            F.when(whole, F.array("text")).otherwise(
                F.regexp_extract_all("text", F.lit(RESULT), F.lit(1))
            ),
            lambda body, i: F.struct(F.lit("result").alias("kind"), i.alias("place"), body.alias("body")),
        ),
        F.array(
            F.struct(
                F.lit("message").alias("kind"),
                F.lit(0).alias("place"),
                F.when(whole, F.lit("")).otherwise(F.regexp_replace("text", MARKED, "")).alias("body"),
            )
        ),
    )
    rows = base.select("conv_id", "turn", "role", F.explode(found).alias("e"))
    columns = ["conv_id", "turn", "role", "kind", "place", "body"]
    rows = rows.select("conv_id", "turn", "role", "e.kind", "e.place", "e.body")
    # copies of one row are told apart by a number, counted without bringing them together
    copies = rows.where("kind != 'message'").groupBy(*columns).count().withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))
    )
    rows = rows.where("kind = 'message'").withColumn("copy", F.lit(1)).unionByName(copies.drop("count"))
    parsed = rows.withColumn(
        "json", F.when(F.col("kind") != "message", _canonical(F.col("body")))
    )
    return parsed.select(
        "conv_id", "turn", "kind", "place", "role",
        F.coalesce(
            F.get_json_object("json", "$.id"), F.get_json_object("json", "$.tool_call_id")
        ).alias("id"),
        F.get_json_object("json", "$.name").alias("name"),
        F.when(F.col("kind") == "call", _canonical(F.get_json_object("json", "$.arguments"))).alias("arguments"),
        F.get_json_object("json", "$.content").alias("content"),
        "body", "copy",
        ((F.col("kind") != "message") & F.col("json").isNull()).alias("broken"),
    )


def _place() -> Column:
    """Where an event stands in its conversation."""
    return F.struct("turn", "place", "role", "copy")


def first_of_id(rows: DataFrame) -> DataFrame:
    """The earliest place of every identifier of a conversation, by partial aggregates."""
    return rows.where(F.col("id").isNotNull()).groupBy(*KEY).agg(
        F.min(_place()).alias("first_at")
    )


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level: 0 without references, else one above the highest call referred to.

    Every round settles the calls whose references are all settled, so rounds follow the
    longest chain of references, and calls on cycles remain without a level.
    """
    ids = calls.select(*KEY).distinct()
    refs = calls.select(
        *KEY, F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("ref")
    )
    needs = refs.join(
        ids.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_semi"
    ).distinct()
    needs = cut_lineage(needs)
    settled = cut_lineage(ids.join(needs, KEY, "left_anti").withColumn("level", F.lit(0)))
    while True:
        done = settled.select("conv_id", F.col("id").alias("ref"), F.col("level").alias("ref_level"))
        ready = (
            needs.join(settled.select(*KEY), KEY, "left_anti")
            .join(done, ["conv_id", "ref"], "left")
            .groupBy(*KEY)
            .agg(F.count(F.when(F.col("ref_level").isNull(), 1)).alias("open"), F.max("ref_level").alias("top"))
            .where("open = 0")
            .select(*KEY, (F.col("top") + 1).alias("level"))
        )
        ready = cut_lineage(ready)
        if ready.isEmpty():
            return settled
        settled = cut_lineage(settled.union(ready))


def _json_type(arguments: Column, parameter: Column) -> Column:
    """JSON type of one argument; null where it is missing."""
    raw = F.get(F.map_values(F.map_filter(F.from_json(arguments, "map<string,variant>"), lambda k, v: k == parameter)), F.lit(0))
    kind = F.schema_of_variant(raw)
    return (
        F.when(raw.isNull(), F.lit(None))
        .when(kind == "VOID", "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "BIGINT", "integer")
        .otherwise("number")
    )


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, place, problems: what the arguments of a call break of its schema.

    `schemas` has a row per tool and parameter (a null parameter: a tool without any). Rows of
    calls meet rows of their own tool only.
    """
    wanted = schemas.select(F.col("name").alias("tool"), "parameter", "type", "required")
    known = wanted.groupBy("tool").agg(
        F.collect_set("parameter").alias("parameters")
    )
    place = ["conv_id", "turn", "place"]
    checked = calls.join(wanted, F.col("name") == F.col("tool"), "left")
    kind = _json_type(F.col("arguments"), F.col("parameter"))
    fits = (kind == F.col("type")) | ((F.col("type") == "number") & (kind == "integer"))
    problem = (
        F.when(F.col("tool").isNull(), F.concat(F.lit("tool:"), F.coalesce("name", F.lit(""))))
        .when(F.col("arguments").isNull() | ~F.col("arguments").startswith("{"), F.lit("arguments"))
        .when(F.col("parameter").isNull(), F.lit(None))
        .when(kind.isNull() & F.col("required"), F.concat(F.lit("missing:"), F.col("parameter")))
        .when(kind.isNotNull() & ~fits, F.concat(F.lit("type:"), F.col("parameter")))
    )
    of_schema = checked.select(*place, problem.alias("problem"))
    unknown = (
        calls.where(F.col("arguments").startswith("{"))
        .join(known, F.col("name") == F.col("tool"))
        .select(*place, F.explode(F.array_except(F.json_object_keys("arguments"), "parameters")).alias("extra"))
        .select(*place, F.concat(F.lit("unknown:"), F.col("extra")).alias("problem"))
    )
    # bounded by the parameters of one call
    return (
        of_schema.union(unknown)
        .groupBy(*place)
        .agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("problems"))
    )


def no_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def link_tool_calls(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, kind, place, role, id, name, level, linked, error, json of every event.

    Without schemas arguments are only parsed. `linked` says that a call has a result, or a
    result a call, of the same identifier. Keys are compared null-safe only in the sense that
    events without an identifier are never linked.
    """
    every = cut_lineage(events(messages))
    calls = every.where((F.col("kind") == "call") & ~F.col("broken"))
    results = every.where((F.col("kind") == "result") & ~F.col("broken"))
    call_ids, result_ids = first_of_id(calls), first_of_id(results)
    ids = (
        call_ids.withColumn("kind", F.lit("call"))
        .union(result_ids.withColumn("kind", F.lit("result")))
    )
    linked = call_ids.select(*KEY).join(result_ids.select(*KEY), KEY).withColumn("linked", F.lit(True))
    firsts = calls.join(call_ids, KEY).where(_place().eqNullSafe(F.col("first_at")))
    level = levels(cut_lineage(firsts.select(*KEY, "arguments"))).withColumn("kind", F.lit("call"))
    missing = (
        calls.select(*KEY, F.explode(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1))).alias("ref"))
        .join(call_ids.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti")
        .select(*KEY).distinct()
        .withColumns({"kind": F.lit("call"), "lost": F.lit(True)})
    )
    # events of tools are few beside messages: messages bypass the joins
    tools = every.where("kind != 'message'")
    joined = (
        tools.join(ids, [*KEY, "kind"], "left")
        .join(linked, KEY, "left")
        .join(level, [*KEY, "kind"], "left")
        .join(missing, [*KEY, "kind"], "left")
    )
    if schemas is not None:
        joined = joined.join(
            argument_errors(calls, schemas).withColumn("kind", F.lit("call")),
            ["conv_id", "turn", "place", "kind"], "left",
        )
    else:
        joined = joined.withColumn("problems", F.lit(""))
    error = (
        F.when(F.col("broken"), "json")
        .when(F.col("id").isNull(), "id")
        .when(F.col("first_at").isNotNull() & ~_place().eqNullSafe(F.col("first_at")), "duplicate")
        .when(F.col("lost"), "reference")
        .when((F.col("kind") == "call") & F.col("level").isNull(), "cycle")
        .when(F.col("problems") != "", F.col("problems"))
    )
    joined = joined.withColumn("error", error).withColumn(
        "linked", F.coalesce(F.col("linked") & (_place().eqNullSafe(F.col("first_at"))), F.lit(False))
    )
    plain = every.where("kind = 'message'").withColumns(
        {"level": F.lit(None).cast("int"), "linked": F.lit(None).cast("boolean"), "error": F.lit(None).cast("string")}
    )
    columns = ["conv_id", "turn", "kind", "place", "role", "id", "name", "level", "linked", "error", "arguments", "content", "body"]
    out = joined.select(*columns).unionByName(plain.select(*columns))
    # the text parts are JSON already where they came from JSON
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    optional = lambda key, value, given=None: F.when(
        (F.col(key) if given is None else given).isNotNull(), F.concat(F.lit(f'"{key}":'), value)
    )
    content = F.when(F.col("kind") == "message", quoted(F.col("body"))).when(
        F.col("content").isNotNull(),
        F.coalesce(F.when(F.col("content").rlike(r"^[\[{]"), _canonical(F.col("content"))), quoted(F.col("content"))),
    )
    body = F.concat_ws(
        ",",
        optional("arguments", F.col("arguments")),
        optional("content", content, content),
        optional("conv_id", quoted(F.col("conv_id"))),
        optional("id", quoted(F.col("id"))),
        optional("kind", quoted(F.col("kind"))),
        optional("name", quoted(F.col("name"))),
        optional("role", quoted(F.col("role"))),
        optional("turn", quoted(F.col("turn"))),
    )
    return out.select(*columns[:10], F.concat(F.lit("{"), body, F.lit("}")).alias("json"))
