"""Chat formatting: link tool calls to their results, order them, validate their arguments, write canonical JSON.
Built-in functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Schema of the query's one tool: by parameter its JSON type, whether it is required, and limits.
REPLY_SCHEMA = {
    "reply": {
        "role": {"type": "string", "required": True, "enum": ["system", "user"]},
        "text": {"type": "string", "required": True, "min_length": 1, "max_length": 20_000},
        "turn": {"type": "integer", "required": True, "minimum": 0},
    }
}

#: The SQL types that a JSON type may have.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": r"(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def canonical(json: Column) -> Column:
    """JSON with the keys of every object in order and no spaces; null for what isn't JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Sorted array<string> of what is wrong: `tool` (no such tool), `json` (not a JSON object), and for a parameter p
    `missing:p`, `type:p`, `range:p` or `unknown:p`. Parameters that are JSON null count as missing if required."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    by_tool = F.array(F.lit("tool"))
    for tool, parameters in schemas.items():
        found = [F.transform(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, parameters))), lambda k: F.concat(F.lit("unknown:"), k))]
        for p, rule in parameters.items():
            own = F.try_variant_get(value, f"$['{p}']", "variant")
            kind = F.coalesce(F.schema_of_variant(own), F.lit("VOID"))
            bad = F.lit(False)
            as_text, as_number = F.try_variant_get(value, f"$['{p}']", "string"), F.try_variant_get(value, f"$['{p}']", "double")
            if "enum" in rule:
                bad = bad | ~as_text.isin(rule["enum"])
            if "min_length" in rule:
                bad = bad | (F.length(as_text) < rule["min_length"])
            if "max_length" in rule:
                bad = bad | (F.length(as_text) > rule["max_length"])
            if "minimum" in rule:
                bad = bad | (as_number < rule["minimum"])
            if "maximum" in rule:
                bad = bad | (as_number > rule["maximum"])
            missing = F.lit(f"missing:{p}") if rule.get("required") else F.lit(None).cast("string")
            found.append(F.array(F.when(kind == "VOID", missing).when(~kind.rlike(f"^{_TYPES[rule['type']]}$"), f"type:{p}").when(bad, f"range:{p}")))
        by_tool = F.when(name == tool, F.when(~is_object, F.array(F.lit("json"))).otherwise(F.concat(*found))).otherwise(by_tool)
    return F.array_sort(F.filter(by_tool, lambda x: x.isNotNull()))


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): topological levels of the ids that need others, from edges (id, needs) of which all ends exist.

    An id that needs none has level 0 and isn't returned; another's level is one above the largest of those it needs.
    Ids on a cycle, and those that need them, get a null. Null ends and repeated edges don't count.

    Ids that need just one other are chains: pointers along them are doubled, so a chain of n costs log n rounds. What
    remains are ids with several needs; they take a round for each level among themselves. Rounds are written to the
    shared folder; no group is gathered anywhere.
    """
    edges = common.written(edges.where("id IS NOT NULL AND needs IS NOT NULL").distinct(), "edges")
    n = edges.count()
    # where a pointer stands, how far it has come, and whether it can go on
    one = edges.groupBy("id").agg(F.count("*").alias("n"), F.first("needs").alias("at")).where("n = 1").select("id", "at", F.lit(1).cast("long").alias("far"))
    steps = common.written(one, "steps", n)
    rounds = max(1, steps.count()).bit_length() + 1
    for _ in range(rounds):
        ahead = steps.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("far").alias("_far"))
        moved = steps.join(ahead, "at", "left").select("id", F.coalesce("_at", "at").alias("at"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_at").isNotNull().alias("_on"))
        moved = common.written(moved, "steps", n)
        steps = moved.drop("_on")
        if moved.where("_on").isEmpty():
            break
    else:  # what still moves runs in a circle
        steps = moved.select("id", F.when(~F.col("_on"), F.col("at")).alias("at"), "far")
    # ids with several needs, each need as the end of its chain and the way to it
    several = edges.join(steps.select("id"), "id", "left_anti")
    ends = steps.select(F.col("id").alias("needs"), F.col("at"), F.col("far").alias("_far"), F.lit(True).alias("_on"))
    pending = several.join(ends, "needs", "left").select("id", F.when(F.col("_on"), F.col("at")).otherwise(F.col("needs")).alias("at"), (F.coalesce("_far", F.lit(0)) + 1).alias("far"))
    pending = common.written(pending, "pending", n)
    path = f"{common.shared_dir(edges.sparkSession)}/levels-{uuid.uuid4().hex}"
    known = pending.select("id", F.col("far").alias("level")).limit(0)
    known.write.parquet(path)
    spark, schema = edges.sparkSession, known.schema
    while not pending.isEmpty():
        waiting = pending.select(F.col("id").alias("at")).distinct().withColumn("_wait", F.lit(True))
        had = spark.read.schema(schema).parquet(path).toDF("at", "_level")
        now = pending.join(waiting, "at", "left").join(had, "at", "left")
        free = now.groupBy("id").agg(F.max(F.coalesce("_level", F.lit(0).cast("long")) + F.col("far")).alias("level"), F.max(F.coalesce("_wait", F.col("at").isNull())).alias("stop")).where("NOT stop").drop("stop")
        free = common.written(free, "free", n)
        if free.isEmpty():
            break
        free.write.mode("append").parquet(path)
        pending = common.written(pending.join(free, "id", "left_anti"), "pending", n)
    known = spark.read.schema(schema).parquet(path)
    stuck = pending.select("id").distinct().withColumn("level", F.lit(None).cast("long"))
    base = known.unionByName(stuck)
    chains = steps.join(base.select(F.col("id").alias("at"), "level", F.lit(True).alias("_has")), "at", "left")
    level = F.when(F.col("at").isNull(), None).when(F.col("_has"), F.col("level") + F.col("far")).otherwise(F.col("far"))
    return base.unionByName(chains.select("id", level.alias("level"))).select("id", F.col("level").cast("int").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict) -> DataFrame:
    """The columns of calls and link struct: result_turn, n_results (long), level int, errors array<string>, message
    string.

    calls: call_id, name, arguments (JSON string) and others; results: call_id, result_turn, content; needs: (id,
    needs), which calls must come before which. Results are counted and the first (smallest result_turn, then content)
    chosen per identifier before the join, so an identifier with many results costs a row. Calls without a result, or
    without an identifier, keep nulls and 0 results; calls that repeat an identifier are each answered; results
    without a call are left out. message is canonical JSON of call, arguments and result, null where the arguments
    aren't valid JSON. An existing column called link is replaced; empty tables do.
    """
    own = [c for c in calls.columns if c != "link"]
    first = results.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.struct("result_turn", "content")).alias("_first"), F.count("*").alias("_n"))
    known = calls.where(F.col("call_id").isNotNull()).select(F.col("call_id").alias("id")).distinct()
    edges = needs.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "needs"), "needs", "left_semi").select("id", "needs")
    level = levels(edges).withColumnRenamed("id", "call_id").withColumnRenamed("level", "_level").withColumn("_found", F.lit(True))
    rows = calls.select("call_id", "name", "arguments", F.struct(*own).alias("_row"))
    rows = rows.join(first.hint("shuffle_hash"), "call_id", "left").join(level.hint("shuffle_hash"), "call_id", "left")
    body = F.concat(
        F.lit('{"arguments":'), canonical(F.col("arguments")), F.lit(',"id":'), F.to_json(F.col("call_id").cast("variant")), F.lit(',"name":'), F.to_json(F.col("name").cast("variant")),
        F.lit(',"result":'), F.coalesce(F.to_json(F.col("_first.content").cast("variant")), F.lit("null")), F.lit("}"),
    )
    link = F.struct(
        F.col("_first.result_turn").alias("result_turn"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_results"),
        F.when(F.col("_found").isNull(), F.lit(0)).otherwise(F.col("_level")).alias("level"),
        argument_errors(F.col("name"), F.col("arguments"), schemas).alias("errors"), body.alias("message"),
    )
    return rows.select("_row.*", link.alias("link"))


def in_order(linked: DataFrame, conversation: str) -> DataFrame:
    """The columns of linked (from link_calls, without map columns) and position long: the place of each call, from 0, in a
    topological order of its conversation.

    Calls come by level, those on a cycle (no level) last; within a level by call_id, then message and arguments, nulls
    first. A null conversation is one of its own. A conversation may be most of the table (common.numbered).
    """
    names = [c for c in linked.columns if c != "position"]
    rows = linked.select(*names, F.col("link.level").alias("_level"), F.col("link.message").alias("_message"))
    order = [F.col("_level").asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in ("call_id", "_message", "arguments"))]
    return common.numbered(rows, conversation, order, "position").select(*names, "position")


def conversations(linked: DataFrame, conversation: str, part_calls: int = 1000) -> DataFrame:
    """(conversation, part, n_calls (long), messages string): each conversation as canonical JSON, an array of its messages
    in the order of in_order, in parts of part_calls calls, so that no value grows with a conversation.

    Calls without a message (their arguments aren't JSON) are null in the array. An empty table gives none.
    """
    rows = in_order(linked, conversation).select(F.col(conversation), F.floor(F.col("position") / part_calls).cast("long").alias("part"), F.struct("position", F.coalesce("link.message", F.lit("null")).alias("m")).alias("_m"))
    told = rows.groupBy(conversation, "part").agg(F.sort_array(F.collect_list("_m")).alias("_all"))
    messages = F.concat(F.lit("["), F.array_join(F.transform("_all", lambda x: x["m"]), ","), F.lit("]"))
    return told.select(conversation, "part", F.size("_all").cast("long").alias("n_calls"), messages.alias("messages"))


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Turns of conversations as calls of one tool: what isn't the assistant's asks for a reply, the assistant's next turn
    is the result, and each call needs the one two turns before it."""
    turns = common.table(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws(":", F.when(F.col("conv_id").isNotNull(), F.concat(F.lit("c"), F.col("conv_id"))), turn)
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asks = turns.where(~F.col("role").eqNullSafe("assistant"))
    # arguments come unordered, as from a model; canonical() puts them in order
    calls = asks.select("conv_id", "turn", F.when(whole, key(F.col("turn"))).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("turn", "text", "role")).alias("arguments"))
    results = turns.where("role = 'assistant'").select(F.when(whole, key(F.col("turn") - 1)).alias("call_id"), F.col("turn").alias("result_turn"), F.col("text").alias("content"))
    needs = asks.where(whole).select(key(F.col("turn")).alias("id"), key(F.col("turn") - 2).alias("needs"))
    done = in_order(link_calls(calls, results, needs, REPLY_SCHEMA), "conv_id")
    return done.select("conv_id", "turn", "position", "link.result_turn", "link.n_results", F.col("link.level").cast("long").alias("level"), F.array_join("link.errors", ",").alias("errors"), F.sha2("link.message", 256).alias("message_sha256"))


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, 'c' || conv_id || ':' || turn AS id FROM conversations),
k AS (SELECT DISTINCT conv_id, turn FROM t WHERE role IS DISTINCT FROM 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
lv(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.conv_id = k.conv_id AND p.turn = k.turn - 2)
  UNION ALL SELECT k.conv_id, k.turn, lv.level + 1 FROM lv JOIN k ON k.conv_id = lv.conv_id AND k.turn = lv.turn + 2),
r AS (SELECT conv_id, turn - 1 AS turn, min(turn) AS result_turn, count(*) AS n, arg_min(text, (turn, text)) AS content FROM t WHERE role = 'assistant' GROUP BY ALL),
a AS (SELECT t.conv_id, t.turn, r.result_turn, coalesce(r.n, 0) AS n_results, CAST(coalesce(lv.level, 0) AS BIGINT) AS level,
       array_to_string(list_filter([
         CASE WHEN role IS NULL THEN 'missing:role' END, CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN t.turn IS NULL THEN 'missing:turn' END,
         CASE WHEN role NOT IN ('system', 'user') THEN 'range:role' END, CASE WHEN length(text) NOT BETWEEN 1 AND 20000 THEN 'range:text' END, CASE WHEN t.turn < 0 THEN 'range:turn' END
       ], lambda x: x IS NOT NULL), ',') AS errors,
       '{"arguments":{' || array_to_string([x FOR x IN ['"role":' || to_json(role), '"text":' || to_json(text), '"turn":' || t.turn] IF x IS NOT NULL], ',')
              || '},"id":' || to_json(id) || ',"name":"reply","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS message, id, text, role
FROM t LEFT JOIN r USING (conv_id, turn) LEFT JOIN lv USING (conv_id, turn)
WHERE role IS DISTINCT FROM 'assistant')
SELECT conv_id, turn, result_turn, n_results, level, errors, sha256(message) AS message_sha256,
       row_number() OVER (PARTITION BY conv_id ORDER BY level, id NULLS FIRST, message NULLS FIRST) - 1 AS position
FROM a
"""
