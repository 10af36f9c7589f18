"""Chat formatting with tool calls linked to their results, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, ordered so
that a call stands behind the calls whose results it uses, checked against the
schemas of their functions, and written as canonical JSON (keys sorted, no white
space), one row per message, call or result.

Input forms.  An ``assistant`` text ``{"tool_calls": [{"id", "name",
"arguments"}, ...]}`` holds calls; ``content`` beside them is a message before
them (part -1), and a turn with an empty list of calls is a message; arguments may be an object or a string of
JSON, and use another call's result by ``{"$ref": "<id>"}``.  A ``tool`` text
``{"tool_call_id", "content"}`` is a result.  With ``turns_as_calls`` a plain
``user`` turn is a call of ``respond`` with the text as its prompt, and a plain
``assistant`` turn the result of the turn before.  All else is a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .work import written

# name, field, type (string, number, boolean, object, array), required
SCHEMAS = [
    ("respond", "prompt", "string", True), ("respond", "turn", "number", True), ("respond", "after", "string", False),
    ("check", "of", "string", True), ("check", "length", "number", True),
]
REF = r'"\$ref":"((?:[^"\\]|\\.)*)"'


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .otherwise("number")
    )


def parts(conversations: DataFrame, turns_as_calls: bool) -> DataFrame:
    """conv_id, turn, part, kind, role, call_id, name, arguments (canonical JSON or null), content."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    json = F.when(F.ltrim("text").startswith("{") & known, F.try_parse_json("text"))
    rows = rows.withColumn("_j", json)
    array = F.try_variant_get("_j", "$.tool_calls", "array<variant>")
    rows = rows.withColumn("_calls", F.when(F.col("role") == "assistant", array))
    rows = rows.withColumn("_of", F.when(F.col("role") == "tool", F.try_variant_get("_j", "$.tool_call_id", "string")))
    plain = rows.where("_calls IS NULL AND _of IS NULL")
    explicit = rows.where("_calls IS NOT NULL").select("conv_id", "turn", "role", F.posexplode("_calls").alias("part", "_c"))
    given = F.try_variant_get("_c", "$.arguments", "variant")
    inner = F.try_variant_get("_c", "$.arguments", "string")
    arguments = F.when(_kind(given) == "string", F.try_parse_json(inner)).otherwise(given)
    calls = explicit.select(
        "conv_id", "turn", "part", F.lit("call").alias("kind"), "role",
        F.try_variant_get("_c", "$.id", "string").alias("call_id"), F.try_variant_get("_c", "$.name", "string").alias("name"),
        F.to_json(arguments).alias("arguments"), F.lit(None).cast("string").alias("content"),
    )
    beside = F.try_variant_get("_j", "$.content", "string")
    said = rows.where("_calls IS NOT NULL").where((F.size("_calls") == 0) | beside.isNotNull()).select(
        "conv_id", "turn", F.when(F.size("_calls") == 0, 0).otherwise(-1).alias("part"), F.lit("message").alias("kind"), "role",
        F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.coalesce(beside, F.lit("")).alias("content"),
    )
    results = rows.where("_of IS NOT NULL").select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("result").alias("kind"), "role", F.col("_of").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.coalesce(F.try_variant_get("_j", "$.content", "string"), F.lit("")).alias("content"),
    )
    asks = known & (F.col("role") == "user") & F.lit(turns_as_calls)
    answers = known & (F.col("role") == "assistant") & (F.col("turn") > 0) & F.lit(turns_as_calls)
    text = F.coalesce("text", F.lit(""))
    rest = plain.select(
        "conv_id", "turn", F.lit(0).alias("part"),
        F.when(asks, "call").when(answers, "result").otherwise("message").alias("kind"), "role",
        F.when(asks, F.format_string("turn-%d", "turn")).when(answers, F.format_string("turn-%d", F.col("turn") - 1)).alias("call_id"),
        F.when(asks, "respond").alias("name"),
        F.when(asks, F.to_json(F.struct(text.alias("prompt"), F.col("turn")))).alias("arguments"),
        F.when(~F.coalesce(asks, F.lit(False)), text).alias("content"),
    )
    return calls.unionByName(said).unionByName(results).unionByName(rest)


def with_problems(calls: DataFrame, schemas: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """``calls`` with problem: the first by name of what doesn't fit the function's schema; null: all does.

    An argument of an unknown name, of another type than the schema's, or a
    required one that is missing; arguments that are no JSON object; a function
    without schema.  A ``$ref`` object fits every type; of two types of a field the
    first by name counts.  A function's schema is one row, so a call is checked where it is.
    """
    fields = schemas.where("name IS NOT NULL AND field IS NOT NULL").groupBy("name", "field").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    known = fields.groupBy(F.col("name").alias("_known")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("_types"),
        F.collect_list(F.when(F.col("required"), F.col("field"))).alias("_needed"),
    )
    known = written(known, "call-schemas")
    if known.count() <= most_broadcast:
        known = F.broadcast(known)
    given = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string, variant>")
    names = F.map_keys("_given")
    told = lambda kind, fields: F.transform(fields, lambda f: F.concat(F.lit(kind), f))

    def wrong(field: Column, value: Column) -> Column:
        ref = F.try_variant_get(value, "$['$ref']", "string").isNotNull()
        return ~ref & (F.coalesce(_kind(value), F.lit("null")) != F.element_at("_types", field))

    problems = F.concat(
        told("unknown:", F.array_except(names, F.map_keys("_types"))),
        told("type:", F.map_keys(F.map_filter("_given", wrong))),
        told("missing:", F.array_except("_needed", names)),
    )
    problem = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("function:"), F.coalesce("name", F.lit(""))))
        .when(F.col("_given").isNull(), "arguments").otherwise(F.array_min(problems))
    )
    out = calls.withColumn("_given", given).join(known, F.col("name") == F.col("_known"), "left")
    return out.withColumn("problem", problem).drop("_given", "_known", "_types", "_needed")


def ordered(calls: DataFrame) -> DataFrame | None:
    """conv_id, call_id, place, stage (null: on a cycle, or behind one), lost of the calls that use results or are used.

    ``calls`` (conv_id, call_id, turn, refs) own their identifiers.  A call
    can't stand before what it uses: its place is the last turn among its own and
    the places of the calls it uses.  Uses of calls of earlier places are in order
    by that; those within a place are put into stages, a call one behind the last
    that it uses.  Calls on a cycle all have one place.  ``lost`` is the first
    identifier in use that the conversation doesn't have.  Rounds go with the
    longest chain of uses of later turns, and the longest within a place; chains
    back through the turns take none.  None: no call uses another.
    """
    inner = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), "_r", F.lit('"'))), "$", "string")
    uses = calls.select("conv_id", "call_id", "turn", F.explode("refs").alias("_r"))
    uses = uses.select("conv_id", "call_id", "turn", inner.alias("_on")).distinct()
    other = calls.select("conv_id", F.col("call_id").alias("_on"), F.col("turn").alias("_turn")).distinct()
    edges = written(uses.join(other.hint("shuffle_hash"), ["conv_id", "_on"], "left"), "call-edges")
    if edges.isEmpty():
        return None
    key = ["conv_id", "call_id"]
    lost = edges.where("_turn IS NULL").groupBy(*key).agg(F.min("_on").alias("lost"))
    met = edges.where("_turn IS NOT NULL")
    places = met.select(*key, "turn").union(met.select("conv_id", "_on", "_turn")).distinct().withColumnRenamed("turn", "place")
    places = written(places, "call-places")
    if not met.where("_turn > turn").isEmpty():
        total = None
        while True:
            on = places.select("conv_id", F.col("call_id").alias("_on"), F.col("place").alias("_p"))
            far = met.join(on, ["conv_id", "_on"]).groupBy(*key).agg(F.max("_p").alias("_far"))
            places = written(places.join(far, key, "left").select(*key, F.greatest("place", "_far").alias("place")), "call-places")
            # places only ever rise
            before, total = total, places.agg(F.sum(F.col("place").cast("decimal(38,0)"))).first()[0]
            if total == before:
                break
    at = places.select("conv_id", F.col("call_id").alias("_on"), F.col("place").alias("_p"))
    tight = written(met.join(places, key).join(at, ["conv_id", "_on"]).where("place = _p").select(*key, "_on"), "call-tight")
    users = tight.select(*key).distinct()
    done = written(places.select(*key).join(users, key, "left_anti").withColumn("stage", F.lit(0)), "call-stages")
    while not tight.isEmpty():
        ready = tight.join(done.select("conv_id", F.col("call_id").alias("_on"), "stage"), ["conv_id", "_on"], "left")
        ready = ready.groupBy(*key).agg(F.max("stage").alias("_s"), F.count("stage").alias("_k"), F.count(F.lit(1)).alias("_n"))
        ready = ready.where("_k = _n").select(*key, (F.col("_s") + 1).alias("stage")).join(done.select(*key), key, "left_anti")
        ready = written(ready, "call-ready")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
    return places.join(done, key, "left").join(lost, key, "full_outer").withColumn("_cycle", F.col("place").isNotNull() & F.col("stage").isNull())


def format_chats(conversations: DataFrame, schemas: DataFrame, turns_as_calls: bool = False) -> DataFrame:
    """One row per message, call or result: conv_id, turn, place, stage, part, kind, call_id, status, json.

    Rows of a conversation in the order (place, stage, turn, part) are
    topologically ordered: no call stands before a call whose result it uses, but
    for those of status ``cycle``.  ``place`` is the turn, of a call that uses a
    call of a later turn that one's place.  ``status`` of a call: ``duplicate``
    (its identifier came before in the conversation), ``cycle`` (on one, or using
    one of its place), ``lost:<id>`` (uses an identifier that the conversation
    doesn't have), ``invalid:<problem>``, ``unanswered`` or ``ok``; of a result
    ``orphan``, ``early`` (not behind its call's place) or ``ok``; of a message
    ``ok``, or ``unplaced`` if conv_id or turn is null.  A call without identifier
    is unanswered, and its uses aren't followed, as a duplicate's aren't.  Nulls in
    text or role count as empty.  Repeated rows give repeated rows: of calls the
    first by (turn, part) owns the identifier, and rows alike in these are owners
    together.  Empty tables give an empty result; other columns are ignored; texts
    of any length are taken whole.

    Conversations are never gathered: every join is on conversation and
    identifier, so that a conversation with a third of the rows is spread.
    """
    rows = written(parts(conversations, turns_as_calls), "chat-parts")  # parsed once, for the joins on identifiers and for the result
    calls = rows.where("kind = 'call'")
    ident = ["conv_id", "call_id"]
    refs = F.regexp_extract_all("arguments", F.lit(REF), F.lit(1))
    first = F.min(F.struct("turn", "part", refs.alias("refs")))
    owner = calls.where("call_id IS NOT NULL").groupBy(*ident).agg(first.alias("_own"))
    order = ordered(owner.select(*ident, "_own.turn", "_own.refs"))
    if order is not None:
        owner = owner.join(order.hint("shuffle_hash"), ident, "left")
    else:
        owner = owner.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("place", "long"), ("stage", "int"), ("lost", "string"), ("_cycle", "boolean"))))
    owner = owner.select(*ident, F.col("_own.turn").alias("_turn"), F.col("_own.part").alias("_part"), "place", "stage", "lost", "_cycle")
    owner = written(owner, "call-owners")
    answered = rows.where("kind = 'result'").select(*ident).distinct().withColumn("_answered", F.lit(True))
    out = with_problems(calls, schemas)
    out = out.join(owner.hint("shuffle_hash"), ident, "left").join(answered.hint("shuffle_hash"), ident, "left")
    own = (F.col("turn") == F.col("_turn")) & (F.col("part") == F.col("_part"))
    status = (
        F.when(~own, "duplicate").when(F.col("_cycle"), "cycle")
        .when(F.col("lost").isNotNull(), F.concat(F.lit("lost:"), "lost"))
        .when(F.col("problem").isNotNull(), F.concat(F.lit("invalid:"), "problem"))
        .when(F.col("_answered"), "ok").otherwise("unanswered")
    )
    # fields in alphabetical order; arguments are canonical JSON already
    head = F.to_json(F.struct(F.coalesce("call_id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("role", F.lit("")).alias("role")))
    json = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(","), F.substring(head, 2, 2**31 - 1))
    columns = ["conv_id", "turn", "place", "stage", "part", "kind", "call_id", "status", "json"]
    place, stage = F.when(own, F.col("place")), F.when(own, F.col("stage"))
    out = out.select(
        "conv_id", "turn", F.coalesce(place, "turn").alias("place"), F.coalesce(stage, F.lit(0)).alias("stage"), "part", "kind", "call_id",
        status.alias("status"), json.alias("json"),
    )

    results = rows.where("kind = 'result'").join(owner.drop("stage").hint("shuffle_hash"), ident, "left")
    told = F.when(F.col("_turn").isNull(), "orphan").when(F.coalesce("place", "_turn") >= F.col("turn"), "early").otherwise("ok")
    json = F.to_json(F.struct(F.col("content"), F.coalesce("role", F.lit("")).alias("role"), F.col("call_id").alias("tool_call_id")))
    results = results.withColumn("status", told).withColumn("place", F.col("turn")).withColumn("stage", F.lit(0)).withColumn("json", json).select(*columns)

    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    json = F.to_json(F.struct(F.col("content"), F.coalesce("role", F.lit("")).alias("role")))
    messages = rows.where("kind = 'message'").withColumn("place", F.col("turn")).withColumn("stage", F.lit(0))
    messages = messages.withColumn("status", F.when(placed, "ok").otherwise("unplaced")).withColumn("json", json).select(*columns)
    return out.unionByName(results).unionByName(messages)


def as_tool_turns(conversations: DataFrame) -> DataFrame:
    """Plain turns as turns with calls: conv_id, turn, role, text.

    A user turn t becomes an assistant's turn with two calls.  ``ask-t`` asks
    ``respond`` with the text as its prompt, after the turn before the last
    (``ask-(t-2)``); ``check-t`` checks ``ask-t``.  By the text's length n some are
    wrong: n divisible by 5 gives the turn as a string, by 7 leaves the prompt out,
    by 3 adds an unknown field to the check; n divisible by 11 makes the two use
    each other, and by 13 the call use the next one, ``ask-(t+2)``, instead.  An
    assistant's turn t becomes the result of ``ask-(t-1)``.  Other turns stay.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    name = lambda kind, t: F.concat(F.lit(kind + "-"), t.cast("string"))
    ref = lambda i: F.create_map(F.lit("$ref"), i)
    after = F.when(n % 11 == 0, name("check", turn)).when(n % 13 == 0, name("ask", turn + 2)).when(turn >= 2, name("ask", turn - 2))
    # an object is written as the JSON it is given as: arguments may be a string of JSON
    ask = F.struct(
        F.when(after.isNotNull(), ref(after)).alias("after"), F.when(n % 7 != 0, text).alias("prompt"),
        F.when(n % 5 != 0, turn).alias("turn"),
    )
    spelt = F.struct(F.when(after.isNotNull(), ref(after)).alias("after"), F.when(n % 7 != 0, text).alias("prompt"), turn.cast("string").alias("turn"))
    check = F.struct(n.alias("length"), F.when(n % 3 == 0, F.lit("third")).alias("note"), ref(name("ask", turn)).alias("of"))
    call = lambda kind, given, what: F.struct(name(kind, turn).alias("id"), F.lit(what).alias("name"), given.alias("arguments"))
    asked = F.when(n % 5 == 0, F.to_json(spelt)).otherwise(F.to_json(ask))
    calls = F.to_json(F.struct(F.array(call("ask", asked, "respond"), call("check", F.to_json(check), "check")).alias("tool_calls")))
    result = F.to_json(F.struct(text.alias("content"), name("ask", turn - 1).alias("tool_call_id")))
    user, answer = F.col("role") == "user", (F.col("role") == "assistant") & (turn > 0)
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, calls).when(answer, result).otherwise(F.col("text")).alias("text"),
    )


def schema_table(spark, rows=SCHEMAS) -> DataFrame:
    return spark.createDataFrame(rows, "name string, field string, type string, required boolean")


def op8_tool_calls(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_chats(as_tool_turns(chats), schema_table(spark))


# the calls of as_tool_turns(), and over them what format_chats() says
ORACLE = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
ask AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'check-' || turn WHEN n % 13 = 0 THEN 'ask-' || (turn + 2) WHEN turn >= 2 THEN 'ask-' || (turn - 2) END AS ref FROM c WHERE role = 'user'),
call AS (SELECT conv_id, turn, 0 AS part, 'ask-' || turn AS id, ref,
    CASE WHEN n % 7 = 0 THEN 'missing:prompt' WHEN n % 5 = 0 THEN 'type:turn' END AS problem,
    '{"arguments":{' || CASE WHEN ref IS NULL THEN '' ELSE '"after":{"$ref":"' || ref || '"},' END || CASE WHEN n % 7 = 0 THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END
    || '"turn":' || CASE WHEN n % 5 = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END || '},"id":"ask-' || turn || '","name":"respond","role":"assistant"}' AS json FROM ask
  UNION ALL SELECT conv_id, turn, 1, 'check-' || turn, 'ask-' || turn, CASE WHEN n % 3 = 0 THEN 'unknown:note' END,
    '{"arguments":{"length":' || n || CASE WHEN n % 3 = 0 THEN ',"note":"third"' ELSE '' END || ',"of":{"$ref":"ask-' || turn || '"}},"id":"check-' || turn || '","name":"check","role":"assistant"}' FROM ask),
edge AS (SELECT x.conv_id, x.id, x.turn, y.id AS used, y.turn AS used_turn FROM call x JOIN call y ON y.conv_id = x.conv_id AND y.id = x.ref),
reach AS (SELECT conv_id, id, used, used_turn FROM edge UNION SELECT r.conv_id, r.id, e.used, e.used_turn FROM reach r JOIN edge e ON e.conv_id = r.conv_id AND e.id = r.used),
place AS (SELECT call.conv_id, call.id, greatest(call.turn, coalesce(max(used_turn), call.turn)) AS place FROM call LEFT JOIN reach USING (conv_id, id) GROUP BY call.conv_id, call.id, call.turn),
tight AS (SELECT e.conv_id, e.id, e.used FROM edge e JOIN place p ON p.conv_id = e.conv_id AND p.id = e.id JOIN place q ON q.conv_id = e.conv_id AND q.id = e.used WHERE p.place = q.place),
near AS (SELECT conv_id, id, used FROM tight UNION SELECT r.conv_id, r.id, e.used FROM near r JOIN tight e ON e.conv_id = r.conv_id AND e.id = r.used),
loop AS (SELECT DISTINCT conv_id, id FROM near WHERE id = used),
bad AS (SELECT conv_id, id FROM loop UNION SELECT n.conv_id, n.id FROM near n JOIN loop l ON l.conv_id = n.conv_id AND l.id = n.used),
deep AS (SELECT conv_id, id, 0 AS d FROM call WHERE (conv_id, id) NOT IN (SELECT conv_id, id FROM bad)
  UNION SELECT t.conv_id, t.id, d + 1 FROM deep JOIN tight t ON t.conv_id = deep.conv_id AND t.used = deep.id WHERE (t.conv_id, t.id) NOT IN (SELECT conv_id, id FROM bad)),
stage AS (SELECT conv_id, id, max(d) AS stage FROM deep GROUP BY conv_id, id),
res AS (SELECT conv_id, turn, role, text, 'ask-' || (turn - 1) AS id FROM c WHERE role = 'assistant' AND turn > 0)
SELECT call.conv_id, call.turn, place, coalesce(stage, 0)::INT AS stage, part, 'call' AS kind, call.id AS call_id,
  CASE WHEN bad.id IS NOT NULL THEN 'cycle' WHEN ref IS NOT NULL AND (call.conv_id, ref) NOT IN (SELECT conv_id, id FROM call) THEN 'lost:' || ref
       WHEN problem IS NOT NULL THEN 'invalid:' || problem WHEN (call.conv_id, call.id) IN (SELECT conv_id, id FROM res) THEN 'ok' ELSE 'unanswered' END AS status, json
FROM call JOIN place USING (conv_id, id) LEFT JOIN stage USING (conv_id, id) LEFT JOIN bad ON bad.conv_id = call.conv_id AND bad.id = call.id
UNION ALL SELECT res.conv_id, turn, turn, 0, 0, 'result', res.id, CASE WHEN p.id IS NULL THEN 'orphan' WHEN p.place >= turn THEN 'early' ELSE 'ok' END,
  '{"content":' || to_json(text)::VARCHAR || ',"role":"tool","tool_call_id":"' || res.id || '"}' FROM res LEFT JOIN place p ON p.conv_id = res.conv_id AND p.id = res.id
UNION ALL SELECT conv_id, turn, turn, 0, 0, 'message', NULL, 'ok', '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}'
FROM c WHERE role <> 'user' AND NOT (role = 'assistant' AND turn > 0)
"""
