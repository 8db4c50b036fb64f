"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

A message's text may be a JSON object. An assistant's with ``tool_calls``, a list
of ``{"id", "name", "arguments"}``, makes calls; a message of role ``tool`` with
``tool_call_id`` gives a result. A call depends on the calls whose ids its
arguments name as strings ``"$id"``. Any other text is plain content.

Calls and results meet in a hash join on conversation and id; a call's level in
the topological order is one more than the highest level it depends on, found
round by round in joins on the same key, so a conversation of any length is
never gathered in one task. In each round a call that waits for one other alone
takes over what that one waits for, so a chain of n calls takes log n rounds.
Canonical JSON has its keys in order and no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Tables, attach

#: Argument types by tool: a word of JSON schema, a list of one type for an array's items, or the fields of an object.
#: A field whose name ends in ? may be absent; fields that aren't named are allowed only where the field * is.
Type = str | list | dict
Schemas = dict[str, dict[str, Type]]

_KINDS = {
    "string": "^STRING$",
    "integer": "^BIGINT$|^DECIMAL\\([0-9]+,0\\)$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*>$",
    "object": "^OBJECT<.*>$",
}


def canonical(value: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(value))


def fits(value: Column, kind: Type) -> Column:
    """Whether a variant is of a type; null for an absent one."""
    schema = F.schema_of_variant(value)
    if isinstance(kind, str):
        return schema.rlike(_KINDS[kind])
    if isinstance(kind, list):
        every = F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda item: F.coalesce(fits(item, kind[0]), F.lit(False)))
        return F.when(schema.isNotNull(), schema.startswith("ARRAY") & F.coalesce(every, F.lit(False)))
    good = schema.startswith("OBJECT")
    for field, inner in kind.items():
        if field != "*":
            part = F.try_variant_get(value, f"$['{field.rstrip('?')}']", "variant")
            good = good & F.coalesce(fits(part, inner), F.lit(field.endswith("?")))
    if "*" not in kind:
        names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        good = good & F.coalesce(F.forall(names, lambda name: name.isin(*[f.rstrip("?") for f in kind])), F.lit(False))
    return F.when(schema.isNotNull(), good)


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments fit the named tool's schema; false for an unknown tool or what isn't an object."""
    parsed = F.try_parse_json(arguments)
    verdict = F.lit(False)
    for tool, fields in schemas.items():
        verdict = F.when(name == tool, F.coalesce(fits(parsed, fields), F.lit(False))).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def read_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and what the text's JSON holds: calls and answered; ``_row`` tells the rows apart.

    A message without conv_id or turn makes no calls.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.when(F.ltrim(text).startswith("{"), text)
    calls = F.from_json(F.get_json_object(body, "$.tool_calls"), "array<struct<id:string,name:string,arguments:string>>")
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        text.alias("text"),
        F.when((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), calls).alias("calls"),
        F.when(F.col("role") == "tool", F.get_json_object(body, "$.tool_call_id")).alias("answered"),
        F.monotonically_increasing_id().alias("_row"),
    )


#: No chain of calls is longer.
ENDLESS = 1 << 40
#: Rounds whose levels are kept as tables of their own before they are put into one.
PARTS = 16


def levels_of(calls: DataFrame, needs: DataFrame, tables: Tables) -> DataFrame:
    """The level of every call (conv_id, call_id) that isn't on a cycle of needs (conv_id, call_id, needed) or behind one.

    A waiting call is held as the least level it can have and what it still
    waits for, each with the steps to it. A round removes the needs that were
    settled in the round before; then calls with one need left take over their
    need's, if that has one left too. When a round settles no call, none that
    is left ever will be. Calls that wait for several at each step of a long
    ladder settle one step a round.
    """
    key = ["conv_id", "call_id"]
    one = F.struct(F.col("needed"), F.lit(1).cast("bigint").alias("steps"))
    waiting = tables.put("waiting", needs.groupBy(*key).agg(F.lit(0).cast("bigint").alias("least"), F.collect_set(one).alias("needs")))
    settled = tables.put("settled0", calls.join(waiting, key, "left_anti").select(*key, F.lit(0).cast("bigint").alias("level")))
    parts, round_ = [settled], 0
    while not settled.isEmpty():
        round_ += 1
        known = settled.select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("below"))
        each = waiting.select(*key, "least", F.explode("needs").alias("need")).select(*key, "least", "need.*").join(known, ["conv_id", "needed"], "left")
        left = F.collect_list(F.when(F.col("below").isNull(), F.struct("needed", "steps")))
        after = each.groupBy(*key).agg(F.greatest(F.max("least"), F.max(F.col("below") + F.col("steps"))).alias("least"), left.alias("needs"))
        after = tables.put("after", after)
        settled = tables.put(f"settled{round_}", after.where("size(needs) = 0").select(*key, F.col("least").alias("level")))
        after = after.where("size(needs) > 0")
        only = F.when(F.size("needs") == 1, F.col("needs")[0])
        behind = after.where("size(needs) = 1").select("conv_id", F.col("call_id").alias("_of"), F.col("least").alias("_least"), F.col("needs")[0].alias("_need"))
        jumped = after.withColumn("_only", only).withColumn("_of", F.col("_only.needed")).join(behind, ["conv_id", "_of"], "left")
        further = F.array(F.struct(F.col("_need.needed").alias("needed"), F.least(F.col("_only.steps") + F.col("_need.steps"), F.lit(ENDLESS)).alias("steps")))
        found = F.col("_need").isNotNull()
        least = F.when(found, F.greatest("least", F.least(F.col("_least") + F.col("_only.steps"), F.lit(ENDLESS)))).otherwise(F.col("least"))
        waiting = tables.put("waiting", jumped.select(*key, least.alias("least"), F.when(found, further).otherwise(F.col("needs")).alias("needs")))
        parts.append(settled)
        if len(parts) > PARTS:
            whole = tables.put(f"levels{round_}", _union(parts))
            tables.drop(*[n for n in tables.held if n.startswith(("settled", "levels")) and n not in (f"settled{round_}", f"levels{round_}")])
            parts = [whole]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def link_calls(messages: DataFrame, schemas: Schemas, tables: Tables) -> DataFrame:
    """One row per call: the message row that makes it, where it is answered, its level, and whether its arguments are valid.

    A call without an id, or that repeats an earlier one's, is linked to
    nothing, while calls of one id at the same turn and place, as repeated rows
    have them, are linked alike; of several results the earliest after the call counts. Calls on a
    cycle, or behind one, have no level. An id that very many calls or results
    share is joined without meeting in one task.
    """
    both = F.when(F.col("call_id").isNotNull(), F.struct("conv_id", "call_id")).alias("key")
    made = messages.where("calls IS NOT NULL").select("_row", "conv_id", "turn", F.posexplode("calls").alias("index", "call"))
    made = made.select("_row", "conv_id", "turn", "index", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.coalesce("call.arguments", F.lit("{}")).alias("arguments"))
    made = tables.put("made", made.select("*", both))
    first = made.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("turn", "index")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = tables.put("first", first)
    answers = messages.where("answered IS NOT NULL").select("conv_id", F.col("answered").alias("call_id"), F.col("turn").alias("at")).select("at", both)
    counted = first.select("key", "first").join(answers.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    answered = attach(answers, tables.put("answers", counted), "key", "n").where("at > first.turn").groupBy("key").agg(F.min("at").alias("answered_at"))
    named = F.regexp_extract_all("arguments", F.lit('"\\$([^"]+)"'), F.lit(1))
    begun = attach(made.select("key", "turn", "index", "arguments"), first, "key", "n").where("turn = first.turn AND index = first.index")
    needs = begun.groupBy("key").agg(F.max("arguments").alias("arguments")).select("key.*", F.explode(F.array_distinct(named)).alias("needed"))
    calls = first.select("key.*")
    needs = tables.put("needs", needs.join(calls.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"]))
    levels = levels_of(calls, needs, tables).select(F.struct("conv_id", "call_id").alias("key"), "level")
    ordered = tables.put("ordered", first.join(answered, "key", "left").join(levels, "key", "left"))
    linked = attach(made, ordered, "key", "n")
    is_first = F.coalesce((F.col("turn") == F.col("first.turn")) & (F.col("index") == F.col("first.index")), F.lit(False))
    return linked.select(
        "_row", "index", "call_id", "name",
        F.coalesce(canonical(F.col("arguments")), F.col("arguments")).alias("arguments"),
        F.when(is_first, F.col("answered_at")).alias("answered_at"),
        F.when(is_first, F.col("level")).cast("int").alias("level"),
        valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"),
    )


def format_chats(conversations: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_linked, n_invalid, level and its canonical ``message``.

    ``level`` is the highest level of a message's calls, null without any.
    Messages stay rows, to be read in the order of conv_id and turn; null keys,
    repeated turns and empty texts are kept as they are, a null role is written
    as null. Messages that share conv_id and turn have their own calls each; a message
    without one of the two is plain content. So is JSON that can't be read.
    Arguments that aren't JSON are written as they are, as a string, and are
    invalid. Other fields of a message that makes or answers calls are carried
    over in canonical form, but for ``role``, which the table's column gives. An
    empty table gives an empty result.
    """
    tables = Tables(conversations.sparkSession)
    messages = tables.put("messages", read_messages(conversations))
    calls = tables.put("calls", link_calls(messages, schemas or {}, tables))
    written = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "level", "name", (F.col("answered_at").isNotNull()).alias("linked"), "valid"))
    grouped = calls.groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count("answered_at").alias("n_linked"),
        F.sum((~F.col("valid")).cast("int")).alias("n_invalid"),
        F.max("level").alias("level"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(2**31 - 1)), "index", written.alias("json")))), lambda s: s["json"])).alias("_calls"),
    )
    joined = messages.drop("calls").join(grouped, "_row", "left")
    quoted = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit('{"v":null}'))
    value = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(quoted(c), r'^\{"v":|\}$', ""))
    content = F.when(F.col("_calls").isNotNull(), value(F.get_json_object("text", "$.content"))).when(F.col("answered").isNotNull(), value(F.coalesce(F.get_json_object("text", "$.content"), F.lit("")))).otherwise(value(F.col("text")))
    field = lambda name, json: F.struct(F.lit(name).alias("key"), json.alias("json"))
    written = F.array(
        field("content", content), field("role", value(F.col("role"))),
        F.when(F.col("answered").isNotNull(), field("tool_call_id", value(F.col("answered")))),
        F.when(F.col("_calls").isNotNull(), field("tool_calls", F.concat(F.lit("["), F.col("_calls"), F.lit("]")))),
    )
    written = F.filter(written, lambda f: f.isNotNull())
    body = F.when(F.col("_calls").isNotNull() | F.col("answered").isNotNull(), F.from_json("text", "map<string,variant>"))
    others = F.transform(F.map_entries(body), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))
    others = F.filter(others, lambda o: ~F.exists(written, lambda f: f["key"] == o["key"]))
    fields = F.array_sort(F.concat(written, F.coalesce(others, F.array().cast("array<struct<key:string,json:string>>"))))
    pairs = F.transform(fields, lambda f: F.concat(F.regexp_replace(F.to_json(F.struct(f["key"].alias("v"))), r'^\{"v":|\}$', ""), F.lit(":"), f["json"]))
    parts = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return joined.select("conv_id", "turn", "role", zero("n_calls"), zero("n_linked"), zero("n_invalid"), F.col("level").cast("int").alias("level"), parts.alias("message"))
