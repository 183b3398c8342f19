"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

DataFrame functions only. Calls and results meet in an equi-join on (conversation, call id). Calls are ordered
topologically, and by turn and place where dependencies leave a choice: a call's key is the greatest of its own
(turn, place, 0) and, for each call it depends on, that call's key with one hop more. Keys move only where a call
precedes one that it depends on, so rounds of joins are needed for such chains alone, not for the length of a
conversation; calls on a cycle, and calls behind it that it moves, have no key and come last. Arguments are checked against schemas (names, JSON
types, required ones). Canonical JSON has sorted keys and no blanks; null fields are left out.

Calls stand as <tool_call>{"id", "name", "arguments", "depends_on"}</tool_call> in assistant texts, their results in
'tool' messages as {"tool_call_id", "content"}. With turns=True every user message is also a call of the tool
'reply', answered by the assistant message of the next turn and dependent on the user message two turns before.

Defined results: null roles and texts are left out of their message; unparsable calls are ignored, unparsable
arguments are invalid and left out; of several calls or results with one id the first by turn counts (then by place,
then by text); a conversation is cut into segments of SEGMENT turns, and a segment of over CROWDED messages (many rows of
one turn) into several rows, dealt by hash, so that no row grows without bound; rows without conversation or turn are
dropped; equal rows are separate messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.shared import materialise

SEGMENT, CROWDED = 1024, 16_384
#: The hops of a key on a cycle, or raised by one.
ENDLESS = 1 << 30
#: tool -> argument -> (JSON types, required)
Schemas = dict[str, dict[str, tuple[tuple[str, ...], bool]]]
REPLY: Schemas = {"reply": {"prompt": (("string",), True), "turn": (("integer",), True)}}

JSON_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "null": ("VOID",), "array": ("ARRAY",), "object": ("OBJECT",)}


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the JSON text `arguments` fits the schema of the tool `name`; an unknown tool or broken JSON does not."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    fits = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        good = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, sorted(fields))).cast("array<string>"))) == 0, F.lit(False))
        for field, (types, required) in sorted(fields.items()):
            kind = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant"))
            of_type = F.lit(False)
            for t in types:
                for prefix in JSON_TYPES[t]:
                    of_type = of_type | F.coalesce(kind.startswith(prefix), F.lit(False))
            there = F.coalesce(F.array_contains(keys, field), F.lit(False))
            good = good & (of_type if required else (~there | of_type))
        fits = fits | ((name == tool) & good)
    return F.coalesce(fits, F.lit(False))


def embedded_calls(messages: DataFrame) -> DataFrame:
    """Calls in assistant texts: conv_id, turn, place, call_id, name, arguments, depends_on."""
    blocks = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)).alias("place", "block"))
    one = F.try_parse_json("block")
    return blocks.select(
        "conv_id", "turn", "place",
        F.try_variant_get(one, "$.id", "string").alias("call_id"),
        F.try_variant_get(one, "$.name", "string").alias("name"),
        F.to_json(F.try_variant_get(one, "$.arguments", "variant")).alias("arguments"),
        F.coalesce(F.try_variant_get(one, "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    ).where("call_id is not null and name is not null")


def turn_calls(messages: DataFrame) -> DataFrame:
    """Every user message as a call of 'reply'."""
    call = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    return messages.where("role = 'user'").select(
        "conv_id", "turn", F.lit(-1).alias("place"), call(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.array(call(F.col("turn") - 2)).alias("depends_on"),
    )


def results(messages: DataFrame, turns: bool) -> DataFrame:
    """conv_id, call_id, turn, content of results."""
    body = F.try_parse_json("text")
    out = messages.where("role = 'tool'").select("conv_id", F.try_variant_get(body, "$.tool_call_id", "string").alias("call_id"), "turn", F.try_variant_get(body, "$.content", "string").alias("content")).where("call_id is not null")
    if turns:
        out = out.unionByName(messages.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")))
    return out


def first_of(df: DataFrame, *order: str) -> DataFrame:
    """The first row of each (conv_id, call_id), without sorting a group: the least struct."""
    rest = [c for c in df.columns if c not in ("conv_id", "call_id")]
    lead = [*order, *(c for c in rest if c not in order)]
    return df.groupBy("conv_id", "call_id").agg(F.min(F.struct(*lead)).alias("s")).select("conv_id", "call_id", *(F.col(f"s.{c}").alias(c) for c in rest))


def topological_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, key struct<turn, place, hops>): dependencies have lesser keys; null on and behind cycles."""
    own = F.struct("turn", "place", F.lit(0).alias("hops"))
    keys = calls.select("conv_id", "call_id", own.alias("key"))
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("dep"))
    dep_keys = lambda k: k.select("conv_id", F.col("call_id").alias("dep"), F.struct("key.turn", "key.place", (F.col("key.hops") + 1).alias("hops")).alias("dep_key"))
    # only calls that some chain of dependencies can move take part: those before a call they depend on, and what follows
    known = materialise(needs.join(dep_keys(keys), ["conv_id", "dep"]).join(keys, ["conv_id", "call_id"]).select("conv_id", "call_id", "dep", "key", "dep_key"))
    if known.where("dep_key > key").isEmpty():
        return keys
    edges = materialise(needs.join(calls.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]))
    # a round takes the calls that the last one raised to their dependents; the others have their final key
    raised = materialise(known.where("dep_key > key").groupBy("conv_id", "call_id").agg(F.max("dep_key").alias("key")))
    moved = raised
    while True:
        # a chain of more hops than calls have moved has met a call twice: a cycle, whose hops go to ENDLESS at once
        chains = moved.groupBy("conv_id").agg(F.count("*").alias("most"))
        offers = edges.join(dep_keys(raised), ["conv_id", "dep"]).join(chains, "conv_id")
        hops = F.when(F.col("dep_key.hops") > F.col("most"), ENDLESS).otherwise(F.col("dep_key.hops"))
        offers = offers.groupBy("conv_id", "call_id").agg(F.max(F.struct("dep_key.turn", "dep_key.place", hops.alias("hops"))).alias("offer"))
        had = keys.select("conv_id", "call_id", F.col("key").alias("own")).join(offers, ["conv_id", "call_id"]).join(moved.withColumnRenamed("key", "moved"), ["conv_id", "call_id"], "left")
        raised = materialise(had.where(F.col("offer") > F.coalesce("moved", "own")).select("conv_id", "call_id", F.col("offer").alias("key")))
        if raised.isEmpty():
            break
        moved = materialise(moved.join(raised, ["conv_id", "call_id"], "left_anti").unionByName(raised))
    final = keys.join(moved.withColumnRenamed("key", "moved"), ["conv_id", "call_id"], "left")
    key = F.coalesce("moved", "key")
    return final.select("conv_id", "call_id", F.when(key["hops"] < ENDLESS, key).alias("key"))


def linked_calls(messages: DataFrame, schemas: Schemas, turns: bool = False) -> DataFrame:
    """conv_id, turn, place, call_id, name, arguments (canonical), key, valid, linked, result_turn."""
    calls = embedded_calls(messages)
    if turns:
        calls = calls.unionByName(turn_calls(messages))
    calls = materialise(first_of(calls, "turn", "place", "name", "arguments"))
    answers = first_of(results(messages, turns), "turn", "content")
    answers = answers.select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.lit(True).alias("linked"))
    out = calls.join(topological_keys(calls), ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    return out.select("conv_id", "turn", "place", "call_id", "name", F.to_json(F.try_parse_json("arguments")).alias("arguments"), "key", valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"), F.coalesce("linked", F.lit(False)).alias("linked"), "result_turn")


def canonical(**fields: Column) -> Column:
    """A JSON object of fields that are JSON texts already, keys sorted; null ones are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(text: Column) -> Column:
    """A string as a JSON text."""
    one = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(one, 6, 1 << 30).substr(F.lit(1), F.length(one) - 6))


def format_chats(conversations: DataFrame, schemas: Schemas = REPLY, turns: bool = True, segment: int = SEGMENT, crowded: int = CROWDED) -> DataFrame:
    """conv_id, segment, n_messages, n_calls, n_linked, n_valid, chat (canonical JSON)."""
    messages = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), conversations["role"].cast("string").alias("role"), conversations["text"].cast("string").alias("text")).where("conv_id is not null and turn is not null")
    part = F.floor(F.col("turn") / segment).alias("segment")
    calls = linked_calls(messages, schemas, turns)
    call = canonical(arguments=F.col("arguments"), id=quoted(F.col("call_id")), linked=F.col("linked").cast("string"), name=quoted(F.col("name")), result_turn=F.col("result_turn").cast("string"), turn=F.col("turn").cast("string"), valid=F.col("valid").cast("string"))
    said = canonical(content=quoted(F.col("text")), role=quoted(F.col("role")), turn=F.col("turn").cast("string"))
    ranked = F.struct(F.col("key").isNull().cast("int").alias("last"), "key", "turn", "place", "call_id", call.alias("json"))
    items = messages.select("conv_id", part, F.struct("turn", "role", said.alias("json")).alias("message"), F.lit(None).cast("struct<last:int,key:struct<turn:bigint,place:int,hops:int>,turn:bigint,place:int,call_id:string,json:string>").alias("call"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"))
    items = items.unionByName(calls.select("conv_id", part, F.lit(None).cast("struct<turn:bigint,role:string,json:string>").alias("message"), ranked.alias("call"), "linked", "valid"))
    full = materialise(messages.groupBy("conv_id", part).agg(F.ceil(F.count("*") / crowded).alias("parts")).where("parts > 1"))
    if full.isEmpty():
        items = items.withColumn("piece", F.lit(0))
    else:
        own = F.coalesce("message.json", "call.json")
        items = items.withColumn("place", F.monotonically_increasing_id()).join(full, ["conv_id", "segment"], "left").withColumn("piece", F.pmod(F.xxhash64(own, "place"), F.coalesce("parts", F.lit(1))))
    grouped = items.groupBy("conv_id", "segment", "piece").agg(
        F.count("message").alias("n_messages"),
        F.count("call").alias("n_calls"),
        F.count_if("linked").alias("n_linked"),
        F.count_if("valid").alias("n_valid"),
        F.collect_list("message").alias("messages"),
        F.collect_list("call").alias("calls"),
    )
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), lambda x: x["json"]), ","), F.lit("]"))
    chat = canonical(calls=listed("calls"), id=F.col("conv_id").cast("string"), messages=listed("messages"), segment=F.col("segment").cast("string"))
    return grouped.select("conv_id", "segment", "n_messages", "n_calls", "n_linked", "n_valid", chat.alias("chat"))


__all__ = ["REPLY", "SEGMENT", "format_chats", "linked_calls", "topological_keys", "valid_arguments"]
