"""Tool-call linking for chats, in DataFrame operations only.

Input are three tables: ``calls`` (conversation, turn, place within the turn, call id,
tool, arguments as JSON text), ``results`` (conversation, turn, place, call id, content)
and ``others`` (conversation, turn, role, content): the turns that are neither. ``parsed``
reads all three from a conversations table whose turns hold calls and results as JSON;
``exchanges`` reads a plain conversation as calls of one tool, a user's turn
being the call and the assistant's turn right after it the result.

* Linking: an equi-join of calls and results on conversation and call id. A result
  without a call, a call without a result, and an id that occurs more than once on
  its side are told by ``status``.
* Order: a result comes after its call, and a call after the results that its
  arguments name by ``{"$result": "<call id>"}``, however deep within them. ``level`` is
  the length of the longest chain before a message; messages on or behind a circle have
  none. Runs of calls that name one result each are doubled over, so a chain of any length
  takes a logarithm of rounds; calls that name several take a round for each of them on
  one way. Sorting by level, turn, place and kind gives a topological order of a
  conversation, and no conversation is gathered in one task.
* Arguments are checked against the tool's schema: unknown tool, no JSON object,
  missing, unknown and wrongly typed arguments.
* Canonical JSON: keys sorted, no spaces, numbers in plain decimals without needless
  zeros where they have at most 20 digits before and 18 behind the point (others as the
  shortest digits that give the same double, with ``e``).

Rows: a null conversation, turn or text gives a message that links to nothing; a turn of
any other role, or of none, is a message of its own with the status ``message``; null or
empty arguments are no JSON object; repeated rows stay, as repeated ids; ties in the order
(equal level, turn, place and kind) are repeated ids and go in any order; very long texts
are worked on within their row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import saved

#: JSON types of a schema, and how the type of a variant value begins.
TYPES = {"string": ("STRING",), "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


@dataclass
class Tool:
    """A tool's arguments: name to JSON type; which must be there; whether others may."""

    params: dict[str, str]
    required: list[str] = field(default_factory=list)
    open: bool = False


#: The tool as whose calls ``exchanges`` reads a conversation.
REPLY = {"reply": Tool({"text": "string", "turn": "integer", "after": "object"}, ["text", "turn"])}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def problems(tool: str, arguments: str, tools: dict[str, Tool]) -> Column:
    """Sorted problems of the JSON text ``arguments`` against the schema of the column ``tool``."""
    variant = f"try_parse_json({arguments})"
    cases = []
    for name, t in tools.items():
        missing = [f"if(try_variant_get(v, {_text('$[' + repr(p) + ']')}, 'variant') is null, {_text('missing:' + p)}, null)" for p in sorted(t.required)]
        known = "array(" + ", ".join(map(_text, t.params)) + ")" if t.params else "cast(array() as array<string>)"
        extra = "cast(array() as array<string>)" if t.open else f"transform(array_sort(array_except(coalesce(json_object_keys({arguments}), array()), {known})), x -> concat('unknown:', x))"
        wrong = []
        for p, kind in sorted(t.params.items()):
            got = f"schema_of_variant(try_variant_get(v, {_text('$[' + repr(p) + ']')}, 'variant'))"
            fits = " or ".join(f"startswith({got}, '{x}')" for x in TYPES[kind])
            if kind == "integer":  # a whole number, however it is written
                value = f"try_variant_get(v, {_text('$[' + repr(p) + ']')}, 'double')"
                fits = f"({fits}) and {value} = floor({value})"
            wrong.append(f"if({got} is null or ({fits}), null, {_text('type:' + p)})")
        checks = ", ".join([*missing, *wrong])
        listed = f"array_compact(array({checks}))" if checks else "cast(array() as array<string>)"
        cases.append(f"when {tool} = {_text(name)} then concat({listed}, {extra})")
    body = f"case when v is null or not startswith(schema_of_variant(v), 'OBJECT') then array('arguments:no object') {' '.join(cases)} else array('tool:unknown') end"
    return F.expr(f"array_sort(transform(array({variant}), v -> {body})[0])")


def _numbers(json: str) -> str:
    """SQL: the compact JSON text with its numbers in canonical form; strings are left as they are."""
    token = _text(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+')
    plain = "try_cast(x as decimal(38,18))"
    short = f"regexp_replace(cast({plain} as string), '[.]?0+$', '')"
    other = "lower(cast(cast(x as double) as string))"
    number = f"case when not rlike(x, '[.eE]') then if(x = '-0', '0', x) when cast({plain} as double) = cast(x as double) then if({plain} = 0, '0', {short}) else {other} end"
    return f"array_join(transform(regexp_extract_all({json}, {token}, 0), x -> if(rlike(x, '^-?[0-9]'), {number}, x)), '')"


def _json(column: str) -> Column:
    """The canonical JSON text of a compact one with sorted keys."""
    return F.expr(f"if(rlike({column}, '[0-9][.eE]|-0'), {_numbers(column)}, {column})")


def canonical(json: str) -> Column:
    """The JSON text with sorted keys, without spaces and with canonical numbers; null where it is no JSON."""
    return F.expr(f"transform(array(to_json(try_parse_json({json}))), z -> if(rlike(z, '[0-9][.eE]|-0'), {_numbers('z')}, z))[0]")


def parsed(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and results of turns whose text is JSON, and the turns that are neither.

    Calls: ``{"tool_calls": [{"id":, "name":, "arguments": {}}]}``; results, in turns
    of the role ``tool``: ``{"tool_call_id":, "content":}``.
    """
    schema = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"
    said = conversations.select("conv_id", "turn", "role", "text", F.from_json("text", schema).alias("m"))
    is_calls, is_result = F.expr("coalesce(role = 'assistant' and size(m.tool_calls) > 0, false)"), F.expr("coalesce(role = 'tool' and m.tool_call_id is not null, false)")
    calls = said.where(is_calls).select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "c"))
    return (
        calls.select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments")),
        said.where(is_result).select("conv_id", "turn", F.lit(0).alias("place"), F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content")),
        said.where(~is_calls & ~is_result).select("conv_id", "turn", "role", F.col("text").alias("content")),
    )


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A plain conversation as calls of the tool ``reply`` with the id ``call_<turn>``, and the turns that are neither call nor result.

    A call names the result of the call two turns before it, as an exchange goes on from the
    last one. As plain turns hold no mistakes, some calls get one each, by (7 conv_id + turn)
    mod 16: 1 arguments that are a list, 2 no text, 3 a turn that is text, 4 an argument that the
    tool doesn't know, 5 a tool that isn't there, 6 two results named in a list; and in every
    tenth conversation turns 1 and 3 name each other.
    """
    kind = F.expr("coalesce(pmod(7 * conv_id + turn, 16), 0)")
    ref = lambda back: f"""concat('{{"$result":"call_', turn - {back}, '"}}')"""
    text = "transform(array(to_json(struct(text))), j -> substr(j, 2, length(j) - 2))[0]"
    after = F.when(F.expr("pmod(conv_id, 10) = 3 and turn = 1"), F.lit('"after":{"$result":"call_3"}')).when(kind == 6, F.expr(f"concat('\"after\":[', {ref(2)}, ',', {ref(4)}, ']')")).otherwise(F.expr(f"concat('\"after\": ', {ref(2)})"))
    fields = [
        (F.expr(text), F.expr("text is not null") & (kind != 2)),
        (F.when(kind == 3, F.expr("concat('\"turn\":\"', turn, '\"')")).otherwise(F.expr("concat('\"turn\":', turn, '.0')")), F.expr("turn is not null")),
        (F.lit('"extra":[1e2, -0.50]'), kind == 4),
        (after, F.expr("turn >= 2 or pmod(conv_id, 10) = 3 and turn = 1")),
    ]
    listed = F.array_join(F.array_compact(F.array(*(F.when(there, value) for value, there in fields))), ", ")
    arguments = F.when(kind == 1, F.lit("[1]")).otherwise(F.concat(F.lit("{"), listed, F.lit("}")))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("place"), F.concat(F.lit("call_"), F.col("turn")).alias("call_id"), F.when(kind == 5, "ask").otherwise("reply").alias("tool"), arguments.alias("arguments"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", F.lit(0).alias("place"), F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, conversations.where("coalesce(role, '') not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))


def _depths(edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` of the calls that name results: how many calls are on the longest chain before each.

    ``edges``: a call (``after``) and a call whose result it names (``before``), each once. What
    is on or behind a circle has no row. A call that names one result is hung on the nearest call
    before it that names none or several, by doubling; calls that name several are settled in rounds.
    """
    counted = saved(edges.groupBy("conv_id", F.col("after").alias("call_id")).agg(F.count("*").alias("names"), F.min("before").alias("before")))
    single = counted.where("names = 1").select("conv_id", F.col("call_id").alias("at"), F.col("before").alias("to"))
    open_ = single.select("conv_id", F.col("at").alias("to"), F.lit(True).alias("open"))
    hung = saved(single.join(open_, ["conv_id", "to"], "left").select("conv_id", "at", "to", F.lit(1).cast("long").alias("dist"), F.coalesce("open", F.lit(False)).alias("open")))
    left = hung.where("open").count()
    while left:
        via = hung.select("conv_id", F.col("at").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("open").alias("again"))
        both = hung.join(via, ["conv_id", "to"], "left")
        step = F.col("open") & F.col("again").isNotNull()
        hung = saved(both.select("conv_id", "at", F.when(step, F.col("next")).otherwise(F.col("to")).alias("to"), F.when(step, F.col("dist") + F.col("more")).otherwise(F.col("dist")).alias("dist"), F.when(step, F.col("again")).otherwise(F.col("open")).alias("open")))
        before, left = left, hung.where("open").count()
        if left == before:
            break  # the distances of a chain have no gaps, so what is left goes round in circles
    hung = hung.where("not open")
    # Calls that name several: over their single ones to what those hang on. A depth that isn't known yet is null.
    many = counted.where("names > 1").select("conv_id", "call_id", "names")
    steps = edges.withColumnRenamed("after", "call_id").join(many, ["conv_id", "call_id"], "left_semi").withColumnRenamed("before", "at")
    chained = counted.where("names = 1").select("conv_id", F.col("call_id").alias("at"), F.lit(True).alias("chained"))
    steps = steps.join(chained, ["conv_id", "at"], "left").join(hung.select("conv_id", "at", "to", "dist"), ["conv_id", "at"], "left")
    steps = steps.select("conv_id", "call_id", F.when(F.col("chained"), F.col("to")).otherwise(F.col("at")).alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
    steps = saved(steps.join(many.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("several")), ["conv_id", "to"], "left"))  # a null ``to`` hangs on a circle and stays open
    settled = None
    while True:
        known = steps if settled is None else steps.join(settled.select("conv_id", F.col("call_id").alias("to"), "depth"), ["conv_id", "to"], "left")
        depth = F.when(F.col("to").isNull(), F.lit(None)).when(F.col("several").isNull(), F.lit(0)).otherwise(F.lit(None).cast("long") if settled is None else F.col("depth"))
        done = known.withColumn("reach", depth + F.col("dist")).groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("reach").alias("ready"), F.max("reach").alias("depth")).where("n = ready")
        new = saved(done.select("conv_id", "call_id", F.col("depth").cast("long").alias("depth")))
        grown = new.count()
        if settled is not None and grown == last or settled is None and not grown:
            break
        settled, last = new, grown
    none = counted.select("conv_id", "call_id", F.lit(0).cast("long").alias("depth")).limit(0)
    settled = none if settled is None else settled
    ends = hung.join(many.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("several")), ["conv_id", "to"], "left").join(settled.select("conv_id", F.col("call_id").alias("to"), "depth"), ["conv_id", "to"], "left")
    own = ends.where("several is null or depth is not null").select("conv_id", F.col("at").alias("call_id"), (F.coalesce("depth", F.lit(0)) + F.col("dist")).cast("long").alias("depth"))
    return own.unionByName(settled)


#: Objects with the one key $result in compact JSON; within a string the quotes would have backslashes.
REFERENCE = r'\{"[$]result":("(?:[^"\\]|\\.)*")\}'


def link(calls: DataFrame, results: DataFrame, others: DataFrame | None, tools: dict[str, Tool]) -> DataFrame:
    """One row for each call, result and other turn: ``conv_id, turn, place, kind, call_id, level, status, problems, json``."""
    refs = F.expr(f"from_json(concat('[', array_join(regexp_extract_all(to_json(try_parse_json(arguments)), {_text(REFERENCE)}, 1), ','), ']'), 'array<string>')")
    naming = calls.where("arguments like '%$result%' or arguments like '%\\\\\\\\u%'")  # a key may be written with escapes
    named = naming.select("conv_id", F.col("call_id").alias("after"), F.explode_outer(refs).alias("before")).where("before is not null").distinct()
    side = lambda df, name: df.where("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias(name))
    ids = saved(side(calls, "n_calls").join(side(results, "n_results"), ["conv_id", "call_id"], "full"))
    edges = saved(named.join(ids.where("n_calls > 0").select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"]).where("after is not null"))
    if not edges.isEmpty():
        chained = edges.select("conv_id", F.col("after").alias("call_id")).distinct()
        ids = ids.join(chained.withColumn("named", F.lit(True)), ["conv_id", "call_id"], "left").join(_depths(edges), ["conv_id", "call_id"], "left")
        ids = saved(ids.withColumn("depth", F.when(F.col("named") & F.col("depth").isNull(), F.lit(None)).otherwise(F.coalesce("depth", F.lit(0)))).drop("named"))
    else:
        ids = ids.withColumn("depth", F.lit(0).cast("long"))
    out = []
    for kind, rows in (("call", calls), ("result", results)):
        own, other = (F.coalesce(F.col(c), F.lit(0)) for c in (("n_calls", "n_results") if kind == "call" else ("n_results", "n_calls")))
        joined = rows.join(ids, ["conv_id", "call_id"], "left")
        status = F.when(own + other == 0, "no id").when(own > 1, "repeated id").when(other == 0, "no result" if kind == "call" else "no call").when(F.col("depth").isNull(), "circular").otherwise("linked")
        level = F.when((own + other == 0) | F.col("depth").isNull(), F.lit(None).cast("long")).otherwise(2 * F.col("depth") + (0 if kind == "call" else 1))
        wrong = problems("tool", "arguments", tools) if kind == "call" else F.expr("cast(array() as array<string>)")
        fields = {"arguments": F.expr("try_parse_json(arguments)"), "id": F.col("call_id"), "name": F.col("tool"), "type": F.lit("call")} if kind == "call" else {"content": F.col("content"), "type": F.lit("result"), "tool_call_id": F.col("call_id")}
        out.append(joined.select("conv_id", F.col("turn").cast("long"), F.col("place").cast("long"), F.lit(kind).alias("kind"), "call_id", level.alias("level"), status.alias("status"), wrong.alias("problems"), _written(fields).alias("json")))
    if others is not None:
        rest = _written({"content": F.col("content"), "role": F.col("role"), "type": F.lit("message")})
        out.append(others.select("conv_id", F.col("turn").cast("long"), F.lit(0).cast("long").alias("place"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("level"), F.lit("message").alias("status"), F.expr("cast(array() as array<string>)").alias("problems"), rest.alias("json")))
    made = reduce(DataFrame.unionByName, out)
    return made.withColumn("json", _json("json"))


def _written(fields: dict[str, Column]) -> Column:
    """Compact JSON of an object, its keys sorted; null fields are left out."""
    return F.to_json(F.struct(*(value.alias(key) for key, value in sorted(fields.items()))))


def digest(linked: DataFrame) -> DataFrame:
    return linked.select("conv_id", "turn", "place", "kind", "call_id", F.col("level").cast("long"), "status", F.array_join("problems", ",").alias("problems"), F.sha2("json", 256).alias("json_sha256"))


_OBJECT = "'{' || array_to_string(list_transform(list_sort(list_filter([%s], lambda x: x.v IS NOT NULL)), lambda x: to_json(x.k) || ':' || x.v), ',') || '}'"


def _object(**fields: str) -> str:
    """SQL: a JSON object whose keys are sorted by the SQL."""
    return _OBJECT % ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in fields.items())


#: The same rows for ``exchanges`` of the table conversations: ways are walked one call at a time.
ORACLE_SQL = f"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, coalesce(((7 * conv_id + turn) % 16 + 16) % 16, 0) AS k, coalesce(conv_id % 10 = 3 AND turn = 1, false) AS back FROM conversations),
made AS (
  SELECT *, 'call_' || turn AS call_id, CASE WHEN k = 5 THEN 'ask' ELSE 'reply' END AS tool, CASE WHEN k <> 2 THEN to_json(text) END AS j_text, CASE WHEN k = 3 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END AS j_turn, CASE WHEN k = 4 THEN '[100,-0.5]' END AS j_extra,
         CASE WHEN k = 1 THEN [] WHEN back THEN ['call_3'] WHEN turn >= 2 AND k = 6 THEN ['call_' || (turn - 2), 'call_' || (turn - 4)] WHEN turn >= 2 THEN ['call_' || (turn - 2)] ELSE [] END AS refs
  FROM turns WHERE role = 'user'),
calls AS (
  SELECT *, list_transform(refs, lambda r: {_object(**{"$result": "to_json(r)"})}) AS j_refs FROM made),
written AS (
  SELECT *, CASE WHEN k = 1 THEN '[1]' ELSE {_object(text="j_text", turn="j_turn", extra="j_extra", after="CASE WHEN len(refs) = 0 THEN NULL WHEN k = 6 AND NOT back THEN '[' || array_to_string(j_refs, ',') || ']' ELSE j_refs[1] END")} END AS j_args FROM calls),
messages AS (
  SELECT conv_id, turn, 'call' AS kind, call_id, {_object(name="to_json(tool)", id="to_json(call_id)", type="to_json('call')", arguments="j_args")} AS json,
         CASE WHEN k = 1 THEN 'arguments:no object' WHEN k = 5 THEN 'tool:unknown' ELSE array_to_string(list_sort(list_filter([CASE WHEN j_text IS NULL THEN 'missing:text' END, CASE WHEN j_turn IS NULL THEN 'missing:turn' END, CASE WHEN k = 3 AND j_turn IS NOT NULL THEN 'type:turn' END, CASE WHEN k = 6 AND NOT back AND len(refs) > 0 THEN 'type:after' END, CASE WHEN k = 4 THEN 'unknown:extra' END], lambda x: x IS NOT NULL)), ',') END AS problems
  FROM written
  UNION ALL
  SELECT conv_id, turn, 'result', 'call_' || (turn - 1), {_object(tool_call_id="to_json('call_' || (turn - 1))", type="to_json('result')", content="to_json(text)")}, ''
  FROM turns WHERE role = 'assistant'),
edges AS (SELECT DISTINCT c.conv_id, c.call_id AS after, b.call_id AS before FROM (SELECT conv_id, call_id, unnest(refs) AS ref FROM calls) c JOIN calls b ON c.conv_id = b.conv_id AND c.ref = b.call_id),
reach AS (SELECT conv_id, after, before FROM edges UNION SELECT r.conv_id, r.after, e.before FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.after = r.before),
circular AS (SELECT DISTINCT r.conv_id, r.after AS call_id FROM reach r WHERE EXISTS (SELECT 1 FROM reach c WHERE c.conv_id = r.conv_id AND c.after = c.before AND (c.after = r.before OR c.after = r.after))),
ways AS (SELECT conv_id, after, before, 1 AS d FROM edges e WHERE NOT EXISTS (SELECT 1 FROM circular c WHERE c.conv_id = e.conv_id AND c.call_id = e.after) UNION SELECT w.conv_id, w.after, e.before, w.d + 1 FROM ways w JOIN edges e ON e.conv_id = w.conv_id AND e.after = w.before),
depths AS (SELECT conv_id, after AS call_id, max(d) AS d FROM ways GROUP BY 1, 2),
counted AS (
  SELECT *, CASE WHEN conv_id IS NULL OR call_id IS NULL THEN 0 ELSE count(*) FILTER (kind = 'call') OVER id END AS n_calls, CASE WHEN conv_id IS NULL OR call_id IS NULL THEN 0 ELSE count(*) FILTER (kind = 'result') OVER id END AS n_results
  FROM messages WINDOW id AS (PARTITION BY conv_id, call_id))
SELECT m.conv_id, m.turn, CAST(0 AS BIGINT) AS place, kind, m.call_id,
       CASE WHEN n_calls + n_results = 0 OR c.call_id IS NOT NULL THEN NULL ELSE CAST(2 * coalesce(d, 0) + CASE kind WHEN 'call' THEN 0 ELSE 1 END AS BIGINT) END AS level,
       CASE WHEN n_calls + n_results = 0 THEN 'no id' WHEN kind = 'call' AND n_calls > 1 OR kind = 'result' AND n_results > 1 THEN 'repeated id' WHEN kind = 'call' AND n_results = 0 THEN 'no result' WHEN kind = 'result' AND n_calls = 0 THEN 'no call' WHEN c.call_id IS NOT NULL THEN 'circular' ELSE 'linked' END AS status,
       problems, sha256(json) AS json_sha256
FROM counted m LEFT JOIN circular c ON c.conv_id = m.conv_id AND c.call_id = m.call_id LEFT JOIN depths p ON p.conv_id = m.conv_id AND p.call_id = m.call_id
UNION ALL
SELECT conv_id, turn, 0, 'message', NULL, NULL, 'message', '', sha256({_object(role="to_json(role)", type="to_json('message')", content="to_json(text)")})
FROM turns WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""
