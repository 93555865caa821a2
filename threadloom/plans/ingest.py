"""Registered ingest queries: imports, captures, exchange logs and dialect normalization.

The raw exports are built from the conversations table in every dialect and then normalized again; the oracle is the
table itself.  Shapes the table has no source for (tool calls, images, fences, trees, responses) are woven around its
texts, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.plans.registry import query
from threadloom.plans.reports import LOCAL, local
from threadloom.plans.summaries import sql_strip
from threadloom.session import saved, shared_folder
from threadloom.sources import dialects as D
from threadloom.sources import imports as I
from threadloom.sources.testviews import USER, load, table

# What every plain dialect must give back: system turns gone, the rest renumbered and trimmed.
ROUND_TRIP = (
    f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn, role,"
    f" {sql_strip('full_text')} AS full_text FROM v_messages WHERE role <> 'system'"
)
SYSTEM = (
    "SELECT c.conv_id, {fmt} AS source_format, {llm} AS source_llm, coalesce(s.t, '') AS system_instruction, coalesce(n,"
    " 0) AS message_count FROM (SELECT DISTINCT conv_id FROM v_messages) c LEFT JOIN (SELECT conv_id, arg_max(full_text,"
    " turn) AS t FROM v_messages WHERE role = 'system' GROUP BY 1) s USING (conv_id) LEFT JOIN (SELECT conv_id, count(*)"
    " AS n FROM v_messages WHERE role <> 'system' GROUP BY 1) m USING (conv_id)"
)


PART = 5000
PARTS = 1_000_000


def turns(spark, sf_dir, fields):
    """One row per export with its turns in order.

    An export holds at most PART turns (a capture may not hold more); a longer conversation arrives as several exports, so
    no conversation, however long, has to fit into one row.  The key of an export is conv_id * PARTS + part.
    """
    m = load(spark, sf_dir, "v_messages")
    key = (F.col("conv_id") * PARTS + F.floor(F.col("turn") / PART)).cast("bigint").alias("conv_id")
    listed = F.array_sort(F.collect_list(F.struct("turn", *fields)))
    return m.groupBy(key).agg(listed.alias("t"))


def whole(messages):
    """Messages of exports as messages of conversations: turns go on counting from one part to the next."""
    conv, part = F.expr(f"conv_id div {PARTS}"), F.col("conv_id") % PARTS
    split = messages.withColumns({"part": part, "conv_id": conv})
    sizes = split.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    joined = split.join(offsets, ["conv_id", "part"])
    return joined.withColumn("turn", (F.col("turn") + F.col("offset")).cast("int")).drop("part", "offset")


def whole_heads(heads):
    """Conversation heads over all parts: counts add up, the last system instruction holds."""
    conv, part = F.expr(f"conv_id div {PARTS}"), F.col("conv_id") % PARTS
    split = heads.withColumns({"part": part, "conv_id": conv})
    said = F.when(F.col("system_instruction") != "", F.col("part"))
    return split.groupBy("conv_id", "source_format", "source_llm").agg(
        F.coalesce(F.max_by("system_instruction", said), F.lit("")).alias("system_instruction"),
        F.sum("message_count").alias("message_count"),
    )


def raw_openai(spark, sf_dir):
    t = turns(spark, sf_dir, [F.col("role"), F.col("full_text").alias("content")])
    return t.select("conv_id", F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("raw"))


def raw_claude(spark, sf_dir):
    t = turns(spark, sf_dir, [F.col("role"), F.col("full_text").alias("content")])
    spoken = F.filter("t", lambda x: x["role"] != "system")
    system = F.element_at(F.filter("t", lambda x: x["role"] == "system"), -1)
    parts = lambda x: F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text")))
    doc = F.struct(
        F.lit("claude-x").alias("model"),
        F.when(F.exists("t", lambda x: x["role"] == "system"), F.try_element_at(F.filter("t", lambda x: x["role"] == "system"), F.lit(-1))["content"]).alias("system"),
        F.transform(spoken, lambda x: F.struct(x["role"].alias("role"), parts(x).alias("content"))).alias("messages"),
    )
    del system
    return t.select("conv_id", F.to_json(doc).alias("raw"))


def raw_gemini(spark, sf_dir):
    t = turns(spark, sf_dir, [F.col("role"), F.col("full_text").alias("content")])
    spoken = F.filter("t", lambda x: x["role"] != "system")
    role = lambda x: F.when(x["role"] == "assistant", "model").otherwise(x["role"])
    part = lambda text: F.array(F.struct(text.alias("text")))
    last = F.try_element_at(F.filter("t", lambda x: x["role"] == "system"), F.lit(-1))["content"]
    doc = F.struct(
        F.transform(spoken, lambda x: F.struct(role(x).alias("role"), part(x["content"]).alias("parts"))).alias("contents"),
        F.when(last.isNotNull(), F.struct(part(last).alias("parts"))).alias("systemInstruction"),
    )
    return t.select("conv_id", F.to_json(doc).alias("raw"))


def raw_text(spark, sf_dir):
    t = turns(spark, sf_dir, [F.col("role"), F.col("full_text").alias("content")])
    line = F.transform("t", lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), x["content"]))
    return t.select("conv_id", F.array_join(line, "\n---\n").alias("raw"))


def messages_of(exports, dialect):
    _, m = D.normalize(exports, (dialect,))
    return whole(m.select("conv_id", "turn", "role", "full_text"))


def heads_of(exports, dialect):
    c, m = D.normalize(exports, (dialect,))
    profiled = D.profiles(c, m).select("conv_id", "source_format", "source_llm", "system_instruction", "message_count")
    return whole_heads(profiled)


@query(
    "format_detection", "N1 N20",
    " UNION ALL ".join(
        f"SELECT DISTINCT conv_id, '{f}' AS source_format, '{p}' AS source_llm FROM v_messages"
        for f, p in (("openai", "openai"), ("claude", "anthropic"), ("gemini", "google"), ("generic", "unknown"))
    ),
)
def format_detection(spark, sf_dir):
    out = None
    for make in (raw_openai, raw_claude, raw_gemini, raw_text):
        part = D.detected(D.parsed(make(spark, sf_dir)))
        out = part if out is None else out.unionByName(part)
    labelled = out.select(F.expr(f"conv_id div {PARTS}").alias("conv_id"), "source_format", D.provider("source_format").alias("source_llm"))
    return labelled.distinct()


for _name, _ids, _make, _dialect in (
    ("openai_messages", "N2 N3 N17", raw_openai, "openai"),
    ("claude_messages", "N8 N9", raw_claude, "claude"),
    ("gemini_messages", "N11 N12 N17", raw_gemini, "gemini"),
    ("transcript_messages", "N14 N15", raw_text, "text"),
):
    query(_name, _ids, ROUND_TRIP)(lambda spark, sf_dir, make=_make, d=_dialect: messages_of(make(spark, sf_dir), d))

for _name, _ids, _make, _dialect, _fmt, _llm in (
    ("openai_conversations", "N2 N19", raw_openai, "openai", "openai", "openai"),
    ("claude_conversations", "N8 N19", raw_claude, "claude", "claude", "anthropic"),
    ("gemini_conversations", "N11 N19", raw_gemini, "gemini", "gemini", "google"),
    ("transcript_conversations", "N15 N19", raw_text, "text", "generic", "unknown"),
):
    _sql = SYSTEM.format(fmt=f"'{_fmt}'", llm=f"'{_llm}'")
    if _dialect == "text":
        _sql = _sql.replace("arg_max(full_text, turn)", f"arg_max({sql_strip('full_text')}, turn)")
    query(_name, _ids, _sql)(lambda spark, sf_dir, make=_make, d=_dialect: heads_of(make(spark, sf_dir), d))


# -- shapes around the table's texts ------------------------------------------------------------------------------------------


def spoken(spark, sf_dir):
    return load(spark, sf_dir, "v_messages").where("role <> 'system'").withColumn("id", F.expr("concat_ws(':', conv_id, turn)"))


TOOL_BLOCKS = """
SELECT conv_id || ':' || turn AS conv_id, b.ix AS block_ix, b.kind AS type, b.txt AS text, b.tool AS tool_name, b.call AS
    tool_call_id FROM (SELECT *, unnest([
    {{'ix': 0, 'kind': 'text', 'txt': {strip}, 'tool': '', 'call': ''}},
    {{'ix': 1, 'kind': 'tool_call', 'txt': '{{"n":' || turn || '}}', 'tool': 'lookup', 'call': 'c' || turn}},
    {{'ix': 2, 'kind': 'tool_call', 'txt': '{{}}', 'tool': 'legacy', 'call': ''}}]) AS b FROM v_messages WHERE role <>
    'system')
UNION ALL SELECT conv_id || ':' || turn, b.ix + 3, b.kind, b.txt, b.tool, b.call FROM (SELECT *, unnest([
    {{'ix': 0, 'kind': 'text', 'txt': {strip}, 'tool': '', 'call': ''}},
    {{'ix': 1, 'kind': 'tool_result', 'txt': full_text, 'tool': 'lookup', 'call': 'c' || turn}}]) AS b FROM v_messages WHERE
    role <> 'system')
"""


@query("openai_tool_calls", "N4", TOOL_BLOCKS.format(strip=sql_strip("full_text")))
def openai_tool_calls(spark, sf_dir):
    function = F.struct(
        F.lit("lookup").alias("name"), F.concat(F.lit('{"n":'), F.col("turn").cast("string"), F.lit("}")).alias("arguments")
    )
    call = F.concat(F.lit("c"), F.col("turn").cast("string"))
    asks = F.to_json(
        F.struct(
            F.lit("assistant").alias("role"),
            F.col("full_text").alias("content"),
            F.array(F.struct(call.alias("id"), function.alias("function"))).alias("tool_calls"),
            F.struct(F.lit("legacy").alias("name")).alias("function_call"),
        )
    )
    result = F.to_json(
        F.struct(
            F.lit("tool").alias("role"), F.col("full_text").alias("content"), F.lit("lookup").alias("name"),
            call.alias("tool_call_id"),
        )
    )
    exports = spoken(spark, sf_dir).select(
        F.col("id").alias("conv_id"), F.concat(F.lit("["), asks, F.lit(","), result, F.lit("]")).alias("raw")
    )
    _, m = D.normalize(exports, ("openai",))
    rows = D.block_rows(m)
    return rows.select(
        "conv_id", (F.col("block_ix") + F.when(F.col("turn") == 1, 3).otherwise(0)).alias("block_ix"), "type", "text",
        "tool_name", "tool_call_id",
    )


@query(
    "openai_content_parts", "N3",
    f"""
SELECT conv_id || ':' || turn AS conv_id, b.ix AS block_ix, b.kind AS type, b.txt AS text, b.url AS url, b.alt AS alt_text
FROM (SELECT *, unnest([{{'ix': 0, 'kind': 'text', 'txt': {sql_strip('full_text')}, 'url': '', 'alt': ''}},
    {{'ix': 1, 'kind': 'image', 'txt': '', 'url': 'https://img.example.com/' || turn, 'alt': 'User provided image'}},
    {{'ix': 2, 'kind': 'text', 'txt': '[Audio input]', 'url': '', 'alt': ''}}]) AS b FROM v_messages WHERE role <> 'system')
""",
)
def openai_content_parts(spark, sf_dir):
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.col("full_text").alias("text")))
    url = F.concat(F.lit('{"type":"image_url","image_url":{"url":"https://img.example.com/'), F.col("turn").cast("string"), F.lit('"}}'))
    raw = F.concat(
        F.lit('[{"role":"user","content":['), text, F.lit(","), url, F.lit(',{"type":"input_audio"},{"type":"other"}]}]')
    )
    _, m = D.normalize(spoken(spark, sf_dir).select(F.col("id").alias("conv_id"), raw.alias("raw")), ("openai",))
    return D.block_rows(m).select("conv_id", "block_ix", "type", "text", "url", "alt_text")


RESPONSES = f"""
SELECT conv_id || ':' || turn AS conv_id, '{{fmt}}' AS source_format, '{{model}}' AS source_model, turn + {{extra}} AS
    total_tokens, 'assistant' AS role, {sql_strip('full_text')} AS full_text FROM v_messages WHERE role <> 'system'
"""


def responses(spark, sf_dir, raw, dialect):
    c, m = D.normalize(spoken(spark, sf_dir).select(F.col("id").alias("conv_id"), raw.alias("raw")), (dialect,))
    return c.join(m.select("conv_id", "role", "full_text"), "conv_id").select(
        "conv_id", "source_format", "source_model", "total_tokens", "role", "full_text"
    )


def quoted():
    """The message text as a JSON string literal."""
    wrapped = F.to_json(F.array("full_text"))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


@query("openai_responses", "N5", RESPONSES.format(fmt="openai", model="gpt-x", extra=7))
def openai_responses(spark, sf_dir):
    raw = F.concat(
        F.lit('{"id":"r","model":"gpt-x","choices":[{"message":{"role":"assistant","content":'), quoted(),
        F.lit('}},{"other":1}],"usage":{"total_tokens":'), (F.col("turn") + 7).cast("string"), F.lit("}}"),
    )
    return responses(spark, sf_dir, raw, "openai")


@query("claude_responses", "N10", RESPONSES.format(fmt="claude", model="claude-x", extra=3))
def claude_responses(spark, sf_dir):
    # Without a role next to the content; with one the export is an OpenAI message by priority.
    raw = F.concat(
        F.lit('{"type":"message","model":"claude-x","content":[{"type":"text","text":'), quoted(),
        F.lit('}],"usage":{"input_tokens":'), F.col("turn").cast("string"), F.lit(',"output_tokens":3}}'),
    )
    return responses(spark, sf_dir, raw, "claude")


@query("gemini_responses", "N13", RESPONSES.format(fmt="gemini", model="gem-x", extra=4))
def gemini_responses(spark, sf_dir):
    raw = F.concat(
        F.lit('{"modelVersion":"gem-x","candidates":[{"content":{"role":"model","parts":[{"text":'), quoted(),
        F.lit('}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":'), F.col("turn").cast("string"),
        F.lit(',"candidatesTokenCount":4}}'),
    )
    return responses(spark, sf_dir, raw, "gemini")


@query(
    "claude_typed_blocks", "N9",
    f"""
SELECT conv_id || ':' || turn AS conv_id, b.ix AS block_ix, b.kind AS type, b.txt AS text, b.url AS url, b.tool AS tool_name,
    b.call AS tool_call_id FROM (SELECT *, unnest([
    {{'ix': 0, 'kind': 'thinking', 'txt': full_text, 'url': '', 'tool': '', 'call': ''}},
    {{'ix': 1, 'kind': 'text', 'txt': {sql_strip('full_text')}, 'url': '', 'tool': '', 'call': ''}},
    {{'ix': 2, 'kind': 'tool_call', 'txt': '{{"n":' || turn || '}}', 'url': '', 'tool': 'find', 'call': 't' || turn}},
    {{'ix': 3, 'kind': 'error', 'txt': full_text || chr(10) || 'end', 'url': '', 'tool': '', 'call': 't' || turn}},
    {{'ix': 4, 'kind': 'image', 'txt': '', 'url': 'data:image/png;base64,[embedded]', 'tool': '', 'call': ''}}]) AS b FROM
    v_messages WHERE role <> 'system')
""",
)
def claude_typed_blocks(spark, sf_dir):
    n = F.col("turn").cast("string")
    raw = F.concat(
        F.lit('{"system":"","messages":[{"role":"assistant","content":[{"type":"thinking","thinking":'), quoted(),
        F.lit('},{"type":"text","text":'), quoted(), F.lit('},{"type":"tool_use","id":"t'), n,
        F.lit('","name":"find","input":{"n":'), n, F.lit('}},{"type":"tool_result","tool_use_id":"t'), n,
        F.lit('","is_error":true,"content":[{"type":"text","text":'), quoted(),
        F.lit('},"end"]},{"type":"image","source":{"type":"base64","media_type":"image/png","data":"x"}}]}]}'),
    )
    _, m = D.normalize(spoken(spark, sf_dir).select(F.col("id").alias("conv_id"), raw.alias("raw")), ("claude",))
    return D.block_rows(m).select("conv_id", "block_ix", "type", "text", "url", "tool_name", "tool_call_id")


@query(
    "gemini_typed_parts", "N12",
    f"""
SELECT conv_id || ':' || turn AS conv_id, b.ix AS block_ix, b.kind AS type, b.txt AS text, b.lang AS language, b.tool AS
    tool_name FROM (SELECT *, unnest([
    {{'ix': 0, 'kind': 'text', 'txt': {sql_strip('full_text')}, 'lang': '', 'tool': ''}},
    {{'ix': 1, 'kind': 'file', 'txt': '', 'lang': '', 'tool': ''}},
    {{'ix': 2, 'kind': 'tool_call', 'txt': '{{"n":' || turn || '}}', 'lang': '', 'tool': 'find'}},
    {{'ix': 3, 'kind': 'tool_result', 'txt': '{{"ok":true}}', 'lang': '', 'tool': 'find'}},
    {{'ix': 4, 'kind': 'code', 'txt': full_text, 'lang': 'python', 'tool': ''}},
    {{'ix': 5, 'kind': 'tool_result', 'txt': full_text, 'lang': '', 'tool': 'code_execution'}}]) AS b FROM v_messages WHERE
    role <> 'system')
""",
)
def gemini_typed_parts(spark, sf_dir):
    n = F.col("turn").cast("string")
    raw = F.concat(
        F.lit('{"contents":[{"role":"model","parts":[{"text":'), quoted(),
        F.lit('},{"inlineData":{"mimeType":"application/pdf"}},{"functionCall":{"name":"find","args":{"n":'), n,
        F.lit('}}},{"functionResponse":{"name":"find","response":{"ok":true}}},{"executableCode":{"language":"PYTHON","code":'),
        quoted(), F.lit('}},{"codeExecutionResult":{"outcome":"OK","output":'), quoted(), F.lit("}}]}]}"),
    )
    _, m = D.normalize(spoken(spark, sf_dir).select(F.col("id").alias("conv_id"), raw.alias("raw")), ("gemini",))
    return D.block_rows(m).select("conv_id", "block_ix", "type", "text", "language", "tool_name")


@query(
    "export_tree", "N6 N7",
    f"""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn, role,
    {sql_strip('full_text')} AS full_text, 1700000000 + turn AS epoch FROM v_messages WHERE role <> 'system'
""",
)
def export_tree(spark, sf_dir):
    """Every conversation as a tree: the turns form the last-child path, and every node has a dead first branch."""
    nodes = turns(spark, sf_dir, ["role", "full_text"])
    node = lambda name, body: F.concat(F.to_json(F.array(name)).substr(F.lit(2), F.length(name) + 2), F.lit(":"), body)

    def entry(x, i):
        name = F.concat(F.lit("n"), i.cast("string"))
        children = F.when(
            i + 1 < F.size("t"),
            F.concat(F.lit('["dead'), i.cast("string"), F.lit('","n'), (i + 1).cast("string"), F.lit('"]')),
        ).otherwise(F.lit("[]"))
        message = F.to_json(
            F.struct(
                F.struct(x["role"].alias("role")).alias("author"),
                F.struct(F.lit("text").alias("content_type"), F.array(x["full_text"]).alias("parts")).alias("content"),
                (x["turn"] + 1700000000).alias("create_time"),
            )
        )
        parent = F.when(i == 0, F.lit("null")).otherwise(F.concat(F.lit('"n'), (i - 1).cast("string"), F.lit('"')))
        body = F.concat(F.lit('{"message":'), message, F.lit(',"parent":'), parent, F.lit(',"children":'), children, F.lit("}"))
        dead = F.concat(F.lit('"dead'), i.cast("string"), F.lit('":{"message":null,"parent":"'), name, F.lit('","children":[]}'))
        return F.concat(node(name, body), F.lit(","), dead)

    raw = F.concat(F.lit('{"title":"x","mapping":{'), F.array_join(F.transform("t", entry), ","), F.lit("}}"))
    _, out = D.normalize(nodes.select("conv_id", raw.alias("raw")), ("export",))
    timed = out.select("conv_id", "turn", "role", "full_text", F.unix_seconds("ts").alias("epoch"))
    return whole(timed)


FENCED = (
    "first || chr(10) || '```python' || chr(10) || 'def f' || turn || '():' || chr(10) || '    pass' || chr(10) || '```' ||"
    " chr(10) || rest || chr(10) || '  ```' || chr(10) || 'open'"
)


def fenced(spark, sf_dir):
    m = spoken(spark, sf_dir)
    body = F.concat(
        F.col("full_text"), F.lit("\n```python\ndef f"), F.col("turn").cast("string"), F.lit("():\n    pass\n```\n"),
        F.reverse("full_text"), F.lit("\n  ```\nopen"),
    )
    raw = F.to_json(F.array(F.struct(F.lit("user").alias("role"), body.alias("content"))))
    return D.normalize(m.select(F.col("id").alias("conv_id"), raw.alias("raw")), ("openai",))


@query(
    "fenced_blocks", "N16",
    f"""
SELECT conv_id || ':' || turn AS conv_id, b.ix AS block_ix, b.kind AS type, b.txt AS text, b.lang AS language FROM (SELECT *,
    unnest([{{'ix': 0, 'kind': 'text', 'txt': {sql_strip('full_text')}, 'lang': ''}},
    {{'ix': 1, 'kind': 'code', 'txt': 'def f' || turn || '():' || chr(10) || '    pass', 'lang': 'python'}},
    {{'ix': 2, 'kind': 'text', 'txt': {sql_strip('reverse(full_text)')}, 'lang': ''}},
    {{'ix': 3, 'kind': 'code', 'txt': 'open', 'lang': ''}}]) AS b FROM v_messages WHERE role <> 'system')
""",
)
def fenced_blocks(spark, sf_dir):
    return D.block_rows(fenced(spark, sf_dir)[1]).select("conv_id", "block_ix", "type", "text", "language")


@query(
    "block_rendering", "N18",
    f"""
SELECT conv_id || ':' || turn AS conv_id, {sql_strip('full_text')} || chr(10) || chr(10) || '```python' || chr(10) || 'def f'
    || turn || '():' || chr(10) || '    pass' || chr(10) || '```' || chr(10) || chr(10) || {sql_strip('reverse(full_text)')}
    || chr(10) || chr(10) || '```' || chr(10) || 'open' || chr(10) || '```' AS full_text FROM v_messages WHERE role <>
    'system'
""",
)
def block_rendering(spark, sf_dir):
    return fenced(spark, sf_dir)[1].select("conv_id", "full_text")


PROFILES = f"""
WITH x AS (SELECT *, {sql_strip('full_text')} AS body, CASE (conv_id + turn) % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' END AS lang
    FROM v_messages WHERE role <> 'system'),
y AS (SELECT *, body || CASE WHEN lang IS NULL THEN '' ELSE CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) END || '```' || lang || chr(10)
    || 'run ' || turn || chr(10) || '```' END AS shown FROM x),
s AS (SELECT conv_id, arg_max(full_text, turn) AS t FROM v_messages WHERE role = 'system' GROUP BY 1)
SELECT c.conv_id, coalesce(n, 0) AS message_count, CAST(coalesce(u, 0) AS BIGINT) AS user_messages, CAST(coalesce(a, 0) AS BIGINT) AS
    assistant_messages, CAST(0 AS BIGINT) AS other_messages, coalesce(code, FALSE) AS has_code, FALSE AS has_tool_usage,
    coalesce(languages, '') AS languages, CAST(coalesce(chars, 0) AS BIGINT) AS text_chars, md5(concat_ws(chr(10) || chr(10), nullif(t, ''),
    texts)) AS text_md5 FROM (SELECT DISTINCT conv_id FROM v_messages) c LEFT JOIN s USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n,
    count_if(role = 'user') AS u, count_if(role = 'assistant') AS a, bool_or(lang IS NOT NULL) AS code, string_agg(DISTINCT lang, ',' ORDER BY
    lang) AS languages, sum(length(shown)) AS chars, string_agg(nullif(shown, ''), chr(10) || chr(10) ORDER BY turn) AS texts FROM y GROUP BY
    1) USING (conv_id)
"""


@query("conversation_profiles", "N19", PROFILES)
def conversation_profiles(spark, sf_dir):
    """Whole conversations with a code block in two of five messages."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    fence = lambda lang: F.concat(F.lit(f"\n```{lang}\nrun "), F.col("turn").cast("string"), F.lit("\n```"))
    coded = F.concat("full_text", F.when(kind == 0, fence("python")).when(kind == 1, fence("sql")).otherwise(""))
    content = F.when(F.col("role") == "system", F.col("full_text")).otherwise(coded)
    listed = turns(spark, sf_dir, [F.col("role"), content.alias("content")])
    raw = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    c, m = D.normalize(listed.select("conv_id", raw.alias("raw")), ("openai",))
    m = saved(whole(m.select("conv_id", "turn", "role", "blocks", "full_text")), "whole-messages")
    heads = c.select("conv_id", "source_format", "source_llm", "system_instruction", F.lit(0).alias("message_count"))
    c = whole_heads(heads).drop("message_count")
    profiled = D.profiles(c, m).join(D.all_text(c, m), "conv_id")
    return profiled.select(
        "conv_id", "message_count", "user_messages", "assistant_messages", "other_messages",
        "has_code", "has_tool_usage", F.array_join("languages_used", ",").alias("languages"), "text_chars", F.md5("all_text").alias("text_md5"),
    )


# -- imports -----------------------------------------------------------------------------------------------------------------


@query(
    "text_import", "S1",
    """
SELECT doc_id, octet_length(encode(raw)) AS size_bytes, CASE WHEN doc_id % 3 = 1 THEN 'text_json' ELSE 'text_plain' END AS
    kind FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '  [' || to_json(text) || ']' ELSE '{broken ' ||
    text END AS raw FROM documents)
""",
)
def text_import(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('  ', to_json(array(text))) ELSE concat('{broken ', text)"
        " END AS raw",
    )
    return I.import_texts(docs).select("doc_id", F.col("size_bytes").cast("bigint").alias("size_bytes"), "kind")


@query(
    "json_import", "S2",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_import(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("raw"))
    return I.import_json(lines).select("event_id", F.variant_get("doc", "$.k", "bigint").alias("k"))


@query(
    "file_import", "S3",
    """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'file_text' WHEN 1 THEN 'file_json' WHEN 2 THEN 'unsupported' ELSE 'file_text' END
    AS outcome, CASE WHEN doc_id % 4 <> 2 THEN md5(text) END AS text_md5 FROM documents
""",
)
def file_import(spark, sf_dir):
    """Documents as files: UTF-8 text, JSON, an unknown type, and Latin-1 bytes; the decoded text is compared."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(
        F.concat(
            F.lit("in/"), F.col("doc_id").cast("string"), F.expr("element_at(array('/d.md', '/d.json', '/d.exe', '/d'), CAST(doc_id % 4 + 1 AS INT))")
        ).alias("path"),
        F.when(F.expr("doc_id % 4 = 1"), F.to_json(F.array("text")).cast("binary"))
        .when(F.expr("doc_id % 4 = 3 AND text RLIKE '^[\\x00-\\u00FF]*$'"), F.encode("text", "ISO-8859-1"))
        .otherwise(F.col("text").cast("binary"))
        .alias("content"),
    )
    accepted, rejected = I.import_files(files)
    inner = F.when(F.col("kind") == "file_json", F.variant_get("doc", "$[0]", "string")).otherwise(F.col("raw"))
    both = accepted.select("path", F.col("kind").alias("outcome"), F.md5(inner.cast("binary")).alias("text_md5")).unionByName(
        rejected.select("path", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("text_md5"))
    )
    return both.select(F.split_part("path", F.lit("/"), F.lit(2)).cast("bigint").alias("doc_id"), "outcome", "text_md5")


@query(
    "folder_import", "S1 S2 S3",
    f"""
SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'file_text' WHEN 1 THEN 'file_json' ELSE 'unsupported' END AS outcome, CASE WHEN
    user_id % 3 = 0 THEN CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) END AS size_bytes, CASE WHEN user_id % 3 < 2 THEN
    md5(string_agg(text || chr(10), '' ORDER BY doc_id)) END AS text_md5 FROM (SELECT *, {USER} AS user_id FROM documents)
    GROUP BY user_id
""",
)
def folder_import(spark, sf_dir):
    """The documents of each user as one real file in a tree of folders, found again by a recursive scan."""
    root, target = shared_folder(spark, "uploads"), shared_folder(spark, "imported")
    docs = table(spark, sf_dir, "documents").withColumn("user_id", F.expr(USER))
    placed = docs.repartition("user_id").sortWithinPartitions("user_id", "doc_id")
    placed.where("user_id % 3 = 0").select("user_id", "text").write.partitionBy("user_id").text(f"{root}/texts")
    whole = docs.where("user_id % 3 = 1").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    whole.select("user_id", F.col("t.text").alias("texts")).write.partitionBy("user_id").json(f"{root}/json")
    placed.where("user_id % 3 = 2").select("user_id", "text").write.partitionBy("user_id").csv(f"{root}/tables")
    accepted, rejected = I.import_folder(spark, root, target, "part-*")
    texts = F.variant_get(F.parse_json("raw"), "$.texts", "array<string>")
    inner = F.when(F.col("kind") == "file_json", F.concat(F.array_join(texts, "\n"), F.lit("\n"))).otherwise(F.col("raw"))
    both = accepted.select(
        "path", F.col("kind").alias("outcome"), F.when(F.col("kind") == "file_text", F.col("size_bytes")).alias("size_bytes"),
        F.md5(inner.cast("binary")).alias("text_md5"),
    ).unionByName(
        rejected.select(
            "path", F.col("reason").alias("outcome"), F.lit(None).cast("bigint").alias("size_bytes"),
            F.lit(None).cast("string").alias("text_md5"),
        )
    )
    return both.withColumn("user_id", F.regexp_extract("path", "/user_id=([0-9]+)/", 1).cast("bigint")).drop("path")


def captures(spark, sf_dir):
    t = turns(spark, sf_dir, [F.col("role"), F.col("full_text").alias("content")])
    conv = F.expr(f"conv_id div {PARTS}")
    platform = F.expr("element_at(array('chatgpt', 'claude', 'gemini', 'other'), CAST(conv_id div 1000000 % 4 + 1 AS INT))")
    doc = F.struct(
        platform.alias("platform"),
        F.lit("m").alias("model"),
        F.when(conv % 5 == 0, "").otherwise(F.concat(F.lit("Talk "), conv.cast("string"))).alias("title"),
        F.concat(F.lit("https://chat.example.com/c/"), conv.cast("string"), F.lit("?x=1#top")).alias("url"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit("").alias("model"))).alias("messages"),
        F.when(conv % 7 == 0, "not a time").otherwise("2024-05-06T07:08:09Z").alias("captured_at"),
    )
    return t.select(F.col("conv_id").alias("capture_id"), F.to_json(doc).alias("payload"))


@query(
    "capture_ingest", "S4",
    """
SELECT conv_id AS session_id, CASE WHEN conv_id % 5 = 0 THEN 'Captured Conversation' ELSE 'Talk ' || conv_id END AS title,
    CASE conv_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'other' END AS source_llm,
    CAST(count(*) AS INT) AS message_count, CAST(sum(length(full_text)) // 4 AS BIGINT) AS total_tokens,
    'auto-capture,' || CASE conv_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' ELSE 'other' END AS
    tags, CAST(CASE WHEN conv_id % 7 = 0 THEN 1717200000 ELSE 1714979289 END AS BIGINT) AS captured_at
FROM v_messages GROUP BY conv_id
""",
)
def capture_ingest(spark, sf_dir):
    """Whole conversations: a capture holds PART turns at most, the parts of a conversation become one session row."""
    parts = I.import_captures(captures(spark, sf_dir), now=F.timestamp_seconds(F.lit(1717200000)))
    out = I.join_captures(parts, F.expr(f"capture_id div {PARTS}"), F.col("capture_id") % PARTS)
    return out.select(
        "session_id", "title", "source_llm", "message_count", "total_tokens", F.array_join("tags", ",").alias("tags"),
        F.unix_seconds("captured_at").alias("captured_at"),
    )


def exchange_log(spark, sf_dir):
    """An API log around the messages: three providers and some entries that fit none."""
    m = spoken(spark, sf_dir)
    text, n = quoted(), F.col("turn").cast("string")
    kind = F.col("turn") % 4
    request = (
        F.when(kind <= 1, F.concat(F.lit('{"model":"m","system":"s","messages":[{"role":"user","content":'), text, F.lit("}]}")))
        .when(kind == 2, F.concat(F.lit('{"model":"m","contents":[{"role":"user","parts":[{"text":'), text, F.lit("}]}]}")))
        .otherwise(F.lit('{"prompt":"x"}'))
    )
    response = (
        F.when(kind == 0, F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":'), text,
                                   F.lit('}}],"usage":{"prompt_tokens":'), n, F.lit(',"completion_tokens":5}}')))
        .when(kind == 1, F.concat(F.lit('{"content":[{"type":"text","text":'), text,
                                  F.lit('},{"type":"tool_use","id":"a","name":"b","input":{}}],"usage":{"input_tokens":'), n,
                                  F.lit(',"output_tokens":5}}')))
        .when(kind == 2, F.concat(F.lit('{"candidates":[{"content":{"role":"model","parts":[{"text":'), text,
                                  F.lit('}]}}],"usageMetadata":{"promptTokenCount":'), n, F.lit(',"candidatesTokenCount":5}}')))
        .otherwise(F.lit("{}"))
    )
    return m.select(F.col("id").alias("exchange_id"), request.alias("request"), response.alias("response"))


@query(
    "exchange_provider", "S8",
    """
SELECT conv_id || ':' || turn AS exchange_id, CASE turn % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic'
    WHEN 2 THEN 'google' END AS provider FROM v_messages WHERE role <> 'system'
""",
)
def exchange_provider(spark, sf_dir):
    return I.exchanges(exchange_log(spark, sf_dir)).select("exchange_id", "provider")


@query(
    "exchange_rows", "S5 S6 S7",
    """
SELECT conv_id || ':' || turn AS exchange_id, CASE turn % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic'
    ELSE 'google' END AS provider, 'm' AS model, full_text AS response_content, turn AS request_tokens, CAST(5 AS BIGINT) AS
    response_tokens FROM v_messages WHERE role <> 'system' AND turn % 4 < 3
""",
)
def exchange_rows(spark, sf_dir):
    return I.exchange_rows(I.exchanges(exchange_log(spark, sf_dir))).drop("raw")


@query(
    "exchange_messages", "S5 S6 S7",
    f"""
SELECT conv_id || ':' || turn AS conv_id, CAST(i AS INT) AS turn, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
    {sql_strip('full_text')} || CASE WHEN i = 1 AND turn % 4 = 1 THEN chr(10) || chr(10) || '[Tool call:
    b({{}})]' ELSE '' END AS full_text FROM v_messages, (VALUES (0), (1)) r(i) WHERE role <> 'system' AND turn % 4 < 3
""".replace("[Tool call:\n    b", "[Tool call: b"),
)
def exchange_messages(spark, sf_dir):
    rows = I.exchange_rows(I.exchanges(exchange_log(spark, sf_dir)))
    _, m = D.normalize(rows.select(F.col("exchange_id").alias("conv_id"), "raw"), ("openai", "claude", "gemini"))
    return m.select("conv_id", "turn", "role", "full_text")


@query(
    "relational_scan", "S9",
    """
SELECT user_id, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(max(message_count) AS INT) AS
    longest FROM v_sessions WHERE deleted_at IS NULL GROUP BY 1
""",
)
def relational_scan(spark, sf_dir):
    """The sessions table in its declared schema, written and scanned back with pruned columns and a pushed filter."""
    root = shared_folder(spark, "tables")
    sessions = load(spark, sf_dir, "v_sessions").selectExpr(
        "CAST(session_id AS STRING) AS id", "CAST(user_id AS STRING) AS user_id", "CAST(team_id AS STRING) AS team_id",
        "'' AS title", "source_llm", "'' AS source_model", "CAST(message_count AS INT) AS message_count", "total_tokens",
        "'[]' AS tags", "'{}' AS metadata", "is_archived", "CAST(created_at AS TIMESTAMP) AS created_at",
        "CAST(created_at AS TIMESTAMP) AS updated_at", "CAST(deleted_at AS TIMESTAMP) AS deleted_at",
    )
    I.append_rows(sessions, f"{root}/sessions")
    live = I.read_table(spark, root, "sessions").where(F.col("deleted_at").isNull())
    return live.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(
        F.count("*").alias("sessions"), F.sum("total_tokens").alias("tokens"), F.max("message_count").alias("longest")
    )


# Per relational table: the view it comes from, its columns, what it is grouped by and what is summed.
RELATIONAL = {
    "users": ("v_users", ["user_id AS id", "tier AS subscription_tier"], "subscription_tier", None),
    "teams": ("v_teams", ["team_id AS id", "name", "is_active"], "is_active", None),
    "team_members": ("v_team_members", ["team_id", "user_id", "role"], "role", None),
    "sessions": (
        "v_sessions", ["session_id AS id", "user_id", "team_id", "source_llm", "message_count", "total_tokens", "is_archived", "deleted_at"],
        "source_llm", "total_tokens",
    ),
    "contexts": ("v_contexts", ["session_id", "version", "blob_size_bytes", "compression_ratio"], "version", "blob_size_bytes"),
    "api_keys": ("v_keys", ["key_id AS id", "user_id", "is_active", "created_at"], "is_active", None),
    "webhooks": ("v_webhooks", ["webhook_id AS id", "user_id", "events", "is_active", "created_at"], "events", None),
    "audit_logs": ("v_audit", ["id", "user_id", "action", "resource_type", "resource_id", "created_at"], "action", None),
    "shift_records": ("v_shifts", ["user_id", "source_llm", "target_llm", "source_tokens", "target_tokens"], "target_llm", "source_tokens"),
}


@query(
    "relational_tables", "S9",
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST({key.replace('subscription_tier', 'tier')} AS VARCHAR) AS category, count(*) AS entries,"
        f" {f'CAST(sum({amount}) AS BIGINT)' if amount else 'CAST(NULL AS BIGINT)'} AS amount FROM {view} GROUP BY 2"
        for name, (view, _, key, amount) in RELATIONAL.items()
    ),
    LOCAL,
)
def relational_tables(spark, sf_dir):
    """All nine tables in their declared schemas, written and scanned back; each scan reads two columns at most."""
    root = shared_folder(spark, "tables")
    out = None
    for name, (view, columns, key, amount) in RELATIONAL.items():
        source = local(spark, sf_dir, view) if view in LOCAL else load(spark, sf_dir, view)
        I.append_rows(I.conform(source.selectExpr(*columns), name), f"{root}/{name}")
        total = F.sum(amount).cast("bigint") if amount else F.lit(None).cast("bigint")
        part = I.read_table(spark, root, name).groupBy(F.col(key).cast("string").alias("category")).agg(
            F.count("*").alias("entries"), total.alias("amount")
        )
        part = part.select(F.lit(name).alias("table_name"), "category", "entries", "amount")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "audit_sink", "S11",
    "SELECT action, count(*) AS entries, count(DISTINCT id) AS distinct_ids FROM v_audit GROUP BY 1",
)
def audit_sink(spark, sf_dir):
    """Two appends, one per resource type, into the append-only log; nothing already written changes."""
    path = shared_folder(spark, "audit")
    audit = load(spark, sf_dir, "v_audit")
    for kind in ("session", "context"):
        I.append_rows(audit.where(F.col("resource_type") == kind), path, "action")
    written = spark.read.parquet(path)
    return written.groupBy("action").agg(F.count("*").alias("entries"), F.countDistinct("id").alias("distinct_ids"))
