"""Raw chat exports to canonical conversations, messages and blocks.

Input: exports(conv_id, raw STRING), one conversation per row in any of the known dialects.  A raw export is parsed once
into a VARIANT; messages, content parts and fenced code are arrays inside the row until the final explode.  So the plain
dialects need no shuffle at all: numbering and ordering come from the array positions.  Only the tree-shaped export
walks pointers, and does so over narrow (conv_id, node, next) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import chains, fixed, ordered
from threadloom.functions.barrier import once
from threadloom.functions import text as T

WS = r"[ \t\r\x0b\x0c]"
FENCE = rf"(?md)^{WS}*```[^\n]*$"
FENCE_LANGUAGE = rf"(?md)^{WS}*```{WS}*([^\s]*)[^\n]*$"
RULE_LINE = rf"(?md)^{WS}*(?:-{{3,}}|={{3,}}|\*{{3,}}){WS}*(?:\n|\z)"
MARKER_WORDS = [w for _, words in fixed.TURN_MARKER_WORDS for w in words.split()]
MARKER = rf"(?mdi)^({'|'.join(sorted(MARKER_WORDS, key=len, reverse=True))}){WS}*[:\-|>]{WS}*"

BLOCK = (
    "struct<type:string,text:string,language:string,url:string,alt_text:string,tool_name:string,tool_call_id:string>"
)
NO_BLOCKS = f"CAST(array() AS array<{BLOCK}>)"


# -- small SQL builders over variants ------------------------------------------------------------------------------------


def _s(path_source: str, path: str) -> str:
    """A string member, '' when missing or null."""
    return f"coalesce(try_variant_get({path_source}, '$.{path}', 'string'), '')"


def _v(source: str, path: str) -> str:
    return f"try_variant_get({source}, '$.{path}', 'variant')"


def _is(source: str, kind: str) -> str:
    """Is the variant an OBJECT, ARRAY or STRING?  (Missing counts as no.)"""
    if kind == "STRING":
        return f"coalesce(schema_of_variant({source}) = 'STRING', false)"
    target = {"OBJECT": "map<string,variant>", "ARRAY": "array<variant>"}[kind]
    return f"(try_cast({source} AS {target}) IS NOT NULL)"


def _items(source: str) -> str:
    return f"coalesce(try_cast({source} AS array<variant>), array())"


def _text_of(source: str) -> str:
    return f"coalesce(try_variant_get({source}, '$', 'string'), '')"


def _block(kind: str, text="''", language="''", url="''", alt="''", tool="''", call="''") -> str:
    return (
        f"named_struct('type', {kind}, 'text', {text}, 'language', {language}, 'url', {url}, 'alt_text', {alt},"
        f" 'tool_name', {tool}, 'tool_call_id', {call})"
    )


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


_BLANKS = "' \\t\\n\\r\\u000b\\u000c'"


def _strip(x: str) -> str:
    return f"btrim({x}, {_BLANKS})"


def fenced_blocks(x: str) -> str:
    """Split a text (SQL expression) into alternating text and code blocks.

    Splitting at the fence lines gives text pieces at even and code pieces at odd places; one line break on either side
    of a code piece belongs to the fences.  A last odd piece is an unclosed fence and still code.
    """
    pieces = f"split({x}, {_quoted(FENCE)}, -1)"
    languages = f"regexp_extract_all({x}, {_quoted(FENCE_LANGUAGE)}, 1)"
    closed = "i < size(p.parts) - 1"
    code = f"regexp_replace(CASE WHEN {closed} THEN regexp_replace(part, r'\\n\\z', '') ELSE part END, r'\\A\\n', '')"
    # A closed piece of a single line break is an empty code block: nothing is left after the first cut.
    shaped = (
        "transform(p.parts, (part, i) -> CASE WHEN i % 2 = 0 THEN "
        + _block("'text'", _strip("part"))
        + f" ELSE {_block(chr(39) + 'code' + chr(39), code, 'element_at(p.languages, CAST((i + 1) / 2 AS INT))')} END)"
    )
    kept = (
        f"filter({shaped}, (b, i) -> CASE WHEN b.type = 'text' THEN b.text <> '' WHEN {closed} THEN {_strip('b.text')}"
        " <> '' ELSE p.parts[i] <> '' END)"
    )
    whole = f"array({_block(chr(39) + 'text' + chr(39), 'p.whole')})"
    return (
        f"transform(array(named_struct('whole', {x}, 'parts', {pieces}, 'languages', {languages})),"
        f" p -> CASE WHEN size({kept}) > 0 THEN {kept} ELSE {whole} END)[0]"
    )


def _text_blocks(x: str) -> str:
    """Blocks of a text, none when it is blank."""
    return f"CASE WHEN {_strip(x)} = '' THEN {NO_BLOCKS} ELSE {fenced_blocks(x)} END"


def _openai_part(p: str) -> str:
    kind = f"coalesce(try_variant_get({p}, '$.type', 'string'), 'text')"
    image = f"CASE WHEN {_is(_v(p, 'image_url'), 'OBJECT')} THEN {_s(p, 'image_url.url')} ELSE {_s(p, 'image_url')} END"
    return f"""CASE WHEN {_is(p, 'STRING')} THEN {_text_blocks(_text_of(p))}
        WHEN NOT {_is(p, 'OBJECT')} THEN {NO_BLOCKS}
        WHEN {kind} = 'text' THEN {_text_blocks(_s(p, 'text'))}
        WHEN {kind} = 'image_url' THEN array({_block("'image'", url=image, alt="'User provided image'")})
        WHEN {kind} = 'input_audio' THEN array({_block("'text'", "'[Audio input]'")})
        ELSE {NO_BLOCKS} END"""


def _openai_blocks(m: str) -> str:
    content, call = _v(m, "content"), _v(m, "function_call")
    body = f"""CASE WHEN {_is(content, 'STRING')} THEN {_text_blocks(_text_of(content))}
        ELSE flatten(transform({_items(content)}, p -> {_openai_part('p')})) END"""
    calls = (
        f"transform(filter({_items(_v(m, 'tool_calls'))}, c -> {_is('c', 'OBJECT')} AND ({_v('c', 'function')} IS NULL OR"
        f" {_is(_v('c', 'function'), 'OBJECT')})), c -> "
        + _block(
            "'tool_call'",
            "coalesce(try_variant_get(c, '$.function.arguments', 'string'), '{}')",
            tool=_s("c", "function.name"),
            call=_s("c", "id"),
        )
        + ")"
    )
    legacy = f"""CASE WHEN {_is(call, 'OBJECT')} THEN array({_block("'tool_call'",
        f"coalesce(try_variant_get({m}, '$.function_call.arguments', 'string'), '{{}}')", tool=_s(m, 'function_call.name'))})
        ELSE {NO_BLOCKS} END"""
    result = f"""CASE WHEN {_s(m, 'role')} = 'tool' THEN array({_block("'tool_result'", _s(m, 'content'),
        tool=_s(m, 'name'), call=_s(m, 'tool_call_id'))}) ELSE {NO_BLOCKS} END"""
    return f"concat({body}, {calls}, {legacy}, {result})"


def _texts(items: str, separator: str, by_key: bool = False) -> str:
    """Strings and text parts of an item list joined by a separator."""
    is_text = f"{_v('p', 'text')} IS NOT NULL" if by_key else f"{_s('p', 'type')} = 'text'"
    return (
        f"array_join(transform(filter({items}, p -> {_is('p', 'STRING')} OR ({_is('p', 'OBJECT')} AND {is_text})),"
        f" p -> CASE WHEN {_is('p', 'STRING')} THEN {_text_of('p')} ELSE {_s('p', 'text')} END), '{separator}')"
    )


def _json_or_text(v: str) -> str:
    return f"CASE WHEN {_is(v, 'OBJECT')} THEN to_json({v}) ELSE {_text_of(v)} END"


def _claude_part(p: str) -> str:
    result, kind = _v(p, "content"), _s(p, "type")
    result_text = f"CASE WHEN {_is(result, 'STRING')} THEN {_text_of(result)} ELSE {_texts(_items(result), chr(92) + 'n')} END"
    is_error = f"coalesce(try_variant_get({p}, '$.is_error', 'boolean'), false)"
    source = f"""CASE {_s(p, 'source.type')} WHEN 'url' THEN {_s(p, 'source.url')} WHEN 'base64' THEN
        concat('data:', {_s(p, 'source.media_type')}, ';base64,[embedded]') ELSE '' END"""
    tool_input = f"CASE WHEN {_v(p, 'input')} IS NULL THEN '{{}}' ELSE {_json_or_text(_v(p, 'input'))} END"
    return f"""CASE WHEN {_is(p, 'STRING')} THEN {_text_blocks(_text_of(p))}
        WHEN NOT {_is(p, 'OBJECT')} THEN {NO_BLOCKS}
        WHEN {kind} = 'text' THEN {_text_blocks(_s(p, 'text'))}
        WHEN {kind} = 'tool_use' THEN array({_block("'tool_call'", tool_input, tool=_s(p, 'name'), call=_s(p, 'id'))})
        WHEN {kind} = 'tool_result' THEN array({_block(f"CASE WHEN {is_error} THEN 'error' ELSE 'tool_result' END",
            result_text, call=_s(p, 'tool_use_id'))})
        WHEN {kind} = 'image' THEN array({_block("'image'", url=source, alt="'Image in conversation'")})
        WHEN {kind} = 'thinking' AND {_strip(_s(p, 'thinking'))} <> '' THEN array({_block("'thinking'", _s(p, 'thinking'))})
        ELSE {NO_BLOCKS} END"""


def _claude_blocks(m: str) -> str:
    content = _v(m, "content")
    return f"""CASE WHEN {_is(content, 'STRING')} THEN {_text_blocks(_text_of(content))}
        ELSE flatten(transform({_items(content)}, p -> {_claude_part('p')})) END"""


def _either(p: str, camel: str, snake: str) -> str:
    return f"coalesce({_v(p, camel)}, {_v(p, snake)})"


def _gemini_part(p: str) -> str:
    inline, call = _either(p, "inlineData", "inline_data"), _either(p, "functionCall", "function_call")
    response = _either(p, "functionResponse", "function_response")
    code = _either(p, "executableCode", "executable_code")
    outcome = _either(p, "codeExecutionResult", "code_execution_result")
    mime = f"coalesce(try_variant_get({inline}, '$.mimeType', 'string'), try_variant_get({inline}, '$.mime_type', 'string'), '')"

    def payload(holder, key):
        value = _v(holder, key)
        return f"CASE WHEN {value} IS NULL THEN '{{}}' ELSE {_json_or_text(value)} END"

    def when(holder, block):
        return f"WHEN {holder} IS NOT NULL THEN CASE WHEN {_is(holder, 'OBJECT')} THEN array({block}) ELSE {NO_BLOCKS} END"

    language = f"lower(coalesce(try_variant_get({code}, '$.language', 'string'), 'python'))"
    return f"""CASE WHEN {_is(p, 'STRING')} THEN {_text_blocks(_text_of(p))}
        WHEN NOT {_is(p, 'OBJECT')} THEN {NO_BLOCKS}
        WHEN {_v(p, 'text')} IS NOT NULL THEN {_text_blocks(_s(p, 'text'))}
        {when(inline, _block(f"CASE WHEN startswith({mime}, 'image/') THEN 'image' ELSE 'file' END",
                             url=f"concat('data:', {mime}, ';base64,[embedded]')",
                             alt=f"concat('Inline ', {mime}, ' content')"))}
        {when(call, _block("'tool_call'", payload(call, 'args'), tool=_s(call, 'name')))}
        {when(response, _block("'tool_result'", payload(response, 'response'), tool=_s(response, 'name')))}
        {when(code, _block("'code'", _s(code, 'code'), language))}
        {when(outcome, _block("'tool_result'", _s(outcome, 'output'), tool="'code_execution'"))}
        ELSE {NO_BLOCKS} END"""


def _gemini_blocks(m: str) -> str:
    return f"flatten(transform({_items(_v(m, 'parts'))}, p -> {_gemini_part('p')}))"


# -- format detection -------------------------------------------------------------------------------------------------------


def parsed(exports: DataFrame) -> DataFrame:
    """Add `doc`: the export as VARIANT when it looks like JSON and is valid, NULL otherwise."""
    body = T.strip("raw")
    return once(exports, doc=F.when(body.rlike(r"^[{\[]"), F.try_parse_json(body)))


def detected(documents: DataFrame) -> DataFrame:
    """Add `source_format` and `shape`; the first matching dialect by priority wins."""
    first, obj, arr = _v("doc", "x").replace("$.x", "$[0]"), _is("doc", "OBJECT"), _is("doc", "ARRAY")

    def has(key, source="doc"):
        return f"{_v(source, key)} IS NOT NULL"

    messages, contents = _v("doc", "messages"), _v("doc", "contents")
    block0 = "try_variant_get(doc, '$.messages[0].content[0]', 'variant')"
    content0 = "try_variant_get(doc, '$.contents[0]', 'variant')"
    claude_request = f"""{has('messages')} AND {_is(messages, 'ARRAY')} AND (contains(lower({_s('doc', 'model')}), 'claude')
        OR {has('system')} OR ({_is(block0, 'OBJECT')} AND {has('type', block0)}))"""
    claude_blocked = f"({has('messages')} AND NOT {_is(messages, 'ARRAY')})"
    has_contents = f"{_is(contents, 'ARRAY')} AND {content0} IS NOT NULL"
    shape = f"""CASE
        WHEN doc IS NULL THEN 'text'
        WHEN {arr} AND {_is(first, 'OBJECT')} AND {has('role', first)} THEN 'openai_array'
        WHEN {obj} AND {has('mapping')} THEN 'openai_export'
        WHEN {obj} AND {has('choices')} THEN 'openai_response'
        WHEN {obj} AND {has('role')} AND {has('content')} THEN 'openai_single'
        WHEN {obj} AND NOT {claude_blocked} AND {_s('doc', 'type')} = 'message' THEN 'claude_response'
        WHEN {obj} AND {claude_request} THEN 'claude_request'
        WHEN {obj} AND {has('candidates')} THEN 'gemini_response'
        WHEN {obj} AND {has_contents} AND NOT ({_is(content0, 'OBJECT')} AND {has('parts', content0)}) THEN 'unknown'
        WHEN {obj} AND {has_contents} THEN 'gemini_contents'
        WHEN {obj} AND {has('systemInstruction')} THEN 'gemini_contents'
        WHEN {obj} AND {_is(_v('doc', 'parts'), 'ARRAY')} THEN 'gemini_single'
        WHEN {arr} AND {_is(first, 'OBJECT')} AND {has('parts', first)} THEN 'gemini_array'
        ELSE 'unknown' END"""
    family = F.split("shape", "_")[0]
    label = (
        F.when(F.col("shape") == "text", "generic")
        .when(F.col("shape") == "openai_export", "openai_export")
        .otherwise(family)
    )
    return once(documents, shape=F.expr(shape)).withColumn("source_format", label)


def provider(source_format: str) -> Column:
    """Provider label of a format."""
    table = F.create_map(*[F.lit(x) for pair in fixed.FORMAT_PROVIDER.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(source_format)), F.lit("unknown"))


def role_sql(role: str, family: str) -> str:
    """Canonical role; unknown roles are users.  The dialects differ in which names they know."""
    tools = "WHEN 'tool' THEN 'tool' WHEN 'function' THEN 'tool'"
    known = {
        "openai": f"WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' {tools}",
        "claude": "WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system'",
        "gemini": f"WHEN 'model' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' {tools}",
    }
    return f"CASE lower({role}) {known[family]} ELSE 'user' END"


# -- conversations with their messages as arrays --------------------------------------------------------------------------


def _message(role: str, blocks: str, model: str, finish: str = "''") -> str:
    return f"named_struct('role', {role}, 'blocks', {blocks}, 'model', {model}, 'finish_reason', {finish})"


def _openai_rows(documents: DataFrame) -> DataFrame:
    raw = f"""filter(CASE shape WHEN 'openai_array' THEN {_items('doc')} WHEN 'openai_single' THEN array(doc)
        ELSE transform({_items(_v('doc', 'choices'))}, c -> coalesce({_v('c', 'message')}, {_v('c', 'delta')})) END,
        m -> m IS NOT NULL AND {_is('m', 'OBJECT')} AND {_s('m', 'role')} <> '')"""
    staged = once(documents, raw_messages=F.expr(raw))
    content = _v("m", "content")
    system = f"""transform(filter(raw_messages, m -> lower({_s('m', 'role')}) = 'system'), m -> CASE WHEN {_is(content, 'STRING')}
        THEN {_text_of(content)} ELSE {_texts(_items(content), chr(92) + 'n')} END)"""
    messages = f"""transform(filter(raw_messages, m -> lower({_s('m', 'role')}) <> 'system'),
        m -> {_message(role_sql(_s('m', 'role'), 'openai'), _openai_blocks('m'), _s('m', 'model'), _s('m', 'finish_reason'))})"""
    tokens = "coalesce(try_variant_get(doc, '$.usage.total_tokens', 'bigint'), 0)"
    return staged.select(
        "conv_id", "source_format", "shape",
        F.expr(f"coalesce(try_element_at({system}, -1), '')").alias("system_instruction"),
        F.expr(messages).alias("messages"),
        F.expr(f"CASE WHEN shape = 'openai_response' THEN {_s('doc', 'model')} ELSE '' END").alias("source_model"),
        F.expr(f"CASE WHEN shape = 'openai_response' THEN {tokens} ELSE 0L END").alias("total_tokens"),
    )


def _claude_rows(documents: DataFrame) -> DataFrame:
    raw = f"""filter(CASE shape WHEN 'claude_response' THEN array(doc) ELSE {_items(_v('doc', 'messages'))} END,
        m -> {_is('m', 'OBJECT')} AND (shape = 'claude_response' OR {_s('m', 'role')} <> ''))"""
    staged = once(documents, raw_messages=F.expr(raw))
    role = f"CASE WHEN shape = 'claude_response' THEN 'assistant' ELSE {role_sql(_s('m', 'role'), 'claude')} END"
    system = _v("doc", "system")
    tokens = (
        "coalesce(try_variant_get(doc, '$.usage.input_tokens', 'bigint'), 0) +"
        " coalesce(try_variant_get(doc, '$.usage.output_tokens', 'bigint'), 0)"
    )
    return staged.select(
        "conv_id", "source_format", "shape",
        F.expr(f"CASE WHEN {_is(system, 'STRING')} THEN {_text_of(system)} ELSE {_texts(_items(system), chr(92) + 'n')} END").alias(
            "system_instruction"
        ),
        F.expr(
            f"transform(raw_messages, m -> {_message(role, _claude_blocks('m'), _s('doc', 'model'), _s('m', 'stop_reason'))})"
        ).alias("messages"),
        F.expr(_s("doc", "model")).alias("source_model"),
        F.expr(f"CASE WHEN shape = 'claude_response' THEN {tokens} ELSE 0L END").alias("total_tokens"),
    )


def _gemini_rows(documents: DataFrame) -> DataFrame:
    raw = f"""CASE shape WHEN 'gemini_response' THEN transform(filter({_items(_v('doc', 'candidates'))},
            c -> {_is('c', 'OBJECT')} AND {_is(_v('c', 'content'), 'OBJECT')}),
            c -> named_struct('m', {_v('c', 'content')}, 'finish', {_s('c', 'finishReason')}))
        ELSE transform(filter(CASE shape WHEN 'gemini_single' THEN array(doc) WHEN 'gemini_array' THEN {_items('doc')}
            ELSE {_items(_v('doc', 'contents'))} END, m -> {_is('m', 'OBJECT')}),
            m -> named_struct('m', m, 'finish', '')) END"""
    staged = once(documents, raw_messages=F.expr(raw))
    system = _either("doc", "systemInstruction", "system_instruction")
    role = role_sql("coalesce(try_variant_get(x.m, '$.role', 'string'), 'user')", "gemini")
    tokens = (
        "coalesce(try_variant_get(doc, '$.usageMetadata.promptTokenCount', 'bigint'), 0) +"
        " coalesce(try_variant_get(doc, '$.usageMetadata.candidatesTokenCount', 'bigint'), 0)"
    )
    parts = _texts(_items(_v(system, "parts")), chr(92) + "n", by_key=True)
    return staged.select(
        "conv_id", "source_format", "shape",
        F.expr(f"CASE WHEN {_is(system, 'STRING')} THEN {_text_of(system)} ELSE {parts} END").alias("system_instruction"),
        F.expr(f"transform(raw_messages, x -> {_message(role, _gemini_blocks('x.m'), _s('doc', 'model'), 'x.finish')})").alias(
            "messages"
        ),
        F.expr(f"CASE WHEN shape = 'gemini_response' THEN {_s('doc', 'modelVersion')} ELSE {_s('doc', 'model')} END").alias(
            "source_model"
        ),
        F.expr(f"CASE WHEN shape = 'gemini_response' THEN {tokens} ELSE 0L END").alias("total_tokens"),
    )


def text_turns(documents: DataFrame) -> DataFrame:
    """Add `turns` (role, content) found by role markers at line starts; NULL when there is no marker at all."""
    words = F.create_map(*[F.lit(x) for role, ws in fixed.TURN_MARKER_WORDS for w in ws.split() for x in (w, role)])
    body = F.regexp_replace(T.strip("raw"), RULE_LINE, "")
    staged = documents.withColumns(
        {"__marks": F.regexp_extract_all(body, F.lit(MARKER), F.lit(1)), "__parts": F.split(body, MARKER, -1)}
    )
    # Part 0 lies before the first marker and belongs to no turn.
    pairs = F.transform(
        "__marks",
        lambda m, i: F.struct(
            F.element_at(words, F.lower(m)).alias("role"), T.strip(F.element_at("__parts", i + 2)).alias("content")
        ),
    )
    turns = F.filter(pairs, lambda t: t["content"] != "")
    return once(staged, turns=F.when(F.size("__marks") > 0, turns)).drop("__marks", "__parts")


def _text_rows(documents: DataFrame) -> DataFrame:
    staged = text_turns(documents).withColumn("whole", T.strip("raw"))
    systems = "transform(filter(turns, t -> t.role = 'system'), t -> t.content)"
    spoken = f"""transform(filter(turns, t -> t.role <> 'system'),
        t -> {_message('t.role', fenced_blocks('t.content'), "''")})"""
    single = f"array({_message(chr(39) + 'user' + chr(39), fenced_blocks('whole'), chr(39) * 2)})"
    # Markers without a single non-empty turn leave the whole text as one user message, like no markers at all.
    return staged.select(
        "conv_id", "source_format", "shape",
        F.expr(f"coalesce(try_element_at({systems}, -1), '')").alias("system_instruction"),
        F.expr(f"""CASE WHEN size(turns) > 0 THEN {spoken} WHEN whole <> '' THEN {single}
            ELSE filter({single}, m -> false) END""").alias("messages"),
        F.lit("").alias("source_model"),
        F.lit(0).cast("bigint").alias("total_tokens"),
    )


def _export_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree export: (conversations, messages) from the last-child path of every tree."""
    # from_json keeps the order of the mapping's keys, which decides the root; a VARIANT object would sort them.
    nodes = documents.select(
        "conv_id",
        "source_format",
        "shape",
        F.expr(_s("doc", "default_model_slug")).alias("source_model"),
        F.from_json(F.get_json_object("raw", "$.mapping"), "map<string,string>").alias("mapping"),
    )
    entries = F.transform(
        F.map_entries("mapping"),
        lambda e: F.struct(e["key"].alias("node"), F.try_parse_json(e["value"]).alias("v")),
    )
    parent = "try_variant_get(e.v, '$.parent', 'string')"
    listed = once(nodes, entries=entries).withColumn(
        "absent", F.expr(f"array_except(transform(entries, e -> {parent}), map_keys(mapping))")
    )
    rooted = listed.withColumn(
        "root", F.expr(f"try_element_at(filter(entries, e -> {parent} IS NULL OR array_contains(absent, {parent})), 1).node")
    )
    flat = rooted.select("conv_id", "source_model", F.explode("entries").alias("e")).select(
        "conv_id",
        "source_model",
        F.col("e.node").alias("node"),
        F.expr(_v("e.v", "message")).alias("m"),
        F.expr(f"try_variant_get(try_element_at({_items(_v('e.v', 'children'))}, -1), '$', 'string')").alias("next"),
    )
    starts = rooted.where(F.col("root").isNotNull()).select("conv_id", F.col("root").alias("start"))
    path = chains.walk(starts, flat.select("conv_id", "node", "next"), ["conv_id"])
    on_path = flat.join(path.select("conv_id", "node", "step"), ["conv_id", "node"])
    on_path = on_path.where(F.expr(f"{_is('m', 'OBJECT')} AND {_is(_v('m', 'author'), 'OBJECT')}"))
    role = f"lower({_s('m', 'author.role')})"
    content = _v("m", "content")
    part = f"""CASE WHEN {_is('p', 'STRING')} THEN {_text_blocks(_text_of('p'))}
        WHEN {_is('p', 'OBJECT')} AND {_s('p', 'asset_pointer')} <> '' THEN array({_block("'image'",
            url=_s('p', 'asset_pointer'), alt="'ChatGPT generated image'")}) ELSE {NO_BLOCKS} END"""
    from_parts = f"flatten(transform({_items(_v('m', 'content.parts'))}, p -> {part}))"
    code = _block("'code'", _s("m", "content.text"), _s("m", "content.language"))
    blocks = f"""CASE WHEN {_is(content, 'STRING')} THEN {_text_blocks(_text_of(content))}
        WHEN size({from_parts}) > 0 THEN {from_parts}
        WHEN {_s('m', 'content.content_type')} = 'code' AND {_strip(_s('m', 'content.text'))} <> '' THEN array({code})
        ELSE {NO_BLOCKS} END"""
    said = once(on_path, blocks=F.expr(blocks)).select(
        "conv_id",
        "step",
        F.expr(role).alias("raw_role"),
        F.expr(role_sql(role, "openai")).alias("role"),
        "blocks",
        F.expr(
            "array_join(transform(filter(" + _items(_v("m", "content.parts")) + f", p -> {_is('p', 'STRING')} AND"
            f" {_strip(_text_of('p'))} <> ''), p -> {_text_of('p')}), ' ')"
        ).alias("system_text"),
        F.coalesce(F.expr("try_variant_get(m, '$.metadata.model_slug', 'string')"), F.col("source_model")).alias("model"),
        F.expr(
            "CASE WHEN try_variant_get(m, '$.create_time', 'double') > 0 THEN"
            " timestamp_seconds(try_variant_get(m, '$.create_time', 'double')) END"
        ).alias("ts"),
    )
    system = F.col("raw_role").isin("system", "")
    instruction = (
        said.where(system & (T.strip("system_text") != ""))
        .groupBy("conv_id")
        .agg(F.max_by("system_text", "step").alias("system_instruction"))
    )
    kept = said.where(~system & (F.size("blocks") > 0))
    numbered = ordered.running_sum(
        kept, ["conv_id"], ["step"], F.lit(1), ordered.bucket_of("step", 4096), "turn"
    ).withColumn("turn", (F.col("turn") - 1).cast("int"))
    messages = numbered.select("conv_id", "turn", "role", "blocks", "model", F.lit("").alias("finish_reason"), "ts")
    conversations = nodes.join(instruction, "conv_id", "left").select(
        "conv_id", "source_format", "shape",
        F.coalesce("system_instruction", F.lit("")).alias("system_instruction"),
        "source_model",
        F.lit(0).cast("bigint").alias("total_tokens"),
    )
    return conversations, messages


_FAMILIES = {"openai": _openai_rows, "claude": _claude_rows, "gemini": _gemini_rows, "text": _text_rows}
_SHAPES = {
    "openai": ["openai_array", "openai_single", "openai_response"],
    "claude": ["claude_request", "claude_response"],
    "gemini": ["gemini_contents", "gemini_single", "gemini_array", "gemini_response"],
    "text": ["text"],
}


def normalize(exports: DataFrame, dialects: tuple[str, ...] = ("openai", "claude", "gemini", "text", "export")):
    """exports(conv_id, raw) -> (conversations, messages).

    messages has conv_id, turn, role, blocks ARRAY<STRUCT>, full_text, model, finish_reason, ts; turns are numbered after
    system messages and messages without blocks are gone.
    """
    documents = detected(parsed(exports))
    heads, bodies = [], []
    for name in dialects:
        if name == "export":
            head, body = _export_rows(documents.where(F.col("shape") == "openai_export"))
        else:
            rows = _FAMILIES[name](documents.where(F.col("shape").isin(_SHAPES[name])))
            head = rows.drop("messages")
            spoken = F.filter("messages", lambda m: F.size(m["blocks"]) > 0)
            # posexplode_outer: the inner form makes the planner test the array's size in a copy of the whole parse.
            exploded = rows.select("conv_id", F.posexplode_outer(spoken).alias("turn", "m"))
            body = exploded.where(F.col("turn").isNotNull()).select(
                "conv_id", "turn", "m.role", "m.blocks", "m.model", "m.finish_reason",
                F.lit(None).cast("timestamp").alias("ts"),
            )
        heads.append(head)
        bodies.append(body)
    conversations, messages = heads[0], bodies[0]
    for head, body in zip(heads[1:], bodies[1:]):
        conversations, messages = conversations.unionByName(head), messages.unionByName(body)
    conversations = conversations.withColumn("source_llm", provider("source_format"))
    return conversations, messages.withColumn("full_text", full_text("blocks"))


# -- rendering and profile --------------------------------------------------------------------------------------------------


def block_text(b: Column) -> Column:
    """How a block reads in the running text of its message."""
    kind = b["type"]
    return (
        F.when(kind == "code", F.concat(F.lit("```"), b["language"], F.lit("\n"), b["text"], F.lit("\n```")))
        .when(kind == "image", F.concat(F.lit("[Image: "), F.when(b["alt_text"] != "", b["alt_text"]).otherwise(b["url"]), F.lit("]")))
        .when(kind == "tool_call", F.concat(F.lit("[Tool call: "), b["tool_name"], F.lit("("), b["text"], F.lit(")]")))
        .when(kind == "tool_result", F.concat(F.lit("[Tool result ("), b["tool_name"], F.lit("): "), b["text"], F.lit("]")))
        .when(kind == "thinking", F.lit(""))
        .otherwise(b["text"])
    )


def full_text(blocks: str) -> Column:
    return F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t != ""), "\n\n")


def block_rows(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "turn", F.posexplode("blocks").alias("block_ix", "b")).select(
        "conv_id", "turn", "block_ix", "b.*"
    )


def profiles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts and flags per conversation."""
    code = F.exists("blocks", lambda b: b["type"] == "code")
    tools = F.exists("blocks", lambda b: b["type"].isin("tool_call", "tool_result"))
    languages = (
        messages.select("conv_id", F.explode("blocks").alias("b"))
        .where((F.col("b.type") == "code") & (F.col("b.language") != ""))
        .select("conv_id", F.lower("b.language").alias("language"))
        .distinct()
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("language")).alias("languages_used"))
    )
    counted = messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.count_if(F.col("role").isin("system", "tool")).alias("other_messages"),
        F.bool_or(code).alias("has_code"),
        F.bool_or(tools).alias("has_tool_usage"),
        F.sum(F.length("full_text")).alias("text_chars"),
    )
    joined = conversations.join(counted, "conv_id", "left").join(languages, "conv_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *conversations.columns,
        *[F.coalesce(c, zero).alias(c) for c in ("message_count", "user_messages", "assistant_messages", "other_messages", "text_chars")],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_code", "has_tool_usage")],
        F.coalesce("languages_used", F.array().cast("array<string>")).alias("languages_used"),
    )


def all_text(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, all_text): the system instruction and every text, in order, with blank lines between them."""
    said = messages.where(F.col("full_text") != "").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "full_text"))).alias("said")
    )
    texts = F.coalesce(F.transform("said", lambda m: m["full_text"]), F.array().cast("array<string>"))
    opening = F.when(F.col("system_instruction") != "", F.array("system_instruction")).otherwise(F.array().cast("array<string>"))
    return conversations.join(said, "conv_id", "left").select("conv_id", F.array_join(F.concat(opening, texts), "\n\n").alias("all_text"))
