"""Bulk import of texts, JSON, files, captured conversations and API exchange logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions import text as T
from threadloom.functions.barrier import once

CAPTURE_SCHEMA = (
    "platform string, model string, title string, url string,"
    " messages array<struct<role:string,content:string,model:string>>, captured_at string"
)
TEXT_FILES = ["txt", "md", "markdown", ""]


def import_texts(texts: DataFrame) -> DataFrame:
    """Classify raw texts: kind, size in bytes and the parsed document; blank texts are dropped."""
    body = T.strip("raw")
    doc = F.when(body.rlike(r"^[{\[]"), F.try_parse_json(body))
    parsed = once(texts.where(body != ""), doc=doc).withColumn("size_bytes", F.octet_length("raw"))
    return parsed.withColumn("kind", F.when(F.col("doc").isNotNull(), "text_json").otherwise("text_plain"))


def import_json(lines: DataFrame) -> DataFrame:
    """Newline-delimited JSON documents as VARIANT; rows that are empty or not JSON are dropped."""
    return once(lines, doc=F.try_parse_json("raw")).where(
        F.col("doc").isNotNull() & ~F.to_json("doc").isin("{}", "[]", "null", '""', "0", "false")
    )


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))


def scan_folder(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """Every file below a folder as one row: path, content, and the size and time of the file.

    The scan is split by files over the cluster; where only path, size or time is asked for, no content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    return files.select(
        F.col("_metadata.file_path").alias("path"), "content",
        F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"),
    )


def _judged(files: DataFrame) -> DataFrame:
    """Decoded text, parsed JSON and the reason for a refusal (NULL where a file is accepted)."""
    decoded = files.withColumns(
        {
            "extension": extension(F.col("path")),
            "size_bytes": F.octet_length("content"),
            "raw": F.expr(
                "CASE WHEN is_valid_utf8(CAST(content AS STRING)) THEN CAST(content AS STRING)"
                " ELSE decode(content, 'ISO-8859-1') END"
            ),
        }
    )
    checked = once(decoded, doc=F.when(F.col("extension") == "json", F.try_parse_json("raw")))
    reason = (
        F.when(F.col("size_bytes") == 0, "empty")
        .when((F.col("extension") == "json") & F.col("doc").isNull(), "invalid_json")
        .when((F.col("extension") != "json") & ~F.col("extension").isin(TEXT_FILES), "unsupported")
    )
    kind = F.when(F.col("extension") == "json", "file_json").otherwise("file_text")
    return checked.withColumns({"reason": reason, "kind": kind})


def import_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, content) -> (accepted, rejected).  UTF-8 first, Latin-1 where the bytes are not UTF-8."""
    judged = _judged(files)
    accepted = judged.where(F.col("reason").isNull()).select("path", "kind", "size_bytes", "raw", "doc")
    return accepted, judged.where(F.col("reason").isNotNull()).select("path", "extension", "size_bytes", "reason")


def import_folder(spark: SparkSession, root: str, target: str, names: str = "*") -> tuple[DataFrame, DataFrame]:
    """Import a folder tree into two tables below `target`, (accepted, rejected), in one pass over the files.

    accepted(path, kind, size_bytes, modified, raw) holds the decoded text, rejected(path, extension, size_bytes, modified,
    reason) no content.  Files of no importable type are told by their names and never opened.  Spark's scans pass over files
    of no bytes, so these are in neither table.
    """
    files = scan_folder(spark, root, names)
    named = files.withColumn("extension", extension(F.col("path")))
    known = F.col("extension").isin([*TEXT_FILES, "json"])
    columns = ["path", "extension", "kind", "size_bytes", "modified", "reason", "raw"]
    opened = _judged(files).where(known).withColumn("size_bytes", F.col("file_size")).select(*columns)
    # A second scan of the names alone: the content column is pruned from it.
    refused = named.where(~known).select(
        "path", "extension", F.lit(None).cast("string").alias("kind"), F.col("file_size").alias("size_bytes"), "modified",
        F.lit("unsupported").alias("reason"),
        F.lit(None).cast("string").alias("raw"),
    )
    for part in (opened, refused):
        part.withColumn("accepted", F.col("reason").isNull()).write.mode("append").partitionBy("accepted").parquet(target)
    schema = opened.withColumn("accepted", F.lit(True)).schema
    rows = spark.read.schema(schema).parquet(target)
    return (
        rows.where("accepted").select("path", "kind", "size_bytes", "modified", "raw"),
        rows.where("NOT accepted").select("path", "extension", "size_bytes", "modified", "reason"),
    )


def import_captures(captures: DataFrame, now: Column | None = None) -> DataFrame:
    """captures(capture_id, payload JSON) -> one session row per valid capture; works on batches and on streams."""
    table = F.create_map(*[F.lit(x) for pair in fixed.PLATFORM_PROVIDER.items() for x in pair])
    parsed = once(captures, p=F.from_json("payload", CAPTURE_SCHEMA)).where(F.size("p.messages") > 0)
    chars = F.aggregate("p.messages", F.lit(0).cast("bigint"), lambda acc, m: acc + F.length(m["content"]))
    moment = F.coalesce(F.try_to_timestamp("p.captured_at"), F.current_timestamp() if now is None else now)
    platform = F.col("p.platform")
    return parsed.select(
        "capture_id",
        F.coalesce(F.when(F.col("p.title") != "", F.col("p.title")), F.lit("Captured Conversation")).alias("title"),
        F.coalesce(F.try_element_at(table, platform), platform).alias("source_llm"),
        F.col("p.model").alias("source_model"),
        F.size("p.messages").alias("message_count"),
        F.floor(chars / 4).cast("bigint").alias("total_tokens"),
        chars.alias("total_chars"),
        F.array(F.lit("auto-capture"), platform).alias("tags"),
        F.col("p.url").alias("url"),
        moment.alias("captured_at"),
        F.col("p.messages").alias("messages"),
    )


def join_captures(parts: DataFrame, session: Column, part: Column) -> DataFrame:
    """Captures of one conversation that came in several parts as one session row: counts add up, the first part names it.

    Only heads meet here; the messages stay in the rows of their parts, so a conversation of any length is no single row.
    """
    heads = parts.select(session.alias("session_id"), part.alias("part"), *[c for c in parts.columns if c != "messages"])
    first = F.min_by(F.struct("title", "source_llm", "source_model", "tags", "url"), "part")
    joined = heads.groupBy("session_id").agg(
        first.alias("h"),
        F.sum("message_count").cast("int").alias("message_count"),
        F.floor(F.sum("total_chars") / 4).cast("bigint").alias("total_tokens"),
        F.max("captured_at").alias("captured_at"),
    )
    return joined.select("session_id", "h.*", "message_count", "total_tokens", "captured_at")


def exchange_provider(request: str = "req", response: str = "resp") -> Column:
    """Which API an exchange belongs to; NULL when it cannot be told."""
    return F.expr(f"""CASE
        WHEN try_variant_get({request}, '$.messages', 'variant') IS NOT NULL
            AND try_variant_get({response}, '$.choices', 'variant') IS NOT NULL THEN 'openai'
        WHEN try_variant_get({request}, '$.messages', 'variant') IS NOT NULL
            AND startswith(schema_of_variant(try_variant_get({response}, '$.content', 'variant')), 'ARRAY') THEN 'anthropic'
        WHEN try_variant_get({request}, '$.contents', 'variant') IS NOT NULL THEN 'google' END""")


def exchanges(log: DataFrame) -> DataFrame:
    """exchange_log(exchange_id, request, response) parsed and told apart; unknown ones are kept with a NULL provider."""
    parsed = once(log, req=F.try_parse_json("request"), resp=F.try_parse_json("response"))
    return once(parsed.select("exchange_id", "req", "resp"), provider=exchange_provider())


_ARRAY = "coalesce(try_variant_get({0}, '{1}', 'array<variant>'), array())"


def exchange_rows(parsed: DataFrame) -> DataFrame:
    """One row per known exchange: model, answer text, token counts and the combined raw conversation for `normalize`."""
    first = "try_variant_get(resp, '$.choices[0].message', 'variant')"
    candidate = "try_variant_get(resp, '$.candidates[0].content', 'variant')"

    def texts(items, condition):
        return (
            f"array_join(transform(filter({items}, b -> {condition}), b -> coalesce(try_variant_get(b, '$.text',"
            " 'string'), '')), '')"
        )

    def tokens(path):
        return f"coalesce(try_variant_get(resp, '$.{path}', 'bigint'), 0L)"

    content = _ARRAY.format("resp", "$.content")
    answer = f"""CASE provider WHEN 'openai' THEN coalesce(try_variant_get({first}, '$.content', 'string'), '')
        WHEN 'anthropic' THEN {texts(content, "coalesce(try_variant_get(b, '$.type', 'string'), '') = 'text'")}
        ELSE {texts(_ARRAY.format(candidate, '$.parts'), "try_variant_get(b, '$.text', 'variant') IS NOT NULL")} END"""
    in_tokens = f"""CASE provider WHEN 'openai' THEN {tokens('usage.prompt_tokens')}
        WHEN 'anthropic' THEN {tokens('usage.input_tokens')} ELSE {tokens('usageMetadata.promptTokenCount')} END"""
    out_tokens = f"""CASE provider WHEN 'openai' THEN {tokens('usage.completion_tokens')}
        WHEN 'anthropic' THEN {tokens('usage.output_tokens')} ELSE {tokens('usageMetadata.candidatesTokenCount')} END"""

    def joined(items):
        return f"concat('[', array_join(transform({items}, v -> to_json(v)), ','), ']')"

    asked = _ARRAY.format("req", "$.messages")
    reply = f"CASE WHEN {first} IS NULL THEN array() ELSE array({first}) END"
    answered = f"""concat(transform({asked}, v -> to_json(v)), CASE WHEN size({content}) = 0 THEN array() ELSE
        array(concat('{{"role":"assistant","content":', {joined(content)}, '}}')) END)"""

    def member(name, value):
        return f"CASE WHEN {value} IS NULL THEN '' ELSE concat('\"{name}\":', to_json({value}), ',') END"

    system = "coalesce(try_variant_get(req, '$.systemInstruction', 'variant'), try_variant_get(req, '$.system_instruction', 'variant'))"
    contents = f"concat({_ARRAY.format('req', '$.contents')}, CASE WHEN {candidate} IS NULL THEN array() ELSE array({candidate}) END)"
    raw = f"""CASE provider WHEN 'openai' THEN {joined(f'concat({asked}, {reply})')}
        WHEN 'anthropic' THEN concat('{{', {member('model', "try_variant_get(req, '$.model', 'variant')")},
            {member('system', "try_variant_get(req, '$.system', 'variant')")}, '"messages":[', array_join({answered}, ','), ']}}')
        ELSE concat('{{', {member('systemInstruction', system)}, '"contents":', {joined(contents)}, '}}') END"""
    known = once(parsed.where(F.col("provider").isNotNull()), raw=F.expr(raw))
    return known.select(
        "exchange_id",
        "provider",
        F.expr("coalesce(try_variant_get(req, '$.model', 'string'), '')").alias("model"),
        F.expr(answer).alias("response_content"),
        F.expr(in_tokens).alias("request_tokens"),
        F.expr(out_tokens).alias("response_tokens"),
        "raw",
    )


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append-only sink: rows are only ever added."""
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


RELATIONAL_SCHEMAS = {
    "users": "id string, email string, display_name string, subscription_tier string, shifts_this_month int,"
    " is_active boolean, settings string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "teams": "id string, name string, owner_id string, is_active boolean, created_at timestamp, deleted_at timestamp",
    "team_members": "id string, team_id string, user_id string, role string, joined_at timestamp",
    "sessions": "id string, user_id string, team_id string, title string, source_llm string, source_model string,"
    " message_count int, total_tokens bigint, tags string, metadata string, is_archived boolean,"
    " created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "contexts": "id string, session_id string, version int, blob binary, blob_size_bytes bigint, compression_ratio double,"
    " parent_id string, is_current boolean, created_at timestamp",
    "api_keys": "id string, user_id string, name string, key_prefix string, scopes string, is_active boolean,"
    " created_at timestamp",
    "webhooks": "id string, user_id string, url string, events string, is_active boolean, failure_count int,"
    " created_at timestamp",
    "audit_logs": "id string, user_id string, action string, resource_type string, resource_id string, details string,"
    " created_at timestamp",
    "shift_records": "id string, user_id string, session_id string, source_llm string, target_llm string,"
    " source_tokens bigint, target_tokens bigint, status string, created_at timestamp",
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a relational table in its declared types; what is not there is NULL."""
    fields = [c.strip().split() for c in RELATIONAL_SCHEMAS[name].split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A relational table from parquet with its declared schema (no inference; columns not used are not read)."""
    return spark.read.schema(RELATIONAL_SCHEMAS[name]).parquet(f"{root}/{name}")
