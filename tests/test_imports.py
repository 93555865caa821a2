"""Folder imports and the pack store, on real files."""

import hashlib

from pyspark.sql import functions as F

from threadloom.operators import export as X
from threadloom.operators import reports as R
from threadloom.session import shared_folder
from threadloom.sources import imports as I


def test_folder_tree(spark, tmp_path):
    deep = tmp_path / "in" / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "in" / "plain").write_bytes("ohne Endung, größer".encode())
    (deep / "old.TXT").write_bytes("größer".encode("latin-1"))
    (deep / "doc.json").write_text('{"a": [1, 2]}')
    (deep / "bad.json").write_text("{not json")
    (deep / "tool.exe").write_bytes(bytes(range(256)))
    (deep / "empty.md").write_bytes(b"")
    (deep / "long.md").write_text("word " * 300_000)
    accepted, rejected = I.import_folder(spark, str(tmp_path / "in"), shared_folder(spark, "t"))
    got = {r.path.split("/")[-1]: r for r in accepted.collect()}
    assert {n: r.kind for n, r in got.items()} == {"plain": "file_text", "old.TXT": "file_text", "doc.json": "file_json", "long.md": "file_text"}
    assert got["old.TXT"].raw == "größer" and got["old.TXT"].size_bytes == 6 and got["old.TXT"].modified is not None
    assert hashlib.md5(got["long.md"].raw.encode()).hexdigest() == hashlib.md5(("word " * 300_000).encode()).hexdigest()
    refused = {r.path.split("/")[-1]: (r.reason, r.size_bytes) for r in rejected.collect()}
    assert refused == {"bad.json": ("invalid_json", 9), "tool.exe": ("unsupported", 256)}


def test_names_alone_are_read_without_content(spark, tmp_path):
    (tmp_path / "x.md").write_text("x")
    plan = I.scan_folder(spark, str(tmp_path)).select("path", "file_size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_pack_store_prunes_targets_at_run_time(spark, tmp_path):
    path = str(tmp_path / "packs")
    packs = spark.range(30).selectExpr("id AS conv_id", "element_at(array('openai', 'claude', 'gemini'), CAST(id % 3 + 1 AS INT)) AS target", "id AS token_estimate")
    X.write_packs(packs, path)
    spark.createDataFrame([(t, p) for t, p in (("openai", "a"), ("claude", "b"), ("gemini", "c"))], "target string, provider string").write.parquet(str(tmp_path / "p"))
    wanted = spark.read.parquet(str(tmp_path / "p")).where("provider = 'b'")
    read = X.stored_packs(spark, path, wanted)
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.conv_id for r in read.collect()) == list(range(1, 30, 3))


def test_captures_in_parts_are_one_session(spark):
    payload = '{"platform": "claude", "model": "m", "title": "%s", "url": "u", "captured_at": "%s", "messages": [%s]}'
    message = '{"role": "user", "content": "%s"}'
    rows = [
        (7_000_001, payload % ("second", "2024-05-07T00:00:00Z", message % "abc")),
        (7_000_000, payload % ("first", "2024-05-06T00:00:00Z", ", ".join([message % "abcd", message % "x"]))),
        (8_000_000, payload % ("", "never", message % "")),
        (9_000_000, None),
        (9_000_001, '{"messages": []}'),
    ]
    parts = I.import_captures(spark.createDataFrame(rows, "capture_id bigint, payload string"), F.timestamp_seconds(F.lit(0)))
    got = I.join_captures(parts, F.expr("capture_id div 1000000"), F.col("capture_id") % 1000000).orderBy("session_id").collect()
    assert [(r.session_id, r.title, r.message_count, r.total_tokens) for r in got] == [
        (7, "first", 3, 2), (8, "Captured Conversation", 1, 0)
    ]
    assert got[0].source_llm == "anthropic" and got[1].captured_at.timestamp() == 0


def test_missing_columns_are_null(spark):
    made = I.conform(spark.range(2).selectExpr("id AS user_id"), "webhooks")
    assert made.columns == [c.split()[0] for c in I.RELATIONAL_SCHEMAS["webhooks"].split(", ")]
    assert [(r.user_id, r.url) for r in made.collect()] == [("0", None), ("1", None)]


def test_listing_of_a_user_over_many_days(spark):
    rows = spark.range(40).selectExpr("1L AS user_id", "id AS k", "date_add(DATE'2024-01-01', CAST(id % 10 AS INT)) AS created_at")
    got = [(r.k, r.position) for r in R.listing(rows, "k").orderBy("position").collect()]
    want = sorted(range(40), key=lambda k: (-(k % 10), -k))
    assert got == [(k, i + 1) for i, k in enumerate(want)]
