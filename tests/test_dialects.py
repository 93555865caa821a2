"""The same chat in every dialect gives the same messages; special shapes by hand."""

import json

import pytest

from threadloom.sources import dialects as D
from threadloom.sources import imports as I

CHAT = [("user", "How do I sort?"), ("assistant", "Like this:\n```python\nsorted(x)\n```\nDone."), ("user", "Thanks")]
RAW = {
    "openai": json.dumps([{"role": "system", "content": "Be brief"}] + [{"role": r, "content": t} for r, t in CHAT]),
    "claude": json.dumps({"model": "claude-x", "system": "Be brief", "messages": [{"role": r, "content": [{"type": "text", "text": t}]} for r, t in CHAT]}),
    "gemini": json.dumps({"systemInstruction": {"parts": [{"text": "Be brief"}]}, "contents": [{"role": {"assistant": "model"}.get(r, r), "parts": [{"text": t}]} for r, t in CHAT]}),
    "text": "System: Be brief\n" + "\n".join(f"{r.title()}: {t}" for r, t in CHAT),
    "export": json.dumps(
        {
            "mapping": {
                "z": {"message": {"author": {"role": "system"}, "content": {"parts": ["Be brief"]}}, "parent": None, "children": ["m0"]},
                **{
                    f"m{i}": {
                        "message": {"author": {"role": r}, "content": {"content_type": "text", "parts": [t]}, "create_time": 1700000000 + i},
                        "parent": "z" if i == 0 else f"m{i - 1}",
                        "children": ["dead", f"m{i + 1}"] if i < 2 else [],
                    }
                    for i, (r, t) in enumerate(CHAT)
                },
            }
        }
    ),
}


@pytest.fixture(scope="module")
def normalized(spark):
    exports = spark.createDataFrame(list(RAW.items()), "conv_id string, raw string")
    heads, messages = D.normalize(exports)
    return heads.collect(), messages.collect()


@pytest.mark.parametrize("dialect", list(RAW))
def test_dialects_agree(normalized, dialect):
    heads, messages = normalized
    mine = sorted((m.turn, m.role, m.full_text) for m in messages if m.conv_id == dialect)
    want = [(0, "user", "How do I sort?"), (1, "assistant", "Like this:\n\n```python\nsorted(x)\n```\n\nDone."), (2, "user", "Thanks")]
    assert mine == want
    assert [h.system_instruction for h in heads if h.conv_id == dialect] == ["Be brief"]


def test_export_times(normalized):
    _, messages = normalized
    first = next(m for m in messages if m.conv_id == "export" and m.turn == 0)
    assert first.ts.timestamp() == 1700000000


def blocks(spark, raw, *dialects):
    _, m = D.normalize(spark.createDataFrame([(1, raw)], "conv_id bigint, raw string"), dialects)
    return [(b.type, b.text, b.language) for b in D.block_rows(m).orderBy("turn", "block_ix").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("a\n```py\nx\n```\nb", [("text", "a", ""), ("code", "x", "py"), ("text", "b", "")]),
        ("```\n\n```", [("text", "```\n\n```", "")]),
        ("a\n```js extra\nopen\n", [("text", "a", ""), ("code", "open\n", "js")]),
        ("only ``` inline", [("text", "only ``` inline", "")]),
        ("a\n```", [("text", "a", "")]),
        ("```\n  keep\n\n```", [("code", "  keep\n", "")]),
    ],
)
def test_fences(spark, text, want):
    assert blocks(spark, json.dumps([{"role": "user", "content": text}]), "openai") == want


def test_text_turns(spark):
    raw = "lost\nQ> one\ntwo\n----\nA | three\n***\n\nHuman:\nfour"
    _, m = D.normalize(spark.createDataFrame([(1, raw)], "conv_id bigint, raw string"), ("text",))
    assert [(r.role, r.full_text) for r in m.orderBy("turn").collect()] == [("user", "one\ntwo"), ("assistant", "three"), ("user", "four")]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('[{"role":"user"}]', "openai"),
        ('{"role":"user","content":[{"type":"text","text":"x"}]}', "openai"),
        ('{"mapping":{}}', "openai_export"),
        ('{"messages":[{"role":"user","content":"x"}],"model":"claude-3"}', "claude"),
        ('{"messages":[{"role":"user","content":"x"}]}', "unknown"),
        ('{"type":"message","content":[]}', "claude"),
        ('{"contents":[{"parts":[]}]}', "gemini"),
        ('[{"parts":[]}]', "gemini"),
        ("{broken", "generic"),
        ("hello", "generic"),
        ("[]", "unknown"),
    ],
)
def test_detection(spark, raw, want):
    df = spark.createDataFrame([(1, raw)], "conv_id bigint, raw string")
    assert D.detected(D.parsed(df)).first()["source_format"] == want


def test_file_import_reasons(spark):
    rows = [("a/x.json", b"{bad"), ("a/x.exe", b"x"), ("a/x.txt", b""), ("a/x.md", "ü".encode("latin-1")), ("a/noext", b"ok")]
    accepted, rejected = I.import_files(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path: r.reason for r in rejected.collect()} == {"a/x.json": "invalid_json", "a/x.exe": "unsupported", "a/x.txt": "empty"}
    assert {r.path: r.raw for r in accepted.collect()} == {"a/x.md": "ü", "a/noext": "ok"}


@pytest.mark.parametrize("name", ["openai_messages", "claude_messages", "gemini_messages", "transcript_messages", "openai_conversations", "claude_conversations", "gemini_conversations", "transcript_conversations"])
def test_conversations_in_parts_come_back_whole(spark, sf, monkeypatch, name):
    """Exports of at most three turns give the same messages and heads as whole exports."""
    import __spark_entry__
    from threadloom.plans import ingest

    run = __spark_entry__.queries()[name]
    whole = sorted(map(tuple, run(spark, sf).collect()), key=str)
    monkeypatch.setattr(ingest, "PART", 3)
    assert sorted(map(tuple, run(spark, sf).collect()), key=str) == whole


def test_profiles_of_conversations_in_parts_come_back_whole(spark, sf, monkeypatch):
    """Exports of at most three turns give the same profiles as whole exports, one per conversation."""
    import __spark_entry__
    from threadloom.plans import ingest

    run = __spark_entry__.queries()["conversation_profiles"]
    whole = sorted(map(tuple, run(spark, sf).collect()))
    monkeypatch.setattr(ingest, "PART", 3)
    assert sorted(map(tuple, run(spark, sf).collect())) == whole
