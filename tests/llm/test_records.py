"""Preference formatting, revisit resolution, and the pipeline against brute force."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

from threadloom.llm import bpe, chat_format, warc_revisit

TURNS = "pair_id bigint, turn bigint, role string, text string, side string"


def test_pairs_are_split_at_the_first_difference(spark):
    same = [(0, "system", "s"), (1, "user", "hi"), (2, "assistant", "A")]
    rows = lambda pair, turns: [(pair, t, r, x, "clash") for t, r, x in turns]
    chosen = rows(1, same) + rows(2, same) + rows(3, same[:1]) + rows(None, [(0, "user", None)]) + rows(5, [(0, None, "<|user|>")]) + rows(1, same[:1])
    rejected = rows(1, same[:2] + [(2, "assistant", "B"), (3, "user", "more")]) + rows(2, same) + rows(4, same[:1])
    rejected += rows(None, [(0, "user", "x")]) + [(1, None, "user", "no turn", "clash")]
    got = chat_format.format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()
    body = {(r.pair_id, r.side): r.body for r in got}
    assert body[1, "prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n"
    assert body[1, "chosen"] == "<|assistant|>\nA<|end|>\n"
    assert body[1, "rejected"] == "<|assistant|>\nB<|end|>\n<|user|>\nmore<|end|>\n"
    assert (2, "chosen") not in body and body[2, "prompt"].endswith("A<|end|>\n")
    assert set(k for k in body if k[0] in (3, 4)) == {(3, "chosen"), (4, "rejected")}
    assert body[None, "chosen"] == "<|user|>\n<|end|>\n"
    assert body[5, "chosen"] == "<||>\n<\\|user|><|end|>\n"
    masks = {(r.pair_id, r.side): [(s.length, s.loss) for s in r.mask] for r in got}
    assert masks[1, "rejected"] == [(14, False), (9, True), (9, False), (12, False)]
    assert not any(on for _, on in masks[2, "prompt"])
    assert all(sum(n for n, _ in masks[k]) == len(body[k]) for k in body)


def test_long_conversations_come_in_parts(spark):
    turns = [(7, t, "user" if t % 2 else "assistant", f"t{t}", "") for t in range(25)]
    other = [(*x[:3], "changed" if x[1] >= 12 else x[3], "") for x in turns]
    frames = [spark.createDataFrame(x, TURNS) for x in (turns, other)]
    whole = {r.side: r.body for r in chat_format.format_preferences(*frames).collect()}
    parts = chat_format.format_preferences(*frames, part_turns=4).orderBy("part").collect()
    assert max(r.n_turns for r in parts) == 4
    for side, text in whole.items():
        assert "".join(r.body for r in parts if r.side == side) == text
    assert chat_format.format_preferences(*[f.limit(0) for f in frames]).count() == 0


RECORDS = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, digest string, url_key string"


def test_revisits_meet_the_latest_earlier_response(spark):
    full, seen = "response", "revisit"
    e = lambda tag, **more: {"etag": tag} | {k.replace("_", "-"): v for k, v in more.items()}
    rows = [
        (1, "http://www.A.com/x/#f", 10, full, e('"v1"', server="s", date="d1"), "d1", ""),
        (2, "https://a.com:443/x?utm_source=q", 20, full, e('"v2"', server="s2", date="d2"), "d2", ""),
        (3, "a.com/x", 15, seen, e('W/"v1"', date="new", server="no"), None, ""),
        (4, "http://a.com/x", 90_000, seen, e('"v2"'), None, ""),
        (5, "http://a.com/x", 90_001, seen, e('"v1"', date="own"), None, ""),
        (6, "http://a.com/x", 5, seen, e('"v1"'), None, ""),
        (7, "http://b.com/?b=2&a=1", 1, full, {}, "same", ""),
        (8, "http://b.com?a=1&b=2", 2, seen, None, "same", ""),
        (9, "http://b.com?a=1&b=2", 2, seen, {"last-modified": "x"}, None, ""),
        (10, None, 1, full, None, "n", ""),
        (11, None, 1, seen, None, "n", ""),
        (12, "http://a.com/x", None, seen, e('"v1"'), None, ""),
        (13, "http://c.com/p", 7, "metadata", None, None, ""),
        (4, "http://a.com/x", 90_000, seen, e('"v2"'), None, ""),
    ]
    docs = spark.createDataFrame(rows, RECORDS)
    for width in (86_400, 7, 10**9):  # with and without carrying across buckets
        got = warc_revisit.resolve(docs, width).collect()
        assert len(got) == 9
        by = {r.revisit_id: (r.response_id, r.verdict) for r in got}
        assert by == {
            3: (1, "resolved"), 4: (2, "resolved"), 5: (None, "mismatch"), 6: (None, "no_response"), 8: (7, "resolved"),
            9: (7, "unverified"), 11: (10, "resolved"), 12: (None, "no_response"),
        }
        heads = {r.revisit_id: r.headers for r in got}
        assert heads[3] == {"etag": 'W/"v1"', "date": "new", "server": "s"}
        assert heads[5] == {"etag": '"v1"', "date": "own"}
    assert warc_revisit.resolve(docs.limit(0)).count() == 0


def test_canonical_urls(spark):
    same = [
        ["http://www.Example.com/a/", "https://user@example.com:443/a?utm_source=x", "m.example.com/a#top", " http://example.com/a/index.html"],
        ["http://e.org?b=1&a=2", "https://e.org/?a=2&b=1&fbclid=9"],
        ["", None],
    ]
    for urls in same:
        rows = spark.createDataFrame([(u,) for u in urls], "url string")
        assert rows.select(warc_revisit.canonical(rows.url).alias("k")).distinct().count() == 1


@pytest.mark.parametrize("name", ["op5_preference_format", "op6_revisit_resolution", "op9_wu_manber", "op10_quality_rules"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from threadloom.llm import plans

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    got = plans.QUERIES[name](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_stages(spark, sf):
    """Every stage on what the stage before kept, against plain Python over the same rows."""
    import corpus_pipeline
    from test_dedup import brute_components, brute_spans
    from test_filters import brute_hits, brute_measures

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = [(str(r.item_id), r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_spans, corpus_pipeline.decontaminated, corpus_pipeline.tokens
    ]
    rows = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = {r.doc_id: r for r in stage(spark, spark.createDataFrame(list(rows.values()), docs.schema), sf).collect()}
        pairs = [(k, r.text) for k, r in sorted(rows.items())]
        if stage is corpus_pipeline.quality:
            for k, text in pairs:
                m = brute_measures(text)
                assert not (k in out and (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]))
            assert len(out) > 0.5 * len(rows)
        elif stage is corpus_pipeline.near_duplicates:
            assert set(out) == {k for k, _, c in brute_components([(k, t) for k, t in pairs], 5, 80) if k == c}
        elif stage is corpus_pipeline.repeated_spans:
            want = {k: kept.decode() for k, (kept, n, gone) in brute_spans(pairs).items() if gone < n}
            assert {k: r.text for k, r in out.items()} == want
            assert all(r.n_chars == len(r.text) for r in out.values())
        else:
            items = [(k, t.encode()) for k, t in bench]
            from threadloom.llm import decontaminate as dc

            tables = dc.compile_patterns(items)
            for k, text in pairs:
                words = dc.bench_words(text.encode())
                n = dc.covered(dc.search(words, tables)[0])
                assert (k in out) == (not (n > 0 and 20 * n >= len(words)))
            k, text = pairs[0]
            assert brute_hits(text.encode()[:600], items[:3])[1] == dc.covered(dc.search(dc.bench_words(text.encode()[:600]), dc.compile_patterns(items[:3]))[0])
        assert all(r.__fields__ == columns for r in out.values())
        rows = out
    done = corpus_pipeline.tokens(spark, spark.createDataFrame(list(rows.values()), docs.schema), sf).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(done) == len(rows)
    for r in done:
        assert r.ids == encoding.encode_ordinary(rows[r.doc_id].text)
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest()


def test_stages_of_an_empty_table(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
