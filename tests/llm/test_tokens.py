"""Byte-level BPE and token counts against the public libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from threadloom.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "ß", "日本", "12", ".", "!?", "'s", "'ll", "\x1c", "\x85", "\xa0", " ", "😀", "\x00"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    long_word = "".join(rng.choice("etaoinshrdlu") for _ in range(5_000))
    return ["", " ", "a", "<|endoftext|>", "x" * 3_000, "ab" * 600, long_word, *mixed]


def test_codec_equals_tiktoken(tiktoken_encoding):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    encoded = codec.encode(texts())
    for text, ids, back in zip(texts(), encoded, codec.decode(encoded), strict=True):
        assert list(memoryview(ids).cast("I")) == tiktoken_encoding.encode_ordinary(text)
        assert back == text.encode()


def test_memory_forgets_without_changing_results(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in texts()[:60] * 2:
        assert list(memoryview(codec.encode([text])[0]).cast("I")) == tiktoken_encoding.encode_ordinary(text)


def test_encode_and_decode_tables(spark, tiktoken_encoding):
    rows = [(1, "the end", "x", "y"), (1, "the end", "x", "y"), (None, None, None, None), (2, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(out.columns) == sorted(["doc_id", "text", "ids", "n_tokens"])
    back = bpe.decode(out, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"the end", b"the end"]
    assert [r.ids for r in back if r.doc_id == 1][0] == tiktoken_encoding.encode_ordinary("the end")
    odd = spark.createDataFrame([(None,), ([],), ([70_000, 0, None],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(odd, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b"", b"!"]
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_digest_query(spark, sf, tiktoken_encoding):
    from threadloom.llm import plans

    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = plans.QUERIES["op1_byte_bpe"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        ids = tiktoken_encoding.encode_ordinary(want[r.doc_id])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_token_count_query(spark, sf):
    from threadloom.llm import plans

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = plans.QUERIES["op3_token_counts"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n = len(tokenizer.encode(want[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_unusual_rows(spark, name):
    rows = [(1, "the end", "x", "y"), (2, "the end", "x", "y"), (1, "the end", "x", "y"), (None, None, None, None), (None, "a b", "", ""), (3, "", "", "")]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path(name)).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.n_bytes): r.n_tokens for r in got}
    assert by[(1, 7)] == by[(2, 7)] >= 2
    assert by[(None, 0)] == by[(3, 0)] == 0
    assert by[(None, 3)] > 0
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), public_tokenizers.path(name)).count() == 0


def test_cache_is_used_and_appended(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    first = spark.createDataFrame([(1, "one"), (2, "two two")], "doc_id bigint, text string")
    token_counts.token_counts(first, path, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # A count planted in the cache comes back: known digests are not encoded again.
    digest = hashlib.sha256(b"three").hexdigest()
    version = token_counts.tokenizer_digest(path)
    spark.createDataFrame([(digest, version, 77), (digest, "older tokenizer", 5)], token_counts.CACHE).write.mode("append").parquet(cache)
    more = spark.createDataFrame([(3, "three"), (4, "one"), (5, "four")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, path, cache).collect()}
    assert got == {3: 77, 4: 1, 5: 1}
    assert spark.read.parquet(cache).count() == 5
