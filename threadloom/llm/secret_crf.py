"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans the patterns miss.

Tokens are runs of letters, digits, `+ / _ -` and non-ASCII bytes, and single marks; each is tagged as the begin of a secret,
inside one, or outside.  A tag's score is a sum of weights of the token (shape, length, digits, distinct characters, word), of
its neighbours (words and shapes) and of the file (source, language, size), plus a weight for each pair of adjacent tags.  The
field is trained by its exact likelihood on windows around what the patterns find and on windows without a find; the patterns
themselves are no features, so what looks and stands like a secret is found in other dresses too.

Decoding is Viterbi over whole texts and exact: where a token's best score inside a secret, plus the most that any pair of
neighbours can add to it, stays below nought, every best path is outside there, and the text falls into independent stretches.
Everything up to that point is numpy over distinct tokens of a few megabytes of text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import mixed, raw, slices
from threadloom.session import saved

#: Fixed patterns of the base spans, in the order of their kinds; letters of the first one are matched in either case.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")

#: The field is trained on at most so many windows with a find and so many without, those of least hash, and on at most
#: PER_DOCUMENT windows of one document.  Windows of WINDOW tokens.
SAMPLE_WINDOWS = 2_000
PER_DOCUMENT = 4
WINDOW = 24
#: Documents of this remainder of crc32(doc_id) by 5 are kept out of training.
HELD_OUT = 1
BUCKETS = 1 << 16
ROUNDS = 50
RATE = 0.1
DECAY = 1e-3
PIECE_BYTES = 4 << 20
#: A worker remembers the scores of distinct tokens up to about so many bytes.
REMEMBERED_BYTES = 24 << 20

OUT, BEGIN, INSIDE = 0, 1, 2


# -- fixed patterns ----------------------------------------------------------------------------------------------------------


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' finds, in bytes; leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A maximal run of 24 digits or more is what a shorter pattern finds and then keeps.
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


# -- tokens --------------------------------------------------------------------------------------------------------------------

_CLASS = np.full(256, 2, np.uint8)  # marks
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = 1


@dataclass
class Tokens:
    """Tokens of a piece of a table: bounds in the joined bytes, number of the distinct token, bounds of each text's tokens."""

    start: np.ndarray
    end: np.ndarray
    which: np.ndarray
    distinct: list[bytes]
    text_at: np.ndarray
    first: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    text_at = offsets - low
    if high == low:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, [], text_at, np.zeros(len(texts) + 1, np.int64))
    data = texts.buffers()[2].slice(low, high - low)
    kind = _CLASS[np.frombuffer(data, np.uint8)]
    cut = np.empty(len(kind), bool)
    cut[0] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut[text_at[:-1][text_at[:-1] < len(kind)]] = True
    bounds = np.append(np.flatnonzero(cut), len(kind))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), data])
    coded = pieces.dictionary_encode()
    keep = np.flatnonzero(kind[bounds[:-1]])
    start = bounds[keep]
    return Tokens(start, bounds[keep + 1], coded.indices.to_numpy()[keep], coded.dictionary.to_pylist(), text_at, np.searchsorted(start, text_at))


# -- features ------------------------------------------------------------------------------------------------------------------

_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0x75 if c >= 0x80 else c for c in range(256))
_REPEATED = re.compile(rb"(.)\1+", re.DOTALL)
_BLANK = b""
OWN, PREVIOUS, BEFORE, NEXT, FILE = 8, 2, 1, 2, 3


def _buckets(templates: tuple[int, ...], values: np.ndarray) -> np.ndarray:
    """One column of buckets per template."""
    with np.errstate(over="ignore"):
        return (mixed(values[:, None] + np.array(templates, np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.int64)


def token_features(tokens: list[bytes]) -> np.ndarray:
    """Buckets of each token: OWN as the one tagged, PREVIOUS, BEFORE (the one before that), NEXT; a blank stands outside texts."""
    facts = np.empty((len(tokens), 6), np.int64)
    hashed = np.empty((len(tokens), 3), np.uint64)
    for i, token in enumerate(tokens):
        shown = token[:256].translate(_SHAPE)
        facts[i] = len(token), len(token) - len(token.translate(None, b"0123456789")), len(set(token)), len(set(shown)), not token.strip(b"0123456789abcdefABCDEF"), 0
        hashed[i] = zlib.crc32(_REPEATED.sub(rb"\1", shown)[:24]), zlib.crc32(token.lower()[:24]), zlib.crc32(token[:4])
    n, digits, distinct, kinds, hexadecimal, _ = facts.T
    log = np.log2(np.maximum(n, 1))
    short = np.minimum(n, 64) // 8
    sized = np.stack([3 * log, 4 * digits // np.maximum(n, 1), np.minimum(distinct, 40) // 4 * 64 + log, kinds * 16 + short, hexadecimal * 16 + short])
    own = [_buckets((1 + k,), row.astype(np.uint64)) for k, row in enumerate(sized)]
    shape, word, start = hashed.T
    own += [_buckets((10,), shape), _buckets((11,), word), _buckets((12,), start)]
    return np.hstack([*own, _buckets((13,), word), _buckets((14,), shape), _buckets((15,), word), _buckets((16,), word), _buckets((17,), shape)])


def file_features(sources: list, languages: list, sizes: list[int]) -> np.ndarray:
    names = np.array([[zlib.crc32(str(x).encode()), zlib.crc32(str(y).encode())] for x, y in zip(sources, languages)], np.uint64).reshape(-1, 2)
    log = np.array([n.bit_length() for n in sizes], np.uint64)
    return np.hstack([_buckets((20,), names[:, 0]), _buckets((21,), names[:, 1]), _buckets((22,), log)])


# -- the field -----------------------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """weights (BUCKETS, 2): begin and inside against outside; pairs (3, 3): from a tag to the next; a text starts after outside."""

    weights: np.ndarray
    pairs: np.ndarray

    def slack(self) -> float:
        """The most that neighbours can add to a tag inside a secret, compared with outside."""
        after = np.vstack([self.pairs.T, np.zeros(3)])  # one row per following tag, and the end
        return float(max((self.pairs[:, y] - self.pairs[:, OUT]).max() + (after[:, y] - after[:, OUT]).max() for y in (BEGIN, INSIDE)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(field: Field, features: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood per window with its gradients: features (n, t, k) buckets, tags (n, t) with -1 behind the end."""
    n, t, _ = features.shape
    scores = np.zeros((n, t, 3))
    scores[:, :, 1:] = field.weights[features].sum(axis=2)
    real = tags >= 0
    alpha = np.zeros((n, t, 3))
    alpha[:, 0] = field.pairs[OUT] + scores[:, 0]
    for i in range(1, t):
        step = _log_sum(alpha[:, i - 1, :, None] + field.pairs[None], 1) + scores[:, i]
        alpha[:, i] = np.where(real[:, i, None], step, alpha[:, i - 1])
    beta = np.zeros((n, t, 3))
    for i in range(t - 2, -1, -1):
        step = _log_sum(field.pairs[None] + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(real[:, i + 1, None], step, 0)
    total = _log_sum(alpha[:, -1], 1)
    likely = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
    seen = np.eye(3)[np.where(real, tags, 0)] * real[:, :, None]
    moved = (seen - likely)[:, :, 1:] / n
    used, size = features[real].ravel(), len(field.weights)
    gradient = np.stack([np.bincount(used, np.repeat(moved[real][:, y], features.shape[2]), size) for y in (0, 1)], axis=1)
    before = np.concatenate([np.zeros((n, 1), int), tags[:, :-1]], axis=1)
    steps = np.zeros((3, 3))
    np.add.at(steps, (before[real], tags[real]), 1.0)
    steps[OUT] -= likely[:, 0].sum(axis=0)
    for i in range(1, t):
        both = alpha[:, i - 1, :, None] + field.pairs[None] + (scores[:, i] + beta[:, i])[:, None, :] - total[:, None, None]
        steps -= (np.exp(both) * real[:, i, None, None]).sum(axis=0)
    path = (scores * seen).sum(axis=(1, 2)) + np.where(real, field.pairs[before, np.where(real, tags, 0)], 0).sum(axis=1)
    return float((path - total).mean()), gradient, steps / n


def fit(features: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Gradient ascent with adaptive rates (moment estimates), shrinking weights a little in each round."""
    weights = np.zeros((BUCKETS, 2))
    if not len(tags):
        return Field(weights, np.zeros((3, 3)))
    # Only the buckets met are moved.
    met, features = np.unique(features, return_inverse=True)
    features = features.reshape(*tags.shape, -1)
    field = Field(np.zeros((len(met), 2)), np.zeros((3, 3)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weights, field.pairs)]
    for k in range(1, rounds + 1):
        _, *gradients = likelihood(field, features, tags)
        for p, g, (m, v) in zip((field.weights, field.pairs), gradients, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += RATE * (m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) - DECAY * p)
    weights[met] = field.weights
    return Field(weights, field.pairs)


def viterbi(scores: np.ndarray, pairs: np.ndarray) -> list[int]:
    """The best tags of one stretch that follows a tag outside; equal paths prefer outside, then begin."""
    best, back = pairs[OUT] + scores[0], []
    for row in scores[1:]:
        step = best[:, None] + pairs
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


# -- windows for training ------------------------------------------------------------------------------------------------------


def _tagged(t: Tokens, i: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of the tokens of text i: the first token that a find covers begins it."""
    a, b = t.first[i], t.first[i + 1]
    tags = np.zeros(b - a, np.int8)
    for start, end, _ in spans:
        at = np.arange(np.searchsorted(t.end[a:b], t.text_at[i] + start, "right"), np.searchsorted(t.start[a:b], t.text_at[i] + end))
        fresh = at[tags[at] == OUT]
        if len(fresh):
            tags[fresh] = INSIDE
            if fresh[0] == 0 or tags[fresh[0] - 1] == OUT:
                tags[fresh[0]] = BEGIN
    return tags


def _windows(rate: int):
    """Training windows of Arrow batches (h, text, source, lang); of texts without a find those with h % rate = 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            out = []
            texts = raw(batch.column("text"))
            for i, h in enumerate(batch.column("h").to_pylist()):
                text = texts[i].as_py()
                spans = base_spans(text)
                if not spans and h % rate:
                    continue
                t = tokens_of(texts.slice(i, 1))
                n = len(t.start)
                if not n:
                    continue
                tags = _tagged(t, 0, spans)
                # Around finds; without one around what looks most like a secret: most digits, then longest, then first.
                digits = np.array([sum(map(x.count, b"0123456789")) for x in t.distinct])[t.which]
                centers = np.flatnonzero(tags == BEGIN) if spans else [*np.lexsort((t.start - t.end, -digits))[: PER_DOCUMENT - 1], h % n]
                own = token_features([_BLANK, *t.distinct])
                at = np.concatenate([[0, 0], t.which + 1, [0]])
                about = file_features([batch.column("source")[i].as_py()], [batch.column("lang")[i].as_py()], [len(text)])
                used = -1
                for no, c in enumerate(centers[:PER_DOCUMENT]):
                    a = max(0, int(c) - WINDOW // 3)
                    if a <= used and spans:
                        continue
                    # A window starts outside.
                    while spans and a > 0 and tags[a - 1] != OUT:
                        a -= 1
                    used = a
                    b = min(n, a + WINDOW)
                    k = np.arange(a, b)
                    rows = [own[at[k + 2], :8], own[at[k + 1], 8:10], own[at[k], 10:11], own[at[k + 3], 11:13], about.repeat(b - a, axis=0)]
                    out.append((not spans, h, no, np.hstack(rows).ravel().tolist(), tags[a:b].tolist()))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["plain", "h", "no", "features", "tags"])

    return cut


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang; a missing source or language is null."""
    other = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", F.col("text"), *other)


def train(docs: DataFrame) -> Field:
    """Fit the field on a bounded sample of windows; every document is searched for finds, held-out ones are not."""
    rows = _columns(docs).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != HELD_OUT)
    rows = rows.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), "text", "source", "lang")
    # A document without a find gives PER_DOCUMENT windows; twice as many as asked for are cut.
    rate = max(1, docs.count() * PER_DOCUMENT // (2 * SAMPLE_WINDOWS))
    windows = saved(rows.mapInArrow(_windows(rate), "plain boolean, h bigint, no int, features array<int>, tags array<tinyint>"), "windows")
    parts = [windows.where(which).orderBy("h", "no", F.hash("features")).limit(SAMPLE_WINDOWS).toArrow() for which in ("plain", "NOT plain")]
    width = OWN + PREVIOUS + BEFORE + NEXT + FILE
    features, tags = [], []
    for part in parts:
        for f, y in zip(part.column("features").to_pylist(), part.column("tags").to_pylist()):
            features.append(f + [0] * (WINDOW * width - len(f)))
            tags.append(y + [-1] * (WINDOW - len(y)))
    return fit(np.array(features, np.int64).reshape(-1, WINDOW, width), np.array(tags, np.int64).reshape(-1, WINDOW))


# -- tagging whole texts -------------------------------------------------------------------------------------------------------


class _Memory:
    """Sums of weights of distinct tokens in their four roles; forgets everything when it has grown too large."""

    def __init__(self, field: Field):
        self.weights, self.at, self.held = field.weights, {}, 0
        self.rows = self.fresh([_BLANK])

    def fresh(self, tokens: list[bytes]) -> np.ndarray:
        w = self.weights[token_features(tokens)]
        return np.hstack([w[:, a:b].sum(axis=1) for a, b in ((0, 8), (8, 10), (10, 11), (11, 13))])

    def scores(self, distinct: list[bytes]) -> np.ndarray:
        """One row per token and one for the blank."""
        if self.held > REMEMBERED_BYTES:
            self.at, self.held, self.rows = {}, 0, self.rows[:1]
        new = [x for x in distinct if x not in self.at]
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.held += sum(map(len, new)) + 200 * len(new)
        self.rows = np.vstack([self.rows, self.fresh(new)])
        return self.rows[[*map(self.at.__getitem__, distinct), 0]]


def tag(field: Field, memory: _Memory, t: Tokens, about: np.ndarray) -> list[list[tuple[int, int]]]:
    """Bounds (in bytes of their text) of what the field finds in each text; about: file scores of each text."""
    n_texts = len(t.first) - 1
    found: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    if not len(t.start):
        return found
    rows = memory.scores(t.distinct)
    which, n = t.which.astype(np.int64), len(t.which)
    text = np.repeat(np.arange(n_texts), np.diff(t.first))
    starts = t.first[:-1][np.diff(t.first) > 0]
    blank = len(rows) - 1
    before, earlier, after = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    before[1:], before[0] = which[:-1], blank
    before[starts] = blank
    earlier[1:], earlier[0] = before[:-1], blank
    earlier[starts] = blank
    after[:-1], after[-1] = which[1:], blank
    after[starts[1:] - 1] = blank
    scores = rows[which, 0:2] + rows[before, 2:4] + rows[earlier, 4:6] + rows[after, 6:8] + about[text]
    open_ = np.flatnonzero(scores.max(axis=1) + field.slack() >= 0)
    if not len(open_):
        return found
    breaks = np.flatnonzero((np.diff(open_) > 1) | (text[open_[1:]] != text[open_[:-1]])) + 1
    for run in np.split(open_, breaks):
        tags = viterbi(np.column_stack([np.zeros(len(run)), scores[run]]), field.pairs)
        at = None
        for k, y in enumerate([*tags, OUT]):
            if at is not None and y != INSIDE:
                i = text[run[at]]
                found[i].append((int(t.start[run[at]] - t.text_at[i]), int(t.end[run[k - 1]] - t.text_at[i])))
                at = None
            if y == BEGIN or (y == INSIDE and at is None):
                at = k
    return found


def spans_of(text: bytes, added: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of the field that touch none of them, in code points, by start and kind."""
    spans = base_spans(text)
    fixed = list(spans)
    spans += [(a, b, 3) for a, b in added if not any(s < b and a < e for s, e, _ in fixed)]
    if spans and not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        spans = [(int(points[a]), int(points[b]), k) for a, b, k in spans]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _search(field: Field):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(field)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text", PIECE_BYTES):
            texts = raw(batch.column("text"))
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)).tolist()
            about = field.weights[file_features(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), sizes)].sum(axis=1)
            added = tag(field, memory, tokens_of(texts), about)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans_of(x.as_py(), more)] for x, more in zip(texts, added)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return search


def secret_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs(doc_id, text[, source, lang]) -> (doc_id, spans array<struct<kind, start, end>>), one row per row.

    Ends are exclusive, positions are code points.  A null text is an empty one and has no spans; repeated rows are searched
    each for itself; other columns are ignored.  Without any find to learn from (an empty table) the field adds nothing.
    """
    rows = _columns(docs)
    field = field or train(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(_search(field), schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
