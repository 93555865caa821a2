"""A gated recurrent language model: trained in numpy by truncated backpropagation, used for whole-document likelihoods.

Symbols are the words at or above a count threshold, an end mark and one symbol for all other words; their number grows with
the input (see FREQUENT and ROOTS).  The output is factored: softmax over
classes of symbols, then over the symbols of the class.  A word without a symbol of its own is the `other` symbol times its
share among such words, from counts over all training documents, so probabilities of all words add up to one.

Documents run in lanes; the state is carried from window to window to the end of a document and reset between documents.
Training runs in the tasks that hold the documents; the rounds share all training documents among them, so every document is
learned from once.  After each round the weights are averaged, weighted by tokens.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import hashes, ragged, raw, words_of
from threadloom.session import saved

#: Size of the state; lanes and steps of a window in scoring and in training.
STATE = 16
LANES, WINDOW = 512, 64
TRAIN_LANES, TRAIN_WINDOW = 64, 16
#: Rounds of training; in round r the weights learn from training documents whose crc32 div 5 is r modulo the rounds.
ROUNDS, RATE = 2, 0.08
#: Words with at least N / FREQUENT or sqrt(N) / ROOTS of N occurrences, and at least 2, have symbols and travel to every task (at
#: most FREQUENT or ROOTS * sqrt(N) of them, whichever is more); the rest are joined.
FREQUENT, ROOTS = 50_000, 8
#: In a window of training, symbols that come so often are added up one by one, rarer ones together.
OFTEN = 8
#: Scores of symbols that are worked on at once, some 256 KB of them.
TOGETHER = 1 << 16
#: Weights that are changed at once, so that they stay in the processor's cache.
PART = 1 << 14
#: Words counted together in a task, bytes of text scored together, and rows of weights sent together.
CHUNK, PIECE, SENT = 2_000_000, 8 << 20, 4096
#: The end mark takes a value that no word hash is left with.
END = np.uint64(0)


def tokens_of(text: bytes) -> np.ndarray:
    h = hashes(words_of(text))
    h[h == END] = np.uint64(1)
    return np.append(h, END)


class Weights(NamedTuple):
    inputs: np.ndarray  # (symbols + 1, 3 * state); the last row is the start of a document
    state: np.ndarray  # (state, 3 * state)
    to_class: np.ndarray  # (state, classes)
    class_bias: np.ndarray
    to_symbol: np.ndarray  # (state, symbols), columns ordered by class
    symbol_bias: np.ndarray


class Layout(NamedTuple):
    """The classes: symbols are numbered by class, class k holds the numbers [start[k], start[k + 1])."""

    start: np.ndarray
    of: np.ndarray


def layout(counts: np.ndarray, classes: int | None = None) -> Layout:
    """Neighbouring symbols in order of frequency, cut into classes of about equal mass, about the root of their number."""
    classes = classes or math.isqrt(len(counts) - 1) + 1
    mass = np.cumsum(counts + 1.0) / np.sum(counts + 1.0)
    of = np.minimum((mass - 1e-12) * classes, classes - 1).astype(np.int64)
    of = np.unique(of, return_inverse=True)[1]
    return Layout(np.append(np.searchsorted(of, np.arange(of[-1] + 1)), len(of)), of)


def initial(counts: np.ndarray, shape: Layout, size: int = STATE, seed: int = 7) -> Weights:
    """Small random weights, and biases that make the untrained model the unigram model."""
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.08, s).astype(np.float32)
    mass = np.bincount(shape.of, counts + 1.0)
    return Weights(
        small(len(counts) + 1, 3 * size),
        small(size, 3 * size),
        small(size, len(mass)) * 0.1,
        np.log(mass / mass.sum()).astype(np.float32),
        small(size, len(counts)) * 0.1,
        np.log((counts + 1.0) / mass[shape.of]).astype(np.float32),
    )


def halved(x: np.ndarray, n: int) -> np.ndarray:
    """A copy with the columns of the gates halved, as step() takes them."""
    x = x.copy()
    x[..., : 2 * n] *= 0.5
    return x


def step(x: np.ndarray, state: np.ndarray, h: np.ndarray):
    """One step of the gated unit for all lanes: the new state, and what backpropagation needs.

    `x` are the inputs' rows and `state` the weights of the state, both halved for the gates: they are 0.5 tanh(y / 2) + 0.5.
    """
    n = h.shape[1]
    g = h @ state
    gates = np.tanh(x[:, : 2 * n] + g[:, : 2 * n])
    gates *= 0.5
    gates += 0.5
    z, r, inner = gates[:, :n], gates[:, n:], g[:, 2 * n :]
    c = np.tanh(x[:, 2 * n :] + r * inner)
    h = h - c
    h *= z
    h += c
    return h, (z, r, inner, c)


def log_probabilities(w: Weights, shape: Layout, h: np.ndarray, symbol: np.ndarray, gradients: Weights | None = None):
    """Natural log of P(symbol | state) per row; with `gradients`, they are added up and the gradient of h is returned too."""
    rows = np.arange(len(symbol))
    group, widths = shape.of[symbol], np.diff(shape.start)
    x = h @ w.to_class
    x += w.class_bias
    x -= np.maximum.reduce(x, axis=1, keepdims=True)
    total = np.log(np.add.reduce(np.exp(x), axis=1))
    out = x[rows, group] - total
    if gradients is not None:
        x -= total[:, None]
        d = np.exp(x, out=x)
        d[rows, group] -= 1
        dh = d @ w.to_class.T
        gradients.to_class[...] += h.T @ d
        gradients.class_bias[...] += np.add.reduce(d, axis=0)
    # Rows are brought in the order of their classes once.  What has to be done class by class is done there, the rest for
    # the scores of several classes at once, which lie one after another.
    chosen = np.flatnonzero(widths[group] > 1)
    chosen = chosen[np.argsort(group[chosen], kind="stable")]
    mine, states = group[chosen], h[chosen]
    bounds = np.searchsorted(mine, np.arange(len(shape.start)))
    ends = np.cumsum(widths[mine])
    own = ends - widths[mine] + symbol[chosen] - shape.start[mine]
    of_symbol, back = np.zeros(len(chosen), out.dtype), None if gradients is None else np.zeros_like(states)
    for classes in _together(np.diff(bounds) * widths):
        first, last = bounds[classes[0]], bounds[classes[-1] + 1]
        at = ends[first] - widths[classes[0]]
        x, total = np.empty(ends[last - 1] - at, out.dtype), np.empty(last - first, out.dtype)
        parts = []
        for k in classes:
            (i, j), (a, b) = bounds[k : k + 2].tolist(), shape.start[k : k + 2].tolist()
            end = int(ends[j - 1] - at)
            of = slice(end - (j - i) * (b - a), end)
            scores = x[of].reshape(j - i, b - a)
            np.matmul(states[i:j], w.to_symbol[:, a:b], out=scores)
            scores += w.symbol_bias[a:b]
            scores -= np.maximum.reduce(scores, axis=1, keepdims=True)
            parts.append((i, j, a, b, of, scores))
        grown = np.exp(x)
        for i, j, _, _, of, scores in parts:
            np.add.reduce(grown[of].reshape(scores.shape), axis=1, out=total[i - first : j - first])
        np.log(total, out=total)
        of_symbol[first:last] = x[own[first:last] - at] - total
        if gradients is not None:
            for i, j, _, _, _, scores in parts:
                scores -= total[i - first : j - first, None]
            np.exp(x, out=x)
            x[own[first:last] - at] -= 1
            for i, j, a, b, _, d in parts:
                np.matmul(d, w.to_symbol[:, a:b].T, out=back[i:j])
                gradients.to_symbol[:, a:b] += states[i:j].T @ d
                gradients.symbol_bias[a:b] += np.add.reduce(d, axis=0)
    out[chosen] += of_symbol
    if gradients is None:
        return out
    dh[chosen] += back
    return out, dh


def _together(sizes: np.ndarray) -> Iterator[list[int]]:
    """The numbers of the sizes above zero, in order, in runs of sizes that add up to about TOGETHER."""
    run, held = [], 0
    for k in np.flatnonzero(sizes).tolist():
        if run and held + sizes[k] > TOGETHER:
            yield run
            run, held = [], 0
        run.append(k)
        held += sizes[k]
    if run:
        yield run


class Lanes(NamedTuple):
    """Documents one after another in lanes, longest lane first: the symbols, those before them, the document, its first step."""

    symbol: np.ndarray  # (steps, lanes)
    previous: np.ndarray
    document: np.ndarray
    first: np.ndarray
    length: np.ndarray  # of each lane

    def live(self) -> np.ndarray:
        """How many lanes reach each step; they are the first ones."""
        return np.searchsorted(-self.length, -np.arange(len(self.symbol)), "left")


def pack(documents: list[np.ndarray], lanes: int, start: int) -> Lanes:
    """Put each document on the lane that is shortest so far, the longest document first."""
    lanes = max(1, min(lanes, len(documents)))
    heap = [(0, i) for i in range(lanes)]
    members: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(documents)), key=lambda d: (-len(documents[d]), d)):
        size, lane = heapq.heappop(heap)
        members[lane].append(d)
        heapq.heappush(heap, (size + len(documents[d]), lane))
    length = np.array([sum(len(documents[d]) for d in m) for m in members])
    order = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    symbol = np.zeros((steps, lanes), np.int32)
    previous, document, first = np.full_like(symbol, start), np.zeros_like(symbol), np.zeros((steps, lanes), bool)
    for column, lane in enumerate(order):
        at = 0
        for d in members[lane]:
            s = documents[d]
            symbol[at : at + len(s), column] = s
            previous[at + 1 : at + len(s), column] = s[:-1]
            document[at : at + len(s), column] = d
            first[at, column] = True
            at += len(s)
    return Lanes(symbol, previous, document, first, length[order])


def score(w: Weights, shape: Layout, documents: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Natural log-likelihood of every document, all of its symbols, the state carried across windows."""
    total = np.zeros(len(documents))
    if not documents:
        return total
    packed = pack(documents, lanes, len(w.inputs) - 1)
    starts, live = packed.first.any(axis=1), packed.live()
    n = w.state.shape[0]
    inputs, state = halved(w.inputs, n), halved(w.state, n)
    h = np.zeros((packed.symbol.shape[1], n), np.float32)
    for begin in range(0, len(packed.symbol), window):
        span = slice(begin, begin + window)
        states = []
        for t in range(begin, min(begin + window, len(packed.symbol))):
            h = _begun(h[: live[t]], packed.first[t], starts[t])
            h, _ = step(inputs[packed.previous[t, : live[t]]], state, h)
            states.append(h)
        there = np.arange(packed.symbol.shape[1]) < live[span, None]
        lp = log_probabilities(w, shape, np.concatenate(states), packed.symbol[span][there])
        total += np.bincount(packed.document[span][there], lp, minlength=len(total))
    return total


def _begun(h: np.ndarray, first: np.ndarray, any_first: bool) -> np.ndarray:
    """The states with those of lanes on which a document begins set to zero."""
    return np.where(first[: len(h), None], np.float32(0), h) if any_first else h


def _summed_by(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row p of the result adds up the rows of `values` whose place is p < n, one after another; every place occurs."""
    order = np.argsort(place, kind="stable")
    begin = np.searchsorted(place[order], np.arange(n))
    count = np.diff(begin, append=len(place))
    by_count = np.argsort(-count, kind="stable")
    begin, count = begin[by_count], count[by_count]
    # Places that come often are summed on their own, the others together, the second row of each, the third and so on.
    sums = values[order[begin]]
    often = int(np.searchsorted(-count, -OFTEN))
    for i, (b, c) in enumerate(zip(begin[:often].tolist(), count[:often].tolist(), strict=True)):
        sums[i] = np.add.reduce(values[order[b : b + c]], axis=0)
    for k in range(1, OFTEN):
        some = int(np.searchsorted(-count, -k))
        if some > often:
            sums[often:some] += values[order[begin[often:some] + k]]
    out = np.empty_like(sums)
    out[by_count] = sums
    return out


def train(w: Weights, shape: Layout, documents: list[np.ndarray], lanes: int = TRAIN_LANES, window: int = TRAIN_WINDOW) -> Weights:
    """One pass of truncated backpropagation over the documents, with Adagrad; returns the new weights."""
    w = Weights(*[x.copy() for x in w])
    squares = [np.full_like(x, 1e-4) for x in w]
    if not documents:
        return w
    packed = pack(documents, lanes, len(w.inputs) - 1)
    starts, live = packed.first.any(axis=1), packed.live()
    g = Weights(*[np.zeros_like(x) for x in w])
    scratch = np.empty((2, PART), w.state.dtype)
    used = np.zeros(0, np.int64)
    n, width = w.state.shape[0], packed.symbol.shape[1]
    # What the steps of a window leave for backpropagation, by step and lane.
    before, after, z, r, inner, c = (np.zeros((window, width, n), w.state.dtype) for _ in range(6))
    gates, inward = (np.zeros((window, width, 3 * n), w.state.dtype) for _ in range(2))
    h = np.zeros((width, n), np.float32)
    for begin in range(0, len(packed.symbol), window):
        span = slice(begin, begin + window)
        lengths = live[span].tolist()
        size = len(lengths)
        x, state = halved(w.inputs[packed.previous[span]], n), halved(w.state, n)
        for i, m in enumerate(lengths):
            before[i, :m] = h = _begun(h[:m], packed.first[begin + i], starts[begin + i])
            h, kept = step(x[i, :m], state, h)
            after[i, :m], z[i, :m], r[i, :m], inner[i, :m], c[i, :m] = h, *kept
        g.inputs[used] = 0
        for part in g[1:]:
            part.fill(0)
        there = np.arange(width) < live[span, None]
        full = lengths[-1] == width
        symbols = packed.symbol[span][there]
        _, dh = log_probabilities(w, shape, after[:size].reshape(-1, n) if full else after[:size][there], symbols, g)
        not_z, not_r, bent, apart = 1 - z, 1 - r, 1 - c * c, before - c
        carried = np.zeros((0, n), np.float32)
        end = len(symbols)
        # The steps of a window are kept from the last to the first, the order in which their gradients are added.
        for i in range(size - 1, -1, -1):
            m, k = lengths[i], size - 1 - i
            d = dh[end - m : end]
            end -= m
            d[: len(carried)] += carried
            dz, dr, dc = gates[k, :m, :n], gates[k, :m, n : 2 * n], gates[k, :m, 2 * n :]
            np.multiply(d, not_z[i, :m], out=dc)
            dc *= bent[i, :m]
            np.multiply(d, apart[i, :m], out=dz)
            dz *= z[i, :m]
            dz *= not_z[i, :m]
            np.multiply(dc, inner[i, :m], out=dr)
            dr *= r[i, :m]
            dr *= not_r[i, :m]
            into = inward[k, :m]
            into[:, : 2 * n] = gates[k, :m, : 2 * n]
            np.multiply(dc, r[i, :m], out=into[:, 2 * n :])
            g.state[...] += before[i, :m].T @ into
            d *= z[i, :m]
            d += into @ w.state.T
            carried = _begun(d, packed.first[begin + i], starts[begin + i])
        there = there[::-1]
        used, place = np.unique(packed.previous[span][::-1][there], return_inverse=True)
        rows = _summed_by(place, gates[:size].reshape(-1, 3 * n) if full else gates[:size][there], len(used))
        scale = np.sqrt(len(symbols))
        g.inputs[used] = rows = rows / scale
        squares[0][used] += rows * rows
        w.inputs[used] -= RATE * rows / np.sqrt(squares[0][used])
        # Dividing by a power of two is exact in every width, and fastest in that of the weights.
        exact = math.frexp(scale)[0] == 0.5
        for whole in zip(w[1:], g[1:], squares[1:], strict=True):
            for at in range(0, whole[0].size, PART):
                x, dx, s = (y.reshape(-1)[at : at + PART] for y in whole)
                moved, root = scratch[:, : len(x)]
                dx /= dx.dtype.type(scale) if exact else scale
                s += np.multiply(dx, dx, out=moved)
                np.multiply(dx, RATE, out=moved)
                moved /= np.sqrt(s, out=root)
                x -= moved
    return w


def table_of(w: Weights) -> np.ndarray:
    """All weights as rows: what belongs to one symbol in one row, the rest behind them in rows of the same width."""
    n, v = w.to_symbol.shape
    own = np.zeros((v + 1, 4 * n + 1), w.inputs.dtype)
    own[:, : 3 * n] = w.inputs
    own[:v, 3 * n : 4 * n] = w.to_symbol.T
    own[:v, 4 * n] = w.symbol_bias
    rest = np.concatenate([w.state.ravel(), w.to_class.ravel(), w.class_bias])
    return np.concatenate([own, np.pad(rest, (0, -len(rest) % own.shape[1])).reshape(-1, own.shape[1])])


def from_table(rows: np.ndarray, like: Weights) -> Weights:
    n, v = like.to_symbol.shape
    rest, sizes = rows[v + 1 :].ravel(), np.cumsum([like.state.size, like.to_class.size, like.class_bias.size])
    state, to_class, class_bias = np.split(rest[: sizes[-1]], sizes[:-1])
    parts = [rows[: v + 1, : 3 * n], state.reshape(like.state.shape), to_class.reshape(like.to_class.shape), class_bias, rows[:v, 3 * n : 4 * n].T, rows[:v, 4 * n]]
    return Weights(*[np.ascontiguousarray(x, np.float32) for x in parts])


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w])


class Model(NamedTuple):
    """Everything a task needs: weights, the numbering of symbols, the frequent words and the totals."""

    weights: Weights
    shape: Layout
    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    symbols: np.ndarray  # of each frequent word
    other: int
    n: int  # training tokens
    v: int  # distinct training tokens
    tail_n: int  # the same among words without a symbol
    tail_v: int

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the frequent words, and whether the word is one of them."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 1


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in the column `text`, counted in the task before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "c"])

        for batch in batches:
            for text in raw(batch.column("text")):
                held.append(tokens_of(text.as_py()))
                n += len(held[-1])
                if n > CHUNK:
                    yield flush()
                    held, n = [], 0
        yield flush()

    return texts.mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the training part of `docs`, and the counts (word, c) of all its tokens."""
    spark = docs.sparkSession
    part = docs.where(~held_out(key)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = saved(count_words(part.select("text")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(2, min(-(-n // FREQUENT), math.isqrt(n) // ROOTS))
    frequent = counts.where(F.col("c") >= least).toPandas()
    word, c = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["c"].to_numpy(np.int64)
    if END not in word:
        ends = counts.where("word = 0").select("c").first()
        word, c = np.append(word, END), np.append(c, ends.c if ends else 0)
    rank = np.lexsort((word, -c))
    tail_n, tail_v = int(n - c[rank].sum()), int(max(0, v - np.sum(c[rank] > 0)))
    mass = np.append(c[rank], tail_n).astype(float)
    place = np.lexsort((np.arange(len(mass)), -mass))
    number = np.empty(len(mass), np.int64)
    number[place] = np.arange(len(mass))
    other = int(number[-1])
    symbols = np.empty(len(word), np.int64)
    symbols[rank] = number[:-1]
    shape = layout(mass[place])
    order = np.argsort(word)
    model = Model(initial(mass[place], shape), shape, word[order], c[order], symbols[order], other, int(n), int(v), tail_n, tail_v)
    crc = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")))
    for r in range(rounds):
        share = part.where(F.floor(crc / 5) % rounds == r).select("text")
        rows = share.mapInArrow(_trainer(model), "row int, change array<float>, weight double")
        got = rows.repartition("row").mapInArrow(_summed, "row int, change array<float>").toArrow()
        if got.num_rows:
            values = table_of(model.weights)
            change = got.column("change").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
            values[got.column("row").to_numpy()] += change
            model = model._replace(weights=from_table(values, model.weights))
    return model, counts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Stretches of a batch with about PIECE bytes of text, and their tokens."""
    for batch in batches:
        held, size, begin = [], 0, 0
        for i, text in enumerate(raw(batch.column("text"))):
            body = text.as_py()
            held.append(tokens_of(body))
            size += len(body)
            if size > PIECE or i == batch.num_rows - 1:
                yield batch, begin, held
                held, size, begin = [], 0, i + 1


def _trainer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = model.weights, 0
        for _, _, tokens in _pieces(batches):
            documents = []
            for h in tokens:
                at, known = model.look_up(h)
                documents.append(np.where(known, model.symbols[at], model.other))
                n += len(h)
            w = train(w, model.shape, documents)
        change = table_of(w) - table_of(model.weights)
        rows = np.flatnonzero(change.any(axis=1))
        for at in range(0, len(rows), SENT):
            some = rows[at : at + SENT]
            sizes = [change.shape[1]] * len(some)
            columns = [pa.array(some, pa.int32()), ragged(change[some].ravel(), sizes, pa.float32()), pa.array(np.full(len(some), float(n)))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "change", "weight"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each row of the weights, over the tasks that changed it, weighted by their tokens."""
    sums: dict[int, np.ndarray] = {}
    weights: Counter[int] = Counter()
    for batch in batches:
        change = batch.column("change").flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
        for row, x, weight in zip(batch.column("row").to_pylist(), change, batch.column("weight").to_pylist(), strict=True):
            sums[row] = sums[row] + x * weight if row in sums else x * weight
            weights[row] += weight
    if sums:
        means = np.stack([x / weights[row] for row, x in sums.items()]).astype(np.float32)
        columns = [pa.array(list(sums), pa.int32()), ragged(means.ravel(), [means.shape[1]] * len(means), pa.float32())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "change"])


def _scorer(model: Model):
    base_all = np.log10(model.n + 0.5 * (model.v + 1))
    base_tail = np.log10(model.tail_n + 0.5 * (model.tail_v + 1))
    logs = np.log10(model.counts + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = TaskContext.get().partitionId() << 33
        for batch, begin, tokens in _pieces(batches):
            documents, rows, rare, times = [], [], [], []
            for h in tokens:
                at, known = model.look_up(h)
                symbol = np.where(known, model.symbols[at], model.other)
                documents.append(symbol)
                seen = logs[at[known]].sum()
                words, counts = np.unique(h[~known], return_counts=True)
                rare.append(words)
                times.append(counts)
                rows.append((len(h), int((model.counts[at[known]] > 0).sum()), seen - len(h) * base_all, -np.sum(~known) * base_tail))
            neural = score(model.weights, model.shape, documents) / np.log(10)
            size, known, base, tail = zip(*rows, strict=True)
            lists = [len(x) for x in rare]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(mark, mark + len(rows))),
                    batch.column("key").slice(begin, len(rows)),
                    batch.column("held_out").slice(begin, len(rows)),
                    pa.array(size, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(neural + np.array(tail), pa.float64()),
                    ragged(np.concatenate(rare).view(np.int64), lists, pa.int64()),
                    ragged(np.concatenate(times).astype(np.int32), lists, pa.int32()),
                ],
                ["mark", "key", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )
            mark += len(rows)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 of the whole text.

    Null texts count as empty: one token, the end.  A null key is hashed like the empty string.  Repeated rows are scored
    each.  Without training documents every count is 0.  Other columns are not read.

    Frequent words are looked up in the task; the others of each document, once per document, are joined with their counts.
    """
    model, counts = fit(docs, key, text, rounds)
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"mark bigint, key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double,"
        " rare array<bigint>, times array<int>"
    )
    scored = saved(rows.mapInArrow(_scorer(model), schema), "scored")
    rare = scored.select("mark", F.explode(F.arrays_zip("rare", "times")).alias("z"))
    rare = rare.select("mark", F.col("z.rare").alias("word"), F.col("z.times").alias("times")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("mark").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(sums, "mark", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
