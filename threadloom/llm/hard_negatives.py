"""Hard negatives by exact search in an inverted multi-index.

A vector is cut into two halves, each with a codebook of its own; a pair of codewords is a cell.  For an anchor, a half can
score at most its product with the codeword plus its length times the codeword's radius (the largest distance of any row from
its codeword), so the sum of the two bounds a whole cell.  A heap walks the cells by falling bound (the multi-sequence order).
A search asks for windows of scores; a window is certified, and its search stops, when the bound of the next cell is below
what could still enter it: below its k-th best row so far, or below its lower end.  Nothing is approximate: the codebooks
decide how early a search stops and never what it finds.

Rounds run as Spark jobs.  Each round deals out the next cells of every open anchor, four times as many as before.  Rows lie in
blocks by cell, written once: small cells share a block, and a cell with a third of all rows (or a vector that everyone has) is
many blocks.  Anchors lie in blocks with the cells dealt to them.  All pairs of blocks meet (functions/blocks.py); a task holds a
block of anchors, scores the rows of the cells that they visit in matrix products, and keeps the k best of each window.  So a
round writes one row per anchor, not one per anchor and cell.  Every round is written to the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.blocks import Pairs, in_pairs, packed, rows_of
from threadloom.session import saved

#: The codebooks are fitted on at most so many rows, those of least hash of the id.  All rows are indexed.
SAMPLE_ROWS = 16_384
#: Rows of a cell on average, as long as a half has no more than MOST_CODES codewords.
CELL_ROWS = 256
MOST_CODES = 256
FIT_ROUNDS = 12
#: A tile has about so many rows and at most so many anchors; anchors and cells of a block have MARKS pairs at most.
TILE_ROWS = 8_192
TILE_ANCHORS = 2_048
MARKS = 1 << 25
#: Anchors whose cells are dealt, or whose scores are formed, at once.
ANCHORS_AT_ONCE = 256
FIRST_CELLS = 16
#: Components floor(256 x) saturate here, so that a score of up to 2,048 of them fits a long.
LARGEST = 1 << 26

POSITIVES = 5
NEGATIVES = 3


def vectors(rows: DataFrame) -> DataFrame:
    """rows(vec_id, label, embedding) -> (vec_id, label, v): integer components of the rows that take part.

    Rows with a null id, label or vector and rows with a null or non-finite component take no part.  Repeated rows count
    once; of different rows with one id the one of the smallest label, then of the smallest vector, counts.
    """
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * 256))).cast("int"))
    kept = rows.where(sound & F.coalesce(finite, F.lit(False))).select("vec_id", F.struct(F.col("label").cast("int").alias("label"), whole.alias("v")).alias("r"))
    return kept.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.*")


# -- index -----------------------------------------------------------------------------------------------------------------


def _padded(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of `dim` numbers; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _fitted(points: np.ndarray, codes: int) -> np.ndarray:
    """Codewords of one half by Lloyd's rounds; each start is the row farthest from the earlier ones, which keeps radii small."""
    distinct = np.unique(points, axis=0)
    codes = min(codes, len(distinct))
    chosen, gap = [0], np.full(len(distinct), np.inf)
    while len(chosen) < codes:
        gap = np.minimum(gap, ((distinct - distinct[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    centers = distinct[chosen]
    for _ in range(FIT_ROUNDS):
        nearest = _nearest(points, centers)[0]
        counts = np.bincount(nearest, minlength=codes)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nearest = ((centers * centers).sum(axis=1)[None, :] - 2 * points @ centers.T).argmin(axis=1)
    return nearest, np.sqrt(((points - centers[nearest]) ** 2).sum(axis=1))


class Index:
    """Blocks of rows(vec_id, label, v, cell) in the shared folder; codebooks, radii and row counts of the cells (bounded by MOST_CODES)."""

    def __init__(self, rows: DataFrame):
        facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
        self.dim, self.cut = facts["dim"], (facts["dim"] + 1) // 2
        codes = int(np.clip(round((facts["n"] / CELL_ROWS) ** 0.5), 1, MOST_CODES))
        sample = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
        points = _padded(sample.column("v"), self.dim)
        if not len(points):
            points = np.zeros((1, self.dim))
        books = _fitted(points[:, : self.cut], codes), _fitted(points[:, self.cut :], codes)
        dim, cut = self.dim, self.cut

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _padded(b.column("v"), dim)
                (c1, d1), (c2, d2) = _nearest(x[:, :cut], books[0]), _nearest(x[:, cut:], books[1])
                made = [pa.array(c, t) for c, t in ((c1, pa.int32()), (c2, pa.int32()), (d1, pa.float64()), (d2, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "c1", "c2", "d1", "d2"])

        dealt = saved(rows.mapInArrow(assign, "vec_id bigint, label int, v array<int>, c1 int, c2 int, d1 double, d2 double"), "cells")
        self.books, self.radii = books, []
        for book, code, far in ((books[0], "c1", "d1"), (books[1], "c2", "d2")):
            radius = np.zeros(len(book))
            for r in dealt.groupBy(code).agg(F.max(far).alias("r")).toLocalIterator():
                radius[r[code]] = r["r"]
            self.radii.append(radius)
        self.count = np.zeros((len(books[0]), len(books[1])), np.int64)
        for r in dealt.groupBy("c1", "c2").count().toLocalIterator():
            self.count[r["c1"], r["c2"]] = r["count"]

        self.blocks = packed(self._in_groups(dealt), "blocks", 2 * TILE_ROWS, "group")

    def _in_groups(self, dealt: DataFrame) -> DataFrame:
        """The rows by group: neighbouring cells of about TILE_ROWS rows together, or a part of a larger cell."""
        group, parts = np.zeros(self.count.size, np.int64), -(-self.count.ravel() // TILE_ROWS)
        number = held = 0
        for cell in np.flatnonzero(parts).tolist():
            n = int(self.count.flat[cell])
            if held and held + n > TILE_ROWS:
                number, held = number + 1, 0
            group[cell] = number
            if n > TILE_ROWS:
                number += int(parts[cell])
            else:
                held += n
        codes = self.count.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("c1").to_numpy().astype(np.int64) * codes + b.column("c2").to_numpy()
                part = b.column("hash").to_numpy() % np.maximum(parts[cell], 1)
                columns = [b.column(c) for c in ("vec_id", "label", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(group[cell] + part)], ["vec_id", "label", "v", "cell", "group"])

        hashed = dealt.select("vec_id", "label", "v", "c1", "c2", F.xxhash64("vec_id").alias("hash"))
        placed = hashed.mapInArrow(place, "vec_id bigint, label int, v array<int>, cell int, group bigint")
        return placed.repartition("group").sortWithinPartitions("group", "cell")


def visits(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Non-empty cells by falling sum of the bounds of their halves: (bound, code of half 1, code of half 2)."""
    order = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[order[0]].tolist(), second[order[1]].tolist()
    reached = [0] * len(a)  # how many cells of a row have been taken; rows are taken from the left
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        x, y = int(order[0][i]), int(order[1][j])
        if count[x, y]:
            yield -bound, x, y
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))


def _dealer(index: Index, done: int, batch: int):
    """Cells number `done` up to `done + batch` of every anchor that has an uncertified window left, one row per anchor."""
    dim, cut, books, radii, count = index.dim, index.cut, index.books, index.radii, index.count

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ANCHORS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ANCHORS_AT_ONCE)):
            q = _padded(b.column("v"), dim)
            windows = b.column("windows").to_pylist()
            halves = []
            for x, book, radius in ((q[:, :cut], books[0], radii[0]), (q[:, cut:], books[1], radii[1])):
                size = np.sqrt((x * x).sum(axis=1))[:, None]
                reach = np.sqrt((book * book).sum(axis=1))[None, :] + radius
                # The last terms cover rounding: scores are whole numbers, bounds are not.
                halves.append(x @ book.T + size * radius + 0.5 + 1e-9 * size * reach)
            owner, cells, left = [], [], []
            for i in range(len(q)):
                least = min((w["lo"] for w in windows[i]), default=np.inf)
                mine, at_first = [], 0
                for k, (bound, x, y) in enumerate(visits(halves[0][i], halves[1][i], count)):
                    if k == done + batch or least > bound:
                        break
                    if k >= done:
                        at_first = at_first if mine else bound
                        mine.append(x * count.shape[1] + y)
                if mine:
                    owner.append(i)
                    cells.append(mine)
                    # A window that is certified at the first of these cells is so at the others.
                    left.append([w for w in windows[i] if w["lo"] <= at_first])
            kept = b.take(pa.array(owner, pa.int64()))
            columns = [kept.column("anchor_id"), kept.column("label"), kept.column("v"), pa.array(left, b.schema.field("windows").type), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "label", "v", "windows", "cells"])

    return deal


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum stays below 2**53, in whole numbers otherwise."""
    sizes = [np.sqrt((m * m).sum(axis=1)).max(initial=0) for m in (q, x)]
    if sizes[0] * sizes[1] < 1 << 52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class _Asking:
    """A block of anchors: which cells each visits, its windows, and the best rows of them so far."""

    def __init__(self, block: pa.Table, dim: int, cells: int):
        block = block.combine_chunks()
        self.ids, self.labels = block.column("anchor_id").to_numpy(), block.column("label").to_numpy()
        self.q = _padded(block.column("v"), dim)
        visited = block.column("cells").combine_chunks()
        self.visits = np.zeros((len(self.ids), cells), bool)
        self.visits[np.repeat(np.arange(len(self.ids)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()] = True
        windows = block.column("windows").combine_chunks()
        sizes = windows.value_lengths().to_numpy()
        self.first = np.append(0, np.cumsum(sizes))  # the windows of anchor i are first[i] up to first[i + 1]
        self.owner = np.repeat(np.arange(len(self.ids)), sizes)
        each = windows.flatten()
        self.no, self.lo, self.hi = (each.field(c).to_numpy().copy() for c in ("no", "lo", "hi"))
        self.best = [np.zeros(0, np.int64) for _ in range(3)]  # window, row, score

    def take(self, window: list[np.ndarray], row: list[np.ndarray], score: list[np.ndarray], k: int) -> None:
        """The k best of each window of what it had and what comes, ties to the smaller id."""
        w, r, s = (np.concatenate([old, *new]) for old, new in zip(self.best, (window, row, score), strict=True))
        order = np.lexsort((r, -s, w))
        w, r, s = w[order], r[order], s[order]
        begin = np.flatnonzero(np.diff(w, prepend=-1))
        rank = np.arange(len(w)) - np.repeat(begin, np.diff(begin, append=len(w)))
        self.best = [x[rank < k] for x in (w, r, s)]
        last = rank == k - 1
        self.lo[w[last]] = np.maximum(self.lo[w[last]], s[last])


#: Below all scores.
NOTHING = -(1 << 63)


def _scores(q: np.ndarray, x: np.ndarray, visits: np.ndarray, spans: list[slice]) -> np.ndarray:
    """Scores of rows by anchors, NOTHING where an anchor does not visit the row's cell; cells are stretches of the rows."""
    if visits.mean() > 0.5:
        out = _product(q, x)
        for span, there in zip(spans, visits.T, strict=True):
            if not there.all():
                out[~there, span] = NOTHING
        return out
    out = np.full((len(q), len(x)), NOTHING)
    for span, there in zip(spans, visits.T, strict=True):
        if there.any():
            out[there, span] = _product(q[there], x[span])
    return out


def _tiles(dim: int, cells: int, k: int, same_label: bool):
    """The k best rows of every window of the anchors that a task holds, among the rows that come by and lie in visited cells."""

    def meet(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        asking: dict[int, _Asking] = {}
        held = None
        for a_no, a, b_no, b in pairs:
            if b_no not in asking:
                asking[b_no] = _Asking(rows_of(b), dim, cells)
            if a_no != held:
                rows, held = rows_of(a), a_no
                ids, labels, cell = (rows.column(c).to_numpy() for c in ("vec_id", "label", "cell"))
                x = _padded(rows.column("v"), dim)
                cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                spans = [slice(i, j) for i, j in zip(cuts, cuts[1:])]
            anchors = asking[b_no]
            visits = anchors.visits[:, cell[cuts[:-1]]]
            coming = np.flatnonzero(visits.any(axis=1))
            window, row, score = [], [], []
            for start in range(0, len(coming), ANCHORS_AT_ONCE):
                some = coming[start : start + ANCHORS_AT_ONCE]
                scores = _scores(anchors.q[some], x, visits[some], spans)
                fit = (labels[None, :] == anchors.labels[some, None]) == same_label
                fit &= ids[None, :] != anchors.ids[some, None]
                scores[~fit] = NOTHING
                most = scores.max(axis=1)
                for i, anchor in enumerate(some.tolist()):
                    for w in range(anchors.first[anchor], anchors.first[anchor + 1]):
                        if most[i] < anchors.lo[w] or most[i] == NOTHING:
                            continue
                        at = np.flatnonzero((scores[i] >= anchors.lo[w]) & (scores[i] <= anchors.hi[w]) & (scores[i] > NOTHING))
                        if len(at) > k:
                            least = np.partition(scores[i, at], len(at) - k)[len(at) - k]
                            at = at[scores[i, at] >= least]
                            at = at[np.lexsort((ids[at], -scores[i, at]))][:k]
                        window.append(np.full(len(at), w))
                        row.append(ids[at])
                        score.append(scores[i, at])
            if window:
                anchors.take(window, row, score, k)
        for anchors in asking.values():
            w, row, score = anchors.best
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchors.ids[anchors.owner[w]], anchors.no[w], row, score)], ["anchor_id", "no", "vec_id", "score"])

    return meet


def window_search(index: Index, anchors: DataFrame, windows: DataFrame, k: int, same_label: bool) -> DataFrame:
    """anchors(anchor_id, label, v), windows(anchor_id, no, lo, hi) -> (anchor_id, no, rank, vec_id, score).

    The k best rows of each window, of the anchor's label or of all other labels, the anchor itself never.
    """
    spark = anchors.sparkSession
    best = spark.createDataFrame([], "anchor_id bigint, no bigint, vec_id bigint, score bigint, rank int")
    order = Window.partitionBy("anchor_id", "no").orderBy(F.desc("score"), F.asc("vec_id"))
    cells = int(np.count_nonzero(index.count))
    size = max(1, min(TILE_ANCHORS, MARKS // max(1, index.count.size)))
    done, batch = 0, FIRST_CELLS
    while done < cells:
        full = best.where(F.col("rank") == k).select("anchor_id", "no", F.col("score").alias("least"))
        narrowed = windows.join(full, ["anchor_id", "no"], "left").withColumn("lo", F.greatest("lo", "least"))
        asked = narrowed.groupBy("anchor_id").agg(F.collect_list(F.struct("no", "lo", "hi")).alias("windows"))
        schema = "anchor_id bigint, label int, v array<int>, windows array<struct<no:bigint,lo:bigint,hi:bigint>>, cells array<int>"
        dealt = anchors.join(asked, "anchor_id").select("anchor_id", "label", "v", "windows").mapInArrow(_dealer(index, done, batch), schema)
        probes = packed(dealt, "probes", size)
        if probes.isEmpty():
            break
        found = in_pairs(index.blocks, probes, _tiles(index.dim, index.count.size, k, same_label), "anchor_id bigint, no bigint, vec_id bigint, score bigint")
        both = best.drop("rank").unionByName(found)
        best = saved(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        done, batch = done + batch, batch * 4
    return best


def hard_negatives(
    rows: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 50, most: int = 95
) -> DataFrame:
    """rows(vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors` is a condition on vec_id.  An anchor's positives are its best rows of the same label; for each of them the best
    rows of other labels follow whose score lies between `least` and `most` hundredths of the positive's, ties to the
    smaller id.  Positives of negative score have no such row.  Shorter vectors end in zeros.  See vectors() for rows that
    take no part; an empty table gives an empty result, and other columns are ignored.
    """
    taken = saved(vectors(rows.select("vec_id", "label", "embedding")), "vectors")
    index = Index(taken)
    asking = saved(taken.where(anchors).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    far = 1 << 62
    everything = asking.select("anchor_id", F.lit(0).cast("bigint").alias("no"), F.lit(-far).alias("lo"), F.lit(far).alias("hi"))
    near = window_search(index, asking, everything, positives, True)
    near = saved(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole hundredths without rounding errors: lo is the ceiling and hi the floor of the products over 100.
    p = F.col("positive_score")

    def floored(x: Column) -> Column:
        return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))

    windows = near.select("anchor_id", p.alias("no"), (-floored(-p * least)).alias("lo"), floored(p * most).alias("hi")).distinct()
    hard = window_search(index, asking, windows.where("lo <= hi"), negatives, False)
    hard = hard.select("anchor_id", F.col("no").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = near.join(hard, ["anchor_id", "positive_score"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
