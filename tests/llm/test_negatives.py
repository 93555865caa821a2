"""Hard negatives against brute force over all pairs, on small and unusual tables."""

import math

import numpy as np
import pytest

from threadloom.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, embedding array<float>, anchor_id string, no int"


def brute(rows):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [max(-H.LARGEST, min(H.LARGEST, math.floor(256 * float(np.float32(x))))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
    out = set()
    for a in kept:
        if a % 50:
            continue
        ranked = sorted((-score(a, b), b) for b in kept if b != a)
        for s, p in [x for x in ranked if kept[x[1]][0] == kept[a][0]][:5]:
            fits = [x for x in ranked if kept[x[1]][0] != kept[a][0] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out |= {(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)}
    return out


def found(spark, rows):
    got = H.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id % 50 = 0").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


@pytest.fixture
def small(monkeypatch):
    """Many cells, tiles and rounds on a few rows."""
    for name, value in (("CELL_ROWS", 4), ("TILE_ROWS", 16), ("TILE_ANCHORS", 3), ("FIRST_CELLS", 2)):
        monkeypatch.setattr(H, name, value)


def test_clusters_ties_and_unusual_rows(spark, small):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(3)), (centers[rng.integers(4)] + rng.normal(size=6) / 3).tolist()) for i in range(400)]
    rows += [(500 + i, i % 3, [0.5] * 6) for i in range(60)]  # one vector that many have
    rows += [(550, 1, [0.5] * 6), (550, 1, [0.5] * 6), (51, 0, [9.0] * 6)]  # repeated rows, one id twice
    rows += [(600, None, [1.0] * 6), (650, 1, None), (700, 1, [1.0, None]), (750, 1, [float("nan")] * 6), (None, 1, [1.0] * 6)]
    rows += [(800, 1, [float("inf")] * 6), (850, 1, []), (900, 2, [1.0, 2.0]), (950, 2, [1e30] * 6), (951, 1, [2e5, 3e5, 0.0, 0.0, 0.0, 0.0])]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, 1, [1.0])]) == set()
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.7])]
    assert found(spark, rows) == brute(rows) != set()


def test_the_walk_takes_every_cell_by_falling_bound():
    rng = np.random.default_rng(1)
    a, b, count = rng.integers(0, 9, 7) * 1.0, rng.integers(0, 9, 5) * 1.0, rng.integers(0, 2, (7, 5))
    walked = list(H.visits(a, b, count))
    assert sorted((x, y) for _, x, y in walked) == [(x, y) for x in range(7) for y in range(5) if count[x, y]]
    assert [w[0] for w in walked] == sorted((w[0] for w in walked), reverse=True)
    assert all(s == a[x] + b[y] for s, x, y in walked)


def test_searches_stop_early(spark, small):
    """With well separated clusters the bound ends a search long before all cells are seen."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (np.eye(8)[i % 8] * 4 + rng.normal(size=8) / 50).tolist()) for i in range(800)]
    table = H.vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    index = H.Index(H.saved(table, "vectors"))
    deal = H._dealer(index, 8, 1000)
    import pyarrow as pa

    v = [math.floor(256 * x) for x in rows[0][2]]
    asked = pa.RecordBatch.from_pylist(
        [{"anchor_id": 0, "label": 0, "v": v, "windows": [{"no": 0, "lo": 900_000, "hi": 1 << 60}]}],
        pa.schema([("anchor_id", pa.int64()), ("label", pa.int32()), ("v", pa.list_(pa.int32())), ("windows", pa.list_(pa.struct([("no", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])))]),
    )
    assert sum(b.num_rows for b in deal([asked])) < (index.count > 0).sum() / 2


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert found(spark, rows) == brute(rows)


def test_dealt_cells_are_one_row_per_anchor(spark, small):
    """A round holds some anchors at a time and one row for each, however many cells it deals them; all cells are dealt once."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = [(i, i % 2, rng.normal(size=6).tolist()) for i in range(400)]
    index = H.Index(H.saved(H.vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")), "vectors"))
    window = pa.list_(pa.struct([("no", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
    asked = pa.RecordBatch.from_pylist(
        [{"anchor_id": i, "label": 0, "v": [math.floor(256 * x) for x in v], "windows": [{"no": 0, "lo": -(1 << 62), "hi": 1 << 62}]} for i, _, v in rows],
        pa.schema([("anchor_id", pa.int64()), ("label", pa.int32()), ("v", pa.list_(pa.int32())), ("windows", window)]),
    )
    there = np.flatnonzero(index.count).tolist()
    got = [b for done, batch in ((0, 5), (5, 1000)) for b in H._dealer(index, done, batch)([asked])]
    assert max(b.num_rows for b in got) <= H.ANCHORS_AT_ONCE < 400
    dealt = {}
    for b in got:
        for r in b.to_pylist():
            dealt.setdefault(r["anchor_id"], []).extend(r["cells"])
    assert len(there) > 20 and sorted(dealt) == list(range(400)) and all(sorted(c) == there for c in dealt.values())


def test_blocks_hold_every_row_once(spark, small):
    """Small cells share a block, a large one is several; rows of a block are sorted by cell."""
    from threadloom.functions.blocks import rows_of

    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [0.5, 0.25] if i < 200 else rng.normal(size=2).tolist()) for i in range(400)]
    index = H.Index(H.saved(H.vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")), "vectors"))
    import pyarrow as pa

    blocks = [rows_of(pa.scalar(bytes(r.block))) for r in index.blocks.collect()]
    assert sorted(i for b in blocks for i in b.column("vec_id").to_pylist()) == list(range(400))
    assert max(b.num_rows for b in blocks) <= 2 * H.TILE_ROWS and len({r.no for r in index.blocks.collect()}) == len(blocks)
    assert all(b.column("cell").to_pylist() == sorted(b.column("cell").to_pylist()) and len(set(b.column("group").to_pylist())) == 1 for b in blocks)
