"""N-gram Jaccard join, size-aware: small sets meet on enumerated subsets, large sets scan inverted lists.

Two sets of n and m shingles are linked when 100 * common >= p * union, that is when common >= p (n + m) / (100 + p).

* Small sets.  Linked sets share a subset that either of them gets by deleting at most n - ceil(pn / 100) shingles.  All those
  subsets are enumerated; sets that meet on a subset of k shingles are linked when p (n + m) <= (100 + p) k, and linking
  each to the smallest set of the bucket connects the same sets as linking all pairs.
* Large sets.  The shingles of a set are dealt by hash into parts, more parts than two linked sets of that size class can have
  different shingles, so linked sets have equal parts.  As in prefix filtering, each set lists all but some of its parts, those
  of very frequent shingles and empty ones last, and linked sets are listed under a common part.  A part holds several shingles,
  so texts that are not near copies seldom meet, however large the corpus.
  In rounds, each set is compared with one leader of its lists, which joins groups of near copies without forming their pairs;
  then the pairs whose sets are still in different components are compared.
* The boundary between both is where the number of rows, estimated from the sizes of all sets, is least.

Equal sets are one node from the start, so copies cost one row per document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import digest, hashes, lean, mixed, ragged, raw, runs_of, sent_if_small, slices, words_of
from threadloom.llm.graph import components
from threadloom.llm.sentence_spans import BITMAP_BITS, _bitmap
from threadloom.session import saved

#: Shingles that are ordered by their frequency instead of their hash: at most so many, 16 bytes each in every task.
FREQUENT = 200_000
#: Shingles counted together in a task, and the least count there that is passed on.  Any order gives the same result; this
#: one keeps what many documents share out of the inverted lists.
CHUNK, LOCAL = 5_000_000, 2
#: Bytes of text, and of packed sets, that a task turns into arrays at once.
PIECE = 8 << 20
#: Sizes for which subsets may be enumerated; the cost in rows of an entry of an inverted list, and of fetching and comparing
#: a set that is found in lists (subsets need no comparison).
MOST_SMALL, SCANNED, COMPARED = 49, 4, 24
#: Rounds with leaders: at most so many, and none once the pairs left make at most so many rows per listed part.
ROUNDS, PAIRS_PER_ENTRY = 3, 2
#: Columns that hold the parities of a set.
PARITIES = [f"p{i}" for i in range(16)]


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(runs_of(hashes(words_of(text)), width))


def allowed(n: int, percent: int) -> int:
    """How many shingles of a set of n may be missing in a set linked with it."""
    return n + -percent * n // 100


def subset_count(n: int, percent: int) -> int:
    total, ways = 1, 1
    for k in range(1, allowed(n, percent) + 1):
        ways = ways * (n - k + 1) // k
        total += ways
    return total


def best_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size whose sets are enumerated, given how many sets there are of each size up to MOST_SMALL + 1."""
    lists = lambda n: (allowed(n, percent) + 1) * SCANNED + COMPARED
    cost = {
        x: sum(c * subset_count(n, percent) for n, c in sizes.items() if n <= x)
        + sum(c * lists(n) for n, c in sizes.items() if 100 * n > percent * x)
        for x in range(1, MOST_SMALL + 1)
    }
    return min(cost, key=lambda x: (cost[x], x))


@lean
def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(what, value, count): what 0: how many sets of a size; 1: a shingle that is frequent in this part of the table."""
    held, n = [], 0
    sizes = np.zeros(MOST_SMALL + 2, np.int64)

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values, counts = values[counts >= LOCAL], counts[counts >= LOCAL]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["what", "value", "count"])

    for batch in slices(batches, "text", PIECE):
        for text in raw(batch.column("text")):
            s = shingles(text.as_py(), width)
            sizes[min(len(s), MOST_SMALL + 1)] += 1
            held.append(s)
            n += len(s)
            if n > CHUNK:
                yield flush()
                held, n = [], 0
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), pa.array(np.arange(len(sizes))), pa.array(sizes)], ["what", "value", "count"])


def _sets(frequent: tuple[np.ndarray, np.ndarray], small: int, width: int, percent: int):
    """(mark, key, n, digest, carrier, parts, own, subsets, sizes, parities) per document; carriers bring the entries of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = TaskContext.get().partitionId() << 33
        known, rank = frequent
        seen: set[bytes] = set()
        for batch in slices(batches, "text", PIECE):
            n, digests, carriers, listed, own, subs, ks, odd = [], [], [], [], [], [], [], []
            for text in raw(batch.column("text")):
                s = shingles(text.as_py(), width)
                d = digest(s.tobytes())
                first = len(s) > 0 and d not in seen
                seen.add(d)
                n.append(len(s))
                digests.append(d)
                carriers.append(first)
                parts = _parts(s, known, rank, percent) if first and 100 * len(s) > percent * small else [s[:0], s[:0]]
                listed.append(np.concatenate(parts))
                own.append(len(parts[0]))
                sub, k = _subsets(s, percent) if first and len(s) <= small else (s[:0], [])
                subs.append(sub)
                ks.append(k)
                odd.append(parities(s))
            odd = np.stack(odd)
            if len(seen) > 200_000:
                seen.clear()
            marks = np.arange(mark, mark + len(n))
            mark += len(n)
            flat = lambda xs: np.concatenate([np.zeros(0, np.uint64), *xs]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(marks, pa.int64()),
                    batch.column("key"),
                    pa.array(n, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(carriers),
                    ragged(flat(listed), [len(x) for x in listed], pa.int64()),
                    pa.array(own, pa.int32()),
                    ragged(flat(subs), [len(x) for x in subs], pa.int64()),
                    ragged(np.array([k for x in ks for k in x], np.int32), [len(x) for x in ks], pa.int32()),
                    *[pa.array(odd[:, i]) for i in range(len(PARITIES))],
                ],
                ["mark", "key", "n", "digest", "carrier", "parts", "own", "subsets", "sizes", *PARITIES],
            )

    return lean(run)


@lru_cache
def _classes(percent: int) -> list[int]:
    """The least size of each size class; linked sets are in the same class or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


def class_of(n: int, percent: int) -> int:
    return bisect_right(_classes(percent), n) - 1


def dealt(level: int, percent: int) -> tuple[int, int]:
    """(parts, listed parts) of the sets that may be linked with one of this size class as the smaller one.

    Such a pair has less than `listed` different shingles, so more than `parts - listed` of its parts are equal.  Both sets
    leave out their `parts - listed` weakest parts in one order, so the strongest equal part is listed by both.
    """
    n = _classes(percent)[level + 1] - 1
    listed = (n + n * 100 // percent) * (100 - percent) // (100 + percent) + 1
    return listed + listed // 3, listed


def _parts(s: np.ndarray, known: np.ndarray, rank: np.ndarray, percent: int) -> list[np.ndarray]:
    """Hashes of the listed parts of a set: as the smaller one of a pair in its own size class, and for that of the class below."""
    rare = np.zeros(len(s), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rare = np.where(known[at] == s, rank[at], 0)
    q = class_of(len(s), percent)
    out = []
    with np.errstate(over="ignore"):
        m = mixed(s)
        for level in (q, q - 1):
            if level < 0:
                out.append(s[:0])
                continue
            parts, listed = dealt(level, percent)
            # The most shingles of a pair with this set; of a smaller class, its sets end before this one's.
            both = len(s) + (len(s) * 100 // percent if level == q else _classes(percent)[q] - 1)
            listed = min(listed, both * (100 - percent) // (100 + percent) + 1)
            part = ((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[order], np.arange(parts))
            size = np.diff(starts, append=len(s))
            full = np.flatnonzero(size)
            total, least = np.zeros(parts, np.uint64), np.full(parts, np.iinfo(np.int64).max)
            total[full] = np.add.reduceat(mixed(m + np.uint64(1))[order], starts[full])
            least[full] = np.minimum.reduceat(rare[order], starts[full])
            h = mixed(total + mixed(np.arange(parts).astype(np.uint64) + (np.uint64(level) << np.uint64(32))) + size.astype(np.uint64))
            # Parts with a rare shingle first, larger ones before smaller ones; empty ones last.
            out.append(h[np.lexsort((h, -size, least))[:listed]])
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """1,024 bits as sixteen 64-bit values: how often, even or odd, the set has a shingle that belongs to the bit."""
    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _subsets(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """A hash of every subset that lacks at most allowed(n) shingles, and its size."""
    with np.errstate(over="ignore"):
        m = mixed(s)
        total = m.sum(dtype=np.uint64)
        out, sizes = [], []
        for d in range(allowed(len(s), percent) + 1):
            gone = list(combinations(range(len(s)), d))
            gone = np.array(gone, np.int64).reshape(len(gone), d)
            out.append(mixed((total - m[gone].sum(axis=1, dtype=np.uint64)) + np.uint64(len(s) - d)))
            sizes += [len(s) - d] * len(gone)
    return np.concatenate(out), sizes



def packed(s: np.ndarray) -> bytes:
    """48 bits of each shingle: two sets of 20,000 have one chance in 700,000 of a common value that is none."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(b: pa.Buffer | bytes) -> np.ndarray:
    values = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(values), 8), np.uint8)
    out[:, 2:] = values
    return out.reshape(-1).view("<u8")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


@lean
def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, words) of the documents whose set is the wanted one."""
    for batch in slices(batches, "text", PIECE):
        nodes, sets = [], []
        for text, node, want in zip(raw(batch.column("text")), batch.column("node").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            s = shingles(text.as_py(), width)
            if digest(s.tobytes()) == want:
                nodes.append(node)
                sets.append(packed(s))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])


@lean
def _with_leader(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, node, shingles), sorted, the leader's own row first: the members linked with their leader."""
    at, lead = None, None
    for batch in batches:
        a, b = [], []
        ids = [batch.column(c).to_pylist() for c in ("leader", "salt", "node")]
        for leader, salt, node, data in zip(*ids, batch.column("shingles"), strict=True):
            if (leader, salt) != at:
                at, lead = (leader, salt), None
            if node == leader:
                lead = unpacked(data.as_buffer())
            elif lead is not None and linked(lead, unpacked(data.as_buffer()), percent):
                a.append(leader)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


@lean
def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = zip(batch.column("x"), batch.column("y"), strict=True)
        keep = [linked(unpacked(x.as_buffer()), unpacked(y.as_buffer()), percent) for x, y in both]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _least_count(often: DataFrame) -> int:
    """The least count that at most FREQUENT shingles reach (one more than the largest, if too many share that)."""
    classes = often.groupBy(F.least(F.col("count"), F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    least, held = 100_001, 0
    for r in classes.collect():
        held += r.n
        if held > FREQUENT:
            break
        least = r.c
    return least


def _listed(bitmap: np.ndarray):
    """(s, node, n, own) of the listed parts whose bit is set; own: listed as the smaller set of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            values = parts.flatten().to_numpy(zero_copy_only=False)
            bit = values.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            hit = np.flatnonzero((bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            at = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            own = at < batch.column("own").to_numpy()[owner]
            owners = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(values[hit]), batch.column("mark").take(owners), batch.column("n").take(owners), pa.array(own[hit])], ["s", "node", "n", "own"])

    return lean(run)


def _leaders(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """(node, leader): of the leaders of its lists that are in another component, the one that shares most parts with it."""
    chance = F.xxhash64("node", F.lit(turn))
    heads = placed.groupBy("s").agg(F.min(F.struct(chance.alias("chance"), "node", "n", "root")).alias("head"))
    met = placed.join(heads, "s").where((F.col("root") != F.col("head.root")) & (percent * F.greatest("n", "head.n") <= 100 * F.least("n", "head.n")))
    shared = met.groupBy("node", F.col("head.node").alias("leader")).agg(F.count("*").alias("k"))
    return shared.groupBy("node").agg(F.max_by("leader", F.struct("k", -F.col("leader"))).alias("leader"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) per row: the set size and the smallest key reachable by links, itself included.

    Sets are of shingles of `width` words; a link needs `percent` or more of the union in common.

    Documents without words have an empty set and are linked with nothing.  Repeated rows are linked like copies.  A null
    key is returned with its component, whose name is its smallest key that is not null (null if it has none).  Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    counted = saved(rows.select("text").mapInArrow(lambda x: _count(x, width), "what int, value bigint, count bigint").groupBy("what", "value").agg(F.sum("count").alias("count")), "counts")
    small = best_boundary({r.value: r["count"] for r in counted.where("what = 0 AND count > 0").collect()}, percent)
    often = counted.where("what = 1").select("value", "count")
    top = often.where(F.col("count") >= _least_count(often)).toPandas()
    known = top["value"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = (known[order], top["count"].to_numpy(np.int64)[order])

    schema = f"mark bigint, key {kind}, n int, digest binary, carrier boolean, parts array<bigint>, own int, subsets array<bigint>, sizes array<int>, " + ", ".join(f"{p} bigint" for p in PARITIES)
    sets = saved(rows.mapInArrow(_sets(frequent, small, width, percent), schema), "sets")
    # One node per set: the least mark among the rows that carry its entries.
    nodes = saved(sets.where("carrier").groupBy("digest").agg(F.min("mark").alias("node")), "nodes")
    again = saved(sets.where("carrier").select("mark", "digest").join(nodes, "digest").where("mark <> node").select("mark"), "again")
    carriers = sets.where("carrier").join(sent_if_small(again), "mark", "left_anti").withColumn("node", F.col("mark"))

    buckets = carriers.where(F.size("subsets") > 0).select("node", "n", F.explode(F.arrays_zip("subsets", "sizes")).alias("z"))
    buckets = buckets.select("node", "n", F.col("z.subsets").alias("h"), F.col("z.sizes").alias("k"))
    least = buckets.groupBy("h", "k").agg(F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("c")).where("c > 1").select("h", "k", "least")
    small_links = (
        buckets.join(least, ["h", "k"])
        .where((F.col("node") != F.col("least.node")) & (percent * (F.col("n") + F.col("least.n")) <= (100 + percent) * F.col("k")))
        .select(F.col("least.node").alias("a"), F.col("node").alias("b"))
    )

    large = carriers.where(F.size("parts") > 0)
    common = large.select(F.explode("parts").alias("run")).groupBy("run").agg(F.count("*").alias("c")).where("c > 1")
    common = saved(common.select("run"), "common")
    marked = large.select("mark", "n", "own", "parts").mapInArrow(_listed(_bitmap(common)), "s bigint, node bigint, n int, own boolean")
    entries = saved(marked.join(common, F.col("s") == F.col("run"), "left_semi"), "entries")

    def fetched(wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, from their documents; a repeated row comes twice, which does no harm."""
        found = sets.select("mark", F.col("key").alias("__key"), "digest").join(wanted, F.col("mark") == F.col("node")).drop("mark")
        owners = sent_if_small(saved(found, "found"))
        texts = rows.join(owners, F.col("key").eqNullSafe(F.col("__key"))).select("node", "digest", "text")
        return saved(texts.mapInArrow(lambda x: _pack(x, width), "node bigint, shingles binary"), "packs")

    def led(leaders: DataFrame) -> DataFrame:
        """(a, b) of the members that are linked with their leader."""
        packs = fetched(leaders.select(F.explode(F.array("node", "leader")).alias("node")).distinct())
        # Members meet their leader in groups of bounded size: a leader's row is repeated for each salt in use.
        salts = leaders.groupBy("leader").agg(F.ceil(F.count("*") / 256).cast("bigint").alias("salts"))
        members = leaders.join(salts, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"))
        heads = salts.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        roles = saved(members.unionByName(heads), "roles")
        grouped = packs.join(sent_if_small(roles), "node").repartition("leader", "salt")
        grouped = grouped.sortWithinPartitions("leader", "salt", F.col("node") != F.col("leader")).select("leader", "salt", "node", "shingles")
        return grouped.mapInArrow(lambda x: _with_leader(x, percent), "a bigint, b bigint")

    links, placed = small_links, entries.withColumn("root", F.col("node"))
    for turn in range(ROUNDS):
        links = saved(links.unionByName(led(saved(_leaders(placed, turn, percent), "leaders"))), "links")
        roots = components(links)
        # What is left: lists of sets that are in different components so far.
        placed = saved(placed.drop("root").join(roots, "node", "left").select("s", "node", "n", "own", F.coalesce("root", "node").alias("root")), "placed")
        mixed_lists = placed.groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s")
        mixed_lists = mixed_lists.agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("inside")).where("c * c > inside")
        mixed_lists = saved(mixed_lists.select("s", "c", ((F.col("c") * F.col("c") - F.col("inside")) / 2).alias("rows")), "mixed")
        left = mixed_lists.agg(F.sum("c").alias("c"), F.sum("rows").alias("rows")).first()
        placed = placed.join(mixed_lists.select("s"), "s", "left_semi")
        if not left.c or left.rows <= PAIRS_PER_ENTRY * left.c:
            break
    odd = sets.where("carrier").select(F.col("mark").alias("node"), *PARITIES)
    placed = saved(placed.join(odd, "node"), "placed")
    a = placed.where("own").select("s", F.col("node").alias("a"), "n", F.col("root").alias("root_a"), *[F.col(p).alias(f"{p}_a") for p in PARITIES])
    b = placed.select("s", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("root_b"), *[F.col(p).alias(f"{p}_b") for p in PARITIES])
    larger = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES), F.lit(0))
    near = (F.col("n") >= need) & (apart <= F.col("n") + F.col("m") - 2 * need)
    pairs = saved(a.join(b, "s").where(larger & near & (F.col("root_a") != F.col("root_b"))).select("a", "b").distinct(), "pairs")
    packs = fetched(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = pairs.join(packs.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(packs.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    last_links = both.mapInArrow(lambda x: _pairs(x, percent), "a bigint, b bigint")
    roots = components(links.unionByName(last_links))

    # Back to documents: a component's name is its smallest key.
    least_key = sets.where("n > 0").groupBy("digest").agg(F.min("key").alias("least"))
    named = nodes.join(least_key, "digest").join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_digest = named.join(names, "root").select("digest", "component_id")
    return (
        sets.select("key", "n", "digest")
        .join(by_digest, "digest", "left")
        .select(
            F.col("key").alias(key),
            F.col("n").cast("bigint").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
