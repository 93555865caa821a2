"""A search index on storage: segments with tombstones and additive statistics, and pages of results without forming all hits.

A segment is what one call added: postings(token, id, doc, length, tf), lengths(id, doc, length), tombstones(id) of documents
whose rows in earlier segments are dead, and signed statistics: df per token, number of documents, sum of lengths.  Reading
merges segments: a row counts if no later segment buries its document; the statistics are sums.  Adding and removing documents
reads the new texts and the index rows of the documents touched, never the rest of the corpus.  Compaction writes one segment in
token ranges, so that the few tokens of a query batch are a few files.

A page of BM25 results needs the best documents only.  Postings carry a level of their impact; a (token, level) block knows its
largest impact.  Heavy blocks give each query a score that k documents reach for certain; tokens that together stay below it
bring in no document of their own, and blocks of the other tokens that cannot reach it are not joined.  What is left is
completed from the skipped tokens.  The number of hits is counted on bitmaps of documents per token, not on hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.operators import search as S
from threadloom.session import saved, shared_folder

#: Levels of impact per unit; impacts lie below K1 + 1.
LEVELS = 8
#: Postings read per query to find its first threshold, besides the page itself.
HEAVY = 2_048
#: So many times the wanted documents of a query are scored in full to find it.
LIKELY = 4
#: Tokens in fewer documents are counted from their postings, the others from bitmaps of their documents.
RARE = 1_024
#: Scores are ranked on six digits: what is this close to the threshold may still tie.
CLOSE = 2e-6
#: Tombstones are sent to all tasks up to this number; beyond it the merge shuffles.
SENT_IDS = 500_000


def _numbered(docs: DataFrame, segment: int) -> DataFrame:
    """Documents with a number of their own, dense within a task's rows."""
    return docs.select("id", "content", (F.monotonically_increasing_id() + F.lit(segment) * F.lit(1 << 52)).alias("doc"))


@dataclass
class SearchIndex:
    """An index under a folder; methods that change it write a further segment, whose statistics are written last."""

    spark: SparkSession
    root: str

    @classmethod
    def build(cls, docs: DataFrame, root: str | None = None) -> SearchIndex:
        """docs(id, content), one row per id, as the first segment."""
        spark = docs.sparkSession
        index = cls(spark, root or shared_folder(spark, "index"))
        index._write(0, docs, spark.createDataFrame([], "id string"), None, None)
        return index

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _put(self, df: DataFrame, name: str, segment: int) -> DataFrame:
        path = f"{self.root}/{name}/segment={segment}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, segment: int, docs: DataFrame, dead: DataFrame, dead_posts: DataFrame | None, dead_sizes: DataFrame | None) -> None:
        posts = self._put(S.postings(_numbered(docs, segment), "doc"), "postings", segment)
        # Documents without a token have a row of length nought.
        sizes = posts.groupBy("id", "doc").agg(F.max("length").alias("length"))
        sizes = self._put(sizes, "lengths", segment)
        self._put(dead, "tombstones", segment)
        df = posts.where(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("df"))
        stats = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
        if dead_posts is not None:
            less = dead_posts.groupBy("token").agg((-F.count("*")).alias("df"))
            df = df.unionByName(less).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
            gone = dead_sizes.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("total"))
            stats = stats.unionByName(gone).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        self._put(df, "df", segment)
        self._put(stats, "stats", segment)

    def segments(self) -> list[int]:
        return sorted(r[0] for r in self._table("stats").select("segment").distinct().collect())

    def _live(self, name: str) -> DataFrame:
        """Rows of a table whose document no later segment buries; segments without statistics were never finished."""
        segments = self.segments()
        rows = self._table(name).where(F.col("segment") <= segments[-1])
        if len(segments) == 1:
            return rows.drop("segment")
        dead = self._table("tombstones").where(F.col("segment") <= segments[-1]).groupBy("id").agg(F.max("segment").alias("buried"))
        dead = saved(dead, "tombstones")
        dead = F.broadcast(dead) if dead.count() <= SENT_IDS else dead
        buried = (rows["id"] == dead["id"]) & (rows["segment"] < dead["buried"])
        return rows.join(dead, buried, "left_anti").drop("segment")

    def postings(self) -> DataFrame:
        return self._live("postings").where(F.col("token").isNotNull())

    def lengths(self) -> DataFrame:
        return self._live("lengths")

    def vocabulary(self) -> DataFrame:
        """Document frequency by adding up the segments' changes."""
        return self._table("df").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self) -> tuple[int, float]:
        """Number of documents and their average length."""
        r = self._table("stats").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        return r["n"], (r["total"] / r["n"] if r["n"] else 0.0)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> SearchIndex:
        """Add or replace documents (id, content; one row per id) and remove others (id) in one further segment."""
        segment = self.segments()[-1] + 1
        touched = changed.select("id")
        if removed is not None:
            touched = touched.unionByName(removed.select("id"))
        touched = saved(touched.distinct(), "touched")
        touched = F.broadcast(touched) if touched.count() <= SENT_IDS else touched
        sizes = saved(self.lengths().join(touched, "id", "left_semi"), "buried")
        posts = self.postings().join(touched, "id", "left_semi")
        self._write(segment, changed.select("id", "content"), sizes.select("id"), posts, sizes)
        return self

    def compact(self, root: str | None = None) -> SearchIndex:
        """The same documents as one segment of a new index, postings in token ranges."""
        index = SearchIndex(self.spark, root or shared_folder(self.spark, "index"))
        empty = self._live("postings").where(F.col("token").isNull())
        posts = self.postings().repartitionByRange("token", "id").sortWithinPartitions("token").unionByName(empty)
        index._put(posts, "postings", 0)
        index._put(self.lengths(), "lengths", 0)
        index._put(self.spark.createDataFrame([], "id string"), "tombstones", 0)
        index._put(self.vocabulary(), "df", 0)
        total = self._table("stats").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        index._put(total, "stats", 0)
        return index


# -- pages -------------------------------------------------------------------------------------------------------------------


def _kth(scored: DataFrame, k: int, name: str) -> DataFrame:
    """The k-th best score of each query that has k."""
    best = ordered.top_rows(scored, ["query_id"], [F.desc("score")], k)
    return best.where(F.col("rank") == k).select("query_id", F.col("score").alias(name))


def _best(asked: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """asked(query_id, token, weight), posts(token, doc, level, impact) -> (query_id, doc, score) that hold the best k of each query."""
    blocks = posts.groupBy("token", "level").agg(F.max("impact").alias("top"), F.count("*").alias("n"))
    reach = F.col("weight") * F.col("top")
    blocks = saved(asked.join(blocks, "token").select("query_id", "token", "level", "weight", "n", reach.alias("reach")), "blocks")

    def met(some: DataFrame) -> DataFrame:
        pairs = posts.join(some.select("query_id", "token", "level", "weight"), ["token", "level"])
        return pairs.groupBy("query_id", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))

    # The heaviest blocks of a query: those that begin within its first postings.
    by_reach = Window.partitionBy("query_id").orderBy(F.desc("reach"), "token", "level")
    before = F.coalesce(F.sum("n").over(by_reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = blocks.withColumn("before", before).where(F.col("before") < HEAVY + k)
    # The likeliest documents of those are scored in full: k of them set the threshold.
    likely = ordered.top_rows(met(heavy), ["query_id"], [F.desc("score"), F.asc("doc")], LIKELY * k).select("query_id", "doc")
    whole = likely.join(asked, "query_id").join(posts.select("token", "doc", "impact"), ["token", "doc"])
    whole = whole.groupBy("query_id", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    first = saved(_kth(whole, k, "first"), "threshold")

    # Tokens from the weakest on, as long as all of them together stay below the threshold, bring in no document.
    tokens = blocks.groupBy("query_id", "token").agg(F.max("reach").alias("most")).join(first, "query_id", "left")
    floor = F.coalesce("first", F.lit(0.0)) - CLOSE
    weakest = Window.partitionBy("query_id").orderBy("most", "token")
    tokens = tokens.withColumn("upto", F.sum("most").over(weakest.rowsBetween(Window.unboundedPreceding, 0)))
    tokens = tokens.withColumn("all", F.sum("most").over(Window.partitionBy("query_id"))).withColumn("skipped", F.col("upto") < floor)
    tokens = saved(tokens.withColumn("skipped_most", F.sum(F.when(F.col("skipped"), F.col("most"))).over(Window.partitionBy("query_id"))), "tokens")

    live = blocks.join(tokens, ["query_id", "token"]).where(~F.col("skipped") & (F.col("reach") + F.col("all") - F.col("most") >= floor))
    found = saved(met(live), "candidates")
    rest = tokens.groupBy("query_id").agg(F.max("first").alias("first"), F.coalesce(F.max("skipped_most"), F.lit(0.0)).alias("more"))
    bounds = rest.join(_kth(found, k, "second"), "query_id", "left")
    threshold = F.coalesce(F.greatest("first", "second"), F.lit(0.0)) - CLOSE
    left = saved(found.join(bounds, "query_id").where(F.col("score") + F.col("more") >= threshold).select("query_id", "doc", "score"), "survivors")
    owed = left.select("query_id", "doc").join(tokens.where("skipped").select("query_id", "token"), "query_id").join(asked, ["query_id", "token"])
    paid = owed.join(posts.select("token", "doc", "impact"), ["token", "doc"])
    paid = paid.select("query_id", "doc", (F.col("weight") * F.col("impact")).alias("score"))
    return left.unionByName(paid).groupBy("query_id", "doc").agg(F.sum("score").alias("score"))


def _totals(asked: DataFrame, posts: DataFrame) -> DataFrame:
    """Documents with a token of each query, by the union of the tokens' bitmaps."""
    bucket, position = F.bitmap_bucket_number("doc").alias("bucket"), F.bitmap_bit_position("doc").alias("position")
    placed = posts.select("token", "df", bucket, position)
    often = placed.where(F.col("df") >= RARE).groupBy("token", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
    by_token = asked.select("query_id", "token").join(often, "token").select("query_id", "bucket", "bits")
    rare = asked.select("query_id", "token").join(placed.where(F.col("df") < RARE), "token")
    by_doc = rare.groupBy("query_id", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
    merged = by_token.unionByName(by_doc).groupBy("query_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("query_id").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("total"))


def result_page(queries: DataFrame, index: SearchIndex, page: int, page_size: int, within: DataFrame | None = None) -> DataFrame:
    """queries(query_id, query) -> (query_id, id, score, rank, total): one page per query, ties by document id.

    `within` (id) keeps the pages and totals to some documents before anything is scored; the statistics behind the scores are
    those of the whole index.
    """
    n, average = index.statistics()
    asked = S.asked_tokens(queries)
    known = index.vocabulary().join(asked.select("token").distinct(), "token", "left_semi")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = saved(asked.join(known, "token").select("query_id", "token", (idf * F.col("qtf")).alias("weight"), "df"), "asked")
    posts = index.postings().join(asked.select("token", "df").distinct(), "token")
    if within is not None:
        posts = posts.join(within.select("id"), "id", "left_semi")
    impact: Column = F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("length") / average))
    posts = posts.select("token", "doc", "df", impact.alias("impact")).withColumn("level", F.floor(F.col("impact") * LEVELS).cast("int"))
    posts = saved(posts, "impacts")
    asked = asked.drop("df")
    best = _best(asked, posts, page * page_size).where(F.round("score", 6) > 0)
    named = best.join(index.lengths().select("doc", "id"), "doc").select("query_id", "id", F.round("score", 6).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    top = ordered.top_rows(named, ["query_id"], order, page * page_size).where(F.col("rank") > (page - 1) * page_size)
    return top.join(_totals(asked, posts), "query_id")
