"""Version history of stored contexts: numbering, current version, branches, history walks and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import chains, ordered

MAIN = "main"


def next_versions(sessions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The number the next stored version of each session gets (1 for the first)."""
    last = contexts.groupBy("session_id").agg(F.max("version").alias("last"))
    joined = sessions.select("session_id").join(last, "session_id", "left")
    return joined.select("session_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_version"))


def version_list(contexts: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of versions per session, newest first, with the number of versions."""
    totals = contexts.groupBy("session_id").agg(F.count("*").alias("versions"))
    rows = ordered.top_rows(contexts, ["session_id"], [F.desc("version")], offset + limit, "position")
    return rows.where(F.col("position") > offset).join(totals, "session_id")


def current_versions(contexts: DataFrame) -> DataFrame:
    """The latest version per session: one row per session leaves each map task, nothing is sorted."""
    rest = [c for c in contexts.columns if c != "session_id"]
    newest = contexts.groupBy("session_id").agg(F.max_by(F.struct(*rest), "version").alias("v"))
    return newest.select("session_id", "v.*")


def append_versions(contexts: DataFrame, arriving: DataFrame) -> DataFrame:
    """Stored contexts plus new ones: numbers continue per session and only the newest row is current."""
    last = contexts.groupBy("session_id").agg(F.max("version").alias("last"))
    numbered = ordered.running_sum(
        arriving, ["session_id"], ["arrival"], F.lit(1), ordered.bucket_of("arrival", 4096), "nth"
    )
    placed = numbered.join(last, "session_id", "left").withColumn(
        "version", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("bigint")
    )
    every = contexts.unionByName(placed.select(*contexts.columns))
    newest = every.groupBy("session_id").agg(F.max("version").alias("newest"))
    return every.join(newest, "session_id").withColumn("is_current", F.col("version") == F.col("newest")).drop("newest")


def branch_numbers(versions: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """Number of each commit within its branch, in id order."""
    bucket = ordered.bucket_of("id", bucket_width)
    out = ordered.running_sum(versions, ["graph_id", "branch"], ["id"], F.lit(1), bucket, "version_number")
    return out.withColumn("version_number", F.col("version_number").cast("bigint"))


def branch_heads(branches: DataFrame, versions: DataFrame) -> DataFrame:
    """The last commit of each branch, or the commit it started from when it has none yet."""
    heads = versions.groupBy("graph_id", "branch").agg(F.max("id").alias("last"), F.count("*").alias("commits"))
    joined = branches.join(heads, ["graph_id", "branch"], "left")
    return joined.select(
        "graph_id",
        "branch",
        F.coalesce("last", "base_id").alias("head_id"),
        F.coalesce("commits", F.lit(0)).alias("commits"),
    )


def archive_branches(branches: DataFrame, requested: DataFrame) -> DataFrame:
    """Status of each branch after archive requests; the main branch is protected."""
    asked = requested.select("graph_id", "branch", F.lit(True).alias("asked")).distinct()
    joined = branches.join(asked, ["graph_id", "branch"], "left")
    archive = F.coalesce("asked", F.lit(False)) & (F.col("branch") != MAIN)
    return joined.select("graph_id", "branch", F.when(archive, "archived").otherwise("active").alias("status"))


def history(versions: DataFrame, starts: DataFrame, max_depth: int = 50) -> DataFrame:
    """The parent chain of each start, newest first, at most `max_depth` versions long."""
    links = versions.select("graph_id", F.col("id").alias("node"), F.col("parent_id").alias("next"))
    return chains.walk(starts, links, ["graph_id"], max_depth - 1)


def _repeated(values: Column, times: Column) -> Column:
    return F.when(times == 1, values).otherwise(F.flatten(F.transform(values, lambda v: F.array_repeat(v, times.cast("int")))))


def _name(state: Column) -> Column:
    return F.substr(state, F.instr(state, " ") + 1)


def _entity_changes(old: str, new: str) -> tuple[Column, Column, Column]:
    """Names added, removed and changed between two arrays of states: an importance as text, a blank, the name.

    Names of a version are its own as a rule; where one comes again, every combination of its rows counts.
    """
    a, b = F.transform(old, _name), F.transform(new, _name)
    added, removed = F.array_except(b, a), F.array_except(a, b)
    differing = F.transform(F.array_except(new, old), _name)
    own = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    others = lambda x: F.filter(new, lambda y: (_name(x) == _name(y)) & (x != y))
    every = F.flatten(F.transform(old, lambda x: F.transform(others(x), _name)))
    keep = lambda names, some: F.filter(names, lambda n: F.array_contains(some, n))
    return (
        F.when(own, added).otherwise(keep(b, added)),
        F.when(own, removed).otherwise(keep(a, removed)),
        F.when(own, F.array_except(differing, added)).otherwise(every),
    )


def diff(pairs: DataFrame, entities: DataFrame, decisions: DataFrame, tasks: DataFrame, meta: DataFrame) -> DataFrame:
    """Changes between snapshots: pairs(old_id, new_id), everything else keyed by version_id.

    The content of a version is gathered into one row, its texts as digests; a pair meets its two versions and is compared
    in its row.  A repeated pair repeats what is found on either side, and what is found on both once for each combination.
    """
    keys = ["old_id", "new_id"]
    # -0.0 is 0.0; an entity without a name is never listed.
    importance = F.coalesce((F.col("importance") + 0).cast("string"), F.lit("?"))
    rows = entities.where(F.col("name").isNotNull()).select("version_id", F.concat(importance, F.lit(" "), "name").alias("entities"))
    for label, df in (("decisions", decisions), ("tasks", tasks)):
        # A description of null differs from every other.
        text = F.sha2("description", 256)
        listed = df.select("version_id", text.alias(label), text.isNull().cast("int").alias(f"{label}_null"))
        rows = rows.unionByName(listed, allowMissingColumns=True)
    labels = ["decisions", "tasks"]
    sets = [x for c in labels for x in (F.collect_set(c).alias(c), F.coalesce(F.max(f"{c}_null"), F.lit(0)).alias(f"{c}_null"))]
    versions = rows.where(F.col("version_id").isNotNull()).groupBy("version_id").agg(F.collect_list("entities").alias("entities"), *sets)

    old_meta = meta.selectExpr("version_id AS old_id", "message_count AS old_count", "global_summary AS old_summary")
    new_meta = meta.selectExpr("version_id AS new_id", "message_count AS new_count", "global_summary AS new_summary")
    times = pairs.groupBy(*keys).agg(F.count("*").alias("times"))
    asked = pairs.join(times, keys).join(old_meta, "old_id").join(new_meta, "new_id")
    asked = asked.select(
        *keys, "times",
        (F.col("new_count") - F.col("old_count")).alias("message_delta"),
        (~F.col("old_summary").eqNullSafe(F.col("new_summary"))).alias("summary_changed"),
    )

    none, parts = F.array().cast("array<string>"), ["entities", *labels, *[f"{c}_null" for c in labels]]

    def side(name):
        return versions.select(F.col("version_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in parts]).hint("merge")

    both = asked.join(side("old"), "old_id", "left").join(side("new"), "new_id", "left")
    empty = {f"{n}_{c}": F.coalesce(f"{n}_{c}", F.lit(0) if c.endswith("null") else none) for n in ("old", "new") for c in parts}
    both, times = both.withColumns(empty), F.col("times")
    added, removed, changed = _entity_changes("old_entities", "new_entities")
    numbers = []
    for label in labels:
        for what, here, there in (("added", "new", "old"), ("removed", "old", "new")):
            n = F.size(F.array_except(f"{here}_{label}", f"{there}_{label}")) + F.col(f"{here}_{label}_null")
            numbers.append((n * times).alias(f"{label}_{what}"))
    return both.select(
        *keys,
        _repeated(F.array_sort(added), times).alias("entities_added"),
        _repeated(F.array_sort(removed), times).alias("entities_removed"),
        _repeated(F.array_sort(changed), times * times).alias("entities_modified"),
        *numbers, "message_delta", "summary_changed",
    )


def storage_stats(contexts: DataFrame) -> DataFrame:
    """Blob sizes and the mean compression ratio per session, from metadata columns only."""
    return contexts.groupBy("session_id").agg(
        F.sum("blob_size_bytes").alias("stored_bytes"),
        F.count("*").alias("versions"),
        F.avg("compression_ratio").alias("average_ratio"),
    )
