"""Cross-session memory: decay, merging, conflicts, gaps, digest and integrity checks, per user.

Position of an item is (session_seq, item_ix); it replaces the list order of a single-user run.  A heavy user is spread
over (user, name) or (user, token) groups everywhere; no step collects the items of one user.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import dims, ordered
from threadloom.functions import text as T
from threadloom.functions.substrings import occurring
from threadloom.functions.tiles import common_counts, in_tiles, incidence
from threadloom.session import saved

HALF_LIFE = 30.0
REINFORCEMENT = 0.1
FLOOR = 0.05
MIN_OVERLAP = 0.1
STALLED_DAYS = 14.0


def decayed(importance: Column, age: Column, reinforcements: Column | int = 0, half_life: float = HALF_LIFE) -> Column:
    """Importance boosted by reinforcements, decayed by age, kept within [0.05, 1], rounded to 6."""
    boosted = F.least(F.lit(1.0), importance + F.lit(REINFORCEMENT) * reinforcements)
    factor = F.exp(-F.log(F.lit(2.0)) / half_life * F.greatest(age, F.lit(0.0)))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), boosted * factor)), 6)


def position() -> Column:
    return F.struct("session_seq", "item_ix")


def _text_key(text: Column) -> Column:
    """Stands for a text where only its equality counts, so that no shuffle carries the text for it."""
    return F.sha2(T.name_key(text), 256)


# -- entities ----------------------------------------------------------------------------------------------------------


def _keyed(entities: DataFrame) -> DataFrame:
    return entities.withColumns(
        {"key": T.name_key(F.col("name")), "decayed": decayed(F.col("importance"), F.col("age_days"))}
    )


def alias_hits(entities: DataFrame) -> DataFrame:
    """Aliases that equal the key of an entity seen earlier: (user_id, key of that entity, name to add)."""
    keyed = _keyed(entities)
    first = keyed.groupBy("user_id", "key").agg(F.min(position()).alias("first_seen"))
    asked = keyed.select(
        "user_id", F.col("key").alias("own_key"), "name", position().alias("seen"), F.explode("aliases").alias("alias")
    ).withColumn("key", T.name_key(F.col("alias")))
    hits = asked.where(F.col("key") != F.col("own_key")).join(first, ["user_id", "key"])
    return hits.where(F.col("first_seen") < F.col("seen")).select("user_id", "key", F.col("name").alias("added"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One entity per user and name key: the strongest after decay wins, aliases and sessions are united."""
    keyed = _keyed(entities)
    fields = ["user_id", "key", "kind", "name", "type", "first_mentioned_at", "decayed", "session_seq", "item_ix"]
    # Declared aliases (kind 1) and names that ask for the entity of an alias (kind 2) travel with the entities (kind 0): the rows
    # of a user and key meet in one shuffle.
    declared = F.col("alias").alias("name"), F.col("key"), F.lit(1).alias("kind")
    asking = F.col("name"), T.name_key(F.col("alias")).alias("key"), F.lit(2).alias("kind")
    each = keyed.select("*", F.explode("aliases").alias("alias"))
    rest = [c for c in fields if c not in ("name", "key", "kind")]
    asked = each.where(T.name_key(F.col("alias")) != F.col("key")).select(*rest, *asking)
    rows = keyed.select(*rest, "name", "key", F.lit(0).alias("kind")).unionByName(each.select(*rest, *declared)).unionByName(asked)
    rows = rows.where(F.col("user_id").isNotNull() & F.col("key").isNotNull()).repartition("user_id", "key")
    own = F.col("kind") == 0
    nth = F.row_number().over(Window.partitionBy("user_id", "key", "kind", "session_seq").orderBy("item_ix"))
    rank = F.struct(F.col("decayed"), -F.col("session_seq"), -F.col("item_ix"))
    named = rows.withColumn("opens", F.when(nth == 1, 1).otherwise(0)).groupBy("user_id", "key", "kind", "name").agg(
        F.max_by(F.struct("name", "type", "first_mentioned_at"), rank).alias("winner"),
        F.max(rank).alias("rank"),
        F.max("decayed").alias("best"),
        F.count("*").alias("n"),
        F.min(position()).alias("seen"),
        F.max(position()).alias("last"),
        F.sum("opens").alias("sessions"),
    )
    merged = named.groupBy("user_id", "key").agg(
        F.max_by("winner", F.when(own, F.col("rank"))).alias("winner"),
        F.max(F.when(own, F.col("best"))).alias("best"),
        F.sum(F.when(own, F.col("n"))).alias("mentions"),
        F.sum(F.when(own, F.col("sessions"))).alias("sessions"),
        F.min(F.when(own, F.col("seen"))).alias("first_seen"),
        F.collect_list(F.struct("kind", "name", "n", "seen", "last")).alias("names"),
    ).where("mentions > 0")

    # Names of every occurrence but the first one count as aliases, as do all declared aliases and cross hits.
    def is_alias(x: Column) -> Column:
        again = (x["kind"] == 0) & ((x["n"] > 1) | (x["seen"] > F.col("first_seen")))
        return x["name"].isNotNull() & ((x["kind"] == 1) | again | ((x["kind"] == 2) & (x["last"] > F.col("first_seen"))))

    found = F.array_distinct(F.transform(F.filter("names", is_alias), lambda x: x["name"]))
    return merged.select(
        "user_id",
        "key",
        F.col("winner.name").alias("name"),
        F.col("winner.type").alias("type"),
        F.col("winner.first_mentioned_at").alias("first_mentioned_at"),
        F.array_sort(F.array_remove(found, F.col("winner.name"))).alias("aliases"),
        F.round(F.least(F.lit(1.0), F.col("best")), 4).alias("importance"),
        F.col("sessions").alias("session_count"),
        F.col("mentions"),
    )


def unified_graph(merged: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between surviving entities, keyed by name, weighted by the source's importance."""
    named = edges.select(
        "user_id",
        T.name_key(F.col("src_name")).alias("src_key"),
        T.name_key(F.col("dst_name")).alias("dst_key"),
        F.col("type").alias("relationship"),
    ).distinct()
    source = merged.select("user_id", F.col("key").alias("src_key"), F.col("importance").alias("weight"))
    target = merged.select("user_id", F.col("key").alias("dst_key"))
    return named.join(target, ["user_id", "dst_key"], "left_semi").join(source, ["user_id", "src_key"])


# -- decisions, tasks, preferences -----------------------------------------------------------------------------------------


def merge_decisions(decisions: DataFrame) -> DataFrame:
    """The last active decision per text; without an active one, the highest decided_at (first on ties)."""
    active = F.col("status") == "active"
    rank = F.struct(
        F.when(active, 1).otherwise(0),
        F.when(active, F.col("session_seq")).otherwise(F.col("decided_at")),
        F.when(active, F.col("item_ix")).otherwise(-F.col("session_seq")),
        F.when(active, F.lit(0)).otherwise(-F.col("item_ix")),
    )
    payload = F.struct("description", "rationale", "decided_at", "status", "session_seq", "item_ix")
    keyed = decisions.withColumn("key", T.name_key(F.col("description")))
    return keyed.groupBy("user_id", "key").agg(F.max_by(payload, rank).alias("d")).select("user_id", "key", "d.*")


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """The last completed task per text; without a completed one, the highest priority (first on ties)."""
    done = F.col("status") == "completed"
    rank = F.struct(
        F.when(done, 1).otherwise(0),
        F.when(done, F.col("session_seq").cast("double")).otherwise(F.col("priority")),
        F.when(done, F.col("item_ix")).otherwise(-F.col("session_seq")),
        F.when(done, F.lit(0)).otherwise(-F.col("item_ix")),
    )
    payload = F.struct("description", "status", "priority", "session_seq", "item_ix")
    keyed = tasks.withColumn("key", T.name_key(F.col("description")))
    return keyed.groupBy("user_id", "key").agg(F.max_by(payload, rank).alias("t")).select("user_id", "key", "t.*")


def merge_preferences(preferences: DataFrame) -> DataFrame:
    """Tone and detail of the youngest session, the union of domains, the last value per format key."""
    youngest = preferences.groupBy("user_id").agg(
        F.min_by(F.struct("tone", "detail_level"), F.struct("age_days", "session_seq")).alias("p")
    )
    domains = (
        preferences.select("user_id", F.explode("domain_expertise").alias("d"))
        .distinct()
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list("d")).alias("domain_expertise"))
    )
    formats = (
        preferences.select("user_id", "session_seq", F.explode("format_preferences").alias("k", "v"))
        .groupBy("user_id", "k")
        .agg(F.max_by("v", "session_seq").alias("v"))
        .groupBy("user_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("format_preferences"))
    )
    joined = youngest.join(domains, "user_id", "left").join(formats, "user_id", "left")
    return joined.select(
        "user_id",
        "p.tone",
        "p.detail_level",
        F.coalesce("domain_expertise", F.array().cast("array<string>")).alias("domain_expertise"),
        F.coalesce("format_preferences", F.create_map().cast("map<string,string>")).alias("format_preferences"),
    )


def consolidation_totals(
    sessions: DataFrame, entities: DataFrame, decisions: DataFrame, tasks: DataFrame
) -> DataFrame:
    """Counts of one consolidation run per user."""
    s = sessions.groupBy("user_id").agg(
        F.count("*").alias("session_count"),
        F.sum("message_count").alias("message_count"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    keyed = _keyed(entities).groupBy("user_id", "key").agg(F.count("*").alias("n"))
    e = keyed.groupBy("user_id").agg(F.count("*").alias("entity_count"), F.sum(F.col("n") - 1).alias("repeats"))
    hits = alias_hits(entities).groupBy("user_id").agg(F.count("*").alias("cross_hits"))

    def distinct_keys(df, name):
        keys = df.select("user_id", _text_key(F.col("description")).alias("key")).distinct()
        return keys.groupBy("user_id").agg(F.count("*").alias(name))

    joined = (
        s.join(e, "user_id", "left")
        .join(hits, "user_id", "left")
        .join(distinct_keys(decisions, "decision_count"), "user_id", "left")
        .join(distinct_keys(tasks, "task_count"), "user_id", "left")
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "user_id", "session_count", "message_count", "total_tokens",
        *[F.coalesce(c, zero).alias(c) for c in ("entity_count", "decision_count", "task_count")],
        (F.coalesce("repeats", zero) + F.coalesce("cross_hits", zero)).alias("entities_merged"),
    )


# -- conflicts -----------------------------------------------------------------------------------------------------------


def _conflict_texts(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active decisions and their distinct texts.  Copies of one text meet here, before any pairing."""
    active = decisions.where(F.col("status") == "active").select(
        "user_id", "session_seq", "item_ix", "description", F.concat_ws(" ", "description", "rationale").alias("text")
    )
    active = active.withColumn("text_id", F.xxhash64("text"))
    texts = active.groupBy("user_id", "text_id", "text").agg(F.count("*").alias("copies"))
    tokens = F.array_distinct(T.terms("text"))
    return active, texts.withColumn("tokens", tokens).withColumn("size", F.size("tokens"))


def _tile_of_texts(min_overlap: float):
    """Conflicting pairs of one tile of a user's texts: by overlap of token sets or by opposing words, with a `named` text."""
    against = {}
    for word, other in dims.opposing_words():
        against.setdefault(word, set()).add(other)
    words = sorted(against)
    opposes = np.array([[float(v in against[w]) for v in words] for w in words], np.float32)

    def meet(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
        owner, code, values = incidence(table.column("tokens"))
        n = table.num_rows
        size = np.bincount(owner, minlength=n)
        common = common_counts(owner, code, n, left, right).astype(np.float64)
        union = size[left][:, None] + size[right][None, :] - common
        overlap = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        known = {v: i for i, v in enumerate(values)}
        place = np.full(len(values), -1)
        for w, v in enumerate(words):
            if v in known:
                place[known[v]] = w
        has = np.zeros((n, len(words)), np.float32)
        hit = place[code] >= 0
        has[owner[hit], place[code[hit]]] = 1
        opposing = (has[left] @ opposes @ has[right].T) > 0
        named = table.column("named").to_numpy()
        ids = table.column("text_id").to_numpy()
        keep = (opposing | (overlap >= min_overlap)) & (named[left][:, None] | named[right][None, :])
        if len(left) == len(right) and (left == right).all():
            keep &= left[:, None] <= right[None, :]
        i, j = np.nonzero(keep)
        x, y = ids[left[i]], ids[right[j]]
        user = table.column("user_id").combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
        columns = [user, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(overlap[i, j]), pa.array(opposing[i, j])]
        return pa.table(columns, names=["user_id", "a", "b", "overlap", "opposing"])

    return meet


def conflicting_texts(decisions: DataFrame, min_overlap: float = MIN_OVERLAP, about: str | None = None) -> DataFrame:
    """Pairs of distinct texts (and single texts with themselves) that conflict; with `about`, one of them has to name it.

    The texts of a user meet in tiles of a bounded number of rows, so neither a user with many texts nor a frequent token is
    one task; a tile counts common tokens of all its pairs and passes on the conflicts only.
    """
    if min_overlap <= 0:
        raise ValueError("a threshold of zero or less makes every pair a conflict; use a positive one")
    _, texts = _conflict_texts(decisions)
    named = F.lit(True) if about is None else F.contains(F.lower("text"), F.lit(about.lower()))
    texts = texts.select("user_id", "text_id", "tokens", named.alias("named"))
    if about is not None:
        texts = texts.join(texts.where("named").select("user_id").distinct(), "user_id", "left_semi")
    user = texts.schema["user_id"].dataType.simpleString()
    schema = f"user_id {user}, a bigint, b bigint, overlap double, opposing boolean"
    return in_tiles(texts, ["user_id"], "text_id", _tile_of_texts(min_overlap), schema).select(
        "user_id",
        "a",
        "b",
        F.round("overlap", 4).alias("overlap_score"),
        F.when(F.col("opposing"), "opposing_choice").otherwise("scope_overlap").alias("conflict_type"),
    )


def conflict_groups(decisions: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Conflicts between texts with the number of decision pairs behind each, counted without forming them."""
    active, texts = _conflict_texts(decisions)
    per_session = active.groupBy("user_id", "text_id", "session_seq").agg(F.count("*").alias("n"))
    conflicts = conflicting_texts(decisions, min_overlap)
    label = texts.select("user_id", "text_id", "text", "copies")
    with_a = conflicts.join(label.selectExpr("user_id", "text_id AS a", "text AS text_a", "copies AS copies_a"), ["user_id", "a"])
    with_b = with_a.join(label.selectExpr("user_id", "text_id AS b", "text AS text_b", "copies AS copies_b"), ["user_id", "b"])
    # Pairs inside one session do not count: per text pair, sum over shared sessions of n_a * n_b.
    same = (
        conflicts.select("user_id", "a", "b")
        .join(per_session.selectExpr("user_id", "text_id AS a", "session_seq", "n AS n_a"), ["user_id", "a"])
        .join(per_session.selectExpr("user_id", "text_id AS b", "session_seq", "n AS n_b"), ["user_id", "b", "session_seq"])
        .groupBy("user_id", "a", "b")
        .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("same_session"))
    )
    joined = with_b.join(same, ["user_id", "a", "b"], "left")
    apart = F.col("copies_a") * F.col("copies_b") - F.coalesce("same_session", F.lit(0))
    pairs = F.when(F.col("a") == F.col("b"), F.shiftright(apart, 1)).otherwise(apart)
    return (
        joined.withColumn("pairs", pairs)
        .where(F.col("pairs") > 0)
        .select(
            "user_id",
            F.least("text_a", "text_b").alias("text_low"),
            F.greatest("text_a", "text_b").alias("text_high"),
            "overlap_score",
            "conflict_type",
            "pairs",
        )
    )


def conflict_pairs(decisions: DataFrame, min_overlap: float = MIN_OVERLAP, about: str | None = None) -> DataFrame:
    """The conflicts themselves: one row per pair of decisions of different sessions, earlier session first."""
    active, _ = _conflict_texts(decisions)
    conflicts = conflicting_texts(decisions, min_overlap, about)
    side = active.select("user_id", "text_id", "session_seq", "item_ix", "description")
    left = side.selectExpr("user_id", "text_id AS a", "session_seq AS seq_a", "item_ix AS ix_a", "description AS text_a")
    right = side.selectExpr("user_id", "text_id AS b", "session_seq AS seq_b", "item_ix AS ix_b", "description AS text_b")
    rows = conflicts.join(left, ["user_id", "a"]).join(right, ["user_id", "b"])
    rows = rows.where(
        (F.col("seq_a") != F.col("seq_b")) & ((F.col("a") != F.col("b")) | (F.col("seq_a") < F.col("seq_b")))
    )
    swap = F.col("seq_a") > F.col("seq_b")

    def pick(first, second):
        return F.when(swap, F.col(second)).otherwise(F.col(first))

    return rows.select(
        "user_id",
        pick("seq_a", "seq_b").alias("session_a"),
        pick("ix_a", "ix_b").alias("item_a"),
        pick("text_a", "text_b").alias("decision_a"),
        pick("seq_b", "seq_a").alias("session_b"),
        pick("ix_b", "ix_a").alias("item_b"),
        pick("text_b", "text_a").alias("decision_b"),
        "overlap_score",
        "conflict_type",
    )


def conflicts_for_entity(decisions: DataFrame, name: str, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Conflicts with the name in one of the two descriptions; only pairs with such a text are formed."""
    needle = F.lit(name.lower())
    return conflict_pairs(decisions, min_overlap, name).where(
        F.contains(F.lower("decision_a"), needle) | F.contains(F.lower("decision_b"), needle)
    )


# -- gaps ----------------------------------------------------------------------------------------------------------------


def entity_session_counts(entities: DataFrame) -> DataFrame:
    """Sessions per entity key and the highest importance, where only the first row of a name in a session counts."""
    key = T.name_key(F.col("name"))
    # Both groupings work on what one shuffle brings together.
    met = entities.select("user_id", "session_seq", "item_ix", "importance", "name").repartition("user_id", key)
    first = met.withColumn("key", key).groupBy("user_id", "key", "session_seq").agg(
        F.min_by(F.struct("importance", "name"), "item_ix").alias("f")
    )
    return first.groupBy("user_id", "key").agg(
        F.count("*").alias("sessions"),
        F.max("f.importance").alias("importance"),
        F.min_by("f.name", "session_seq").alias("name"),
    )


def decided_keys(keys: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entity keys that occur as a substring in some decision text of the user.

    Most keys are words of the texts and are settled by an equality; the rest, with blanks or as parts of words, are looked up
    by their rarest gram.
    """
    texts = decisions.select("user_id", F.lower("description").alias("text")).distinct()
    words = texts.select("user_id", F.explode(F.array_distinct(F.split("text", "[^a-z0-9]+"))).alias("key")).distinct()
    whole = saved(keys.join(words, ["user_id", "key"], "left_semi").select("user_id", "key"), "whole")
    rest = saved(keys.join(whole, ["user_id", "key"], "left_anti").select("user_id", F.col("key").alias("needle")), "keys")
    inside = occurring(rest, texts, ["user_id"])
    return whole.unionByName(inside.select("user_id", F.col("needle").alias("key")))


def undecided_topics(entities: DataFrame, decisions: DataFrame, min_sessions: int = 2) -> DataFrame:
    frequent = saved(entity_session_counts(entities).where(F.col("sessions") >= min_sessions), "frequent")
    return _undecided(frequent, decisions)


def _undecided(frequent: DataFrame, decisions: DataFrame) -> DataFrame:
    decided = decided_keys(frequent.select("user_id", "key"), decisions)
    return frequent.join(decided, ["user_id", "key"], "left_anti").select(
        "user_id",
        F.lit("undecided_topic").alias("gap_type"),
        F.col("key").alias("subject"),
        F.when(F.col("sessions") >= 3, "high").otherwise("medium").alias("severity"),
        F.col("sessions").alias("session_count"),
    )


def stalled_tasks(tasks: DataFrame, threshold: float = STALLED_DAYS) -> DataFrame:
    active = F.col("status") == "active"
    # Only texts of active tasks can come out.
    keyed = tasks.withColumn("key", _text_key(F.col("description"))).withColumn("description", F.when(active, F.col("description")))
    rank = F.struct(F.col("age_days"), -F.col("session_seq"), -F.col("item_ix"))
    summed = keyed.groupBy("user_id", "key").agg(
        F.max_by(F.struct("description", "age_days", "priority"), F.when(active, rank)).alias("t"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("status") == "completed").alias("completed"),
    )
    stalled = summed.where(
        (F.col("active") > 0) & (F.col("completed") == 0) & (F.col("t.age_days") >= threshold)
    )
    return stalled.select(
        "user_id",
        F.lit("stalled_task").alias("gap_type"),
        F.col("t.description").alias("subject"),
        F.when(F.col("t.age_days") >= threshold * 2, "high").otherwise("medium").alias("severity"),
        F.lit(1).cast("bigint").alias("session_count"),
    )


def unclear_entities(entities: DataFrame, min_sessions: int = 3, low: float = 0.3) -> DataFrame:
    return _unclear(entity_session_counts(entities), min_sessions, low)


def _unclear(counts: DataFrame, min_sessions: int = 3, low: float = 0.3) -> DataFrame:
    unclear = counts.where((F.col("sessions") >= min_sessions) & (F.col("importance") < low))
    return unclear.select(
        "user_id",
        F.lit("unclear_entity").alias("gap_type"),
        F.col("name").alias("subject"),
        F.lit("low").alias("severity"),
        F.col("sessions").alias("session_count"),
    )


def gap_report(entities: DataFrame, decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    # Entities of a single session make no gap; the others are counted once for both rules.
    frequent = saved(entity_session_counts(entities).where(F.col("sessions") >= 2), "frequent")
    gaps = _undecided(frequent, decisions).unionByName(stalled_tasks(tasks)).unionByName(_unclear(frequent))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return gaps.withColumn("severity_order", order)


def distinct_counts(entities: DataFrame, decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distinct entity names, decision texts and task texts per user."""

    def keys(df, key, kind):
        return df.select("user_id", F.lit(kind).alias("kind"), key.alias("key"))

    text = _text_key(F.col("description"))
    every = keys(entities, T.name_key(F.col("name")), "e").unionByName(keys(decisions, text, "d")).unionByName(keys(tasks, text, "t"))
    return (
        every.distinct()
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("kind") == "e").alias("total_entities"),
            F.count_if(F.col("kind") == "d").alias("total_decisions"),
            F.count_if(F.col("kind") == "t").alias("total_tasks"),
        )
    )


# -- digest ----------------------------------------------------------------------------------------------------------------


def digest_entities(entities: DataFrame, minimum: float = 0.3, n: int = 10) -> DataFrame:
    # The best of a key has the highest importance, so rows below the minimum decide nothing.
    keyed = entities.where(F.col("importance") >= minimum).withColumn("key", T.name_key(F.col("name")))
    rank = F.struct(F.col("importance"), -F.col("session_seq"), -F.col("item_ix"))
    best = keyed.groupBy("user_id", "key").agg(F.max_by(F.struct("name", "type", "importance"), rank).alias("b"))
    rows = best.select("user_id", "key", "b.*")
    top = ordered.top_rows(rows, ["user_id"], [F.desc("importance"), F.asc("key")], n)
    detail = F.concat("type", F.lit(" entity (importance: "), F.format_number("importance", 2), F.lit(")"))
    return top.select(
        "user_id", F.lit("entity").alias("category"), F.col("name").alias("title"), detail.alias("detail"), "importance"
    )


def digest_decisions(decisions: DataFrame, n: int = 10) -> DataFrame:
    active = decisions.where(F.col("status") == "active").withColumn("key", _text_key(F.col("description")))
    first = active.groupBy("user_id", "key").agg(
        F.min_by(F.struct("description", "rationale", "session_seq", "item_ix"), position()).alias("d")
    )
    rows = first.select("user_id", "d.*")
    top = ordered.top_rows(rows, ["user_id"], [F.asc("session_seq"), F.asc("item_ix")], n)
    return top.select(
        "user_id",
        F.lit("decision").alias("category"),
        F.substring("description", 1, 80).alias("title"),
        F.when(F.col("rationale") == "", "No rationale provided").otherwise(F.col("rationale")).alias("detail"),
        F.lit(0.7).alias("importance"),
    )


def digest_tasks(tasks: DataFrame, n: int = 10) -> DataFrame:
    """The first task per text, replaced by a later completed one; in first-seen order."""
    keyed = tasks.withColumn("key", _text_key(F.col("description")))
    fields = F.struct("description", "status", "priority")
    done = F.col("status") == "completed"
    merged = keyed.groupBy("user_id", "key").agg(
        F.min_by(fields, position()).alias("first"),
        F.max_by(fields, F.when(done, position())).alias("last_done"),
        F.min(position()).alias("seen"),
        F.count_if(done).alias("n_done"),
    )
    chosen = F.when(F.col("n_done") > 0, F.col("last_done")).otherwise(F.col("first"))
    rows = merged.select("user_id", "seen", chosen.alias("t")).select("user_id", "seen", "t.*")
    top = ordered.top_rows(rows, ["user_id"], [F.asc("seen")], n)
    detail = F.concat(F.lit("Status: "), "status", F.lit(", Priority: "), F.format_number("priority", 1))
    return top.select(
        "user_id",
        F.lit("task").alias("category"),
        F.substring("description", 1, 80).alias("title"),
        detail.alias("detail"),
        F.col("priority").alias("importance"),
    )


def digest(entities: DataFrame, decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    """All digest entries with their place per user, by importance (at most 30 rows per user)."""
    entries = digest_entities(entities).unionByName(digest_decisions(decisions)).unionByName(digest_tasks(tasks))
    return ordered.top_rows(
        entries, ["user_id"], [F.desc("importance"), F.asc("category"), F.asc("title"), F.asc("detail")], 30, "place"
    )


def digest_stats(sessions: DataFrame, entities: DataFrame, decisions: DataFrame, tasks: DataFrame) -> DataFrame:
    active = decisions.where(F.col("status") == "active")
    counts = distinct_counts(entities, active, tasks)
    done = tasks.groupBy("user_id").agg(F.count_if(F.col("status") == "completed").alias("tasks_completed"))
    messages = sessions.groupBy("user_id").agg(
        F.count("*").alias("session_count"), F.sum("message_count").alias("total_messages")
    )
    joined = messages.join(counts, "user_id", "left").join(done, "user_id", "left")
    return joined.select(
        "user_id",
        "session_count",
        F.coalesce("total_entities", F.lit(0)).alias("new_entities"),
        F.coalesce("total_decisions", F.lit(0)).alias("decisions_made"),
        F.coalesce("tasks_completed", F.lit(0)).alias("tasks_completed"),
        "total_messages",
    )


def recent_sessions(sessions: DataFrame, now: str, days: int) -> DataFrame:
    """Sessions newer than `days` days; soft-deleted ones included."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return sessions.where(F.col("created_at") >= since)


# -- integrity ---------------------------------------------------------------------------------------------------------------


def references(rows: DataFrame, check: str, owner: str, ref: str) -> DataFrame:
    """One row per reference that is not null, with the check it belongs to."""
    refs = rows.select("user_id", F.lit(check).alias("check"), F.col(owner).cast("string").alias("owner"), F.col(ref).cast("string").alias("ref"))
    return refs.where(F.col("ref").isNotNull())


def dangling(rows: DataFrame, check: str, owner: str, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References of `rows` that no row of `targets` answers, within the user."""
    known = targets.select("user_id", F.col(target).cast("string").alias("ref")).distinct()
    missing = references(rows, check, owner, ref).join(known, ["user_id", "ref"], "left_anti")
    return missing.select("user_id", "check", "owner", "ref")


def integrity_violations(
    entities: DataFrame, relationships: DataFrame, nodes: DataFrame, edges: DataFrame, tasks: DataFrame, decisions: DataFrame,
    entity_nodes: bool = False,
) -> DataFrame:
    """Relationship targets, graph nodes, edge ends, task dependencies and supersessions that point nowhere.

    With `entity_nodes` every row of `entities` is a node labelled by its name as well, beside `nodes`.  Names and labels are
    counted together, one row per value of a user; a node refers to its own label, so nodes need no other row.  The other
    references to names and labels meet these rows at once; a table that is given as relationships and edges comes once.
    """
    dependencies = tasks.select("user_id", "task_id", F.explode("dependencies").alias("dependency"))
    tagged = lambda df, c, name, label: df.select("user_id", F.col(c).cast("string").alias("ref"), F.lit(name).alias("name"), F.lit(label).alias("label"))
    values = tagged(entities, "name", 1, int(entity_nodes)).unionByName(tagged(nodes, "label", 0, 1)).where(F.col("ref").isNotNull())
    # Nothing answers a reference without a user; without these rows both readers below share one shuffle.
    lost = values.where(F.col("user_id").isNull() & (F.col("label") == 1))
    values = values.where(F.col("user_id").isNotNull())
    known = values.groupBy("user_id", "ref").agg(F.max("name").alias("names"), F.sum("label").alias("labels"))

    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), "labels"))
    unanswered = known.where((F.col("names") == 0) & (F.col("labels") > 0)).select("user_id", "ref", copies)
    loose_nodes = unanswered.select("user_id", "ref").unionByName(lost.select("user_id", "ref"))
    graph_nodes = loose_nodes.select("user_id", F.lit("graph_node").alias("check"), F.col("ref").alias("owner"), "ref")

    def ends(rows: DataFrame, owner: str, ref: str, checks: dict[str, str]) -> DataFrame:
        """References with the checks that fail where none of the names or labels answers."""
        refs = references(rows, "", owner, ref).drop("check")
        return refs.select("*", *[F.lit(checks.get(k)).cast("string").alias(k) for k in ("of_name", "of_label")])

    sources = ends(edges, "dst_name", "src_name", {"of_label": "edge_source"})
    if relationships is edges:
        every = sources.unionByName(ends(edges, "src_name", "dst_name", {"of_name": "relationship_target", "of_label": "edge_target"}))
    else:
        every = sources.unionByName(ends(edges, "src_name", "dst_name", {"of_label": "edge_target"}))
        every = every.unionByName(ends(relationships, "src_name", "dst_name", {"of_name": "relationship_target"}))
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    met = every.join(known, ["user_id", "ref"], "left").where(none("names") | none("labels"))
    failed = F.array(F.when(none("names"), F.col("of_name")), F.when(none("labels"), F.col("of_label")))
    loose = met.select("user_id", F.explode(failed).alias("check"), "owner", "ref").where(F.col("check").isNotNull())

    return (
        loose.unionByName(graph_nodes)
        .unionByName(dangling(dependencies, "task_dependency", "task_id", "dependency", tasks, "task_id"))
        .unionByName(dangling(decisions, "superseded_by", "decision_id", "superseded_by", decisions, "decision_id"))
    )


def quality_warnings(
    documents: DataFrame, summaries: DataFrame, scores: DataFrame, entities: DataFrame, topics: DataFrame
) -> DataFrame:
    """Non-fatal findings per conversation.

    documents(conv_id, message_count, compression_ratio), summaries(conv_id, level), scores(conv_id, entity),
    entities(conv_id, name), topics(conv_id, label, message_index).
    """

    def warn(df, name, subject):
        return df.select("conv_id", F.lit(name).alias("warning"), subject.cast("string").alias("subject"))

    none = F.lit(None)
    without_global = documents.where(F.col("message_count") > 0).join(
        summaries.where(F.col("level") == "global").select("conv_id").distinct(), "conv_id", "left_anti"
    )
    orphans = scores.select("conv_id", F.col("entity").alias("name")).join(
        entities.select("conv_id", "name").distinct(), ["conv_id", "name"], "left_anti"
    )
    repeated = (
        entities.groupBy("conv_id", F.lower("name").alias("key"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("conv_id")
        .distinct()
    )
    outside = (
        topics.join(documents.where(F.col("message_count") > 0).select("conv_id", "message_count"), "conv_id")
        .where(F.col("message_index") >= F.col("message_count"))
        .select("conv_id", "label")
        .distinct()
    )
    return (
        warn(without_global, "no_global_summary", none)
        .unionByName(warn(documents.where(F.col("compression_ratio") <= 0), "ratio_not_positive", none))
        .unionByName(warn(orphans, "orphan_score", F.col("name")))
        .unionByName(warn(repeated, "duplicate_names", none))
        .unionByName(warn(outside, "topic_index_out_of_range", F.col("label")))
    )
