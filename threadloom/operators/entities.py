"""Entity extraction, deduplication, relationships and the knowledge graph, per conversation.

A mention is one narrow row (conv_id, turn, source, ix, key, name, type); (turn, source, ix) is its position.  Entities
are aggregates over mentions, so a conversation of any size is spread over its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import dims, fixed
from threadloom.functions import text as T
from threadloom.functions.barrier import once
from threadloom.functions.substrings import containing
from threadloom.session import saved

WORD = r"[a-z0-9_\-]+"
GAP = r"[^a-z0-9_\-]+"
CONTEXT = 100
PREFIX = 4
NEAR_CONFIDENCE = 0.7

SOURCES = {"file_path": 1, "url": 2, "endpoint": 3, "import": 4, "env_var": 5, "symbol": 6, "term": 7}


def _grown(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is never collected on the driver for a broadcast."""
    return rows.hint("merge")


# -- mentions ---------------------------------------------------------------------------------------------------------------


def _all(text: str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first_group(text: str, pattern: str, groups: int) -> Column:
    """Per match the first group that took part (the others come back empty)."""
    found = _all(text, pattern, 1)
    for g in range(2, groups + 1):
        found = F.zip_with(found, _all(text, pattern, g), lambda a, b: F.when(a == "", b).otherwise(a))
    return found


def _mentions(names: Column, source: str, kind: str, prefix: str = "", keep_case: bool = False) -> Column:
    def row(name, i):
        clean = T.strip(name)
        key = clean if keep_case else F.lower(clean)
        return F.struct(
            F.lit(SOURCES[source]).alias("source"), i.alias("ix"), F.concat(F.lit(prefix), key).alias("key"),
            clean.alias("name"), F.lit(kind).alias("type"),
        )

    return F.filter(F.transform(names, row), lambda m: F.length(m["name"]) >= 2)


def pattern_mentions(messages: DataFrame) -> DataFrame:
    """File paths, URLs, API endpoints, imports and environment variables: one pass over each message, no shuffle."""
    t = "full_text"
    known = F.filter(
        _all(t, fixed.ENV_VAR_PATTERN, 1),
        lambda v: F.exists(T.string_array(fixed.ENV_VAR_PREFIXES), lambda p: F.startswith(v, p)),
    )
    every = F.concat(
        _mentions(_all(t, fixed.FILE_PATH_PATTERN), "file_path", "file_path"),
        _mentions(_all(t, fixed.URL_PATTERN), "url", "url"),
        _mentions(_first_group(t, fixed.ENDPOINT_PATTERN, 2), "endpoint", "api"),
        _mentions(_first_group(t, fixed.IMPORT_PATTERN, 3), "import", "code", "import:"),
        _mentions(known, "env_var", "code"),
    )
    rows = messages.select("conv_id", "turn", F.explode_outer(every).alias("m")).where(F.col("m").isNotNull())
    return rows.select("conv_id", "turn", "m.*")


def symbol_mentions(blocks: DataFrame) -> DataFrame:
    """Definitions in code blocks; names are case-sensitive."""
    names = _first_group("text", fixed.CODE_SYMBOL_PATTERN, 3)
    found = _mentions(names, "symbol", "code", "symbol:", keep_case=True)
    code = blocks.where(F.col("type") == "code")
    rows = code.select("conv_id", "turn", "block_ix", F.explode_outer(found).alias("m")).where(F.col("m").isNotNull())
    placed = (F.col("block_ix").cast("bigint") * 1_000_000 + F.col("m.ix")).alias("ix")
    return rows.select("conv_id", "turn", "m.source", placed, "m.key", "m.name", "m.type")


def _parts(text: Column) -> Column:
    """Alternately what is between words and a word: gap, word, gap, ..., word, gap; line breaks stand around the text."""
    padded = F.concat(F.lit("\n"), text, F.lit("\n"))
    return F.regexp_extract_all(padded, F.lit(f"{WORD}|{GAP}"), F.lit(0))


def term_runs(dictionary: DataFrame) -> DataFrame:
    """The dictionary with each term's run (from its first word to its last), its number of words and the marks around it."""
    n = F.size("__parts")
    cut = once(dictionary, __parts=_parts(F.col("term"))).where(n >= 3)
    lead, trail = F.substr(F.get("__parts", F.lit(0)), F.lit(2)), F.get("__parts", n - 1)
    return cut.select(
        *dictionary.columns,
        F.array_join(F.slice("__parts", F.lit(2), n - 2), "").alias("run"),
        F.floor((n - 1) / 2).cast("int").alias("width"),
        lead.alias("lead"),
        F.substr(trail, F.lit(1), F.length(trail) - 1).alias("trail"),
    )


def term_mentions(messages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Whole-word dictionary matches, at most one per term and message.

    dictionary(term, canonical, type, place).  A message passes on its runs of one up to w words with exactly what stands
    between them, w being the most words of any term; an equi-join on (width, run) meets the dictionary, so neither the
    dictionary is scanned per message nor a pattern built per row.  Marks around a term (as in `.net` or `c++`) are compared
    with what stands around the run, which must go on beyond them without a word.  A term without a word matches nothing.
    The join side is chosen by its size at run time; nothing is forced into memory.
    """
    runs = saved(term_runs(dictionary), "terms")
    # One row per width that some term has; the widths are few because terms are short.
    widths = runs.groupBy("width").agg(F.max(F.length(F.concat("lead", "trail")) > 0).alias("marked")).orderBy("width").collect()
    none = F.lit(None).cast("string")
    lowered = once(messages.select("conv_id", "turn", "full_text"), parts=_parts(F.lower("full_text")))
    n_words = F.floor((F.size("parts") - 1) / 2).cast("int")

    def windows(width: int, marked: bool) -> Column:
        def run(k: Column) -> Column:
            return F.get("parts", 2 * k - 1) if width == 1 else F.array_join(F.slice("parts", 2 * k, F.lit(2 * width - 1)), "")

        def window(run: Column, before: Column, after: Column) -> Column:
            return F.struct(F.lit(width).alias("width"), run.alias("run"), before.alias("before"), after.alias("after"))

        starts = F.when(n_words >= width, F.sequence(F.lit(1), n_words - width + 1)).otherwise(F.array().cast("array<int>"))
        if marked:
            return F.transform(starts, lambda k: window(run(k), F.get("parts", 2 * k - 2), F.get("parts", 2 * k + 2 * width - 2)))
        # Repeats are left out among plain texts: among structs every one would be compared with every other.
        return F.transform(F.array_distinct(F.transform(starts, run)), lambda r: window(r, none, none))

    if not widths:
        every = F.array().cast("array<struct<width:int,run:string,before:string,after:string>>")
    else:
        every = F.concat(*(windows(r["width"], r["marked"]) for r in widths))
    rows = lowered.select("conv_id", "turn", F.explode(every).alias("w")).select("conv_id", "turn", "w.*")
    opens = (F.col("lead") == "") | (F.endswith("before", "lead") & (F.col("before") != F.col("lead")))
    closes = (F.col("trail") == "") | (F.startswith("after", "trail") & (F.col("after") != F.col("trail")))
    hits = rows.join(runs, ["width", "run"]).where(opens & closes)
    found = hits.select(
        "conv_id", "turn", F.lit(SOURCES["term"]).alias("source"), F.col("place").cast("bigint").alias("ix"),
        F.concat(F.lit("tech:"), F.lower("canonical")).alias("key"), F.col("canonical").alias("name"), "type", "term",
    )
    # Runs that are compared with their marks keep their repeats until here.
    return (found.distinct() if any(r["marked"] for r in widths) else found).drop("term")


def all_mentions(messages: DataFrame, dictionary: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    found = pattern_mentions(messages).withColumn("ix", F.col("ix").cast("bigint"))
    found = found.unionByName(term_mentions(messages, dictionary))
    return found if blocks is None else found.unionByName(symbol_mentions(blocks))


def raw_entities(mentions: DataFrame) -> DataFrame:
    """Mentions summed per key: first spelling and type, count, first and last message."""
    at = F.struct("turn", "source", "ix")
    return mentions.groupBy("conv_id", "key").agg(
        F.min_by(F.struct("name", "type"), at).alias("first"),
        F.count("*").alias("mention_count"),
        F.min(at).alias("at"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
    ).select("conv_id", "key", "first.name", "first.type", "mention_count", "at", "first_turn", "last_turn")


# -- deduplication --------------------------------------------------------------------------------------------------------------

def resolve_exact(raw: DataFrame) -> DataFrame:
    """Keys with the same lower-case name become one entity, named like the most mentioned of them."""
    keyed = raw.withColumn("low", F.lower("name"))
    order = F.struct(-F.col("mention_count"), F.col("at"))
    best = keyed.groupBy("conv_id", "low").agg(
        F.min_by(F.struct("name", "type", "mention_count", "at"), order).alias("b")
    )
    return keyed.select("conv_id", "key", "low").join(best, ["conv_id", "low"]).select(
        "conv_id", "key", F.col("b.name").alias("canonical"), F.col("b.type").alias("canonical_type"),
        F.col("b.mention_count").alias("slot_count"), F.col("b.at").alias("slot_at"),
        F.array().cast("array<string>").alias("aliases"),
    )


def _relations(items: DataFrame) -> DataFrame:
    """(conv_id, key, ord, peer, kind): each item with the better-ranked ones of equal, containing or contained name."""
    names = items.select("conv_id", F.col("low").alias("text")).distinct()
    pairs = containing(names.withColumnRenamed("text", "needle"), names, ["conv_id"], shortest=3)
    directed = (
        names.select("conv_id", F.col("text").alias("low"), F.col("text").alias("peer_low"), F.lit(0).alias("kind"))
        .unionByName(pairs.select("conv_id", F.col("needle").alias("low"), F.col("text").alias("peer_low"), F.lit(1).alias("kind")))
        .unionByName(pairs.select("conv_id", F.col("text").alias("low"), F.col("needle").alias("peer_low"), F.lit(2).alias("kind")))
    )
    peers = items.select("conv_id", F.col("low").alias("peer_low"), F.col("key").alias("peer"), F.col("ord").alias("peer_ord"))
    met = items.select("conv_id", "low", "key", "ord").join(_grown(directed), ["conv_id", "low"]).join(
        _grown(peers), ["conv_id", "peer_low"]
    )
    return met.where(F.col("peer_ord") < F.col("ord")).select("conv_id", "key", "ord", "peer", "kind")


def _with_ends(state: DataFrame) -> DataFrame:
    """Add `until`: the rank of the next item that names the same slot, from which on this item's name is not shown."""
    named = state.where("shown")
    order = Window.partitionBy("conv_id", "slot").orderBy("ord")
    ends = named.select("conv_id", "key", F.lead("ord").over(order).alias("until"))
    return state.join(_grown(ends), ["conv_id", "key"], "left")


def resolve(raw: DataFrame) -> DataFrame:
    """Key -> canonical entity, with substring merging.

    Items of a conversation are ranked by mentions, then by position.  An item belongs to the slot of an item that shows
    the same name, or else to the earliest slot whose name, at the item's rank, contains the item's name or is contained in
    it (three characters at least); in the latter case the slot is named after the item from there on.  An item without such
    a slot founds one.

    Each item depends on better-ranked items only, and only on those whose names are related to its own.  So all items
    decide at once from the decisions of the round before, and the rounds end when nothing changes: after k rounds the
    items whose chain of dependencies is shorter than k are settled.  Rounds join narrow rows of related items; no
    conversation or component is gathered, except for the aliases of one entity.
    """
    items = saved(
        raw.select(
            "conv_id", "key", "name", "type", F.lower("name").alias("low"), "mention_count", "at",
            F.struct((-F.col("mention_count")).alias("n"), F.col("at").alias("at"), F.col("key").alias("key")).alias("ord"),
        ),
        "items",
    )
    relations = saved(_relations(items), "relations")
    state = items.select("conv_id", "key", "ord", F.col("key").alias("slot"), F.col("ord").alias("founded"), F.lit(True).alias("shown"))
    state, mark = saved(_with_ends(state), "slots"), None
    while True:
        shown = state.where("shown").select("conv_id", F.col("key").alias("peer"), "slot", "founded", "until")
        visible = relations.join(_grown(shown), ["conv_id", "peer"]).where(
            (F.col("kind") == 0) | F.col("until").isNull() | (F.col("until") >= F.col("ord"))
        )
        choice = F.min(F.struct((F.col("kind") > 0).alias("other_name"), "founded", "kind", "slot"))
        chosen = visible.groupBy("conv_id", "key").agg(choice.alias("c"))
        state = items.select("conv_id", "key", "ord").join(_grown(chosen), ["conv_id", "key"], "left").select(
            "conv_id", "key", "ord",
            F.coalesce("c.slot", "key").alias("slot"),
            F.coalesce("c.founded", "ord").alias("founded"),
            (F.col("c").isNull() | (F.col("c.kind") == 2)).alias("shown"),
        )
        state = saved(_with_ends(state), "slots")
        before, mark = mark, state.agg(F.bit_xor(F.xxhash64("conv_id", "key", "slot", "shown"))).first()[0]
        if before == mark:
            break
    members = state.join(_grown(items.drop("ord")), ["conv_id", "key"])
    last = F.max_by(F.struct("ord", "name", "type", "low"), F.when(F.col("shown"), F.col("ord")))
    heads = members.groupBy("conv_id", "slot").agg(
        last.alias("last"),
        F.min_by(F.struct("mention_count", "at"), "ord").alias("founder"),
        F.max(F.when(F.col("shown") & F.col("until").isNotNull(), F.struct("ord", "name"))).alias("former"),
    )
    later = members.join(_grown(heads.select("conv_id", "slot", "last")), ["conv_id", "slot"]).where(
        (F.col("ord") > F.col("last.ord")) & (F.col("low") != F.col("last.low"))
    )
    more = later.groupBy("conv_id", "slot").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("more"))
    described = heads.join(_grown(more), ["conv_id", "slot"], "left").select(
        "conv_id", "slot",
        F.col("last.name").alias("canonical"), F.col("last.type").alias("canonical_type"),
        F.col("founder.mention_count").alias("slot_count"), F.col("founder.at").alias("slot_at"),
        F.array_distinct(
            F.concat(
                F.when(F.col("former").isNotNull(), F.array("former.name")).otherwise(F.array().cast("array<string>")),
                F.coalesce(F.transform("more", lambda m: m["name"]), F.array().cast("array<string>")),
            )
        ).alias("aliases"),
    )
    return state.select("conv_id", "key", "slot").join(_grown(described), ["conv_id", "slot"]).drop("slot")


def entities_of(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per canonical entity with summed mentions, extent, aliases and its rank in the list."""
    joined = raw.join(_grown(resolved), ["conv_id", "key"])
    return joined.groupBy("conv_id", F.lower("canonical").alias("low")).agg(
        F.first("canonical").alias("name"),
        F.first("canonical_type").alias("type"),
        F.first("aliases").alias("aliases"),
        F.sum("mention_count").alias("mention_count"),
        F.min("first_turn").alias("first_turn"),
        F.max("last_turn").alias("last_turn"),
        F.first(F.struct((-F.col("slot_count")).alias("n"), F.col("slot_at").alias("at"))).alias("rank"),
    )


# -- relationships ----------------------------------------------------------------------------------------------------------------


def cooccurrence(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities named in the same message; confidence grows with every further common message.

    The pairs of a message are formed inside one row per message, which its text bounds; they are summed before the
    shuffle.
    """
    seen = mentions.select("conv_id", "turn", "key").distinct().join(resolved, ["conv_id", "key"])
    ranked = F.struct((-F.col("slot_count")).alias("n"), F.col("slot_at").alias("at"), F.lower("canonical").alias("low"))
    listed = seen.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(ranked)).alias("e"))
    names = F.transform("e", lambda x: x["low"])
    pairs = F.flatten(
        F.transform(
            "names",
            lambda a, i: F.transform(
                F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("src"), b.alias("dst"))
            ),
        )
    )
    rows = listed.select("conv_id", names.alias("names")).select("conv_id", F.explode(pairs).alias("p"))
    counted = rows.groupBy("conv_id", "p.src", "p.dst").agg(F.count("*").alias("evidence"))
    confidence = F.round(F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("evidence") - 1)), 4)
    return counted.select(
        "conv_id", "src", "dst", F.lit("related_to").alias("relationship"), confidence.alias("confidence"), "evidence"
    )


_HITS = "array<struct<verb:int,relationship:string,pos:int>>"


def _verb_hits(n: int, verb: str, relationship: str) -> Column:
    """Matches of one verb phrase with their zero-based starts: the pieces between matches add up to the positions."""
    sizes = F.transform(F.split("lowered", rf"(?U)\b{verb}\b", -1), F.length)

    def hit(z, k):
        start = F.aggregate(F.slice(z, F.lit(1), k), F.lit(0), lambda acc, m: acc + m) + (k - 1) * F.lit(len(verb))
        return F.struct(F.lit(n).alias("verb"), F.lit(relationship).alias("relationship"), start.alias("pos"))

    def hits(z):
        return F.when(F.size(z) > 1, F.transform(F.sequence(F.lit(1), F.size(z) - 1), lambda k: hit(z, k)))

    found = F.when(F.contains(F.col("lowered"), F.lit(verb)), F.get(F.transform(F.array(sizes), hits), F.lit(0)))
    return F.coalesce(found, F.array().cast(_HITS))


def verb_edges(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """Nearest entity before and after a relating verb, 100 characters each way; substrings count.

    Windows meet entity names through the first characters of a name at a position of the window (an equi-join), and the
    full name is then compared at that position.
    """
    lowered = messages.select("conv_id", "turn", F.lower("full_text").alias("lowered"))
    every = F.concat(*[_verb_hits(n, verb, kind) for n, (verb, kind) in enumerate(fixed.RELATION_VERBS)])
    parts = (
        lowered.withColumn("h", F.explode_outer(every))
        .where(F.col("h").isNotNull())
        .select("conv_id", "turn", "lowered", "h.verb", "h.relationship", "h.pos")
    )
    low = F.greatest(F.lit(0), F.col("pos") - CONTEXT)
    windows = parts.select(
        "conv_id", "turn", "verb", "relationship", "pos",
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("side"), F.substring("lowered", low + 1, F.col("pos") - low).alias("window")),
                F.struct(F.lit("after").alias("side"), F.substring("lowered", F.col("pos") + 1, F.lit(CONTEXT)).alias("window")),
            )
        ).alias("w"),
    ).select("conv_id", "turn", "verb", "relationship", "pos", "w.*")
    cut = F.transform(F.sequence(F.lit(2), F.lit(PREFIX)), lambda n: F.substring(F.col("window"), F.col("at"), n))
    grams = (
        windows.where(F.length("window") >= 2)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("window") - 1)))
        .withColumn("gram", F.explode(F.array_distinct(cut)))
        .where(F.length("gram") >= 2)
    )
    named = entities.select("conv_id", "low", "rank", F.substring("low", 1, PREFIX).alias("gram"))
    found = grams.join(_grown(named), ["conv_id", "gram"]).where(
        F.substring(F.col("window"), F.col("at"), F.length("low")) == F.col("low")
    )
    nearest = found.groupBy("conv_id", "turn", "verb", "relationship", "pos").agg(
        F.min_by("low", F.when(F.col("side") == "before", F.struct(-F.col("at"), F.col("rank")))).alias("src"),
        F.min_by("low", F.when(F.col("side") == "after", F.struct(F.col("at"), F.col("rank")))).alias("dst"),
    )
    return nearest.where(F.col("src") != F.col("dst")).select(
        "conv_id", "src", "dst", "relationship", F.lit(NEAR_CONFIDENCE).alias("confidence"), F.lit(1).cast("bigint").alias("evidence")
    )


def degrees(relationships: DataFrame) -> DataFrame:
    """Relationships per entity, counting both ends."""
    ends = relationships.select("conv_id", F.explode(F.array("src", "dst")).alias("low"))
    return ends.groupBy("conv_id", "low").agg(F.count("*").alias("degree"))


def with_importance(entities: DataFrame, relationships: DataFrame, messages: DataFrame) -> DataFrame:
    """Importance = .3 recency + .3 frequency + .2 degree + .2 type weight, within [0, 1], rounded to 4."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("messages"))
    degree = degrees(relationships)
    top = entities.groupBy("conv_id").agg(F.max("mention_count").alias("most_mentions"))
    top_degree = degree.groupBy("conv_id").agg(F.max("degree").alias("most_degree"))
    per_conv = n.join(top, "conv_id").join(top_degree, "conv_id", "left")
    joined = entities.join(per_conv, "conv_id").join(degree, ["conv_id", "low"], "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )
    recency = F.col("last_turn") / F.col("messages")
    raw = (
        0.3 * recency
        + 0.3 * F.col("mention_count") / F.col("most_mentions")
        + 0.2 * F.col("degree") / F.coalesce("most_degree", F.lit(1))
        + 0.2 * dims.type_weight("type")
    )
    return joined.withColumns(
        {"recency": recency, "importance": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4)}
    ).drop("messages", "most_mentions", "most_degree")


def entity_rows(scored: DataFrame, relationships: DataFrame) -> DataFrame:
    """Final entity rows with their outgoing relationships as a list."""
    targets = scored.select("conv_id", F.col("low").alias("dst"), F.col("name").alias("target"))
    outgoing = (
        relationships.join(targets, ["conv_id", "dst"])
        .groupBy("conv_id", F.col("src").alias("low"))
        .agg(F.array_sort(F.collect_list(F.struct("target", "relationship", "confidence"))).alias("relationships"))
    )
    return scored.join(outgoing, ["conv_id", "low"], "left").select(
        "conv_id", "name", "type", "aliases", F.col("first_turn").alias("first_mentioned_at"), "importance", "relationships"
    )


def graph(scored: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes per entity, and the edges whose two ends are nodes."""
    nodes = scored.select("conv_id", "low", F.col("name").alias("label"), F.col("type").alias("group"))
    known = nodes.select("conv_id", "low")
    edges = relationships.join(known.withColumnRenamed("low", "src"), ["conv_id", "src"], "left_semi").join(
        known.withColumnRenamed("low", "dst"), ["conv_id", "dst"], "left_semi"
    )
    return nodes, edges.select("conv_id", "src", "dst", "relationship", F.col("confidence").alias("weight"))


def extraction_stats(raw: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    a = raw.groupBy("conv_id").agg(F.count("*").alias("raw_entities"))
    b = entities.groupBy("conv_id").agg(F.count("*").alias("entities"))
    c = relationships.groupBy("conv_id").agg(F.count("*").alias("relationships"))
    joined = a.join(b, "conv_id", "left").join(c, "conv_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "conv_id", "raw_entities", F.coalesce("entities", zero).alias("entities"),
        F.coalesce("relationships", zero).alias("relationships"),
    )
