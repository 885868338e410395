"""Operators on proposed links: filters, deduplication, scoring, ranking, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skosloom.config import DEFAULTS, Settings
from skosloom.functions.text import confidence_bucket, normalize_text

CORE = ("child", "parent", "child_uri", "parent_uri", "confidence", "type", "source")

# Multipliers of a link's confidence by its source.
MULTIPLIERS = {"existing_skos_broader": 1.0, "broader_from_preflabel": 1.0, "pattern_inclusion": 1.0, "pattern_specialized": 0.9, "lexical_similarity": 0.9, "embedding": 0.8, "generation": 0.7}

# Confidence of a link without one, by its source.
DEFAULT_CONFIDENCE = {"existing_skos_broader": 0.9, "pattern_inclusion": 0.8, "lexical_similarity": 0.6, "embedding": 0.7, "generation": 0.5}

# Order of the discovery methods when the first of equal links is kept.
METHOD_ORDER = ("pattern_analogy", "graph_proximity", "zone_enrichment", "abstract_concept")


def usable(rel: DataFrame) -> DataFrame:
    """Links whose confidence is a number from 0 to 1."""
    c = F.col("confidence")
    return rel.where(c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0))


def without_self_links(rel: DataFrame) -> DataFrame:
    """Drops links of a node to itself, and those whose two ends are both unknown."""
    return rel.where(~F.col("child_uri").eqNullSafe(F.col("parent_uri")))


def at_least(rel: DataFrame, confidence: float) -> DataFrame:
    return usable(rel).where(F.col("confidence") >= confidence)


def of_type(rel: DataFrame, kind: str) -> DataFrame:
    """``existing_parent`` or ``candidate_parent`` links."""
    return rel.where(F.col("type") == kind)


def violations(rel: DataFrame) -> DataFrame:
    """One row of counts: missing core fields, confidences out of range, links to oneself."""
    c = F.col("confidence")
    missing = F.greatest(*[F.col(x).isNull().cast("int") for x in ("child", "parent", "confidence", "type", "source")]) == 1
    return rel.agg(
        F.count(F.lit(1)).alias("n_relations"),
        F.count_if(missing).alias("n_missing_field"),
        F.count_if(c.isNotNull() & ~F.coalesce(~F.isnan(c) & c.between(0.0, 1.0), F.lit(False))).alias("n_bad_confidence"),
        F.count_if(F.coalesce(F.col("child_uri") == F.col("parent_uri"), F.lit(False))).alias("n_self"),
    )


def require_valid(rel: DataFrame) -> DataFrame:
    """``rel``, or an error that names what is wrong; one aggregate over all rows."""
    absent = [c for c in CORE if c not in rel.columns]
    if absent:
        raise ValueError(f"links lack the columns {absent}")
    bad = {k: v for k, v in violations(rel).first().asDict().items() if k != "n_relations" and v}
    if bad:
        raise ValueError(f"invalid links: {bad}")
    return rel


def filled_confidence() -> Column:
    """Confidence, else the default of the source, else 0.5."""
    by_source = F.lit(None).cast("double")
    for s, v in DEFAULT_CONFIDENCE.items():
        by_source = F.when(F.col("source") == s, v).otherwise(by_source)
    c = F.col("confidence")
    return F.coalesce(F.when(~F.isnan(c) & c.between(0.0, 1.0), c), by_source, F.lit(0.5))


def best_by(rel: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in a total order; Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rel.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 1).drop("_n")


def dedup_best(rel: DataFrame) -> DataFrame:
    """Per pair of URIs the link of highest confidence, the first of equal ones."""
    return best_by(usable(rel), ["child_uri", "parent_uri"], F.desc("confidence"), F.asc("seq"))


def dedup_first(rel: DataFrame) -> DataFrame:
    """Per pair of labels the first link by discovery method, then order."""
    place = F.lit(len(METHOD_ORDER))
    for i, m in reversed(list(enumerate(METHOD_ORDER))):
        place = F.when(F.col("discovery_method") == m, i).otherwise(place)
    return best_by(rel.withColumn("method_place", place), ["child", "parent"], F.asc("method_place"), F.asc("seq"))


def scored(rel: DataFrame) -> DataFrame:
    """``rel`` with ``score``: confidence times the multiplier of its source, 1 at most."""
    m = F.lit(1.0)
    for s, v in MULTIPLIERS.items():
        m = F.when(F.col("source") == s, v).otherwise(m)
    return rel.withColumn("score", F.least(F.lit(1.0), F.col("confidence") * m))


def accepted(rel: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per pair of labels the link of highest score, the first of equal ones, if it reaches the threshold."""
    return best_by(scored(usable(rel)), ["child", "parent"], F.desc("score"), F.asc("seq")).where(F.col("score") >= settings.acceptance)


def top_with_ties(rel: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per child the links of the highest confidences; a group of ties stays whole."""
    w = Window.partitionBy("child_uri").orderBy(F.desc("confidence"))
    return usable(rel).withColumn("place", F.rank().over(w)).where(F.col("place") <= settings.max_parents)


def top_per_category(rel: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("relation_category").orderBy(F.desc("confidence"), F.asc("seq"))
    return usable(rel).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def parent_cap(rel: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per child exactly the first links by confidence, then order."""
    w = Window.partitionBy("child_uri").orderBy(F.desc("confidence"), F.asc("seq"))
    return usable(rel).withColumn("place", F.row_number().over(w)).where(F.col("place") <= settings.max_parents)


def candidate_groups(rel: DataFrame) -> DataFrame:
    """Candidates by parent, largest group first."""
    g = of_type(rel, "candidate_parent").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("child_uri").alias("n_children"))
    return g.orderBy(F.desc("n"), F.asc("parent"))


def group_key(c: Column) -> Column:
    """Key of spelling variants: normalised, each word without a French plural or feminine ending (a rule in place of a lemmatiser)."""
    stem = lambda w: F.when(F.length(w) > 4, F.regexp_replace(F.regexp_replace(w, "aux$", "al"), "(?:es|e|s|x)$", "")).otherwise(w)
    return F.array_join(F.transform(F.split(normalize_text(c), " "), stem), " ")


def review_queue(rel: DataFrame) -> DataFrame:
    """Groups of candidates to decide on: ``group_key``, variants, children, mean confidence and the first ten children.

    The sample is its first ten children; the variants are all there.
    """
    cand = of_type(usable(rel), "candidate_parent").withColumn("group_key", group_key(F.col("parent"))).where(F.col("group_key") != "")
    per_child = cand.groupBy("group_key", "child").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("group_key").orderBy("seq")
    sample = per_child.withColumn("i", F.row_number().over(w)).where(F.col("i") <= 10).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("seq", "child"))).alias("s"))
    per_name = cand.groupBy("group_key", "parent").agg(F.min("seq").alias("seq"))
    names = per_name.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("seq", "parent"))).alias("v"))
    sums = cand.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("child").alias("n_children"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    out = sums.join(names, "group_key").join(sample, "group_key")
    return out.select("group_key", F.array_join(F.transform("v", lambda x: x["parent"]), " | ").alias("variants"), "n_links", "n_children", "avg_confidence", F.array_join(F.transform("s", lambda x: x["child"]), " | ").alias("children"))


def apply_decisions(rel: DataFrame, decisions: DataFrame, terms: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates after review, with their log columns ``action`` and ``taken``.

    ``decisions``: ``group_key``, ``action`` (A accept, R reject, M modify, I
    individually, S skip), ``alternative_term``, ``child_uri`` (only for I; one
    row per accepted child, else null).  ``terms``: ``term``, ``uri`` of
    resolved alternative terms and accepted labels.  Accepted terms get the URI
    that ``terms`` has for them, so that they can become nodes.
    """
    cand = of_type(rel, "candidate_parent").withColumn("group_key", group_key(F.col("parent")))
    whole = decisions.where(F.col("child_uri").isNull()).select("group_key", "action", "alternative_term")
    single = decisions.where(F.col("child_uri").isNotNull() & (F.col("action") == "I")).select("group_key", "child_uri", F.lit(True).alias("yes")).distinct()
    d = cand.join(whole, "group_key", "left").join(single, ["group_key", "child_uri"], "left").withColumn("action", F.coalesce("action", F.lit(settings.review_default)))
    taken = F.when(F.col("action").isin("A", "M"), True).when(F.col("action") == "I", F.coalesce("yes", F.lit(False))).otherwise(False)
    named = d.withColumn("taken", taken).withColumn("parent", F.when(F.col("action") == "M", F.coalesce("alternative_term", "parent")).otherwise(F.col("parent")))
    uris = terms.select(F.col("term").alias("parent"), F.col("uri").alias("_uri"))
    return named.join(uris, "parent", "left").withColumn("parent_uri", F.when(F.col("taken"), F.coalesce("_uri", "parent_uri")).otherwise(F.col("parent_uri"))).drop("_uri", "yes", "alternative_term")


def category_statistics(rel: DataFrame) -> DataFrame:
    """Counts in all, by category, by confidence bucket and by source, in one pass of grouping sets."""
    r = usable(rel).withColumn("bucket", confidence_bucket(F.col("confidence")))
    r = r.select("relation_category", "bucket", "source")
    sets = r.groupingSets([[], ["relation_category"], ["bucket"], ["source"]], "relation_category", "bucket", "source")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "category").when(F.col("gid") == 5, "bucket").otherwise("source").alias("kind"),
        F.coalesce("relation_category", "bucket", "source").alias("val"),
        "n",
    )


def validation_sample(rel: DataFrame, n: int = 100) -> DataFrame:
    """The best links of each category, ``n`` in all, with mean and population deviation of their confidences."""
    categories = usable(rel).agg(F.count_distinct("relation_category").alias("k"))
    per = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.col("k"), F.lit(1))))
    w = Window.partitionBy("relation_category").orderBy(F.desc("confidence"), F.asc("seq"))
    top = usable(rel).where(F.col("relation_category").isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    top = top.join(F.broadcast(categories), how="inner").where(F.col("place") <= per)
    return top.groupBy("relation_category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.stddev_pop("confidence"), 6).alias("sd_confidence"), F.max("place").alias("last_place"))


def random_sample(rel: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` links drawn by a hash of ``seq``, the same on every run (a sampling operator)."""
    return rel.orderBy(F.xxhash64(F.lit(seed), F.col("seq")), "seq").limit(n)


def method_counts(rel: DataFrame) -> DataFrame:
    """Counters of the detectors: links by category and type."""
    return rel.groupBy("relation_category", "type").agg(F.count(F.lit(1)).alias("n"))


def mined_patterns(rel: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Patterns of children and their parents: kind, text, frequency, all parents met, the one most often met and its share, the first three children.

    A suffix pattern comes from a child ``x-y`` with ``y`` in the parent, a
    prefix pattern from a first word that is a word of the parent, a contains
    pattern from each child word of four letters or more within the parent.
    Equal counts go to the parent met first.
    """
    r = rel.select("seq", F.trim("child").alias("child"), F.trim("parent").alias("parent")).where((F.col("child") != "") & (F.col("parent") != ""))
    lc, lp = F.lower("child"), F.lower("parent")
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    dash = F.split("child", "-")
    suffix = F.when((F.size(dash) == 2) & (F.trim(dash[1]) != "") & F.contains(lp, F.lower(F.trim(dash[1]))), F.array(F.struct(F.lit("suffix").alias("kind"), F.concat(F.lit("*-"), F.trim(dash[1])).alias("text"))))
    ws = split("child")
    first = F.when((F.size(ws) > 1) & F.array_contains(split(lp), F.lower(F.element_at(ws, F.lit(1)))), F.array(F.struct(F.lit("prefix").alias("kind"), F.concat(F.element_at(ws, F.lit(1)), F.lit(" *")).alias("text"))))
    inner = F.transform(F.filter(split(lc), lambda x: (F.length(x) >= 4) & F.contains(lp, x)), lambda x: F.struct(F.lit("contains").alias("kind"), F.concat(F.lit("*"), x, F.lit("*")).alias("text")))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    met = r.select("seq", "child", "parent", F.explode(F.concat(F.coalesce(suffix, none), F.coalesce(first, none), inner)).alias("p")).select("seq", "child", "parent", "p.kind", "p.text")
    per = met.groupBy("kind", "text", "parent").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = per.groupBy("kind", "text").agg(F.array_sort(F.collect_list("parent")).alias("target_parents"), F.sum("n").alias("frequency"), F.max(F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col("parent"))).alias("b"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n_parents"))
    # the first three children met, ranked before they are collected
    w = Window.partitionBy("kind", "text").orderBy("seq", "child")
    some = met.withColumn("i", F.row_number().over(w)).where(F.col("i") <= 3).groupBy("kind", "text").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "child"))), lambda x: x["child"]).alias("examples"))
    kept = best.where(F.col("frequency") >= settings.pattern_min_frequency).join(some, ["kind", "text"])
    return kept.select(F.col("kind").alias("pattern_type"), F.col("text").alias("pattern_text"), "frequency", "n_parents", "target_parents", F.col("b.parent").alias("most_common_parent"), F.round(F.col("b.n") / F.col("frequency"), 6).alias("confidence"), "examples")


def mode_first_seen(df: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """Most frequent value of each key; of equal ones the first seen."""
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    return per.groupBy(key).agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), F.col("b.n").alias("n"))


def discovery_statistics(rel: DataFrame) -> DataFrame:
    """Links of each discovery category: number, children, mean and best confidence."""
    return usable(rel).groupBy("relation_category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("child_uri").alias("n_children"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.max("confidence").alias("max_confidence"))


def zone_members(rel: DataFrame) -> DataFrame:
    """``zone_id``, ``uri``: members of the zones that links name as their evidence."""
    return rel.where(F.col("supporting_evidence.zone_id").isNotNull() & F.col("child_uri").isNotNull()).select(F.col("supporting_evidence.zone_id").alias("zone_id"), F.col("child_uri").alias("uri")).distinct()


def zone_network(rel: DataFrame) -> DataFrame:
    """``parent``, ``child``, ``n``, ``confidence``: links with both ends in zones."""
    nodes = zone_members(rel).select("uri").distinct()
    e = usable(rel).where(F.col("child_uri").isNotNull() & F.col("parent_uri").isNotNull()).groupBy(F.col("parent_uri").alias("parent"), F.col("child_uri").alias("child")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
    return e.join(nodes.withColumnRenamed("uri", "parent"), "parent", "left_semi").join(nodes.withColumnRenamed("uri", "child"), "child", "left_semi").select("parent", "child", "n", "confidence")


def zone_profile(rel: DataFrame) -> DataFrame:
    """``zone_id``, members, ``dominant_source`` (the first by name of equal ones) and ``source_diversity`` of every zone."""
    r = rel.where(F.col("supporting_evidence.zone_id").isNotNull()).select(F.col("supporting_evidence.zone_id").alias("zone_id"), "child_uri", "source")
    per = r.where(F.col("source").isNotNull()).groupBy("zone_id", "source").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("zone_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("source"))).alias("b"), F.count(F.lit(1)).alias("source_diversity"))
    return r.groupBy("zone_id").agg(F.count_distinct("child_uri").alias("n_members"), F.count(F.lit(1)).alias("n_links")).join(top, "zone_id", "left").select("zone_id", "n_members", "n_links", F.col("b.source").alias("dominant_source"), "source_diversity").orderBy(F.desc("n_links"), "zone_id")


def zone_of(rel: DataFrame, zone_id: int) -> DataFrame:
    """Members of one zone."""
    return zone_members(rel).where(F.col("zone_id") == zone_id)


def pattern_of(patterns: DataFrame, text: str) -> DataFrame:
    """Patterns of one text."""
    return patterns.where(F.col("pattern_text") == text)


def relation_graph(rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (``id``, ``label`` of the first link, degrees) and edges with attributes (links, best confidence, sources) of all links with two ends."""
    r = rel.where(F.col("child_uri").isNotNull() & F.col("parent_uri").isNotNull())
    c = F.col("confidence")
    good = F.when(c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0), c)
    edges = r.groupBy(F.col("parent_uri").alias("parent"), F.col("child_uri").alias("child")).agg(F.count(F.lit(1)).alias("n"), F.max(good).alias("confidence"), F.count_distinct("source").alias("n_sources"), F.min("seq").alias("first_seq"))
    ends = r.select(F.col("child_uri").alias("id"), F.col("child").alias("label"), "seq").unionByName(r.select(F.col("parent_uri").alias("id"), F.col("parent").alias("label"), "seq"))
    named = ends.groupBy("id").agg(F.min(F.when(F.col("label").isNotNull(), F.struct("seq", "label")))["label"].alias("label"))
    out = edges.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    into = edges.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n_parents"))
    return named.join(out, "id", "left").join(into, "id", "left").na.fill(0, ["n_children", "n_parents"]), edges
