"""Prepared concepts, lexical indexes, and links found in columns and labels.

Concepts carry ``row_id`` (file order); wherever a label names several
concepts, the first or last row wins as each operator states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skosloom.config import DEFAULTS, Settings
from skosloom.functions.labels import NULL_TOKENS
from skosloom.functions.text import adjective_and_base, base_and_complement, label_parts, normalize_text, source_parts, tokens, trim_ws
from skosloom.plans.skew import HOT_KEYS, lookup

RELATION = ["row_id", "child", "child_uri", "parent", "parent_uri", "confidence", "type", "source", "relation_category"]


def null_tokens(df: DataFrame) -> DataFrame:
    """Null tokens of all text columns as null; the tokens are compared exactly."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")) for c in text})


def minted_uri(row_id: Column, label: Column, settings: Settings = DEFAULTS) -> Column:
    """A URI that a recomputation mints again: the base and a digest of row and label."""
    return F.concat(F.lit(settings.uri_base), F.sha2(F.concat_ws("|", row_id.cast("string"), F.coalesce(label, F.lit(""))), 256))


def prepare(concepts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``row_id``, ``uri``, ``label`` (cleaned), ``label_term``, ``norm``, ``definition``, ``source`` and the other fields."""
    c = null_tokens(concepts)
    label = F.col("`skos:prefLabel`")
    clean, term = label_parts(label)
    definition, source = source_parts(F.col("`skos:definition`"))
    out = c.select(
        "row_id", F.coalesce(F.col("URI"), minted_uri(F.col("row_id"), label, settings)).alias("uri"), F.col("URI").isNotNull().alias("had_uri"), label.alias("pref"), clean.alias("label"), term.alias("label_term"),
        definition.alias("definition"), source.alias("source"), F.col("`skos:altLabel`").alias("alt"), F.col("`skos:broader`").alias("broader"),
    )
    return out.withColumn("norm", normalize_text(F.col("label")))


def first_labels(c: DataFrame) -> DataFrame:
    """``key``, ``first_label``, ``first_uri``: the first concept of each normalised label."""
    return c.where(F.col("norm") != "").groupBy(F.col("norm").alias("key")).agg(F.min_by("label", "row_id").alias("first_label"), F.min_by("uri", "row_id").alias("first_uri"))


def last_labels(c: DataFrame) -> DataFrame:
    """``label``, ``last_uri``: the last concept of each cleaned label."""
    return c.where(F.col("label") != "").groupBy("label").agg(F.max_by("uri", "row_id").alias("last_uri"))


def uri_labels(c: DataFrame) -> DataFrame:
    """``uri``, ``norm``: the normalised label of the last row of each URI."""
    return c.where(F.col("norm") != "").groupBy("uri").agg(F.max_by("norm", "row_id").alias("norm"))


def alt_labels(c: DataFrame) -> DataFrame:
    """``key``, ``uri``: every normalised alternative label with its concept, repeats kept."""
    alts = c.select("uri", F.explode(F.split("alt", "##|, ")).alias("a")).select(normalize_text(F.col("a")).alias("key"), "uri")
    return alts.where(F.col("key") != "")


def word_frequency(c: DataFrame) -> DataFrame:
    """``word``, ``freq``: occurrences of valid words in terms of more than one of them."""
    return c.select(tokens(F.col("norm")).alias("t")).where(F.size("t") > 1).select(F.explode("t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def term_frequency(c: DataFrame) -> DataFrame:
    """``term``, ``freq``: how often each final parenthesis occurs, normalised."""
    return c.where(F.col("label_term").isNotNull()).groupBy(normalize_text(F.col("label_term")).alias("term")).agg(F.count(F.lit(1)).alias("freq")).where(F.col("term") != "")


def _relation(df: DataFrame, parent: Column, parent_uri: Column, confidence: Column, existing: Column, source: str, category: str) -> DataFrame:
    kind = F.when(existing, "existing_parent").otherwise("candidate_parent")
    return df.select("row_id", F.col("label").alias("child"), F.col("uri").alias("child_uri"), parent.alias("parent"), parent_uri.alias("parent_uri"), confidence.cast("double").alias("confidence"), kind.alias("type"), F.lit(source).alias("source"), F.lit(category).alias("relation_category"))


def explicit_broader(c: DataFrame) -> DataFrame:
    """Links written in ``skos:broader``; labels that name no concept stay candidates."""
    told = c.where(F.col("broader").isNotNull()).select("row_id", "pref", "uri", F.explode(F.split("broader", "##|, ")).alias("b"))
    told = told.withColumn("b", trim_ws(F.col("b"))).where(F.col("b") != "").withColumn("key", normalize_text(F.col("b")))
    found = lookup(told, first_labels(c), "key", ["first_uri"]).withColumn("label", F.col("pref"))
    return _relation(found, F.col("b"), F.col("first_uri"), F.lit(1.0), F.col("first_uri").isNotNull(), "skos:broader_column", "existing_skos_broader")


def label_broader(c: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Links from a label to the term in its final parenthesis, if that is a concept or frequent."""
    told = c.where(F.col("label_term").isNotNull()).withColumn("key", normalize_text(F.col("label_term"))).where(F.col("key") != "")
    found = lookup(told.select("row_id", "label", "uri", "label_term", "key"), first_labels(c), "key", ["first_label", "first_uri"])
    found = lookup(found, term_frequency(c).withColumnRenamed("term", "key"), "key", ["freq"])
    existing = F.col("first_label").isNotNull()
    kept = found.where(existing | (F.col("freq") >= settings.min_label_term_frequency))
    return _relation(kept, F.col("label_term"), F.col("first_uri"), F.when(existing, 1.0).otherwise(0.8), existing, "broader_from_preflabel", "preflabel_parenthesis")


def _by_base(c: DataFrame, based: DataFrame, settings: Settings, confidence: float, candidate: float, category: str, source: str = "pattern_specialized") -> DataFrame:
    """Links to the concept a base names, else to the base itself where it is a frequent word."""
    freq = word_frequency(c)
    frequent = freq.where(F.col("freq") >= settings.min_word_frequency).withColumnRenamed("word", "key")
    known = first_labels(c).join(frequent, "key", "full_outer")
    hot = freq.orderBy(F.desc("freq"), "word").limit(HOT_KEYS).select(F.col("word").alias("key"))
    found = lookup(based, known, "key", ["first_label", "first_uri", "freq"], hot=hot)
    existing = F.col("first_label").isNotNull()
    kept = found.where(existing | F.col("freq").isNotNull())
    return _relation(kept, F.coalesce("first_label", "key"), F.col("first_uri"), F.when(existing, confidence).otherwise(candidate), existing, source, category)


def word_inclusion(c: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Links from a term of several words to the concept each word names, else to the word if frequent; repeats kept."""
    t = c.where(F.col("norm") != "").select("row_id", "label", "uri", tokens(F.col("norm")).alias("t"))
    based = t.where(F.size("t") > 1).select("row_id", "label", "uri", F.explode("t").alias("key"))
    return _by_base(c, based, settings, 1.0, 0.8, "word_inclusion", "pattern_inclusion")


def phrase_pattern(c: DataFrame, keyword: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Links from ``X keyword Y`` to ``X``."""
    base, _ = base_and_complement(F.col("norm"), keyword)
    based = c.select("row_id", "label", "uri", base.alias("key")).where(F.col("key").isNotNull())
    return _by_base(c, based, settings, 0.9, 0.9 * 0.8, f"{keyword}_pattern")


def adjective_pattern(c: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Links from a term with a listed adjective to the term without it."""
    _, base = adjective_and_base(F.col("norm"))
    based = c.select("row_id", "label", "uri", base.alias("key")).where(F.coalesce("key", F.lit("")) != "")
    return _by_base(c, based, settings, 0.8, 0.6, "adjectival_pattern")


def all_patterns(c: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All label patterns together."""
    out = word_inclusion(c, settings)
    for k in ("de", "en", "pour"):
        out = out.unionByName(phrase_pattern(c, k, settings))
    return out.unionByName(adjective_pattern(c, settings))


def prefix_roots(words: DataFrame, shortest: int = 4) -> DataFrame:
    """``root``: the distinct common prefixes of ``shortest`` letters or more of any two ``words.word``.

    In sorted order the common prefix of two words is that of some neighbours
    between them, so neighbours alone give all prefixes, and no pairs are made.
    """
    w = words.select("word").where(F.length("word") >= shortest).distinct()
    before = F.lag("word").over(Window.partitionBy(F.substring("word", 1, shortest)).orderBy("word"))
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.length("word"), F.length("before"))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(F.col("word"), i, F.lit(1)) == F.substring(F.col("before"), i, F.lit(1))), i).otherwise(n))
    return w.withColumn("before", before).where(F.col("before").isNotNull()).select(F.substring(F.col("word"), F.lit(1), same).alias("root")).distinct()


def resolve_terms(terms: DataFrame, c: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``term``, ``uri``, ``found_by``: a concept's label, else an alternative label of one concept only, else a minted URI.

    A term that several concepts bear as alternative label is dropped.
    """
    t = terms.select("term").distinct().withColumn("key", normalize_text(F.col("term"))).where(F.col("key") != "")
    alts = alt_labels(c).groupBy("key").agg(F.min("uri").alias("alt_uri"), (F.min("uri") == F.max("uri")).alias("one"))
    found = t.join(first_labels(c).select("key", "first_uri"), "key", "left").join(alts, "key", "left")
    found = found.where(F.col("first_uri").isNotNull() | F.col("alt_uri").isNull() | F.col("one"))
    minted = F.concat(F.lit(settings.uri_base), F.sha2("key", 256))
    by = F.when(F.col("first_uri").isNotNull(), "label").when(F.col("alt_uri").isNotNull(), "alt").otherwise("minted")
    return found.select("term", F.coalesce("first_uri", "alt_uri", minted).alias("uri"), by.alias("found_by"))


def missing_uris(c: DataFrame, uris: DataFrame) -> DataFrame:
    """Concepts with a row of nulls appended for every distinct ``uris.uri`` that no concept has."""
    new = uris.select("uri").where(F.col("uri").isNotNull()).distinct().join(c.select("uri"), "uri", "left_anti")
    return c.unionByName(new, allowMissingColumns=True)


def concept_statistics(c: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of counts over the prepared concepts."""
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return c.agg(
        F.count(F.lit(1)).alias("n_concepts"),
        F.count_distinct("uri").alias("n_uris"),
        F.count_distinct(F.when(F.col("norm") != "", F.col("norm"))).alias("n_labels"),
        n(F.col("label_term").isNotNull()).alias("n_with_term"),
        n(F.col("source") != "").alias("n_with_source"),
        n(F.col("alt").isNotNull()).alias("n_with_alt"),
        n(F.col("broader").isNotNull()).alias("n_with_broader"),
        n(F.startswith("uri", F.lit(settings.uri_base))).alias("n_uris_of_base"),
        n(F.size(F.split("norm", " ")) > 1).alias("n_multiword"),
        F.round(F.avg(F.length("label")), 6).alias("avg_label_length"),
    )
