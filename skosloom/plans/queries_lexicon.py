"""Queries of scalar functions, indexes and label links over the concept file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skosloom.functions import text as X
from skosloom.operators import lexicon as L
from skosloom.plans import sql as S
from skosloom.sources.tables import table


def _c(spark: SparkSession, d: str) -> DataFrame:
    return L.prepare(table(spark, d, "concepts"))


def s1_scan(spark, d):
    """Concept file with its null tokens mapped."""
    c = L.null_tokens(table(spark, d, "concepts"))
    return c.select("row_id", "URI", F.col("`skos:prefLabel`").alias("pref"), F.col("`skos:definition`").alias("definition"), F.col("`skos:altLabel`").alias("alt"))


def f1_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


def f3_valid_words(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split(X.normalize_text(F.col("text")), " ")).alias("word"))
    return w.where(X.valid_word(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def f4_extract_source(spark, d):
    return _c(spark, d).select("row_id", "definition", "source")


def f5_broader_from_label(spark, d):
    return _c(spark, d).select("row_id", "label", "label_term")


def f8_assign_uri(spark, d):
    return _c(spark, d).select("row_id", "uri", "had_uri")


def f9_tokenize(spark, d):
    return _c(spark, d).select("row_id", F.array_join(X.tokens(F.col("norm")), " ").alias("words"))


def f10_de_en_pour(spark, d):
    c = _c(spark, d)
    parts = []
    for k in ("de", "en", "pour"):
        base, rest = X.base_and_complement(F.col("norm"), k)
        parts.append(c.select("row_id", F.lit(k).alias("keyword"), base.alias("base"), rest.alias("complement")).where(F.col("base").isNotNull()))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def f11_adjective(spark, d):
    adj, base = X.adjective_and_base(F.col("norm"))
    return _c(spark, d).select("row_id", adj.alias("adjective"), base.alias("base")).where(F.col("adjective").isNotNull())


def f14_levenshtein(spark, d):
    """Edit distance of each concept's label to that of the first concept with its normalised label's first word."""
    c = _c(spark, d).where(F.col("norm") != "").withColumn("w", F.split("norm", " ")[0])
    first = c.groupBy("w").agg(F.min_by("norm", "row_id").alias("other"))
    return c.join(first, "w").select("row_id", F.levenshtein("norm", "other").alias("distance"))


def f15_prefix_roots(spark, d):
    return L.prefix_roots(_c(spark, d).select(F.explode(F.split(F.lower("label"), " ")).alias("word")))


def f15_suffix_root(spark, d):
    w = _c(spark, d).select(F.explode(F.split(F.lower("label"), " ")).alias("word")).where(F.length("word") >= 4).distinct()
    return w.select("word", X.stem(F.col("word")).alias("root"))


def k4_uri_list(spark, d):
    return table(spark, d, "nodes").select("uri", X.uri_list(F.col("parents")).alias("broader"), X.uri_list(F.col("children")).alias("narrower"))


def k8_xml_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.xml_text(F.col("text")).alias("xml"))


def k9_multi_value(spark, d):
    return _c(spark, d).select("row_id", F.posexplode(X.multi_value(F.col("alt"))).alias("pos", "val"))


def a1_word_freq(spark, d):
    return L.word_frequency(_c(spark, d)).where(F.col("freq") >= 3)


def a2_broader_freq(spark, d):
    return L.term_frequency(_c(spark, d)).where(F.col("freq") >= 2)


def a3_label_index(spark, d):
    c = _c(spark, d)
    first, last = L.first_labels(c), L.uri_labels(c).withColumnRenamed("norm", "last_norm")
    return first.join(last, first.first_uri == last.uri, "left").select("key", "first_uri", "last_norm")


def a3_alt_index(spark, d):
    return L.alt_labels(_c(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("lowest_uri"))


def j1_explicit_broader(spark, d):
    return L.explicit_broader(_c(spark, d))


def j2_label_broader(spark, d):
    return L.label_broader(_c(spark, d))


def j4_word_inclusion(spark, d):
    return L.word_inclusion(_c(spark, d))


def j5_pattern_de(spark, d):
    return L.phrase_pattern(_c(spark, d), "de")


def j5_pattern_en(spark, d):
    return L.phrase_pattern(_c(spark, d), "en")


def j5_pattern_pour(spark, d):
    return L.phrase_pattern(_c(spark, d), "pour")


def j6_adjectival(spark, d):
    return L.adjective_pattern(_c(spark, d))


def j15_alt_resolution(spark, d):
    terms = _c(spark, d).where(F.col("alt").isNotNull()).select(F.explode(X.multi_value(F.col("alt"))).alias("term"))
    return L.resolve_terms(terms, _c(spark, d))


def j17_missing_uri(spark, d):
    return L.missing_uris(_c(spark, d), table(spark, d, "nodes")).select("row_id", "uri", "label")


def a16_stats(spark, d):
    return L.concept_statistics(_c(spark, d))


def flagship_word_inclusion_topk(spark, d):
    """Word-inclusion links, the best three parents of each child kept with whole groups of ties."""
    rel = L.word_inclusion(_c(spark, d)).groupBy("child_uri", "parent", "parent_uri", "type").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("child_uri").orderBy(F.desc("confidence"))
    return rel.withColumn("place", F.rank().over(w)).where(F.col("place") <= 3)


QUERIES = {f.__name__: f for f in (s1_scan, f1_normalize_text, f3_valid_words, f4_extract_source, f5_broader_from_label, f8_assign_uri, f9_tokenize, f10_de_en_pour, f11_adjective, f14_levenshtein, f15_suffix_root, f15_prefix_roots, k4_uri_list, k8_xml_escape, k9_multi_value, a1_word_freq, a2_broader_freq, a3_label_index, a3_alt_index, j1_explicit_broader, j2_label_broader, j4_word_inclusion, j5_pattern_de, j5_pattern_en, j5_pattern_pour, j6_adjectival, j15_alt_resolution, j17_missing_uri, a16_stats, flagship_word_inclusion_topk)}

_C = S.with_(S.CONCEPTS)
_BROADER = S.with_(S.CONCEPTS, S.FIRST, f"told AS (SELECT *, {S.norm('b')} AS key FROM (SELECT row_id, pref, uri, {S.trim_ws('x')} AS b FROM (SELECT row_id, pref, uri, unnest(string_split_regex(broader, '##|, ')) AS x FROM c WHERE broader IS NOT NULL)) WHERE b <> '')")
_LABEL = S.with_(S.CONCEPTS, S.FIRST, f"told AS (SELECT row_id, label, uri, label_term, {S.norm('label_term')} AS key FROM c WHERE label_term IS NOT NULL)", "tf AS (SELECT key, count(*) AS freq FROM told WHERE key <> '' GROUP BY 1)")
_LIST = lambda x: f"array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter({x}, lambda v: v IS NOT NULL)), lambda v: struct_pack(p := list_position({x}, v), v := v))), lambda s: s.v), ' ## ')"
_DOC_WORDS = f"SELECT unnest(string_split({S.norm('text')}, ' ')) AS word FROM documents"
_XML = S.trim_ws("coalesce(text, '')")
_INCLUSION = S.by_base("SELECT c.row_id, c.label, c.uri, unnest(tk.t) AS key FROM c JOIN tk ON tk.row_id = c.row_id WHERE len(tk.t) > 1 AND c.norm <> ''", 1.0, 0.8, "word_inclusion", "pattern_inclusion")
_ALTS = f"alts AS (SELECT {S.norm('a')} AS key, uri FROM (SELECT uri, unnest(string_split_regex(alt, '##|, ')) AS a FROM c))"

ORACLE = {
    "s1_scan": f"""SELECT row_id, {S.null('"URI"')} AS "URI", {S.null('"skos:prefLabel"')} AS pref, {S.null('"skos:definition"')} AS definition, {S.null('"skos:altLabel"')} AS alt FROM concepts""",
    "f1_normalize_text": f"SELECT doc_id, {S.norm('text')} AS norm FROM documents",
    "f3_valid_words": rf"SELECT word, count(*)::BIGINT AS n FROM ({_DOC_WORDS}) WHERE length(word) >= 3 AND regexp_full_match(word, '\p{{L}}+') AND word NOT IN ({S.quoted(S.STOP_WORDS)}) GROUP BY 1",
    "f4_extract_source": "WITH " + S.DEFINITION + " SELECT row_id, definition, source FROM defs",
    "f5_broader_from_label": _C + "SELECT row_id, label, label_term FROM c",
    "f8_assign_uri": _C + "SELECT row_id, uri, had_uri FROM c",
    "f9_tokenize": S.with_(S.CONCEPTS, S.FREQ) + "SELECT row_id, array_to_string(t, ' ') AS words FROM tk",
    "f10_de_en_pour": _C + " UNION ALL ".join(rf"SELECT row_id, '{k}' AS keyword, regexp_extract(norm, '^(.+?)\s+{k}\s+(.+)$', 1) AS base, regexp_extract(norm, '^(.+?)\s+{k}\s+(.+)$', 2) AS complement FROM c WHERE regexp_matches(norm, '^(.+?)\s+{k}\s+(.+)$')" for k in ("de", "en", "pour")),
    "f11_adjective": _C + rf"SELECT row_id, adjective, trim(regexp_replace(replace(norm, adjective, ''), '\s+', ' ', 'g')) AS base FROM (SELECT row_id, norm, regexp_extract(norm, '{S.ADJ}', 1) AS adjective FROM c WHERE regexp_matches(norm, '{S.ADJ}'))",
    "f14_levenshtein": _C + ", w AS (SELECT row_id, norm, split_part(norm, ' ', 1) AS w FROM c WHERE norm <> ''), f AS (SELECT w, arg_min(norm, row_id) AS other FROM w GROUP BY 1) SELECT row_id, levenshtein(norm, other)::INT AS distance FROM w JOIN f USING (w)",
    "f15_suffix_root": _C + f", w AS (SELECT DISTINCT unnest(string_split(lower(label), ' ')) AS w FROM c) SELECT w AS word, {S.STEM} AS root FROM w WHERE length(w) >= 4",
    "f15_prefix_roots": _C + ", w AS (SELECT DISTINCT unnest(string_split(lower(label), ' ')) AS w FROM c), v AS (SELECT w FROM w WHERE length(w) >= 4) SELECT DISTINCT left(a.w, list_max(list_filter(range(4, least(length(a.w), length(b.w)) + 1), lambda i: left(a.w, i) = left(b.w, i)))) AS root FROM v a JOIN v b ON left(a.w, 4) = left(b.w, 4) AND a.w < b.w",
    "k4_uri_list": f"SELECT uri, {_LIST('coalesce(parents, []::VARCHAR[])')} AS broader, {_LIST('coalesce(children, []::VARCHAR[])')} AS narrower FROM nodes",
    "k8_xml_escape": rf"SELECT doc_id, regexp_replace(replace(replace(replace({_XML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS xml FROM documents",
    "k9_multi_value": _C + f", v AS (SELECT row_id, list_filter(list_transform(string_split(coalesce(alt, ''), '##'), lambda x: {S.trim_ws('x')}), lambda x: x <> '') AS l FROM c) SELECT row_id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS val FROM v",
    "a1_word_freq": S.with_(S.CONCEPTS, S.FREQ) + "SELECT word, freq FROM freq WHERE freq >= 3",
    "a2_broader_freq": _LABEL + "SELECT key AS term, freq::BIGINT AS freq FROM tf WHERE freq >= 2",
    "a3_label_index": S.with_(S.CONCEPTS, S.FIRST, "u AS (SELECT uri, arg_max(norm, row_id) AS last_norm FROM c WHERE norm <> '' GROUP BY 1)") + "SELECT key, first_uri, last_norm FROM lab LEFT JOIN u ON u.uri = lab.first_uri",
    "a3_alt_index": S.with_(S.CONCEPTS, _ALTS) + "SELECT key, count(*)::BIGINT AS n, min(uri) AS lowest_uri FROM alts WHERE key <> '' GROUP BY 1",
    "j1_explicit_broader": _BROADER + "SELECT row_id, pref AS child, uri AS child_uri, b AS parent, first_uri AS parent_uri, 1.0::DOUBLE AS confidence, CASE WHEN first_uri IS NOT NULL THEN 'existing_parent' ELSE 'candidate_parent' END AS type, 'skos:broader_column' AS source, 'existing_skos_broader' AS relation_category FROM told LEFT JOIN lab USING (key)",
    "j2_label_broader": _LABEL + "SELECT row_id, label AS child, uri AS child_uri, label_term AS parent, first_uri AS parent_uri, CASE WHEN first_label IS NOT NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN first_label IS NOT NULL THEN 'existing_parent' ELSE 'candidate_parent' END AS type, 'broader_from_preflabel' AS source, 'preflabel_parenthesis' AS relation_category FROM told LEFT JOIN lab USING (key) LEFT JOIN tf USING (key) WHERE key <> '' AND (first_label IS NOT NULL OR freq >= 2)",
    "j4_word_inclusion": _INCLUSION,
    **{f"j5_pattern_{k}": S.by_base(S.phrase_base(k), 0.9, 0.9 * 0.8, f"{k}_pattern") for k in ("de", "en", "pour")},
    "j6_adjectival": S.by_base(rf"SELECT row_id, label, uri, key FROM (SELECT *, trim(regexp_replace(replace(norm, regexp_extract(norm, '{S.ADJ}', 1), ''), '\s+', ' ', 'g')) AS key FROM c WHERE regexp_matches(norm, '{S.ADJ}')) WHERE key <> ''", 0.8, 0.6, "adjectival_pattern"),
    "j15_alt_resolution": S.with_(S.CONCEPTS, S.FIRST, _ALTS, "ag AS (SELECT key, min(uri) AS alt_uri, min(uri) = max(uri) AS one FROM alts WHERE key <> '' GROUP BY 1)", f"t AS (SELECT term, {S.norm('term')} AS key FROM (SELECT DISTINCT term FROM (SELECT unnest(list_filter(list_transform(string_split(alt, '##'), lambda x: {S.trim_ws('x')}), lambda x: x <> '')) AS term FROM c WHERE alt IS NOT NULL)))") + f"SELECT term, coalesce(first_uri, alt_uri, '{S.BASE}' || sha256(key)) AS uri, CASE WHEN first_uri IS NOT NULL THEN 'label' WHEN alt_uri IS NOT NULL THEN 'alt' ELSE 'minted' END AS found_by FROM t LEFT JOIN lab USING (key) LEFT JOIN ag USING (key) WHERE key <> '' AND (first_uri IS NOT NULL OR alt_uri IS NULL OR one)",
    "j17_missing_uri": _C + "SELECT row_id, uri, label FROM c UNION ALL SELECT NULL, uri, NULL FROM (SELECT DISTINCT uri FROM nodes WHERE uri IS NOT NULL AND uri NOT IN (SELECT uri FROM c))",
    "a16_stats": "WITH " + S.DEFINITION + ",\n" + S.CONCEPTS + f"""SELECT count(*)::BIGINT AS n_concepts, count(DISTINCT uri)::BIGINT AS n_uris, count(DISTINCT CASE WHEN norm <> '' THEN norm END)::BIGINT AS n_labels, count(label_term)::BIGINT AS n_with_term,
  count(*) FILTER (WHERE source <> '')::BIGINT AS n_with_source, count(alt)::BIGINT AS n_with_alt, count(broader)::BIGINT AS n_with_broader, count(*) FILTER (WHERE uri LIKE '{S.BASE}%')::BIGINT AS n_uris_of_base,
  count(*) FILTER (WHERE len(string_split(norm, ' ')) > 1)::BIGINT AS n_multiword, round(avg(length(label)), 6) AS avg_label_length FROM c JOIN defs USING (row_id)""",
    "flagship_word_inclusion_topk": f"SELECT * FROM (SELECT *, rank() OVER (PARTITION BY child_uri ORDER BY confidence DESC)::INT AS place FROM (SELECT child_uri, parent, parent_uri, type, max(confidence) AS confidence FROM ({_INCLUSION}) GROUP BY ALL)) WHERE place <= 3",
}
