"""Queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skosloom.functions.labels import is_null_token, words
from skosloom.llm.canonical import collapse
from skosloom.llm.encode import encoded, shared_model
from skosloom.llm.mix import mix
from skosloom.llm.setjoin import similar_classes, similar_rows
from skosloom.llm.stuffing import stuffed_pages
from skosloom.llm.survivor import fuse, survivors
from skosloom.llm.topbands import top_parents
from skosloom.plans import sql as S
from skosloom.plans.queries_core import NAMES
from skosloom.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "relations"), table(spark, sf_dir, "nodes"), table(spark, sf_dir, "detectors"))


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(table(spark, sf_dir, "relations"), table(spark, sf_dir, "nodes"), table(spark, sf_dir, "detectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "concepts"), "row_id", ["URI"], ["skos:prefLabel"])[1]


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "concepts"), "row_id", ["URI"], ["skos:prefLabel"])[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("`skos:prefLabel`")
    return similar_rows(table(spark, sf_dir, "concepts").where(~is_null_token(label)), "row_id", words(label), 0.6)


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal sets, each named by its lowest row."""
    label = F.col("`skos:prefLabel`")
    return similar_classes(table(spark, sf_dir, "concepts").where(~is_null_token(label)), "row_id", words(label), 0.6)[0]


def p6_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by random trees repeated to a target recall of 0.95."""
    label = F.col("`skos:prefLabel`")
    return similar_classes(table(spark, sf_dir, "concepts").where(~is_null_token(label)), "row_id", words(label), 0.6, recall=0.95)[0]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_parents(table(spark, sf_dir, "relations"), table(spark, sf_dir, "nodes"), 3)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", encoded(F.col("text"), shared_model(spark)).alias("ids"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_fused, p4_found, p4_counts, p6_found, p6_classes, p6_trees, p7_found, p8_ids, p9_mix, p9_shares, p10_found)}

# --- the same results in SQL; token ids, mixes and page kinds have none ---

_OK = "(confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1)"
_ENDS = ", ".join(f"coalesce({e}_uri, {e[0]}n.named, CASE WHEN {e}_uri IS NULL THEN {S.label_key(e)} END) AS {e[0]}" for e in ("child", "parent"))
_RESOLVED = f"r0 AS (SELECT *, {S.label_key('child')} AS ck, {S.label_key('parent')} AS pk FROM relations), r AS (SELECT r0.*, {_ENDS} FROM r0 LEFT JOIN names cn ON cn.key = r0.ck LEFT JOIN names pn ON pn.key = r0.pk)"
_DKEY = r"regexp_replace(lower(coalesce(source, '')), '[^\p{L}\p{N}]+', '', 'g')"
_TEXT = lambda x: f"({x} IS NOT NULL AND {S.trim_ws(x)} <> '')"
_ORD = f"o AS (SELECT r.*, d.trust, row_number() OVER (ORDER BY d.trust NULLS LAST, detected_at DESC NULLS LAST, seq) AS ord FROM r LEFT JOIN (SELECT {_DKEY} AS dk, min(trust) AS trust FROM detectors GROUP BY 1) d ON d.dk = {_DKEY})"
_PICK = lambda name, ok: f"coalesce(arg_min(seq, ord) FILTER (WHERE {ok}), -1)::BIGINT AS {name}_seq"
_NULL = lambda x: f"({x} IS NULL OR {S.trim_ws(x)} IN ('', 'NULL', 'NaN'))"
_RUNS = r"[^\p{L}\p{M}\p{N}]+"
_URI, _LABEL = '"URI"', '"skos:prefLabel"'
_COPIES = rf"""k AS (SELECT row_id, CASE WHEN {_NULL(_URI)} THEN NULL ELSE regexp_replace(lower(nfc_normalize({_URI})), '{_RUNS}', '', 'g') END AS u,
  CASE WHEN {_NULL(_LABEL)} THEN NULL ELSE array_to_string(list_sort(regexp_extract_all(lower(nfc_normalize({_LABEL})), '[\p{{L}}\p{{M}}\p{{N}}]+')), ' ') END AS l FROM concepts), g AS (SELECT *, min(row_id) OVER (PARTITION BY u, l) AS first, count(*) OVER (PARTITION BY u, l) AS copies FROM k)"""

ORACLE: dict[str, str] = {
    "p3_found": f"WITH {NAMES}, {_RESOLVED}, {_ORD} SELECT min(seq) AS group_seq, {_PICK('child', _TEXT('child'))}, {_PICK('parent', _TEXT('parent'))}, {_PICK('confidence', _OK)}, {_PICK('source', 'trust IS NOT NULL')} FROM o GROUP BY c, p HAVING count(*) > 1",
    "p4_found": f"WITH {_COPIES} SELECT first AS row_id_a, row_id AS row_id_b FROM g WHERE row_id > first",
    "p4_counts": f"WITH {_COPIES} SELECT first AS row_id, any_value(copies)::BIGINT AS copies FROM g GROUP BY 1",
    "p6_found": f"WITH w AS (SELECT row_id, list_distinct({S.words(_LABEL)}) AS w FROM concepts WHERE NOT {_NULL(_LABEL)}), t AS (SELECT row_id, len(w) AS n, unnest(w) AS word FROM w), m AS (SELECT a.row_id AS x, b.row_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.word = b.word AND a.row_id < b.row_id GROUP BY 1, 2) SELECT x AS row_id_a, y AS row_id_b FROM m WHERE k / (na + nb - k) >= 0.6",
    "p6_classes": f"WITH w AS (SELECT min(row_id) AS row_id, w FROM (SELECT row_id, list_sort(list_distinct({S.words(_LABEL)})) AS w FROM concepts WHERE NOT {_NULL(_LABEL)}) GROUP BY 2), t AS (SELECT row_id, len(w) AS n, unnest(w) AS word FROM w), m AS (SELECT a.row_id AS x, b.row_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.word = b.word AND a.row_id < b.row_id GROUP BY 1, 2) SELECT x AS sid_a, y AS sid_b FROM m WHERE k / (na + nb - k) >= 0.6",
    "p7_found": f"WITH {NAMES}, {_RESOLVED}, b AS (SELECT c, confidence, seq, row_number() OVER (PARTITION BY c, p ORDER BY confidence DESC, seq) AS i FROM r WHERE {_OK}), t AS (SELECT c, seq, row_number() OVER (PARTITION BY c ORDER BY confidence DESC, seq) AS place FROM b WHERE i = 1) SELECT c AS child_uri, place::INT AS place, seq FROM t WHERE place <= 3",
}
