"""Queries of lexical similarity, families, vectors, zones and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skosloom.config import Settings
from skosloom.functions.text import cosine, jaccard, word_set
from skosloom.operators import discovery as D
from skosloom.operators import lexicon as L
from skosloom.operators import relations as R
from skosloom.operators import similarity as X
from skosloom.plans import sql as S
from skosloom.plans.workspace import Workspace
from skosloom.sources.tables import table

#: The vectors of the test tables are far apart: a looser cut than the default.
ZONE_CUT = 0.40
_ZONES = Settings(zone_threshold=0.6, family_threshold=0.6, abstract_threshold=0.5)


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all parts, and their second words as labels of their own."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("uri"), F.col("p_name").alias("label"))
    alone = p.select(F.element_at(F.split("label", " "), -1).alias("label")).distinct().unionByName(spark.createDataFrame([("small",), ("large",)], "label string")).distinct()
    # a few words, so one ordering of them all
    alone = alone.select((1_000_000 + F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label"))).cast("bigint").alias("row_id"), "label")
    return p.unionByName(alone.withColumn("uri", F.concat(F.lit("s"), F.col("row_id"))))


def concept_labels(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned labels of all concepts."""
    return L.prepare(table(spark, d, "concepts")).select("row_id", "label", "uri")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def f12_substrings(spark, d):
    t = X.terms(concept_labels(spark, d))
    return X.word_pairs(t, 0.3).select("a", "b", F.array_join(X.substrings(F.col("a"), F.col("b")), "|").alias("found"))


def f13_jaccard(spark, d):
    t = X.terms(concept_labels(spark, d))
    return X.word_pairs(t, 0.3).select("a", "b", F.round("jac", 6).alias("jac"))


def j7_similar_pairs(spark, d):
    return X.similar_pairs(part_labels(spark, d)).select("i", "j", "a", "b", F.round("sim", 6).alias("sim"), "root")


def a4_families(spark, d):
    return X.families(X.similar_pairs(part_labels(spark, d))).select("root", "member", F.col("size").cast("bigint").alias("size"))


def a5_family_merge(spark, d):
    return X.merged_families(X.families(X.similar_pairs(part_labels(spark, d))), Workspace(spark, "a5"))


def j8_containment(spark, d):
    return X.contained(X.families(X.similar_pairs(part_labels(spark, d))))


def j9_prefix_group(spark, d):
    return X.prefix_links(part_labels(spark, d)).withColumn("confidence", F.round("confidence", 6))


def z5_lexical_links(spark, d):
    return X.lexical_links(part_labels(spark, d), Workspace(spark, "z5"))


def f16_context(spark, d):
    return D.contexts(L.prepare(table(spark, d, "concepts")), table(spark, d, "relations"))


def f17_encode(spark, d):
    c = D.contexts(L.prepare(table(spark, d, "concepts")), table(spark, d, "relations"))
    return D.encode(c, "context").select("uri", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("length"))


def f18_cosine(spark, d):
    """Similarity of each vector to the next one by id."""
    v = _vectors(spark, d).select("vec_id", "embedding")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(n, "vec_id").select("vec_id", F.round((cosine(F.col("embedding"), F.col("next")) + 1) / 2, 6).alias("sim"))


def f18_close_pairs(spark, d):
    return D.similar_vectors(_vectors(spark, d), "vec_id", "embedding", ZONE_CUT).select("a", "b", F.round("cos", 6).alias("cos"))


def g13_zones(spark, d):
    return D.zones(_vectors(spark, d), "vec_id", "embedding", Workspace(spark, "g13"), ZONE_CUT)


def _label_zones(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("label").alias("zone"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def a11_zone_stats(spark, d):
    return D.zone_statistics(_label_zones(spark, d))


def _zones(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ws = Workspace(spark, "zones")
    z = ws.cut(D.zones(_vectors(spark, d), "vec_id", "embedding", ws, ZONE_CUT))
    m = z.join(_vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").select("zone", "id", "v")
    return m, D.zone_statistics(m)


def j12_zone_rep(spark, d):
    m, s = _zones(spark, d)
    known = spark.createDataFrame([], "child bigint, parent bigint")
    return D.zone_links(m, s, known, _ZONES)


def a12_abstract(spark, d):
    m, s = _zones(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = L.prepare(table(spark, d, "concepts")).select("label")
    return D.abstract_concepts(m, s, texts, labels, _ZONES)


def j11_two_hop(spark, d):
    e = table(spark, d, "relations").where(F.col("child_uri").isNotNull() & F.col("parent_uri").isNotNull() & (F.col("type") == "existing_parent"))
    return D.two_hop(e.select(F.col("child_uri").alias("child"), F.col("parent_uri").alias("parent")))


def j10_pattern_links(spark, d):
    c = L.prepare(table(spark, d, "concepts"))
    rel = table(spark, d, "relations")
    ws = Workspace(spark, "j10")
    vec = ws.cut(D.encode(D.contexts(c, rel), "context"))
    return D.analogy_links(c, rel, R.mined_patterns(rel), vec)


QUERIES = {f.__name__: f for f in (f12_substrings, f13_jaccard, j7_similar_pairs, a4_families, a5_family_merge, j8_containment, j9_prefix_group, z5_lexical_links, f16_context, f17_encode, f18_cosine, f18_close_pairs, g13_zones, a11_zone_stats, j12_zone_rep, a12_abstract, j11_two_hop, j10_pattern_links)}

_LABELS = r"""p AS (SELECT p_partkey AS row_id, 'p' || p_partkey AS uri, p_name AS label FROM part), alone AS (SELECT DISTINCT label FROM (SELECT string_split(label, ' ')[-1] AS label FROM p UNION SELECT 'small' UNION SELECT 'large')),
l AS (SELECT * FROM p UNION ALL SELECT i, 's' || i, label FROM (SELECT 1000000 + row_number() OVER (ORDER BY label) AS i, label FROM alone)),
t AS (SELECT label, min(row_id) AS i, arg_max(uri, row_id) AS uri, list_distinct(regexp_extract_all(lower(label), '[\p{L}\p{N}_]+')) AS w FROM l GROUP BY 1)"""
_CONCEPT_TERMS = r"t AS (SELECT *, list_distinct(regexp_extract_all(lower(label), '[\p{L}\p{N}\p{M}_]+')) AS w FROM (SELECT label, min(row_id) AS i FROM c WHERE coalesce(label, '') <> '' GROUP BY 1))"
_JAC = "pr AS (SELECT x.i, y.i AS j, x.label AS a, y.label AS b, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS jac FROM t x JOIN t y ON x.i < y.i)"
_LCS = """sb AS (SELECT i, j, a, b, jac, s, s0 FROM (SELECT *, unnest(range(1, length(a) + 1)) AS s0 FROM pr WHERE jac >= 0.4 - 1e-9), LATERAL (SELECT max(substr(lower(a), s0, n)) AS s FROM range(4, length(a) - s0 + 2) AS r(n) WHERE contains(lower(b), substr(lower(a), s0, n)))),
rt AS (SELECT i, j, any_value(a) AS a, any_value(b) AS b, any_value(jac) AS jac, arg_max(s, length(s) * 1000 - s0) FILTER (WHERE s IS NOT NULL) AS root FROM sb GROUP BY 1, 2),
sim AS (SELECT *, least(1.0, jac + CASE WHEN root IS NULL THEN 0 ELSE 0.2 END) AS sim FROM rt)"""
_SIM = S.with_(_LABELS, _JAC, _LCS)
_FAM = S.with_(_LABELS, _JAC, _LCS, "q AS (SELECT * FROM sim WHERE sim >= 0.6 - 1e-9 AND root IS NOT NULL)", "m AS (SELECT root, a AS member FROM q UNION SELECT root, b FROM q)", "fam AS (SELECT root, member, count(*) OVER (PARTITION BY root) AS size FROM m)")
_UNIT = "un AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"

ORACLE = {
    "f13_jaccard": S.with_(S.CONCEPTS, _CONCEPT_TERMS, _JAC) + "SELECT a, b, round(jac, 6) AS jac FROM pr WHERE jac >= 0.3",
    "j7_similar_pairs": _SIM + "SELECT i, j, a, b, round(sim, 6) AS sim, root FROM sim WHERE sim >= 0.6 - 1e-9",
    "a4_families": _FAM + "SELECT root, member, size::BIGINT AS size FROM fam WHERE size >= 2",
    "j8_containment": _FAM + "SELECT x.root, y.member AS child, x.member AS parent FROM fam x JOIN fam y ON x.root = y.root WHERE x.size >= 2 AND length(x.member) < length(y.member) AND contains(lower(y.member), lower(x.member))",
    "j9_prefix_group": S.with_(_LABELS, "k AS (SELECT *, lower(string_split(label, ' ')[1]) AS key, len(string_split(label, ' ')) > 1 AS many FROM t)", "g AS (SELECT key FROM k WHERE many AND length(key) >= 4 GROUP BY 1 HAVING count(*) >= 2)", "al AS (SELECT key, arg_min(label, i) AS parent, arg_min(uri, i) AS parent_uri, arg_min(w, i) AS pw FROM k WHERE NOT many GROUP BY 1)")
    + "SELECT label AS child, uri AS child_uri, parent, parent_uri, round(least(0.8, sim + 0.2), 6) AS confidence, 'existing_parent' AS type, 'lexical_similarity' AS source, 'lexical_prefix' AS relation_category FROM (SELECT *, len(list_intersect(w, pw)) / len(list_distinct(list_concat(w, pw))) + 0.2 AS sim FROM k JOIN g USING (key) JOIN al USING (key) WHERE many) WHERE sim >= 0.5",
    "f18_cosine": "SELECT a.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "f18_close_pairs": f"WITH {_UNIT} SELECT a, b, round(cos, 6) AS cos FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / (x.n * y.n) AS cos FROM un x JOIN un y ON x.vec_id < y.vec_id) WHERE cos >= 0.4",
    "a11_zone_stats": f"WITH {_UNIT}, pc AS (SELECT x.label, avg(list_dot_product(x.v, y.v) / (x.n * y.n)) AS c FROM un x JOIN un y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY 1), ce AS (SELECT label, list(m ORDER BY d) AS centre FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS d FROM un) GROUP BY 1, 2) GROUP BY 1), rp AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round((list_cosine_similarity(v, centre) + 1) / 2, 9) DESC, vec_id) AS i FROM un JOIN ce USING (label)), sz AS (SELECT label, count(*)::BIGINT AS size FROM un GROUP BY 1) SELECT label AS zone, size, round(coalesce((c + 1) / 2, 1.0), 6) AS coherence, vec_id AS representative FROM sz JOIN rp USING (label) LEFT JOIN pc USING (label) WHERE i = 1",
    "j11_two_hop": "WITH e AS (SELECT DISTINCT child_uri AS child, parent_uri AS parent FROM relations WHERE child_uri IS NOT NULL AND parent_uri IS NOT NULL AND type = 'existing_parent'), h AS (SELECT DISTINCT a.child, b.parent AS grand FROM e a JOIN e b ON b.child = a.parent WHERE a.child <> b.parent), n AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.child = h.child AND e.parent = h.grand)), o AS (SELECT child, count(*)::BIGINT AS outdegree FROM e GROUP BY 1) SELECT n.child, n.grand, count(*)::BIGINT AS shared, any_value(outdegree) AS outdegree FROM n JOIN e x ON x.child = n.child JOIN e y ON y.child = n.grand AND y.parent = x.parent JOIN o ON o.child = n.child GROUP BY 1, 2",
}
