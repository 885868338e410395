"""Queries on proposed links, graphs and the hierarchy's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skosloom.functions.text import confidence_bucket
from skosloom.operators import graph as G
from skosloom.operators import lexicon as L
from skosloom.operators import metrics as M
from skosloom.operators import relations as R
from skosloom.plans import pipeline as P
from skosloom.plans import queries_lexicon as QL
from skosloom.plans import sql as S
from skosloom.plans.workspace import Workspace
from skosloom.sources import sinks as K
from skosloom.sources.tables import table


def _r(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relations")


def _n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes")


def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    """``parent``, ``child``, ``confidence`` between nodes: links written in nodes (1.0) and the best proposed parents of each child, ties kept."""
    best = R.usable(_r(spark, d)).where(F.col("child_uri") != F.col("parent_uri")).groupBy("child_uri", "parent_uri").agg(F.max("confidence").alias("confidence"))
    top = R.top_with_ties(best).select(F.col("parent_uri").alias("parent"), F.col("child_uri").alias("child"), "confidence")
    told = G.all_edges_of(_n(spark, d)).select("parent", "child", F.lit(1.0).alias("confidence"))
    e = top.unionByName(told).groupBy("parent", "child").agg(F.max("confidence").alias("confidence"))
    return G.between(e, _n(spark, d))


def node_edges(spark: SparkSession, d: str) -> DataFrame:
    """``parent``, ``child``, ``confidence`` of the links that nodes hold, with the best usable confidence proposed for each, 0.5 where none is."""
    e = G.between(G.all_edges_of(_n(spark, d)), _n(spark, d))
    best = R.usable(_r(spark, d)).groupBy(F.col("child_uri").alias("child"), F.col("parent_uri").alias("parent")).agg(F.max("confidence").alias("confidence"))
    return e.join(best, ["child", "parent"], "left").select("parent", "child", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def _dag(spark: SparkSession, d: str, ws: Workspace) -> DataFrame:
    return ws.cut(G.break_cycles(node_edges(spark, d), ws)[0].select("parent", "child"))


def f20_conf_bucket(spark, d):
    return R.usable(_r(spark, d)).select("seq", confidence_bucket(F.col("confidence")).alias("bucket"))


def f21_self_ref(spark, d):
    return R.without_self_links(_r(spark, d)).select("seq")


def f22_confidence_filter(spark, d):
    return R.at_least(_r(spark, d), 0.8).select("seq", "confidence")


def f23_by_type(spark, d):
    return R.of_type(_r(spark, d), "candidate_parent").select("seq", "parent")


def f24_violations(spark, d):
    return R.violations(_r(spark, d))


def f26_default_confidence(spark, d):
    return _r(spark, d).select("seq", R.filled_confidence().alias("confidence"))


def u1_union(spark, d):
    c = L.prepare(table(spark, d, "concepts"))
    out = L.explicit_broader(c).unionByName(L.label_broader(c), allowMissingColumns=True)
    return out.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("child_uri").alias("n_children"))


def u4_except(spark, d):
    return _r(spark, d).select(F.col("child_uri").alias("uri")).where(F.col("uri").isNotNull()).subtract(_n(spark, d).select("uri"))


def a6_candidate_groups(spark, d):
    return R.candidate_groups(_r(spark, d))


def a7_candidate_variants(spark, d):
    return R.of_type(_r(spark, d), "candidate_parent").groupBy(R.group_key(F.col("parent")).alias("group_key")).agg(F.count_distinct("parent").alias("n_variants"), F.count(F.lit(1)).alias("n"))


def a9_patterns(spark, d):
    lists = {x: F.array_join(x, " | ") for x in ("target_parents", "examples")}
    return R.mined_patterns(_r(spark, d)).withColumns(lists)


def a10_mode(spark, d):
    return R.mode_first_seen(_r(spark, d).where(F.col("child_uri").isNotNull()), "child_uri", "source")


def a13_dedup_best(spark, d):
    return R.dedup_best(_r(spark, d)).select("child_uri", "parent_uri", "seq", "confidence")


def a14_dedup_first(spark, d):
    return R.dedup_first(_r(spark, d)).select("child", "parent", "seq", "method_place")


def a15_score_filter(spark, d):
    return R.accepted(_r(spark, d)).select("seq", F.round("score", 9).alias("score"))


def a17_method_counts(spark, d):
    return R.method_counts(_r(spark, d))


def a18_category_stats(spark, d):
    return R.category_statistics(_r(spark, d))


def a26_sample(spark, d):
    return R.validation_sample(_r(spark, d))


def a27_random_sample(spark, d):
    return R.random_sample(_r(spark, d), 20).select("seq", "source")


def w1_topk_ties(spark, d):
    return R.top_with_ties(_r(spark, d)).select("seq", "place")


def w3_topn(spark, d):
    return R.top_per_category(_r(spark, d), 5).select("relation_category", "seq", "place")


def w5_parent_cap(spark, d):
    return R.parent_cap(_r(spark, d)).select("seq", "place")


def h2_review_queue(spark, d):
    return R.review_queue(_r(spark, d))


def h3_decisions(spark, d):
    """Links of accepted groups: the rule stands for a reviewer who accepts groups of five links or more and rejects the others."""
    rel = _r(spark, d)
    cand = R.of_type(rel, "candidate_parent").groupBy(R.group_key(F.col("parent")).alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    dec = cand.select("group_key", F.when(F.col("n") >= 5, "A").otherwise("R").alias("action"), none.alias("alternative_term"), none.alias("child_uri"))
    terms = L.resolve_terms(R.of_type(rel, "candidate_parent").select(F.col("parent").alias("term")), L.prepare(table(spark, d, "concepts")))
    return R.apply_decisions(rel, dec, terms).groupBy("action", "taken").agg(F.count(F.lit(1)).alias("n"), F.count("parent_uri").alias("n_with_uri"))


def g1_initial_graph(spark, d):
    c = L.prepare(table(spark, d, "concepts"))
    e = L.explicit_broader(c).where(F.col("parent_uri").isNotNull()).select(F.col("child_uri").alias("child"), F.col("parent_uri").alias("parent")).distinct()
    return G.between(e, c)


def g4_edges(spark, d):
    return G.edges_of(_n(spark, d))


def g9_symmetric_edges(spark, d):
    return G.all_edges_of(_n(spark, d))


def j14_edge_semi(spark, d):
    return G.between(G.all_edges_of(_n(spark, d)), _n(spark, d))


def j13_siblings(spark, d):
    """Per link: how many other children its parent has, and the first of them."""
    e = G.all_edges_of(_n(spark, d))
    per = e.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("lo"))
    second = e.join(per, "parent").where(F.col("child") != F.col("lo")).groupBy("parent").agg(F.min("child").alias("next"))
    j = e.join(per.where("n > 1"), "parent").join(second, "parent")
    return j.select("child", "parent", (F.col("n") - 1).alias("n_siblings"), F.when(F.col("child") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("first_sibling"))


def g5_bounded_redundant(spark, d):
    return G.bounded_redundant(hierarchy_edges(spark, d), Workspace(spark, "g5"))


def j16_edge_anti(spark, d):
    e = hierarchy_edges(spark, d).select("parent", "child")
    return G.without(e, G.bounded_redundant(e, Workspace(spark, "j16")))


def g6_cyclic_core(spark, d):
    return G.cyclic_core(hierarchy_edges(spark, d), Workspace(spark, "g6"))


def g7_cycle_break(spark, d):
    return G.break_cycles(node_edges(spark, d), Workspace(spark, "g7"))[0].select("parent", "child")


def g8_transitive_reduction(spark, d):
    ws = Workspace(spark, "g8")
    e = _dag(spark, d, ws)
    return G.without(e, G.transitive_redundant(e, ws))


def g10_depth(spark, d):
    return G.depths(hierarchy_edges(spark, d), Workspace(spark, "g10"))


def g11_eccentricity(spark, d):
    return G.root_distances(node_edges(spark, d), Workspace(spark, "g11")).groupBy("root").agg(F.max("depth").alias("eccentricity"), F.count(F.lit(1)).alias("n"))


def g12_longest_path(spark, d):
    ws = Workspace(spark, "g12")
    return G.longest_levels(_dag(spark, d, ws), ws)


def _max_depth(spark: SparkSession, d: str) -> DataFrame:
    return F.broadcast(M.max_depth(G.root_distances(node_edges(spark, d), Workspace(spark, "depth"))))


def a21_metrics(spark, d):
    return M.hierarchy_metrics(_n(spark, d)).join(F.broadcast(M.validated_share(_n(spark, d)))).join(_max_depth(spark, d))


def a19_discovery_stats(spark, d):
    return R.discovery_statistics(_r(spark, d))


def a11_zone_profile(spark, d):
    return R.zone_profile(_r(spark, d))


def a20_build_report(spark, d):
    """Report on the nodes as a built hierarchy, one row a node, with the links that cycles lose."""
    n = _n(spark, d).where(F.col("uri").isNotNull()).groupBy("uri").agg(F.min("status").alias("status"))
    e = G.break_cycles(node_edges(spark, d), ws := Workspace(spark, "a20"))
    dag = ws.cut(e[0])
    up = dag.groupBy(F.col("child").alias("uri")).agg(F.collect_list("parent").alias("parents"))
    down = dag.groupBy(F.col("parent").alias("uri")).agg(F.collect_list("child").alias("children"))
    return M.build_report(n.join(up, "uri", "left").join(down, "uri", "left"), dag, e[1].count())


def j18_network(spark, d):
    return R.zone_network(_r(spark, d))


def j19_zone(spark, d):
    return R.zone_of(_r(spark, d), 1)


def j19_pattern(spark, d):
    return R.pattern_of(R.mined_patterns(_r(spark, d)), "Sonate *").select("pattern_type", "pattern_text", "frequency")


def g3_vertices(spark, d):
    return R.relation_graph(_r(spark, d))[0]


def g3_edges(spark, d):
    return R.relation_graph(_r(spark, d))[1]


def a22_relation_count(spark, d):
    return _n(spark, d).agg(F.sum(F.size(F.coalesce("children", F.array().cast("array<string>")))).alias("n_relations"))


def a23_reduction_report(spark, d):
    ws = Workspace(spark, "a23")
    e = node_edges(spark, d)
    dag, back = G.break_cycles(e, ws)
    red = ws.cut(G.transitive_redundant(dag, ws))
    return M.reduction_report(e, G.without(dag, red), red, back)


def a24_integrity(spark, d):
    return M.integrity_report(_n(spark, d)).join(_max_depth(spark, d))


def a25_final_metrics(spark, d):
    return M.final_metrics(_n(spark, d)).join(_max_depth(spark, d))


def k2_tsv_rows(spark, d):
    return M.export_rows(_n(spark, d), L.null_tokens(table(spark, d, "concepts")))


def k13_recommend(spark, d):
    ws = Workspace(spark, "k13")
    depth = G.longest_levels(_dag(spark, d, ws), ws).agg(F.coalesce(F.max("level") - 1, F.lit(0)).alias("max_depth"))
    return M.recommendations(M.final_metrics(_n(spark, d)), depth)


def k7_concept_xml(spark, d):
    rows = M.export_rows(_n(spark, d), L.null_tokens(table(spark, d, "concepts")))
    return K.rdf_lines(rows, "http://example.org/vocabulary")


def k14_relations_json(spark, d):
    return K.json_lines(_r(spark, d).select("seq", "child", "parent", "confidence", "source", "details"))


def z7_hierarchy(spark, d):
    """Edges of the hierarchy built from explicit, label and pattern links of all concepts."""
    ws = Workspace(spark, "z7")
    c = ws.cut(L.prepare(table(spark, d, "concepts")))
    links = P.found_links(c, ws, similar=False)
    return P.build_hierarchy(c, links, ws)[1]


def z7_pipeline(spark, d):
    """Edges of the hierarchy that the whole pipeline builds from all concepts with its defaults: similarity and discovery included."""
    return P.run(table(spark, d, "concepts"), ws=Workspace(spark, "z7_pipeline")).edges


QUERIES = {f.__name__: f for f in (f20_conf_bucket, f21_self_ref, f22_confidence_filter, f23_by_type, f24_violations, f26_default_confidence, u1_union, u4_except, a6_candidate_groups, a7_candidate_variants, a9_patterns, a10_mode, a13_dedup_best, a14_dedup_first, a15_score_filter, a17_method_counts, a18_category_stats, a26_sample, a27_random_sample, w1_topk_ties, w3_topn, w5_parent_cap, h2_review_queue, h3_decisions, g1_initial_graph, g4_edges, g9_symmetric_edges, j14_edge_semi, j13_siblings, g5_bounded_redundant, j16_edge_anti, g6_cyclic_core, g7_cycle_break, g8_transitive_reduction, g10_depth, g11_eccentricity, g12_longest_path, a21_metrics, a19_discovery_stats, a11_zone_profile, a20_build_report, j18_network, j19_zone, j19_pattern, g3_vertices, g3_edges, a22_relation_count, a23_reduction_report, a24_integrity, a25_final_metrics, k2_tsv_rows, k13_recommend, k7_concept_xml, k14_relations_json, z7_hierarchy, z7_pipeline)}

_OK = "(confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1)"
_U = f"u AS (SELECT * FROM relations WHERE {_OK})"
_BUCKET = "format('{:.1f}-{:.1f}', floor(round(confidence * 10, 9)) / 10, floor(round(confidence * 10, 9)) / 10 + 0.1)"
_MULT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in R.MULTIPLIERS.items()) + " ELSE 1.0::DOUBLE END"
_DEF = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in R.DEFAULT_CONFIDENCE.items()) + " END"
_METHOD = "CASE discovery_method " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(R.METHOD_ORDER)) + f" ELSE {len(R.METHOD_ORDER)} END"
_UP = "up AS (SELECT DISTINCT uri AS child, p AS parent FROM (SELECT uri, unnest(parents) AS p FROM nodes) WHERE p IS NOT NULL AND uri IS NOT NULL)"
_DOWN = "down AS (SELECT DISTINCT c AS child, uri AS parent FROM (SELECT uri, unnest(children) AS c FROM nodes) WHERE c IS NOT NULL AND uri IS NOT NULL)"
_ALL = "ae AS (SELECT * FROM up UNION SELECT * FROM down)"
_MERGED = "m AS (SELECT uri, (SELECT count(*) FROM up WHERE up.child = n.uri) AS p, (SELECT count(*) FROM down WHERE down.parent = n.uri) AS c FROM (SELECT DISTINCT uri FROM nodes WHERE uri IS NOT NULL) n)"
_TREE = S.with_(_UP, _DOWN, _ALL, _MERGED)
_IDS = "ids AS (SELECT DISTINCT uri FROM nodes WHERE uri IS NOT NULL)"
_BEST = f"best AS (SELECT child_uri, parent_uri, max(confidence) AS confidence FROM relations WHERE {_OK} GROUP BY 1, 2)"
_INSIDE = "parent IN (SELECT uri FROM ids) AND child IN (SELECT uri FROM ids)"
_H = "WITH RECURSIVE " + ", ".join([_UP, _DOWN, _ALL, _IDS, _BEST]) + f"""
, rk AS (SELECT parent_uri AS parent, child_uri AS child FROM (SELECT *, rank() OVER (PARTITION BY child_uri ORDER BY confidence DESC) AS r FROM best WHERE child_uri <> parent_uri) WHERE r <= 3),
e AS (SELECT parent, child FROM rk WHERE {_INSIDE} UNION SELECT parent, child FROM ae WHERE {_INSIDE})"""
_N = "WITH RECURSIVE " + ", ".join([_UP, _DOWN, _ALL, _IDS, _BEST]) + f"""
, e AS (SELECT parent, child, coalesce(confidence, 0.5::DOUBLE) AS w FROM ae LEFT JOIN best ON child_uri = child AND parent_uri = parent WHERE {_INSIDE}),
o AS (SELECT *, row_number() OVER (ORDER BY w, parent, child) AS k FROM e), t AS (SELECT k, parent AS p, child AS n FROM o UNION SELECT t.k, t.p, o.child FROM t JOIN o ON o.parent = t.n WHERE o.k > t.k AND t.n <> t.p),
gone AS (SELECT DISTINCT k FROM t WHERE n = p), dag AS (SELECT parent, child FROM o WHERE k NOT IN (SELECT k FROM gone))"""
_ROOT = "root AS (SELECT DISTINCT parent AS id FROM e WHERE parent NOT IN (SELECT child FROM e))"
_DEPTH = ", " + _ROOT + ", dw AS (SELECT id AS root, id, 0 AS depth FROM root UNION SELECT root, e.child, depth + 1 FROM dw JOIN e ON e.parent = dw.id WHERE depth < 100), md AS (SELECT coalesce(max(m), 0)::INT AS d FROM (SELECT min(depth) AS m FROM dw GROUP BY root, id))"
_G5 = _H + """, w AS (SELECT e.parent AS s, e.child AS t, f.child AS n, 1 AS k FROM e JOIN e f ON f.parent = e.parent WHERE f.child <> e.child AND f.child <> e.parent
 UNION SELECT s, t, g.child, k + 1 FROM w JOIN e g ON g.parent = w.n WHERE k < 5 AND n <> t AND g.child <> s), red AS (SELECT DISTINCT s AS parent, t AS child FROM w WHERE n = t) """
_G6 = _H + """, r AS (SELECT child AS a, parent AS d FROM e UNION SELECT r.a, e.parent FROM r JOIN e ON e.child = r.d), cyc AS (SELECT DISTINCT a AS id FROM r WHERE a = d),
low AS (SELECT id FROM cyc UNION SELECT a FROM r WHERE d IN (SELECT id FROM cyc)), high AS (SELECT id FROM cyc UNION SELECT d FROM r WHERE a IN (SELECT id FROM cyc)) """
_RED = ", c AS (SELECT parent AS a, child AS d FROM dag UNION SELECT c.a, dag.child FROM c JOIN dag ON dag.parent = c.d), red AS (SELECT DISTINCT dag.parent, c.d AS child FROM dag JOIN c ON c.a = dag.child)"
_G8 = _N + _RED
_LONGEST = _N + ", l AS (SELECT DISTINCT parent AS id, 1 AS level FROM dag WHERE parent NOT IN (SELECT child FROM dag) UNION SELECT dag.child, level + 1 FROM l JOIN dag ON dag.parent = l.id) "
_KEY = "array_to_string(list_transform(string_split(" + S.norm("parent") + ", ' '), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(regexp_replace(w, 'aux$', 'al'), '(?:es|e|s|x)$', '') ELSE w END), ' ')"
_CAND = f"cand AS (SELECT *, {_KEY} AS group_key FROM relations WHERE type = 'candidate_parent')"
_FINAL = "SELECT count(*)::BIGINT AS total_concepts, sum(c)::BIGINT AS total_relations, count(*) FILTER (WHERE p = 0 AND c = 0)::BIGINT AS orphan_concepts, count(*) FILTER (WHERE p = 0 AND c > 0)::BIGINT AS root_concepts, count(*) FILTER (WHERE p > 0 AND c = 0)::BIGINT AS leaf_concepts, round(avg((p > 0 OR c > 0)::INT) * 100, 4) AS hierarchy_coverage, round(avg((p > 1)::INT) * 100, 4) AS poly_hierarchy_rate FROM m"
_ISSUES = """issues AS (SELECT 'missing_parent' AS kind FROM up WHERE parent NOT IN (SELECT uri FROM nodes WHERE uri IS NOT NULL)
UNION ALL SELECT 'parent_without_child' FROM up WHERE parent IN (SELECT uri FROM nodes) AND (child, parent) NOT IN (SELECT (child, parent) FROM down)
UNION ALL SELECT 'missing_child' FROM down WHERE child NOT IN (SELECT uri FROM nodes WHERE uri IS NOT NULL)
UNION ALL SELECT 'child_without_parent' FROM down WHERE child IN (SELECT uri FROM nodes) AND (child, parent) NOT IN (SELECT (child, parent) FROM up))"""
_NC = "nc AS (SELECT row_id, " + ", ".join(f'{S.null(chr(34) + f + chr(34))} AS "{f}"' for f in ("URI", "skos:prefLabel", "skos:definition", "rdf:type", "skos:altLabel", "skos:hiddenLabel", "skos:scopeNote", "skos:changeNote")) + " FROM concepts)"
_K2 = S.with_(_UP, _DOWN, _ALL, _NC, 'bu AS (SELECT "URI" AS uri, arg_min(nc, row_id) AS r FROM nc WHERE "URI" IS NOT NULL GROUP BY 1)',
    f"bl AS (SELECT key, arg_min(x, x.row_id) AS r FROM (SELECT nc AS x, {S.label_key('nc.' + chr(34) + 'skos:prefLabel' + chr(34))} AS key FROM nc) WHERE key <> '' GROUP BY 1)",
    f"ids AS (SELECT uri, preflabel, {S.label_key('preflabel')} AS key FROM (SELECT uri, min(preflabel) AS preflabel FROM nodes WHERE uri IS NOT NULL GROUP BY 1))",
    "us AS (SELECT child AS uri, string_agg(parent, ' ## ' ORDER BY parent) AS broader FROM ae GROUP BY 1)", "ds AS (SELECT parent AS uri, string_agg(child, ' ## ' ORDER BY child) AS narrower FROM ae GROUP BY 1)",
    "j AS (SELECT ids.uri, preflabel, coalesce(bu.r, bl.r) AS r, broader, narrower FROM ids LEFT JOIN bu ON bu.uri = ids.uri LEFT JOIN bl ON bl.key = ids.key LEFT JOIN us ON us.uri = ids.uri LEFT JOIN ds ON ds.uri = ids.uri)") + """
SELECT uri AS "URI", coalesce(r."skos:prefLabel", preflabel) AS "prefLabel", coalesce(r."skos:definition", '') AS definition, coalesce(r."rdf:type", 'skos:Concept') AS type, coalesce(r."skos:altLabel", '') AS "altLabel", coalesce(r."skos:hiddenLabel", '') AS "hiddenLabel",
  coalesce(r."skos:scopeNote", '') AS "scopeNote", coalesce(broader, '') AS broader, coalesce(narrower, '') AS narrower, coalesce(r."skos:changeNote", 'Terme créé lors de la hiérarchisation semi-automatique') AS "changeNote" FROM j"""  # fmt: skip
_PAT = r"""WITH r AS (SELECT seq, trim(child, ' ') AS child, trim(parent, ' ') AS parent FROM relations WHERE trim(child, ' ') <> '' AND trim(parent, ' ') <> ''),
p AS (SELECT seq, child, parent, 'suffix' AS kind, '*-' || trim(string_split(child, '-')[2], ' ') AS text FROM r WHERE len(string_split(child, '-')) = 2 AND trim(string_split(child, '-')[2], ' ') <> '' AND contains(lower(parent), lower(trim(string_split(child, '-')[2], ' ')))
UNION ALL SELECT seq, child, parent, 'prefix', w[1] || ' *' FROM (SELECT *, list_filter(string_split_regex(child, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM r) WHERE len(w) > 1 AND list_contains(list_filter(string_split_regex(lower(parent), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''), lower(w[1]))
UNION ALL SELECT seq, child, parent, 'contains', '*' || w || '*' FROM (SELECT seq, child, parent, unnest(list_filter(string_split_regex(lower(child), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM r) WHERE length(w) >= 4 AND contains(lower(parent), w)),
g AS (SELECT kind, text, parent, count(*) AS n, min(seq) AS first FROM p GROUP BY ALL),
tp AS (SELECT kind, text, string_agg(parent, ' | ' ORDER BY parent) AS target_parents FROM g GROUP BY ALL), ex AS (SELECT kind, text, string_agg(child, ' | ' ORDER BY i) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY kind, text ORDER BY seq, child) AS i FROM p) WHERE i <= 3 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY kind, text ORDER BY n DESC, first) AS i, sum(n) OVER (PARTITION BY kind, text) AS f, count(*) OVER (PARTITION BY kind, text) AS np FROM g)
SELECT kind AS pattern_type, text AS pattern_text, f::BIGINT AS frequency, np::BIGINT AS n_parents, parent AS most_common_parent, round(n / f, 6) AS confidence, target_parents, examples FROM b JOIN tp USING (kind, text) JOIN ex USING (kind, text) WHERE i = 1 AND f >= 3"""

_TERMS = S.with_(S.CONCEPTS, S.FIRST, f"alts AS (SELECT key, min(uri) AS lo, max(uri) AS hi FROM (SELECT uri, {S.norm('a')} AS key FROM (SELECT uri, unnest(regexp_split_to_array(alt, '##|, ')) AS a FROM c)) WHERE key <> '' GROUP BY 1)",
    _CAND, f"tm AS (SELECT term, key FROM (SELECT DISTINCT parent AS term, {S.norm('parent')} AS key FROM cand) WHERE key <> '')", "res AS (SELECT term FROM tm LEFT JOIN lab USING (key) LEFT JOIN alts USING (key) WHERE first_uri IS NOT NULL OR lo IS NULL OR lo = hi)")
_J = lambda name, x: f"CASE WHEN {x} IS NULL THEN '' ELSE ',\"{name}\":' || to_json({x}) END"
_XT = lambda x: f"regexp_replace(replace(replace(replace({S.trim_ws(x)}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
_XPARTS = lambda x: f"list_filter(list_transform(string_split(coalesce({x}, ''), '##'), lambda v: {S.trim_ws('v')}), lambda v: v <> '')"
_XA = lambda x: "replace(" + _XT(x) + ", '\"', '&quot;')"
_XTAG = lambda tag, x: f"""CASE WHEN coalesce({x}, '') <> '' THEN '<skos:{tag} xml:lang="fr">' || {_XT(x)} || '</skos:{tag}>' ELSE '' END"""
_XLINK = lambda tag, x: f"""coalesce(array_to_string(list_transform({_XPARTS(x)}, lambda u: '<skos:{tag} rdf:resource="' || {_XA('u')} || '"/>'), ''), '')"""
_XML = f"""'<skos:Concept rdf:about="' || {_XA('"URI"')} || '"><skos:inScheme rdf:resource="http://example.org/vocabulary"/>' || {_XTAG('prefLabel', '"prefLabel"')} || {_XTAG('definition', 'definition')}
 || coalesce(array_to_string(list_transform({_XPARTS('"altLabel"')}, lambda a: '<skos:altLabel xml:lang="fr">' || {_XT('a')} || '</skos:altLabel>'), ''), '') || {_XLINK('broader', 'broader')} || {_XLINK('narrower', 'narrower')} || {_XTAG('scopeNote', '"scopeNote"')} || {_XTAG('changeNote', '"changeNote"')} || '</skos:Concept>'"""

ORACLE = {
    "a7_candidate_variants": f"WITH {_CAND} SELECT group_key, count(DISTINCT parent)::BIGINT AS n_variants, count(*)::BIGINT AS n FROM cand GROUP BY 1",
    "h2_review_queue": f"WITH {_CAND}, u AS (SELECT * FROM cand WHERE {_OK} AND group_key <> ''), nm AS (SELECT group_key, string_agg(parent, ' | ' ORDER BY seq, parent) AS variants FROM (SELECT group_key, parent, min(seq) AS seq FROM u GROUP BY 1, 2) GROUP BY 1), ch AS (SELECT group_key, coalesce(string_agg(child, ' | ' ORDER BY seq, child), '') AS children FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY seq) AS i FROM (SELECT group_key, child, min(seq) AS seq FROM u GROUP BY 1, 2)) WHERE i <= 10 GROUP BY 1) SELECT group_key, variants, count(*)::BIGINT AS n_links, count(DISTINCT child)::BIGINT AS n_children, round(avg(confidence), 6) AS avg_confidence, children FROM u JOIN nm USING (group_key) JOIN ch USING (group_key) GROUP BY ALL",
    "h3_decisions": _TERMS + "SELECT action, action = 'A' AS taken, count(*)::BIGINT AS n, count(CASE WHEN action = 'A' AND term IS NOT NULL THEN term ELSE parent_uri END)::BIGINT AS n_with_uri FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY group_key) >= 5 THEN 'A' ELSE 'R' END AS action FROM cand) LEFT JOIN res ON term = parent GROUP BY 1",
    "k7_concept_xml": "SELECT \"URI\", " + _XML + " AS xml FROM (" + _K2 + ")",
    "k14_relations_json": f"SELECT '{{\"seq\":' || seq || {_J('child', 'child')} || {_J('parent', 'parent')} || CASE WHEN confidence IS NULL OR isnan(confidence) THEN '' ELSE ',\"confidence\":' || confidence::VARCHAR END || {_J('source', 'source')} || CASE WHEN details IS NULL THEN '' ELSE ',\"details\":{{' || ltrim({_J('family_root', 'details.family_root')} || {_J('prefix', 'details.prefix')} || {_J('family_size', 'details.family_size')} || {_J('group_size', 'details.group_size')} || CASE WHEN details.jaccard_similarity IS NULL THEN '' ELSE ',\"jaccard_similarity\":' || details.jaccard_similarity::VARCHAR END, ',') || '}}' END || '}}' AS json FROM relations",
    "f20_conf_bucket": f"SELECT seq, {_BUCKET} AS bucket FROM relations WHERE {_OK}",
    "f21_self_ref": "SELECT seq FROM relations WHERE child_uri IS DISTINCT FROM parent_uri",
    "f22_confidence_filter": f"SELECT seq, confidence FROM relations WHERE {_OK} AND confidence >= 0.8",
    "f23_by_type": "SELECT seq, parent FROM relations WHERE type = 'candidate_parent'",
    "f24_violations": f"SELECT count(*)::BIGINT AS n_relations, count(*) FILTER (WHERE child IS NULL OR parent IS NULL OR confidence IS NULL OR type IS NULL OR source IS NULL)::BIGINT AS n_missing_field, count(*) FILTER (WHERE confidence IS NOT NULL AND NOT {_OK})::BIGINT AS n_bad_confidence, count(*) FILTER (WHERE child_uri = parent_uri)::BIGINT AS n_self FROM relations",
    "f26_default_confidence": f"SELECT seq, coalesce(CASE WHEN {_OK} THEN confidence END, {_DEF}, 0.5::DOUBLE) AS confidence FROM relations",
    "u1_union": "SELECT source, type, count(*)::BIGINT AS n, count(DISTINCT child_uri)::BIGINT AS n_children FROM (SELECT source, type, child_uri FROM (" + QL.ORACLE["j1_explicit_broader"] + ") UNION ALL SELECT source, type, child_uri FROM (" + QL.ORACLE["j2_label_broader"] + ")) GROUP BY 1, 2",
    "g1_initial_graph": "WITH j AS (" + QL.ORACLE["j1_explicit_broader"] + "), k AS (" + S.with_(S.CONCEPTS) + "SELECT uri FROM c) SELECT DISTINCT child_uri AS child, parent_uri AS parent FROM j WHERE parent_uri IN (SELECT uri FROM k) AND child_uri IN (SELECT uri FROM k)",
    "u4_except": "SELECT DISTINCT child_uri AS uri FROM relations WHERE child_uri IS NOT NULL AND child_uri NOT IN (SELECT uri FROM nodes WHERE uri IS NOT NULL)",
    "a6_candidate_groups": "SELECT parent, count(*)::BIGINT AS n, count(DISTINCT child_uri)::BIGINT AS n_children FROM relations WHERE type = 'candidate_parent' GROUP BY 1",
    "a9_patterns": _PAT,
    "a10_mode": "SELECT child_uri, source, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY child_uri ORDER BY n DESC, first) AS i FROM (SELECT child_uri, source, count(*) AS n, min(seq) AS first FROM relations WHERE child_uri IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)) WHERE i = 1",
    "a13_dedup_best": f"WITH {_U} SELECT child_uri, parent_uri, seq, confidence FROM (SELECT *, row_number() OVER (PARTITION BY child_uri, parent_uri ORDER BY confidence DESC, seq) AS i FROM u) WHERE i = 1",
    "a14_dedup_first": f"SELECT child, parent, seq, mp::INT AS method_place FROM (SELECT *, row_number() OVER (PARTITION BY child, parent ORDER BY mp, seq) AS i FROM (SELECT *, {_METHOD} AS mp FROM relations)) WHERE i = 1",
    "a15_score_filter": f"WITH {_U}, s AS (SELECT *, least(1.0::DOUBLE, confidence * {_MULT}) AS score FROM u) SELECT seq, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY child, parent ORDER BY score DESC, seq) AS i FROM s) WHERE i = 1 AND score >= 0.8",
    "a17_method_counts": "SELECT relation_category, type, count(*)::BIGINT AS n FROM relations GROUP BY 1, 2",
    "a18_category_stats": f"WITH {_U}, b AS (SELECT relation_category, source, {_BUCKET} AS bucket FROM u) SELECT 'all' AS kind, NULL AS val, count(*)::BIGINT AS n FROM b UNION ALL SELECT 'category', relation_category, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'bucket', bucket, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM b GROUP BY 2",
    "a26_sample": f"WITH {_U}, k AS (SELECT greatest(1, 100 // greatest(count(DISTINCT relation_category), 1)) AS per FROM u), t AS (SELECT *, row_number() OVER (PARTITION BY relation_category ORDER BY confidence DESC, seq) AS place FROM u WHERE relation_category IS NOT NULL) SELECT relation_category, count(*)::BIGINT AS n, round(avg(confidence), 6) AS mean_confidence, round(stddev_pop(confidence), 6) AS sd_confidence, max(place)::INT AS last_place FROM t, k WHERE place <= per GROUP BY 1",
    "w1_topk_ties": f"WITH {_U} SELECT seq, place::INT AS place FROM (SELECT seq, rank() OVER (PARTITION BY child_uri ORDER BY confidence DESC) AS place FROM u) WHERE place <= 3",
    "w3_topn": f"WITH {_U} SELECT relation_category, seq, place::INT AS place FROM (SELECT relation_category, seq, row_number() OVER (PARTITION BY relation_category ORDER BY confidence DESC, seq) AS place FROM u) WHERE place <= 5",
    "w5_parent_cap": f"WITH {_U} SELECT seq, place::INT AS place FROM (SELECT seq, row_number() OVER (PARTITION BY child_uri ORDER BY confidence DESC, seq) AS place FROM u) WHERE place <= 3",
    "g4_edges": f"WITH {_UP} SELECT child, parent FROM up",
    "g9_symmetric_edges": S.with_(_UP, _DOWN, _ALL) + "SELECT child, parent FROM ae",
    "j14_edge_semi": S.with_(_UP, _DOWN, _ALL) + "SELECT child, parent FROM ae WHERE child IN (SELECT uri FROM nodes) AND parent IN (SELECT uri FROM nodes)",
    "j13_siblings": S.with_(_UP, _DOWN, _ALL) + "SELECT a.child, a.parent, count(*)::BIGINT AS n_siblings, min(b.child) AS first_sibling FROM ae a JOIN ae b ON b.parent = a.parent AND b.child <> a.child GROUP BY 1, 2",
    "g5_bounded_redundant": _G5 + "SELECT parent, child FROM e WHERE (parent, child) IN (SELECT (parent, child) FROM red)",
    "j16_edge_anti": _G5 + "SELECT parent, child FROM e WHERE (parent, child) NOT IN (SELECT (parent, child) FROM red)",
    "g6_cyclic_core": _G6 + "SELECT parent, child FROM e WHERE parent IN (SELECT id FROM low) AND child IN (SELECT id FROM high)",
    "g7_cycle_break": _N + "SELECT parent, child FROM dag",
    "g8_transitive_reduction": _G8 + "SELECT parent, child FROM dag WHERE (parent, child) NOT IN (SELECT (parent, child) FROM red)",
    "g10_depth": _H + ", " + _ROOT + ", w AS (SELECT id, 0 AS depth FROM root UNION SELECT e.child, depth + 1 FROM w JOIN e ON e.parent = w.id WHERE depth < 100), x AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1) SELECT id, depth::INT AS depth FROM x",
    "g11_eccentricity": _N + ", " + _ROOT + ", w AS (SELECT id AS root, id, 0 AS depth FROM root UNION SELECT root, e.child, depth + 1 FROM w JOIN e ON e.parent = w.id WHERE depth < 100), x AS (SELECT root, id, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT root, max(depth)::INT AS eccentricity, count(*)::BIGINT AS n FROM x GROUP BY 1",
    "g12_longest_path": _LONGEST + "SELECT id, max(level)::INT AS level FROM l GROUP BY 1",
    "a23_reduction_report": _G8 + """, n AS (SELECT (SELECT count(*) FROM e) AS b, (SELECT count(*) FROM dag WHERE (parent, child) NOT IN (SELECT (parent, child) FROM red)) AS a, (SELECT count(*) FROM dag WHERE (parent, child) IN (SELECT (parent, child) FROM red)) AS t, (SELECT count(*) FROM gone) AS c)
SELECT b::BIGINT AS relations_before, a::BIGINT AS relations_after, t::BIGINT AS transitive_removed, c::BIGINT AS cycle_edges_removed, (b - a)::BIGINT AS removed, round(CASE WHEN b > 0 THEN (b - a) / b * 100 ELSE 0 END, 4) AS reduction_pct, round(CASE WHEN b > 0 THEN t / b * 100 ELSE 0 END, 4) AS efficiency_pct FROM n""",
    "a21_metrics": _N + _DEPTH + ", " + _MERGED + " SELECT (SELECT d FROM md) AS max_depth, (SELECT round(avg(ok::INT) * 100, 4) FROM (SELECT uri, coalesce(bool_or(metadata.user_validated), false) AS ok FROM nodes WHERE uri IS NOT NULL GROUP BY 1)) AS validated_pct, count(*)::BIGINT AS total_nodes, count(*) FILTER (WHERE p = 0)::BIGINT AS roots, count(*) FILTER (WHERE c = 0)::BIGINT AS leaves, round(avg(p), 4) AS avg_parents, round(avg(c), 4) AS avg_children FROM m",
    "a19_discovery_stats": f"WITH {_U} SELECT relation_category, count(*)::BIGINT AS n, count(DISTINCT child_uri)::BIGINT AS n_children, round(avg(confidence), 6) AS avg_confidence, max(confidence) AS max_confidence FROM u GROUP BY 1",
    "a11_zone_profile": "WITH r AS (SELECT supporting_evidence.zone_id AS zone_id, child_uri, source FROM relations WHERE supporting_evidence.zone_id IS NOT NULL), p AS (SELECT zone_id, source, count(*) AS n FROM r WHERE source IS NOT NULL GROUP BY 1, 2), t AS (SELECT zone_id, count(*)::BIGINT AS source_diversity FROM p GROUP BY 1), b AS (SELECT zone_id, source, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, source) AS i FROM p) SELECT r.zone_id, count(DISTINCT child_uri)::BIGINT AS n_members, count(*)::BIGINT AS n_links, any_value(b.source) AS dominant_source, any_value(source_diversity) AS source_diversity FROM r LEFT JOIN b ON b.zone_id = r.zone_id AND i = 1 LEFT JOIN t ON t.zone_id = r.zone_id GROUP BY 1",
    "a20_build_report": _N + ", s AS (SELECT uri, min(status) AS status FROM nodes WHERE uri IS NOT NULL GROUP BY 1), x AS (SELECT status, uri IN (SELECT child FROM dag) AS up, uri IN (SELECT parent FROM dag) AS down FROM s) SELECT count(*)::BIGINT AS n_nodes, count(*) FILTER (WHERE status = 'user_created')::BIGINT AS n_created, round(avg((up OR down)::INT) * 100, 4) AS completeness, round(avg(up::INT) * 100, 4) AS coverage, (SELECT count(*) FROM dag)::BIGINT AS n_edges, (SELECT round(avg(w), 6) FROM o WHERE k NOT IN (SELECT k FROM gone)) AS avg_confidence, greatest(0, 100 - 10 * (SELECT count(*) FROM gone))::INT AS consistency FROM x",
    "j18_network": f"WITH {_U}, z AS (SELECT DISTINCT child_uri AS uri FROM relations WHERE supporting_evidence.zone_id IS NOT NULL AND child_uri IS NOT NULL) SELECT parent_uri AS parent, child_uri AS child, count(*)::BIGINT AS n, max(confidence) AS confidence FROM u WHERE child_uri IN (SELECT uri FROM z) AND parent_uri IN (SELECT uri FROM z) GROUP BY 1, 2",
    "j19_zone": "SELECT DISTINCT supporting_evidence.zone_id AS zone_id, child_uri AS uri FROM relations WHERE supporting_evidence.zone_id = 1 AND child_uri IS NOT NULL",
    "j19_pattern": "SELECT pattern_type, pattern_text, frequency FROM (" + _PAT + ") WHERE pattern_text = 'Sonate *'",
    "g3_vertices": "WITH r AS (SELECT * FROM relations WHERE child_uri IS NOT NULL AND parent_uri IS NOT NULL), n AS (SELECT id, arg_min(label, seq) AS label FROM (SELECT child_uri AS id, child AS label, seq FROM r UNION ALL SELECT parent_uri, parent, seq FROM r) GROUP BY 1), e AS (SELECT DISTINCT child_uri AS c, parent_uri AS p FROM r) SELECT id, min(label) AS label, (SELECT count(*) FROM e WHERE p = id)::BIGINT AS n_children, (SELECT count(*) FROM e WHERE c = id)::BIGINT AS n_parents FROM n GROUP BY id",
    "g3_edges": f"SELECT parent_uri AS parent, child_uri AS child, count(*)::BIGINT AS n, max(confidence) FILTER (WHERE {_OK}) AS confidence, count(DISTINCT source)::BIGINT AS n_sources, min(seq) AS first_seq FROM relations WHERE child_uri IS NOT NULL AND parent_uri IS NOT NULL GROUP BY 1, 2",
    "a22_relation_count": "SELECT sum(coalesce(len(children), 0))::BIGINT AS n_relations FROM nodes",
    "a24_integrity": _N + _DEPTH + ", " + _MERGED + ", " + _ISSUES + " SELECT (SELECT d FROM md) AS max_depth, count(*)::BIGINT AS total_nodes, count(*) FILTER (WHERE p = 0 AND c = 0)::BIGINT AS orphans, count(*) FILTER (WHERE p = 0 AND c > 0)::BIGINT AS roots, count(*) FILTER (WHERE p > 0 AND c = 0)::BIGINT AS leaves, round(avg(c), 4) AS avg_children, round(avg(p), 4) AS avg_parents, " + ", ".join(f"(SELECT count(*) FROM issues WHERE kind = '{k}')::BIGINT AS n_{k}" for k in ("missing_parent", "parent_without_child", "missing_child", "child_without_parent")) + " FROM m",
    "a25_final_metrics": _N + _DEPTH + ", " + _MERGED + " SELECT *, (SELECT d FROM md) AS max_depth FROM (" + _FINAL + ")",
    "k2_tsv_rows": _K2,
    "k13_recommend": _LONGEST + f", {_MERGED}, f AS ({_FINAL}), x AS (SELECT *, coalesce((SELECT max(level) - 1 FROM l), 0) AS max_depth, orphan_concepts / greatest(total_concepts, 1) * 100 AS o FROM f) SELECT * FROM (SELECT 'coverage' AS topic, CASE WHEN hierarchy_coverage < 50 THEN 'low' WHEN hierarchy_coverage > 90 THEN 'good' END AS level FROM x UNION ALL SELECT 'orphans', CASE WHEN o > 30 THEN 'high' WHEN o < 10 THEN 'good' END FROM x UNION ALL SELECT 'depth', CASE WHEN max_depth < 3 THEN 'shallow' WHEN max_depth > 8 THEN 'deep' ELSE 'good' END FROM x UNION ALL SELECT 'poly', CASE WHEN poly_hierarchy_rate > 20 THEN 'high' END FROM x) WHERE level IS NOT NULL",
}
