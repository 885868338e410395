"""Queries of the general data problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skosloom.operators.forest import descendant_counts, descendants, hierarchy, links, other_parents, resolved
from skosloom.operators.packed import split_packed
from skosloom.operators.rejects import BAD_TEXT, FIELDS, HTTP_URI, loaded, rejected
from skosloom.plans import sql as S
from skosloom.plans.workspace import Workspace
from skosloom.sources.tables import table

PACKED_FIELDS = ["skos:altLabel", "skos:broader", "skos:narrower"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "concepts"), PACKED_FIELDS, ["row_id"]).select("row_id", "field", "pos", "val")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "concepts"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_counts(resolved(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "concepts"), Workspace(spark, "forest")))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of a tree with each of its descendants."""
    return descendants(resolved(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "concepts"), Workspace(spark, "forest")))


def p2_other_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that the forest leaves out, for a child has one parent in it."""
    nodes = table(spark, sf_dir, "nodes")
    return other_parents(nodes.select(F.col("uri").alias("node")), links(nodes, table(spark, sf_dir, "concepts"), Workspace(spark, "links")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(table(spark, sf_dir, "tsv_lines"), ["line_id"])


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(table(spark, sf_dir, "tsv_lines"), ["line_id"])


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_descendants, p2_pairs, p2_other_parents, p5_found, p5_loaded)}


# --- the same results in SQL ---

_SEP = r"[\x01,;|\n]"
_ITEM = rf'(?:{_SEP}|^)([ \t]*"(?:[^"]|"")*"[^\x01,;|\n]*|[^\x01,;|\n]*)'
_BLANK = "chr(32) || chr(9)"


def _values(x: str) -> str:
    """List of the values of a packed field."""
    value = f"""CASE WHEN regexp_full_match(i, '"(?:[^"]|"")*"') AND length(i) > 1 THEN trim(replace(substr(i, 2, length(i) - 2), '""', '"'), {_BLANK}) ELSE i END"""
    items = f"list_transform(regexp_extract_all(replace({x}, '##', chr(1)), '{_ITEM}', 1), lambda r: trim(r, {_BLANK}))"
    return f"list_filter(list_transform({items}, lambda i: replace({value}, chr(1), '##')), lambda v: v <> '')"


def _filled(x: str) -> str:
    return f"({x} IS NOT NULL AND {S.trim_ws(x)} NOT IN ('', 'NULL', 'NaN'))"


_PACKED = "cells AS (" + " UNION ALL ".join(f"""SELECT row_id, "URI", '{f}' AS field, "{f}" AS t FROM concepts WHERE {_filled(f'"{f}"')}""" for f in PACKED_FIELDS) + f"), lists AS (SELECT row_id, \"URI\", field, {_values('t')} AS l FROM cells), vals AS (SELECT row_id, \"URI\", field, unnest(range(1, len(l) + 1))::INT AS pos, unnest(l) AS val FROM lists)"
NAMES = f"names AS (SELECT key, min(uri) AS named FROM (SELECT {S.label_key('preflabel')} AS key, uri FROM nodes WHERE uri IS NOT NULL) WHERE key <> '' GROUP BY 1 HAVING min(uri) = max(uri))"
_LINKS = f"""ids AS (SELECT DISTINCT uri FROM nodes WHERE uri IS NOT NULL), lv AS (SELECT "URI" AS u, field, named FROM (SELECT "URI", field, {S.label_key('val')} AS key FROM vals WHERE field <> 'skos:altLabel' AND "URI" IN (SELECT uri FROM ids)) JOIN names USING (key)),
l0 AS (SELECT uri AS c, unnest(parents) AS p FROM nodes UNION SELECT unnest(children), uri FROM nodes UNION SELECT u, named FROM lv WHERE field = 'skos:broader' UNION SELECT named, u FROM lv WHERE field = 'skos:narrower'),
e AS (SELECT c, min(p) AS p FROM l0 WHERE c IN (SELECT uri FROM ids) AND p IN (SELECT uri FROM ids) GROUP BY 1),
tree AS (SELECT uri, uri AS root_uri, 0 AS depth, uri AS path FROM ids WHERE uri NOT IN (SELECT c FROM e) UNION ALL SELECT e.c, root_uri, depth + 1, path || ' > ' || e.c FROM tree JOIN e ON e.p = tree.uri),
rest AS (SELECT uri FROM ids WHERE uri NOT IN (SELECT uri FROM tree)), up AS (SELECT c, p FROM e WHERE c IN (SELECT uri FROM rest) UNION SELECT up.c, e.p FROM up JOIN e ON e.c = up.p),
found AS (SELECT uri, root_uri, depth, path, 'tree' AS state FROM tree UNION ALL SELECT uri, '', -1, '', CASE WHEN uri IN (SELECT c FROM up WHERE c = p) THEN 'cycle' ELSE 'below_cycle' END FROM rest)"""
_RE2 = lambda p: p.replace("*+", "*").replace("++", "+").replace("'", "''")
_F = r'(?:"[^"]*(?:""[^"]*)*"|[^"\t][^\t]*|)'
_FIELDS = rf"regexp_extract_all(chr(9) || t, '\t({_F})', 1)"
_UNQUOTE = lambda x: f"""CASE WHEN {x} LIKE '"%' THEN replace(substr({x}, 2, length({x}) - 2), '""', '"') ELSE {x} END"""
_PORT = f"ltrim(regexp_extract(u, '{_RE2(HTTP_URI)}', 1), '0')"
_JUDGED = rf"""j0 AS (SELECT *, regexp_replace(coalesce(raw, ''), '\r$', '') AS t FROM tsv_lines), j1 AS (SELECT *, regexp_matches(t, '^{_F}(?:\t{_F})*$') AS q, {_FIELDS} AS f FROM j0),
j2 AS (SELECT *, {S.trim_ws(_UNQUOTE('f[1]'))} AS u, {_UNQUOTE('f[3]')} AS def FROM j1),
j AS (SELECT *, CASE WHEN NOT q THEN 'quoting' WHEN t = '' OR len(f) <> 10 THEN 'columns' WHEN u NOT IN ('', 'NULL', 'NaN') AND NOT (regexp_matches(u, '{_RE2(HTTP_URI)}') AND (length({_PORT}) < 5 OR length({_PORT}) = 5 AND {_PORT} <= '65535')) THEN 'uri'
  WHEN regexp_matches(def, '{BAD_TEXT}') THEN 'definition' END AS reason FROM j2)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_PACKED} SELECT row_id, field, pos, val FROM vals",
    "p2_found": f"WITH RECURSIVE {_PACKED}, {NAMES}, {_LINKS} SELECT * FROM found",
    "p2_descendants": f"WITH RECURSIVE {_PACKED}, {NAMES}, {_LINKS}, up2 AS (SELECT depth, unnest(string_split(path, ' > ')) AS uri, unnest(range(depth + 1)) AS step FROM tree) SELECT uri, (count(*) - 1)::BIGINT AS n_descendants, max(depth - step)::INT AS height FROM up2 GROUP BY 1",
    "p2_pairs": f"WITH RECURSIVE {_PACKED}, {NAMES}, {_LINKS}, up2 AS (SELECT uri AS descendant, depth, unnest(string_split(path, ' > ')) AS uri, unnest(range(depth + 1)) AS step FROM tree) SELECT uri, descendant, (depth - step)::INT AS distance FROM up2 WHERE step < depth",
    "p2_other_parents": f"WITH {_PACKED}, {NAMES}, {_LINKS.split('tree AS (')[0].rstrip().rstrip(',')} SELECT DISTINCT c AS child, p AS parent FROM l0 WHERE c IN (SELECT uri FROM ids) AND p IN (SELECT uri FROM ids) AND (c, p) NOT IN (SELECT (c, p) FROM e)",
    "p5_found": f"WITH {_JUDGED} SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_loaded": f"WITH {_JUDGED} SELECT line_id, " + ", ".join(f'{_UNQUOTE(f"f[{i}]")} AS "{n}"' for i, n in enumerate(FIELDS, 1)) + " FROM j WHERE reason IS NULL",
}
