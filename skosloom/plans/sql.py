"""Pieces of the SQL that states the same results independently (DuckDB dialect)."""

from __future__ import annotations

from skosloom.config import ADJECTIVES, STOP_WORDS, SUFFIXES

BASE = "http://example.org/vocabulary/"
WS = r"[\s\p{Z}]"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def trim_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def null(x: str) -> str:
    return f"CASE WHEN {x} NOT IN ('', 'NULL', 'NaN') THEN {x} END"


def words(x: str) -> str:
    """Words of a label after decomposing, without marks, in lower case (list)."""
    return rf"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\p{{L}}\p{{N}}]+')"


def label_key(x: str) -> str:
    t = trim_ws(f"coalesce({x}, '')")
    p = rf"(?s)^(.*?){WS}*\(([^)]+)\){WS}*$"
    head = f"CASE WHEN regexp_matches({t}, '{p}') THEN regexp_extract({t}, '{p}', 1) ELSE {t} END"
    return f"array_to_string({words(head)}, ' ')"


_TERM = rf"^(.*?){WS}*\(([^)]+)\){WS}*$"
TOKENS = rf"list_filter(regexp_extract_all(regexp_replace(lower(norm), '[-_]', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND regexp_full_match(w, '\p{{L}}+') AND NOT list_contains([{quoted(STOP_WORDS)}], w))"

#: Source of a definition: the final balanced parenthesis, by a scan over its brackets.
DEFINITION = f"""d0 AS (SELECT row_id, {trim_ws("coalesce(" + null('"skos:definition"') + ", '')")} AS t FROM concepts),
d1 AS (SELECT row_id, t, string_split(left(t, length(t) - 1), '(') AS parts FROM d0),
d2 AS (SELECT row_id, t, parts, len(parts) AS n, list_transform(range(1, len(parts)), lambda i: len(parts) - i
  - list_sum(list_transform(parts[i + 1:], lambda x: length(x) - length(replace(x, ')', '')))) = 1) AS fits FROM d1),
d3 AS (SELECT row_id, t, parts, n, coalesce(list_max(list_filter(range(1, n), lambda i: fits[i])), n - 1) AS start FROM d2),
defs AS (SELECT row_id, CASE WHEN t LIKE '%)' AND n > 1 THEN {trim_ws("array_to_string(parts[1:start], '(')")} ELSE t END AS definition,
  CASE WHEN t LIKE '%)' AND n > 1 THEN {trim_ws("array_to_string(parts[start + 1:], '(')")} ELSE '' END AS source FROM d3)"""

#: Prepared concepts ``c``.
CONCEPTS = f"""c0 AS (SELECT row_id, {null('"URI"')} AS u, {null('"skos:prefLabel"')} AS pref, {null('"skos:altLabel"')} AS alt, {null('"skos:broader"')} AS broader FROM concepts),
c1 AS (SELECT row_id, coalesce(u, '{BASE}' || sha256(row_id || '|' || coalesce(pref, ''))) AS uri, u IS NOT NULL AS had_uri, pref, alt, broader,
  CASE WHEN regexp_matches(pref, '{_TERM}') THEN {trim_ws(f"regexp_extract(pref, '{_TERM}', 1)")} ELSE {trim_ws("pref")} END AS label,
  CASE WHEN regexp_matches(pref, '{_TERM}') THEN {trim_ws(f"regexp_extract(pref, '{_TERM}', 2)")} END AS label_term FROM c0),
c AS (SELECT *, {norm("label")} AS norm FROM c1)"""
FIRST = "lab AS (SELECT norm AS key, arg_min(label, row_id) AS first_label, arg_min(uri, row_id) AS first_uri FROM c WHERE norm <> '' GROUP BY 1)"
FREQ = f"tk AS (SELECT row_id, {TOKENS} AS t FROM c), freq AS (SELECT w AS word, count(*)::BIGINT AS freq FROM (SELECT unnest(t) AS w FROM tk WHERE len(t) > 1) GROUP BY 1)"
REL = "row_id, label AS child, uri AS child_uri"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def by_base(based: str, conf: float, cand: float, category: str, source: str = "pattern_specialized") -> str:
    return with_(CONCEPTS, FIRST, FREQ, f"based AS ({based})") + f"""
SELECT {REL}, coalesce(first_label, b.key) AS parent, first_uri AS parent_uri, CASE WHEN first_label IS NOT NULL THEN {conf!r}::DOUBLE ELSE {cand!r}::DOUBLE END AS confidence,
  CASE WHEN first_label IS NOT NULL THEN 'existing_parent' ELSE 'candidate_parent' END AS type, '{source}' AS source, '{category}' AS relation_category
FROM based b LEFT JOIN lab ON lab.key = b.key LEFT JOIN freq ON freq.word = b.key AND freq.freq >= 3 WHERE first_label IS NOT NULL OR freq.freq IS NOT NULL"""


def phrase_base(keyword: str) -> str:
    p = rf"^(.+?)\s+{keyword}\s+(.+)$"
    return f"SELECT row_id, label, uri, regexp_extract(norm, '{p}', 1) AS key FROM c WHERE regexp_matches(norm, '{p}')"


ADJ = rf"(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(ADJECTIVES)})(?:$|[^\p{{L}}\p{{N}}_])"
STEM = "CASE " + " ".join(f"WHEN w LIKE '%{s}' AND length(w) > {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in SUFFIXES) + " ELSE w END"
