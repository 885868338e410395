"""Sinks: RDF/XML, JSON, HTML report.

Rows are rendered on the workers and written as many files; only headers,
footers and one-row aggregates are made on the driver.
"""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.functions.text import multi_value, xml_text

RDF_OPEN = '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xmlns:dc="http://purl.org/dc/elements/1.1/">'
RDF_CLOSE = "</rdf:RDF>"


def concept_scheme(uri: str, title: str, creator: str, date: str, lang: str = "fr") -> str:
    """The scheme element; the date is a parameter, so that a run can be repeated."""
    e = html.escape
    return f'<skos:ConceptScheme rdf:about="{e(uri)}"><dc:title xml:lang="{e(lang)}">{e(title, quote=False)}</dc:title><dc:creator>{e(creator, quote=False)}</dc:creator><dc:date>{e(date, quote=False)}</dc:date></skos:ConceptScheme>'


def _attr(c: Column) -> Column:
    return F.replace(xml_text(c), F.lit('"'), F.lit("&quot;"))


def concept_xml(scheme: str, lang: str = "fr") -> Column:
    """One ``skos:Concept`` element per export row, escaped once; missing values give no element."""
    text = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'<skos:{tag} xml:lang="{lang}">'), xml_text(c), F.lit(f"</skos:{tag}>")))
    link = lambda tag, c: F.array_join(F.transform(multi_value(c), lambda u: F.concat(F.lit(f'<skos:{tag} rdf:resource="'), _attr(u), F.lit('"/>'))), "")
    alts = F.array_join(F.transform(multi_value(F.col("altLabel")), lambda a: F.concat(F.lit(f'<skos:altLabel xml:lang="{lang}">'), xml_text(a), F.lit("</skos:altLabel>"))), "")
    parts = [
        F.concat(F.lit('<skos:Concept rdf:about="'), _attr(F.col("URI")), F.lit(f'"><skos:inScheme rdf:resource="{html.escape(scheme)}"/>')),
        text("prefLabel", F.col("prefLabel")), text("definition", F.col("definition")), alts, link("broader", F.col("broader")), link("narrower", F.col("narrower")),
        text("scopeNote", F.col("scopeNote")), text("changeNote", F.col("changeNote")), F.lit("</skos:Concept>"),
    ]
    return F.concat_ws("", *parts)


def rdf_lines(rows: DataFrame, scheme: str, lang: str = "fr") -> DataFrame:
    """``URI``, ``xml`` of every export row."""
    return rows.select("URI", concept_xml(scheme, lang).alias("xml"))


def write_rdf(rows: DataFrame, path: str, scheme: str, title: str, creator: str, date: str, lang: str = "fr") -> str:
    """A folder of text files that, read in the order of their names, are one RDF/XML document."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "", RDF_OPEN), (1, "", concept_scheme(scheme, title, creator, date, lang))], "part int, URI string, xml string")
    foot = spark.createDataFrame([(3, "", RDF_CLOSE)], "part int, URI string, xml string")
    body = rdf_lines(rows, scheme, lang).withColumn("part", F.lit(2))
    head.unionByName(body).unionByName(foot).orderBy("part", "URI").select("xml").write.mode("overwrite").text(path)
    return path


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns, as JSON has none."""
    return df.withColumns({f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")} or {})


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    clean = without_nan(df)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns])).alias("json"))


def write_json(df: DataFrame, path: str) -> str:
    json_lines(df).write.mode("overwrite").text(path)
    return path


def statistics_json(stats: dict[str, dict]) -> str:
    """Statistics of the stages (one-row aggregates) as JSON; NaN becomes null."""

    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    return json.dumps({"stages": clean(stats), **clean(pipeline_summary(stats))}, ensure_ascii=False, indent=1, default=str)


def pretty_xml(text: str) -> str:
    """An XML document indented, without blank lines; for documents of a size that a person reads."""
    from xml.dom import minidom

    lines = minidom.parseString(text).toprettyxml(indent="  ").splitlines()
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', *(x for x in lines[1:] if x.strip())])


def pipeline_summary(stats: dict[str, dict]) -> dict:
    """Completed stages and the key figures of a run."""
    pick = lambda stage, *names: {n: stats[stage][n] for n in names if n in stats.get(stage, {})}
    key = pick("concepts", "n_concepts") | pick("links", "n_relations") | pick("build", "n_nodes", "n_created", "n_edges", "consistency") | pick("hierarchy", "hierarchy_coverage", "orphan_concepts") | pick("optimisation", "cycle_edges_removed", "transitive_removed")
    return {"completed": list(stats), "key_metrics": key}


def html_report(stats: dict[str, dict], recommendations: list[tuple[str, str]], title: str, date: str) -> str:
    """A page with an executive summary, a section for each stage, the final metrics and the recommendations, from aggregates only."""
    e = lambda x: html.escape(str(x))
    table = lambda d: "<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in d.items()) + "</table>"
    section = lambda name, body: f"<section><h2>{e(name)}</h2>{body}</section>"
    summary = section("Résumé", table(pipeline_summary(stats)["key_metrics"]))
    final = [k for k in ("hierarchy", "integrity") if k in stats]
    stages = "".join(section(k, table(v)) for k, v in stats.items() if k not in final)
    metrics = section("Métriques finales", "") + "".join(section(k, table(stats[k])) for k in final) if final else ""
    notes = section("Recommandations", "<ul>" + "".join(f"<li>{e(t)}: {e(v)}</li>" for t, v in recommendations) + "</ul>")
    return f'<!doctype html><html lang="fr"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><p>{e(date)}</p>{summary}{stages}{metrics}{notes}</body></html>'
