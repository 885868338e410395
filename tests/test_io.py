import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from skosloom.__main__ import arguments
from skosloom.plans import pipeline
from skosloom.sources import sinks, tsv
from skosloom.sources.tables import table
from skosloom.streaming import incremental

HEAD = "URI\tskos:prefLabel\tskos:definition\tskos:altLabel\tskos:broader\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_concepts(spark, tmp_path):
    p = write(tmp_path / "c.tsv", HEAD + 'u:1\tFlûte\tNULL\t"a ""b""\tc"\tNaN\n\tNA\t"two\nlines"\t\t\n')
    got = [tuple(r) for r in tsv.read_concepts(spark, p).orderBy("row_id").select("URI", "`skos:prefLabel`", "`skos:definition`", "`skos:altLabel`", "`skos:broader`", "`rdf:type`").collect()]
    assert got == [("u:1", "Flûte", None, 'a "b"\tc', None, None), (None, "NA", "two\nlines", None, None, None)]
    with pytest.raises(ValueError, match="missing columns"):
        tsv.read_concepts(spark, write(tmp_path / "d.tsv", "URI\tskos:prefLabel\n"))
    with pytest.raises(Exception, match="(?i)path"):
        tsv.read_concepts(spark, str(tmp_path / "none.tsv"))


def test_pipeline_and_sinks(spark, tmp_path):
    rows = [("u:1", "Flûte", "Instrument (à vent) (Source)", "", ""), ("u:2", "Flûte à bec (Flûte)", "<b> & c", "x##y", "Flûte"), ("u:3", "Flûte de Pan", "", "", "Flûte à bec"), ("u:4", "Musique", "", "", "Musique sacrée"), ("u:5", "Musique sacrée", "", "", "Musique")]
    p = write(tmp_path / "c.tsv", HEAD + "".join("\t".join(r) + "\n" for r in rows))
    r = pipeline.run(tsv.read_concepts(spark, p))
    edges = {(e["child"], e["parent"]) for e in r.edges.collect()}
    assert ("u:2", "u:1") in edges and r.stats["integrity"]["total_nodes"] == 5
    assert not {("u:4", "u:5"), ("u:5", "u:4")} <= edges
    out = pipeline.write_all(r, str(tmp_path / "out"), "2026-01-01")
    lines = [x["value"] for x in spark.read.text(out["rdf"]).withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
    doc = xml.dom.minidom.parseString("\n".join(lines).encode())
    assert len(doc.getElementsByTagName("skos:Concept")) == 5
    assert "&lt;b&gt; &amp; c" in "\n".join(lines) and "&amp;amp;" not in "\n".join(lines)
    again = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(out["tsv"])
    assert again.count() == 5 and len(again.columns) == 10
    assert json.loads(out["json"])["stages"]["concepts"]["n_concepts"] == 5
    assert "<h2>hierarchy</h2>" in out["html"]


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double")
    assert [json.loads(r[0]) for r in sinks.json_lines(df).collect()] == [{"id": 1}, {"id": 2, "x": 0.5}]
    assert json.loads(sinks.statistics_json({"a": {"x": float("inf"), "y": [1]}}))["stages"] == {"a": {"x": None, "y": [1]}}


def test_arguments():
    assert arguments(["--input", "a", "--output", "b"]).input == "a"
    with pytest.raises(SystemExit):
        arguments([])


def test_streaming(spark, sf, tmp_path):
    src = tmp_path / "src"
    table(spark, sf, "tsv_lines").repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    got = []
    q = incremental.start(incremental.classified(stream), lambda df, _: got.extend((r["line_id"], r["reason"]) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    from skosloom.operators.rejects import rejected

    assert {x for x in got if x[1]} == {tuple(r) for r in rejected(table(spark, sf, "tsv_lines"), ["line_id"]).collect()}
    rel = tmp_path / "rel"
    table(spark, sf, "relations").select("seq", "relation_category", "confidence", "detected_at").where("detected_at is not null").coalesce(1).write.parquet(str(rel))
    s = spark.readStream.schema(spark.read.parquet(str(rel)).schema).parquet(str(rel))
    seen = []
    incremental.start(incremental.windowed_counts(s).select("n"), lambda df, _: seen.extend(r["n"] for r in df.collect()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(seen) > 0


def test_review_and_zones_in_the_pipeline(spark):
    from skosloom.plans import pipeline
    from tests.conftest import rows

    labels = ["Flûte", "Flûte à bec", "Chant de messe", "Chant de Noël", "Chant de marche", "Chant de fête"]
    fields = ["URI", "skos:prefLabel", "skos:definition", "rdf:type", "skos:altLabel", "skos:hiddenLabel", "skos:narrower", "skos:broader", "skos:scopeNote", "skos:changeNote"]
    data = [(i, f"u:{i}", x, *[None] * 8) for i, x in enumerate(labels, 1)]
    concepts = spark.createDataFrame(data, "row_id bigint, " + ", ".join(f"`{f}` string" for f in fields))
    decisions = spark.createDataFrame([("chant", "A", None, None)], "group_key string, action string, alternative_term string, child_uri string")
    r = pipeline.run(concepts, zones=True, decisions=decisions)
    made = [x for x in r.nodes.collect() if x["status"] == "user_created"]
    assert [x["preflabel"] for x in made] == ["Chant"]
    # links that another path makes redundant are gone, so the songs are below the new term, not all next to it
    below, todo = set(), [made[0]["uri"]]
    pairs = rows(r.edges.select("parent", "child"))
    while todo:
        n = todo.pop()
        new = {c for p, c in pairs if p == n} - below
        below |= new
        todo += new
    assert below == {"u:3", "u:4", "u:5", "u:6"}
    assert ("u:1", "u:2") in {(p, c) for p, c, *_ in rows(r.edges.select("parent", "child"))}
    assert r.stats["review"]["A"] >= 4 and r.stats["build"]["n_created"] == 1 and r.stats["build"]["consistency"] <= 100
    assert rows(r.concepts.where("norm = 'chant'").select("label")) == [("Chant",)]
    pipeline.check_outputs(r)
    r.export = r.export.drop("broader")
    with pytest.raises(ValueError, match="broader"):
        pipeline.check_outputs(r)


def test_pretty_xml_and_summary():
    from skosloom.sources import sinks

    text = sinks.pretty_xml("<a>\n\n<b>x</b></a>")
    assert text.splitlines() == ['<?xml version="1.0" encoding="UTF-8"?>', "<a>", "  <b>x</b>", "</a>"]
    stats = {"concepts": {"n_concepts": 3}, "hierarchy": {"hierarchy_coverage": 50.0}}
    assert sinks.pipeline_summary(stats) == {"completed": ["concepts", "hierarchy"], "key_metrics": {"n_concepts": 3, "hierarchy_coverage": 50.0}}
    assert "Résumé" in sinks.html_report(stats, [("depth", "good")], "T", "d")


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from skosloom.plans import workspace

    none = lambda *a: None
    cluster = SimpleNamespace(conf=SimpleNamespace(get=none), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: SimpleNamespace(get=none)))
    with pytest.raises(ValueError, match="checkpoint"):
        workspace.checkpoint_root(cluster)
