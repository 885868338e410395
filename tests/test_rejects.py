import csv
import io

import pytest
from pyspark.sql import functions as F

from skosloom.operators.rejects import loaded, rejected, usable_uri

TEN = "\t".join

URIS = {
    "http://a.example/x": True, "HTTPS://a.example": True, "http://a.example:65535/": True, "http://a.example:65536/": False, "http://a.example:/": True, "http:///x": False, "http:/a/b": False, "/x": False,
    "ftp://a.example/": False, "http://a.example/a b": False, "http://a.example/%4": False, "http://a.example/%4G": False, "http://a.example/%4a": True, "http://u:p@a.example/x@y:z": True, "http://[::1]/": True, "http://[1::2::3]/": False,
    "http://[fe80::1": False, "http://192.0.2.7/x": True, "http://a.example/x#a#b": False, "http://a.example/é": False, "NULL": True, "": True, "null": False, " http://a.example ": True, "http://a.example?q=/?#f": True, "http://a.example/<x>": False, "http://a.example:000080/": True,
}


def test_uris(spark):
    df = spark.createDataFrame([(u,) for u in URIS], "u string").select("u", usable_uri(F.col("u")).alias("ok"))
    assert {r["u"]: r["ok"] for r in df.collect()} == URIS


def rec(**kw):
    f = [""] * 10
    f[0] = "http://a.example/1"
    for k, v in kw.items():
        f[int(k[1:])] = v
    return TEN(f)


CASES = [
    (rec(), None), (None, "columns"), ("", "columns"), ("\r", "columns"), (rec() + "\r", None), (rec() + "\t", "columns"), ("a\tb", "columns"), (rec(f1='"open'), "quoting"), (rec(f1='"a" b'), "quoting"), (rec(f1='a "b" c'), None), (rec(f1='"a ""b"" c"'), None),
    (rec(f1='"tab\tand\nline"'), None), (rec(f0="x"), "uri"), (rec(f0='"x'), "quoting"), (rec(f2="a\x01b"), "definition"), (rec(f2="a�"), "definition"), (rec(f2="a￿"), "definition"), (rec(f2="\U0001f3b5 \x85"), None), (rec(f1="a\x01"), None), (rec(f0="bad", f2="\x01"), "uri"),
    (rec(f9='"end"') + "\r", None), (rec(f9='"end" '), "quoting"), (rec(f1='""'), None), (rec(f1='"""'), "quoting"), ("\t" * 9, None), ("x" * 200_000, "columns"), ("\t" * 30_000, "columns"), (rec(f1='"' + '""' * 30_000 + '"'), None),
]


def frame(spark):
    return spark.createDataFrame([(i, r, "x") for i, (r, _) in enumerate(CASES)], "line_id bigint, raw string, reason string")


def test_reasons(spark):
    got = {r["line_id"]: r["reason"] for r in rejected(frame(spark), ["line_id"]).collect()}
    assert got == {i: why for i, (_, why) in enumerate(CASES) if why}


def test_loaded(spark):
    out = {r["line_id"]: list(r)[1:] for r in loaded(frame(spark), ["line_id"]).collect()}
    valid = [i for i, (_, why) in enumerate(CASES) if not why]
    assert sorted(out) == valid
    for i in valid:
        text = CASES[i][0].removesuffix("\r")
        csv.field_size_limit(10**7)
        assert out[i] == next(csv.reader(io.StringIO(text, newline=""), delimiter="\t")), i


def test_empty(spark):
    assert rejected(spark.createDataFrame([], "line_id bigint, raw string"), ["line_id"]).collect() == []


@pytest.mark.parametrize("n", [3])
def test_repeated(spark, n):
    df = spark.createDataFrame([(1, "bad")] * n, "line_id bigint, raw string")
    assert rejected(df, ["line_id"]).count() == n
