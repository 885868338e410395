import random
import re

from pyspark.sql import functions as F

from skosloom.operators import packed
from skosloom.operators.packed import FIRST_ESCAPE, FULL, candidates, choose_dialects, parse, split_packed
from skosloom.plans.workspace import Workspace
from tests.conftest import rows

ITEM = re.compile(r'(?:##|[,;|\n]|^)([ \t]*"(?:[^"]|"")*"|(?:(?!##)[^,;|\n])*)')


def brute(s):
    if s is None or s.strip() in ("", "NULL", "NaN"):
        return []
    out = []
    for m in ITEM.finditer(s):
        v = m[1].strip(" \t")
        if len(v) > 1 and v[0] == v[-1] == '"':
            v = v[1:-1].replace('""', '"').strip(" \t")
        if v:
            out.append(v)
    return out


def split(spark, values):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id bigint, f string, text string")
    got = {}
    for i, field, pos, val in sorted(map(tuple, split_packed(df, ["f"], ["id"]).collect())):
        assert field == "f"
        got.setdefault(i, []).append((pos, val))
    return [[v for _, v in sorted(got.get(i, []))] for i in range(len(values))], got


def test_cases(spark):
    values = [None, "", "NULL", " NaN ", "NA", "a", "a##b", "a, b ;c|d\ne", '"a, b"##c', '"""x"" y"', 'g "q"', "##a####b##", "#a#", "a###b", '"open, b', " \t ", ",;|", '"a" b, c', '""']
    got, pos = split(spark, values)
    assert got == [[], [], [], [], ["NA"], ["a"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a, b", "c"], ['"x" y'], ['g "q"'], ["a", "b"], ["#a#"], ["a", "#b"], ['"open', "b"], [], [], ["a b", "c"], []]
    assert [p for p, _ in pos[7]] == [1, 2, 3, 4, 5]


def test_random_against_brute_force(spark):
    r = random.Random(5)
    known = ["aa", "Motet, B", "fa # x", "c|d", "long label here", 'say "hi"']
    values = []
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 4)):
            v = r.choice([*known, "x" + str(r.randint(0, 9))])
            quote = re.search(r"##|[,;|\n]", v) or v.startswith('"') or r.random() < 0.2
            parts.append('"' + v.replace('"', '""') + '"' if quote else v)
        s = parts[0]
        for p in parts[1:]:
            s += r.choice(["##", ", ", ";", " | ", "\n", " ## "]) + p
        values.append(s)
    values += ["Motet, B"] * 40  # often read as one value when quoted, yet two when bare
    got, _ = split(spark, values)
    assert got == [brute(v) for v in values]


def test_long_repeated_and_empty(spark):
    long = ", ".join(f"v{i}" for i in range(20000))
    quotes = '"' + '""' * 20000 + 'x"'
    got, _ = split(spark, [long, quotes, "a##b", "a##b"])
    assert len(got[0]) == 20000 and got[0][-1] == "v19999"
    assert got[1] == ['"' * 20000 + "x"]
    assert got[2] == got[3] == ["a", "b"]
    empty = spark.createDataFrame([], "id bigint, f string")
    assert split_packed(empty, ["f"], ["id"]).collect() == []


def test_no_saving_pays_for_an_escape(spark):
    quoted = '"a, tombeau funèbre, b"; autre'
    long = ", ".join(f"v{i}" for i in range(150)) + "; last"
    got, _ = split(spark, [quoted, long, *["tombeau funèbre, x"] * 3000])
    assert got[0] == ["a, tombeau funèbre, b", "autre"]
    assert got[1] == [*(f"v{i}" for i in range(150)), "last"]


def test_bits_decide(spark):
    """Separators meant as text: at a low price of an escape the parses that leave them are cheapest."""
    texts = [f"w{i},q{i},r{i}##z{i},t{i}" for i in range(60)] + ["a##b", '"x, y"##z']
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n bigint")

    def read(first):
        d, n = choose_dialects(df, Workspace(spark, "t"), first, learn=False)
        assert d.count() == n
        d = df.join(d, "text", "left")
        return {r["text"]: r["v"] for r in d.select("text", parse(F.col("text"), F.coalesce("dialect", F.lit(FULL))).alias("v")).collect()}

    low, high = read(0.5), read(5.0)
    assert all(low[t] == t.split("##") for t in texts[:60])
    assert all(high[t] == re.split("##|,", t) for t in texts[:60])
    assert low["a##b"] == high["a##b"] == ["a", "b"] and high['"x, y"##z'] == ["x, y", "z"]


def test_no_pricing_without_effect(spark, monkeypatch):
    """At the price of the stated format no text takes another dialect, so none is priced."""
    r = random.Random(7)
    parts = ["a", "word", "Motet, B", '"x, y"', '"', '""', ",", ";", "|", "##", "#", "\n", " ", "\t"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(1000)]
    df = spark.createDataFrame([(t, 1 + i % 300) for i, t in enumerate(sorted(set(texts)))], "text string, n bigint")
    assert choose_dialects(df, Workspace(spark, "t"), FIRST_ESCAPE)[1] == 0
    monkeypatch.setattr(packed, "choose_dialects", lambda *a, **k: 1 / 0)
    found = split_packed(spark.createDataFrame([(1, 'a, "b; c"##d')], "id bigint, f string"), ["f"], ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == [(1, "f", 1, "a"), (1, "f", 2, "b; c"), (1, "f", 3, "d")]


def test_lower_price_decides_the_rows(spark):
    """Below that price the chosen dialects are those that the rows are read in; what is learned follows the table."""
    text = [",".join(chr(0x4E00 + 9 * i + k) for k in range(4)) + "##" + chr(0x4E08 + 9 * i) for i in range(60)]
    lists = [f"a{i}##b{i}##c{i}##d{i}, e{i}" for i in range(600)]

    def read(values, learn):
        df = spark.createDataFrame(list(enumerate(values)), "id bigint, f string")
        got = {}
        for i, _, pos, val in split_packed(df, ["f"], ["id"], escape=0.5, learn=learn).collect():
            got.setdefault(i, []).append((pos, val))
        return [[v for _, v in sorted(got[i])] for i in range(len(values))]

    assert read(text, False) == read(text, True) == [t.split("##") for t in text]
    assert read(text + lists, False)[:60] == [t.split("##") for t in text]
    assert read(text + lists, True) == [brute(t) for t in text + lists]


def test_dialects_offered(spark):
    df = spark.createDataFrame([(0, False), (2, False), (2, True), (3, False)], "m int, q boolean").select(candidates(F.col("m"), F.col("q")))
    assert [r[0] for r in df.collect()] == [[0], [0, 4], [0, 1, 4, 5], [0, 2, 4, 6]]


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a##b", "z", 9)], "row_id bigint, `skos:altLabel` string, dialect string, pos int")
    assert rows(split_packed(df, ["skos:altLabel"], ["row_id"])) == [(1, "skos:altLabel", 1, "a"), (1, "skos:altLabel", 2, "b")]
