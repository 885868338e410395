import base64
import collections
import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from skosloom.functions.labels import words
from skosloom.llm import queries, setjoin
from skosloom.llm.canonical import collapse
from skosloom.llm.encode import Codec, decoded, encoded, serialise, shared_model
from skosloom.llm.mix import mix
from skosloom.llm.setjoin import similar_classes, similar_rows, similar_sets
from skosloom.llm.stuffing import function_words, repetition, shares, stuffed, stuffed_pages
from skosloom.llm.stuffing import stuffed_share as any_share
from skosloom.llm.survivor import estimate, fuse, survivors
from skosloom.llm.topbands import top_n, top_parents
from skosloom.plans.workspace import Workspace
from tests.conftest import rows
from tests.oracle import assert_same

REL = "seq bigint, child string, child_uri string, parent string, parent_uri string, confidence double, source string, detected_at timestamp, trust int, c string"
NODES = "uri string, preflabel string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf, name):
    assert_same(spark, sf, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_others_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


# --- survivors and fusion


def relations(spark, data):
    import datetime as dt

    day = lambda n: None if n is None else dt.datetime(2024, 1, n)
    return spark.createDataFrame([(s, c, cu, p, pu, x, src, day(d), 7, "zz") for s, c, cu, p, pu, x, src, d in data], REL)


def test_survivors(spark):
    nodes = spark.createDataFrame([("u:a", "Alpha"), ("u:b", "Beta"), ("u:b", "Beta"), ("u:x", "Two"), ("u:y", "two (z)")], NODES)
    det = spark.createDataFrame([("Best_One", 1), ("second", 2)], "source string, trust int")
    nan = float("nan")
    rel = relations(
        spark,
        [
            (1, "Alpha", "u:a", "Beta", "u:b", 0.5, "second", 5),
            (2, " ", "u:a", "beta (q)", None, nan, "best-one", 1),
            (3, "ALPHA", None, None, "u:b", 2.0, "BEST ONE", None),
            (4, None, "u:a", "Beta", "u:b", 0.9, None, 9),
            (5, "Two", None, "Beta", "u:b", 0.1, "x", 1),
            (6, "two", None, "Beta", "u:b", None, "x", 1),
            (7, "Only", "u:o", "Beta", "u:b", 0.5, "second", 1),
            (8, None, None, None, None, None, None, None),
            (9, None, None, None, None, None, None, None),
        ],
    )
    got = rows(survivors(rel, nodes, det))
    # group a-b: order by trust, date, seq is 2, 3, 1, 4
    assert got == sorted([(1, 3, 2, 1, 2), (5, 5, 5, 5, -1), (8, -1, -1, -1, -1)], key=repr)
    fused = {r["group_seq"]: r for r in fuse(rel, nodes, det).collect()}
    assert fused[1]["parent"] in {"Beta", "beta (q)"} and 0 <= fused[1]["parent_posterior"] <= 1
    assert 7 not in fused and 8 not in fused and fused[5]["confidence"] == "0.1" and fused[5]["source"] is None
    empty = spark.createDataFrame([], REL)
    assert survivors(empty, nodes, det).collect() == [] and fuse(empty, nodes, det).collect() == []


def weights(found):
    from skosloom.llm.survivor import _independent

    return _independent(*found[0], 0.8)


def test_estimate_finds_copies(spark):
    # sources 0 and 1 are independent and right; 2 and 3 share the same false values
    pats = [([[0, 1], [2, 3]], 300), ([[0], [2, 3]], 50), ([[0, 1]], 200), ([[0, 1, 2], [3]], 20)]
    found = estimate(spark.createDataFrame(pats, "sets array<array<int>>, n bigint"), 4)
    w = weights(found)
    assert w((0, 1)) > w((2, 3)) and found[0][1][3, 2] > 0.9
    assert estimate(spark.createDataFrame([], "sets array<array<int>>, n bigint"), 2)[0][1] == {}


def test_fusion_counts_every_rival_value(spark, monkeypatch):
    import skosloom.llm.survivor as m

    nodes = spark.createDataFrame([("u:b", "Beta")], NODES)
    det = spark.createDataFrame([("first", 1), ("second", 2)], "source string, trust int")
    # "first" gives 15 confidences for every link, "second" one; "one" and "two" are not listed
    data = [(g, x, s) for g in range(20) for x, s in [*((i / 100, "first") for i in range(15)), (0.5, "second"), (0.6, "one"), (0.7, "two")]]
    rel = relations(spark, [(i, "Alpha", f"u:{g}", "Beta", "u:b", x, s, 1) for i, (g, x, s) in enumerate(data)])
    seen = []
    monkeypatch.setattr(m, "estimate", lambda p, n: seen.append((rows(p), n)) or estimate(p, n))
    got = fuse(rel, nodes, det).collect()
    pats, sources = seen[0]
    assert sources == 5
    assert ([[0], [1], [2], [3]], [15, 1, 1, 1], 20) in [tuple(p[1:]) for p in pats]
    assert len(got) == 20 and all(float(r["confidence"]) >= 0.5 for r in got)


def test_estimate_with_multiplicities(spark):
    schema = "sets array<array<int>>, ks array<bigint>, n bigint"
    w = weights(estimate(spark.createDataFrame([([[0], [1]], [15, 1], 100), ([[0, 1]], [1], 30)], schema), 2))
    same = weights(estimate(spark.createDataFrame([([[0]] * 15 + [[1]], 100), ([[0, 1]], 30)], "sets array<array<int>>, n bigint"), 2))
    capped = weights(estimate(spark.createDataFrame([([[0], [1]], [2, 1], 100), ([[0, 1]], [1], 30)], schema), 2))
    assert w((0,)) == pytest.approx(same((0,))) and w((0,)) < capped((0,)) and w((0,)) < w((1,))


def test_many_agreeing_sources_do_not_tie(spark):
    """Every named source votes for itself, and weights of any size are told apart."""
    nodes = spark.createDataFrame([("u:b", "Beta")], NODES)
    det = spark.createDataFrame([("s0", 1)], "source string, trust int")
    data = [(g, 0.5 if i < 45 else 0.7, f"s{i}") for g in range(4) for i in range(75)]
    rel = relations(spark, [(i, "Alpha", f"u:{g}", "Beta", "u:b", x, s, 1) for i, (g, x, s) in enumerate(data)])
    got = fuse(rel, nodes, det).collect()
    assert [(r["confidence"], r["confidence_posterior"]) for r in got] == [("0.5", 1.0)] * 4


def planted(links=400, seed=5):
    """Confidences with known true values: four honest sources, a bad one and three that copy it."""
    r = random.Random(seed)
    truth, out = {}, []
    for g in range(links):
        truth[g] = r.randrange(100)
        say = lambda right: truth[g] if r.random() < right else r.randrange(100)
        bad = say(0.35)
        votes = {f"h{i}": say(0.8) for i in range(4) if r.random() < 0.8} | {"bad": bad} | {f"copy{i}": bad if r.random() < 0.95 else say(0.35) for i in range(3)}
        out += [(g, v / 100, s) for s, v in votes.items()]
    return truth, out


def test_fusion_beats_the_majority_where_sources_copy(spark):
    truth, data = planted()
    nodes = spark.createDataFrame([("u:b", "Beta")], NODES)
    det = spark.createDataFrame([("h0", 1)], "source string, trust int")
    rel = relations(spark, [(i, "Alpha", f"u:{g:05d}", "Beta", "u:b", x, s, 1) for i, (g, x, s) in enumerate(data)])
    first = {}
    by = collections.defaultdict(list)
    for i, (g, x, _) in enumerate(data):
        first.setdefault(g, i)
        by[first[g]].append(x)
    got = {r["group_seq"]: float(r["confidence"]) for r in fuse(rel, nodes, det).collect()}
    right = lambda pick: sum(pick(i) == truth[g] / 100 for g, i in first.items()) / len(first)
    fused, majority = right(got.__getitem__), right(lambda i: collections.Counter(by[i]).most_common(1)[0][0])
    assert fused > 0.9 and majority < 0.75, (fused, majority)


# --- top n


def test_top_n(spark):
    r = random.Random(1)
    data = [(f"g{r.choice([0, 0, 0, 1, 2, 3])}", r.choice([0.1, 0.5, 0.9, 1.0, 1.0]), i) for i in range(400)] + [(None, 1.0, 900), ("g1", None, 901), ("g2", float("nan"), 902), ("g9", 0.0, 903), ("g9", -0.0, 904)]
    df = spark.createDataFrame(data, "g string, s double, i bigint").withColumn("place", F.lit(1)).withColumn("band", F.lit("x"))
    for bands in ((0.75, 0.5, 0.25), (), (0.9,)):
        got = rows(top_n(df, "g", "s", "i", 3, Workspace(spark, "t"), bands).select("g", "place", "i"))
        by = collections.defaultdict(list)
        for g, s, i in data:
            if g and s is not None and s == s:
                by[g].append((-s, i))
        assert got == sorted([(g, k, i) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:3], 1)], key=repr)
    assert top_n(df.limit(0), "g", "s", "i", 3, Workspace(spark, "t")).collect() == []


def test_lower_bands_limit_hot_groups_before_the_shuffle(spark, monkeypatch):
    plans = []
    cut = Workspace.cut
    monkeypatch.setattr(Workspace, "cut", lambda self, df, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(self, df, **k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        # one group has all rows but one
        df = spark.range(50_000, numPartitions=4).select(F.when(F.col("id") == 7, "b").otherwise("a").alias("g"), (F.col("id") % 1000 / 1000).alias("s"), F.col("id").alias("i"))
        got = rows(top_n(df, "g", "s", "i", 3, Workspace(spark, "t")).select("g", "place", "i"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", 1, 999), ("a", 2, 1999), ("a", 3, 2999), ("b", 1, 7)]
    lower = [p for p in plans if "LeftAnti" in p]
    assert len(lower) == 3
    for p in lower:  # a plan is printed from the top: the limit of the scan's side stands below its exchange
        scan = p[p.index("LeftAnti") :]
        assert "Partial" in scan[: scan.index("Scan parquet")].split("WindowGroupLimit")[-1]
        assert scan.index("Exchange hashpartitioning(g") < scan.index(", Partial")


def test_top_parents_ties(spark):
    nodes = spark.createDataFrame([("u:a", "Alpha")], NODES)
    rel = relations(spark, [(i, "Alpha" if i % 2 else "ALPHA (x)", None, f"p{i % 5}", None, [0.5, 0.5, 0.9, None, 7.0][i % 5], "s", 1) for i in range(20)])
    assert rows(top_parents(rel, nodes)) == [("u:a", 1, 2), ("u:a", 2, 0), ("u:a", 3, 1)]


# --- copies


def test_collapse(spark):
    data = [
        (1, "http://a/1", "Fête de X"), (2, "HTTP://A/1/", "x, DE fête"), (3, "<http://a/1>", unicodedata.normalize("NFD", "Fête de X")), (4, "http://a/1", "Fete de X"), (5, None, "NULL"), (6, "NaN", None),
        (7, "-", None), (8, "http://a/1", "Fête X"), (9, "http://a/1", "Fête de X"), (10, "http://a/1", "Fête de de X"), (11, " NULL ", ""),
    ]
    df = spark.createDataFrame([(*x, 1, "k") for x in data], "row_id bigint, URI string, `skos:prefLabel` string, n int, canon string")
    groups, members = collapse(df, "row_id", ["URI"], ["skos:prefLabel"])
    assert rows(members) == sorted([(1, 2), (1, 3), (1, 9), (5, 6), (5, 11)], key=repr)
    assert dict(rows(groups)) == {1: 4, 4: 1, 5: 3, 7: 1, 8: 1, 10: 1}
    assert collapse(df.limit(0), "row_id", ["URI"], ["skos:prefLabel"])[1].collect() == []


# --- set joins


def brute_pairs(data, t):
    sets = {i: set((x or "").lower().split()) for i, x in data}
    return sorted(((a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t), key=repr)


@pytest.mark.parametrize(("t", "small"), [(0.6, 4096), (0.6, 1), (0.4, 3), (0.8, 2), (1.0, 5)])
def test_set_join_is_complete(spark, monkeypatch, t, small):
    r = random.Random(int(t * 10) + small)
    hot = ["de", "la", "fete"]
    data = [(i, " ".join(r.sample(hot, r.randint(0, 3)) + [f"w{r.randrange(12)}" for _ in range(r.randint(0, 5))])) for i in range(250)] + [(900, None), (901, ""), (902, "solo"), (903, "solo solo")]
    df = spark.createDataFrame([(i, x, 1) for i, x in data], "row_id bigint, label string, sid int")
    monkeypatch.setattr(setjoin.similar_sets, "__defaults__", (7, small, 1.0))
    got = rows(similar_rows(df, "row_id", words(F.col("label")), t))
    assert got == brute_pairs(data, t)


@pytest.mark.parametrize("small", [4096, 2])
def test_repeated_trees_reach_their_recall(spark, small):
    r = random.Random(small)
    data = {i: sorted({f"w{r.randrange(14)}" for _ in range(r.randint(2, 6))}) for i in range(220)}
    keys = {" ".join(v): i for i, v in data.items()}
    df = spark.createDataFrame([(i, k) for k, i in keys.items()], "sid int, key string")
    want = set(brute_pairs([(i, k) for k, i in keys.items()], 0.6))
    got = rows(similar_sets(df, 0.6, Workspace(spark, "t"), small_pairs=small, recall=0.95))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want)


def test_classes_hold_every_row_once(spark):
    data = [(1, "a b c"), (2, "c b a"), (3, "a b c d"), (4, "x y"), (5, "c  a b b"), (6, None)]
    pairs, members = similar_classes(spark.createDataFrame(data, "row_id bigint, label string"), "row_id", words(F.col("label")))
    assert rows(pairs) == [(1, 3)] and rows(members) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1)]


def test_sets_of_many_items(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(3000)]
    data = [(i, " ".join(r.sample(base[:700], r.randint(300, 600)))) for i in range(30)] + [(100 + i, " ".join(base[i * 5 : 1000 + i * 9])) for i in range(30)]
    df = spark.createDataFrame(data, "row_id bigint, label string")
    got = rows(similar_rows(df, "row_id", words(F.col("label")), 0.6))
    assert got == brute_pairs(data, 0.6) and len(got) > 100


def test_set_join_empty_and_long(spark):
    long = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, long), (2, long + " more")], "row_id bigint, label string")
    assert rows(similar_rows(df, "row_id", words(F.col("label")), 0.9)) == [(1, 2)]
    assert similar_rows(df.limit(0), "row_id", words(F.col("label")), 0.6).collect() == []


# --- encoding


@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, public_tokenizers.PATTERN


def test_encode(spark, reference_encoder):
    e, _, _ = reference_encoder
    r = random.Random(9)
    texts = [None, "", " ", "\t \n", "Hello world", "<|endoftext|>", "été œuvre 尺八 عود 🎵‍﻿", "a" * 5000, "x\x00y", "  two  spaces ", "it's we'LL", "1234567 8", "".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x2FF), r.randint(0x4E00, 0x4EFF), r.randint(0x1F300, 0x1F5FF)])) for _ in range(3000)), "mot " * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    shared = shared_model(spark)
    out = df.select("i", encoded(F.col("text"), shared).alias("ids")).withColumn("back", decoded(F.col("ids"), shared))
    for i, ids, back in out.collect():
        assert list(ids) == (e.encode_ordinary(texts[i]) if texts[i] else []), i
        assert back == (texts[i] or "")


def test_codec_forgets(reference_encoder, monkeypatch):
    import skosloom.llm.encode as m

    _, ranks, pattern = reference_encoder
    monkeypatch.setattr(m, "MEMORY", 1)
    c = Codec(serialise(ranks), pattern)
    assert c.encode_batch(["a b c"]) == c.encode_batch(["a b c"])
    with pytest.raises(ValueError, match="gaps"):
        serialise({b"a": 1})


# --- mixing


def test_mix(spark):
    docs = [(i, "mot " * (5 + i % 40), " A " if i % 2 else "a", "z") for i in range(400)] + [(1000 + i, "mot " * 20, "b", "z") for i in range(50)] + [(2000, None, "a", "z"), (2001, "", "b", "z"), (2002, "mot", None, "z"), (2003, "mot " * 9000, "other", "z")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, rank string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.5, 4), ("none", 0.1, 3)], "source string, target_weight double, max_repeats int")
    chosen, report = mix(df, targets)
    rep = {r["source"]: r for r in report.collect()}
    picked = chosen.collect()
    assert set(rep) == {"a", "b", "none"} and rep["none"]["mix_tokens"] == 0
    assert all(1 <= r["copies"] <= {"a": 1, "b": 4}[r["source"]] for r in picked)
    assert len({r["doc_id"] for r in picked}) == len(picked) and not {r["doc_id"] for r in picked} & {2000, 2001, 2002, 2003}
    assert rep["b"]["mix_tokens"] == 4 * rep["b"]["source_tokens"] and rep["b"]["used_docs"] == 50
    assert abs(rep["a"]["actual_share"] - 0.5) < 0.005
    fixed = {r["source"]: r for r in mix(df, targets, total=10_000)[1].collect()}
    assert fixed["b"]["most_copies"] == 4 and abs(fixed["a"]["mix_tokens"] - 5000) < 50
    assert mix(df, targets)[0].exceptAll(chosen).count() == 0
    none, shares = mix(df.limit(0), targets)
    assert none.collect() == [] and [r["actual_share"] for r in shares.collect()] == [0.0] * 3


def test_mix_prefers_large_documents(spark):
    df = spark.createDataFrame([(i, "mot " * (10 if i % 2 else 100), "a") for i in range(2000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    size = df.count()
    got = mix(df, targets, total=22_000)[0]
    large = got.where("tokens > 50").count()
    assert large > 5 * (got.count() - large) and got.count() < size


# --- stuffing

#: Words that the test texts share as function words, as a corpus would give them.
WORDS = frozenset("le la de une un pour les en et qui dans ce que personne ne das den der die an eine ohne par n a du".split())


def stuffed_share(text):
    return any_share(text, WORDS)


PROSE = "Le maître de chapelle copia la messe en une nuit pour la fête patronale, ce que personne ne contesta. "
SPAM = {
    "repeated": "violon pas cher, violon, violon promo, " * 20,
    "links": "\n".join(f"https://www.site{i}.example/page{i}.html" for i in range(30)),
    "tags": " ".join(f"#violon{i} #cours{i}" for i in range(40)),
    "menu": "\n".join(f"> Voir tous les {w} en ligne" for w in ["violon", "luth", "cornet", "harpe", "orgue"] * 6),
    "spaced": "V I O L O N VIOLON!!! *VIOLON* violon " * 20,
    "html": "\n".join(f'<a href="https://a{i}.example/x">Violon avis</a>' for i in range(30)),
    "slogan": "acheter le violon acheter le violon acheter le violon " * 10,
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam(kind):
    assert stuffed_share(SPAM[kind]) > 0.5
    assert stuffed_share(PROSE + "\n" + SPAM[kind]) > 0.5
    assert stuffed_share(PROSE * (2 + 2 * len(SPAM[kind]) // len(PROSE)) + "\n" + SPAM[kind]) <= 0.5


def test_prose_and_edges(spark):
    refrain = "\n".join([PROSE.strip(), "Personne n'a retrouvé la partie de timbale que le facteur citait en 1629."] * 12)
    german = "Der Kantor verkaufte das Fagott an den Grafen ohne jede Begründung. Die Zunft verlangte eine knappere Definition. " * 4
    for t in (PROSE, PROSE * 200, refrain, german, "", " \n\t", None):
        assert stuffed_share(t) <= 0.5
    df = spark.createDataFrame([(1, None), (2, ""), (3, SPAM["tags"]), (4, SPAM["tags"])], "doc_id int, text string")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", stuffed(F.col("text"), WORDS).alias("s")).collect()}
    assert got[1] == got[2] == 0.0 and got[3] == got[4] > 0.5


@pytest.mark.parametrize("end", ["", ",", "."])
def test_keyword_phrases_with_function_words(end):
    adverts = ["soldes", "prix", "occasion", "partition gratuite", "neuf"]
    french = f"{end} ".join(f"votre luth royal et le luth royal {a} pour le luth royal ou luth royal {a} avec luth royal" for a in adverts * 3)
    german = f"{end} ".join(f"Klage und Klage {a} für Klage oder Klage {a} mit Klage" for a in ("Test", "Preis", "Angebot"))
    for t in (french, german, PROSE + "\n" + french):
        assert stuffed_share(t) > 0.5
    # one phrase of 15 terms, all different, over and over without an end
    assert stuffed_share("le violon de qualité pour la fête et votre cours en ligne avec une remise " * 12) > 0.5


def test_long_segments_are_judged_in_all_their_windows():
    r = random.Random(3)
    # prose without ends of sentences: every other term a function word, all others new
    prose = lambda n: " ".join(w for i in range(n // 2) for w in (r.choice(["le", "une", "dans", "pour", "et", "qui"]), f"mot{r.random():.9f}".replace(".", "")))
    spam = "achat avec le luth pas cher "
    assert stuffed_share(prose(70) + " " + spam * 3000) > 0.95
    assert stuffed_share(prose(128) + " " + spam * 300) > 0.5
    assert 0 < stuffed_share(spam * 30 + prose(1000)) < 0.5
    # links weigh their characters, not their terms
    assert stuffed_share(prose(256) + " " + f"https://www.example.org/{'luth' * 20}/ " * 128) > 0.5


def test_short_segments_are_judged_by_what_is_around_them():
    # the first lines of the menu end a window of prose
    prose = " ".join(f"mot{i}" if i % 2 else "le" for i in range(120)) + "."
    menu = ["> Voir tous les luth en ligne"] * 3
    letters = lambda t: sum(c.isalnum() for c in t)
    size = letters("".join(menu))
    assert stuffed_share("\n".join([prose, *menu])) == pytest.approx(size / (size + letters(prose)))


PROSE_IN = {
    "pl": "W roku 1652 kapela zapłaciła pięciu śpiewakom i jednemu organiście. Mistrz chóru poprosił o krótszą definicję, ale nikt jej nie napisał.",
    "fi": "Luostarin kirjasto osti vanhan urun ja korjautti sen ennen talvea. Kukaan ei kuitenkaan kertonut, kuka sen oli rakentanut.",
    "ru": "В архиве сохранилась только одна тетрадь с нотами. Переписчик не указал ни имени композитора, ни даты первого исполнения.",
    "zh": "教堂在一六五二年付給五位歌手和一位管風琴師報酬。沒有人知道這首曲子是誰寫的，但是抄本仍然保存得很好。",
    "ja": "この曲は古い写本に残っているが、作者の名前は書かれていない。私たちは図書館でその楽譜を見つけた。",
    "hi": "पुस्तकालय में एक पुरानी पांडुलिपि मिली है। किसी को नहीं पता कि इसे किसने लिखा था।",
    "ar": "وجد الباحث مخطوطة قديمة في مكتبة الدير. لم يكتب الناسخ اسم المؤلف ولا تاريخ النسخ.",
    "el": "Στο αρχείο σώζεται μόνο ένα τετράδιο με νότες. Ο αντιγραφέας δεν έγραψε το όνομα του συνθέτη.",
    "tr": "Manastırın kütüphanesi eski orgu kıştan önce tamir ettirdi. Kimse bu parçayı kimin yazdığını bilmiyor.",
    "hu": "A kolostor könyvtára megvette a régi orgonát, és tél előtt megjavíttatta. Senki sem tudja, ki írta ezt a darabot.",
    "cs": "Knihovna kláštera koupila staré varhany a před zimou je dala opravit. Nikdo neví, kdo tu skladbu napsal.",
    "ko": "수도원 도서관에서 오래된 악보가 발견되었다. 누가 이 곡을 썼는지 아무도 모른다.",
    "th": "ห้องสมุดของวัดมีต้นฉบับเก่าเล่มหนึ่ง ไม่มีใครรู้ว่าใครเป็นคนเขียนเพลงนี้",
    "vi": "Thư viện của tu viện đã mua cây đàn cổ và sửa lại trước mùa đông. Không ai biết ai đã viết bản nhạc này.",
    "he": "בספריית המנזר נמצא כתב יד ישן. איש אינו יודע מי כתב את היצירה הזאת.",
    "sv": "Klostrets bibliotek köpte den gamla orgeln och lät laga den före vintern. Ingen vet vem som skrev stycket.",
    "id": "Perpustakaan biara membeli organ tua itu dan memperbaikinya sebelum musim dingin. Tidak ada yang tahu siapa penulisnya.",
    "ta": "நூலகத்தில் ஒரு பழைய கையெழுத்துப் பிரதி கிடைத்தது. அதை எழுதியவர் யார் என்று யாருக்கும் தெரியாது.",
}


@pytest.mark.parametrize("lang", PROSE_IN)
def test_prose_of_languages_that_the_corpus_does_not_know(lang):
    t = PROSE_IN[lang]
    assert any_share(t) < 0.5 and stuffed_share(t) < 0.5 and stuffed_share(t.replace(". ", ".\n")) < 0.5
    assert stuffed_share(t.rstrip(".।。")) < 0.5


def test_keywords_of_languages_that_the_corpus_does_not_know():
    assert any_share("tanie skrzypce, skrzypce sklep, skrzypce promocja, skrzypce używane, " * 12) > 0.5
    assert any_share("便宜 小提琴 小提琴 商店 小提琴 特价 " * 20) > 0.5
    assert any_share("\n".join(f"дешевые {w} цена" for w in ("скрипка", "лютня", "орган", "арфа", "флейта") * 6)) > 0.5


def test_one_by_one_as_together():
    texts = [PROSE, None, SPAM["tags"], "", PROSE + "\n" + SPAM["menu"], *PROSE_IN.values(), SPAM["html"], "\x00 a\x00b"]
    assert list(shares(texts, WORDS)) == pytest.approx([any_share(t, WORDS) for t in texts])


def test_function_words_of_the_corpus(spark):
    french = ["Le luth est dans la salle. On le garde pour la fête.", "La messe est pour le soir.\nluth promo luth achat", "Le chantre est dans la salle.", "La viole est pour le maître.", "Le motet est dans la marge."]
    rows_ = [(i, t, " FR" if i % 2 else "fr", "x") for i, t in enumerate(french * 3)] + [(90 + i, "luth promo achat luth viole " * 4, "fr", "y") for i in range(9)] + [(200, None, None, "z"), (201, "", "fr", "z")]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string, share string")
    words = {r["word"] for r in function_words(df).collect()}
    assert {"le", "la", "est", "pour", "dans"} <= words and not words & {"promo", "achat", "viole"}
    assert {r[0] for r in stuffed_pages(df).collect()} == set(range(90, 99))
    assert stuffed_pages(df.limit(0)).collect() == []


def test_repetition():
    import numpy as np

    assert repetition(np.array([1, 2, 3] * 20))[1] > 0.9
    assert max(repetition(np.arange(60))) == 0.0
