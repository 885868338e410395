import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skosloom.functions import text as X
from skosloom.functions.labels import label_key, words
from skosloom.operators import similarity
from skosloom.operators.similarity import common_substrings


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("Flûte à bec", "flute a bec"), ("Musique sacrée", "musique sacree"), ("  A--b  (c) ", "a--b c"), (None, ""), ("", ""), ("été œuvre", "ete œuvre")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize_text) == want


@pytest.mark.parametrize(("raw", "clean", "term"), [("A (b) (c)", "A (b)", "c"), ("A (b (c))", "A (b (c))", None), ("plain", "plain", None), ("Flûte à bec (instrument à vent)", "Flûte à bec", "instrument à vent")])
def test_label_parts(spark, raw, clean, term):
    df = spark.createDataFrame([(raw,)], "x string").select(*X.label_parts(F.col("x")))
    assert tuple(df.first()) == (clean, term)


@pytest.mark.parametrize(
    ("raw", "clean", "source"),
    [
        ("Concept (avec parenthèses) final (Source)", "Concept (avec parenthèses) final", "Source"),
        ("x (a (b))", "x", "a (b)"),
        ("x (a))", "x", "a)"),
        ("a (b) c", "a (b) c", ""),
        ("Flûte droite à bloc (Larousse 2023)", "Flûte droite à bloc", "Larousse 2023"),
        (None, "", ""),
        ("()", "", ""),
        (")", ")", ""),
    ],
)
def test_source_parts(spark, raw, clean, source):
    df = spark.createDataFrame([(raw,)], "x string").select(*X.source_parts(F.col("x")))
    assert tuple(df.first()) == (clean, source)


def test_small_functions(spark):
    base, rest = X.base_and_complement(F.col("x"), "de")
    assert tuple(spark.createDataFrame([("flute de bec de bois",)], "x string").select(base, rest).first()) == ("flute", "bec de bois")
    assert one(spark, "partition", X.stem) == "parti"
    assert one(spark, "ment", X.stem) == "ment"
    assert one(spark, ["b", "a", "b"], X.uri_list, "array<string>") == "b ## a"
    assert one(spark, [], X.uri_list, "array<string>") == ""
    assert one(spark, None, X.uri_list, "array<string>") == ""
    assert one(spark, "a & b < c", X.xml_text) == "a &amp; b &lt; c"
    assert one(spark, 0.83, X.confidence_bucket, "double") == "0.8-0.9"
    assert one(spark, "flute a bec", X.tokens) == ["flute", "bec"]
    assert one(spark, "chant de messe", X.tokens) == ["chant", "messe"]


def test_common_substrings():
    assert common_substrings("musique", "musicien") == ["musi"]
    assert common_substrings("abc", "abc") == []
    assert common_substrings(None, "abcd") == []
    assert common_substrings("Chant de messe", "chant de noel") == ["chant de "]


def brute_words(s):
    plain = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")).lower()
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain).split()


@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=("Cs", "Cn", "Co")), max_size=30), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None)
def test_words_against_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", words(F.col("x")).alias("w"))
    for i, w in df.collect():
        assert w == brute_words(texts[i]), repr(texts[i])


def test_words_of_every_character(spark):
    """Every assigned character between two letters, in lines of 64, as Python's tables have it."""
    known = [chr(i) for i in range(0x20, 0x110000) if unicodedata.category(chr(i)) not in ("Cs", "Cn", "Co")]
    texts = ["".join(f"a{c}b " for c in known[i : i + 64]) for i in range(0, len(known), 64)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", words(F.col("x")).alias("w"), label_key(F.concat(F.col("x"), F.lit("("))).alias("k"))
    wrong = [(texts[i], w) for i, w, k in df.collect() if w != brute_words(texts[i]) or k != " ".join(w)]
    assert not wrong


def test_label_key(spark):
    assert one(spark, "  Fête de X à Y (recueil) ", label_key) == "fete de x a y"
    assert one(spark, "A (b) (c)", label_key) == "a b"
    assert one(spark, None, label_key) == ""
    assert one(spark, "a\nb (x)", label_key) == "a b"


def test_terms_are_cut_once_a_batch(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choices("abc ", k=r.randint(0, 24))) for _ in range(60)] + [None, "", "Motet en fa", "MOTET EN SOL"]
    pairs = [(a, b) for a in texts for b in texts]

    def brute(a, b):
        x, y, kept = (a or "").lower().strip(), (b or "").lower().strip(), []
        for i in range(len(x) - 3):
            s = next((x[i:e] for e in range(len(x), i + 3, -1) if x[i:e] in y), "")
            if s and not any(s in k for k in kept):
                kept = [k for k in kept if k not in s] + [s]
        return kept

    cut, plain = [], similarity._grams
    monkeypatch.setattr(similarity, "_grams", lambda t, n: cut.append(t) or plain(t, n))
    assert similarity._all_common(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])) == [brute(a, b) for a, b in pairs]
    assert len(cut) == len(set(texts))
