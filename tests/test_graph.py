import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skosloom.operators import discovery as D
from skosloom.operators import graph as G
from skosloom.operators import relations as R
from skosloom.operators import similarity as X
from skosloom.plans.workspace import Workspace
from tests.conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def has_cycle(pairs):
    out, state = {}, {}
    for p, c in pairs:
        out.setdefault(p, []).append(c)

    def visit(n):
        state[n] = 1
        for c in out.get(n, []):
            if state.get(c) == 1 or (c not in state and visit(c)):
                return True
        state[n] = 2
        return False

    return any(n not in state and visit(n) for n in list(out))


def test_bounded_and_unbounded_reduction(spark):
    short = [("p", "a"), ("a", "b"), ("p", "b")]
    long = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", "n6")]
    assert rows(G.bounded_redundant(edges(spark, short), Workspace(spark, "t"))) == [("p", "b")]
    assert rows(G.bounded_redundant(edges(spark, long), Workspace(spark, "t"))) == []
    assert rows(G.transitive_redundant(edges(spark, short + long), Workspace(spark, "t"))) == [("n0", "n6"), ("p", "b")]


def test_depths_and_levels(spark):
    e = edges(spark, [("r", "a"), ("a", "b"), ("r", "b")])
    assert rows(G.depths(e, Workspace(spark, "t"))) == [("a", 1), ("b", 1), ("r", 0)]
    assert rows(G.longest_levels(e, Workspace(spark, "t"))) == [("a", 2), ("b", 3), ("r", 1)]
    assert rows(G.root_distances(e, Workspace(spark, "t")).select("root", F.col("depth"))) == [("r", 0), ("r", 1), ("r", 1)]


def test_cycles_are_broken(spark):
    r = random.Random(2)
    pairs = sorted({(f"v{r.randrange(25)}", f"v{r.randrange(25)}") for _ in range(45)} | {("x", "y"), ("y", "x"), ("z", "z")})
    core = set(rows(G.cyclic_core(edges(spark, pairs), Workspace(spark, "t"))))
    kept, gone = G.break_cycles(edges(spark, pairs), Workspace(spark, "t"))
    kept, gone = rows(kept), rows(gone)
    assert has_cycle(pairs) and not has_cycle(kept)
    assert set(kept) | set(gone) == set(pairs) and not set(kept) & set(gone)
    assert set(gone) <= core


def elementary_cycles(pairs):
    out = {}
    for p, c in pairs:
        out.setdefault(p, []).append(c)
    found = []

    def walk(start, path):
        for c in out.get(path[-1], []):
            if c == start:
                found.append([*zip(path, [*path[1:], start], strict=True)])
            elif c > start and c not in path:
                walk(start, [*path, c])

    for n in sorted(out):
        walk(n, [n])
    return found


def test_weakest_edge_of_every_cycle(spark):
    one = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.4), ("c", "a", 0.7), ("x", "x", 0.1)], "parent string, child string, confidence double")
    assert rows(G.weakest_edges(one, Workspace(spark, "t"))) == [("b", "c"), ("x", "x")]
    r = random.Random(6)
    edge = {(f"v{r.randrange(9)}", f"v{r.randrange(9)}"): r.choice([0.3, 0.5, 0.5, 0.8, None]) for _ in range(24)}
    want = {min(c, key=lambda e: (0.5 if edge[e] is None else edge[e], *e)) for c in elementary_cycles(edge)}
    df = spark.createDataFrame([(*k, v) for k, v in edge.items()], "parent string, child string, confidence double")
    assert set(rows(G.weakest_edges(df, Workspace(spark, "t")))) == want


def test_detours_against_brute_force(spark):
    r = random.Random(9)
    pairs = sorted({(f"v{r.randrange(12)}", f"v{r.randrange(12)}") for _ in range(40)} | {("hub", f"v{i}") for i in range(12)})

    def paths(p, c, n):
        todo = [(p,)]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x[-1] and b not in x and (a, b) != (p, c):
                    if b == c:
                        return True
                    if len(x) < n:
                        todo.append((*x, b))
        return False

    assert rows(G.bounded_redundant(edges(spark, pairs), Workspace(spark, "t"), 3)) == [(p, c) for p, c in pairs if p != c and paths(p, c, 3)]


def test_no_levels_with_a_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        G.longest_levels(edges(spark, [("r", "a"), ("a", "b"), ("b", "a")]), Workspace(spark, "t"))
    with pytest.raises(ValueError, match="cycle"):
        G.longest_levels(edges(spark, [("a", "b"), ("b", "a")]), Workspace(spark, "t"))


def test_review_keeps_every_variant(spark):
    rel = spark.createDataFrame([(i, f"c{i}", f"u:{i}", "Chant" + "s" * (i % 2) + "." * i, None, 0.8, "candidate_parent") for i in range(14)], "seq int, child string, child_uri string, parent string, parent_uri string, confidence double, type string")
    q = R.review_queue(rel).first()
    assert len(q["variants"].split(" | ")) == 14 and len(q["children"].split(" | ")) == 10


def test_components(spark):
    lab = dict(rows(G.component_labels(edges(spark, [("b", "a"), ("b", "c"), ("d", "c"), ("x", "y")]), Workspace(spark, "t"))))
    assert lab == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_ties_and_caps(spark):
    rel = spark.createDataFrame([("c", s, float(v)) for s, v in enumerate([1.0, 0.9, 0.9, 0.9, 0.8, float("nan"), 2.0])], "child_uri string, seq int, confidence double")
    assert sorted(r["seq"] for r in R.top_with_ties(rel).collect()) == [0, 1, 2, 3]
    assert sorted(r["seq"] for r in R.parent_cap(rel).collect()) == [0, 1, 2]


def test_decisions(spark):
    rel = spark.createDataFrame([(1, "a", "u:a", "Chants", None, 0.8, "candidate_parent"), (2, "b", "u:b", "chant", None, 0.8, "candidate_parent"), (3, "c", "u:c", "Autre", None, 0.7, "candidate_parent"), (4, "d", "u:d", "Rien", None, 0.7, "candidate_parent")], "seq int, child string, child_uri string, parent string, parent_uri string, confidence double, type string")
    dec = spark.createDataFrame([("chant", "A", None, None), ("autr", "I", None, None), ("autr", "I", None, "u:c")], "group_key string, action string, alternative_term string, child_uri string")
    terms = spark.createDataFrame([("Chants", "u:ch"), ("chant", "u:ch"), ("Autre", "u:au")], "term string, uri string")
    got = {r["seq"]: (r["action"], r["taken"], r["parent_uri"]) for r in R.apply_decisions(rel, dec, terms).collect()}
    assert got == {1: ("A", True, "u:ch"), 2: ("A", True, "u:ch"), 3: ("I", True, "u:au"), 4: ("S", False, None)}
    queue = {r["group_key"]: r["n_children"] for r in R.review_queue(rel).collect()}
    assert queue == {"chant": 2, "autr": 1, "rien": 1}


def test_families(spark):
    labels = ["Flûte à bec", "Flûte", "Flûte", "Flûte de Pan", "Musique sacrée", "Musique", "Messe en musique", "Chant de messe", "Chant de Noël", "Chant de marche"]
    df = spark.createDataFrame([(i, x, f"u:{i}") for i, x in enumerate(labels, 1)], "row_id bigint, label string, uri string")
    pairs = X.similar_pairs(df)
    got = {(r["a"], r["b"]): round(r["sim"], 4) for r in pairs.collect()}
    assert got == {("Musique sacrée", "Musique"): 0.7, ("Chant de messe", "Chant de Noël"): 0.7, ("Chant de messe", "Chant de marche"): 0.7, ("Chant de Noël", "Chant de marche"): 0.7}
    fam = {}
    for root, member in rows(X.families(pairs).select("root", "member")):
        fam.setdefault(root, set()).add(member)
    assert fam["musique"] == {"Musique", "Musique sacrée"} and fam["chant de "] == set(labels[7:])
    merged = X.merged_families(X.families(pairs), Workspace(spark, "t"))
    by = {}
    for root, member in rows(merged):
        by.setdefault(root, set()).add(member)
    assert by == {"musique": {"Musique", "Musique sacrée"}, "chant de m": set(labels[7:])}
    links = rows(X.family_links(df, merged).select("child", "parent", "confidence", "relation_category"))
    assert links == [("Musique sacrée", "Musique", 0.8, "lexical_family_generic")]
    prefix = {(r["child"], r["parent_uri"]): round(r["confidence"], 4) for r in X.prefix_links(df).collect()}
    assert prefix == {("Flûte à bec", "u:3"): 0.7333, ("Flûte de Pan", "u:3"): 0.7333}


def brute_linkage(v, cut):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] >= cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


def test_average_linkage():
    r = np.random.default_rng(1)
    for _ in range(30):
        v = r.normal(size=(r.integers(1, 14), 3))
        lab = D.average_linkage(v.copy(), 0.4)
        assert sorted(sorted(int(i) for i in np.flatnonzero(np.array(lab) == k)) for k in set(lab)) == brute_linkage(v, 0.4)


def test_zones(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, vector array<double>")
    got = {}
    for z, i in rows(D.zones(df, "id", "vector", Workspace(spark, "t"), 0.7).select("zone", "id")):
        got.setdefault(z, []).append(i)
    assert sorted(sorted(g) for g in got.values()) == [g for g in brute_linkage(v, 0.3) if len(g) > 1]


def test_close_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    r = np.random.default_rng(5)
    v = r.normal(size=(40, 4))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] >= 0.5}
    got = [(a, b) for a, b, _ in rows(D.similar_vectors(df, "id", "vector", 0.5))]
    assert sorted(want) == sorted(got)


def test_word_pairs_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 7)
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["de"] * 6 + ["à"] * 4 + ["en"] * 3
    labels = sorted({" ".join(r.choices(words, k=r.choice([1, 2, 3, 5, 5, 9]))) for _ in range(150)}, key=lambda x: (len(x) % 7, x))
    df = spark.createDataFrame([(i, x, f"u{i}") for i, x in enumerate(labels)], "row_id bigint, label string, uri string")
    sets = [set(x.split()) for x in labels]
    for least in (0.3, 0.6 - 0.2, 1.0):
        want = [(i, j, labels[i], labels[j], len(a & b) / len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) / len(a | b) >= least]
        assert rows(X.word_pairs(X.terms(df), least)) == sorted(want, key=repr)


def test_pairs_of_a_frequent_word_are_dropped_by_the_join(spark):
    """1,200 labels share two words of five: 719,400 pairs meet, and the join itself drops them."""
    df = spark.createDataFrame([(i, f"de à x{i} y{i} z{i}", f"u{i}") for i in range(1200)], "row_id bigint, label string, uri string")
    found = X.word_pairs(X.terms(df), 0.3)
    assert found.collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(plan) if "Join" in x)
    assert "bit_count" in plan[join] and not any("Aggregate" in x for x in plan[:join])
