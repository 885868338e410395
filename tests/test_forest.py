import random

from skosloom.operators.forest import descendants, hierarchy, other_parents, resolve_forest, resolved
from skosloom.plans.workspace import Workspace
from tests.conftest import rows


def brute(parents):
    out = {}
    for n in parents:
        seen, x = [], n
        while parents.get(x) is not None and x not in seen:
            seen.append(x)
            x = parents[x]
        if x in seen:
            out[n] = ("", -1, "", "cycle" if x == n else "below_cycle")
        else:
            out[n] = (x, len(seen), " > ".join([x, *reversed(seen)]), "tree")
    return out


def solve(spark, parents):
    ids = spark.createDataFrame([(n,) for n in parents] or [], "node string")
    edges = spark.createDataFrame([(c, p) for c, p in parents.items() if p is not None], "child string, parent string")
    return resolve_forest(ids, edges, Workspace(spark, "t"))


def test_random_forests(spark):
    r = random.Random(3)
    parents = {}
    for t in range(12):  # trees, a star, long chains, and cycles with trees below
        n = r.choice([1, 2, 5, 30])
        for i in range(n):
            parents[f"t{t}n{i}"] = f"t{t}n{r.randrange(i)}" if i else None
    for i in range(70):
        parents[f"chain{i}"] = f"chain{i - 1}" if i else None
        parents[f"star{i}"] = "star0" if i else None
    for k in (1, 2, 3, 7):
        for i in range(k):
            parents[f"c{k}n{i}"] = f"c{k}n{(i + 1) % k}"
        for i in range(5):
            parents[f"c{k}b{i}"] = f"c{k}b{i - 1}" if i else f"c{k}n0"
    got = {x["node"]: (x["root"], x["depth"], " > ".join(x["path"]), x["state"]) for x in solve(spark, parents).collect()}
    assert got == brute(parents)


def test_links_from_all_places(spark):
    nodes = spark.createDataFrame(
        [("u:a", "Alpha", None, ["u:b", None, "u:b"], 1), ("u:b", "Beta", [], None, 1), ("u:c", "Céta (x)", ["u:nowhere"], [], 1), ("u:d", "Delta", None, None, 1), ("u:e", "Same", None, None, 1), ("u:f", "Same", None, None, 1), ("u:a", "Alpha", None, None, 2), (None, "No", ["u:a"], None, 1)],
        "uri string, preflabel string, parents array<string>, children array<string>, depth int",
    )
    concepts = spark.createDataFrame([(1, "u:c", "BETA", None), (2, "u:b", None, '"ceta"##Delta; Same'), (3, None, "Alpha", None), (4, "u:zz", "Alpha", None), (5, "u:e", "Same", None)], "row_id bigint, URI string, `skos:broader` string, `skos:narrower` string")
    h = hierarchy(nodes, concepts)
    assert h.columns == ["uri", "root_uri", "depth", "path", "state"]
    assert rows(h) == sorted([("u:a", "u:a", 0, "u:a", "tree"), ("u:b", "u:a", 1, "u:a > u:b", "tree"), ("u:c", "u:a", 2, "u:a > u:b > u:c", "tree"), ("u:d", "u:a", 2, "u:a > u:b > u:d", "tree"), ("u:e", "u:e", 0, "u:e", "tree"), ("u:f", "u:f", 0, "u:f", "tree")], key=repr)
    assert rows(descendants(resolved(nodes, concepts, Workspace(spark, "t")))) == sorted([("u:a", "u:b", 1), ("u:a", "u:c", 2), ("u:a", "u:d", 2), ("u:b", "u:c", 1), ("u:b", "u:d", 1)], key=repr)


def test_empty_and_several_parents(spark):
    assert solve(spark, {}).collect() == []
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "node string")
    edges = spark.createDataFrame([("c", "b"), ("c", "a"), ("c", "a"), ("c", None), ("c", "no")], "child string, parent string")
    got = resolve_forest(ids, edges, Workspace(spark, "t"))
    assert sorted((x["node"], x["path"]) for x in got.collect()) == [("a", ["a"]), ("b", ["b"]), ("c", ["a", "c"])]
    assert rows(other_parents(ids, edges)) == [("c", "b")]
