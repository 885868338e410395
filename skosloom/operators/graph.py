"""Graph operators on edges ``parent``, ``child``: iterations of joins over written rounds.

Every loop writes its rounds through a ``Workspace`` and stops when a round
brings nothing new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skosloom.plans.workspace import Workspace


def edges_of(nodes: DataFrame) -> DataFrame:
    """Distinct links written in ``parents`` of the nodes; null elements are none."""
    return nodes.select(F.col("uri").alias("child"), F.explode("parents").alias("parent")).where(F.col("parent").isNotNull() & F.col("child").isNotNull()).distinct()


def all_edges_of(nodes: DataFrame) -> DataFrame:
    """Distinct links written on either side."""
    down = nodes.select(F.explode("children").alias("child"), F.col("uri").alias("parent")).where(F.col("child").isNotNull() & F.col("parent").isNotNull())
    return edges_of(nodes).unionByName(down).distinct()


def between(edges: DataFrame, nodes: DataFrame, key: str = "uri") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()
    return edges.join(ids, edges.child == ids.id, "left_semi").join(ids, F.col("parent") == ids.id, "left_semi")


def _detours(asked: DataFrame, hop: DataFrame, ws: Workspace, max_edges: int | None) -> DataFrame:
    """Those of ``asked`` (``parent``, ``child``) with another path of ``hop`` (``n``, ``m``) between their ends; one frontier per edge."""
    front = ws.cut(asked.join(hop.withColumnRenamed("n", "parent"), "parent").where((F.col("m") != F.col("child")) & (F.col("m") != F.col("parent"))).select("parent", "child", F.col("m").alias("n")))
    found, edges = [front.select("parent", "child").limit(0)], 1
    while (max_edges is None or edges < max_edges) and front.take(1):
        step = ws.cut(front.join(hop, "n").where(F.col("m") != F.col("parent")).select("parent", "child", F.col("m").alias("n")).distinct())
        hit = step.where(F.col("n") == F.col("child")).select("parent", "child")
        found.append(hit)
        # an edge once found redundant needs no longer paths
        front = step.join(hit, ["parent", "child"], "left_anti")
        edges += 1
    return reduce(DataFrame.unionByName, found).distinct()


def _redundant(edges: DataFrame, ws: Workspace, max_edges: int | None) -> DataFrame:
    """Edges with a detour, searched from the end of fewer edges, so that neither a hub's children nor a child's parents are squared."""
    e = ws.cut(edges.select("parent", "child").distinct())
    out = e.groupBy("parent").agg(F.count(F.lit(1)).alias("n_down"))
    into = e.groupBy("child").agg(F.count(F.lit(1)).alias("n_up"))
    # a detour leaves its parent by another edge and enters its child by another
    asked = ws.cut(e.join(out.where("n_down > 1"), "parent").join(into.where("n_up > 1"), "child"))
    down = _detours(asked.where("n_down <= n_up").select("parent", "child"), e.select(F.col("parent").alias("n"), F.col("child").alias("m")), ws, max_edges)
    turned = asked.where("n_down > n_up").select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    up = _detours(turned, e.select(F.col("child").alias("n"), F.col("parent").alias("m")), ws, max_edges)
    return down.unionByName(up.select(F.col("child").alias("parent"), F.col("parent").alias("child")))


def bounded_redundant(edges: DataFrame, ws: Workspace, max_edges: int = 5) -> DataFrame:
    """Edges with another path of 2 to ``max_edges`` edges between their ends that avoids the edge."""
    return _redundant(edges, ws, max_edges)


def transitive_redundant(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Edges whose child is also reached through another child of the parent; for graphs without cycles."""
    return _redundant(edges, ws, None)


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that are not among ``gone``."""
    return edges.join(gone.select("parent", "child"), ["parent", "child"], "left_anti")


def roots_of(edges: DataFrame) -> DataFrame:
    """Parents that are nobody's child."""
    return edges.select(F.col("parent").alias("id")).distinct().join(edges.select(F.col("child").alias("id")), "id", "left_anti")


def depths(edges: DataFrame, ws: Workspace, seeds: DataFrame | None = None) -> DataFrame:
    """``id``, ``depth``: least number of edges from a root (or from ``seeds``); unreached nodes are absent."""
    e = ws.cut(edges.select("parent", "child").distinct())
    front = ws.cut((seeds if seeds is not None else roots_of(e)).select("id").distinct())
    done = [front.withColumn("depth", F.lit(0))]
    while True:
        seen = reduce(DataFrame.unionByName, done).select("id")
        reached = front.join(e.withColumnRenamed("parent", "id"), "id").select(F.col("child").alias("id")).distinct()
        front = ws.cut(reached.join(seen, "id", "left_anti"))
        if not front.take(1):
            return reduce(DataFrame.unionByName, done)
        done.append(front.withColumn("depth", F.lit(len(done))))


def root_distances(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``root``, ``id``, ``depth``: least number of edges from each root to each node below it."""
    e = ws.cut(edges.select("parent", "child").distinct())
    front = ws.cut(roots_of(e).select(F.col("id").alias("root"), "id"))
    done = [front.withColumn("depth", F.lit(0))]
    while True:
        seen = reduce(DataFrame.unionByName, done).select("root", "id")
        reached = front.join(e.withColumnRenamed("parent", "id"), "id").select("root", F.col("child").alias("id")).distinct()
        front = ws.cut(reached.join(seen, ["root", "id"], "left_anti"))
        if not front.take(1):
            return reduce(DataFrame.unionByName, done)
        done.append(front.withColumn("depth", F.lit(len(done))))


def longest_levels(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``id``, ``level``: most nodes on a path from a root, the node included.

    Each round takes off the nodes whose parents are all gone, with their
    edges, so every edge is taken off once; edges that stay for ever are an
    error, for they lie on or under a cycle.
    """
    e = ws.cut(edges.select("parent", "child").distinct())
    front = ws.cut(roots_of(e).select("id"))
    rounds = [front.withColumn("level", F.lit(1))]
    while True:
        rest = ws.cut(e.join(front.withColumnRenamed("id", "parent"), "parent", "left_anti"))
        freed = e.join(front.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        front = ws.cut(freed.join(rest.select(F.col("child").alias("id")), "id", "left_anti"))
        if not front.take(1):
            if rest.take(1):
                raise ValueError("no end of paths: the graph has a cycle")
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(front.withColumn("level", F.lit(len(rounds) + 1)))
        ws.drop(e)
        e = rest


def cyclic_core(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Edges left when nodes without parents and nodes without children are peeled off again and again."""
    e = ws.cut(edges.select("parent", "child").distinct())
    n = e.count()
    while n:
        kids, pars = e.select(F.col("child").alias("parent")).distinct(), e.select(F.col("parent").alias("child")).distinct()
        e = ws.cut(e.join(kids, "parent", "left_semi").join(pars, "child", "left_semi").select("parent", "child"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


def component_labels(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``id``, ``label``: the lowest id of each weakly connected component, by label propagation with jumps."""
    both = edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))).distinct()
    both = ws.cut(both)
    lab = ws.cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(lab.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = lab.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        # jump: take the label of one's label
        up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = ws.cut(step.join(up, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "was"))
        changed = new.where(F.col("label") != F.col("was")).take(1)
        lab = new.select("id", "label")
        if not changed:
            return lab


def weakest_edges(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``parent``, ``child``: the edge of lowest ``confidence`` of every elementary cycle, ties by parent and child.

    An edge is the weakest of some cycle if its child reaches its parent again
    by stronger edges alone.  Only edges of the cyclic core are asked, each
    with a frontier of its own that keeps every node once.
    """
    strength = F.col("confidence") if "confidence" in edges.columns else F.lit(0.5)
    e = edges.select("parent", "child", F.coalesce(strength, F.lit(0.5)).alias("confidence")).groupBy("parent", "child").agg(F.max("confidence").alias("confidence"))
    core = ws.cut(ws.cut(e).join(cyclic_core(e, ws), ["parent", "child"], "left_semi"))
    hop = core.select(F.col("parent").alias("n"), F.struct("confidence", "parent", "child").alias("hop"))
    front = ws.cut(core.select("parent", "child", F.struct("confidence", "parent", "child").alias("own"), F.col("child").alias("n")))
    seen, found = [front.select("own", "n")], [front.where(F.col("n") == F.col("parent")).select("parent", "child")]
    while front.take(1):
        step = front.where(F.col("n") != F.col("parent")).join(hop, "n").where(F.col("hop") > F.col("own"))
        step = step.select("parent", "child", "own", F.col("hop.child").alias("n")).distinct()
        step = ws.cut(step.join(reduce(DataFrame.unionByName, seen), ["own", "n"], "left_anti").select("parent", "child", "own", "n"))
        hit = step.where(F.col("n") == F.col("parent")).select("parent", "child")
        found.append(hit)
        seen.append(step.select("own", "n"))
        front = step.join(hit, ["parent", "child"], "left_anti")
    return reduce(DataFrame.unionByName, found).distinct()


def break_cycles(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Edges without cycles, and the edges removed: the weakest of every elementary cycle, so that none is left."""
    e = ws.cut(edges)
    gone = ws.cut(weakest_edges(e, ws))
    return without(e, gone), gone
