"""Parent–child links to full hierarchies by tree contraction.

Each round rakes all leaves and splices out an independent part of the nodes
in unary chains (about a third, by random draws), recording what it removed.  Rounds stop when no leaf is left: what remains then is cycles
only.  The records are replayed backwards, each removed node finding its
parent already resolved, which gives root, depth and path.

Defined results: a node without a parent is a root (depth 0); of several
parents of a node the one of lowest id is taken (``other_parents`` gives the
links left out for that); links to ids that are no node,
null links and repeated links are ignored; a node that is its own parent is a
cycle; nodes on or under a cycle have empty ``root`` and ``path`` and depth -1.
Cost: every round is a fixed number of joins over what is still live, and that
shrinks by a constant factor, so all rounds together cost about as much as the
first few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skosloom.functions.labels import label_key, node_names
from skosloom.operators.packed import split_packed
from skosloom.plans.skew import HOT_KEYS, lookup
from skosloom.plans.workspace import Workspace

ARROW = " > "


def links(nodes: DataFrame, concepts: DataFrame, ws: Workspace) -> DataFrame:
    """``child``, ``parent``: all links written in nodes and concepts, between nodes.

    ``parents`` and ``children`` of nodes hold ids; ``skos:broader`` and
    ``skos:narrower`` of concepts hold packed labels, each naming the one node
    with its label key.
    """
    none = F.array().cast("array<string>")
    up = F.transform(F.coalesce(F.col("parents"), none), lambda x: F.struct(F.col("uri").alias("child"), x.alias("parent")))
    down = F.transform(F.coalesce(F.col("children"), none), lambda x: F.struct(x.alias("child"), F.col("uri").alias("parent")))
    by_id = nodes.select(F.explode(F.concat(up, down)).alias("e")).select("e.child", "e.parent")
    # a row whose URI names no node can give no link: leave it out before its fields are split
    known = nodes.select(F.col("uri").alias("URI")).where(F.col("URI").isNotNull()).distinct()
    told = concepts.select("URI", "`skos:broader`", "`skos:narrower`").join(known, "URI", "left_semi")
    vals = split_packed(told, ["skos:broader", "skos:narrower"], ["URI"], ws=ws)
    vals = ws.cut(vals.select("URI", "field", label_key(F.col("val")).alias("label_key")))
    named = lookup(vals, ws.cut(node_names(nodes)), "label_key", ["named_uri"]).where(F.col("named_uri").isNotNull())
    broader = F.col("field") == "skos:broader"
    by_label = named.select(F.when(broader, F.col("URI")).otherwise(F.col("named_uri")).alias("child"), F.when(broader, F.col("named_uri")).otherwise(F.col("URI")).alias("parent"))
    return by_id.unionByName(by_label).where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()


def _draw(c, r: int):
    return F.xxhash64(c, F.lit(r))


def _contract(live: DataFrame, r: int) -> DataFrame:
    """One round over live links ``c``, ``p``, ``via``, ``hops``; ``kind`` tells what became of each.

    A node with one child leaves its chain if its draw is below those of its
    parent and its child, so no two neighbours leave together.  Its child takes
    over its link.  Nodes without children are leaves; a leaf below a leaving
    node is raked from that node's parent.
    """
    kids = live.groupBy(F.col("p").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("only"))
    seen = live.join(kids, "c", "left")
    leaving = (F.col("n") == 1) & (_draw(F.col("c"), r) < _draw(F.col("p"), r)) & (_draw(F.col("c"), r) < _draw(F.col("only"), r))
    seen = seen.withColumn("leaves", F.coalesce(leaving, F.lit(False)))
    gone = seen.where("leaves")
    over = gone.select(F.col("only").alias("c"), F.col("c").alias("v"), F.col("p").alias("v_p"), F.col("via").alias("v_via"), F.col("hops").alias("v_hops"))
    moved = F.col("v").isNotNull()
    stay = seen.where(~F.col("leaves")).join(over, "c", "left").select(
        "c",
        F.when(moved, F.col("v_p")).otherwise(F.col("p")).alias("p"),
        F.when(moved, F.concat("v_via", F.array("v"), "via")).otherwise(F.col("via")).alias("via"),
        F.when(moved, F.col("v_hops") + F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
        F.when(F.col("n").isNull(), "leaf").otherwise("live").alias("kind"),
    )
    return stay.unionByName(gone.select("c", "p", "via", "hops", F.lit("spliced").alias("kind")))


def resolve_forest(ids: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """``node``, ``root``, ``depth``, ``path``, ``state`` of each distinct non-null ``ids.node``."""
    nodes = ws.cut(ids.select("node").where(F.col("node").isNotNull()).distinct())
    edges = ws.cut(edges.select("child", "parent"))
    known = lookup(edges, nodes.select(F.col("node").alias("parent"), F.lit(True).alias("ok")), "parent", ["ok"]).where("ok")
    live = known.groupBy(F.col("child").alias("c")).agg(F.min("parent").alias("p")).join(nodes.withColumnRenamed("node", "c"), "c", "left_semi")
    first = live = ws.cut(live.select("c", "p", F.array().cast("array<string>").alias("via"), F.lit(0).alias("hops")))
    # the nodes of most children stay the busiest parents in every round
    hot = ws.cut(first.groupBy(F.col("p").alias("parent")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "parent").limit(HOT_KEYS).select("parent"))
    records: list[tuple[DataFrame, int]] = []
    while True:
        out = ws.cut(_contract(live, len(records)))
        live = out.where(F.col("kind") == "live").drop("kind")
        counts = {x["kind"]: x["count"] for x in out.groupBy("kind").count().collect()}
        record = out.where(F.col("kind") != "live").select(F.col("c").alias("node"), F.col("p").alias("parent"), "via", "hops")
        records.append((record, counts.get("leaf", 0) + counts.get("spliced", 0)))
        if not counts.get("leaf"):
            break

    # without leaves every link left is on a cycle, and its text names the nodes spliced out of that cycle
    on_cycle = live.select(F.explode(F.concat("via", F.array("c"))).alias("node")).distinct()
    on_cycle = ws.cut(on_cycle.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path"), F.lit("cycle").alias("state")))
    roots = nodes.join(first.select(F.col("c").alias("node")), "node", "left_anti")
    roots = ws.cut(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit("tree").alias("state")))
    done = [on_cycle, roots]
    tree = F.col("state") == "tree"
    for record, n in reversed(records):
        if not n:
            continue
        solved = ws.together(done).withColumnRenamed("node", "parent")
        record = record.join(on_cycle.select("node"), "node", "left_anti")
        found = lookup(record, solved, "parent", ["root", "depth", "path", "state"], hot=hot)
        done.append(
            ws.cut(
                found.select(
                    "node",
                    F.when(tree, F.col("root")).otherwise("").alias("root"),
                    F.when(tree, F.col("depth") + F.col("hops") + 1).otherwise(-1).alias("depth"),
                    F.when(tree, F.concat("path", "via", F.array("node"))).otherwise(F.array().cast("array<string>")).alias("path"),
                    F.when(tree, F.lit("tree")).otherwise("below_cycle").alias("state"),
                )
            )
        )
    return ws.together(done)


def other_parents(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``child``, ``parent``: links between nodes that a forest leaves out, because the child has a parent of lower id."""
    nodes = ids.select(F.col("node").alias("id")).where(F.col("id").isNotNull()).distinct()
    known = edges.select("child", "parent").distinct()
    known = known.join(nodes, known.child == nodes.id, "left_semi").join(nodes, F.col("parent") == nodes.id, "left_semi")
    taken = known.groupBy("child").agg(F.min("parent").alias("parent"))
    return known.join(taken, ["child", "parent"], "left_anti")


def resolved(nodes: DataFrame, concepts: DataFrame, ws: Workspace) -> DataFrame:
    """The forest of all nodes by all written links."""
    return resolve_forest(nodes.select(F.col("uri").alias("node")), links(nodes, concepts, ws), ws)


def hierarchy(nodes: DataFrame, concepts: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``uri``, ``root_uri``, ``depth``, ``path``, ``state``: one row per distinct ``nodes.uri``."""
    solved = resolved(nodes, concepts, ws or Workspace(nodes.sparkSession, "forest"))
    return solved.select(F.col("node").alias("uri"), F.col("root").alias("root_uri"), "depth", F.array_join("path", ARROW).alias("path"), "state")


def descendants(solved: DataFrame) -> DataFrame:
    """``uri``, ``descendant``, ``distance``: all pairs of a tree node and a node below it, from the paths."""
    steps = solved.where(F.col("state") == "tree").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "uri"))
    return steps.where(F.col("at") < F.col("depth")).select("uri", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(solved: DataFrame) -> DataFrame:
    """``uri``, ``n_descendants``, ``height``: for every tree node, leaves with 0; aggregated before the shuffle."""
    tree = solved.where(F.col("state") == "tree")
    below = tree.select("depth", F.posexplode("path").alias("at", "uri"))
    return below.groupBy("uri").agg((F.count(F.lit(1)) - 1).alias("n_descendants"), F.max(F.col("depth") - F.col("at")).cast("int").alias("height"))
