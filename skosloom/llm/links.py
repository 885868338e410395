"""Child and parent of a proposed link, named by URI, by label, or by label key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.functions.labels import label_key, node_names
from skosloom.plans.skew import HOT_KEYS, lookup
from skosloom.plans.workspace import Workspace

ENDS = ["child_uri", "child_key", "parent_uri", "parent_key"]


def usable_confidence(c: Column) -> Column:
    """Neither null nor NaN, and from 0 to 1."""
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)


def with_end_keys(relations: DataFrame) -> DataFrame:
    """``relations`` with ``child_key`` and ``parent_key``: label keys, only where the URI is null."""
    return relations.withColumns({f"{e}_key": F.when(F.col(f"{e}_uri").isNull(), label_key(F.col(e))) for e in ("child", "parent")})


def resolve_ends(grouped: DataFrame, nodes: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``c`` and ``p`` in place of ``ENDS``.

    ``grouped`` should already be aggregated by ``ENDS``, so that a hot end has
    few rows left; ``ws`` keeps the names of nodes for both ends.  Rows with both URIs pass by; the others look their label
    keys up among the nodes' names, the most frequent keys by broadcast of at
    most ``HOT_KEYS`` rows.  A missing label has the empty key.
    """
    names = node_names(nodes) if ws is None else ws.cut(node_names(nodes))
    whole = grouped.where(F.col("child_uri").isNotNull() & F.col("parent_uri").isNotNull()).withColumn("c", F.col("child_uri")).withColumn("p", F.col("parent_uri"))
    part = grouped.where(F.col("child_uri").isNull() | F.col("parent_uri").isNull())
    keys = part.select(F.explode(F.array("child_key", "parent_key")).alias("label_key")).where(F.col("label_key") != "")
    hot = keys.groupBy("label_key").count().orderBy(F.desc("count"), "label_key").limit(HOT_KEYS).select("label_key")
    for end, name in (("child", "c"), ("parent", "p")):
        part = lookup(part, names.select(F.col("label_key").alias(f"{end}_key"), F.col("named_uri").alias(f"_{name}")), f"{end}_key", [f"_{name}"], hot=hot.withColumnRenamed("label_key", f"{end}_key"))
        part = part.withColumn(name, F.coalesce(f"{end}_uri", f"_{name}", f"{end}_key")).drop(f"_{name}")
    return whole.unionByName(part).drop(*ENDS)
