"""Top N items within every group, by descending bands of the score.

The items are written once, partitioned by bands of the score whose bounds are
quantiles of it.  Bands are read from the top.  In each, Spark keeps the first
N rows of a group and task in a total order (score descending, then id
ascending) before the rows are shuffled by group, so no task gets a whole hot
group, in the lower bands neither; groups filled by higher bands are then taken
out by an anti-join, and those that a band fills in part take its best rows.

Defined results: equal scores share a band, so ties are broken by id alone;
null and NaN scores take no place; a null group is no group; a repeated row
(same group, score and id) takes as many places as it has copies; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skosloom.llm.links import ENDS, resolve_ends, usable_confidence, with_end_keys
from skosloom.plans.workspace import Workspace

#: Shares of the items below the lower bound of each band but the last, from the top.
BANDS = (0.75, 0.5, 0.25)


def top_n(items: DataFrame, group: str, score: str, tie: str, n: int, ws: Workspace, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """``group``, ``place``, ``tie``, ``score`` of the first ``n`` items of every group."""
    ranked = items.select(group, score, tie).where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    ranked = ws.cut(ranked)
    bounds = ranked.agg(F.percentile_approx(F.col(score), list(bands), 1000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds), reverse=True)
    band = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        band = F.when(F.col(score) >= F.lit(b), i).otherwise(band)
    banded = ws.cut(ranked.withColumn("band", band), partition_by=["band"])
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    kept: list[DataFrame] = []
    for i in range(len(bounds) + 1):
        # the limit is its own step below the join: a join between would keep Spark from limiting before the shuffle
        first = banded.where(F.col("band") == i).select(group, score, tie).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        if kept:
            taken = reduce(DataFrame.unionByName, kept).groupBy(group).agg(F.count(F.lit(1)).alias("taken"))
            first = first.join(taken.where(F.col("taken") >= n).select(group), group, "left_anti")
            first = first.join(taken, group, "left").withColumn("place", (F.col("place") + F.coalesce("taken", F.lit(0))).cast("int")).drop("taken").where(F.col("place") <= n)
        kept.append(ws.cut(first.select(group, "place", tie, score)))
    return reduce(DataFrame.unionByName, kept)


def top_parents(relations: DataFrame, nodes: DataFrame, n: int = 3, ws: Workspace | None = None) -> DataFrame:
    """``child_uri``, ``place``, ``seq``: the ``n`` best parents of each child.

    A parent stands for the row with its highest usable confidence, then lowest
    ``seq``; parents without one do not count.  A child with neither URI nor
    label is the child with the empty key.
    """
    ws = ws or Workspace(relations.sparkSession, "topbands")
    usable = relations.select("seq", "child", "child_uri", "parent", "parent_uri", "confidence").where(usable_confidence(F.col("confidence")))
    # -0.0 and 0.0 are one confidence
    best = F.min(F.struct((0.0 - F.col("confidence")).alias("k"), F.col("seq"))).alias("best")
    grouped = ws.cut(with_end_keys(usable).groupBy(*ENDS).agg(best))
    links = resolve_ends(grouped, nodes, ws).groupBy("c", "p").agg(F.min("best").alias("best"))
    items = links.select(F.col("c").alias("child_uri"), (0.0 - F.col("best.k")).alias("confidence"), F.col("best.seq").alias("seq"))
    return top_n(items, "child_uri", "confidence", "seq", n, ws).select("child_uri", "place", "seq")
