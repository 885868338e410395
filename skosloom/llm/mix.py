"""Mixing sources to target weights by Pareto order sampling.

The total of the mix is the largest one for which every listed source that has
documents can give its share within its repeats (or ``total``, where given, of
which each source gives as much of its share as it can).  A source's part is
first served with certain whole copies of all its documents; of the rest, each
document gets an inclusion probability proportional to its size (1 at most),
so that the expected size is what is missing.  Documents are ranked by random
odds divided by inclusion odds (Pareto order sampling: a fixed-size sample with
unequal probabilities) and taken in that order until the size is reached.

The cut in the order is found by a histogram of the rank over all documents of
a source, so that no task sorts a whole source: only the documents of the one
bin that holds the cut are ordered exactly.

Defined results: sources compare trimmed and in lower case; documents of other
or no source, and documents without tokens, stay out; a source whose weight is
not positive or whose repeats are under 1 gives nothing; draws depend on the
document id and the seed alone, so a repeated row draws alike and is kept or
dropped with its copies; an empty table gives an empty mix with reached shares 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skosloom.llm.encode import shared_model, token_count
from skosloom.plans.workspace import Workspace

BINS = 4096


def source_name(c: Column) -> Column:
    """Trimmed (any white space) and lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def allocate(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source: size, ``want`` (tokens of the mix), ``whole`` (copies of every document) and ``rest`` (tokens still missing).

    ``sizes``: ``source``, ``tokens``, ``docs``; ``targets`` has one row per listed source.
    """
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(sizes, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "docs": F.coalesce("docs", F.lit(0))})
    able = (F.col("tokens") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") >= 1)
    supply = F.col("tokens") * F.col("max_repeats")
    everywhere = Window.partitionBy(F.lit(1))  # one row per listed source
    reach = F.min(F.when(able, supply / F.col("weight"))).over(everywhere) if total is None else F.lit(float(total))
    t = t.withColumn("want", F.when(able, F.least(F.floor(F.col("weight") * reach + 1e-6), supply)).otherwise(0).cast("bigint"))
    t = t.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("want") / F.col("tokens"))).otherwise(0).cast("int"))
    return t.withColumn("rest", F.col("want") - F.col("whole") * F.col("tokens"))


def _inclusion(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``source``, ``factor``: inclusion probability is ``least(1, factor * tokens)``, with expected size ``rest``.

    Solved over the distinct sizes of each source, largest first: those above a
    threshold are certain, the others share what is left by size.
    """
    by_size = docs.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(plan.select("source", "rest")), "source")
    down = Window.partitionBy("source").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy(F.desc("tokens")).rowsBetween(0, Window.unboundedFollowing)
    above = F.coalesce(F.sum(F.col("n") * F.col("tokens")).over(down), F.lit(0)).cast("double")
    squares = F.sum(F.col("n") * F.col("tokens").cast("double") * F.col("tokens")).over(up)
    tried = by_size.withColumn("factor", (F.col("rest") - above) / squares)
    fits = (F.col("factor") >= 0) & (F.col("factor") * F.col("tokens") <= 1 + 1e-12)
    return tried.groupBy("source").agg(F.coalesce(F.max_by(F.when(fits, F.col("factor")), F.when(fits, F.col("tokens"))), F.lit(0.0)).alias("factor"))


def pareto_rank(doc_id: Column, probability: Column, seed: int) -> Column:
    """Random odds divided by inclusion odds, mapped to 0..1; certain documents come first (0)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    q = (u / (1 - u)) / (probability / (1 - probability))
    return F.when(probability >= 1, 0.0).when(probability <= 0, 1.0).otherwise(q / (1 + q))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, tokenizer: str = "byte_bpe_50k", ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (``doc_id``, ``source``, ``tokens``, ``copies``) and its report, one row per listed source."""
    spark = documents.sparkSession
    ws = ws or Workspace(spark, "mix")
    names = F.broadcast(targets.select(source_name(F.col("source")).alias("source")).distinct())
    listed = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").join(names, "source", "left_semi")
    docs = ws.cut(listed.select("doc_id", "source", token_count(F.col("text"), shared_model(spark, tokenizer)).alias("tokens")))
    docs = docs.where(F.col("tokens") > 0)
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = ws.cut(allocate(sizes, targets, total))
    plan = ws.cut(plan.join(_inclusion(docs, plan), "source", "left"))
    ranked = docs.join(F.broadcast(plan.select("source", "whole", "rest", "factor")), "source")
    ranked = ranked.withColumn("rank", pareto_rank(F.col("doc_id"), F.least(F.lit(1.0), F.coalesce("factor", F.lit(0.0)) * F.col("tokens")), seed))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") * BINS))
    # the bin of each source in which the missing size is reached: at most BINS + 1 rows per source
    hist = ranked.groupBy("source", "bin").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = hist.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    marked = ranked.join(F.broadcast(cuts.select("source", F.col("bin").alias("cut"), "before")), "source", "left")
    inside = marked.where(F.col("bin") == F.col("cut"))
    run = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0))
    # a document that crosses the mark is taken if that comes nearer to it
    edge = inside.withColumn("extra", (so_far + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    outer = marked.where(F.col("cut").isNull() | (F.col("bin") != F.col("cut"))).withColumn("extra", F.coalesce((F.col("bin") < F.col("cut")).cast("int"), F.lit(0)))
    cols = ["doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    chosen = ws.cut(outer.select(*cols).unionByName(edge.select(*cols)).where(F.col("copies") > 0))
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.count(F.lit(1)).alias("used"), F.max("copies").alias("most_copies"))
    report = plan.join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    share = F.col("got") / F.nullif(F.sum("got").over(Window.partitionBy(F.lit(1))), F.lit(0))
    report = report.select(
        "source", F.col("weight").alias("target_share"), F.coalesce(share, F.lit(0.0)).alias("actual_share"), F.col("got").alias("mix_tokens"), F.col("want").alias("wanted_tokens"),
        F.col("tokens").alias("source_tokens"), F.col("docs").alias("source_docs"), F.coalesce("used", F.lit(0)).alias("used_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
    return chosen, report
