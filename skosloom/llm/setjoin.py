"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Records branch on tokens they hold: a node of the tree is a path of chosen
tokens, and a record goes to the node of each token it chooses.  Small nodes
are brute-forced; large ones branch again.  Every pair is verified exactly.

How a record chooses depends on the target recall.

* Under 1, trees are repeated: in each, all records share a random order of the
  tokens and every record chooses its first.  A pair of similarity ``t`` meets
  in one tree with probability ``t`` or more, so ``log(1 - recall) / log(1 - t)``
  trees reach the target; a large node branches into as many trees again.
* At 1 a single tree is enough: in one shared random order (draws within classes
  of like frequency, rare first) each record chooses so many tokens that two
  records which must share ``o`` tokens meet for certain, the first
  ``size - o + 1`` of each.  Random repeats lose no pair only with probability,
  and need more rows: recall 0.999 takes 8 rows a record and tree level at
  ``t`` = 0.6, the certain choice about two for sets of four.

In the certain tree a large node is first divided by the sizes of the partners,
in bands of an eighth, so that ``o`` is near exact; a pair is reported only at
the path of its first shared tokens, so it comes once.  A branch ends where the
path holds all tokens a pair must share.

Equal sets are one record of the tree; their copies are joined on at the end
(``similar_rows``), or left as members of their class (``similar_classes``).

Defined results: null tokens and records without a word are in no pair;
repeated words count once; ids must be unique (a repeated id pairs with others
but not with itself).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.plans.skew import lookup
from skosloom.plans.workspace import Workspace

#: Nodes of at most so many pairs are brute-forced.
SMALL_PAIRS = 4096


def _must_share(sizes: Column, t: float) -> Column:
    """Tokens that two sets of together ``sizes`` tokens share at least, if their Jaccard similarity is ``t`` or more."""
    return F.ceil(F.lit(t / (1 + t)) * sizes - 1e-9).cast("int")


def _band(m: Column) -> Column:
    """Number of a size's band: sizes under 16 alone, then bands of an eighth."""
    return F.when(m < 16, m).otherwise(F.floor(F.log(m.cast("double") + 1e-9) / math.log(1.125)) - 7).cast("int")


def _least(band: Column) -> Column:
    """Lowest size of a band, or less."""
    return F.when(band < 16, band).otherwise(F.floor(F.pow(F.lit(1.125), band + 7) - 1e-6)).cast("int")


def _ordered(sets: DataFrame, seed: int) -> DataFrame:
    """``sid``, ``toks`` in the shared random order, ``met``: whether another set has the token too."""
    words = sets.select("sid", F.explode(F.split("key", " ")).alias("word"))
    freq = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    hot = freq.orderBy(F.desc("freq"), "word").limit(1024).select("word")
    known = lookup(words, freq, "word", ["freq"], hot=hot)
    place = F.struct(F.floor(F.log2("freq")).cast("int").alias("cls"), F.xxhash64(F.lit(seed), F.col("word")).alias("draw"), F.col("word"), F.col("freq"))
    lists = known.groupBy("sid").agg(F.array_sort(F.collect_list(place)).alias("l"))
    return lists.select("sid", F.transform("l", lambda x: x["word"]).alias("toks"), F.transform("l", lambda x: x["freq"] > 1).alias("met"))


def _first_nodes(x: DataFrame, t: float) -> DataFrame:
    """The nodes of the first level: one row per record and chosen token, for partners of any size."""
    m = F.size("toks")
    need = _must_share(m + F.ceil(m * t - 1e-9), t)
    x = x.select("sid", "toks", "met", need.alias("o"), F.explode(F.sequence(F.lit(0), m - need)).alias("pos")).where(F.expr("met[pos]"))
    return x.select(F.xxhash64(F.expr("toks[pos]")).alias("node"), F.lit(2).alias("side"), "sid", "toks", "met", "pos", (F.col("o") - 1).alias("need"), F.lit(1).alias("depth"))


def _by_size(rows: DataFrame, t: float) -> DataFrame:
    """Rows of large nodes of the first level, divided by the bands of both partners' sizes."""
    m = F.size("toks")
    bands = F.sequence(_band(F.ceil(m * t - 1e-9)), _band(F.floor(m / t + 1e-9)))
    x = rows.withColumn("own", _band(m)).withColumn("s", F.explode(bands)).withColumn("lo", F.least("own", "s")).withColumn("hi", F.greatest("own", "s"))
    x = x.withColumn("o", F.greatest(F.lit(1), _must_share(_least(F.col("lo")) + _least(F.col("hi")), t))).where(F.col("pos") <= m - F.col("o"))
    side = F.when(F.col("lo") == F.col("hi"), 2).when(F.col("own") == F.col("lo"), 0).otherwise(1)
    return x.select(F.xxhash64("node", "lo", "hi").alias("node"), side.alias("side"), "sid", "toks", "met", "pos", (F.col("o") - 1).alias("need"), "depth")


def _branch(rows: DataFrame) -> DataFrame:
    """Rows of large nodes on the nodes below: each record chooses among its tokens after the path."""
    last = F.size("toks") - F.col("need")
    below = rows.where(F.col("pos") + 1 <= last).withColumn("pos", F.explode(F.sequence(F.col("pos") + 1, last))).where(F.expr("met[pos]"))
    return below.select(F.xxhash64("node", F.expr("toks[pos]")).alias("node"), "side", "sid", "toks", "met", "pos", (F.col("need") - 1).alias("need"), (F.col("depth") + 1).alias("depth"))


def _brute(rows: DataFrame, t: float, once: bool) -> DataFrame:
    """Verified pairs of the records of each node; ``once`` reports a pair only at the path of its first shared tokens."""
    a = rows.where(F.col("side") != 1).select("node", "side", "depth", F.col("sid").alias("sa"), F.col("toks").alias("ta"), F.col("pos").alias("pa"))
    b = rows.where(F.col("side") != 0).select("node", F.col("sid").alias("sb"), F.col("toks").alias("tb"), F.col("pos").alias("pb"))
    pairs = a.join(b, "node").where((F.col("sa") < F.col("sb")) | ((F.col("side") == 0) & (F.col("sa") != F.col("sb"))))
    m, n = F.size("ta"), F.size("tb")
    shared = F.size(F.array_intersect("ta", "tb"))
    similar = (F.least(m, n) >= F.greatest(m, n) * F.lit(t) - 1e-9) & (shared / (m + n - shared) >= F.lit(t))
    if once:
        similar &= F.size(F.array_intersect(F.slice("ta", 1, F.col("pa") + 1), F.slice("tb", 1, F.col("pb") + 1))) == F.col("depth")
    return pairs.where(similar).select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb"))


def _split(rows: DataFrame, ws: Workspace, small_pairs: int) -> DataFrame:
    """``node``, ``large`` of the nodes with any pair."""
    n = [F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1, 2)]
    nodes = rows.groupBy("node").agg(*n, F.max("need").alias("need"))
    pairs = F.col("n0") * F.col("n1") + F.col("n2") * (F.col("n2") - 1) / 2
    return ws.cut(nodes.where(pairs > 0).select("node", ((pairs > small_pairs) & (F.col("need") > 0)).alias("large")))


def _certain(sets: DataFrame, t: float, ws: Workspace, seed: int, small_pairs: int) -> DataFrame:
    rows = ws.cut(_first_nodes(_ordered(sets, seed), t))
    found = []
    divided = False
    while True:
        nodes = _split(rows, ws, small_pairs)
        found.append(ws.cut(_brute(rows.join(nodes.where(~F.col("large")), "node", "left_semi"), t, True)))
        if not nodes.where("large").take(1):
            return reduce(DataFrame.unionByName, found)
        large = rows.join(nodes.where("large"), "node", "left_semi")
        below = ws.cut(_branch(large) if divided else _by_size(large, t))
        ws.drop(nodes)
        ws.drop(rows)
        rows, divided = below, True


def _tree(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """Every record's first token after its path, in ``trees`` random orders; a record without one stays at its node."""
    tried = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    left = F.array_except("toks", "path")
    draw = F.array_min(F.transform(left, lambda x: F.struct(F.xxhash64(F.lit(seed), F.col("node"), F.col("tree"), x).alias("r"), x.alias("x"))))["x"]
    tried = tried.withColumn("x", draw).where(F.col("x").isNotNull())
    return tried.select(F.xxhash64("node", "tree", "x").alias("node"), F.lit(2).alias("side"), "sid", "toks", F.concat("path", F.array("x")).alias("path"), F.lit(0).alias("pos"), (F.size("toks") - F.size("path") - 1).alias("need"), (F.col("depth") + 1).alias("depth"))


def _repeated(sets: DataFrame, t: float, ws: Workspace, seed: int, small_pairs: int, recall: float) -> DataFrame:
    trees = max(1, math.ceil(math.log(1 - recall) / math.log(1 - t)))
    start = sets.select("sid", F.split("key", " ").alias("toks"), F.array().cast("array<string>").alias("path"), F.lit(0).cast("bigint").alias("node"), F.lit(0).alias("depth"))
    rows = ws.cut(_tree(start, trees, seed))
    found = []
    while True:
        nodes = _split(rows, ws, small_pairs)
        found.append(ws.cut(_brute(rows.join(nodes.where(~F.col("large")), "node", "left_semi"), t, False)))
        if not nodes.where("large").take(1):
            return reduce(DataFrame.unionByName, found).distinct()
        large = ws.cut(rows.join(nodes.where("large"), "node", "left_semi"))
        # records that the path holds whole cannot branch: they meet all others of their node here
        whole = large.where(F.col("need") == 0).withColumn("side", F.lit(0))
        found.append(ws.cut(_brute(whole.unionByName(large.withColumn("side", F.lit(1))), t, False)))
        rows = ws.cut(_tree(large, trees, seed + len(found)))


def similar_sets(sets: DataFrame, t: float, ws: Workspace, seed: int = 7, small_pairs: int = SMALL_PAIRS, recall: float = 1.0) -> DataFrame:
    """``sa`` < ``sb``: pairs of different sets (``sid``, ``key``: sorted words joined by blanks) alike enough, all of them at ``recall`` 1."""
    return _certain(sets, t, ws, seed, small_pairs) if recall >= 1 else _repeated(sets, t, ws, seed, small_pairs, recall)


def _classes(df: DataFrame, id_col: str, words: Column, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """``row_id``, ``key`` of every row with a word, and ``sid`` (its lowest row), ``key``, ``n`` of every distinct set."""
    rows = ws.cut(df.select(F.col(id_col).alias("row_id"), F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("key")).where(F.col("key") != ""))
    return rows, ws.cut(rows.groupBy("key").agg(F.min("row_id").alias("sid"), F.count(F.lit(1)).alias("n")))


def similar_classes(df: DataFrame, id_col: str, words: Column, t: float = 0.6, ws: Workspace | None = None, recall: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of equal sets (``sid_a``, ``sid_b``) and membership (``row_id``, ``sid``): whole, without all pairs of copies."""
    ws = ws or Workspace(df.sparkSession, "setclasses")
    rows, sets = _classes(df, id_col, words, ws)
    hot = sets.where(F.col("n") > 1).orderBy(F.desc("n"), "sid").limit(1024).select("key")
    members = lookup(rows, sets, "key", ["sid"], hot=hot).select("row_id", "sid")
    return similar_sets(sets, t, ws, recall=recall).select(F.col("sa").alias("sid_a"), F.col("sb").alias("sid_b")), members


def similar_rows(df: DataFrame, id_col: str, words: Column, t: float = 0.6, ws: Workspace | None = None) -> DataFrame:
    """``row_id_a`` < ``row_id_b``: all pairs of rows whose sets of ``words`` have Jaccard similarity ``t`` or more, copies included."""
    ws = ws or Workspace(df.sparkSession, "setjoin")
    rows, sets = _classes(df, id_col, words, ws)
    alike = similar_sets(sets, t, ws)
    hot = sets.where(F.col("n") > 1).orderBy(F.desc("n"), "sid").limit(1024).select("key")
    members = ws.cut(lookup(rows, sets, "key", ["sid", "n"], hot=hot).select("row_id", "sid", "n"))
    a = members.select(F.col("sid").alias("sa"), F.col("row_id").alias("a"))
    b = members.select(F.col("sid").alias("sb"), F.col("row_id").alias("b"))
    across = alike.join(a, "sa").join(b, "sb").select("a", "b")
    several = members.where(F.col("n") > 1).select("sid", "row_id")
    within = several.withColumnRenamed("row_id", "a").join(several.withColumnRenamed("row_id", "b"), "sid").where(F.col("a") < F.col("b")).select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))
