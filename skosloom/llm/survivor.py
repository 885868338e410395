"""Best representative of each duplicate group.

Two ways to choose, field by field, both in one pass of partial aggregates:

``survivors`` follows a given order of trust: detector rank, then latest date,
then lowest ``seq``; each field comes from the first row with a usable value.

``fuse`` is Bayesian fusion with copy detection: every distinct value of a
field is a claim by the sources that gave it; accuracies of sources and
the dependence between them are estimated in turns, dependence from the false
values two sources share; votes of likely copies are discounted; the value of
highest posterior survives.  The estimates need only how often each pattern
(which sources gave how many values) occurs; patterns are aggregated over all
groups once and stay with the executors.

Defined results: a group is two or more rows with the same child and parent; a
field without a usable value gives -1 (``survivors``) or null (``fuse``); ties
go to the lowest ``seq``; a group without any usable value gives no row in
``fuse``; repeated rows count as rows but vote once per source.
Every named source votes for itself, whatever their number; rows without a
source vote as one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.functions.labels import SPACE, char_class
from skosloom.llm.links import ENDS, resolve_ends, usable_confidence, with_end_keys
from skosloom.plans.skew import HOT_KEYS, lookup
from skosloom.plans.workspace import Workspace

FIELDS = ("child", "parent", "confidence", "source")


def detector_key(c: Column) -> Column:
    """Letters and digits of a detector's name, ignoring case; null if there are none."""
    key = F.lower(F.regexp_replace(c, f"[^{char_class('LN')}]+", ""))
    return F.when(key != "", key)


def trust_table(detectors: DataFrame) -> DataFrame:
    """``dkey``, ``trust``: one row per detector name (a fixed, small table)."""
    return detectors.select(detector_key(F.col("source")).alias("dkey"), "trust").where(F.col("dkey").isNotNull()).groupBy("dkey").agg(F.min("trust").alias("trust"))


def _not_blank(c: Column) -> Column:
    return c.isNotNull() & c.rlike(f"(?!{SPACE})[\\s\\S]")


def _rows(relations: DataFrame, detectors: DataFrame) -> DataFrame:
    """Relations with label keys, the detector's trust, and ``ok_*``: whether each field's value is usable."""
    known = relations.select("seq", "child", "child_uri", "parent", "parent_uri", "confidence", "source", "detected_at")
    rel = with_end_keys(known).withColumn("dkey", detector_key(F.col("source"))).join(F.broadcast(trust_table(detectors)), "dkey", "left")
    usable = {"child": _not_blank(F.col("child")), "parent": _not_blank(F.col("parent")), "confidence": usable_confidence(F.col("confidence")), "source": F.col("trust").isNotNull()}
    return rel.withColumns({f"ok_{f}": c for f, c in usable.items()})


def survivors(relations: DataFrame, nodes: DataFrame, detectors: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """``group_seq`` and, per field, the ``seq`` of the row whose value survives."""
    ws = ws or Workspace(relations.sparkSession, "survivor")
    # the greatest comes first; null dates are the least
    rank = F.struct((-F.coalesce(F.col("trust").cast("bigint"), F.lit(1 << 62))).alias("t"), F.col("detected_at").alias("d"), (-F.col("seq")).alias("s"))
    rows = _rows(relations, detectors).withColumn("r", rank)
    firsts = [F.max(F.when(F.col(f"ok_{f}"), F.col("r"))).alias(f"r_{f}") for f in FIELDS]
    grouped = ws.cut(rows.groupBy(*ENDS).agg(F.min("seq").alias("group_seq"), F.count(F.lit(1)).alias("n"), *firsts))
    groups = resolve_ends(grouped, nodes, ws).groupBy("c", "p").agg(F.min("group_seq").alias("group_seq"), F.sum("n").alias("n"), *[F.max(f"r_{f}").alias(f"r_{f}") for f in FIELDS])
    return groups.where(F.col("n") > 1).select("group_seq", *[F.coalesce(-F.col(f"r_{f}.s"), F.lit(-1)).cast("bigint").alias(f"{f}_seq") for f in FIELDS])


def _ends_key() -> Column:
    return F.to_json(F.struct(*ENDS))


def _claims(relations: DataFrame, nodes: DataFrame, detectors: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """``g`` (lowest ``seq`` of the group), ``field``, ``val``, ``votes`` (sorted numbers of sources), ``n``, ``seq``: distinct usable values of each group of two or more, and the number of sources."""
    rows = _rows(relations, detectors)
    # groups first, from aggregated rows: most links come once and end here
    ends = ws.cut(rows.groupBy(*ENDS).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")))
    named = ws.cut(resolve_ends(ends.withColumn("e", _ends_key()), nodes, ws))
    groups = named.groupBy("c", "p").agg(F.min("first").alias("g"), F.sum("n").alias("n")).where(F.col("n") > 1)
    known = ws.cut(named.select("c", "p", "e", F.col("n").alias("m")).join(groups.select("c", "p", "g"), ["c", "p"]).select("e", "g", "m"))
    hot = known.orderBy(F.desc("m"), "e").limit(HOT_KEYS).select("e")
    # sources are numbered by their names, the listed ones first; one number more for rows without
    names = rows.where(F.col("dkey").isNotNull()).groupBy("dkey").agg(F.min("trust").alias("t")).orderBy(F.asc_nulls_last("t"), "dkey")
    numbers = ws.cut(names.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("t", F.lit(1 << 30)).alias("t"), "dkey"))).alias("l")).select(F.posexplode("l").alias("s", "x")).select("s", "x.dkey"))
    sources = numbers.count() + 1
    vals = {"child": F.col("child"), "parent": F.col("parent"), "confidence": F.col("confidence").cast("string"), "source": F.col("dkey")}
    cells = [F.when(F.col(f"ok_{f}"), vals[f]).alias(f"v_{f}") for f in FIELDS]
    told = lookup(rows.select(_ends_key().alias("e"), "seq", "dkey", *cells), known, "e", ["g"], hot=hot).where(F.col("g").isNotNull())
    told = told.join(numbers, "dkey", "left").withColumn("s", F.coalesce("s", F.lit(sources - 1)))
    each = told.select("g", "seq", "s", F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(f"v_{f}").alias("val")) for i, f in enumerate(FIELDS)])).alias("x")).select("g", "seq", "s", "x.field", "x.val")
    votes = each.where(F.col("val").isNotNull()).groupBy("g", "field", "val").agg(F.sort_array(F.collect_set("s")).alias("votes"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    return ws.cut(votes), sources


def _independent(accuracy: list[float], copies: dict[tuple[int, int], float], copy_rate: float):
    """For a set of voting sources: each one's log-odds weight times the chance that it did not copy a better one."""
    rank = {s: i for i, s in enumerate(sorted(range(len(accuracy)), key=lambda s: (-accuracy[s], s)))}
    known: dict[tuple[int, ...], float] = {}

    def weight(votes: tuple[int, ...]) -> float:
        if votes not in known:
            total, before = 0.0, []
            for s in sorted(votes, key=rank.__getitem__):
                own = 1.0
                for b in before:
                    own *= 1 - copy_rate * copies.get((s, b), 0.0)
                total += own * math.log(10 * accuracy[s] / (1 - accuracy[s]))
                before.append(s)
            known[votes] = total
        return known[votes]

    return weight


Model = tuple[list[float], dict[tuple[int, int], float]]


def _sums(patterns: DataFrame, models: dict[int, Model], copy_rate: float) -> DataFrame:
    """Per ``field``: expected true (``a``) and false (``b``) values of each source (``s`` = ``t``) and shared by two, and how often two differ (``c``)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = {f: _independent(*m, copy_rate) for f, m in models.items()}
        total: dict[tuple[int, int, int], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for g in batches:
            for f, sets, ks, n in zip(g["field"], g["sets"], g["ks"], g["n"], strict=True):
                sets, ks = [tuple(int(x) for x in v) for v in sets], [int(k) for k in ks]
                own = [weights[f](v) for v in sets]
                top = max(own)
                odds = [math.exp(w - top) for w in own]
                whole = sum(k * o for k, o in zip(ks, odds, strict=True))
                voting = sorted({s for v in sets for s in v})
                for v, k, o in zip(sets, ks, odds, strict=True):
                    p, m, inside = o / whole, float(k * n), set(v)
                    for s in v:
                        for t in voting:
                            x = total[f, s, t]
                            if t in inside:
                                x[0] += p * m
                                x[1] += (1 - p) * m
                            else:
                                x[2] += m
        yield pd.DataFrame([(*k, *x) for k, x in total.items()], columns=["field", "s", "t", "a", "b", "c"])

    parts = patterns.mapInPandas(sums, "field int, s int, t int, a double, b double, c double")
    return parts.groupBy("field", "s", "t").agg(*[F.sum(x).alias(x) for x in "abc"])


def estimate(patterns: DataFrame, sources: int, rounds: int = 5, copy_rate: float = 0.8, prior: float = 0.1) -> dict[int, Model]:
    """Per field: accuracy of every source, and the chance that one copies another, from ``sets`` (sources of each value of a group), ``ks`` and ``n``.

    ``ks`` tells how many values each of the sets has, one if it is not given;
    without ``field`` all are of one.  Fields are apart, because sources that
    all copy a label may still differ in what they think of it.  Patterns stay
    with the executors: a round sends the driver a few sums for each pair of
    sources that meet in a group.  The first round looks for copies only:
    values weighed without knowing the copies would make a source and its
    copies look right.
    """
    ks = F.col("ks") if "ks" in patterns.columns else F.array_repeat(F.lit(1).cast("bigint"), F.size("sets"))
    field = F.col("field").cast("int") if "field" in patterns.columns else F.lit(0)
    told = patterns.select(field.alias("field"), "sets", ks.alias("ks"), "n")
    models: dict[int, Model] = {f: ([0.8] * sources, {}) for f in range(len(FIELDS))}
    for i in range(rounds):
        true = {f: [1.0] * sources for f in models}
        claims = {f: [1.25] * sources for f in models}
        met: dict[tuple[int, int, int], tuple[float, float, float]] = {}
        for r in _sums(told, models, copy_rate).collect():
            f, s, t = r["field"], r["s"], r["t"]
            if s == t:
                true[f][s] += r["a"]
                claims[f][s] += r["a"] + r["b"]
            else:
                met[f, s, t] = r["a"], r["b"], r["c"]
        for f, (accuracy, _) in models.items():
            if i:
                accuracy = [min(0.99, max(0.05, true[f][s] / claims[f][s])) for s in range(sources)]
            models[f] = (accuracy, {})
        for (f, s, t), (both_true, both_false, differ) in met.items():
            a, b = models[f][0][s], models[f][0][t]
            same, wrong = a * b, (1 - a) * (1 - b) / 10
            other = max(1e-6, 1 - same - wrong)
            log_odds = (
                both_true * math.log((copy_rate * b + (1 - copy_rate) * same) / same)
                + both_false * math.log((copy_rate * (1 - b) + (1 - copy_rate) * wrong) / wrong)
                + differ * math.log((1 - copy_rate) * other / other)
                + math.log(prior / (1 - prior))
            )
            models[f][1][s, t] = 1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds))))
    # a source always names itself: who is right about confidences says whose name to keep
    models[FIELDS.index("source")] = models[FIELDS.index("confidence")]
    return models


def vote_weight(field: Column, votes: Column, models: dict[int, Model], copy_rate: float = 0.8) -> Column:
    """Weight of the votes for a value (sorted numbers of its sources), as a vectorised function."""

    @F.pandas_udf("double")
    def weights(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = {f: _independent(*m, copy_rate) for f, m in models.items()}
        for fields, s in batches:
            yield pd.Series([known[f](tuple(int(x) for x in v)) for f, v in zip(fields, s, strict=True)], index=s.index, dtype="float64")

    return weights(field, votes)


def fuse(relations: DataFrame, nodes: DataFrame, detectors: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """One fused record per group of two rows or more: ``group_seq``, and per field the value of highest posterior with its share of the posterior."""
    ws = ws or Workspace(relations.sparkSession, "fusion")
    claims, sources = _claims(relations, nodes, detectors, ws)
    # values with one set of sources are alike to the model: a group is the counts of its sets, not its values
    kinds = claims.groupBy("g", "field", "votes").agg(F.count(F.lit(1)).alias("k"))
    pairs = kinds.groupBy("g", "field").agg(F.array_sort(F.collect_list(F.struct("votes", "k"))).alias("pairs"))
    patterns = ws.cut(pairs.groupBy("field", F.col("pairs.votes").alias("sets"), F.col("pairs.k").alias("ks")).agg(F.count(F.lit(1)).alias("n")))
    models = estimate(patterns, sources)
    scored = claims.withColumn("weight", F.round(vote_weight(F.col("field"), F.col("votes"), models), 9))
    # the best value of each field, and the sum of all odds against the best
    best = F.max(F.struct(F.col("weight").alias("w"), F.col("n").alias("n"), (-F.col("seq")).alias("s"), F.col("val").alias("val"))).alias("best")
    odds = scored.groupBy("g", "field", "weight").agg(F.count(F.lit(1)).alias("k"), best)
    fields = odds.groupBy("g", "field").agg(F.max("best").alias("best"), F.collect_list(F.struct("weight", "k")).alias("all"))
    z = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["k"] * F.exp(x["weight"] - F.col("best.w")))
    one = fields.select("g", "field", F.col("best.val").alias("val"), F.round(1 / z, 6).alias("posterior"))
    picks = [F.max(F.when(F.col("field") == i, F.col(x))).alias(f"{f}{e}") for i, f in enumerate(FIELDS) for x, e in (("val", ""), ("posterior", "_posterior"))]
    return one.groupBy(F.col("g").alias("group_seq")).agg(*picks)
