"""Lookups that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most frequent keys that are looked up by broadcast; a fixed bound, so the broadcast cannot grow with the data.
HOT_KEYS = 1024


#: Longer keys are compared by their SHA-256 digest and their length, so that a broadcast of keys has a bound in bytes as well.
LONG_KEY = 1024
#: Hot rows whose values are longer than this are not broadcast; adaptive execution splits their join.
LONG_VALUES = 65536


def short_key(c: Column) -> Column:
    """``c`` as text, long keys by digest."""
    t = c.cast("string")
    return F.when(F.length(t) <= LONG_KEY, t).otherwise(F.concat(F.lit("\0sha256:"), F.length(t).cast("string"), F.lit(":"), F.sha2(t, 256)))


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS) -> DataFrame:
    """``_k``: the short forms of the ``limit`` most frequent non-null keys, counted over all rows with partial aggregation."""
    found = df.where(F.col(key).isNotNull()).groupBy(short_key(F.col(key)).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), F.asc("_k")).limit(limit).select("_k")


def lookup(df: DataFrame, table: DataFrame, key: str, values: list[str], hot: DataFrame | None = None, salt: str | None = None) -> DataFrame:
    """Left join ``df`` to ``table`` (one row per key), safe for hot keys.

    The most frequent keys of ``df`` (``HOT_KEYS`` at most, or those of
    ``hot``, which must be as few) are answered from a broadcast of their rows
    alone; every other key has a small part of the rows and goes through a
    shuffled join.  Rows without a key get nulls and take no part in the
    shuffle.

    ``df`` is read once for the hot keys and once for the others.  Where it is
    costly to make, give ``salt``, a column of many values: then all rows pass
    the shuffle in one reading, those already answered spread by their salt.
    """
    keys = hot_keys(df, key) if hot is None else hot.select(short_key(F.col(key)).alias("_k"))
    known = table.select(key, *values)
    size = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(v)))), F.lit(0)) for v in values), F.lit(0))
    hot_rows = F.broadcast(keys).join(known.withColumn("_k", short_key(F.col(key))), "_k", "left").where(size <= LONG_VALUES).select("_k", *values, F.lit(True).alias("_hot"))
    marked = df.withColumn("_k", short_key(F.col(key))).join(F.broadcast(hot_rows), "_k", "left").drop("_k")
    cols = [c for c in df.columns] + values
    if salt is not None:
        open_key = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("s"), F.col(salt).cast("string")))
        table_side = known.select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_key"), *[F.col(v).alias(f"_{v}") for v in values])
        both = marked.withColumn("_key", open_key).join(table_side, "_key", "left")
        return both.select(*df.columns, *[F.when(F.col("_hot"), F.col(v)).otherwise(F.col(f"_{v}")).alias(v) for v in values])
    done = marked.where(F.col("_hot") | F.col(key).isNull()).select(*cols)
    rest = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot", *values)
    return done.unionByName(rest.join(known, key, "left").select(*cols))
