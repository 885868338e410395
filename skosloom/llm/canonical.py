"""Duplicates hidden by formatting differences, collapsed with their counts.

Byte-identical raw rows are collapsed first, with counts; only the distinct
survivors are canonicalised; they are grouped again on their full canonical
text, and the counts are summed.  No hash stands for a text, so no two
different records can meet.

Canonical text: composed (NFC), lower case, letters, marks and digits only; a
label is the sorted list of its runs of these (``·`` joins them), a URI drops
all else.  Accents count.  Null and the null tokens are one value, different
from any text, also from a text without letters.  A word repeated in a label
counts as often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.functions.labels import char_class, composed, is_null_token
from skosloom.plans.skew import lookup
from skosloom.plans.workspace import Workspace

_MISSING = "\x00"


def canonical_flat(c: Column) -> Column:
    """Canonical text without regard to white space and punctuation; null tokens give one marker."""
    return F.when(is_null_token(c), _MISSING).otherwise(composed(F.lower(F.regexp_replace(composed(c), f"[^{char_class('LMN')}]+", ""))))


def canonical_bag(c: Column) -> Column:
    """Canonical text without regard to the order of words either."""
    runs = F.regexp_extract_all(F.lower(composed(c)), F.lit(f"([{char_class('LMN')}]+)"), 1)
    return F.when(is_null_token(c), _MISSING).otherwise(composed(F.array_join(F.array_sort(runs), "·")))


def _raw(cols: list[str]) -> Column:
    """The raw columns as one text, unambiguous."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(cols)]))


def survivors(df: DataFrame, id_col: str, flat: list[str], bag: list[str]) -> DataFrame:
    """One row per distinct raw record: ``raw``, ``first`` (lowest id), ``n`` (its copies) and ``canon``."""
    cols = flat + bag
    exact = df.groupBy(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"))
    named = exact.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(cols)], "first", "n")
    keys = [canonical_flat(F.col(f"`{c}`")) for c in flat] + [canonical_bag(F.col(f"`{c}`")) for c in bag]
    return named.select(_raw(cols).alias("raw"), "first", "n", F.array(*keys).alias("canon"))


def collapse(df: DataFrame, id_col: str, flat: list[str], bag: list[str], ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups (``row_id``, ``copies``: one per record) and members (``row_id_a``, ``row_id_b``: the other rows of each)."""
    ws = ws or Workspace(df.sparkSession, "canonical")
    distinct = ws.cut(survivors(df, id_col, flat, bag))
    groups = distinct.groupBy("canon").agg(F.min("first").alias("row_id"), F.sum("n").alias("copies"))
    several = distinct.join(groups.where(F.col("copies") > 1), "canon").select("raw", "row_id")
    rows = df.select(F.col(id_col).alias("row_id_b"), _raw(flat + bag).alias("raw"))
    found = lookup(rows, several.withColumnRenamed("row_id", "row_id_a"), "raw", ["row_id_a"], hot=distinct.where(F.col("n") > 1).orderBy(F.desc("n"), "first").limit(1024).select("raw"))
    members = found.where(F.col("row_id_a") < F.col("row_id_b")).select("row_id_a", "row_id_b")
    return groups.select("row_id", "copies"), members
