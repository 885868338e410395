"""Words, label keys and names of nodes, as JVM-side expressions.

Decomposition uses the ICU library that ships with Spark, called through
``java_method``; no Python worker is started.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that mean "no value"; ``NA`` is a value.
NULL_TOKENS = ("", "NULL", "NaN")

#: A label with its broader term in a final parenthesis.
LABEL_WITH_TERM = r"(?s)\A(.*?)[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\(([^)]+)\)[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\z"

#: White space of every kind.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Trim white space of every kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}++|{SPACE}++\z", "")


def is_null_token(c: Column) -> Column:
    """True for null and for the null tokens (trimmed)."""
    return c.isNull() | strip(c).isin(*NULL_TOKENS)


def value_or_null(c: Column) -> Column:
    """``c``, or null where it is a null token."""
    return F.when(~is_null_token(c), c)


def _icu(c: Column, form: str) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(form), F.coalesce(c, F.lit("")), F.lit(False))


def decomposed(c: Column) -> Column:
    """Canonical decomposition (NFD); null becomes empty."""
    return _icu(c, "decompose")


def composed(c: Column) -> Column:
    """Canonical composition (NFC); null becomes empty."""
    return _icu(c, "compose")


@cache
def char_class(kinds: str) -> str:
    """Members of a pattern's class for the general categories that begin with one of ``kinds`` (as ``LN``).

    The JVM's tables may be older than the text: the characters that this
    Python's tables know and the JVM's do not are added by code point, behind
    one test of their range.
    """
    known = "".join(rf"\p{{{k}}}" for k in kinds)
    jvm = SparkContext._active_spark_context._jvm
    told = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] in kinds)
    new = [ord(c) for c in jvm.java.util.regex.Pattern.compile(f"[{known}]+").matcher(told).replaceAll("")]
    if not new:
        return known
    runs = [[new[0], new[0]]]
    for n in new[1:]:
        if n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return rf"{known}[\x{{{new[0]:X}}}-\x{{{new[-1]:X}}}&&[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]]"


def unaccented(c: Column) -> Column:
    """Lower case without combining marks; null becomes empty."""
    return F.lower(F.regexp_replace(decomposed(c), f"[{char_class('M')}]+", ""))


def words(c: Column) -> Column:
    """Maximal runs of letters and digits after decomposing, dropping marks and lower-casing."""
    return F.regexp_extract_all(unaccented(c), F.lit(f"([{char_class('LN')}]+)"), 1)


def label_key(c: Column) -> Column:
    """Words of the label without a final parenthesis, joined by one space; null becomes empty."""
    t = strip(F.coalesce(c, F.lit("")))
    head = F.when(t.rlike(LABEL_WITH_TERM), F.regexp_extract(t, LABEL_WITH_TERM, 1)).otherwise(t)
    return F.trim(F.regexp_replace(unaccented(head), f"[^{char_class('LN')}]+", " "))


def node_names(nodes: DataFrame) -> DataFrame:
    """``label_key``, ``named_uri``: one row per label key that exactly one node bears.

    A node written twice counts once; keys shared by several nodes name none;
    the empty key names none.
    """
    keyed = nodes.select(label_key(F.col("preflabel")).alias("label_key"), "uri").where(F.col("uri").isNotNull() & (F.col("label_key") != ""))
    one = keyed.groupBy("label_key").agg(F.min("uri").alias("named_uri"), F.max("uri").alias("_max"))
    return one.where(F.col("named_uri") == F.col("_max")).drop("_max")
