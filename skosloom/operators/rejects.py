"""Rows that fail to parse: the valid rows loaded, the others with their reason.

Every raw record is read under the explicit schema of ten text fields with its
raw text retained, and classified by quoting, number of columns, and checks on
the values, in this order.  The grammar of the records is stated here and used
for both: Spark's own CSV reader repairs some broken quoting silently and, fed
record by record, lost the start of a field in a few of 250,000 sound records,
so neither its verdict nor its fields are used.

Defined results: null and empty records fail as ``columns``; one carriage
return at the end of a record is dropped first; a null token as ``URI`` is
valid; repeated records are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.functions.labels import NULL_TOKENS, strip

FIELDS = ("URI", "skos:prefLabel", "skos:definition", "rdf:type", "skos:altLabel", "skos:hiddenLabel", "skos:narrower", "skos:broader", "skos:scopeNote", "skos:changeNote")
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|(?!")[^\t]*+)'
WELL_QUOTED = rf"\A{_FIELD}(?:\t{_FIELD})*+\z"

# RFC 3986, section 3
_PCT = "%[0-9A-Fa-f]{2}"
_UNRES = r"A-Za-z0-9\-._~"
_SUB = r"!$&'()*+,;="
_DEC = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_DEC}(?:\.{_DEC}){{3}}"
_H16 = "[0-9A-Fa-f]{1,4}"
_LS32 = f"(?:{_H16}:{_H16}|{_V4})"
_V6 = "|".join(
    [
        f"(?:{_H16}:){{6}}{_LS32}",
        f"::(?:{_H16}:){{5}}{_LS32}",
        f"(?:{_H16})?::(?:{_H16}:){{4}}{_LS32}",
        f"(?:(?:{_H16}:){{0,1}}{_H16})?::(?:{_H16}:){{3}}{_LS32}",
        f"(?:(?:{_H16}:){{0,2}}{_H16})?::(?:{_H16}:){{2}}{_LS32}",
        f"(?:(?:{_H16}:){{0,3}}{_H16})?::{_H16}:{_LS32}",
        f"(?:(?:{_H16}:){{0,4}}{_H16})?::{_LS32}",
        f"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}",
        f"(?:(?:{_H16}:){{0,6}}{_H16})?::",
    ]
)
_IP_LITERAL = rf"\[(?:{_V6}|[vV][0-9A-Fa-f]+\.[{_UNRES}{_SUB}:]+)\]"
_HOST = rf"(?:{_IP_LITERAL}|(?:[{_UNRES}{_SUB}]|{_PCT})++)"
_PCHAR = rf"(?:[{_UNRES}{_SUB}:@]|{_PCT})"
HTTP_URI = rf"\A[hH][tT][tT][pP][sS]?://(?:(?:[{_UNRES}{_SUB}:]|{_PCT})*@)?{_HOST}(?::([0-9]*))?(?:/{_PCHAR}*+)*+(?:\?(?:{_PCHAR}|[/?])*+)?(?:#(?:{_PCHAR}|[/?])*+)?\z"

#: Outside the characters of XML 1.0, or the replacement character.
BAD_TEXT = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFC}\x{10000}-\x{10FFFF}]"

def usable_uri(c: Column) -> Column:
    """True where the trimmed value is a null token or an absolute http(s) URI with a host and a port of at most 65535."""
    t = strip(F.coalesce(c, F.lit("")))
    port = F.regexp_replace(F.regexp_extract(t, HTTP_URI, 1), r"\A0++", "")
    fits = (F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535"))
    return t.isin(*NULL_TOKENS) | (t.rlike(HTTP_URI) & fits)


def unquoted_field(raw: Column, n: int) -> Column:
    """Field ``n`` (from 0) of a well-quoted record, with its quotes resolved."""
    field = F.regexp_extract(raw, rf"\A(?:{_FIELD}\t){{{n}}}({_FIELD})", 1)
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(field, F.lit('"')), inner).otherwise(field)


def _count(raw: Column) -> Column:
    """Fields of a well-quoted record."""
    bare = F.regexp_replace(raw, r'(?<=\A|\t)"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("\t"), F.lit(""))) + 1


def read_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with ``_raw`` (the record without its carriage return) and ``_reason`` (null if valid)."""
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\r\z", "")
    t = F.col("_raw")
    reason = (
        F.when(~t.rlike(WELL_QUOTED), "quoting")
        .when((t == "") | (_count(t) != len(FIELDS)), "columns")
        .when(~usable_uri(unquoted_field(t, 0)), "uri")
        .when(unquoted_field(t, 2).rlike(BAD_TEXT), "definition")
    )
    return df.withColumn("_raw", text).withColumn("_reason", reason)


def rejected(df: DataFrame, keep: list[str], raw: str = "raw") -> DataFrame:
    """``keep`` columns and ``reason`` of the records that fail."""
    return read_records(df.select(*dict.fromkeys([*keep, raw])), raw).where(F.col("_reason").isNotNull()).select(*keep, F.col("_reason").alias("reason"))


def loaded(df: DataFrame, keep: list[str], raw: str = "raw") -> DataFrame:
    """``keep`` columns and the ten fields of the valid records, null tokens kept as text."""
    ok = read_records(df.select(*dict.fromkeys([*keep, raw])), raw).where(F.col("_reason").isNull())
    return ok.select(*keep, *[unquoted_field(F.col("_raw"), i).alias(name) for i, name in enumerate(FIELDS)])
