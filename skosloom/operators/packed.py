"""Several values packed in one field: one row per value, with its place.

A *dialect* is a set of separators (of ``##``, comma, semicolon, vertical bar,
line break) and a choice whether a leading double quote quotes a value.  The
stated format takes every separator and the quotes in every field: one dialect,
the widest, in which ``split_packed`` reads all fields unless it is told another
price of escapes.  Then every distinct field is priced in bits under each dialect
its characters allow and is read in the cheapest one (minimum description
length).  The price of a parse is

* for the dialect: one bit per separator and one for quoting;
* for each separator it takes: a code learned from how often each occurs in the
  table, mixed with an equal share so that none costs over 3.4 bits;
* for each value: the shorter of a dictionary code, ``log2(N / count)`` bits
  from counts of values over the whole table, and a literal, ``CHAR_BITS`` per
  character and for its end;
* for each separator or leading quote left as text, and each separator taken
  within quotes: an escape; values with an escape have no dictionary code.

Taking a separator costs its code, an end and the dialect's bit, 10.4 bits at
most, leaving it a character and an escape: from ``FIRST_ESCAPE`` bits on
separators separate and closed quotes quote, in fields of any length and
whatever the dictionary knows.  The widest dialect is the cheapest of every field
then, and nothing is priced.  Only at a lower price that a caller sets do bits
decide: separators meant as text stay text.  The price can be learned from there:
``log2`` of the characters read per escape that the cheapest parses leave, in
rounds.

Each text is parsed once for pricing, with all separators: a dialect that
leaves some joins neighbouring pieces, so all prices are sums over those pieces.

Defined results: null, empty, ``NULL`` and ``NaN`` fields (trimmed) give no
rows; empty items give none and take no place; a quote that is never closed is
text; text between a closing quote and the next separator stays with its value.
Repeated rows give their values as often as they occur; long fields are parsed
whole with possessive patterns, which need no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.functions.labels import is_null_token
from skosloom.plans.skew import HOT_KEYS, lookup
from skosloom.plans.workspace import Workspace

SEPARATORS = ("##", ",", ";", "|", "\n")
_REGEX = ("##", ",", ";", r"\|", r"\n")
CHAR_BITS = 6.0
#: Bits of an escape in the first round; from so many on no dialect but the widest is the cheapest of a field.
FIRST_ESCAPE = 5.0
_QUOTED = r'[ \t]*+"[^"]*+(?:""[^"]*+)*+"(?!")'
_ANY = r"##|[,;|\n]"
_LEADS = r'(?:\A|##|[,;|\n])[ \t]*+"'


def item_pattern(mask: int, quoting: bool) -> str:
    """Pattern whose group 1 is an item of a field under a dialect."""
    chosen = [r for i, r in enumerate(_REGEX) if mask >> i & 1]
    single = "".join(r for r in chosen if r != "##")
    if "##" in chosen:
        plain = rf"(?:[^#{single}]++|#(?!#))*+"
    else:
        plain = rf"[^{single}]*+" if single else r"[\s\S]*+"
    start = rf"(?:{'|'.join(chosen)}|\A)" if chosen else r"\A"
    return rf"{start}({f'(?:{_QUOTED})?+' if quoting else ''}{plain})"


_PATTERNS = [item_pattern(d >> 1, bool(d & 1)) for d in range(64)]
FULL = 63


def _blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[ \t]++|[ \t]++\z", "")


def parse(text: Column, dialect: Column | int) -> Column:
    """Non-empty values of ``text`` under ``dialect``, in order.

    The steps are separate ``transform`` calls so that each is evaluated once;
    a dialect given as a number has its pattern compiled once.
    """
    if isinstance(dialect, int):
        pattern, quoting = F.lit(_PATTERNS[dialect]), F.lit(bool(dialect & 1))
    else:
        pattern, quoting = F.element_at(F.lit(_PATTERNS), dialect + 1), dialect.bitwiseAND(F.lit(1)) == 1
    trimmed = F.filter(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), _blank_trim), lambda t: t != "")
    return F.filter(F.transform(trimmed, lambda t: F.when(quoting & F.startswith(t, F.lit('"')), _unquoted(t)).otherwise(t)), lambda v: v != "")


def _unquoted(t: Column) -> Column:
    """Value of an item that begins with a quote: its quoted head resolved, with the text behind it; unclosed quotes are text."""
    head = F.regexp_extract(t, rf"\A({_QUOTED})", 1)
    body = F.replace(F.substring(head, F.lit(2), F.length(head) - 2), F.lit('""'), F.lit('"'))
    return F.when(head != "", _blank_trim(F.concat(body, F.substring(t, F.length(head) + 1, F.length(t))))).otherwise(t)


def pieces(text: Column) -> Column:
    """Items of ``text`` with all separators: ``sep`` (bit of the one before, 0 at the start), ``chars``, ``val``, ``quoted``, ``inner`` (separators within quotes, by kind)."""
    bit = lambda m: F.when(F.startswith(m, F.lit("##")), 1).when(F.startswith(m, F.lit(",")), 2).when(F.startswith(m, F.lit(";")), 4).when(F.startswith(m, F.lit("|")), 8).when(F.startswith(m, F.lit("\n")), 16).otherwise(0)
    cut = F.transform(F.regexp_extract_all(text, F.lit(_PATTERNS[FULL]), F.lit(0)), lambda m: F.struct(bit(m).alias("sep"), F.regexp_replace(m, rf"\A(?:{_ANY})", "").alias("raw")))
    cut = F.transform(cut, lambda x: F.struct(x["sep"].alias("sep"), x["raw"].alias("raw"), _blank_trim(x["raw"]).alias("t")))
    head = lambda t: F.when(F.startswith(t, F.lit('"')), F.regexp_extract(t, rf"\A({_QUOTED})", 1)).otherwise("")
    cut = F.transform(cut, lambda x: F.struct(x["sep"].alias("sep"), F.length(x["raw"]).alias("chars"), x["t"].alias("t"), head(x["t"]).alias("h")))
    within = lambda h: F.array(*[((F.length(h) - F.length(F.replace(h, F.lit(x), F.lit("")))) / len(x)).cast("int") for x in SEPARATORS])
    return F.transform(cut, lambda x: F.struct(x["sep"].alias("sep"), x["chars"].alias("chars"), F.when(F.startswith(x["t"], F.lit('"')), _unquoted(x["t"])).otherwise(x["t"]).alias("val"), (x["h"] != "").alias("quoted"), F.when(x["h"] != "", within(x["h"])).alias("inner")))


def _present(text: Column) -> Column:
    mask = F.lit(0)
    for i, s in enumerate(SEPARATORS):
        mask = mask + F.when(F.contains(text, F.lit(s)), 1 << i).otherwise(0)
    return mask


def candidates(mask: Column, quotes: Column) -> Column:
    """Dialects that read differently a field with the separators ``mask`` outside of its quotes, and quoted values or none."""
    masks = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda m: m.bitwiseAND(F.bitwise_not(mask)) == 0)
    return F.flatten(F.transform(masks, lambda m: F.when(quotes, F.array(m * 2, m * 2 + 1)).otherwise(F.array(m * 2))))


def _literal_bits(chars: Column) -> Column:
    return F.when(chars > 0, CHAR_BITS * (chars + 1)).otherwise(0.0)


def _price(sep_bits: list[float]) -> tuple[Column, Column]:
    """Bits and escapes of a piece (``sep``, ``nxt``, ``chars``, ``quoted``, ``inner``, ``alone``) under ``dialect``."""
    mask, quoting = F.shiftright("dialect", 1), F.col("dialect").bitwiseAND(F.lit(1)) == 1
    left = lambda x: (F.col(x) > 0) & (F.col(x).bitwiseAND(mask) == 0)
    kinds = range(len(SEPARATORS))
    named, own_chars = F.lit(0.0), F.lit(0.0)
    for i in kinds:
        named = F.when(F.col("sep") == 1 << i, sep_bits[i]).otherwise(named)
        own_chars = F.when(F.col("sep") == 1 << i, CHAR_BITS * len(SEPARATORS[i])).otherwise(own_chars)
    # quotes read as text: the quote itself, and each separator taken within
    taken = sum((F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.col("inner")[i]).otherwise(0) for i in kinds), F.lit(0))
    bare = F.col("quoted") & ~quoting
    joined = F.when(left("sep"), CHAR_BITS * F.col("chars")).when(left("nxt"), CHAR_BITS * (F.col("chars") + 1))
    own = F.when(bare, _literal_bits(F.col("chars")) + taken * (CHAR_BITS + min(sep_bits))).otherwise(F.coalesce(joined, F.col("alone")))
    escapes = F.when(bare, taken + 1).otherwise(0) + F.when(left("sep"), 1).otherwise(0)
    return own + F.when(left("sep"), own_chars).otherwise(named), escapes


def choose_dialects(texts: DataFrame, ws: Workspace, first: float, learn: bool = True) -> tuple[DataFrame, int]:
    """``text``, ``dialect`` of each distinct text whose cheapest dialect is not the widest, and their number.

    ``texts`` has ``text`` and ``n``, its number of rows.  Without ``learn``
    the price of an escape stays ``first``; from ``FIRST_ESCAPE`` on no text is
    told.  The widest dialect takes every separator and the quotes; it needs no
    telling.
    """
    # parsing costs far more than its bytes tell: keep it spread over all tasks
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(parts, "text").withColumn("text_id", F.monotonically_increasing_id())
    texts = ws.cut(texts.withColumn("p", pieces(F.col("text"))))
    mask = F.aggregate("p", F.lit(0), lambda a, x: a.bitwiseOR(x["sep"]))
    marked = texts.select("text_id", "n", "p", mask.alias("mask"), F.exists("p", lambda x: x["quoted"]).alias("quotes"))
    items = marked.select("text_id", "n", "mask", "quotes", F.posexplode("p").alias("pos", "v"), "p")
    items = items.select("text_id", "n", "mask", "quotes", "v.*", F.coalesce(F.get("p", F.col("pos") + 1)["sep"], F.lit(0)).alias("nxt"))
    count = lambda bit: F.coalesce(F.sum(F.when(F.col("sep") == bit, F.col("n"))), F.lit(0)).alias(f"s{bit}")
    sums = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("values"), F.coalesce(F.sum(F.col("n") * F.col("chars")), F.lit(0)).alias("chars"), *[count(1 << i) for i in range(5)]).first()
    taken = max(1, sum(sums[f"s{1 << i}"] for i in range(5)))
    sep_bits = [-math.log2(0.5 * sums[f"s{1 << i}"] / taken + 0.1) for i in range(5)]
    counts = ws.cut(items.where(F.col("val") != "").groupBy("val").agg(F.sum("n").alias("n")).where(F.col("n") > 1))
    codes = counts.select("val", F.log2(F.lit(float(sums["values"] + 1)) / F.col("n")).alias("code_bits"))
    frequent = counts.orderBy(F.desc("n"), "val").limit(HOT_KEYS).select("val")
    priced = lookup(items, codes, "val", ["code_bits"], hot=frequent, salt="text_id")
    literal = _literal_bits(F.length("val"))
    alone = F.least(literal, F.coalesce("code_bits", literal)) + F.when(F.col("quoted"), 2.0).otherwise(0.0)
    tried = priced.withColumn("alone", alone).withColumn("dialect", F.explode(candidates(F.col("mask"), F.col("quotes"))))
    bits, escapes = _price(sep_bits)
    widest = F.col("dialect") == F.col("mask") * 2 + F.col("quotes").cast("int")
    cost = tried.select("text_id", "n", "dialect", bits.alias("b"), escapes.alias("e"), widest.alias("widest"))
    cost = ws.cut(cost.groupBy("text_id", "dialect").agg(F.sum("b").alias("b"), F.sum("e").alias("e"), F.first("n").alias("n"), F.first("widest").alias("widest")))
    seen, escape = -1, first
    while True:
        bits = F.round(F.col("b") + F.col("e") * F.lit(escape) + F.bit_count("dialect"), 6)
        best = cost.groupBy("text_id").agg(F.min(F.struct(bits.alias("bits"), (-F.col("dialect")).alias("d"), "e", "n", "widest")).alias("x"))
        found = ws.cut(best.where(~F.col("x.widest")).select("text_id", (-F.col("x.d")).alias("dialect"), "x.e", "x.n"))
        left, many = found.agg(F.coalesce(F.sum(F.col("n") * F.col("e")), F.lit(0)), F.count(F.lit(1))).first()
        # with none left a higher price changes nothing
        if left in (0, seen) or not learn:
            return texts.join(found, "text_id").select("text", "dialect"), many
        ws.drop(found)
        seen, escape = left, max(0.0, math.log2((sums["chars"] + 1.0) / (left + 1)))


def split_packed(df: DataFrame, fields: list[str], keep: list[str], pos: str = "pos", val: str = "val", field: str = "field", ws: Workspace | None = None, escape: float = FIRST_ESCAPE, learn: bool = True) -> DataFrame:
    """One row per value of each of ``fields``: ``keep`` columns, field name, place from 1, value.

    Every distinct text takes the dialect of least description length; at
    ``FIRST_ESCAPE`` bits an escape that is the widest, and no text is priced.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").alias("t")) for f in fields])).alias("_cell")
    rows = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)], cells)
    rows = rows.select(*[f"_k{i}" for i in range(len(keep))], F.col("_cell.f").alias("_field"), F.col("_cell.t").alias("text"))
    rows = rows.where(~is_null_token(F.col("text")))
    told, vals = rows, parse(F.col("text"), FULL)
    if escape < FIRST_ESCAPE:
        ws = ws or Workspace(df.sparkSession, "packed")
        open_text = (_present(F.col("text")) > 0) | F.col("text").rlike(_LEADS)
        # fields of the widest dialect need no telling apart: only the others are joined, if there are any
        other, many = choose_dialects(rows.where(open_text).groupBy("text").agg(F.count(F.lit(1)).alias("n")), ws, escape, learn)
        if many:
            other = ws.cut(other)
            told = lookup(rows, other, "text", ["dialect"])
            vals = F.when(F.col("dialect").isNull(), vals).otherwise(parse(F.col("text"), F.coalesce("dialect", F.lit(FULL))))
    out = told.select(*[f"_k{i}" for i in range(len(keep))], "_field", F.posexplode(vals).alias("_pos", "_v"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], F.col("_field").alias(field), (F.col("_pos") + 1).cast("int").alias(pos), F.col("_v").alias(val))
