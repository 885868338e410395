"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skosloom.config import ADJECTIVES, STOP_WORDS, SUFFIXES
from skosloom.functions.labels import char_class, decomposed

#: White space, in a class that Java and RE2 read alike.
WS = r"[\s\p{Z}]"
LABEL_TERM = rf"^(.*?){WS}*\(([^)]+)\){WS}*$"


def trim_ws(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Decomposed, without non-spacing marks, lower case, only word characters and hyphens, single blanks; null gives empty."""
    plain = F.lower(F.regexp_replace(decomposed(c), r"\p{Mn}+", ""))
    return squeeze(F.regexp_replace(plain, rf"[^{char_class('LN')}_\s-]", " "))


def label_parts(c: Column) -> tuple[Column, Column]:
    """A label without its final parenthesis, and the term in it (null without one)."""
    has = c.rlike(LABEL_TERM)
    clean = F.when(has, trim_ws(F.regexp_extract(c, LABEL_TERM, 1))).otherwise(trim_ws(c))
    return clean, F.when(has, trim_ws(F.regexp_extract(c, LABEL_TERM, 2)))


def source_parts(c: Column) -> tuple[Column, Column]:
    """A definition without its final balanced parenthesis, and that parenthesis as its source (empty without one).

    The parenthesis opens at the last place from which openings outnumber
    closings by one before the final bracket, else at the last opening.
    """
    t = trim_ws(F.coalesce(c, F.lit("")))
    # depth from the right at each opening bracket, over the brackets only
    body = F.substring(t, F.lit(1), F.length(t) - 1)
    pieces = F.split(body, r"\(")
    n = F.size(pieces)
    closing = lambda x: F.length(x) - F.length(F.replace(x, F.lit(")"), F.lit("")))
    # suffix i..n-1 of the pieces has n-i openings; it fits if its closings are one fewer
    fits = F.filter(F.sequence(F.lit(1), n - 1), lambda i: (n - i - F.aggregate(F.slice(pieces, i + 1, n), F.lit(0), lambda a, x: a + closing(x))) == 1)
    start = F.when(F.size(fits) > 0, F.element_at(fits, -1)).otherwise(n - 1)
    has = F.endswith(t, F.lit(")")) & (n > 1)
    head = F.array_join(F.slice(pieces, 1, F.greatest(start, F.lit(1))), "(")
    tail = F.array_join(F.slice(pieces, start + 1, n), "(")
    return F.when(has, trim_ws(head)).otherwise(t), F.when(has, trim_ws(tail)).otherwise("")


def valid_word(w: Column, stop: tuple[str, ...] = STOP_WORDS, min_length: int = 3) -> Column:
    """Long enough, letters only, and no stop word."""
    return (F.length(w) >= min_length) & w.rlike(f"^[{char_class('L')}]+$") & ~w.isin(*stop)


def tokens(c: Column) -> Column:
    """Valid words of a normalised term, in order and with repeats."""
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(c), "[-_]", " "), F.lit(f"([{char_class('LN')}_]+)"), 1)
    return F.filter(parts, lambda w: valid_word(w))


def base_and_complement(c: Column, keyword: str) -> tuple[Column, Column]:
    """Parts before and after the first ``keyword`` of a normalised term, null where it has none."""
    p = rf"^(.+?)\s+{keyword}\s+(.+)$"
    return F.when(c.rlike(p), F.regexp_extract(c, p, 1)), F.when(c.rlike(p), F.regexp_extract(c, p, 2))


def adjective_and_base(c: Column, adjectives: tuple[str, ...] = ADJECTIVES) -> tuple[Column, Column]:
    """First listed adjective of a normalised term, and the term without any occurrence of its letters."""
    p = rf"(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(adjectives)})(?:$|[^\p{{L}}\p{{N}}_])"
    adj = F.when(c.rlike(p), F.regexp_extract(c, p, 1))
    return adj, F.when(adj.isNotNull(), squeeze(F.replace(c, adj, F.lit(""))))


def word_set(c: Column) -> Column:
    """Distinct words of the lower-cased label, accents kept."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"([{char_class('LNM')}_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def stem(w: Column, min_length: int = 4) -> Column:
    """A word without the first listed suffix it ends in, where more than two letters stay before it."""
    out = w
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(w, F.lit(s)) & (F.length(w) > len(s) + 2), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return F.when(F.length(w) >= min_length, out)


def confidence_bucket(c: Column) -> Column:
    """Tenth that a confidence falls into, as ``0.8-0.9``."""
    low = F.floor(F.round(c * 10, 9)) / 10
    return F.format_string("%.1f-%.1f", low, low + 0.1)


def uri_list(c: Column) -> Column:
    """Distinct values in order, joined by `` ## ``."""
    return F.array_join(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())), " ## ")


def multi_value(c: Column) -> Column:
    """Non-empty trimmed parts of a value split at ``##``."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "##"), trim_ws), lambda x: x != "")


def xml_text(c: Column) -> Column:
    """Trimmed, escaped and without control characters; null gives empty."""
    t = trim_ws(F.coalesce(c, F.lit("")))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double precision; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def contextual_similarity(a: Column, b: Column) -> Column:
    """Cosine mapped to 0..1, clamped against rounding."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine(a, b) + 1) / 2))
