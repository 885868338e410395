"""Keyword-stuffed and link-list pages.

A text is cut into segments (lines, and sentences within lines) and terms.  Two
measures of repetition judge a segment, taken over a window of ``WINDOW`` terms
around it (longer segments in parts, each by its own terms): the
*autocorrelation*, the largest share of positions with the same term as the
position ``lag`` before, over the lags up to ``MAX_LAG``; and the *regularity
of recurrence gaps*, the share of positions whose term returned after the same
gap as the time before.  A segment is stuffing if

* it is mostly links or tags;
* it repeats within itself: its terms return at some lag almost throughout, or
  most of its content terms are back within ``MAX_LAG`` terms, or many of its
  terms are and its frame returns at one lag around it;
* it has hardly a function word, and the form of a list (short items between
  separators, many short lines without the end of a sentence, long runs without
  any punctuation) or terms around it of which most return soon;
* it has few function words, and no end of a sentence or a short period;
* it is a short line without an end in a window that repeats regularly (menus).

Function words are found in the corpus, not listed: the words that a large part
of the documents of a language have in their sentences.  A language that the
corpus does not know has none; its prose has ends of sentences and no form of a
list, and passes.  Scripts without blanks are read letter by letter.

A page is flagged if stuffing makes up more than half of the characters of its
terms.  Defined results: null, empty and blank texts are not flagged; texts of
any length are analysed whole; every copy is judged alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skosloom.plans.workspace import Workspace

LIST_SHARE, PROSE_SHARE = 0.12, 0.26
WINDOW, MAX_LAG, SHORT_LAG = 128, 24, 6
REGULAR, SHORT_REGULAR, MENU, MENU_TERMS, DENSE = 0.25, 0.6, 0.08, 10, 0.5
#: Terms that return soon: around a segment without function words, within any, and within one whose frame returns at one lag.
RETURNED, CROWDED, FRAMED, FRAME = 0.4, 0.35, 0.3, 0.4
#: A list has so many items of so many terms at most on average (more items where a sentence ends), or so many lines of so many terms; or it is a run of terms without punctuation.
ITEMS, ENDED_ITEMS, ITEM_TERMS, LINES, LINE_TERMS, BARE_TERMS = 3, 6, 4.5, 5, 8, 25
#: Part of a language's documents that have a function word; part of all documents that a language has; least documents of a word.
WORD_SHARE, LANGUAGE_SHARE, WORD_DOCS = 0.3, 0.001, 5
#: Characters analysed at once; texts are never divided.
CHUNK = 1 << 22

DOC, LINE, END, SEP, COLON, NONE, LINK, TAG, WORD = range(9)
_MARKUP = re.compile(r"<[^<>\x00]*>")
_ENDS = ".!?…؟।。！？"
_SEPS = ",|•·/»>«()–—、，；：-"


#: Scripts written without blanks, read letter by letter.
_ALONE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))) + "]"
_HAS_ALONE = re.compile(_ALONE)


@cache
def _tokens(alone: bool) -> re.Pattern:
    """Terms and marks within a run of text without blanks; whether it has letters that stand alone."""
    marks = "".join(chr(n) for n in (*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(n))[0] == "M")
    word = rf"{_ALONE}|[#@]?(?:(?!{_ALONE})[\w{marks}])+" if alone else rf"[#@]?[\w{marks}]+"
    # a word, or the address it begins
    address = r"(?:-[\w-]+)?(?:\.[\w-]+)+/[^\"<>]*|://[^\"<>]+"
    return re.compile(
        rf"www\.[^\"<>]+|{word}(?:{address})?|\x00|\x01|\x02\d+"
        r"""|[.!?…؟।]+["'»”’)\]]*\Z|[。！？]+|[:;]|[,|•·/»>«()、，；：]|\A[–—-]+\Z"""
    )


def _kind(token: str) -> int:
    c = token[0]
    if c in "\x00\x01\x02":
        return (DOC, LINE, TAG)["\x00\x01\x02".index(c)]
    if c in _ENDS:
        return END
    if c in ":;":
        return COLON
    if c in _SEPS:
        return SEP
    return LINK if "/" in token or token.startswith("www.") else WORD


def _read(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Token numbers of all texts in order, the tokens, and whether a number follows (after which a point ends no sentence).

    Runs between blanks are few against their occurrences: each is cut into
    tokens once.
    """
    whole = "\x00".join(t.replace("\x00", " ").replace("\x01", " ").replace("\x02", " ") if t else "" for t in texts).lower()
    if "<" in whole:
        whole = _MARKUP.sub(lambda m: f" \x02{len(m[0])} ", whole)
    for c in "\r\u2028\u2029":
        whole = whole.replace(c, "\n")
    runs = whole.replace("\n", " \x01 ").replace("\x00", " \x00 ").split()
    if not runs:
        return np.zeros(0, dtype=np.int64), [], np.zeros(0, dtype=bool)
    codes, unique = pd.factorize(np.array(runs, dtype=object))
    plain, ids = _tokens(False).findall, {}
    parts = [[ids.setdefault(t, len(ids)) for t in (plain(u) if u.isascii() or not _HAS_ALONE.search(u) else _tokens(True).findall(u))] for u in unique]
    many = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.fromiter((i for p in parts for i in p), dtype=np.int64, count=int(many.sum()))
    begin = np.cumsum(many) - many
    counts = many[codes]
    run = np.repeat(np.arange(len(codes)), counts)
    place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    digit = np.append(np.fromiter((u[0].isdigit() for u in unique), dtype=bool, count=len(unique))[codes], False)
    return flat[begin[codes][run] + place], list(ids), digit[run + 1]


def _best_lag(hits: list[np.ndarray], first: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Largest share of positions of the ranges that repeat the term ``lag`` before, over the lags up to ``longest`` and half the range."""
    n, best = end - first, np.zeros(len(first))
    for lag in range(1, longest + 1):
        fits = (n >= 8) & (lag <= n // 2)
        count = hits[lag][end] - hits[lag][np.minimum(first + lag, end)]
        best = np.maximum(best, np.where(fits, count / np.maximum(n - lag, 1), 0.0))
    return best


def _of(unique: list[str], f, kind) -> np.ndarray:
    return np.fromiter(map(f, unique), dtype=kind, count=len(unique))


def _segments(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Token numbers, the tokens, the kind of each occurrence, and the number of its segment."""
    codes, unique, number = _read(texts)
    kind = _of(unique, _kind, np.int8)[codes]
    kind[(kind == END) & number & _of(unique, lambda t: t[0] not in "。！？", bool)[codes]] = NONE
    cut = (kind == DOC) | (kind == LINE) | (kind == END)
    return codes, unique, kind, np.cumsum(cut) - cut  # a mark belongs to the segment it closes


def shares(texts: list[str | None], words: frozenset[str] = frozenset()) -> np.ndarray:
    """Share of the characters of each text that are stuffing, for all texts at once; ``words`` are function words."""
    codes, unique, kind, seg = _segments(texts)
    if not len(codes):
        return np.zeros(len(texts))
    size = _of(unique, lambda t: int(t[1:]) if t[0] == "\x02" else len(t), np.int64)
    is_word, hashed, letter = _of(unique, lambda t: t in words, bool), _of(unique, lambda t: t[0] in "#@", bool), _of(unique, lambda t: bool(_HAS_ALONE.match(t)), bool)
    n_segs = int(seg[-1]) + 1
    closes = np.append((kind[1:] == LINE) | (kind[1:] == DOC), True)
    ended = np.zeros(n_segs, dtype=bool)
    ended[seg[(kind == END) | ((kind == COLON) & closes)]] = True
    marks = np.bincount(seg[(kind == SEP) | (kind == COLON)], minlength=n_segs)

    at = np.flatnonzero(kind >= LINK)
    if not len(at):
        return np.zeros(len(texts))
    doc = (np.cumsum(kind == DOC))[at]
    tkind, tseg, tsize = kind[at], seg[at], size[codes[at]]
    term = np.where(tkind == LINK, len(unique), np.where(tkind == TAG, len(unique) + 1, codes[at]))
    spelt = letter[codes[at]]
    word, link = is_word[codes[at]], (tkind == LINK) | (tkind == TAG)
    n = len(at)
    marks += np.bincount(tseg[hashed[codes[at]]], minlength=n_segs)

    # hits[lag][i]: positions before i that repeat the term lag before, within one text
    hits = [np.zeros(n + 1, dtype=np.int32)]
    for lag in range(1, MAX_LAG + 1):
        same = np.zeros(n + 1, dtype=np.int32)
        if lag < n:
            same[lag + 1 :] = (term[lag:] == term[:-lag]) & (doc[lag:] == doc[:-lag])
        hits.append(np.cumsum(same, dtype=np.int32))
    order = np.lexsort((np.arange(n), term, doc))
    again = (term[order][1:] == term[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    before = np.full(n, -1)
    before[order[1:][again]] = order[:-1][again]
    gap = np.where(before >= 0, np.arange(n) - before, 0)
    close = np.concatenate([[0], np.cumsum((before >= 0) & (gap <= MAX_LAG))])
    even = np.concatenate([[0], np.cumsum((before >= 0) & (gap == gap[before]) & (before[before] >= 0))])

    # parts of segments: the units that are judged
    starts = np.flatnonzero(np.append(True, tseg[1:] != tseg[:-1]))
    seg_size = np.diff(np.append(starts, n))
    within = np.arange(n) - np.repeat(starts, seg_size)
    first = np.flatnonzero(within % WINDOW == 0)
    end = np.append(first[1:], n)
    part = np.repeat(np.arange(len(first)), end - first)
    total = end - first
    pseg, pdoc, of = tseg[first], doc[first], np.repeat(seg_size, seg_size)[first]
    seg_start = first - within[first]
    doc_start = np.searchsorted(doc, pdoc, "left")
    doc_end = np.searchsorted(doc, pdoc, "right")
    around = np.maximum(doc_start, np.minimum(seg_start - (WINDOW - of) // 2, doc_end - WINDOW))
    wfirst = np.where(of >= WINDOW, seg_start + np.minimum(within[first], of - WINDOW), around)
    wend = np.minimum(doc_end, wfirst + WINDOW)

    count = lambda x: np.bincount(part, weights=x, minlength=len(first))
    share, links = count(word) / total, count(link) / total
    # words of set phrases may pass for function words: content is half of the terms at least
    content = np.maximum(count(~word), total / 2)
    inside = (before >= 0) & (gap <= MAX_LAG) & (before >= first[part])
    dense = count(inside & ~word) / content
    wide, short = _best_lag(hits, wfirst, wend, MAX_LAG), _best_lag(hits, wfirst, wend, SHORT_LAG)
    regular = np.where(wend - wfirst >= 8, (even[wend] - even[wfirst]) / np.maximum(wend - wfirst, 1), 0.0)
    returned = np.where(wend - wfirst >= 8, (close[wend] - close[wfirst]) / np.maximum(wend - wfirst, 1), 0.0)
    own = _best_lag(hits, first, end, MAX_LAG)

    open_ = ~ended[pseg]
    items = marks[pseg] + 1
    spaced = count(spelt) < total / 2  # letters return soon in any text
    lines = np.bincount(doc[starts], weights=~ended[tseg[starts]], minlength=len(texts))[pdoc]
    listed = (items >= np.where(open_, ITEMS, ENDED_ITEMS)) & (of / items <= ITEM_TERMS)
    listed |= open_ & (((of <= LINE_TERMS) & (lines >= LINES)) | ((items == 1) & (of >= BARE_TERMS) & spaced))
    bad = links >= 0.5
    bad |= (total >= 8) & ((own >= SHORT_REGULAR) | (spaced & ((dense >= DENSE) | ((total >= 12) & (count(inside & ~word) / total >= CROWDED)))))
    bad |= (share < LIST_SHARE) & (listed | (spaced & (returned >= RETURNED)))
    bad |= (share < PROSE_SHARE) & ((short >= REGULAR) | (open_ & listed & (of / items <= ITEM_TERMS / 1.5)))
    bad |= (total >= 8) & spaced & (count(inside & ~word) / total >= FRAMED) & (wide >= FRAME)
    bad |= (total <= MENU_TERMS) & (share < 2 * PROSE_SHARE) & open_ & (wend - wfirst >= 3 * MENU_TERMS) & ((wide >= MENU) | (regular >= MENU))
    bad |= (short >= SHORT_REGULAR) & (share < 2 * PROSE_SHARE)

    chars = count(tsize)
    sums = np.bincount(pdoc, weights=chars, minlength=len(texts))
    return np.bincount(pdoc, weights=chars * bad, minlength=len(texts)) / np.maximum(sums, 1)


def stuffed_share(text: str | None, words: frozenset[str] = frozenset()) -> float:
    """Share of stuffing of one text."""
    return float(shares([text], words)[0])


def repetition(codes: np.ndarray) -> tuple[float, float]:
    """Autocorrelation of a sequence over lags up to ``MAX_LAG`` and up to ``SHORT_LAG``."""
    n = len(codes)
    hits = [np.zeros(n + 1, dtype=np.int32)]
    for lag in range(1, MAX_LAG + 1):
        same = np.zeros(n + 1, dtype=np.int32)
        if lag < n:
            same[lag + 1 :] = codes[lag:] == codes[:-lag]
        hits.append(np.cumsum(same))
    ends = np.array([0]), np.array([n])
    return float(_best_lag(hits, *ends, MAX_LAG)[0]), float(_best_lag(hits, *ends, SHORT_LAG)[0])


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    """Ranges of ``texts`` of about ``CHUNK`` characters."""
    first = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= CHUNK or i == len(texts):
            yield slice(first, i)
            first, size = i, 0


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each language (``g``) with each word in a sentence, and (null) with any, by batches."""
    for b in batches:
        texts, langs = b["text"].tolist(), b["g"].to_numpy()
        for part in _chunks(texts):
            codes, unique, kind, seg = _segments(texts[part])
            if not len(codes):
                continue
            ended = np.zeros(int(seg[-1]) + 1, dtype=bool)
            ended[seg[kind == END]] = True
            at = (kind == WORD) & ended[seg]
            # a word counts once a document, a document once a language
            pairs = np.unique(np.cumsum(kind == DOC)[at].astype(np.int64) * (len(unique) + 1) + codes[at])
            doc, word = pairs // (len(unique) + 1), pairs % (len(unique) + 1)
            group, names = pd.factorize(langs[part])
            found, n = np.unique(group[doc].astype(np.int64) * len(unique) + word, return_counts=True)
            yield pd.DataFrame({"g": names[found // len(unique)], "word": np.array(unique, dtype=object)[found % len(unique)], "n": n})
            any_, n = np.unique(group[np.unique(doc)], return_counts=True)
            yield pd.DataFrame({"g": names[any_], "word": None, "n": n})


def function_words(documents: DataFrame, text: str = "text", lang: str = "lang", ws: Workspace | None = None) -> DataFrame:
    """``word``: words that many documents of one language have in their sentences, counted over all documents.

    Runs without the end of a sentence have no say, so lists have none.  A
    language is what ``lang`` says (trimmed, in lower case; null is one, too)
    if it has ``LANGUAGE_SHARE`` of the documents.  As a word must be in
    ``WORD_SHARE`` of a language's documents, there are at most
    1 / ``LANGUAGE_SHARE`` times 1 / ``WORD_SHARE`` times the words of an
    average document, whatever the size of the corpus.
    """
    ws = ws or Workspace(documents.sparkSession, "words")
    own = documents.where(F.col(text).isNotNull()).select(F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))).alias("g"), F.col(text).alias("text"))
    counts = own.mapInPandas(_word_counts, "g string, word string, n bigint").groupBy("g", "word").agg(F.sum("n").alias("n"))
    counts = ws.cut(counts.where(F.col("word").isNull() | (F.col("n") >= WORD_DOCS)))
    sizes = counts.where(F.col("word").isNull()).select("g", F.col("n").alias("docs"))
    total = sizes.agg(F.sum("docs").alias("all"))
    large = sizes.join(F.broadcast(total), how="inner").where(F.col("docs") >= F.col("all") * LANGUAGE_SHARE)
    known = counts.where(F.col("word").isNotNull()).join(large, "g").where(F.col("n") >= F.col("docs") * WORD_SHARE)
    return known.select("word").distinct()


def stuffed(text: Column, words: frozenset[str]) -> Column:
    """Share of stuffing of ``text``, as a vectorised function."""

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            out = [shares(texts[part], words) for part in _chunks(texts)]
            yield pd.Series(np.concatenate(out) if out else [], index=s.index, dtype="float64")

    return share(text)


def stuffed_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """``doc_id`` of the documents of which more than ``least`` is stuffing, by the function words of the corpus itself."""
    words = frozenset(r["word"] for r in function_words(documents, text, lang).collect())
    return documents.select(doc_id, stuffed(F.col(text), words).alias("share")).where(F.col("share") > least).select(doc_id)
