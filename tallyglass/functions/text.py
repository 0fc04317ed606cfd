"""Text functions as column expressions. Patterns start with (?U): digits and spaces are Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import WORDING

# Characters that comparisons leave out.
PUNCTUATION = "[ \t\r\n　，,。.:：；;、/（）()【】《》〈〉—\\-━﻿·•●\\[\\]\\{\\}_~“”\"'‘’＋+]"
#: Fixed value: how a page states its unit.
UNIT = "单位[:：]\\s*(万元|元|亿元)"
#: A year of this century: four digits that stand alone, with anything but a digit behind them.
YEAR = "(?<!\\d)(20\\d\\d)(?=\\D)"


def text(c) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def normalize(c) -> Column:
    """without Chinese and ASCII punctuation and blanks."""
    return F.regexp_replace(text(c), PUNCTUATION, "")


def squeeze(c) -> Column:
    """without white space, brackets and quotes."""
    return F.regexp_replace(text(c), "(?U)[\\s（）()\\[\\]【】“”\"'‘’]", "")


def years(c) -> Column:
    """years 20xx that no digit precedes."""
    return F.transform(F.regexp_extract_all(text(c), F.lit("(?U)" + YEAR), F.lit(1)), lambda x: x.cast("int"))


def money_unit(c) -> Column:
    """the unit stated on a page, or null."""
    found = F.regexp_extract(text(c), "(?U)" + UNIT, 1)
    return F.when(found != "", found)


def literal(word: str) -> str:
    return "\\Q" + word + "\\E"


def near_number(c, keywords: list[str]) -> Column:
    """first number after any keyword."""
    got = F.regexp_extract(text(c), "(?U)(?:" + "|".join(map(literal, keywords)) + ")[^0-9]*?(-?\\d+(?:,\\d{3})*(?:\\.\\d+)?)", 1)
    return F.regexp_replace(got, ",", "").try_cast("double")


def near_percent(c, keywords: list[str]) -> Column:
    """first percentage after any keyword."""
    got = F.regexp_extract(text(c), "(?U)(?:" + "|".join(map(literal, keywords)) + ")[^0-9]*?(-?\\d+(?:\\.\\d+)?)\\s*%", 1)
    return got.try_cast("double")


def spans(c, pattern: str) -> Column:
    """F16: array of (start, match), 0-based, for a pattern without look-around."""
    c = text(c)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,found:string>>)").alias("out"))

    def add(acc, m):
        at = F.call_function("locate", m, c, acc["at"])
        one = F.array(F.struct((at - 1).alias("start"), m.alias("found")))
        return F.struct((at + F.length(m)).alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.aggregate(found, start, add, lambda acc: acc["out"])


def quality(c) -> Column:
    """Chinese share times what isn't garbled, halved when Latin letters dominate."""
    c = text(c)
    n = F.length(c)
    han = F.regexp_count(c, F.lit("[一-龥]")) / n
    garbled = F.regexp_count(c, F.lit("[�□■]")) / n
    latin = F.regexp_count(c, F.lit("[A-Za-z]")) / n
    score = han * (1 - garbled)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.when(latin > 0.8, score * 0.5).otherwise(score), F.lit(1.0)))


def sentence(c, target) -> Column:
    """the sentence around the first hit of target."""
    c = text(c)
    at = F.call_function("locate", target, c)
    left = F.substring(c, F.lit(1), at - 1)
    right = F.substring(c, at, F.length(c))
    head = F.regexp_extract(left, "(?s)([^。！？.!?\n]*)$", 1)
    tail = F.regexp_extract(right, "(?s)^([^。！？.!?\n]*[。！？.!?]?)", 1)
    return F.when(at > 0, F.ltrim(F.concat(head, tail)))


def snippet(c, start, end, reach: int = 32) -> Column:
    """the hit with `reach` characters on both sides, blanks collapsed, the middle left out."""
    c = text(c)
    lo = F.greatest(start - reach, F.lit(0))
    part = F.substring(c, lo + 1, F.least(end + reach, F.length(c)) - lo)
    part = F.trim(F.regexp_replace(part, "(?U)\\s+", " "))
    cut = F.concat(F.substring(part, 1, reach), F.lit(" … "), F.substring(part, -reach, reach))
    return F.when(F.length(part) > 2 * reach, cut).otherwise(part)


def clip(c, starts, ends, most: int = 120) -> Column:
    """one clip around several spans, at most `most` characters."""
    lo = F.greatest(F.array_min(starts) - 10, F.lit(0))
    hi = F.least(F.array_max(ends) + 10, F.length(text(c)))
    return F.substring(text(c), lo + 1, F.least(hi - lo, F.lit(most)))


def windows(c, size: int = 1700, overlap: int = 200, most: int = 3) -> Column:
    """sliding windows (start, text), the first few of them."""
    c = text(c)
    last = F.greatest(F.length(c) - overlap - 1, F.lit(0))
    starts = F.slice(F.sequence(F.lit(0), last, F.lit(size - overlap)), 1, most)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(c, s + 1, F.lit(size)).alias("body")))


def section(c, start: str, stop: str) -> Column:
    """from a start heading to the next heading. Where no such heading follows, all of the rest is taken at once."""
    rest = F.regexp_extract(text(c), "(?s)(?m:" + start + ").*", 0)
    cut = lambda r: F.regexp_extract(r, "(?s)((?m:" + start + ").*?)(?=(?m:" + stop + ")|\\z)", 1)
    return F.transform(F.array(rest), lambda r: F.when(r.rlike("(?m)" + stop), cut(r)).otherwise(r))[0]


def guess_position(page, needle) -> Column:
    """exact, then normalised and proportional, then the longest of three parts of a long clip that is
    found and has over 30% of it; 10**9 when not found."""
    page = text(page)
    flat = F.regexp_replace(F.trim(text(needle)), "\n", "")
    exact = F.call_function("locate", F.substring(flat, 1, 50), page)
    n_page, n_needle = normalize(page), normalize(F.substring(text(needle), 1, 50))
    near = F.call_function("locate", n_needle, n_page)
    scaled = F.floor((near - 1) / F.length(n_page) * F.length(page)).cast("int")
    long = F.length(flat) >= 8
    n = F.length(text(needle))
    third = F.floor(n / 3).cast("int")
    parts = []
    for i in range(3):
        part = F.trim(F.substring(text(needle), third * i + 1, third if i < 2 else n))
        at = F.call_function("locate", F.substring(part, 1, 30), page)
        parts.append(F.when((n > 50) & (F.length(part) >= 8) & (F.length(part) > 0.3 * n) & (at > 0), F.struct(F.length(part).alias("size"), F.lit(-i).alias("first"), (at - 1).alias("at"))))
    best = F.array_max(F.array(*parts))["at"]
    return F.when(long & (exact > 0), exact - 1).when((n >= 8) & (near > 0), scaled).otherwise(F.coalesce(best, F.lit(10**9)))


TITLES = ["(?m)^\\s*(?:[一二三四五六七八九十]+[、.．])?\\s*([^\\n。]{2,40}?表)\\s*$", "(?m)第\\s*\\d+\\s*页\\s*([^\\n]{2,40}?表)", "(?m)([^\\n]{2,40}?表)\\s*[（(]续表?[）)]"]


def titles(c) -> Column:
    """candidate table titles by three patterns."""
    parts = [F.regexp_extract_all(text(c), F.lit("(?U)" + p), F.lit(1)) for p in TITLES]
    return F.array_distinct(F.concat(*parts))


def settled_wording(c) -> Column:
    """Budget words to final-account words, in their fixed order."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), WORDING, c)


def page_is_table(c) -> Column:
    """A unit mark, the usual phrase, or a total with ten digits or more."""
    c = text(c)
    return c.rlike("(?U)" + UNIT) | c.contains("本表反映") | (c.contains("合计") & (F.regexp_count(c, F.lit("(?U)\\d")) >= 10))


def page_is_front(c) -> Column:
    """Contents, glossary and explanation pages."""
    c = text(c)
    return c.contains("目录") | c.contains("名词解释") | c.contains("情况说明")
