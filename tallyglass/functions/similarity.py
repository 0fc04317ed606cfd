"""String similarities. The two Arrow functions run on blocked candidate pairs only."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=100_000)
def sequence(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib ratio of two strings; null where either is null."""
    return pd.Series([None if x is None or y is None else sequence(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & rows.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@lru_cache(maxsize=100_000)
def indel(a: str, b: str) -> float:
    """100 * 2 * LCS / (m + n)."""
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    return max(indel(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def blocks_of(alias: str, least: float) -> tuple[int, list[tuple[int, str]]]:
    """How many characters may stay unmatched at a partial ratio of `least`, and (offset, block) of more blocks than
    that: all but so many blocks stand unchanged in every window that reaches the ratio."""
    m = len(alias)
    unmatched = min(int(2 * m * (1 - least / 100) + 1e-9), m - 1)
    size = m // (unmatched + 1)
    n = m // size
    return unmatched, [(i * m // n, alias[i * m // n : i * m // n + size]) for i in range(n)]


@lru_cache(maxsize=100_000)
def mention(text: str, alias: str, least: float) -> float:
    """The partial ratio of alias and text where it reaches `least`, else 0; only windows of the longer one around
    blocks of the shorter are compared."""
    if len(alias) > len(text):
        alias, text = text, alias
    if not alias or alias in text:
        return 100.0 if alias else 0.0
    unmatched, blocks = blocks_of(alias, least)
    m, starts = len(alias), set()
    for offset, block in blocks:
        at = text.find(block)
        while at >= 0:
            starts.update(range(at - offset - unmatched, at - offset + unmatched + 1))
            at = text.find(block, at + 1)
    windows = [text[max(0, i) : i + m] for i in starts if -m < i < len(text)]
    best = max((indel(alias, w) for w in windows), default=0.0)
    return best if best >= least else 0.0


@F.pandas_udf(T.DoubleType())
def mention_score(text: pd.Series, alias: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([mention(*x) for x in zip(text, alias, least, strict=True)], dtype="float64")


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max(indel(both, left) if both else 0.0, indel(both, right) if both else 0.0, indel(left, right))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("ratio", "partial", "token_sort", "token_set")]))
def fuzzy(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """the four fuzzy ratios of two strings (null counts as empty)."""
    rows = [(indel(x, y), partial(x, y), token_sort(x, y), token_set(x, y)) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=["ratio", "partial", "token_sort", "token_set"])


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def location(page_a, page_b, section_sim, table_sim, reach: int = 1) -> Column:
    """weighted page, section and table over what both sides have."""
    near = F.when(F.abs(page_a - page_b) <= reach, 0.5).otherwise(0.0)
    got = F.coalesce(near, F.lit(0.0)) + F.coalesce(section_sim * 0.3, F.lit(0.0)) + F.coalesce(table_sim * 0.2, F.lit(0.0))
    got = F.when(page_a.isNull() | page_b.isNull(), got - F.coalesce(near, F.lit(0.0))).otherwise(got)
    weight = F.when(page_a.isNotNull() & page_b.isNotNull(), 0.5).otherwise(0.0) + F.when(section_sim.isNotNull(), 0.3).otherwise(0.0) + F.when(table_sim.isNotNull(), 0.2).otherwise(0.0)
    return F.when(weight > 0, got / weight).otherwise(0.0)


def metric(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """1 within tolerance, else what the relative difference leaves."""
    rel = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).when(rel <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - rel))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda x: x != ""))
