"""String similarity: native where the engine has the parts, Arrow UDFs where it has not."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the joined length, in percent."""
    if not a and not b:
        return 100.0
    # bit-parallel longest common subsequence
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    s = (1 << len(a)) - 1
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u) | (s - u)
    common = (~s & ((1 << len(a)) - 1)).bit_count()
    return 200.0 * common / (len(a) + len(b))


def _full_windows_ratio(a: str, b: str) -> float:
    """Best indel ratio of a (under 64 characters) against the windows of its length, all of them at once."""
    n, text = len(a), np.frombuffer(b.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    masks = np.zeros(len(text), dtype=np.uint64)
    for ch in set(a):
        masks[text == ord(ch)] = sum(1 << i for i, x in enumerate(a) if x == ch)
    s = np.full(len(text) - n + 1, (1 << n) - 1, dtype=np.uint64)
    for j in range(n):
        u = s & masks[j : j + len(s)]
        s = (s + u) | (s - u)
    common = n - int(np.bitwise_count(s & np.uint64((1 << n) - 1)).min())
    return 200.0 * common / (2 * n)


def best_window_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter string against windows of the longer, of its length or cut at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    if n < 64 <= len(b):
        return max(_full_windows_ratio(a, b), *(indel_ratio(a, w) for i in range(1, n) for w in {b[:i], b[-i:]}), 0.0)
    windows = [b[max(0, i) : i + n] for i in range(1 - n, len(b))]
    return max(indel_ratio(a, w) for w in dict.fromkeys(windows))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_window_ratio(x, y) for x, y in zip(a, b, strict=True)])


def contained_or(query: Column, text: Column, otherwise: Column) -> Column:
    """100 where one contains the other, else the given score."""
    return F.when(text.contains(query) | query.contains(text), 100.0).otherwise(otherwise)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; 1 for equal or two empty texts."""
    x, y = F.array_remove(F.split(a, ""), ""), F.array_remove(F.split(b, ""), "")
    union = F.size(F.array_union(x, y))
    return F.when(a == b, 1.0).when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(1.0)


def folder_similarity(query: str, prefecture: Column, city: Column, district: Column, display: Column) -> Column:
    """Best of the ways in which a folder can answer a query; may exceed 1."""
    from mapsieve.functions.text import strip_digits

    q = F.lit(query.lower())
    shown = F.lower(display)
    position = F.instr(shown, query.lower()) - 1
    n = F.char_length(display)
    ways = [F.when(shown == q, 1.0), F.when(position >= 0, 0.7 + 0.3 * (1.0 - position / n) + 0.2 * (len(query) / n))]
    whole = sequence_ratio(q, shown)
    ways.append(F.when(whole > 0.3, whole * 0.5))
    bare = strip_digits(q)
    for part in (prefecture, city, district):
        p = F.lower(part)
        ways.append(F.when(p == q, 0.9).when(p.contains(q), 0.6 + 0.3 * len(query) / F.char_length(part)))
        ratio = sequence_ratio(q, p)
        ways.append(F.when(ratio > 0.5, ratio * 0.6))
        rest = strip_digits(p)
        ways.append(F.when(bare == "", None).when(rest == bare, 0.85).when(rest.contains(bare), 0.7))
    return F.greatest(*(F.coalesce(w.cast("double"), F.lit(0.0)) for w in ways), F.lit(0.0))
