"""Ratcliff/Obershelp similarity and the order-dependent folds built on it.

The ratio is asymmetric and has no SQL counterpart (edit distance is a different
measure), so these are the few functions that run in Python, one Arrow batch at
a time. Length and character-count bounds settle most pairs without a match run.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Acceptance limits for facts, first-try and later questions.
FUZZY_MATCH = 0.90
FACT_DUPLICATE = 0.90
QUESTION_DUPLICATE = 0.94
QUESTION_DUPLICATE_RETRY = 0.98


def similarity_at_least(limit: float):
    """Pandas UDF (left, right) -> ratio where it reaches `limit`, else NULL."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        values, counted = [], lru_cache(maxsize=1024)(_letters)
        for a, b in zip(left, right):
            both = len(a) + len(b)
            # The letters that both have bound every ratio; most pairs need no matcher.
            if both and 2.0 * np.minimum(counted(a), counted(b)).sum() / both < limit:
                values.append(None)
                continue
            matcher = SequenceMatcher(None, a, b)
            bound = min(matcher.real_quick_ratio(), matcher.quick_ratio())
            value = matcher.ratio() if bound >= limit else 0.0
            values.append(value if value >= limit else None)
        return pd.Series(values, dtype="float64")

    return ratio


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.bincount(codes % 128, minlength=128)


def fresh_positions(keys: list[str], limit: float, accepted: list[str] | None = None) -> list[int]:
    """Positions kept by a greedy pass that drops keys close to one kept earlier.

    ratio(key, old) is at most twice the letters both have over their joint length.
    That bound is taken against all kept keys at once, after the one that lengths alone
    give; only those it cannot rule out are matched, each by one matcher made when first needed.
    """
    size = len(keys) + len(accepted or [])
    lengths, letters = np.zeros(size), np.zeros((size, 128), dtype=np.int32)
    old_keys: list[str] = []
    seen: set[str] = set()
    matchers: dict[int, SequenceMatcher] = {}
    kept: list[int] = []

    def keep(key: str, count: np.ndarray) -> None:
        lengths[len(old_keys)], letters[len(old_keys)] = len(key), count
        old_keys.append(key)
        seen.add(key)

    def repeats(key: str, count: np.ndarray) -> bool:
        if key in seen and limit <= 1:  # the ratio of equal texts is 1
            return True
        n = len(old_keys)
        near = np.flatnonzero(2.0 * np.minimum(lengths[:n], len(key)) >= limit * (lengths[:n] + len(key)))
        shared = np.minimum(letters[near], count).sum(axis=1)
        for old in near[2.0 * shared >= limit * (lengths[near] + len(key))].tolist():
            if old not in matchers:
                matchers[old] = SequenceMatcher(None, "", old_keys[old])
            matchers[old].set_seq1(key)
            if matchers[old].ratio() >= limit:
                return True
        return False

    for key in accepted or []:
        keep(key, _letters(key))
    for position, key in enumerate(keys):
        count = _letters(key)
        if key and not repeats(key, count):
            keep(key, count)
            kept.append(position)
    return kept


def keep_fresh(limit: float):
    """Pandas UDF over array<string> keys -> array<int> of kept positions."""

    @F.pandas_udf("array<int>")
    def kept(keys: pd.Series) -> pd.Series:
        return keys.map(lambda row: fresh_positions(list(row), limit))

    return kept


def length_can_reach(left: Column, right: Column, limit: float) -> Column:
    """JVM-side necessary condition: 2*min(la, lb)/(la + lb) >= limit."""
    la, lb = F.length(left), F.length(right)
    return 2.0 * F.least(la, lb) >= F.lit(limit) * (la + lb)
