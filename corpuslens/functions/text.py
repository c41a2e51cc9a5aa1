"""Counting in strings and ordering their suffixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(pattern: Column) -> Column:
    """A regular expression that matches the pattern's characters as they are."""
    return F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def occurrences(text: Column, pattern: Column) -> Column:
    """Occurrences of the pattern, overlapping ones too: matches of a look-ahead have no width."""
    return F.regexp_count(text, F.concat(F.lit("(?="), quoted(pattern), F.lit(")"))).cast("long")


def ranked_suffixes(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of one text by their first `length` characters, then by place; and the common prefix of each with the one before in that order, `length` at most.

    Prefix doubling: the ranks by 1, 2, 4, ... characters; ranks of two overlapping windows give any other length. All ranks
    are kept, a few numbers for each character; the common prefixes are read from them, the widest windows first.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    rank = np.unique(codes, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1  # 0 is behind the end
    levels, width = [(1, rank)], 1
    while width < length and rank.max() < n:
        step = min(width, length - width)
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].reshape(-1) + 1
        width += step
        levels.append((width, rank.astype(np.int32)))
    order = np.argsort(rank, kind="stable")
    prefix = np.zeros(n, np.int32)
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, np.int64)
    for width, rank in reversed(levels):
        inside = (shared + width <= length) & (np.maximum(a, b) + shared < n)
        at = np.flatnonzero(inside)
        same = rank[a[at] + shared[at]] == rank[b[at] + shared[at]]
        shared[at[same]] += width
    prefix[1:] = shared
    return order, prefix
