"""The document array as grammars: one for each stretch of rows, built where the rows are.

A stretch's grammar replaces repeated pairs round by round: in a round, every pair that occurs more often than the pairs
that overlap it becomes a rule, wherever it does. What is left is its sequence of roots. Symbols under the number of its
documents are documents (in the order of `docs`), the others are rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stretch.
STRETCH = 1 << 16
GRAMMARS = "stretch long, docs array<long>, left array<int>, right array<int>, roots array<int>"


def compress(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """docs, left, right, roots of a sequence; rules only use symbols under their own.

    A pair that occurs once is left out of later rounds until one of its symbols is replaced: it can't become more frequent,
    and it stands back for any pair that occurs twice.
    """
    docs, now = np.unique(sequence, return_inverse=True)
    now, left, right, fresh = now.reshape(-1).astype(np.int64), [], [], len(docs)
    at = np.arange(max(0, len(now) - 1))  # where the pairs begin that may be repeated
    while len(at):
        pair = now[at] * fresh + now[at + 1]
        order = np.argsort(pair)
        ranked = pair[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        count = np.diff(np.append(heads, len(at)))
        kinds, kind = ranked[heads], np.empty(len(at), np.int64)
        kind[order] = np.repeat(np.arange(len(heads)), count)
        weight = np.full(len(now) + 1, -1)
        weight[at + 1] = (count * (len(kinds) + 1) + np.arange(len(kinds)))[kind]
        hit = (count[kind] > 1) & (weight[at + 1] > weight[at]) & (weight[at + 1] >= weight[at + 2])  # of equal neighbours the first
        often = np.bincount(kind[hit], minlength=len(kinds)) > 1
        hit &= often[kind]
        if not hit.any():
            break
        name = np.cumsum(often) - 1 + fresh
        left.append(kinds[often] // fresh), right.append(kinds[often] % fresh)
        keep, open_ = np.ones(len(now), bool), np.zeros(len(now), bool)
        open_[at[count[kind] > 1]] = True
        put = at[hit]
        now[put], keep[put + 1], open_[put] = name[kind[hit]], False, True
        now, open_ = now[keep], open_[keep]
        open_[:-1] |= now[1:] >= fresh
        at = np.flatnonzero(open_[:-1])
        fresh += int(often.sum())
    none = [np.zeros(0, np.int64)]
    return docs, np.concatenate(left or none), np.concatenate(right or none), now


class Grammar:
    def __init__(self, docs: np.ndarray, left: np.ndarray, right: np.ndarray, roots: np.ndarray):
        self.docs, self.left, self.right, self.roots, self.sigma = docs, left, right, roots, len(docs)
        span = np.ones(self.sigma + len(left), np.int64)
        for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True), self.sigma):
            span[i] = span[a] + span[b]
        self.span = span
        self.heads = np.cumsum(np.append(0, span[roots]))

    def cover(self, low: int, high: int) -> list[tuple[int, int]]:
        """Offset and symbol of the largest symbols that make up low..high, both included, as far as there are rows; empty if low > high."""
        out, stack, high = [], [], min(high, int(self.heads[-1]) - 1)
        if low <= high:
            first, last = np.searchsorted(self.heads, [low, high], "right") - 1
            stack = [(int(self.heads[i]), int(self.roots[i])) for i in range(last, first - 1, -1)]
        while stack:
            at, var = stack.pop()
            end = at + int(self.span[var])
            if at > high or end <= low:
                continue
            if at >= low and end <= high + 1:
                out.append((at, var))
            else:
                rule = var - self.sigma
                a, b = int(self.left[rule]), int(self.right[rule])
                stack += [(at + int(self.span[a]), b), (at, a)]
        return out

    def expand(self, low: int, high: int) -> np.ndarray:
        """The symbols of documents at low..high, both included, as far as there are rows; only what overlaps the range is expanded."""
        high = min(high, int(self.heads[-1]) - 1)
        if low > high:
            return np.zeros(0, np.int64)
        first, last = np.searchsorted(self.heads, [low, high], "right") - 1
        now, at = self.roots[first : last + 1].astype(np.int64), self.heads[first : last + 1]
        while (rules := now >= self.sigma).any():
            rule = now[rules] - self.sigma
            into = np.repeat(np.arange(len(now)), np.where(rules, 2, 1))
            second = np.append(False, into[1:] == into[:-1])
            is_rule = rules[into]
            left, right = self.left[rule], self.right[rule]
            out, begin = now[into], at[into].copy()
            out[is_rule & ~second], out[second] = left, right
            begin[second] += self.span[left]
            keep = (begin <= high) & (begin + self.span[out] > low)
            now, at = out[keep], begin[keep]
        return now

    def from_left(self, skip: int, count: int) -> np.ndarray:
        """At most `count` symbols of documents from the left end on, after `skip` of them."""
        return self.expand(skip, skip + count - 1)

    def from_right(self, skip: int, count: int) -> np.ndarray:
        """The same from the right end on, going left."""
        end = int(self.heads[-1]) - skip
        return self.expand(max(0, end - count), end - 1)[::-1] if end > 0 else np.zeros(0, np.int64)

    def first_last(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents at low..high, and their first and last place."""
        symbols = self.expand(low, high)
        found, first = np.unique(symbols, return_index=True)
        last = len(symbols) - 1 - np.unique(symbols[::-1], return_index=True)[1]
        return self.docs[found], first + low, last + low


def grammars(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """A row (GRAMMARS) for each stretch of rows(rk, doc_id); a task holds a stretch at a time."""

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("rk")
        columns = compress(part.column("doc_id").to_numpy())
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([part.column("stretch").slice(0, 1), *(pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds, strict=True))], ["stretch", "docs", "left", "right", "roots"])

    return rows.select("rk", "doc_id", F.floor(F.col("rk") / stretch).alias("stretch")).groupBy("stretch").applyInArrow(lambda part: build(part), GRAMMARS)


def _grammars_of(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield Grammar(*(np.array(batch.column(c)[i].values, np.int64) for c in ("docs", "left", "right", "roots")))


def _ranges(intervals: DataFrame, stretch: int) -> DataFrame:
    first, last = F.floor(F.col("sp") / stretch), F.floor(F.col("ep") / stretch)
    spread = intervals.withColumn("stretch", F.explode(F.sequence(first, last)))
    begin = F.col("stretch") * stretch
    return spread.groupBy("stretch").agg(F.collect_list(F.struct("pattern_id", (F.greatest(F.col("sp"), begin) - begin).alias("lo"), (F.least(F.col("ep"), begin + (stretch - 1)) - begin).alias("hi"))).alias("asked"))


def first_last_rows(intervals: DataFrame, found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """pattern_id, doc_id, first_rk, last_rk: the first and last row of each document in each interval(pattern_id, sp, ep), from the grammars `found`."""

    def listed(batches):
        for batch in batches:
            for i, own in enumerate(_grammars_of(batch)):
                base = batch.column("stretch")[i].as_py() * stretch
                for x in batch.column("asked")[i].as_py():
                    docs, first, last = own.first_last(x["lo"], x["hi"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), x["pattern_id"], np.int64)), pa.array(docs), pa.array(first + base), pa.array(last + base)], ["pattern_id", "doc_id", "first_rk", "last_rk"])

    parts = found.join(_ranges(intervals, stretch), "stretch").mapInArrow(listed, "pattern_id long, doc_id long, first_rk long, last_rk long")
    return parts.groupBy("pattern_id", "doc_id").agg(F.min("first_rk").alias("first_rk"), F.max("last_rk").alias("last_rk"))


def interval_cover(intervals: DataFrame, found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """pattern_id, rk, stretch, var and span_len of the largest symbols that make up each interval."""

    def covers(batches):
        for batch in batches:
            for i, own in enumerate(_grammars_of(batch)):
                at = batch.column("stretch")[i].as_py()
                for x in batch.column("asked")[i].as_py():
                    parts = own.cover(x["lo"], x["hi"])
                    yield pa.RecordBatch.from_pylist([{"pattern_id": x["pattern_id"], "rk": at * stretch + off, "stretch": at, "var": var, "span_len": int(own.span[var])} for off, var in parts], schema=pa.schema([("pattern_id", pa.int64()), ("rk", pa.int64()), ("stretch", pa.int64()), ("var", pa.int64()), ("span_len", pa.int64())]))

    return found.join(_ranges(intervals, stretch), "stretch").mapInArrow(covers, "pattern_id long, rk long, stretch long, var long, span_len long")


def expanded(intervals: DataFrame, found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """pattern_id, rk and doc_id of each row of each interval, expanded from the grammars."""

    def expand(batches):
        for batch in batches:
            for i, own in enumerate(_grammars_of(batch)):
                base = batch.column("stretch")[i].as_py() * stretch
                for x in batch.column("asked")[i].as_py():
                    docs = own.docs[own.expand(x["lo"], x["hi"])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), x["pattern_id"], np.int64)), pa.array(np.arange(len(docs)) + (base + x["lo"])), pa.array(docs)], ["pattern_id", "rk", "doc_id"])

    return found.join(_ranges(intervals, stretch), "stretch").mapInArrow(expand, "pattern_id long, rk long, doc_id long")


def ends(found: DataFrame, skip: int, count: int, right: bool = False) -> DataFrame:
    """stretch, i (from 0) and doc_id of the `count` rows after the first `skip` of each stretch; with `right`, from its end on, going left."""

    def expand(batches):
        for batch in batches:
            for i, own in enumerate(_grammars_of(batch)):
                docs = own.docs[own.from_right(skip, count) if right else own.from_left(skip, count)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), batch.column("stretch")[i].as_py(), np.int64)), pa.array(np.arange(len(docs))), pa.array(docs)], ["stretch", "i", "doc_id"])

    return found.mapInArrow(expand, "stretch long, i long, doc_id long")


def relational(found: DataFrame, least: int, sigma: int, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """rules(var, left, right) and sequence(at, var) of all stretches, as the relational operators take them.

    Terminals are 1..sigma, for the doc_ids from `least` on; a stretch has fewer rules than rows, so its rules are numbered from
    sigma + 1 + its first row on; `at` orders the roots and has gaps, as a stretch has no more roots than rows.
    """
    name = lambda symbol: F.when(symbol < F.size("docs"), F.element_at("docs", symbol + 1) - (least - 1)).otherwise(symbol - F.size("docs") + F.col("stretch") * stretch + (sigma + 1))
    pairs = found.select("stretch", "docs", F.posexplode(F.arrays_zip("left", "right")).alias("i", "p"))
    rules = pairs.select((F.col("i") + F.col("stretch") * stretch + (sigma + 1)).alias("var"), name(F.col("p.left")).alias("left"), name(F.col("p.right")).alias("right"))
    roots = found.select("stretch", "docs", F.posexplode("roots").alias("i", "root"))
    return rules, roots.select((F.col("i") + F.col("stretch") * stretch).alias("at"), name(F.col("root")).alias("var"))
