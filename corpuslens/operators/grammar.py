"""Straight-line programs as tables: rules(var, left, right) over terminals 1..sigma, one start symbol for each root.

Loops run once for each level of the grammar, and each level is a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sum
from ..storage import stored


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def occurrences(rules: DataFrame, sigma: int) -> DataFrame:
    """node_occ: first_pos and last_pos (from 1) of each terminal in each variable, leaves included; and span_len of the variable."""
    one = F.lit(1).cast("long")
    done = stored(rules.sparkSession.range(1, sigma + 1).select(F.col("id").alias("var"), F.col("id").alias("term"), one.alias("first_pos"), one.alias("last_pos"), one.alias("span_len")))
    open_ = rules
    while not open_.isEmpty():
        spans = done.select("var", "span_len").distinct()
        ready = stored(open_.join(spans.select(F.col("var").alias("left"), F.col("span_len").alias("l")), "left").join(spans.select(F.col("var").alias("right"), F.col("span_len").alias("r")), "right").select("var", "left", "right", "l", "r"))
        if ready.isEmpty():
            raise ValueError("a rule uses a symbol that has none")
        child = lambda side, shift: ready.select(F.col("var").alias("up"), F.col(side).alias("var"), shift.alias("shift"), (F.col("l") + F.col("r")).alias("whole")).join(done, "var").select(F.col("up").alias("var"), "term", (F.col("first_pos") + F.col("shift")).alias("first_pos"), (F.col("last_pos") + F.col("shift")).alias("last_pos"), F.col("whole").alias("span_len"))
        both = child("left", F.lit(0)).unionByName(child("right", F.col("l")))
        done = stored(done.unionByName(both.groupBy("var", "term").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.min("span_len").alias("span_len"))))
        open_ = open_.join(ready.select("var"), "var", "left_anti")
    return done


def occurrence_bits(rules: DataFrame, node_occ: DataFrame, sigma: int) -> DataFrame:
    """first and last bits of each variable and terminal: (1,0) absent, (0,0) in the left child only, (0,1) in both, (1,1) in the right child only.

    For a terminal: first is set for all but its own, last only for its own.
    """
    has = node_occ.select("var", "term", F.lit(True).alias("has"))
    terms = node_occ.sparkSession.range(1, sigma + 1).select(F.col("id").alias("term"))
    grid = rules.crossJoin(F.broadcast(terms))  # sigma rows on one side; the result has that many for each rule by definition
    in_ = lambda df, side: df.join(has.select(F.col("var").alias(side), "term", F.col("has").alias(f"in_{side}")), [side, "term"], "left")
    bits = in_(in_(grid, "left"), "right").select("var", "term", F.col("in_left").isNull().cast("int").alias("first"), F.col("in_right").isNotNull().cast("int").alias("last"))
    leaf = terms.select(F.col("term").alias("var")).crossJoin(F.broadcast(terms))
    return bits.unionByName(leaf.select("var", "term", (F.col("var") != F.col("term")).cast("int").alias("first"), (F.col("var") == F.col("term")).cast("int").alias("last")))


def cover(rules: DataFrame, roots: DataFrame, spans: DataFrame, low: int, high: int) -> DataFrame:
    """off (from 0) and var of the largest variables that make up low..high (both included) of the roots' text.

    roots(var, start); spans(var, span_len). A suffix cover has high at the end, a prefix cover has low at 0; an empty
    range has no rows.
    """
    front = roots.select("var", F.col("start").alias("off"))
    found = []
    while True:
        front = stored(front.join(spans, "var").where((F.col("off") <= high) & (F.col("off") + F.col("span_len") > low) & F.lit(low <= high)))
        inside = (F.col("off") >= low) & (F.col("off") + F.col("span_len") - 1 <= high)
        found.append(front.where(inside).select("off", "var"))
        split = front.where(~inside).join(rules, "var")
        if split.isEmpty():
            return _union(found)
        split = stored(split.join(spans.select(F.col("var").alias("left"), F.col("span_len").alias("_l")), "left"))
        front = split.select(F.col("left").alias("var"), "off").unionByName(split.select(F.col("right").alias("var"), (F.col("off") + F.col("_l")).alias("off")))


def expand(rules: DataFrame, roots: DataFrame, spans: DataFrame, low: int, high: int) -> DataFrame:
    """off and term of the symbols low..high-1: variables are replaced level by level; order by off, up or down, as needed."""
    front, found = cover(rules, roots, spans, low, high - 1), []
    while True:
        front = stored(front)
        left = rules.join(spans.select(F.col("var").alias("left"), F.col("span_len").alias("_l")), "left")
        split = front.join(left, "var")
        found.append(front.join(rules.select("var"), "var", "left_anti").select("off", F.col("var").alias("term")))
        if split.isEmpty():
            return _union(found)
        split = stored(split)
        front = split.select("off", F.col("left").alias("var")).unionByName(split.select((F.col("off") + F.col("_l")).alias("off"), F.col("right").alias("var")))


def cover_occurrences(parts: DataFrame, node_occ: DataFrame) -> DataFrame:
    """term, first_pos and last_pos (from 1) over a cover(off, var) whose offsets begin at any number."""
    base = parts.agg(F.min("off").alias("_base"))
    at = parts.crossJoin(F.broadcast(base)).withColumn("off", F.col("off") - F.col("_base"))  # one row
    return at.join(node_occ, "var").groupBy("term").agg(F.min(F.col("off") + F.col("first_pos")).alias("first_pos"), F.max(F.col("off") + F.col("last_pos")).alias("last_pos"))


def laid_out(sequence: DataFrame, spans: DataFrame) -> DataFrame:
    """off and var of a sequence(root_pos, var) of variables, one after another; off is each root's head."""
    return running_sum(sequence.join(spans, "var"), "span_len", "_end", "root_pos").select((F.col("_end") - F.col("span_len")).alias("off"), "var", "root_pos")


def binary_tree(leaves: DataFrame, first_id: int) -> DataFrame:
    """id, left, right of the rules that join leaves(i, id), i from 0, pairwise and level by level; a last odd node goes up as it is."""
    level, found, n = stored(leaves.select("i", "id")), [], leaves.count()
    while n > 1:
        paired = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("id", "i").alias("left"), F.max_by("id", "i").alias("right"), F.count("*").alias("n"))
        named = stored(paired.withColumn("id", F.when(F.col("n") == 2, F.col("i") + first_id).otherwise(F.col("left"))))
        found.append(named.where("n = 2").select("id", "left", "right"))
        level, first_id, n = named.select("i", "id"), first_id + n // 2, (n + 1) // 2
    return _union(found) if found else leaves.select(F.col("id"), F.col("id").alias("left"), F.col("id").alias("right")).limit(0)
