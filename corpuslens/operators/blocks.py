"""Pre-aggregated parts of the document array, and the cover of an interval by them and the rows between.

The array is cut into blocks of `block_size` rows, `arity` blocks are a node of level 1, `arity` of those one of level 2, and
so on. A node's list has each of its documents once. Only nodes whose list pays are stored: a list must be `storing_factor`
times shorter than what would be read without it, the lists stored below it and the rows in no list.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import release, stored

#: Suffixes of a block; nodes in the next larger one; times that a list must be shorter than what it stands for.
BLOCK_SIZE, ARITY, STORING_FACTOR = 512, 4, 4
#: So many different nodes, or gaps, are also pushed to the file scans.
PUSHED = 64
NODES = "level int, node long, doc_id long, freq long, first_isa long, last_isa long"


def block_table(index: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """freq, first_isa and last_isa of each document in each block of rk values."""
    return index.groupBy(F.floor(F.col("rk") / block_size).alias("block"), "doc_id").agg(F.count("*").alias("freq"), F.min("isa").alias("first_isa"), F.max("isa").alias("last_isa"))


def sampled_nodes(rows: DataFrame, n: int, block_size: int = BLOCK_SIZE, arity: int = ARITY, storing_factor: int = STORING_FACTOR, levels: int | None = None) -> DataFrame:
    """level and node of the nodes that are stored, for n rows(rk, block, prev_rk).

    There are so many levels, or else as many as it takes until one node has all rows. A row is the first of its document in a node if the document's row before lies before the node, so one pass gives the
    lengths of all lists.
    """
    if levels is None:
        levels = 0
        while block_size * arity**levels < n:
            levels += 1
    fresh = [(F.col("prev_rk").isNull() | (F.col("prev_rk") < F.floor(F.col("rk") / (block_size * arity**k)) * (block_size * arity**k))).cast("long") for k in range(1, levels + 1)]
    level = stored(rows.groupBy(F.col("block").alias("node")).agg(F.count("*").alias("cost"), *(F.sum(c).alias(f"own_{k}") for k, c in enumerate(fresh, 1))))
    found, kept = level.sparkSession.createDataFrame([], "level int, node long"), [level]
    for k in range(1, levels + 1):
        up = level.groupBy(F.floor(F.col("node") / arity).alias("node")).agg(F.sum("cost").alias("cost"), *(F.sum(f"own_{j}").alias(f"own_{j}") for j in range(k, levels + 1)))
        pays = F.col("cost") > storing_factor * F.col(f"own_{k}")
        level = stored(up.withColumns({"pays": pays, "cost": F.when(pays, F.col(f"own_{k}")).otherwise(F.col("cost"))}))
        kept.append(level)
        found = found.unionByName(level.where("pays").select(F.lit(k).alias("level"), "node"))
    out = stored(found)
    release(*kept)
    return out


def node_lists(rows: DataFrame, sampled: DataFrame, block_size: int = BLOCK_SIZE, arity: int = ARITY) -> DataFrame:
    """The lists (NODES) of the sampled nodes: those of the lowest level from the rows, the others from those."""
    levels = sorted(r.level for r in sampled.select("level").distinct().collect())
    out = rows.sparkSession.createDataFrame([], NODES)
    if not levels:
        return out
    least = levels[0]
    merge = [F.sum("freq").alias("freq"), F.min("first_isa").alias("first_isa"), F.max("last_isa").alias("last_isa")]
    lists = stored(rows.groupBy(F.floor(F.col("rk") / (block_size * arity**least)).alias("node"), "doc_id").agg(F.count("*").alias("freq"), F.min("isa").alias("first_isa"), F.max("isa").alias("last_isa")))
    for k in levels:
        own = sampled.where(F.col("level") == k).select("node")
        up = lists if k == least else lists.groupBy(F.floor(F.col("node") / arity ** (k - least)).alias("node"), "doc_id").agg(*merge)
        out = out.unionByName(up.join(own, "node").withColumn("level", F.lit(k)))
    out = stored(out.sortWithinPartitions("level", "node"), **{"parquet.block.size": 4 << 20})  # so that a row group holds few nodes
    release(lists)
    return out


def cover(intervals: DataFrame, sampled: DataFrame, block_size: int = BLOCK_SIZE, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """What makes up each interval(pattern_id, sp, ep), both ends included: the largest sampled nodes in it, pattern_id, level, node; and the gaps between them, pattern_id, lo, hi."""
    levels = sorted(r.level for r in sampled.select("level").distinct().collect())
    inside = intervals.select("pattern_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("node")).limit(0)
    for k in levels:
        span = block_size * arity**k
        first, last = F.floor((F.col("sp") + span - 1) / span), F.floor((F.col("ep") + 1) / span) - 1
        inside = inside.unionByName(intervals.where(last >= first).select("pattern_id", F.lit(k).alias("level"), F.explode(F.sequence(first, last)).alias("node")))
    inside = stored(inside.join(sampled, ["level", "node"]).select("pattern_id", "level", "node"))
    above = inside.limit(0)
    for i, k in enumerate(levels):
        for up in levels[i + 1 :]:
            over = inside.where(F.col("level") == up).select("pattern_id", F.col("node").alias("_over"))
            low = inside.where(F.col("level") == k).withColumn("_over", F.floor(F.col("node") / arity ** (up - k)))
            above = above.unionByName(low.join(over, ["pattern_id", "_over"], "left_semi").select("pattern_id", "level", "node"))
    nodes = inside.join(above, ["pattern_id", "level", "node"], "left_anti")
    span = F.lit(block_size).cast("long") * F.pow(F.lit(float(arity)), "level").cast("long")
    edges = nodes.select("pattern_id", (F.col("node") * span).alias("begin"), ((F.col("node") + 1) * span).alias("end"))
    edges = edges.unionByName(intervals.select("pattern_id", (F.col("ep") + 1).alias("begin"), (F.col("ep") + 1).alias("end"))).unionByName(intervals.select("pattern_id", F.lit(-1).cast("long").alias("begin"), F.col("sp").alias("end")))
    before = F.lag("end").over(Window.partitionBy("pattern_id").orderBy("begin", "end"))
    gaps = edges.withColumn("lo", before).where(F.col("lo") < F.col("begin")).select("pattern_id", "lo", (F.col("begin") - 1).alias("hi"))
    return nodes, gaps


def gap_rows(gaps: DataFrame, rows: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """pattern_id and the rows of each gap; rows have their block as a column, so the join is on equal blocks."""
    spread = gaps.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_size), F.floor(F.col("hi") / block_size))))
    return spread.join(rows, "block").where(F.col("rk").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def covered(intervals: DataFrame, rows: DataFrame, nodes: DataFrame, sampled: DataFrame, block_size: int = BLOCK_SIZE, arity: int = ARITY) -> DataFrame:
    """pattern_id, doc_id, freq, first_isa, last_isa of the parts that make up each interval."""
    chosen, gaps = (stored(x) for x in cover(stored(intervals), sampled, block_size, arity))
    few = lambda df, *names: [tuple(r) for r in df.select(*names).distinct().limit(PUSHED + 1).collect()]
    lists, spans = few(chosen, "level", "node"), few(gaps, "lo", "hi")
    if len(lists) <= PUSHED:  # so that the scan skips row groups, as both tables are stored in this order
        nodes = nodes.where(reduce(or_, ((F.col("level") == k) & (F.col("node") == node) for k, node in lists), F.lit(False)))
    if len(spans) <= PUSHED:
        rows = rows.where(reduce(or_, (F.col("rk").between(lo, hi) for lo, hi in spans), F.lit(False)))
    inner = nodes.join(chosen, ["level", "node"]).select("pattern_id", "doc_id", "freq", "first_isa", "last_isa")
    edge = gap_rows(gaps, rows.select("block", "rk", "doc_id", "isa"), block_size)
    return inner.unionByName(edge.select("pattern_id", "doc_id", F.lit(1).cast("long").alias("freq"), F.col("isa").alias("first_isa"), F.col("isa").alias("last_isa")))
