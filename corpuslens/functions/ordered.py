"""Rank, select, range extremes, shifts, running sums and runs over rows with a dense number 0, 1, 2, ...

A window over all rows would need one task. Here rows are cut into blocks by their number: a window works inside a block,
and a small table of one row for each block carries what crosses its edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

BLOCK = 1 << 16


def numbered(df: DataFrame, *by: str | Column, name: str = "rk", walk: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with the place of each row in the order of `by`, from 0: range-sorted partitions and their offsets.

    walk: what is done with the sorted partitions; it keeps their rows and their order.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = walk(ordered) if walk else ordered
    kept = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = kept.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_offset"))  # a row for each partition
    out = kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_offset")
    out._stored_at = kept._stored_at
    return out


def _block(index: str, size: int) -> Column:
    return F.floor(F.col(index) / F.lit(size))


def running_sum(df: DataFrame, value: str | Column, name: str, index: str = "rk", size: int = BLOCK) -> DataFrame:
    """df with the sum of value over all rows up to this one.

    Three levels: inside a block, over the blocks of a group of `size` blocks, and over the groups, of which there is one for
    size * size rows.
    """
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumns({"_b": _block(index, size), "_v": value})
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = df.groupBy("_b").agg(F.sum("_v").alias("_t")).withColumn("_g", _block("_b", size))
    groups = blocks.groupBy("_g").agg(F.sum("_t").alias("_t")).select("_g", before(Window.orderBy("_g"), "_t").alias("_far"))
    base = blocks.withColumn("_near", before(Window.partitionBy("_g").orderBy("_b"), "_t")).join(groups, "_g").select("_b", (F.col("_near") + F.col("_far")).alias("_base"))
    own = F.sum("_v").over(Window.partitionBy("_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_own", own).join(base, "_b").withColumn(name, F.col("_base") + F.coalesce("_own", F.lit(0))).drop("_b", "_v", "_own", "_base")


def shifted(df: DataFrame, value: str, name: str, by: int = -1, index: str = "rk", size: int = BLOCK) -> DataFrame:
    """df with the value of the row before (by=-1) or after (by=1); null where there is none."""
    df = df.withColumn("_b", _block(index, size))
    edge = size - 1 if by < 0 else 0
    edges = df.where(F.pmod(F.col(index), F.lit(size)) == edge).select((F.col("_b") - by).alias("_b"), F.col(value).alias("_edge"))
    w = Window.partitionBy("_b").orderBy(index)
    inside = F.lag(value, 1).over(w) if by < 0 else F.lead(value, 1).over(w)
    first = F.pmod(F.col(index), F.lit(size)) == (0 if by < 0 else size - 1)
    return df.withColumn("_n", inside).join(edges, "_b", "left").withColumn(name, F.when(first, F.col("_edge")).otherwise(F.col("_n"))).drop("_b", "_n", "_edge")


def rank1(bits: DataFrame, bit: str = "bit", index: str = "i") -> DataFrame:
    """bits with rank: the ones before this row."""
    one = F.col(bit).cast("int")
    return running_sum(bits, one, "_r", index).withColumn("rank", (F.col("_r") - one).cast("long")).drop("_r")


def select1(bits: DataFrame, bit: str = "bit", index: str = "i") -> DataFrame:
    """k (from 1) and the index of the k-th one."""
    return running_sum(bits, F.col(bit).cast("int"), "k", index).where(F.col(bit).cast("boolean")).select(F.col("k").cast("long").alias("k"), index)


def range_extremes(df: DataFrame, ranges: DataFrame, value: str, index: str = "rk", size: int = BLOCK) -> DataFrame:
    """Leftmost index of the least and of the largest value in each range(range_id, lo, hi), both ends included.

    Whole blocks answer from one row each; only the blocks at the two ends are read.
    """
    df = df.withColumn("_b", _block(index, size))
    low, high = F.struct(F.col(value).alias("v"), F.col(index).alias("i")), F.struct((-F.col(value)).alias("v"), F.col(index).alias("i"))
    whole = df.groupBy("_b").agg(F.min(low).alias("_low"), F.min(high).alias("_high"))
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    full = (F.col("_b") * size >= F.col("lo")) & ((F.col("_b") + 1) * size - 1 <= F.col("hi"))
    edges = spread.where(~full).join(df, "_b").where(F.col(index).between(F.col("lo"), F.col("hi"))).select("range_id", low.alias("_low"), high.alias("_high"))
    inner = spread.where(full).join(whole, "_b").select("range_id", "_low", "_high")
    return edges.unionByName(inner).groupBy("range_id").agg(F.min("_low").alias("l"), F.min("_high").alias("h")).select("range_id", F.col("l.i").alias("min_at"), F.col("h.i").alias("max_at"))


def run_numbers(df: DataFrame, value: str, name: str = "run_id", index: str = "rk") -> DataFrame:
    """df with head (the value differs from the row before) and the run's number from 0."""
    headed = shifted(df, value, "_before", -1, index).withColumn("head", F.coalesce(~F.col(value).eqNullSafe(F.col("_before")), F.lit(True)) | (F.col(index) == 0)).drop("_before")
    return running_sum(headed, F.col("head").cast("int"), name, index).withColumn(name, (F.col(name) - 1).cast("long"))


def runs(df: DataFrame, value: str, index: str = "rk") -> DataFrame:
    """run_id, start, len and value of each maximal run of equal values."""
    return run_numbers(df, value, index=index).groupBy("run_id").agg(F.min(index).alias("start"), F.count("*").alias("len"), F.min(F.col(value).cast("long")).alias("value"))


def differences(df: DataFrame, value: str, index: str = "rk") -> DataFrame:
    """df with diff: the value less the one before (0 before the first), and shifted: diff less the least diff, if that is negative."""
    found = shifted(df, value, "_before", -1, index).withColumn("diff", F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before")
    base = found.agg(F.least(F.min("diff"), F.lit(0)).alias("_base"))
    return found.crossJoin(F.broadcast(base)).withColumn("shifted", F.col("diff") - F.col("_base")).drop("_base")  # one row


def restored(df: DataFrame, index: str = "rk") -> DataFrame:
    """df with value: the running sum of diff, by blocks as samples."""
    return running_sum(df, "diff", "value", index)


def restored_range(samples: DataFrame, df: DataFrame, low: int, high: int, index: str = "rk", size: int = BLOCK) -> DataFrame:
    """index and value for low..high, both included, of df(index, diff): from the nearest sample before, without the rows of other blocks.

    samples(block, base): the value before each block of `size` rows, as differential_samples() makes them.
    """
    first, last = low // size, high // size
    near = df.where(F.col(index).between(first * size, high)).withColumn("block", _block(index, size))
    own = F.sum("diff").over(Window.partitionBy("block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    base = samples.where(F.col("block").between(first, last))
    return near.withColumn("_own", own).join(base, "block").where(F.col(index) >= low).select(index, (F.col("base") + F.col("_own")).cast("long").alias("value"))


def differential_samples(df: DataFrame, index: str = "rk", size: int = BLOCK) -> DataFrame:
    """block and base, the sum of diff before the block, for each block of `size` rows of df(index, diff)."""
    sums = df.groupBy(_block(index, size).alias("block")).agg(F.sum("diff").alias("_t"))
    return running_sum(sums, "_t", "_s", "block", size).select("block", (F.col("_s") - F.col("_t")).alias("base"))


def bit_operations(bits: DataFrame, a: str, b: str) -> DataFrame:
    """bits with not_a, and_ab and or_ab of two 64-bit words."""
    x, y = F.col(a), F.col(b)
    return bits.withColumns({"not_a": F.bitwise_not(x), "and_ab": x.bitwiseAND(y), "or_ab": x.bitwiseOR(y)})
