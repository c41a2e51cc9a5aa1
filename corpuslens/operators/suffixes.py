"""Suffix rows and the arrays over them: suffix and document array, BWT, per-document ranks, neighbours, LCP values and runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import numbered, run_numbers
from ..functions.text import ranked_suffixes
from ..storage import release, stored

#: Characters of a suffix that are kept as its sort key.
KEY_LENGTH = 32
DELIMITER = "\u0000"


#: Suffixes that are handed on at once.
BATCH = 50_000
_CUT = [("doc_id", pa.int64()), ("pos", pa.int32()), ("key", pa.string()), ("isa", pa.int64()), ("ilcp_b", pa.int32()), ("ilcp_f", pa.int32())]


def _keys(text: str, raw: bytes, at: int, n: int, length: int) -> pa.Array:
    """The `length` characters from each of n places on, at the end fewer."""
    if len(raw) != len(text):  # characters of several bytes
        return pa.array([text[i : i + length] for i in range(at, at + n)], pa.string())
    whole = max(0, min(n, len(raw) - length - at + 1))
    data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)[at : at + whole].tobytes() if whole else b""
    rest = [raw[i : i + length] for i in range(at + whole, at + n)]
    sizes = np.concatenate([[0], np.full(whole, length), list(map(len, rest))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer(data + b"".join(rest))])


def _cut(key_length: int):
    def cut(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                raw = text.encode()
                order, prefix = ranked_suffixes(np.frombuffer(text.encode("utf-32-le"), np.uint32), key_length)
                isa = np.empty(len(text), np.int64)
                isa[order] = np.arange(len(text))
                before = prefix[isa]
                after = np.append(prefix, 0)[isa + 1].astype(np.int32)
                for at in range(0, len(text), BATCH):  # so a long document is no large batch
                    n = min(BATCH, len(text) - at)
                    own = slice(at, at + n)
                    columns = [np.full(n, doc, np.int64), np.arange(at, at + n, dtype=np.int32), _keys(text, raw, at, n, key_length), isa[own], before[own], after[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _CUT, strict=True)], [name for name, _ in _CUT])

    return cut


def suffix_rows(docs: DataFrame, key_length: int = KEY_LENGTH) -> DataFrame:
    """doc_id, pos, key: a row for each character of each document, with the text from there on, cut to key_length.

    Also isa, the place among its document's suffixes by key and place, and ilcp_b and ilcp_f, the characters that the key
    shares with those of the document's suffixes before and behind it in that order; 0 at the ends. A document is in memory
    as a few numbers for each character.
    """
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.where("doc_id IS NOT NULL").select("doc_id", "text").repartition(tasks, "doc_id")  # a small part of what the suffixes take
    return dealt.mapInArrow(_cut(key_length), "doc_id long, pos int, key string, isa long, ilcp_b int, ilcp_f int")


def suffix_array(docs: DataFrame, key_length: int = KEY_LENGTH, walk=None) -> DataFrame:
    """Suffix rows with rk, their place by key, then document, then position.

    Intervals, ranks in a document and tests of LCP values under a pattern's length are exact for patterns of up to
    key_length characters; the order is that of whole suffixes if no text is longer. exact_suffix_array() has no limit.
    """
    cut = stored(suffix_rows(docs, key_length))  # read twice, to sample the ranges and to sort
    out = numbered(cut, "key", "doc_id", "pos", walk=walk)
    release(cut)
    return out


def exact_suffix_array(docs: DataFrame, key_length: int = KEY_LENGTH) -> DataFrame:
    """doc_id, pos and rk by whole suffixes, ties by document: prefix doubling, a sort for each doubling of the compared length."""
    placed = numbered(suffix_rows(docs, key_length).select("doc_id", "pos", "key"), "key", "doc_id", "pos")
    ranked, length = stored(run_numbers(placed, "key", "class").select("doc_id", "pos", "rk", "class")), key_length
    while True:
        later = ranked.select("doc_id", (F.col("pos") - length).alias("pos"), F.col("class").alias("next"))
        paired = ranked.select("doc_id", "pos", "class").join(later, ["doc_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1)))
        longer = paired.groupBy("class").agg(F.count("*").alias("n"), F.max("next").alias("m")).where("n > 1 AND m >= 0")
        if longer.isEmpty():  # rows of one class are suffixes with nothing left to compare
            return ranked.select("doc_id", "pos", "rk")
        placed = numbered(paired, "class", "next", "doc_id", "pos").withColumn("pair", F.concat_ws(" ", "class", "next")).drop("class")
        ranked, length = stored(run_numbers(placed, "pair", "class").select("doc_id", "pos", "rk", "class")), 2 * length


def bwt(suffixes: DataFrame, docs: DataFrame) -> DataFrame:
    """rk and the character before each suffix; before a document stands the delimiter."""
    previous = F.when(F.col("pos") == 0, F.lit(DELIMITER)).otherwise(F.substring(F.col("text"), F.col("pos"), F.lit(1)))
    return suffixes.select("rk", "doc_id", "pos").join(docs.select("doc_id", "text"), "doc_id").select("rk", "doc_id", "pos", previous.alias("ch"))


def bwt_runs(transformed: DataFrame) -> DataFrame:
    """run_id, ch, start, len, first_pos and last_pos of each maximal run of equal characters."""
    at = F.struct("rk", "pos")
    return run_numbers(transformed, "ch").groupBy("run_id").agg(F.min("ch").alias("ch"), F.min("rk").alias("start"), F.count("*").alias("len"), F.min(at)["pos"].alias("first_pos"), F.max(at)["pos"].alias("last_pos"))


def with_neighbours(suffixes: DataFrame) -> DataFrame:
    """prev_rk and next_rk (of its document's neighbours; null at the ends) and occ, how often its document stands before it in the document array.

    occ is counted in the order of the whole collection, isa in that of the document alone; they agree.
    """
    own = Window.partitionBy("doc_id").orderBy("rk")
    return suffixes.withColumns({"occ": F.row_number().over(own).cast("long") - 1, "prev_rk": F.lag("rk").over(own), "next_rk": F.lead("rk").over(own)})


def run_starts(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the merged runs begin, and the least value of each.

    Greedy from the first row: a run is either the longest stretch of one value, or, if that is a single row, the longest
    stretch of one document. So runs begin where values change, but for those that a stretch of a document, begun by a single
    value, goes over; only these are walked.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), values
    new_value, new_doc = np.append(values[1:] != values[:-1], True), np.append(docs[1:] != docs[:-1], True)  # behind each row
    begins = np.append(True, new_value[:-1])
    ends = np.flatnonzero(new_doc) + 1
    at = np.flatnonzero(begins & new_value & ~new_doc)
    done = 0
    for i, end in zip(at.tolist(), ends[np.searchsorted(ends, at, "right")].tolist(), strict=True):
        if i < done:
            continue
        while True:
            begins[i + 1 : end] = False
            done = end
            if end == n:
                break
            begins[end] = True
            if not new_value[end] or new_doc[end]:
                break
            i, end = end, int(ends[np.searchsorted(ends, end, "right")])
    begins = np.flatnonzero(begins)
    return begins, np.minimum.reduceat(values, begins)


def run_minima(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The least value of the merged run that each row is in."""
    begins, least = run_starts(values, docs)
    return np.repeat(least, np.diff(np.append(begins, len(values))))


def with_merged_runs(rows: DataFrame) -> DataFrame:
    """rows, sorted in each partition, with min_b and min_f: the least ilcp_b and ilcp_f of the merged run that a row is in.

    The merging depends on the order, so rows are walked batch by batch; runs end at the edges of batches, which changes no
    answer, as a run only needs a bound on its values.
    """

    def walk(batches):
        for batch in batches:
            docs = batch.column("doc_id").to_numpy()
            for value, name in (("ilcp_b", "min_b"), ("ilcp_f", "min_f")):
                batch = batch.append_column(name, pa.array(run_minima(batch.column(value).to_numpy(), docs)))
            yield batch

    return rows.mapInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("min_b", T.IntegerType()), T.StructField("min_f", T.IntegerType())]))


def merged_runs(rows: DataFrame, value: str = "ilcp_b") -> DataFrame:
    """run_id, start, len, value: the merged runs over rows(rk, doc_id, value) as one sequence, and the least value of each.

    The greedy merging of run_minima() goes from run to run, so one task walks all rows in order: for reports, not for search.
    """

    def walk(part: pa.Table) -> pa.Table:
        part = part.sort_by("rk")
        begins, least = run_starts(part.column(value).to_numpy(), part.column("doc_id").to_numpy())
        start, size = part.column("rk").to_numpy()[begins], np.diff(np.append(begins, part.num_rows))
        return pa.table([pa.array(np.arange(len(begins))), pa.array(start), pa.array(size), pa.array(least.astype(np.int64))], ["run_id", "start", "len", "value"])

    return rows.select("rk", "doc_id", value, F.lit(0).alias("one")).groupBy("one").applyInArrow(lambda part: walk(part), "run_id long, start long, len long, value long")
