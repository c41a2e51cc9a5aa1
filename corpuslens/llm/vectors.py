"""What the two vector searches share: usable vectors, and query blocks against candidate parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a query block and of a candidate part, at most on average.
BLOCK = 16_384
VECTORS = "vec_id long, dim int, length double, v binary"


def usable(embeddings: DataFrame, convert: Callable[[np.ndarray], np.ndarray], zero: bool) -> DataFrame:
    """vec_id, dim, length and v (bytes of convert(vector as doubles), and the norm of that) of the rows that take part.

    Null vectors, those with null or non-finite components, also after convert, those of no components and, unless `zero`,
    zero vectors don't; nor does a null vec_id, which no result could name. Rows that repeat a vec_id are rows of their own.
    """

    def read(batches):
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten()
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(size[named & (size > 0)]).tolist():
                rows = np.flatnonzero(named & (size == dim))
                own = x[first[rows][:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    out = np.ascontiguousarray(convert(own), np.float64)
                good = np.isfinite(own).all(axis=1) & np.isfinite(out).all(axis=1)
                if not zero:
                    good &= own.any(axis=1)
                rows, out = rows[good], out[good]
                packed = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer((np.arange(len(out) + 1) * 8 * dim).astype(np.int32)), pa.py_buffer(out.tobytes())])
                largest = np.maximum(np.abs(out).max(axis=1, initial=0), 1e-300)  # so that squares don't overflow
                length = np.linalg.norm(out / largest[:, None], axis=1) * largest
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(length), packed], ["vec_id", "dim", "length", "v"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, VECTORS)


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries: highest score, then least vec."""
    if score.dtype == object:  # integers of any size
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], vec[i])), np.int64)
    else:
        order = np.lexsort((vec, -score, query))
    query = query[order]
    begins = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else order
    rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
    return order[rank < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_row and the k best of found(query_row, query_id, vec_id, score) for each, with their rank from 1."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
