"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a cell is a pair of centroids. A query goes through the
cells by summed distance of its halves to the centroids, with a heap, until they hold a share of all vectors, and those are
reranked by their inner products. How large a share the wanted recall takes is measured on the sample that the codebooks
were fitted on: a few cells where vectors are clustered, many where they are not.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .language_id import unit_hash
from .vectors import BLOCK, best, matrix, ranked, usable

K, QUERY_STEP = 20, 20
#: Centroids for each half; about so many vectors, and numbers in them, fit the codebooks (the only sample here).
CENTROIDS, SAMPLE_ROWS, SAMPLE_NUMBERS, ROUNDS = 64, 20_000, 4_000_000, 10
#: The part of a query's neighbours that its cells must hold, over so many queries of the sample.
RECALL, TRIED = 0.95, 400
#: Queries that a task routes to their cells.
ROUTE_ROWS = 256
FOUND = "query_row long, query_id long, vec_id long, score double"


def means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    centers = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])]
    for _ in range(rounds):
        near = nearest(x, centers)
        centers = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def visited(first: np.ndarray, second: np.ndarray, size: dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
    """Non-empty cells by rising first[i] + second[j], until they hold `enough` vectors."""
    by_first, by_second = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[by_first].tolist(), second[by_second].tolist()
    heap, cells = [(a[0] + b[0], 0, 0)], []
    while heap and enough > 0:
        _, i, j = heapq.heappop(heap)
        if i + 1 < len(a) and j == 0:  # each pair is pushed once: from the left, or from above in the first column
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if n := size.get((by_first[i], by_second[j])):
            cells.append((by_first[i], by_second[j]))
            enough -= n
    return cells


class Codebooks:
    def __init__(self, x: np.ndarray, k: int = CENTROIDS):
        self.half = x.shape[1] // 2
        self.books = [means(y, min(k, len(y))) if y.shape[1] else np.zeros((1, 0)) for y in (x[:, : self.half], x[:, self.half :])]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each half to its centroids, as nearness is measured: how far a centroid's product is under the largest one."""
        products = [y @ b.T for b, y in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True)]
        return [p.max(axis=1, keepdims=True) - p for p in products]


def share_for(books: Codebooks, x: np.ndarray, k: int, recall: float = RECALL, tried: int = TRIED) -> float:
    """The least part of the sample x that cells must hold, in their order, to have `recall` of the k nearest of its vectors, on average.

    A sample is sparser than all vectors, whose nearest are nearer and in earlier cells, so the share serves for those too.
    """
    queries = np.unique(np.linspace(0, len(x) - 1, tried).astype(int))
    a, b = books.cells(x)
    width = len(books.books[1])
    size = np.bincount(a * width + b, minlength=len(books.books[0]) * width)
    first, second = books.distances(x[queries])
    shares = []
    for q, f, s in zip(queries.tolist(), first, second, strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        order = np.argsort((f[:, None] + s[None]).ravel(), kind="stable")
        held = np.empty(len(order), np.int64)
        held[order] = np.cumsum(size[order])
        shares.append(held[a[near] * width + b[near]] / len(x))
    found = np.concatenate(shares) if shares else np.zeros(0)
    return float(np.quantile(found, recall, method="higher")) if len(found) else 1.0


def _encode(books):
    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = books.value.cells(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "v")), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["row", "vec_id", "v", "a", "b"])

    return encode


def _route(books, size, enough: int):
    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, a, bs = [], [], []
            first, second = books.value.distances(matrix(batch.column("v")))
            for row in range(batch.num_rows):
                wanted = {}
                for i, j in visited(first[row], second[row], size.value, enough):
                    wanted.setdefault(i, []).append(j)
                for i, js in wanted.items():
                    rows.append(row), a.append(i), bs.append(js)
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("row", "vec_id", "v")), pa.array(a, pa.int32()), pa.array(bs, pa.list_(pa.int32()))], ["row", "vec_id", "v", "a", "bs"])

    return route


def rerank(q_row, q, wanted, row, vid, v, cell, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, candidate's place and score of the k best of each query in its cells, by inner products summed in a fixed order, so equal vectors score equally."""
    asked = np.zeros((len(q), int(cell.max(initial=0)) + 1), bool)
    for at, js in enumerate(wanted):
        js = np.array(js)
        asked[at, js[js < asked.shape[1]]] = True
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lot in np.array_split(np.arange(len(q)), -(-len(q) * len(v) // 1_000_000)):
        near = np.where(asked[np.ix_(lot, cell)] & (row != q_row[lot, None]), q[lot] @ v.T, -np.inf)
        least = np.partition(near, -k, axis=1)[:, [-k]] if len(v) > k else -np.inf
        i, c = np.nonzero((near >= least - 1e-9 * np.abs(least)) & np.isfinite(near)) if len(v) > k else np.nonzero(np.isfinite(near))
        at, score = lot[i], (q[lot[i]] * v[c]).sum(axis=1)
        keep = best(at, vid[c], score, k)
        found.append((at[keep], c[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rerank(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
        number = lambda t, c: t.column(c).to_numpy()
        vid = number(vectors, "vec_id")
        at, vec, score = rerank(number(queries, "row"), matrix(queries.column("v")), queries.column("bs").to_pylist(), number(vectors, "row"), vid, matrix(vectors.column("v")), number(vectors, "b"), k)
        return pa.table([pa.array(number(queries, "row")[at]), pa.array(number(queries, "vec_id")[at]), pa.array(vid[vec]), pa.array(score)], names)

    return search


def nearest_neighbours(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by query_step, the k largest inner products found.

    Ties go to the smaller vec_id. A query has k rows whenever there are k candidates: if its cells hold too few, the
    traversal goes on. Which rows take part: usable(), without zero vectors. Rows that repeat a vec_id are queries and
    candidates of their own. Vectors of each length have an index of their own.
    """
    spark = embeddings.sparkSession
    vectors = stored(usable(embeddings, np.asarray, zero=False).withColumn("row", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], FOUND)
    for dim, n in sorted(tuple(r) for r in vectors.groupBy("dim").count().collect()):
        found = found.unionByName(_of_one_length(vectors.where(F.col("dim") == dim).select("row", "vec_id", "v"), dim, n, k, query_step, recall))
    return ranked(found, k).drop("query_row")


def _of_one_length(vectors: DataFrame, dim: int, n: int, k: int, query_step: int, recall: float) -> DataFrame:
    spark, most = vectors.sparkSession, min(SAMPLE_ROWS, -(-SAMPLE_NUMBERS // dim))
    drawn = vectors.where(unit_hash("row") < most / n).orderBy("row").toArrow()
    if not drawn.num_rows:
        drawn = vectors.orderBy("row").limit(most).toArrow()
    sample = matrix(drawn.column("v"))
    learned = Codebooks(sample)
    books, enough = spark.sparkContext.broadcast(learned), max(k + 1, round(share_for(learned, sample, k, recall) * n))
    coded = stored(vectors.mapInArrow(_encode(books), "row long, vec_id long, v binary, a int, b int"))
    size = {(r.a, r.b): r["count"] for r in coded.groupBy("a", "b").count().collect()}  # CENTROIDS**2 cells at most
    lists = {i: sum(c for (a, _), c in size.items() if a == i) for i, _ in size}
    parts = F.create_map(*(F.lit(x) for i, c in sorted(lists.items()) for x in (i, -(-c // BLOCK))))
    routed = coded.where(F.col("vec_id") % query_step == 0).select("row", "vec_id", "v").repartition(-(-n // (ROUTE_ROWS * query_step)), "row").mapInArrow(_route(books, spark.sparkContext.broadcast(size), enough), "row long, vec_id long, v binary, a int, bs array<int>")
    blocks = max(1, -(-n // (BLOCK * query_step)))
    own = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    count = F.element_at(parts, F.col("a"))
    queries = routed.withColumns({"block": own(F.lit(blocks)), "part": each(count)})
    against = coded.withColumns({"part": own(count), "block": each(F.lit(blocks))})
    key = ["a", "block", "part"]
    return queries.groupBy(*key).cogroup(against.groupBy(*key)).applyInArrow(_rerank(k), FOUND)


def op9_ann(spark, sf_dir: str) -> DataFrame:
    """Each query's 20 nearest rows of embeddings found by the index; which rows take part, and ties, as in nearest_neighbours()."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
