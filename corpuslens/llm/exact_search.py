"""Exact top-k by inner product: norm-bucketed retrieval.

Candidates are dealt by length: the longest ones are a part, the next ones another, and so on. Every query searches the part
with the longest; its k-th score there decides to which other parts it goes at all. In a part, a query goes through buckets
from the longest vectors down; the k-th score so far gives each bucket a local cosine threshold. Over 1 it rules the bucket
out; if it leaves few candidates by their value in the query's largest coordinate, only those are verified (coordinate
pruning); else those that are long enough (length pruning). Verified products are exact integers.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .common import release, stored, table
from .vectors import BLOCK, best, matrix, ranked, usable

K, QUERY_STEP, SCALE = 20, 20, 64
#: Vectors of a bucket, and the part of them up to which coordinate pruning is chosen.
BUCKET, FEW = 512, 0.25
#: Scores travel with so many digits; what is larger is cut to them, and to a long in the result.
DIGITS, LONG = 38, 2**63 - 1
FOUND = f"query_row long, query_id long, vec_id long, score decimal({DIGITS},0)"


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


def whole_numbers(x: np.ndarray, most: float) -> np.ndarray:
    """Integers in doubles as what holds products up to `most` exactly: doubles, longs, or Python's integers."""
    if most < 2**53:
        return x
    return x.astype(np.int64) if most < 2**62 else np.array([int(c) for c in x.ravel()], object).reshape(x.shape)


def search_part(q_row: np.ndarray, q: np.ndarray, q_length: np.ndarray, kth: np.ndarray, row: np.ndarray, vid: np.ndarray, v: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, candidate's place and score of the k best candidates of each query, without its own row.

    kth: what a score must reach for each query, -inf if nothing is known.
    """
    order = np.lexsort((vid, -length))
    row, vid, v, length = row[order], vid[order], v[order], length[order]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    qk, vk = whole_numbers(q, most), whole_numbers(v, most)
    kind = qk.dtype if qk.dtype == object else np.int64
    unit = q / np.maximum(q_length, 1e-300)[:, None]
    focus = np.abs(unit).argmax(axis=1)
    angle = np.arccos(np.clip(unit[np.arange(len(q)), focus], -1, 1))
    kth = kth.copy()
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
    for at in range(0, len(v), BUCKET):
        own, top = slice(at, min(at + BUCKET, len(v))), length[at]
        going = np.flatnonzero(q_length * (top * (1 + 1e-9)) + 1e-9 >= kth)
        if not len(going):
            break  # the rest is no longer
        limit = np.where(kth[going] > 0, kth[going] / np.maximum(q_length[going] * top, 1e-300), -1.0).clip(-1, 1)
        spread = np.arccos(np.clip(limit - 1e-9, -1, 1))
        low, high = np.cos(np.minimum(angle[going] + spread, np.pi)) - 1e-9, np.cos(np.maximum(angle[going] - spread, 0)) + 1e-9
        units, sorted_by = v[own] / np.maximum(length[own], 1e-300)[:, None], {}
        pick, rows, columns = [], [], []
        for i, g in enumerate(going.tolist()):
            f = int(focus[g])
            if limit[i] <= 0:
                pick.append(g)
                continue
            if f not in sorted_by:
                by = np.argsort(units[:, f])
                sorted_by[f] = by, units[by, f]
            by, values = sorted_by[f]
            a, b = np.searchsorted(values, low[i]), np.searchsorted(values, high[i], "right")
            if b - a > FEW * len(values) or length[own.stop - 1] == 0:
                pick.append(g)
            elif b > a:
                rows.append(np.full(b - a, g)), columns.append(by[a:b] + at)
        hits = []
        if pick:
            pick = np.array(pick)
            product = qk[pick] @ vk[own].T
            i, j = np.nonzero(product >= kth[pick, None])
            hits.append((pick[i], j + at, product[i, j].astype(kind)))
        if rows:
            i, j = np.concatenate(rows), np.concatenate(columns)
            product = (qk[i] * vk[j]).sum(axis=1) if kind == object else np.einsum("ij,ij->i", qk[i], vk[j])
            hits.append((i, j, product.astype(kind)))
        i, j, score = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else held
        fresh = (score >= kth[i]).astype(bool) & (row[j] != q_row[i])
        held = tuple(np.concatenate(x) for x in zip(held, (i[fresh], j[fresh], score[fresh]), strict=True))
        keep = best(held[0], vid[held[1]], held[2], k)
        held = tuple(x[keep] for x in held)
        n = np.bincount(held[0], minlength=len(q))
        full = n >= k
        now = held[2][np.cumsum(n)[full] - 1].astype(float)
        kth[full] = np.where(np.abs(now) < 2**53, now, np.nextafter(now, -np.inf))  # not above the integer
    return held[0], order[held[1]], held[2]


def _scores(score: np.ndarray) -> pa.Array:
    if score.dtype != object:
        return pa.array(score).cast(pa.decimal128(DIGITS, 0))
    most = 10**DIGITS - 1
    return pa.array([Decimal(max(-most, min(most, x))) for x in score.tolist()], pa.decimal128(DIGITS, 0))


def _search(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.decimal128(DIGITS, 0))], ["query_row", "query_id", "vec_id", "score"])
        number = lambda t, c: t.column(c).to_numpy()
        at, vec, score = search_part(number(queries, "rk"), matrix(queries.column("v")), number(queries, "length"), number(queries, "least"), number(vectors, "rk"), number(vectors, "vec_id"), matrix(vectors.column("v")), number(vectors, "length"), k)
        return pa.table([pa.array(number(queries, "rk")[at]), pa.array(number(queries, "vec_id")[at]), pa.array(number(vectors, "vec_id")[vec]), _scores(score)], ["query_row", "query_id", "vec_id", "score"])

    return search


def exact_top_k(embeddings: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best by inner product of floor(64 * x) vectors, for each row whose vec_id is divisible by query_step.

    A query meets the parts that its threshold leaves, in blocks of queries; ties go to the smaller vec_id. Which rows take
    part: usable(). Rows that repeat a vec_id are queries and candidates of their own. Vectors of different lengths are never
    compared. Products are exact at any size; a score that no long holds is returned as the nearest long.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())  # equal rows may be dealt to several tasks
    placed = numbered(usable(embeddings, integers, zero=True).withColumn("tie", tie), "dim", F.desc("length"), "vec_id", "tie")
    vectors = stored(placed.drop("tie").withColumn("part", F.floor(F.col("rk") / BLOCK)))
    release(placed)
    blocks = max(1, -(-vectors.where(F.col("vec_id") % query_step == 0).count() // BLOCK))
    parts = vectors.groupBy("dim", "part").agg(F.max("length").alias("top"))
    ends = parts.groupBy("dim").agg(F.min("part").alias("part"), F.max("part").alias("last"))  # a row for each length of vectors
    longest = ends.select("dim", "part")
    asked = vectors.where(F.col("vec_id") % query_step == 0).withColumn("block", F.pmod(F.xxhash64("rk"), F.lit(blocks)).cast("int")).drop("part")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    key = ["dim", "part", "block"]

    def searched(queries: DataFrame, among: DataFrame) -> DataFrame:
        among = among.withColumn("block", each)
        return queries.groupBy(*key).cogroup(among.toDF(*among.columns).groupBy(*key)).applyInArrow(_search(k), FOUND)

    first = stored(searched(asked.join(longest, "dim").withColumn("least", F.lit(float("-inf"))), vectors.join(longest, ["dim", "part"], "left_semi")))
    kth = ranked(first, k).where(F.col("rank") == k).select(F.col("query_row").alias("rk"), F.col("score").cast("double").alias("kth"))
    slack = F.lit(1 + 1e-9)
    known = asked.join(kth, "rk", "left").withColumn("least", F.when(F.col("kth").isNull(), F.lit(float("-inf"))).otherwise(F.col("kth") - F.abs("kth") * F.lit(1e-12))).drop("kth")
    others = known.join(ends.where("last > part"), "dim").withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("last")))).drop("last")
    going = others.join(parts, ["dim", "part"]).where(F.col("length") * F.col("top") * slack + F.lit(1e-9) >= F.col("least")).drop("top")
    found = ranked(first.unionByName(searched(going, vectors.join(longest, ["dim", "part"], "left_anti"))), k)
    score = F.greatest(F.least("score", F.lit(Decimal(LONG))), F.lit(Decimal(-LONG - 1))).cast("long")
    return found.select("query_id", "rank", "vec_id", score.alias("score"))


def op8_exact_search(spark, sf_dir: str) -> DataFrame:
    """Each query's 20 best rows of embeddings by inner product of floor(64 * x); which rows take part, and ties, as in exact_top_k()."""
    return exact_top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH whole AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.row <> c.row),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20"""
