"""Listing over a stream of new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences


def stream_listing(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern_id, doc_id, freq of each new document of a streaming docs(doc_id, text); stateless, so any output mode but complete works."""
    if not all(patterns):
        raise ValueError("a pattern must have a character")
    known = F.array(*(F.struct(F.lit(i).cast("long").alias("pattern_id"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)))
    pairs = docs.select("doc_id", "text", F.explode(known).alias("p")).where(F.contains("text", "p.pattern"))
    return pairs.select("p.pattern_id", "doc_id", occurrences(F.col("text"), F.col("p.pattern")).alias("freq"))


def stream_totals(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern_id, documents and occurrences so far: a running aggregate with one row of state for each pattern."""
    return stream_listing(docs, patterns).groupBy("pattern_id").agg(F.count("*").alias("documents"), F.sum("freq").alias("occurrences"))
