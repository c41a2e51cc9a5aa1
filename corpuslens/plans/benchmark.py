"""Times every plan on the patterns of a file, for one or more collections; writes counters as CSV and, if asked, the results.

    python -m corpuslens.plans.benchmark --patterns patterns.txt --data documents.parquet [--data more.parquet] --out folder [--plans suffix,preagg] [--block-size 512] [--storing-factor 4] [--print-result]
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK_SIZE, STORING_FACTOR
from ..sources.artifacts import print_results, space, write_space
from ..sources.collections import patterns_of, read_delimited, read_patterns
from .index import DocIndex, build
from .strategies import STRATEGIES, search

COUNTERS = "collection string, name string, seconds double, patterns long, size_bytes long, bits_x_symbol double, time_x_pattern double"
#: The tables and columns that each family of plans reads.
_MATCH = ["rk", "doc_id", "pos", "key"]
_NEEDS = {"suffix": _MATCH, "sada": [*_MATCH, "prev_rk", "next_rk"], "ilcp": [*_MATCH, "ilcp_b", "ilcp_f"], "cilcp": [*_MATCH, "min_b", "min_f"], "gcda": _MATCH, "preagg": [*_MATCH, "isa", "block"]}


def sizes(index: DocIndex, strategy: str) -> dict[str, DataFrame]:
    """What a plan reads, by name."""
    if strategy == "scan":
        return {"docs": index.docs}
    family, _, place = strategy.partition("_")
    columns = _NEEDS[family] + {"isa": ["isa"], "rank": ["occ"]}.get(place, [])
    extra = {"gcda": {"grammars": index.grammars}, "preagg": {"nodes": index.nodes, "sampled": index.sampled}}.get(family, {})
    return {"rows": index.rows.select(*dict.fromkeys(columns))} | extra


def measure(index: DocIndex, patterns: DataFrame, strategies: Iterable[str], collection: str = "", results: str | None = None) -> DataFrame:
    """COUNTERS for each plan; with a folder for results, also the documents and frequencies of each pattern as text."""
    spark = index.rows.sparkSession
    symbols = index.docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    number, rows = patterns.count(), []
    search(index, patterns_of(spark, ["warm-up"])).write.format("noop").mode("overwrite").save()
    for name in strategies:
        began = time.time()
        found = search(index, patterns, name)
        found.write.format("noop").mode("overwrite").save()
        seconds = time.time() - began
        size = space(sizes(index, name)).agg(F.sum("bytes")).first()[0] or 0
        rows.append((collection, name, seconds, number, size, 8.0 * size / max(1, symbols), seconds / max(1, number)))
        if results:
            print_results(found, patterns, f"{results}/result-{name}")
    return spark.createDataFrame(rows, COUNTERS)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.partition("\n")[0])
    parser.add_argument("--patterns", required=True, help="a text file, one pattern a line")
    parser.add_argument("--data", required=True, action="append", help="a Parquet table (doc_id, text), or a file of documents ended by zero bytes; again for more collections")
    parser.add_argument("--out", required=True)
    parser.add_argument("--plans", default=",".join(["scan", *STRATEGIES]))
    parser.add_argument("--block-size", type=int, default=BLOCK_SIZE)
    parser.add_argument("--storing-factor", type=int, default=STORING_FACTOR)
    parser.add_argument("--print-result", action="store_true")
    said = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("benchmark").getOrCreate()
    patterns = read_patterns(spark, said.patterns)
    for at, data in enumerate(said.data):
        docs = spark.read.parquet(data).select(F.col("doc_id").cast("long").alias("doc_id"), "text") if data.rstrip("/").endswith(".parquet") else read_delimited(spark, data)
        index = build(docs, block_size=said.block_size, storing_factor=said.storing_factor)
        folder = f"{said.out}/{at}"
        index.save(f"{folder}/index")
        write_space(space({"docs": index.docs, "rows": index.rows, "sampled": index.sampled, "nodes": index.nodes, "grammars": index.grammars}), f"{folder}/breakdown")
        measure(index, patterns, said.plans.split(","), data, folder if said.print_result else None).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/counters")


if __name__ == "__main__":
    main()
