"""The index of a collection: its tables, built once, written to a folder and read back."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.blocks import ARITY, BLOCK_SIZE, NODES, STORING_FACTOR, node_lists, sampled_nodes
from ..operators.compressed import GRAMMARS, STRETCH, grammars
from ..operators.shards import SHARD
from ..operators.suffixes import KEY_LENGTH, suffix_array, with_merged_runs, with_neighbours
from ..sources.artifacts import load, save
from ..storage import release, stored

#: Rows of a partition of the index, and bytes of a row group, whose key ranges are skipped.
PARTITION_ROWS, ROW_GROUP = 1 << 22, 8 << 20


@dataclass(frozen=True)
class DocIndex:
    """docs(doc_id, text), rows (schemas.INDEX), sampled nodes and their lists (NODES), grammars (GRAMMARS); keys of key_length characters."""

    docs: DataFrame
    rows: DataFrame
    sampled: DataFrame
    nodes: DataFrame
    grammars: DataFrame
    key_length: int = KEY_LENGTH
    block_size: int = BLOCK_SIZE
    stretch: int = STRETCH

    def save(self, folder: str) -> None:
        numbers = {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), int)}
        tables = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in numbers}
        save(tables | {"docs": self.docs.select("doc_id", "text"), "parameters": self.rows.sparkSession.createDataFrame([tuple(numbers.values())], ", ".join(f"{n} int" for n in numbers))}, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> DocIndex:
        parameters = load(spark, folder, "parameters", "key_length int, block_size int, stretch int").first()
        return cls(load(spark, folder, "docs", schemas.DOCUMENTS), load(spark, folder, "rows", schemas.INDEX), load(spark, folder, "sampled", "level int, node long"), load(spark, folder, "nodes", NODES), load(spark, folder, "grammars", GRAMMARS), *parameters)


@dataclass(frozen=True)
class Shards:
    """docs(doc_id, text), indexed in shards of about so many characters, each when a query reads it; nothing is stored."""

    docs: DataFrame
    key_length: int = KEY_LENGTH
    block_size: int = BLOCK_SIZE
    storing_factor: int = STORING_FACTOR
    stretch: int = STRETCH
    characters: int = SHARD

    def dealt(self) -> DataFrame:
        """The documents as they are read, or dealt to all tasks if they come in fewer partitions."""
        context, docs = self.docs.sparkSession.sparkContext, self.docs.select("doc_id", "text")
        if docs.rdd.getNumPartitions() >= context.defaultParallelism:
            return docs
        tasks = max(context.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return docs.repartition(tasks, F.xxhash64("doc_id", F.length("text")))


def index_of(docs: DataFrame, rows: DataFrame, key_length: int, block_size: int = BLOCK_SIZE, storing_factor: int = STORING_FACTOR, stretch: int = STRETCH) -> DocIndex:
    """The index over rows (schemas.INDEX) that are there already."""
    sampled = sampled_nodes(rows, rows.count(), block_size, ARITY, storing_factor)
    return DocIndex(docs.select("doc_id", "text"), rows, sampled, node_lists(rows, sampled, block_size), stored(grammars(rows, stretch)), key_length, block_size, stretch)


def index_rows(docs: DataFrame, key_length: int = KEY_LENGTH, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The rows (schemas.INDEX) of docs(doc_id, text), stored in the order of rk, which is that of the keys."""
    ordered = suffix_array(docs, key_length, with_merged_runs)
    n = ordered.count()
    parts = max(1, -(-n // PARTITION_ROWS), min(docs.sparkSession.sparkContext.defaultParallelism, n // ROW_GROUP))
    rows = with_neighbours(ordered).withColumn("block", F.floor(F.col("rk") / block_size))
    placed = rows.repartitionById(parts, F.floor(F.col("rk") * parts / n).cast("int")) if n else rows  # a partition is a range of rk
    out = stored(placed.sortWithinPartitions("rk").select("rk", "doc_id", "pos", "key", "isa", "occ", "prev_rk", "next_rk", "ilcp_b", "ilcp_f", "min_b", "min_f", "block"), **{"parquet.block.size": ROW_GROUP})
    release(ordered)
    return out


def build(docs: DataFrame, key_length: int = KEY_LENGTH, block_size: int = BLOCK_SIZE, storing_factor: int = STORING_FACTOR, stretch: int = STRETCH) -> DocIndex:
    """The index of docs(doc_id, text): unique doc_ids; empty documents keep theirs and never match."""
    return index_of(docs, index_rows(docs, key_length, block_size), key_length, block_size, storing_factor, stretch)
