"""Collections and patterns from files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import numbered, running_sum

#: Ends a document; stands between the sequences of one document.
DOCUMENT_END, SEQUENCE_BREAK = "\u0000", "\u0018"


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (from 0, in file order) and text of the documents in one file, each ended by a zero byte; the last one needs none.

    Empty documents keep their number. The reader splits the file, so it may be larger than a task's memory.
    """
    lines = spark.read.option("lineSep", DOCUMENT_END).text(path)
    return numbered(lines.select(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text")), "_block", "_row", name="doc_id").select("doc_id", "text")


def split_collection(text: Column) -> Column:
    """An array of the documents in one string."""
    parts = F.split(text, DOCUMENT_END, -1)
    return F.when(F.endswith(text, F.lit(DOCUMENT_END)), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def borders(collection: DataFrame, index: str = "pos", symbol: str = "ch") -> DataFrame:
    """collection(pos, ch) with doc_id: the delimiters before each position."""
    ends = (F.col(symbol) == DOCUMENT_END).cast("int")
    return running_sum(collection, ends, "_n", index).withColumn("doc_id", (F.col("_n") - ends).cast("long")).drop("_n")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id (from 0) and pattern of each line that isn't empty, in order; repeated ones stay."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_row"), F.col("value").alias("pattern")).where("pattern <> ''")
    return numbered(lines, "_row", name="pattern_id").select("pattern_id", "pattern")


def patterns_of(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")


def read_fasta(spark: SparkSession, folder: str, most_sequences: int | None = None) -> DataFrame:
    """doc_id and text of each *.fasta file below the folder, in path order: headers and line ends go, a break stands between sequences."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.fasta").select(F.col("_metadata.file_path").alias("_path"), "value")
    parts = F.filter(F.split(F.concat(F.lit("\n"), "value"), r"\r?\n>[^\n]*"), lambda s: F.length(F.regexp_replace(s, r"\s", "")) > 0)
    parts = parts if most_sequences is None else F.slice(parts, 1, most_sequences)
    text = F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, r"[\r\n]", "")), SEQUENCE_BREAK)
    return numbered(files.select("_path", text.alias("text")), "_path", name="doc_id").select("doc_id", "text")


def sample_patterns(docs: DataFrame, each: int = 1, lengths: tuple[int, ...] = (8, 12, 16), seed: int = 0) -> DataFrame:
    """doc_id, i, pattern: `each` substrings of every document, their place and length set by a hash; none with a break.

    The hash is the first 32 bits of the md5 of "doc_id i seed", so the sample is the same everywhere.
    """
    numbered_ = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i"))
    draw = F.conv(F.left(F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("i").cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("long")
    drawn = numbered_.withColumn("_h", draw).withColumn("_n", F.element_at(F.array(*map(F.lit, lengths)), (F.col("_h") % len(lengths) + 1).cast("int")))
    room = F.length("text") - F.col("_n") + 1
    cut = drawn.where(room > 0).withColumn("pattern", F.substring(F.col("text"), (F.floor(F.col("_h") / len(lengths)) % room + 1).cast("int"), F.col("_n")))
    return cut.where(~F.contains("pattern", F.lit(SEQUENCE_BREAK)) & ~F.contains("pattern", F.lit(DOCUMENT_END))).select("doc_id", "i", "pattern")
