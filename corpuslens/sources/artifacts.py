"""Index tables and reports in folders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str, again: bool = True) -> None:
    """Each table under its name; with again=False, those that are there already stay."""
    for name, df in tables.items():
        df.write.mode("overwrite" if again else "ignore").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/{name}").select(*(f.name for f in spark.createDataFrame([], schema).schema))
    except AnalysisException as missing:
        raise FileNotFoundError(f"the index in {folder} has no table {name!r}") from missing


def info(df: DataFrame, value: str) -> DataFrame:
    """size, min, max and diff_base of a column: what turns its differences into numbers from 0."""
    found = df.agg(F.count(value).alias("size"), F.min(value).alias("min"), F.max(value).alias("max"))
    return found.withColumn("diff_base", F.greatest(F.lit(0), -F.col("min")))


def print_results(found: DataFrame, patterns: DataFrame, path: str) -> None:
    """Text lines: each pattern, and below it `  doc:freq` by document."""
    printed_results(found, patterns).write.mode("overwrite").text(path)


def printed_results(found: DataFrame, patterns: DataFrame) -> DataFrame:
    heads = patterns.select("pattern_id", F.lit(-1).cast("long").alias("doc_id"), F.col("pattern").alias("value"))
    rows = found.select("pattern_id", "doc_id", F.format_string("  %d:%d", "doc_id", "freq").alias("value"))
    return heads.unionByName(rows).orderBy("pattern_id", "doc_id").select("value")


def space(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and bytes of the values of each table: 8 for a long or double, 4 for an int, 1 for a boolean, UTF-8 for a string, those of its elements for an array; a null has none."""
    widths = {"bigint": 8, "double": 8, "int": 4, "float": 4, "boolean": 1}

    def size(name: str, kind: str):
        if kind.startswith("array<"):
            return F.size(F.coalesce(name, F.array())) * widths[kind[6:-1]]
        return F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.when(F.col(name).isNotNull(), widths[kind]).otherwise(0)

    out = None
    for name, df in tables.items():
        row = sum((size(c, kind).cast("long") for c, kind in df.dtypes), F.lit(0).cast("long"))
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).select(F.lit(name).alias("name"), "rows", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def file_space(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name and bytes of the files of each table in a saved index."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}").agg(F.sum("length").alias("bytes")).select(F.lit(name).alias("name"), "bytes")
        out = files if out is None else out.unionByName(files)
    return out


def write_numbers(numbers: DataFrame, path: str) -> None:
    """The column `value` of numbers(i, value), in the order of i, as signed 32-bit little-endian integers in files part-00000, ... that follow each other."""
    spark, at = numbers.sparkSession, spark_path(numbers.sparkSession, path)
    fields = numbers.select("i", F.col("value").cast("int").alias("value")).repartitionByRange("i").sortWithinPartitions("i")

    def pack(batches):
        whole = b"".join(b.column("value").to_numpy(zero_copy_only=False).astype("<i4").tobytes() for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["body"])

    parts = fields.mapInArrow(pack, "body binary").withColumn("part", F.spark_partition_id())
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    for row in parts.toLocalIterator():  # a part at a time
        out = system.create(spark_path(spark, f"{path}/part-{row['part']:05}"))
        out.write(bytearray(row["body"]))
        out.close()


def spark_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """i (from 0) and value of the signed 32-bit little-endian integers in a file or a folder of files; files of any size, record by record."""
    raw = spark.sparkContext.binaryRecords(path, 4)  # the one reader of Spark that splits binary files
    words = raw.zipWithIndex().map(lambda x: (x[1], int.from_bytes(x[0], "little", signed=True)))
    return spark.createDataFrame(words, "i long, value int")


def read_grammar(spark: SparkSession, rules_path: str, sequence_path: str) -> tuple[int, DataFrame, DataFrame]:
    """sigma, rules(var, left, right) and sequence(root_pos, var) of a grammar in two files of 32-bit integers.

    The rules file has the number of terminal symbols, counted with 0, and then two symbols for each rule; the sequence file
    has the symbols that are left. Symbols under that number are terminals, the others rules in order. Terminals and rules
    keep their numbers, so sigma is one less than the count.
    """
    numbers = read_numbers(spark, rules_path)
    count = numbers.where("i = 0").first()["value"]
    pairs = numbers.where("i > 0").groupBy(F.floor((F.col("i") - 1) / 2).alias("rule")).agg(F.max(F.when(F.col("i") % 2 == 1, F.col("value"))).alias("left"), F.max(F.when(F.col("i") % 2 == 0, F.col("value"))).alias("right"))
    rules = pairs.select((F.col("rule") + count).alias("var"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    return count - 1, rules, read_numbers(spark, sequence_path).select(F.col("i").alias("root_pos"), F.col("value").cast("long").alias("var"))


def write_grammar(sigma: int, rules: DataFrame, sequence: DataFrame, rules_path: str, sequence_path: str) -> None:
    """The two files of read_grammar(), for rules whose var rises by one from sigma + 1 on."""
    place = (F.col("var") - sigma - 1) * 2
    both = rules.select((place + 1).alias("i"), F.col("left").alias("value")).unionByName(rules.select((place + 2).alias("i"), F.col("right").alias("value")))
    write_numbers(both.unionByName(rules.sparkSession.createDataFrame([(0, sigma + 1)], "i long, value long")), rules_path)
    write_numbers(sequence.select(F.col("root_pos").alias("i"), F.col("var").alias("value")), sequence_path)


def write_space(sizes: DataFrame, path: str) -> None:
    sizes.orderBy("name").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
