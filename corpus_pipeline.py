"""Cleans, deduplicates, mixes and packs the documents table: five stages, each by one operator of corpuslens.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import release, stored
from corpuslens.llm.language_id import identify, learn
from corpuslens.llm.line_dedup import line_dedup
from corpuslens.llm.mixing import mix
from corpuslens.llm.packing import pack, written_order
from corpuslens.llm.simhash import near_copies


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars as the text has it now."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None
    return docs.select(*(size.alias(c) if c == "n_chars" else c for c in columns))


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject, as they are.

    It rejects null texts, texts without a letter, and texts far from every language in `lang`, for their number of n-grams.
    With no labelled row there is nothing to be far from, so only the first two go. Rows are judged one by one.
    """
    model = learn(docs)
    found = identify(docs, model)
    keep = ~F.col("_cl_rejected") if model.langs else F.col("text").rlike(r"\p{L}")
    return found.where(keep).select(*docs.columns)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand elsewhere before; one that loses all of them stays, with empty text.

    Null texts stay null; an empty one is one empty line and stays. Rows that repeat doc_id and text are one document.
    """
    return _measured(line_dedup(docs), docs.columns)


def near_duplicate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that of the smallest doc_id.

    A null doc_id comes after all others, and of one doc_id's texts the one with the least hash is first. Rows that share a
    doc_id but not their text are documents of their own; of rows that repeat both, one stays. Null and empty texts, and
    texts of spaces only, are one group.
    """
    found = near_copies(docs)
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("f"))
    key = lambda doc, mark: {"_cl_id": F.coalesce(doc, F.lit(0)), "_cl_null": doc.isNull(), "_cl_mark": mark}
    stay = first.select(*(c.alias(name) for name, c in key(F.col("f.doc_id"), F.col("f.mark")).items()))
    named = docs.withColumns(key(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(stay, ["_cl_id", "_cl_null", "_cl_mark"])
    same = Window.partitionBy("_cl_id", "_cl_null", "_cl_mark").orderBy("_cl_mark")
    return named.withColumn("_cl_row", F.row_number().over(same)).where("_cl_row = 1").select(*docs.columns)


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order in which they are due; where a source's target ends, a text is cut.

    Null, empty and blank texts have no words and are never taken; a null source is one source. Rows that repeat a doc_id
    are documents of their own.
    """
    return _measured(mix(docs), docs.columns)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences that they are packed into, in the order in which documents are due.

    The stage before wrote its rows in that order, and their places in its files keep it: sequence_id rises with the due
    times of groups of neighbouring pieces. Documents that come from no file are in the order of doc_id. Null and empty
    texts are a piece of one token; texts of any length are cut into full windows.
    """
    return pack(docs, by=written_order(docs))


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicate), ("mixing to target weights", mixing), ("packing", packing)]
#: Learned language models, hashes of tokens and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents table; each stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir)), docs
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
