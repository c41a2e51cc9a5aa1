"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Each source has a weight that runs linearly from a start to an end value over the training time 0..1. Its integral sets the
source's target. A document takes a stretch of its source's words, in hash order, in each pass over the source; inverting
the source's cumulative demand gives the time at which that stretch is due, and rows are range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Start and end weight of the sources in code-point order, repeating; the means are 5, 2 and 1.
SCHEDULES = ((6.5, 3.5), (2.0, 2.0), (0.5, 1.5))
#: Times that a source may be used, and rows that share a running sum, at most on average.
MOST_PASSES, BUCKET_ROWS = 3, 2_000
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def _targets(sizes: DataFrame, schedules, passes: int) -> DataFrame:
    """_cl_target and _cl_bend of each _cl_source(_cl_source_size): shares of the sum by weight, none over its cap.

    With sources in the order of cap by weight, the level of a share for each weight is largest at the first one under its
    cap, if all before it have theirs; so no rounds are needed.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_cl_null"), "_cl_source")) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("_cl_rank"), F.lit(len(values))) + 1).cast("int"))
    weighed = sizes.withColumn("_cl_rank", rank).withColumns({"_cl_w": pick([(a + b) / 2 for a, b in schedules]), "_cl_bend": pick([(b - a) / (a + b) for a, b in schedules]), "_cl_cap": F.lit(passes) * F.col("_cl_source_size")})
    all_, by = Window.partitionBy(), Window.orderBy(F.col("_cl_cap") / F.col("_cl_w"), "_cl_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by), F.lit(0))
    level = (F.sum("_cl_source_size").over(all_) - before("_cl_cap")) / (F.sum("_cl_w").over(all_) - before("_cl_w"))
    return weighed.withColumn("_cl_level", level).withColumn("_cl_target", F.least(F.col("_cl_cap").cast("double"), F.col("_cl_w") * F.max("_cl_level").over(all_))).select("_cl_source", "_cl_source_size", "_cl_target", "_cl_bend")


def _due(share: Column, bend: Column) -> Column:
    """The time by which `share` of the demand has come, for the weight 1 + bend * (2t - 1)."""
    root = F.sqrt(F.greatest((1 - bend) * (1 - bend) + 4 * bend * share, F.lit(0.0)))
    return F.when(bend == 0, share).otherwise((root - (1 - bend)) / (2 * bend))


def mixing_plan(docs: DataFrame, columns: list[str] | None = None, schedules=SCHEDULES, passes: int = MOST_PASSES) -> DataFrame:
    """The given columns of docs(doc_id, text, source, ...), all by default, with what the mix does with each row.

    _cl_size: the text's words (null: 0). _cl_source_size and _cl_target: of its source. _cl_taken: the words the mix takes,
    repeats counted. _cl_copies: an array of (pass, words, due) with the stretches taken. Names with _cl_ are reserved. A
    source takes whole documents in the order of a hash of doc_id and text, pass after pass, and cuts the last one where its
    target is met. A null source is one source, after all others. Rows that repeat a doc_id are documents of their own; rows
    that repeat doc_id and text are exchangeable. With no words at all, every target is 0. Long texts are counted whole, in
    the JVM.
    """
    columns = columns or docs.columns
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    source = F.col("source").cast("string")
    place = F.shiftright("_cl_hash", 28)
    known = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    hashed = F.conv(F.left(known, F.lit(15)), 16, 10).cast("long")
    sized = docs.select(*columns, source.isNull().alias("_cl_null"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("_cl_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_cl_size"), hashed.alias("_cl_hash"))
    sized = sized.withColumn("_cl_bucket", F.shiftright(place * buckets, 32))
    parts = stored(sized.groupBy("_cl_source", "_cl_null", "_cl_bucket").agg(F.sum("_cl_size").alias("_cl_part")))  # used twice
    targets = _targets(parts.groupBy("_cl_source", "_cl_null").agg(F.sum("_cl_part").alias("_cl_source_size")), schedules, passes)
    earlier = Window.partitionBy("_cl_source").orderBy("_cl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_cl_base", F.coalesce(F.sum("_cl_part").over(earlier), F.lit(0))).drop("_cl_null", "_cl_part").join(targets, "_cl_source")
    inside = Window.partitionBy("_cl_source", "_cl_bucket").orderBy("_cl_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_cl_before", F.coalesce(F.sum("_cl_size").over(inside), F.lit(0))).join(parts, ["_cl_source", "_cl_bucket"])
    quota = F.floor("_cl_target")
    begin = lambda p: F.lit(p) * F.col("_cl_source_size") + F.col("_cl_base") + F.col("_cl_before")
    words = lambda p: F.greatest(F.least(quota - begin(p), F.col("_cl_size")), F.lit(0))
    copies = F.array(*(F.struct(F.lit(p).alias("pass"), words(p).alias("words"), _due(begin(p) / F.greatest(F.col("_cl_target"), F.lit(1.0)), F.col("_cl_bend")).alias("due")) for p in range(passes)))
    return placed.withColumns({"_cl_taken": sum((words(p) for p in range(1, passes)), words(0)), "_cl_copies": F.filter(copies, lambda c: c["words"] > 0)}).select(*columns, "_cl_size", "_cl_source_size", "_cl_target", "_cl_taken", "_cl_copies", "_cl_hash")


def mix(docs: DataFrame, columns: list[str] | None = None, schedules=SCHEDULES, passes: int = MOST_PASSES) -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by the time they are due (_cl_due); a cut row's text has its first words.

    Defined as mixing_plan(); a document of no words is never taken.
    """
    columns = columns or docs.columns
    plan = mixing_plan(docs, list(dict.fromkeys([*columns, "text"])), schedules, passes)
    taken = plan.withColumn("_cl_copy", F.explode("_cl_copies"))
    cut = F.array_join(F.slice(F.filter(F.split("text", SPACE), lambda w: w != ""), 1, F.col("_cl_copy.words").cast("int")), " ")
    text = F.when(F.col("_cl_copy.words") == F.col("_cl_size"), F.col("text")).otherwise(cut)
    out = taken.withColumn("text", text).select(*columns, F.col("_cl_copy.due").alias("_cl_due"), "_cl_hash")
    return out.orderBy("_cl_due", "_cl_hash").drop("_cl_hash")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in the order in which documents are due first; nulls and repeated rows as in mixing_plan()."""
    plan = mixing_plan(table(spark, sf_dir, "documents"), ["doc_id"])
    due = F.try_element_at("_cl_copies", F.lit(1))["due"]
    out = plan.select("doc_id", F.col("_cl_size").alias("size"), F.col("_cl_source_size").alias("source_size"), F.col("_cl_target").alias("target"), F.col("_cl_taken").alias("taken"), due.alias("first_due"))
    return out.orderBy(F.col("first_due").asc_nulls_last(), "doc_id")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
               CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 15) AS BIGINT) AS h FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][rank % 3 + 1] AS w, [-0.3::DOUBLE, 0.0, 0.5][rank % 3 + 1] AS bend, 3 * source_size AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
           FROM weighed WINDOW before AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target FROM levels),
placed AS (SELECT s.*, t.* EXCLUDE (source), CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
           FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (SELECT *, list_sum(list_transform([0, 1, 2], lambda p: greatest(least(CAST(floor(target) AS BIGINT) - p * source_size - before, size), 0))) AS taken, before / greatest(target, 1.0) AS share FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken = 0 THEN NULL WHEN bend = 0 THEN share ELSE (sqrt(greatest((1 - bend) * (1 - bend) + 4 * bend * share, 0.0)) - (1 - bend)) / (2 * bend) END AS first_due FROM taking"""
