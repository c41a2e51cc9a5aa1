"""Line dedup by content-defined chunks.

A rolling hash over the hashes of neighbouring lines sets the chunk boundaries: a chunk ends where the hash is least among its
neighbours, so the same lines give the same chunks wherever they stand, and no chunk of a text with several lines is a
single line. Chunks that occur more than once anywhere go, but for their first occurrence; hashes only pick candidates, and
bytes decide.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, sliced, stored, table

#: Lines in the rolling hash, its factor and modulus, and the least lines of a chunk.
ROLL, FACTOR, MODULUS, MIN_LINES = 2, 31, 1_000_003, 2


def chunks(text: bytes, roll: int = ROLL, least: int = MIN_LINES) -> list[tuple[bytes, int]]:
    """The text's chunks and their line counts; joined by newlines, they are the text.

    A chunk ends with a line whose rolling hash is under those of the least - 1 lines before it and not over those of as
    many lines behind it. So each has `least` lines or more, or is the whole text.
    """
    lines = text.split(b"\n")
    n, reach = len(lines), least - 1
    hashes = np.fromiter((int.from_bytes(md5(x, usedforsecurity=False).digest()[:4]) for x in lines), np.int64, n)
    rolling = np.zeros(n, np.int64)
    for j in range(min(roll, n)):
        rolling[j:] += FACTOR**j * hashes[: n - j]
    rolling %= MODULUS
    ends = np.zeros(n, bool)
    if n > 2 * reach + 1:
        here = slice(reach, n - 1 - reach)
        ends[here] = True
        for j in range(1, reach + 1):
            ends[here] &= (rolling[here] < rolling[reach - j : n - 1 - reach - j]) & (rolling[here] <= rolling[reach + j : n - 1 - reach + j])
    ends[n - 1] = True
    at = np.flatnonzero(ends).tolist()
    return [(b"\n".join(lines[a:b]), b - a) for a, b in zip([0, *(x + 1 for x in at[:-1])], (x + 1 for x in at), strict=True)]


def _hashes(roll: int, least: int):
    def hashes(batches):
        for batch in sliced(batches):
            doc, mark, at, value = [], [], [], []
            for d, m, text in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for i, (body, n) in enumerate(chunks(text, roll, least) if text else ()):
                    if n >= least:
                        doc.append(d), mark.append(m), at.append(i), value.append(xxhash.xxh64_intdigest(body))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(at, pa.int32()), pa.array(np.array(value, np.uint64).view(np.int64))], ["doc", "mark", "at", "h"])

    return hashes


def _bodies(roll: int, least: int):
    def bodies(batches):
        for batch in sliced(batches):
            doc, mark, at, body = [], [], [], []
            for d, m, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                own = chunks(text, roll, least)
                for i in wanted:
                    doc.append(d), mark.append(m), at.append(i), body.append(own[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(at, pa.int32()), pa.array(body, pa.binary())], ["doc", "mark", "at", "body"])

    return bodies


def _without(roll: int, least: int, names: list[str]):
    def without(batches):
        for batch in sliced(batches):
            n_lines, n_removed, kept = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_cl_gone").to_pylist(), strict=True):
                n, removed = 0, 0
                if text is not None:
                    n = text.count(b"\n") + 1
                    if gone:
                        own, gone = chunks(text, roll, least), set(gone)
                        removed = sum(own[i][1] for i in gone)
                        text = b"\n".join([body for i, (body, _) in enumerate(own) if i not in gone])
                n_lines.append(n), n_removed.append(removed), kept.append(text)
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "_cl_n_lines": pa.array(n_lines, pa.int64()), "_cl_n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(x) for x in [*names, "_cl_n_lines", "_cl_n_removed"]], [*names, "_cl_n_lines", "_cl_n_removed"])

    return without


def line_dedup(docs: DataFrame, columns: list[str] | None = None, roll: int = ROLL, min_lines: int = MIN_LINES) -> DataFrame:
    """The given columns of docs(doc_id, text, ...), all by default, with repeated chunks cut from text; and n_lines, n_removed.

    Those two are named _cl_n_lines and _cl_n_removed, so they clash with no column. The first occurrence (smallest doc_id,
    then text hash, then place) stays. A null text stays null, with no lines; an empty one has one empty line. A document
    that loses all its chunks stays as a row with empty text. A null doc_id sorts after all others. Rows that repeat doc_id
    and text are one document, so each of them gets that document's result. A text of one line, however often it stands, and
    a long text's single chunk are compared and kept as any other. A text is held whole by the task that cuts it. Names that
    begin with _cl_ are reserved.
    """
    if taken := {"_cl_gone", "_cl_n_lines", "_cl_n_removed", "_cl_key", "_cl_hash"} & set(docs.columns):
        raise ValueError(f"columns named {sorted(taken)} are reserved")
    columns = columns or docs.columns
    doc, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text")
    keyed = docs.select(doc.alias("doc"), mark.alias("mark"), "text")
    found = stored(keyed.mapInArrow(_hashes(roll, min_lines), "doc long, mark long, at int, h long"))
    twice = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))  # so that Spark can split a common h in the join
    wanted = found.join(twice, "h", "left_semi")
    by_doc = wanted.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(F.collect_set("at").alias("wanted"))
    texts = keyed.join(by_doc, (F.col("doc") == F.col("_doc")) & (F.col("mark") == F.col("_mark"))).select("doc", "mark", "text", "wanted")
    bodies = texts.mapInArrow(_bodies(roll, min_lines), "doc long, mark long, at int, body binary")
    first = bodies.groupBy("body").agg(F.min(F.struct("doc", "mark", "at")).alias("f")).select("f.*")
    gone = stored(wanted.join(first, ["doc", "mark", "at"], "left_anti").groupBy(F.col("doc").alias("_cl_doc"), F.col("mark").alias("_cl_mark")).agg(F.collect_set("at").alias("_cl_gone")))
    needed = docs.select(*dict.fromkeys(["text", *columns]), doc.alias("_cl_key"), mark.alias("_cl_hash"))
    joined = needed.join(gone, (F.col("_cl_key") == F.col("_cl_doc")) & (F.col("_cl_hash") == F.col("_cl_mark")), "left").select(*dict.fromkeys(["text", *columns]), "_cl_gone")
    return joined.mapInArrow(_without(roll, min_lines, columns), carried(docs, columns, "_cl_n_lines long, _cl_n_removed long"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines, those that went, and the text that stays; nulls, empty texts and repeated rows as in line_dedup()."""
    kept = line_dedup(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return kept.select("doc_id", F.col("_cl_n_lines").alias("n_lines"), F.col("_cl_n_removed").alias("n_removed"), "text")


SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs}),
hashed AS (SELECT *, CAST('0x' || left(md5(line), 8) AS BIGINT) AS h FROM lines),
rolled AS (SELECT *, (31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) + h) % 1000003 AS r, count(*) OVER (PARTITION BY doc_id) AS lines FROM hashed),
edged AS (SELECT *, coalesce(r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i) AND i BETWEEN 2 AND lines - 2, false) AS cut FROM rolled),
numbered AS (SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM edged),
bodies AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk),
marked AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM bodies)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
       coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id"""
