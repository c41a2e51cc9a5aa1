"""Substring dedup by super-k-mer partitioning.

Every window of `window` consecutive words has a minimiser: the least hash among its sequences of `sub` words.
Consecutive windows that share one travel as a single packed string (a super-k-mer) to the minimiser's bucket, so equal
windows meet there, and sorting counts them; bytes are compared before a window counts as repeated. What one batch of
documents holds twice is settled before the shuffle. The windows of a very common minimiser travel singly, dealt by their
own hash, and in two steps: first among some of the batches, where all but the first go, and then among the firsts of all. So
no task grows with one passage.
"""

from __future__ import annotations

from array import array
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SubstringHash, Words, ids_of, pieces, release, sliced, stored, table, texts_of

WINDOW, SUB = 20, 5
#: Text bytes for each bucket; super-k-mers of a minimiser from which it can be common, and most common minimisers: it is common
#: if it has one part in so many of the super-k-mers of all that can be, so there are no more, and the list fits any task.
BUCKET_BYTES, COMMON, MOST_COMMON = 4 << 20, 20_000, 2_000_000
#: Text bytes that a task packs together, and hashes at once.
FLUSH_BYTES, SLICE_BYTES = 6 << 20, 1 << 20


def _runs(words: Words, hashes: SubstringHash, window: int, sub: int):
    """First word and minimiser of each window inside one text, and where runs of equal minimisers begin."""
    n, span = len(words.start), window - sub + 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    least = hashes.of(words.start[: n - sub + 1], words.end[sub - 1 :])
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = np.flatnonzero(words.of[: n - window + 1] == words.of[window - 1 :])
    least = least[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    return at, least, np.flatnonzero(begins)


def _lots(batches, window: int):
    """ids, marks, words before and texts, a lot at a time; a long text goes in pieces, each window in just one of them."""
    for batch in sliced(batches, limit=SLICE_BYTES):
        ids, marks = ids_of(batch.column("doc_id")), batch.column("mark").fill_null(0).to_numpy(zero_copy_only=False)
        texts = texts_of(batch.column("text"))
        if len(texts) > 1 or len(texts[0]) <= SLICE_BYTES:
            yield ids, marks, np.zeros(len(texts), np.int64), texts
            continue
        before = 0
        for piece in pieces(texts[0], window - 1, SLICE_BYTES):
            yield ids, marks, np.array([before]), [piece]
            before += len(piece.split()) - (window - 1)


def _count_minimisers(window: int, sub: int):
    def count(batches):
        for _, _, _, texts in _lots(batches, window):
            words = Words(texts)
            _, least, begins = _runs(words, SubstringHash(words.buffer), window, sub)
            value, n = np.unique(least[begins], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["m", "n"])

    return count


PACKED = "bucket int, salt int, n long, meta binary, packed binary"


def _packed(z: zstandard.ZstdCompressor, doc: np.ndarray, mark: np.ndarray, begin: np.ndarray, lines: list[bytes]) -> tuple[bytes, bytes]:
    return z.compress(doc.astype(np.int64).tobytes() + mark.astype(np.int32).tobytes() + begin.astype(np.int64).tobytes()), z.compress(b"\n".join(lines))


def _pack(window: int, sub: int, buckets: int, salts: int, common: np.ndarray):
    """Rows of super-k-mers by bucket; rows without `packed` hold what the task itself found to be repeated.

    Common minimisers' windows go to buckets from `buckets` on, each in `salts` parts.
    """

    def flush(seen: dict, first: list[array], salt: int):
        z = zstandard.ZstdCompressor(level=3)
        keys = list(seen)
        doc, mark, begin, _, bucket = (np.frombuffer(x, np.int64) for x in first)
        rows = {"bucket": [], "salt": [], "n": [], "meta": [], "packed": []}
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        for part in np.split(by, cuts[1:]) if len(by) else []:
            at = int(bucket[part[0]])
            own = _packed(z, doc[part], mark[part], begin[part], [keys[i] for i in part])
            for k, v in zip(rows, (at, salt if at >= buckets else 0, len(part), *own), strict=True):
                rows[k].append(v)
        return rows

    def settled(found: list, order: int):
        rows = np.array(found, np.int64).reshape(-1, 4)
        return {"bucket": [order % buckets], "salt": [0], "n": [len(rows)], "meta": [rows.tobytes()], "packed": [None]}

    def as_batch(rows):
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(rows[k], kind) for k, kind in zip(rows, kinds, strict=True)], list(rows))

    def pack(batches):
        fresh = lambda: ({}, [array("q") for _ in range(5)], [], 0)  # noqa: E731  the arrays: doc, mark, first window, past the last one, bucket
        (seen, first, found, held), task = fresh(), TaskContext.get()
        order = task.partitionId() * 7919 if task else 0
        for ids, marks, before, texts in _lots(batches, window):
            words = Words(texts)
            hashes = SubstringHash(words.buffer)
            at, least, begins = _runs(words, hashes, window, sub)
            if len(common) and len(begins):  # each window of a common minimiser is a run of its own
                split = np.isin(least, common)
                split[begins] = True
                begins = np.flatnonzero(split)
            ends = np.append(begins[1:], len(at)) if len(begins) else begins
            low, high = at[begins], at[ends - 1] if len(begins) else begins
            route = least[begins].copy()
            bucket = (route % np.uint64(buckets)).astype(np.int64)
            if len(common) and len(begins):
                hot = np.isin(route, common)
                own = hashes.of(words.start[low[hot]], words.end[low[hot] + window - 1])
                bucket[hot] = (own % np.uint64(buckets)).astype(np.int64) + buckets
            text = words.of[low]
            offset = low - words.first[text] + before[text]
            blob = words.blob
            for a, b, doc, mark, begin, n, to in zip(words.start[low].tolist(), words.end[high + window - 1].tolist(), ids[text].tolist(), marks[text].tolist(), offset.tolist(), (high - low + 1).tolist(), bucket.tolist(), strict=True):
                key, new = blob[a:b], (doc, mark, begin, begin + n, to)
                i = seen.setdefault(key, len(seen))
                if i == len(first[0]):
                    for x, y in zip(first, new, strict=True):
                        x.append(y)
                elif (first[0][i], first[1][i], first[2][i]) != new[:3]:
                    old = tuple(x[i] for x in first)
                    if new < old:
                        for x, y in zip(first, new, strict=True):
                            x[i] = y
                        new = old
                    found.append(new[:4])
            held += len(blob)
            if held >= FLUSH_BYTES:
                yield as_batch(flush(seen, first, order % salts))
                yield as_batch(settled(found, order))
                (seen, first, found, held), order = fresh(), order + 1
        yield as_batch(flush(seen, first, order % salts))
        yield as_batch(settled(found, order))

    return pack


FOUND = "doc_id long, mark int, start long, stop long"
#: What a bucket gives: found ranges, or a row of its first windows for the second step.
STEP = f"{FOUND}, bucket int, n long, meta binary, packed binary"


def _found(rows: np.ndarray, more: tuple | None = None) -> pa.Table:
    n, extra = len(rows), int(more is not None)
    pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(extra, kind)])
    columns = [pad(rows[:, 0], pa.int64()), pad(rows[:, 1].astype(np.int32), pa.int32()), pad(rows[:, 2], pa.int64()), pad(rows[:, 3], pa.int64())]
    for value, kind in zip(more or [None] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True):
        columns.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([value] * extra, kind)]))
    return pa.table(columns, ["doc_id", "mark", "start", "stop", "bucket", "n", "meta", "packed"])


def _windows(blobs: list[bytes], lines: list[int], window: int):
    """Hash, line, number in its line, and byte span (in all blobs, joined) of each window, a blob at a time."""
    parts, base, line = [], 0, 0
    for blob, n in zip(blobs, lines, strict=True):
        words = Words.packed(blob, n)
        at = np.flatnonzero(words.of[: max(0, len(words.start) - window + 1)] == words.of[window - 1 :])
        start, end = words.start[at], words.end[at + window - 1]
        parts.append((SubstringHash(words.buffer).of(start, end), words.of[at] + line, at - words.first[words.of[at]], start + base, end + base))
        base, line = base + len(blob) + 1, line + n
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def repeated_windows(doc: np.ndarray, mark: np.ndarray, offset: np.ndarray, blobs: list[bytes], lines: list[int], window: int) -> np.ndarray:
    """Ranges (doc, mark, first window, past the last window) of windows whose words start earlier too, among super-k-mers.

    A blob holds `lines` super-k-mers; doc, mark and offset (of the first word, in its document) go with them, in order.
    """
    value, line, inside, start, end = _windows(blobs, lines, window)
    text = b"\n".join(blobs)
    by = np.argsort(value)
    same = value[by[1:]] == value[by[:-1]]
    twice = np.zeros(len(by), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = by[twice]
    rank = np.unique(np.rec.fromarrays([doc, mark]), return_inverse=True)[1].reshape(-1)
    at = at[np.lexsort((offset[line[at]] + inside[at], rank[line[at]], value[at]))]
    key = value[at]
    head = np.ones(len(at), bool)
    head[1:] = key[1:] != key[:-1]
    first = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))] if len(at) else at
    begin = lambda w: offset[line[w]] + inside[w]
    later = (rank[line[at]] != rank[line[first]]) | (begin(at) != begin(first))
    at, first = at[later], first[later]
    by = np.argsort(at)
    at, first = at[by], first[by]
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1] + 1) | (line[at[1:]] != line[at[:-1]]) | (line[first[1:]] != line[first[:-1]])
    lows = np.flatnonzero(cut)
    highs = np.append(lows[1:], len(at)) - 1 if len(lows) else lows
    for a, b, c, d in zip(start[at[lows]].tolist(), end[at[highs]].tolist(), start[first[lows]].tolist(), end[first[highs]].tolist(), strict=True):
        if text[a:b] != text[c:d]:  # different words with equal hashes
            return _by_bytes(text, doc[line], mark[line], begin(np.arange(len(line))), start, end)
    low = at[lows]
    return np.stack([doc[line[low]], mark[line[low]].astype(np.int64), begin(low), begin(at[highs]) + 1], axis=1)


def _by_bytes(text: bytes, doc, mark, begin, start, end) -> np.ndarray:
    """The same without hashes, for windows by their byte spans."""
    seen, out = {}, []
    for d, m, at, a, b in sorted(zip(doc.tolist(), mark.tolist(), begin.tolist(), start.tolist(), end.tolist(), strict=True)):
        if seen.setdefault(text[a:b], (d, m, at)) != (d, m, at):
            out.append((d, m, at, at + 1))
    return np.array(out, np.int64).reshape(-1, 4)


def _in_bucket(window: int, buckets: int):
    def find(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        docs, marks, offsets, blobs, lines, out = [], [], [], [], [], []
        for n, meta, packed in zip(*(rows.column(c).to_pylist() for c in ("n", "meta", "packed")), strict=True):
            if packed is None:
                out.append(np.frombuffer(meta, np.int64).reshape(-1, 4))
            else:
                meta = unpack(meta)
                docs.append(np.frombuffer(meta, np.int64, n))
                marks.append(np.frombuffer(meta, np.int32, n, 8 * n))
                offsets.append(np.frombuffer(meta, np.int64, n, 12 * n) if n % 2 == 0 else np.frombuffer(meta[12 * n :], np.int64, n))
                blobs.append(unpack(packed))
                lines.append(n)
        more = None
        if blobs:
            doc, mark, offset = np.concatenate(docs), np.concatenate(marks), np.concatenate(offsets)
            out.append(repeated_windows(doc, mark, offset, blobs, lines, window))
            bucket = rows.column("bucket")[0].as_py()
            if bucket >= buckets:  # each line is a window; those that start nowhere earlier here go on
                gone = set(map(tuple, out[-1][:, :3].tolist()))
                keep = [i for i, x in enumerate(zip(doc.tolist(), mark.tolist(), offset.tolist(), strict=True)) if x not in gone]
                text = b"\n".join(blobs).split(b"\n")
                more = (bucket - buckets, len(keep), *_packed(zstandard.ZstdCompressor(level=3), doc[keep], mark[keep], offset[keep], [text[i] for i in keep]))
        return _found(np.concatenate(out) if out else np.zeros((0, 4), np.int64), more)

    return find


SPACE = "[\\x20\\x09-\\x0D]+"


def _islands(found: DataFrame, window: int) -> DataFrame:
    """_id, _mark and gone: each document's removed words as sorted ranges (low, high) that don't touch, high not included."""
    own = Window.partitionBy("doc_id", "mark").orderBy("start", "stop")
    ranges = found.withColumn("high", F.col("stop") + (window - 1))
    begins = ranges.withColumn("begins", F.coalesce(F.col("start") > F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    islands = begins.withColumn("island", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "mark", "island").agg(F.min("start").alias("low"), F.max("high").alias("high"))
    return islands.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("gone"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words, joined by one space) of every row of docs(doc_id, text, ...).

    A word goes if a window that covers it starts earlier too: in a smaller doc_id, or earlier in its document. Windows are
    judged on the input. Null text counts as empty; it and a text of fewer than `window` words keep all. A null doc_id sorts
    after all others. Rows with one doc_id and different texts are different documents, in the order of a hash of the
    text; rows that repeat both are one document and get the same result. Long texts are packed in pieces; the last step
    holds the words of a text. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.shiftright(F.xxhash64("text"), 32).cast("int").alias("mark"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    counts = docs.mapInArrow(_count_minimisers(window, sub), "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    often = stored(counts.where(F.col("n") >= COMMON))
    least = -(-(often.agg(F.sum("n")).first()[0] or 0) // MOST_COMMON)
    common = often.where(F.col("n") >= least).select("m").toPandas()["m"].to_numpy(np.int64).view(np.uint64)
    release(often)
    salts = isqrt(total // FLUSH_BYTES) + 1
    packed = docs.mapInArrow(_pack(window, sub, buckets, salts, np.sort(common)), PACKED)
    step = stored(packed.groupBy("bucket", "salt").applyInArrow(_in_bucket(window, buckets), STEP))
    firsts = step.where("packed IS NOT NULL").select("bucket", "n", "meta", "packed")
    found = step.where("packed IS NULL").selectExpr("doc_id", "mark", "start", "stop")
    found = found.unionByName(firsts.groupBy("bucket").applyInArrow(_in_bucket(window, buckets), STEP).select("doc_id", "mark", "start", "stop"))
    known = F.coalesce("doc_id", F.lit(2**63 - 1))
    gone = _islands(found, window)
    joined = docs.join(gone, (known == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "gone")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    worded = joined.select("doc_id", "gone", words.alias("words"))
    # what lies between the ranges stays
    low, high = F.concat(F.array(F.lit(0).cast("long")), F.col("gone.high")), F.concat(F.col("gone.low"), F.array(F.size("words").cast("long")))
    kept = F.flatten(F.zip_with(low, high, lambda a, b: F.slice(F.col("words"), (a + 1).cast("int"), (b - a).cast("int"))))
    n_removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda n, r: n + r["high"] - r["low"]), F.lit(0).cast("long"))
    return worded.select("doc_id", F.size("words").cast("long").alias("n_words"), n_removed.alias("n_removed"), F.array_join(F.when(F.col("gone").isNull(), F.col("words")).otherwise(kept), " ").alias("text"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """How many words of each document go, and a hash of those that stay; nulls, empty texts and repeated rows as in substring_dedup()."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH worded AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
placed AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM worded),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i : i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM placed),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later WHERE again),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM worded),
kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS text FROM each LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (doc_id)"""
