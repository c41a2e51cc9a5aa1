"""Language ID by the nearest of several centroids for each language.

A text is a vector of TF-IDF weights of hashed byte n-grams, over letters only, normalised. Spherical k-means gives each
language several centroids; the nearest one by cosine names the language, and a text that is much farther from it than
learned texts of as many n-grams are is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, release, sliced, stored, table

#: Hashed n-gram features, lengths of the n-grams, centroids for each language.
FEATURES, LENGTHS, CENTROIDS = 4096, (2, 3), 4
#: About so many labelled rows are learned from for each language; the only sample here.
SAMPLE_ROWS = 500
#: A text is rejected under this part of the cosine that all but one in a thousand learned texts of its size reach. Sizes are
#: powers of two of the number of n-grams; the learned texts count with their first 1, 2, 4, ... words and whole.
REJECT_PART, SIZES = 0.5, 40
#: Texts whose n-grams are counted at once, and bytes of a text that are.
ROWS, PIECE = 256, 1 << 20
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts for each text; long texts go piece by piece."""
    parts = [b" " + b" ".join((t or "").lower().encode().translate(_LETTERS_ONLY).split()) + b" " for t in texts]
    out, most, lot, size = np.zeros((len(parts), FEATURES), np.int64), max(LENGTHS), [], 0
    for row, part in enumerate(parts):
        for at in range(0, max(1, len(part) - 1), PIECE):  # the next piece's first n-grams begin in it
            piece = part[at : at + PIECE + most - 1]
            lot.append((row, piece, min(PIECE, len(part) - at)))
            size += len(piece)
            if size >= PIECE:
                _count(out, lot)
                lot, size = [], 0
    _count(out, lot)
    return out


def _count(out: np.ndarray, lot: list[tuple[int, bytes, int]]) -> None:
    """Adds the n-grams of each (row, piece, places): those that begin in its first places."""
    if not lot:
        return
    rows, pieces, places = zip(*lot, strict=True)
    length = np.array([len(p) + 2 for p in pieces])
    of = np.repeat(np.array(rows), length)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    begins = inside < np.repeat(np.array(places), length)
    buffer = np.frombuffer(b"\0\0".join(pieces) + b"\0\0", np.uint8)
    for n in LENGTHS:
        size = max(0, len(buffer) - n + 1)
        hashed, whole = np.full(size, n * 97, np.uint32), begins[:size].copy()
        for j in range(n):
            part = buffer[j : j + size]
            hashed = (hashed ^ part) * _FACTORS[j]
            hashed ^= hashed >> np.uint32(15)
            whole &= part != 0
        first = rows[0]
        found = (hashed % np.uint32(FEATURES)).astype(np.int64)[whole] + (of[:size][whole] - first) * FEATURES
        out[first : rows[-1] + 1] += np.bincount(found, minlength=(rows[-1] + 1 - first) * FEATURES).reshape(-1, FEATURES)


def weights(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; the first is the mean, each next one starts at the row farthest from those before."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    centers = unit(x.mean(axis=0, keepdims=True))
    while len(centers) < min(k, len(x)):
        centers = np.concatenate([centers, x[[np.argmin((x @ centers.T).max(axis=1))]]])
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        centers = unit(np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(len(centers))]))
    return centers.astype(np.float32)


def sizes(n: np.ndarray) -> np.ndarray:
    """The size class of each row of counts."""
    return np.minimum(np.log2(np.maximum(n.sum(axis=1), 1)).astype(int), SIZES - 1)


def beginnings(text: str) -> list[str]:
    """The first 1, 2, 4, ... words of a text, and all of it."""
    words = text.split(None, 1 << 10)[: 1 << 10]
    return [" ".join(words[: 1 << k]) for k in range(10) if 1 << k < len(words)] + [text]


class Model:
    """idf; langs and centers: a row for each centroid; least: for each centroid and size, the cosine under which a text is rejected."""

    def __init__(self, idf: np.ndarray, own: dict[str, np.ndarray], reached: dict[tuple[str, int], float]):
        self.idf = idf
        self.langs = [lang for lang in sorted(own) for _ in own[lang]]
        self.centers = np.concatenate([own[lang] for lang in sorted(own)]) if own else np.zeros((0, FEATURES), np.float32)
        least = np.full((len(self.langs), SIZES), np.nan)
        for i, lang in enumerate(self.langs):
            known = [k for k in range(SIZES) if (lang, k) in reached]
            for k in range(SIZES if known else 0):  # a size that was not learned: as the next smaller one, else the next larger one
                near = max((x for x in known if x <= k), default=known[0])
                least[i, k] = REJECT_PART * reached[lang, near]
        self.least = np.nan_to_num(least)

    def cosines(self, n: np.ndarray) -> np.ndarray:
        return weights(n, self.idf) @ self.centers.T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether it is rejected, of each text."""
        if not self.langs:
            return [(UNDETERMINED, 0.0, True)] * len(texts)
        n = counts(texts)
        near = self.cosines(n)
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(float)
        far = cosine < self.least[best, sizes(n)]
        no_letter = [t is None or not _LETTER.search(t) for t in texts]
        return [(UNDETERMINED, 0.0, True) if no else (self.langs[b], c, f) for no, b, c, f in zip(no_letter, best.tolist(), cosine.tolist(), far.tolist(), strict=True)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit_hash(column: str) -> Column:
    """A deterministic number in 0..1 for each value."""
    return F.shiftright(F.xxhash64(column), 11).cast("double") / float(1 << 53) + 0.5


def inverse_frequency(rows: int, frequency: np.ndarray) -> np.ndarray:
    return (np.log((1 + rows) / (1 + frequency)) + 0.1).astype(np.float32)


def _vectors(batches):
    """lang and n, the counts of each text as bytes."""
    for batch in sliced(batches, rows=ROWS):
        n = counts(batch.column("text").to_pylist()).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([row.tobytes() for row in n], pa.binary())], ["lang", "n"])


def _frequencies(batches):
    total, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for x in batch.column("n"):
            total += np.frombuffer(x.as_buffer(), np.float32) > 0
        rows += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["rows", "has"])


def _centers(idf: np.ndarray):
    def centers(rows: pa.Table) -> pa.Table:
        n = sorted(rows.column("n").to_pylist())  # so the order in which tasks end doesn't count
        found = spherical_means(weights(np.stack([np.frombuffer(x, np.float32) for x in n]), idf), CENTROIDS)
        return pa.table([pa.array([rows.column("lang")[0].as_py()], pa.string()), pa.array([found.tobytes()], pa.binary())], ["lang", "centers"])

    return centers


def _reached(model):
    def reached(batches):
        for batch in sliced(batches, rows=ROWS // 8):
            texts = [(lang, t) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in beginnings(text)]
            n = counts([t for _, t in texts])
            own = np.array([lang for lang, _ in texts])[:, None] == np.array(model.value.langs)[None]
            near = np.where(own, model.value.cosines(n), -1).max(axis=1)
            some = n.sum(axis=1) > 0
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in texts], pa.string()), pa.array(sizes(n), pa.int32()), pa.array(near.astype(float))], ["lang", "size", "cosine"]).filter(pa.array(some))

    return reached


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows of docs(doc_id, text, lang) that aren't held out, from about sample_rows of each language.

    Every language that a row names is learned. Centroids are found by a task for each language; the driver gets a row for
    each language, of FEATURES * CENTROIDS numbers, and a few for the sizes. Rows with a null doc_id, text or lang teach
    nothing; texts are counted whole.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = labelled.groupBy("lang").count().collect()
    if not rows:
        return Model(np.ones(FEATURES, np.float32), {}, {})
    share = F.create_map(*(F.lit(v) for lang, n in sorted(rows) for v in (lang, sample_rows / n)))
    drawn = stored(labelled.where(unit_hash("doc_id") < F.try_element_at(share, F.col("lang"))).select("text", "lang"))
    vectors = stored(drawn.mapInArrow(_vectors, "lang string, n binary"))
    parts = vectors.select("n").mapInArrow(_frequencies, "rows long, has binary").collect()  # one for each task
    idf = inverse_frequency(sum(r.rows for r in parts), sum((np.frombuffer(r.has, np.int64) for r in parts), np.zeros(FEATURES, np.int64)))
    own = {r.lang: np.frombuffer(r.centers, np.float32).reshape(-1, FEATURES) for r in vectors.groupBy("lang").applyInArrow(_centers(idf), "lang string, centers binary").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Model(idf, own, {}))
    reached = drawn.mapInArrow(_reached(shared), "lang string, size int, cosine double").groupBy("lang", "size").agg(F.percentile("cosine", 0.001).alias("least")).collect()
    release(drawn, vectors)
    return Model(idf, own, {(r.lang, r["size"]): r.least for r in reached})


def _predict(model, names: list[str]):
    def predict(batches):
        for batch in sliced(batches, rows=ROWS):
            found = model.value.predict(batch.column("text").to_pylist())
            lang, score, out = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*names, "_cl_lang", "_cl_score", "_cl_rejected"])

    return predict


def identify(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs(text, ...), all by default, with _cl_lang, _cl_score (the cosine) and _cl_rejected.

    A null text, or one without a letter, is `und` with score 0, and rejected; so is everything if nothing could be learned.
    Rows are judged one by one, so repeated rows agree. Long texts are counted piece by piece, whole. Names that begin with
    _cl_ are reserved.
    """
    if taken := {"_cl_lang", "_cl_score", "_cl_rejected"} & set(docs.columns):
        raise ValueError(f"columns named {sorted(taken)} are reserved")
    columns = columns or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB for each language
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(_predict(shared, columns), carried(docs, columns, "_cl_lang string, _cl_score double, _cl_rejected boolean"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents; null texts and those without a letter are und, as in identify()."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs), ["doc_id", "text"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("_cl_lang").alias("lang_pred"), F.col("_cl_score").alias("score"), F.col("_cl_rejected").alias("rejected"))
