"""Quality by a byte-level convolutional network in numpy.

Bytes become short vectors; learned filters run over them; each overlapping chunk keeps the largest response of each
filter, and a linear layer turns those into the chunk's logit. A logistic layer over the mean, least and largest chunk
logits of the whole text gives one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, sliced, stored, table, texts_of
from .language_id import held_out, unit_hash

#: Numbers for each byte; bytes that a filter covers, in steps; filters.
EMBED, STEPS, STRIDE, FILTERS = 8, 4, 2, 16
#: Bytes of half a chunk; a chunk is two neighbouring halves, so chunks overlap by one half.
HALF = 128
#: About so many labelled rows are learned from, with their whole texts; the only sample here.
SAMPLE_ROWS = 3000
#: Rounds over the sample; parts of it that are learned apart in a round, whose networks are then averaged; chunks of a step.
EPOCHS, PARTS, BATCH, RATE = 5, 4, 128, 0.01
#: Halves that the network looks at in one go.
SPAN = 4096


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each filled up with zeros to whole halves (two at least), and the halves of each."""
    halves = [max(2, -(-(len(t) + STEPS * STRIDE) // HALF)) for t in texts]
    return np.frombuffer(b"".join([t.ljust(n * HALF, b"\0") for t, n in zip(texts, halves, strict=True)]), np.uint8), np.array(halves)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
        self.p = {"embed": normal(256, EMBED) * 0.5, "filters": normal(STEPS, STRIDE * EMBED, FILTERS) * np.float32((2 / (STEPS * STRIDE * EMBED)) ** 0.5), "bias": np.zeros(FILTERS, np.float32), "out": normal(FILTERS) * 0.3, "out_bias": np.zeros(1, np.float32)}
        self.p["embed"][0] = 0
        self.last, self.mean, self.scale = np.array([0.0, 1.0, 0.0, 0.0]), np.zeros(3), np.ones(3)

    def responses(self, buffer: np.ndarray) -> np.ndarray:
        """A row of filter responses for every STRIDE bytes."""
        x = self.p["embed"][buffer].reshape(len(buffer) // STRIDE, STRIDE * EMBED)
        y = x @ self.p["filters"][0]
        for j in range(1, STEPS):
            y[: len(x) - j] += x[j:] @ self.p["filters"][j]
        return y

    def chunk_logits(self, buffer: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each half with the next one; those of the halves before `ends`, the last of each text, have no meaning."""
        n, places = len(buffer) // HALF, HALF // STRIDE
        best = np.empty((n, FILTERS), np.float32)
        for at in range(0, n, SPAN):
            to = min(at + SPAN, n)
            y = self.responses(buffer[at * HALF : to * HALF + (STEPS - 1) * STRIDE])[: (to - at) * places]
            last = ends[(ends > at) & (ends <= to)] - at
            for j in range(1, STEPS):  # filters that reach into the next text; a text ends with zeros, whose responses are 0
                y[last * places - j] = 0
            best[at:to] = y.reshape(-1, places, FILTERS).max(axis=1)
        best[:-1] = np.maximum(best[:-1], best[1:])
        return np.maximum(best + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"][0]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean, least and largest chunk logit of each whole text."""
        buffer, halves = padded(texts)
        ends = np.cumsum(halves)
        logits = self.chunk_logits(buffer, ends).astype(np.float64)
        used = np.ones(len(logits), bool)
        used[ends - 1] = False
        logits, begins = logits[used], ends - halves - np.arange(len(texts))
        return np.stack([np.add.reduceat(logits, begins) / (halves - 1), np.minimum.reduceat(logits, begins), np.maximum.reduceat(logits, begins)], axis=1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = self.last[0] + ((features - self.mean) / self.scale) @ self.last[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit_chunks(self, batches, moments: dict | None = None, t: int = 0) -> tuple[dict, int]:
        """Adam on the logistic loss of (chunks, labels, weights); chunks: rows of 2 * HALF bytes. Returns the moments and the steps so far."""
        moments = moments or {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        places = 2 * HALF // STRIDE
        for raw, label, weight in batches:
            y = self.responses(raw.reshape(-1)).reshape(len(raw), places, FILTERS)[:, : places - STEPS + 1]
            where = y.argmax(axis=1)
            peak = np.take_along_axis(y, where[:, None], 1)[:, 0] + self.p["bias"]
            hidden = np.maximum(peak, 0)
            error = ((1 / (1 + np.exp(-(hidden @ self.p["out"] + self.p["out_bias"][0]))) - label) * weight / len(raw)).astype(np.float32)
            back = error[:, None] * self.p["out"] * (peak > 0)
            seen = raw[np.arange(len(raw))[:, None, None], where[:, :, None] * STRIDE + np.arange(STEPS * STRIDE)]
            vectors = self.p["embed"][seen].reshape(len(raw), FILTERS, STEPS, STRIDE * EMBED)
            flat = self.p["filters"].transpose(2, 0, 1).reshape(FILTERS, STEPS * STRIDE, EMBED)
            grad = {"out": hidden.T @ error, "out_bias": error.sum(keepdims=True), "bias": back.sum(axis=0), "filters": np.einsum("rf,rfsk->skf", back, vectors), "embed": np.zeros_like(self.p["embed"])}
            np.add.at(grad["embed"], seen, back[:, :, None, None] * flat[None])
            grad["embed"][0] = 0
            t += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                self.p[k] -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return moments, t

    def fit_texts(self, features: np.ndarray, label: np.ndarray, rounds: int = 25) -> None:
        """Newton's method for the last layer, with a small ridge."""
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-6
        x = np.concatenate([np.ones((len(features), 1)), (features - self.mean) / self.scale], axis=1)
        w = np.zeros(4)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (p - label) + 0.1 * w)
        self.last = w


def _steps(batches):
    """Batches of chunks, labels and weights from rows in a fixed order; chunks of one text are dealt over the batches of about a megabyte.

    A chunk weighs one over its text's chunks, so a text counts once, however long it is.
    """
    for batch in sliced(batches, limit=1 << 20):
        chunks, label, weight = [], [], []
        for text, y in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            n = max(1, -(-len(text) // HALF) - 1)
            own = np.frombuffer(text.ljust((n + 1) * HALF, b"\0")[: (n + 1) * HALF], np.uint8)
            chunks.append(np.lib.stride_tricks.sliding_window_view(own, 2 * HALF)[::HALF])
            label.append(np.full(n, y, np.float32)), weight.append(np.full(n, 1 / n, np.float32))
        label, weight = np.concatenate(label), np.concatenate(weight)
        weight /= weight.mean()
        of, first = np.repeat(np.arange(len(chunks)), list(map(len, chunks))), np.cumsum([0, *map(len, chunks)])
        order = np.random.default_rng(11).permutation(len(label))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            yield np.stack([chunks[of[r]][r - first[of[r]]] for r in rows.tolist()]), label[rows], weight[rows]


def _learn_part(net):
    """Each part's network after a round over its rows, which come part by part."""

    def parts(batches):
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield int(part[a]), batch.slice(a, b - a)

    def learn(batches):
        own, at, state, t, rows = None, None, None, 0, 0
        for part, batch in parts(batches):
            if part != at:
                if own:
                    yield _packed(at, own, rows)
                own, at, state, t, rows = Network(), part, None, 0, 0
                own.p = {k: v.copy() for k, v in net.value.p.items()}
            state, t = own.fit_chunks(_steps(iter([batch])), state, t)
            rows += batch.num_rows
        if own:
            yield _packed(at, own, rows)

    return learn


def _packed(part: int, net: Network, rows: int) -> pa.RecordBatch:
    flat = np.concatenate([net.p[k].ravel() for k in sorted(net.p)])
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "rows", "network"])


def _averaged(net: Network, found: list) -> Network:
    """The mean of the parts' networks, by their rows."""
    total = sum(r.rows for r in found)
    flat = sum(np.frombuffer(r.network, np.float32) * np.float32(r.rows / total) for r in sorted(found, key=lambda r: r.part))
    out, at = Network(), 0
    for k in sorted(net.p):
        out.p[k] = flat[at : at + net.p[k].size].reshape(net.p[k].shape).astype(np.float32)
        at += net.p[k].size
    return out


def _features(net):
    def features(batches):
        for batch in sliced(batches, limit=1 << 20):
            x = net.value.features(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x[:, i]) for i in range(3))], ["label", "a", "b", "c"])

    return features


def _score(net):
    def score(batches):
        for batch in sliced(batches, limit=1 << 20):
            p = net.value.probability(net.value.features(texts_of(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return score


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """A network for docs(doc_id, text) and labels(doc_id, quality), from about sample_rows labelled rows that aren't held out.

    A doc_id that is labelled twice counts with the larger label; of rows that repeat a doc_id, the text with the least hash
    is learned. Every chunk of a sampled text is learned from. In each round tasks learn from parts of the sample, and the driver averages what they send,
    a few thousand numbers each; then it gets four numbers for each sampled row. With labels of one kind only, or none, the
    network stays untrained and all scores are what it gives then.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality").cast("int") > 0).cast("int").alias("label"))
    labelled = usable.groupBy("_id").agg(F.max("label").alias("label"))
    drawn = labelled.where(unit_hash("_id") < sample_rows / max(1, labelled.count()))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # about sample_rows rows of two numbers
    own = named.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
    rows = stored(own.select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")))
    net, context = Network(), docs.sparkSession.sparkContext
    if len(rows.select("label").distinct().collect()) == 2:
        for _ in range(EPOCHS):
            found = rows.repartition(PARTS, "part").sortWithinPartitions("part", F.xxhash64("doc_id"), "text").mapInArrow(_learn_part(context.broadcast(net)), "part int, rows long, network binary").collect()
            net = _averaged(net, found)
        x = np.array(sorted(tuple(r) for r in rows.mapInArrow(_features(context.broadcast(net)), "label int, a double, b double, c double").collect()), float)
        net.fit_texts(x[:, 1:], x[:, 0])
    release(rows)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs(doc_id, text, ...), over its whole text.

    A null text scores as an empty one: a chunk of zeros. Rows are judged one by one, so repeated rows agree. Long texts go
    through the network in spans. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), "doc_id long, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score of every whole text of documents, learned from labels; null and empty texts score as in score()."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
