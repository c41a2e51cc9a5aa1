"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit majority votes over shingle hashes. Each different fingerprint is one row from there on. For a
budget of k differing bits the 64 bits are cut into k + 2 blocks; two fingerprints in the budget agree in two blocks at
least, so rows meet in buckets of equal block pairs (or of more blocks, see AGREE). In a bucket, the sorted fingerprints are a binary trie (a node is a
range of them): node pairs are traversed together, the bits in which their prefixes differ are added up, and a pair is
dropped when they exceed the budget, or when all its leaves are in one component already. So a bucket returns a spanning
forest of its links, never all pairs. A bucket over the bound is dealt as pairs of parts.

64 bits do not tell a similarity of 0.8 from one of 0.7, and no small budget finds both ends of it. near_copies() therefore
votes on 256 bits from the same shingles and lets rows meet in bands of sampled bits, short texts by shingles; there the same
trie over the first 64 bits and all 256 bits only proposes pairs, and the sets of shingles decide.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, pieces, release, sliced, stored, table, texts_of
from .components import components

BUDGET, SHINGLE, SEED = 4, 4, 42
#: Blocks in which linked fingerprints must agree to meet; more of them make smaller buckets, and more rows.
AGREE = 2
#: Most rows of a bucket in one task; larger buckets are dealt as pairs of parts.
BUCKET_ROWS = 50_000
#: Rows that a task joins at once and node pairs in one step (over the words of a fingerprint), and the largest product of node sizes that is compared directly.
JOIN_ROWS, STEP, DIRECT = 100_000, 20_000, 64
#: near_copies(): words of a shingle; 64-bit words of a fingerprint.
COPY_SHINGLE, COPY_WORDS = 5, 4
#: near_copies(): least bits of a band, and the chance that pairs with that share of differing bits meet in no band. At a Jaccard
#: similarity of 0.8, a cosine of 8/9, 15 % of the bits differ.
LEAST_BITS, MISSED_AT, MISSED = 16, 0.152, 0.025
#: near_copies(): most differing bits in the first word, and in all 256. Of two small sets (5 and 4 shingles) about 48 bits
#: differ at a similarity of 0.8, and three standard deviations more are let through; forests grow in these steps.
WIDE_FIRST, WIDE_BUDGET = 24, 68
STEPS = (16, 28, 40, 52, WIDE_BUDGET)
#: near_copies(): most classes of a cluster that have a rare shingle.
RARE = 8
#: near_copies(): bands that join up most of a cluster before the others are looked at.
FIRST_BANDS = 8
#: Least similarity of two shingle sets, as a fraction, and the sets so small that they meet by shingles instead of bands.
ENOUGH, WHOLE, FEW = 4, 5, 32


def _shingles(texts: list[bytes], shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the first one and the number of each text."""
    words = Words([t.lower() for t in texts])
    n = np.diff(words.first)
    shingles = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    begins = np.cumsum(shingles) - shingles
    at = np.repeat(words.first[:-1] - begins, shingles) + np.arange(shingles.sum())
    last = np.minimum(at + shingle, np.repeat(words.first[1:], shingles)) - 1
    blob, digest = words.blob, xxhash.xxh64_intdigest
    hashes = np.array([digest(blob[a:b], seed) for a, b in zip(words.start[at].tolist(), words.end[last].tolist(), strict=True)], np.uint64)
    return hashes, begins, shingles


def _lots(texts: list[bytes], shingle: int, seed: int):
    """Hashes of shingles, their first one and number for each piece, and the text of each piece: a lot at a time, long texts piece by piece."""
    short = [i for i, t in enumerate(texts) if len(t) <= SLICE_BYTES]
    if short:
        yield *_shingles([texts[i] for i in short], shingle, seed), np.array(short)
    for i, text in enumerate(texts):
        if len(text) > SLICE_BYTES:
            for piece in pieces(text, shingle - 1):
                yield *_shingles([piece], shingle, seed), np.array([i])


_ODD = np.random.default_rng(64).integers(1, 2**63, (64, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _anew(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes, mixed anew for each word of a fingerprint but the first."""
    if not word:
        return hashes
    half, (first, second) = np.uint64(32), _ODD[word]
    h = (hashes ^ (hashes >> half)) * first
    h = (h ^ (h >> half)) * second
    return h ^ (h >> half)


def _looked_at(texts: list[bytes], shingle: int, words: int, seed: int, with_sets: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fingerprints of `words` uint64 and, if asked for, the different shingle hashes of each text, rising; each shingle is hashed once."""
    ones, number = np.zeros((len(texts), words * 64), np.int64), np.zeros(len(texts), np.int64)
    found = [[] for _ in texts]
    for hashes, begins, shingles, of in _lots(texts, shingle, seed):
        full = np.flatnonzero(shingles)
        if len(full):
            number[of] += shingles
            for k in range(words):
                bits = np.unpackbits(_anew(hashes, k).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[of[full], 64 * k : 64 * k + 64] += np.add.reduceat(bits, begins[full], axis=0, dtype=np.int32)
        for i, b, n in zip(of.tolist(), begins.tolist(), shingles.tolist(), strict=True) if with_sets else ():
            found[i].append(np.unique(hashes[b : b + n]))
    prints = np.packbits(2 * ones > number[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64)
    return prints, [x[0] if len(x) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *x])) for x in found]


def long_fingerprints(texts: list[bytes], shingle: int = COPY_SHINGLE, words: int = COPY_WORDS, seed: int = SEED) -> np.ndarray:
    """`words` uint64 of SimHash for each text: a bit is set if over half of the shingles' hashes, mixed anew for each word but the first, have it."""
    return _looked_at(texts, shingle, words, seed, False)[0]


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 SimHash of each text: a bit is set if over half of the shingles' hashes have it."""
    return long_fingerprints(texts, shingle, 1, seed)[:, 0]


def _fingerprint(shingle: int):
    def fingerprint(batches):
        for batch in sliced(batches):
            values = fingerprints(texts_of(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return fingerprint


def _below(x: np.ndarray) -> np.ndarray:
    """All bits up to the highest one."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return x


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _nearest_first(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The label after uniting along a, b, and the places of the pairs that do so: the nearest one of each component, again and again."""
    used, at = [np.zeros(0, np.int64)], np.argsort(apart, kind="stable")
    while True:
        x, y = label[a[at]], label[b[at]]
        differ = x != y
        if not differ.any():
            return label, np.concatenate(used)
        at, x, y = at[differ], x[differ], y[differ]
        of, place = np.concatenate([x, y]), np.tile(np.arange(len(at)), 2)
        by = np.lexsort((place, of))
        pick = np.unique(place[by[np.append(True, of[by[1:]] != of[by[:-1]])]])
        used.append(at[pick])
        label = _unite(label, a[at[pick]], b[at[pick]])


def trie_forest(fp: np.ndarray, begin: np.ndarray, end: np.ndarray, budget: int = BUDGET, rest: np.ndarray | None = None, total: int | None = None, label: np.ndarray | None = None, fits=None, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints that are sorted inside each range begin:end, the least index that each one reaches by links in its range, and the links that show it.

    The links are two rows of indices: a spanning forest with few pairs besides, or with `every` all pairs that link different
    components of `label`, which stay as they are. With further words of the fingerprints in `rest`, a link also needs at
    most `total` differing bits in all words, and nearer pairs are preferred. label: components that are known before.
    fits(i, j, differing bits): which pairs may be links at all.
    """
    label = np.arange(len(fp)) if label is None else label
    pairs = [np.zeros((2, 0), np.int64)]
    wide = end - begin > 1
    stack = [(begin[wide], end[wide], begin[wide], end[wide])]
    changes, fresh = np.zeros(len(fp), np.int64), False
    step = STEP if rest is None else STEP // (1 + rest.shape[1])
    while stack:
        a, b, c, d = stack.pop()
        if len(a) > step:
            half = len(a) - step
            stack.append((a[:half], b[:half], c[:half], d[:half]))
            a, b, c, d = a[half:], b[half:], c[half:], d[half:]
        if not fresh:
            changes[1:] = np.cumsum(label[1:] != label[:-1])
            fresh = True
        apart = (changes[b - 1] != changes[a]) | (changes[d - 1] != changes[c]) | (label[a] != label[c])
        left, right = _below(fp[a] ^ fp[b - 1]), _below(fp[c] ^ fp[d - 1])
        near = np.bitwise_count((fp[a] ^ fp[c]) & ~(left | right)) <= budget
        go = apart & near
        a, b, c, d, left, right = a[go], b[go], c[go], d[go], left[go], right[go]
        direct = (b - a) * (d - c) <= DIRECT
        if direct.any():
            x, y = a[direct], c[direct]
            n, m = b[direct] - x, d[direct] - y
            each = n * m
            of = np.repeat(np.arange(len(x)), each)
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = x[of] + inside // m[of], y[of] + inside % m[of]
            differ = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
            hit = (label[i] != label[j]) & (differ <= budget)
            i, j, differ = i[hit], j[hit], differ[hit]
            if rest is not None:
                differ += np.bitwise_count(rest[i] ^ rest[j]).sum(axis=1, dtype=np.int64)
                hit = differ <= total
                i, j, differ = i[hit], j[hit], differ[hit]
            if fits is not None:
                hit = fits(i, j, differ)
                i, j, differ = i[hit], j[hit], differ[hit]
            if every:
                pairs.append(np.stack([i, j]))
            elif len(i):
                label, used = _nearest_first(label, i, j, differ)
                pairs.append(np.stack([i[used], j[used]]))
                fresh = False
        a, b, c, d, left, right = a[~direct], b[~direct], c[~direct], d[~direct], left[~direct], right[~direct]
        if not len(a):
            continue
        same = a == c
        swap = (right > left) | ((right == left) & (d - c > b - a))  # the node that branches higher is split, or the larger one
        a, b, c, d, left = np.where(swap, c, a), np.where(swap, d, b), np.where(swap, a, c), np.where(swap, b, d), np.where(swap, right, left)
        top = left ^ (left >> np.uint64(1))
        low, high = a.copy(), b.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            one = (fp[np.minimum(mid, len(fp) - 1)] & top) != 0
            high = np.where(open_ & one, mid, high)
            low = np.where(open_ & ~one, mid + 1, low)
        low = np.where(top == 0, (a + b) >> 1, low)  # equal first words
        own, other = same, ~same
        stack.append((np.concatenate([a[other], low[other], a[own]]), np.concatenate([low[other], b[other], low[own]]), np.concatenate([c[other], c[other], low[own]]), np.concatenate([d[other], d[other], b[own]])))
        stack.append((np.concatenate([a[own], low[own]]), np.concatenate([low[own], b[own]]), np.concatenate([a[own], low[own]]), np.concatenate([low[own], b[own]])))
    return label, np.concatenate(pairs, axis=1)


def likely_bits(n: np.ndarray) -> np.ndarray:
    """The most of 256 bits that differ between a set of n shingles and one with a similarity of 0.8, but for one pair in a thousand.

    A bit differs with a chance of 0.1515 between large sets; ties in the votes of small ones add to that (3/16 for 5 and 4).
    """
    chance = 0.1515 + 0.16 / np.maximum(n, 4)
    return 256 * chance + 3 * np.sqrt(256 * chance * (1 - chance))


def _join(budget: int, words: list[str], totals: tuple, more: list[str]):
    """more: none, for links to the least of each component; or n and e, the size of a set and the most it can share, for links between near ones; or these and comp, its component so far, for all links between different ones."""

    def pairs(held: list[dict], last: bool):
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        cuts = np.flatnonzero((x["key"][1:] != x["key"][:-1]).any(axis=1)) + 1
        whole = len(x["fp"]) if last else int(cuts[-1]) if len(cuts) else 0
        kept = [{k: v[whole:] for k, v in x.items()}]
        x = {k: v[:whole] for k, v in x.items()}
        links = np.zeros((2, 0), np.int64)
        if whole:
            begin = np.concatenate([[0], cuts[cuts < whole]]).astype(np.int64)
            fits, every = None, "comp" in more
            if more:
                most = likely_bits(x["n"])
                fits = lambda i, j, differ: ((WHOLE + ENOUGH) * np.minimum(x["e"][i], x["e"][j]) >= ENOUGH * (x["n"][i] + x["n"][j])) & (differ <= np.maximum(most[i], most[j]))
            label = x["comp"] if every else None
            if not more:  # rows with one name are one component before
                _, at, own = np.unique(x["rep"], return_index=True, return_inverse=True)
                label = at[own.reshape(-1)]
            for total in totals:  # small ones first, so that near pairs come before wide ones
                label, found = trie_forest(x["fp"], begin, np.append(begin[1:], whole), budget, x["rest"] if words else None, total, label, fits, every)
                if more:
                    links = np.concatenate([links, x["rep"][found]], axis=1)
            if not more:  # to the least of each component, so that many buckets give the same links
                least = np.full(whole, np.iinfo(np.int64).max)
                np.minimum.at(least, label, x["rep"])
                far = least[label] != x["rep"]
                links = np.stack([x["rep"][far], least[label][far]])
            links = np.unique(np.sort(links, axis=0), axis=1)
        return kept, pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])

    def join(batches):
        held, n = [], 0
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            rows = {"key": np.stack([column(c).astype(np.int64) for c in ("blocks", "key", "t", "u")], axis=1), "fp": column("flipped").view(np.uint64) ^ np.uint64(1 << 63), "rep": column("rep")}
            if words:
                rows["rest"] = np.stack([column(c).view(np.uint64) for c in words], axis=1)
            held.append(rows | {c: column(c) for c in more})
            n += batch.num_rows
            if n >= JOIN_ROWS // (1 + len(words)):
                held, found = pairs(held, False)
                n = len(held[0]["fp"])
                yield found
        if n:
            yield pairs(held, True)[1]

    return join


def links(classes: DataFrame, budget: int = BUDGET, agree: int = AGREE) -> DataFrame:
    """Edges a, b between rep values of classes(fp, rep) that join up just what fingerprints with at most `budget` differing bits do."""
    blocks = budget + agree
    edges = [64 * i // blocks for i in range(blocks + 1)]
    mask = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = F.array(*(F.struct(F.lit(i).alias("blocks"), F.col("fp").bitwiseAND(F.lit(signed(sum(mask[x] for x in own)))).alias("key")) for i, own in enumerate(combinations(range(blocks), agree))))
    return _met(classes.select("fp", "rep", F.explode(pairs).alias("k")).select("fp", "rep", "k.blocks", "k.key"), budget)


def _met(keyed: DataFrame, budget: int, words: tuple[str, ...] = (), totals: tuple = (None,), more: tuple[str, ...] = ()) -> DataFrame:
    """Links a, b of each bucket of keyed(blocks, key, fp, rep, and the columns `words` and `more`): a spanning forest and a few more, or with comp among `more` all links between different components."""
    large = stored(keyed.groupBy("blocks", "key").count().where(F.col("count") > BUCKET_ROWS).withColumn("parts", F.ceil(F.col("count") / BUCKET_ROWS).cast("int")).drop("count"))
    if large.isEmpty():
        dealt = keyed.withColumns({"t": F.lit(0), "u": F.lit(0)})
    else:
        parts = F.coalesce("parts", F.lit(1))
        own = keyed.join(large, ["blocks", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        dealt = own.withColumn("v", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"t": F.least("own", "v"), "u": F.greatest("own", "v")})
    key = ["blocks", "key", "t", "u"]
    dealt = dealt.select(*key, F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("flipped"), "rep", *words, *more)
    return dealt.repartition(*key).sortWithinPartitions(*key, "flipped").mapInArrow(_join(budget, list(words), totals, list(more)), "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and component_id of every row of docs(doc_id, text, ...).

    Documents are linked if their fingerprints differ in at most `budget` bits; component_id is the smallest doc_id that
    links reach. Null and empty texts have fingerprint zero. A null doc_id stays null, and names a component only where all are
    null. Rows that repeat a doc_id stay rows of their own, and join nothing by it: fingerprints are linked, not doc_ids.
    Long texts are hashed in pieces of SLICE_BYTES. Other columns are ignored.
    """
    prints = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint(shingle), "doc_id long, fp long"))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.select("fp", F.col("fp").alias("rep")), budget))
    parts = classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    least = parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    whole = parts.join(least, "part").select("fp", "component_id")
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: list[bytes], shingle: int = COPY_SHINGLE) -> list[np.ndarray]:
    """The different shingle hashes of each text, rising."""
    return _looked_at(texts, shingle, 0, SEED, True)[1]


def _long_fingerprint(shingle: int):
    def fingerprint(batches):
        for batch in sliced(batches, limit=SLICE_BYTES // COPY_WORDS):
            texts = texts_of(batch.column("text"))
            values, sets = _looked_at(texts, shingle, COPY_WORDS, SEED, True)
            values = values.view(np.int64)
            rep = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            # two sets similar enough share one of so many least hashes of each
            keys = [x[: len(x) - -(-ENOUGH * len(x) // WHOLE) + 1].view(np.int64) if 0 < len(x) * ENOUGH < FEW * WHOLE else () for x in sets]
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(rep), pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, values.T.copy()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "rep", "n", "fp", "w1", "w2", "w3", "keys"])

    return fingerprint


def band_plan(classes: int) -> tuple[int, int]:
    """Bits of a band and number of bands, for so many different texts.

    Bits grow with the logarithm of the number, so a band holds no more unrelated texts in a larger corpus; bands follow from
    them, so that two texts with MISSED_AT of their bits different share no band with a chance of MISSED at most.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, classes) / 4)))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - MISSED_AT) ** bits)))


def _bands(bits_each: int, bands: int, more: tuple[str, ...] = (), begin: int = 0, end: int | None = None):
    """A row for each band from begin to end of each class, the bands are the same in every task; and with the first band one for each of its keys."""
    drawn_of, bands = bands, (bands if end is None else end) - begin

    def banded(batches):
        drawn = np.random.default_rng(SEED)
        places = np.concatenate([drawn.permutation(64 * COPY_WORDS)[:bits_each] for _ in range(drawn_of)][begin : begin + bands])
        prints, names = ["fp", "w1", "w2", "w3"], ["rep", "fp", "w1", "w2", "w3", *more]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                large = np.flatnonzero(part.column("n").to_numpy(zero_copy_only=False) >= FEW)
                words = np.stack([part.column(c).to_numpy(zero_copy_only=False)[large] for c in prints], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(large), 8 * COPY_WORDS), axis=1)
                key = bits[:, places].reshape(len(large) * bands, bits_each) @ (1 << np.arange(bits_each))
                keys = part.column("keys").to_pylist() if not begin else []
                own = np.array([k for x in keys for k in x], np.int64)
                rows = pa.array(np.concatenate([np.repeat(large, bands), np.repeat(np.arange(len(keys)), list(map(len, keys)))]).astype(np.int64))
                blocks = np.concatenate([np.tile(np.arange(begin, begin + bands, dtype=np.int32), len(large)), np.full(len(own), drawn_of, np.int32)])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in names), pa.array(blocks), pa.array(np.concatenate([key.astype(np.int64), own]))], [*names, "blocks", "key"])

    schema = "".join(f"{c} long, " for c in ("rep", "fp", "w1", "w2", "w3", *more)) + "blocks int, key long"
    return lambda classes: classes.mapInArrow(banded, schema)


def _sets(shingle: int):
    def sets(batches):
        for batch in sliced(batches):
            found = [x.tobytes() for x in shingle_sets(texts_of(batch.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("cluster"), pa.array(found, pa.binary())], ["rep", "cluster", "shingles"])

    return sets


def _each_shingle(batches):
    for batch in sliced(batches, "shingles"):
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("shingles")]
        of = pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets))))
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(of), batch.column("cluster").take(of), pa.array(np.concatenate(sets))], ["rep", "cluster", "h"])


def _by_rare(rare: DataFrame, size: DataFrame) -> DataFrame:
    """Pairs a, b that share a shingle of rare(rep, cluster, h, c) among the first ones of both, for size(rep, n)."""
    place = F.row_number().over(Window.partitionBy("rep").orderBy("c", "h"))
    first = rare.join(size, "rep").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * ENOUGH / WHOLE) + 1)
    groups = first.where("c > 1").groupBy("cluster", "h").agg(F.sort_array(F.collect_list("rep")).alias("reps"))  # RARE at most
    pairs = F.expr("flatten(transform(reps, (x, i) -> transform(slice(reps, i + 2, size(reps)), y -> struct(x AS a, y AS b))))")
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _similar(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(WHOLE * both >= ENOUGH * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets of shingles have a similarity of 0.8 or more."""
    pairs, sets = stored(pairs.distinct()), sets.select("rep", "shingles")
    held = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    out = stored(held.mapInArrow(_similar, "a long, b long"))
    release(pairs)
    return out


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text) and part of every row of docs(doc_id, text, ...), linked at a shingle similarity of 0.8 or more.

    A class is the rows with one set of shingles, and part is the class that names a component. Classes that share a band (a
    key if they are small) meet:
    1. Those with at most WIDE_BUDGET of 256 bits different form clusters.
    2. Shingles that no more than RARE of a cluster's classes have link few pairs: all pairs that share one, among the first
       of both in the order of rarity, are decided by the sets. (Similar sets that share a rare one share one of those.)
    3. Pairs that share none can only share the rest. Classes of which that leaves too little drop out; the others propose a
       forest, nearest pairs first, which the sets decide.
    4. All pairs that may be similar by size and by that rest, and that are not joined so far, are decided by the sets.
    So a large group of copies of one text that aren't similar to each other is settled in 2 and 3 as far as their changes are
    rare, and not pair by pair.
    README.md has the measured recall. Null and empty texts are one class. A null doc_id stays null. Rows that repeat a doc_id
    join nothing by it. Long texts are hashed in pieces. Other columns are ignored.
    """
    words, rest = ["fp", "w1", "w2", "w3"], ("w1", "w2", "w3")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    prints = stored(marked.mapInArrow(_long_fingerprint(shingle), "doc_id long, mark long, rep long, n long, fp long, w1 long, w2 long, w3 long, keys array<long>"))
    classes = stored(prints.groupBy("rep").agg(F.min(F.struct("mark", "n", *words, "keys")).alias("c")).select("rep", "c.*"))
    plan = band_plan(classes.count())
    part = components(_met(_bands(*plan, end=FIRST_BANDS)(classes), WIDE_FIRST, rest, (WIDE_BUDGET,)))
    named = classes.join(part, classes.rep == part.node, "left").withColumn("rep", F.coalesce("component", "rep")).select(*classes.columns)
    more = _met(_bands(*plan, begin=FIRST_BANDS)(named), WIDE_FIRST, rest, (WIDE_BUDGET,))  # what the first bands have joined gives no links here
    wide = components(part.toDF("a", "b").unionByName(more))
    clusters = wide.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).unionByName(wide.select(F.col("component").alias("rep"), F.col("component").alias("cluster")).distinct())
    members = stored(classes.join(clusters, "rep"))
    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(members.select("rep", "cluster", "mark"), "mark").dropDuplicates(["rep"]).select("rep", "cluster", "text")
    sets = stored(texts.mapInArrow(_sets(shingle), "rep long, cluster long, shingles binary"))
    each = sets.mapInArrow(_each_shingle, "rep long, cluster long, h long")
    few = each.groupBy("cluster", "h").agg(F.count("*").alias("c")).where(F.col("c") <= RARE)
    rare = stored(each.join(few, ["cluster", "h"]))
    shared = members.join(rare.groupBy("rep").agg(F.count("*").alias("u")), "rep", "left").withColumn("e", F.col("n") - F.coalesce("u", F.lit(0)))
    able = stored(shared.where(F.col("e") * WHOLE >= F.col("n") * ENOUGH).select("rep", "n", "e", *words, "keys"))
    near = _met(_bands(*plan, ("n", "e"))(able), WIDE_FIRST, rest, STEPS, ("n", "e"))
    first = _verified(near.unionByName(_by_rare(rare, members.select("rep", "n"))), sets)
    joined = components(first)
    parts = stored(able.join(joined, able.rep == joined.node, "left").withColumn("comp", F.coalesce("component", "rep")).select(*able.columns, "comp"))
    second = _verified(_met(_bands(*plan, ("n", "e", "comp"))(parts), WIDE_FIRST, rest, (WIDE_BUDGET,), ("n", "e", "comp")), sets)
    found = components(first.unionByName(second))
    release(classes, members, sets, rare, able, parts, first, second)
    return prints.select("doc_id", "mark", "rep").join(found, F.col("rep") == found.node, "left").select("doc_id", "mark", F.coalesce("component", "rep").alias("part"))


def with_component_id(found: DataFrame) -> DataFrame:
    """near_copies() with component_id, the smallest doc_id of the component, null if it has none."""
    return found.join(found.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
