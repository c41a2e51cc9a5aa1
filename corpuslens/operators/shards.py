"""The index of a shard, which is a bounded lot of whole documents, as arrays in one task.

A document lies in one shard, so listing over a collection is listing over its shards. A shard has the arrays of the index
(schemas.INDEX) over its own suffixes: suffix array, document array, neighbours, ranks, LCP values, merged runs, grammars and
sampled lists. Each is made when a plan first asks for it, over all rows of the shard; of grammars, one for each stretch of
rows that an interval meets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .blocks import ARITY, BLOCK_SIZE, STORING_FACTOR
from .compressed import STRETCH, Grammar, compress
from .suffixes import KEY_LENGTH, run_minima

#: Characters of a shard; a longer document is a shard by itself.
SHARD = 1 << 20


def lots(batches: Iterable[pa.RecordBatch], characters: int = SHARD) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of the documents with a text, in lots of about so many characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                if ids and size + len(text) > characters:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(doc), texts.append(text)
                size += len(text)
    if ids:
        yield ids, texts


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x from `by` places on, 0 behind the end."""
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def _by_document(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of documents, those of one document in their own order; and where each document begins there."""
    order = np.argsort(docs.astype(np.uint16) if len(docs) and docs.max() < 1 << 16 else docs, kind="stable")
    ranked = docs[order]
    return order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(docs)])


def counted(docs: np.ndarray, freq: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each document and how often it is there, or the sum of its frequencies."""
    order, heads = _by_document(docs)
    sums = np.diff(np.append(heads, len(docs))) if freq is None else np.add.reduceat(freq[order], heads) if len(docs) else freq
    return docs[order[heads]], sums


def spread(docs: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document, and its frequency from the least and the largest of its places."""
    order, heads = _by_document(docs)
    if not len(docs):
        return docs, place
    own = place[order]
    return docs[order[heads]], np.maximum.reduceat(own, heads) - np.minimum.reduceat(own, heads) + 1


class Shard:
    """Documents are numbered from 0 in the order of `texts`, of which none is empty; rows are places of the suffix array."""

    def __init__(self, texts: list[str], key_length: int = KEY_LENGTH, block_size: int = BLOCK_SIZE, storing_factor: int = STORING_FACTOR, stretch: int = STRETCH, arity: int = ARITY):
        self.key_length, self.block_size, self.storing_factor, self.stretch, self.arity = key_length, block_size, storing_factor, stretch, arity
        self.grammars: dict[int, Grammar] = {}
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1)  # behind the 0 that ends each document
        self.starts = self.ends - sizes - 1
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.symbol = np.zeros(int(codes.max()) + 1, np.int32)
        self.symbol[codes] = 1
        self.symbol *= np.cumsum(self.symbol)  # 1, 2, ... in the order of code points; 0 is in no text
        self.sigma = int(self.symbol.max())
        kind = np.uint8 if self.sigma < 1 << 8 else np.uint16 if self.sigma < 1 << 16 else np.uint32
        own = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.codes = np.zeros(int(self.ends[-1]), kind)
        self.codes[np.arange(len(codes)) + own] = self.symbol[codes]

    @cached_property
    def words(self) -> tuple[np.ndarray, int]:
        """As many characters from each place on as a number of 63 bits takes, and how many these are."""
        bits = self.sigma.bit_length()
        word, width, most = self.codes.astype(np.int64), 1, min(self.key_length, 63 // bits)
        while width < most:
            step = min(width, most - width)
            word = (word << (bits * step)) | (_ahead(word, width) >> (bits * (width - step)))
            width += step
        return word, width

    @cached_property
    def sa(self) -> np.ndarray:
        """The suffixes by their first key_length characters: a sort by the words, then prefix doubling of what is equal so far."""
        (word, width), n = self.words, len(self.codes)
        order = np.argsort(word)
        fresh = np.append(True, np.diff(word[order]) != 0)
        rank = np.empty(n, np.int64)
        while True:
            number = np.cumsum(fresh)
            rank[order] = number
            tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
            if width >= self.key_length or not len(tied):
                break
            step = min(width, self.key_length - width)
            at = order[tied]
            pair = (number[tied] << 32) | _ahead(rank, step)[at]  # groups stay in their places
            sort = np.argsort(pair)
            order[tied], pair = at[sort], pair[sort]
            fresh[tied[1:]] |= np.diff(pair) != 0
            width += step
        return order[len(self.ends) :]  # the 0s come first

    @cached_property
    def da(self) -> np.ndarray:
        """The document of each row."""
        return np.repeat(np.arange(len(self.ends), dtype=np.int32), self.ends - self.starts)[self.sa]

    @cached_property
    def _own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows by document; the first of each document there; and whether the row behind is of the same document."""
        order, heads = _by_document(self.da)
        return order, heads, self.da[order[1:]] == self.da[order[:-1]]

    @cached_property
    def prev(self) -> np.ndarray:
        """The row before of the same document, or -1."""
        order, _, same = self._own
        out = np.full(len(order), -1)
        out[order[1:][same]] = order[:-1][same]
        return out

    @cached_property
    def next(self) -> np.ndarray:
        """The row behind of the same document, or one behind the end."""
        order, _, same = self._own
        out = np.full(len(order), len(order))
        out[order[:-1][same]] = order[1:][same]
        return out

    @cached_property
    def occ(self) -> np.ndarray:
        """How often its document stands before each row in the document array."""
        order, heads, _ = self._own
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        return out

    @cached_property
    def isa(self) -> np.ndarray:
        """The place of each row among its document's own suffixes, which each document orders for itself."""
        at, place = np.empty(len(self.codes), np.int64), np.empty(len(self.codes), np.int64)
        at[self.sa] = np.arange(len(self.sa))
        for start, end in zip(self.starts.tolist(), (self.ends - 1).tolist(), strict=True):
            place[start + np.argsort(at[start:end])] = np.arange(end - start)
        return place[self.sa]

    @cached_property
    def _shared(self) -> np.ndarray:
        """Characters that two neighbouring rows of a document share, up to key_length; a document ends by a 0 that it has once."""
        order, _, same = self._own
        a, b = self.sa[order[:-1][same]], self.sa[order[1:][same]]
        (word, width), bits = self.words, self.sigma.bit_length()
        out, left = np.zeros(len(a), np.int32), np.arange(len(a))
        for at in range(0, self.key_length, width):
            other = word[a] ^ word[b]
            differ = other != 0
            found = other[differ]
            highest = np.frexp((found & ~(found >> 1)).astype(np.float64))[1]  # without its second bit, no number is rounded up to the next power
            out[left[differ]] = at + (bits * width - highest) // bits
            left, a, b = left[~differ], a[~differ] + width, b[~differ] + width
        out[left] = self.key_length
        return np.minimum(out, self.key_length)

    @cached_property
    def ilcp_b(self) -> np.ndarray:
        """Characters shared with the document's row before; 0 where there is none."""
        order, _, same = self._own
        out = np.zeros(len(order), np.int32)
        out[order[1:][same]] = self._shared
        return out

    @cached_property
    def ilcp_f(self) -> np.ndarray:
        """Characters shared with the document's row behind; 0 where there is none."""
        order, _, same = self._own
        out = np.zeros(len(order), np.int32)
        out[order[:-1][same]] = self._shared
        return out

    @cached_property
    def min_b(self) -> np.ndarray:
        return run_minima(self.ilcp_b, self.da)

    @cached_property
    def min_f(self) -> np.ndarray:
        return run_minima(self.ilcp_f, self.da)

    def grammar(self, i: int) -> Grammar:
        """The grammar of the i-th stretch of the document array."""
        if i not in self.grammars:
            self.grammars[i] = Grammar(*compress(self.da[i * self.stretch : (i + 1) * self.stretch]))
        return self.grammars[i]

    @cached_property
    def lists(self) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """For each level of nodes from 1 on, the documents and frequencies of the nodes that are stored."""
        n, out = len(self.da), []
        rows = np.arange(n)
        cost = np.bincount(rows // self.block_size)
        span = self.block_size
        while span < n:
            span *= self.arity
            node = rows // span
            own = np.bincount(node, self.prev < node * span).astype(np.int64)
            cost = np.add.reduceat(cost, np.arange(0, len(cost), self.arity))
            pays = cost > self.storing_factor * own
            cost = np.where(pays, own, cost)
            out.append({i: counted(self.da[i * span : (i + 1) * span]) for i in np.flatnonzero(pays).tolist()})
        return out

    def interval(self, pattern: str) -> tuple[int, int]:
        """First row and the one behind the last whose suffix begins with the pattern's first key_length characters."""
        want = [int(self.symbol[c]) if c < len(self.symbol) else 0 for c in map(ord, pattern[: self.key_length])]
        if 0 in want:
            return 0, 0
        bounds = []
        for behind in (False, True):
            low, high = 0, len(self.sa)
            while low < high:
                mid = (low + high) // 2
                at = int(self.sa[mid])
                have = self.codes[at : at + len(want)].tolist()
                if have < want or behind and have == want:
                    low = mid + 1
                else:
                    high = mid
            bounds.append(low)
        return bounds[0], bounds[1]

    def rows(self, pattern: str) -> np.ndarray:
        """The rows whose suffixes begin with the pattern; what is longer than key_length is compared in the text."""
        found = np.arange(*self.interval(pattern))
        for k, c in enumerate(map(ord, pattern[self.key_length :]), self.key_length):
            want = int(self.symbol[c]) if c < len(self.symbol) else 0
            found = found[self.codes[np.minimum(self.sa[found] + k, len(self.codes) - 1)] == want] if want else found[:0]
        return found

    def places(self, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """Document and position there of each occurrence."""
        found = self.rows(pattern)
        return self.da[found], self.sa[found] - self.starts[self.da[found]]

    def list(self, pattern: str, strategy: str) -> tuple[np.ndarray, np.ndarray]:
        """The documents with the pattern and its frequency in each.

        The interval of a pattern longer than key_length isn't known; its occurrences are counted one by one.
        """
        if strategy == "suffix" or len(pattern) > self.key_length:
            return counted(self.da[self.rows(pattern)])
        low, high = self.interval(pattern)
        if low == high:
            return self.da[:0], np.zeros(0, np.int64)
        family, _, place = strategy.partition("_")
        if family == "preagg":
            return self._aggregated(low, high)
        if family == "gcda":
            rows = self._ends(low, high)
        elif family == "sada":
            rows = low + np.flatnonzero((self.prev[low:high] < low) | (self.next[low:high] >= high))
        else:
            before, after = (self.ilcp_b, self.ilcp_f) if family == "ilcp" else (self.min_b, self.min_f)
            rows = low + np.flatnonzero((before[low:high] < len(pattern)) | (after[low:high] < len(pattern)))
        return spread(self.da[rows], (self.isa if place == "isa" else self.occ)[rows])

    def _ends(self, low: int, high: int) -> np.ndarray:
        """Rows with the first and the last of each document in each stretch of the interval, from the grammars."""
        found = []
        for i in range(low // self.stretch, (high - 1) // self.stretch + 1):
            base = i * self.stretch
            _, first, last = self.grammar(i).first_last(max(low - base, 0), min(high - base, self.stretch) - 1)
            found += [first + base, last + base]
        return np.concatenate(found)

    def _aggregated(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest stored lists in the interval and the rows between them, added up."""
        docs, freq, at, unit = [], [], low, self.block_size * self.arity
        while at < high:
            for k in range(len(self.lists), 0, -1):
                span = self.block_size * self.arity**k
                if at % span == 0 and at + span <= high and at // span in self.lists[k - 1]:
                    own, n = self.lists[k - 1][at // span]
                    end = at + span
                    break
            else:
                end = min(high, (at // unit + 1) * unit)
                own, n = self.da[at:end], np.ones(end - at, np.int64)
            docs.append(own), freq.append(n)
            at = end
        return counted(np.concatenate(docs), np.concatenate(freq))
