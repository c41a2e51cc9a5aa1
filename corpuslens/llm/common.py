"""What several operators share: tables in the shared folder, batches of bounded size, words and substring hashes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..storage import release, shared_folder, stored  # noqa: F401  for the operators

SPACE, NEWLINE = 32, 10
#: Bytes of text that the vectorised operators look at in one go.
SLICE_BYTES = 2 << 20


def carried(docs: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The schema of the given columns of docs and of more ones."""
    return T.StructType([docs.schema[c] for c in columns] + T.StructType.fromDDL(more).fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Gives freed memory back, as workers serve one stage after another."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows and `limit` bytes in `column`, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(at, to - at)
            at = to
    _trim()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, overlap: int, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `limit` bytes, cut between words; each begins with the last `overlap` words of the one before.

    All pieces but an only one have more words than `overlap`, so each run of overlap + 1 words is in just one of them.
    """
    at, held, first = 0, b"", True
    while at < len(text):
        cut = _BREAK.search(text, at + limit)
        to = cut.start() if cut else len(text)
        held, at = held + text[at:to], to
        words = held.split()
        if len(words) > overlap:
            yield held
            held, first = b" ".join(words[len(words) - overlap :]) if overlap else b"", False
    if first:
        yield held


def ids_of(column: pa.Array, missing: int = 2**63 - 1) -> np.ndarray:
    """int64 ids; a null sorts after all others."""
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


class Words:
    """Words (maximal runs of bytes other than 0x20 and 0x09-0x0D) of several texts in one buffer.

    Texts are joined by newlines and their words by single spaces, so equal word sequences are equal substrings.
    start, end: of each word in the buffer; first[d]:first[d + 1] are the words of text d.
    """

    def __init__(self, texts: list[bytes]):
        self._cut(b"\n".join([b" ".join(t.split()) for t in texts]), len(texts))

    @classmethod
    def packed(cls, blob: bytes, n: int) -> Words:
        """Of a buffer that holds n texts in this form already."""
        self = cls.__new__(cls)
        self._cut(blob, n)
        return self

    def _cut(self, blob: bytes, n: int) -> None:
        self.blob = blob
        self.buffer = np.frombuffer(blob, np.uint8)
        breaks = np.flatnonzero((self.buffer == SPACE) | (self.buffer == NEWLINE))
        start, end = np.empty(len(breaks) + 1, np.int64), np.empty(len(breaks) + 1, np.int64)
        start[0], end[-1] = 0, len(blob)
        start[1:], end[:-1] = breaks + 1, breaks
        real = end > start
        new_text = np.zeros(len(start), np.int64)
        new_text[1:] = self.buffer[breaks] == NEWLINE
        of = np.cumsum(new_text)[real]
        self.start, self.end = start[real], end[real]
        self.first = np.searchsorted(of, np.arange(n + 1))
        self.of = of


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        row = np.full(max(n, SLICE_BYTES // 2 + 4096), base, np.uint64)
        row[0] = 1
        _powers[name] = np.cumprod(row)
    return _powers[name]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class SubstringHash:
    """64-bit polynomial hashes of any substrings of a buffer, from one running sum; equal bytes give equal hashes."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buffer] * _power("up", _BASE, n + 1)[:n], out=self.sum[1:])
        self.down = _power("down", pow(_BASE, -1, 2**64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sum[end] - self.sum[start]) * self.down[start])
