"""Packing by best-fit decreasing.

Documents become token ids where they are read; an overlong one is first cut into full windows. Only the pieces' lengths
are shuffled, into groups of neighbouring pieces, so an order that documents had before is kept from group to group. In a
group, pieces go from the longest to the shortest, each into the open window with the least room that is enough, which a
segment tree indexed by remaining capacity finds.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import numbered
from .common import release, sliced, stored, table

WINDOW, END_ID = 2048, 1
#: Pieces that are packed together.
GROUP_PIECES = 8192


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids as the tokenizers library has them for a byte-level BPE file; that file's merges, run by tiktoken.

    Texts that are too much for tiktoken's pattern matcher, such as a million spaces in a row, go to tokenizers itself.
    """
    import tiktoken

    import public_tokenizers

    said = json.loads(Path(path).read_text())
    special = {x["content"]: x["id"] for x in said["added_tokens"] if x["special"]}
    plain = sorted(set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256)))
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in special}
    coding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    plainer = lru_cache(maxsize=1)(lambda: __import__("tokenizers").Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        try:
            return coding.encode(text, allowed_special="all")
        except ValueError:  # the matcher's stack
            return plainer().encode(text, add_special_tokens=False).ids

    return encode


def _tokenize(path: str, window: int, with_ids: bool):
    def tokenize(batches):
        encode = encoder(path)
        for batch in sliced(batches):
            rows = {k: [] for k in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for row, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window].tobytes()
                    for k, v in zip(rows, (row, doc, at, len(piece) // 4, crc32(piece), len(ids), piece), strict=True):
                        rows[k].append(v)
            names = list(rows)[1 : 6 + with_ids]
            place = batch.column("place").take(pa.array(rows["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays([place, *(pa.array(rows[k], pa.binary() if k == "ids" else pa.int64()) for k in names)], ["place", *names])

    return tokenize


class OpenWindows:
    """Counts of open windows by remaining capacity, in a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        node, count = self.leaves + room, self.count
        while node:
            count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least `need` that an open window has; -1 if none has."""
        node, count = self.leaves + need, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return -1
            node += 1
        while node < self.leaves:
            node <<= 1
            node += not count[node]
        return node - self.leaves


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; lengths must not rise."""
    tree, open_, used, number, offset = OpenWindows(window), [[] for _ in range(window + 1)], 0, [], []
    for need in lengths:
        room = tree.tightest(need) if need < window else -1
        if room < 0:
            at, room, used = used, window, used + 1
        else:
            at = open_[room].pop()
            tree.change(room, -1)
        number.append(at)
        offset.append(window - room)
        if room > need:
            open_[room - need].append(at)
            tree.change(room - need, 1)
    return number, offset


def _pack_group(window: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("rk", "ascending")])
        number, offset = best_fit(rows.column("length").to_pylist(), window)
        number, rk = np.array(number, np.int64), rows.column("rk").to_numpy()
        first = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, rk)
        place = np.empty(len(first), np.int64)
        place[np.argsort(first)] = np.arange(len(first))  # windows in the order of their first pieces
        ids = rows.column("g")[0].as_py() * 2**32 + place[number]
        return rows.drop_columns(["g", "rk"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))

    return pack


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def written_order(docs: DataFrame) -> list[Column]:
    """The place of each row in the files that docs was read from; empty if it wasn't read from Parquet files."""
    place = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    if "_metadata" in docs.columns:
        return []
    try:
        docs.select(*place).schema
    except AnalysisException:
        return []
    return place


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False, by: list[Column] | None = None) -> DataFrame:
    """A row for each piece of each row of docs(doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With with_ids also ids, as little-endian unsigned 32-bit numbers. A null or empty text is the end id alone. Rows that
    repeat a doc_id are documents of their own; a null doc_id stays null. A text of any length is tokenised whole, and its
    ids are in memory once. by: an order of the documents (by doc_id if empty); GROUP_PIECES neighbours are packed
    together, and sequence_id rises with the order of the groups and of each window's first piece. Other columns are ignored.
    """
    more = ", ids binary" if with_ids else ""
    placed = docs.select(F.struct(*(c.alias(f"p{i}") for i, c in enumerate(by or [F.col("doc_id")]))).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([placed.schema["place"], *T.StructType.fromDDL(PIECES + more)])
    pieces = stored(placed.mapInArrow(_tokenize(tokenizer or default_tokenizer(), window, with_ids), schema))
    order = ["place", "doc_id", "start", "ids_crc32", "tie"]  # the tie breaker lets equal rows be dealt to several tasks
    ranked = numbered(pieces.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), *order)
    out = ranked.drop("place", "tie").withColumn("g", F.floor(F.col("rk") / GROUP_PIECES))
    release(pieces)
    return out.groupBy("g").applyInArrow(_pack_group(window), f"{PIECES}{more}, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, length and ids of each window of pack(..., with_ids=True), padded to the window unless its length is a power of two."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(rows.sort_values("offset")["ids"]), "<u4")
        size = len(ids) if len(ids).bit_count() == 1 else window
        return pd.DataFrame({"sequence_id": rows["sequence_id"].iloc[:1], "length": len(ids), "ids": [np.concatenate([ids, np.full(size - len(ids), pad_id, "<u4")]).astype(np.int32)]})

    return packed.groupBy("sequence_id").applyInPandas(fill, "sequence_id long, length long, ids array<int>")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; nulls, empty and long texts and repeated rows as in pack()."""
    return pack(table(spark, sf_dir, "documents"))
