"""Document listing with frequencies: interchangeable plans for one logical query.

search(patterns) returns pattern_id, doc_id, freq: for each pattern, the documents that hold it and the number of its
occurrences, overlapping ones included. Matching is exact and case-sensitive; documents without an occurrence are absent;
repeated patterns are answered each for itself. An empty pattern is an error.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..operators.blocks import covered
from ..operators.compressed import first_last_rows
from ..operators.shards import Shard, lots
from ..storage import stored
from .index import DocIndex, Shards

#: Most pattern characters that are sent to every task of a scan; with more, patterns are scanned in lots of that size.
SCAN_CHARACTERS = 1 << 20
#: Most patterns that a scan searches one by one.
ONE_BY_ONE = 24
#: So many different patterns are also pushed to the file scan, which then skips row groups by their key range.
PUSHED = 64


def checked(patterns: DataFrame) -> DataFrame:
    """patterns(pattern_id, pattern), after a look at its lengths."""
    if not patterns.where(F.coalesce(F.length("pattern"), F.lit(0)) == 0).isEmpty():
        raise ValueError("a pattern must have a character")
    return patterns


def _in_lots(patterns: DataFrame) -> tuple[int, list[DataFrame]]:
    """Their number, after a look at them, and the patterns in lots that may go to every task."""
    size, number = checked(patterns).agg(F.sum(F.length("pattern")), F.count("*")).first()
    n = max(1, -(-(size or 0) // SCAN_CHARACTERS))
    return number, [patterns if n == 1 else patterns.where(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(n)) == lot) for lot in range(n)]


def scan(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each text is searched for each pattern; no index. The patterns' size is checked before they go to all tasks.

    A few patterns are searched one by one, in the JVM; more of them in one pass over each text by an automaton.
    """
    number, parts = _in_lots(patterns)
    found = None
    for some in parts:
        if number > ONE_BY_ONE:
            part = docs.select("doc_id", "text").mapInArrow(_all_at_once(some.select("pattern_id", "pattern").collect()), "pattern_id long, doc_id long, freq long")  # a lot of bounded size
        else:
            pairs = docs.select("doc_id", "text").join(F.broadcast(some), F.contains("text", "pattern"))
            part = pairs.select("pattern_id", "doc_id", occurrences(F.col("text"), F.col("pattern")).alias("freq"))
        found = part if found is None else found.unionByName(part)
    return found


def _all_at_once(patterns: list):
    """Counts all patterns in one pass over each text."""
    ids: dict[str, list[int]] = {}
    for number, pattern in patterns:
        ids.setdefault(pattern, []).append(number)

    def count(batches):
        automaton = ahocorasick.Automaton()
        for pattern in ids:
            automaton.add_word(pattern, pattern)
        if ids:
            automaton.make_automaton()
        for batch in batches:
            rows = ([], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                freq = Counter(pattern for _, pattern in automaton.iter(text)) if ids and text else {}
                for pattern, n in freq.items():
                    for number in ids[pattern]:
                        for column, value in zip(rows, (number, doc, n), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["pattern_id", "doc_id", "freq"])

    return count


def matches(index: DocIndex, patterns: DataFrame) -> DataFrame:
    """The index rows that begin with each pattern, with pattern_id and len: one hash join on as many first characters as all patterns have.

    A pattern longer than the keys is looked up by its first characters, and the rest is compared in the text. Patterns of up
    to SCAN_CHARACTERS together, which is counted before, go to all tasks.
    """
    size = F.length("pattern")
    seen = checked(patterns).agg(F.min(size).alias("least"), F.max(size).alias("most"), F.sum(size).alias("all")).first()
    if seen["all"] is None:
        return index.rows.limit(0).join(patterns.limit(0)).withColumn("len", size)
    heads = [r[0] for r in patterns.select(F.left("pattern", F.lit(index.key_length))).distinct().limit(PUSHED + 1).collect()]
    rows, shared = index.rows, F.lit(min(seen["least"], index.key_length))
    if len(heads) <= PUSHED:
        rows = rows.where(reduce(or_, (F.col("key").startswith(p) for p in heads), F.lit(False)))
    own = patterns.withColumn("_head", F.left("pattern", F.lit(index.key_length))).withColumn("len", size)
    own = F.broadcast(own) if seen["all"] <= SCAN_CHARACTERS else own
    near = rows.join(own, (F.left("key", shared) == F.left("_head", shared)) & F.startswith("key", "_head")).drop("_head")
    if seen["most"] <= index.key_length:
        return near
    columns, long = near.columns, F.col("len") > index.key_length
    whole = near.where(long).join(index.docs, "doc_id").where(F.substring(F.col("text"), F.col("pos") + 1, F.col("len")) == F.col("pattern"))
    return near.where(~long).unionByName(whole.select(*columns))


def _over_shards(index: Shards, patterns: DataFrame, found, column: str) -> DataFrame:
    """pattern_id, doc_id and a column of what found(shard, pattern) gives: document numbers of the shard, and values.

    A task builds one shard after another, answers all patterns from it and lets it go, so nothing is stored and only
    answers are shuffled.
    """
    schema = f"pattern_id long, doc_id long, {column}"
    kinds = [pa.int64(), pa.int64(), pa.int32() if column.endswith("int") else pa.int64()]
    characters, numbers_of = index.characters, (index.key_length, index.block_size, index.storing_factor, index.stretch)

    def answers(ids: dict[str, list[int]]):
        def run(batches):
            for own, texts in lots(batches, characters) if ids else ():
                shard, known = Shard(texts, *numbers_of), pa.array(own, pa.int64())
                for pattern, numbers in ids.items():
                    docs, value = found(shard, pattern)
                    for number in numbers if len(docs) else ():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number), kinds[0]), known.take(pa.array(docs)), pa.array(value).cast(kinds[2])], ["pattern_id", "doc_id", column.partition(" ")[0]])

        return run

    parts = []
    for some in _in_lots(patterns)[1]:
        ids: dict[str, list[int]] = {}
        for number, pattern in some.select("pattern_id", "pattern").collect():  # a lot of bounded size
            ids.setdefault(pattern, []).append(number)
        parts.append(index.dealt().mapInArrow(answers(ids), schema))
    return reduce(DataFrame.unionByName, parts)


def locate(index: DocIndex | Shards, patterns: DataFrame) -> DataFrame:
    """pattern_id, doc_id and pos (from 0) of every occurrence."""
    if isinstance(index, Shards):
        return _over_shards(index, patterns, lambda shard, pattern: shard.places(pattern), "pos int")
    return matches(index, patterns).select("pattern_id", "doc_id", "pos")


def intervals(index: DocIndex, patterns: DataFrame) -> DataFrame:
    """pattern_id, sp and ep: the closed range of rk values whose suffixes begin with the pattern; an absent pattern has no row."""
    return matches(index, patterns).groupBy("pattern_id").agg(F.min("rk").alias("sp"), F.max("rk").alias("ep"))


def _spread(witnesses: DataFrame, place: str) -> DataFrame:
    """Frequencies from the outermost occurrences of each document: their places in the document's own order."""
    return witnesses.groupBy("pattern_id", "doc_id").agg((F.max(place) - F.min(place) + 1).alias("freq"))


def _suffix(index, patterns):
    return matches(index, patterns).groupBy("pattern_id", "doc_id").agg(F.count("*").alias("freq"))


def _sada(place):
    def plan(index, patterns):
        found = matches(index, patterns)
        bounds = found.groupBy("pattern_id").agg(F.min("rk").alias("sp"), F.max("rk").alias("ep"))
        first = F.col("prev_rk").isNull() | (F.col("prev_rk") < F.col("sp"))
        last = F.col("next_rk").isNull() | (F.col("next_rk") > F.col("ep"))
        return _spread(found.join(bounds, "pattern_id").where(first | last), place)

    return plan


def _under(before, after):
    """Listing by rows whose common prefix with the document's neighbour is shorter than the pattern."""

    def listing(place):
        return lambda index, patterns: _spread(matches(index, patterns).where((F.col(before) < F.col("len")) | (F.col(after) < F.col("len"))), place)

    return listing


_ilcp, _cilcp = _under("ilcp_b", "ilcp_f"), _under("min_b", "min_f")


def _short(index: DocIndex, patterns: DataFrame, plan) -> DataFrame:
    """Plans that only know intervals hold for patterns up to the key length; the interval of a longer one isn't known, and its occurrences are counted one by one."""
    long = patterns.where(F.length("pattern") > index.key_length)
    own = plan(patterns.where(F.length("pattern") <= index.key_length))
    return own if long.isEmpty() else own.unionByName(_suffix(index, long))


def _gcda(place):
    """First and last row of each document in the interval from the grammars of the document array, and their places in the document's order."""

    def plan(index, patterns):
        def listed(own):
            ends = stored(first_last_rows(intervals(index, own), index.grammars, index.stretch))
            rows = ends.select("pattern_id", "doc_id", F.explode(F.array("first_rk", "last_rk")).alias("rk"))
            return _spread(rows.join(index.rows.select("rk", place), "rk"), place)

        return _short(index, patterns, listed)

    return plan


def _preagg(index, patterns):
    def plan(own):
        parts = covered(intervals(index, own), index.rows, index.nodes, index.sampled, index.block_size)
        return parts.groupBy("pattern_id", "doc_id").agg(F.sum("freq").alias("freq"))

    return _short(index, patterns, plan)


#: _isa plans take a suffix's place among its document's own suffixes, which each document gave by itself; _rank plans take how
#: often the document stands before it in the document array, counted over the whole collection.
STRATEGIES = {
    "suffix": _suffix,
    "sada_isa": _sada("isa"),
    "sada_rank": _sada("occ"),
    "ilcp_isa": _ilcp("isa"),
    "ilcp_rank": _ilcp("occ"),
    "cilcp_isa": _cilcp("isa"),
    "cilcp_rank": _cilcp("occ"),
    "gcda_isa": _gcda("isa"),
    "gcda_rank": _gcda("occ"),
    "preagg": _preagg,
}


def search(index: DocIndex | Shards, patterns: DataFrame, strategy: str = "suffix") -> DataFrame:
    if strategy == "scan":
        return scan(index.docs, patterns)
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are scan, {', '.join(STRATEGIES)}")
    if isinstance(index, Shards):
        own = _over_shards(index, patterns, lambda shard, pattern: shard.list(pattern, strategy), "freq long")
        return own.groupBy("pattern_id", "doc_id").agg(F.sum("freq").alias("freq"))  # rows may share a doc_id
    return STRATEGIES[strategy](index, patterns)


def search_interval(index: DocIndex, sp: int, ep: int) -> DataFrame:
    """doc_id and freq of the suffixes sp..ep, both included."""
    rows = index.rows.where(F.col("rk").between(sp, ep))
    ends = F.col("prev_rk").isNull() | (F.col("prev_rk") < sp) | F.col("next_rk").isNull() | (F.col("next_rk") > ep)
    return rows.where(ends).groupBy("doc_id").agg((F.max("isa") - F.min("isa") + 1).alias("freq"))


def access(index: DocIndex, i: int, n: int = 1) -> DataFrame:
    """rk, doc_id and pos of the n suffixes from place i on."""
    return index.rows.where(F.col("rk").between(i, i + n - 1)).select("rk", "doc_id", "pos")


def access_with_rank(index: DocIndex, i: int, n: int = 1) -> DataFrame:
    """rk, doc_id and occ (how often the document stands before) of the n suffixes from place i on."""
    return index.rows.where(F.col("rk").between(i, i + n - 1)).select("rk", "doc_id", "occ")


def places_in_documents(index: DocIndex, pairs: DataFrame) -> DataFrame:
    """pairs(doc_id, s1, s2) of two positions of a document with isa_1 and isa_2, their places among its suffixes."""
    own = lambda s, isa: index.rows.select("doc_id", F.col("pos").alias(s), F.col("isa").alias(isa))
    return pairs.join(own("s1", "isa_1"), ["doc_id", "s1"]).join(own("s2", "isa_2"), ["doc_id", "s2"])


def as_maps(found: DataFrame) -> DataFrame:
    """pattern_id and freqs, a map from doc_id to freq."""
    return found.groupBy("pattern_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "freq"))).alias("freqs"))


def count_occurrences(occurring: DataFrame) -> DataFrame:
    """doc_id and freq of a bag of occurrences(doc_id)."""
    return occurring.groupBy("doc_id").agg(F.count("*").alias("freq"))
