"""Each operator against brute force, on tables with nulls, empty and long texts, repeated rows and other columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import ann, exact_search, language_id, license_scan, line_dedup, mixing, packing, quality, simhash, substring_dedup
from corpuslens.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size double, start array<int>, _id string, doc string, mark string, fp string, h timestamp"


def corpus():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = "\n".join(line(9) for _ in range(6))
    texts = [line(60), line(60) + "\n" + shared, shared + "\n" + line(30), None, "", "   \n\t ", "one two", line(5) + "\n" + shared + "\n" + shared, "x", "1234 !!", "\n".join(line(8) for _ in range(3000))]
    texts += [texts[0], texts[0] + " extra", texts[0].upper(), "  ".join(texts[0].split()), texts[6], texts[6]]
    return texts


TEXTS = corpus()
SOURCES = ["b", "a", None, "b", "b", "c", "a", "b", None, "b", "b", "b", "a", "é", "d", "b", "b"]


def table(spark, texts=None, ids=None):
    texts = TEXTS if texts is None else texts
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, SOURCES[i % len(SOURCES)], None, "x", 1.0, [1], "y", "z", None, "q", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def windows_removed(texts, n=20):
    seen, out = {}, {}
    for d, t in enumerate(texts):
        words = WORD.findall((t or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if seen.setdefault(tuple(words[i : i + n]), (d, i)) != (d, i):
                gone[i : i + n] = [True] * n
        out[d] = len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()
    return out


def test_pieces_of_a_long_text_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 300)
    texts = [TEXTS[10], "short one", "", "x" * 900 + " " + TEXTS[0], None, "a b  " * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["doc_id", "mark", "text"])
    got, want = [], []
    for ids, _, before, lot in substring_dedup._lots(iter([batch]), 20):
        for d, base, t in zip(ids.tolist(), before.tolist(), lot, strict=True):
            words = t.split()
            got += [(d, base + i, tuple(words[i : i + 20])) for i in range(len(words) - 19)]
    for d, t in enumerate(texts):
        words = (t or "").encode().split()
        want += [(d, i, tuple(words[i : i + 20])) for i in range(len(words) - 19)]
    assert got == want and len(got) > 1000


@pytest.mark.parametrize("common", [20_000, 1])
def test_substring_dedup(spark, docs, monkeypatch, common):
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 14)
    rows = substring_dedup.substring_dedup(docs).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in rows} == windows_removed(TEXTS)
    assert len(rows) == len(TEXTS)


def test_substring_dedup_null_and_repeated_ids(spark, nothing):
    text = " ".join(map(str, range(40)))
    rows = substring_dedup.substring_dedup(table(spark, [text, text, text, text], [5, None, 5, 7])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows) == [(False, 5, 0), (False, 5, 0), (False, 7, 40), (True, 0, 40)]
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(substring_dedup.SubstringHash, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    blobs = [b"a b c d\nx b c d", b"a b c d e"]
    found = substring_dedup.repeated_windows(np.array([1, 2, 3]), np.zeros(3, np.int32), np.array([0, 0, 0]), blobs, [2, 1], 3)
    assert sorted(map(tuple, found.tolist())) == [(2, 0, 1, 2), (3, 0, 0, 1), (3, 0, 1, 2)]


def chunks_removed(texts):
    first, out = {}, {}
    for d, t in enumerate(texts):
        if t is None:
            out[d] = None
            continue
        lines, parts, begin = t.split("\n"), [], 0
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        r = [(31 * (h[i - 1] if i else 0) + h[i]) % 1000003 for i in range(len(lines))]
        for i in range(len(lines)):
            if 1 <= i <= len(lines) - 3 and r[i - 1] > r[i] <= r[i + 1] or i == len(lines) - 1:
                parts.append(lines[begin : i + 1])
                begin = i + 1
        out[d] = "\n".join(x for part in [p for j, p in enumerate(parts) if len(p) < 2 or first.setdefault("\n".join(p), (d, j)) == (d, j)] for x in part)
    return out


def test_line_dedup(spark, docs, nothing):
    kept = line_dedup.line_dedup(docs)
    rows = kept.collect()
    assert {r.doc_id: r.text for r in rows} == chunks_removed(TEXTS) and kept.columns[: len(docs.columns)] == docs.columns
    assert all(r._cl_n_removed == 0 for r in rows if r.doc_id in (3, 4)) and sum(r._cl_n_removed for r in rows) > 0
    assert line_dedup.line_dedup(nothing).count() == 0
    again = line_dedup.line_dedup(table(spark, [TEXTS[10]] * 3, [1, 1, 2])).collect()
    assert sorted((r.doc_id, r._cl_n_removed > 0) for r in again) == [(1, False), (1, False), (2, True)]


def test_exact_copies_lose_all_lines_and_most_of_a_repeated_passage_goes(spark):
    rng = np.random.default_rng(21)
    lines = lambda n: [f"line {x}" for x in rng.integers(0, 10**9, n)]
    whole, passage = lines(12), lines(40)
    texts = ["\n".join(whole), "\n".join(whole), "\n".join(lines(9) + passage + lines(7)), "\n".join(lines(4) + passage + lines(11)), "a\nb", "a\nb", "single", "single"]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert got[1]._cl_n_removed == 12 and got[1].text == "" and got[5]._cl_n_removed == 2 and got[7].text == "single"
    assert 30 <= got[3]._cl_n_removed <= 40 and got[3].text.startswith(texts[3][:30]) and got[2]._cl_n_removed == 0
    with pytest.raises(ValueError):
        line_dedup.line_dedup(table(spark).withColumn("_cl_gone", F.lit(1)))


def test_line_chunks_join_to_the_text():
    for t in TEXTS:
        if t is not None:
            own = line_dedup.chunks(t.encode())
            assert b"\n".join(body for body, _ in own) == t.encode() and sum(n for _, n in own) == t.count("\n") + 1
            assert len(own) == 1 or min(n for _, n in own) >= 2
            wide = line_dedup.chunks(t.encode(), 3, 4)
            assert b"\n".join(body for body, _ in wide) == t.encode() and (len(wide) == 1 or min(n for _, n in wide) >= 4)


def simhash_of(text, n=4):
    words = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(fps, ids, budget):
    parent = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for x, a in zip(fps, ids, strict=True):
            for y, b in zip(fps, ids, strict=True):
                if (x ^ y).bit_count() <= budget and parent[a] != parent[b]:
                    parent[a] = parent[b] = min(parent[a], parent[b])
                    changed = True
    return parent


def test_simhash(spark, docs, nothing):
    fps = [simhash_of(t) for t in TEXTS]
    want = reach(fps, range(len(TEXTS)), 4)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in rows} == {i: (fps[i], want[i]) for i in range(len(TEXTS))}
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_does_not_join_texts_by_a_repeated_or_null_doc_id(spark):
    rng = np.random.default_rng(11)
    a, b, c, d = (" ".join(str(x) for x in rng.integers(0, 50_000, 60)) for _ in range(4))
    near = a + " " + a  # a few shingles more
    ids = [5, 1, 5, 7, None, None, 3]
    texts = [a, near, b, b, c, d, c]
    fps = [simhash_of(t) for t in texts]
    rows = simhash.near_duplicates(table(spark, texts, ids)).collect()
    linked = reach(fps, range(len(texts)), 4)
    want = {fps[i]: min((ids[k] for k in linked if linked[k] == linked[i] and ids[k] is not None), default=None) for i in range(len(texts))}
    assert len(rows) == 7 and all(r.component_id == want[r.fp & (2**64 - 1)] for r in rows) and len(set(want.values())) >= 4
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ids)) and want[fps[5]] is None


@pytest.mark.parametrize(("rows", "agree"), [(50_000, 2), (8, 2), (8, 3)])
def test_simhash_links_join_what_brute_force_joins(spark, monkeypatch, rows, agree):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(8)} | {0, 2**64 - 1})
    signed = [(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(fps)]
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame(signed, "fp long, rep long"), 4, agree)).collect()}
    want = reach(fps, range(len(fps)), 4)
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_only_letters_are_letters():
    idf, n = np.ones(language_id.FEATURES, np.float32), language_id.counts(["one two", "drei vier"])
    model = language_id.Model(idf, {lang: language_id.weights(n[[i]], idf) for i, lang in enumerate("ab")}, {})
    assert [x[0] == "und" for x in model.predict(["²½ ①", "_1", "", None, "é", "字", "ª"])] == [True] * 4 + [False] * 3


def test_trie_forest_over_several_words():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, (30, 4), dtype=np.uint64)
    rows = [base[rng.integers(30)].copy() for _ in range(500)] + [base[0].copy() for _ in range(300)]
    for row in rows:
        for bit in rng.choice(256, rng.integers(0, 50), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    for row in rows[500:]:  # many with one first word
        row[0] = base[0, 0]
    prints = np.array(rows)[np.argsort([int(r[0]) for r in rows], kind="stable")]
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).astype(int)
    linked = (apart[:, :, 0] <= 22) & (apart.sum(axis=2) <= 44)
    want = np.arange(len(prints))
    while not np.array_equal(least := np.where(linked, want[None], len(prints)).min(axis=1), want):
        want = least
    got, pairs = simhash.trie_forest(prints[:, 0].copy(), np.array([0]), np.array([len(prints)]), 22, prints[:, 1:].copy(), 44)
    assert np.array_equal(got, want)
    assert linked[pairs[0], pairs[1]].all() and len(pairs[0]) < 2 * len(prints)
    shown = np.arange(len(prints))
    assert np.array_equal(simhash._unite(shown, *pairs), want)


@pytest.mark.parametrize("rows", [50_000, 40])
def test_near_copies(spark, docs, nothing, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(5)
    words = lambda n: [str(x) for x in rng.integers(0, 5000, n)]
    base, texts = [words(250) for _ in range(12)], []
    for i in range(120):
        text = list(base[i % 12])
        text[int(rng.integers(0, 240))] = "other"  # 5 of 246 shingles
        texts.append(" ".join(text))
    texts += [" ".join(words(250)) for _ in range(40)] + [" ".join(base[0][:125] + words(125))]
    got = {r.doc_id: r.component_id for r in simhash.with_component_id(simhash.near_copies(table(spark, texts))).collect()}
    assert got == {i: i % 12 if i < 120 else i for i in range(len(texts))}
    assert sorted((r.doc_id, r.component_id) for r in simhash.with_component_id(simhash.near_copies(docs)).collect() if r.doc_id in (3, 4, 5, 11, 14)) == [(3, 3), (4, 3), (5, 3), (11, 0), (14, 0)]
    assert simhash.near_copies(nothing).count() == 0


def test_near_copies_are_those_of_similar_shingles(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [str(x) for x in rng.integers(0, 50_000, n)]
    texts, want = [], []
    for n, shared in [(9, 8)] * 60 + [(9, 7)] * 20 + [(200, 164)] * 20 + [(200, 176)] * 20 + [(34, 29), (39, 33), (60, 49), (60, 54)] * 5:
        own = words(n)  # the second text has its first words only, or others behind them
        other = own[:shared] + (words(n - shared) if n == 200 else [])
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (own, other))
        want += [len(texts)] + [len(texts) if 5 * len(a & b) >= 4 * len(a | b) else len(texts) + 1]
        texts += [" ".join(own), " ".join(other)]
    line = "one two three four five six seven"
    texts += [line, f"{line} " * 40 + " ".join(words(4))]  # the votes of one, and five more different shingles
    got = {r.doc_id: r.component_id for r in simhash.with_component_id(simhash.near_copies(table(spark, texts))).collect()}
    assert got == dict(enumerate([*want, len(want), len(want) + 1]))


def test_copies_of_one_text_that_are_not_similar_to_each_other(spark):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 150)]
    texts = [" ".join(base)]
    for i in range(300):  # each new word changes 5 of 146 shingles; 4 of them leave 126 of 166
        text = list(base)
        for at in rng.choice(29, int(rng.integers(1, 9)), replace=False):
            text[5 * at + 2] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(text))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    linked = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    want = np.arange(len(texts))
    while not np.array_equal(least := np.where(linked, want[None], len(texts)).min(axis=1), want):
        want = least
    got = {r.doc_id: r.component_id for r in simhash.with_component_id(simhash.near_copies(table(spark, texts))).collect()}
    assert got == dict(enumerate(want.tolist())) and 50 < len(set(got.values())) < 250


def test_long_texts_have_the_fingerprints_and_sets_of_whole_ones(monkeypatch):
    rng = np.random.default_rng(13)
    texts = [b"", b" ", b"one", b" ".join(b"%d" % x for x in rng.integers(0, 99, 3000)), b"x" * 500 + b"  y \n" + b"z" * 700 + b" a b c d e", b"a b c d" + b" " * 900]
    whole, sets = simhash.long_fingerprints(texts), simhash.shingle_sets(texts)
    monkeypatch.setattr(simhash, "SLICE_BYTES", 300)
    monkeypatch.setattr(simhash.pieces, "__defaults__", (300,))
    assert np.array_equal(simhash.long_fingerprints(texts), whole) and all(np.array_equal(a, b) for a, b in zip(simhash.shingle_sets(texts), sets, strict=True))
    assert [int(x) for x in simhash.fingerprints(texts)] == [simhash_of(t.decode()) for t in texts]


def test_bands_follow_the_number_of_texts():
    assert simhash.band_plan(0) == simhash.band_plan(100_000) and simhash.band_plan(10**9)[0] == 28
    for n in (10**5, 10**7, 10**9):
        bits, bands = simhash.band_plan(n)
        assert (1 - (1 - simhash.MISSED_AT) ** bits) ** bands <= simhash.MISSED


def test_trie_gives_all_pairs_between_known_components():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 2**64, (10, 4), dtype=np.uint64)
    prints = np.sort(base[rng.integers(0, 10, 300)].view([("", np.uint64)] * 4).ravel()).view(np.uint64).reshape(-1, 4)
    for row in prints:
        for bit in rng.choice(192, 25, replace=False):
            row[1 + bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    known = rng.integers(0, 4, len(prints))
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).astype(int)
    hit = (apart[:, :, 0] <= 24) & (apart.sum(axis=2) <= 44) & (known[:, None] != known[None])
    fits = lambda i, j, differ: differ <= 44
    _, (a, b) = simhash.trie_forest(prints[:, 0].copy(), np.array([0]), np.array([len(prints)]), 24, prints[:, 1:].copy(), 60, known, fits, True)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in np.argwhere(hit).tolist() if i < j} != set()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def targets_of(sizes, passes=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = sum(weight[s] for s in names if s not in fixed)
        now = {s: fixed[s] if s in fixed else rest * weight[s] / free for s in names}
        over = [s for s in names if s not in fixed and now[s] > passes * sizes[s]]
        if not over:
            return now
        fixed |= {s: passes * sizes[s] for s in over}


def test_mixing(docs, nothing):
    size = [len(WORD.findall((t or "").encode())) for t in TEXTS]
    by_source = defaultdict(int)
    for i, n in enumerate(size):
        by_source[SOURCES[i]] += n
    target = targets_of(by_source)
    rows = mixing.mixing_plan(docs, ["doc_id", "source"]).collect()
    taken = defaultdict(int)
    for r in rows:
        assert r._cl_size == size[r.doc_id] and r._cl_source_size == by_source[r.source] and r._cl_target == pytest.approx(target[r.source])
        assert r._cl_taken <= 3 * r._cl_size and r._cl_taken == sum(c.words for c in r._cl_copies) and all(0 <= c.due <= 1 for c in r._cl_copies)
        taken[r.source] += r._cl_taken
    assert len(rows) == len(TEXTS) and all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert any(t == 3 * by_source[s] for s, t in target.items())
    mixed = mixing.mix(docs)
    out = mixed.collect()
    assert [r._cl_due for r in out] == sorted(r._cl_due for r in out)
    assert sum(len(WORD.findall(r.text.encode())) for r in out) == sum(taken.values())
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [tuple(r) for r in out]
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()
    assert mixing.mixing_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_due_times_follow_the_schedule(spark):
    rows = spark.range(11).select((F.col("id") / 10).alias("u")).select("u", *(mixing._due(F.col("u"), F.lit(b)).alias(n) for n, b in (("early", -0.3), ("even", 0.0), ("late", 1.0)))).collect()
    for r in rows:
        for t, b in ((r.early, -0.3), (r.even, 0.0), (r.late, 1.0)):
            assert b * t * t + (1 - b) * t == pytest.approx(r.u)


def test_packing_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert len(by_doc) == len(TEXTS)
    for d, text in enumerate(TEXTS):
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))] and all(r.doc_tokens == len(ids) for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))] and pieces[-1].offset + pieces[-1].length <= 2048
    full = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert all(len(r.ids) == (r.length if r.length.bit_count() == 1 else 2048) for r in full) and sum(r.length for r in full) == sum(r.length for r in rows)
    assert packing.pack(nothing).count() == 0


def test_tokens_of_special_strings_and_odd_texts():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for text in ("a<|endoftext|>b", "  \n\n x", "日本 😀 ñé", "it's WE'RE 12345", " 　 ", "a" * 3000, "<|end", "\x00\x1c\x85"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_survives_long_white_space_and_keeps_the_order(spark, monkeypatch):
    from tokenizers import Tokenizer

    long = [" " * 1_000_000, "a" + "\n" * 1_000_000 + " b", "x" * 300_000]
    rows = packing.pack(table(spark, [*long, None, "", ""], [3, 2, 1, None, None, None]), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for d, text in zip((3, 2, 1), long, strict=True):
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == d)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert sum(r.doc_id is None for r in rows) == 3
    monkeypatch.setattr(packing, "GROUP_PIECES", 16)
    docs = table(spark, ["word " * (i % 50) for i in range(200)])
    by_sequence = defaultdict(list)
    for r in packing.pack(docs).collect():
        by_sequence[r.sequence_id].append(r.doc_id)
    firsts = [min(by_sequence[q]) for q in sorted(by_sequence)]
    assert firsts == sorted(firsts) and len(by_sequence) >= 13


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 101, 300).tolist(), reverse=True)
    number, offset = packing.best_fit(lengths, 100)
    room = []
    for n, at, begin in zip(lengths, number, offset, strict=True):
        fits = [r for r in room if r >= n]
        if at == len(room):
            assert not fits
            room.append(100)
        else:
            assert room[at] == min(fits)
        assert begin == 100 - room[at]
        room[at] -= n


def test_language_id(spark, nothing):
    rng = np.random.default_rng(5)
    kinds = {"aa": "abc", "bb": "xyz", "cc": "éñü"}
    rows = [(i, " ".join("".join(rng.choice(list(kinds[lang]), 4)) for _ in range(20)), lang) for i, lang in enumerate(list(kinds) * 60)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "aa"), (None, "abc cab", None), (1003, "日本語のテキスト", None), (1003, "日本語のテキスト", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, sample_rows=30)
    assert Counter(model.langs) == {"aa": 4, "bb": 4, "cc": 4}
    out = language_id.identify(docs, model).collect()
    assert all(r._cl_lang == r.lang and not r._cl_rejected for r in out if r.doc_id is not None and r.doc_id < 1000)
    odd = {r.doc_id: r for r in out if r.doc_id is None or r.doc_id >= 1000}
    assert all(odd[i]._cl_lang == "und" and odd[i]._cl_rejected and odd[i]._cl_score == 0 for i in (1000, 1001, 1002))
    assert odd[1003]._cl_rejected and odd[1003]._cl_lang in kinds and odd[None]._cl_lang == "aa" and len(out) == len(rows)
    assert language_id.identify(nothing, language_id.learn(nothing)).count() == 0
    one = language_id.identify(docs.limit(2), language_id.Model(np.ones(language_id.FEATURES, np.float32), {}, {})).collect()
    assert all(r._cl_lang == "und" for r in one)


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    texts = ["abc abd", "xyz", None, "", "é" * 50]
    assert np.array_equal(language_id.counts(texts), np.concatenate([language_id.counts([t]) for t in texts]))


def test_long_texts_are_counted_whole(monkeypatch):
    texts = ["ab cde " * 400, "", "z" * 1000, "é ab" * 90, "q"]
    whole = language_id.counts(texts)
    monkeypatch.setattr(language_id, "PIECE", 64)
    assert np.array_equal(language_id.counts(texts), whole) and whole[2].sum() == 1001 + 1000


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + i) for i in range(3300)]
    rows = [(3 * i + k, "".join(rng.choice(letters[3 * i : 3 * i + 3], 30)), f"l{i:04}") for i in range(1100) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    taught = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(taught) > 1000 and set(model.langs) == taught
    with pytest.raises(ValueError):
        language_id.identify(docs.withColumn("_cl_score", F.lit(1)), model)


def test_short_clean_texts_are_not_rejected(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words, 150)), "aa") for i in range(300)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not any(far for _, _, far in model.predict([words[0], " ".join(words[:2]), " ".join(words[3:7]), rows[0][1]]))
    assert all(far for _, _, far in model.predict(["xyzzy vvv qqq zzz www yyy uuu ttt sss", "日本語のテキスト"]))


def test_held_out_is_the_crc_rule(spark):
    rows = spark.range(50).select("id", language_id.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_quality(spark, docs, nothing):
    rng = np.random.default_rng(9)
    texts = [" ".join(("%s***" if i % 2 else "%s") % "".join(rng.choice(list("abcde"), 5)) for _ in range(80)) for i in range(600)]
    own = spark.createDataFrame([*enumerate(texts), (600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(600)] + [(0, None, None), (None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(own, quality.learn(own, labels)).collect()
    held = [r for r in rows if r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held) > 0.95 * len(held) and len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    assert rows and {r.score for r in rows if r.doc_id == 600} == {r.score for r in rows if r.doc_id == 601}
    untrained = quality.learn(nothing, labels.limit(0))
    assert quality.score(docs, untrained).count() == len(TEXTS) and quality.score(nothing, untrained).count() == 0


def test_quality_sees_the_whole_text_in_chunks():
    net, rng = quality.Network(), np.random.default_rng(2)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 7, 128, 129, 1000, 4096)]
    together = net.features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], net.features([t])[0], atol=1e-5)
        n = max(2, -(-(len(t) + 8) // 128))
        x = net.p["embed"][np.frombuffer(t.ljust((n + 1) * 128, b"\0"), np.uint8)]
        y = np.array([sum((x[2 * k + 2 * j : 2 * k + 2 * j + 2].reshape(-1) @ net.p["filters"][j]) for j in range(4)) for k in range(n * 64)])
        z = [np.maximum(y[c * 64 : (c + 2) * 64].max(axis=0) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"][0] for c in range(n - 1)]
        assert np.allclose(together[i], [np.mean(z), np.min(z), np.max(z)], atol=1e-4)


def vectors(spark, n=400, d=8):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=d) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist(), "z") for i in range(n)]
    rows[60] = (60, rows[40][1], "z")
    rows += [(10000, None, "z"), (10020, [1.0, None] + [0.0] * 6, "z"), (10040, [float("nan")] + [0.0] * 7, "z"), (10060, [float("inf")] + [0.0] * 7, "z"), (10080, [0.0] * 8, "z"), (None, [1.0] * 8, "z")]
    rows += [(40, rows[40][1], "z"), (80, rows[3][1], "z"), (81, rows[5][1], "z")]  # a repeated row, and other vectors of known ids
    rows += [(20000 + i, rows[7][1], "z") for i in range(40)]
    rows += [(30000 + i, rng.normal(size=5).astype(np.float32).tolist(), "z") for i in range(60)] + [(40000, [1.0], "z"), (40001, [2.0], "z"), (40002, [], "z")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3), rows


def brute_top(rows, convert, k, zero):
    """(query_id, rank, vec_id, score) of each query row, sorted."""
    good = [(i, convert(np.array(v, float))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]
    out = []
    for at, (q, x) in enumerate(good):
        if q % 20 == 0:
            found = sorted((-float(x @ v), i) for j, (i, v) in enumerate(good) if j != at and len(v) == len(x))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 100])
def test_exact_search(spark, monkeypatch, block):
    monkeypatch.setattr(exact_search, "BLOCK", block)
    monkeypatch.setattr(exact_search, "BUCKET", 32)
    frame, rows = vectors(spark)
    want = brute_top(rows, lambda x: np.floor(64 * x), 20, True)
    got = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in exact_search.exact_top_k(frame).collect())
    assert got == want and {10080, 30000, 40000} <= {r[0] for r in got}
    assert sum(r[0] == 40 for r in got) == 40 and (80, 1) in {r[:2] for r in got}
    assert exact_search.exact_top_k(frame.limit(0)).count() == 0
    assert exact_search.exact_top_k(frame.where("vec_id IN (40, 60, 61)")).count() == 9


def test_exact_search_of_large_values(spark):
    rows = [(0, [3.0, 1.0], ""), (1, [1e8, 1.0], ""), (2, [1e8, 2.0], ""), (3, [2e7, 0.0], ""), (4, [4e6, 0.5], ""), (5, [-1e12, 0.0], ""), (20, [1e14, -7.0], ""), (6, [1e307, 0.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i != 6}
    want = []
    for q in (0, 20):
        found = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)
        want += [(q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(found, 1)]
    assert sorted(tuple(r) for r in exact_search.exact_top_k(frame).collect()) == sorted(want)


def recall_of(got, want):
    near = defaultdict(set)
    for q, _, i, _ in want:
        near[q].add(i)
    return np.mean([i in near[q] for q, _, i, _ in got])


def test_approximate_search(spark):
    frame, rows = vectors(spark, 3000)
    want = brute_top(rows, np.asarray, 20, False)
    got = sorted(tuple(r) for r in ann.nearest_neighbours(frame).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(a[0] != b[0] or a[1] >= b[1] or a[3] >= b[3] - 1e-12 for a, b in zip(got, got[1:], strict=False) if a[0] not in (40, 80))
    exact = defaultdict(list)
    for i, v, _ in rows:
        exact[i].append(v)
    assert all(any(s == pytest.approx(float(np.dot(x, y))) for x in exact[q] for y in exact[i] if len(x) == len(y)) for q, _, i, s in got[::7])
    assert recall_of(got, want) >= 0.9
    assert ann.nearest_neighbours(frame.limit(0)).count() == 0
    assert ann.nearest_neighbours(frame.where("vec_id IN (40, 60, 61)")).count() == 9


def test_clustered_vectors_need_few_of_them(spark):
    rng = np.random.default_rng(15)
    centers = rng.normal(size=(400, 32))
    x = (centers[rng.integers(0, 400, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ann.share_for(ann.Codebooks(x), x, 20) < 0.05
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    near = {q: set(np.argsort(-np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, len(x), 20)}
    got = ann.nearest_neighbours(frame).collect()
    assert len(got) == 20 * len(near) and np.mean([r.vec_id in near[r.query_id] for r in got]) >= 0.9


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(6)
    a, b = rng.random(7), rng.random(9)
    size = {(i, j): int(rng.integers(1, 4)) for i in range(7) for j in range(9) if rng.random() < 0.7}
    cells = ann.visited(a, b, size, 10**9)
    assert cells == sorted(size, key=lambda c: a[c[0]] + b[c[1]])
    some = ann.visited(a, b, size, 10)
    assert some == cells[: len(some)] and sum(size[c] for c in some) >= 10 > sum(size[c] for c in some[:-1])


NOTICE = "This work is licensed under the GNU General Public License, version 3."


def test_license_scan(spark, docs, nothing):
    filler = " ".join(f"w{i}" for i in range(500))
    texts = [NOTICE, f"{filler}\n{NOTICE.upper()} {filler}", NOTICE.replace("work", "thing"), "Licensed under the GNU thing", None, "", f"{NOTICE} {filler} {NOTICE}", NOTICE.replace("3", "2"), "Released under the MIT License. " * 3, "MIT is a place; under the license of GNU.", license_scan.NOTICES["apache-2.0-header"][0]]
    got = defaultdict(dict)
    for r in license_scan.license_scan(table(spark, texts)).collect():
        got[r.doc_id][r.license] = r
    assert {d: set(x) for d, x in got.items()} == {0: {"gpl-3.0"}, 1: {"gpl-3.0"}, 2: {"gpl-3.0"}, 6: {"gpl-3.0"}, 7: {"gpl-2.0"}, 8: {"mit"}, 10: {"apache-2.0", "apache-2.0-header"}}
    assert got[0]["gpl-3.0"].coverage == 1 and got[1]["gpl-3.0"].first_word == 500 and got[2]["gpl-3.0"].coverage == pytest.approx(11 / 12)
    assert got[6]["gpl-3.0"].passages == 2 and got[6]["gpl-3.0"].first_word == 0 and got[8]["mit"].passages == 3
    assert license_scan.license_scan(docs).count() == 0 and license_scan.license_scan(nothing).count() == 0


@pytest.mark.parametrize("name", ["apache-2.0-header", "mit-text", "gpl-header", "bsd-3-clause"])
@pytest.mark.parametrize("apart", [0, 1, 60, 100])
def test_license_scan_finds_long_notices_that_stand_close_together(name, apart):
    notice = license_scan.words_of(license_scan.NOTICES[name][0].encode())
    filler = [b"w%d" % i for i in range(500)]
    changed = [w for i, w in enumerate(notice) if i != 3]
    for copies in ([notice, notice], [notice] * 5, [changed, notice], [notice, changed]):
        text, at = list(filler), []
        for own in copies:
            at.append((len(text), len(text) + len(own)))
            text += own + filler[:apart]
        got = {r[0]: r[1:] for r in license_scan.Scanner().scan(b" ".join(text + filler))}
        assert got[name] == (1.0, *at[copies.index(notice)], len(copies))


def test_license_scan_finds_a_line_seventy_times_and_one_behind_a_thin_one():
    line, filler = license_scan.words_of(NOTICE.encode()), [b"w%d" % i for i in range(40)]
    for apart in (0, 3, 40):
        got = {r[0]: r[1:] for r in license_scan.Scanner().scan(b" ".join((line + filler[:apart]) * 70))}
        assert got["gpl-3.0"] == (1.0, 0, 12, 70)
    thin = b" ".join(w + b" x y" for w in line)
    assert license_scan.Scanner().scan(thin) == []
    assert [r[:4] for r in license_scan.Scanner().scan(thin + b" z z z " + b" ".join(line))] == [("gpl-3.0", 1.0, 39, 51)]


def test_long_gaps_without_anchors_are_aligned():
    rng = np.random.default_rng(9)
    a, b = ([bytes([97 + int(x)]) for x in rng.integers(0, 4, n)] for n in (300, 90))
    row = [0] * (len(b) + 1)
    for w in a:
        row = list(np.maximum.accumulate([0] + [max(row[j + 1], row[j] + 1) if w == b[j] else row[j + 1] for j in range(len(b))]))
    assert len(license_scan._common(a, b)) == row[-1] and len(license_scan.align(a, b)) > 0.8 * row[-1]


def test_alignment_is_a_common_subsequence_close_to_the_longest():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a = [bytes([97 + int(x)]) for x in rng.integers(0, 26, 60)]
        b = [w for w in a if rng.random() < 0.9]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) >= 0.8 * len(license_scan._common(a, b))
