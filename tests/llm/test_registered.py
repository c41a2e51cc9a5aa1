"""The registered queries, by their names and columns, against brute force: on the smallest tables and on tables of odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm.license_scan import NOTICES, words_of
from corpuslens.llm.queries import QUERIES
from test_operators import SOURCES, TEXTS, WORD, brute_top, chunks_removed, reach, recall_of, simhash_of, targets_of, windows_removed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, repeated rows and ids, and columns with names that operators use."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if i % 2 else None, SOURCES[i % len(SOURCES)], None, "x", 1, 2, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, TEXTS[1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (1, TEXTS[7], "en", "a", 3, "x", 1, 2, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, length int, row int, part string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, None) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(i % 7), 1.0, -2.0 * (i % 3)], 1, "z") for i in range(60)] + [(20, [1.0, 1.0, 1.0], 2, None), (None, [1.0, 1.0, 1.0], None, None), (70, None, None, None), (80, [None, 1.0, 1.0], 1, "z"), (100, [5.0], 1, "z"), (101, [2.0], 1, "z")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, row int, length string").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_query_over_empty_tables(spark, empty, name):
    assert (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, empty).count() == 0


def texts_in(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["plain", "odd"])
def tables(request, odd):
    return FOLDER if request.param == "plain" else odd


def test_op2(spark, tables):
    from tokenizers import Tokenizer

    from corpuslens.llm.packing import default_tokenizer

    tokenizer, want, got, place = Tokenizer.from_file(default_tokenizer()), [], [], defaultdict(list)
    for d, t in texts_in(spark, tables):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    rows = QUERIES["op2_packing"](spark, tables).collect()
    for r in rows:
        got.append((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens))
        place[r.sequence_id].append((r.offset, r.length))
    assert sorted(map(str, got)) == sorted(map(str, want))
    for parts in place.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(place) <= 1.1 * sum(r.length for r in rows) / 2048 + 1


def test_op3(spark, tables):
    texts = texts_in(spark, tables)
    fps = [simhash_of(t) for _, t in texts]
    linked = reach(fps, range(len(fps)), 4)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[linked[i]] = d if least[linked[i]] is None else min(d, least[linked[i]])
    want = sorted(str((d, f"{fps[i]:016x}", least[linked[i]])) for i, (d, _) in enumerate(texts))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in QUERIES["op3_simhash"](spark, tables).collect()) == want


def test_op4(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source").collect()
    size, by = defaultdict(list), defaultdict(int)
    for r in docs:
        n = len(WORD.findall((r.text or "").encode()))
        size[str(r.doc_id)].append((n, r.source))
        by[r.source] += n
    target = targets_of(by)
    rows, taken = QUERIES["op4_mixing"](spark, tables).collect(), defaultdict(float)
    assert len(rows) == len(docs)
    for r in rows:
        own = [s for n, s in size[str(r.doc_id)] if n == r["size"] and by[s] == r.source_size and target[s] == pytest.approx(r.target)]
        assert own and 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
    for s in by:
        assert taken[by[s]] == pytest.approx(sum(target[x] for x in by if by[x] == by[s]), abs=3)
    assert QUERIES["op4_mixing"](spark, tables).collect() == rows


def test_op5(spark, odd):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, FOLDER).collect()}
    texts = dict(texts_in(spark, FOLDER))
    assert got == windows_removed([texts[i] for i in range(len(texts))])
    assert QUERIES["op5_substring_dedup"](spark, odd).count() == len(TEXTS) + 4
    assert {r.kept_sha256 for r in QUERIES["op5_substring_dedup"](spark, odd).where("n_words = 0").collect()} == {hashlib.sha256(b"").hexdigest()}


def test_op6(spark, odd):
    rows = QUERIES["op6_quality"](spark, FOLDER).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r.predicted == label[r.doc_id] for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert len(rows) == 200 and np.mean(held) >= 0.8
    assert QUERIES["op6_quality"](spark, odd).where("score BETWEEN 0 AND 1 AND held_out IS NOT NULL").count() == len(TEXTS) + 4


def test_op7(spark, odd):
    rows = QUERIES["op7_language_id"](spark, FOLDER).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert len(rows) == 200 and np.mean(held) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd_rows = QUERIES["op7_language_id"](spark, odd).collect()
    assert len(odd_rows) == len(TEXTS) + 4 and {r.lang_pred for r in odd_rows} == {"en", "und"}


def test_op8_and_op9(spark, tables):
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in QUERIES["op8_exact_search"](spark, tables).collect())
    assert got == brute_top(rows, lambda x: np.floor(64 * x), 20, True)
    want = brute_top(rows, np.asarray, 20, False)
    found = sorted(tuple(r) for r in QUERIES["op9_ann"](spark, tables).collect())
    assert [r[:2] for r in found] == [r[:2] for r in want]
    if tables == FOLDER:
        assert recall_of(found, want) >= 0.9
    else:  # many products are equal there
        assert np.mean([a[3] == pytest.approx(b[3]) for a, b in zip(found, want, strict=True)]) >= 0.9


def test_op1(spark, odd):
    got = {r.doc_id: r.text for r in QUERIES["op1_line_dedup"](spark, FOLDER).collect()}
    texts = dict(texts_in(spark, FOLDER))
    assert got == chunks_removed([texts[i] for i in range(len(texts))])
    assert QUERIES["op1_line_dedup"](spark, odd).count() == len(TEXTS) + 4


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_op10(spark, odd):
    """Each notice that some passage covers, by an exhaustive look at all passages of its length."""
    found = {(r.doc_id, r.license): r for r in QUERIES["op10_license_scan"](spark, FOLDER).collect()}
    for d, t in texts_in(spark, FOLDER):
        words = words_of((t or "").encode())
        for name, (notice, must) in NOTICES.items():
            own, needed = words_of(notice.encode()), {w.encode() for w in must.split()}
            if not needed <= set(words):
                assert (d, name) not in found
                continue
            best = 0
            for at in range(max(1, len(words) - len(own) + 1)):
                part = words[at : at + len(own)]
                if needed <= set(part) and sum(w in set(own) for w in part) >= 0.8 * len(own):
                    best = max(best, longest_common(part, own) / len(own))
            if best >= 0.8:
                assert found[d, name].coverage >= best - 1e-9
    for (d, name), r in found.items():
        own = words_of(NOTICES[name][0].encode())
        part = words_of(dict(texts_in(spark, FOLDER))[d].encode())[r.first_word : r.end_word]
        assert r.coverage <= longest_common(part, own) / len(own) + 1e-9
    assert QUERIES["op10_license_scan"](spark, odd).count() == 0


def test_pipeline_over_odd_rows(spark, odd):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert all(r.length <= 2048 for r in rows)


def test_pipeline_keeps_the_order_in_which_documents_are_due(spark, tmp_path, monkeypatch):
    """Packing reads back the order that mixing wrote: sequence ids rise with the place in the files, group by group."""
    from corpuslens.llm import packing

    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    docs = spark.range(400).select((F.lit(1000) - F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs.orderBy(F.desc("doc_id")).repartitionByRange(7, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(str(tmp_path / "d"))
    rows = corpus_pipeline.packing(spark, spark.read.parquet(str(tmp_path / "d")), FOLDER).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r.doc_id)
    firsts = [max(by[k]) for k in sorted(by)]
    assert firsts == sorted(firsts, reverse=True) and len(by) >= 50 and len(rows) == 400
