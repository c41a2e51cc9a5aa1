import os

import pytest

from corpuslens.plans import strategies
from corpuslens.plans.index import DocIndex, Shards, build
from corpuslens.plans.queries import QUERIES, SHARDED
from corpuslens.sources.collections import patterns_of
from corpuslens.storage import shared_folder

DOCS = ["aaaa", "banana", "", "a.b.a.b.a", "éléphant éé\nél", "x\\Ey \\E\\Ey", "banana bandana banana bandana banana", "日本日本日 😀😀"]
PATTERNS = ["aa", "a", "ana", "a.b.a", "zzz", "A", "aaaab", "é", "éé\né", "\\E", "\\E\\E", "banana bandana banana", "日本", "😀", "aa", "n", "ban"]


def brute(docs, patterns):
    return {(p, d): n for p, pattern in enumerate(patterns) for d, text in enumerate(docs) if (n := sum(text.startswith(pattern, i) for i in range(len(text))))}


def found(df):
    return {(r.pattern_id, r.doc_id): r.freq for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark):
    return build(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string"), key_length=8, block_size=4, storing_factor=1, stretch=16)


@pytest.mark.parametrize("strategy", ["scan", *strategies.STRATEGIES])
def test_every_strategy_gives_the_same_answer(spark, index, strategy):
    assert found(strategies.search(index, patterns_of(spark, PATTERNS), strategy)) == brute(DOCS, PATTERNS)


def shards(spark, docs, characters=25):
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    return Shards(rows, key_length=8, block_size=4, storing_factor=1, stretch=16, characters=characters)


@pytest.mark.parametrize("characters", [1, 25, 1000])
@pytest.mark.parametrize("strategy", strategies.STRATEGIES)
def test_every_strategy_lists_over_shards(spark, strategy, characters):
    own = shards(spark, list(enumerate(DOCS)), characters)
    assert found(strategies.search(own, patterns_of(spark, PATTERNS), strategy)) == brute(DOCS, PATTERNS)


@pytest.mark.parametrize("strategy", strategies.STRATEGIES)
def test_rows_that_share_a_doc_id_or_have_none(spark, strategy):
    docs = [(1, "banana"), (1, "ana"), (None, "bananas ana"), (None, None), (2, ""), (None, "an")]
    got = found(strategies.search(shards(spark, docs), patterns_of(spark, ["ana", "an"]), strategy))
    assert got == {(0, 1): 3, (0, None): 3, (1, 1): 3, (1, None): 4}


def test_shards_locate_and_take_lots_of_patterns(spark, monkeypatch):
    many = sorted({t[i : i + n] for t in DOCS for n in (1, 2, 9) for i in range(len(t) - n + 1)})
    monkeypatch.setattr(strategies, "SCAN_CHARACTERS", 70)
    own = shards(spark, list(enumerate(DOCS)))
    want = sorted((p, d, i) for p, pattern in enumerate(many) for d, text in enumerate(DOCS) for i in range(len(text)) if text.startswith(pattern, i))
    assert sorted(map(tuple, strategies.locate(own, patterns_of(spark, many)).collect())) == want
    assert found(strategies.search(own, patterns_of(spark, many), "sada_rank")) == brute(DOCS, many)
    with pytest.raises(ValueError):
        strategies.locate(own, patterns_of(spark, ["a", ""]))


@pytest.mark.parametrize("name", sorted(SHARDED))
def test_a_listing_stores_nothing_and_shuffles_no_suffix(spark, tmp_path, name):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('the ion of man ', 40) AS text")  # 180,000 suffixes
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tables = set(os.listdir(folder := shared_folder(spark).removeprefix("file:")))
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() == (300 * 40 * 3 if name == "locate" else 300 * 3)
    assert set(os.listdir(folder)) == tables


def test_many_patterns_and_lots(spark, index, monkeypatch):
    many = sorted({t[i : i + n] for t in DOCS for n in (1, 2, 3, 5) for i in range(len(t) - n + 1)})
    monkeypatch.setattr(strategies, "SCAN_CHARACTERS", 50)
    monkeypatch.setattr(strategies, "PUSHED", 3)
    want = brute(DOCS, many)
    assert found(strategies.scan(index.docs, patterns_of(spark, many))) == want
    assert found(strategies.search(index, patterns_of(spark, many), "preagg")) == want


def test_empty_pattern_and_unknown_strategy(spark, index):
    with pytest.raises(ValueError):
        strategies.search(index, patterns_of(spark, ["a", ""]), "suffix")
    with pytest.raises(ValueError):
        strategies.search(index, patterns_of(spark, ["a"]), "none")


def test_interval_holds_the_occurrences(spark, index):
    row = strategies.intervals(index, patterns_of(spark, ["ana"])).first()
    occurring = strategies.locate(index, patterns_of(spark, ["ana"])).collect()
    assert row.ep - row.sp + 1 == len(occurring)
    got = {r.doc_id: r.freq for r in strategies.search_interval(index, row.sp, row.ep).collect()}
    assert got == {d: n for (_, d), n in brute(DOCS, ["ana"]).items()}


@pytest.mark.parametrize(("bag", "want"), [([], {}), ([3], {3: 1}), ([3, 3, 1, 3, 1, 6], {1: 2, 3: 3, 6: 1}), ([3, 3, 1, 3, 1, 6, 321], {1: 2, 3: 3, 6: 1, 321: 1})])
def test_counting_a_bag(spark, bag, want):
    rows = spark.createDataFrame([(d,) for d in bag], "doc_id long")
    assert {r.doc_id: r.freq for r in strategies.count_occurrences(rows).collect()} == want


def test_maps(spark, index):
    rows = strategies.as_maps(strategies.search(index, patterns_of(spark, ["ana"]))).collect()
    assert rows[0].freqs == {d: n for (_, d), n in brute(DOCS, ["ana"]).items()}


def test_saved_index(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = DocIndex.open(spark, str(tmp_path))
    assert again.key_length == 8 and again.stretch == 16
    assert found(strategies.search(again, patterns_of(spark, PATTERNS), "sada_isa")) == brute(DOCS, PATTERNS)
    with pytest.raises(FileNotFoundError):
        DocIndex.open(spark, str(tmp_path / "none"))


def test_scan_keeps_no_python_in_the_plan(spark, index):
    plan = strategies.scan(index.docs, patterns_of(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
