import csv

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators.blocks import cover, node_lists, sampled_nodes
from corpuslens.operators.compressed import Grammar, compress, expanded, first_last_rows, grammars, interval_cover
from corpuslens.operators.suffixes import merged_runs, run_starts
from corpuslens.plans import benchmark, queries, strategies
from corpuslens.plans.index import build


def sequences():
    rng = np.random.default_rng(4)
    return [[5], [5, 5, 5, 5, 5], [1, 2, 1, 2, 3, 3, 3, 3, 1, 2, 1, 2], rng.integers(0, 5, 500).tolist(), np.tile(rng.integers(0, 90, 60), 20).tolist()]


@pytest.mark.parametrize("text", sequences())
def test_grammar_gives_every_range_back(text):
    text = np.array(text)
    docs, left, right, roots = compress(text)
    own = Grammar(docs, left, right, roots)
    assert 2 * len(left) + len(roots) <= len(text)
    n = len(text)
    for low, high in {(0, n - 1), (1, n - 2), (n // 3, n // 2), (n - 1, n - 1), (2, 1), (0, n + 50)}:
        want = text[low : high + 1]
        assert np.array_equal(own.docs[own.expand(low, high)], want)
        assert [i for at, var in own.cover(low, high) for i in range(at, at + int(own.span[var]))] == list(range(low, min(high, n - 1) + 1))
        if len(want):
            found, first, last = own.first_last(low, high)
            places = {d: [low + i for i, x in enumerate(want.tolist()) if x == d] for d in set(want.tolist())}
            assert {d: (a, b) for d, a, b in zip(found.tolist(), first.tolist(), last.tolist(), strict=True)} == {d: (p[0], p[-1]) for d, p in places.items()}


def test_listing_over_stretches(spark):
    text = sequences()[4] + sequences()[3]
    rows = spark.createDataFrame(list(enumerate(text)), "rk long, doc_id long").repartition(5)
    found = grammars(rows, 100)
    assert found.count() == 17
    ranges = [(0, 0, len(text) - 1), (1, 99, 100), (2, 130, 820), (3, 5, 5)]
    asked = spark.createDataFrame(ranges, "pattern_id long, sp long, ep long")
    want = {(p, d): ([i for i in range(a, b + 1) if text[i] == d][0], [i for i in range(a, b + 1) if text[i] == d][-1]) for p, a, b in ranges for d in set(text[a : b + 1])}
    assert {(r.pattern_id, r.doc_id): (r.first_rk, r.last_rk) for r in first_last_rows(asked, found, 100).collect()} == want
    assert sorted((r.pattern_id, r.rk, r.doc_id) for r in expanded(asked, found, 100).collect()) == sorted((p, i, text[i]) for p, a, b in ranges for i in range(a, b + 1))
    parts = interval_cover(asked, found, 100).collect()
    assert sorted((r.pattern_id, i) for r in parts for i in range(r.rk, r.rk + r.span_len)) == sorted((p, i) for p, a, b in ranges for i in range(a, b + 1))
    assert len(parts) < sum(b + 1 - a for _, a, b in ranges) / 2


def test_sampled_nodes_cover_an_interval(spark):
    rng = np.random.default_rng(8)
    docs = np.concatenate([rng.integers(0, 300, 200), rng.integers(0, 4, 500), rng.integers(0, 100, 324)]).tolist()
    before = [max((j for j in range(i) if docs[j] == d), default=None) for i, d in enumerate(docs)]
    seen = {}
    isa = [seen.setdefault(d, []).append(i) or len(seen[d]) - 1 for i, d in enumerate(docs)]
    rows = spark.createDataFrame([(i, d, isa[i], before[i], i // 4) for i, d in enumerate(docs)], "rk long, doc_id long, isa long, prev_rk long, block long")
    sampled = sampled_nodes(rows, len(docs), 4, 2, 3)
    lists = node_lists(rows, sampled, 4, 2)
    cost, want = {b: 4 for b in range(256)}, {}
    for k in range(1, 9):
        span = 4 * 2**k
        up = {}
        for node in range(1024 // span):
            own = set(docs[node * span : (node + 1) * span])
            below = cost[2 * node] + cost[2 * node + 1]
            if below > 3 * len(own):
                want[k, node] = own
            up[node] = len(own) if (k, node) in want else below
        cost = up
    got = {}
    for r in lists.collect():
        got.setdefault((r.level, r.node), {})[r.doc_id] = (r.freq, r.first_isa, r.last_isa)
    assert {key: set(v) for key, v in got.items()} == want and {(r.level, r.node) for r in sampled.collect()} == set(want)
    assert all(n == b - a + 1 for v in got.values() for n, a, b in v.values())
    ranges = [(0, 0, 1023), (1, 203, 690), (2, 7, 9), (3, 500, 500)]
    nodes, gaps = cover(spark.createDataFrame(ranges, "pattern_id long, sp long, ep long"), sampled, 4, 2)
    places = [(r.pattern_id, i) for r in nodes.collect() for i in range(r.node * 4 * 2**r.level, (r.node + 1) * 4 * 2**r.level)] + [(r.pattern_id, i) for r in gaps.collect() for i in range(r.lo, r.hi + 1)]
    assert sorted(places) == [(p, i) for p, a, b in ranges for i in range(a, b + 1)]


def test_node_sample_has_the_levels_of_its_sql(spark, tmp_path):
    names = spark.range(4000).selectExpr("id AS p_partkey", "concat('part ', id, ' of ', id % 7) AS p_name")  # over 8 * 4 ** 6 characters
    names.write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["node_sample"]).fetchall()
    got = queries.node_sample(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.level for r in got) <= 6


def test_merged_runs(spark):
    values, docs = [3, 3, 1, 2, 5, 4, 4], [0, 1, 2, 2, 2, 3, 4]
    begins, least = run_starts(np.array(values), np.array(docs))
    rows = spark.createDataFrame([(i, d, v) for i, (d, v) in enumerate(zip(docs, values, strict=True))], "rk long, doc_id long, ilcp_b int").repartition(3)
    got = sorted(tuple(r) for r in merged_runs(rows).collect())
    assert [r[1] for r in got] == begins.tolist() == [0, 2, 5] and [r[3] for r in got] == least.tolist() == [3, 1, 4] and [r[2] for r in got] == [2, 3, 2]


def test_benchmark_writes_counters_and_results(spark, tmp_path):
    docs = ["aaaa", "banana", "", "a.b.a.b.a"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "d.parquet"))
    (tmp_path / "p").write_text("aa\nana\n\nzzz\n")
    benchmark.main(["--patterns", str(tmp_path / "p"), "--data", str(tmp_path / "d.parquet"), "--out", str(tmp_path / "out"), "--plans", "scan,gcda_rank,preagg", "--block-size", "4", "--print-result"])
    (file,) = (tmp_path / "out/0/counters").glob("*.csv")
    rows = list(csv.DictReader(file.open()))
    assert [r["name"] for r in rows] == ["scan", "gcda_rank", "preagg"] and all(int(r["patterns"]) == 3 and float(r["bits_x_symbol"]) > 0 and float(r["time_x_pattern"]) > 0 for r in rows)
    lines = sorted("".join(f.read_text() for f in sorted((tmp_path / "out/0/result-preagg").glob("part*"))).splitlines())
    assert lines == sorted(["aa", "  0:3", "ana", "  1:2", "zzz"])
    assert list((tmp_path / "out/0/breakdown").glob("*.csv"))


def test_access(spark):
    index = build(spark.createDataFrame([(0, "banana"), (1, "ana")], "doc_id long, text string"))
    order = sorted(("banana"[i:], 0, i) for i in range(6)) + [("ana"[i:], 1, i) for i in range(3)]
    order = sorted(order)
    assert [(r.doc_id, r.pos) for r in strategies.access(index, 2, 4).orderBy("rk").collect()] == [(d, i) for _, d, i in order[2:6]]
    ranks = [sum(x[1] == d for x in order[:k]) for k, (_, d, _) in enumerate(order)]
    assert [r.occ for r in strategies.access_with_rank(index, 0, 9).orderBy("rk").collect()] == ranks
    row = strategies.places_in_documents(index, spark.createDataFrame([(0, 1, 3)], "doc_id long, s1 int, s2 int")).first()
    own = [i for _, d, i in order if d == 0]
    assert (row.isa_1, row.isa_2) == (own.index(1), own.index(3))
    assert index.rows.where(F.col("isa") != F.col("occ")).isEmpty()
