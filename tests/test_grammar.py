import pytest

from corpuslens.operators import grammar
from corpuslens.plans.queries import GRAMMAR

TEXT = [4, 3, 2, 1, 3, 2, 1, 3, 3, 3, 2, 1, 2, 2, 1, 1]
SMALL = [(3, 1, 2), (4, 3, 3)]


@pytest.fixture(scope="module")
def big(spark):
    rules = spark.createDataFrame(GRAMMAR, "var long, left long, right long")
    occ = grammar.occurrences(rules, 4)
    return rules, occ, occ.select("var", "span_len").distinct(), spark.createDataFrame([(14, 0)], "var long, start long")


def test_first_and_last_positions(spark, big):
    got = {(r.var, r.term): (r.first_pos, r.last_pos) for r in big[1].collect()}
    for (var, term), want in {(5, 1): (2, 2), (5, 2): (1, 1), (6, 1): (3, 3), (6, 3): (1, 1), (7, 3): (1, 2), (10, 1): (3, 4), (10, 2): (1, 2), (14, 1): (4, 16), (14, 2): (3, 14), (14, 3): (2, 10), (14, 4): (1, 1)}.items():
        assert got[var, term] == want
    assert (7, 1) not in got
    small = {(r.var, r.term): (r.first_pos, r.last_pos) for r in grammar.occurrences(spark.createDataFrame(SMALL, "var long, left long, right long"), 2).collect()}
    assert small[4, 1] == (1, 3) and small[4, 2] == (2, 4)


@pytest.mark.parametrize(("parts", "first", "last"), [([5, 7, 6], {1: 2, 2: 1, 3: 3}, {1: 7, 2: 6, 3: 5}), ([1, 7, 6], {1: 1, 2: 5, 3: 2}, {1: 6, 2: 5, 3: 4}), ([3, 3], {3: 1}, {3: 2})])
def test_cover_of_several_variables(spark, big, parts, first, last):
    laid = grammar.laid_out(spark.createDataFrame(list(enumerate(parts)), "root_pos long, var long"), big[2])
    got = {r.term: (r.first_pos, r.last_pos) for r in grammar.cover_occurrences(laid, big[1]).collect()}
    assert got == {t: (first[t], last[t]) for t in first}


@pytest.mark.parametrize(("low", "high"), [(0, 15), (3, 9), (5, 5), (7, 15), (9, 3)])
def test_cover_and_expansion(big, low, high):
    rules, _, spans, roots = big
    span = {r.var: r.span_len for r in spans.collect()}
    parts = sorted((r.off, r.var) for r in grammar.cover(rules, roots, spans, low, high).collect())
    assert [i for off, var in parts for i in range(off, off + span[var])] == list(range(low, high + 1))
    assert [r.term for r in grammar.expand(rules, roots, spans, low, high + 1).orderBy("off").collect()] == TEXT[low : high + 1]


@pytest.mark.parametrize(("leaves", "want"), [([1], []), ([1, 2], [(3, 1, 2)]), ([1, 2, 3, 4], [(5, 1, 2), (6, 3, 4), (7, 5, 6)]), ([1, 2, 3, 4, 5], [(6, 1, 2), (7, 3, 4), (8, 6, 7), (9, 8, 5)])])
def test_binary_tree(spark, leaves, want):
    rows = spark.createDataFrame(list(enumerate(leaves)), "i long, id long")
    assert sorted(tuple(r) for r in grammar.binary_tree(rows, len(leaves) + 1).collect()) == want
