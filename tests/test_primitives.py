import random

import numpy as np

from corpuslens.functions import ordered
from corpuslens.functions.text import ranked_suffixes
from corpuslens.operators.suffixes import exact_suffix_array, run_minima

VALUES = [random.Random(3).randrange(4) for _ in range(100)]


def rows(spark, values=VALUES):
    return spark.createDataFrame(list(enumerate(values)), "rk long, v long").repartition(3)


def test_running_sum_and_shift_cross_blocks(spark):
    got = {r.rk: (r.s, r.before, r.after) for r in ordered.shifted(ordered.shifted(ordered.running_sum(rows(spark), "v", "s", size=7), "v", "before", -1, size=7), "v", "after", 1, size=7).collect()}
    assert got == {i: (sum(VALUES[: i + 1]), VALUES[i - 1] if i else None, VALUES[i + 1] if i + 1 < len(VALUES) else None) for i in range(len(VALUES))}


def test_rank_select(spark):
    bits = spark.createDataFrame([(i, v == 0) for i, v in enumerate(VALUES)], "i long, bit boolean")
    assert {r.i: r["rank"] for r in ordered.rank1(bits).collect()} == {i: VALUES[:i].count(0) for i in range(len(VALUES))}
    assert [r.i for r in ordered.select1(bits).orderBy("k").collect()] == [i for i, v in enumerate(VALUES) if v == 0]


def test_range_extremes(spark):
    ranges = [(k, *sorted(random.Random(k).sample(range(100), 2))) for k in range(20)]
    got = {r.range_id: (r.min_at, r.max_at) for r in ordered.range_extremes(rows(spark), spark.createDataFrame(ranges, "range_id long, lo long, hi long"), "v", size=7).collect()}
    for k, low, high in ranges:
        part = VALUES[low : high + 1]
        assert got[k] == (low + part.index(min(part)), low + part.index(max(part)))


def test_runs_and_numbers(spark):
    found = ordered.runs(rows(spark, [5, 5, 1, 1, 1, 5]), "v").orderBy("run_id").collect()
    assert [tuple(r) for r in found] == [(0, 0, 2, 5), (1, 2, 3, 1), (2, 5, 1, 5)]
    again = ordered.numbered(rows(spark).drop("rk"), "v", name="n").collect()
    assert sorted(r.n for r in again) == list(range(100)) and [r.v for r in sorted(again, key=lambda r: r.n)] == sorted(VALUES)
    assert ordered.runs(rows(spark, []), "v").count() == 0


def test_differences_are_restored(spark):
    found = ordered.differences(rows(spark), "v")
    assert min(r.shifted for r in found.collect()) == 0
    assert {r.rk: r.value for r in ordered.restored(found.select("rk", "diff")).collect()} == dict(enumerate(VALUES))


def test_bits(spark):
    r = ordered.bit_operations(spark.createDataFrame([(12, 10)], "a long, b long"), "a", "b").first()
    assert (r.not_a, r.and_ab, r.or_ab) == (~12, 8, 14)


def test_suffixes_of_one_text():
    rng = np.random.default_rng(1)
    texts = ["", "a", "aaaaaaa", "banana banana"] + ["".join(rng.choice(list("ab"), n)) for n in range(2, 60)]
    for length in (1, 3, 8, 33, 64):
        for t in texts:
            order, prefix = ranked_suffixes(np.frombuffer(t.encode("utf-32-le"), np.uint32), length)
            assert order.tolist() == sorted(range(len(t)), key=lambda i: (t[i : i + length], i))
            keys = [t[i : i + length] for i in order.tolist()]
            assert prefix.tolist()[1:] == [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:], strict=False)]


def test_run_minima():
    assert run_minima(np.array([3, 3, 1, 2, 5, 4]), np.array([0, 1, 2, 2, 2, 3])).tolist() == [3, 3, 1, 1, 1, 4]


def test_exact_suffix_array_of_repetitive_texts(spark):
    docs = ["abababababab" * 4, "abababababab" * 4, "", "aaaaaaaaaaaaaaaaaaaa", "abab"]
    got = [(r.doc_id, r.pos) for r in exact_suffix_array(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), 3).orderBy("rk").collect()]
    assert got == [(d, i) for _, d, i in sorted((t[i:], d, i) for d, t in enumerate(docs) for i in range(len(t)))]
