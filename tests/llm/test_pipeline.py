"""The pipeline's stages, each on its own input."""

import duckdb
import pytest

import corpus_pipeline
from corpuslens.llm.queries import ORACLES, QUERIES
from test_operators import SCHEMA, TEXTS, chunks_removed, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).persist()


def test_stages_keep_the_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
        assert stage(spark, spark.createDataFrame([], SCHEMA), FOLDER).count() == 0, name
    assert corpus_pipeline.packing(spark, spark.createDataFrame([], SCHEMA), FOLDER).count() == 0


def test_language_stage(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, FOLDER).collect()}
    assert not kept & {3, 4, 5, 9} and {0, 1, 2, 7, 10} <= kept
    bare = docs.withColumn("lang", docs.lang.substr(5, 0)).where("lang IS NULL")
    assert {r.doc_id for r in corpus_pipeline.language(spark, bare, FOLDER).collect()} == {r.doc_id for r in bare.collect()} - {3, 4, 5, 9}


def test_lines_stage(spark, docs):
    rows = corpus_pipeline.lines(spark, docs, FOLDER).collect()
    assert {r.doc_id: r.text for r in rows} == chunks_removed(TEXTS) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_near_duplicate_stage(spark, docs):
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, FOLDER).collect())
    assert kept == [0, 1, 2, 3, 6, 7, 8, 9, 10, 13]  # 4 and 5 have no word, as 3; 11, 12 and 14 are 0 again, 13 has É for é; 15 and 16 are 6
    odd = table(spark, ["a b c d e f g", "a b c d e f g", "h i j k l m n", "o p q r s t u"], [1, None, 2, 2])
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicate(spark, odd, FOLDER).collect()) == [1, 2, 2]
    odd = table(spark, ["a b c d e f g", "a b c d e f g", "h i j k l m n", "h i j k l m n", "h i j k l m n"], [None, None, 3, 3, None])
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicate(spark, odd, FOLDER).collect()) == [0, 3]


def test_mixing_and_packing_stages(spark, docs):
    mixed = corpus_pipeline.mixing(spark, docs, FOLDER)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    assert corpus_pipeline.packing(spark, mixed, FOLDER).agg({"doc_tokens": "min"}).first()[0] > 1


def test_run_packs_all_that_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r.length <= 2048 for r in rows) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    names = sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == names
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
