import struct

from corpuslens.functions.text import occurrences
from corpuslens.operators import grammar
from corpuslens.sources import artifacts, collections
from corpuslens.streaming.listing import stream_listing, stream_totals
from pyspark.sql import functions as F


def test_delimited_file(spark, tmp_path):
    (tmp_path / "data").write_bytes(b"one\0\0two\nlines\0three\0")
    got = collections.read_delimited(spark, str(tmp_path / "data")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "one"), (1, ""), (2, "two\nlines"), (3, "three")]
    (tmp_path / "open").write_bytes(b"a\0b")
    assert [r.text for r in collections.read_delimited(spark, str(tmp_path / "open")).orderBy("doc_id").collect()] == ["a", "b"]


def test_split_collection(spark):
    row = spark.createDataFrame([("a\0\0b\0",), ("a\0b",)], "t string").select(collections.split_collection(F.col("t")).alias("d")).collect()
    assert [r.d for r in row] == [["a", "", "b"], ["a", "b"]]


def test_patterns_keep_order_and_repeats(spark, tmp_path):
    (tmp_path / "p").write_text("b\n\na\nb\n")
    assert [tuple(r) for r in collections.read_patterns(spark, str(tmp_path / "p")).orderBy("pattern_id").collect()] == [(0, "b"), (1, "a"), (2, "b")]


def test_fasta(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fasta").write_text(">one x\nACGT\nAC\n>two\r\nGG\r\n")
    (tmp_path / "sub" / "b.fasta").write_text(">three\nTT\n>four\nCC\n>five\nAA\n")
    (tmp_path / "c.txt").write_text("no")
    assert [r.text for r in collections.read_fasta(spark, str(tmp_path)).orderBy("doc_id").collect()] == ["ACGTAC\x18GG", "TT\x18CC\x18AA"]
    assert [r.text for r in collections.read_fasta(spark, str(tmp_path), 1).orderBy("doc_id").collect()] == ["ACGTAC", "TT"]


def test_sampled_patterns_occur_and_hold_no_break(spark):
    docs = spark.createDataFrame([(0, "abcdefghijklmnopqrstuvwxyz"), (1, "short"), (2, "abcdefgh\x18ijklmnopqr" * 3)], "doc_id long, text string")
    rows = collections.sample_patterns(docs, 20).join(docs, "doc_id").collect()
    assert rows and all(r.pattern in r.text and "\x18" not in r.pattern and len(r.pattern) in (8, 12, 16) for r in rows)


def test_printed_results_and_space(spark, tmp_path):
    docs, patterns = spark.createDataFrame([(0, "aaa"), (1, "ba")], "doc_id long, text string"), collections.patterns_of(spark, ["a", "b"])
    found = patterns.crossJoin(docs).where(F.contains("text", "pattern")).select("pattern_id", "doc_id", occurrences(F.col("text"), F.col("pattern")).alias("freq"))
    artifacts.print_results(found, patterns, str(tmp_path / "out"))
    assert [r.value for r in artifacts.printed_results(found, patterns).collect()] == ["a", "  0:3", "  1:1", "b", "  1:1"]
    artifacts.save({"docs": docs}, str(tmp_path / "t"))
    sizes = artifacts.file_space(spark, str(tmp_path / "t"), ["docs"])
    assert sizes.first().bytes > 0
    odd = spark.createDataFrame([(1, "é", [1, 2], None), (2, None, None, 1.0)], "a long, b string, c array<int>, d double")
    assert [tuple(r) for r in artifacts.space({"odd": odd}).collect()] == [("odd", 2, 8 + 2 + 8 + 8 + 8)]
    artifacts.write_space(sizes, str(tmp_path / "space"))
    assert spark.read.csv(str(tmp_path / "space"), header=True).count() == 1


def test_numbers_and_grammars_in_files(spark, tmp_path):
    values = [5, -7, 2**31 - 1, 0, 3] * 40
    artifacts.write_numbers(spark.createDataFrame(list(enumerate(values)), "i long, value long").repartition(3), str(tmp_path / "n"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "n").glob("part-*")))
    assert raw == struct.pack(f"<{len(values)}i", *values)
    assert [r.value for r in artifacts.read_numbers(spark, str(tmp_path / "n")).orderBy("i").collect()] == values
    rules = [(4, 1, 2), (5, 4, 4), (6, 5, 3)]
    (tmp_path / "g.R").write_bytes(struct.pack("<7i", 4, 1, 2, 4, 4, 5, 3))
    (tmp_path / "g.C").write_bytes(struct.pack("<3i", 6, 3, 5))
    sigma, read, sequence = artifacts.read_grammar(spark, str(tmp_path / "g.R"), str(tmp_path / "g.C"))
    assert sigma == 3 and sorted(tuple(r) for r in read.collect()) == rules
    spans = grammar.occurrences(read, sigma).select("var", "span_len").distinct()
    roots = grammar.laid_out(sequence, spans).select("var", F.col("off").alias("start"))
    assert [r.term for r in grammar.expand(read, roots, spans, 0, 10).orderBy("off").collect()] == [1, 2, 1, 2, 3, 3, 1, 2, 1, 2]
    artifacts.write_grammar(sigma, read, sequence, str(tmp_path / "h.R"), str(tmp_path / "h.C"))
    again = artifacts.read_grammar(spark, str(tmp_path / "h.R"), str(tmp_path / "h.C"))
    assert again[0] == 3 and sorted(tuple(r) for r in again[1].collect()) == rules and again[2].orderBy("root_pos").collect() == sequence.orderBy("root_pos").collect()


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, "aaaa"), (1, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("listed", stream_listing(docs, ["aa", "b"]), "append"), ("totals", stream_totals(docs, ["aa", "b"]), "complete")):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(tuple(r) for r in spark.table("listed").collect()) == [(0, 0, 3), (1, 1, 1)]
    assert sorted(tuple(r) for r in spark.table("totals").collect()) == [(0, 1, 3), (1, 1, 1)]
