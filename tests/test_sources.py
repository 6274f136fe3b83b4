from lexweave.operators import corpus as C
from lexweave.sources import files as S
from lexweave.streaming import corpus as T


def test_raw_documents(spark, tmp_path):
    (tmp_path / "b.txt").write_text("SOURCE_URL: http://x/y\n\nBody one.")
    (tmp_path / "a.txt").write_text("no header")
    (tmp_path / "c.md").write_text("not read")
    got = [tuple(r) for r in S.raw_documents(spark, f"file://{tmp_path}").orderBy("doc_id").collect()]
    assert got == [("a.txt", None, None, "no header"), ("b.txt", "url", "http://x/y", "SOURCE_URL: http://x/y\n\nBody one.")]


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps. Another longer sentence follows here."), (2, "The quick brown fox jumps!")], "doc_id long, text string")
    sents = C.unique_sentences(C.sentences(docs))
    S.write_corpus(sents, f"file://{tmp_path}/corpus")
    back = S.sentences(spark, f"file://{tmp_path}/corpus")
    assert [r.sent for r in back.collect()] == ["the quick brown fox jumps", "another longer sentence follows here"]
    S.write_documents(sents, f"file://{tmp_path}/docs")
    assert spark.read.parquet(f"file://{tmp_path}/docs").count() == 1


def test_names_vectors_and_log(spark, tmp_path):
    (tmp_path / "n.txt").write_text("  Asha \n\nBEN\n")
    assert [r.name for r in S.names(spark, f"file://{tmp_path}/n.txt").collect()] == ["asha", "ben"]
    v = spark.createDataFrame([("a", 0, [1.0])], "word string, idx long, vector array<double>")
    S.write_vectors(v, f"file://{tmp_path}/v", "m1")
    S.write_vectors(v, f"file://{tmp_path}/v", "m2")
    assert S.vectors(spark, f"file://{tmp_path}/v").count() == 2 and S.vectors(spark, f"file://{tmp_path}/v", "m1").count() == 1
    log = spark.createDataFrame([("u", "saved", "f.txt", [("p", "q.pdf")]), ("w", "skipped", None, [])], "url string, status string, text_file string, pdfs array<struct<url: string, file: string>>")
    S.write_crawl_log(log, f"file://{tmp_path}/log")
    assert sorted(map(str, S.read_crawl_log(spark, f"file://{tmp_path}/log").collect())) == sorted(map(str, log.collect()))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"The quick brown fox number {'abcdef'[k % 3]}x jumps. Same sentence every time here.") for k in range(9)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = T.sentences(T.documents(spark, f"file://{tmp_path}/in", files_per_batch=1))
    T.append_corpus(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    got = sorted(r.key for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == sorted(r.key for r in C.unique_sentences(C.sentences(docs)).collect())
