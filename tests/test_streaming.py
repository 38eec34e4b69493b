import os

from pyspark.sql import functions as F

from corpusflow.operators import search
from corpusflow.plans import retrieval
from corpusflow.streaming import ingest as L


def _docs_stream(spark, folder):
    schema = "doc_id long, text string, filename string, file_type string"
    return spark.readStream.schema(schema).parquet(folder)


def test_ingest_stream_replay_and_new_files(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([(1, "alpha beta gamma " * 40, "a.txt", "txt")],
                          "doc_id long, text string, filename string, file_type string").write.parquet(src + "/1")
    coll, ck = os.path.join(tmpdir_path, "coll"), os.path.join(tmpdir_path, "ck")
    L.start_ingest(_docs_stream(spark, src + "/*"), coll, ck).awaitTermination()
    n1 = spark.read.parquet(coll).count()
    L.start_ingest(_docs_stream(spark, src + "/*"), coll, ck).awaitTermination()  # replay: nothing new
    assert spark.read.parquet(coll).count() == n1
    spark.createDataFrame([(2, "delta " * 10, "b.txt", "txt")],
                          "doc_id long, text string, filename string, file_type string").write.parquet(src + "/2")
    L.start_ingest(_docs_stream(spark, src + "/*"), coll, ck).awaitTermination()
    ids = {r.id for r in spark.read.parquet(coll).select("id").collect()}
    assert "b.txt_0" in ids and len(ids) == n1 + 1
    # batch = stream: the streamed rows equal the batch pipeline on the same input
    batch = L.ingest_batch(spark.read.parquet(src + "/*")).select("id", "document")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, spark.read.parquet(coll).select("id", "document").collect()))


def test_collection_ingest_appends_versions(spark, tmpdir_path):
    from corpusflow.operators import collection

    src, path = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "coll")
    schema = "doc_id long, text string, filename string, file_type string"
    spark.createDataFrame([(1, "alpha beta gamma " * 40, "a.txt", "txt")], schema).coalesce(1).write.parquet(src + "/1")
    spark.createDataFrame([(2, "delta " * 10, "b.txt", "txt"), (3, " ", "c.txt", "txt")], schema).coalesce(1).write.parquet(src + "/2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    L.start_collection_ingest(stream, path, os.path.join(tmpdir_path, "ck1")).awaitTermination()
    v = collection.current(spark, path)
    assert v.number == 3 and len(v.segments) == 2
    L.start_collection_ingest(stream, path, os.path.join(tmpdir_path, "ck2")).awaitTermination()  # a replay from the start
    assert collection.current(spark, path) == v
    batch = L.ingest_batch(spark.read.parquet(src + "/*")).select("id", "document")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, collection.read(spark, path).select("id", "document").collect()))


def test_query_log_and_search_streams(spark, tmpdir_path):
    base = "/root/testdata/sf0.001"
    req_dir = os.path.join(tmpdir_path, "req")
    spark.read.parquet(f"{base}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(7).alias("n_results")).write.parquet(req_dir)
    stream = spark.readStream.schema("query_id long, query string, n_results int").parquet(req_dir)
    log = os.path.join(tmpdir_path, "log")
    L.start_query_log(stream, log, os.path.join(tmpdir_path, "ck1")).awaitTermination()
    assert spark.read.parquet(log).count() == 40
    idx = search.build_index(retrieval.collection_rows(spark, base), "id", "embedding")
    out = os.path.join(tmpdir_path, "hits")
    L.start_search(stream, idx, out, os.path.join(tmpdir_path, "ck2"), k=10).awaitTermination()
    streamed = {(r.query_id, r.rank, r.id) for r in spark.read.parquet(out).collect()}
    batch = {(r.query_id, r.rank, r.id) for r in retrieval.text_search(spark, base).collect()}
    assert streamed == batch


def test_file_stream_ingest_routes_extracts_and_rejects(spark, tmpdir_path):
    from corpusflow.sources.extract import make_docx

    src = os.path.join(tmpdir_path, "files")
    os.makedirs(src)
    content = {"a.txt": b"plain words here\r\nsecond line", "b.docx": make_docx(["para one", "para two"]),
               "c.zip": b"PK\x03\x04", "d.csv": b"x,y\n1,2\n", "e.md": b" \n ", "f.pdf": b"%PDF-1.4"}
    for name, data in content.items():
        with open(os.path.join(src, name), "wb") as f:
            f.write(data)
    coll, rej = os.path.join(tmpdir_path, "coll"), os.path.join(tmpdir_path, "rej")
    L.start_file_ingest(spark, src, coll, rej, os.path.join(tmpdir_path, "ck")).awaitTermination()
    docs = {r.id: r.document for r in spark.read.parquet(coll).collect()}
    assert docs["a.txt_0"] == "plain words here second line"
    assert docs["b.docx_0"] == "para one para two"
    assert "d.csv_0" in docs
    reasons = {r.filename: r.reason for r in spark.read.parquet(rej).collect()}
    assert reasons["c.zip"] == "unsupported" and reasons["e.md"] == "blank"
    assert reasons["f.pdf"].startswith("Error processing pdf file")


def test_tables_stored_as_folders_are_streamed(spark, tmpdir_path):
    from corpusflow.plans import streams

    docs = spark.createDataFrame([(k, f"alpha {k} " * 100) for k in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = streams.stream_ingest(spark, tmpdir_path)
    assert sorted(r.source for r in got.select("source").distinct().collect()) == [f"doc_{k}.txt" for k in range(6)]
