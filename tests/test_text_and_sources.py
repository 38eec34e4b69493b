import os

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators.embedding import HashEmbedder, embed_column
from corpusflow.sources import files
from corpusflow.functions.text import clamp, py_strip


def py_suffix(name):
    ext = os.path.splitext(name)[1].lower()
    return ext if ext.startswith(".") else "." + ext


def test_file_type_edge_names(spark):
    names = ["a.TXT", "a.tar.gz", ".txt", "noext", "a.", "x.doc", "x.zip", "dir/b.Md", "..a", "a.b.c"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = {r.filename: (r.s, r.t) for r in df.select("filename", files.file_suffix(F.col("filename")).alias("s"),
                                                   files.file_type(F.col("filename")).alias("t")).collect()}
    for n in names:
        assert got[n][0] == py_suffix(n), n
        assert got[n][1] == py_suffix(n)[1:], n


def test_routing_rejects_unsupported(spark):
    df = spark.createDataFrame([("a.txt",), ("b.MP4",), ("c.zip",), ("d",)], "filename string")
    good, bad = files.route(df)
    assert {r.filename: r.extractor for r in good.collect()} == {"a.txt": "text", "b.MP4": "video"}
    assert sorted(r.filename for r in bad.collect()) == ["c.zip", "d"]


def test_decode_text(spark):
    rows = [(1, b"a\r\nb"), (2, b"a\rb"), (3, "﻿x".encode()), (4, b"\xff\xfe"), (5, b"")]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r.t for r in df.select("id", files.decode_text(F.col("content")).alias("t")).collect()}
    assert got == {1: "a\nb", 2: "a\nb", 3: "﻿x", 4: None, 5: ""}


def test_text_status(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, " "), (5, " x")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.s for r in df.select("id", files.text_status(F.col("text")).alias("s")).collect()}
    assert got == {1: "empty", 2: "empty", 3: "blank", 4: "blank", 5: "ok"}


def test_binary_file_source(spark, tmpdir_path):
    for name, data in [("a.txt", b"hello\r\nworld"), ("b.md", b"# t"), ("c.zip", b"PK")]:
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(data)
    df = files.read_files(spark, tmpdir_path)
    good, bad = files.route(df)
    txt = good.filter(F.col("extractor") == "text").select("filename", files.decode_text(F.col("content")).alias("t"))
    assert {r.filename: r.t for r in txt.collect()} == {"a.txt": "hello\nworld", "b.md": "# t"}
    assert [r.filename for r in bad.collect()] == ["c.zip"]


def test_requests_default(spark):
    raw = spark.createDataFrame([('{"query": "q"}',), ('{"query": "r", "n_results": 7, "conversation_id": 3}',),
                                 ('{"query": "s", "n_results": null}',)], "value string")
    got = [(r.query, r.n_results, r.conversation_id) for r in files.requests_from_json(raw).collect()]
    assert got == [("q", 5, None), ("r", 7, 3), ("s", 5, None)]


def test_clamp_and_strip(spark):
    df = spark.createDataFrame([(None,), (-1,), (9,), (10,), (50,), (51,)], "x int")
    assert [r.c for r in df.select(clamp(F.col("x")).alias("c")).collect()] == [None, 10, 10, 10, 50, 50]
    s = spark.createDataFrame([("  a b \n",)], "t string").select(py_strip(F.col("t")).alias("s")).first().s
    assert s == "a b"


def test_hash_embedder_jvm_equals_python(spark):
    texts = ["Hello, world! Héllo_again 12", "", "le chat été", "a a a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(embed_column(F.col("t")).alias("v")).collect()]
    ref = HashEmbedder(64).embed(texts)
    assert np.allclose(np.array(got), ref, atol=1e-15)
    assert np.allclose([np.linalg.norm(v) for v in got], [1, 0, 1, 1])


def test_model_embedder_plugin(spark):
    class Lengths:  # a stand-in model: [len, words]; local class, pickled by value
        dimension = 2

        def load(self):
            self.ready = True

        def embed(self, texts):
            return np.array([[len(t), len(t.split())] for t in texts], dtype=float)

    df = spark.createDataFrame([("a bc",), ("",), ("x y z",)], "t string")
    got = [r.v for r in df.select(embed_column(F.col("t"), Lengths()).alias("v")).collect()]
    assert got == [[4.0, 2.0], [0.0, 0.0], [5.0, 3.0]]


def test_reject_empty_embeddings_and_metadata_strip(spark):
    from corpusflow.operators.frames import strip_image_metadata
    from corpusflow.operators.index import reject_empty_embeddings

    rows = spark.createDataFrame([("a", [1.0]), ("b", []), ("c", None)], "id string, embedding array<double>")
    good, bad = reject_empty_embeddings(rows)
    assert [r.id for r in good.collect()] == ["a"] and sorted(r.id for r in bad.collect()) == ["b", "c"]
    img = spark.createDataFrame([("p", 2, 3, 3, 16, b"xx", "exif", "gps")],
                                "origin string, height int, width int, nChannels int, mode int, data binary, exif string, gps string")
    assert strip_image_metadata(img).columns == ["origin", "height", "width", "nChannels", "mode", "data"]


def test_paged_files_through_udtf(spark):
    from corpusflow.sources.extract import extract_pages

    files_df = spark.createDataFrame([("a.txt", "p one\fp two\fp three".encode()), ("b.txt", b"single")],
                                     "filename string, content binary")
    pages = extract_pages(files_df)
    got = {(r.filename, r.page_no): r.text for r in pages.collect()}
    assert got == {("a.txt", 0): "p one", ("a.txt", 1): "p two", ("a.txt", 2): "p three", ("b.txt", 0): "single"}
    text = {r.filename: r.text for r in files.paged_text(pages, "filename", "page_no", "text").collect()}
    assert text == {"a.txt": "p one\np two\np three\n", "b.txt": "single\n"}


def test_dense_histogram(spark):
    from corpusflow.operators.frames import dense_histogram, histogram

    v = spark.createDataFrame([(1, 0.5), (1, 0.7), (1, 3.2), (1, 300.0), (2, 255.9)], "video long, value double")
    d = {r.video: r.hist for r in dense_histogram(histogram(v, ["video"], "value", 256), ["video"], 256).collect()}
    assert len(d[1]) == 256 and d[1][0] == 2.0 and d[1][3] == 1.0 and sum(d[1]) == 3.0
    assert d[2][255] == 1.0 and sum(d[2]) == 1.0


def test_csv_of_one_row_is_printed_as_pandas_does():
    import io
    import random

    import pandas as pd

    from corpusflow.sources import extract as X

    rng = random.Random(5)
    odd = ["0", "-0", "007", "1", "-12", "999999999999999999", "9999999999999999999", "1.0", "-3.50", "0.1", "0.000001", "0.0", "-0.0", "0.1000001",
           "173665.47", "999999.999999", "1000000.5", "1234567.25", "1e5", "1E5x", "1e", "0x1F", "NA", "n/a", "nan", "NaN", "None", "null", "True", "false", "inf",
           "-inf", "Infinity", "O", "5-LOW", "1-URGENT", "a b", " a", "a ", '"q"', "'", "+1", "+a", "1_000", "a,b", "", "#N/A", "<NA>", "2024-01-01", "é", "a\tb",
           "x" * 60, ".5", "5.", "1.#IND", "--1", "-a", "12a", "1.2.3", "#x", "-NaN", "1d5", "1.5f", "1j"]
    heads = ["a", "a_long_name", "B2", "a", "", "1", "x y", "a.1", "é", "Unnamed: 0"]

    def cell():
        kind = rng.randint(0, 4)
        if kind == 0:
            return str(rng.randint(-10**rng.randint(0, 18), 10**rng.randint(0, 18)))
        if kind == 1:
            return f"{rng.uniform(-10**rng.randint(0, 6), 10**rng.randint(0, 6)):.{rng.randint(1, 6)}f}"
        return rng.choice(odd)

    files = [f"a\n{c}\n".encode() for c in odd]
    for _ in range(1500):
        n = rng.randint(1, 5)
        names = [f"c{k}" * rng.randint(1, 4) for k in range(n)] if rng.random() < 0.8 else [rng.choice(heads) for _ in range(n)]
        cells = [cell() for _ in range(n + rng.choice([0] * 8 + [-1, 1]))]
        files.append((",".join(names) + "\n" + ",".join(cells) + rng.choice(["\n"] * 8 + ["", "\r\n", "\n1\n"])).encode())
    plain = 0
    for data in files:
        table = X._one_row_table(data)
        if table is not None:
            plain += 1
            assert table == pd.read_csv(io.BytesIO(data)).to_string(), data
    assert plain > 200
    line = b"o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority\n1,3691,O,194029.55,5-LOW\n"
    assert X._one_row_table(line) is not None
