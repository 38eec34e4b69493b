"""Paged files read in byte ranges, against splitting whole files."""

import io
import os
import random

import pytest

from corpusflow.sources import paged


@pytest.mark.parametrize("text", ["", "\f", "a", "a\f", "\fa", "ab\f\fcd\fe", "é\fü\f", "x" * 50 + "\f" + "y" * 3])
def test_ranges_own_every_page_once(text):
    data = text.encode()
    want = text.split("\f")
    for size in (1, 2, 3, 7, 100):
        for piece in (1, 2, 5, 1000):
            starts = list(range(0, len(data), size)) or [0]
            got = []
            for a in starts:
                end = min(a + size, len(data)) if a != starts[-1] else len(data) + 1
                got += paged.page_bytes(io.BytesIO(data), a, end, b"\f", piece)
            assert [p.decode() for _, p in got] == want
            assert [b for b, _ in got] == [sum(len(p.encode()) + 1 for p in want[:k]) for k in range(len(want))]


def test_a_file_far_above_a_range(spark, tmpdir_path):
    rng = random.Random(1)
    pages = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 400))) for _ in range(3000)]
    os.makedirs(f"{tmpdir_path}/in/deeper")
    with open(f"{tmpdir_path}/in/long.txt", "wb") as f:
        f.write("\f".join(pages).encode())
    for name, data in (("deeper/bad.txt", b"ok\f\xff\xfe\fend"), ("empty.txt", b""), (".hidden", b"no"), ("_no", b"no")):
        with open(f"{tmpdir_path}/in/{name}", "wb") as f:
            f.write(data)
    rows = paged.read_pages(spark, f"{tmpdir_path}/in", range_bytes=10_000).collect()
    of = lambda name: [(r.page_no, r.text, r.error) for r in sorted(rows, key=lambda r: r.page_no) if r.path.endswith(name)]
    assert of("long.txt") == [(k, p, None) for k, p in enumerate(pages)]
    assert of("empty.txt") == [(0, "", None)]
    bad = of("bad.txt")
    assert [t for _, t, _ in bad] == ["ok", None, "end"] and "page at 3" in bad[1][2]
    assert not [r for r in rows if "hidden" in r.path or "_no" in r.path]
    one = spark.read.format("paged_files").option("path", f"{tmpdir_path}/in/long.txt").option("range_bytes", "10000").load()
    assert one.rdd.getNumPartitions() > 50  # many tasks share the file
    assert paged.read_pages(spark, f"{tmpdir_path}/none").count() == 0
    with pytest.raises(Exception):
        spark.read.format("paged_files").option("path", tmpdir_path).option("separator", "--").load().count()


def test_many_small_files_share_tasks(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(paged, "TASKS", 8)
    os.makedirs(f"{tmpdir_path}/in")
    for k in range(100):
        with open(f"{tmpdir_path}/in/{k}.txt", "wb") as f:
            f.write("\f".join(f"{k} {j} " + "x" * 30 for j in range(k % 4 + 1)).encode())
    reader = paged.PagedReader(f"{tmpdir_path}/in", 50, "\f")
    assert len(reader.partitions()) <= 8
    assert len(paged.PagedReader(f"{tmpdir_path}/in", 50, "\f").partitions()[0].ranges) > 10
    got = [(p.rsplit("/", 1)[1], t) for part in reader.partitions() for p, _, t, _ in reader.read(part)]
    want = [(f"{k}.txt", f"{k} {j} " + "x" * 30) for k in range(100) for j in range(k % 4 + 1)]
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(paged, "RANGE_BYTES", 200)  # a task reads about that much at most
    assert len(reader.partitions()) > 30
