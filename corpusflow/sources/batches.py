"""B1: a batch sink as a Python data source: files of at most 5000 rows, counted and committed by message.

``df.write.format("row_batches").option("job", "42").mode("append").save(path)``.
A task cuts its rows into batches, writes each as one file whose name holds job,
task and attempt, and reports file and rows in its commit message. Spark passes on
the messages of one attempt of every task, and the commit lists their files in
``jobs/<job>.json``: a failed, repeated or speculative attempt leaves files that no
list names. A job that is listed already (a replay) commits nothing. Readers take
the listed files only (``read_batches``); ``total`` sums the reported rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusflow.config import DEFAULT
from corpusflow.session import ship_package
from corpusflow.sources import storage

FORMAT = "row_batches"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task with their rows."""

    files: list[tuple[str, int]] = field(default_factory=list)


def _open(path: str):
    """File system and path of a folder, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, rows: int):
        self.path, self.job, self.rows = path.rstrip("/"), job, rows
        if rows < 1:
            raise ValueError("batch_rows must be positive")

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _open(self.path)
        folder = f"{base}/files/{self.job}"
        files.create_dir(folder, recursive=True)
        # the attempt and a random part: two attempts never write the same file
        stem = f"p{task.partitionId():06d}-a{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        done, held, n = Written(), [], 0

        def flush(parts: list) -> None:
            table = pa.Table.from_batches(parts)
            name = f"{self.job}/{stem}-b{len(done.files):06d}.parquet"
            pq.write_table(table, f"{base}/files/{name}", filesystem=files)
            done.files.append((name, table.num_rows))

        for batch in iterator:
            while n + batch.num_rows >= self.rows:
                held.append(batch.slice(0, self.rows - n))
                batch, n = batch.slice(self.rows - n), 0
                flush(held)
                held = []
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            flush(held)
        return done

    def commit(self, messages: list) -> None:
        files, base = _open(self.path)
        listed = f"{base}/jobs/{self.job}.json"
        from pyarrow.fs import FileType

        if files.get_file_info(listed).type == FileType.File:
            return  # a replay: what it wrote stays unlisted
        files.create_dir(f"{base}/jobs", recursive=True)
        names = sorted(f for m in messages if m is not None for f in m.files)
        part = f"{base}/jobs/.{self.job}-{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as out:
            out.write(json.dumps({"files": names, "rows": sum(n for _, n in names)}).encode())
        files.move(part, listed)

    def abort(self, messages: list) -> None:
        """Nothing is listed, so nothing was written; files of ended tasks stay unlisted."""


class RowBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise NotImplementedError("read with read_batches")

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are appended; a new folder starts anew")
        return BatchWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex, int(self.options.get("batch_rows", DEFAULT.write_batch_size)))


def write_batches(rows: DataFrame, path: str, job: str | None = None, batch_rows: int = DEFAULT.write_batch_size) -> int:
    """Append ``rows`` in batches; the number of rows that the job has written, by its commit messages."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(RowBatches)
    job = job or uuid.uuid4().hex
    listed = f"{path}/jobs/{job}.json"
    known = storage.read_text(spark, listed)
    if known is not None:  # a replay: its files would stay unlisted
        return json.loads(known)["rows"]
    rows.write.format(FORMAT).option("job", job).option("batch_rows", str(batch_rows)).mode("append").save(path)
    return json.loads(storage.read_text(spark, listed))["rows"]


def jobs(spark: SparkSession, path: str) -> dict[str, dict]:
    """The committed jobs with their files and rows."""
    names = [n for n in storage.names(spark, f"{path}/jobs") if n.endswith(".json")]
    return {n[:-5]: json.loads(storage.read_text(spark, f"{path}/jobs/{n}")) for n in names}


def total(spark: SparkSession, path: str) -> int:
    return sum(j["rows"] for j in jobs(spark, path).values())


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed jobs."""
    files = [f"{path}/files/{name}" for j in jobs(spark, path).values() for name, n in j["files"] if n]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
