"""Session helpers: recommended configs and a cluster-safe checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows per Arrow batch handed to Python: documents can be megabytes each,
    # so a bounded batch keeps a worker's memory bounded
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "corpusflow",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in RECOMMENDED.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session leaves it unset (local tests) do we set our own,
    under ``fallback`` or a fresh folder below /tmp.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        master = spark.conf.get("spark.master", "")
        if fallback is None and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if fallback is None:
            import tempfile
            fallback = tempfile.mkdtemp(prefix="corpusflow-ckpt-", dir="/tmp")
        d = fallback
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        pass
    return d


#: Bytes of an Arrow batch handed to Python. A row can hold a text or a block of
#: 1024 vectors, and a worker holds several copies of its batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at ``BATCH_BYTES`` or below (or at one row), unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusflow`` importable in Python workers (``addPyFile`` of a zip).

    Idempotent per SparkContext. On a cluster this is how executors get the
    code (same as ``--py-files``); the zip is rebuilt when sources change.
    """
    import hashlib
    import pathlib
    import tempfile
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: code ships with the client
        return
    key = id(sc._jsc) if hasattr(sc, "_jsc") else id(sc)
    if key in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*.py"))
    h = hashlib.sha1()
    for p in files:
        h.update(str(p.relative_to(root)).encode())
        h.update(p.read_bytes())
    out = pathlib.Path(tempfile.gettempdir()) / f"corpusflow-{h.hexdigest()[:12]}.zip"
    if not out.exists():
        tmp = out.with_suffix(f".{os.getpid()}.part")
        with zipfile.ZipFile(tmp, "w") as z:
            for p in files:
                z.write(p, f"corpusflow/{p.relative_to(root)}")
        os.replace(tmp, out)
    sc.addPyFile(str(out))
    _SHIPPED.add(key)


def materialize(df):
    """Checkpoint ``df`` to the shared checkpoint folder, computing it once.

    A reliable checkpoint of an unpersisted plan runs it twice (one job to
    count, another to write); persisting first makes the write read the
    cached blocks. The cache is dropped once the checkpoint exists.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    if not checkpoint_dir(spark):
        return df.cache()
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the checkpoint folder and read it from there.

    Unlike ``materialize`` nothing is cached, rows lie packed on disk, and later
    steps read the columns they use.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest(df: DataFrame, n: int, *order: Column | str) -> list[Row]:
    """The first ``n`` rows in ``order`` (columns of ``df`` or expressions over them).

    ``orderBy().limit().collect()`` sends ``n`` rows of every task to the driver, which
    merges them; here a task does that, and the driver gets ``n`` rows.
    """
    return written(df.orderBy(*order).limit(n)).orderBy(*order).collect()
