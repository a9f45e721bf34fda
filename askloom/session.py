"""Session helpers: builder for local runs and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "askloom", memory: str = "16g") -> SparkSession:
    """A session for tests and benches; a cluster supplies its own."""
    n = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` decides. Only a local master without that
    setting gets a folder of its own; a cluster without it is an error,
    because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="askloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


_FOLDERS: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A new path in this application's own part of the shared folder.

    The part is deleted when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = f"{ensure_checkpoint_dir(spark)}/askloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = folder
    return f"{_FOLDERS[app]}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table or folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch, about, in the jobs that write tables.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside send rows to Python workers in batches of some ``BATCH_BYTES``.

    A worker holds a batch several times, as input, result and what comes between, and keeps that memory for
    its next task. Without the bound a batch grows with its task's rows, up to 10,000 or 64 MB.
    """
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Used where one result feeds several branches or a loop: later stages read
    the written copy, so a lost executor does not lose it. A Parquet table also
    gives Spark its true size (for join choices) and pruned columns. Its Python
    steps get small batches.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Spark serves the archive to all executors, so nothing has to be installed there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="askloom-package-")) / "askloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
