"""Session settings, the shared scratch folder and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str = "local[8]", app: str = "examloom", **conf: str) -> SparkSession:
    """A session as tests and the bench use it; on a cluster the caller's session is taken as it is."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that UDFs import it on any executor."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="examloom-")) / "examloom_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share.

    Only where the cluster names none (as in tests on one machine) a temporary folder of this machine is made.
    The folder is removed when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="examloom-scratch-")
        _SCRATCH[app] = f"{base.rstrip('/')}/examloom-{os.getpid()}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended already
        pass


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_scratch(df: DataFrame, name: str) -> str:
    """Write a Parquet table to the shared folder and return its path."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files are deleted when it ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder, go on from the written table.

    A written table survives lost executors and is read with column pruning, other than cached blocks. With
    drop_shuffles, the shuffle files that writing took are gone when it ends.
    """
    spark, schema = df.sparkSession, df.schema
    with shuffles_dropped(spark) if drop_shuffles else nullcontext():
        path = write_scratch(df, name)
    return spark.read.schema(schema).parquet(path)
