"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 1000

_test_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_settled: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "taxloom",
                  **conf: str) -> SparkSession:
    """A session for tests and the benchmark. On a cluster use the session it provides."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a local session gets a temporary folder, removed when the
    interpreter ends; on a cluster that would lose rows, as each executor would write to its own disk, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _test_dirs:
            _test_dirs[app] = tempfile.mkdtemp(prefix="taxloom-")
            atexit.register(shutil.rmtree, _test_dirs[app], ignore_errors=True)
        folder = _test_dirs[app]
    return folder.rstrip("/")


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end whatever ``settle`` stored inside: ``with scratch(spark): job(...).write.parquet(target)``."""
    mark = len(_settled)
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _settled[mark:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _settled[mark:]


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for the few Python functions that run
    there. Not needed where the package is installed on the workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="taxloom-"), "taxloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("taxloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """Readies a given session for this package's jobs.

    The JVM never compiles a method above 8000 bytes; Spark's own limit for generated code is far above,
    so wide projections would run interpreted. With the limit at 8000 Spark splits them instead.
    Rows sent to Python workers hold whole documents, so they go in smaller batches than Spark's 10,000 rows.
    """
    ship_package(spark)
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stored_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; ``scratch`` deletes what a job stored there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _settled.append(path)
    return path


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the plan between passes of a multi-pass job and survives lost executors. A Parquet table is
    used rather than an RDD checkpoint so that later passes still prune columns and see real sizes
    (which lets Spark choose broadcast joins by measured size). ``scratch`` deletes what a job stored.
    """
    spark = df.sparkSession
    path = stored_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
