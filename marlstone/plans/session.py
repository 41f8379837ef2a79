"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []


def build_session(master: str = "local[8]", app: str = "marlstone", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that they need no path to it."""
    context = spark.sparkContext
    if getattr(context, "_marlstone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="marlstone-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/marlstone-code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(f"{at}/{n}", os.path.relpath(f"{at}/{n}", os.path.dirname(root)))
    context.addPyFile(path)
    context._marlstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by path so that pruning and pushdown reach the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIRS:
            _OWN_DIRS.append(tempfile.mkdtemp(prefix="marlstone-"))
            atexit.register(shutil.rmtree, _OWN_DIRS[0], True)
        folder = "file://" + _OWN_DIRS[0]
    return folder.rstrip("/")


class Workspace:
    """Written tables that cut lineage between the rounds of an iterative operator.

    Tables lie under the shared folder, so losing executors loses nothing; the plan that follows starts at a
    scan and has exact size statistics. Superseded tables are dropped with ``drop``; the last ones stay for the
    result that reads them and go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_remove, self.root, spark)

    def write(self, df: DataFrame, label: str = "t", by: str | None = None) -> DataFrame:
        """The frame, written and read back; ``by`` names a column of few values to lay it out by."""
        self.n += 1
        path = f"{self.root}/{label}{self.n}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._marlstone_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_marlstone_path", None)
            if path:
                _delete(self.spark, path)


def _remove(path: str, spark: SparkSession) -> None:
    """At the end of the driver, through the file system the path belongs to; a local path without it if the session is gone."""
    local = path.removeprefix("file://")
    if os.path.isabs(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session has ended
        pass


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
