"""Session helpers shared by all operators: table access, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have at most to be sent to every executor; beyond it, joins are shuffled.
BROADCAST_ROWS = 500_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once for an application, so that none needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    to = f"{shared_dir(spark)}/lociflow-{context.applicationId}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(to)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(data.getvalue())
    out.close()
    context.addPyFile(to)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a new one on a local master, as in
    tests, and an error on a cluster, whose machines share no folder of ours."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lociflow-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


class Files:
    """Small files and folders on any file system that Spark knows, through the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, jvm = spark, spark.sparkContext._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def write_new(self, path: str, data: bytes) -> None:
        """A file that must not exist yet."""
        if self.exists(path):
            raise FileExistsError(path)
        out = self.fs.create(self.path_of(path), False)
        out.write(data)
        out.close()

    def read(self, path: str) -> bytes:
        source = self.fs.open(self.path_of(path))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def rename(self, old: str, new: str) -> None:
        """One step on file systems that rename atomically; an existing target is refused."""
        if self.exists(new):
            raise FileExistsError(new)
        if not self.fs.rename(self.path_of(old), self.path_of(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)


def spool(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    It cuts the lineage, survives the loss of executors and, being columnar, is a fraction of the size
    of an RDD checkpoint. The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/spool/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; a cluster's own cleaner takes the folder
        pass


def broadcast_if_small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint where its counted `rows` are within `limit`, else as it is (shuffled join)."""
    return F.broadcast(df) if rows is not None and rows <= limit else df
