"""Session helpers: code shipping and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Applications that have the package.
_SHIPPED: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from the same checkout on a local master, else from a zip file that Spark gives to every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        if _is_local(spark):
            paths = [p for p in sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
            if ROOT not in paths:
                sc.environment["PYTHONPATH"] = ":".join([ROOT, *paths])
        else:
            package = Path(SparkFiles.getRootDirectory()) / "corpusloom.zip"
            with zipfile.ZipFile(package, "w", zipfile.ZIP_DEFLATED) as z:
                for source in sorted(Path(ROOT, "corpusloom").rglob("*.py")):
                    z.write(source, source.relative_to(ROOT))
            sc.addPyFile(str(package))
    # Batches for Python workers are bounded by bytes, not by rows alone: documents differ in size by orders of magnitude.
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, "8m")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def write_table(df: DataFrame, name: str, codec: str = "zstd", tasks: int | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Survives the loss of executors. With `tasks`, no more tasks than these write a file each."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    (df.coalesce(tasks) if tasks else df).write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    atexit.register(_drop_quietly, spark, path)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of write_table() that no later plan reads."""
    _drop_path(df.sparkSession, df._corpusloom_path)


def _drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass
