"""Places that the driver and every executor can reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset (local tests) a folder of this process's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="qhapaq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """Compute df once into Parquet in the shared folder and read it back.

    This cuts lineage: an executor lost later only costs a reread. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._qhapaq_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what written() made of these, once nothing will read it any more."""
    for df in tables:
        at = (df.sparkSession, df._qhapaq_path)
        if at in _written:
            _written.remove(at)
            _delete(*at)


def ship(spark: SparkSession) -> None:
    """Give executors this package, unless they have it: Python functions name its modules."""
    context = spark.sparkContext
    if getattr(context, "_qhapaq_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="qhapaq-code-")) / "qhapaq.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._qhapaq_shipped = True


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return
