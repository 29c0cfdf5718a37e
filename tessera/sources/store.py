"""Tables that jobs write for themselves, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Local mode only, where driver and executors are one process.
LOCAL_DIR = "/tmp/checkpoints/tessera"


def work_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a cluster must name one, local mode has a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name the executors' shared folder in spark.checkpoint.dir")
        found = LOCAL_DIR
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; what is written there goes when the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files that are read again: lineage ends there, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_core_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tessera_core_shipped = True
