"""Session building and the two things every multi-stage job needs: tables and checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "siftspark", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted session is used as it is."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a context, so that no worker depends on its own path."""
    sc = spark.sparkContext
    if not getattr(sc, "_siftspark_shipped", False):
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="siftspark-code-"), "siftspark.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(target)
        sc._siftspark_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder of spark.checkpoint.dir and cut its lineage.

    The session names the folder. Where it names none, a temporary one is set on a single machine (tests), and a
    cluster is an error, since its executors share no temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix=f"siftspark-{os.getpid()}-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
