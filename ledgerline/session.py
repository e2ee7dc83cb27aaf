"""Session settings for local runs; on a cluster the submitter's own session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cpus: int | None = None, partitions: int | None = None, app: str = "ledgerline") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")  # keep all local cores busy
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once a session, so that functions on them can import it from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    if sc.master.startswith("local"):  # on a cluster Spark itself limits the threads of a Python worker
        sc.environment.setdefault("OMP_NUM_THREADS", "1")
    here = Path(__file__).resolve().parent
    if here.is_dir():  # else the package came as an archive that the submitter has shipped
        archive = Path(tempfile.mkdtemp(prefix="ledgerline-")) / "ledgerline_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(here.rglob("*.py")):
                z.write(file, file.relative_to(here.parent))
        sc.addPyFile(str(archive))
    sc._ledgerline_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, set in the session.

    `spark.checkpoint.dir` names a folder shared by all executors, so a lost executor does not lose the
    data. Only a local session that names nothing gets a folder below /tmp; a cluster without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="ledgerline-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


def truncate_lineage(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the folder the cluster names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored_columns(df):
    """Write a table by columns to the checkpoint folder and read it again: cuts the lineage, and readers take only the columns they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
