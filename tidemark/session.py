"""Session helpers: one place for the settings the operators rely on, for table reads and for cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches. On a cluster the submitter's settings hold and this is not used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g"))
        .config("spark.driver.maxResultSize", "2g")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a directory of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: the session's spark.checkpoint.dir. Where that is unset a temporary folder serves a session on one
    machine, as in tests; on a cluster it is an error, as other machines would not see it."""
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Checkpoints and tables that are written inside go to a folder of their own, which is deleted at the end: results must have been
    written or collected by then."""
    before = shared_folder(spark)
    folder = f"{before}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        spark.sparkContext.setCheckpointDir(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by an eager reliable checkpoint: later stages read it again even when every executor that wrote it is gone."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder; for wide or large rows of which later stages read some columns."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
