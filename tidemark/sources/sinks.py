"""Sinks: artifacts, keyed stores, journals, and the firewall around evaluation labels."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.memory import batch_errors, pending_keys

# Names that pipeline artifacts have.
ARTIFACTS = {"processed_meta.json", "frame_timestamps.json", "frames_manifest.json", "transcript.json", "vision_captions.json", "context_blocks.json", "semantic_structure.json", "metadata.json"}


def overwrite_videos(rows: DataFrame, path: str) -> None:
    """Write a stage's rows, replacing the partitions of the videos they hold and no others."""
    overwrite_partitions(rows, path, "video_id")


def overwrite_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Write rows partitioned by a column, replacing the partitions they hold and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_new(rows: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    rows.write.mode("errorifexists").parquet(path)


def write_new_json(path: str, value: dict) -> None:
    """One small document: written beside its place and then linked to it, so that it is whole or absent; fails when there is one."""
    text = json.dumps(value, allow_nan=False, indent=2, sort_keys=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(draft, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.link(draft, path)
    finally:
        Path(draft).unlink(missing_ok=True)


def append_journal(rows: DataFrame, path: str) -> None:
    """Append events as JSON lines; a commit is whole or absent."""
    rows.write.mode("append").json(path)


class VideoStore:
    """A keyed table in versions. Each write adds one folder of rows (partitioned by video_id) and then swaps the pointer file CURRENT,
    atomically; nothing that is there is written again. CURRENT names the newest version, and a small table with the version from which
    on the rows of each replaced video count. Readers see the old state until the swap, and never none. One writer at a time; `compact`
    rewrites the store without its dead rows."""

    def __init__(self, spark: SparkSession, path: str, dims: int):
        if isinstance(dims, bool) or not isinstance(dims, int) or dims < 1:
            raise ValueError("dimension must be a positive integer")
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims

    def _state(self) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT").first()[0])

    def current(self) -> int | None:
        """The newest version's number."""
        state = self._state()
        return None if state is None else state["version"]

    def _replaced(self, state: dict) -> DataFrame:
        if state["replaced"] is None:
            return self.spark.createDataFrame([], "video_id string, since long")
        return self.spark.read.schema("video_id string, since long").parquet(f"{self.path}/{state['replaced']}")

    def load(self) -> DataFrame:
        state = self._state()
        if state is None:
            raise FileNotFoundError("the store has no version")
        if not state["live"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(state["schema"])))
        rows = self.spark.read.option("basePath", f"{self.path}/rows").option("mergeSchema", True).parquet(*[f"{self.path}/rows/version={v}" for v in state["live"]])
        rows = rows.withColumn("video_id", F.col("video_id").cast("string"))
        if state["replaced"] is not None:
            since = self._replaced(state).select(F.col("video_id").alias("__v"), "since")
            rows = rows.join(since, F.col("video_id") == F.col("__v"), "left").where(F.col("since").isNull() | (F.col("version") >= F.col("since"))).drop("__v", "since")
        return rows.drop("version")

    def _swap(self, state: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        out = new.getFileSystem(conf).create(new)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), conf).rename(new, old, how)

    def _write(self, rows: DataFrame, version: int) -> bool:
        """Writes a version's rows; false if there are none."""
        folder = f"{self.path}/rows/version={version}"
        rows.drop("version").write.mode("overwrite").partitionBy("video_id").parquet(folder)  # a leftover of a writer that failed before its swap
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return any(f.isDirectory() for f in found)

    def _check(self, rows: DataFrame, key: str | None) -> None:
        bad = batch_errors(rows, "embedding", self.dims, "video_id", key).limit(1).collect()
        if bad:
            raise ValueError("invalid batch: " + "; ".join(bad[0]["errors"]))

    def add(self, rows: DataFrame) -> None:
        """Append a batch whose vectors and keys are valid, or change nothing."""
        self._check(rows, None)
        state = self._state() or {"version": -1, "live": [], "replaced": None, "schema": rows.schema.json()}
        version = state["version"] + 1
        made = self._write(rows, version)
        self._swap(state | {"version": version, "live": state["live"] + [version] if made else state["live"]})

    def replace_video(self, video_id: str, rows: DataFrame) -> None:
        """Replace all rows of a video, or delete them with an empty batch; an invalid batch changes nothing."""
        self._check(rows, video_id)
        self.replace_videos(rows, self.spark.createDataFrame([(video_id,)], "video_id string"))

    def replace_videos(self, rows: DataFrame, keys: DataFrame) -> None:
        """Replace all rows of the videos in `keys` (video_id) by those of `rows`, which holds no others."""
        state = self._state()
        if state is None:
            return self.add(rows)
        version, name = state["version"] + 1, f"replaced/r{state['version'] + 1}"
        made = self._write(rows, version)
        gone = keys.select("video_id").distinct().withColumn("since", F.lit(version).cast("long"))
        since = self._replaced(state).unionByName(gone).groupBy("video_id").agg(F.max("since").alias("since"))
        since.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._swap(state | {"version": version, "live": state["live"] + [version] if made else state["live"], "replaced": name})

    def compact(self) -> None:
        """One version with the live rows alone; older folders may be deleted once their readers are done."""
        state = self._state()
        if state is not None:
            version = state["version"] + 1
            made = self._write(self.load(), version)
            self._swap(state | {"version": version, "live": [version] if made else [], "replaced": None})


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None if there is none, or not one file in it; any other failure is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_pending(rows: DataFrame, path: str) -> None:
    """Write only videos that the sink does not have yet (resume)."""
    there = existing(rows.sparkSession, path)
    if there is None:
        return overwrite_videos(rows, path)
    done = there.select(F.col("video_id").cast("string").alias("video_id"))
    return overwrite_videos(rows.join(pending_keys(rows, done, "video_id"), "video_id"), path)


def check_label_destination(path: str, roots: list[str]) -> Path:
    """Where evaluation labels may go: not in or above a pipeline folder, nor under an artifact's name; symbolic links are followed."""
    target = Path(path).resolve()
    for root in map(lambda r: Path(r).resolve(), roots):
        if target == root or root in target.parents or target in root.parents:
            raise ValueError("evaluation labels must stay outside pipeline folders")
    if ARTIFACTS & set(target.parts):
        raise ValueError("evaluation labels must not have an artifact's name")
    return target


def blank_sidecars(videos: DataFrame, existing: DataFrame) -> DataFrame:
    """Empty annotation rows for videos that have none."""
    return pending_keys(videos, existing, "video_id").withColumn("annotations", F.array().cast("array<string>"))
