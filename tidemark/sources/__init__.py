"""Sources: files and documents as DataFrames with explicit schemas."""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import safe_id
from tidemark.operators.memory import usable_vector

# Suffixes of raw videos, and of images in the order in which they are listed.
VIDEO_SUFFIXES = ["mp4", "mov", "mkv", "avi"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "webp", "pgm", "ppm"]

MEMORY_SCHEMA = (
    "memory_id bigint, video_id string, block_id string, time_range array<double>, speech_text string, visual_caption string, raw_transcript_segment_id bigint, source_type string, verification_status string, accepted_as_fact boolean,"
    " topics array<string>, unvalidated_topics array<string>, decisions array<string>, unvalidated_decisions array<string>, tasks array<string>, unvalidated_tasks array<string>, intent string, summary string, model_confidence_unvalidated double, searchable_text string, indexed_at timestamp"
)
MANIFEST_SCHEMA = (
    "schema_version int, dataset_id string, dataset_version string, purpose string, records array<struct<video_id:string,split:string,source_url:string,license_id:string,license_url:string,attribution:string,changes:string,"
    "source_duration_seconds:double,clip_interval_seconds:array<double>,timestamp_unit:string,timestamp_origin:string,size_bytes:bigint,sha256:string,verification_status:string,reference_annotations:array<struct<kind:string,role:string,source_url:string,license_id:string,license_url:string,attribution:string,sha256:string>>>>"
)
FRAME_MAP_SCHEMA = "map<string,struct<timestamp_sec:double,source_timestamp_sec:double,sampling:string>>"


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "suffix": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def raw_videos(spark: SparkSession, folder: str, video_id: str | None = None) -> DataFrame:
    """(video_id, path, suffix, length) of videos directly in a folder, by name; one exact id if given. The contents are not read.
    Raises if there is none, or if two files share a stem."""
    rows = _named(spark.read.format("binaryFile").load(folder).select("path", "length")).where(F.col("suffix").isin(VIDEO_SUFFIXES))
    rows = rows.select(F.col("stem").alias("video_id"), "path", "suffix", "length")
    rows = rows if video_id is None else rows.where(F.col("video_id") == video_id)
    if rows.isEmpty():
        raise FileNotFoundError("no raw video" + (f" {video_id}" if video_id else ""))
    if not rows.groupBy("video_id").count().where("count > 1").isEmpty():
        raise ValueError("two raw videos share a stem")
    return rows.orderBy("video_id")


def check_video_id(video_id: str) -> str:
    """The id, if it is a single safe path component."""
    if not video_id or video_id in (".", "..") or any(c in video_id for c in "/\\\0"):
        raise ValueError("video_id must be one safe path component")
    return video_id


def processed_videos(spark: SparkSession, table_path: str, video_id: str | None = None) -> DataFrame:
    """Ids of a table partitioned by video_id, from its partitions; a missing one is an error."""
    ids = spark.read.parquet(table_path).select(F.col("video_id").cast("string")).distinct().where(~F.col("video_id").startswith("."))
    ids = ids if video_id is None else ids.where(F.col("video_id") == check_video_id(video_id))
    if ids.isEmpty():
        raise FileNotFoundError("no processed video")
    return ids.orderBy("video_id")


def json_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """Whole-file JSON documents with a declared schema; a malformed one is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def frame_map(documents: DataFrame, json_col: str, prefix: str = "frames_fixed/", expected: int | None = None) -> DataFrame:
    """Frames of map documents (video_id, json text), those under a prefix, with their number in order of time; with `expected` a
    video of another count is an error on the executor."""
    from tidemark.operators.numbering import numbered

    rows = documents.select("video_id", F.explode(F.from_json(json_col, FRAME_MAP_SCHEMA)).alias("source_path", "f")).where(F.col("source_path").startswith(prefix)).select("video_id", "source_path", "f.*")
    rows = numbered(rows, "video_id", ["timestamp_sec", "source_path"])
    if expected is not None:
        n = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("__n"))
        bad = F.raise_error(F.concat(F.lit("frame count differs for "), F.col("video_id")))
        rows = rows.join(n, "video_id").where(F.when(F.col("__n") == expected, True).otherwise(bad.cast("boolean"))).drop("__n")
    return rows


def reference_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with header, byte-order mark allowed, a quote in a text doubled; missing or repeated columns and ragged rows are errors. Adds source_path."""
    head = spark.read.text(path).limit(1).collect()
    names = next(csv.reader([head[0][0].lstrip("﻿").rstrip("\r")])) if head else []
    if len(set(names)) != len(names) or not set(required) <= set(names):
        raise ValueError(f"a reference needs unique columns, with {sorted(required)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", multiLine=True, enforceSchema=False, quote='"', escape='"').withColumn("source_path", F.input_file_name())


def manifest_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a manifest document. Its version, texts and number of records are checked here, its records by contracts."""
    doc = json_documents(spark, path, MANIFEST_SCHEMA)
    top = doc.select("schema_version", "dataset_id", "dataset_version", "purpose", F.size("records").alias("n")).collect()
    if len(top) != 1 or top[0]["schema_version"] != 1 or any(not (top[0][k] or "").strip() for k in ("dataset_id", "dataset_version", "purpose")) or not 1 <= top[0]["n"] <= 10:
        raise ValueError("a manifest has version 1, its texts, and 1 to 10 records")
    return doc.select(F.explode("records").alias("r")).select("r.*")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, ordinal) of images, by extension group and then name."""
    from tidemark.operators.numbering import numbered

    rank = F.array_position(F.array(*[F.lit(s) for s in IMAGE_SUFFIXES]), F.col("suffix"))
    names = _named(spark.read.format("binaryFile").load(folder).select("path")).where(F.col("suffix").isin(IMAGE_SUFFIXES)).select("path", rank.alias("g"), "name", F.lit(0).alias("all"))
    order = numbered(names, "all", ["g", "name"], "ordinal").select("path", "ordinal")
    return spark.read.format("binaryFile").load(folder).select("path", "content").join(order, "path")


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, pixels) of JPEG, PNG, BMP and GIF images by Spark's image source; pixels are rows of blue, green,
    red (and alpha). What cannot be decoded has null sizes and pixels."""
    i = spark.read.format("image").load(folder).select("image.*")
    ok = F.col("height") > 0
    return i.select(F.col("origin").alias("path"), *[F.when(ok, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "pixels"))])


def legacy_memory(spark: SparkSession, path: str) -> DataFrame:
    """Memory rows of a metadata document from before the acceptance flags: no flag, so nothing in them is accepted. Their single
    confidence is model_confidence_unvalidated; memory_id is their place in the document."""
    schema = "video_id string, block_id string, time_range array<double>, speech_text string, visual_caption string, topics array<string>, decisions array<string>, tasks array<string>, intent string, summary string, confidence double, searchable_text string"
    fields = ",".join(c.replace(" ", ":") for c in schema.split(", "))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{fields}>>", {"mode": "FAILFAST"})).alias("memory_id", "r"))
    return rows.select(F.col("memory_id").cast("bigint").alias("memory_id"), "r.*").withColumnRenamed("confidence", "model_confidence_unvalidated").withColumns({"accepted_as_fact": F.lit(None).cast("boolean"), "verification_status": F.lit(None).cast("string")})


def file_hashes(spark: SparkSession, folder: str, block: int = 1 << 20) -> DataFrame:
    """(path, length, sha256) of files. Only paths are shuffled; each task reads its files in blocks, so their size does not matter. Empty
    files are left out, as Spark's reader lists none."""
    names = spark.read.format("binaryFile").load(folder).select("path", "length")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(sha256=[_sha256(p, block) for p in pdf["path"]])

    return names.mapInPandas(work, "path string, length long, sha256 string")


def _sha256(path: str, block: int) -> str:
    fs, inner = pyarrow.fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe="/:@"))
    digest = hashlib.sha256()
    with fs.open_input_stream(inner) as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()


def media_probes(spark: SparkSession, path: str, tolerance: float = 1e-6) -> DataFrame:
    """Probe results (JSON lines of a probing tool) as (video_id, kind, start_sec, duration_sec, origin_ok): a stream must start
    within a microsecond of zero."""
    rows = spark.read.schema("video_id string, streams array<struct<codec_type:string,start_time:string,duration:string>>").json(path)
    s = rows.select("video_id", F.explode("streams").alias("s")).select("video_id", F.col("s.codec_type").alias("kind"), F.col("s.start_time").try_cast("double").alias("start_sec"), F.col("s.duration").try_cast("double").alias("duration_sec"))
    return s.withColumn("origin_ok", F.coalesce(F.abs("start_sec") <= tolerance, F.lit(False)))


def memory_store(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """A store's rows; vectors and metadata are one table, so they cannot disagree. A vector of another dimension is an error."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if "accepted_as_fact" not in rows.columns:  # written before the flag existed: not accepted
        rows = rows.withColumn("accepted_as_fact", F.lit(None).cast("boolean"))
    return rows.where(F.when(usable_vector(F.col("embedding"), dims), True).otherwise(F.raise_error(F.lit("a stored vector has another dimension")).cast("boolean")))


def safe_ids(rows: DataFrame) -> DataFrame:
    return rows.where(safe_id(F.col("video_id")))
