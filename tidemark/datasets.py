"""Manifests of source videos from the command line: what they say, what is there, a verified copy, evaluation references.

    python -m tidemark.datasets validate --manifest m.json
    python -m tidemark.datasets verify --manifest m.json --video P01 --source clip.mp4
    python -m tidemark.datasets prepare --manifest m.json --video P01 --source clip.mp4 --raw-dir raw --output-manifest new.json --acknowledge-license
    python -m tidemark.datasets references --manifest m.json --video P01 --kind action --csv refs.csv --output labels.json
"""

from __future__ import annotations

import argparse
import copy
import hashlib
import json
import os
import shutil
import subprocess
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.config import load_config
from tidemark.operators import contracts as C
from tidemark.operators.provenance import reference_of_kind
from tidemark.sources import VIDEO_SUFFIXES, manifest_records, reference_csv
from tidemark.sources.sinks import check_label_destination, write_new_json

# Columns of the evaluation references of each kind: id, label.
REFERENCE_COLUMNS = {"action": ("narration_id", "narration"), "sound": ("annotation_id", "class")}


def probed_seconds(path: Path) -> float:
    """A file's duration by a probing tool."""
    out = subprocess.run(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", str(path)], capture_output=True, text=True, check=True, timeout=60)
    return float(out.stdout.strip())


def file_digest(path: Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def checked_manifest(spark: SparkSession, path: str):
    """The records of a manifest without a broken rule."""
    records = manifest_records(spark, path)
    bad = C.manifest_violations(records).where(F.size("violations") > 0).select("video_id", "violations").limit(1).collect()
    if bad:
        raise ValueError(f"manifest record {bad[0][0]!r}: {', '.join(bad[0][1])}")
    return records


def selected(records, video_id: str) -> dict:
    got = records.where(F.col("video_id") == video_id).limit(1).collect()
    if not got:
        raise ValueError(f"video {video_id!r} is not in the manifest")
    return got[0].asDict(recursive=True)


def verify_source(record: dict, source: Path, checksum: bool = True, seconds: Callable[[Path], float] = probed_seconds) -> dict:
    """Size, digest and duration of a file, against what its record declares."""
    seen = {"size_bytes": source.stat().st_size, "sha256": file_digest(source), "duration_seconds": seconds(source)}
    if record["size_bytes"] is not None and record["size_bytes"] != seen["size_bytes"]:
        raise ValueError("size differs from the manifest")
    if (checksum or record["sha256"] is not None) and record["sha256"] != seen["sha256"]:
        raise ValueError("digest differs from the manifest")
    if abs(record["source_duration_seconds"] - seen["duration_seconds"]) > 0.001:
        raise ValueError("duration differs from the manifest")
    return seen


def prepare_local(manifest: dict, record: dict, source: Path, raw_dir: Path, acknowledged: bool, seconds: Callable[[Path], float] = probed_seconds) -> tuple[dict, Path, dict]:
    """A verified exclusive copy of a whole source video: (manifest with the record verified, its place, what was seen). The copy is
    staged beside its place and checked, then linked: it is whole or absent, and nothing is replaced."""
    if not acknowledged:
        raise ValueError("read the license and acknowledge it")
    if record["clip_interval_seconds"] != [0, record["source_duration_seconds"]]:
        raise ValueError("only whole videos are prepared")
    source = source.expanduser().resolve()
    if source.suffix.lower().lstrip(".") not in VIDEO_SUFFIXES:
        raise ValueError("not a video file")
    seen = verify_source(record, source, checksum=False, seconds=seconds)
    raw_dir.mkdir(parents=True, exist_ok=True)
    place = raw_dir.resolve() / f"{record['video_id']}{source.suffix.upper()}"
    if any(p.stem == record["video_id"] and p.resolve() != place for p in raw_dir.iterdir()):
        raise ValueError("another file of this video is there")
    if source != place:
        draft = raw_dir / f".staged-{uuid.uuid4().hex}"
        try:
            shutil.copyfile(source, draft)
            if file_digest(draft) != seen["sha256"]:
                raise ValueError("the copy differs")
            os.link(draft, place)
        finally:
            draft.unlink(missing_ok=True)
    updated = copy.deepcopy(manifest)
    for r in updated["records"]:
        if r["video_id"] == record["video_id"]:
            r.update(sha256=seen["sha256"], size_bytes=seen["size_bytes"], verification_status="verified", changes="None; original media bytes retained.")
    return updated, place, seen


def references(spark: SparkSession, csv_path: str, record: dict, kind: str) -> dict:
    """The annotations of one kind for a record, clipped to it; one broken row refuses them all."""
    one = spark.createDataFrame([record], C_RECORD)
    if one.select(reference_of_kind(F.col("reference_annotations"), F.lit(kind)).isNotNull()).first()[0] is not True:
        raise ValueError(f"the record declares no {kind} references")
    name, label = REFERENCE_COLUMNS[kind]
    rows = reference_csv(spark, csv_path, [name, "video_id", "start_timestamp", "stop_timestamp", label]).where(F.col("video_id") == record["video_id"])
    given = rows.select("video_id", F.col(name).alias("annotation_id"), F.col("start_timestamp").alias("start_text"), F.col("stop_timestamp").alias("stop_text"), F.col(label).alias("label"))
    clipped, rejected = C.clip_references(given, one)
    bad = rejected.limit(1).collect()
    if bad:
        raise ValueError(f"reference {bad[0]['annotation_id']!r}: {', '.join(bad[0]['violations'])}")
    return {"role": "evaluation_only", "video_id": record["video_id"], "kind": kind, "annotations": [r.asDict() for r in clipped.orderBy("source_start", "annotation_id").collect()]}


C_RECORD = "video_id string, clip_interval_seconds array<double>, source_duration_seconds double, reference_annotations array<struct<kind:string>>"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, seconds: Callable[[Path], float] = probed_seconds) -> int:
    """0, or 2 with a message when something is wrong."""
    p = argparse.ArgumentParser(prog="tidemark.datasets")
    sub = p.add_subparsers(dest="do", required=True)
    for name in ("validate", "verify", "prepare", "references"):
        s = sub.add_parser(name)
        s.add_argument("--manifest", required=True)
        if name != "validate":
            s.add_argument("--video", required=True)
        if name in ("verify", "prepare"):
            s.add_argument("--source", required=True)
        if name == "prepare":
            s.add_argument("--raw-dir")
            s.add_argument("--output-manifest", required=True)
            s.add_argument("--acknowledge-license", action="store_true")
        if name == "references":
            s.add_argument("--kind", choices=tuple(REFERENCE_COLUMNS), required=True)
            s.add_argument("--csv", required=True)
            s.add_argument("--output", required=True)
    a = p.parse_args(argv)
    if spark is None:
        from tidemark.session import local_session

        spark = local_session()
    try:
        records = checked_manifest(spark, a.manifest)
        if a.do == "validate":
            out = {"metadata_valid": True, "records": records.count(), "local_bytes_checked": False}
        elif a.do == "verify":
            out = verify_source(selected(records, a.video), Path(a.source), seconds=seconds)
        elif a.do == "prepare":
            if Path(a.output_manifest).exists():
                raise ValueError("the output manifest exists")
            manifest = json.loads(Path(a.manifest).read_text(encoding="utf-8"))
            raw = Path(a.raw_dir or load_config()["paths.raw_dir"])
            updated, place, seen = prepare_local(manifest, selected(records, a.video), Path(a.source), raw, a.acknowledge_license, seconds)
            write_new_json(a.output_manifest, updated)
            out = {"prepared": str(place), "manifest": a.output_manifest, **seen}
        else:
            paths = load_config()["paths"]
            target = check_label_destination(a.output, list(paths.values()))
            record = {k: v for k, v in selected(records, a.video).items() if k in ("video_id", "clip_interval_seconds", "source_duration_seconds", "reference_annotations")}
            record["reference_annotations"] = [{"kind": r["kind"]} for r in record["reference_annotations"] or []]
            data = references(spark, a.csv, record, a.kind)
            write_new_json(str(target), data)
            out = {"output": str(target), "role": data["role"], "annotations": len(data["annotations"])}
    except (ValueError, OSError, subprocess.SubprocessError, KeyError, TypeError) as e:
        print(f"dataset error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
