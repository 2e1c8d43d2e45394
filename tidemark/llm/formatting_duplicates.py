"""Duplicates hidden by formatting differences (problem 6)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.skew import lookup
from tidemark.session import cut, table


def _strict(payload: str) -> dict | None:
    """The object of a strictly valid JSON text, else None. Of repeated keys the last counts; NaN and infinities are not JSON."""

    def refuse(_: str):
        raise ValueError

    try:
        got = json.loads(payload, parse_constant=refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def json_texts(payload: Column, fields: list[str]) -> Column:
    """The string fields of valid JSON objects; null for every other payload. Values that are no strings are null."""

    @F.pandas_udf("struct<" + ",".join(f"{f}:string" for f in fields) + ",valid:boolean>")
    def parse(s: pd.Series) -> pd.DataFrame:
        objects = [_strict(x) for x in s]
        text = lambda o, f: o[f].encode("utf-8", "replace").decode() if o is not None and isinstance(o.get(f), str) else None
        return pd.DataFrame({f: pd.Series([text(o, f) for o in objects], dtype=object) for f in fields} | {"valid": [o is not None for o in objects]})

    return parse(payload)


def bare(c: Column) -> Column:
    """The letters and digits of a text, lower-cased; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def collapse_formatting(raw: DataFrame, row_id: str, payload: str, fields: list[str]) -> DataFrame:
    """Rows (row_id, payload) of JSON objects, each with the id and size of its record: keep_id, copies.

    Two payloads are the same record when each of `fields`, reduced to its lower-cased letters and digits, is the same; missing, null
    and non-text values equal an empty text. Left out: null payloads, payloads that are no valid JSON object, and records without any
    letter or digit in `fields`. An empty table gives an empty result; other columns are ignored.

    Method: byte-identical payloads are collapsed first (counted on the map side), only the distinct survivors are parsed and
    canonicalised, and these are grouped by their full canonical texts, summing the counts. Ids are given back by two lookups that
    split hot keys: from distinct payload to record, then from row to distinct payload.
    """
    rows = raw.select(F.col(row_id).alias("id"), F.col(payload).alias("p")).where("p IS NOT NULL").withColumn("h", F.concat(F.unhex(F.md5(F.col("p").cast("binary"))), F.unhex(F.hex(F.xxhash64("p")))))
    distinct = rows.groupBy("h", "p").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    parsed = distinct.select("h", "first_id", "n", json_texts(F.col("p"), fields).alias("x")).where("x.valid").select("h", "first_id", "n", *[bare(F.col(f"x.{f}")).alias(f"c{i}") for i, f in enumerate(fields)])
    texts = [f"c{i}" for i in range(len(fields))]
    whole = F.concat_ws("\x00", *texts)  # bare texts have no such character
    survivors = cut(parsed.where(F.concat(*texts) != "").select("h", "first_id", "n", whole.alias("canon")))
    # one record per full canonical text; the variants of a record may be very many, so they are counted before they are looked up
    records = cut(survivors.groupBy("canon").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("w")))
    variants = survivors.count()
    known = lookup(survivors, records, "canon", "w", variants, "first_id").select("h", "n", "keep_id", "copies")
    return lookup(rows.select("id", "h"), known.withColumnRenamed("n", "w"), "h", "w", rows.count(), "id").select(F.col("id").alias(row_id), "keep_id", "copies")


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with the number of its copies in any formatting."""
    return _all(spark, folder).where("raw_id = keep_id").select("keep_id", "copies")


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_formatting(table(spark, folder, "memory_raw"), "raw_id", "payload", ["visual_caption", "speech_text"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).where("raw_id <> keep_id").select("keep_id", F.col("raw_id").alias("copy_id"))


QUERIES = {"p6_found": p6_found, "p6_records": p6_records}

_RECORDS = r"""
WITH v AS MATERIALIZED (SELECT raw_id, payload FROM memory_raw WHERE json_valid(payload) AND NOT regexp_matches(payload, ',\s*[}\]]')),  -- DuckDB takes trailing commas, JSON does not
o AS MATERIALIZED (SELECT * FROM v WHERE json_type(payload) = 'OBJECT'),
t AS (SELECT raw_id, CASE WHEN json_type(payload, '$.visual_caption') = 'VARCHAR' THEN payload ->> '$.visual_caption' END AS a, CASE WHEN json_type(payload, '$.speech_text') = 'VARCHAR' THEN payload ->> '$.speech_text' END AS b FROM o),
c AS (SELECT raw_id, coalesce(regexp_replace(lower(regexp_replace(a, '[^\p{L}\p{N}]+', '', 'g')), '[^\p{L}\p{N}]+', '', 'g'), '') AS a, coalesce(regexp_replace(lower(regexp_replace(b, '[^\p{L}\p{N}]+', '', 'g')), '[^\p{L}\p{N}]+', '', 'g'), '') AS b FROM t),
g AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY a, b) AS keep_id FROM c WHERE a <> '' OR b <> '')
"""

SQL = {
    "p6_found": _RECORDS + "SELECT keep_id, raw_id AS copy_id FROM g WHERE raw_id <> keep_id",
    "p6_records": _RECORDS + "SELECT keep_id, count(*) AS copies FROM g GROUP BY ALL",
}
