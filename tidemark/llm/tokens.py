"""Encoding a corpus with a public byte-level tokenizer (problem 7), by folding ranked merges over distinct pieces."""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.skew import lookup
from tidemark.session import cut, table, written

#: Default rank file: lines of base64 bytes and rank, the rank being the id.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges, with Unicode white space.
PATTERN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 8_192
#: The fold is quadratic in a piece's bytes; longer pieces are merged with a heap instead.
FOLD_BYTES = 160
#: So many pieces outside the vocabulary, the most frequent ones of up to PLAN_BYTES bytes, travel inside the plan, which bounds its size.
#: All others return by a lookup that splits hot keys, so a frequent long piece is no hot key either.
PLAN_PIECES = 20_000
PLAN_BYTES = 64


def read_ranks(path: str = RANKS) -> dict[str, int]:
    """Rank of each token; bytes are written as Latin-1 text."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f) if a}


def _literal(values: dict, kind: str) -> Column:
    """A constant lookup table: a list of small maps by the CRC of the key. Map lookup is a scan, so a map holds a few keys only."""
    rows: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in values.items():
        rows[zlib.crc32(k.encode("utf-8")) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=True)), f"array<map<string,{kind}>>")


def _look(table_: Column, key: Column) -> Column:
    return F.get(table_, F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int"))[key]


def _as_text(vocabulary: dict[str, int]) -> dict[str, int]:
    """The tokens that are whole characters, as text: a piece that is one of them needs no merge."""
    out = {}
    for t, rank in vocabulary.items():
        try:
            out[t.encode("latin-1").decode("utf-8")] = rank
        except UnicodeDecodeError:
            continue
    return out


def _bytes(piece: Column) -> Column:
    """UTF-8 bytes as Latin-1 text: one character a byte."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _merge_once(parts: Column, ranks: Column) -> Column:
    """Merge the leftmost pair of least rank; unchanged when no pair has a rank."""

    def merged(r: Column) -> Column:
        at = F.array_position(r, F.array_min(r)).cast("int")
        joined = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
        return F.when(F.array_min(r).isNull(), parts).otherwise(joined)

    pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: _look(ranks, F.concat(F.get(parts, i - 1), F.get(parts, i))))
    return F.when(F.size(parts) < 2, parts).otherwise(_let(pairs, merged))


def fold_merges(piece_bytes: Column, ranks: Column) -> Column:
    """Token ids of a piece given as Latin-1 text, by folding merges over its bytes."""
    parts = F.aggregate(F.sequence(F.lit(1), F.length(piece_bytes)), F.split(piece_bytes, ""), lambda acc, _: _merge_once(acc, ranks))
    return F.transform(parts, lambda p: _look(ranks, p))


def heap_merges(piece: str, ranks: dict[str, int]) -> list[int]:
    """The same merges for long pieces: linked parts and a heap of pairs, n log n."""
    parts, nxt, prev = list(piece), list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    heap = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    heapq.heapify(heap)
    alive = [True] * len(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else len(parts)
        if not alive[i] or j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[i] < len(parts):
            prev[nxt[i]] = i
            if (p := parts[i] + parts[nxt[i]]) in ranks:
                heapq.heappush(heap, (ranks[p], i, parts[i], parts[nxt[i]]))
        if prev[i] >= 0 and (p := parts[prev[i]] + parts[i]) in ranks:
            heapq.heappush(heap, (ranks[p], prev[i], parts[prev[i]], parts[i]))
    return [ranks[p] for p, ok in zip(parts, alive) if ok]


def encode_corpus(docs: DataFrame, doc_id: str, text: str, path: str = RANKS) -> DataFrame:
    """(doc_id, ids): the token ids of each document's text, without special tokens, whose strings are ordinary text.

    Every row of `docs` gives one row, repeated ones too. Null and empty texts give an empty list; a null id stays. An empty table
    gives an empty result; other columns are ignored.

    Method: a text is split into pieces by the tokenizer's pattern. A piece that is a token is its id, by a constant rank map. The
    others are made distinct over the corpus (counted on the map side) and each is encoded once by a fold that merges the pair of
    least rank over its byte array; pieces longer than FOLD_BYTES are merged with a heap, as the fold is quadratic. The PLAN_PIECES
    most frequent short ones return to the texts inside the plan, as a second constant map; the rest by a join that splits hot keys.
    """
    vocabulary = read_ranks(path)
    whole_text = _literal(_as_text(vocabulary), "int")
    pieces = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")).alias("p"))
    # Every piece is looked up once here; written, so that the constant map stands in one plan only.
    gap = F.filter(F.transform("p", lambda v, i: F.struct(i.alias("i"), F.when(F.get("x", i).isNull(), v).alias("piece"))), lambda s: s.piece.isNotNull())
    known = written(pieces.select("id", "h", "p", F.transform("p", lambda v: _look(whole_text, v)).alias("x")).select("id", "h", "x", F.when(F.exists("x", lambda v: v.isNull()), gap).alias("g")))
    unknown = known.where("g IS NOT NULL").select(F.explode("g.piece").alias("piece"))
    counts = cut(unknown.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).select("piece", "n", _bytes(F.col("piece")).alias("b")))

    @F.pandas_udf("array<int>")
    def long_ids(s: pd.Series) -> pd.Series:
        ranks = shared.value
        return s.map(lambda b: heap_merges(b, ranks))

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's fixed size
    short = counts.where(F.length("b") <= FOLD_BYTES).select("piece", "n", fold_merges(F.col("b"), _literal(vocabulary, "int")).alias("ids"))
    long = counts.where(F.length("b") > FOLD_BYTES).select("piece", "n", long_ids("b").alias("ids"))
    coded = cut(short.unionByName(long))
    frequent = coded.where(F.octet_length("piece") <= PLAN_BYTES).orderBy(F.desc("n"), "piece").limit(PLAN_PIECES).select("piece", "ids").collect()
    hot = _literal({r[0]: list(r[1]) for r in frequent}, "array<int>")

    whole = known.where("g IS NULL").select(F.col("id").alias(doc_id), F.col("x").alias("ids"))
    part = written(known.where("g IS NOT NULL").select("id", "h", "x", F.transform("g", lambda s: F.struct(s.i.alias("i"), _look(hot, s.piece).alias("ids"), s.piece.alias("piece"))).alias("y")))
    present = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), F.array(v).alias("ids"), v.isNull().alias("gap"))), lambda s: ~s.gap)
    present = F.transform(present, lambda s: F.struct(s.i.alias("i"), s.ids.alias("ids")))
    filled = F.transform(F.filter("y", lambda s: s.ids.isNotNull()), lambda s: F.struct(s.i.alias("i"), s.ids.alias("ids")))
    in_order = lambda *parts: F.flatten(F.transform(F.array_sort(F.concat(*parts)), lambda s: s.ids))
    open_ = F.exists("y", lambda s: s.ids.isNull())
    ready = part.where(~open_).select(F.col("id").alias(doc_id), in_order(present, filled).alias("ids"))
    rare = part.where(open_).select("id", "h", F.explode(F.filter("y", lambda s: s.ids.isNull())).alias("s")).select("id", "h", "s.i", "s.piece", F.pmod(F.xxhash64("id", "h", "s.i"), F.lit(1 << 40)).alias("at"))
    total = coded.agg(F.sum("n")).first()[0] or 0
    got = lookup(rare, coded.select("piece", "n", "ids"), "piece", "n", total, "at").groupBy("id", "h").agg(F.collect_set(F.struct("i", "ids")).alias("c"))
    joined = part.where(open_).join(got.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "c"), F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")))
    return whole.unionByName(ready).unionByName(joined.select(F.col("id").alias(doc_id), in_order(present, filled, F.col("c")).alias("ids")))


def decode_ids(ids: Column, path: str = RANKS) -> Column:
    """The text of a list of ids: binary pieces, concatenated. An id without a token gives null."""
    tokens = [base64.b64encode(t.encode("latin-1")).decode() for t, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
    pieces = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    whole = F.aggregate(ids, F.lit("").cast("binary"), lambda acc, i: F.concat(acc, F.unbase64(F.get(pieces, i))))
    return F.decode(whole, "UTF-8")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
