"""Frequency of every term and of every run of terms (problem 1), by suffix-sorted counting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shuffle_partitions, table, written

def _suffixes(sequences: Column, sigma: int) -> Column:
    """All suffixes of a record's sequences, cut to sigma terms, in order."""
    each = lambda s: F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.slice(s, i, sigma))
    return F.array_sort(F.flatten(F.transform(F.filter(sequences, lambda s: F.size(s) > 0), each)))


def _shared(a: Column, b: Column) -> Column:
    """Number of leading terms that two sequences share; 0 when there is no first one."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    both = F.least(F.size(a), F.size(b))  # beyond it the shorter one is padded with nulls, which equal null terms
    return F.when(a.isNull(), 0).otherwise(F.when(differs == 0, both).otherwise(F.least(both.cast("long"), differs - 1))).cast("int")


def _stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over suffixes in reverse lexicographic order: a stack holds the open prefixes with their counts; a prefix is emitted
    when the next suffix no longer has it, and its occurrences then count for the prefix below it."""
    field, open_, cf, df = None, [], [], []
    out: list[tuple] = []

    def pop(to: int) -> None:
        while len(open_) > to:
            out.append((field, list(open_), cf[-1], df[len(open_) - 1]))
            c = cf.pop()
            open_.pop()
            df.pop()
            if cf:
                cf[-1] += c

    for batch in batches:
        for f, terms, lcp, n in zip(batch["field"], batch["suffix"], batch["lcp"], batch["n"]):
            keep = 0
            if f == field:
                top = min(len(open_), len(terms))
                while keep < top and open_[keep] == terms[keep]:
                    keep += 1
            pop(keep)
            field = f
            for t in terms[keep:]:
                open_.append(t)
                cf.append(0)
                df.append(0)
            cf[-1] += n
            # Only prefixes longer than what the record's preceding suffix shares are new to the record. df is kept as a difference
            # list: what a suffix adds reaches from depth lcp to its end.
            for d in range(lcp, len(terms)):
                df[d] += n
        if len(out) > 50_000:
            yield _frame(out)
            out.clear()
    pop(0)
    yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"field": object, "terms": object, "occurrences": "int64", "records": "int64"}  # also of no rows
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=kind) for i, (name, kind) in enumerate(kinds.items())})


def _salts(summed: DataFrame, parts: int) -> DataFrame:
    """(field, head, salts) of first terms that have over half of a route's share of the summed suffixes, with as many routes as their
    share is worth; fewer than 2 * parts rows."""
    weights = summed.groupBy("field", F.get("suffix", 0).alias("head")).agg(F.count(F.lit(1)).alias("w"))
    total = weights.agg(F.sum("w")).first()[0] or 0
    return weights.where(F.col("w") * 2 * parts > total).select("field", "head", F.ceil(F.col("w") * 2 * parts / F.lit(max(1, total))).cast("int").alias("salts"))


def prefix_counts(df: DataFrame, field: str, sequences: str, sigma: int = 5, salts: int | None = None) -> DataFrame:
    """Count every run of up to `sigma` terms in `sequences` (array<array<string>>, one row per record and field).

    Output: field, terms (array<string>), occurrences (in the whole collection), records (rows that have the run at least once).
    Null or empty lists of sequences, and empty sequences, add nothing; null terms are terms of their own within a run. An empty table
    gives an empty result; extra columns are ignored.

    Method: suffix sigma. Each record emits its sequences' suffixes, cut to sigma terms, with the number of leading terms shared with
    the suffix before it in the record's own sorted list: a prefix is new to the record exactly when it is longer than that, so record
    sets travel as additive counts, never as sets. Equal suffixes are summed on the map side, routed by their first term,
    sorted in reverse lexicographic order and reduced with a stack, which gives the counts of all their prefixes. A first term may hold
    a third of all suffixes: each is spread over as many routes as its measured share is worth (or over `salts`, if given) by a hash of
    the suffix, and the few partial counts of a prefix that result are summed at the end.
    """
    base = df.select(F.col(field).alias("field"), _suffixes(F.col(sequences), sigma).alias("s"))
    each = base.select("field", "s", F.posexplode("s").alias("i", "suffix")).select("field", "suffix", _shared(F.get(F.col("s"), F.col("i") - 1), F.col("suffix")).alias("lcp"))
    summed = each.groupBy("field", "suffix", "lcp").agg(F.count(F.lit(1)).alias("n"))
    n = shuffle_partitions(df.sparkSession)
    if salts is None:
        summed = written(summed)
        spread = _salts(summed, n)
        routes = F.broadcast(spread.select(F.col("field").alias("__f"), F.col("head").alias("__h"), F.col("salts").alias("__salts")))
        summed = summed.join(routes, F.col("field").eqNullSafe(F.col("__f")) & F.get("suffix", 0).eqNullSafe(F.col("__h")), "left")
    else:
        summed = summed.withColumn("__salts", F.lit(salts))
    routed = summed.repartition(n, F.col("field"), F.get(F.col("suffix"), 0), F.pmod(F.xxhash64("suffix"), F.coalesce("__salts", F.lit(1)))).select("field", "suffix", "lcp", "n").sortWithinPartitions(F.col("field"), F.col("suffix").desc())
    partial = routed.mapInPandas(_stack, "field string, terms array<string>, occurrences long, records long")
    return partial.groupBy("field", "terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


#: Unicode white space, as a character class that both regular-expression dialects read alike.
SPACE = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normal_term(c: Column) -> Column:
    """Lower-cased, without white space at the ends, inner runs of it one blank; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), SPACE, " "), "^ | $", "")


def _fields(rows: DataFrame, sequences) -> DataFrame:
    """(field, sequences) of memory rows; `sequences` turns a row's normal values of a field, none of them null or empty, into sequences."""
    fields = [("topics", F.col("topics")), ("tasks", F.col("tasks")), ("intent", F.array("intent"))]

    def values(c: Column) -> Column:
        return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normal_term), lambda t: t.isNotNull() & (t != ""))

    each = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), values(c).alias("values")) for n, c in fields])).alias("x")).select("x.*")
    return each.where(F.size("values") > 0).select("field", sequences(F.col("values")).alias("sequences"))


def value_sequences(rows: DataFrame) -> DataFrame:
    """One sequence a row and field: its values in order, each value one term."""
    return _fields(rows, F.array)


def word_sequences(rows: DataFrame) -> DataFrame:
    """One sequence a value: its words."""
    return _fields(rows, lambda v: F.transform(v, lambda t: F.split(t, " ")))


#: Longest run of values that is counted.
SIGMA = 3


def term_frequencies(rows: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) of every distinct value, over all rows: the runs of one value among those of up to SIGMA."""
    counts = prefix_counts(value_sequences(rows), "field", "sequences", SIGMA)
    return counts.where(F.size("terms") == 1).select("field", F.get("terms", 0).alias("term"), "occurrences", "records")


RARE_ROWS = 2
COMMON_SHARE = 0.05


def p1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct term with its occurrences, its rows and its mark (null when it is neither rare nor common)."""
    rows = table(spark, folder, "memory_rows")
    total = rows.count()  # one number, from the files' footers
    mark = F.when(F.col("records") <= RARE_ROWS, "rare").when(F.col("records") > COMMON_SHARE * total, "common")
    return term_frequencies(rows).withColumn("mark", mark)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_frequencies(spark, folder).where("mark IS NOT NULL").select("field", "term", "mark")


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of up to three successive values of a row, each with its occurrences and rows."""
    counts = prefix_counts(value_sequences(table(spark, folder, "memory_rows")), "field", "sequences", SIGMA)
    return counts.select("field", F.array_join("terms", " / ").alias("run"), F.size("terms").alias("n"), "occurrences", "records")


def p1_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of up to three words inside the values, each with its occurrences and rows."""
    counts = prefix_counts(word_sequences(table(spark, folder, "memory_rows")), "field", "sequences", 3)
    return counts.select("field", F.array_join("terms", " ").alias("ngram"), F.size("terms").alias("n"), "occurrences", "records")


QUERIES = {"p1_found": p1_found, "p1_frequencies": p1_frequencies, "p1_runs": p1_runs, "p1_ngrams": p1_ngrams}

_TERMS = r"""
WITH v AS (SELECT memory_id, 'topics' AS field, unnest(topics) AS x FROM memory_rows UNION ALL SELECT memory_id, 'tasks', unnest(tasks) FROM memory_rows UNION ALL SELECT memory_id, 'intent', intent FROM memory_rows),
t AS (SELECT memory_id, field, regexp_replace(regexp_replace(lower(x), '[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS term FROM v WHERE x IS NOT NULL),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT memory_id) AS records FROM t WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM memory_rows) THEN 'common' END AS mark FROM c)
"""

SQL = {
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": _TERMS + "SELECT field, term, occurrences, records, mark FROM m",
    "p1_runs": r"""
WITH r AS (SELECT memory_id, 'topics' AS field, topics AS x FROM memory_rows UNION ALL SELECT memory_id, 'tasks', tasks FROM memory_rows UNION ALL SELECT memory_id, 'intent', [intent] FROM memory_rows),
v AS (SELECT memory_id, field, list_filter(list_transform(x, lambda t: regexp_replace(regexp_replace(lower(t), '[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')), lambda t: t IS NOT NULL AND t <> '') AS vs FROM r),
p AS (SELECT memory_id, field, vs, unnest(range(1, len(vs) + 1)) AS i FROM v),
g AS (SELECT memory_id, field, array_to_string(vs[i:i + k - 1], ' / ') AS run, k AS n FROM p, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(vs))
SELECT field, run, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT memory_id) AS records FROM g GROUP BY ALL""",
    "p1_ngrams": _TERMS
    + """, w AS (SELECT memory_id, field, string_split(term, ' ') AS ws FROM t WHERE term <> ''),
p AS (SELECT memory_id, field, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT memory_id, field, array_to_string(ws[i:i + k - 1], ' ') AS ngram, k AS n FROM p, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(ws))
SELECT field, ngram, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT memory_id) AS records FROM g GROUP BY ALL""",
}
