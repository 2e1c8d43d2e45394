"""Evaluation texts leaking into training text (problem 8), by template windows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import words
from tidemark.session import cut, shuffle_partitions, table, written

WINDOW = 12
#: Item windows are broadcast up to this many rows (about 40 bytes each); beyond it the join is shuffled.
BROADCAST_WINDOWS = 200_000

# Words that name a unit.
UNITS = "second seconds sec minute minutes min hour hours ms frame frames gram grams g kg mg cm mm m km ml cl l litre litres percent degree degrees celsius fps".split()

#: A document's window is only cut out where its first words (LEAD of them, or all of a shorter window) begin some window of an item.
LEAD = 5
#: Those starts travel in the plan as a bitmap of 512 bits a start and at most this many bits in all (3 MB of text); the fuller it is,
#: the more windows are cut out for nothing. It changes no result.
LEAD_BITS = 1 << 23
#: Names travel in the plan up to this many words; more of them are looked up by a join.
PLAN_NAMES = 20_000
#: A template is hot when more than one in HOT_SHARE of the documents' windows have it.
HOT_SHARE = 256


def _template(w: Column, named) -> Column:
    """The list of words with numbers, units and names as typed placeholders (which no word can equal)."""

    def one(x: Column) -> Column:
        out = F.when(x.rlike(r"^\p{N}+$"), "<num>").when(x.isin(UNITS), "<unit>")
        return out.when(named(x), "<name>").otherwise(x)

    return F.transform(w, one)


def _templated(df: DataFrame, row_id: str, text: str, names: DataFrame | list[str]) -> DataFrame:
    """(row_id, t, v): the template of each text and, beside it, the word in each slot (null elsewhere). Names are a list of words, or a
    table with a column `word` whose words meet those of the texts by a join."""
    base = df.select(row_id, words(F.col(text)).alias("w"))
    if isinstance(names, DataFrame):
        base = base.withColumn("__h", F.xxhash64("w"))
        said = base.select(row_id, "__h", F.explode(F.array_distinct("w")).alias("word")).distinct()
        own = said.join(names.select("word").distinct(), "word").groupBy(F.col(row_id).alias("__id"), F.col("__h").alias("__oh")).agg(F.collect_set("word").alias("__own"))
        base = base.join(own, F.col(row_id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__oh")), "left")
        named = lambda x: F.array_contains(F.coalesce(F.col("__own"), F.array().cast("array<string>")), x)
    else:
        named = lambda x: x.isin(names) if names else F.lit(False)
    rows = base.select(row_id, "w", _template(F.col("w"), named).alias("t"))
    return rows.select(row_id, "t", F.zip_with("w", "t", lambda a, b: F.when(a != b, a)).alias("v"))


def _lead(i: Column, n: int) -> Column:
    """Hash of the n template words from position i (from 1)."""
    return F.xxhash64(*[F.get("t", i + (j - 1)) for j in range(n)])


def _cut_out(at: Column, n: Column) -> Column:
    """Windows of n words from the given positions: a hash of the template, one of the template with the pattern of equal words in its
    slots, and these words. Slots are one replacement of others, word for word and both ways, only if their patterns are equal."""

    def one(i: Column) -> Column:
        t, slots = F.slice("t", i, n), F.array_compact(F.slice("v", i, n))
        pattern = F.transform(slots, lambda x: F.array_position(slots, x))
        return F.struct(n.cast("int").alias("n"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), pattern, t).alias("h2"), slots.alias("slots"))

    return F.transform(at, one)


_NOWHERE = "array<int>"


def item_windows(items: DataFrame, row_id: str, text: str, names: DataFrame | list[str]) -> DataFrame:
    """(row_id, n, h1, h2, slots, lead) of every passage of an item: runs of WINDOW words, or all words of a shorter item; none of a
    text without words. `lead` is the hash of the passage's first words, at most LEAD of them."""
    size = F.size("t")
    n = F.least(size, F.lit(WINDOW))
    spots = F.sequence(F.lit(1), size - n + 1)
    lead = lambda i: F.coalesce(*[F.when(n == k, _lead(i, k)) for k in range(1, LEAD)], _lead(i, LEAD))
    rows = _templated(items, row_id, text, names).where(size > 0).select(row_id, F.explode(F.arrays_zip(_cut_out(spots, n).alias("x"), F.transform(spots, lead).alias("lead"))).alias("y"))
    return rows.select(row_id, "y.x.*", "y.lead")


def lead_bitmap(leads: DataFrame) -> tuple[int, Column]:
    """(bits, array of longs) of the column `lead`: the bit of each one's hash is set. The collected rows are at most LEAD_BITS / 64."""
    leads = leads.select("lead").distinct()
    bits = min(LEAD_BITS, max(1 << 12, 1 << (512 * leads.count()).bit_length()))
    at = F.pmod(F.col("lead"), F.lit(bits))
    rows = leads.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(lead, {bits}) % 64 as int))")).alias("x")).collect()
    longs = [0] * (bits >> 6)
    for r in rows:
        longs[r.word] = r.x
    return bits, F.from_json(F.lit(json.dumps(longs)), "array<bigint>")


def _marked(bitmap: tuple[int, Column], h: Column) -> Column:
    bits, longs = bitmap
    at = F.pmod(h, F.lit(bits))
    return F.getbit(F.get(longs, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1


def document_windows(docs: DataFrame, row_id: str, text: str, bitmaps: dict[int, tuple[int, Column]], lengths: list[int], names: DataFrame | list[str]) -> DataFrame:
    """(row_id, n, h1, h2, slots) of runs of n successive words for each n of `lengths` that start like an item's (`bitmaps`, by the
    length of the start). Texts with fewer words than a length have no window of it."""
    size = F.size("t")

    def everywhere(k: int) -> Column:
        return F.when(size >= k, F.sequence(F.lit(1), size - (k - 1))).otherwise(F.array().cast(_NOWHERE))

    def hashes(k: int) -> Column:  # a column of its own, so that each start is hashed once
        return F.transform(everywhere(k), lambda i: _lead(i, k)).alias(f"h{k}")

    def starts(k: int) -> Column:
        return F.filter(everywhere(k), lambda i: _marked(bitmaps[k], F.get(f"h{k}", i - 1))).alias(f"at{k}")

    def starting(n: int) -> Column:
        return F.filter(f"at{min(LEAD, n)}", lambda i: i <= size - (n - 1))

    found = _templated(docs, row_id, text, names).select(row_id, "t", "v", *map(hashes, bitmaps)).select(row_id, "t", "v", *map(starts, bitmaps))
    per_length = [_cut_out(starting(n), F.lit(n)) for n in lengths]
    return found.select(row_id, F.explode(F.concat(*per_length)).alias("x")).select(row_id, "x.*")


def _consistent(a: Column, b: Column) -> Column:
    """Whether replacing each slot word of a by that of b is one replacement per word, both ways."""
    pairs = F.size(F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b"))))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def _met(windows: DataFrame, made: DataFrame, doc_id: str) -> DataFrame:
    """Windows of documents with the items' windows of equal template and pattern. Few item windows are broadcast. Of many, those of hot
    templates (fewer than HOT_SHARE) are repeated over parts into which the documents' windows are split, by measured weight."""
    keys = ["n", "h1", "h2"]
    if made.count() <= BROADCAST_WINDOWS:
        return windows.join(F.broadcast(made), keys)
    windows = written(windows)
    weights = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__w"))
    total = weights.agg(F.sum("__w")).first()[0] or 0
    parts = shuffle_partitions(made.sparkSession)
    hot = weights.where(F.col("__w") * HOT_SHARE > total).select(*keys, F.ceil(F.col("__w") * parts / F.lit(max(1, total))).cast("int").alias("__parts"))
    split = lambda df: df.join(F.broadcast(hot), keys, "left")  # noqa: E731  fewer than HOT_SHARE rows
    part = F.coalesce(F.pmod(F.xxhash64(doc_id, "slots"), F.col("__parts")), F.lit(0)).cast("int")
    left = split(windows).withColumn("__part", part).drop("__parts")
    right = split(made).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"])


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, names: DataFrame | list[str]) -> DataFrame:
    """(doc_id, item_id, kind, windows) of every document that has a passage of an item.

    A passage is a run of 12 words of the item, or all words of a shorter item. kind 'exact': the document has the same words;
    'reparameterised': it has the template with other numbers, names or units, each always replaced by the same other one. `windows`
    counts the distinct passages of that kind. Null, empty and wordless texts have no passages. Repeated rows and shared wording count
    once per pair of ids. Empty tables give an empty result; other columns are ignored. Names are the words in `names` (a list, or a
    table with a column `word`) and no others, units those in UNITS; each word is a slot, so another number of words in a slot (12.5
    for 12, a full name for a given one) is another template and is not found as re-parameterised.

    Method: both sides become typed templates; documents emit a hash per window beside the words in its slots (no text travels),
    which meets the items' windows by a hash join. Only places whose first words start some item window are cut out, which changes no
    result. The pattern of equal words among the slots is in the hash, so that what meets is consistent; equal slots are an exact copy.
    """
    made = item_windows(items, item_id, item_text, names).select(F.col(item_id).alias("__item"), "n", "h1", "h2", F.col("slots").alias("want"), "lead")
    made = cut(made.distinct())
    lengths = sorted(r[0] for r in made.select("n").distinct().collect())  # at most WINDOW numbers
    if not lengths:
        return made.select(F.lit(None).cast(docs.schema[doc_id].dataType).alias(doc_id), F.col("__item").alias(item_id), F.lit("").alias("kind"), F.lit(0).cast("long").alias("windows"))
    bitmaps = {k: lead_bitmap(made.where(F.least(F.col("n"), F.lit(LEAD)) == k)) for k in sorted({min(LEAD, n) for n in lengths})}
    windows = document_windows(docs, doc_id, doc_text, bitmaps, lengths, names)
    met = _met(windows, made.drop("lead").distinct(), doc_id)
    kind = F.when(F.col("slots") == F.col("want"), "exact").when((F.size("slots") == F.size("want")) & _consistent(F.col("want"), F.col("slots")), "reparameterised")
    return met.select(doc_id, F.col("__item").alias(item_id), "h1", kind.alias("kind")).where("kind IS NOT NULL").distinct().groupBy(doc_id, item_id, "kind").agg(F.count(F.lit(1)).alias("windows"))


def roster_names(spark: SparkSession, folder: str) -> DataFrame | list[str]:
    """All words of known people's names, lower-cased: in order, or as a table where they are more than PLAN_NAMES."""
    r = table(spark, folder, "roster")
    found = r.select(F.explode(words(F.concat_ws(" ", "given_name", "family_name"))).alias("word")).distinct()
    return sorted(x[0] for x in found.collect()) if found.count() <= PLAN_NAMES else found


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items leaked into them, word for word or with other numbers, names and units."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text", roster_names(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).where("kind = 'exact'").select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}

SQL = {
    "p8_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, array_to_string(w[p:p + least(12, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + n - 1], ' ') AS s, n FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s, n)
""",
    "p8_leaks": r"""
WITH nm AS (SELECT list(DISTINCT lower(x)) AS names FROM (SELECT unnest(regexp_extract_all(concat_ws(' ', given_name, family_name), '[\p{L}\p{N}]+')) AS x FROM roster)),
a AS (SELECT doc_id AS id, true AS doc, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT item_id, false, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) FROM eval_items WHERE text IS NOT NULL),
t AS (SELECT id, doc, w, list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '\p{N}+') THEN '<num>' WHEN list_contains(['UNITS'], x) THEN '<unit>' WHEN list_contains(names, x) THEN '<name>' ELSE x END) AS t FROM a, nm),
u AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] <> t[i] THEN w[i] END) AS v FROM t),
iw AS (SELECT DISTINCT id AS item_id, least(12, len(w)) AS n, array_to_string(t[p:p + least(12, len(w)) - 1], ' ') AS s, list_filter(v[p:p + least(12, len(w)) - 1], lambda x: x IS NOT NULL) AS want
       FROM (SELECT *, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS p FROM u WHERE NOT doc AND len(w) > 0)),
dw AS (SELECT DISTINCT id AS doc_id, n, array_to_string(t[p:p + n - 1], ' ') AS s, list_filter(v[p:p + n - 1], lambda x: x IS NOT NULL) AS slots
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM u, (SELECT DISTINCT n FROM iw) WHERE doc AND len(w) >= n)),
j AS (SELECT doc_id, item_id, n, s, CASE WHEN slots = want THEN 'exact' WHEN len(list_distinct(list_zip(want, slots))) = len(list_distinct(want)) AND len(list_distinct(want)) = len(list_distinct(slots)) THEN 'reparameterised' END AS kind FROM dw JOIN iw USING (n, s))
SELECT doc_id, item_id, kind, count(DISTINCT (n, s)) AS windows FROM j WHERE kind IS NOT NULL GROUP BY ALL
""".replace("UNITS", "', '".join(UNITS)),
}
