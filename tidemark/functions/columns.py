"""Column builders: text, numbers, intervals, evidence guards, text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.intervals import finite

# --- text -------------------------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends (Spark's trim only removes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nonblank(c: Column) -> Column:
    """Holds something other than white space; false for null."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def numbered_id(prefix: str, n: Column, *more: Column) -> Column:
    """prefix_0007, or prefix_0007_0010: at least four digits, never cut."""
    return F.format_string(prefix + "_%04d" * (1 + len(more)), n, *more)


def without_fence(c: Column) -> Column:
    """A model's answer without its Markdown fence: of an answer that opens with a fence and has over two lines the first and last
    line go, and then a leading word json."""
    lines = F.split(c, "\n", -1)
    inner = F.when(c.startswith("```") & (F.size(lines) > 2), F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n")).otherwise(c)
    return strip(F.regexp_replace(strip(inner), r"^json", ""))


# --- numbers ------------------------------------------------------------------------------------------------------------------


def round6(c: Column) -> Column:
    return F.round(c, 6)


def even_position(i: Column, last: Column, count: Column) -> Column:
    """The i-th of `count` positions spread over 0..last, halves to the even neighbour."""
    return F.bround(i * last / (count - 1), 0).cast("int")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two float arrays, summed in double in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes of 64 digits."""
    word = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(1, 4)), F.bit_count(word(a, 0).bitwiseXOR(word(b, 0))))


# --- intervals ------------------------------------------------------------------------------------------------------------------


def overlaps_closed(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def overlaps_open(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def contains_closed(outer0: Column, outer1: Column, inner0: Column, inner1: Column) -> Column:
    return (outer0 <= inner0) & (outer1 >= inner1)


def within(t: Column, start: Column, end: Column, tolerance: float) -> Column:
    return (t >= start - tolerance) & (t <= end + tolerance)


def strictly_increasing(times: Column) -> Column:
    """Each element is greater than the one before it; true for fewer than two."""
    n = F.size(times)
    return F.forall(F.zip_with(F.slice(times, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b > a), lambda x: x)


# --- evidence guards: four rules that differ on purpose --------------------------------------------------------------------------

# The statuses of evidence.
ACCEPTED = "accepted_independent_evidence"
HYPOTHESIS = "unvalidated_model_hypothesis"
DERIVED = "unvalidated_derived_model_hypothesis"


def accepted_flag(flag: Column) -> Column:
    """Rollups: the flag alone."""
    return flag.eqNullSafe(True)


def accepted_fact(flag: Column, status: Column) -> Column:
    """Indexing: flag and status."""
    return flag.eqNullSafe(True) & status.eqNullSafe(ACCEPTED)


def card_status(status: Column, source_type: Column) -> Column:
    """Cards: a missing or empty status is a hypothesis where a model made the record, else unknown."""
    return F.when(F.length(status) > 0, status).otherwise(F.when(source_type == "model", HYPOTHESIS).otherwise("unvalidated_or_unknown"))


def card_range(time_range: Column, frame_sec: Column) -> Column:
    """Cards: the range, else the instant of the frame, else null."""
    return F.coalesce(time_range, F.when(frame_sec.isNotNull(), F.array(frame_sec, frame_sec)))


def policy_accepted(e: Column) -> Column:
    """Policy: flags, interval, claim, id, method, source and reviewer of an evidence struct all hold."""
    return F.size(evidence_errors(e)) == 0


# Acceptance methods and the source type that belongs to each.
METHODS = {"independent_human_review": "human_review", "independent_instrumented_measurement": "instrumented_measurement"}


def evidence_errors(e: Column) -> Column:
    """The names of the rules an evidence struct breaks, in their order."""
    p = e.acceptance_provenance
    rules = [
        ("not independently accepted", e.verification_status.eqNullSafe(ACCEPTED)),
        ("not accepted as fact", accepted_flag(e.accepted_as_fact)),
        ("bad interval", F.coalesce(finite(e.start_sec) & finite(e.end_sec) & (e.start_sec <= e.end_sec), F.lit(False))),
        ("no claim", nonblank(e.claim)),
        ("no evidence id", nonblank(e.evidence_id)),
        ("no acceptance provenance", p.isNotNull()),
        ("bad method", F.coalesce(p.method.isin(*METHODS), F.lit(False))),
        ("source does not match method", F.coalesce(e.source_type == F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])[p.method], F.lit(False))),
        ("no reviewer", nonblank(p.reviewer_or_system)),
        ("no source ids", F.coalesce((F.size(p.source_evidence_ids) > 0) & F.forall(p.source_evidence_ids, nonblank), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))


def first_error(rules: dict[str, Column]) -> Column:
    """The name of the first rule that does not hold, in their order; null if all do. A rule that is null does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])


# --- formats ----------------------------------------------------------------------------------------------------------------------

# Grammars of ids, digests and clock texts.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*\z"
SHA256 = r"^[0-9a-f]{64}\z"
CLOCK = r"^([0-9]{2,}):([0-5][0-9]):([0-5][0-9])(\.[0-9]{1,9})?\z"


def safe_id(c: Column) -> Column:
    """A single safe path component."""
    return F.coalesce(c.rlike(SAFE_ID) & ~c.contains(".."), F.lit(False))


def sha256_hex(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA256), F.lit(False))


def https_url(c: Column) -> Column:
    """HTTPS with a host and without credentials."""
    return F.coalesce((F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & (F.length(F.try_parse_url(c, F.lit("HOST"))) > 0) & F.try_parse_url(c, F.lit("USERINFO")).isNull(), F.lit(False))


def clock_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS[.fraction]; null for every other text."""
    part = lambda i: F.regexp_extract(c, CLOCK, i)
    fraction = F.when(part(4) == "", F.lit(0.0)).otherwise(F.concat(F.lit("0"), part(4)).cast("double"))
    return F.when(c.rlike(CLOCK), part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + fraction)
