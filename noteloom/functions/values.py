"""Numbers, durations, names of models, messages of errors and answers of models, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import once, strip

#: What messages of passing errors hold.
PASSING = ("file system operation timed out", "filesystem operation timed out", "operation timed out", "ebusy", "resource busy", "temporarily unavailable")
#: Fixed value: the fields of a lecture, which a model must give.
LECTURE = "title string, audience string, durationMinutes double, slides array<string>"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & ~F.abs(x).eqNullSafe(F.lit(float("inf")))


def clamp_integer(value: Column, least: int, most: int, otherwise: int) -> Column:
    """The floor of a number within limits; ``otherwise`` for none, NaN and infinity."""
    v = value.cast("double")
    return F.when(_finite(v), F.greatest(F.lit(least), F.least(F.lit(most), F.floor(v)))).otherwise(F.lit(otherwise)).cast("long")


def positive_integer(value: Column) -> Column:
    """The whole part of a number if it is above 0, else null."""
    v = value.cast("double")
    whole = F.when(_finite(v), F.floor(v))
    return F.when(whole > 0, whole.cast("long"))


def configured(value: Column, least: int, most: int, otherwise: int, zero: bool = False) -> Column:
    """A setting's whole part within limits; ``otherwise`` if it is none or not positive (with ``zero``: negative)."""
    v = value.cast("double")
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    good = _finite(v) & ((whole >= 0) if zero else (whole > 0))
    return F.when(good, F.greatest(F.lit(least), F.least(F.lit(most), whole))).otherwise(F.lit(otherwise)).cast("long")


def milliseconds(nanoseconds: Column) -> Column:
    v = nanoseconds.cast("double")
    return F.when(_finite(v), F.greatest(F.lit(0.0), v / 1_000_000))


def one_decimal(x: Column) -> Column:
    """A number from 0 on with one decimal, as C prints it: the exact binary value is rounded, ties go to the even digit. (Java's formatter rounds
    the shortest decimal that reads back as the number, half up.)"""

    def tenths(part: Column) -> Column:
        """0 to 10 of a fraction. Both halves of it can be multiplied by 20 without loss, and the sign of a sum of two doubles is right."""
        low = F.floor(part * 10)
        high = F.floor(part * (1 << 26)) / (1 << 26)
        return once(F.struct(low.alias("n"), ((high * 20 - (low * 2 + 1)) + (part - high) * 20).alias("over")), lambda s: s["n"] + F.when(s["over"] > 0, 1).when(s["over"] == 0, s["n"] % 2).otherwise(0))

    text = lambda s: F.concat((s["whole"] + F.when(s["n"] > 9, 1).otherwise(0)).cast("string"), F.lit("."), (s["n"] % 10).cast("string"))
    exact = once(x, lambda y: once(F.struct(F.floor(y).alias("whole"), tenths(y - F.floor(y)).alias("n")), text))
    return F.when(x < 1e15, exact).otherwise(F.format_string("%.1f", x))


def stage_duration(ms: Column) -> Column:
    """Seconds with one decimal; a dash where there is no number."""
    v = ms.cast("double")
    return F.when(_finite(v), F.concat(one_decimal(F.greatest(F.lit(0.0), v) / 1000), F.lit("s"))).otherwise("—")


def elapsed(ms: Column) -> Column:
    """mm:ss, or hh:mm:ss from one hour on."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    hours, rest = F.floor(s / 3600), F.concat(two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(hours > 0, F.concat(two(hours), F.lit(":"), rest)).otherwise(rest)


def is_passing_error(message: Column) -> Column:
    """Whether an error may go away when the operation is tried again."""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for part in PASSING:
        found = found | F.contains(low, F.lit(part))
    return found


def attempts(message: Column) -> Column:
    """How many attempts a failure took, as its message says: n of "(attempt n of m)", 1 if it says nothing."""
    n = F.regexp_extract(F.coalesce(message, F.lit("")), r"(?i)\(attempt\s+(\d+)\s+of\s+\d+\)", 1)
    return F.greatest(F.lit(1), F.coalesce(F.try_to_number(n, F.lit("999999999")).cast("int"), F.lit(1)))


def error_text(name: Column, message: Column) -> Column:
    """An error's name, unless it is the general one, and its message, or a sentence where there is none."""
    said = F.coalesce(F.nullif(strip(F.coalesce(message, F.lit(""))), F.lit("")), F.lit("The request failed."))
    kind = F.coalesce(name, F.lit(""))
    return F.concat(F.when((kind != "") & (kind != "Error"), F.concat(kind, F.lit(": "))).otherwise(""), said)


def failure_message(error: Column, partial: Column) -> Column:
    """What is kept of a failed turn: the error in a fence, which it cannot close, and the answer as far as it came."""
    safe = F.replace(error, F.lit("```"), F.lit("'''"))
    told = F.concat(F.lit("**The request failed.**\n\n```text\n"), safe, F.lit("\n```"))
    return F.concat(told, F.when(F.coalesce(partial, F.lit("")) != "", F.concat(F.lit("\n\n**The answer until then**\n\n"), partial)).otherwise(""))


def model_names_match(a: Column, b: Column) -> Column:
    """Whether two names mean one model; a name without a tag means the latest."""
    full = lambda x: F.when(F.contains(x, F.lit(":")), x).otherwise(F.concat(x, F.lit(":latest")))
    return full(a) == full(b)


def model_label(name: Column, size: Column, quantization: Column, capabilities: Column) -> Column:
    can = F.when(F.array_contains(capabilities, "embedding"), "embedding").when(F.array_contains(capabilities, "completion"), "generation")
    details = F.concat_ws(" · ", F.nullif(size, F.lit("")), F.nullif(quantization, F.lit("")), can)
    return F.when(details == "", name).otherwise(F.concat(name, F.lit(" — "), details))


def bare_json(answer: Column) -> Column:
    """A model's answer without the code fence around it."""
    t = strip(answer)
    t = F.regexp_replace(t, r"^```(?:json)?", "")
    return strip(F.regexp_replace(t, r"```\z", ""))


def lecture(answer: Column) -> Column:
    """struct(title, audience, durationMinutes, slides as JSON texts) of an answer; null if it is no JSON object or lacks a field or gives it another type."""
    parsed = F.try_parse_json(bare_json(answer))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    got = F.from_json(bare_json(answer), LECTURE, {"mode": "PERMISSIVE"})
    good = (kind("$.title") == "STRING") & (kind("$.audience") == "STRING") & kind("$.durationMinutes").rlike("^(?:BIGINT|DOUBLE|DECIMAL)") & kind("$.slides").startswith("ARRAY")
    return F.when(F.coalesce(good, F.lit(False)), got)


def source_type(kind: Column) -> Column:
    return F.when(kind == "pdf", "pdf").otherwise("markdown")


def is_duplicate_id_error(message: Column) -> Column:
    """Whether a write failed because an id was already there."""
    return F.coalesce(message, F.lit("")).rlike(r"(?i)\balready exists\b|\bduplicate\b.{0,20}\bid\b")
