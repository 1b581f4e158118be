"""Numbers inside text, thresholds, and statistic reading rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimgrid.functions.text import col
from claimgrid.rules import values as V


def number(c) -> Column:
    """Text to double; null when it is not a finite number."""
    v = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def integer(c) -> Column:
    """Text to long with thousands commas dropped; a decimal point is not dropped."""
    return F.trim(F.replace(col(c), F.lit(","), F.lit(""))).try_cast("long")


def p_significant(c) -> Column:
    t = F.trim(col(c))
    return F.coalesce(
        F.when((F.length(t) == 0) | (F.upper(t) == "NA"), False).when(t.startswith("<"), True).otherwise(number(t) < 0.05),
        F.lit(False),
    )


def first_number(c) -> Column:
    return F.regexp_extract(col(c), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def percent_in_parens(c) -> Column:
    return F.regexp_extract(col(c), r"\(([-\d.]+)%\)", 1).try_cast("double")


def level_score(c) -> Column:
    low = F.lower(F.trim(col(c)))
    return (
        F.when((F.length(low) == 0) | (low == "na"), F.lit(None).cast("double"))
        .when(low.isin("no", "否"), 0.0)
        .when(low.isin("yes", "是"), 1.0)
        .when(low.startswith(">="), number(F.regexp_replace(low, "^>=", "")))
        .when(low.startswith(">"), number(F.regexp_replace(low, "^>", "")))
        .otherwise(number(low))
    )


def level_affirmative(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin(V.AFFIRMATIVE_LEVELS), F.lit(False))


MOST = 10**18 - 1  # numbers of more than 18 digits stand at this value, behind every list


def whole(digits: Column) -> Column:
    """Digits of any length to long, at most MOST; null for empty text."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) > 18, F.lit(MOST)).otherwise(F.nullif(short, F.lit("")).try_cast("long"))


def ref_ranges(c) -> Column:
    """'1-5,7' -> [(1, 5), (7, 7)], as structs of lo and hi; parts that are no numbers are dropped, also reversed ranges.
    A range is one entry, however long it is."""
    parts = F.filter(F.split(F.regexp_replace(col(c), r"\s*-\s*", "-"), r"[,，\s]+"), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    ends = F.transform(parts, lambda p: F.struct(whole(F.split(p, "-")[0]).alias("lo"), whole(F.element_at(F.split(p, "-"), -1)).alias("hi")))
    return F.filter(ends, lambda r: r["lo"] <= r["hi"])


def range_size(ranges: Column) -> Column:
    """How many numbers the ranges hold together."""
    return F.aggregate(ranges, F.lit(0).cast("decimal(38,0)"), lambda a, r: (a + r["hi"] - r["lo"] + 1).cast("decimal(38,0)"))


def range_total(ranges: Column) -> Column:
    """Sum of all numbers in the ranges."""
    def one(r: Column) -> Column:
        ends, n = r["lo"] + r["hi"], r["hi"] - r["lo"] + 1  # one of the two is even
        wide = lambda x: x.cast("decimal(19,0)")
        return F.when(n % 2 == 0, wide(ends) * wide(F.shiftright(n, 1))).otherwise(wide(F.shiftright(ends, 1)) * wide(n))

    return F.aggregate(ranges, F.lit(0).cast("decimal(38,0)"), lambda a, r: (a + one(r)).cast("decimal(38,0)"))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def gradient_hash(vector, bits: int = 63) -> Column:
    """Bit i is set when element i is below element i+1. Written out so that it stays one expression."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = F.shiftleft((F.get(col(vector), F.lit(i)) < F.get(col(vector), F.lit(i + 1))).cast("long"), i)
        out = out.bitwiseOR(F.coalesce(bit, F.lit(0).cast("long")))
    return out


def statistic_reading(test, value) -> Column:
    """What a statistic says by the usual cut-off of its test: 'pass', 'fail' or 'unknown'."""
    out = None
    for name, (op, cut) in V.STATISTIC_RULES.items():
        v = col(value)
        ok = v > cut if op == ">" else v < cut
        branch = F.when(ok, "pass").otherwise("fail")
        cond = (col(test) == name) & v.isNotNull()
        out = F.when(cond, branch) if out is None else out.when(cond, branch)
    return out.otherwise("unknown")


def correlation_band(r) -> Column:
    a = F.abs(col(r))
    return F.when(a > 0.8, "strong").when(a > 0.5, "moderate").when(a > 0.3, "weak").otherwise("negligible")


def concordance_band(c) -> Column:
    return (
        F.when(col(c) < 0.5, "reversed")
        .when(col(c) == 0.5, "none")
        .when(col(c) > 0.8, "excellent")
        .when(col(c) > 0.7, "good")
        .otherwise("limited")
    )


def hazard_direction(hr) -> Column:
    return F.when(col(hr) > 1, "risk").when(col(hr) < 1, "protective").otherwise("none")


def bonferroni(p, n) -> Column:
    return F.least(col(p) * col(n), F.lit(1.0))


def instant(c) -> Column:
    """ISO-8601 text to a UTC time stamp; null when it does not parse."""
    return F.try_to_timestamp(F.trim(col(c)))


def has_zone(c) -> Column:
    return F.trim(col(c)).rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")


def seconds_between(a, b) -> Column:
    return (F.unix_micros(col(b)) - F.unix_micros(col(a))) / 1e6
