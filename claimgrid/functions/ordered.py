"""Ordered computations that never gather one key in one task.

A plain window ``partitionBy(project)`` sends every row of a project to one task; a project may own a
third of the corpus. Here each key is cut into chunks of a fixed span of its integer position. A
window runs inside each chunk, a one-row-per-chunk summary is carried from chunk to chunk, and the
carried value is joined back. The position must be unique within the key, so a chunk holds at most
``span`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimgrid.session import cut

SPAN = 1_000_000


def _chunked(df: DataFrame, pos: str, span: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(span)).cast("long"))


def _carry(df: DataFrame, keys: list[str], per_chunk: Column, over, forward: bool = True) -> DataFrame:
    """One row per chunk with the value handed over from the chunks before (or after) it."""
    w = Window.partitionBy(*keys).orderBy(F.col("_chunk") if forward else F.col("_chunk").desc())
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_chunk").agg(per_chunk.alias("_own"))
    return sums.select(*keys, "_chunk", over(F.col("_own")).over(w).alias("_carry"))


def _joined(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(carry, [*keys, "_chunk"], "left")


def last_known(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    d = _chunked(df, pos, span).withColumn("_v", value)
    carry = _carry(d, keys, F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))), lambda c: F.last(c, True))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.last("_v", True).over(w))
    return _joined(d, carry, keys).withColumn(out, F.coalesce("_local", "_carry")).drop("_chunk", "_v", "_local", "_carry")


def next_known(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Earliest non-null ``value`` at or after each row."""
    d = _chunked(df, pos, span).withColumn("_v", value)
    carry = _carry(d, keys, F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(pos))), lambda c: F.last(c, True), False)
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_local", F.first("_v", True).over(w))
    return _joined(d, carry, keys).withColumn(out, F.coalesce("_local", "_carry")).drop("_chunk", "_v", "_local", "_carry")


def previous_row(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """``value`` of the row before; null on the first row of a key. Null values are handed over too."""
    d = _chunked(df, pos, span).withColumn("_v", F.struct(value.alias("x")))
    carry = _carry(d, keys, F.max_by("_v", pos), lambda c: F.last(c, True))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    d = d.withColumn("_local", F.lag("_v").over(w))
    return _joined(d, carry, keys).withColumn(out, F.coalesce("_local", "_carry")["x"]).drop("_chunk", "_v", "_local", "_carry")


def next_row(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """``value`` of the row after; null on the last row of a key."""
    d = _chunked(df, pos, span).withColumn("_v", F.struct(value.alias("x")))
    carry = _carry(d, keys, F.min_by("_v", pos), lambda c: F.last(c, True), False)
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    d = d.withColumn("_local", F.lead("_v").over(w))
    return _joined(d, carry, keys).withColumn(out, F.coalesce("_local", "_carry")["x"]).drop("_chunk", "_v", "_local", "_carry")


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    d = _chunked(df, pos, span).withColumn("_v", value)
    carry = _carry(d, keys, F.sum("_v"), F.sum)
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.sum("_v").over(w))
    return (
        _joined(d, carry, keys)
        .withColumn(out, F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_chunk", "_v", "_local", "_carry")
    )


def neighbours(df: DataFrame, keys: list[str], pos: str, text: str, before: int, after: int, out: str) -> DataFrame:
    """Array of ``text`` on the lines ``pos-before .. pos+after`` of the same key.

    Each line is sent to the few lines it is near to, and the pieces are put together by an
    aggregation on (key, line): an equi-join free of ranges, bounded by ``before+after+1`` per line.
    """
    sent = df.select(
        *keys,
        F.explode(F.sequence(F.col(pos) - F.lit(after), F.col(pos) + F.lit(before))).alias("_to"),
        F.struct(F.col(pos).alias("p"), F.col(text).alias("t")).alias("_piece"),
    )
    ctx = sent.groupBy(*keys, "_to").agg(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["t"]).alias(out))
    return df.join(ctx.withColumnRenamed("_to", pos), [*keys, pos], "inner")


def bracket(points: DataFrame, probes: DataFrame, keys: list[str], value: str, span: int = SPAN) -> DataFrame:
    """For every distinct probe value the nearest point not above it and the nearest not below it."""
    p = points.select(*keys, F.col(value).alias("_x")).where("_x is not null").distinct().withColumn("_pt", F.col("_x"))
    q = probes.select(*keys, F.col(value).alias("_x")).where("_x is not null").distinct().withColumn("_pr", F.col("_x"))
    # one row per (key, value), so the value itself is a valid chunk position
    both = (
        p.unionByName(q, allowMissingColumns=True)
        .groupBy(*keys, "_x")
        .agg(F.max("_pt").alias("_pt"), F.max("_pr").alias("_pr"))
    )
    # read four times below: written once, so that the extraction behind the points runs once
    both = cut(both)
    both = last_known(both, keys, "_x", F.col("_pt"), "below", span)
    both = next_known(both, keys, "_x", F.col("_pt"), "above", span)
    return both.where("_pr is not null").select(*keys, F.col("_x").alias(value), "below", "above")


def missing_between(ranges: DataFrame, points: DataFrame, keys: list[str], value: str, span: int = SPAN) -> DataFrame:
    """``ranges`` (keys, lo, hi and other columns) with ``missing``: how many whole numbers from lo to hi are no point of
    the key, and the first and last of them; ranges without any are left out.

    Points carry their rank and the run of neighbouring numbers they stand in. The first point at or above lo and the last
    at or below hi then decide: their ranks give the number of points between, their runs the first and last gap. A range
    is one row, whatever its length.
    """
    p = points.select(*keys, F.col(value).cast("long").alias("_x")).where("_x is not null").distinct()
    p = cut(running_sum(p, keys, "_x", F.lit(1), "_rank").withColumn("_run", F.col("_x") - F.col("_rank")))
    runs = p.groupBy(*keys, "_run").agg(F.min("_x").alias("_start"), F.max("_x").alias("_end"))
    p = cut(p.join(runs, [*keys, "_run"]).drop("_run"))
    ends = ranges.select(*keys, F.explode(F.array("lo", "hi")).alias("_x"))
    near = bracket(p.select(*keys, "_x"), ends, keys, "_x", span)
    first = near.where("above is not null").select(*keys, F.col("_x").alias("lo"), F.col("above").alias("_a")).join(p.select(*keys, F.col("_x").alias("_a"), F.col("_rank").alias("_ra"), F.col("_end").alias("_ea")), [*keys, "_a"])
    last = near.where("below is not null").select(*keys, F.col("_x").alias("hi"), F.col("below").alias("_b")).join(p.select(*keys, F.col("_x").alias("_b"), F.col("_rank").alias("_rb"), F.col("_start").alias("_sb")), [*keys, "_b"])
    d = ranges.join(first, [*keys, "lo"], "left").join(last, [*keys, "hi"], "left")
    inside = F.when(F.col("_a") <= F.col("hi"), F.col("_rb") - F.col("_ra") + 1).otherwise(0)
    d = d.withColumn("missing", F.col("hi") - F.col("lo") + 1 - inside).where("missing > 0")
    d = d.withColumn("first_missing", F.when(F.col("_a") == F.col("lo"), F.col("_ea") + 1).otherwise(F.col("lo")))
    d = d.withColumn("last_missing", F.when(F.col("_b") == F.col("hi"), F.col("_sb") - 1).otherwise(F.col("hi")))
    return d.drop("_a", "_ra", "_ea", "_b", "_rb", "_sb")
