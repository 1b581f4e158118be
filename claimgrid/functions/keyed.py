"""Helpers for keys that may be hot: bounded samples, rule matching without joins, substring joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimgrid.session import cut

RULE_ROWS_MAX = 10_000
#: Keys with at most so many needles meet their texts as one list.
FEW_NEEDLES = 128


def rule_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table from a literal list. Its length is known here, so a broadcast of it is safe."""
    if len(rows) > RULE_ROWS_MAX:
        raise ValueError(f"{len(rows)} rules; read a table this large as a DataFrame and equi-join it")
    return F.broadcast(spark.createDataFrame(rows, schema))


def matching(df: DataFrame, rules: list[tuple[Column, dict]], keep: list) -> DataFrame:
    """One output row per row and rule whose condition holds.

    The rule list is literal and short, so the match is one projection over each row: no join, no
    product of rows and rules.
    """
    hits = [F.when(cond, F.struct(*[_lit(v).alias(k) for k, v in fields.items()])) for cond, fields in rules]
    found = df.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("_hit"))
    return found.select(*[c for c in found.columns if c != "_hit"], "_hit.*")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key. Spark cuts each key to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def samples(df: DataFrame, keys: list[str], value: str, k: int, out: str) -> DataFrame:
    """The ``k`` smallest distinct values of each key as one joined string."""
    top = first_k(df.select(*keys, value).distinct(), keys, [F.col(value)], k)
    return top.groupBy(*keys).agg(F.concat_ws(", ", F.array_sort(F.collect_list(value))).alias(out))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest order, by a map-side combined ``min``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(packed).select(*keys, "_r.*")


def contains_join(left: DataFrame, text: str, right: DataFrame, needle: str, keys: list[str], gram: int = 4) -> DataFrame:
    """Inner join of rows whose ``text`` contains ``needle`` (case folded), within equal keys.

    The rows of ``right`` of a key travel as one list to the texts of that key, where each needle is tested; the list holds
    FEW_NEEDLES rows at most. Keys with more rows go through parts of the needles instead.
    """
    n = F.lower(F.col(needle))
    own, others = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    dealt = [*keys, "_deal"]  # grouped by a hash besides, so that the join deals both sides out and a hot key can be split
    named = right.where(F.length(n) > 0).select(*keys, F.xxhash64(*keys).alias("_deal"), n.alias("_needle"), *others)
    some = first_k(named, dealt, [F.col("_needle")], FEW_NEEDLES + 1)
    lists = cut(some.groupBy(*dealt).agg(F.collect_list(F.struct("_needle", *others)).alias("_all")).drop("_deal"))
    few, many = lists.where(F.size("_all") <= FEW_NEEDLES), lists.where(F.size("_all") > FEW_NEEDLES).select(*keys)
    folded = F.lower(F.col(text))
    held = F.explode(F.filter("_all", lambda r: F.contains(F.col("_folded"), r["_needle"]))).alias("_r")
    met = left.withColumn("_folded", folded).join(few, keys).select(*keys, *own, held)
    met = met.select(*keys, *own, *[F.col("_r")[c].alias(c) for c in others])
    if many.isEmpty():
        return met
    return met.unionByName(_by_parts(left.join(many, keys, "left_semi"), text, right.join(many, keys, "left_semi"), needle, keys, gram))


def _by_parts(left: DataFrame, text: str, right: DataFrame, needle: str, keys: list[str], gram: int) -> DataFrame:
    """``contains_join`` for any number of needles.

    A text that contains a needle contains every run of ``gram`` letters of it (a shorter needle is its own run), so the
    join is an equi-join on (keys, run). Of each needle only the run that the fewest texts hold is used, which also
    parts needles that begin alike. Texts are named by a hash meanwhile and join last, for the exact test.
    """
    folded, n = F.lower(F.col(text)), F.lower(F.col(needle))

    def runs(whole: str, size: int) -> Column:
        return F.regexp_extract_all(F.col(whole), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))  # linear, also in a long text

    wanted = right.where(F.length(n) > 0).select(*keys, n.alias("_n")).distinct()
    own = reduce(lambda w, g: w.when(F.length("_n") == g, runs("_n", g)), range(1, gram), F).otherwise(runs("_n", gram))
    parts = wanted.select(*keys, "_n", F.explode(F.array_distinct(own)).alias("_gram"))
    texts = left.select(*keys, folded.alias("_t")).distinct()
    every = F.array_distinct(F.flatten(F.array(*[runs("_t", g) for g in range(1, gram + 1)])))
    probe = texts.select(*keys, F.xxhash64("_t").alias("_h"), F.explode(every).alias("_gram")).join(parts.select(*keys, "_gram").distinct(), [*keys, "_gram"], "left_semi").distinct()
    often = probe.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_f"))
    rarest = parts.join(often, [*keys, "_gram"], "left").groupBy(*keys, "_n").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_gram").alias("g"))).alias("_b"))
    rarest = rarest.where("_b.f > 0").select(*keys, "_n", F.col("_b.g").alias("_gram"))
    near = probe.join(rarest, [*keys, "_gram"]).select(*keys, "_h", "_n").distinct()
    joined = left.withColumn("_h", F.xxhash64(folded)).join(near, [*keys, "_h"]).where(F.contains(folded, F.col("_n"))).drop("_h")
    return joined.join(right.withColumn("_n", n), [*keys, "_n"]).drop("_n").select(*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])
