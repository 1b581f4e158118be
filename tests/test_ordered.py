"""Chunked windows must give the same result for any chunk size, also one row per chunk."""

import pytest
from pyspark.sql import Window, functions as F

from claimgrid.functions import ordered as D
from claimgrid.functions.keyed import contains_join, first_k


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, p, None if (p * 7 + len(k)) % 3 else p * 10) for k in ("a", "bb") for p in (1, 2, 3, 5, 8, 9, 13, 21, 40)]
    return spark.createDataFrame(data, "k string, line long, v long")


def result(df, c):
    return {(r["k"], r["line"]): r[c] for r in df.collect()}


@pytest.mark.parametrize("span", [1, 4, 10, 1_000_000])
def test_chunk_size_does_not_matter(rows, span):
    w = Window.partitionBy("k").orderBy("line")
    ups, downs = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.select("k", "line", F.last("v", True).over(ups).alias("a"), F.first("v", True).over(downs).alias("b"), F.lag("v").over(w).alias("c"), F.lead("v").over(w).alias("d"), F.sum(F.coalesce("v", F.lit(1))).over(ups).alias("e"))
    v = F.col("v")
    assert result(D.last_known(rows, ["k"], "line", v, "a", span), "a") == result(want, "a")
    assert result(D.next_known(rows, ["k"], "line", v, "b", span), "b") == result(want, "b")
    assert result(D.previous_row(rows, ["k"], "line", v, "c", span), "c") == result(want, "c")
    assert result(D.next_row(rows, ["k"], "line", v, "d", span), "d") == result(want, "d")
    assert result(D.running_sum(rows, ["k"], "line", F.coalesce("v", F.lit(1)), "e", span), "e") == result(want, "e")


@pytest.mark.parametrize("span", [1, 7, 1_000_000])
def test_bracket(spark, span):
    pts = spark.createDataFrame([("k", 10), ("k", 20), ("k", 20), ("z", 5)], "k string, x long")
    prb = spark.createDataFrame([("k", 5), ("k", 10), ("k", 15), ("k", 99), ("y", 1)], "k string, x long")
    got = {(r.k, r.x): (r.below, r.above) for r in D.bracket(pts, prb, ["k"], "x", span).collect()}
    assert got == {("k", 5): (None, 10), ("k", 10): (10, 10), ("k", 15): (10, 20), ("k", 99): (20, None), ("y", 1): (None, None)}


def test_contains_join_is_exact(spark):
    left = spark.createDataFrame([("p", "The Age of X"), ("p", "ab"), ("q", "age"), ("p", "")], "k string, t string")
    right = spark.createDataFrame([("p", "age"), ("p", "b"), ("p", "the age of x y"), ("q", "AGE"), ("p", "of x")], "k string, n string")
    got = sorted((r.k, r.t, r.n) for r in contains_join(left, "t", right, "n", ["k"]).collect())
    want = sorted((a.k, a.t, b.n) for a in left.collect() for b in right.collect() if a.k == b.k and b.n.lower() in a.t.lower())
    assert got == want


def test_first_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    d = first_k(df, ["k"], [F.asc("id")], 3)
    assert d.count() == 6
    assert "WindowGroupLimit" in d._jdf.queryExecution().toString()
