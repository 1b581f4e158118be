"""Reference ranges as intervals: nothing is expanded, whatever the length of a range or of its numbers."""

import random

import pytest
from pyspark.sql import functions as F

from claimgrid.functions import numbers as N
from claimgrid.functions.ordered import missing_between
from claimgrid.operators import extract as X, reconcile as J


@pytest.mark.parametrize("text,want", [
    ("1-5,7", [(1, 5), (7, 7)]), ("9 - 3, x, 4", [(4, 4)]), ("1-999999999999", [(1, 999999999999)]), ("0012", [(12, 12)]), ("", []), (None, None), ("-3", []), ("1--3", []), ("0", [(0, 0)]),
    ("1234567890", [(1234567890,) * 2]), ("5-" + "9" * 40, [(5, N.MOST)]), ("1，2 3", [(1, 1), (2, 2), (3, 3)])])
def test_ranges(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string").select(N.ref_ranges("t").alias("r"))
    got = d.select("r", N.range_size(F.col("r")).alias("n"), N.range_total(F.col("r")).alias("total")).first()
    assert (None if got.r is None else [tuple(r) for r in got.r]) == want
    if want is not None:
        assert got.n == sum(b - a + 1 for a, b in want) and got.total == sum((a + b) * (b - a + 1) // 2 for a, b in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_missing_between(spark, seed):
    rng = random.Random(seed)
    points = [(k, rng.randrange(-30, 60)) for k in "ab" for _ in range(45)] + [("a", 5), ("a", 5), ("a", None)] + [("hot", x) for x in range(200) if x % 50]
    ranges = [(k, lo, lo + rng.randrange(0, 25)) for k in "abz" for lo in (rng.randrange(-40, 70) for _ in range(25))] + [("hot", 0, 10**12), ("hot", 1, 49), ("hot", 3, 160)]
    got = missing_between(spark.createDataFrame(ranges, "k string, lo long, hi long"), spark.createDataFrame(points, "k string, x long"), ["k"], "x", 7)
    want = []
    for k, lo, hi in ranges:
        held = {x for c, x in points if c == k}
        if hi < 10**6:
            gaps = [x for x in range(lo, hi + 1) if x not in held]
            want += [(k, lo, hi, len(gaps), gaps[0], gaps[-1])] if gaps else []
        else:
            want.append((k, lo, hi, hi - lo + 1 - len(held), 0, hi))
    assert sorted(tuple(r) for r in got.select("k", "lo", "hi", "missing", "first_missing", "last_missing").collect()) == sorted(want)


def test_citations_of_long_ranges(spark):
    refs = [f"{'The STRING database' if k in (2, 3, 5) else 'Other'} paper" for k in range(1, 7)]
    body = spark.createDataFrame([("p", "Pairs came from STRING [2-5], STRING [3], STRING [1-999999999999] and STRING [12345678901] or STRING [0]")], "project_id string, body string")
    lists = spark.createDataFrame([("p", k + 1, r) for k, r in enumerate(refs)], "project_id string, ref long, reference string")
    cited = X.citations(body).where("resource = 'STRING'")
    assert {(r.ref, r.ref_to) for r in cited.collect()} == {(2, 5), (3, 3), (1, 999999999999), (12345678901, 12345678901), (0, 0)}
    got = J.citation_check(cited, lists, spark.createDataFrame([("p", "STRING")], "project_id string, resource string"))
    assert {(r.problem, r.ref, r.ref_to, r.refs) for r in got.collect()} == {
        ("mismatch", 4, 4, 1), ("mismatch", 1, 6, 3), ("out_of_range", 7, 999999999999, 999999999993), ("out_of_range", 12345678901, 12345678901, 1), ("out_of_range", 0, 0, 1)}


def test_figures_missing_in_a_long_range(spark):
    lines = spark.createDataFrame([("p", 1, "see Fig 2-1 ~ Fig 2-900000000000"), ("p", 2, "Fig 2-3 and Fig.2-4"), ("p", 3, "Fig 3-1 ~ Fig 3-2"), ("q", 1, "Fig 2-5 ~ Fig 2-4")], "project_id string, line long, text string")
    got = J.missing_in_range(lines).collect()
    assert [(r.project_id, r.line, r.prefix, r.missing, r.first_missing, r.last_missing) for r in got] == [("p", 1, "2", 900000000000 - 4, 2, 900000000000 - 1)]
