"""Cases in which a candidate search once lost results."""

import pytest

from claimgrid.operators.converge import cluster_findings, link_pairs, prepare
from claimgrid.operators.reconcile import unknown_symbols
from claimgrid.operators.similarity import history_hints


def test_hint_by_common_words(spark):
    past = spark.createDataFrame([(i, "c", "the model was fitted without an offset") for i in range(1, 6)] + [(9, "c", "rare zebra alone")], "finding_id long, category string, description string")
    now = spark.createDataFrame([(1, "c", "the model was fitted without an offset rare zebra alone")], "finding_id long, category string, description string")
    assert [r.past_id for r in history_hints(now, past).collect()] == [1, 2, 3]


def test_nearest_symbol_with_another_first_letter(spark):
    lost = spark.createDataFrame([("p", "BENE1"), ("p", "EGNE12"), ("p", "X")], "project_id string, symbol string")
    have = spark.createDataFrame([("p", "GENE1"), ("p", "GENE123"), ("q", "BENE2")], "project_id string, symbol string")
    got = {r.symbol: (r.nearest, r.edits) for r in unknown_symbols(lost, have).collect()}
    assert got == {"BENE1": ("GENE1", 1), "EGNE12": (None, None), "X": (None, None)}


def findings(spark, *rows):
    return spark.createDataFrame([("p", a, 0, loc, dim, d) for a, loc, dim, d in rows], "project_id string, agent string, pos long, location string, dimension string, description string")


def test_location_with_a_number_inside(spark):
    d = findings(spark, ("a", "1.2 results table", "count", "x y"), ("b", "results table", "count", "z w"))
    assert link_pairs(prepare(d, ["a", "b"])).count() == 1


def test_unknown_route_is_an_error(spark):
    with pytest.raises(Exception, match="unknown route zz"):
        cluster_findings(findings(spark, ("a", "l", "d", "t"), ("zz", "l", "d", "t")), ["a", "b"]).collect()


def test_contains_join_of_like_needles(spark):
    from claimgrid.functions.keyed import contains_join
    texts = [("p", i, f"the VAR{i} rose " + "x" * i) for i in range(60)] + [("p", 900, "var7 " * 20_000), ("q", 1, "var1"), ("p", 2, None)]
    needles = [("p", f"var{i}") for i in range(1000)] + [("p", "x"), ("p", ""), ("p", None), ("q", "ar")]
    left = spark.createDataFrame(texts, "k string, i long, t string")
    right = spark.createDataFrame(needles, "k string, n string")
    got = sorted((r.k, r.i, r.n) for r in contains_join(left, "t", right, "n", ["k"]).collect())
    assert got == sorted((k, i, n) for k, i, t in texts for q, n in needles if k == q and t and n and n in t.lower())


def test_open_pair_off_the_centre(spark):
    from claimgrid.operators.contracts import unresolved_duplicates
    found = spark.createDataFrame([("p", i, f"m{i}", "c", "e", "same", "fix") for i in "ABC"], "project_id string, canonical_id string, module string, claim string, evidence_object string, error_mechanism string, repair_path string").selectExpr("*", "cast(array() as array<struct<path:string,locator:string>>) as refs")
    schema = "project_id string, left_id string, right_id string, dimension string, own_evidence boolean"
    two = [("p", "A", "B", "module", True), ("p", "C", "A", "module", True)]
    assert [(r.group_id, r.pairs_needed, r.pairs_decided) for r in unresolved_duplicates(found, spark.createDataFrame(two, schema)).collect()] == [("A", 3, 2)]
    assert unresolved_duplicates(found, spark.createDataFrame([*two, ("p", "B", "C", "module", True), ("p", "B", "C", "module", True)], schema)).count() == 0
