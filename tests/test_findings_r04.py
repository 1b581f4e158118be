"""Findings of the fourth review on disk, each on a few rows: projects with few findings meet as one list."""

import random

from pyspark.sql import functions as F

from claimgrid.operators import converge as G

ROUTES = ["A", "B", "C"]
SCHEMA = "project_id long, agent string, pos long, location string, dimension string, rule string, description string, protected_category string, id string, source_path string, module string, claim string, error_mechanism string, evidence_object string, repair_path string, severity string"


def findings(spark, seed):
    rnd = random.Random(seed)
    places = ["Section 1.2", "1.2.1 and 3", "1.2", "figure part", "figure part 1", "", None, "3", "see figure part 1 below"]
    rows = []
    for i in range(150):
        sem = [rnd.choice(["m", "n"]), "c", "e", "o", "r"] if rnd.random() < 0.3 else [rnd.choice(["", "", "m", "n"]), None, "", "", ""]
        rows.append((rnd.choice([1, 1, 1, 2, 2, 3, 4, None]), rnd.choice(ROUTES), i, rnd.choice(places), rnd.choice(["d1", "d2", None]), rnd.choice(["r", "", "", None]), rnd.choice(["wrong value", "bad p value", None, ""]),
                     rnd.choice(["", "", "", "figure_identity", None]), f"f{i}", rnd.choice([f"t{rnd.randrange(25)}", ""]), *sem, rnd.choice(["MAJOR", "INFO", None])))
    rows += rows[:6]  # the same row twice
    rows += [(*r[:3], "1.2", *r[4:9], "other", *r[10:]) for r in rows[10:14]]  # another finding in the same place
    rows += [(9, a, p, "1.2", "d1", "r", "bad p value", "", f"x{a}", "t", "", "", "", "", "", "INFO") for a in ROUTES for p in (1, None)]  # a place that is not known
    return spark.createDataFrame(rows, SCHEMA)


def both(spark, monkeypatch, of):
    """Rows when all projects meet as lists, when the larger ones do not, and when none does."""
    out = []
    for few in (1000, 25, 0):
        monkeypatch.setattr(G, "FEW_FINDINGS", few)
        out.append(sorted(map(str, map(tuple, of().collect()))))
    return out


def test_links_of_lists_and_of_blocks_are_the_same(spark, monkeypatch):
    items = G.prepare(findings(spark, 1), ROUTES).localCheckpoint()
    lists, mixed, blocks = both(spark, monkeypatch, lambda: G.link_pairs(items))
    assert lists == mixed == blocks and len(lists) > 300
    a, b = (items.select("project_id", F.struct(*items.columns).alias(n)) for n in "ab")
    want = a.join(b, "project_id").where("a.agent <> b.agent and a.ord < b.ord").where(G.linked("a", "b", 0.4)).select("project_id", "a.ord", F.col("b.ord").alias("right"), "a.raw_finding_id", F.col("b.raw_finding_id").alias("r"), G.link_score("a", "b")).distinct().count()
    assert want == len(lists)


def test_links_of_small_projects_are_shuffled_once(spark):
    links = G.link_pairs(G.prepare(findings(spark, 2).where("project_id > 2 and project_id < 9"), ROUTES))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan, plan
    assert links.count() > 5


def test_ends_of_links_count_as_often_as_they_come(spark):
    """Each row in the place of an end is an end: two and three rows make six links."""
    from claimgrid.plans.queries.clusters import ROUTES as routes
    f = spark.createDataFrame([(1, "A", 4, "1.2", "d")] * 2 + [(1, "C", 5, "1.2", "d")] * 3 + [(1, "C", 6, "7", "e")], "project_id long, agent string, pos long, location string, dimension string")
    r = G.link_pairs(G.prepare(f, routes)).select(G.position("left_ord", "left_agent", routes), G.position("right_ord", "right_agent", routes), "left_times", "right_times").collect()
    assert [tuple(x) for x in r] == [(4, 5, 2, 3)]


def test_clusters_of_lists_and_of_rounds_are_the_same(spark, monkeypatch):
    f = findings(spark, 4).localCheckpoint()
    monkeypatch.setattr(G, "FEW_FINDINGS", 1000)
    lists = sorted(map(str, map(tuple, G.cluster_findings(f, ROUTES).collect())))
    monkeypatch.setattr(G, "FEW_FINDINGS", 30)
    rounds = []
    assert sorted(map(str, map(tuple, G.cluster_findings(f, ROUTES, rounds=rounds).collect()))) == lists and rounds
    assert all(f"'{m}'" in "".join(lists) for m in ("exact", "similarity", "single")) and len(lists) > 130


def test_clusters_of_small_projects_write_no_rounds(spark, monkeypatch):
    written = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda d: written.append(d.columns) or cut(d))
    rounds = []
    out = G.cluster_findings(findings(spark, 5).where("project_id > 2 and project_id < 9"), ROUTES, rounds=rounds)
    assert out.count() > 20 and not rounds and written == [["project_id"]]


def test_cluster_invariants_make_the_clusters_once(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(7 * k, k % 3, "FOP"[k % 3], 1000.0 * (k % 600), f"{1 + k % 5}-X") for k in range(40)]
    spark.createDataFrame([*rows, rows[0]], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    d = queries()["G01_cluster_invariants"](spark, str(tmp_path))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    # a row that comes twice is two findings in one place, and each meets both
    assert tuple(d.first()) == (43, 1, 1)
