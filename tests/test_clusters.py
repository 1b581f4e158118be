"""Clusters against a plain step-by-step solution, and the cases the reference tests use."""

import itertools

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import contracts as Q, converge as G, reconcile as J

ROUTES = ["A", "B", "C"]
COLS = ["agent", "pos", "id", "severity", "dimension", "location", "description", "rule", "source_path", "locator", "protected_category", "module"]


def frame(spark, rows):
    d = spark.createDataFrame([tuple(r.get(c) for c in COLS) for r in rows], "agent string, pos long, id string, severity string, dimension string, location string, description string, rule string, source_path string, locator string, protected_category string, module string")
    return d.withColumn("project_id", F.lit("p"))


def sizes(spark, rows):
    c = G.cluster_findings(frame(spark, rows), ROUTES)
    return sorted(r["n"] for r in c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect())


def row(agent, pos, location, **kw):
    return dict(agent=agent, pos=pos, id=f"{agent}{pos}", severity="MAJOR", dimension="d", location=location, description=f"{agent} text", rule="", source_path=f"{agent}.csv", locator=str(pos), protected_category="", module="") | kw


def test_enclosing_sections_need_complete_links(spark):
    assert sizes(spark, [row("A", 0, "1.2"), row("B", 0, "1.2.1"), row("C", 0, "1.2.2")]) == [1, 2]


def test_protected_category_vetoes_an_equal_key(spark):
    same = dict(source_path="x.csv", locator="1")
    assert sizes(spark, [row("A", 0, "1", **same), row("B", 0, "1", **same, protected_category="figure_identity")]) == [1, 1]


def test_copies_are_paired_in_order(spark):
    same = dict(source_path="x.csv", locator="1")
    rows = [row("A", i, "9", **same) for i in range(5)] + [row("B", i, "9", **same) for i in range(3)]
    assert sizes(spark, rows) == [1, 1, 2, 2, 2]


def test_one_finding_per_route_and_every_pair_linked(spark):
    locs, mods, cats = ["1.1", "1.1.2", "2", "", "Figure part"], ["", "m0", "m1"], ["", "figure_identity"]
    rows = [row(a, i, locs[(i * 3 + n) % 5], module=mods[(i + n) % 3], protected_category=cats[(i * n) % 5 == 4], rule="r" if i % 3 == 0 else "") for n, a in enumerate(ROUTES) for i in range(8)]
    f = frame(spark, rows)
    out = G.cluster_findings(f, ROUTES).collect()
    assert len(out) == len(rows)
    pairs = {frozenset((r.left_id, r.right_id)) for r in G.link_pairs(G.prepare(f, ROUTES)).collect()}
    groups = {}
    for r in out:
        groups.setdefault(r.cluster_id, []).append(r)
    for g in groups.values():
        assert len({r.agent for r in g}) == len(g)
        assert all(frozenset((x.raw_finding_id, y.raw_finding_id)) in pairs for x, y in itertools.combinations(g, 2))
    # maximal: no single finding could still join a cluster that lacks its route
    for g in groups.values():
        for h in groups.values():
            if len(h) == 1 and g is not h and h[0].agent not in {r.agent for r in g} and not any(r.match_mode == "exact" for r in g):
                assert not all(frozenset((r.raw_finding_id, h[0].raw_finding_id)) in pairs for r in g)


def test_links_need_the_threshold_of_the_blocks(spark):
    with pytest.raises(ValueError):
        G.link_pairs(G.prepare(frame(spark, [row("A", 0, "1")]), ROUTES), 0.2)


def test_taint_ends_in_cycles(spark):
    n = spark.createDataFrame([("p", x, "raw_p" if x in "ae" else "fdr", True) for x in "abcde"], "project_id string, node_id string, selection_field string, formal_selection boolean")
    e = spark.createDataFrame([("p", a, b) for a, b in ("aa", "ab", "bc", "cb", "ed", "dx")], "project_id string, from_node string, to_node string")
    assert sorted((r.node_id, r.origin) for r in Q.propagate(n, e).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "e")]


def test_claim_outcomes(spark):
    c = spark.createDataFrame([("p", "go", 383), ("p", "up", 50), ("p", "x", 104), ("p", "y", 900), ("p", "s", 41)], "project_id string, label string, claimed long")
    m = spark.createDataFrame([("p", "go", "a", 409, None), ("p", "up", "b", 51, None), ("p", "x", "c", 100, None), ("p", "y", "d", 100, None), ("p", "s", "e", 100, 40)], "project_id string, label string, path string, total long, significant long")
    got = {r.label: r.outcome for r in J.crossref(c, m).collect()}
    assert got == {"go": "subset", "up": "ok", "x": "close", "y": "mismatch", "s": "ok_significant"}


def test_first_come_settles_blocks_at_once(spark):
    """Blocks of copies, a block with more findings than units, and a tangle, against a walk through the units in order."""
    import random
    rng = random.Random(4)
    edges = {("p", u, 1000 + v) for u in range(40) for v in range(40)} | {("p", 100 + u, 2000 + v) for u in range(5) for v in range(30)} | {("q", u, 3000 + v) for u in range(30) for v in range(4)}
    edges |= {("q", 200 + rng.randrange(12), 4000 + rng.randrange(12)) for _ in range(50)}
    want, free = set(), {(p, v) for p, _, v in edges}
    for p, u in sorted({e[:2] for e in edges}):
        for v in sorted(v for q, x, v in edges if (q, x) == (p, u)):
            if (p, v) in free:
                free.remove((p, v))
                want.add((p, u, v))
                break
    rounds = []
    got = G.first_come(spark.createDataFrame(sorted(edges), "project_id string, uid long, v long"), "B", rounds)
    assert {tuple(r) for r in got.collect()} == want and len(rounds) <= 8
    rounds = []
    whole = [("p", u, v) for u in range(300) for v in range(300)]
    assert G.first_come(spark.createDataFrame(whole, "project_id string, uid long, v long"), "B", rounds).count() == 300 and len(rounds) == 1


def test_a_long_chain_takes_few_rounds(spark):
    steps = 10_000
    e = spark.range(steps).select(F.lit("p").alias("project_id"), F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node"))
    n = spark.range(steps + 1).select(F.lit("p").alias("project_id"), F.col("id").alias("node_id"), F.when(F.col("id").isin(7, 5000), "raw_p").otherwise("fdr").alias("selection_field"), F.lit(True).alias("formal_selection"))
    rounds = []
    got = Q.propagate(n, e, rounds).agg(F.count("*").alias("n"), F.min("node_id").alias("low"), F.max("origin").alias("top")).first()
    assert (got.n, got.low, got.top) == (steps - 6, 7, 7) and len(rounds) <= 15


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_taint_of_tangled_graphs(spark, seed):
    """Chains, cycles, ladders, parallel edges and several projects against a plain search."""
    import random
    rng = random.Random(seed)
    edges, names = set(), {}
    for p in "ab":
        size = 60
        names[p] = list(range(size))
        edges |= {(p, k, k + 1) for k in range(0, 25)} | {(p, 30 + k, 30 + (k + 1) % 6) for k in range(6)} | {(p, 24, 40), (p, 40, 41), (p, 40, 42), (p, 41, 43), (p, 42, 43), (p, 43, 44), (p, 33, 44), (p, 5, 5)}
        edges |= {(p, rng.randrange(size), rng.randrange(size)) for _ in range(rng.choice([0, 15, 60]))} | {(p, 200, 3), (p, 44, 201)}
    sources = {(p, rng.randrange(60)) for p in "ab" for _ in range(4)}
    want = {}
    for p, s in sorted(sources):
        todo, seen = [s], set()
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            want[p, x] = min(s, want.get((p, x), s))
            todo += [v for q, u, v in edges if q == p and u == x and v in names[p]]
    n = spark.createDataFrame([(p, x, "raw_p" if (p, x) in sources else "fdr", True) for p in "ab" for x in names[p]], "project_id string, node_id long, selection_field string, formal_selection boolean")
    e = spark.createDataFrame(sorted(edges) * 2, "project_id string, from_node long, to_node long")
    assert {(r.project_id, r.node_id): r.origin for r in Q.propagate(n, e).collect()} == want
