"""Findings of the third review on memory, shuffles and time, each on a few rows."""

import random

from claimgrid.operators import contracts as Q, reconcile as J
from claimgrid.rules import values as V


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_high_risk_records_are_never_broadcast(spark):
    m = spark.createDataFrame([(1, "a", "molecular_docking"), (1, "a", "molecular_docking"), (2, "b", "odd"), (None, "c", "virtual_knockout")], "project_id long, module_id string, module_type string")
    d = spark.createDataFrame([(1, "a", "reproducible", "pass"), (1, "a", "reproducible", "fail"), (1, "a", "extra", "odd"), (None, "c", "module_exists", "pass")], "project_id long, module_id string, dimension string, status string")
    p = spark.createDataFrame([(1, "a", "ligand_list", "missing"), (1, "a", None, "odd")], "project_id long, module_id string, item_id string, status string")
    out = Q.high_risk(m, d, p)
    assert "Broadcast" not in plan(out)
    n = {k: len(V.HIGH_RISK_PACKAGES[k]) for k in ("molecular_docking", "virtual_knockout")}
    got = {}
    for r in out.collect():
        got[(r.project_id, r.code)] = got.get((r.project_id, r.code), 0) + 1
    dims = len(V.HIGH_RISK_DIMENSIONS)
    assert got == {(2, "module_type_invalid"): 1, (1, "dimension_status_invalid"): 2 * (dims - 1), (1, "dimension_review"): 2, (None, "dimension_status_invalid"): dims,
                   (1, "item_without_disposition"): 2 * (n["molecular_docking"] - 1), (1, "evidence_review"): 2, (None, "item_without_disposition"): n["virtual_knockout"]}


def test_paths_nobody_claims_are_not_gathered(spark):
    claimed = spark.createDataFrame([(1, "a", 1), (1, "a/b/c.csv", 2), (1, "b/c.csv", 3), (1, "c.csv", 4), (1, "x", 5), (2, "a", 6), (2, "a", 6), (None, "a", 7), (1, None, 8)], "project_id long, claimed_path string, line long")
    files = spark.createDataFrame([(1, "a/b/c.csv"), (1, "a/b/c.csv"), (1, "a/d.csv"), (None, "a/b"), (3, None)], "project_id long, path string")
    out = J.missing_paths(claimed, files)
    assert sorted(r.line for r in out.collect()) == [4, 5, 6, 6, 7, 8]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and text.index("LeftAnti") < text.index("Aggregate") < text.index("LeftSemi") < text.index("explode(")


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_symbols_meet_the_list_of_their_project(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("ABé1") for _ in range(rnd.randint(0, 5)))
    keys = [1, 1, 1, 2, 3, None]
    lost = [(rnd.choice(keys), rnd.choice([word(), word(), word(), None])) for _ in range(120)]
    have = [(rnd.choice([1, 1, 2, None]), rnd.choice([word(), word(), word(), None])) for _ in range(60)]
    want = set()
    for k, s in set(lost):
        own = {t for j, t in have if j == k and k is not None and t is not None}
        if s is None or s not in own:
            near = min(((edits(s, t), t) for t in own if edits(s, t) <= 2), default=(None, None), key=lambda x: (x[0], x[1].encode())) if s is not None else (None, None)
            want.add((k, s, near[1], near[0], "WARNING"))
    a, b = (spark.createDataFrame(x, "project_id long, symbol string") for x in (lost, have))
    for few in (128, 15, 0):  # all projects by lists, project 1 by rests, all by rests
        monkeypatch.setattr(J, "FEW_NEEDLES", few)
        out = J.unknown_symbols(a, b)
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) == want and len(rows) == len(want) > 50
        assert ("_rest" in out._jdf.queryExecution().optimizedPlan().toString()) == (few < 128)


def test_arbitration_gathers_dispositions_and_links_once(spark):
    rnd = random.Random(13)
    pick = lambda *x: rnd.choice(x)
    rid = lambda: pick(*[f"r{i}" for i in range(12)], " ", None)
    cid = lambda: pick(*[f"c{i}" for i in range(6)], None)
    pid = lambda: pick(1, 1, 1, 2, None)
    disp = [(pid(), rid(), pick("accept", "reject", "reject", "merge", "odd", "aaa", None), pick("why", "", None)) for _ in range(45)]
    links = [(pid(), rid(), cid()) for _ in range(40)]
    canon = [(pid(), cid(), "MAJOR", pick(0, 1), *["x"] * len(V.SEMANTIC_FIELDS)) for _ in range(9)]
    src = [(pid(), cid(), rid()) for _ in range(30)]
    decl = [(1, 3, "leader_confirmed", 0), (2, 1, "draft", 0), (3, 0, "draft", 0), (None, 1, "draft", 0)]
    full = lambda *x: all(v is not None for v in x)
    want = []
    ids = {(k, r) for k, r, *_ in disp}
    there = {(k, c) for k, c, *_ in canon if full(k, c)}
    to, given = set(links), {x for x in src if full(*x)}
    for k, r, d, _ in disp:
        want += [(k, r, "decision_invalid")] * (d not in V.ARBITRATION_DECISIONS)
    for k, r in ids:
        all_ = [d for j, q, d, _ in disp if (j, q) == (k, r)]
        first = None if None in all_ else min(all_)
        linked = full(k, r) and any((j, q) == (k, r) for j, q, _ in links)
        want += [(k, r, "raw_finding_id_repeated")] * (len(all_) > 1) + [(k, r, "reject_maps_to_finding")] * (first == "reject" and linked)
        want += [(k, r, "decision_maps_to_none")] * (first in V.ARBITRATION_DECISIONS and first != "reject" and not linked)
    for k, r, c in to:
        want += [(k, r, "maps_to_unknown_finding")] * ((k, c) not in there) + [(k, r, "mapping_absent_from_sources")] * ((k, c) in there and (k, c, r) not in given)
    want += [(k, r, "source_not_disposed") for k, c, r in src if not full(k, r) or (k, r) not in ids]
    for k, n, *_ in decl:
        held = {r for j, r in ids if full(j, r) and j == k and r.strip()}
        want += [(k, None if k is None else str(k), "raw_count_differs")] * (n != len(held))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    can = frame(canon, "project_id long, canonical_id string, severity string, evidence_count int, " + ", ".join(f"{f} string" for f in V.SEMANTIC_FIELDS))
    out = Q.arbitration(frame(disp, "project_id long, raw_finding_id string, decision string, reason string"), frame(links, "project_id long, raw_finding_id string, canonical_id string"), can,
                        frame(src, "project_id long, canonical_id string, raw_finding_id string"), frame(decl, "project_id long, raw_finding_count int, status string, unresolved_count int"))
    codes = {x[2] for x in want}
    got = [(r.project_id, r.subject, r.code) for r in out.collect() if r.code in codes]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert codes >= {"reject_maps_to_finding", "decision_maps_to_none", "maps_to_unknown_finding", "mapping_absent_from_sources", "source_not_disposed", "raw_finding_id_repeated", "raw_count_differs"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2
