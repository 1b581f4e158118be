"""Faults that the third review found, each on a few rows."""

import random

from pyspark.sql import functions as F

from claimgrid.operators import compare as C, converge as G, extract as X, similarity as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_never_broadcast_their_keys(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(62) for _ in range(12)]
    prints = [b ^ sum(1 << i for i in rnd.sample(range(62), rnd.randint(0, 6))) for b in base for _ in range(6)]
    rows = [(i % 2, f"a{i:03}", p) for i, p in enumerate(prints)] + [(0, "b", prints[0]), (None, "c", 1), (1, None, 1), (1, "d", None), (0, "e", -1), (0, "f", -4)]
    d = S.near_duplicates(spark.createDataFrame(rows, "project_id long, asset string, fingerprint long"))
    held = {}
    for k, a, p in rows:
        if k is not None and p is not None and a is not None:
            held.setdefault((k, p), []).append(a)
    want = sorted((k, min(x), min(y), len(x), len(y), bin((p ^ q) & (2**64 - 1)).count("1")) for (k, p), x in held.items() for (j, q), y in held.items()
                  if k == j and min(x) < min(y) and bin((p ^ q) & (2**64 - 1)).count("1") <= 5)
    assert sorted(tuple(r)[:6] for r in d.collect()) == want and want
    assert "Broadcast" not in plan(d)


def test_citations_make_a_text_ready_once_and_lose_no_letter_case(spark):
    texts = [(1, "ſTRING db [3]; geneKards"), (2, "PUBCHEM [1-4, 9]"), (3, "pıİ omım (x) [2] DAVİD\n base [5]"), (4, "string [a]"), (5, None), (6, "GeneCards, String [7]。omim [8"), (7, "plain [1]")]
    d = X.citations(spark.createDataFrame(texts, "project_id long, body string"))
    got = sorted((r.project_id, r.resource, r.ref, r.ref_to) for r in d.collect())
    assert got == [(1, "STRING", 3, 3), (2, "PubChem", 1, 4), (2, "PubChem", 9, 9), (3, "DAVID", 5, 5), (3, "OMIM", 2, 2), (6, "GeneCards", 7, 7), (6, "STRING", 7, 7)]
    assert d._jdf.queryExecution().optimizedPlan().toString().count(r"(?U)\s+") <= 2  # in the filter and in the projection


def test_item_diff_keeps_both_revisions_in_one_aggregation(spark):
    schema = "a long, b string"
    old = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None), (None, None), (4, "o")], schema)
    new = spark.createDataFrame([(1, "x"), (2, "z"), (2, "z"), (3, None), (None, None), (None, "n")], schema)
    d = C.item_diff(old, new, ["a", "b"])
    assert sorted(map(str, map(tuple, d.collect()))) == sorted(map(str, [
        (2, "z", "added"), (2, "y", "removed"), (4, "o", "removed"), (None, "n", "added"),
        (3, None, "added"), (3, None, "removed"), (None, None, "added"), (None, None, "removed")]))
    assert "Join" not in plan(d)


def test_links_carry_what_they_need_and_are_scored_once(spark):
    rnd = random.Random(5)
    places = ["Section 1.2", "1.2.1 and 3", "1.2", "figure part", "figure part 1", "", None, "3", "see figure part 1 below"]
    rows = [(rnd.choice([1, 1, 2, None]), rnd.choice("AB"), i, rnd.choice(places), rnd.choice(["d1", "d2", None]), rnd.choice(["r", "", None]), rnd.choice(["wrong value", "bad p value", None, ""]),
             rnd.choice(["", "figure_identity", None]), f"f{i}", rnd.choice(["t1", "t2"]), "evidence nobody links by") for i in range(120)]
    rows += rows[:3]
    f = spark.createDataFrame(rows, "project_id long, agent string, pos long, location string, dimension string, rule string, description string, protected_category string, id string, source_path string, evidence string")
    items = G.prepare(f, ["A", "B"]).localCheckpoint()
    links = G.link_pairs(items)
    got = sorted((r.project_id, r.left_ord, r.right_ord, r.score) for r in links.collect())
    a, b = (items.select("project_id", F.struct(*items.columns).alias(n)) for n in "ab")
    want = a.join(b, "project_id").where("a.agent <> b.agent and a.ord < b.ord").where(G.linked("a", "b", 0.4)).select("project_id", "a.ord", F.col("b.ord").alias("right"), G.link_score("a", "b").alias("score")).distinct()
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    text = links._jdf.queryExecution().optimizedPlan().toString()
    assert "description" not in text and "evidence" not in text and "array_intersect(_ka" in text


def extractions(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")


def test_models_are_extracted_once(spark):
    texts = ["a <- lm(y ~ p + q, data = d)", "b <- lm(y ~ p + q + r)", "c <- lm(y ~ q + p + r)", "d <- glm(y ~ s + t + u)", "# e <- lm(y ~ p)", "f <- lm(y ~ p + q + r + s)", None]
    code = spark.createDataFrame([(p, "s.R", i, t) for p in (1, None) for i, t in enumerate(texts)], "project_id long, path string, line long, text string")
    nested, differing = S.nested_models(X.models(code)), S.differing_models(X.models(code))
    assert sorted((r.project_id, r.model_small, r.model_large, r.missing) for r in nested.collect()) == [(1, "a", "b", "r"), (1, "a", "f", "r,s"), (1, "b", "f", "s")]
    assert sorted((r.project_id, r.model, r.differs_from) for r in differing.collect()) == [(1, "b", 1), (1, "d", 2), (1, "f", 1)]
    assert extractions(nested) == extractions(differing) == 0


def test_contained_needles_travel_as_one_list_for_each_key(spark, monkeypatch):
    from claimgrid.functions import keyed

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abAB ") for _ in range(rnd.randint(0, 5)))
    keys = [1, 1, 1, 2, None, 3]
    left = [(rnd.choice(keys), i, rnd.choice([word() + word() + word(), None, ""])) for i in range(150)]
    right = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice("xyz"), rnd.choice([word(), None])) for _ in range(60)]
    left, right = left + left[:4], right + right[:4]
    want = sorted((k, i, t, x, n) for k, i, t in left for j, x, n in right if k is not None and k == j and t is not None and n and n.lower() in t.lower())
    a, b = spark.createDataFrame(left, "project_id long, no long, text string"), spark.createDataFrame(right, "project_id long, x string, needle string")
    for few in (128, 10, 0):  # all keys by lists, key 1 by parts, all by parts
        monkeypatch.setattr(keyed, "FEW_NEEDLES", few)
        d = keyed.contains_join(a, "text", b, "needle", ["project_id"])
        assert d.columns == ["project_id", "no", "text", "x", "needle"] and sorted(map(tuple, d.collect())) == want and len(want) > 100
        assert ("regexp_extract_all" in plan(d)) == (few < 128)
