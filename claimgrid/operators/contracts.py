"""Contracts over audit records. Every validator returns rows: project_id, subject, code, kind.

``kind`` is ``error`` (the record breaks its contract) or ``candidate`` (a professional has to look; it
carries no severity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.numbers import has_zone, instant
from claimgrid.operators.compare import coverage, duplicate_keys, orphans, union_findings
from claimgrid.operators.extract import K
from claimgrid.operators.ordered_checks import attempt_facts, task_lifecycle
from claimgrid.operators.similarity import conservation
from claimgrid.rules import values as V
from claimgrid.session import cut


# --- generic rules --------------------------------------------------------------------------------


def required(c: str) -> tuple[Column, str]:
    return F.col(c).isNotNull(), f"{c}_missing"


def filled(c: str) -> tuple[Column, str]:
    return ~T.is_blank(c), f"{c}_blank"


def one_of(c: str, values: list[str]) -> tuple[Column, str]:
    return F.coalesce(F.col(c).isin(values), F.lit(False)), f"{c}_invalid"


def non_negative(c: str) -> tuple[Column, str]:
    return F.coalesce(F.col(c) >= 0, F.lit(False)), f"{c}_not_non_negative"


def within(c: str, low, high) -> tuple[Column, str]:
    return F.coalesce(F.col(c).between(low, high), F.lit(False)), f"{c}_out_of_range"


def non_empty(c: str) -> tuple[Column, str]:
    return F.coalesce(F.size(c) > 0, F.lit(False)), f"{c}_empty"


def validate(df: DataFrame, rules: list[tuple[Column, str]], subject: str, unique: list[str] | None = None, kind: str = "error") -> DataFrame:
    """One row per broken rule. Uniqueness is judged by one combined count per key, one row per repeated key."""
    bad = F.array_compact(F.array(*[F.when(~ok, code) for ok, code in rules]))
    out = df.select(K, F.col(subject).cast("string").alias("subject"), F.explode(bad).alias("code"))
    if unique:
        twice = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(subject).cast("string")).alias("subject")).where("_n > 1")
        out = out.unionByName(twice.select(K, "subject", F.lit(f"{unique[-1]}_repeated").alias("code")))
    return out.withColumn("kind", F.lit(kind))


def coerce_int(c: str) -> Column:
    return F.trim(F.col(c).cast("string")).try_cast("bigint")


def coerce_bool(c: str) -> Column:
    low = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def clip_score(c: str) -> tuple[Column, Column]:
    """(score in 0..100, note when it was changed)."""
    n = coerce_int(c)
    v = F.greatest(F.lit(0), F.least(F.lit(100), n))
    return v, F.when(n.isNull(), "not_a_number").when(n != v, "clipped")


def _rows(df: DataFrame, cond: Column, code: str, subject: str, kind: str) -> DataFrame:
    return df.where(cond).select(K, F.col(subject).cast("string").alias("subject"), F.lit(code).alias("code"), F.lit(kind).alias("kind"))


# --- data scope, statistics, methods, learning ----------------------------------------------------


def dataset_scope(datasets: DataFrame, reads: DataFrame) -> DataFrame:
    """``datasets``: project_id, dataset_id, declared, source_status, outputs (count). ``reads``: project_id,
    dataset_id, activity, reachable."""
    d = datasets.withColumn("_k", F.coalesce("dataset_id", F.lit("")))
    errors = validate(d, [filled("dataset_id"), one_of("source_status", V.SOURCE_STATUSES)], "dataset_id", [K, "dataset_id"])
    read_errors = validate(reads, [one_of("activity", V.ACTIVITIES)], "dataset_id")
    unknown = _rows(reads, F.col("activity") == "unknown", "activity_unknown", "dataset_id", "candidate")
    live = reads.groupBy(K, "dataset_id").agg(F.bool_or((F.col("activity") == "active") & F.coalesce("reachable", F.lit(False))).alias("_live"))
    j = d.join(live, [K, "dataset_id"], "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
    say = F.coalesce("declared", F.lit(False))
    return union_findings([
        errors, read_errors, unknown,
        _rows(j, say & ~F.col("_live") & (F.col("outputs") == 0), "isolated_declaration", "dataset_id", "candidate"),
        _rows(j, F.col("_live") & ~say, "active_unreported", "dataset_id", "candidate"),
        _rows(j, F.col("_live") & F.col("source_status").isin("missing", "unknown"), "source_unresolved", "dataset_id", "candidate")])


def propagate(nodes: DataFrame, edges: DataFrame, rounds: list[str] | None = None) -> DataFrame:
    """Nodes reached from formal raw-p selections, each with its smallest origin.

    Chains are shortened before anything is sent along them. A node with one node before it points to that node; pointers
    are doubled, with the smallest origin met, until they end at a node without or with several nodes before it. What is
    left is a graph between these last, and is shortened again as long as that halves it. Waves run on the rest, and the
    results go back through the shortened chains. A chain of n steps so takes log2(n) rounds instead of n; cycles end, as
    pointers are doubled no more often than the number of nodes allows. Each round is written to the checkpoint folder.
    ``rounds``, if given, receives a word for each round.
    """
    known = nodes.select(K, "node_id").distinct()
    e = edges.join(known.withColumnRenamed("node_id", "to_node"), [K, "to_node"], "left_semi").where("from_node <> to_node")
    e = cut(e.select(K, F.col("from_node").alias("u"), F.col("to_node").alias("v")).distinct())
    own = cut(nodes.where("selection_field = 'raw_p' and formal_selection").select(K, "node_id", F.col("node_id").alias("origin")).distinct())
    best = _spread(own, e, [] if rounds is None else rounds)
    return best.select(K, "node_id", "origin")


def _lowest(df: DataFrame) -> DataFrame:
    return df.where("origin is not null").groupBy(K, "node_id").agg(F.min("origin").alias("origin"))


def _spread(own: DataFrame, e: DataFrame, rounds: list[str]) -> DataFrame:
    """Smallest origin of every node that has one. ``own``: project_id, node_id, origin; ``e``: project_id, u, v, distinct."""
    size = e.count()
    if not size:
        return own
    before = e.groupBy(K, "v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("to"))
    chain = before.where("n = 1").select(K, F.col("v").alias("node_id"), "to").join(own, [K, "node_id"], "left")
    chain = cut(chain)
    for _ in range(chain.count().bit_length() + 1):
        ahead = chain.select(K, F.col("node_id").alias("to"), F.col("to").alias("_to"), F.col("origin").alias("_o"))
        if chain.join(ahead, [K, "to"], "left_semi").isEmpty():
            break
        rounds.append("double")
        chain = cut(chain.join(ahead, [K, "to"], "left").select(K, "node_id", F.coalesce("_to", "to").alias("to"), F.least("origin", "_o").alias("origin")))
    # a pointer that still leads to a chain node runs in a cycle, whose smallest origin it has met
    join_ = e.join(before.where("n > 1").select(K, "v"), [K, "v"], "left_semi")
    ends = chain.select(K, F.col("node_id").alias("u"), "to", F.col("origin").alias("_o"))
    inner = join_.join(ends, [K, "u"], "left").select(K, F.coalesce("to", "u").alias("u"), "v", "_o")
    inner = cut(inner)
    core = inner.select(K, F.col("u").alias("_u"), "v").join(before.where("n > 1").select(K, F.col("v").alias("_u")), [K, "_u"], "left_semi").where("_u <> v").select(K, F.col("_u").alias("u"), "v").distinct()
    core = cut(core)
    # origins that reach a node of the core over its chains, or from a node without any before it
    first = inner.join(own.select(K, F.col("node_id").alias("u"), F.col("origin").alias("_own")), [K, "u"], "left").select(K, F.col("v").alias("node_id"), F.least("_o", "_own").alias("origin"))
    start = cut(_lowest(own.unionByName(first)))
    left = core.count()
    solved = (_spread(start, core, rounds) if left * 2 <= size else _waves(start, core, rounds)) if left else start
    solved = cut(solved)
    back = chain.join(solved.select(K, F.col("node_id").alias("to"), F.col("origin").alias("_o")), [K, "to"], "left").select(K, "node_id", F.least("origin", "_o").alias("origin"))
    return cut(_lowest(solved.unionByName(back)))


def _waves(own: DataFrame, e: DataFrame, rounds: list[str]) -> DataFrame:
    """A wave carries (node, origin) only where the origin is new or smaller; its size is the change, not the graph."""
    best = wave = own
    while True:
        rounds.append("wave")
        sent = wave.join(e.withColumnRenamed("u", "node_id"), [K, "node_id"]).groupBy(K, F.col("v").alias("node_id")).agg(F.min("origin").alias("origin"))
        wave = cut(sent.join(best.withColumnRenamed("origin", "_o"), [K, "node_id"], "left").where("_o is null or origin < _o").select(K, "node_id", "origin"))
        if wave.isEmpty():
            return best
        best = cut(_lowest(best.unionByName(wave)))


def stat_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(K, F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return union_findings([
        validate(nodes, [filled("node_id"), one_of("taint_status", V.TAINT_STATUSES)], "node_id", [K, "node_id"]),
        _rows(orphans(ends, nodes, [K, "node_id"]), F.lit(True), "edge_to_unknown_node", "node_id", "error"),
        _rows(propagate(nodes, edges), F.lit(True), "raw_p_downstream", "node_id", "candidate")])


def method_code(analyses: DataFrame) -> DataFrame:
    fields = ["report_method", "implementation", "parameters", "outputs", "differences"]
    return union_findings([
        validate(analyses, [filled("analysis_id"), *[required(f) for f in fields], one_of("match_status", V.MATCH_STATUSES)], "analysis_id", [K, "analysis_id"]),
        _rows(analyses, F.col("match_status").isin("mismatch", "partial", "unknown"), "method_review", "analysis_id", "candidate")])


def ml_lineage(metrics: DataFrame, predictions: DataFrame, selections: DataFrame) -> DataFrame:
    """``metrics``: project_id, analysis_id, metric_id, prediction_id, published, data_role. ``predictions``:
    project_id, analysis_id, prediction_id, data_role, sample_identity_hash. ``selections``: project_id,
    analysis_id, selection_id, scope, supervised."""
    pub = metrics.where(F.coalesce("published", F.lit(True)))
    return union_findings([
        _rows(orphans(pub, predictions, [K, "analysis_id", "prediction_id"]), F.lit(True), "metric_without_prediction", "metric_id", "error"),
        _rows(pub, F.col("data_role").isin("train", "unknown"), "metric_role", "metric_id", "candidate"),
        validate(selections, [one_of("scope", V.LINEAGE_SCOPES)], "selection_id"),
        _rows(selections, F.coalesce("supervised", F.lit(False)) & F.col("scope").isin("pre_split", "unknown"), "selection_leakage", "selection_id", "candidate"),
        _rows(predictions, (F.col("data_role") == "external") & T.is_blank("sample_identity_hash"), "external_identity", "prediction_id", "candidate")])


def high_risk(modules: DataFrame, dimensions: DataFrame, packages: DataFrame) -> DataFrame:
    """``modules``: project_id, module_id, module_type. ``dimensions``: project_id, module_id, dimension, status.
    ``packages``: project_id, module_id, item_id, status. The required items are a literal list per type.

    Records are many times the rows they may be exploded from, which the planner does not know, so the joins are told never
    to broadcast."""
    table = F.create_map(*[x for t, items in V.HIGH_RISK_PACKAGES.items() for x in (F.lit(t), F.array(*map(F.lit, items)))])
    good = modules.where(F.col("module_type").isin(list(V.HIGH_RISK_PACKAGES)))
    need_dim = good.select(K, "module_id", F.explode(F.array(*map(F.lit, V.HIGH_RISK_DIMENSIONS))).alias("dimension"))
    d = need_dim.join(dimensions.hint("merge"), [K, "module_id", "dimension"], "left").withColumn("subject", F.concat_ws("/", "module_id", "dimension"))
    need_item = good.select(K, "module_id", F.explode(F.element_at(table, F.col("module_type"))).alias("item_id"))
    p = need_item.join(packages.hint("merge"), [K, "module_id", "item_id"], "left").withColumn("subject", F.concat_ws("/", "module_id", "item_id"))
    ok_dim = F.coalesce(F.col("status").isin(V.DIMENSION_STATUSES), F.lit(False))
    ok_item = F.coalesce(F.col("status").isin(V.EVIDENCE_STATUSES), F.lit(False))
    return union_findings([
        validate(modules, [one_of("module_type", list(V.HIGH_RISK_PACKAGES))], "module_id"),
        _rows(d, ~ok_dim, "dimension_status_invalid", "subject", "error"),
        _rows(d, F.col("status").isin("fail", "unknown"), "dimension_review", "subject", "candidate"),
        _rows(p, F.col("status").isNull(), "item_without_disposition", "subject", "error"),
        _rows(p, F.col("status").isNotNull() & ~ok_item, "item_status_invalid", "subject", "error"),
        _rows(p, F.col("status").isin("missing", "unknown"), "evidence_review", "subject", "candidate")])


# --- arbitration ----------------------------------------------------------------------------------


def pair_coverage(merges: DataFrame, checks: DataFrame) -> DataFrame:
    """Merges whose pairwise checks do not cover every pair of members.

    A merge of n members needs n(n-1)/2 different checked pairs among them, so counts decide it and the
    pairs that should exist are never listed. ``merges``: project_id, merge_id, member. ``checks``:
    project_id, merge_id, left_id, right_id, linked.
    """
    m = merges.select(K, "merge_id", "member").distinct()
    size = m.groupBy(K, "merge_id").agg(F.count(F.lit(1)).alias("members"))
    lo, hi = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    c = checks.select(K, "merge_id", lo.alias("_a"), hi.alias("_b"), "linked").where("_a < _b")
    c = c.join(m.withColumnRenamed("member", "_a"), [K, "merge_id", "_a"], "left_semi").join(m.withColumnRenamed("member", "_b"), [K, "merge_id", "_b"], "left_semi")
    per = c.groupBy(K, "merge_id", "_a", "_b").agg(F.bool_and("linked").alias("_ok")).groupBy(K, "merge_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("_ok")).alias("incompatible"))
    d = size.join(per, [K, "merge_id"], "left").na.fill(0, ["checked", "incompatible"])
    need = (F.col("members") * (F.col("members") - 1) / 2).cast("long")
    return d.withColumn("needed", need).where("checked < needed or incompatible > 0 or members < 2")


def arbitration(dispositions: DataFrame, links: DataFrame, canonical: DataFrame, sources: DataFrame, declared: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``dispositions``: project_id, raw_finding_id, decision, reason. ``links``: project_id, raw_finding_id,
    canonical_id (from the dispositions). ``canonical``: project_id, canonical_id, severity, evidence_count
    and the semantic fields. ``sources``: project_id, canonical_id, raw_finding_id (from the canonical
    findings). ``declared``: project_id, raw_finding_count, status, unresolved_count. ``merged``: project_id,
    canonical_id covered by a merge decision."""
    parts = [
        validate(dispositions, [filled("raw_finding_id"), one_of("decision", V.ARBITRATION_DECISIONS), filled("reason")], "raw_finding_id"),
        validate(canonical, [filled("canonical_id"), one_of("severity", V.SEVERITIES), *[filled(f) for f in V.SEMANTIC_FIELDS]], "canonical_id", [K, "canonical_id"]),
        validate(declared, [one_of("status", V.ARBITRATION_STATUSES), non_negative("unresolved_count")], K),
        _rows(declared, (F.col("status") == "leader_confirmed") & (F.col("unresolved_count") != 0), "confirmed_with_unresolved", K, "error"),
    ]
    raw = [K, "raw_finding_id"]
    # dispositions and links meet in one aggregation; a decision is its place among the known ones, so that the first is a minimum of numbers
    order = sorted(V.ARBITRATION_DECISIONS)
    place = reduce(lambda w, i: w.when(F.col("decision") < order[i], 2 * i + 1).when(F.col("decision") == order[i], 2 * i + 2), range(len(order)), F.when(F.col("decision").isNull(), 0))
    both = dispositions.select(*raw, place.otherwise(2 * len(order) + 1).alias("_at")).unionByName(links.select(*raw, F.lit(None).cast("int").alias("_at")))
    by_raw = cut(both.groupBy(*raw).agg(F.count("_at").alias("_n"), F.min("_at").alias("_at"), F.bool_or(F.col("_at").isNull()).alias("_l"))).where("_n > 0")
    linked = F.col("_l") & F.col(K).isNotNull() & F.col("raw_finding_id").isNotNull()
    known = {x: 2 * i + 2 for i, x in enumerate(order)}
    codes = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "raw_finding_id_repeated"), F.when((F.col("_at") == known["reject"]) & linked, "reject_maps_to_finding"),
        F.when(F.col("_at").isin([n for x, n in known.items() if x != "reject"]) & ~linked, "decision_maps_to_none")))
    n = by_raw.where(~T.is_blank("raw_finding_id")).groupBy(K).agg(F.count(F.lit(1)).alias("_n"))
    # so do links and sources; a link is judged by one join with the canonical findings
    way = [K, "canonical_id", "raw_finding_id"]
    met = links.select(*way, F.lit(True).alias("_l")).unionByName(sources.select(*way, F.lit(False).alias("_l"))).groupBy(*way).agg(F.bool_or("_l").alias("_l"), F.bool_and("_l").alias("_only"))
    to = met.where("_l").join(canonical.select(K, "canonical_id", F.lit(True).alias("_c")).distinct(), [K, "canonical_id"], "left")
    astray = F.when(F.col("_c").isNull(), "maps_to_unknown_finding").when(F.col("_only") | F.col("raw_finding_id").isNull(), "mapping_absent_from_sources")
    parts += [
        by_raw.select(K, F.col("raw_finding_id").cast("string").alias("subject"), F.explode(codes).alias("code"), F.lit("error").alias("kind")),
        _rows(declared.join(n, K, "left"), F.col("raw_finding_count") != F.coalesce("_n", F.lit(0)), "raw_count_differs", K, "error"),
        to.select(K, F.col("raw_finding_id").cast("string").alias("subject"), astray.alias("code"), F.lit("error").alias("kind")).where("code is not null"),
        _rows(sources.join(by_raw.select(*raw), raw, "left_anti"), F.lit(True), "source_not_disposed", "raw_finding_id", "error"),
        _rows(orphans(canonical, sources, [K, "canonical_id"]), F.lit(True), "finding_without_source", "canonical_id", "error"),
    ]
    conf = declared.where("status = 'leader_confirmed'").select(K)
    if "evidence_count" in canonical.columns:
        parts.append(_rows(canonical.join(conf, K, "left_semi"), F.col("evidence_count") == 0, "confirmed_without_evidence", "canonical_id", "error"))
    if merged is not None:
        multi = sources.groupBy(K, "canonical_id").agg(F.countDistinct("raw_finding_id").alias("_n")).where("_n > 1")
        parts.append(_rows(orphans(multi, merged, [K, "canonical_id"]), F.lit(True), "merge_decision_missing", "canonical_id", "error"))
    return union_findings(parts)


def unresolved_duplicates(canonical: DataFrame, independence: DataFrame) -> DataFrame:
    """Groups of duplicate candidates with a pair that has no sound independence decision: a group of n needs
    n(n-1)/2 of them. ``independence``: project_id, left_id, right_id, dimension (a field that differs), own_evidence
    (both sides cite their own). Pairs are counted, never listed, so a large group is one row."""
    keys = duplicate_keys(canonical)
    fields = canonical.select(K, "canonical_id", *[T.norm_lower(f).alias(f"_{f}") for f in ("module", "claim", "evidence_object")])
    a = fields.select(K, F.col("canonical_id").alias("left_id"), F.struct("_module", "_claim", "_evidence_object").alias("a"))
    b = fields.select(K, F.col("canonical_id").alias("right_id"), F.struct("_module", "_claim", "_evidence_object").alias("b"))
    j = independence.select(K, F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "dimension", "own_evidence")
    j = j.join(a, [K, "left_id"]).join(b, [K, "right_id"])
    differs = reduce(lambda w, f: F.when(F.col("dimension") == f, F.col(f"a._{f}") != F.col(f"b._{f}")).otherwise(w), ("module", "claim", "evidence_object"), F.lit(False))
    sound = j.where(F.coalesce("own_evidence", F.lit(False)) & differs).where("left_id <> right_id").select(K, "left_id", "right_id").distinct()
    one, two = (keys.withColumnRenamed("canonical_id", side) for side in ("left_id", "right_id"))
    decided = sound.join(one, [K, "left_id"]).join(two, [K, "right_id", "reason", "shared_key"]).groupBy(K, "reason", "shared_key").agg(F.count(F.lit(1)).alias("_d"))
    groups = keys.groupBy(K, "reason", "shared_key").agg(F.min("canonical_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    d = groups.join(decided, [K, "reason", "shared_key"], "left").withColumns({"pairs_needed": F.expr("group_size * (group_size - 1) div 2"), "pairs_decided": F.coalesce("_d", F.lit(0).cast("long"))})
    return d.where("pairs_decided < pairs_needed").select(K, "group_id", "reason", "shared_key", "group_size", "pairs_needed", "pairs_decided")


# --- decision, figures, supervision ---------------------------------------------------------------


def decision(decisions: DataFrame, sources: DataFrame, report_verdicts: DataFrame | None = None) -> DataFrame:
    """``decisions``: project_id, declared_project, status, confirmed_by, confirmed_at, score, score_scale, verdict,
    release_decision, one count column per severity, canonical_finding_count, unresolved_count. ``sources``:
    project_id, source, recorded_sha256, actual_sha256."""
    total = reduce(lambda a, b: a + b, [F.col(s) for s in V.SEVERITIES])
    pair = reduce(lambda w, kv: w | ((F.col("verdict") == kv[0]) & (F.col("release_decision") == kv[1])), V.VERDICT_RELEASE.items(), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = [
        validate(decisions, [
            (yes(F.col("declared_project") == F.col(K).cast("string")), "project_differs"),
            (yes(F.col("status") == "leader_confirmed"), "status_not_confirmed"), filled("confirmed_by"),
            (yes(has_zone("confirmed_at") & instant("confirmed_at").isNotNull()), "confirmed_at_invalid"),
            (yes(F.col("score").between(0, 100) & (F.col("score_scale") == 100)), "score_invalid"), (yes(pair), "verdict_release_invalid"),
            *[non_negative(s) for s in V.SEVERITIES], (yes(total == F.col("canonical_finding_count")), "count_not_severity_sum"),
            (yes(F.col("unresolved_count") == 0), "unresolved_left")], K),
        _rows(sources, ~yes(F.col("recorded_sha256") == F.col("actual_sha256")), "source_hash_differs", "source", "error"),
    ]
    if report_verdicts is not None:
        j = decisions.select(K, F.col("verdict").alias("_v")).join(report_verdicts, K, "left")
        out.append(_rows(j, ~F.col("_v").eqNullSafe(F.col("verdict")), "report_verdict_differs", K, "error"))
    return union_findings(out)


def visual_closure(assets: DataFrame, reviews: DataFrame, lane: str = "strict") -> DataFrame:
    """Every figure is accounted for. ``assets``: project_id, asset_id, source_sha256, format_status, high_risk,
    asset_type. ``reviews``: project_id, asset_id, source_sha256, outcome, reason, review_complete, flagged,
    derivative_ok, alternative_ok, waived."""
    strict = F.lit(lane == "strict")
    inv = conservation(assets, reviews)
    j = reviews.drop("source_sha256").join(assets.drop("source_sha256"), [K, "asset_id"])
    sup = F.col("format_status") == "supported"
    o = F.col("outcome")
    no_reason = T.is_blank("reason")
    other = ~F.coalesce("derivative_ok", F.lit(False)) & ~F.coalesce("alternative_ok", F.lit(False))
    rules = [
        (sup & (o == "reviewed") & ~F.coalesce("review_complete", F.lit(False)), "review_evidence"),
        (sup & (o == "skipped") & no_reason, "skip_reason"),
        (sup & (o == "skipped") & strict & (F.col("asset_type") != "cover_decoration"), "strict_skip"),
        (sup & (o == "skipped") & (F.col("high_risk") | F.coalesce("flagged", F.lit(False))), "high_risk_skip"),
        (sup & ~o.isin("reviewed", "skipped"), "supported_outcome"),
        (~sup & (o != "unsupported"), "unsupported_outcome"),
        (~sup & no_reason, "unsupported_reason"),
        (~sup & F.col("high_risk") & other, "high_risk_derivative"),
        (~sup & ~F.col("high_risk") & strict & other, "strict_unsupported"),
        (~sup & ~F.col("high_risk") & ~strict & other & ~F.coalesce("waived", F.lit(False)), "unsupported_resolution"),
    ]
    return union_findings([
        inv.where("status <> 'conserved'").select(K, F.col("asset_id").alias("subject"), F.concat(F.lit("inventory_"), "status").alias("code"), F.lit("error").alias("kind")),
        validate(j, [(~bad, code) for bad, code in rules], "asset_id")])


def visual_counts(assets: DataFrame, reviews: DataFrame) -> DataFrame:
    """asset_total = reviewed + skipped + unsupported, with none unaccounted."""
    j = assets.select(K, "asset_id").join(reviews.select(K, "asset_id", "outcome"), [K, "asset_id"], "left")
    o = F.coalesce("outcome", F.lit(""))
    g = j.groupBy(K).agg(F.count(F.lit(1)).alias("asset_total"), *[F.count_if(o == x).alias(x) for x in ("reviewed", "skipped", "unsupported")])
    g = g.withColumn("unaccounted", F.col("asset_total") - F.col("reviewed") - F.col("skipped") - F.col("unsupported"))
    return g.withColumn("conserved", F.col("unaccounted") == 0)


def supervision(summaries: DataFrame, events: DataFrame, completed: DataFrame, minimum: int = 3, coverage_needed: float = 1.0) -> DataFrame:
    """``summaries``: project_id, status, passed, leader_role. ``completed``: project_id, task_id. ``events`` as in
    ``attempt_facts``; task ids are unique across projects."""
    life = task_lifecycle(events)
    c = completed.select(K, "task_id").distinct().join(life, "task_id", "left")
    g = c.groupBy(K).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "completed").alias("_ok"))
    j = summaries.join(g, K, "left").na.fill(0, ["_n", "_ok"])
    return union_findings([
        validate(j, [filled("status"), required("passed"), filled("leader_role"), (F.col("_n") >= minimum, "too_few_completed"),
                     (F.col("_ok") >= F.col("_n") * coverage_needed, "timing_coverage")], K),
        _rows(c, F.coalesce("status", F.lit("")) != "completed", "task_not_completed", "task_id", "error")])


# --- modes, slices, policies, readiness -----------------------------------------------------------


def apply_mode(results: DataFrame) -> DataFrame:
    """``results``: project_id, contract, mode, kind. off: ignored; shadow: would block; enforce: blocks."""
    bad = F.col("kind") == "error"
    d = results.where("mode <> 'off'").groupBy(K, "contract", "mode").agg(F.count_if(bad).alias("errors"), F.count_if(~bad & F.col("kind").isNotNull()).alias("candidates"))
    d = d.withColumn("would_block", F.col("errors") > 0)
    return d.withColumn("blocking", F.col("would_block") & (F.col("mode") == "enforce"))


def project_blocking(modes: DataFrame) -> DataFrame:
    return modes.groupBy(K).agg(F.bool_or("would_block").alias("would_block"), F.bool_or("blocking").alias("blocking"))


def slices(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """``manifest``: project_id, slice_id, agent. ``results``: project_id, slice_id, agent, status, has_findings, summary."""
    r = results.select(K, "slice_id", F.col("agent").alias("r_agent"), F.col("status").alias("r_status"), "has_findings", "summary")
    j = manifest.join(r, [K, "slice_id"], "left")
    gone = F.col("r_agent").isNull() & F.col("r_status").isNull()
    problem = (
        F.when(gone, "slice_missing").when(F.col("r_agent") != F.col("agent"), "wrong_owner").when(F.col("r_status") != "completed", "not_completed")
        .when(~F.coalesce("has_findings", F.lit(False)), "findings_missing").when(F.col("summary").isNull(), "summary_missing"))
    return j.select(K, "slice_id", "agent", problem.alias("problem")).where("problem is not null")


def policy_binding(manifests: DataFrame, version: str, policy_hash: str) -> DataFrame:
    """Manifests bound to another policy than the current one, which is one literal row."""
    bad_v, bad_h = ~F.col("policy_version").eqNullSafe(F.lit(version)), ~F.col("policy_hash").eqNullSafe(F.lit(policy_hash))
    return manifests.where(bad_v | bad_h).select(K, "policy_version", "policy_hash", F.when(bad_v, "version").otherwise("hash").alias("differs"))


def required_items(projects: DataFrame, files: DataFrame, lines: DataFrame, needed_files: list[str], needed_marks: list[str], code_counts: DataFrame | None = None,
                   risk_statement: str = "代码不可复现") -> DataFrame:
    """Required files and section marks, and the risk statement a project without code must make."""
    nf = projects.select(K, F.explode(F.array(*map(F.lit, needed_files))).alias("item"))
    a = nf.join(files.select(K, F.col("path").alias("item")).distinct(), [K, "item"], "left_anti").select(K, F.lit("file").alias("kind"), "item")
    from claimgrid.functions.keyed import matching

    have = matching(lines, [(F.col("text").contains(m), {"item": m}) for m in [*needed_marks, risk_statement]], [K]).distinct()
    nm = projects.select(K, F.explode(F.array(*map(F.lit, needed_marks))).alias("item"))
    b = nm.join(have, [K, "item"], "left_anti").select(K, F.lit("section").alias("kind"), "item")
    out = a.unionByName(b)
    if code_counts is not None:
        bare = code_counts.where("code = 0").select(K).join(have.where(F.col("item") == risk_statement), K, "left_anti")
        out = out.unionByName(bare.select(K, F.lit("code_risk").alias("kind"), F.lit(risk_statement).alias("item")))
    return out


def readiness(gates: DataFrame, gate_names: list[str]) -> DataFrame:
    """All gates of a project together, with the names of the failed ones. The gate list is literal, so the
    failed names are one flag per gate, not a collected list. ``gates``: project_id, gate, passed."""
    g = gates.groupBy(K).agg(*[F.bool_and(F.when(F.col("gate") == n, F.col("passed"))).alias(f"_g{i}") for i, n in enumerate(gate_names)])
    failed = F.concat_ws(",", *[F.when(~F.coalesce(f"_g{i}", F.lit(False)), n) for i, n in enumerate(gate_names)])
    return g.select(K, failed.alias("failed")).withColumn("ready", F.col("failed") == "")


# --- receipts -------------------------------------------------------------------------------------


def receipt_action(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """At-most-once delivery: send, skip or block each request by the latest receipt of its project.

    ``requests``: project_id, decision_sha256, body_sha256, channel. ``receipts``: the same and seq, status.
    """
    last = receipts.groupBy(K).agg(F.max(F.struct("seq", "status", "decision_sha256", "body_sha256", "channel")).alias("r"))
    j = requests.join(last, K, "left")
    same = (F.col("r.decision_sha256") == F.col("decision_sha256")) & (F.col("r.body_sha256") == F.col("body_sha256")) & (F.col("r.channel") == F.col("channel"))
    act = (
        F.when(F.col("r").isNull(), "send").when(~F.col("r.status").isin(V.RECEIPT_STATES), "block_invalid_status")
        .when((F.col("r.status") == "sent") & same, "skip_sent").when(F.col("r.decision_sha256") != F.col("decision_sha256"), "block_other_decision")
        .when(F.col("r.status").isin("pending", "unknown"), "block_unknown_state").when(F.col("r.status") == "sent", "block_other_body").otherwise("send"))
    return j.select(K, "decision_sha256", "body_sha256", "channel", act.alias("action"))
