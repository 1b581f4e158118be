"""Findings of independent review routes: linkage, clusters, votes and the arbitration queue."""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from claimgrid.functions import text as T
from claimgrid.functions.keyed import contains_join, keep_first
from claimgrid.functions.keys import cluster_key, finding_key, raw_finding_id, severity_rank
from claimgrid.functions.ordered import running_sum
from claimgrid.operators.extract import K
from claimgrid.operators import settle
from claimgrid.operators.predicates import evidence_complete
from claimgrid.rules import values as V
from claimgrid.session import cut

SPAN = 1 << 40  # room for positions inside one route
#: Findings of a project with at most so many meet as one list.
FEW_FINDINGS = 48
#: At most so many larger projects are broadcast.
LARGE_MAX = 10_000

cloudpickle.register_pickle_by_value(settle)  # executors need no copy of it


# --- votes ----------------------------------------------------------------------------------------


def majority(votes: DataFrame, keys: list[str], value: str, out: str = "majority") -> DataFrame:
    """Most frequent value; the smaller text wins a tie."""
    g = votes.where(~T.is_blank(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b")).select(*keys, F.col("_b.v").alias(out))


def disposition_votes(items: DataFrame, routes: list[str]) -> DataFrame:
    """Votes of the routes on each machine code. ``items``: project_id, agent, code, disposition,
    final_severity, auto_severity; one row per route and code (the last by text order counts)."""
    d = items.withColumn("code", T.norm_text("code")).where("code <> ''")
    d = keep_first(d.select(K, "code", "agent", "disposition", "final_severity", "auto_severity"), [K, "code", "agent"], ["disposition", "final_severity"])
    filled = F.nullif(F.col("disposition"), F.lit(""))
    g = d.groupBy(K, "code").agg(
        F.count(F.lit(1)).alias("support"), F.countDistinct(filled).alias("_kinds"), F.count(filled).alias("_votes"),
        F.max_by("final_severity", severity_rank("final_severity")).alias("_sev"), F.max("auto_severity").alias("auto_severity"),
        *[F.bool_or(F.col("agent") == r).alias(f"_r{i}") for i, r in enumerate(routes)])
    agree = (
        F.when((F.col("support") == len(routes)) & (F.col("_kinds") == 1) & (F.col("_votes") == F.col("support")), "consensus")
        .when((F.col("support") >= 2) & (F.col("_votes") > 0), F.when(F.col("_kinds") <= 2, "majority").otherwise("split")).otherwise("single"))
    missing = F.concat_ws(",", *[F.when(~F.col(f"_r{i}"), r) for i, r in enumerate(routes)])
    m = majority(d, [K, "code"], "disposition", "recommended_disposition")
    return g.select(K, "code", "auto_severity", "support", agree.alias("agreement"),
                    F.coalesce(F.nullif("_sev", F.lit("")), F.lit("INFO")).alias("recommended_severity"), missing.alias("missing_routes")).join(m, [K, "code"], "left")


def dimension_vote(votes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    g = votes.where(v.isNotNull()).groupBy(*keys).agg(F.count_if(v).alias("true_count"), F.count_if(~v).alias("false_count"))
    t, f = F.col("true_count"), F.col("false_count")
    agree = F.when(f == 0, "consensus_true").when(t == 0, "consensus_false").when(t > f, "majority_true").when(f > t, "majority_false").otherwise("split")
    return g.withColumn("agreement", agree).withColumn("recommended", F.when(t > f, True).when(f > t, False))


# --- clusters -------------------------------------------------------------------------------------


def classify_clusters(members: DataFrame, routes_total: int) -> DataFrame:
    """Class of each cluster. ``members``: project_id, cluster_id, agent, severity."""
    g = members.groupBy(K, "cluster_id").agg(F.countDistinct("agent").alias("agents"), F.countDistinct("severity").alias("severities"))
    a = F.col("agents")
    cls = (
        F.when((a == routes_total) & (F.col("severities") <= 1), "consensus").when(a >= routes_total - 1, "majority")
        .when(a == 1, "single").otherwise("divergent"))
    return g.withColumn("cluster_class", cls).withColumn("routes_total", F.lit(routes_total).cast("long"))


def convergence_metrics(classes: DataFrame) -> DataFrame:
    c, n = F.col("cluster_class"), F.count(F.lit(1))
    names = ["consensus", "majority", "single", "divergent"]
    g = classes.groupBy(K).agg(n.alias("clusters"), *[F.round(100.0 * F.count_if(c == x) / n, 1).alias(f"{x}_rate") for x in names])
    return g.withColumn("converged", (F.col("consensus_rate") >= 95) & (F.col("divergent_rate") < 5))


def arbitration_queue(members: DataFrame, routes_total: int) -> DataFrame:
    """Every cluster with route, worst severity and whether all members carry full evidence, in queue order."""
    cls = classify_clusters(members, routes_total)
    g = members.withColumn("_e", evidence_complete()).groupBy(K, "cluster_id").agg(
        F.max_by("severity", severity_rank("severity")).alias("severity"), F.bool_and("_e").alias("evidence_complete"))
    rank = reduce(lambda w, kv: F.when(F.col("cluster_class") == kv[0], kv[1]).otherwise(w), V.ROUTE_ORDER.items(), F.lit(9))
    q = cls.join(g, [K, "cluster_id"]).withColumn("queue_rank", rank)
    return q.select(K, "cluster_id", "cluster_class", "agents", "severity", "evidence_complete", "queue_rank").orderBy("queue_rank", K, "cluster_id")


# --- linkage --------------------------------------------------------------------------------------

SECTION_NO = r"\d+(?:\.\d+)*"


def _route_order(routes: list[str]) -> Column:
    return F.create_map(*[x for i, r in enumerate(routes) for x in (F.lit(r), F.lit(i))])


def position(ord_: str, agent: str, routes: list[str]) -> Column:
    """``pos`` of a prepared finding from its place in route and position order."""
    return F.col(ord_) - F.element_at(_route_order(routes), F.col(agent)).cast("long") * SPAN


def prepare(findings: DataFrame, routes: list[str]) -> DataFrame:
    """Normalised link fields and keys. ``findings``: project_id, agent, pos and the finding fields."""
    order = _route_order(routes)
    d = findings
    for c in ["id", "severity", "dimension", "location", "description", "evidence", "rule", "source_type", "source_path", "locator",
              "quote_or_value", "protected_category", *V.SEMANTIC_FIELDS]:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    key = F.nullif(T.norm_text("finding_key"), F.lit("")) if "finding_key" in findings.columns else F.lit(None).cast("string")
    d = d.withColumn("finding_key", F.coalesce(key, finding_key()))
    secs = F.regexp_extract_all(T.norm_lower("location"), F.lit(SECTION_NO), F.lit(0))
    cat = T.norm_lower("protected_category")
    sem = [T.norm_lower(f) for f in V.SEMANTIC_FIELDS]
    full = reduce(lambda a, b: a & b, [F.length(s) > 0 for s in sem])
    return d.select(
        K, "agent", "pos", (F.coalesce(F.element_at(order, F.col("agent")).cast("long"), F.raise_error(F.concat(F.lit("unknown route "), F.coalesce("agent", F.lit("null")))).cast("long")) * SPAN + F.col("pos")).alias("ord"), "severity", "description", *V.EVIDENCE_FIELDS, "finding_key",
        raw_finding_id().alias("raw_finding_id"), cluster_key().alias("cluster_key"), T.norm_lower("location").alias("_loc"),
        T.norm_text("dimension").alias("_dim"), T.norm_text("rule").alias("_rule"), T.tokens("description").alias("_tok"),
        F.when(cat.isin(V.PROTECTED_CATEGORIES), cat).otherwise("").alias("_cat"), F.array(*sem).alias("_sem"), full.alias("_full"),
        secs.alias("_secs"), F.array_max(F.transform(secs, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"].alias("_best"))


def _of(side: str | Column, field: str) -> Column:
    """A field of a finding, which is a column name or, inside a list, an element."""
    return F.col(f"{side}.{field}") if isinstance(side, str) else side[field]


def vetoed(a: str | Column, b: str | Column) -> Column:
    """Different protected categories, or a semantic field filled on both sides and unequal."""
    clash = F.exists(F.zip_with(_of(a, "_sem"), _of(b, "_sem"), lambda x, y: (x != "") & (y != "") & (x != y)), lambda z: z)
    return (_of(a, "_cat") != _of(b, "_cat")) | clash


def link_score(a: str | Column, b: str | Column) -> Column:
    """Location 0.4 / 0.25 / 0.2, dimension 0.2 (two blanks count), rule 0.2 (not blank), words 0.2 x Jaccard."""
    la, lb = _of(a, "_loc"), _of(b, "_loc")
    best, secs = _of(a, "_best"), _of(b, "_secs")
    # the first section of the right side that equals or encloses decides
    kinds = F.filter(
        F.transform(secs, lambda s: F.when(s == best, 0.4).when(best.startswith(F.concat(s, F.lit("."))) | s.startswith(F.concat(best, F.lit("."))), 0.25)),
        lambda k: k.isNotNull())
    loc = F.when((la == "") | (lb == ""), 0.0).when(la == lb, 0.4).when(
        best.isNotNull() & (F.size(secs) > 0), F.coalesce(F.get(kinds, F.lit(0)), F.lit(0.0))).when(la.contains(lb) | lb.contains(la), 0.2).otherwise(0.0)
    dim = F.when(_of(a, "_dim") == _of(b, "_dim"), 0.2).otherwise(0.0)
    rule = F.when((_of(a, "_rule") != "") & (_of(a, "_rule") == _of(b, "_rule")), 0.2).otherwise(0.0)
    ta, tb = _of(a, "_tok"), _of(b, "_tok")
    words = F.when((F.size(ta) > 0) & (F.size(tb) > 0), 0.2 * F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))).otherwise(0.0)
    return F.round(loc + dim + rule + words, 9)


def linked(a: str | Column, b: str | Column, threshold: float) -> Column:
    same = (_of(a, "_full") & _of(b, "_full") & (_of(a, "_sem") == _of(b, "_sem"))) | (_of(a, "finding_key") == _of(b, "finding_key"))
    return ~vetoed(a, b) & (same | (link_score(a, b) >= threshold))


LINK_FIELDS = ["agent", "ord", "finding_key", "raw_finding_id", "_loc", "_dim", "_rule", "_tok", "_cat", "_sem", "_full", "_secs", "_best"]


def _large(items: DataFrame) -> DataFrame | None:
    """Projects with too many findings for one list, or with positions outside their route; None: there are none."""
    odd = F.count_if(F.col("pos").between(0, SPAN - 1)) < F.count(F.lit(1))
    large = cut(items.where(F.col(K).isNotNull()).groupBy(K).agg(F.count(F.lit(1)).alias("_n"), odd.alias("_odd")).where((F.col("_n") > FEW_FINDINGS) | F.col("_odd")).select(K))
    if large.isEmpty():
        return None
    return F.broadcast(large) if large.limit(LARGE_MAX + 1).count() <= LARGE_MAX else large


def _met(items: DataFrame, threshold: float) -> DataFrame:
    """The findings of projects that are not large, each with the findings before it that it is linked to: project_id, b,
    _times (how many rows have its place), _links. Projects follow each other in a partition.

    All findings of a project are in one partition, so each is shuffled once, and is scored with those before it.
    """
    whole = Window.partitionBy(K).orderBy("b.ord").rowsBetween(Window.unboundedPreceding, -1)
    d = items.where(F.col(K).isNotNull()).select(K, F.struct(*LINK_FIELDS).alias("b")).repartition(K)
    d = d.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(K, "b.ord"))).withColumn("_before", F.collect_list(F.struct(*[F.col(f"b.{f}").alias(f) for f in LINK_FIELDS], "_times")).over(whole))
    b = F.col("b")
    met = F.filter("_before", lambda a: (a["agent"] != b["agent"]) & (a["ord"] < b["ord"]) & linked(a, b, threshold))
    links = F.transform(met, lambda a: F.struct(a["ord"].alias("ord"), a["agent"].alias("agent"), a["raw_finding_id"].alias("raw_finding_id"), a["_times"].alias("times"), link_score(a, b).alias("score")))
    return d.select(K, "b", "_times", links.alias("_links"))


def _check_threshold(threshold: float) -> None:
    if threshold < 0.4:
        raise ValueError("the blocks are complete for thresholds of 0.4 and more")


def link_pairs(items: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Verified links between findings of different routes; ``left_times`` and ``right_times``: how many rows have that place.

    Findings of a project with few meet as one list; in a large project they meet in blocks that no link can miss.
    """
    _check_threshold(threshold)
    large = _large(items)
    few = _met(items if large is None else items.join(large, K, "left_anti"), threshold).select(K, "b", "_times", F.explode("_links").alias("a"))
    few = few.select(K, F.col("a.ord").alias("left_ord"), F.col("b.ord").alias("right_ord"), F.col("a.agent").alias("left_agent"), F.col("b.agent").alias("right_agent"),
                     F.col("a.raw_finding_id").alias("left_id"), F.col("b.raw_finding_id").alias("right_id"), F.col("a.score").alias("score"), F.col("a.times").alias("left_times"), F.col("_times").alias("right_times")).distinct()
    if large is None:
        return few
    # written first, so that the shuffle files of the lists serve nothing any more when the blocks make theirs
    return cut(few).unionByName(_link_blocks(items.join(large, K, "left_semi"), threshold))


def _link_blocks(items: DataFrame, threshold: float) -> DataFrame:
    """``link_pairs`` for any number of findings of a project.

    A link of at least 0.4 needs one of: equal key, equal semantic tuple, equal location, an equal or
    enclosing section, a location inside the other, equal dimension and rule, or equal words together with
    an equal dimension or rule. Each of these is an equi-join; equal categories are part of every key. Keys are
    hashes, as every pair is verified, and a pair is scored under the smallest key it shares. Findings travel with the
    fields that a link needs and no others, and are written once, evenly dealt: otherwise each of the scans below would
    work out the fields again, for every use of one.
    """
    items = cut(items.select(K, *LINK_FIELDS).repartition(K, "ord").withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(K, "ord"))))
    x = F.struct(*LINK_FIELDS, "_times")
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("_best", r"\."))), lambda n: F.concat_ws(".", F.slice(F.split("_best", r"\."), F.lit(1), n)))

    def all_ups(secs: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(secs, lambda s: F.transform(
            F.sequence(F.lit(1), F.size(F.split(s, r"\."))), lambda n: F.concat_ws(".", F.slice(F.split(s, r"\."), F.lit(1), n))))))

    def keys(side: str) -> Column:
        sep = "\x1f"
        words = F.array_join(F.array_sort("_tok"), " ")
        out = [
            F.array(F.concat_ws(sep, F.lit("key"), "finding_key")),
            F.when(F.col("_full"), F.array(F.concat_ws(sep, F.lit("sem"), F.array_join("_sem", sep)))),
            F.when(F.col("_loc") != "", F.array(F.concat_ws(sep, F.lit("loc"), "_loc"))),
            F.when(F.col("_rule") != "", F.array(F.concat_ws(sep, F.lit("dr"), "_dim", "_rule"))),
            F.when(words != "", F.array(F.concat_ws(sep, F.lit("wd"), words, "_dim"), F.concat_ws(sep, F.lit("wr"), words, "_rule"))),
        ]
        if side == "left":
            out.append(F.when(F.col("_best").isNotNull(), F.array(F.concat_ws(sep, F.lit("s1"), "_best"))))
            out.append(F.when(F.col("_best").isNotNull(), F.transform(ups, lambda u: F.concat_ws(sep, F.lit("s2"), u))))
        else:
            out.append(F.transform(all_ups("_secs"), lambda u: F.concat_ws(sep, F.lit("s1"), u)))
            out.append(F.transform("_secs", lambda u: F.concat_ws(sep, F.lit("s2"), u)))
        empty = F.array().cast("array<string>")
        every = F.flatten(F.array(*[F.coalesce(o, empty) for o in out]))
        return F.array_distinct(F.transform(every, lambda k: F.xxhash64(F.col("_cat"), k)))

    left = items.select(K, x.alias("a"), keys("left").alias("_ka")).withColumn("_k", F.explode("_ka"))
    right = items.select(K, x.alias("b"), keys("right").alias("_kb")).withColumn("_k", F.explode("_kb"))
    near = left.join(right, [K, "_k"]).where("a.agent <> b.agent and a.ord < b.ord").where(F.col("_k") == F.array_min(F.array_intersect("_ka", "_kb"))).select(K, "a", "b")
    # one location inside the other, where one of them at least has no section number
    located = items.where(F.col("_loc") != "").select(K, "_loc", F.col("_best").isNull().alias("_bare"), x.alias("x"))
    bare = located.where("_bare")

    def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
        return contains_join(outer.select(K, "_loc", F.col("x").alias("p")), "_loc", inner.select(K, F.col("_loc").alias("_in"), F.col("x").alias("q")), "_in", [K]).select(K, "p", "q")

    inside = within(located, bare).unionByName(within(bare, located.where("not _bare")))
    inside = inside.select(K, F.when(F.col("p.ord") < F.col("q.ord"), F.col("p")).otherwise(F.col("q")).alias("a"),
                           F.when(F.col("p.ord") < F.col("q.ord"), F.col("q")).otherwise(F.col("p")).alias("b")).where("a.agent <> b.agent")
    ok = near.unionByName(inside).where(linked("a", "b", threshold))
    return ok.select(K, F.col("a.ord").alias("left_ord"), F.col("b.ord").alias("right_ord"), F.col("a.agent").alias("left_agent"), F.col("b.agent").alias("right_agent"),
                     F.col("a.raw_finding_id").alias("left_id"), F.col("b.raw_finding_id").alias("right_id"), link_score("a", "b").alias("score"), F.col("a._times").alias("left_times"), F.col("b._times").alias("right_times")).distinct()


def _rank_pair(units: DataFrame, key: str, routes: list[str]) -> DataFrame:
    """Merge units that share a key under which everything is linked: the i-th unit without a route takes the
    i-th single finding of that route. Linear in the block, whatever its size."""
    for s in routes[1:]:
        u = units.where(F.col(key).isNotNull())
        lacking = u.where(~F.array_contains("agents", s))
        single = u.where((F.size("agents") == 1) & F.array_contains("agents", s))
        a = running_sum(lacking.select(K, key, "uid"), [K, key], "uid", F.lit(1), "_n")
        b = running_sum(single.select(K, key, F.col("uid").alias("joins")), [K, key], "joins", F.lit(1), "_n")
        units = _merge(units, a.join(b, [K, key, "_n"]).select(K, "uid", "joins"))
    return units


def _merge(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Move each joining unit into the unit it joins; a key stays where both agree on it."""
    to = units.join(pairs.select(K, F.col("joins").alias("uid"), F.col("uid").alias("_to")), [K, "uid"], "left")
    g = to.withColumn("uid", F.coalesce("_to", "uid")).drop("_to")
    rest = [c for c in units.columns if c not in (K, "uid", "agents", "members")]
    out = g.groupBy(K, "uid").agg(
        F.array_sort(F.flatten(F.collect_list("agents"))).alias("agents"), F.array_sort(F.flatten(F.collect_list("members"))).alias("members"),
        *[F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c)).alias(c) for c in rest])
    return cut(out)


def cluster_findings(findings: DataFrame, routes: list[str], threshold: float = 0.4, rounds: list[str] | None = None) -> DataFrame:
    """Clusters of findings across routes: at most one finding per route, every pair of members linked.

    Strong evidence is settled first: equal key, equal semantic tuple, equal location, equal dimension and
    rule, each with equal category and semantic fields, so that all findings under one key are linked and
    can be paired by rank without listing pairs. What is left is linked by scored pairs, which are built among
    findings of clusters that still lack a route; a cluster takes the first finding, in route and position order,
    that every member is linked to.
    A unit holds at most one finding per route, so its member list is as long as the route list.
    Output: project_id, cluster_id, agent, pos, raw_finding_id, severity, match_mode and evidence fields.
    A project with few findings takes all these steps at once, in one task; only large projects are settled in rounds over
    all of them. ``rounds``, if given, receives the name of the route for each of their rounds of scored matching.
    """
    _check_threshold(threshold)
    items = prepare(findings, routes)
    large = _large(items)
    few = _clusters_at_once(items if large is None else items.join(large, K, "left_anti"), routes, threshold)
    return few if large is None else few.unionByName(_clusters_in_rounds(items.join(large, K, "left_semi"), routes, threshold, rounds))


def _strong_keys(side: str = "") -> list[Column]:
    """The keys under which all findings are linked; null where a finding has none."""
    sep = "\x1f"
    cat, sem, key, loc, dim, rule, full = (F.col(side + c) for c in ("_cat", "_sem", "finding_key", "_loc", "_dim", "_rule", "_full"))
    sig = F.concat_ws(sep, cat, F.array_join(sem, sep))
    return [F.concat_ws(sep, key, sig).alias("_k1"), F.when(full, sig).alias("_k2"), F.when(loc != "", F.concat_ws(sep, loc, sig)).alias("_k3"), F.when(rule != "", F.concat_ws(sep, dim, rule, sig)).alias("_k4")]


def _with_findings(clusters: DataFrame, items: DataFrame) -> DataFrame:
    return clusters.join(items.select(K, "ord", "agent", "pos", "raw_finding_id", "finding_key", "severity", *V.EVIDENCE_FIELDS), [K, "ord"]).drop("ord")


def _clusters_at_once(items: DataFrame, routes: list[str], threshold: float) -> DataFrame:
    """Clusters of the projects that are not large: findings are shuffled once, and only their clusters are joined with them."""
    link = [F.transform("_links", lambda a: a["ord"]).alias("_ords"), F.transform("_links", lambda a: F.xxhash64(a["agent"], a["raw_finding_id"], "b.agent", "b.raw_finding_id", a["score"])).alias("_names")]
    met = _met(items, threshold).select(K, "b.ord", "b.agent", *_strong_keys("b."), *link)
    schema = StructType().add(K, items.schema[K].dataType).add("ord", LongType()).add("cluster_id", LongType()).add("match_mode", StringType())
    return _with_findings(met.mapInArrow(settle.settled(routes, to_arrow_schema(schema)), schema), items)


def _clusters_in_rounds(items: DataFrame, routes: list[str], threshold: float, rounds: list[str] | None) -> DataFrame:
    """Clusters of projects with any number of findings."""
    items = cut(items)
    units = items.select(K, F.col("ord").alias("uid"), F.array("agent").alias("agents"), F.array("ord").alias("members"), *_strong_keys())
    closed = []
    for key, mode in (("_k1", "exact"), ("_k2", "semantic_tuple"), ("_k3", "location"), ("_k4", "rule")):
        units = _rank_pair(units, key, routes)
        if mode == "exact":
            # clusters of equal keys are complete; only findings that stayed alone go on
            closed.append(units.where(F.size("agents") > 1).select(K, "uid", "members", F.lit(mode).alias("match_mode")))
            units = units.where(F.size("agents") == 1)
    lacking = units.where(F.size("agents") < len(routes)).select(K, F.explode("members").alias("ord"))
    edges = cut(link_pairs(items.join(lacking, [K, "ord"], "left_semi"), threshold).select(K, "left_ord", "right_ord", "left_agent", "right_agent"))
    for s in routes[1:]:
        units = _scored_stage(units, edges, s, rounds)
    done = units.select(K, "uid", "members", F.when(F.size("members") > 1, "similarity").otherwise("single").alias("match_mode"))
    every = reduce(lambda a, b: a.unionByName(b), [*closed, done])
    return _with_findings(every.select(K, F.col("uid").alias("cluster_id"), "match_mode", F.explode("members").alias("ord")), items)


def _scored_stage(units: DataFrame, edges: DataFrame, s: str, rounds: list[str] | None = None) -> DataFrame:
    """Let units without route ``s`` take single findings of it that all their members are linked to."""
    e = edges.where(F.col("right_agent") == s).select(K, F.col("left_ord").alias("m"), F.col("right_ord").alias("v")).unionByName(
        edges.where(F.col("left_agent") == s).select(K, F.col("right_ord").alias("m"), F.col("left_ord").alias("v")))
    lacking = units.where(~F.array_contains("agents", s)).select(K, "uid", F.size("members").alias("_need"), F.explode("members").alias("m"))
    single = units.where((F.size("agents") == 1) & F.array_contains("agents", s)).select(K, F.col("uid").alias("v"))
    cand = lacking.join(e, [K, "m"]).join(single, [K, "v"], "left_semi").groupBy(K, "uid", "v").agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
    taken = first_come(cut(cand.where("_n = _need").select(K, "uid", "v")), s, rounds)
    return units if taken is None else _merge(units, taken.select(K, "uid", F.col("v").alias("joins")))


def _whole_blocks(open_: DataFrame) -> DataFrame:
    """Pairs of blocks in which every unit may take every finding and nothing else: the i-th unit takes the i-th finding.

    Two units of a block have the same number and the same mixture of candidates. The mixture is a hash; that a block is
    whole is decided by counts, so equal hashes of different candidates do no harm.
    """
    def side(own: str, other: str) -> DataFrame:
        return open_.groupBy(K, own).agg(F.count(F.lit(1)).alias(f"_d_{own}"), F.bit_xor(F.xxhash64(F.col(other))).alias(f"_s_{own}"))

    e = open_.join(side("uid", "v"), [K, "uid"]).join(side("v", "uid"), [K, "v"])
    block = [K, "_s_uid", "_s_v"]
    per = e.groupBy(*block).agg(F.count(F.lit(1)).alias("_e"), F.count_distinct("uid").alias("_nu"), F.count_distinct("v").alias("_nv"),
                                F.max("_d_uid").alias("_du"), F.max("_d_v").alias("_dv"))
    whole = per.where("_e = _nu * _nv and _du = _nv and _dv = _nu").select(*block)
    inside = cut(e.join(whole, block, "left_semi").select(*block, "uid", "v"))
    a = running_sum(inside.select(*block, "uid").distinct(), block, "uid", F.lit(1), "_n")
    b = running_sum(inside.select(*block, "v").distinct(), block, "v", F.lit(1), "_n")
    return a.join(b, [*block, "_n"], "full").select(K, "uid", "v")


def first_come(open_: DataFrame, name: str = "", rounds: list[str] | None = None) -> DataFrame | None:
    """Matching of units with findings: going through the units in order, each takes its first free finding.

    Each round settles whole blocks by rank, and takes every pair that is the first of both its ends; then both ends
    leave. Blocks of copies, which alone would need a round for each copy, go in one round.
    """
    taken = None
    while not open_.isEmpty():
        if rounds is not None:
            rounds.append(name)
        blocks = cut(_whole_blocks(open_))
        rest = open_.join(blocks.where("uid is not null").select(K, "uid"), [K, "uid"], "left_anti").join(blocks.where("v is not null").select(K, "v"), [K, "v"], "left_anti")
        fu = rest.groupBy(K, "uid").agg(F.min("v").alias("v"))
        fv = rest.groupBy(K, "v").agg(F.min("uid").alias("uid"))
        first = fu.join(fv, [K, "uid", "v"], "left_semi").select(K, "uid", "v")
        now = cut(blocks.where("uid is not null and v is not null").unionByName(first))
        taken = now if taken is None else taken.unionByName(now)
        open_ = cut(rest.join(now.select(K, "uid"), [K, "uid"], "left_anti").join(now.select(K, "v"), [K, "v"], "left_anti"))
    return taken
