"""Set comparison, revisions, referential integrity and the binding of reports to decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.keyed import contains_join, keep_first
from claimgrid.functions.keys import severity_rank
from claimgrid.operators.extract import K
from claimgrid.rules import values as V
from claimgrid.session import cut


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All check outputs as one stream of findings."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def severity_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank("severity").desc(), F.col("line").asc_nulls_last())


# --- revisions ------------------------------------------------------------------------------------


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """added / removed / changed / unchanged by content hash."""
    o = old.select(*keys, F.col(content).alias("_old"))
    n = new.select(*keys, F.col(content).alias("_new"))
    d = o.join(n, keys, "full_outer")
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged"))
    return d.select(*keys, status.alias("status"))


def item_diff(old: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Items only in the new revision and only in the old one; an item with a null is equal to none.

    Both revisions meet in one aggregation, so that a task holds one table of its items and can spill it."""
    side = lambda d, new: d.select(*cols, F.lit(new).alias("_new"))
    g = side(new, True).unionByName(side(old, False)).groupBy(*cols).agg(F.bool_or("_new").alias("_n"), F.bool_or(~F.col("_new")).alias("_o"))
    whole = reduce(lambda w, c: w & F.col(c).isNotNull(), cols, F.lit(True))
    both = F.col("_n") & F.col("_o")
    change = F.when(both & whole, F.array().cast("array<string>")).when(both, F.array(F.lit("added"), F.lit("removed"))).when(F.col("_n"), F.array(F.lit("added"))).otherwise(F.array(F.lit("removed")))
    return g.select(*cols, F.explode(change).alias("change"))


def coverage(raw: DataFrame, disposed: DataFrame, keys: list[str]) -> DataFrame:
    """Raw findings without a disposition and dispositions without a raw finding."""
    r, d = raw.select(*keys).distinct(), disposed.select(*keys).distinct()
    return r.join(d, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        d.join(r, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def intersection_size(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Items two lists share, counted per key after de-duplication."""
    both = a.select(*keys, item).distinct().join(b.select(*keys, item).distinct(), [*keys, item], "left_semi")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"))


def intersection_vs_claim(a: DataFrame, b: DataFrame, keys: list[str], item: str, claims: DataFrame) -> DataFrame:
    n = intersection_size(a, b, keys, item)
    d = claims.join(n, keys, "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    return d.withColumn("agrees", F.col("shared") == F.col("claimed"))


def merge_members(parts: list[DataFrame], cols: list[str]) -> DataFrame:
    return reduce(lambda x, y: x.union(y), [p.select(*cols) for p in parts]).distinct()


# --- integrity ------------------------------------------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def broken_links(links: DataFrame, headings: DataFrame, files: DataFrame) -> DataFrame:
    """Anchors without a heading of that slug, local targets without a file."""
    slugs = headings.select(K, T.heading_slug("title").alias("slug")).distinct()
    local = links.where(~F.col("target").rlike(r"^(?i)(https?:|mailto:)"))
    anchors = local.where(F.col("target").startswith("#")).withColumn("slug", T.heading_slug(F.expr("substr(target, 2)")))
    a = anchors.join(slugs, [K, "slug"], "left_anti").select(K, "line", "target", F.lit("anchor").alias("problem"))
    paths = local.where(~F.col("target").startswith("#")).withColumn("path", F.regexp_replace("target", r":\d+$", ""))
    p = paths.join(files.select(K, "path").distinct(), [K, "path"], "left_anti").select(K, "line", "target", F.lit("path").alias("problem"))
    return a.unionByName(p).withColumn("severity", F.when(F.col("problem") == "path", "error").otherwise("warning"))


def duplicate_keys(canonical: DataFrame) -> DataFrame:
    """What makes canonical findings duplicates of each other: project_id, canonical_id, reason, shared_key.

    Findings share an evidence reference, or both error mechanism and repair path.
    ``canonical``: project_id, canonical_id, refs (array of path/locator), error_mechanism, repair_path.
    """
    ref = canonical.select(K, "canonical_id", F.explode("refs").alias("r"))
    p = F.lower(F.replace(F.trim("r.path"), F.lit("\\"), F.lit("/")))
    p = F.when(p.endswith("/report_text.txt"), "report_text.txt").otherwise(p)
    loc = F.lower(F.trim("r.locator"))
    keyed = ref.where((F.length(p) > 0) & (F.length(loc) > 0)).select(K, "canonical_id", F.lit("shared_evidence").alias("reason"), F.concat_ws("\x1f", p, loc).alias("shared_key"))
    m, x = T.norm_lower("error_mechanism"), T.norm_lower("repair_path")
    same = canonical.where((F.length(m) > 0) & (F.length(x) > 0)).select(K, "canonical_id", F.lit("same_root_and_repair").alias("reason"), F.concat_ws("\x1f", m, x).alias("shared_key"))
    return keyed.unionByName(same).where(~T.is_blank("canonical_id")).distinct()


def duplicate_candidates(canonical: DataFrame) -> DataFrame:
    """Each group of equal ``duplicate_keys`` as a star around its smallest id: a group of n findings gives n-1 rows, not
    all its pairs, and merging along the rows merges the whole group."""
    both = duplicate_keys(canonical)
    centre = both.groupBy(K, "reason", "shared_key").agg(F.min("canonical_id").alias("centre"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    d = both.join(centre, [K, "reason", "shared_key"]).where("canonical_id <> centre")
    return d.groupBy(K, F.col("centre").alias("left_id"), F.col("canonical_id").alias("right_id"), "reason").agg(F.max("group_size").alias("group_size"))


def match_rows_issues(rows: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, unmatched rows, orphan issues). A row names the issue, else shares a reference with it,
    else one title holds the other. ``rows``: project_id, row_id, title, refs, issue_id; ``issues``:
    project_id, issue_id, title, refs."""
    by_id = rows.where(~T.is_blank("issue_id")).join(issues.select(K, "issue_id"), [K, "issue_id"], "left_semi").select(K, "row_id", "issue_id")
    rest = rows.join(by_id.select(K, "row_id"), [K, "row_id"], "left_anti")
    ri = issues.select(K, "issue_id", F.explode("refs").alias("ref"))
    by_ref = rest.select(K, "row_id", F.explode("refs").alias("ref")).join(ri, [K, "ref"]).select(K, "row_id", "issue_id").distinct()
    rt = rest.select(K, "row_id", F.lower(F.trim("title")).alias("rt")).where("rt <> ''")
    it = issues.select(K, "issue_id", F.lower(F.trim("title")).alias("it")).where("it <> ''")
    down = contains_join(rt, "rt", it, "it", [K]).select(K, "row_id", "issue_id")
    up = contains_join(it, "it", rt, "rt", [K]).select(K, "row_id", "issue_id")
    matches = cut(by_id.union(by_ref).union(down).union(up).distinct())  # read three times
    return matches, rows.join(matches, [K, "row_id"], "left_anti"), issues.join(matches, [K, "issue_id"], "left_anti")


def suggest(findings: DataFrame, actions=V.SUGGESTED_ACTIONS) -> DataFrame:
    """Action for each check id by its longest known prefix, one row per check id."""
    out = None
    for prefix, action, safe in sorted(actions, key=lambda a: -len(a[0])):
        s = F.struct(F.lit(action).alias("action"), F.lit(safe).alias("autofix_safe"))
        out = F.when(F.col("check_id").startswith(prefix), s) if out is None else out.when(F.col("check_id").startswith(prefix), s)
    out = out.otherwise(F.struct(F.lit("complete_content").alias("action"), F.lit(False).alias("autofix_safe")))
    first = keep_first(findings.select("check_id", "severity", "message"), ["check_id"], ["severity", "message"])
    return first.withColumn("s", out).select("check_id", "severity", "message", "s.action", "s.autofix_safe")


def autofix_rows(lines: DataFrame, findings: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Before and after of each line a safe fix would change. ``findings``: project_id, line, check_id, term."""
    d = lines.join(findings, [K, "line"])
    c = F.col("check_id")
    fixed = (
        F.when(c.startswith("markdown:placeholder:"), F.trim(F.replace("text", F.col("term"), F.lit(""))))
        .when(c.startswith("markdown:empty_section:"), F.lit(""))
        .when(c.startswith("markdown:heading_jump:"), T.demote_heading("text"))
        .when(c.startswith("terminology:forbidden:"), T.replace_terms("text", terms)))
    return d.select(K, "line", "check_id", F.col("text").alias("original"), fixed.alias("replacement")).where("replacement is not null and replacement <> original")


# --- report binding -------------------------------------------------------------------------------


def concrete(c) -> Column:
    n = F.lower(T.norm_text(c))
    return ~n.isin(V.CROSSWALK_EMPTY) & ~T.norm_text(c).rlike(V.CROSSWALK_REFERENCE)


def report_binding(report: DataFrame, crosswalk: DataFrame, canonical: DataFrame, sources: DataFrame, dispositions: DataFrame,
                   revoked: DataFrame | None = None) -> DataFrame:
    """Errors between the formal report and the decision it is bound to.

    ``report``: project_id, report_id, severity, description, location, evidence, repair.
    ``crosswalk``: project_id, key, report_id, locator, problem, location, evidence, repair.
    ``canonical``: project_id, canonical_id, severity. ``sources``: project_id, canonical_id,
    raw_finding_id. ``dispositions``: project_id, raw_finding_id, finding_key, decision.
    """
    def err(d: DataFrame, code: str, subject: str) -> DataFrame:
        return d.select(K, F.lit(code).alias("error"), F.col(subject).cast("string").alias("subject"))

    disp = keep_first(dispositions.select(K, "raw_finding_id", "finding_key", "decision"), [K, "raw_finding_id"], ["decision", "finding_key"])
    cw = crosswalk.where(~T.is_blank("key"))
    cw1 = keep_first(cw.select(K, "key", "report_id", "locator", "problem", "location", "evidence", "repair"), [K, "key"], ["report_id"])
    out = [
        err(report.groupBy(K, "report_id").count().where("count > 1"), "report_id_repeated", "report_id"),
        err(cw.groupBy(K, "key").agg(F.countDistinct("report_id").alias("n")).where("n > 1"), "key_maps_to_many", "key"),
        err(canonical.join(sources, [K, "canonical_id"], "left_anti"), "canonical_without_source", "canonical_id"),
    ]
    src = sources.join(canonical.select(K, "canonical_id", "severity"), [K, "canonical_id"]).join(disp, [K, "raw_finding_id"], "left")
    retained = src.where("decision is not null and decision <> 'reject'")
    out.append(err(src.where("decision is null or decision = 'reject'"), "source_not_retained", "raw_finding_id"))
    keyed = retained.withColumn("key", T.first_filled("finding_key", "canonical_id"))
    out.append(err(keyed.join(cw1, [K, "key"], "left_anti").select(K, "canonical_id").distinct(), "canonical_without_crosswalk", "canonical_id"))
    mapped = keyed.join(cw1, [K, "key"])
    fields = mapped.select(K, "key", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in V.CROSSWALK_FIELDS])).alias("x"))
    out.append(err(fields.where(~concrete("x.v")).withColumn("s", F.concat_ws("/", "key", "x.f")).distinct(), "field_not_concrete", "s"))
    out.append(err(fields.where(concrete("x.v") & (F.length("x.v") > V.CROSSWALK_CHARS_MAX)).withColumn("s", F.concat_ws("/", "key", "x.f")).distinct(), "field_too_long", "s"))
    out.append(err(mapped.where(F.upper(F.trim("locator")) != F.col("report_id")).select(K, "key").distinct(), "locator_not_target", "key"))
    one = mapped.groupBy(K, "canonical_id").agg(F.countDistinct("report_id").alias("n"), F.min("report_id").alias("report_id"), F.min("severity").alias("severity"))
    out.append(err(one.where("n > 1"), "canonical_maps_to_many", "canonical_id"))
    bound = one.where("n = 1")
    rep1 = keep_first(report.select(K, "report_id", F.col("severity").alias("r_severity"), "description", "location", "evidence", "repair"), [K, "report_id"], ["r_severity"])
    out.append(err(bound.join(rep1, [K, "report_id"], "left_anti"), "report_row_missing", "report_id"))
    both = bound.join(rep1, [K, "report_id"])
    out.append(err(both.where(F.upper("r_severity") != F.upper("severity")), "severity_differs", "report_id"))
    out.append(err(both.where(T.is_blank("description") | T.is_blank("repair")), "report_field_blank", "report_id"))
    out.append(err(both.where(T.is_blank("location") & T.is_blank("evidence")), "locator_blank", "report_id"))
    out.append(err(rep1.join(bound.select(K, "report_id").distinct(), [K, "report_id"], "left_anti"), "report_row_unbound", "report_id"))
    loose = cw1.join(canonical.select(K, F.col("canonical_id").alias("key")), [K, "key"], "left_anti")
    by_key = dispositions.where(~T.is_blank("finding_key")).groupBy(K, F.col("finding_key").alias("key")).agg(F.bool_or(F.col("decision") == "reject").alias("rejected"))
    judged = loose.join(by_key, [K, "key"], "left")
    out.append(err(judged.where("rejected is null"), "key_without_disposition", "key"))
    out.append(err(judged.where("rejected"), "rejected_key_in_report", "key"))
    if revoked is not None:
        out.append(err(cw1.join(revoked.select(K, "key").distinct(), [K, "key"], "left_semi"), "revoked_key_in_report", "key"))
    return reduce(lambda a, b: a.unionByName(b), out)


def report_counts_match(report: DataFrame, decision: DataFrame) -> DataFrame:
    """Severity counts of the report rows against those of the decision."""
    r = keep_first(report, [K, "report_id"], ["severity"]).groupBy(K, F.upper("severity").alias("severity")).agg(F.count(F.lit(1)).alias("in_report"))
    d = r.join(decision.select(K, "severity", "in_decision"), [K, "severity"], "full_outer")
    zero = F.lit(0).cast("long")
    return d.select(K, "severity", F.coalesce("in_report", zero).alias("in_report"), F.coalesce("in_decision", zero).alias("in_decision")).where("in_report <> in_decision")
