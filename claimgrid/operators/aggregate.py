"""Grouped rules: counts, votes, completeness, coverage and scores per project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.keyed import keep_first, matching, samples
from claimgrid.functions.keys import severity_rank
from claimgrid.functions.numbers import first_number, level_affirmative, level_score, number, p_significant, percent_in_parens
from claimgrid.functions.ordered import previous_row
from claimgrid.operators.extract import K
from claimgrid.rules import values as V

N = F.count


def n_if(cond) -> Column:
    return F.count_if(cond)


# --- findings -------------------------------------------------------------------------------------


def severity_counts(findings: DataFrame, keys: list[str] = [K]) -> DataFrame:
    return findings.groupBy(*keys).agg(*[n_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES])


def quality_gate(counts: DataFrame, limits=V.GATE_LIMITS) -> DataFrame:
    breach = None
    for s, limit in limits.items():
        hit = F.col(s) > limit
        breach = F.when(hit, s) if breach is None else breach.when(hit, s)
    advice = F.when(F.col("FATAL") > 0, "review_fatal_first").when(F.col("CRITICAL") > limits["CRITICAL"], "review_critical_first").otherwise("regular_review")
    return counts.withColumn("first_breach", breach).withColumn("passed", F.col("first_breach").isNull()).withColumn("recommendation", advice)


def score_band(counts: DataFrame) -> DataFrame:
    """Upper score limit and verdict from the severity counts."""
    f, c, m = F.col("FATAL"), F.col("CRITICAL"), F.col("MAJOR")
    cap = F.when(f > 0, 30).when(c >= 3, 50).when(c > 1, 69).when((c == 1) | (m > 2), 84).otherwise(100)
    verdict = F.when((f > 0) | (c >= 5), "fail").when(c > 1, "major_revision").when((c == 1) | (m > 2), "conditional").otherwise("pass")
    return counts.withColumn("max_score", cap).withColumn("verdict", verdict)


def error_rating(counts: DataFrame, errors: str = "errors") -> DataFrame:
    e = F.col(errors)
    return counts.withColumn("rating", F.when(e == 0, "good").when(e <= 5, "minor").when(e <= 15, "revise").otherwise("serious"))


def fusion(findings: DataFrame) -> DataFrame:
    """Targets that two or more independent checks point at. Targets: the module without its number, and the path."""
    targets = F.array_compact(F.array(F.nullif(T.module_label("module"), F.lit("")), F.nullif(F.col("path"), F.lit(""))))
    d = findings.select(K, "check_id", F.explode(targets).alias("target"))
    g = d.groupBy(K, "target").agg(F.countDistinct("check_id").alias("checks"), N(F.lit(1)).alias("findings")).where("checks >= 2")
    kind = F.when(F.col("target").rlike(r"[/\\.]"), "file").otherwise("module")
    high = F.col("checks") >= 3
    return g.withColumn("target_type", kind).withColumn("confidence", F.when(high, "HIGH").otherwise("MEDIUM")).withColumn(
        "severity_boost", F.when(high, "CRITICAL").otherwise("MAJOR"))


def max_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    known = F.when(severity_rank("severity") > 0, F.col("severity")).otherwise("INFO")
    return findings.groupBy(*keys).agg(F.max_by(known, severity_rank("severity")).alias("max_severity"))


def count_reconcile(issues: DataFrame, dashboard: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Severity counts shown on a dashboard against the parsed entries (each id once), and a reject verdict
    with no counted entry. ``dashboard``: project_id, severity, shown."""
    one = keep_first(issues.where(F.col("severity").isin(V.SEVERITIES)), [K, "issue_id"], ["severity"])
    parsed = one.groupBy(K, "severity").agg(N(F.lit(1)).alias("parsed"))
    d = parsed.join(dashboard, [K, "severity"], "full_outer")
    zero = F.lit(0).cast("long")
    d = d.select(K, "severity", F.coalesce("parsed", zero).alias("parsed"), F.coalesce("shown", zero).alias("shown"))
    bad = d.where("parsed <> shown").withColumn("problem", F.lit("count_differs"))
    if verdicts is None:
        return bad
    total = d.groupBy(K).agg(F.sum("shown").alias("_all"))
    rej = verdicts.where(T.any_contains(F.col("verdict"), V.REJECT_WORDS)).select(K).join(total, K, "left").where("coalesce(_all, 0) = 0")
    return bad.unionByName(rej.select(K, F.lit(None).cast("string").alias("severity"), zero.alias("parsed"), zero.alias("shown"), F.lit("reject_without_issue").alias("problem")))


def depth_checks(block_lines: DataFrame, labels: list[str], limit: int = V.DEPTH_LIMIT) -> DataFrame:
    """Report depth: at most five core blocks, every block has child errors, every child has its labels and a locator.

    ``block_lines`` comes from ``issue_blocks``. Labels are found line by line and joined by ``bool_or``,
    so the text of a block is never gathered.
    """
    core = F.col("issue_id").startswith("P")
    blocks = block_lines.groupBy(K, "issue_id").agg(n_if("is_child_heading").alias("children"))
    many = blocks.where(core).groupBy(K).agg(N(F.lit(1)).alias("n")).where(F.col("n") > limit)
    out = [
        many.select(K, F.lit("core_issue_limit").alias("check"), F.lit("").alias("issue_id"), F.lit("").alias("label")),
        blocks.where("children = 0").select(K, F.lit("child_errors").alias("check"), "issue_id", F.lit("").alias("label")),
    ]
    t = F.col("text")

    def label_on(lab: str) -> Column:
        return t.rlike(rf"^[^\S\r\n]*(?:-[^\S\r\n]*)?\*\*{lab}\*\*[^\S\r\n]*[:：][^\S\r\n]*\S")

    loc = t.rlike(r"\*\*原报告位置\*\*\s*[:：].*\.docx?") & t.rlike(r"[>＞]|第\s*\d+\s*页|图\s*\d+|表\s*\d+|[“\"《]")
    child = block_lines.where("child_no is not null").groupBy(K, "issue_id", "child_no").agg(
        *[F.bool_or(label_on(lab)).alias(f"l{i}") for i, lab in enumerate(labels)], F.bool_or(loc).alias("_loc"))
    cid = F.concat_ws(".", "issue_id", F.col("child_no").cast("string"))
    rules = [(~F.col(f"l{i}"), {"check": "child_field", "label": lab}) for i, lab in enumerate(labels)]
    rules.append((~F.col("_loc"), {"check": "child_locator", "label": ""}))
    bad = matching(child.withColumn("issue_id", cid), rules, [K, "issue_id"]).select(K, "check", "issue_id", "label")
    return reduce(lambda a, b: a.unionByName(b), [*out, bad])


def lint_summary(checks: DataFrame, ignored_prefixes: list[str], error_prefixes: list[str]) -> DataFrame:
    def starts(prefixes: list[str]) -> Column:
        c = F.lit(False)
        for p in prefixes:
            c = c | F.col("check_id").startswith(p)
        return c

    sev = F.when((F.col("severity") == "warning") & starts(error_prefixes), "error").otherwise(F.col("severity"))
    bad = ~F.col("passed")
    d = checks.withColumn("_s", sev)
    ignored = bad & (F.col("_s") == "warning") & starts(ignored_prefixes)
    g = d.groupBy(K).agg(
        n_if(bad & (F.col("_s") == "error")).alias("errors"), n_if(bad & (F.col("_s") == "warning") & ~ignored).alias("warnings"), n_if(ignored).alias("ignored"))
    return g.withColumn("passed", F.col("errors") == 0)


def summary(findings: DataFrame) -> DataFrame:
    """Totals by priority and status with their subtotals."""
    return findings.rollup("priority", "status").agg(N(F.lit(1)).alias("n"))


# --- files and modules ----------------------------------------------------------------------------


def file_kind(path="path") -> Column:
    e = T.path_suffix(path)
    return (
        F.when(e.isin(V.CODE_EXTS), "code").when(e.isin(V.IMAGE_EXTS), "image").when(e.isin(V.PDF_EXTS), "pdf")
        .when(e.isin(V.BINARY_EXTS), "binary").when(e.isin(V.DATA_EXTS), "table").otherwise("other"))


def module_profile(files: DataFrame) -> DataFrame:
    """File counts by kind for each module folder. ``data`` holds tables and binary results."""
    k = F.col("_k")
    return files.withColumn("_k", file_kind()).groupBy(K, "module").agg(
        N(F.lit(1)).alias("total"), n_if(k == "code").alias("code"), n_if(k.isin("table", "binary")).alias("data"),
        n_if(k == "image").alias("images"), n_if(k == "pdf").alias("pdf"), n_if(k == "binary").alias("binary"),
        n_if((k == "table") & T.path_suffix("path").isin(".csv", ".tsv") & (F.col("size") > 100)).alias("tables"))


def figure_data_ratio(profile: DataFrame, expects: str = V.EXPECTS_TABLE) -> DataFrame:
    visual = F.col("images") + F.col("pdf")
    bare = (visual >= 5) & (F.col("tables") == 0)
    wants = F.col("module").rlike(expects)
    rules = [
        (bare & wants, {"problem": "figures_without_table", "severity": "WARNING"}),
        (bare & ~wants & (F.col("binary") == 0), {"problem": "no_data_files", "severity": "INFO"}),
        ((F.col("tables") > 20) & (visual == 0), {"problem": "tables_without_figure", "severity": "INFO"}),
    ]
    return matching(profile.withColumn("visual", visual), rules, [K, "module", "visual", "tables"])


def delivery_gaps(profile: DataFrame) -> DataFrame:
    """Projects with modules but no code, and modules with code but no data."""
    p = profile.groupBy(K).agg(F.sum("code").alias("_code"), N(F.lit(1)).alias("_m")).where("_code = 0")
    a = p.select(K, F.lit("").alias("module"), F.lit("no_code").alias("problem"))
    b = profile.where("code > 0 and data = 0").select(K, "module", F.lit("no_data").alias("problem"))
    return a.unionByName(b).withColumn("severity", F.lit("WARNING"))


def required_components(files: DataFrame, rules=V.CLINICAL_COMPONENTS) -> DataFrame:
    """Modules of a kind that lack a required component, by file name."""
    name = F.lower(T.path_name("path"))
    mod = F.lower("module")
    each = matching(files, [(mod.contains(m), {"kind": m, "component": c, "severity": s, "present": name.rlike(p)}) for m, c, s, p in rules], [K, "module"])
    g = each.groupBy(K, "module", "kind", "component", "severity").agg(F.bool_or("present").alias("_any"))
    return g.where("not _any").drop("_any")


def figures_without_values(files: DataFrame, word: str = "shap") -> DataFrame:
    """Figures of a kind without a value table of that kind in the same module."""
    name = F.lower(T.path_name("path"))
    g = files.groupBy(K, "module").agg(
        F.bool_or(name.contains(word) & name.rlike(r"\.(pdf|png)$")).alias("_fig"), F.bool_or(name.contains(word) & name.endswith(".csv")).alias("_tab"))
    return g.where("_fig and not _tab").select(K, "module").withColumn("severity", F.lit("WARNING"))


def evidence_packages(files: DataFrame, rules=V.EVIDENCE_PACKAGES, figure: str = V.EVIDENCE_FIGURE) -> DataFrame:
    """Modules with figures that lack an item of their evidence package. A delivered pose lowers the docking items."""
    name, mod = F.lower(T.path_name("path")), F.lower("module")
    each = matching(
        files.withColumn("_fig", name.rlike(figure)).withColumn("_pose", name.rlike(r"(complex|out|pose|docked).*\.(pdb|mol2)$")),
        [(mod.contains(m), {"kind": m, "item": i, "severity": s, "present": name.rlike(p)}) for m, i, p, s in rules], [K, "module", "_fig", "_pose"])
    g = each.groupBy(K, "module", "kind", "item", "severity").agg(F.bool_or("present").alias("_any"), n_if("_fig").alias("figures"), F.bool_or("_pose").alias("_p"))
    d = g.where("not _any and figures > 0")
    return d.withColumn("severity", F.when((F.col("kind") == "dock") & F.col("_p"), "WARNING").otherwise(F.col("severity"))).drop("_any", "_p")


def filtered_only(files: DataFrame, modules=V.FILTERED_MODULES) -> DataFrame:
    name = F.lower(T.path_name("path"))
    d = files.where(T.path_suffix("path").isin(V.DATA_EXTS) & T.any_contains(F.lower("module"), modules))
    g = d.groupBy(K, "module").agg(
        F.bool_and(T.any_contains(name, V.FILTERED_HINTS)).alias("_f"), F.bool_or(T.any_contains(name, V.RAW_HINTS)).alias("_r"), N(F.lit(1)).alias("tables"))
    return g.where("_f and not _r").select(K, "module", "tables").withColumn("severity", F.lit("CRITICAL"))


def format_pairs(files: DataFrame) -> DataFrame:
    """Stems delivered as PNG without a PDF."""
    e = T.path_suffix("path")
    stem = F.regexp_replace("path", r"(?<=[^./])\.[^./]+$", "")
    d = files.where(e.isin(".png", ".pdf")).groupBy(K, stem.alias("stem")).agg(F.bool_or(e == ".pdf").alias("_pdf"))
    return d.where("not _pdf").select(K, "stem").withColumn("severity", F.lit("WARNING"))


def layout(dirs: DataFrame) -> DataFrame:
    g = dirs.groupBy(K).agg(
        F.bool_or(F.col("dir").isin(V.RESULT_ROOTS)).alias("_r"), F.bool_or(F.col("dir").isin(V.CODE_ROOTS + V.ATTACHMENT_ROOTS)).alias("_o"))
    return g.select(K, F.when(F.col("_r"), "segmented").when(F.col("_o"), "mixed").otherwise("flat").alias("layout"))


def roots(files: DataFrame) -> DataFrame:
    """Result root (a named folder, else the project itself when it has three numbered folders, else the folder
    with most numbered children) and code root (the folder with most code files) of each project."""
    parts = T.path_parts("path")
    top = F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    child = F.when(F.size(parts) > 2, F.get(parts, F.lit(1)))
    d = files.select(K, top.alias("top"), child.alias("child"), (file_kind() == "code").alias("is_code")).where("top is not null")
    per = d.groupBy(K, "top").agg(F.countDistinct(F.when(F.col("child").rlike(V.MODULE_DIR), F.col("child"))).alias("inner"), n_if("is_code").alias("code"))
    named = F.col("top").isin(V.RESULT_ROOTS)
    g = per.groupBy(K).agg(
        F.min(F.when(named, F.col("top"))).alias("_named"), F.count_if(F.col("top").rlike(V.MODULE_DIR)).alias("_numbered"),
        F.max(F.struct("inner", "top")).alias("_in"), F.max(F.struct("code", "top")).alias("_code"))
    root = (
        F.when(F.col("_named").isNotNull(), F.col("_named")).when(F.col("_numbered") >= 3, ".").when(F.col("_in.inner") >= 3, F.col("_in.top")))
    return g.select(K, root.alias("result_root"), F.when(F.col("_code.code") > 0, F.col("_code.top")).alias("code_root"))


def case_conflicts(refs: DataFrame) -> DataFrame:
    g = refs.groupBy(K, F.lower("ref_path").alias("folded")).agg(F.countDistinct("ref_path").alias("spellings"), F.min("ref_path").alias("one"), F.max("ref_path").alias("other"))
    return g.where("spellings > 1")


def shallowest_dir(dirs: DataFrame, words: list[str]) -> DataFrame:
    d = dirs.where(T.any_contains(F.lower(T.path_name("dir")), words))
    return d.groupBy(K).agg(F.min(F.struct(T.path_depth("dir").alias("depth"), F.col("dir").alias("dir"))).alias("d")).select(K, "d.dir", "d.depth")


def largest_files(files: DataFrame, k: int = 500) -> DataFrame:
    """The k largest images of each project: an optional cap, off in every check."""
    from claimgrid.functions.keyed import first_k

    return first_k(files.where(T.path_suffix("path").isin(V.IMAGE_EXTS)), [K], [F.desc("size"), F.asc("path")], k)


# --- tables ---------------------------------------------------------------------------------------


def labelled_counts(rows: DataFrame, meta: DataFrame, labels=V.TABLE_LABELS, p_columns=V.P_COLUMNS) -> DataFrame:
    """Rows, rows with p below 0.05 (first p column of the list) and confirmed rows of each labelled table."""
    name = T.path_name("path")
    named = matching(meta, [(name.rlike(p), {"label": lab}) for lab, p in labels], [K, "path", "header"])
    pcol = F.coalesce(*[F.when(F.array_contains("header", c), F.lit(c)) for c in p_columns])
    pick = named.select(K, "path", "label", pcol.alias("p_column"))
    cells = F.col("cells")
    decision = F.lower(F.trim(F.coalesce(F.try_element_at(cells, F.lit("decision")), F.try_element_at(cells, F.lit("Decision")))))
    d = rows.join(pick, [K, "path"]).withColumn("_p", number(F.try_element_at(cells, F.col("p_column")))).withColumn("_d", decision)
    g = d.groupBy(K, "path", "label", "p_column").agg(
        N(F.lit(1)).alias("rows"), n_if(F.col("_p") < 0.05).alias("_sig"), n_if(F.col("_d") == "confirmed").alias("confirmed"))
    total = F.when(F.col("label").contains("Boruta") & (F.col("confirmed") > 0), F.col("confirmed")).otherwise(F.col("rows"))
    return g.select(K, "path", "label", "rows", "confirmed", total.alias("total"), F.when(F.col("p_column").isNotNull(), F.col("_sig")).alias("significant"))


def updown_sum(counts: DataFrame) -> DataFrame:
    """Up plus down against the total, measured side; the rows of one label are summed over files first."""
    g = counts.groupBy(K).pivot("label", ["DEG up", "DEG down", "DEG total"]).agg(F.max("total"))
    d = g.select(K, F.col("DEG up").alias("up"), F.col("DEG down").alias("down"), F.col("DEG total").alias("total"))
    return d.where(F.abs(F.col("up") + F.col("down") - F.col("total")) > 1).withColumn("severity", F.lit("CRITICAL"))


def updown_claims(claims: DataFrame) -> DataFrame:
    """Claimed ups, downs and totals no combination of which adds up within max(5, 2 %).

    The first contradiction of a project is reported, as one row: it exists unless every combination
    fits, and the extremes decide that: when the largest sum fits the smallest total and the smallest sum
    the largest total, all combinations fit; otherwise one of these two does not and is the finding.
    """
    g = claims.groupBy(K).agg(*[
        f(F.when(F.col("label") == lab, F.col("claimed"))).alias(n)
        for lab, s in (("DEG up", "u"), ("DEG down", "d"), ("DEG total", "t")) for f, n in ((F.min, f"{s}0"), (F.max, f"{s}1"))])
    d = g.where("u0 is not null and d0 is not null and t0 is not null")

    def off(u: str, dn: str, t: str) -> Column:
        gap = F.abs(F.col(u) + F.col(dn) - F.col(t))
        return (gap > 1) & (gap > F.greatest(F.lit(5).cast("long"), F.floor(F.col(t) * 0.02)))

    hi, lo = off("u1", "d1", "t0"), off("u0", "d0", "t1")
    pick = F.when(hi, F.struct(F.col("u1").alias("up"), F.col("d1").alias("down"), F.col("t0").alias("total"))).when(
        lo, F.struct(F.col("u0").alias("up"), F.col("d0").alias("down"), F.col("t1").alias("total")))
    return d.select(K, pick.alias("p")).where("p is not null").select(K, "p.*").withColumn("severity", F.lit("CRITICAL"))


def uniform_metric(metrics: DataFrame) -> DataFrame:
    d = metrics.withColumn("_a", number("auc")).where("_a > 0")
    g = d.groupBy(K).agg(N(F.lit(1)).alias("models"), F.countDistinct(F.round("_a", 3)).alias("_d"), F.min("_a").alias("auc"))
    return g.where("models >= 4 and _d = 1").select(K, "models", "auc").withColumn("severity", F.lit("WARNING"))


def best_model(metrics: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Model with the best mean validation metric; training rows are left out. ``metrics``: project_id, model, role, value."""
    g = metrics.groupBy(K, "model").agg(F.avg(F.when(F.col("role") != "train", F.col("value"))).alias("score"))
    b = g.groupBy(K).agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", "model"))).alias("b"), N(F.lit(1)).alias("combinations"))
    out = b.select(K, F.col("b.model").alias("best_model"), F.round("b.score", 6).alias("best_score"), "combinations")
    return out if claims is None else out.join(claims, K).withColumn("agrees", (F.col("claimed_model") == F.col("best_model")) & (F.col("claimed_combinations") == F.col("combinations")))


def max_vs_threshold(results: DataFrame, claims: DataFrame, column: str) -> DataFrame:
    """Claimed threshold against the largest value the result table holds."""
    g = results.groupBy(K).agg(F.max(number(column)).alias("largest"))
    return claims.join(g, K).withColumn("reached", F.col("largest") >= F.col("threshold"))


def uniqueness(rows: DataFrame, key: str, claims: DataFrame | None = None, keys: list[str] = [K]) -> DataFrame:
    g = rows.groupBy(*keys).agg(N(key).alias("records"), F.countDistinct(key).alias("unique_records"))
    g = g.withColumn("duplicates", F.col("records") - F.col("unique_records"))
    return g if claims is None else g.join(claims, keys, "left").withColumn("agrees", F.col("claimed") == F.col("unique_records"))


def top_features(features: DataFrame, k: int) -> DataFrame:
    from claimgrid.functions.keyed import first_k

    return first_k(features, [K], [F.desc("importance"), F.asc("feature")], k)


def chain_reduction(counts: DataFrame, upstream: str, downstream: str, limit: float = 0.5) -> DataFrame:
    """Downstream tables that keep at most half of the rows of an upstream table.

    ``counts``: project_id, path, flow, rows. Upstream tables are reduced to their size range per
    project, so the pairs of files are not formed.
    """
    up = counts.where((F.col("flow") == upstream) & (F.col("rows") > 0)).groupBy(K).agg(F.max(F.struct("rows", "path")).alias("u"), N(F.lit(1)).alias("upstream_files"))
    d = counts.where((F.col("flow") == downstream) & (F.col("rows") > 0)).join(up, K)
    r = F.lit(1.0) - F.col("rows") / F.col("u.rows")
    return d.select(K, "path", "rows", F.col("u.path").alias("upstream_path"), F.col("u.rows").alias("upstream_rows"), F.round(r, 6).alias("reduction")).where(
        F.col("reduction") >= limit).withColumn("severity", F.lit("CRITICAL"))


def extra_variables(used: DataFrame, screened: DataFrame) -> DataFrame:
    """Variables of the final model that the screening list does not hold; projects with both lists only."""
    u = used.select(K, "variable").distinct().join(screened.select(K).distinct(), K, "left_semi")
    lost = u.join(screened.select(K, "variable").distinct(), [K, "variable"], "left_anti")
    n = lost.groupBy(K).agg(N(F.lit(1)).alias("extra"))
    return n.join(samples(lost, [K], "variable", 5, "examples"), K).withColumn("severity", F.lit("WARNING"))


def validate_set(items: DataFrame, reference: DataFrame, keys: list[str] = [K], category: str = "category", item: str = "item") -> DataFrame:
    """Expected, present, missing and extra members per category of a reference set."""
    a = items.select(*keys, category, item).distinct().withColumn("_a", F.lit(True))
    r = reference.select(*[c for c in (*keys, category, item) if c in reference.columns]).distinct().withColumn("_r", F.lit(True))
    on = [c for c in (*keys, category, item) if c in reference.columns]
    d = a.join(r, on, "full_outer")
    return d.groupBy(*keys, category).agg(
        n_if("_r").alias("expected"), n_if(F.col("_r") & F.col("_a")).alias("present"), n_if(F.col("_r") & F.col("_a").isNull()).alias("missing"),
        n_if(F.col("_a") & F.col("_r").isNull()).alias("extra"))


def symbol_profile(symbols: DataFrame, keys: list[str] = [K], k: int = 5) -> DataFrame:
    """Members per naming class with the first samples and the share of standard names."""
    d = symbols.withColumn("cls", T.symbol_class("symbol"))
    g = d.groupBy(*keys, "cls").agg(N(F.lit(1)).alias("n"))
    tot = g.groupBy(*keys).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("cls") == "standard", F.col("n")).otherwise(0)).alias("_std"))
    out = g.join(samples(d, [*keys, "cls"], "symbol", k, "examples"), [*keys, "cls"]).join(tot, keys)
    return out.withColumn("standard_rate", F.round(100.0 * F.col("_std") / F.col("_all"), 1)).drop("_std", "_all")


# --- numbering ------------------------------------------------------------------------------------


def numbering_pattern(refs: DataFrame) -> DataFrame:
    """Figure numbers that do not fit their section: a consistent scheme is one INFO, else each is MAJOR.

    A scheme is consistent when at least three offsets exist and one of them covers 80 %, or when at least
    three figure prefixes each stand in one section only.
    """
    bad = refs.where("mismatch").withColumn("_p", F.regexp_extract("figure", r"^(\d+)", 1)).withColumn(
        "_o", F.regexp_extract("section", r"^(\d+)", 1).cast("long") - F.regexp_extract("figure", r"^(\d+)", 1).cast("long"))
    offs = bad.groupBy(K, "_o").agg(N(F.lit(1)).alias("_n")).groupBy(K).agg(F.sum("_n").alias("mismatches"), F.max("_n").alias("_top"))
    pre = bad.groupBy(K, "_p").agg(F.countDistinct("section").alias("_s")).groupBy(K).agg(N(F.lit(1)).alias("_prefixes"), F.max("_s").alias("_spread"))
    j = offs.join(pre, K)
    scheme = ((F.col("mismatches") >= 3) & (F.col("_top") / F.col("mismatches") >= 0.8)) | ((F.col("_prefixes") >= 3) & (F.col("_spread") == 1))
    j = j.withColumn("_sys", scheme)
    one = j.where("_sys").select(K, F.lit(None).cast("string").alias("figure"), F.lit(None).cast("long").alias("line"), "mismatches", F.lit("INFO").alias("severity"))
    each = bad.join(j.where("not _sys").select(K), K, "left_semi").select(K, "figure", F.col("line").cast("long").alias("line"), F.lit(1).cast("long").alias("mismatches"), F.lit("MAJOR").alias("severity"))
    return one.unionByName(each)


def repeated_across(refs: DataFrame, item: str, place: str, keys: list[str] = [K]) -> DataFrame:
    g = refs.where(F.col(place).isNotNull()).groupBy(*keys, item).agg(F.countDistinct(place).alias("places"), F.min("line").alias("first_line"))
    return g.where("places > 1").withColumn("severity", F.lit("MAJOR"))


def monotonic(staged: DataFrame) -> DataFrame:
    """A later stage whose smallest count exceeds the largest of the stage before it; merging may add."""
    order = F.create_map(*[x for i, (s, _) in enumerate(V.COUNT_STAGES) for x in (F.lit(s), F.lit(i))])
    g = staged.withColumn("_ord", F.try_element_at(order, F.col("stage"))).where("_ord is not null").groupBy(K, "stage", "_ord").agg(F.max("n").alias("_max"), F.min("n").alias("_min"))
    d = previous_row(g, [K], "_ord", F.struct("stage", "_max"), "_p")
    bad = d.where("_p is not null and _min > _p._max and not (stage = 'merged' and _p.stage = 'initial')")
    return bad.select(K, F.col("_p.stage").alias("stage_before"), F.col("_p._max").alias("count_before"), F.col("stage").alias("stage_after"), F.col("_min").alias("count_after")).withColumn("severity", F.lit("CRITICAL"))


def coverage_ratio(annotated: DataFrame, covered: DataFrame, item: str) -> DataFrame:
    """Downstream modules that cover less than half of the annotated items and miss at least two."""
    a = annotated.select(K, item).distinct()
    total = a.groupBy(K).agg(N(F.lit(1)).alias("annotated"))
    c = covered.select(K, "module", item).distinct()
    size = c.groupBy(K, "module").agg(N(F.lit(1)).alias("covered"))
    hit = c.join(a, [K, item], "left_semi").groupBy(K, "module").agg(N(F.lit(1)).alias("_hit"))
    d = size.join(hit, [K, "module"], "left").join(total, K)
    d = d.withColumn("missing", F.col("annotated") - F.coalesce("_hit", F.lit(0))).withColumn("ratio", F.round(F.col("covered") / F.col("annotated"), 6))
    return d.where("ratio < 0.5 and missing >= 2").select(K, "module", "annotated", "covered", "missing", "ratio").withColumn("severity", F.lit("WARNING"))


# --- clinical tables ------------------------------------------------------------------------------


def baseline_direction(rows: DataFrame) -> DataFrame:
    """Direction of each significant baseline variable: means, else weighted levels, else the affirmative level.

    ``rows``: project_id, variable, row_no, level, no_group, yes_group, p_value (text).
    """
    lv = F.trim(F.coalesce("level", F.lit("")))
    pn, py = percent_in_parens("no_group"), percent_in_parens("yes_group")
    score = level_score(lv)
    d = rows.where(~T.is_blank("variable")).select(
        K, "variable", "row_no", "p_value", (F.length(lv) > 0).alias("_lv"), first_number("no_group").alias("_n"), first_number("yes_group").alias("_y"),
        pn.alias("_pn"), py.alias("_py"), score.alias("_s"), level_affirmative(lv).alias("_aff"))
    full = F.col("_s").isNotNull() & F.col("_pn").isNotNull() & F.col("_py").isNotNull()
    g = d.groupBy(K, "variable").agg(
        F.min_by("p_value", "row_no").alias("_p"), F.bool_or("_lv").alias("_levels"), F.min_by("_n", "row_no").alias("_n"), F.min_by("_y", "row_no").alias("_y"),
        F.bool_and(full).alias("_ordinal"), F.sum(F.col("_s") * F.col("_pn") / 100).alias("_no"), F.sum(F.col("_s") * F.col("_py") / 100).alias("_yes"),
        F.min(F.when(F.col("_aff"), F.struct("row_no", "_pn", "_py"))).alias("_a"))
    diff = F.when(~F.col("_levels"), F.col("_y") - F.col("_n")).when(F.col("_ordinal"), F.col("_yes") - F.col("_no")).otherwise(F.col("_a._py") - F.col("_a._pn"))
    # sums of percentages carry rounding noise; a difference below 1e-9 is none
    out = g.where(p_significant("_p")).withColumn("_d", diff)
    rule = F.when(~F.col("_levels"), "mean").when(F.col("_ordinal"), "ordinal").otherwise("affirmative")
    return out.where("abs(_d) > 1e-9").select(K, "variable", F.when(F.col("_d") > 0, "higher").otherwise("lower").alias("direction"), rule.alias("rule"))


# --- project attributes and code facts ------------------------------------------------------------


def project_type(projects: DataFrame, keywords=V.TYPE_KEYWORDS, default: str = "unknown") -> DataFrame:
    return projects.select(K, T.first_class(F.lower("name"), {k: [w.lower() for w in ws] for k, ws in keywords.items()}, default).alias("project_type"))


def project_type_by_text(lines: DataFrame, keywords=V.TYPE_KEYWORDS) -> DataFrame:
    """Type whose keywords occur with the largest share in the text; ties go to the name first in order."""
    low = F.lower("text")
    hits = matching(lines, [(low.contains(w.lower()), {"project_type": t, "word": w}) for t, ws in keywords.items() for w in ws], [K]).distinct()
    size = F.create_map(*[x for t, ws in keywords.items() for x in (F.lit(t), F.lit(len(ws)))])
    g = hits.groupBy(K, "project_type").agg(N(F.lit(1)).alias("_n"))
    g = g.withColumn("share", F.round(F.col("_n") / F.element_at(size, F.col("project_type")), 6))
    return g.groupBy(K).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col("project_type").alias("t"))).alias("b")).select(K, F.col("b.t").alias("project_type"), (-F.col("b.s")).alias("share"))


def disease_code(projects: DataFrame, codes=V.DISEASE_CODES, names=V.DISEASE_NAMES) -> DataFrame:
    """Expected code of a project from its name: the longest code as a word, else the longest disease name."""
    out = None
    for c in sorted(codes, key=lambda x: (-len(x), codes.index(x))):
        hit = F.upper("name").rlike(rf"(?U)\b{c}\b")
        out = F.when(hit, c) if out is None else out.when(hit, c)
    for n in sorted(names, key=lambda x: -len(x)):
        out = out.when(F.col("name").contains(n), names[n])
    return projects.select(K, out.alias("expected"))


def parameter_index(params: DataFrame) -> DataFrame:
    """Values per parameter and project with number of files and the span of the value as text."""
    return params.groupBy(K, "kind", "source").agg(
        N(F.lit(1)).alias("uses"), F.countDistinct("value").alias("values"), F.countDistinct("path").alias("files"), F.min("value").alias("first_value"))


def identifier_index(ids: DataFrame, own: DataFrame) -> DataFrame:
    """Project codes found in code with number of files and whether they are foreign."""
    g = ids.groupBy(K, "value").agg(F.countDistinct("path").alias("files"), F.min("path").alias("first_file"))
    return g.join(own.select(K, "project_code"), K, "left").withColumn("is_foreign", ~F.col("value").eqNullSafe(F.col("project_code"))).drop("project_code")


def coverage_matrix(objects: DataFrame) -> DataFrame:
    """Object class by evidence dimension: how many objects are present, reported, interpreted, structured, sufficient."""
    dims = ["present", "reported", "interpreted", "structured", "sufficient"]
    return objects.groupBy(K, "object_class").pivot("dimension", dims).agg(N(F.lit(1))).na.fill(0, dims)


def attribute(values: DataFrame) -> DataFrame:
    """Which side is wrong when report, result and code do not agree. ``values``: project_id, item, source, value."""
    g = values.groupBy(K, "item").pivot("source", ["report", "result", "code"]).agg(F.min("value"))
    r, s, c = F.col("report"), F.col("result"), F.col("code")
    known = r.isNotNull() & s.isNotNull() & c.isNotNull()
    side = F.when(~known, "incomplete").when((r == s) & (s == c), "consistent").when(s == c, "report").when(r == c, "result").when(r == s, "code").otherwise("all_differ")
    return g.withColumn("wrong_side", side)


# --- visual assets --------------------------------------------------------------------------------


def prefilter_summary(flags: DataFrame, kinds: list[str]) -> DataFrame:
    """Assets per project, flagged assets, and assets per flag type. ``flags``: project_id, asset_id, flags (array)."""
    return flags.groupBy(K).agg(
        N(F.lit(1)).alias("assets"), n_if(F.size("flags") > 0).alias("flagged"), *[n_if(F.array_contains("flags", k)).alias(k) for k in kinds])


def review_worklist(assets: DataFrame, lane: str) -> DataFrame:
    """Which assets need review in a lane, and why the others are skipped."""
    kind = F.col("asset_type")
    reason = F.when(kind == "cover_decoration", "cover")
    if lane == "standard":
        reason = reason.when(F.col("size") < 2000, "very_small").when((F.size("flags") == 0) & ~kind.isin(V.HIGH_RISK_ASSETS), "low_risk")
    d = assets.withColumn("skip_reason", reason.otherwise(F.lit("")))
    return d.withColumn("needs_audit", F.col("skip_reason") == "")


# --- degraded mode --------------------------------------------------------------------------------


def degraded_summary(projects: DataFrame, lines: DataFrame, meta: DataFrame, params: DataFrame) -> DataFrame:
    """What can be listed for projects without a report: countable tables and code parameters."""
    silent = projects.select(K).join(lines.select(K).distinct(), K, "left_anti")
    t = meta.select(K, F.lit("table").alias("kind"), F.col("path").alias("item"), F.col("rows").cast("string").alias("value"))
    p = params.select(K, F.col("kind"), F.col("path").alias("item"), "value")
    return t.unionByName(p).join(silent, K, "left_semi").withColumn("severity", F.lit("INFO"))
