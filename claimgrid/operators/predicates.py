"""Row predicates: a line, a file or a table row that is wrong by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.keyed import matching
from claimgrid.functions.numbers import integer, number
from claimgrid.functions.ordered import next_row
from claimgrid.operators.extract import K, extract
from claimgrid.rules import values as V


def missing_chars(lines: DataFrame, rules=V.MISSING_CHARS, contexts=V.MISSING_CHAR_CONTEXTS) -> DataFrame:
    """A fragment of a term stands where the whole term does not, outside known other uses."""
    t = F.col("text")
    found = []
    for wrong, right in rules:
        cond = t.contains(wrong) & ~t.contains(right)
        if wrong in contexts:
            cond = cond & ~t.rlike(contexts[wrong])
        found.append((cond, {"wrong": wrong, "correct": right, "severity": "MAJOR"}))
    return matching(lines, found, [K, "line"])


def wrong_words(lines: DataFrame, rules=V.WRONG_WORDS) -> DataFrame:
    return matching(lines, [(F.col("text").contains(w), {"wrong": w, "correct": r, "severity": "MAJOR"}) for w, r in rules], [K, "line"])


def text_anomalies(lines: DataFrame, rules=V.TEXT_ANOMALIES, starts=V.TRUNCATED_STARTS, reach: int = 5) -> DataFrame:
    """Fragments whose missing first letter is not there, and lines that begin in the middle of a word.

    An occurrence is dropped when the full term stands wholly within five letters of it. The look-around
    of each pattern says so, so that every occurrence on a line is judged by itself.
    """
    arrays = []
    for pattern, right, severity in rules:
        gap = max(reach - len(right), 0)
        guarded = rf"(?<!{right}.{{0,{gap}}})(?:{pattern})(?!.{{0,{gap}}}{right})" if len(right) <= reach else pattern
        hits = F.regexp_extract_all("text", F.lit(guarded), F.lit(0))
        arrays.append(T.each(hits, "found", correct=right, severity=severity))
    cut = F.when(F.substring(F.trim("text"), 1, 1).isin(starts), F.array(F.struct(
        F.substring(F.trim("text"), 1, 6).alias("found"), F.lit("?").alias("correct"), F.lit("WARNING").alias("severity")))).otherwise(
        F.array().cast("array<struct<found:string,correct:string,severity:string>>"))
    return lines.select(K, "line", F.explode(F.flatten(F.array(*arrays, cut))).alias("h")).select(K, "line", "h.*")


def forbidden_terms(lines: DataFrame, projects: DataFrame, terms=V.FORBIDDEN_TERMS) -> DataFrame:
    """Terms that do not belong to the project's type, on lines that are no comment and no citation."""
    t = F.col("text")
    body = lines.where(~F.trim("text").startswith("#") & ~t.rlike(V.CITATION_LINE))
    typed = body.join(projects.select(K, "project_type"), K)
    arrays = []
    for ptype, words in terms.items():
        for word, severity in words.items():
            hits = F.regexp_extract_all("text", F.lit(rf"(?iU)\b{word}\b"), F.lit(0))
            arrays.append(F.when(F.col("project_type") == ptype, T.each(hits, "term", severity=severity)))
    hit = F.flatten(F.array_compact(F.array(*arrays)))
    return typed.select(K, "line", "project_type", F.explode(hit).alias("h")).select(K, "line", "project_type", "h.*")


def allowed_codes(projects: DataFrame, synonyms=V.CODE_SYNONYMS) -> DataFrame:
    """(project, code) pairs a project may use: the expected code and its synonyms."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extra = F.coalesce(F.try_element_at(table, F.col("expected")), F.array().cast("array<string>"))
    return projects.where("expected is not null").select(K, F.explode(F.array_union(F.array("expected"), extra)).alias("code"))


def foreign_codes(lines: DataFrame, projects: DataFrame, codes: list[str] = V.DISEASE_CODES) -> DataFrame:
    """Codes of a closed list that are neither the project's own nor a synonym of it."""
    pattern = r"(?U)\b(" + "|".join(c for c in codes if len(c) >= 3) + r")\b"
    t = F.col("text")
    found = lines.select(K, "line", "text", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("code"))
    harmless = ((F.col("code") == "READ") & (t.rlike(r"(?i)read[._]") | F.trim("text").rlike(r"^(#|//)"))) | (
        (F.col("code") == "ACC") & t.rlike(r"(?i)accur"))
    named = projects.where("expected is not null").select(K)
    return (
        found.where(~harmless).drop("text").join(named, K, "left_semi")
        .join(allowed_codes(projects), [K, "code"], "left_anti").withColumn("severity", F.lit("FATAL"))
    )


def foreign_ids(lines: DataFrame, projects: DataFrame, pattern: str = V.PROJECT_CODE_WORD, severity: str = "FATAL") -> DataFrame:
    """Project codes in the text that are not the code of the project itself."""
    found = lines.select(K, "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("found"))
    own = projects.select(K, "project_code").where(~T.is_blank("project_code"))
    return found.join(own, K).where("found <> project_code").withColumn("severity", F.lit(severity))


def template_residue(lines: DataFrame, projects: DataFrame, sections: DataFrame, groups=V.RESIDUE_GROUPS) -> DataFrame:
    """Words of another study template in the body. A group is skipped for a project whose name or
    section titles show that it is of that kind; words only in pathway context are INFO."""
    words = projects.select(K, F.col("name").alias("t")).unionByName(sections.select(K, F.col("title").alias("t")))
    low = F.lower("t")
    skip = matching(words, [(T.any_contains(low, [x.lower() for x in ex]), {"grp": g}) for g, (_, ex) in groups.items()], [K]).distinct()
    first_ref = lines.where(F.col("text").rlike(r"(?U)^\s*(参考文献|References|REFERENCES)")).groupBy(K).agg(F.min("line").alias("_ref"))
    body = lines.join(first_ref, K, "left").where("_ref is null or line < _ref")
    in_context = F.lower("text").rlike(V.PATHWAY_CONTEXT.lower())
    rules = [(F.lower("text").contains(w.lower()), {"grp": g, "keyword": w}) for g, (ws, _) in groups.items() for w in ws]
    hits = matching(body.withColumn("ctx", in_context), rules, [K, "line", "ctx"]).join(skip, [K, "grp"], "left_anti")
    counted = hits.groupBy(K, "grp", "keyword").agg(
        F.count_if(~F.col("ctx")).alias("body_lines"), F.count(F.lit(1)).alias("all_lines"), F.min("line").alias("first_line"))
    return counted.withColumn("severity", F.when(F.col("body_lines") > 0, "CRITICAL").otherwise("INFO"))


def survival_residue(lines: DataFrame, words=V.SURVIVAL_RESIDUE) -> DataFrame:
    hits = matching(lines, [(F.lower("text").contains(w.lower()), {"keyword": w}) for w in words], [K, "line"])
    return hits.groupBy(K, "keyword").agg(F.min("line").alias("first_line")).withColumn("severity", F.lit("CRITICAL"))


def stat_anomalies(texts: DataFrame, rules=V.ANOMALY_RULES) -> DataFrame:
    severity = {k: s for k, s, _ in rules}
    hits = extract(texts, [(k, p, 0) for k, _, p in rules]).groupBy(K, "kind").agg(F.count(F.lit(1)).alias("n"))
    sev = None
    for k, s in severity.items():
        sev = F.when(F.col("kind") == k, s) if sev is None else sev.when(F.col("kind") == k, s)
    return hits.withColumn("severity", sev)


def small_validation(texts: DataFrame, limit: int = 5) -> DataFrame:
    hits = extract(texts, [("validation", p, 1) for p in V.VALIDATION_SIZE])
    return hits.select(K, integer("value").alias("n")).where(F.col("n") <= limit).distinct().withColumn("severity", F.lit("WARNING"))


def sum_identities(lines: DataFrame) -> DataFrame:
    """Totals that are not the sum of the two parts named with them, within a line and the next one."""
    d = next_row(lines, [K], "line", F.col("text"), "_next")
    ctx = F.concat_ws(" ", "text", "_next")

    def part(p: str, g: int) -> Column:
        return F.regexp_extract(ctx, p, g).try_cast("long")

    kinds = [("up_down", "CRITICAL", V.SUM_UP_DOWN, F.lit(True)), ("groups", "WARNING", V.SUM_GROUPS, part(V.SUM_GROUPS, 1) > 10)]
    hits = [
        F.when(
            part(p, 1).isNotNull() & (part(p, 1) != part(p, 2) + part(p, 3)) & extra,
            F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), part(p, 1).alias("total"), part(p, 2).alias("part_a"), part(p, 3).alias("part_b")),
        )
        for k, s, p, extra in kinds
    ]
    return d.select(K, "line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(K, "line", "h.*")


def inline_contradiction(texts: DataFrame) -> DataFrame:
    """A count after filtering that is larger than the count before it, named together."""
    p = V.BEFORE_AFTER
    z = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("before"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("after"))
    d = texts.select(*[c for c in texts.columns if c != "text"], F.explode(z).alias("z"))
    d = d.withColumn("n_before", integer("z.before")).withColumn("n_after", integer("z.after")).drop("z")
    return d.where("n_after > n_before").withColumn("severity", F.lit("CRITICAL"))


def absolute_paths(io_refs: DataFrame) -> DataFrame:
    """Machine paths in code, grouped by their first three levels."""
    p = F.col("ref_path")
    unix = p.rlike(r"^/(?!/)")
    drive = p.rlike(r"^.:.")
    prefix = F.when(unix, F.substring_index(p, "/", 4)).otherwise(F.substring(p, 1, 20))
    return (
        io_refs.where(unix | drive).withColumn("prefix", prefix).groupBy(K, "prefix")
        .agg(F.countDistinct("path").alias("files")).withColumn("severity", F.lit("INFO"))
    )


def file_health(files: DataFrame, typos=V.NAME_TYPOS) -> DataFrame:
    """Empty files, files too small for their type, and misspelt names."""
    ext = T.path_suffix("path")
    name = F.lower(T.path_name("path"))
    d = files.where(ext.isin(V.FIGURE_EXTS))
    rules = [
        (F.col("size") == 0, {"problem": "empty", "detail": "", "severity": "CRITICAL"}),
        ((F.col("size") > 0) & (ext == ".pdf") & (F.col("size") < V.MIN_PDF_BYTES), {"problem": "small_pdf", "detail": "", "severity": "WARNING"}),
        ((F.col("size") > 0) & ext.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff") & (F.col("size") < V.MIN_IMAGE_BYTES),
         {"problem": "small_image", "detail": "", "severity": "WARNING"}),
        *[(name.contains(w), {"problem": "typo", "detail": f"{w}->{r}", "severity": "WARNING"}) for w, r in typos.items()],
    ]
    return matching(d, rules, [K, "path"])


def missing_parameter(texts: DataFrame, rules=V.METHOD_NEEDS_RULE) -> DataFrame:
    """A method is named and the rule its result depends on is not."""
    low = F.lower("text")
    return matching(texts, [(low.contains(m) & ~low.rlike(p), {"method": m, "severity": "WARNING"}) for m, p in rules], [K])


def metric_anomalies(metrics: DataFrame) -> DataFrame:
    """Perfect AUC, and high AUC next to low accuracy. Metrics arrive as text."""
    d = metrics.withColumn("_auc", number("auc")).withColumn("_acc", number("accuracy"))
    rules = [
        (F.col("_auc") >= 0.999, {"problem": "perfect_auc", "severity": "WARNING"}),
        ((F.col("_auc") > 0.8) & (F.col("_acc") < 0.4), {"problem": "auc_accuracy_gap", "severity": "WARNING"}),
    ]
    return matching(d, rules, [K, "path", "model"])


def lint_terms(lines: DataFrame, rules: list[tuple[str, str, str, str]], headings_only: bool = False) -> DataFrame:
    """Terms a finished report may not hold: (check, term, replacement, severity)."""
    src = lines.where(F.col("text").rlike(r"^#{1,6}\s+")) if headings_only else lines
    return matching(src, [(F.col("text").contains(t), {"check": c, "term": t, "replacement": r, "severity": s}) for c, t, r, s in rules], [K, "line"])


def evidence_complete(fields=V.EVIDENCE_FIELDS) -> Column:
    ok = F.lit(True)
    for f in fields:
        ok = ok & ~T.is_blank(f)
    return ok


def table_type(meta: DataFrame, markers=V.EFFECT_MARKERS) -> DataFrame:
    """Projects whose differential tables all look like matrices: no effect or p-value column anywhere."""
    deg = meta.where(F.lower("path").contains("deg") & (F.size("header") > 0))
    is_result = F.arrays_overlap(F.transform("header", lambda h: F.lower(h)), F.array(*map(F.lit, markers)))
    per = deg.groupBy(K).agg(F.bool_or(is_result).alias("has_result"), F.count(F.lit(1)).alias("tables"), F.min("path").alias("sample"))
    return per.where(~F.col("has_result")).select(K, "tables", "sample").withColumn("severity", F.lit("MAJOR"))


def baseline_shape(meta: DataFrame) -> DataFrame:
    """Baseline tables without a p-value column or with fewer than three rows."""
    low = F.transform("header", lambda h: F.lower(F.trim(h)))
    has_p = F.exists(low, lambda h: (h == "p") | (h.contains("p") & h.contains("val")))
    d = meta.where(F.lower(T.path_name("path")).contains("baseline"))
    return matching(d, [(~has_p, {"problem": "no_p_column", "severity": "WARNING"}), (F.col("rows") < 3, {"problem": "few_rows", "severity": "WARNING"})], [K, "path"])


def cover_assets(lines: DataFrame, markers: DataFrame, first: int = 30, reach: int = 3) -> DataFrame:
    """Markers on the cover: up to three lines past the last project or title line of the first thirty."""
    cover = lines.where((F.col("line") <= first) & (F.col("text").rlike(V.ASSET_PROJECT_CODE) | F.col("text").rlike("研究方向|项目编号|单号")))
    end = cover.groupBy(K).agg((F.max("line") + reach).alias("_end"))
    return markers.join(end, K, "left").withColumn("is_cover", F.coalesce(F.col("line") <= F.col("_end"), F.lit(False))).drop("_end")


def foreign_in_assets(asset_text: DataFrame, projects: DataFrame) -> DataFrame:
    """Project codes read from figures that belong to another project."""
    found = asset_text.select(K, "asset_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(V.ASSET_PROJECT_CODE), F.lit(1)))).alias("found"))
    return found.join(projects.select(K, "project_code"), K).where("found <> project_code").withColumn("severity", F.lit("CRITICAL")).drop("project_code")
