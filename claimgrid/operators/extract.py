"""Text to facts. Inputs are line tables ``(project_id, line, text)``, code line tables with ``path`` and
``lang`` added, or whole texts, one row each. ``line`` is unique within a project (within a path for code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.numbers import integer, number, ref_ranges
from claimgrid.functions.ordered import last_known, neighbours, next_row, previous_row
from claimgrid.rules import values as V

K = "project_id"


# --- rule-driven extraction -----------------------------------------------------------------------


def rule_hits(text: str, rules: list[tuple[str, str, int]]) -> Column:
    """Array of (kind, value) for every match of every rule; the patterns are literals and compile once."""
    found = [T.each(F.regexp_extract_all(text, F.lit(p), F.lit(g)), "value", kind=kind) for kind, p, g in rules]
    return F.flatten(F.array(*found))


def extract(lines: DataFrame, rules: list[tuple[str, str, int]], text: str = "text") -> DataFrame:
    """One row per match: the line's own columns, ``kind``, ``value`` and 120 letters of context."""
    keep = [c for c in lines.columns if c != text]
    hits = lines.select(*keep, F.substring(F.trim(text), 1, 120).alias("context"), F.explode(rule_hits(text, rules)).alias("h"))
    return hits.select(*keep, "h.kind", "h.value", "context")


def numbers(lines: DataFrame) -> DataFrame:
    return extract(lines, V.NUMBER_RULES)


def claims(texts: DataFrame, rules=V.CLAIM_RULES) -> DataFrame:
    """Distinct integer claims per label. ``value`` is a long; text that is no integer is dropped."""
    hits = extract(texts, rules)
    return hits.select(K, F.col("kind").alias("label"), integer("value").alias("claimed")).where("claimed is not null").distinct()


def thresholds(lines: DataFrame, rules) -> DataFrame:
    hits = extract(lines, rules)
    out = [c for c in hits.columns if c not in ("kind", "value", "context")]
    return hits.select(*out, F.col("kind").alias("label"), number("value").alias("value")).where("value is not null")


def identifiers(lines: DataFrame, rules=V.IDENTIFIER_RULES) -> DataFrame:
    return extract(lines, rules).select(K, "kind", "value").distinct()


# --- report structure -----------------------------------------------------------------------------


def heading_parts(text: str = "text") -> tuple[Column, Column]:
    t = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.regexp_extract(t, V.SECTION, 1), F.trim(F.regexp_extract(t, V.SECTION, 2))


def sections(lines: DataFrame) -> DataFrame:
    """Headings with start line and end line; the last section ends with the text."""
    sid, title = heading_parts()
    heads = lines.select(K, "line", sid.alias("section"), title.alias("title")).where("section <> ''")
    ends = lines.groupBy(K).agg(F.max("line").alias("_total"))
    out = next_row(heads, [K], "line", F.col("line"), "_next").join(ends, K)
    return out.select(K, "section", "title", "line", F.coalesce(F.col("_next") - 1, "_total").cast("long").alias("line_end"))


def lines_with_section(lines: DataFrame) -> DataFrame:
    """Every line with the id of the section it stands in (the last heading at or before it)."""
    sid, _ = heading_parts()
    return last_known(lines, [K], "line", F.nullif(sid, F.lit("")), "section")


def figure_refs(lines: DataFrame) -> DataFrame:
    """Figure references with their section; a mismatch is a different pair of first two levels."""
    found = lines_with_section(lines).select(
        K, "line", "section", F.explode(F.regexp_extract_all("text", F.lit(V.FIGURE_REF), F.lit(1))).alias("figure")
    )
    two = (T.id_depth("figure") >= 2) & (T.id_depth("section") >= 2)
    return found.withColumn(
        "mismatch", F.coalesce(two & (T.id_prefix("figure", 2) != T.id_prefix("section", 2)), F.lit(False))
    )


def table_refs(lines: DataFrame) -> DataFrame:
    return lines_with_section(lines).select(
        K, "line", "section", F.explode(F.regexp_extract_all("text", F.lit(V.TABLE_REF), F.lit(1))).alias("table_no")
    )


def symbols(lines: DataFrame, stops: list[str] = V.SYMBOL_STOPS) -> DataFrame:
    """Gene-like names with first line and number of mentions."""
    found = lines.select(K, "line", F.explode(F.regexp_extract_all("text", F.lit(V.SYMBOL), F.lit(1))).alias("symbol"))
    kept = found.where((F.length("symbol") >= 3) & ~F.col("symbol").isin(stops))
    return kept.groupBy(K, "symbol").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("mentions"))


def resource_refs(lines: DataFrame, names: list[str] = V.DATABASES) -> DataFrame:
    """Mentions of named databases with the reference number that follows, null when there is none."""
    pattern = r"(?iU)\b(" + "|".join(n.replace("-", r"\-") for n in names) + r")\b\s*(?:\[(\d+)\])?"
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("resource"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("ref"),
    )
    return lines.select(K, "line", F.explode(pairs).alias("p")).select(
        K, "line", F.col("p.resource").alias("resource"), F.nullif(F.col("p.ref"), F.lit("")).cast("long").alias("ref")
    )


def asset_markers(lines: DataFrame) -> DataFrame:
    """Inline image markers with the text of the lines around them."""
    around = next_row(previous_row(lines, [K], "line", F.col("text"), "before"), [K], "line", F.col("text"), "after")
    return around.select(
        K, "line", F.explode(F.regexp_extract_all("text", F.lit(V.IMAGE_MARKER), F.lit(1))).alias("file"),
        F.substring(F.trim(F.coalesce("before", F.lit(""))), 1, 100).alias("context_before"),
        F.substring(F.trim(F.coalesce("after", F.lit(""))), 1, 100).alias("context_after"),
    )


def sentences(texts: DataFrame, text: str = "text") -> DataFrame:
    parts = F.filter(F.transform(F.split(text, V.SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(parts).alias("sentence_no", "sentence"))


def _last_position_expr(text: str, markers: list[str]) -> str:
    parts = [
        f"case when locate('{m[::-1]}', reverse({text})) > 0 "
        f"then length({text}) - locate('{m[::-1]}', reverse({text})) - {len(m)} + 2 else 0 end"
        for m in markers
    ]
    return f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _first_stop_expr(text: str, start: str, stops: list[str]) -> str:
    return "least(" + ", ".join(f"nullif(locate('{s}', {text}, {start}), 0)" for s in stops) + ")"


def trim_tail(texts: DataFrame, refs=V.REFERENCE_MARKERS, stops=V.STOP_MARKERS) -> DataFrame:
    """Cut the text at the first boilerplate marker behind the last reference marker."""
    d = texts.withColumn("_ref", F.expr(_last_position_expr("text", refs)))
    d = d.withColumn("_stop", F.when(F.col("_ref") > 0, F.expr(_first_stop_expr("text", "_ref + 1", stops))))
    return d.withColumn("text", F.when(F.col("_stop") > 0, F.expr("left(text, _stop - 1)")).otherwise(F.col("text"))).drop("_ref", "_stop")


def split_references(texts: DataFrame, marker: str = V.REFERENCE_MARKERS[0], stops=V.STOP_MARKERS) -> tuple[DataFrame, DataFrame]:
    """(body, references): text before the last marker, and the numbered entries after it."""
    d = texts.withColumn("_ref", F.expr(_last_position_expr("text", [marker])))
    d = d.withColumn("_tail", F.when(F.col("_ref") > 0, F.expr(f"substring(text, _ref + {len(marker)})")))
    d = d.withColumn("_stop", F.expr(_first_stop_expr("_tail", "1", stops)))
    d = d.withColumn("_block", F.when(F.col("_stop") > 0, F.expr("left(_tail, _stop - 1)")).otherwise(F.col("_tail")))
    body = d.select(K, F.when(F.col("_ref") > 0, F.expr("left(text, _ref - 1)")).otherwise(F.col("text")).alias("body"))
    entries = F.filter(F.transform(F.split("_block", r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    refs = d.select(K, F.posexplode(entries).alias("_p", "reference")).select(K, (F.col("_p") + 1).cast("long").alias("ref"), "reference")
    return body, refs


ASCII_FOLD = ("\u017f\u212a\u0131\u0130", "skii")  # the only other letters that a pattern without case takes for one of a to z


def citations(body: DataFrame, names: dict[str, list[str]] = V.DATABASE_REFERENCES, text: str = "body") -> DataFrame:
    """Resource names followed within 24 letters by a bracketed reference list, one row per number or range (ref to ref_to)."""
    # columns of their own, so that they are made once a text and not once a name
    flat, folded = F.col("_flat"), F.col("_folded")
    body = body.select(K, F.regexp_replace(text, r"(?U)\s+", " ").alias("_flat")).where(F.contains("_flat", F.lit("[")))
    body = body.select(K, "_flat", F.lower(F.translate("_flat", *ASCII_FOLD)).alias("_folded"))
    arrays = []
    for name, words in names.items():
        alts = sorted({name.lower(), *[w.lower() for w in words]}, key=lambda w: (-len(w), w))
        for a in alts:
            quoted = "".join("\\" + ch if ch in r"-.,()[]+*?" else ch for ch in a)
            p = rf"(?iU)({quoted}[^\[\]。；;]{{0,24}})\[([\d,\-\s]+)\]"
            zipped = F.arrays_zip(
                F.regexp_extract_all(flat, F.lit(p), F.lit(1)).alias("context"),
                F.regexp_extract_all(flat, F.lit(p), F.lit(2)).alias("refs"),
            )
            found = T.each(zipped, "hit", resource=name)
            arrays.append(F.when(F.contains(folded, F.lit(a)), found) if a.isascii() else found)  # a text is searched for the names it holds
    hits = body.select(K, F.explode(F.flatten(F.array_compact(F.array(*arrays)))).alias("h"))
    each = hits.select(K, "h.resource", F.trim("h.hit.context").alias("context"), F.explode(ref_ranges("h.hit.refs")).alias("r"))
    return each.select(K, "resource", "context", F.col("r.lo").alias("ref"), F.col("r.hi").alias("ref_to")).dropDuplicates([K, "resource", "ref", "ref_to", "context"])


def pair_claims(lines: DataFrame, keyword: str = "mantel") -> DataFrame:
    """Entity pairs called significant within two lines of a line that names the method."""
    named = lines.where(F.lower("text").contains(keyword.lower())).select(K, "line").withColumn("_hit", F.lit(True))
    ctx = neighbours(lines, [K], "line", "text", 2, 2, "ctx").join(named, [K, "line"], "left_semi")
    joined = F.array_join("ctx", "\n")
    arrays = [
        F.arrays_zip(
            F.regexp_extract_all(joined, F.lit(p), F.lit(1)).alias("entity"),
            F.regexp_extract_all(joined, F.lit(p), F.lit(2)).alias("partner"),
        )
        for p in V.PAIR_CLAIMS
    ]
    each = ctx.select(K, F.explode(F.flatten(F.array(*arrays))).alias("p")).select(K, "p.entity", F.trim("p.partner").alias("partner"))
    return each.where((F.length("entity") >= 2) & (F.length("partner") >= 3)).distinct()


def staged_counts(lines: DataFrame, stages=V.COUNT_STAGES) -> DataFrame:
    """Object counts with the first processing stage named on the line; counts under ten are dropped."""
    stage = None
    for name, p in stages:
        stage = F.when(F.col("text").rlike(p), name) if stage is None else stage.when(F.col("text").rlike(p), name)
    found = lines.where(F.col("text").rlike(V.STAGE_SUBJECT)).select(
        K, "line", stage.otherwise("unknown").alias("stage"),
        F.explode(F.regexp_extract_all("text", F.lit(V.STAGE_COUNT), F.lit(1))).alias("raw"),
    )
    return found.withColumn("n", integer("raw")).where("n >= 10").drop("raw")


def pipe_tables(lines: DataFrame) -> DataFrame:
    """Rows of pipe tables: the line above a separator names the columns, rows of equal width follow."""
    sep = F.col("text").contains("|") & F.trim("text").rlike(r"^[| :\-]+$") & F.col("_prev").contains("|")
    d = previous_row(lines, [K], "line", F.col("text"), "_prev").withColumn("_sep", F.coalesce(sep, F.lit(False)))
    d = last_known(d, [K], "line", F.when(F.col("_sep"), F.struct(F.col("line").alias("at"), F.col("_prev").alias("head"))), "_tbl")
    d = last_known(d, [K], "line", F.when(~F.trim("text").startswith("|") & ~F.col("_sep"), F.col("line")), "_brk")

    def cells(c) -> Column:
        inner = F.regexp_replace(F.trim(c), r"^\|+|\|+$", "")
        return F.transform(F.split(inner, r"\|"), lambda x: T.norm_text(x))

    body = d.where(
        ~F.col("_sep") & F.trim("text").startswith("|") & (F.col("_tbl.at") > F.coalesce("_brk", F.lit(0))) & (F.col("line") > F.col("_tbl.at"))
    ).select(K, F.col("_tbl.at").alias("table_line"), "line", cells("_tbl.head").alias("columns"), cells("text").alias("values"))
    return body.where(F.size("columns") == F.size("values"))


def table_value(row: str, *aliases: str) -> Column:
    """Value of the first alias that names a column, ignoring case and blanks; null when none does."""
    names = F.transform(f"{row}columns" if row else "columns", lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", "")))
    vals = F.col(f"{row}values" if row else "values")
    picks = []
    for a in aliases:
        at = F.array_position(names, F.lit(a.lower().replace(" ", "")))
        picks.append(F.when(at > 0, F.get(vals, at.cast("int") - 1)))
    return F.coalesce(*picks)


def bullets(lines: DataFrame) -> DataFrame:
    t = F.trim("text")
    item = F.when(t.startswith("- "), F.trim(F.regexp_replace(t, "^- ", ""))).when(
        t.rlike(r"^\d+\.\s+"), F.regexp_replace(t, r"^\d+\.\s+", "")
    )
    return lines.select(K, "line", item.alias("item")).where("item is not null")


def verdict(lines: DataFrame) -> DataFrame:
    v = lines.select(K, "line", F.trim(F.regexp_extract("text", V.VERDICT, 1)).alias("verdict")).where("verdict <> ''")
    return v.groupBy(K).agg(F.min_by("verdict", "line").alias("verdict"))


def headings(lines: DataFrame) -> DataFrame:
    p = r"^(#{1,6})\s+(.+?)\s*$"
    return lines.where(F.col("text").rlike(p)).select(
        K, "line", F.length(F.regexp_extract("text", p, 1)).alias("level"), F.regexp_extract("text", p, 2).alias("title")
    )


def links(lines: DataFrame) -> DataFrame:
    p = r"\[[^\]]+\]\(([^)]+)\)"
    target = F.regexp_replace(F.trim("t"), r"^<\s*(.*?)\s*>$", "$1")
    return lines.select(K, "line", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("t")).select(
        K, "line", target.alias("target")
    )


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Link targets of raw pages, the same operator on the other markup."""
    p = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(p), F.lit(1))).alias("target"))


def issue_blocks(lines: DataFrame, child_prefix: str = "具体错误") -> DataFrame:
    """Lines of issue blocks: block id, severity, title, and the number of the child error they belong to."""
    head = r"^###\s+((?:P0?1|S)-\d+)\s+\[(FATAL|CRITICAL|MAJOR|WARNING|INFO)\]\s+(.+?)\s*$"
    child = rf"(?U)^####\s+{child_prefix}\s*(\d+)\s*[：:]\s*(.+?)\s*$"
    is_head = F.col("text").rlike(head)
    ends = F.col("text").rlike(r"^#{1,3}\s")
    mark = F.when(ends, F.struct(
        F.col("line").alias("at"), F.regexp_extract("text", head, 1).alias("id"),
        F.regexp_extract("text", head, 2).alias("severity"), F.regexp_extract("text", head, 3).alias("title"),
    ))
    d = last_known(lines, [K], "line", mark, "_b")
    cmark = F.when(ends, F.struct(F.lit(None).cast("long").alias("no"))).when(
        F.col("text").rlike(child), F.struct(F.regexp_extract("text", child, 1).cast("long").alias("no"))
    )
    d = last_known(d, [K], "line", cmark, "_c")
    return d.where(F.col("_b.id") != "").select(
        K, F.col("_b.id").alias("issue_id"), F.col("_b.severity").alias("severity"), F.col("_b.title").alias("title"),
        F.col("_b.at").alias("block_line"), "line", F.col("_c.no").alias("child_no"), is_head.alias("is_heading"),
        F.col("text").rlike(child).alias("is_child_heading"), "text",
    )


# --- code facts -----------------------------------------------------------------------------------


def packages(code: DataFrame, base: list[str] = V.BASE_PACKAGES) -> DataFrame:
    r = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in V.R_PACKAGES]))
    py = F.regexp_extract("text", V.PY_PACKAGE, 1)
    found = F.when(F.col("lang") == "R", r).otherwise(F.filter(F.array(py), lambda p: p != ""))
    return code.select(K, "path", F.explode(found).alias("package")).where(~F.col("package").isin(base)).distinct()


def parameters(code: DataFrame, config: bool = False) -> DataFrame:
    rules = V.PARAMETER_RULES + (V.CONFIG_RULES if config else [])
    out = extract(code, rules)
    return out.select(K, "path", "line", "kind", "value").withColumn("source", F.lit("config" if config else "code"))


def io_refs(code: DataFrame) -> DataFrame:
    verb = F.lower(F.regexp_extract("text", V.IO_VERB, 1))
    return code.select(
        K, "path", "line", F.explode(F.regexp_extract_all("text", F.lit(V.IO_REF), F.lit(1))).alias("ref_path"),
        F.when(verb.isin(V.OUTPUT_VERBS), "output").otherwise("input").alias("direction"),
    )


def models(code: DataFrame) -> DataFrame:
    """Model formulas: name, function, response and the sorted set of predictors; comment lines are skipped."""
    rhs = F.regexp_replace(F.regexp_extract("text", V.MODEL, 4), r"\s*,?\s*data\s*=.*", "")
    clean = F.transform(F.split(rhs, r"\+"), lambda p: F.trim(F.regexp_replace(p, r"[()]", "")))
    preds = F.array_sort(F.array_distinct(F.filter(clean, lambda p: p.rlike(r"^[A-Za-z_][\w.]*$"))))
    return (
        # the tilde test is cheap and keeps the pattern away from all other lines
        code.where(F.col("text").contains("~") & ~F.trim("text").startswith("#") & F.col("text").rlike(V.MODEL))
        .select(
            K, "path", "line", F.regexp_extract("text", V.MODEL, 1).alias("model"),
            F.lower(F.regexp_extract("text", V.MODEL, 2)).alias("function"),
            F.regexp_extract("text", V.MODEL, 3).alias("response"), preds.alias("predictors"),
        )
        .where(F.size("predictors") > 0)
    )


def symbol_vectors(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Members of quoted vectors ``x <- c("A", "B")``; vectors of the given names win over all others."""
    p = r"""(?s)([A-Za-z_][\w.]*)\s*(?:<-|=)\s*c\(\s*((?:["'][^"']*["']\s*,?\s*)+)\)"""
    zipped = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("vector"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("body")
    )
    if names:
        own = F.filter(zipped, lambda z: F.lower(z["vector"]).isin([n.lower() for n in names]))
        zipped = F.when(F.size(own) > 0, own).otherwise(zipped)
    each = files.select(K, "path", F.explode(zipped).alias("z"))
    return each.select(
        K, "path", F.col("z.vector").alias("vector"),
        F.explode(F.regexp_extract_all("z.body", F.lit(r"""["']([^"']+)["']"""), F.lit(1))).alias("member"),
    ).distinct()


def _vector(c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[c(]+", ""), r"\)+$", "")
    vals = F.transform(F.split(body, ","), lambda p: F.trim(p).try_cast("double"))
    return F.filter(vals, lambda v: v.isNotNull())


def plot_filter_thresholds(files: DataFrame) -> DataFrame:
    """Plot and filter cut-offs of each code file, each by its order of precedence."""
    def allm(name: str) -> Column:
        return F.regexp_extract_all("text", F.lit(V.PLOT_PATTERNS[name]), F.lit(1))

    def head(a: Column) -> Column:
        return F.get(a, F.lit(0))

    pair_lines = F.filter(F.transform(allm("vline"), _vector), lambda v: F.size(v) == 2)
    vline = F.abs(head(head(pair_lines)))
    hline = head(head(F.filter(F.transform(allm("hline"), _vector), lambda v: F.size(v) > 0)))
    breaks = F.abs(head(_vector(head(allm("breaks")))))
    variable = head(allm("threshold")).try_cast("double")

    def pair(name: str) -> Column:
        a = allm(name)
        return F.when(F.size(a) == 2, F.abs(head(a).try_cast("double")))

    def first_of(patterns: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")).try_cast("double") for p in patterns])

    return files.select(
        K, "path",
        F.coalesce(variable, vline, breaks, pair("axvline"), pair("plt_axvline")).alias("plot_effect"),
        F.coalesce(hline, head(allm("axhline")).try_cast("double"), head(allm("plt_axhline")).try_cast("double")).alias("plot_p"),
        first_of(V.FILTER_EFFECT).alias("filter_effect"),
        first_of(V.FILTER_P).alias("filter_p"),
    )


def resource_files(code: DataFrame, pattern: str = V.SET_FILE) -> DataFrame:
    """Quoted set-file names in code with the species their name tells."""
    refs = code.select(K, "path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("ref")).distinct()
    return refs.withColumn("species", T.species_of_name(T.path_name("ref")))


# --- result tables --------------------------------------------------------------------------------


def resolve_column(meta: DataFrame, rows: DataFrame, candidates: list[str], pattern: str = V.SYMBOL_LIKE) -> DataFrame:
    """Column of each table for a role: first candidate that names a column (case ignored), else the first
    column when at least half of its values look like the role."""
    low = F.transform("header", lambda h: F.lower(F.trim(h)))
    named = F.coalesce(*[
        F.when(F.array_position(low, F.lit(c.lower())) > 0, F.get("header", F.array_position(low, F.lit(c.lower())).cast("int") - 1))
        for c in candidates
    ])
    m = meta.select(K, "path", named.alias("named"), F.get("header", F.lit(0)).alias("first"))
    probe = rows.join(m.where("named is null"), [K, "path"]).select(K, "path", F.try_element_at("cells", F.col("first")).alias("v"))
    share = probe.where("v is not null").groupBy(K, "path").agg(F.avg(F.col("v").rlike(pattern).cast("double")).alias("share"))
    out = m.join(share, [K, "path"], "left")
    chosen = F.coalesce("named", F.when(F.col("share") >= 0.5, F.col("first")))
    return out.select(K, "path", chosen.alias("column"), F.when(F.col("named").isNotNull(), "name").when(chosen.isNotNull(), "content").alias("found_by"))
