"""Claims against evidence: joins between what a report says and what was measured or delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.keyed import FEW_NEEDLES, contains_join, first_k, keep_first, matching, samples
from claimgrid.functions.numbers import integer, number, whole
from claimgrid.functions.ordered import bracket, last_known, missing_between
from claimgrid.operators.extract import K, extract
from claimgrid.rules import values as V
from claimgrid.session import cut


# --- counts ---------------------------------------------------------------------------------------


def _distance(value: str, below: str, above: str) -> Column:
    return F.least(F.col(value) - F.col(below), F.col(above) - F.col(value))


def crossref(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """Judge each measured count against the claims of its label.

    ``claims``: project_id, label, claimed. ``counts``: project_id, label, path, total, significant (nullable).
    Outcomes, first that holds: ok (a claim within 1 of the total), ok_significant (within 1 of the
    significant rows), subset (every claim is smaller), close (within max(5, 10 %)), mismatch.
    """
    # nearest claims around each measured value, totals and significant rows in one pass; the claims of a
    # label are never gathered
    probes = counts.select(K, "label", F.explode(F.array(F.col("total").cast("long"), F.col("significant").cast("long"))).alias("_v"))
    b = bracket(claims.select(K, "label", F.col("claimed").cast("long").alias("_v")), probes, [K, "label"], "_v")
    near = b.select(K, "label", F.col("_v").alias("total"), F.col("below").alias("t_below"), F.col("above").alias("t_above"))
    near_sig = b.select(K, "label", F.col("_v").alias("significant"), F.col("below").alias("s_below"), F.col("above").alias("s_above"))
    d = counts.join(near, [K, "label", "total"]).where("t_below is not null or t_above is not null")
    d = d.join(near_sig, [K, "label", "significant"], "left")
    gap = _distance("total", "t_below", "t_above")
    sig_gap = F.when(F.col("significant") != F.col("total"), _distance("significant", "s_below", "s_above"))
    tol = F.greatest(F.lit(5).cast("long"), F.floor(F.col("total") * 0.1))
    outcome = (
        F.when(gap <= 1, "ok").when(sig_gap <= 1, "ok_significant").when(F.col("t_above").isNull(), "subset")
        .when(gap <= tol, "close").otherwise("mismatch")
    )
    closest = F.when(F.col("t_above").isNull(), F.col("t_below")).when(F.col("t_below").isNull(), F.col("t_above")).when(
        F.col("total") - F.col("t_below") <= F.col("t_above") - F.col("total"), F.col("t_below")).otherwise(F.col("t_above"))
    sev = F.when(F.col("outcome").isin("subset", "close"), "WARNING").when(F.col("outcome") == "mismatch", "CRITICAL")
    return d.select(K, "label", "path", "total", "significant", outcome.alias("outcome"), closest.alias("closest_claim"), gap.alias("difference")).withColumn("severity", sev)


def category_counts(table_rows: DataFrame, claims: DataFrame, category: str, label_prefix: str = "") -> DataFrame:
    """Rows per category against claims of the same label; each claim off by more than one is a finding."""
    cat = F.upper(F.trim(F.try_element_at("cells", F.lit(category))))
    counted = table_rows.withColumn("label", F.concat(F.lit(label_prefix), cat)).where("label is not null")
    counted = counted.groupBy(K, "label").agg(F.count(F.lit(1)).alias("actual"))
    return claims.join(counted, [K, "label"]).where(F.abs(F.col("claimed") - F.col("actual")) > 1).withColumn("severity", F.lit("CRITICAL"))


def relative_gap(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """Relative difference of claimed and measured values: over 5 % is recorded, over 20 % is serious."""
    gap = F.abs(F.col("claimed") - F.col("actual")) / F.abs(F.nullif(F.col("actual"), F.lit(0)))
    d = claims.join(counts, [K, "label"]).withColumn("gap", gap)
    return d.withColumn("grade", F.when(F.col("gap") > 0.2, "serious").when(F.col("gap") > 0.05, "record").otherwise("ok"))


def entity_counts(meta: DataFrame, lines: DataFrame, unit: str = r"(?:条|个|pathways?)", tolerance: int = 2) -> DataFrame:
    """Table rows of the entity named in the file name against the count stated next to that name."""
    ent = meta.select(K, "path", "rows", T.entity_of_file(T.path_name("path")).alias("entity")).where("entity <> ''")
    p = rf"(?U)([A-Z][A-Z0-9]+)[^。\n]{{0,40}}?(\d[\d,]*)\s*{unit}"
    z = F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("entity"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("n"))
    said = lines.select(K, "line", F.explode(z).alias("z")).select(K, F.col("z.entity").alias("entity"), integer("z.n").alias("claimed")).distinct()
    return ent.join(said, [K, "entity"]).where(F.abs(F.col("rows") - F.col("claimed")) > tolerance).withColumn("severity", F.lit("WARNING"))


def list_counts(meta: DataFrame, lines: DataFrame, rules: list[tuple[str, str, str]], limit: int = 100) -> DataFrame:
    """Rows of a list table against counts in the same context. One exact claim clears the table; else the
    first claim (by line) below the limit and off by more than one is reported. Rules: (label, file, text)."""
    name = F.lower(T.path_stem("path"))
    tables = matching(meta, [(name.rlike(fp), {"label": lab}) for lab, fp, _ in rules], [K, "path", "rows"])
    said = extract(lines, [(lab, tp, 1) for lab, _, tp in rules]).select(
        K, "line", F.col("kind").alias("label"), integer("value").alias("claimed")).where("claimed is not null")
    # exact claims clear a table by an equi-join; the first wrong one is found per (project, label, rows)
    wanted = tables.select(K, "label", F.col("rows").alias("claimed")).distinct()
    clear = said.join(wanted, [K, "label", "claimed"], "left_semi").select(K, "label", F.col("claimed").alias("rows")).distinct()
    open_ = tables.join(clear, [K, "label", "rows"], "left_anti")
    # the first line per claimed value is enough; distinct values below the limit are at most ``limit``
    firsts = said.where(F.col("claimed") < limit).groupBy(K, "label", "claimed").agg(F.min("line").alias("line"))
    hit = open_.join(firsts, [K, "label"]).where(F.abs(F.col("claimed") - F.col("rows")) > 1)
    out = hit.groupBy(K, "label", "path", "rows").agg(F.min(F.struct("line", "claimed")).alias("c"))
    return out.select(K, "label", "path", "rows", F.col("c.line").alias("line"), F.col("c.claimed").alias("claimed")).withColumn("severity", F.lit("WARNING"))


# --- modules, methods, packages -------------------------------------------------------------------


def claimed_not_delivered(sections: DataFrame, dirs: DataFrame, folders=V.MODULE_FOLDERS) -> DataFrame:
    """Modules named in section titles with no delivered folder.

    Both sides are first turned into (project, keyword) by one projection each, so that the comparison
    is an equi anti-join. ``dirs``: project_id, dir.
    """
    t, d = F.col("title"), F.col("dir")
    said = matching(sections, [(t.contains(k), {"keyword": k}) for k in folders], [K, "section", "title", "line"])
    said = keep_first(said.withColumn("_neg", -F.col("line")), [K, "keyword"], ["_neg"]).drop("_neg")  # the last title counts
    have = matching(dirs, [(T.any_contains(F.lower(d), sorted({p.lower() for p in ps})) | d.contains(k), {"keyword": k}) for k, ps in folders.items()], [K])
    return said.join(have.distinct(), [K, "keyword"], "left_anti").withColumn("severity", F.lit("WARNING"))


def methods_not_delivered(lines: DataFrame, dirs: DataFrame, folders=V.METHOD_FOLDERS) -> DataFrame:
    """Methods mentioned anywhere in the text with no matching folder; first line and number of mentions."""
    low = F.lower("text")
    said = matching(lines, [(low.contains(m.lower()), {"method": m}) for m in folders], [K, "line"])
    said = said.groupBy(K, "method").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("mentions"))
    have = matching(dirs, [(T.any_contains(F.lower("dir"), ps), {"method": m}) for m, ps in folders.items()], [K]).distinct()
    return said.join(have, [K, "method"], "left_anti").withColumn("severity", F.lit("WARNING"))


def reported_modules_missing(lines: DataFrame, dirs: DataFrame, modules=V.REPORTED_MODULES) -> DataFrame:
    low, d = F.lower("text"), F.lower("dir")
    said = matching(lines, [(T.any_contains(low, [w.lower() for w in ws]), {"module": m}) for m, (ws, _) in modules.items()], [K]).distinct()
    have = matching(dirs, [(T.any_contains(d, ks), {"module": m}) for m, (_, ks) in modules.items()], [K]).distinct()
    return said.join(have, [K, "module"], "left_anti").withColumn("severity", F.lit("CRITICAL"))


def delivered_not_claimed(files: DataFrame, lines: DataFrame, mentions=V.MODULE_MENTIONS) -> DataFrame:
    """Folders with results (table, PDF or PNG) whose kind of analysis the report never mentions.

    ``files``: project_id, module, path. A folder takes the first kind whose keyword its name holds.
    """
    kind = T.first_class(F.lower("module"), {k: [w.lower() for w in ws] for k, ws in mentions.items()}, "")
    content = files.where(T.path_suffix("path").isin(".csv", ".pdf", ".png"))
    dirs = content.select(K, "module").distinct().withColumn("kind", kind).where("kind <> ''")
    low = F.lower("text")
    said = matching(lines, [(T.any_contains(low, [w.lower() for w in ws]), {"kind": k}) for k, ws in mentions.items()], [K]).distinct()
    return dirs.join(said, [K, "kind"], "left_anti").withColumn("severity", F.lit("WARNING"))


def method_without_package(lines: DataFrame, packages: DataFrame, table=V.METHOD_PACKAGES) -> DataFrame:
    """Methods named in the report that none of their packages supports; projects without packages are skipped."""
    said = matching(lines, [(F.col("text").contains(m), {"method": m}) for m in table], [K]).distinct()
    have = matching(packages, [(F.col("package").isin(ps), {"method": m}) for m, ps in table.items()], [K]).distinct()
    known = packages.select(K).distinct()
    return said.join(known, K, "left_semi").join(have, [K, "method"], "left_anti").withColumn("severity", F.lit("WARNING"))


def method_without_code(lines: DataFrame, code: DataFrame, table=V.METHOD_CODE) -> DataFrame:
    """Methods named in the report whose function call no code line holds; projects without code are skipped."""
    said = matching(lines, [(F.col("text").contains(m), {"method": m}) for m in table], [K]).distinct()
    have = matching(code, [(F.col("text").rlike(p), {"method": m}) for m, p in table.items()], [K]).distinct()
    return said.join(code.select(K).distinct(), K, "left_semi").join(have, [K, "method"], "left_anti").withColumn("severity", F.lit("CRITICAL"))


def method_parameter(methods: DataFrame, parameters: DataFrame, table=V.METHOD_PARAMETERS) -> DataFrame:
    """Key parameter of a named method that differs from the definition of the method."""
    cases = [(F.col("method") == m, {"parameter": p, "expected": ",".join(v)}) for m, p, v in table]
    need = matching(methods, cases, [K, "method"])
    wrong = ~F.array_contains(F.split("expected", ","), F.col("value"))
    return need.join(parameters, [K, "parameter"]).where(wrong).select(K, "method", "parameter", "path", "value", "expected").withColumn("severity", F.lit("MAJOR"))


# --- identifiers and paths ------------------------------------------------------------------------


def dataset_presence(report_ids: DataFrame, dir_ids: DataFrame, code_ids: DataFrame) -> DataFrame:
    """Where each data set is named (report, folders, code) and what the combination means."""
    def tag(d: DataFrame, name: str) -> DataFrame:
        return d.select(K, F.col("dataset"), F.lit(name).alias("src"))

    every = tag(report_ids, "report").unionByName(tag(dir_ids, "dirs")).unionByName(tag(code_ids, "code"))
    d = every.groupBy(K, "dataset").agg(*[F.bool_or(F.col("src") == s).alias(f"in_{s}") for s in ("report", "dirs", "code")])
    r, f, c = F.col("in_report"), F.col("in_dirs"), F.col("in_code")
    case = (
        F.when(c & ~f & ~r, "code_only").when(c & ~f & r, "no_folder").when(r & ~f & ~c, "report_only").when(f & ~r, "unreported")
    )
    sev = F.when(c & ~f & ~r, "MAJOR").when(f & ~r, "WARNING").when(~f, "INFO")
    return d.withColumn("status", F.coalesce(case, F.lit("consistent"))).withColumn("severity", sev)


def citation_check(citations: DataFrame, references: DataFrame, mentions: DataFrame, names=V.DATABASE_REFERENCES) -> DataFrame:
    """Citations whose number does not exist or points to another resource, and mentions without a number.

    ``mentions``: project_id, resource. Only projects with a reference list are judged. A cited range is one row for each
    problem, with the first and last number that has it and how many have it.
    """
    citations = cut(citations.select(K, "resource", "ref", "ref_to").distinct())  # read five times below, as the others: each text is searched once
    have_list = cut(references.groupBy(K).agg(F.max("ref").alias("_max")))
    low = F.lower("reference")
    fits = cut(matching(references, [(T.any_contains(low, ws), {"resource": n}) for n, ws in names.items()], [K, "ref"]))
    cand = samples(fits.withColumn("ref", F.lpad(F.col("ref").cast("string"), 6, "0")), [K, "resource"], "ref", 10, "candidates")
    cited = cut(citations.join(have_list, K))
    layout = [K, "resource", "ref", "ref_to", (F.col("ref_to") - F.col("ref") + 1).alias("refs"), F.lit("out_of_range").alias("problem")]
    below = cited.where("ref < 1").withColumn("ref_to", F.least("ref_to", F.lit(0))).select(*layout)
    above = cited.where("ref_to > _max").withColumn("ref", F.greatest("ref", F.col("_max") + 1)).select(*layout)
    within = cited.select(K, "resource", F.greatest("ref", F.lit(1)).alias("lo"), F.least("ref_to", "_max").alias("hi")).where("lo <= hi").distinct()
    wrong = missing_between(within, fits, [K, "resource"], "ref").select(
        K, "resource", F.col("first_missing").alias("ref"), F.col("last_missing").alias("ref_to"), F.col("missing").alias("refs"), F.lit("mismatch").alias("problem"))
    bare = (
        mentions.select(K, "resource").distinct().join(have_list.select(K), K, "left_semi")
        .join(citations.select(K, "resource").distinct(), [K, "resource"], "left_anti")
        .select(K, "resource", *[F.lit(None).cast("long").alias(c) for c in ("ref", "ref_to", "refs")], F.lit("no_citation").alias("problem"))
    )
    sev = F.when(F.col("problem") == "no_citation", "MAJOR").otherwise("CRITICAL")
    return below.unionByName(above).unionByName(wrong).unionByName(bare).join(cand, [K, "resource"], "left").withColumn("severity", sev)


def path_claims(lines: DataFrame) -> DataFrame:
    """Result files and folders the report points to, first line of each."""
    refs = lines.select(K, "line", F.explode(F.regexp_extract_all("text", F.lit(V.RESULT_FILE_REF), F.lit(1))).alias("p"))
    clean = F.regexp_replace("p", r"[，。；）)、/]+$", "")
    return refs.select(K, "line", clean.alias("claimed_path")).groupBy(K, "claimed_path").agg(F.min("line").alias("line"))


def missing_paths(claimed: DataFrame, files: DataFrame) -> DataFrame:
    """Claimed paths that are neither a delivered file nor a folder above one (top folder optional).

    Of the files and their folders only what is claimed is kept before anything is gathered. Claims are read twice and are
    written once, which also tells the planner their size before it meets the files."""
    claimed = cut(claimed)
    parts = T.path_parts("path")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    below = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(inner)), lambda n: F.concat_ws("/", F.slice(inner, F.lit(1), n))))
    have = files.select(K, F.explode(F.concat(ups, F.coalesce(below, F.array().cast("array<string>")))).alias("claimed_path"))
    have = have.join(claimed.select(K, "claimed_path").distinct(), [K, "claimed_path"], "left_semi").distinct()
    return claimed.join(have, [K, "claimed_path"], "left_anti").withColumn("severity", F.lit("MAJOR"))


def missing_in_range(lines: DataFrame) -> DataFrame:
    """Figure numbers inside a claimed range 'Fig 1-2 ~ Fig 1-9' that occur nowhere in the text."""
    p = V.FIGURE_RANGE
    g = [F.regexp_extract_all("text", F.lit(p), F.lit(i)).alias(n) for i, n in enumerate(["p1", "a", "p2", "b"], 1)]
    r = lines.select(K, "line", F.explode(F.arrays_zip(*g)).alias("r")).where("r.p1 = r.p2")
    need = r.select(K, "line", F.col("r.p1").alias("prefix"), whole(F.col("r.a")).alias("lo"), whole(F.col("r.b")).alias("hi")).where("lo <= hi")
    seen = lines.select(K, F.explode(F.regexp_extract_all(F.replace("text", F.lit(" ")), F.lit(r"Fig\.?(\d+-\d+)"), F.lit(1))).alias("f"))
    seen = seen.select(K, F.split("f", "-")[0].alias("prefix"), whole(F.split("f", "-")[1]).alias("n"))
    found = missing_between(need, seen, [K, "prefix"], "n")
    per = found.groupBy(K, "line", "prefix").agg(F.sum("missing").alias("missing"), F.min("first_missing").alias("first_missing"), F.max("last_missing").alias("last_missing"))
    return per.withColumn("severity", F.lit("MAJOR"))


def claim_without_asset(lines: DataFrame, markers: DataFrame, dirs: DataFrame, files: DataFrame, words: list[str], dir_words: list[str]) -> DataFrame:
    """A module is described and no figure follows, or its folders hold no file. ``files`` carries ``dir``."""
    first = lines.where(T.any_contains(F.col("text"), words)).groupBy(K).agg(F.min("line").alias("first_line"))
    last = markers.groupBy(K).agg(F.max("line").alias("last_marker"))
    no_fig = first.join(last, K, "left").where("last_marker is null or last_marker < first_line").select(K, "first_line", F.lit("no_figure").alias("problem"))
    cand = dirs.where(T.any_contains(F.lower("dir"), dir_words)).select(K, "dir").distinct()
    filled = cand.join(files.select(K, "dir").distinct(), [K, "dir"], "left_semi").select(K).distinct()
    empty = first.join(cand.select(K).distinct(), K, "left_semi").join(filled, K, "left_anti").select(K, "first_line", F.lit("empty_folder").alias("problem"))
    return no_fig.unionByName(empty).withColumn("severity", F.lit("CRITICAL"))


# --- thresholds -----------------------------------------------------------------------------------


def threshold_mismatch(report: DataFrame, code: DataFrame, tolerance: float = V.EFFECT_TOLERANCE) -> DataFrame:
    """Code values that no report value equals, with the range of the report values they conflict with.

    One row per project, label and code value. Conflicts are counted, not listed pair by pair: values of
    p conflict with every report value, effect sizes with those more than the tolerance away.
    """
    rep = report.select(K, "label", "value").distinct()
    span = rep.groupBy(K, "label").agg(F.min("value").alias("report_min"), F.max("value").alias("report_max"), F.count(F.lit(1)).alias("_n"))
    cod = code.groupBy(K, "label", "value").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("uses"))
    open_ = cod.join(rep, [K, "label", "value"], "left_anti").join(span, [K, "label"])
    # report values within the tolerance lie in the same or a neighbouring band of that width
    band = F.floor(F.col("value") / tolerance).cast("long")
    near = open_.select(K, "label", F.col("value").alias("_c"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    close = near.join(rep.select(K, "label", F.col("value").alias("_r"), band.alias("_band")), [K, "label", "_band"])
    close = close.where(F.abs(F.col("_r") - F.col("_c")) <= tolerance).groupBy(K, "label", F.col("_c").alias("value")).agg(F.count(F.lit(1)).alias("_close"))
    is_effect = F.col("label") == "logFC threshold"
    d = open_.join(close, [K, "label", "value"], "left")
    d = d.withColumn("conflicts", F.col("_n") - F.when(is_effect, F.coalesce("_close", F.lit(0))).otherwise(0))
    direction = (
        F.when(F.col("report_min") > F.col("value"), "report_larger").when(F.col("report_max") < F.col("value"), "report_smaller").otherwise("both")
    )
    return d.where("conflicts > 0").select(K, "label", F.col("value").alias("code_value"), "path", "uses", "report_min", "report_max", "conflicts", direction.alias("direction")).withColumn("severity", F.lit("CRITICAL"))


def script_threshold_mismatch(code: DataFrame) -> DataFrame:
    d = code.groupBy(K, "label").agg(
        F.countDistinct("value").alias("values"), F.count(F.lit(1)).alias("uses"), F.min("value").alias("smallest"), F.max("value").alias("largest"))
    return d.where("values > 1").withColumn("severity", F.lit("WARNING"))


def plot_mismatch(thresholds: DataFrame) -> DataFrame:
    """Plot and filter cut-offs of one file that differ by more than their tolerance."""
    rules = [
        (F.abs(F.col("plot_effect") - F.col("filter_effect")) > V.EFFECT_TOLERANCE, {"kind": "effect", "plot": F.col("plot_effect"), "filter": F.col("filter_effect")}),
        (F.abs(F.col("plot_p") - F.col("filter_p")) > V.P_TOLERANCE, {"kind": "p", "plot": F.col("plot_p"), "filter": F.col("filter_p")}),
    ]
    return matching(thresholds, rules, [K, "path"]).withColumn("severity", F.lit("CRITICAL"))


# --- sets -----------------------------------------------------------------------------------------


def set_flow(upstream: DataFrame, downstream: DataFrame, keys: list[str], member: str, unused_limit: int = 5) -> DataFrame:
    """Members used downstream that upstream does not have, and upstream members left unused."""
    up, down = upstream.select(*keys, member).distinct(), downstream.select(*keys, member).distinct()
    both = up.select(*keys).distinct().join(down.select(*keys).distinct(), keys, "left_semi")
    tagged = up.withColumn("_s", F.lit(1)).unionByName(down.withColumn("_s", F.lit(2))).groupBy(*keys, member).agg(F.sum("_s").alias("_s"))
    d = tagged.groupBy(*keys).agg(
        F.count_if(F.col("_s") != 2).alias("upstream"), F.count_if(F.col("_s") != 1).alias("downstream"),
        F.count_if(F.col("_s") == 2).alias("unexpected"), F.count_if(F.col("_s") == 1).alias("unused"))
    bad = (F.col("unexpected") > 0) | (F.col("unused") > unused_limit)
    return d.join(both, keys, "left_semi").withColumn("severity", F.when(bad, "FATAL"))


def raw_p_downstream(results: DataFrame, downstream: DataFrame) -> DataFrame:
    """Variables positive by raw p, not by adjusted p, and still used downstream."""
    d = results.where((number("p") < 0.05) & ~(number("adjusted_p") < 0.05))
    return d.join(downstream.select(K, "variable").distinct(), [K, "variable"], "left_semi").withColumn("severity", F.lit("MAJOR"))


def unknown_symbols(symbols: DataFrame, table_symbols: DataFrame, distance: int = 2) -> DataFrame:
    """Symbols of the text that no result table holds, with the nearest table symbol within two edits.

    The table symbols of a project travel as one list to its symbols, where each is tested; the list holds FEW_NEEDLES
    symbols at most. Projects with more of them compare the rests of symbols instead.
    """
    have = table_symbols.select(K, "symbol").distinct()
    lost = symbols.select(K, "symbol").distinct().join(have, [K, "symbol"], "left_anti")
    dealt = [K, "_deal"]  # so that the join deals both sides out and a hot project can be split
    some = first_k(have.where("symbol is not null").withColumn("_deal", F.xxhash64(K)), dealt, [F.col("symbol")], FEW_NEEDLES + 1)
    lists = cut(some.groupBy(*dealt).agg(F.collect_list("symbol").alias("_all")).drop("_deal"))
    few, many = lists.where(F.size("_all") <= FEW_NEEDLES), lists.where(F.size("_all") > FEW_NEEDLES).select(K)
    edits = F.transform("_all", lambda s: F.struct(F.levenshtein("symbol", s).alias("_d"), s.alias("_s")))
    nearest = lambda d: d.join(few, K, "left").select(K, "symbol", F.array_min(F.filter(edits, lambda r: r["_d"] <= distance)).alias("b"))
    if many.isEmpty():
        best = nearest(lost)
    else:
        own = lost.join(many, K, "left_semi")
        near = _nearest_by_rests(own, have.join(many, K, "left_semi"), distance)
        best = nearest(lost.join(many, K, "left_anti")).unionByName(own.join(near, [K, "symbol"], "left"))
    return best.select(K, "symbol", F.col("b._s").alias("nearest"), F.col("b._d").alias("edits")).withColumn("severity", F.lit("WARNING"))


def _nearest_by_rests(lost: DataFrame, have: DataFrame, distance: int) -> DataFrame:
    """project_id, symbol, b (edits, nearest) for any number of table symbols.

    Two words within ``distance`` edits have a common rest after at most ``distance`` letters are left out of each,
    so candidates share the project and such a rest.
    """

    def rests(symbols: DataFrame) -> DataFrame:
        """Hashes of all rests of a symbol, made within its row; what two symbols have in common by chance falls to the
        edit distance below."""
        shorter = "transform(sequence(1, length(r)), i -> concat(substr(r, 1, i - 1), substr(r, i + 1)))"
        every = "array(symbol)"
        for _ in range(distance):
            every = f"array_distinct(flatten(transform({every}, r -> case when length(r) > 0 then concat(array(r), {shorter}) else array(r) end)))"
        return symbols.select(K, "symbol", F.explode(F.transform(F.expr(every), lambda r: F.xxhash64(r))).alias("_rest"))

    near = rests(lost).join(rests(have).withColumnRenamed("symbol", "_s"), [K, "_rest"]).select(K, "symbol", "_s").distinct()
    near = near.withColumn("_d", F.levenshtein("symbol", "_s")).where(F.col("_d") <= distance)
    return near.groupBy(K, "symbol").agg(F.min(F.struct("_d", "_s")).alias("b"))


# --- directions in sentences ----------------------------------------------------------------------


def mentions(sentences: DataFrame, variables: DataFrame) -> DataFrame:
    """Sentences joined to the variables one of whose aliases they mention."""
    aliases = variables.select(K, "variable", F.explode(T.variable_aliases("variable")).alias("alias"))
    hit = contains_join(sentences, "sentence", aliases, "alias", [K])
    return hit.drop("alias").distinct()


def direction_contradiction(sentences: DataFrame, directions: DataFrame) -> DataFrame:
    """A sentence says higher (or lower) about a variable whose table says the opposite."""
    stated = sentences.withColumn("stated", T.direction_words("sentence")).where("stated is not null")
    d = mentions(stated, directions.select(K, "variable")).join(directions.select(K, "variable", "direction"), [K, "variable"])
    return d.where("stated <> direction").withColumn("severity", F.lit("CRITICAL"))


def or_contradiction(sentences: DataFrame, regression: DataFrame) -> DataFrame:
    """Risk wording with an odds ratio below one, protective wording with one above."""
    s = sentences.withColumn("risk", T.says_risk("sentence")).withColumn("protective", T.says_protective("sentence")).where("risk or protective")
    rows = regression.select(K, "variable", number("odds_ratio").alias("odds_ratio")).where("odds_ratio <> 1")
    d = mentions(s, rows.select(K, "variable")).join(rows, [K, "variable"])
    return d.where("(risk and odds_ratio < 1) or (protective and odds_ratio > 1)").withColumn("severity", F.lit("CRITICAL"))


def label_swap(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs claimed significant that the table does not support.

    ``claims``: project_id, entity, partner. ``results``: project_id, entity, partner, p. Partner names
    agree when one holds the other, ignoring case, blanks and underscores. When another entity is
    significant for the same partner the labels look swapped.
    """
    c = cut(claims.select(K, F.upper("entity").alias("entity"), T.label_key("partner").alias("pk")).distinct())
    r = results.select(K, F.upper("entity").alias("r_entity"), T.label_key("partner").alias("rk"), number("p").alias("p")).where("p is not null")
    # results are reduced per partner before they meet the claims; what is read several times is written once
    per_pair = cut(r.groupBy(K, "rk", "r_entity").agg(F.min("p").alias("min_p")))
    rk, pk = per_pair.select(K, "rk").distinct(), c.select(K, "pk").distinct()
    one = contains_join(rk, "rk", pk, "pk", [K]).select(K, "rk", "pk")
    two = contains_join(pk, "pk", rk, "rk", [K]).select(K, "rk", "pk")
    match = cut(one.union(two).distinct())
    best = match.join(per_pair.where("min_p < 0.05"), [K, "rk"]).groupBy(K, "pk").agg(F.min(F.struct(F.col("min_p"), F.col("r_entity"))).alias("b"))
    own = (
        c.join(match, [K, "pk"]).join(per_pair.withColumnRenamed("r_entity", "entity"), [K, "rk", "entity"])
        .groupBy(K, "entity", "pk").agg(F.min("min_p").alias("claimed_p"), F.max("min_p").alias("_max_p"))
    )
    d = own.where("claimed_p >= 0.05").join(best, [K, "pk"], "left")
    return d.select(
        K, "entity", F.col("pk").alias("partner"), "claimed_p", F.col("b.r_entity").alias("actual_entity"), F.col("b.min_p").alias("actual_p"),
        F.when(F.col("b").isNotNull(), "label_swap").otherwise("not_significant").alias("problem")).withColumn("severity", F.lit("CRITICAL"))


def best_selection(scores: DataFrame, selections: DataFrame) -> DataFrame:
    """The selected object is not the one with the lowest score."""
    best = scores.groupBy(K).agg(F.min(F.struct("score", "target")).alias("b"))
    d = selections.join(best, K)
    return d.where(F.col("target") != F.col("b.target")).select(
        K, F.col("target").alias("selected"), F.col("b.target").alias("best"), F.col("b.score").alias("best_score")).withColumn("severity", F.lit("MAJOR"))


def docking_scores(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, selections) read from score-table lines and from the first selection sentence."""
    p = r"^\s*([A-Z0-9]+)\s*\|.*?\|\s*(-?\d+(?:\.\d+)?)\s*$"
    s = lines.where(F.col("text").rlike(p)).select(K, F.regexp_extract("text", p, 1).alias("target"), number(F.regexp_extract("text", p, 2)).alias("score"))
    q = r"(?U)选择\s*([A-Z0-9]+)\s*[-–—]"
    sel = lines.where(T.any_contains(F.col("text"), ["分子动力学", "MD"]) & F.col("text").rlike(q))
    return s, sel.groupBy(K).agg(F.min_by(F.regexp_extract("text", q, 1), "line").alias("target"))


def with_section(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """As-of lookup: the section whose heading is the last at or before the fact's line."""
    marks = facts.select(K, "line").distinct().withColumn("section", F.lit(None).cast("string"))
    all_ = marks.unionByName(sections.select(K, "line", "section")).groupBy(K, "line").agg(F.max("section").alias("_s"))
    found = last_known(all_, [K], "line", F.col("_s"), "section").select(K, "line", "section")
    return facts.join(found, [K, "line"])
