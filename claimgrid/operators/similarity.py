"""Near and exact duplicates, nested models, and findings that resemble earlier ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F, Window

from claimgrid.functions import text as T
from claimgrid.functions.keyed import first_k
from claimgrid.functions.numbers import hamming
from claimgrid.operators.extract import K
from claimgrid.rules import values as V
from claimgrid.session import cut


# --- models ---------------------------------------------------------------------------------------


def predictor_sets(models: DataFrame) -> DataFrame:
    """Distinct predictor sets of each script with the first model that uses each. They are read several times, so both
    operators below write them once and models are extracted once."""
    return models.groupBy(K, "path", "predictors").agg(
        F.count(F.lit(1)).alias("models"), F.min(F.struct("line", "model")).alias("m")
    ).select(K, "path", "predictors", F.concat_ws(",", "predictors").alias("set_key"), "models", F.col("m.line").alias("line"), F.col("m.model").alias("model"),
             F.size("predictors").alias("size"))


def nested_models(models: DataFrame) -> DataFrame:
    """Pairs of predictor sets in one script where one is a proper subset of the other.

    Equal sets are collapsed first. A superset holds every predictor of the subset, so the subset looks
    for candidates under its rarest predictor only.
    """
    return _nested(cut(predictor_sets(models))).drop("small_key", "large_key").withColumn("severity", F.lit("CRITICAL"))


def _nested(sets: DataFrame) -> DataFrame:
    inv = sets.select(K, "path", F.explode("predictors").alias("_p"))
    freq = inv.groupBy(K, "path", "_p").agg(F.count(F.lit(1)).alias("_f"))
    small = sets.select("*", F.explode("predictors").alias("_p")).join(freq, [K, "path", "_p"])
    small = small.groupBy(K, "path", "predictors", "set_key", "model", "line", "size").agg(F.min(F.struct("_f", "_p")).alias("_k"))
    small = small.select(K, "path", F.col("_k._p").alias("_p"), F.struct("predictors", "set_key", "model", "line", "size").alias("a"))
    large = sets.select(K, "path", F.explode("predictors").alias("_p"), F.struct("predictors", "set_key", "model", "line", "size").alias("b"))
    pair = small.join(large, [K, "path", "_p"]).where(
        (F.col("b.size") > F.col("a.size")) & (F.size(F.array_except("a.predictors", "b.predictors")) == 0))
    return pair.select(
        K, "path", F.col("a.model").alias("model_small"), F.col("a.line").alias("line_small"), F.col("b.model").alias("model_large"),
        F.col("b.line").alias("line_large"), F.concat_ws(",", F.array_sort(F.array_except("b.predictors", "a.predictors"))).alias("missing"),
        F.col("a.set_key").alias("small_key"), F.col("b.set_key").alias("large_key"),
    )


def differing_models(models: DataFrame) -> DataFrame:
    """Sets of three or more predictors that differ both ways from others of the script, with their number.

    A set differs both ways from every other large set it is not nested with; the number follows from
    counts, so the pairs are not listed.
    """
    sets = cut(predictor_sets(models).where("size >= 3"))
    n = sets.groupBy(K, "path").agg(F.count(F.lit(1)).alias("_n"))
    pair = F.explode(F.array("small_key", "large_key")).alias("set_key")
    near = _nested(sets).select(K, "path", pair).groupBy(K, "path", "set_key").agg(F.count(F.lit(1)).alias("_nested"))
    d = sets.join(n, [K, "path"]).join(near, [K, "path", "set_key"], "left")
    d = d.withColumn("differs_from", F.col("_n") - 1 - F.coalesce("_nested", F.lit(0)))
    return d.where("differs_from > 0").select(K, "path", "model", "line", "size", "differs_from").withColumn("severity", F.lit("WARNING"))


# --- fingerprints ---------------------------------------------------------------------------------

BANDS = 8  # eight bands of eight bits: five differing bits leave at least three bands untouched


def _band_choices(max_dist: int) -> list[tuple[int, ...]]:
    """Every choice of the bands that must agree. Two fingerprints within the distance agree in at least one."""
    must = BANDS - max_dist
    if not 1 <= must <= 6:
        raise ValueError(f"max_dist must be between {BANDS - 6} and {BANDS - 1}")
    return list(combinations(range(BANDS), must))


def near_duplicates(fp: DataFrame, max_dist: int = 5) -> DataFrame:
    """Fingerprint pairs of a project within the Hamming distance.

    ``fp``: project_id, asset, fingerprint. Exact copies are collapsed to one row per fingerprint before
    any pair is formed, so a fingerprint shared by a third of all assets costs one row. Each fingerprint
    is then sent to the key of every choice of three of its eight bands (24 bits each), which finds all
    pairs within five bits. A pair counts under the first choice of bands in which it agrees only.

    The rows made for the keys are many times those they are made of, which the planner does not know, so the join on
    them is told never to broadcast. Only keys and fingerprints go through it; assets are joined to the pairs found.
    """
    one = fp.groupBy(K, "fingerprint").agg(F.min("asset").alias("asset"), F.count(F.lit(1)).alias("copies"))
    choices = _band_choices(max_dist)
    shifts = lambda bands: F.array(*[F.lit(8 * i) for i in bands]) if bands else F.array().cast("array<int>")
    key = F.expr("aggregate(c, cast(n as bigint), (acc, i) -> shiftleft(acc, 8) | (shiftrightunsigned(fingerprint, i) & 255))")
    keyed = one.select(K, "fingerprint", F.posexplode(F.array(*map(shifts, choices))).alias("n", "c")).select(K, "fingerprint", key.alias("_k"))
    a = keyed.select(K, "_k", F.col("fingerprint").alias("fp_a"))
    b = keyed.select(K, "_k", F.col("fingerprint").alias("fp_b"))
    met = a.join(b.hint("merge"), [K, "_k"]).where((F.col("fp_a") < F.col("fp_b")) & (hamming("fp_a", "fp_b") <= max_dist))
    earlier = F.array(*[shifts(sorted(set(range(c[-1])) - set(c))) for c in choices])
    at = F.shiftrightunsigned("_k", 8 * len(choices[0])).cast("int")
    agrees = lambda i: F.call_function("shiftrightunsigned", F.col("fp_a").bitwiseXOR(F.col("fp_b")), i).bitwiseAND(F.lit(255)) == 0
    met = met.where(~F.exists(F.get(earlier, at), agrees)).select(K, "fp_a", "fp_b")
    side = lambda x: one.select(K, F.col("fingerprint").alias(f"fp_{x}"), F.col("asset").alias(f"asset_{x}"), F.col("copies").alias(f"copies_{x}"))
    both = met.join(side("a").hint("shuffle_hash"), [K, "fp_a"]).join(side("b").hint("shuffle_hash"), [K, "fp_b"])
    first = F.col("asset_a") < F.col("asset_b")
    pick = lambda c, x, y: F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    near = both.where("asset_a <> asset_b").select(
        K, pick("asset", "a", "b").alias("asset_a"), pick("asset", "b", "a").alias("asset_b"), pick("copies", "a", "b").alias("copies_a"), pick("copies", "b", "a").alias("copies_b"),
        hamming("fp_a", "fp_b").alias("distance"))
    pairs = near.groupBy(K, "asset_a", "asset_b", "copies_a", "copies_b").agg(F.min("distance").alias("distance"))
    return pairs.withColumn("severity", F.lit("WARNING"))


def same_fingerprint(fp: DataFrame) -> DataFrame:
    """Fingerprints held by more than one asset: one row per group, with its first asset."""
    g = fp.groupBy(K, "fingerprint").agg(F.min("asset").alias("first_asset"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1").withColumn("severity", F.lit("CRITICAL"))


def exact_duplicates(files: DataFrame, content: str = "hash", name: str = "path", order: str | None = None) -> DataFrame:
    """Every file that repeats the content of an earlier one, with the first holder.

    The first holder per content is a map-side combined minimum, so copies are never gathered. The join
    back is skewed when one content has many copies; adaptive execution splits such a partition.
    """
    o = order or name
    first = files.groupBy(K, content).agg(F.min(F.struct(F.col(o).alias("o"), F.col(name).alias("n"))).alias("f"), F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1")
    d = files.join(first, [K, content]).where(F.col(o) > F.col("f.o"))
    return d.select(K, F.col(name).alias("duplicate"), F.col("f.n").alias("first_holder"), "copies").withColumn("severity", F.lit("CRITICAL"))


# --- captions, derivatives, inventories -----------------------------------------------------------


def captions(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("text").rlike(V.CAPTION)).select(
        K, "line", F.trim(F.regexp_extract("text", V.CAPTION, 1)).alias("figure_id"), F.substring(F.trim("text"), 1, 200).alias("caption"))


def nearest_caption(markers: DataFrame, captions: DataFrame, before: int = 2, after: int = 3) -> DataFrame:
    """Caption nearest to each marker within the line range; the earlier line wins a tie.

    The range is six lines, so each marker asks for six lines by an equi-join."""
    ask = markers.select(K, F.col("line").alias("at"), "file", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
    hit = ask.join(captions, [K, "line"]).withColumn("_d", F.abs(F.col("line") - F.col("at")))
    best = hit.groupBy(K, "at", "file").agg(F.min(F.struct("_d", "line", "figure_id", "caption")).alias("b"))
    return best.select(K, F.col("at").alias("line"), "file", F.col("b.figure_id").alias("figure_id"), F.col("b.caption").alias("caption"), F.col("b.line").alias("caption_line"))


def derivatives(assets: DataFrame) -> DataFrame:
    """For each unsupported asset the first supported one of the same origin and stem."""
    a = assets.withColumn("_stem", F.lower(T.path_stem("relative_path")))
    cand = a.where("format_status = 'supported'").groupBy(K, "origin", "_stem").agg(
        F.min(F.struct(F.col("asset_id").alias("id"), F.col("source_sha256").alias("sha"))).alias("c"))
    d = a.where("format_status <> 'supported'").join(cand, [K, "origin", "_stem"])
    return d.select(K, "asset_id", F.col("c.id").alias("derivative_asset_id"), "source_sha256", F.col("c.sha").alias("derivative_sha256"))


def conservation(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Current inventory against the recorded one: missing, extra, stale or conserved."""
    c = current.select(K, "asset_id", F.col("source_sha256").alias("now"), F.lit(True).alias("_c"))
    r = recorded.select(K, "asset_id", F.col("source_sha256").alias("then"), F.lit(True).alias("_r"))
    d = c.join(r, [K, "asset_id"], "full_outer")
    status = (
        F.when(F.col("_r").isNull(), "missing").when(F.col("_c").isNull(), "extra")
        .when(T.is_blank("now") | ~F.col("now").eqNullSafe(F.col("then")), "stale").otherwise("conserved"))
    return d.select(K, "asset_id", status.alias("status"))


def species_mismatch(classified: DataFrame, projects: DataFrame) -> DataFrame:
    d = classified.where("species <> 'unknown'").join(projects.select(K, F.col("species").alias("data_species")), K)
    return d.where("data_species <> 'unknown' and species <> data_species").withColumn("severity", F.lit("FATAL"))


def history_hints(findings: DataFrame, history: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """Past findings of the same category whose words have a Jaccard similarity of ``least`` with a current one, best
    ``k`` as hints.

    With n words here and p words there, at least a = t / (1 + t) x (n + p) must be common, so one of the n - a + 1 words
    that are rarest in the history must be. The more words the past finding has, the fewer and rarer words lead to it, and
    frequent words lead only to short ones. Only words of current findings are kept of the history. The score is exact
    for every candidate; their texts are joined last.
    """
    words = lambda d, name: d.select(F.col("finding_id").alias(name), "category", T.tokens("description").alias("_t")).withColumn("_size", F.size("_t"))
    now, past = words(findings, "finding_id"), words(history, "past_id")
    f = now.select("finding_id", "category", F.col("_size").alias("_n"), F.explode("_t").alias("_w"))
    h = past.select("past_id", "category", F.col("_size").alias("_p"), F.explode("_t").alias("_w"))
    used = cut(h.join(f.select("category", "_w").distinct(), ["category", "_w"], "left_semi"))  # the history is cut into words once
    freq = used.groupBy("category", "_w").agg(F.count(F.lit(1)).alias("_f"))
    turn = F.row_number().over(Window.partitionBy("finding_id").orderBy("_f", "_w"))  # words without any past finding stand first
    ranked = f.join(freq, ["category", "_w"], "left").withColumn("_turn", turn).where("_f is not null")
    t = least - 1e-6  # scores are rounded
    common = F.ceil(F.round(F.lit(t / (1 + t)) * (F.col("_n") + F.col("_p")), 6))
    near = ranked.join(used, ["category", "_w"]).where(F.col("_turn") <= F.col("_n") - common + 1).select("finding_id", "past_id").distinct()
    near = cut(near)  # read twice: once to choose the texts that are cut into words again
    met = history.select(F.col("finding_id").alias("past_id"), "description").join(near.select("past_id").distinct(), "past_id", "left_semi")
    both = near.join(now.select("finding_id", F.col("_t").alias("_a")), "finding_id").join(met.select("past_id", T.tokens("description").alias("_b")), "past_id")
    shared = F.size(F.array_intersect("_a", "_b"))
    scored = both.withColumn("score", F.round(shared / (F.size("_a") + F.size("_b") - shared), 6)).where(F.col("score") >= least)
    return first_k(scored.select("finding_id", "past_id", "score"), ["finding_id"], [F.desc("score"), F.asc("past_id")], k)
