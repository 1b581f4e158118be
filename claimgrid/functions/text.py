"""Scalar text functions: column in, column out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimgrid.rules import values as V


# every Unicode white space, written out: a plain class is much faster than a property class
BLANKS = r"[ \t\n\x0B\f\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def each(array: Column, name: str, **fixed: str) -> Column:
    """Array of structs: the element as ``name`` plus the fixed fields."""
    return F.transform(array, lambda v: F.struct(v.alias(name), *[F.lit(x).alias(k) for k, x in fixed.items()]))


def norm_text(c) -> Column:
    """Trim, fold full-width blanks and runs of white space to one blank; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), BLANKS, " "))


def norm_lower(c) -> Column:
    return F.lower(norm_text(c))


def norm_path(c) -> Column:
    return F.lower(F.replace(norm_text(c), F.lit("\\"), F.lit("/")))


def is_blank(c) -> Column:
    """``norm_text`` leaves nothing; told by the first letter that is no white space, without making the text."""
    return ~F.coalesce(col(c).cast("string"), F.lit("")).rlike(f"[^{BLANKS[1:-2]}]")


def first_filled(*cols) -> Column:
    """First non-blank of the fields, in order; '' when all are blank."""
    return F.coalesce(*[F.nullif(norm_text(c), F.lit("")) for c in cols], F.lit(""))


# --- dotted identifiers -------------------------------------------------------------------------


def id_prefix(c, levels: int) -> Column:
    return F.concat_ws(".", F.slice(F.split(col(c), r"\."), 1, levels))


def id_parent(c) -> Column:
    """'1.2.3' -> '1.2'; '' for a one-level id."""
    return F.regexp_replace(col(c), r"\.?[^.]*$", "")


def id_leaf(c) -> Column:
    return F.element_at(F.split(col(c), r"\."), -1).cast("long")


def id_depth(c) -> Column:
    return F.size(F.split(col(c), r"\."))


def id_relation(a, b) -> Column:
    """'equal', 'prefix' (one encloses the other), 'sibling' (same parent) or 'other'."""
    a, b = col(a), col(b)
    return (
        F.when(a == b, "equal")
        .when(a.startswith(F.concat(b, F.lit("."))) | b.startswith(F.concat(a, F.lit("."))), "prefix")
        .when((id_depth(a) == id_depth(b)) & (id_depth(a) > 1) & (id_parent(a) == id_parent(b)), "sibling")
        .otherwise("other")
    )


# --- similarity and labels ----------------------------------------------------------------------


def tokens(c) -> Column:
    return F.array_distinct(F.filter(F.split(norm_lower(c), " "), lambda t: F.length(t) > 0))


def token_jaccard(a, b) -> Column:
    """Shared tokens over all tokens; 0 when either side has none."""
    ta, tb = tokens(a), tokens(b)
    return F.when(
        (F.size(ta) > 0) & (F.size(tb) > 0),
        F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb)),
    ).otherwise(F.lit(0.0))


def label_key(c) -> Column:
    return F.translate(F.lower(col(c)), " _", "")


def labels_agree(a, b) -> Column:
    ka, kb = label_key(a), label_key(b)
    return (ka == kb) | ka.contains(kb) | kb.contains(ka)


def heading_slug(c) -> Column:
    kept = F.regexp_replace(F.lower(F.trim(col(c))), r"(?U)[^\w\s\-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", "-"), r"^-+|-+$", "")


# --- paths --------------------------------------------------------------------------------------


def path_parts(c) -> Column:
    return F.split(F.replace(col(c), F.lit("\\"), F.lit("/")), "/")


def path_name(c) -> Column:
    return F.element_at(path_parts(c), -1)


def path_suffix(c) -> Column:
    return F.lower(F.regexp_extract(path_name(c), r"[^.](\.[^.]+)$", 1))


def path_stem(c) -> Column:
    return F.regexp_replace(path_name(c), r"(?<=[^.])\.[^.]+$", "")


def path_depth(c) -> Column:
    return F.size(path_parts(c))


def module_label(c) -> Column:
    return F.regexp_replace(col(c), r"^\d+[_\-]", "")


def project_code(c) -> Column:
    return F.regexp_extract(col(c), V.PROJECT_CODE, 1)


def entity_of_file(c) -> Column:
    return F.regexp_extract(col(c), r"[_\-]([A-Z][A-Z0-9]+(?:[A-Za-z0-9]*)?)(?:[_\-.]|$)", 1)


# --- ordered literal rules ----------------------------------------------------------------------


def any_contains(c, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | col(c).contains(w)
    return cond


def first_class(c, table: dict[str, list[str]], default: str) -> Column:
    """Class of the first entry whose keyword list hits; the table order is the precedence."""
    out = None
    for name, words in table.items():
        hit = any_contains(c, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def asset_type(context, is_cover=None) -> Column:
    kind = first_class(F.lower(col(context)), V.ASSET_KEYWORDS, "unknown")
    return kind if is_cover is None else F.when(col(is_cover), "cover_decoration").otherwise(kind)


def asset_family(kind) -> Column:
    return (
        F.when(col(kind) == "heatmap", "heatmap_like")
        .when(col(kind).isin(V.CHART_TYPES), "chart_like")
        .otherwise("unknown")
    )


def asset_high_risk(kind) -> Column:
    return col(kind).isin(V.HIGH_RISK_ASSETS)


def symbol_class(c) -> Column:
    """Naming class of a gene symbol. Lower-case initials are tested on the text as written."""
    up = F.upper(F.trim(col(c)))
    return (
        F.when(up.rlike(r"-.*_|_.*-"), "protein_complex")
        .when(up.rlike(r"^MT-"), "mitochondrial")
        .when(up.rlike(r"^HLA-"), "hla")
        .when(up.rlike(r"^IG[KHVL]"), "immunoglobulin")
        .when(up.rlike(r"^(LINC\d|MIR\d|RP11-)"), "lncrna")
        .when(F.trim(col(c)).rlike(r"^[a-z]"), "lowercase")
        .when(up.rlike(r"[-_]"), "has_symbols")
        .when(up.contains(" "), "has_space")
        .otherwise("standard")
    )


def species_of_name(c) -> Column:
    """Species by marker in a file name. Short markers must stand alone between separators."""
    name = F.lower(col(c))
    out = None
    for species, markers in V.SPECIES_MARKERS.items():
        cond = F.lit(False)
        for m in markers:
            quoted = m.lower().replace(".", r"\.")
            cond = cond | (name.rlike(rf"(^|[^a-z0-9]){quoted}([^a-z0-9]|$)") if len(m) <= 3 else name.contains(m.lower()))
        out = F.when(cond, species) if out is None else out.when(cond, species)
    return out.otherwise("unknown")


def species_of_symbols(symbols) -> Column:
    """'human' when over 80 % of the set members are upper-case letters."""
    head = col(symbols)
    share = F.size(F.filter(head, lambda g: g.rlike(r"^[A-Z]+$"))) / F.greatest(F.size(head), F.lit(1))
    return F.when(share > 0.8, "human").otherwise("unknown")


def direction_words(c) -> Column:
    return F.when(any_contains(c, V.WORDS_HIGHER), "higher").when(any_contains(c, V.WORDS_LOWER), "lower")


def says_risk(c) -> Column:
    return any_contains(c, V.WORDS_RISK) | col(c).contains("OR>1")


def says_protective(c) -> Column:
    return any_contains(c, V.WORDS_PROTECTIVE) | col(c).contains("OR<1")


def cell_label(c) -> Column:
    """Chinese cell-type label to its English name; other text is returned as it is."""
    out = None
    for zh, en in V.CELL_LABELS.items():
        out = F.when(col(c) == zh, en) if out is None else out.when(col(c) == zh, en)
    return out.otherwise(col(c))


def variable_aliases(c) -> Column:
    """Names under which a table variable may appear in the text."""
    v = F.trim(col(c))
    spaced = F.translate(v, "._", "  ")
    raw = F.regexp_replace(v, r"(Yes|No|>=\d+|\d+)$", "")
    known = F.create_map(*[x for k, a in V.VARIABLE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, a)))])
    empty = F.array().cast("array<string>")
    pool = F.flatten(
        F.array(
            F.array(v, spaced, F.lower(spaced), raw, F.translate(raw, "._", "  ")),
            F.coalesce(F.try_element_at(known, v), empty),
            F.coalesce(F.try_element_at(known, raw), empty),
        )
    )
    return F.array_distinct(F.filter(pool, lambda a: F.length(a) > 0))


def replace_terms(c, mapping: dict[str, str]) -> Column:
    out = col(c)
    for term, better in mapping.items():
        out = F.replace(out, F.lit(term), F.lit(better))
    return out


def demote_heading(c) -> Column:
    """'### x' -> '## x'; a first-level heading stays."""
    return F.regexp_replace(col(c), r"^(#{1,5})#(\s+.+)$", "$1$2")
