"""Content keys: stable hashes that identify findings, clusters and files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimgrid.functions.text import col, norm_path, norm_text
from claimgrid.rules import values as V


def _joined(parts: list[Column], sep: str) -> Column:
    # concat_ws drops nulls, so every part is made non-null before it is joined.
    return F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])


def finding_key(dimension="dimension", rule="rule", source_type="source_type", source_path="source_path",
                locator="locator", quote="quote_or_value",
                fallback=("severity", "location", "description", "evidence")) -> Column:
    main = [norm_text(dimension), norm_text(rule), norm_text(source_type), norm_path(source_path), norm_text(locator), norm_text(quote)]
    spare = [norm_text(f) for f in fallback]
    any_filled = F.length(F.concat(*main)) > 0
    text = F.when(any_filled, _joined(main, "||")).otherwise(_joined(spare, "||"))
    return F.concat(F.lit("fk:"), F.substring(F.sha1(text), 1, 16))


def raw_finding_id(agent="agent", fid="id", source_type="source_type", source_path="source_path",
                   locator="locator", quote="quote_or_value") -> Column:
    parts = [norm_text(c) for c in (agent, fid, source_type, source_path, locator, quote)]
    return F.concat(F.lit("rf:"), F.substring(F.sha2(_joined(parts, "\x1f"), 256), 1, 20))


def cluster_key(key="finding_key") -> Column:
    """Hash of the five semantic fields when all are filled, else of the finding key."""
    fields = [F.lower(norm_text(f)) for f in V.SEMANTIC_FIELDS]
    full = F.lit(True)
    for f in fields:
        full = full & (F.length(f) > 0)
    text = F.when(full, _joined(fields, "\x1f")).otherwise(_joined([F.lit("legacy"), col(key)], "\x1f"))
    return F.concat(F.lit("ck:"), F.substring(F.sha2(text, 256), 1, 20))


def content_hash(c) -> Column:
    return F.sha2(col(c), 256)


def map_hash(c) -> Column:
    """Hash of a string map that does not depend on the order of its entries."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(c))))), 256)


def severity_rank(c) -> Column:
    out = F.lit(0)
    for name, rank in V.SEVERITY_RANK.items():
        out = F.when(col(c) == name, rank).otherwise(out)
    return out


def severity_name(rank) -> Column:
    out = F.lit("INFO")
    for name, r in V.SEVERITY_RANK.items():
        out = F.when(col(rank) == r, name).otherwise(out)
    return out


def effective_severity(check_id, severity, error_prefixes: list[str]) -> Column:
    raised = F.lit(False)
    for p in error_prefixes:
        raised = raised | col(check_id).startswith(p)
    return F.when((col(severity) == "warning") & raised, "error").otherwise(col(severity))
