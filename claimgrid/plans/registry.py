"""Check registry: checks are functions from tables to findings; the runner selects, unions and grades them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimgrid.functions.keys import finding_key
from claimgrid.operators.aggregate import quality_gate, severity_counts
from claimgrid.operators.compare import union_findings
from claimgrid.rules import values as V

FINDING = (
    "project_id string, check_id string, priority string, severity string, category string, message string, module string, path string, line bigint, "
    "claimed string, actual string, context string, evidence string, finding_key string"
)
#: Names of severities that some rules use, and the one of the five they count as.
SEVERITY_NAMES = {"SERIOUS": "CRITICAL", "ERROR": "MAJOR", "WARN": "WARNING", "NOTE": "INFO"}
COLUMNS = [p.split()[0] for p in FINDING.split(", ")]


@dataclass
class Tables:
    """Input tables by name, such as report_lines, code_lines, files, table_meta, projects."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def has(self, names: set[str]) -> bool:
        return names <= set(self.frames)


@dataclass(frozen=True)
class Check:
    check_id: str
    priority: str
    needs: frozenset[str]
    fn: Callable[[Tables], DataFrame]


CHECKS: dict[str, Check] = {}


def check(check_id: str, priority: str, needs: set[str]):
    """Register ``fn(tables) -> DataFrame``. The frame needs project_id and severity; other finding columns are filled."""

    def register(fn: Callable[[Tables], DataFrame]):
        CHECKS[check_id] = Check(check_id, priority, frozenset(needs), fn)
        return fn

    return register


def as_findings(df: DataFrame, check_id: str, priority: str = "P1", **columns: str) -> DataFrame:
    """Bring an operator's result to the finding columns. ``columns`` maps a finding column to an SQL expression.

    Where the result has no ``evidence``, it is what was claimed and what was found; ``finding_key`` is the stable key of
    the finding, by which findings of several routes are matched."""
    out = []
    for p in FINDING.split(", "):
        name, typ = p.split()
        if name == "check_id":
            c = F.lit(check_id)
        elif name == "priority":
            c = F.lit(priority)
        elif name in columns:
            c = F.expr(columns[name])
        elif name in df.columns:
            c = F.col(name)
        else:
            c = F.lit(None)
        if name == "severity":
            upper = F.upper(F.trim(c.cast("string")))
            named = F.coalesce(*[F.when(upper == a, b) for a, b in SEVERITY_NAMES.items()], upper)
            c = F.when(named.isin(V.SEVERITIES), named).otherwise("MAJOR")  # what has no known severity must not pass unseen
        out.append(c.cast(typ).alias(name))
    d = df.select(*out)
    said = F.concat_ws("; ", F.concat(F.lit("claimed: "), F.col("claimed")), F.concat(F.lit("found: "), F.col("actual")))
    d = d.withColumn("evidence", F.coalesce("evidence", F.when(said != "", said), "message", "context"))
    key = finding_key("category", "check_id", "module", "path", F.col("line").cast("string"), "evidence", ("severity", "message"))
    return d.withColumn("finding_key", F.coalesce("finding_key", key))


def failed(spark: SparkSession, check_id: str, priority: str, error: Exception) -> DataFrame:
    row = {c: None for c in COLUMNS} | {"check_id": check_id, "priority": priority, "severity": "ERROR", "message": f"{type(error).__name__}: {error}"}
    return spark.createDataFrame([tuple(row[c] for c in COLUMNS)], FINDING)


def run(tables: Tables, priorities: tuple[str, ...] = ("P0", "P1"), checks: list[str] | None = None) -> DataFrame:
    """Findings of all selected checks whose inputs are there. A check whose plan cannot be built gives one
    ERROR row instead of stopping the others. Checks that cut their lineage run in part while the union is built; the
    others run when the result is used."""
    parts = []
    for c in CHECKS.values():
        if c.priority not in priorities or (checks is not None and c.check_id not in checks) or not tables.has(set(c.needs)):
            continue
        try:
            parts.append(as_findings(c.fn(tables), c.check_id, c.priority))
        except Exception as e:  # noqa: BLE001 - one broken check must not hide the others
            parts.append(failed(tables.spark, c.check_id, c.priority, e))
    return union_findings(parts) if parts else tables.spark.createDataFrame([], FINDING)


def gate(findings: DataFrame) -> DataFrame:
    """Verdict for each project. A check that failed has no project; its ERROR rows count as FATAL there."""
    return quality_gate(severity_counts(findings.withColumn("severity", F.when(F.col("severity") == "ERROR", "FATAL").otherwise(F.col("severity")))))
