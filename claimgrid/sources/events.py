"""Event logs, rule tables and the findings sink."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.keyed import RULE_ROWS_MAX
from claimgrid.functions.numbers import instant
from claimgrid.rules import values as V

EVENT_SCHEMA = (
    "timestamp string, event_type string, status string, actor string, task_id string, attempt int, phase string, agent string, "
    "inputs array<string>, outputs array<string>, details map<string,string>"
)
EVENT_FIELDS = ["timestamp", "event_type", "status", "actor", "task_id", "attempt", "phase", "agent", "inputs", "outputs", "details"]
KINDS = {v: k for k, v in V.TASK_EVENTS.items()}


def parse_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON lines to events. A line that is no JSON object keeps its text in ``bad`` and all fields null."""
    d = lines.where(~T.is_blank(text))
    parsed = d.withColumn("_e", F.from_json(text, EVENT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("_e").isNotNull() & F.col("_e._bad").isNull() & F.trim(text).startswith("{")
    keep = [c for c in lines.columns if c != text]
    return parsed.select(*keep, *[F.when(ok, F.col(f"_e.{f}")).alias(f) for f in EVENT_FIELDS], F.when(~ok, F.col(text)).alias("bad"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files of a folder: value, file, line (from 1, blank lines count) and the folder's partition columns.

    Files stay splittable. The rows of one block of a file have consecutive ids in file order, so a line is its id less
    the block's first id plus the number of lines in the file's earlier blocks; only one row for each block is gathered.
    Blocks are counted by a second scan of the same files. Should that be split differently (executors that come or go
    can change the size of a split), the query stops with an error instead of giving wrong numbers."""
    read = spark.read.text(path)
    more = [c for c in read.columns if c != "value"]
    raw = read.select("value", *more, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"),
                      F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = raw.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    at = F.col("_id") - F.col("_first")
    moved = F.raise_error(F.lit("files were split differently in two scans; set spark.sql.files.minPartitionNum")).cast("long")
    line = F.when((at >= 0) & (at < F.col("_n")), at + F.col("_before") + 1).otherwise(moved)
    return raw.join(blocks, ["_path", "_block"], "left").select("value", *more, "file", line.alias("line"))


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """A log folder. ``file`` and ``line`` locate every row."""
    return parse_events(numbered_lines(spark, path))


def scan_event_lines(texts: DataFrame, key: str = "project_id") -> DataFrame:
    """Whole logs, one row per log, with the line number of each event."""
    from claimgrid.sources.files import to_lines

    return parse_events(to_lines(texts, [key]).withColumnRenamed("text", "value"))


def task_events(events: DataFrame) -> DataFrame:
    """Well-formed task events: task_id, attempt, event, ts. Rows that lack a field are left to ``field_errors``."""
    kind = None
    for raw, short in KINDS.items():
        kind = F.when(F.col("event_type") == raw, short) if kind is None else kind.when(F.col("event_type") == raw, short)
    d = events.withColumn("event", kind).withColumn("ts", instant("timestamp")).where("event is not null")
    good = ~T.is_blank("task_id") & ~T.is_blank("phase") & ~T.is_blank("agent") & (F.col("attempt") >= 1) & F.col("ts").isNotNull()
    return d.where(good).select("task_id", F.col("attempt").cast("long").alias("attempt"), "event", "ts")


def field_errors(events: DataFrame) -> DataFrame:
    """Task events with missing fields, and lines that are no event."""
    is_task = F.col("event_type").isin(list(KINDS))
    missing = F.array_compact(F.array(
        *[F.when(T.is_blank(c), F.lit(c)) for c in ("task_id", "phase", "agent")],
        F.when(F.coalesce(F.col("attempt") < 1, F.lit(True)), F.lit("attempt")), F.when(instant("timestamp").isNull(), F.lit("timestamp"))))
    keep = [c for c in events.columns if c not in (*EVENT_FIELDS, "bad")]
    d = events.select(*keep, "event_type", F.when(F.col("bad").isNotNull(), F.lit("not_json")).when(is_task & (F.size(missing) > 0), F.concat_ws(",", F.array_sort(missing))).alias("problem"))
    return d.where("problem is not null")


def append_events(events: DataFrame, path: str) -> None:
    """Append with the fixed field list; absent fields become empty."""
    out = events
    for f in EVENT_FIELDS:
        if f not in out.columns:
            out = out.withColumn(f, F.lit(None).cast("string"))
    out = out.withColumn("task_id", T.norm_text("task_id")).withColumn("phase", T.norm_text("phase")).withColumn("agent", T.first_filled("agent", "actor"))
    out.select(*EVENT_FIELDS).write.mode("append").json(path)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings by severity folder, ordered by project inside each file, so that one project is one range of
    row groups. A folder per project would make as many folders as projects. Few severities would make a few
    huge tasks, so rows are ranged by (severity, project, key) before the write."""
    n = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [c for c in ("severity", "project_id", "check_id", "path", "line") if c in findings.columns]
    ranged = findings.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    ranged.write.mode("overwrite").partitionBy("severity").format(fmt).save(path)


def load_rules(path: str) -> list[dict]:
    """A rule file (JSON list, or object of lists) as rows; it is small by contract and the size is checked."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    rows = data if isinstance(data, list) else [{"name": k, "value": v} for k, vs in data.items() for v in (vs if isinstance(vs, list) else [vs])]
    if len(rows) > RULE_ROWS_MAX:
        raise ValueError(f"{len(rows)} rules in {path}; read a table this large with spark.read.json")
    return rows
