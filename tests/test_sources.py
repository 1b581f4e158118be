"""Delivery folders, tables, images and logs on files made here."""

import struct

from pyspark.sql import functions as F

from claimgrid.operators.aggregate import layout, module_profile
from claimgrid.sources import events as E, files as S


def make(root):
    p = root / "25YLC101F"
    (p / "01_DEGs").mkdir(parents=True)
    (p / ".git").mkdir()
    (p / "01_DEGs" / "Diff.all.csv").write_text('Gene,Desc\nTP53,"line one\nline two, with comma"\nBRCA1,"say ""hi"""\n', encoding="utf-8")
    (p / "01_DEGs" / "empty.csv").write_text("Gene,Desc\n", encoding="utf-8")
    (p / "01_DEGs" / "run.R").write_text("library(limma)\r\np_cutoff <- 0.05\r\n", encoding="utf-8")
    (p / "01_DEGs" / "fig.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 80) + b"rest")
    (p / ".git" / "x.csv").write_text("a\n1\n")
    (p / "report.txt").write_bytes("﻿1.1 标题\n正文".encode())
    (p / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    return str(root)


def test_inventory_profile_and_dirs(spark, tmp_path):
    files = S.scan_files(spark, make(tmp_path))
    got = {r.path: (r.module, r.ext) for r in files.collect()}
    assert "01_DEGs/run.R" in got and got["01_DEGs/run.R"] == ("01_DEGs", ".r") and not any(".git" in p for p in got)
    prof = module_profile(files.where("module is not null")).collect()[0]
    assert (prof.total, prof.code, prof.images) == (4, 1, 1)
    assert [r.dir for r in S.scan_dirs(files).collect()] == ["01_DEGs"]
    assert layout(S.scan_dirs(files)).collect()[0].layout == "flat"


def test_text_is_decoded_and_numbered(spark, tmp_path):
    lines = S.scan_lines(S.scan_contents(spark, make(tmp_path), [".txt"]), ["project_id", "path"])
    got = {(r.path, r.line): r.text for r in lines.collect()}
    assert got == {("report.txt", 1): "1.1 标题", ("report.txt", 2): "正文", ("latin.txt", 1): "café"}
    assert {r.lang for r in S.scan_code(spark, str(tmp_path)).collect()} == {"R"}


def test_tables_keep_quoted_line_ends(spark, tmp_path):
    rows = S.scan_tables(spark, make(tmp_path)).where("path = '01_DEGs/Diff.all.csv'").orderBy("row_no").collect()
    assert [r.cells["Gene"] for r in rows] == ["TP53", "BRCA1"]
    assert rows[0].cells["Desc"] == "line one\nline two, with comma" and rows[1].cells["Desc"] == 'say "hi"'
    meta = S.table_meta(S.scan_contents(spark, str(tmp_path), [".csv"]).withColumn("text", S.decode_text()))
    assert {r.path: r.rows for r in meta.where("path like '01%'").collect()} == {"01_DEGs/Diff.all.csv": 2, "01_DEGs/empty.csv": 0}


def test_png_probe(spark, tmp_path):
    r = S.probe_png(S.scan_contents(spark, make(tmp_path), [".png"])).collect()[0]
    assert (r.width, r.height, r.too_small) == (640, 80, True)


def test_event_log_round_trip(spark, tmp_path):
    ev = spark.createDataFrame([("2024-01-01T00:00:00Z", "subagent_dispatched", " t1 ", 1, "p", "")], "timestamp string, event_type string, task_id string, attempt int, phase string, agent string").withColumn("actor", F.lit("lead"))
    E.append_events(ev, str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{not json\n[1]\n")
    d = E.scan_events(spark, str(tmp_path / "log"))
    assert sorted((r.task_id, r.agent, r.bad) for r in d.collect() if r.bad is None) == [("t1", "lead", None)]
    assert sorted(r.problem for r in E.field_errors(d).collect()) == ["not_json", "not_json"]
    assert [(r.task_id, r.event) for r in E.task_events(d).collect()] == [("t1", "dispatched")]


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    """Files of many blocks, equal names in two folders, blank lines, all kinds of line ends, an empty file."""
    want = []
    for log, n, end in ((1, 700, "\n"), (2, 40, "\r\n"), (3, 1, "\n"), (4, 0, "\n")):
        (tmp_path / f"log={log}").mkdir()
        texts = ["" if i % 7 == 3 else f"{log} {i} " + "x" * (i % 90) for i in range(n)]
        (tmp_path / f"log={log}" / "a.jsonl").write_bytes(end.join(texts).encode())
        want += [(log, "a.jsonl", i + 1, t) for i, t in enumerate(texts)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        d = E.numbered_lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 10
        assert sorted((r.log, r.file, r.line, r.value) for r in d.collect()) == sorted(want)
        blank = E.scan_events(spark, str(tmp_path))
        assert blank.count() == sum(t.strip() != "" for *_, t in want) and blank.where("bad is null").count() == 0
        assert {(r.log, r.line) for r in blank.collect()} == {(a, n) for a, _, n, t in want if t}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_findings_sink_and_rules(spark, tmp_path):
    f = spark.createDataFrame([("a", "FATAL", "c1"), ("b", "INFO", "c2")], "project_id string, severity string, check_id string")
    E.write_findings(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("severity = 'FATAL'").count() == 1
    (tmp_path / "r.json").write_text('{"x": ["a", "b"], "y": ["c"]}')
    assert E.load_rules(str(tmp_path / "r.json")) == [{"name": "x", "value": "a"}, {"name": "x", "value": "b"}, {"name": "y", "value": "c"}]


def table(spark, text, sep=None):
    d = S.parse_tables(spark.createDataFrame([("p", "f", text)], "project_id string, path string, text string"), sep)
    return d.orderBy("row_no").collect()


def test_large_quoted_table(spark):
    rows = table(spark, 'name,"Desc, long"\r\n' + "".join(f'"g""{i}","a, b\n{i}"\r\n' for i in range(200_000)))
    assert len(rows) == 200_000 and rows[0].header == ["name", "Desc, long"]
    assert rows[-1].cells == {"name": 'g"199999', "Desc, long": "a, b\n199999"}


def test_separators_are_found(spark):
    for sep in ",\t;":
        rows = table(spark, f'a{sep}"b{sep}, c"\n1{sep}2\n\n3{sep} "x" \n')
        assert [r.cells for r in rows] == [{"a": "1", f"b{sep}, c": "2"}, {"a": "3", f"b{sep}, c": "x"}]
    meta = S.table_meta(spark.createDataFrame([("p", "f", 'Gene,"Desc, long"\nx,y\n'), ("p", "g", ""), ("p", "h", None)], "project_id string, path string, text string")).collect()
    assert {(r.path, tuple(r.header or ()), r.rows) for r in meta} == {("f", ("Gene", "Desc, long"), 1), ("g", (), 0), ("h", (), 0)} or {r.path: r.rows for r in meta}["f"] == 1


def test_deep_paths_are_whole(spark, tmp_path):
    deep = "/".join(["d"] * 40)
    (tmp_path / "p" / deep).mkdir(parents=True)
    (tmp_path / "p" / deep / "x.csv").write_text("a\n1\n")
    assert [r.path for r in S.scan_files(spark, str(tmp_path)).collect()] == [f"{deep}/x.csv"]
