from claimgrid.plans import checks  # noqa: F401
from claimgrid.plans.registry import CHECKS, Tables, check, gate, run


def test_checks_run_together_and_a_broken_one_gives_an_error_row(spark):
    lines = spark.createDataFrame([("p", 1, "1.1 WGCNA"), ("p", 2, "1.5 x"), ("p", 3, "局势细胞 图2.1.1"), ("p", 4, "共10个差异基因 上调3 下调4")], "project_id string, line long, text string")
    dirs = spark.createDataFrame([("p", "01_DEGs")], "project_id string, dir string")

    @check("broken", "P1", {"report_lines"})
    def broken(t):
        return t["report_lines"].select("no_such_column")

    try:
        out = run(Tables(spark, {"report_lines": lines, "dirs": dirs})).collect()
    finally:
        CHECKS.pop("broken")
    by = {(r.check_id, r.severity) for r in out}
    assert {("section_gaps", "CRITICAL"), ("wrong_words", "MAJOR"), ("figure_numbering", "MAJOR"), ("sum_identity", "CRITICAL"), ("modules_not_delivered", "WARNING"), ("broken", "ERROR")} <= by
    assert not any(r.check_id == "file_health" for r in out)
    g = gate(run(Tables(spark, {"report_lines": lines}))).collect()[0]
    assert g.project_id == "p" and g.passed is True


def test_all_severities_reach_the_gate(spark):
    from claimgrid.plans.registry import as_findings, failed
    rows = spark.createDataFrame([("p", "SERIOUS"), ("p", "error"), ("p", "warning"), ("p", "odd"), ("p", None), ("p", "FATAL")], "project_id string, severity string")
    found = as_findings(rows, "x")
    assert sorted(r.severity for r in found.collect()) == ["CRITICAL", "FATAL", "MAJOR", "MAJOR", "MAJOR", "WARNING"]
    got = {r.project_id: r.passed for r in gate(found.where("severity = 'WARNING'").unionByName(failed(spark, "x", "P1", ValueError("no")))).collect()}
    assert got == {"p": True, None: False}


def test_folder_to_findings(spark, tmp_path):
    """Two projects as folders: one with faults of several kinds and two reports, one without any text."""
    import struct

    from claimgrid.plans.folder import audit, load_tables

    p = tmp_path / "25YLC101F"
    (p / "01_DEGs").mkdir(parents=True)
    (p / "report_1.md").write_text("1.1 WGCNA\n共10个差异基因 上调3 下调4\n", encoding="utf-8")
    (p / "report_2.md").write_text("project 25YLC999F\n局势细胞\ndata GSE12345\n", encoding="utf-8")
    (p / "notes.txt").write_text("25YLC888F", encoding="utf-8")  # no report
    (p / "01_DEGs" / "run.R").write_text('x <- read.csv("/home/me/in.csv")\n# GSE99999\n', encoding="utf-8")
    (p / "01_DEGs" / "Diff.all.csv").write_text("Gene,P\nTP53,0.01\n", encoding="utf-8")
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 8) + b"rest"
    (p / "01_DEGs" / "a.png").write_bytes(png)
    (p / "01_DEGs" / "b.png").write_bytes(png)
    (tmp_path / "empty" / "01_DEGs").mkdir(parents=True)
    (tmp_path / "empty" / "01_DEGs" / "x.pdf").write_bytes(b"%PDF-1.4 " + b"x" * 5000)

    t = load_tables(spark, str(tmp_path))
    assert {(r.line, r.path, r.file_line) for r in t["report_positions"].collect()} >= {(1, "report_1.md", 1), (2, "report_1.md", 2)}
    findings, verdicts = audit(spark, str(tmp_path), checks=["foreign_project_id", "wrong_words", "sum_identity", "small_images", "duplicate_assets", "dataset_presence", "absolute_paths", "script_thresholds"])
    rows = findings.collect()
    assert not [r.message for r in rows if r.severity == "ERROR"]
    by = {(r.project_id, r.check_id, r.severity) for r in rows}
    me = "25YLC101F"
    assert {(me, "foreign_project_id", "FATAL"), (me, "wrong_words", "MAJOR"), (me, "sum_identity", "CRITICAL"), (me, "small_images", "WARNING"), (me, "duplicate_assets", "CRITICAL"), (me, "dataset_presence", "MAJOR")} <= by
    assert [r.actual for r in rows if r.check_id == "absolute_paths"] == ["/home/me/in.csv"]
    assert {(r.path, r.line) for r in rows if r.check_id == "wrong_words"} == {("report_2.md", 2)}
    assert {r.actual for r in rows if r.check_id == "foreign_project_id"} == {"25YLC999F"}
    assert all(r.finding_key.startswith("fk:") for r in rows) and all(r.evidence for r in rows if r.actual or r.claimed)
    got = {r.project_id: r.passed for r in verdicts.collect()}
    assert got[me] is False and set(got) == {me, "empty"}
