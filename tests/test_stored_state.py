"""Receipts and audits that look at what earlier batches stored."""

from pyspark.sql import functions as F

from claimgrid.streaming import tasks as R


def test_late_repeat_and_project_in_two_batches(spark, tmp_path):
    receipts = "decision_sha256 string, body_sha256 string, channel string, status string, ts timestamp"
    lines = "project_id string, line long, text string"
    days = ["2024-01-01", "2026-06-01"]
    for k, day in enumerate(days):
        rows = [("d", "b", "mail", "sent", day), ("d", f"b{k}", "mail", "sent", day), ("d", "b", "mail", "pending", day)]
        spark.createDataFrame(rows, "decision_sha256 string, body_sha256 string, channel string, status string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.createDataFrame([("p", k, "part")] + [("q", 0, "part")] * (k == 0), lines).coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
        R.first_receipts(spark.readStream.schema(receipts).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        count = lambda d: d.groupBy("project_id").agg(F.count("*").alias("n"))
        R.audit_new_projects(spark.readStream.schema(lines).parquet(str(tmp_path / "lines")), count, str(tmp_path / "audit"), str(tmp_path / "audit-state")).awaitTermination()
    got = sorted((r.body_sha256, str(r.ts)[:10]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("b", days[0]), ("b0", days[0]), ("b1", days[1])]
    assert sorted((r.project_id, r.n) for r in R.current_findings(spark, str(tmp_path / "audit")).collect()) == [("p", 2), ("q", 1)]
