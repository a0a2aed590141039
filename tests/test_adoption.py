"""An adoption is written only if no rule is broken."""

import pytest
from pyspark.sql import functions as F

from gaugework.operators import adoption

ENTRY = (
    "entry_id int, raw_path string, raw_sha256 string, report_path string, report_sha256 string, result_id string, session_id string, "
    "workload_id string, artifact_id string, artifact_revision string, performance_eligible boolean, recommendation_eligible boolean, "
    "primary_metric_eligible boolean"
)


def tables(spark):
    rows = [
        (n, f"raw{n}", f"d{n}", f"rep{n}", f"q{n}", f"r{n}", f"s{n}", ("short", "long")[n % 2], f"m{n // 2}", "1", True, n != 3, True)
        for n in range(6)
    ]
    entries = spark.createDataFrame(rows, ENTRY)
    results = entries.select("raw_path", F.col("raw_sha256").alias("sha256"), F.lit(True).alias("identity_ok"), *adoption.IDENTITY)
    reports = entries.select(
        "report_path", F.col("report_sha256").alias("sha256"), F.array().cast("array<string>").alias("errors"), *adoption.DECISIONS
    )
    return entries, results, reports


DECLARED = {"entries": 6, "performance_eligible": 6, "recommendation_eligible": 5}


def checks(entries, results, reports, old=None):
    found = [
        adoption.entry_violations(entries, results, reports),
        adoption.matrix_violations(entries, ["short", "long"], 3),
        adoption.count_violations(entries, DECLARED),
    ]
    return found + ([adoption.list_changes(old, entries)] if old is not None else [])


def test_a_verified_adoption_is_written_once(spark, tmp_path):
    entries, results, reports = tables(spark)
    path = str(tmp_path / "release")
    adoption.adopt(entries, checks(entries, results, reports, entries), path)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(Exception, match="exist"):
        adoption.adopt(entries, checks(entries, results, reports), path)


CHANGES = {
    # rule: change of (entries, results, reports)
    "raw-missing": lambda e, r, p: (e, r.where("raw_path <> 'raw1'"), p),
    "report-missing": lambda e, r, p: (e, r, p.where("report_path <> 'rep1'")),
    "raw-digest-mismatch": lambda e, r, p: (e, r.withColumn("sha256", F.lit("x")), p),
    "report-digest-mismatch": lambda e, r, p: (e, r, p.withColumn("sha256", F.lit("x"))),
    "report-pair-invalid": lambda e, r, p: (e, r, p.withColumn("errors", F.array(F.lit("report-stale")))),
    "source-identity-mismatch": lambda e, r, p: (e, r.withColumn("identity_ok", F.lit(None).cast("boolean")), p),
    "artifact-revision-mismatch": lambda e, r, p: (e.withColumn("artifact_revision", F.lit("2")), r, p),
    "recommendation-eligible-decision-mismatch": lambda e, r, p: (e, r, p.withColumn("recommendation_eligible", F.lit(True))),
    "session-id-not-unique": lambda e, r, p: (e.withColumn("session_id", F.lit("s")), r, p),
    "cell-not-unique": lambda e, r, p: (e.withColumn("workload_id", F.lit("short")), r, p),
    "cell-not-covered": lambda e, r, p: (e.withColumn("workload_id", F.lit("short")), r, p),
    "workload-not-in-the-matrix": lambda e, r, p: (e.withColumn("workload_id", F.lit("other")), r, p),
    "artifact-count-mismatch": lambda e, r, p: (e.withColumn("artifact_id", F.col("entry_id").cast("string")), r, p),
    "entries-count-mismatch": lambda e, r, p: (e.where("entry_id < 5"), r, p),
    "adopted-entry-dropped": lambda e, r, p: (e.where("entry_id < 5"), r, p),
    "adopted-entry-changed": lambda e, r, p: (e.withColumn("artifact_revision", F.lit("2")), r, p),
}


@pytest.mark.parametrize("rule", CHANGES)
def test_each_rule_stops_the_write(spark, tmp_path, rule):
    whole = tables(spark)
    changed = CHANGES[rule](*whole)
    path = tmp_path / "release"
    with pytest.raises(adoption.AdoptionError, match=rule):
        adoption.adopt(changed[0], checks(*changed, old=whole[0]), str(path))
    assert not path.exists()
