"""Approved runners: first match in policy order, nulls equal, reference identity projected."""

from pyspark.sql import functions as F

from gaugework import schemas
from gaugework.operators.integrity import fixed_rows
from gaugework.operators.release_results import as_earlier_contract, match_runners
from tests.test_community_ranking import frame, release_result

FIELDS = ("runnerID", "runnerVersion", "appVersion", "appBuild", "appSourceCommit")
RUNTIME = '{"backend":"metal","name":"runtime","version":"1.0"}'


def test_first_approval_and_projection(spark):
    other = release_result()
    other["execution"]["appBuild"] = None
    unknown = release_result()
    unknown["runtime"]["version"] = "9"
    results = frame(spark, [("a", release_result(), True), ("b", other, True), ("c", unknown, True)])
    parsed = results.select("contributor", F.from_json("text", schemas.RELEASE_RESULT).alias("r"))
    approvals = fixed_rows(
        spark,
        ["position", "approval_id", *FIELDS, "runtime"],
        [
            (2, "later", "app", "1.0", "1.0", "1", "c", RUNTIME),
            (1, "first", "app", "1.0", "1.0", "1", "c", RUNTIME),
            (3, "no-build", "app", "1.0", "1.0", None, "c", RUNTIME),
        ],
    )
    matched = match_runners(parsed, approvals, FIELDS, {"appVersion": "0.13.0"})
    rows = {r.contributor: r for r in matched.collect()}
    assert (rows["a"].approval_id, rows["b"].approval_id, rows["c"].approval_id) == ("first", "no-build", None)
    assert rows["a"].r.execution.appVersion == "0.13.0"
    assert rows["c"].r.execution.appVersion == "1.0"
    earlier = parsed.select(as_earlier_contract(F.col("r"), "1.0.0-rc.1", "old").alias("r")).collect()
    assert {(r.r.schemaVersion, r.r.execution.workloadVersion) for r in earlier} == {("old", "1.0.0-rc.1")}
