"""What the shared steps shuffle, write and parse: figures that must not grow faster than the input."""

import json

import pytest
from pyspark.sql import functions as F

import gaugework.operators.hot_keys as hot_keys
from gaugework.operators import adoption, metrics, ordered, reports
from gaugework.operators.conformance import breaks_schema, conformance_reasons, constraints_of
from gaugework.plans import evidence_ranking as ranking
from tests import builders


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_without_large_keys_is_one_plain_join(spark):
    facts = spark.range(200).select(F.col("id").alias("n"), (F.col("id") % 7).alias("key"))
    table = spark.range(5).select(F.col("id").alias("key"), (F.col("id") * 10).alias("mark"))
    out = hot_keys.lookup(facts, table, ["key"], "left", ["n"])
    assert plan_of(out).count("Join") == 1 and "Aggregate" not in plan_of(out)
    assert {(r.n, r.mark) for r in out.collect()} == {(n, n % 7 * 10 if n % 7 < 5 else None) for n in range(200)}


def test_large_keys_are_counted_by_bucket_first(spark):
    rows = spark.createDataFrame([("a", 1)] * 30 + [("b", 1)] * 11 + [(None, 2)] * 12 + [("c", 3)] * 10, "k string, v int")
    found = hot_keys.large_keys(rows, ["k"], 10)
    assert {(r.k, r._n) for r in found.collect()} == {("a", 30), ("b", 11), (None, 12)}
    assert hot_keys.large_keys(rows, ["k"], 30) is None


def test_numbering_landed_rows_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr(ordered, "materialize", lambda df: pytest.fail("written again"))
    rows = spark.range(20).select((F.col("id") % 4).alias("k"), "id")
    out = ordered.number_rows(rows, ["k"], [F.col("id")], "n", landed=True).collect()
    assert all(r.n == r.id // 4 + 1 for r in out)


def test_result_values_write_nothing_and_shuffle_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "materialize", lambda df: pytest.fail("values were written"))
    long = spark.createDataFrame(
        [(1, "m", 3.0), (1, "m", 1.0), (1, "m", None), (2, "m", None), (2, "peak_physical_footprint_mib", 4.0), (2, "peak_physical_footprint_mib", 9.0)],
        "result_id long, metric_id string, metric_value double",
    )
    out = metrics.result_values(long, ["result_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "m", 2.0, 2), (2, "m", None, 0), (2, "peak_physical_footprint_mib", 9.0, 2)}


def test_large_results_still_take_the_sliced_way(sliced):
    long = sliced.range(900).select(
        F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("result_id"), F.lit("m").alias("metric_id"), F.col("id").cast("double").alias("metric_value")
    )
    out = {r.result_id: (r.value, r.eligible_attempts) for r in metrics.result_values(long, ["result_id"]).collect()}
    assert out == {1: (349.5, 700), **{n: (float(n), 1) for n in range(700, 900)}}


def test_entry_and_report_digests_are_shuffled_apart(spark):
    text = lambda n: ", ".join(f"{c} string" for c in n)
    flags = ", ".join(f"{c} boolean" for c in adoption.DECISIONS)
    entries = spark.createDataFrame([], f"entry_id long, raw_path string, raw_sha256 string, report_path string, report_sha256 string, {text(adoption.IDENTITY)}, {flags}")
    results = spark.createDataFrame([], f"raw_path string, sha256 string, identity_ok boolean, {text(adoption.IDENTITY)}")
    stored = spark.createDataFrame([], f"report_path string, sha256 string, errors array<string>, {flags}")
    out = adoption.entry_violations(entries, results, stored)
    analyzed = out._jdf.queryExecution().analyzed().toString()
    joined = [line for line in analyzed.split("\n") if "Project" in line and "raw#" in line and "report#" in line]
    assert not joined


SCHEMA = {
    "type": "object",
    "required": ["id", "list"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^kind_0_"},
        "list": {"type": "array", "minItems": 1, "items": {"type": ["integer", "null"], "minimum": 0}},
        "one": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]},
        "deep": {"type": "object", "required": ["x"], "properties": {"x": {"const": 1}}, "additionalProperties": {"type": "boolean"}},
    },
}
DOCUMENTS = [
    {"id": "kind_0_", "list": [1]}, {"id": "x", "list": [1]}, {"id": "kind_0_", "list": []}, {"id": "kind_0_", "list": [1, -1]},
    {"id": "kind_0_", "list": [None]}, {"id": "kind_0_"}, {"id": 1, "list": [1]}, {"id": "kind_0_", "list": {"a": 1}}, [], 1, None,
    {"id": "kind_0_", "list": [1], "more": 1}, {"id": "kind_0_", "list": [1], "one": "a"}, {"id": "kind_0_", "list": [1], "one": 4},
    {"id": "kind_0_", "list": [1], "deep": {"x": 1, "y": True}}, {"id": "kind_0_", "list": [1], "deep": {"x": 2}},
    {"id": "kind_0_", "list": [1], "deep": {"x": 1, "y": 3}}, {"id": "kind_0_", "list": [1], "deep": {}},
]


def test_breaking_a_schema_is_having_a_message(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCUMENTS)] + [(-1, "no json"), (-2, None)]
    rules = constraints_of(SCHEMA)
    frame = spark.createDataFrame(rows, "n int, text string").select("n", F.try_parse_json("text").alias("d"))
    both = frame.select("n", (F.size(conformance_reasons("d", rules)) > 0).alias("a"), breaks_schema("d", rules).alias("b")).collect()
    assert all(r.a == r.b for r in both) and {r.n for r in both if not r.b} == {0, 4, 12, 14}


def test_parsed_packages_are_not_shuffled(spark, monkeypatch):
    packages = spark.createDataFrame(
        [("p", b"{}", b"{}", True, "a")], "package_id string, submission binary, result binary, file_set_valid boolean, author string"
    )
    out = ranking.decide(packages, builders.models(spark), builders.trusted())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out.select("package_id", "classification")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_reports_are_parsed_once(spark, monkeypatch):
    kept = []
    whole = reports.materialize
    monkeypatch.setattr(reports, "materialize", lambda df: kept.append(df) or whole(df))
    pairs = spark.createDataFrame(
        [(1, '{"resultID":"a","schemaVersion":"1"}', '{"result":{"id":"b","sha256":"0","schemaVersion":"1"}}', "{}")],
        "k int, content string, report string, recomputed string",
    )
    verdicts, _ = reports.verify_reports(pairs, ["k"])
    assert plan_of(kept[0]).lower().count("parsejson") + plan_of(kept[0]).count("parse_json") <= 3
    (row,) = verdicts.collect()
    assert row.errors == ["report-does-not-bind-result", "result-id-mismatch", "report-stale"]
