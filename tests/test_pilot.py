"""Pilot bundles: golden values, rejection reasons, first valid wins, eligibility."""

import copy
import hashlib
import json
import uuid

import pytest

from gaugework.plans import pilot

SHORT, LONG = pilot.SHORT, pilot.LONG


def bundle(number=1, workload=LONG):
    plan, category, limit, _, _, _ = pilot.CONTRACTS[workload]
    tokens = 4 if workload == SHORT else 256

    def attempt(i):
        start = 100_000_000 + i * 1_000_000
        events = [{"index": n, "tokenID": n, "elapsedNanoseconds": start + n * 10_000_000} for n in range(tokens)]
        return {
            "runIndex": i, "role": "warmup" if i == 0 else "measured", "outcome": "completed",
            "stopReason": "endOfSequence", "promptTokenCount": 200, "outputTokenCount": tokens,
            "visibleText": "text", "thermalStateBefore": "nominal", "thermalStateAfter": "nominal",
            "tokenEvents": events,
            "metrics": {
                "ttftMilliseconds": 100.0 + i, "userVisibleTTFTMilliseconds": 110.0 + i,
                "requestCompletionMilliseconds": 500.0, "prefillTokensPerSecond": 300.0,
                "decodeTokensPerSecond": 100.0, "peakMemoryMegabytes": 700.0,
                "p50TokenIntervalMilliseconds": 10.0, "p95TokenIntervalMilliseconds": 10.0,
                "p99TokenIntervalMilliseconds": 10.0,
            },
        }

    attempts = [attempt(i) for i in range(6)]
    return {
        "schemaVersion": "suite-b-result-bundle-0.3", "resultID": str(uuid.UUID(int=number)),
        "createdAt": "2026-07-01T00:00:00Z", "officialResultEligible": False,
        "plan": {"id": plan}, "workload": {"id": workload, "category": category}, "measurementMode": {"id": "m"},
        "generationConfiguration": {"outputTokenLimit": limit},
        "model": {"artifactID": "org/m", "artifactRevision": "1"}, "runtime": {"name": "r"},
        "device": {
            "machineIdentifier": "iPhone15,3", "systemVersion": "26.5", "systemBuild": "A", "buildConfiguration": "Release",
            "debuggerAttached": False, "lowPowerModeEnabled": False, "batteryState": "unplugged",
            "batteryLevelPercent": 80.0, "appVersion": "0.6.0", "appBuild": "8", "appSourceCommit": "c",
        },
        "modelPreparation": {
            "artifactID": "org/m", "artifactRevision": "1", "cacheStateBeforePreparation": "cached",
            "downloadOccurredDuringSession": False, "preparationCompleted": True, "modelLoadCompleted": True,
            "eligibleForPerformanceMeasurement": True,
        },
        "eligibility": {"sessionValid": True, "officialLeaderboardEligible": False},
        "sessions": [{
            "id": "default", "fixtureSHA256": "f", "timingEvidenceRetained": True, "performanceEligible": True,
            "attempts": attempts,
            "summary": {
                "successfulMeasuredRuns": 5, "failedMeasuredRuns": 0, "modelInputTokens": 200, "finalThermalState": "nominal",
                "medianPipelineTTFTMilliseconds": 103.0, "medianUserVisibleTTFTMilliseconds": 113.0,
                "medianRequestCompletionMilliseconds": 500.0, "medianPrefillTokensPerSecond": 300.0,
                "medianDecodeTokensPerSecond": 100.0, "medianPeakMemoryMegabytes": 700.0,
            },
        }],
        "bundleSummary": {"decodePercentChange": 0.0, "ttftPercentChange": (105 / 101 - 1) * 100, "prefillPercentChange": 0.0},
    }


def files(spark, bodies):
    rows = [(f"{n:02d}.json", hashlib.sha256(json.dumps(b).encode()).hexdigest(), json.dumps(b)) for n, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "path string, sha256 string, text string")


def _set(value, *path):
    def change(d):
        for p in path[:-1]:
            d = d[p]
        d[path[-1]] = value
    return change


ATTEMPT = ("sessions", 0, "attempts", 2)
CASES = {
    "token-times-not-increasing": _set(100_000_000 + 2_000_000, *ATTEMPT, "tokenEvents", 1, "elapsedNanoseconds"),
    "token-index-not-contiguous": _set(7, *ATTEMPT, "tokenEvents", 1, "index"),
    "metric-mismatch": _set(9.0, *ATTEMPT, "metrics", "p95TokenIntervalMilliseconds"),
    "token-count-mismatch": _set(3, *ATTEMPT, "outputTokenCount"),
    "summary-mismatch": _set(1.0, "sessions", 0, "summary", "medianDecodeTokensPerSecond"),
    "degradation-mismatch": _set(5.0, "bundleSummary", "decodePercentChange"),
    "attempt-sequence-invalid": _set("warmup", *ATTEMPT, "role"),
    "session-flag-mismatch": _set("charging", "device", "batteryState"),
    "contract-mismatch": _set("x", "plan", "id"),
    "schema-version-unsupported": _set("x", "schemaVersion"),
    "final-thermal-mismatch": _set("fair", "sessions", 0, "summary", "finalThermalState"),
    "run-count-mismatch": _set(4, "sessions", 0, "summary", "successfulMeasuredRuns"),
    "preparation-artifact-mismatch": _set("2", "modelPreparation", "artifactRevision"),
}


def test_golden_and_duplicates(spark):
    bad = bundle(1)
    _set(5.0, "bundleSummary", "decodePercentChange")(bad)
    bodies = [bad, bundle(1), bundle(1), bundle(2, SHORT)]  # the invalid file claims nothing
    normalized, rejected = pilot.process(files(spark, bodies))
    rows = {r.path: r for r in normalized.collect()}
    assert set(rows) == {"01.json", "03.json"}
    assert rows["01.json"].primary_value == pytest.approx(100.0) and rows["01.json"].eligible
    assert rows["03.json"].primary_value == pytest.approx(113.0) and rows["03.json"].eligible
    assert rows["01.json"].ttftPercentChange == pytest.approx((105 / 101 - 1) * 100)
    assert {r.path: r.errors for r in rejected.collect()} == {
        "00.json": ["degradation-mismatch"], "02.json": ["duplicate-result-id"],
    }
    counts = pilot.report(normalized, rejected).collect()[0]
    assert (counts.input, counts.normalized, counts.eligible, counts.rejected) == (4, 2, 2, 2)
    assert {(r.workload_id, r["rank"]) for r in pilot.ranked(normalized).collect()} == {(LONG, 1), (SHORT, 1)}
    assert len(pilot.ship_matrix(normalized).collect()) == 1


def test_each_contradiction_is_named(spark):
    bodies = []
    for n, change in enumerate(CASES.values()):
        body = copy.deepcopy(bundle(n + 1))
        change(body)
        bodies.append(body)
    _, rejected = pilot.process(files(spark, bodies))
    found = {r.path: r.errors for r in rejected.collect()}
    for n, name in enumerate(CASES):
        assert name in found[f"{n:02d}.json"], name


def test_ineligible_is_kept_with_reasons(spark):
    warm = bundle(1)
    warm["sessions"][0]["attempts"][0]["thermalStateBefore"] = "fair"
    warm["device"]["appSourceCommit"] = None
    normalized, rejected = pilot.process(files(spark, [warm]))
    row = normalized.collect()[0]
    assert not row.eligible and row.reason_codes == ["initial_thermal_state_not_nominal"]
    assert row.warning_codes == ["runner_source_identity_missing"]
    assert rejected.count() == 0
