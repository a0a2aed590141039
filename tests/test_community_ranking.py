"""Golden facts of the community ranking on synthetic release results."""

import copy
import hashlib
import json
import statistics

import pytest

from gaugework.operators.release_results import FROZEN_CONFIGURATION, WORKLOADS
from gaugework.plans import community_ranking as community

LONG = "b-pipe-001-sustained-generation"
SHORT = "b-ux-001-short-interaction"
TEXT = "Your note is safe on this iPhone. It will sync when the network is back."


def release_result(workload=LONG, step=10_000_000):
    limit = WORKLOADS[workload]["output_limit"]
    short = workload == SHORT

    def attempt(i):
        count = 20
        events = [
            {"index": n, "tokenID": n + 1, "elapsedNanoseconds": 100_000_000 + i * 1000 + n * (step + i)}
            for n in range(count)
        ]
        first, last = events[0]["elapsedNanoseconds"], events[-1]["elapsedNanoseconds"]
        trace = {
            "policyVersion": "first-renderable-decoded-prefix-v1",
            "clockOrigin": "adapter-request-accepted",
            "scope": "through-first-renderable-inclusive",
            "captureLimit": 32,
            "generationStartNanoseconds": 500,
            "outcome": "firstRenderableFound",
            "firstRenderableTokenIndex": 1,
            "entries": [
                {
                    "tokenIndex": n,
                    "tokenID": n + 1,
                    "tokenReceivedNanoseconds": 500 + events[n]["elapsedNanoseconds"],
                    "decodedAtNanoseconds": 600 + events[n]["elapsedNanoseconds"],
                    "decodedPrefix": [" ", "Hi"][n],
                    "isRenderable": bool(n),
                }
                for n in range(2)
            ],
        }
        completion = 500 + last + 1000
        return {
            "runIndex": i,
            "role": "warmup" if i == 0 else "measured",
            "outcome": "completed",
            "stopReason": "endOfSequence",
            "reasonCodes": [],
            "promptTokenCount": 100,
            "outputTokenCount": count,
            "generatedText": TEXT,
            "tokenEvents": events,
            "timingEvidence": {
                "generationStartNanoseconds": 500,
                "promptEvaluationNanoseconds": 50_000_000,
                "requestCompletionNanoseconds": completion,
            },
            "memorySamples": [
                {"elapsedNanoseconds": 0, "physicalFootprintBytes": 1_048_576 * 100},
                {"elapsedNanoseconds": 50, "physicalFootprintBytes": 1_048_576 * (200 + i)},
            ],
            "thermal": {"before": "nominal", "after": "nominal"},
            "renderabilityTrace": trace if short else None,
            "responseConformance": {"status": "pass", "reasonCodes": []},
            "derivedMetrics": {
                "pipelineTTFTMilliseconds": first / 1e6,
                "firstRenderableProxyTTFTMilliseconds": (600 + events[1]["elapsedNanoseconds"]) / 1e6 if short else None,
                "requestCompletionMilliseconds": completion / 1e6 if short else None,
                "prefillTokensPerSecond": 100 * 1e9 / 50_000_000,
                "decodeTokensPerSecond": (count - 1) * 1e9 / (last - first),
                "processPhysicalFootprintMiB": 200.0 + i,
            },
        }

    attempts = [attempt(i) for i in range(6)]
    median = lambda f: (
        None
        if attempts[1]["derivedMetrics"][f] is None
        else statistics.median(a["derivedMetrics"][f] for a in attempts[1:])
    )
    decode = [a["derivedMetrics"]["decodeTokensPerSecond"] for a in attempts]
    configuration = {k: json.loads(v) if v[0].isdigit() or v in ("false", "true") else v for k, v in FROZEN_CONFIGURATION.items()}
    configuration["outputTokenLimit"] = limit
    return {
        "schemaVersion": "suite-b-power-result-1.0.0-rc.1",
        "resultID": "r",
        "createdAt": "2026-07-13T12:00:00Z",
        "benchmarkRelease": {"id": "suite-b-power", "version": "1.0.0-rc.1"},
        "execution": {
            "sessionID": "s", "workloadID": workload, "workloadVersion": "1.0.0-rc.1",
            "workloadCategory": WORKLOADS[workload]["category"],
            "fixtureSHA256": WORKLOADS[workload]["fixture"],
            "measurementModeID": WORKLOADS[workload]["mode"],
            "runnerID": "app", "runnerVersion": "1.0", "appVersion": "1.0", "appBuild": "1",
            "appSourceCommit": "c",
        },
        "configuration": configuration,
        "model": {
            "displayName": "Model", "baseModelID": "b", "artifactID": "org/m", "artifactRevision": "1",
            "artifactContentHash": "h", "quantization": "4bit", "modelFormat": "mlx", "tokenizerIdentity": "t",
        },
        "runtime": {"name": "runtime", "version": "1.0", "backend": "metal"},
        "device": {
            "displayName": "Phone", "machineIdentifier": "phone15,3", "systemName": "iOS",
            "systemVersion": "26.5", "systemBuild": "23F1", "physicalMemoryBytes": 8,
        },
        "environment": {
            "buildConfiguration": "Release", "debuggerAttached": False, "lowPowerModeEnabled": False,
            "batteryState": "unplugged", "batteryLevelPercentAtStart": 80.0,
            "thermalStateAtSessionStart": "nominal", "thermalStateAtSessionEnd": "fair",
        },
        "modelPreparation": {
            "artifactID": "org/m", "artifactRevision": "1", "downloadOccurredDuringSession": False,
            "preparationCompleted": True, "modelLoadCompleted": True, "eligibleForPerformanceMeasurement": True,
        },
        "attempts": attempts,
        "summary": {
            "terminalCounts": {"completed": 5, "failed": 0, "cancelled": 0, "outOfMemory": 0, "notRun": 0, "earlyEOS": 5},
            "metrics": {
                "medianPipelineTTFTMilliseconds": median("pipelineTTFTMilliseconds"),
                "medianFirstRenderableProxyTTFTMilliseconds": median("firstRenderableProxyTTFTMilliseconds"),
                "medianRequestCompletionMilliseconds": median("requestCompletionMilliseconds"),
                "medianPrefillTokensPerSecond": median("prefillTokensPerSecond"),
                "medianDecodeTokensPerSecond": median("decodeTokensPerSecond"),
                "medianProcessPhysicalFootprintMiB": median("processPhysicalFootprintMiB"),
                "decodeFirstToLastPercentChange": None if short else (decode[5] / decode[1] - 1) * 100,
            },
        },
    }


def frame(spark, items):
    """items: (contributor, result document, ordinary_allowed)."""
    rows = []
    for n, (who, body, allowed) in enumerate(items):
        body = copy.deepcopy(body)
        body["resultID"], body["execution"]["sessionID"] = f"r{n}", f"s{n}"
        body["createdAt"] = f"2026-07-13T12:{n:02d}:00Z"
        text = json.dumps(body)
        rows.append((who, f"sub{n}", "community-submission", "unreviewed", allowed, None, f"p/{n}.json",
                     hashlib.sha256(text.encode()).hexdigest(), text))
    return spark.createDataFrame(
        rows,
        "contributor string, submission_id string, source_kind string, evidence_level string, "
        "ordinary_allowed boolean, ordinary_reason string, raw_path string, raw_sha256 string, text string",
    )


def contribution_rows(spark, values, **changes):
    """Flat contributions: (contributor, value, eligible) of one cell or several."""
    from pyspark.sql import functions as F

    base, _ = community.contributions(frame(spark, [("x", release_result(), True)]))
    rows = [
        (n, who, value, ok, extra.get("cell", "c"), extra.get("app", "1.0"), extra.get("os", "26.5"))
        for n, (who, value, ok, *more) in enumerate(values)
        for extra in [more[0] if more else {}]
    ]
    data = spark.createDataFrame(rows, "n int, who string, v double, ok boolean, cell string, app string, os string")
    field = F.lit("medianDecodeTokensPerSecond")
    drop = ["contributor", "contributor_key", "cell_id", "created_at", "raw_path", "metric_values",
            "metric_eligible", "metric_reasons", "app_version", "device", "result_id", "session_id", "raw_sha256"]
    one = base.drop(*drop).join(data, F.lit(True)).join(base.select(F.col("device").alias("_dev")), F.lit(True))
    return one.select(
        "*",
        F.col("who").alias("contributor"),
        F.lower("who").alias("contributor_key"),
        F.col("cell").alias("cell_id"),
        F.format_string("2026-07-13T12:%02d:00Z", "n").alias("created_at"),
        F.format_string("p/%d.json", "n").alias("raw_path"),
        F.format_string("r%d", "n").alias("result_id"),
        F.format_string("s%d", "n").alias("session_id"),
        F.format_string("h%d", "n").alias("raw_sha256"),
        F.col("app").alias("app_version"),
        F.col("_dev").withField("systemVersion", F.col("os")).alias("device"),
        F.create_map(field, "v").alias("metric_values"),
        F.create_map(field, "ok").alias("metric_eligible"),
        F.create_map(field, F.when(F.col("ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("synthetic")))).alias("metric_reasons"),
    ).drop("n", "who", "v", "ok", "cell", "app", "os", "_dev")


@pytest.mark.parametrize("workload", [LONG, SHORT])
def test_valid_result_is_recomputed_exactly(spark, workload):
    good, rejected = community.contributions(frame(spark, [("Alice", release_result(workload), True)]))
    assert rejected.collect() == []
    row = good.collect()[0]
    expected = release_result(workload)["summary"]["metrics"]
    for name, value in row.metric_values.items():
        assert value == pytest.approx(expected[name]) if expected[name] is not None else value is None


def _change(*path, value):
    def apply(d):
        for p in path[:-1]:
            d = d[p]
        d[path[-1]] = value
    return apply


CASES = {
    "token order": (LONG, _change("attempts", 2, "tokenEvents", 3, "elapsedNanoseconds", value=1), "token_evidence_invalid"),
    "derived": (LONG, _change("attempts", 2, "derivedMetrics", "decodeTokensPerSecond", value=1.0), "aggregate_mismatch"),
    "summary": (LONG, _change("summary", "metrics", "medianDecodeTokensPerSecond", value=1.0), "aggregate_mismatch"),
    "counts": (LONG, _change("summary", "terminalCounts", "earlyEOS", value=4), "aggregate_mismatch"),
    "trace": (SHORT, _change("attempts", 2, "renderabilityTrace", "entries", 1, "tokenID", value=9), "first_renderable_evidence_invalid"),
    "prompt": (SHORT, _change("attempts", 2, "promptTokenCount", value=10), "token_evidence_invalid"),
    "fixture": (LONG, _change("execution", "fixtureSHA256", value="x"), "fixture_hash_mismatch"),
    "frozen": (LONG, _change("configuration", "temperature", value=1), "release_identity_mismatch"),
    "environment": (LONG, _change("environment", "batteryLevelPercentAtStart", value=40.0), "environment_ineligible"),
    "preparation": (LONG, _change("modelPreparation", "modelLoadCompleted", value=False), "model_preparation_ineligible"),
    "role": (LONG, _change("attempts", 2, "role", value="warmup"), "attempt_sequence_invalid"),
    "critical": (LONG, _change("attempts", 3, "thermal", "before", value="critical"), "contradictory_outcome_evidence"),
    "outcome": (LONG, _change("attempts", 3, "outcome", value="failed"), "contradictory_outcome_evidence"),
    "five attempts": (SHORT, lambda body: body["attempts"].pop(), "attempt_sequence_invalid"),
}


def test_mutations_are_rejected_with_their_reason(spark):
    items = []
    for workload, change, _ in CASES.values():
        body = release_result(workload)
        change(body)
        items.append(("Alice", body, True))
    good, rejected = community.contributions(frame(spark, items))
    found = {r.raw_path: r.protocol_reasons for r in rejected.collect()}
    assert good.count() == 0
    for n, (name, (_, _, reason)) in enumerate(CASES.items()):
        assert reason in found[f"p/{n}.json"], name


def test_legacy_metrics_are_recovered(spark):
    body = release_result(SHORT)
    for a in body["attempts"]:
        a["responseConformance"] = {"status": "fail", "reasonCodes": ["text"]}
    expected = body["summary"]["metrics"]["medianFirstRenderableProxyTTFTMilliseconds"]
    body["summary"]["metrics"]["medianFirstRenderableProxyTTFTMilliseconds"] = None
    from gaugework import schemas
    from gaugework.operators.release_results import evaluate, legacy_values
    from pyspark.sql import functions as F

    parsed = frame(spark, [("a", body, True)]).select(F.from_json("text", schemas.RELEASE_RESULT).alias("r"))
    row = legacy_values(evaluate(parsed), community.LEGACY_VERSION).collect()[0]
    assert row.recomputed
    assert row.decisions[0].value == pytest.approx(expected)


def _failed_text(body, runs):
    """The first release's export of a result whose text check failed in some attempts."""
    for a in (body["attempts"][n] for n in runs):
        a["generatedText"] = "No."
        a["responseConformance"] = {"status": "fail", "reasonCodes": ["response_conformance_failed"]}
        a["derivedMetrics"] = dict.fromkeys(a["derivedMetrics"])
    good = [a["derivedMetrics"] for n, a in enumerate(body["attempts"]) if n and n not in runs]
    for name in body["summary"]["metrics"]:
        field = name.removeprefix("median")
        field = field[0].lower() + field[1:]
        values = [m[field] for m in good if m.get(field) is not None]
        body["summary"]["metrics"][name] = statistics.median(values) if len(values) >= 3 else None
    return body


def test_first_release_results_with_failed_texts_are_ranked(spark):
    expected = release_result(SHORT)["summary"]["metrics"]
    bodies = {
        "all": _failed_text(release_result(SHORT), range(6)),
        "two": _failed_text(release_result(SHORT), (1, 2)),
        "none": release_result(SHORT),
    }
    lied = _failed_text(release_result(SHORT), range(6))
    lied["attempts"][3]["generatedText"] = release_result(SHORT)["attempts"][3]["generatedText"]
    kept = _failed_text(release_result(SHORT), range(6))
    kept["summary"]["metrics"] = dict(expected)  # metrics that the rule should have nulled
    items = [(who, body, True) for who, body in bodies.items()] + [("lied", lied, True), ("kept", kept, True)]
    contributed, rejected = community.contributions(frame(spark, items))
    rows = {r.contributor: r for r in contributed.collect()}
    assert rows.keys() == bodies.keys()
    primary = "medianFirstRenderableProxyTTFTMilliseconds"
    assert {w: r.recomputed for w, r in rows.items()} == {"all": True, "two": False, "none": False}
    assert rows["all"].metric_eligible[primary] and rows["all"].metric_values[primary] == pytest.approx(expected[primary])
    assert rows["two"].metric_values[primary] == pytest.approx(bodies["two"]["summary"]["metrics"][primary])
    assert {r.raw_path: set(r.protocol_reasons) for r in rejected.collect()} == {
        "p/3.json": {"response_decision_mismatch"}, "p/4.json": {"aggregate_mismatch"},
    }
    cells = community.build_cells(contributed)
    assert [(r.value, r.contributor_count) for r in community.ranked(cells).collect()] == [
        (pytest.approx(statistics.median(r.metric_values[primary] for r in rows.values())), 3)
    ]


def one_cell(spark, values):
    return community.build_cells(contribution_rows(spark, values)).collect()[0]


def test_contributors_count_once(spark):
    row = one_cell(spark, [("Alice", 10.0, True), ("alice", 14.0, True), ("Bob", 20.0, True), ("Carol", 30.0, True)])
    assert (row.contributor_count, row.run_count, row.value) == (3, 4, 20.0)
    assert (row.status, row.aggregate_status) == ("reproduced", "community-aggregate")


def test_two_contributors_and_high_variation(spark):
    row = one_cell(spark, [("Alice", 10.0, True), ("Bob", 40.0, True)])
    assert (row.status, row.aggregate_status) == ("reproduced", "provisional")
    assert row.variation_percent == pytest.approx(60.0) and row.high and row.active


def test_ineligible_runs_count_but_do_not_weigh(spark):
    row = one_cell(spark, [("Alice", 1.0, False), ("Bob", 20.0, True)])
    assert (row.value, row.eligible_contributor_count, row.contributor_count) == (20.0, 1, 2)


def test_display_families(spark):
    values = [
        ("Alice", 20.0, True, {"cell": "a", "app": "0.8.0", "os": "26.5"}),
        ("Alice", 18.0, False, {"cell": "b", "app": "0.10.1", "os": "26.5.2"}),
        ("Alice", 18.0, True, {"cell": "c", "app": "0.8.0", "os": "26.1"}),
    ]
    cells = community.build_cells(contribution_rows(spark, values))
    shown = {r.cell_id: r for r in community.current_display(cells).collect()}
    assert set(shown) == {"b", "c"}
    assert not shown["b"].active and "synthetic" in shown["b"].reason_codes
    ranked = community.ranked(community.current_display(cells)).collect()
    assert [(r.cell_id, r["rank"]) for r in ranked] == [("c", 1)]


def test_same_digest_twice_is_reported(spark):
    items = [("Alice", release_result(), True)] * 2
    rows, _ = community.contributions(frame(spark, items))
    from pyspark.sql import functions as F

    twice = community.duplicate_evidence(rows.withColumn("raw_sha256", F.lit("same"))).collect()
    assert [(r.field, r.value, r.rows) for r in twice] == [("rawSHA256", "same", 2)]


def test_summaries_coverage_and_totals(spark):
    rows, _ = community.contributions(frame(spark, [("Alice", release_result(), True), ("Bob", release_result(), False)]))
    cells = community.build_cells(rows)
    assert community.coverage(cells).collect()[0].coverage == "Needs 1 more"
    total = community.totals(rows, cells).collect()[0]
    assert (total.results, total.cells, total.ranked_cells, total.contributors) == (2, 1, 1, 2)
    summary = {r.field: r for r in community.cell_summaries(rows).collect()}
    assert summary["medianDecodeTokensPerSecond"].contributors == 1
