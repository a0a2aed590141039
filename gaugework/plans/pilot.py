"""Pilot bundles: recompute, reject or normalize, decide eligibility, list.

The pilot rules differ from the later generations: token times are strictly
increasing, a median needs one value, and the degradation runs from the first
to the last completed attempt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.identity import canonical_json_sha256
from gaugework.functions.numbers import close_enough, percent_change, reasons
from gaugework.operators import cells, eligibility, integrity, publish
from gaugework.operators.attempts import array_median, in_order
from gaugework.operators.conformance import let
from gaugework.operators.ordered import beside
from gaugework.session import materialize

# ---- fixed values: schema versions, contracts, summary fields --------------
SCHEMA_VERSIONS = ("suite-b-result-bundle-0.2", "suite-b-result-bundle-0.3")
SHORT = "b-ux-001-short-interaction"
LONG = "b-pipe-001-sustained-generation"
# workload: plan, category, output limit, prompt band, summary field, higher is better
CONTRACTS = {
    SHORT: (
        "b-ux-001-validation",
        "user-experience",
        128,
        (64, 256),
        "medianUserVisibleTTFTMilliseconds",
        False,
    ),
    LONG: (
        "b-pipe-001-validation",
        "pipeline",
        512,
        (128, 512),
        "medianDecodeTokensPerSecond",
        True,
    ),
}
SUMMARY_METRICS = {
    "medianPipelineTTFTMilliseconds": "ttftMilliseconds",
    "medianUserVisibleTTFTMilliseconds": "userVisibleTTFTMilliseconds",
    "medianRequestCompletionMilliseconds": "requestCompletionMilliseconds",
    "medianPrefillTokensPerSecond": "prefillTokensPerSecond",
    "medianDecodeTokensPerSecond": "decodeTokensPerSecond",
    "medianPeakMemoryMegabytes": "peakMemoryMegabytes",
}
CHANGES = {
    "decodePercentChange": "decodeTokensPerSecond",
    "ttftPercentChange": "ttftMilliseconds",
    "prefillPercentChange": "prefillTokensPerSecond",
}
_METRICS = [
    *SUMMARY_METRICS.values(),
    "p50TokenIntervalMilliseconds",
    "p95TokenIntervalMilliseconds",
    "p99TokenIntervalMilliseconds",
]
_NUMBERS = ",".join(f"{m}:DOUBLE" for m in _METRICS)
BUNDLE = f"""schemaVersion STRING, resultID STRING, createdAt STRING,
  officialResultEligible BOOLEAN, plan STRING, workload STRING, measurementMode STRING,
  generationConfiguration STRING, model STRING, runtime STRING,
  device STRUCT<machineIdentifier:STRING,systemVersion:STRING,systemBuild:STRING,
    buildConfiguration:STRING,debuggerAttached:BOOLEAN,lowPowerModeEnabled:BOOLEAN,
    batteryState:STRING,batteryLevelPercent:DOUBLE,appVersion:STRING,appBuild:STRING,
    appSourceCommit:STRING>,
  modelPreparation STRUCT<artifactID:STRING,artifactRevision:STRING,
    cacheStateBeforePreparation:STRING,downloadOccurredDuringSession:BOOLEAN,
    preparationCompleted:BOOLEAN,modelLoadCompleted:BOOLEAN,
    eligibleForPerformanceMeasurement:BOOLEAN>,
  eligibility STRUCT<sessionValid:BOOLEAN,officialLeaderboardEligible:BOOLEAN>,
  sessions ARRAY<STRUCT<id:STRING,fixtureSHA256:STRING,timingEvidenceRetained:BOOLEAN,
    performanceEligible:BOOLEAN,
    attempts:ARRAY<STRUCT<runIndex:BIGINT,role:STRING,outcome:STRING,stopReason:STRING,
      promptTokenCount:BIGINT,outputTokenCount:BIGINT,visibleText:STRING,
      thermalStateBefore:STRING,thermalStateAfter:STRING,
      tokenEvents:ARRAY<STRUCT<index:BIGINT,tokenID:BIGINT,elapsedNanoseconds:BIGINT>>,
      metrics:STRUCT<{_NUMBERS}>>>,
    summary:STRUCT<successfulMeasuredRuns:BIGINT,failedMeasuredRuns:BIGINT,
      modelInputTokens:BIGINT,finalThermalState:STRING,
      {",".join(f"{m}:DOUBLE" for m in SUMMARY_METRICS)}>>>,
  bundleSummary STRUCT<{",".join(f"{c}:DOUBLE" for c in CHANGES)}>"""


def _contract(position: int) -> Column:
    workload = F.get_json_object(F.col("b")["workload"], "$.id")
    value = F.lit(None)
    for name, fields in CONTRACTS.items():
        value = F.when(workload == name, F.lit(fields[position])).otherwise(value)
    return value


def array_percentile(values: Column, fraction: float) -> Column:
    """Interpolated percentile of a row's own array."""

    def pick(ordered):
        at = fraction * (F.size(ordered) - 1)
        low = F.get(ordered, F.floor(at).cast("int"))
        high = F.get(ordered, F.ceil(at).cast("int"))
        return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))

    return let(F.array_sort(values), pick)


def attempt_reasons(attempt: Column) -> Column:
    """Recomputation of one attempt from its token events."""
    events, metrics = attempt["tokenEvents"], attempt["metrics"]
    times = F.transform(events, lambda e: e["elapsedNanoseconds"])
    gaps = F.transform(
        F.filter(events, lambda e, i: i >= 1),
        lambda e, i: (e["elapsedNanoseconds"] - F.get(times, i)) / 1e6,
    )
    first, last = F.get(times, F.lit(0)), F.try_element_at(times, F.lit(-1))
    n = F.size(times)
    span = (last - first) / 1e9
    expected = {
        "ttftMilliseconds": F.when(n > 0, first / 1e6),
        "decodeTokensPerSecond": F.when((n > 1) & (span > 0), (n - 1) / span),
        "p50TokenIntervalMilliseconds": array_percentile(gaps, 0.50),
        "p95TokenIntervalMilliseconds": array_percentile(gaps, 0.95),
        "p99TokenIntervalMilliseconds": array_percentile(gaps, 0.99),
    }
    differ = reduce(
        lambda a, b: a | b,
        [~close_enough(metrics[m], v, rules.PILOT.tolerance) for m, v in expected.items()],
    )
    done = attempt["outcome"] == "completed"
    contiguous = F.forall(F.transform(events, lambda e, i: e["index"].eqNullSafe(i)), lambda x: x)
    counted = (attempt["promptTokenCount"] > 0) & (attempt["outputTokenCount"] == n) & (n > 0)
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    return reasons(
        (no(attempt["outcome"].isin("completed", "failed", "notRun")), "outcome-unsupported"),
        (
            no(
                attempt["thermalStateBefore"].isin(list(rules.THERMAL_ORDER))
                & attempt["thermalStateAfter"].isin(list(rules.THERMAL_ORDER))
            ),
            "thermal-state-unsupported",
        ),
        (no(contiguous), "token-index-not-contiguous"),
        (no(in_order(times, strictly=True)), "token-times-not-increasing"),
        (done & no(counted), "token-count-mismatch"),
        (differ, "metric-mismatch"),
    )


def judge(files: DataFrame) -> DataFrame:
    """One row per file: errors, eligibility, recomputed summary.

    files: path, sha256, text (readable JSON objects).
    """
    parsed = files.select("path", "sha256", F.from_json("text", BUNDLE).alias("b"))
    b = F.col("b")
    session = b["sessions"][0]
    attempts = session["attempts"]
    measured = F.filter(attempts, lambda a, i: i >= 1)
    done = F.filter(measured, lambda a: a["outcome"] == "completed")
    with_runs = parsed.select(
        "*",
        F.get_json_object(b["workload"], "$.id").alias("workload_id"),
        session.alias("session"),
        attempts.alias("attempts"),
        measured.alias("measured"),
        done.alias("done"),
    )
    d, s = F.col("done"), F.col("session")
    n = F.size(d)
    values = lambda metric: F.array_compact(F.transform(d, lambda a: a["metrics"][metric]))
    medians = {name: array_median(values(metric)) for name, metric in SUMMARY_METRICS.items()}
    ends = lambda metric: percent_change(
        F.get(d, F.lit(0))["metrics"][metric], F.try_element_at(d, F.lit(-1))["metrics"][metric]
    )
    changes = {name: ends(metric) for name, metric in CHANGES.items()}
    device, preparation = b["device"], b["modelPreparation"]
    tolerance = rules.PILOT.tolerance
    summary_differs = reduce(
        lambda x, y: x | y,
        [~close_enough(s["summary"][m], v, tolerance) for m, v in medians.items()],
    )
    change_differs = reduce(
        lambda x, y: x | y,
        [~close_enough(b["bundleSummary"][c], v, tolerance) for c, v in changes.items()],
    )
    session_ok = (
        (preparation["cacheStateBeforePreparation"].eqNullSafe("cached"))
        & eligibility.preparation_ok(
            F.lit(True),
            preparation["downloadOccurredDuringSession"],
            preparation["preparationCompleted"],
            preparation["modelLoadCompleted"],
            preparation["eligibleForPerformanceMeasurement"],
        )
        & eligibility.release_environment_ok(
            device["buildConfiguration"],
            device["debuggerAttached"],
            device["lowPowerModeEnabled"],
            device["batteryState"],
            device["batteryLevelPercent"],
            F.lit("nominal"),
        )
    )
    placed = F.forall(
        F.transform(
            F.col("attempts"),
            lambda a, i: a["runIndex"].eqNullSafe(i)
            & a["role"].eqNullSafe(F.when(i == 0, "warmup").otherwise("measured")),
        ),
        lambda ok: ok,
    )
    six = F.size("attempts") == rules.WARMUP_ATTEMPTS + rules.MEASURED_ATTEMPTS
    get = F.get_json_object
    frozen = (
        get(b["plan"], "$.id").eqNullSafe(_contract(0))
        & get(b["workload"], "$.category").eqNullSafe(_contract(1))
        & get(b["generationConfiguration"], "$.outputTokenLimit").eqNullSafe(
            _contract(2).cast("string")
        )
    )
    same_artifact = preparation["artifactID"].eqNullSafe(get(b["model"], "$.artifactID")) & (
        preparation["artifactRevision"].eqNullSafe(get(b["model"], "$.artifactRevision"))
    )
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    stated = s["summary"]
    errors = F.array_distinct(
        F.concat(
            reasons(
                (no(b["schemaVersion"].isin(*SCHEMA_VERSIONS)), "schema-version-unsupported"),
                (no(F.col("workload_id").isin(*CONTRACTS)), "workload-unsupported"),
                (no(b["officialResultEligible"].eqNullSafe(False)), "must-not-be-official"),
                (no(frozen), "contract-mismatch"),
                (no(same_artifact), "preparation-artifact-mismatch"),
                (no((F.size(b["sessions"]) == 1) & six), "attempt-count-invalid"),
                (no(placed), "attempt-sequence-invalid"),
                (
                    no(
                        stated["successfulMeasuredRuns"].eqNullSafe(n)
                        & stated["failedMeasuredRuns"].eqNullSafe(5 - n)
                        & s["performanceEligible"].eqNullSafe(n >= 3)
                        & stated["modelInputTokens"].eqNullSafe(
                            F.get(d, F.lit(0))["promptTokenCount"]
                        )
                    ),
                    "run-count-mismatch",
                ),
                (summary_differs, "summary-mismatch"),
                (
                    no(
                        stated["finalThermalState"].eqNullSafe(
                            F.try_element_at("attempts", F.lit(-1))["thermalStateAfter"]
                        )
                    ),
                    "final-thermal-mismatch",
                ),
                ((F.col("workload_id") == LONG) & change_differs, "degradation-mismatch"),
                (no(b["eligibility"]["sessionValid"].eqNullSafe(session_ok)), "session-flag-mismatch"),
            ),
            F.coalesce(
                F.flatten(F.transform("attempts", attempt_reasons)),
                F.array().cast("array<string>"),
            ),
        )
    )
    low, high = _band(0), _band(1)
    in_band = F.forall(d, lambda a: a["promptTokenCount"].between(low, high))
    primary = F.lit(None).cast("double")
    observed = F.lit(0)
    for workload, fields in CONTRACTS.items():
        here = F.col("workload_id") == workload
        primary = F.when(here, medians[fields[4]]).otherwise(primary)
        observed = F.when(here, F.size(values(SUMMARY_METRICS[fields[4]]))).otherwise(observed)
    gating, warnings = eligibility.pilot_reasons(
        session_ok,
        F.get("attempts", F.lit(0))["thermalStateBefore"],
        n >= 3,
        F.exists("measured", lambda a: a["outcome"] == "notRun"),
        F.coalesce(in_band, F.lit(False)),
        F.coalesce(F.trim(device["appSourceCommit"]) != "", F.lit(False)),
        (F.col("workload_id") == LONG) & F.exists(d, lambda a: a["outputTokenCount"] < 256),
    )
    more = reasons(
        (F.exists(d, lambda a: a["stopReason"] == "cancelled"), "cancelled_attempt_in_summary"),
        (observed < 3, "insufficient_primary_metric_observations"),
        (
            (F.col("workload_id") == SHORT)
            & F.exists(d, lambda a: F.coalesce(F.trim(a["visibleText"]), F.lit("")) == ""),
            "visible_output_missing",
        ),
    )
    object_of = lambda **parts: F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            *[
                F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null")))
                for k, v in parts.items()
            ],
        ),
        F.lit("}"),
    )
    short_device = F.to_json(
        F.struct(
            device["machineIdentifier"].alias("machineIdentifier"),
            device["systemVersion"].alias("systemVersion"),
            device["systemBuild"].alias("systemBuild"),
        ),
        {"ignoreNullFields": "false"},
    )
    ship_device = F.to_json(
        F.struct(
            *[
                device[f].alias(f)
                for f in (
                    "machineIdentifier",
                    "systemVersion",
                    "systemBuild",
                    "buildConfiguration",
                    "appVersion",
                    "appBuild",
                    "appSourceCommit",
                )
            ]
        ),
        {"ignoreNullFields": "false"},
    )
    ended = lambda outcome: F.size(F.filter("measured", lambda a: a["outcome"] == outcome))
    return with_runs.select(
        "path",
        "sha256",
        b["resultID"].alias("result_id"),
        b["createdAt"].alias("created_at"),
        "workload_id",
        get(b["model"], "$.artifactID").alias("artifact_id"),
        errors.alias("errors"),
        F.array_sort(F.array_distinct(F.concat(gating, more))).alias("reason_codes"),
        F.array_sort(warnings).alias("warning_codes"),
        primary.alias("primary_value"),
        medians["medianPeakMemoryMegabytes"].alias("peak_memory"),
        *[v.alias(c) for c, v in changes.items()],
        ended("completed").alias("completed"),
        ended("failed").alias("failed"),
        ended("notRun").alias("not_run"),
        object_of(
            workload=b["workload"],
            plan=b["plan"],
            measurementMode=b["measurementMode"],
            generationConfiguration=b["generationConfiguration"],
            device=short_device,
        ).alias("comparison_identity"),
        object_of(model=b["model"], runtime=b["runtime"], device=ship_device).alias("ship_identity"),
    )


def _band(end: int) -> Column:
    value = F.lit(None).cast("int")
    for name, fields in CONTRACTS.items():
        value = F.when(F.col("workload_id") == name, F.lit(fields[3][end])).otherwise(value)
    return value


def process(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalized, rejected); among valid bundles the first path keeps a result id."""
    judged = materialize(judge(files)).withColumn("valid", F.size("errors") == 0)
    claimed = integrity.first_valid_wins(judged, "result_id", ["path"], "valid")
    normalized = claimed.where("status = 'accepted'").select(
        *[c for c in judged.columns if c not in ("errors", "valid")],
        (F.size("reason_codes") == 0).alias("eligible"),
        canonical_json_sha256(F.col("comparison_identity")).alias("comparison_group_id"),
        canonical_json_sha256(F.col("ship_identity")).alias("ship_configuration_id"),
    ).drop("comparison_identity", "ship_identity")
    duplicate = F.array(F.lit("duplicate-result-id"))
    rejected = claimed.where("status <> 'accepted'").select(
        "path", F.when(F.col("status") == "duplicate", duplicate).otherwise(F.col("errors")).alias("errors")
    )
    return normalized, rejected


def report(normalized: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of run counts."""
    left = normalized.agg(
        F.count("*").alias("normalized"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(~F.col("eligible")).alias("ineligible"),
    )
    both = beside(left, rejected.agg(F.count("*").alias("rejected")))
    return both.select((F.col("normalized") + F.col("rejected")).alias("input"), "*")


def ranked(normalized: DataFrame) -> DataFrame:
    """Eligible rows ranked per workload by the primary value."""
    sign = F.when(F.col("workload_id") == LONG, -F.col("primary_value")).otherwise(
        F.col("primary_value")
    )
    rows = normalized.where("eligible").withColumn("_order", sign)
    return cells.rank_cells(rows, ["workload_id"], "_order", False, ["result_id"]).drop("_order")


def ship_matrix(normalized: DataFrame) -> DataFrame:
    """Per deployable configuration: workloads, peak memory, limitations."""
    limits = F.array(
        F.lit("non-official-pilot-evidence"),
        F.when(
            F.col("workload_id") == SHORT,
            "b-ux-001-adapter-first-renderable-proxy-not-screen-visible-ttft",
        ).otherwise("five-runs-are-not-a-general-thermal-stability-claim"),
    )
    rows = normalized.where("eligible").withColumn("limitations", limits)
    return publish.configuration_matrix(
        rows, ["ship_configuration_id"], "workload_id", "peak_memory", "limitations"
    )
