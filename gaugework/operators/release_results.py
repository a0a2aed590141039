"""Rules of the earlier release results, on one parsed result row.

As with the current generation the attempts are one bounded array per
document, so recomputation needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import BYTES_PER_MIB, close_enough, percent_change, reasons
from gaugework.functions.text import is_renderable, normalized_texts
from gaugework.operators import behaviour, eligibility
from gaugework.operators.attempts import array_median, in_order
from gaugework.operators.integrity import first_approval

# ---- fixed values: workloads, metric names, frozen configuration -----------
SHORT = "b-ux-001-short-interaction"
LONG = "b-pipe-001-sustained-generation"
WORKLOADS = {
    SHORT: {
        "category": "user-experience",
        "fixture": "69b3cd45fb67e1882dabdc082636298123e01081c097af65b3fd133b19ccbc84",
        "mode": "b-mode-warm-resident-ux-v1",
        "output_limit": 128,
        "primary": "first_renderable_proxy_ttft_ms@1",
    },
    LONG: {
        "category": "pipeline",
        "fixture": "b865ad1a1993bfd7bf097b85f7c5585e44f1384fa291b9c05426c6051caba996",
        "mode": "b-mode-sustained-no-rest-v1",
        "output_limit": 512,
        "primary": "decode_tokens_per_second@1",
    },
}
# The release whose short results lose the metrics of attempts with a failed text check.
TEXT_GATED = "suite-b-power-result-1.0.0-rc.1"
# metric id: (attempt field, summary field, workloads)
METRICS = {
    "first_renderable_proxy_ttft_ms@1": (
        "firstRenderableProxyTTFTMilliseconds",
        "medianFirstRenderableProxyTTFTMilliseconds",
        (SHORT,),
    ),
    "pipeline_ttft_ms@1": (
        "pipelineTTFTMilliseconds",
        "medianPipelineTTFTMilliseconds",
        (SHORT, LONG),
    ),
    "request_completion_ms@1": (
        "requestCompletionMilliseconds",
        "medianRequestCompletionMilliseconds",
        (SHORT,),
    ),
    "prefill_tokens_per_second@1": (
        "prefillTokensPerSecond",
        "medianPrefillTokensPerSecond",
        (SHORT, LONG),
    ),
    "decode_tokens_per_second@1": (
        "decodeTokensPerSecond",
        "medianDecodeTokensPerSecond",
        (SHORT, LONG),
    ),
    "process_physical_footprint_mib@1": (
        "processPhysicalFootprintMiB",
        "medianProcessPhysicalFootprintMiB",
        (SHORT, LONG),
    ),
}
CHANGE = "decode_first_to_last_percent_change@1"
CHANGE_FIELD = "decodeFirstToLastPercentChange"
FROZEN_CONFIGURATION = {
    "warmupAttempts": "1",
    "measuredAttempts": "5",
    "minimumMetricEligibleMeasuredAttempts": "3",
    "restIntervalSeconds": "0",
    "samplingEnabled": "false",
    "temperature": "0",
    "includeStopTokenInRawEvents": "false",
    "modelLoadPolicy": "load-once-before-warmup",
    "contextPolicy": "fresh-conversation-per-attempt",
    "kvCachePolicy": "fresh-kv-cache-per-attempt",
    "automaticRetries": "0",
    "clock": "monotonic-nanoseconds",
    "memorySamplingIntervalMilliseconds": "50",
    "memoryMetric": "TASK_VM_INFO.phys_footprint",
    "thermalSource": "ProcessInfo.thermalState",
}
TRACE_IDENTITY = {
    "policyVersion": "first-renderable-decoded-prefix-v1",
    "clockOrigin": "adapter-request-accepted",
    "scope": "through-first-renderable-inclusive",
    "captureLimit": 32,
}
GLOBAL_REASONS = (
    "release_identity_mismatch",
    "workload_identity_mismatch",
    "fixture_hash_mismatch",
    "runner_incompatible",
    "environment_ineligible",
    "model_preparation_ineligible",
)


def _false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _all(flags: Column) -> Column:
    return F.forall(flags, lambda f: F.coalesce(f, F.lit(False)))


def tokens_valid(attempt: Column) -> Column:
    events = attempt["tokenEvents"]
    return _false(
        (attempt["outputTokenCount"] == F.size(events))
        & _all(
            F.transform(events, lambda e, i: (e["index"] == i) & e["tokenID"].isNotNull())
        )
        & in_order(F.transform(events, lambda e: e["elapsedNanoseconds"]))
    )


def samples_valid(attempt: Column) -> Column:
    samples = attempt["memorySamples"]
    return _false(
        (F.size(samples) > 0)
        & in_order(F.transform(samples, lambda s: s["elapsedNanoseconds"]))
        & _all(F.transform(samples, lambda s: s["physicalFootprintBytes"] > 0))
    )


def trace_valid(attempt: Column) -> Column:
    """Entries equal the token events at their position and stop at the first renderable."""
    trace, tokens = attempt["renderabilityTrace"], attempt["tokenEvents"]
    entries, start = trace["entries"], trace["generationStartNanoseconds"]
    identity = reduce(lambda a, b: a & b, [trace[k] == v for k, v in TRACE_IDENTITY.items()])
    same_start = start == attempt["timingEvidence"]["generationStartNanoseconds"]

    def fits(entry, i):
        token = F.get(tokens, i)
        return (
            (entry["tokenIndex"] == i)
            & (entry["tokenID"] == token["tokenID"])
            & (entry["tokenReceivedNanoseconds"] == start + token["elapsedNanoseconds"])
            & (entry["decodedAtNanoseconds"] >= entry["tokenReceivedNanoseconds"])
            & (entry["isRenderable"] == is_renderable(entry["decodedPrefix"], False))
        )

    found = F.array_position(F.transform(entries, lambda e: e["isRenderable"]), True)
    ends = F.when(
        found > 0,
        (found == F.size(entries))
        & (trace["outcome"] == "firstRenderableFound")
        & (trace["firstRenderableTokenIndex"] == found - 1),
    ).otherwise(
        trace["outcome"].isin("noRenderableContent", "captureLimitReached")
        & trace["firstRenderableTokenIndex"].isNull()
    )
    return _false(
        identity
        & same_start
        & (F.size(entries) <= TRACE_IDENTITY["captureLimit"])
        & _all(F.transform(entries, fits))
        & ends
    )


def attempt_values(attempt: Column, interactive: Column) -> Column:
    """Struct of the six recomputed values of one attempt; null where not available."""
    done = attempt["outcome"] == "completed"
    times = F.transform(attempt["tokenEvents"], lambda e: e["elapsedNanoseconds"])
    first, last = F.try_element_at(times, F.lit(1)), F.try_element_at(times, F.lit(-1))
    valid, count = tokens_valid(attempt), F.size(times)
    timing, prompt = attempt["timingEvidence"], attempt["promptTokenCount"]
    prompt_ns = timing["promptEvaluationNanoseconds"]
    completion = timing["requestCompletionNanoseconds"]
    start = F.coalesce(timing["generationStartNanoseconds"], F.lit(0))
    entries = attempt["renderabilityTrace"]["entries"]
    shown = F.filter(entries, lambda e: e["isRenderable"])
    values = {
        "first_renderable_proxy_ttft_ms@1": F.when(
            interactive & trace_valid(attempt),
            F.try_element_at(shown, F.lit(1))["decodedAtNanoseconds"] / 1e6,
        ),
        "pipeline_ttft_ms@1": F.when(valid & (count > 0), first / 1e6),
        "request_completion_ms@1": F.when(
            interactive & (completion > 0) & (completion >= start + F.coalesce(last, F.lit(0))),
            completion / 1e6,
        ),
        "prefill_tokens_per_second@1": F.when(
            (prompt > 0) & (prompt_ns > 0), prompt * 1e9 / prompt_ns
        ),
        "decode_tokens_per_second@1": F.when(
            valid & (count >= 2) & (last > first), (count - 1) * 1e9 / (last - first)
        ),
        "process_physical_footprint_mib@1": F.when(
            samples_valid(attempt),
            F.array_max(
                F.transform(attempt["memorySamples"], lambda s: s["physicalFootprintBytes"])
            )
            / BYTES_PER_MIB,
        ),
    }
    return F.struct(
        *[F.when(done, v).cast("double").alias(METRICS[m][0]) for m, v in values.items()]
    )


def attempt_reasons(attempt: Column, interactive: Column, limit: Column) -> Column:
    """Reasons of one attempt, the completed and the other outcomes kept apart."""
    done = attempt["outcome"] == "completed"
    derived = attempt["derivedMetrics"]
    reported = reduce(
        lambda a, b: a | b, [derived[f].isNotNull() for f, _, _ in METRICS.values()]
    )
    events = (F.size(attempt["tokenEvents"]) > 0) | (F.size(attempt["memorySamples"]) > 0)
    outcome = eligibility.outcome_reasons(
        attempt["outcome"],
        F.coalesce(attempt["reasonCodes"], F.array().cast("array<string>")),
        attempt["stopReason"],
        _false(events),
        reported,
    )
    counts = eligibility.token_limit_reasons(
        attempt["outputTokenCount"],
        attempt["promptTokenCount"],
        attempt["stopReason"],
        limit,
        interactive,
    )
    timing = attempt["timingEvidence"]
    last = F.try_element_at(attempt["tokenEvents"], F.lit(-1))["elapsedNanoseconds"]
    early = timing["requestCompletionNanoseconds"] < (
        F.coalesce(timing["generationStartNanoseconds"], F.lit(0)) + F.coalesce(last, F.lit(0))
    )
    traced = attempt["renderabilityTrace"].isNotNull() & ~trace_valid(attempt)
    series = reasons(
        (~tokens_valid(attempt), "token_evidence_invalid"),
        (interactive & traced, "first_renderable_evidence_invalid"),
        (interactive & _false(early), "contradictory_outcome_evidence"),
    )
    return F.array_distinct(
        F.concat(
            outcome,
            F.when(done, F.concat(counts, series)).otherwise(F.array().cast("array<string>")),
        )
    )


def _frozen_reasons(execution: Column, configuration: Column, app: dict[str, str]) -> Column:
    """Fields that differ from the frozen protocol; the reason depends on the field."""
    workload = execution["workloadID"]
    expected = lambda field: reduce(
        lambda rest, w: F.when(workload == w, F.lit(WORKLOADS[w][field])).otherwise(rest),
        WORKLOADS,
        F.lit(None),
    )
    get = lambda name: F.get_json_object(configuration, f"$.{name}")
    frozen = reduce(
        lambda a, b: a & b,
        [get(n).eqNullSafe(v) for n, v in FROZEN_CONFIGURATION.items()]
        + [get("outputTokenLimit").eqNullSafe(expected("output_limit").cast("string"))],
    )
    same_app = reduce(
        lambda a, b: a & b, [execution[f].eqNullSafe(v) for f, v in app.items()], F.lit(True)
    )
    same_workload = (execution["workloadCategory"] == expected("category")) & (
        execution["measurementModeID"] == expected("mode")
    )
    return reasons(
        (~workload.isin(*WORKLOADS), "workload_identity_mismatch"),
        (~_false(same_workload), "workload_identity_mismatch"),
        (~_false(execution["fixtureSHA256"] == expected("fixture")), "fixture_hash_mismatch"),
        (~same_app, "runner_incompatible"),
        (~frozen, "release_identity_mismatch"),
    )


def _behind_text_gate(attempt: Column, values: Column, gated: Column) -> Column:
    """Values as the first release has them: none for an attempt whose text check failed."""
    failed = gated & attempt["responseConformance"]["status"].eqNullSafe("fail")
    return F.struct(*[F.when(~failed, values[f]).alias(f) for f, _, _ in METRICS.values()])


def evaluate(results: DataFrame, app: dict[str, str] | None = None) -> DataFrame:
    """Add values, reasons, metric decisions and the behaviour vote.

    results: any keys plus `r`, the parsed result.  `app` pins the reference
    runner fields (runnerVersion, appVersion, appBuild, appSourceCommit).
    Short results of the TEXT_GATED version have no values for attempts whose
    text check failed, and that check must be what the text says; their
    `raw_decisions` are what the evidence alone would give.
    """
    r = F.col("r")
    interactive = r["execution"]["workloadID"].eqNullSafe(SHORT)
    gated = interactive & r["schemaVersion"].eqNullSafe(TEXT_GATED)
    limit = F.when(interactive, 128).otherwise(512)
    environment, preparation = r["environment"], r["modelPreparation"]
    measured = F.filter(r["attempts"], lambda a, i: i >= 1)
    first = results.select(
        "*",
        F.transform(r["attempts"], lambda a: attempt_values(a, interactive)).alias("_raw_values"),
        F.flatten(
            F.transform(r["attempts"], lambda a: attempt_reasons(a, interactive, limit))
        ).alias("_attempt_reasons"),
        normalized_texts(F.transform(r["attempts"], lambda a: a["generatedText"])).alias("_all_texts"),
    )
    completed = F.transform(r["attempts"], lambda a, i: (i >= 1) & _false(a["outcome"] == "completed"))
    first = first.select(
        "*",
        F.zip_with(
            r["attempts"], F.col("_raw_values"), lambda a, v: _behind_text_gate(a, v, gated)
        ).alias("values"),
        F.array_compact(
            F.zip_with(completed, F.col("_all_texts"), lambda done, text: F.when(done, F.struct(text.alias("text"))))
        ).alias("_texts"),
    )
    says = lambda a, text: F.when(behaviour.substring_conformant(text), "pass").otherwise("fail")
    misjudged = gated & F.exists(
        F.zip_with(
            r["attempts"],
            F.col("_all_texts"),
            lambda a, text: _false(a["outcome"] == "completed")
            & ~a["responseConformance"]["status"].eqNullSafe(says(a, text)),
        ),
        lambda wrong: wrong,
    )
    positions = F.transform(
        r["attempts"],
        lambda a, i: a["runIndex"].eqNullSafe(i)
        & a["role"].eqNullSafe(F.when(i == 0, "warmup").otherwise("measured")),
    )
    known = lambda s: _false(s.isin(list(rules.THERMAL_ORDER)))
    thermal_known = F.forall(
        r["attempts"], lambda a: known(a["thermal"]["before"]) & known(a["thermal"]["after"])
    )
    # Once an attempt starts critical, it and all later ones must be not-run.
    stop_ignored = F.exists(
        F.transform(
            r["attempts"],
            lambda a, i: _false(
                F.exists(
                    F.slice(r["attempts"], 1, i + 1), lambda b: b["thermal"]["before"] == "critical"
                )
            )
            & ~_false(
                (a["outcome"] == "notRun")
                & F.array_contains(a["reasonCodes"], "thermal_state_critical_before_attempt")
            ),
        ),
        lambda wrong: wrong,
    )
    derived_differ = F.exists(
        F.zip_with(
            r["attempts"],
            F.col("values"),
            lambda a, v: reduce(
                lambda x, y: x | y,
                [
                    ~close_enough(a["derivedMetrics"][f], v[f], rules.RELEASE_ONE.tolerance)
                    for f, _, _ in METRICS.values()
                ],
            ),
        ),
        lambda wrong: wrong,
    )
    environment_ok = eligibility.release_environment_ok(
        environment["buildConfiguration"],
        environment["debuggerAttached"],
        environment["lowPowerModeEnabled"],
        environment["batteryState"],
        environment["batteryLevelPercentAtStart"],
        environment["thermalStateAtSessionStart"],
    )
    prepared = eligibility.preparation_ok(
        (preparation["artifactID"] == r["model"]["artifactID"])
        & (preparation["artifactRevision"] == r["model"]["artifactRevision"]),
        preparation["downloadOccurredDuringSession"],
        preparation["preparationCompleted"],
        preparation["modelLoadCompleted"],
        preparation["eligibleForPerformanceMeasurement"],
    )
    second = first.select(
        "*",
        F.array_distinct(
            F.concat(
                _frozen_reasons(r["execution"], r["configuration"], app or {}),
                reasons(
                    (~environment_ok, "environment_ineligible"),
                    (~prepared, "model_preparation_ineligible"),
                    (~_all(positions) | (F.size(r["attempts"]) != 6), "attempt_sequence_invalid"),
                    (~thermal_known, "thermal_evidence_unavailable"),
                    (stop_ignored, "contradictory_outcome_evidence"),
                ),
                F.col("_attempt_reasons"),
                reasons(
                    (derived_differ, "aggregate_mismatch"),
                    (misjudged, "response_decision_mismatch"),
                ),
            )
        ).alias("_found"),
        F.filter("values", lambda v, i: i >= 1).alias("_measured"),
    )
    blocked = F.array_intersect(F.col("_found"), F.array(*[F.lit(c) for c in GLOBAL_REASONS]))
    workload = r["execution"]["workloadID"]
    decisions = []
    for metric, (field, summary, where) in METRICS.items():
        series = F.array_compact(F.transform(F.col("_measured"), lambda v: v[field]))
        decisions.append(
            _decision(metric, workload.isin(*where), blocked, series, array_median(series), summary)
        )
    decode = METRICS["decode_tokens_per_second@1"][0]
    at = lambda i: F.get(F.col("values"), F.lit(i))[decode]
    change = percent_change(at(1), at(5))
    ends = F.when(change.isNotNull(), F.array(at(1), at(5))).otherwise(
        F.array().cast("array<double>")
    )
    decisions.append(_decision(CHANGE, workload == LONG, blocked, ends, change, CHANGE_FIELD, 2))
    responses = F.transform(F.col("_texts"), lambda t: behaviour.substring_conformant(t["text"]))
    conformant = F.size(F.filter(responses, lambda ok: ok))
    raw = []
    measured_raw = F.filter("_raw_values", lambda v, i: i >= 1)
    for metric, (field, summary, where) in METRICS.items():
        series = F.array_compact(F.transform(measured_raw, lambda v: v[field]))
        none = F.array().cast("array<string>")
        raw.append(_decision(metric, workload.isin(*where), none, series, array_median(series), summary))
    third = second.select(
        "*",
        F.array(*decisions).alias("decisions"),
        F.when(gated, F.array(*raw, decisions[-1])).alias("raw_decisions"),
        conformant.alias("_verified"),
    )

    def ended(outcome):
        return F.size(F.filter(measured, lambda a: a["outcome"] == outcome)).cast("long")

    counts = F.struct(
        *[ended(o).alias(o) for o in rules.OUTCOMES],
        F.size(
            F.filter(
                measured,
                lambda a: (a["outcome"] == "completed") & (a["stopReason"] == "endOfSequence"),
            )
        )
        .cast("long")
        .alias("earlyEOS"),
    )
    summary_differs = F.exists(
        F.col("decisions"),
        lambda d: ~close_enough(d["reported"], d["value"], rules.RELEASE_ONE.tolerance),
    )
    late = reasons(
        (summary_differs | ~counts.eqNullSafe(r["summary"]["terminalCounts"]), "aggregate_mismatch")
    )
    keep = [c for c in results.columns]
    return third.select(
        *keep,
        "values",
        "decisions",
        "raw_decisions",
        F.array_distinct(F.concat("_found", late)).alias("protocol_reasons"),
        F.when(~interactive, "not-applicable")
        .when(F.col("_verified") >= 3, "verified")
        .otherwise("not_verified")
        .alias("behaviour"),
        counts.alias("terminal_counts"),
    )


def _decision(metric, applies, blocked, series, value, summary, minimum=3) -> Column:
    """Eligibility of one metric with the value it should report."""
    count = F.size(series)
    usable = applies & (F.size(blocked) == 0) & (count >= minimum)
    codes = (
        F.when(~applies, F.array(F.lit("metric_not_applicable")))
        .when(F.size(blocked) > 0, blocked)
        .when(count < minimum, F.array(F.lit("insufficient_metric_eligible_attempts")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(
        F.lit(metric).alias("metric_id"),
        F.lit(summary).alias("field"),
        applies.alias("applies"),
        F.coalesce(usable, F.lit(False)).alias("eligible"),
        F.when(usable, value).alias("value"),
        F.col("r")["summary"]["metrics"][summary].alias("reported"),
        codes.alias("reason_codes"),
    )


def legacy_values(evaluated: DataFrame, legacy_version: str) -> DataFrame:
    """Add `recomputed`: old short results whose metrics a text rule had nulled.

    Only for legacy results whose primary metric is not eligible under that
    rule, where a measured response check failed and the evidence alone has
    enough values: their decisions become those of the evidence.  The raw result
    is never changed.
    """
    r = F.col("r")
    failed_check = F.exists(
        F.filter(r["attempts"], lambda a, i: i >= 1), lambda a: a["responseConformance"]["status"] == "fail"
    )
    primary = lambda decisions: F.get(
        F.filter(decisions, lambda d: d["metric_id"] == WORKLOADS[SHORT]["primary"]), F.lit(0)
    )
    applies = _false(
        (r["schemaVersion"] == legacy_version)
        & (r["execution"]["workloadID"] == SHORT)
        & failed_check
        & ~primary("decisions")["eligible"]
        & primary("raw_decisions")["eligible"]
    )
    return evaluated.withColumn("recomputed", applies).withColumn(
        "decisions", F.when(F.col("recomputed"), F.col("raw_decisions")).otherwise(F.col("decisions"))
    )


def match_runners(
    results: DataFrame, approvals: DataFrame, fields: Sequence[str], reference: dict[str, str]
) -> DataFrame:
    """First approved runner per result; matched results take the reference identity.

    approvals: position, approval_id, the execution fields and runtime (JSON
    text with sorted keys).
    """
    execution = F.col("r")["execution"]
    keyed = results.select(
        "*",
        *[execution[f].alias(f) for f in fields],
        F.to_json(F.try_parse_json(F.col("r")["runtime"])).alias("runtime"),
    )
    matched = first_approval(keyed, approvals, [*fields, "runtime"], "position", "approval_id")
    projected = F.col("r")
    for name, value in reference.items():
        projected = projected.withField(f"execution.{name}", F.lit(value))
    approved = F.col("approval_id").isNotNull()
    return matched.select(
        *[c for c in results.columns if c != "r"],
        F.when(approved, projected).otherwise(F.col("r")).alias("r"),
        "approval_id",
    )


def as_earlier_contract(r: Column, version: str, schema_version: str) -> Column:
    """Rewrite the version fields so that the earlier contract's checks apply."""
    return r.withField("schemaVersion", F.lit(schema_version)).withField(
        "execution.workloadVersion", F.lit(version)
    )
