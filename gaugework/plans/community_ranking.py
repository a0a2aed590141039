"""Community ranking over release results: cells, display selection, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules, schemas
from gaugework.functions.identity import (
    canonical_json_sha256,
    identity_json,
    minor_family,
    version_numbers,
)
from gaugework.operators import cells as cell_ops
from gaugework.operators import decisions, integrity
from gaugework.operators.ordered import beside, first_rows, number_rows
from gaugework.operators.release_results import CHANGE_FIELD, METRICS, WORKLOADS, evaluate
from gaugework.operators.release_results import legacy_values
from gaugework.session import materialize

SUMMARY_FIELDS = [summary for _, summary, _ in METRICS.values()] + [CHANGE_FIELD]
UNGATED = "medianRequestCompletionMilliseconds"
LEGACY_VERSION = "suite-b-power-result-1.0.0-rc.1"


def _identity() -> Column:
    """Exact cell of a release result as JSON text."""
    r = F.col("r")
    x, model, device = r["execution"], r["model"], r["device"]
    part = lambda source, *names: F.to_json(
        F.struct(*[source[n].alias(n) for n in names]), {"ignoreNullFields": "false"}
    )
    workload = F.to_json(
        F.struct(
            x["workloadID"].alias("id"),
            x["workloadVersion"].alias("version"),
            x["workloadCategory"].alias("category"),
            x["fixtureSHA256"].alias("fixtureSHA256"),
            x["measurementModeID"].alias("measurementModeID"),
        ),
        {"ignoreNullFields": "false"},
    )
    runner = F.to_json(
        F.struct(
            x["runnerID"].alias("id"),
            x["runnerVersion"].alias("version"),
            x["appVersion"].alias("appVersion"),
            x["appBuild"].alias("appBuild"),
            x["appSourceCommit"].alias("appSourceCommit"),
        ),
        {"ignoreNullFields": "false"},
    )
    pieces = {
        "sourceEvidenceRelease": r["benchmarkRelease"],
        "workload": workload,
        "runner": runner,
        "generation": r["configuration"],
        "model": part(
            model,
            "artifactID",
            "artifactRevision",
            "artifactContentHash",
            "quantization",
            "modelFormat",
            "tokenizerIdentity",
        ),
        "runtime": r["runtime"],
        "device": part(
            device,
            "machineIdentifier",
            "physicalMemoryBytes",
            "systemName",
            "systemVersion",
            "systemBuild",
        ),
    }
    texts = [
        F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null")))
        for name, text in pieces.items()
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}"))


def contributions(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contributions, rejected) from result texts in one common row shape.

    results: contributor, submission_id, source_kind, evidence_level,
    ordinary_allowed, ordinary_reason, raw_path, raw_sha256, text.
    """
    parsed = results.select(
        *[c for c in results.columns if c != "text"],
        F.from_json("text", schemas.RELEASE_RESULT).alias("r"),
    )
    judged = legacy_values(evaluate(parsed), LEGACY_VERSION)
    r = F.col("r")
    metric = lambda key, value: F.map_from_entries(
        F.transform(F.col("decisions"), lambda d: F.struct(d[key], value(d)))
    )
    exported = lambda d: F.when(F.col("recomputed"), d["value"]).otherwise(d["reported"])
    response = F.flatten(
        F.transform(
            F.filter(r["attempts"], lambda a, i: i >= 1),
            lambda a: F.concat(
                F.when(
                    F.coalesce(a["responseConformance"]["status"] != "pass", F.lit(False)),
                    F.coalesce(
                        a["responseConformance"]["reasonCodes"],
                        F.array(F.lit("response_conformance_not_passed")),
                    ),
                ).otherwise(F.array().cast("array<string>")),
                F.when(a["outcome"] != "completed", F.coalesce(
                    a["reasonCodes"], F.array().cast("array<string>")
                )).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    # Written once: small next to the documents, and a filter on the verdict must
    # not be pushed into the checks, which would run them twice.
    rows = materialize(judged.select(
        *[c for c in results.columns if c != "text"],
        F.lower("contributor").alias("contributor_key"),
        canonical_json_sha256(_identity()).alias("cell_id"),
        canonical_json_sha256(r["configuration"]).alias("generation_sha256"),
        r["resultID"].alias("result_id"),
        r["execution"]["sessionID"].alias("session_id"),
        r["createdAt"].alias("created_at"),
        r["execution"]["workloadID"].alias("workload_id"),
        r["execution"]["appVersion"].alias("app_version"),
        r["execution"]["appBuild"].alias("app_build"),
        r["model"].alias("model"),
        r["device"].alias("device"),
        F.get_json_object(r["runtime"], "$.name").alias("runtime_name"),
        F.get_json_object(r["runtime"], "$.backend").alias("runtime_backend"),
        r["environment"]["thermalStateAtSessionEnd"].alias("thermal_end"),
        "terminal_counts",
        "recomputed",
        "protocol_reasons",
        metric("field", exported).alias("metric_values"),
        metric("field", lambda d: d["eligible"]).alias("metric_eligible"),
        metric("field", lambda d: d["reason_codes"]).alias("metric_reasons"),
        response.alias("response_reasons"),
    ))
    valid = F.size("protocol_reasons") == 0
    rejected = rows.where(~valid).select("raw_path", "raw_sha256", "protocol_reasons")
    return rows.where(valid).drop("protocol_reasons"), rejected


def duplicate_evidence(contributed: DataFrame) -> DataFrame:
    """Digests, result ids and session ids used twice; any row stops publication."""
    return integrity.repeated_values(
        contributed,
        {
            "rawSHA256": F.col("raw_sha256"),
            "resultID": F.col("result_id"),
            "sessionID": F.col("session_id"),
        },
    )


def _primary_field(workload: Column) -> Column:
    field = F.lit(None).cast("string")
    for name, workload_rules in WORKLOADS.items():
        field = F.when(workload == name, METRICS[workload_rules["primary"]][1]).otherwise(field)
    return field


def build_cells(contributed: DataFrame) -> DataFrame:
    """One row per exact cell: primary value, variation, states, counts, reasons."""
    field = _primary_field(F.col("workload_id"))
    rows = contributed.select(
        "*",
        (
            F.coalesce("ordinary_allowed", F.lit(True))
            & F.coalesce(F.try_element_at("metric_eligible", field), F.lit(False))
        ).alias("eligible"),
        F.try_element_at("metric_values", field).alias("primary_value"),
    )
    counts = rows.groupBy("cell_id").agg(
        F.count("*").alias("run_count"),
        F.count_if("eligible").alias("eligible_run_count"),
        F.countDistinct("contributor_key").alias("contributor_count"),
        F.countDistinct(F.when(F.col("eligible"), F.col("contributor_key"))).alias(
            "eligible_contributor_count"
        ),
        F.max("created_at").alias("latest_evidence"),
        *[
            F.sum(F.col("terminal_counts")[o]).alias(f"{o}_measured_attempts")
            for o in ("completed", "failed", "notRun")
        ],
    )
    usable = rows.where("eligible").select("cell_id", "contributor_key", "primary_value")
    medians = cell_ops.contributor_medians(usable, ["cell_id"], "contributor_key", "primary_value")
    primary = cell_ops.weighted_cells(medians, ["cell_id"]).select("cell_id", "value")
    variation = cell_ops.relative_variation(medians, ["cell_id"], "contributor_key").select(
        "cell_id", "variation_percent", "high_variation"
    )
    thermal = cell_ops.worst_state(rows, ["cell_id"], "thermal_end", rules.THERMAL_ORDER)
    flagged = rows.select(
        "cell_id",
        F.concat(
            F.when(
                ~F.coalesce("ordinary_allowed", F.lit(True)),
                F.array(F.lit("ordinary_live_ranking_not_allowed")),
            ).otherwise(F.array().cast("array<string>")),
            F.when(
                ~F.coalesce(F.try_element_at("metric_eligible", field), F.lit(False)),
                F.coalesce(
                    F.try_element_at("metric_reasons", field), F.array().cast("array<string>")
                ),
            ).otherwise(F.array().cast("array<string>")),
            F.coalesce("response_reasons", F.array().cast("array<string>")),
        ).alias("codes"),
    )
    why = decisions.reason_union(flagged, ["cell_id"], "codes", "no_metric_eligible_contribution")
    described = first_rows(
        rows.select(
            "cell_id",
            "created_at",
            "raw_path",
            "workload_id",
            "app_version",
            "app_build",
            "model",
            "device",
            "runtime_name",
            "runtime_backend",
            "generation_sha256",
        ),
        ["cell_id"],
        ["created_at", "raw_path"],
    ).drop("created_at", "raw_path")
    joined = (
        described.join(counts, "cell_id")
        .join(thermal, "cell_id")
        .join(why, "cell_id")
        .join(primary, "cell_id", "left")
        .join(variation, "cell_id", "left")
    )
    n, active = F.col("eligible_contributor_count"), F.col("value").isNotNull()
    return joined.select(
        *[c for c in joined.columns if c != "reason_codes"],
        F.coalesce("high_variation", F.lit(False)).alias("high"),
        active.alias("active"),
        F.when(active, F.array().cast("array<string>"))
        .otherwise(F.col("reason_codes"))
        .alias("reason_codes"),
        cell_ops.community_status(n).alias("status"),
        cell_ops.aggregate_status(n).alias("aggregate_status"),
        cell_ops.still_needed(n).alias("still_needed"),
    ).drop("high_variation")


def cell_summaries(contributed: DataFrame) -> DataFrame:
    """Weighted value per (cell, field); request completion has no gate of its own."""
    allowed = F.coalesce("ordinary_allowed", F.lit(True))
    columns, gates = [], {}
    for name in SUMMARY_FIELDS:
        columns.append(F.try_element_at("metric_values", F.lit(name)).alias(name))
        if name == UNGATED:
            gates[name] = None
            continue
        gate = allowed & F.coalesce(
            F.try_element_at("metric_eligible", F.lit(name)), F.lit(False)
        )
        columns.append(gate.alias(f"_ok_{name}"))
        gates[name] = f"_ok_{name}"
    flat = contributed.select("cell_id", "contributor_key", *columns)
    return cell_ops.field_summary(flat, ["cell_id"], "contributor_key", gates)


def evidence_rows(contributed: DataFrame) -> DataFrame:
    """Evidence of every cell in (created, path) order, as rows rather than lists."""
    listed = contributed.select(
        "cell_id",
        "contributor",
        "submission_id",
        "source_kind",
        "evidence_level",
        "result_id",
        "session_id",
        "created_at",
        "raw_path",
        "raw_sha256",
        "recomputed",
    )
    return number_rows(listed, ["cell_id"], [F.col("created_at"), F.col("raw_path")], "position")


def current_display(cells: DataFrame) -> DataFrame:
    """The newest cell of each display family, ranked or not."""
    family = minor_family(F.col("device")["systemVersion"])
    keyed = cells.select(
        "*",
        F.struct(
            "workload_id",
            "generation_sha256",
            F.col("model")["artifactID"].alias("a"),
            F.col("model")["artifactRevision"].alias("b"),
            F.col("model")["artifactContentHash"].alias("c"),
            F.col("model")["quantization"].alias("d"),
            F.col("model")["tokenizerIdentity"].alias("e"),
            "runtime_name",
            "runtime_backend",
            F.col("device")["machineIdentifier"].alias("f"),
            F.col("device")["physicalMemoryBytes"].alias("g"),
            family.alias("h"),
        ).alias("_family"),
    )
    newest = [
        version_numbers(F.col("app_version")),
        version_numbers(F.col("app_build")),
        version_numbers(F.col("device")["systemVersion"]),
        F.col("device")["systemBuild"],
        "latest_evidence",
        "cell_id",
    ]
    return cell_ops.current_display(keyed, ["_family"], newest).drop("_family")


def ranked(cells: DataFrame) -> DataFrame:
    """Active cells ranked per workload; ties keep device, artifact, runtime order."""
    higher = F.col("workload_id") == "b-pipe-001-sustained-generation"
    ordered = cells.where("active").select(
        "*",
        F.when(higher, -F.col("value")).otherwise(F.col("value")).alias("_order"),
        F.col("device")["machineIdentifier"].alias("_d"),
        F.col("model")["artifactID"].alias("_a"),
    )
    ties = ["_d", "_a", "runtime_name", "cell_id"]
    return cell_ops.rank_cells(ordered, ["workload_id"], "_order", False, ties).drop(
        "_order", "_d", "_a"
    )


def coverage(cells: DataFrame) -> DataFrame:
    need = F.col("still_needed")
    return cells.select(
        "cell_id",
        "workload_id",
        F.col("model")["displayName"].alias("model"),
        F.col("model")["quantization"].alias("quantization"),
        F.col("device")["displayName"].alias("device"),
        "eligible_contributor_count",
        "run_count",
        F.when(need == 0, "Reproduced")
        .otherwise(F.concat(F.lit("Needs "), need.cast("string"), F.lit(" more")))
        .alias("coverage"),
    )


def totals(contributed: DataFrame, cells: DataFrame) -> DataFrame:
    """One row of dataset totals."""
    left = contributed.agg(
        F.count("*").alias("results"),
        F.countDistinct("contributor_key").alias("contributors"),
        F.count_if(F.col("source_kind") == "maintainer-reference").alias("official"),
        F.count_if(F.col("source_kind") == "community-submission").alias("community"),
    )
    right = cells.agg(
        F.count("*").alias("cells"),
        F.count_if("active").alias("ranked_cells"),
        F.count_if(F.col("status") == "reproduced").alias("reproduced"),
        F.count_if(F.col("aggregate_status") == "community-aggregate").alias("aggregates"),
    )
    return beside(left, right)
