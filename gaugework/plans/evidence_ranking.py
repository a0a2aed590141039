"""From two-file evidence packages to decisions, contributions and ranked views.

One row per package carries all checks: parsing, schema conformance, series
checks and eligibility are expressions on that row.  Shuffles happen only for
duplicate digests, the model registry, contributor weighting and ranking.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules, schemas
from gaugework.functions.identity import (
    canonical_json_sha256,
    canonical_uuid,
    identity_json,
    uuid5,
)
from gaugework.functions.numbers import reasons
from gaugework.functions.text import normalized_texts
from gaugework.operators import attempts as attempt_ops
from gaugework.operators import behaviour, cells, decisions, eligibility, integrity
from gaugework.operators.conformance import breaks_schema, constraints_of
from gaugework.operators.hot_keys import lookup, small
from gaugework.operators.integrity import fixed_rows
from gaugework.operators.metrics import metric_status
from gaugework.operators.ordered import number_rows
from gaugework.session import materialize

NO_CODES = "array<string>"


@dataclass(frozen=True)
class Trusted:
    """The pinned stack one run validates against; all of it is policy-sized."""

    program: tuple[str, str, str]
    target: tuple[str, str, str]
    # (workload id, version, sha256, measurement mode, inference configuration JSON)
    workloads: Sequence[tuple[str, str, str, str, str]]
    certificate: dict | None  # state, id, program_sha256, target_sha256, runtime (JSON or None)
    app_release: dict | None  # state, version, build, source_revision, certificate_ids
    stack_sha256: str = ""
    intake_open: bool = False
    intake_policy_sha256: str = ""
    validator_revision: str = ""
    evaluated_at: str = ""
    admission: dict = field(default_factory=lambda: dict(rules.ADMISSION))
    submission_schema: dict = field(default_factory=schemas.submission_schema)
    result_schema: dict = field(default_factory=schemas.result_schema)


def _none() -> Column:
    return F.array().cast(NO_CODES)


def _status(codes: Column) -> tuple[Column, Column]:
    return F.when(F.size(codes) == 0, "pass").otherwise("fail"), codes


def parse_packages(packages: DataFrame) -> DataFrame:
    """packages: package_id, submission, result (bytes), file_set_valid, author; duplicate is kept."""
    text = lambda c: F.try_validate_utf8(F.col(c).cast("string"))
    return packages.select(
        "package_id",
        "author",
        "file_set_valid",
        F.sha2(F.coalesce("submission", F.lit("").cast("binary")), 256).alias("submission_sha256"),
        F.sha2(F.coalesce("result", F.lit("").cast("binary")), 256).alias("result_sha256"),
        text("submission").alias("submission_text"),
        text("result").alias("result_text"),
        *[c for c in packages.columns if c == "duplicate"],
    ).select(
        "*",
        F.from_json("submission_text", schemas.SUBMISSION).alias("s"),
        F.from_json("result_text", schemas.RESULT).alias("r"),
        F.try_parse_json("submission_text").alias("submission_doc"),
        F.try_parse_json("result_text").alias("result_doc"),
    )


def _structural(trusted: Trusted) -> Column:
    s, r = F.col("s"), F.col("r")
    broken = lambda c, schema: breaks_schema(c, constraints_of(schema))
    is_object = lambda c: F.try_variant_get(
        F.col(c), "$", "map<string,variant>"
    ).isNotNull()
    submission_known = s["schemaVersion"].eqNullSafe(schemas.SUBMISSION_VERSION)
    result_known = r["schemaVersion"].eqNullSafe(schemas.RESULT_VERSION)
    return reasons(
        (~F.col("file_set_valid"), "submission-package-file-set-invalid"),
        (~is_object("submission_doc"), "invalid-submission-schema"),
        (~is_object("result_doc"), "invalid-envelope"),
        (~submission_known, "unsupported-major-version"),
        (
            submission_known & broken("submission_doc", trusted.submission_schema),
            "invalid-submission-schema",
        ),
        (~result_known, "unsupported-major-version"),
        (result_known & broken("result_doc", trusted.result_schema), "invalid-envelope"),
    )


def _digest(duplicate: Column) -> Column:
    s, r = F.col("s"), F.col("r")
    source = s["sourceResult"]
    directory = canonical_uuid(F.col("package_id"))
    stated = canonical_uuid(s["submissionID"])
    differs = lambda a, b: ~a.eqNullSafe(b)
    return reasons(
        (source.isNull(), "result-reference-missing"),
        (source.isNotNull() & differs(source["path"], F.lit("result.json")),
         "result-reference-mismatch"),
        (source.isNotNull() & differs(source["sha256"], F.col("result_sha256")),
         "result-digest-mismatch"),
        (source.isNotNull() & differs(source["schemaVersion"], r["schemaVersion"]),
         "result-reference-mismatch"),
        (stated.isNull() | directory.isNull() | (stated != directory),
         "submission-directory-identity-mismatch"),
        (duplicate, "duplicate-result-sha256"),
    )


def _canonical_text(text: Column) -> Column:
    """Key-sorted JSON text for equality."""
    return F.to_json(F.try_parse_json(text))


def _contract(trusted: Trusted) -> Column:
    r = F.col("r")
    payload, model = r["payload"], r["model"]
    differs = lambda part, expected: ~(
        part["id"].eqNullSafe(expected[0])
        & part["version"].eqNullSafe(expected[1])
        & part["manifestSHA256"].eqNullSafe(expected[2])
    )
    same_model = (
        model["registryEntrySHA256"].eqNullSafe(F.col("known_model.sha256"))
        & model["artifactID"].eqNullSafe(F.col("known_model.artifact_id"))
        & model["artifactRevision"].eqNullSafe(F.col("known_model.artifact_revision"))
        & model["parameterCount"].eqNullSafe(F.col("known_model.parameter_count"))
        & model["quantization"].eqNullSafe(F.col("known_model.quantization"))
        & model["format"].eqNullSafe(F.col("known_model.format"))
    )
    workload = payload["workload"]
    found = F.lit(False)
    version = digest = mode = inference = F.lit(None).cast("string")
    for wid, wversion, wsha, wmode, wconfig in trusted.workloads:
        here = workload["id"].eqNullSafe(wid)
        found = found | here
        version = F.when(here, F.lit(wversion)).otherwise(version)
        digest = F.when(here, F.lit(wsha)).otherwise(digest)
        mode = F.when(here, F.lit(wmode)).otherwise(mode)
        inference = F.when(here, F.lit(wconfig)).otherwise(inference)
    first = reasons(
        (differs(r["program"], trusted.program), "program-or-target-digest-mismatch"),
        (differs(r["target"], trusted.target), "program-or-target-digest-mismatch"),
        (F.col("known_model").isNull(), "model-artifact-not-registered"),
        (F.col("known_model").isNotNull() & ~same_model, "model-artifact-identity-mismatch"),
        (payload.isNull(), "invalid-program-payload"),
        (payload.isNotNull() & ~found, "unsupported-workload"),
    )
    second = reasons(
        (
            ~workload["version"].eqNullSafe(version) | ~workload["sha256"].eqNullSafe(digest),
            "workload-identity-mismatch",
        ),
        (~payload["measurementMode"].eqNullSafe(mode), "measurement-mode-mismatch"),
        (
            ~_canonical_text(payload["inferenceConfiguration"]).eqNullSafe(
                _canonical_text(inference)
            ),
            "inference-configuration-mismatch",
        ),
    )
    third = reasons(
        (F.coalesce(F.size(r["artifacts"]), F.lit(1)) != 0, "unsupported-external-artifacts")
    )
    series = attempt_ops.attempt_reasons(payload["attempts"])
    rest = F.when(found, F.concat(second, series, third)).otherwise(_none())
    return F.array_distinct(F.concat(first, rest))


def _runner(trusted: Trusted) -> Column:
    r, certificate = F.col("r"), trusted.certificate
    if (
        certificate is None
        or certificate["state"] != "active"
        or certificate["program_sha256"] != trusted.program[2]
        or certificate["target_sha256"] != trusted.target[2]
    ):
        return F.array(F.lit("runner-certificate-not-active"))
    other = ~r["runnerCertificateID"].eqNullSafe(certificate["id"])
    runtime = certificate.get("runtime")
    differs = (
        ~_canonical_text(r["runtime"]).eqNullSafe(_canonical_text(F.lit(runtime)))
        if runtime
        else F.lit(False)
    )
    return reasons(
        (other, "runner-certificate-not-active"),
        (~other & differs, "runner-runtime-identity-mismatch"),
    )


def _app(trusted: Trusted) -> Column:
    app, release = F.col("r")["appRelease"], trusted.app_release
    if release is None or release["state"] != "supported":
        return F.array(F.lit("app-release-not-supported"))
    same = (
        app["version"].eqNullSafe(release["version"])
        & app["build"].eqNullSafe(release["build"])
        & app["sourceRevision"].eqNullSafe(release["source_revision"])
        & app["embeddedMeasurementStackSHA256"].eqNullSafe(trusted.stack_sha256)
        & F.coalesce(
            F.col("r")["runnerCertificateID"].isin(list(release["certificate_ids"])), F.lit(False)
        )
    )
    return reasons((~same, "app-release-not-supported"))


def _target_reasons(trusted: Trusted) -> Column:
    environment = F.col("r")["environment"]
    return F.when(
        environment.isNull(), F.array(F.lit("target-environment-ineligible"))
    ).otherwise(
        eligibility.admission_reasons(
            environment["batteryStateAtStart"],
            environment["batteryLevelAtStart"],
            environment["lowPowerModeAtStart"],
            environment["thermalStateAtStart"],
            environment["thermalAssistance"],
            trusted.admission,
        )
    )


def _metric_decisions() -> Column:
    r = F.col("r")
    rows = []
    for metric, _, _, _ in rules.METRICS:
        values = F.col("series")[metric]
        status, codes = metric_status(
            F.lit(metric),
            r["payload"]["workload"]["id"],
            F.size("contract") == 0,
            F.col("target_reasons"),
            F.size(values),
        )
        rows.append(
            F.struct(
                F.lit(metric).alias("metric_id"),
                status.alias("status"),
                codes.alias("reason_codes"),
                attempt_ops.series_value(metric, values).alias("value"),
            )
        )
    return F.array(*rows)


def _behaviour() -> tuple[Column, Column, Column]:
    """Behaviour status, its reasons, and the recommendation status."""
    number = lambda s: F.size(F.filter(F.col("responses"), lambda x: x == s))
    voted = behaviour.vote_status(
        number("verified"), number("contradicted"), rules.MINIMUM_ELIGIBLE_ATTEMPTS
    )
    defined = F.col("r")["payload"]["workload"]["id"].eqNullSafe(rules.INTERACTIVE)
    valid = F.size("contract") == 0
    status = F.when(defined & valid, voted).otherwise("not-applicable")
    codes = (
        F.when(~defined, F.array(F.lit("behavior-not-defined-for-workload")))
        .when(~valid, F.array(F.lit("contract-conformance-failed")))
        .otherwise(behaviour.vote_reasons(voted))
    )
    return status, codes, status


def comparison_identity() -> Column:
    """JSON of the sixteen exact identity fields."""
    r = F.col("r")
    payload, model, device = r["payload"], r["model"], r["device"]
    plain = {
        "programID": r["program"]["id"],
        "programVersion": r["program"]["version"],
        "targetID": r["target"]["id"],
        "targetVersion": r["target"]["version"],
        "runnerCertificateID": r["runnerCertificateID"],
        "workloadID": payload["workload"]["id"],
        "workloadVersion": payload["workload"]["version"],
        "measurementMode": payload["measurementMode"],
        "modelArtifactID": model["artifactID"],
        "modelArtifactRevision": model["artifactRevision"],
        "quantization": model["quantization"],
        "machineIdentifier": device["machineIdentifier"],
        "osVersion": device["osVersion"],
        "osBuild": device["osBuild"],
    }
    fragments = {
        "runtimeIdentity": r["runtime"],
        "inferenceConfiguration": payload["inferenceConfiguration"],
    }
    return identity_json(plain, fragments)


def _repeated(digests: DataFrame, accepted_digests: DataFrame | None) -> DataFrame:
    """Packages whose digest an earlier one has; the documents stay out of this shuffle."""
    seen = number_rows(digests, ["result_sha256"], [F.col("package_id")], "_use")
    if accepted_digests is not None:
        known = accepted_digests.select("result_sha256").distinct().withColumn("_known", F.lit(True))
        seen = lookup(seen, known, ["result_sha256"], "left", ["package_id"])
    else:
        seen = seen.withColumn("_known", F.lit(None).cast("boolean"))
    return seen.where((F.col("_use") > 1) | F.col("_known")).select("package_id")


def decide(
    packages: DataFrame,
    models: DataFrame,
    trusted: Trusted,
    accepted_digests: DataFrame | None = None,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """One decision row per package, rejected ones included.

    models: entry_id, sha256, artifact_id, artifact_revision, parameter_count,
    quantization, format.  accepted_digests: result_sha256 of earlier intakes.
    repeated: package_id of the packages whose digest is known to be taken; they
    are looked for here if none are given.
    """
    if repeated is None:
        digests = parse_packages(packages).select("package_id", "result_sha256")
        repeated = materialize(_repeated(digests, accepted_digests))
    repeated = repeated.select("package_id", F.lit(True).alias("duplicate"))
    # A document grows many times over when it is parsed, so documents are joined as bytes if
    # the list of repeated ones is long, and parsed ones stay where they are.
    repeated = F.broadcast(repeated) if small(repeated) else repeated
    flagged = packages.join(repeated, "package_id", "left")
    parsed = parse_packages(flagged).withColumn("entry_id", F.col("r")["model"]["registryEntryID"])
    registry = models.select(
        F.col("entry_id"), F.struct(*[c for c in models.columns if c != "entry_id"]).alias("known_model")
    )
    if small(registry):
        joined = parsed.join(F.broadcast(registry), "entry_id", "left")
    else:
        joined = lookup(parsed, registry, ["entry_id"], "left", ["package_id"])
    duplicate = F.coalesce("duplicate", F.lit(False))
    with_structure = joined.select(
        "*", _structural(trusted).alias("structural"), _digest(duplicate).alias("digest")
    )
    with_contract = with_structure.select(
        "*",
        F.when(F.size("structural") > 0, F.array(F.lit("structural-validity-failed")))
        .otherwise(_contract(trusted))
        .alias("contract"),
        attempt_ops.counted(F.col("r")["payload"]["attempts"]).alias("measured"),
    )
    texts = normalized_texts(F.transform(F.col("measured"), lambda a: a["generatedText"]))
    series = attempt_ops.metric_series(F.col("measured"))
    with_texts = with_contract.select(
        "*",
        F.struct(*[v.alias(m) for m, v in series.items()]).alias("series"),
        F.transform(texts, lambda t: behaviour.response_status(t)).alias("responses"),
        _target_reasons(trusted).alias("target_reasons"),
    )
    login = F.col("s")["contributor"]["githubLogin"]
    author_status, author_reason = integrity.author_check(login, F.col("author"))
    behaviour_status, behaviour_codes, recommendation = _behaviour()
    codes_of = lambda reason: F.array_compact(F.array(reason))
    environment = F.col("r")["environment"]
    manual = F.when(
        environment.isNotNull(),
        eligibility.review_triggers(
            F.col("s")["contributor"]["conflictOfInterest"],
            environment["thermalAssistance"],
            [
                environment["batteryStateAtStart"],
                environment["thermalStateAtStart"],
                environment["thermalStateAtEnd"],
                environment["thermalAssistance"],
            ],
        ),
    ).otherwise(
        reasons(
            (
                F.col("s")["contributor"]["conflictOfInterest"].eqNullSafe("disclosed"),
                "declared-conflict-of-interest",
            )
        )
    )
    closed = _none() if trusted.intake_open else F.array(F.lit("public-intake-closed"))
    checks = {
        "structuralValidity": _status(F.col("structural")),
        "contractConformance": _status(F.col("contract")),
        "digestIntegrity": _status(F.col("digest")),
        "runnerCertificate": _status(_runner(trusted)),
        "appRelease": _status(_app(trusted)),
        "intakeState": _status(closed),
        "contributor": (author_status, codes_of(author_reason)),
    }
    classification, codes = decisions.inline_decision(checks, manual)
    report_identity = F.concat_ws(
        "|",
        "result_sha256",
        "submission_sha256",
        F.lit(trusted.intake_policy_sha256),
        F.lit(trusted.evaluated_at),
        F.lit(trusted.validator_revision),
    )
    return with_texts.select(
        "package_id",
        "result_sha256",
        "submission_sha256",
        F.col("s")["submissionID"].alias("submission_id"),
        F.col("r")["resultID"].alias("result_id"),
        F.col("r")["payload"]["workload"]["id"].alias("workload_id"),
        login.alias("contributor"),
        uuid5(report_identity).alias("report_id"),
        classification.alias("classification"),
        codes.alias("reason_codes"),
        behaviour_status.alias("behaviour"),
        behaviour_codes.alias("behaviour_reasons"),
        recommendation.alias("recommendation"),
        _metric_decisions().alias("metrics"),
        comparison_identity().alias("identity_json"),
    )


def contributions(decided: DataFrame) -> DataFrame:
    """Accepted packages, one row per passing metric with a value.

    The class is tested inside the explode, not in a filter, which would be
    pushed below the projections and evaluate all checks a second time.
    """
    usable = F.when(F.col("classification") == "auto-accept", F.col("metrics"))
    accepted = decided.select(
        "package_id",
        "result_sha256",
        "workload_id",
        "contributor",
        F.lower("contributor").alias("contributor_key"),
        canonical_json_sha256(F.col("identity_json")).alias("comparison_id"),
        F.explode(usable).alias("m"),
    )
    return accepted.where("m.status = 'pass' AND m.value IS NOT NULL").select(
        "package_id",
        "result_sha256",
        "workload_id",
        "contributor",
        "contributor_key",
        "comparison_id",
        F.col("m.metric_id").alias("metric_id"),
        F.col("m.value").alias("value"),
    )


def ranked_views(contributed: DataFrame) -> DataFrame:
    """The primary metric of every view: weighted value, state, rank."""
    cell = ["comparison_id", "workload_id", "metric_id"]
    medians = cells.contributor_medians(contributed, cell, "contributor_key", "value")
    return rank_views(cells.weighted_cells(medians, cell))


def rank_views(weighted: DataFrame) -> DataFrame:
    """Ranks per view from cell values.

    weighted: comparison_id, workload_id, metric_id, value, contributors, runs.
    """
    direction = {m: d for m, _, d, _ in rules.METRICS}
    views = fixed_rows(
        weighted.sparkSession,
        ["view_id", "workload_id", "metric_id", "_sign"],
        [(v, w, m, 1.0 if direction[m] == "lower-is-better" else -1.0) for v, w, m in rules.VIEWS],
    )
    rows = weighted.join(views, ["workload_id", "metric_id"]).withColumn(
        "_order", F.col("_sign") * F.col("value")
    )
    ranked = cells.rank_cells(rows, ["view_id"], "_order", False, ["comparison_id"])
    return ranked.select(
        "view_id",
        "comparison_id",
        "metric_id",
        "value",
        F.col("contributors").alias("contributor_count"),
        F.col("runs").alias("submission_count"),
        cells.evidence_state(F.col("contributors")).alias("evidence_state"),
        "rank",
    )


def excluded(decided: DataFrame) -> DataFrame:
    """Packages kept out of the ranking, with their reasons."""
    return decided.where("classification <> 'auto-accept'").select(
        "submission_id", "result_sha256", "classification", "reason_codes"
    )


def rank_packages(
    packages: DataFrame,
    models: DataFrame,
    trusted: Trusted,
    accepted_digests: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, ranked views).

    The decisions are materialized once: they are small next to the documents,
    several tables are built from them, and a filter on the classification
    must not be pushed down into the checks, which would run them twice.
    """
    decided = materialize(decide(packages, models, trusted, accepted_digests))
    return decided, ranked_views(contributions(decided))
