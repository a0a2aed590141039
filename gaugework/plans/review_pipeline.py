"""From packages and review records to verdicts, evidence levels and levelled contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import reasons
from gaugework.operators import reviews
from gaugework.operators.hot_keys import lookup
from gaugework.operators.integrity import support_reasons
from gaugework.operators.ordered import as_of
from gaugework.session import materialize

# ---- fixed values: the parts of a result that make two runs comparable ------
COMPARED = (
    ("benchmarkRelease", "$.benchmarkRelease"),
    ("workloadID", "$.execution.workloadID"),
    ("workloadVersion", "$.execution.workloadVersion"),
    ("measurementModeID", "$.execution.measurementModeID"),
    ("fixtureSHA256", "$.execution.fixtureSHA256"),
    ("configuration", "$.configuration"),
    ("artifactID", "$.model.artifactID"),
    ("artifactRevision", "$.model.artifactRevision"),
    ("artifactContentHash", "$.model.artifactContentHash"),
    ("quantization", "$.model.quantization"),
    ("modelFormat", "$.model.modelFormat"),
    ("tokenizerIdentity", "$.model.tokenizerIdentity"),
    ("runtime", "$.runtime"),
    ("device", "$.device"),
)
FOLDED = ("name", "review_id", "submission_id", "reviewed_at", "review_type", "previous_level", "assigned_level")
PACKAGE_FACTS = (
    "valid", "manifest_sha256", "result_sha256", "result_id", "session_id", "contributor", "identity",
)


def comparison_identity(result: Column) -> Column:
    """Sorted JSON of the compared parts of a result document (a variant); absent counts as null."""
    parts = [F.try_variant_get(result, path, "variant").alias(name) for name, path in COMPARED]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def package_facts(packages: DataFrame) -> DataFrame:
    """What reviews are checked against, from package bytes.

    packages: submission, result (bytes), valid (the package's own checks).
    Packages whose submission has no id can't be reviewed and are left out.
    """
    text = lambda c: F.try_validate_utf8(F.col(c).cast("string"))
    documents = packages.select(
        "valid",
        F.sha2("submission", 256).alias("manifest_sha256"),
        F.sha2("result", 256).alias("result_sha256"),
        F.try_parse_json(text("submission")).alias("m"),
        F.try_parse_json(text("result")).alias("r"),
    )
    part = lambda document, path: F.try_variant_get(document, path, "string")
    return documents.select(
        part("m", "$.submissionID").alias("submission_id"),
        F.coalesce("valid", F.lit(False)).alias("valid"),
        "manifest_sha256",
        "result_sha256",
        part("r", "$.resultID").alias("result_id"),
        part("r", "$.execution.sessionID").alias("session_id"),
        part("m", "$.contributor.githubHandle").alias("contributor"),
        comparison_identity(F.col("r")).alias("identity"),
    ).where(F.col("submission_id").isNotNull())


def review_records(read: DataFrame) -> DataFrame:
    """Records for `judge_reviews` from `read_reviews`."""
    return read.select(
        "name",
        "name_matches",
        F.col("reviewID").alias("review_id"),
        F.col("submissionID").alias("submission_id"),
        F.coalesce("reviewedAt", F.lit("")).alias("reviewed_at"),
        F.col("reviewType").alias("review_type"),
        F.col("previousEvidenceLevel").alias("previous_level"),
        F.col("assignedEvidenceLevel").alias("assigned_level"),
        F.col("submissionManifestSHA256").alias("manifest_sha256"),
        F.col("resultID").alias("result_id"),
        F.col("resultSHA256").alias("result_sha256"),
        F.coalesce("supportingSubmissionIDs", F.array().cast("array<string>")).alias("supporting_ids"),
    )


def _known(packages: DataFrame, key: str, prefix: str) -> DataFrame:
    """Valid packages under another name; an invalid one counts as absent."""
    valid = packages.where("valid").dropDuplicates(["submission_id"])
    return valid.select(
        F.col("submission_id").alias(key),
        F.lit(True).alias(f"{prefix}known"),
        *[F.col(c).alias(f"{prefix}{c}") for c in PACKAGE_FACTS if c != "valid"],
    )


def _supports(records: DataFrame, packages: DataFrame) -> DataFrame:
    """(name, supporting_id, ...) with the reasons that do not depend on the history."""
    named = records.select(
        "name", "reviewed_at", "submission_id", F.explode(F.array_distinct("supporting_ids")).alias("supporting_id")
    )
    reviewed = lookup(
        named, _known(packages, "submission_id", "own_"), ["submission_id"], "left", ["name", "supporting_id"]
    )
    both = lookup(
        reviewed, _known(packages, "supporting_id", "their_"), ["supporting_id"], "left", ["name", "supporting_id"], named
    )
    same = lambda field: F.col(f"own_{field}").eqNullSafe(F.col(f"their_{field}"))
    handle = lambda side: F.lower(F.coalesce(f"{side}_contributor", F.lit("")))
    known = F.coalesce("their_known", F.lit(False))
    against = support_reasons(
        same("identity"), handle("own") == handle("their"), same("result_id"), F.lit(True), same("session_id")
    )
    static = F.concat(
        reasons(
            (~known, "support-missing"),
            (F.col("supporting_id").eqNullSafe(F.col("submission_id")), "support-is-itself"),
        ),
        F.when(known, against).otherwise(F.array().cast("array<string>")),
    )
    return both.select("name", "reviewed_at", "supporting_id", static.alias("why"))


def judge_reviews(records: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, supports, levels).

    records as from `review_records`, names being unique; packages as from
    `package_facts`.  verdicts: every record with valid, level_before and all
    errors; supports: every named support with its level just before the review
    and the reasons against it; levels: submission_id, evidence_level of every
    valid package.  A support counts only if it was accepted before the review,
    so its level is an as-of join of the accepted steps, by (date, name).
    """
    records = materialize(records)
    checked = lookup(
        records, _known(packages, "submission_id", "own_"), ["submission_id"], "left", ["name"]
    )
    known = F.coalesce("own_known", F.lit(False))
    differs = lambda field: known & ~F.col(field).eqNullSafe(F.col(f"own_{field}"))
    static = reasons(
        (~F.coalesce("name_matches", F.lit(False)), "name-is-not-the-review-id"),
        (~known, "package-missing-or-invalid"),
        (differs("manifest_sha256"), "manifest-digest-mismatch"),
        (differs("result_id"), "result-id-mismatch"),
        (differs("result_sha256"), "result-digest-mismatch"),
    )
    # Written: the fold reads both several times; what the checks compared is not needed again.
    judged = materialize(
        checked.select(*FOLDED, static.alias("static_errors")).withColumn(
            "static_ok", F.size("static_errors") == 0
        )
    )
    named = materialize(_supports(records, packages))
    supports = named.select("name", "supporting_id", (F.size("why") == 0).alias("support_ok"))
    folded = materialize(reviews.fold_reviews(judged, supports, "name", landed=True))
    moment = F.struct("reviewed_at", "name")
    steps = folded.where("valid").select(
        F.col("submission_id").alias("supporting_id"), moment.alias("at"), F.col("assigned_level").alias("level")
    )
    placed = as_of(named.withColumn("at", moment), steps, ["supporting_id"], "at", ["level"], landed=True)
    level = F.coalesce("level", F.lit("unreviewed"))
    accepted = level.isin(*rules.ACCEPTED_LEVELS)
    held = placed.select(
        "name",
        "supporting_id",
        level.alias("level_at_review"),
        F.concat("why", reasons((~accepted, "support-not-accepted"))).alias("why"),
    )
    against = held.groupBy("name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("why")))).alias("support_errors")
    )
    with_supports = lookup(folded, against, ["name"], "left", ["name"])
    general = F.filter("errors", lambda e: ~e.isin("package-mismatch", "support-invalid", "support-not-accepted"))
    errors = F.concat(
        "static_errors", general, F.coalesce("support_errors", F.array().cast("array<string>"))
    )
    verdicts = with_supports.select(
        "name", "review_id", "submission_id", "valid", "level_before", errors.alias("errors")
    )
    submissions = packages.where("valid").select("submission_id").distinct()
    return verdicts, held, reviews.evidence_levels(submissions, folded)


def with_levels(contributions: DataFrame, levels: DataFrame) -> DataFrame:
    """Contributions with their package's level: the source's own, or unreviewed without a review."""
    levels = levels.select("submission_id", F.col("evidence_level").alias("_reviewed"))
    rows = lookup(contributions, levels, ["submission_id"], "left", ["raw_path"])
    own = F.col("source_kind") == "maintainer-reference"
    level = F.when(own, F.lit("maintainer-reference")).otherwise(F.coalesce("_reviewed", F.lit("unreviewed")))
    return rows.withColumn("evidence_level", level).drop("_reviewed")
