"""Scans of evidence folders; one bad file becomes a row, never a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework import schemas
from gaugework.functions.numbers import reasons
from gaugework.sources.listing import list_entries, read_bytes

PACKAGE_FILES = ("result.json", "submission.json")


def _in_folders(listing: DataFrame) -> DataFrame:
    """Rows of folders and of what lies in them, with the part of the path below the folder."""
    return listing.where(F.col("folder").isNotNull()).withColumn("direct", ~F.contains("file", F.lit("/")))


def package_files(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Completeness of every package folder: exactly the two files, hidden names counted.

    A folder without files is a package too.  `listing` is what `list_entries`
    gave for the root, if it is at hand.
    """
    rows = _in_folders(list_entries(spark, root) if listing is None else listing)
    named = lambda name: (F.col("file") == name) & (F.col("kind") == "file")
    has = lambda name: F.count_if(named(name)) == 1
    plain = F.col("kind").isin("folder", "empty")
    return rows.groupBy(F.col("folder").alias("package_id")).agg(
        F.count_if(~plain).alias("files"),
        *[(~has(f)).alias(f"missing_{f.split('.')[0]}") for f in PACKAGE_FILES],
        (
            (F.count_if("direct") == len(PACKAGE_FILES)) & has(PACKAGE_FILES[0]) & has(PACKAGE_FILES[1])
        ).alias("file_set_valid"),
        F.count_if(F.col("direct") & F.col("file").isin(*PACKAGE_FILES) & (F.col("kind") != "file")).alias(
            "not_plain_files"
        ),
    )


def unexpected_files(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Entries that belong to no package: loose ones (but the README) and what is extra in a package.

    Hidden names, links and empty folders inside a package are entries like any other.
    """
    rows = list_entries(spark, root) if listing is None else listing
    loose = F.col("folder").isNull()
    own = F.col("file").isin(*PACKAGE_FILES)
    reason = (
        F.when(loose & (F.col("file") != "README.md"), "unexpected-entry")
        .when(~loose & own & (F.col("kind") != "file"), "package-entry-is-not-a-file")
        .when(~loose & ~own & (F.col("kind") != "folder"), "unexpected-package-file")
    )
    return rows.select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def read_packages(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """One row per package with the exact bytes of both files.

    The root is listed once; names are grouped by package, and the task that
    has a package opens its two files, so bytes are not shuffled and stray
    files cost a listing entry and nothing else.
    """
    listed = list_entries(spark, root) if listing is None else listing
    rows = _in_folders(listed).where(F.col("kind") == "file")
    at = lambda name: F.max(F.when(F.col("file") == name, F.col("path")))
    paths = rows.groupBy(F.col("folder").alias("package_id")).agg(
        at("submission.json").alias("submission_path"), at("result.json").alias("result_path")
    )
    complete = package_files(spark, root, listed).select("package_id", "file_set_valid")
    both = complete.join(paths, "package_id", "left")
    return read_bytes(
        both, ["package_id", "file_set_valid"], {"submission": "submission_path", "result": "result_path"}
    )


def with_declared_author(packages: DataFrame) -> DataFrame:
    """Ranking reruns take the declared contributor as the author."""
    login = F.get_json_object(F.col("submission").cast("string"), "$.contributor.githubLogin")
    return packages.withColumn("author", login)


def read_json_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) single-file JSON documents of a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.json")
        .load(folder)
        .select(
            "path",
            F.sha2("content", 256).alias("sha256"),
            F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
        )
    )
    kind = F.schema_of_variant(F.try_parse_json("text"))
    problem = (
        F.when(F.col("text").isNull(), "unreadable-text")
        .when(F.try_parse_json("text").isNull(), "invalid-json")
        .when(~kind.startswith("OBJECT"), "top-level-value-is-not-an-object")
    )
    judged = files.withColumn("problem", problem)
    good = judged.where(F.col("problem").isNull()).drop("problem")
    return good, judged.where(F.col("problem").isNotNull()).select("path", "problem")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON lines; one `expected` label fills both."""
    cases = spark.read.schema(
        "caseID STRING, response STRING, expected STRING, expectedSemantic STRING, "
        "expectedBehavior STRING, focus STRING, source STRING, _corrupt STRING"
    ).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    fill = lambda c: F.coalesce(F.col(c), F.col("expected")).alias(c)
    return cases.select(
        "caseID", "response", fill("expectedSemantic"), fill("expectedBehavior"), "focus", "source",
        F.col("_corrupt").alias("corrupt"),
    )


def check_embedded(submissions: DataFrame) -> DataFrame:
    """Embedded base64 result: digest and five identity fields against the inner document.

    submissions: submission_id, encoding, digest_algorithm, bundle, sha256,
    schema_version, result_id, workload_id, artifact_id, machine_identifier.
    """
    inner = (
        "schemaVersion STRING, resultID STRING, workload STRUCT<id:STRING>, "
        "model STRUCT<artifactID:STRING>, device STRUCT<machineIdentifier:STRING>"
    )
    raw = F.try_to_binary("bundle", F.lit("base64"))
    opened = submissions.withColumn("_raw", raw).withColumn(
        "_inner", F.from_json(F.try_validate_utf8(F.col("_raw").cast("string")), inner)
    )
    differs = lambda outer, value: ~F.col(outer).eqNullSafe(value)
    i = F.col("_inner")
    parsed = F.try_parse_json(F.try_validate_utf8(F.col("_raw").cast("string"))).isNotNull()
    bad_base64 = F.col("_raw").isNull()
    readable = ~bad_base64 & parsed
    why = reasons(
        (
            ~F.col("encoding").eqNullSafe("base64-json")
            | ~F.col("digest_algorithm").eqNullSafe("sha256"),
            "unsupported-encoding-or-digest",
        ),
        (bad_base64, "invalid-base64"),
        (~bad_base64 & differs("sha256", F.sha2("_raw", 256)), "embedded-digest-mismatch"),
        (~bad_base64 & ~parsed, "embedded-json-invalid"),
        (readable & differs("schema_version", i["schemaVersion"]), "schema-version-mismatch"),
        (readable & differs("result_id", i["resultID"]), "result-id-mismatch"),
        (readable & differs("workload_id", i["workload"]["id"]), "workload-id-mismatch"),
        (readable & differs("artifact_id", i["model"]["artifactID"]), "artifact-id-mismatch"),
        (
            readable & differs("machine_identifier", i["device"]["machineIdentifier"]),
            "machine-identifier-mismatch",
        ),
    )
    return opened.select("submission_id", why.alias("reasons"))


def read_reviews(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): review files; the file stem must be the review id."""
    good, rejected = read_json_files(spark, folder)
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    records = good.select(
        "path", stem.alias("name"), F.from_json("text", schemas.REVIEW).alias("v")
    ).select("path", "name", "v.*")
    records = records.withColumn(
        "name_matches", F.col("name").eqNullSafe(F.col("reviewID"))
    )
    stray = (
        list_entries(spark, folder)
        .where(
            F.col("folder").isNotNull() & (F.col("kind") != "folder")
            | (~F.col("file").endswith(".json") & (F.col("file") != "README.md"))
            | (F.col("folder").isNull() & (F.col("kind") != "file"))
        )
        .select("path", F.lit("unexpected-review-entry").alias("problem"))
    )
    return records, rejected.unionByName(stray)


def read_official_list(spark: SparkSession, index: str, files: DataFrame) -> DataFrame:
    """Rows of an index document against the digests of the files they point at.

    files: path (relative, as in the index), sha256.
    """
    rows = (
        spark.read.option("wholetext", True)
        .text(index)
        .select(
            F.explode(
                F.from_json(
                    F.get_json_object("value", "$.results"),
                    "ARRAY<STRUCT<resultID:STRING,source:STRUCT<rawPath:STRING,rawSHA256:STRING,"
                    "finalValidationPath:STRING,finalValidationSHA256:STRING>>>",
                )
            ).alias("row")
        )
        .select("row.resultID", "row.source.*")
    )
    found = lambda name: files.select(
        F.col("path").alias(f"{name}Path"), F.col("sha256").alias(f"_{name}")
    )
    both = rows.join(found("raw"), "rawPath", "left").join(
        found("finalValidation"), "finalValidationPath", "left"
    )
    problem = (
        F.when(F.col("_raw").isNull(), "raw-result-missing")
        .when(F.col("_finalValidation").isNull(), "final-validation-missing")
        .when(F.col("_raw") != F.col("rawSHA256"), "raw-digest-mismatch")
        .when(F.col("_finalValidation") != F.col("finalValidationSHA256"), "report-digest-mismatch")
    )
    return both.withColumn("problem", problem).drop("_raw", "_finalValidation")


def load_pinned(spark: SparkSession, root: str, pins: DataFrame) -> DataFrame:
    """Policy documents named by (path, sha256) pins; any mismatch fails the job.

    Paths are relative to `root`.  The error is raised by the executor that
    meets the wrong bytes, so no result is ever built on them.
    """
    base = root.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.regexp_replace(F.col("path"), "^file:/+", "/").alias("_full"),
            F.sha2("content", 256).alias("_actual"),
            F.col("content").cast("string").alias("text"),
        )
        .withColumn("path", F.replace("_full", F.lit(base), F.lit("")))
    )
    both = pins.join(files.drop("_full"), "path", "left")
    checked = F.when(
        F.col("_actual").eqNullSafe(F.col("sha256")), F.col("text")
    ).otherwise(
        F.raise_error(F.concat(F.lit("pinned document missing or changed: "), F.col("path")))
    )
    return both.select("path", "sha256", checked.alias("text"))
