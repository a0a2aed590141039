"""Stored validation reports against the results they speak of and their recomputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.numbers import reasons
from gaugework.operators.document_tree import compare_documents
from gaugework.session import materialize


def verify_reports(pairs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(verdicts, differences) of reports.

    pairs: keys (of one pair), content (text of the result), report (stored
    text), recomputed (what validating the result gives now).  verdicts: keys,
    errors, differing (number of paths); differences: keys, path, problem, left
    (recomputed), right (stored), as from `compare_documents`.  Only reports
    whose sorted text is not that of their recomputation are taken apart.
    """
    # Every text is parsed once, in a projection of its own: the checks below name each many times.
    parsed = pairs.select(
        *keys,
        "recomputed",
        "report",
        F.sha2("content", 256).alias("_digest"),
        F.try_parse_json("content").alias("_content"),
        F.try_parse_json("report").alias("_stored"),
        F.to_json(F.try_parse_json("recomputed")).alias("_canonical"),
    )
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    part = lambda c, path: F.try_variant_get(c, path, "string")
    reference = F.try_variant_get("_stored", "$.result", "variant")
    read = parsed.select(
        *keys,
        "recomputed",
        "report",
        "_digest",
        (is_object(F.col("_content")) & is_object(F.col("_stored"))).alias("_both"),
        (reference.isNotNull() & F.schema_of_variant(reference).startswith("OBJECT")).alias("_refers"),
        *[part("_stored", f"$.result.{n}").alias(f"_{n}") for n in ("sha256", "id", "schemaVersion")],
        part("_content", "$.resultID").alias("_result_id"),
        part("_content", "$.schemaVersion").alias("_result_schema"),
        (~F.col("_canonical").eqNullSafe(F.to_json("_stored"))).alias("_unlike"),
    )
    both = F.col("_both")
    bound = both & F.col("_refers")
    differs = lambda stated, value: bound & ~F.col(stated).eqNullSafe(F.col(value))
    errors = reasons(
        (~both, "result-and-report-must-be-objects"),
        (both & ~F.coalesce(bound, F.lit(False)), "report-has-no-result-reference"),
        (differs("_sha256", "_digest"), "report-does-not-bind-result"),
        (differs("_id", "_result_id"), "result-id-mismatch"),
        (differs("_schemaVersion", "_result_schema"), "result-schema-mismatch"),
    )
    kept = materialize(
        read.select(
            *keys,
            errors.alias("_errors"),
            F.when(F.col("_unlike"), F.struct("recomputed", "report")).alias("_texts"),
        )
    )
    unlike = kept.where(F.col("_texts").isNotNull())
    texts = lambda name: unlike.select(*keys, F.col(f"_texts.{name}").alias("text"))
    differences = materialize(compare_documents(texts("recomputed"), texts("report"), keys, "text"))
    counts = differences.groupBy(*keys).agg(F.count("*").alias("differing"))
    stale = F.col("differing").isNotNull()
    verdicts = kept.join(counts, list(keys), "left").select(
        *keys,
        F.concat("_errors", reasons((stale, "report-stale"))).alias("errors"),
        F.coalesce("differing", F.lit(0)).alias("differing"),
    )
    return verdicts, differences
