"""Flattened series, embedded results, appends and batch scope over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.numbers import joined
from gaugework.operators import metrics
from gaugework.plans import evidence_ranking as ranking
from gaugework.plans.package_queries import derived_packages
from gaugework.plans.registry import Tables, query
from gaugework.plans.triage import scope, triage
from gaugework.session import spread
from gaugework.sources import tables
from gaugework.sources.packages import check_embedded
from gaugework.sources.sinks import split_append

_KEYS = """
    WITH c AS (SELECT CASE WHEN c_custkey % 60 = 59 THEN c_custkey - 1 ELSE c_custkey END AS k, md5(c_custkey::VARCHAR) AS h
               FROM customer),
    p AS (SELECT k, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
                   || substr(h, 21, 12) AS package_id FROM c),
    a AS (SELECT p.*, i, 1000 + (k % 97) * 10 + i * 3 AS base, 100 + (k % 31) * i + k % 25 AS step
          FROM p, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i))
"""


@query(
    "attempt_rows",
    _KEYS
    + """
    SELECT package_id, CAST(i AS BIGINT) AS idx, CASE WHEN i = 0 THEN 'warmup' ELSE 'measured' END AS phase,
      CASE WHEN i >= 1 AND k % 3 = 0 AND i <= k % 6 THEN 'failed' ELSE 'succeeded' END AS outcome,
      base AS first_token_ns, base + 2 * step + 50 AS completed_ns,
      round(2 / (2 * step / 1000000000.0), 3) AS decode_rate, CASE WHEN k % 11 = 2 THEN 'fair' ELSE 'nominal' END AS thermal_end
    FROM a
    """,
)
def attempt_rows(spark, sf):
    """Attempts as a table, with one metric computed on it."""
    rows = tables.attempts(ranking.parse_packages(derived_packages(spark, sf)))
    rate = metrics.attempt_values()["decode_tokens_per_second"]
    return rows.select(
        "package_id",
        "idx",
        "phase",
        "outcome",
        "first_token_ns",
        "completed_ns",
        F.round(rate, 3).alias("decode_rate"),
        "thermal_end",
    )


@query(
    "series_rows",
    _KEYS
    + """
    SELECT package_id, 18::BIGINT AS token_events, CAST(sum(3 * base + 3 * step) AS BIGINT) AS received_sum,
      CASE WHEN any_value(k) % 4 = 1 THEN 12::BIGINT ELSE 6::BIGINT END AS probed, 12::BIGINT AS memory_samples,
      CASE WHEN any_value(k) % 11 = 2 THEN 6::BIGINT ELSE 0::BIGINT END AS transitions
    FROM a GROUP BY package_id
    """,
)
def series_rows(spark, sf):
    """Token events, memory samples and thermal transitions as tables, counted per package."""
    parsed = ranking.parse_packages(derived_packages(spark, sf)).select("package_id", "r")
    events = tables.token_events(parsed).groupBy("package_id").agg(
        F.count("*").alias("token_events"),
        F.sum("receivedNanoseconds").alias("received_sum"),
        F.count("decodedAtNanoseconds").alias("probed"),
    )
    samples = tables.memory_samples(parsed).groupBy("package_id").agg(
        F.count("*").alias("memory_samples")
    )
    changes = tables.thermal_transitions(parsed).groupBy("package_id").agg(
        F.count("*").alias("_changes")
    )
    return (
        events.join(samples, "package_id")
        .join(changes, "package_id", "left")
        .withColumn("transitions", F.coalesce("_changes", F.lit(0)).cast("long"))
        .drop("_changes")
    )


@query(
    "embedded_result",
    """
    SELECT doc_id AS submission_id, concat_ws(',', CASE WHEN doc_id % 13 = 0 THEN 'unsupported-encoding-or-digest' END,
        CASE WHEN doc_id % 7 = 0 THEN 'embedded-digest-mismatch' END, CASE WHEN doc_id % 5 = 0 THEN 'result-id-mismatch' END,
        CASE WHEN doc_id % 3 = 0 THEN 'machine-identifier-mismatch' END) AS reasons
    FROM documents
    """,
)
def embedded_result(spark, sf):
    """Base64 results inside submissions: digest and identity of the inner document."""
    doc = F.col("doc_id")
    inner = F.to_json(
        F.struct(
            F.lit("v1").alias("schemaVersion"),
            F.concat(F.lit("r"), doc.cast("string")).alias("resultID"),
            F.struct(F.col("source").alias("id")).alias("workload"),
            F.struct(F.col("lang").alias("artifactID")).alias("model"),
            F.struct(F.col("lang").alias("machineIdentifier")).alias("device"),
            F.col("text").alias("payload"),
        )
    )
    wrong = lambda n, value: F.when(doc % n == 0, F.lit("x")).otherwise(value)
    docs = spread(Tables(spark, sf).documents.drop("n_chars"), "doc_id")
    rows = docs.withColumn("inner", inner).select(
        doc.alias("submission_id"),
        F.when(doc % 13 == 0, "hex").otherwise("base64-json").alias("encoding"),
        F.lit("sha256").alias("digest_algorithm"),
        F.base64(F.col("inner").cast("binary")).alias("bundle"),
        wrong(7, F.sha2("inner", 256)).alias("sha256"),
        F.lit("v1").alias("schema_version"),
        wrong(5, F.concat(F.lit("r"), doc.cast("string"))).alias("result_id"),
        F.col("source").alias("workload_id"),
        F.col("lang").alias("artifact_id"),
        wrong(3, F.col("lang")).alias("machine_identifier"),
    )
    return check_embedded(rows).select("submission_id", joined(F.col("reasons")).alias("reasons"))


@query(
    "append_by_id",
    """
    WITH old AS (SELECT o_custkey AS result_id, max(o_orderpriority) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
    new AS (SELECT c_custkey AS result_id, CASE WHEN c_nationkey < 12 THEN '5-LOW' ELSE '4-NOT SPECIFIED' END AS d FROM customer)
    SELECT new.result_id, CASE WHEN old.d IS NULL THEN 'append' ELSE 'result-id-collision' END AS action
    FROM new LEFT JOIN old USING (result_id) WHERE old.d IS NULL OR old.d <> new.d
    """,
)
def append_by_id(spark, sf):
    """Same id and digest is a no-op, another digest a collision, the rest is appended."""
    t = Tables(spark, sf)
    existing = t.orders.where("o_orderstatus = 'F'").groupBy(
        F.col("o_custkey").alias("result_id")
    ).agg(F.max("o_orderpriority").alias("result_sha256"))
    incoming = t.customer.select(
        F.col("c_custkey").alias("result_id"),
        F.when(F.col("c_nationkey") < 12, "5-LOW").otherwise("4-NOT SPECIFIED").alias("result_sha256"),
    )
    fresh, clash = split_append(incoming, existing)
    return fresh.select("result_id", F.lit("append").alias("action")).unionByName(
        clash.select("result_id", F.col("reason").alias("action"))
    )


@query(
    "batch_scope",
    """
    WITH f AS (SELECT o_custkey AS batch_id, o_orderkey AS n, CASE WHEN o_orderkey % 23 = 0 THEN 'M' ELSE 'A' END AS status,
            CASE WHEN o_orderkey % 29 = 0 THEN 'result.json' ELSE NULL END AS only_file, o_custkey % 5 = 0 AS outside FROM orders),
    g AS (SELECT batch_id, bool_or(NOT outside) AS touches, count(*) FILTER (NOT outside AND status = 'A') AS packages,
            bool_or(outside OR status = 'M') AS not_result_only, bool_or(NOT outside AND status = 'A' AND only_file IS NOT NULL) AS incomplete
          FROM f GROUP BY ALL)
    SELECT batch_id, CASE WHEN NOT touches THEN 'not_applicable' WHEN not_result_only OR packages = 0 OR packages > 10 OR incomplete
        THEN 'rejected' ELSE 'auto_accept' END AS classification, packages,
      CASE WHEN touches THEN concat_ws(',', CASE WHEN not_result_only THEN 'non-result-only-change' END,
        CASE WHEN packages = 0 THEN 'no-package-added' END, CASE WHEN packages > 10 THEN 'too-many-packages' END,
        CASE WHEN incomplete THEN 'incomplete-package' END) ELSE '' END AS errors
    FROM g
    """,
)
def batch_scope(spark, sf):
    """Changed paths of every batch: result-only, complete, at most ten packages."""
    key = F.col("o_orderkey")
    folder = F.concat(
        F.when(F.col("o_custkey") % 5 == 0, "docs/").otherwise("in/draft/"),
        F.lit("00000000-0000-4000-8000-"),
        F.lpad(key.cast("string"), 12, "0"),
    )
    names = F.when(key % 29 == 0, F.array(F.lit("result.json"))).otherwise(
        F.array(F.lit("result.json"), F.lit("submission.json"))
    )
    changes = Tables(spark, sf).orders.select(
        F.col("o_custkey").alias("batch_id"),
        F.when(key % 23 == 0, "M").otherwise("A").alias("status"),
        folder.alias("folder"),
        F.explode(names).alias("file"),
    ).select("batch_id", "status", F.concat_ws("/", "folder", "file").alias("path"))
    scoped = scope(changes, "in/draft")
    decided = scoped.select("batch_id", F.lit("auto-accept").alias("classification"))
    return triage(scoped, decided).withColumn("errors", joined(F.col("errors")))
