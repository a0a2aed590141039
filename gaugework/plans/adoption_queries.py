"""Rules of an adoption over the given tables: orders are entries, their lines the evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.operators import adoption
from gaugework.plans.registry import Tables, query

WORKLOADS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")

# Results are the orders with lines; a report is what the lines say of an order.
_ADOPTION = """
    WITH l AS (SELECT l_orderkey AS k, sum(l_quantity) > 100 AS many, bool_or(l_returnflag = 'R') AS returned, max(l_tax) > 0.07 AS taxed,
          count(*) AS n FROM lineitem GROUP BY ALL),
    e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey - 1 ELSE o_orderkey END AS result_id,
          o_orderkey // 2 * 2 + CASE WHEN o_orderkey % 89 = 1 THEN 0 ELSE o_orderkey % 2 END AS session_id, o_orderpriority AS workload,
          o_custkey AS artifact, o_totalprice > 250000 AS many, o_orderstatus = 'F' AS returned, o_orderkey % 3 = 0 AS taxed FROM orders),
    j AS (SELECT e.*, l.k IS NOT NULL AS there, l.many AS r_many, l.returned AS r_returned, l.taxed AS r_taxed, n FROM e LEFT JOIN l USING (k)),
    v AS (SELECT 'raw-missing' AS rule, k::VARCHAR AS subject, 1::BIGINT AS found FROM j WHERE NOT there
      UNION ALL SELECT 'report-missing', k::VARCHAR, 1 FROM j WHERE NOT there OR k % 41 = 7
      UNION ALL SELECT 'raw-digest-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 53 = 9
      UNION ALL SELECT 'report-digest-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 41 <> 7 AND k % 59 = 3
      UNION ALL SELECT 'report-pair-invalid', k::VARCHAR, 1 FROM j WHERE there AND k % 41 <> 7 AND n > 9
      UNION ALL SELECT 'source-identity-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 61 = 2
      UNION ALL SELECT 'result-id-mismatch', k::VARCHAR, 1 FROM j WHERE there AND result_id <> k
      UNION ALL SELECT 'session-id-mismatch', k::VARCHAR, 1 FROM j WHERE there AND session_id <> k
      UNION ALL SELECT 'artifact-revision-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 67 = 4
      UNION ALL SELECT 'performance-eligible-decision-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 41 <> 7 AND many <> r_many
      UNION ALL SELECT 'recommendation-eligible-decision-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 41 <> 7 AND returned <> r_returned
      UNION ALL SELECT 'primary-metric-eligible-decision-mismatch', k::VARCHAR, 1 FROM j WHERE there AND k % 41 <> 7 AND taxed <> r_taxed
      UNION ALL SELECT 'result-id-not-unique', result_id::VARCHAR, count(*) FROM e GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT 'session-id-not-unique', session_id::VARCHAR, count(*) FROM e GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT 'cell-not-unique', artifact || ' / ' || workload, count(*) FROM e GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT 'cell-not-covered', a || ' / ' || w, 1 FROM (SELECT DISTINCT artifact AS a FROM e),
          (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED']) AS w)
        WHERE NOT EXISTS (FROM e WHERE artifact = a AND workload = w)
      UNION ALL SELECT DISTINCT 'workload-not-in-the-matrix', artifact || ' / ' || workload, 1 FROM e
        WHERE workload NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
      UNION ALL SELECT 'artifact-count-mismatch', '3', count(DISTINCT artifact) FROM e HAVING count(DISTINCT artifact) <> 3
      UNION ALL SELECT 'entries-count-mismatch', '6', count(*) FROM e HAVING count(*) <> 6
      UNION ALL SELECT 'performance-eligible-count-mismatch', '6', count(*) FILTER (many) FROM e HAVING count(*) FILTER (many) <> 6
      UNION ALL SELECT 'adopted-entry-dropped', k::VARCHAR, 1 FROM e WHERE k % 71 = 8
      UNION ALL SELECT 'adopted-entry-changed', k::VARCHAR, 1 FROM e WHERE k % 71 <> 8 AND k % 73 = 6)
"""


def _entries(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return t.orders.select(
        key.alias("entry_id"),
        text("raw/", key).alias("raw_path"),
        F.when(key % 53 == 9, F.lit("other")).otherwise(F.sha2(key.cast("string"), 256)).alias("raw_sha256"),
        text("report/", key).alias("report_path"),
        F.when(key % 59 == 3, F.lit("other")).otherwise(F.sha2(text("r", key), 256)).alias("report_sha256"),
        F.when(key % 97 == 5, key - 1).otherwise(key).cast("string").alias("result_id"),
        (F.floor(key / 2) * 2 + F.when(key % 89 == 1, 0).otherwise(key % 2)).cast("string").alias("session_id"),
        F.col("o_orderpriority").alias("workload_id"),
        F.col("o_custkey").cast("string").alias("artifact_id"),
        F.when(key % 67 == 4, "r2").otherwise("r1").alias("artifact_revision"),
        (F.col("o_totalprice") > 250000).alias("performance_eligible"),
        (F.col("o_orderstatus") == "F").alias("recommendation_eligible"),
        (key % 3 == 0).alias("primary_metric_eligible"),
    )


def _evidence(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (F.sum("l_quantity") > 100).alias("performance_eligible"),
        F.bool_or(F.col("l_returnflag") == "R").alias("recommendation_eligible"),
        (F.max("l_tax") > 0.07).alias("primary_metric_eligible"),
        F.count("*").alias("n"),
    )
    ordered = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(lines, "o_orderkey")
    results = ordered.select(
        text("raw/", key).alias("raw_path"),
        F.sha2(key.cast("string"), 256).alias("sha256"),
        (key % 61 != 2).alias("identity_ok"),
        key.cast("string").alias("result_id"),
        key.cast("string").alias("session_id"),
        F.col("o_orderpriority").alias("workload_id"),
        F.col("o_custkey").cast("string").alias("artifact_id"),
        F.lit("r1").alias("artifact_revision"),
    )
    wrong = F.when(F.col("n") > 9, F.array(F.lit("report-stale"))).otherwise(F.array().cast("array<string>"))
    reports = ordered.where("o_orderkey % 41 <> 7").select(
        text("report/", key).alias("report_path"),
        F.sha2(text("r", key), 256).alias("sha256"),
        wrong.alias("errors"),
        *adoption.DECISIONS,
    )
    return results, reports


@query("adoption_violations", _ADOPTION + "SELECT rule, subject, found FROM v")
def adoption_violations(spark, sf):
    """Every rule that an adoption of all orders would break, with what breaks it."""
    t = Tables(spark, sf)
    entries = _entries(t)
    # The release before: two kinds of its entries do not come through unchanged.
    key = F.col("entry_id")
    now = entries.where(key % 71 != 8).withColumn(
        "raw_sha256", F.when(key % 73 == 6, F.lit("newer")).otherwise(F.col("raw_sha256"))
    )
    found = [
        adoption.entry_violations(entries, *_evidence(t)),
        adoption.matrix_violations(entries, WORKLOADS, 3),
        adoption.count_violations(entries, {"entries": 6, "performance_eligible": 6}),
        adoption.list_changes(entries, now),
    ]
    return reduce(DataFrame.unionByName, found)
