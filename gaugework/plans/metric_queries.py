"""Attempt and result metrics, gates and recomputation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import joined, reasons
from gaugework.operators import metrics
from gaugework.operators.ordered import exact_median, exact_percentiles
from gaugework.plans.registry import Tables, big, query, r6

# Order lines play attempts: the first line is the warm-up, returned lines failed.
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _attempts(spark, sf):
    return Tables(spark, sf).lineitem.select(
        F.col("l_orderkey").alias("result_id"),
        (F.col("l_linenumber") - 1).alias("idx"),
        F.when(F.col("l_linenumber") == 1, "warmup").otherwise("measured").alias("phase"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("outcome"),
        F.lit(0).cast("long").alias("accepted_ns"),
        big(F.col("l_partkey") * 1000).alias("first_token_ns"),
        F.when(F.col("l_tax") > 0, big(F.col("l_partkey") * 2000)).alias("first_renderable_ns"),
        (big(F.round(F.col("l_extendedprice") * 100)) * 1000).alias("completed_ns"),
        big(F.col("l_suppkey") * 1000000).alias("prompt_ns"),
        big(F.col("l_quantity") * 1000000).alias("decode_ns"),
        big("l_suppkey").alias("input_tokens"),
        big("l_linenumber").alias("output_tokens"),
        big(F.col("l_partkey") * 4096).alias("peak_bytes"),
    )


_ATTEMPTS = """
    WITH a AS (
      SELECT l_orderkey AS result_id, l_partkey * 1000 AS first_token,
             CASE WHEN l_tax > 0 THEN l_partkey * 2000 END AS renderable,
             CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 AS completed,
             l_suppkey AS tokens_in, l_suppkey * 1000000 AS prompt_ns,
             l_linenumber AS tokens_out, l_quantity * 1000000 AS decode_ns,
             l_partkey * 4096 AS peak
      FROM lineitem WHERE l_linenumber > 1 AND l_returnflag <> 'R'),
    long AS (
      SELECT result_id, 'first_renderable_ms' AS metric_id, renderable / 1000000.0 AS v FROM a
      UNION ALL SELECT result_id, 'pipeline_ttft_ms', first_token / 1000000.0 FROM a
      UNION ALL SELECT result_id, 'request_completion_ms', completed / 1000000.0 FROM a
      UNION ALL SELECT result_id, 'prefill_tokens_per_second',
        CASE WHEN prompt_ns > 0 AND tokens_in > 0 THEN tokens_in / (prompt_ns / 1000000000.0) END FROM a
      UNION ALL SELECT result_id, 'decode_tokens_per_second',
        CASE WHEN decode_ns > 0 AND tokens_out >= 2 THEN (tokens_out - 1) / (decode_ns / 1000000000.0) END FROM a
      UNION ALL SELECT result_id, 'peak_physical_footprint_mib', peak / 1048576.0 FROM a),
    val AS (SELECT result_id, metric_id, count(v) AS eligible_attempts,
              CASE WHEN metric_id = 'peak_physical_footprint_mib' THEN max(v) ELSE median(v) END AS value
            FROM long GROUP BY result_id, metric_id)
"""


def _values(spark, sf):
    usable = metrics.measured_and_succeeded(_attempts(spark, sf))
    long = metrics.long_values(usable, ["result_id"], metrics.attempt_values())
    return metrics.result_values(long, ["result_id"])


@query(
    "result_metrics",
    _ATTEMPTS
    + "SELECT result_id, metric_id, round(value, 6) AS value, eligible_attempts FROM val",
)
def result_metrics(spark, sf):
    """Six metric values per result over measured, succeeded attempts."""
    return _values(spark, sf).withColumn("value", r6("value"))


@query(
    "metric_decisions",
    _ATTEMPTS
    + """
    , w AS (SELECT val.*, CASE o_orderstatus WHEN 'F' THEN 'power.text.short-interaction'
              ELSE 'power.text.sustained-generation' END AS workload,
              o_totalprice > 400000 AS hot FROM val JOIN orders ON o_orderkey = result_id),
    d AS (SELECT metric_id, workload, CASE
        WHEN metric_id IN ('first_renderable_ms', 'request_completion_ms')
             AND workload <> 'power.text.short-interaction' THEN 'metric-not-defined-for-workload'
        WHEN hot THEN 'start-thermal-state-ineligible'
        WHEN eligible_attempts < 3 THEN 'insufficient-successful-measured-attempts'
        ELSE '' END AS reason FROM w)
    SELECT metric_id, workload, reason, CASE WHEN reason = '' THEN 'pass' ELSE 'not-applicable' END
           AS status, count(*) AS results FROM d GROUP BY ALL
    """,
)
def metric_decisions(spark, sf):
    """Every metric is decided on its own: scope, environment, attempt count."""
    orders = Tables(spark, sf).orders.select(
        F.col("o_orderkey").alias("result_id"),
        F.when(F.col("o_orderstatus") == "F", rules.INTERACTIVE)
        .otherwise(rules.SUSTAINED)
        .alias("workload"),
        reasons((F.col("o_totalprice") > 400000, "start-thermal-state-ineligible")).alias("target"),
    )
    both = _values(spark, sf).join(orders, "result_id")
    status, why = metrics.metric_status(
        F.col("metric_id"),
        F.col("workload"),
        F.lit(True),
        F.col("target"),
        F.col("eligible_attempts"),
    )
    decided = both.select("metric_id", "workload", joined(why).alias("reason"), status.alias("status"))
    return decided.groupBy("metric_id", "workload", "reason", "status").agg(
        F.count("*").alias("results")
    )


@query(
    "degradation",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber AS n, l_extendedprice AS p,
                 (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o,
                 l_linenumber > 1 AND l_returnflag <> 'R' AND l_tax > 0 AS ok,
                 l_linenumber > 1 AND l_returnflag <> 'R' AS done FROM lineitem),
    e AS (SELECT l_orderkey, count(*) FILTER (ok) AS n3, arg_min(p, o) FILTER (ok) AS f3,
            arg_max(p, o) FILTER (ok) AS l3, max(p) FILTER (done AND n = 2) AS f2,
            max(p) FILTER (done AND n = 6) AS l2, count(*) FILTER (done) AS n1,
            arg_min(p, o) FILTER (done) AS f1, arg_max(p, o) FILTER (done) AS l1
          FROM x GROUP BY ALL)
    SELECT l_orderkey,
           CASE WHEN n3 >= 2 THEN round((l3 - f3) / f3 * 100, 6) END AS current_change,
           round((l2 - f2) / f2 * 100, 6) AS release_change,
           CASE WHEN n1 >= 1 THEN round((l1 - f1) / f1 * 100, 6) END AS pilot_change
    FROM e
    """,
)
def degradation(spark, sf):
    """Three generations, three definitions of the first-to-last change."""
    lines = Tables(spark, sf).lineitem.select("l_orderkey", *_ORDER, "l_returnflag", "l_tax")
    price = F.col("l_extendedprice")
    done = (F.col("l_linenumber") > 1) & (F.col("l_returnflag") != "R")
    current = metrics.first_to_last(lines, ["l_orderkey"], _ORDER, price, done & (F.col("l_tax") > 0))
    completed = F.when(done, F.struct(*_ORDER))
    ends = lines.groupBy("l_orderkey").agg(
        F.max(F.when(done & (F.col("l_linenumber") == 2), price)).alias("_one"),
        F.max(F.when(done & (F.col("l_linenumber") == 6), price)).alias("_five"),
        F.min_by(price, completed).alias("_first"),
        F.max_by(price, completed).alias("_last"),
    )
    return current.join(ends, "l_orderkey").select(
        "l_orderkey",
        r6("change_percent").alias("current_change"),
        r6(metrics.percent_change(F.col("_one"), F.col("_five"))).alias("release_change"),
        r6(metrics.percent_change(F.col("_first"), F.col("_last"))).alias("pilot_change"),
    )


@query(
    "generation_medians",
    """
    SELECT l_orderkey, count(l_extendedprice) AS "values",
           CASE WHEN count(l_extendedprice) >= 1 THEN round(median(l_extendedprice), 6) END AS median_pilot,
           CASE WHEN count(l_extendedprice) >= 3 THEN round(median(l_extendedprice), 6) END AS median_release_1,
           CASE WHEN count(l_extendedprice) >= 3 THEN round(median(l_extendedprice), 6) END AS median_current
    FROM lineitem GROUP BY ALL
    """,
)
def generation_medians(spark, sf):
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_extendedprice")
    out = metrics.medians_by_generation(lines, ["l_orderkey"], "l_extendedprice")
    names = ("median_pilot", "median_release_1", "median_current")
    return out.select("l_orderkey", "values", *[r6(n).alias(n) for n in names])


@query(
    "outcome_counts",
    """
    SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click,
           count(*) FILTER (event_type = 'error') AS n_error,
           count(*) FILTER (event_type = 'purchase') AS n_purchase,
           count(*) FILTER (event_type = 'signup') AS n_signup,
           count(*) FILTER (event_type = 'view') AS n_view,
           count(*) FILTER (event_type = 'purchase' AND value < 5) AS n_early
    FROM events GROUP BY ALL
    """,
)
def outcome_counts(spark, sf):
    events = Tables(spark, sf).events.select("user_id", "event_type", "value")
    names = ("click", "error", "purchase", "signup", "view")
    early = (F.col("event_type") == "purchase") & (F.col("value") < 5)
    marked = events.unionByName(events.where(early).withColumn("event_type", F.lit("early")))
    return metrics.outcome_counts(marked, ["user_id"], "event_type", (*names, "early"))


@query(
    "eligible_gate",
    """
    WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value > 20) AS n
               FROM events GROUP BY ALL)
    SELECT user_id, n AS eligible_attempts,
           CASE WHEN n < 3 THEN 'insufficient-successful-measured-attempts' ELSE 'pass' END AS decision
    FROM g
    """,
)
def eligible_gate(spark, sf):
    usable = (F.col("event_type") == "purchase") & (F.col("value") > 20)
    counts = Tables(spark, sf).events.groupBy("user_id").agg(
        F.count_if(usable).alias("eligible_attempts")
    )
    gate = metrics.attempt_gate(F.col("eligible_attempts"))
    return counts.withColumn("decision", F.coalesce(gate, F.lit("pass")))


@query(
    "reported_values",
    """
    WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS v
               FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, round(v, 6) AS recomputed,
           CASE WHEN v IS NULL THEN false
                ELSE abs(o_totalprice - v) <= greatest(1e-6 * greatest(abs(o_totalprice), abs(v)), 25000)
                END AS matches
    FROM orders LEFT JOIN s ON o_orderkey = l_orderkey
    """,
)
def reported_values(spark, sf):
    """Reported totals against the sum of their parts, within tolerance."""
    t = Tables(spark, sf)
    recomputed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("recomputed")
    )
    reported = t.orders.select("o_orderkey", F.col("o_totalprice").alias("reported"))
    out = metrics.compare_reported(reported, recomputed, ["o_orderkey"], 25000.0)
    return out.select("o_orderkey", r6("recomputed").alias("recomputed"), "matches")


@query(
    "series_reproduced",
    """
    WITH s AS (SELECT user_id, count(*) AS n, arg_min(value, event_id) AS f, max(value) AS p,
                 arg_max(event_type, event_id) AS e FROM events GROUP BY ALL),
    c AS (SELECT c_custkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS rn, c_mktsegment FROM customer)
    SELECT c_custkey, n IS NOT DISTINCT FROM rn AS count_ok,
           coalesce(f, -1) <= coalesce(p, -1) AS peak_ok,
           coalesce(e, 'none') AS end_state, p IS NULL AS without_series
    FROM c LEFT JOIN s ON user_id = c_custkey
    """,
)
def series_reproduced(spark, sf):
    """Stated count, peak and end state against those of the raw series."""
    t = Tables(spark, sf)
    raw = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").alias("n"),
        F.min_by("value", "event_id").alias("f"),
        F.max("value").alias("p"),
        F.max_by("event_type", "event_id").alias("e"),
    )
    stated = t.customer.select(
        "c_custkey", big(F.floor(F.col("c_acctbal") / 100)).alias("stated")
    )
    return stated.join(raw, "c_custkey", "left").select(
        "c_custkey",
        F.col("n").eqNullSafe(F.col("stated")).alias("count_ok"),
        (F.coalesce("f", F.lit(-1.0)) <= F.coalesce("p", F.lit(-1.0))).alias("peak_ok"),
        F.coalesce("e", F.lit("none")).alias("end_state"),
        F.col("p").isNull().alias("without_series"),
    )


@query(
    "legacy_recompute",
    """
    WITH s AS (SELECT l_orderkey, median(l_extendedprice) AS m, count(*) AS n,
                 bool_or(l_returnflag = 'R') AS failed_check
               FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
    SELECT o_orderkey, o_orderstatus = 'P' AND coalesce(failed_check, false) AND n >= 3 AS recomputed,
           round(CASE WHEN o_orderstatus = 'P' AND failed_check AND n >= 3 THEN m
                      WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END, 6) AS value
    FROM orders LEFT JOIN s ON o_orderkey = l_orderkey
    """,
)
def legacy_recompute(spark, sf):
    """Old results nulled by a text rule regain the value of their raw series."""
    t = Tables(spark, sf)
    raw = exact_median(
        t.lineitem.where("l_linenumber > 1").select(
            F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_returnflag"
        ),
        ["o_orderkey"],
        "l_extendedprice",
        "m",
        {"n": (F.count("*"), F.sum), "failed_check": (F.bool_or(F.col("l_returnflag") == "R"), F.bool_or)},
    )
    both = t.orders.join(raw, "o_orderkey", "left")
    applies = (F.col("o_orderstatus") == "P") & F.coalesce("failed_check", F.lit(False))
    enough = F.coalesce(F.col("n") >= rules.MINIMUM_ELIGIBLE_ATTEMPTS, F.lit(False))
    exported = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice"))
    value = metrics.prefer_recomputed(F.col("m"), exported, applies, enough)
    return both.select(
        "o_orderkey", (applies & enough).alias("recomputed"), r6(value).alias("value")
    )


@query(
    "input_length_medians",
    """
    WITH p AS (SELECT CASE WHEN n_chars >= 2048 THEN 2048 WHEN n_chars >= 512 THEN 512
                 WHEN n_chars >= 128 THEN 128 ELSE 32 END AS target, source, n_chars,
                 length(text) AS measured FROM documents)
    SELECT source, CAST(target AS BIGINT) AS target, count(*) AS attempts,
           count(*) FILTER (n_chars = measured) AS count_matches,
           round(median(n_chars), 6) AS median_chars,
           round(quantile_cont(measured, 0.95), 6) AS p95_chars
    FROM p GROUP BY ALL
    """,
)
def input_length_medians(spark, sf):
    """Medians per source and input-length point."""
    n = F.col("n_chars")
    points = Tables(spark, sf).documents.select(
        "source",
        F.when(n >= 2048, 2048).when(n >= 512, 512).when(n >= 128, 128).otherwise(32)
        .cast("long")
        .alias("target"),
        n,
        big(F.length("text")).alias("measured"),
    )
    keys = ["source", "target"]
    medians = exact_median(
        points,
        keys,
        "n_chars",
        "median_chars",
        {
            "attempts": (F.count("*"), F.sum),
            "count_matches": (F.count_if(F.col("n_chars") == F.col("measured")), F.sum),
        },
    )
    tails = exact_percentiles(points, keys, "measured", {"p95_chars": 0.95})
    return medians.join(tails, keys).select(
        *keys,
        "attempts",
        "count_matches",
        r6("median_chars").alias("median_chars"),
        r6("p95_chars").alias("p95_chars"),
    )


@query(
    "prompt_constant",
    """
    SELECT user_id, count(DISTINCT floor(value / 50)) = 1 AS constant,
           bool_and(event_type IN ('view', 'click', 'error', 'signup', 'purchase')) AS known
    FROM events GROUP BY ALL
    """,
)
def prompt_constant(spark, sf):
    """A field that must be identical over all completed attempts."""
    return (
        Tables(spark, sf)
        .events.groupBy("user_id")
        .agg(
            (F.countDistinct(F.floor(F.col("value") / 50)) == 1).alias("constant"),
            F.bool_and(
                F.col("event_type").isin("view", "click", "error", "signup", "purchase")
            ).alias("known"),
        )
    )
