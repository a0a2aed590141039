"""Admission, contradiction and publication rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.numbers import joined
from gaugework.operators import eligibility
from gaugework.operators.integrity import fixed_rows
from gaugework.plans.registry import Tables, big, query

def _count_by(df, *columns):
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


@query(
    "environment_admission",
    """
    WITH e AS (SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN 'unplugged' WHEN 'O' THEN 'charging' END AS battery,
        o_totalprice / 500000.0 AS level, o_custkey % 10 = 0 AS low_power,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'serious' WHEN '2-HIGH' THEN 'unknown' ELSE 'nominal' END AS thermal,
        CASE WHEN o_custkey % 4 = 0 THEN 'cooling' ELSE 'none' END AS assistance FROM orders)
    SELECT o_orderkey, concat_ws(',',
        CASE WHEN battery IS DISTINCT FROM 'unplugged' THEN 'battery-state-ineligible' END,
        CASE WHEN NOT level * 100 >= 30 THEN 'battery-level-ineligible' END,
        CASE WHEN low_power THEN 'low-power-mode-ineligible' END,
        CASE WHEN thermal <> 'nominal' THEN 'start-thermal-state-ineligible' END,
        CASE WHEN assistance <> 'none' THEN 'thermal-assistance-ineligible' END) AS reasons,
      coalesce(battery = 'unplugged' AND NOT low_power AND level * 100 >= 50 AND thermal = 'nominal', false)
        AS release_ok,
      concat_ws(',', CASE WHEN battery IS NULL THEN 'battery_state_unknown' END,
        CASE WHEN battery = 'charging' THEN 'external_power_connected' END,
        CASE WHEN level * 100 < 50 THEN 'battery_level_below_minimum' END) AS pilot_reasons,
      assistance = 'none' AS ordinary_ranking
    FROM e
    """,
)
def environment_admission(spark, sf):
    """Three generations of the environment rule, and the ordinary-ranking flag."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    env = Tables(spark, sf).orders.select(
        "o_orderkey",
        F.when(status == "F", "unplugged").when(status == "O", "charging").alias("battery"),
        (F.col("o_totalprice") / 500000.0).alias("level"),
        (F.col("o_custkey") % 10 == 0).alias("low_power"),
        F.when(priority == "1-URGENT", "serious")
        .when(priority == "2-HIGH", "unknown")
        .otherwise("nominal")
        .alias("thermal"),
        F.when(F.col("o_custkey") % 4 == 0, "cooling").otherwise("none").alias("assistance"),
    )
    battery, level, low, thermal, assistance = (
        F.col(c) for c in ("battery", "level", "low_power", "thermal", "assistance")
    )
    return env.select(
        "o_orderkey",
        joined(eligibility.admission_reasons(battery, level, low, thermal, assistance)).alias(
            "reasons"
        ),
        eligibility.release_environment_ok(
            F.lit("Release"), F.lit(False), low, battery, level * 100, thermal
        ).alias("release_ok"),
        joined(eligibility.pilot_power_reasons(battery, level * 100)).alias("pilot_reasons"),
        (assistance == "none").alias("ordinary_ranking"),
    )


@query(
    "preparation_check",
    """
    SELECT l_linestatus, l_returnflag = 'A' AND l_linenumber < 4 AND l_tax < 0.06 AND l_quantity > 5
        AND l_discount IS NOT NULL AS prepared, count(*) AS rows
    FROM lineitem GROUP BY ALL
    """,
)
def preparation_check(spark, sf):
    ok = eligibility.preparation_ok(
        F.col("l_returnflag") == "A",
        F.col("l_linenumber") >= 4,
        F.col("l_tax") < 0.06,
        F.col("l_quantity") > 5,
        F.col("l_discount").isNotNull(),
    )
    lines = Tables(spark, sf).lineitem.select("l_linestatus", ok.alias("prepared"))
    return _count_by(lines, "l_linestatus", "prepared")


@query(
    "frozen_constants",
    """
    WITH x AS (SELECT o_orderkey, c_mktsegment, o_orderstatus, o_orderpriority,
                      nullif(c_nationkey % 3, 0) AS slot FROM orders JOIN customer ON o_custkey = c_custkey),
    e AS (SELECT * FROM (VALUES ('BUILDING', 'F', '1-URGENT', NULL), ('MACHINERY', 'O', '2-HIGH', '1'))
          AS t(seg, st, pr, sl))
    SELECT field, reason, count(*) AS rows FROM (
      SELECT 'o_orderstatus' AS field, 'release_identity_mismatch' AS reason FROM x JOIN e ON seg = c_mktsegment WHERE o_orderstatus <> st
      UNION ALL SELECT 'o_orderpriority', 'workload_identity_mismatch' FROM x JOIN e ON seg = c_mktsegment WHERE o_orderpriority <> pr
      UNION ALL SELECT 'slot', 'runner_incompatible' FROM x JOIN e ON seg = c_mktsegment WHERE slot::VARCHAR IS DISTINCT FROM sl)
    GROUP BY ALL
    """,
)
def frozen_constants(spark, sf):
    """Fields that differ from the frozen protocol, with the reason of that field."""
    t = Tables(spark, sf)
    expected = fixed_rows(
        spark,
        ["c_mktsegment", "field", "expected_value", "reason"],
        [
            ("BUILDING", "o_orderstatus", "F", "release_identity_mismatch"),
            ("BUILDING", "o_orderpriority", "1-URGENT", "workload_identity_mismatch"),
            ("BUILDING", "slot", None, "runner_incompatible"),
            ("MACHINERY", "o_orderstatus", "O", "release_identity_mismatch"),
            ("MACHINERY", "o_orderpriority", "2-HIGH", "workload_identity_mismatch"),
            ("MACHINERY", "slot", "1", "runner_incompatible"),
        ],
    )
    runs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "c_mktsegment",
        "o_orderstatus",
        "o_orderpriority",
        F.nullif(F.col("c_nationkey") % 3, F.lit(0)).alias("slot"),
    )
    out = eligibility.frozen_mismatches(
        runs, ["o_orderkey"], "c_mktsegment", ["o_orderstatus", "o_orderpriority", "slot"], expected
    )
    return _count_by(out, "field", "reason")


@query(
    "outcome_contradictions",
    """
    WITH a AS (SELECT CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
          WHEN 'signup' THEN 'cancelled' WHEN 'click' THEN 'outOfMemory' ELSE 'notRun' END AS outcome,
        CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events),
    b AS (SELECT outcome, CASE WHEN k < 30 THEN '' WHEN k < 60 THEN 'user_cancelled' WHEN k < 80 THEN 'runtime_error'
          ELSE 'os_memory_termination' END AS code, k % 2 = 0 AS stopped, k % 5 = 0 AS limited,
          value > 25 AS has_events, value > 40 AS has_metrics FROM a),
    c AS (SELECT outcome, concat_ws(',',
        CASE WHEN outcome <> 'completed' AND (stopped OR code = '' OR NOT CASE outcome
               WHEN 'failed' THEN code = 'runtime_error' WHEN 'cancelled' THEN code = 'user_cancelled'
               WHEN 'outOfMemory' THEN code = 'os_memory_termination' ELSE false END)
             OR outcome = 'notRun' AND has_events
             OR outcome = 'completed' AND (NOT stopped OR limited OR code <> '')
             THEN 'contradictory_outcome_evidence' END,
        CASE WHEN outcome <> 'completed' AND has_metrics THEN 'aggregate_mismatch' END) AS reasons FROM b)
    SELECT outcome, list_aggregate(list_sort(string_split(reasons, ',')), 'string_agg', ',') AS reasons,
           count(*) AS rows FROM c GROUP BY ALL
    """,
)
def outcome_contradictions(spark, sf):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    outcome = (
        F.when(kind == "purchase", "completed")
        .when(kind == "error", "failed")
        .when(kind == "signup", "cancelled")
        .when(kind == "click", "outOfMemory")
        .otherwise("notRun")
    )
    code = (
        F.when(k < 30, F.lit(None).cast("string"))
        .when(k < 60, "user_cancelled")
        .when(k < 80, "runtime_error")
        .otherwise("os_memory_termination")
    )
    stop = F.when(k % 2 == 0, F.when(k % 5 == 0, "timeLimit").otherwise("endOfSequence"))
    why = eligibility.outcome_reasons(
        F.col("outcome"),
        F.array_compact(F.array(F.col("code"))),
        F.col("stop"),
        F.col("value") > 25,
        F.col("value") > 40,
    )
    attempts = Tables(spark, sf).events.select(
        outcome.alias("outcome"), code.alias("code"), stop.alias("stop"), "value"
    )
    return _count_by(
        attempts.select("outcome", joined(F.array_sort(why)).alias("reasons")), "outcome", "reasons"
    )


@query(
    "token_limits",
    """
    WITH c AS (SELECT role, length(text) AS output, turn * 60 AS prompt,
          CASE WHEN turn % 2 = 0 THEN 'outputTokenLimit' ELSE 'endOfSequence' END AS stop,
          CASE WHEN role = 'user' THEN 300 ELSE 800 END AS lim FROM conversations),
    r AS (SELECT role, output > lim OR (role = 'user' AND NOT (prompt BETWEEN 64 AND 256)) AS token_bad,
            output > lim AS over, stop = 'outputTokenLimit' AND output <> lim AS contradiction FROM c)
    SELECT role, CASE WHEN over AND contradiction THEN 'token_evidence_invalid,contradictory_outcome_evidence'
        WHEN token_bad AND contradiction THEN 'contradictory_outcome_evidence,token_evidence_invalid'
        WHEN token_bad THEN 'token_evidence_invalid' WHEN contradiction THEN 'contradictory_outcome_evidence'
        ELSE '' END AS reasons, count(*) AS rows FROM r GROUP BY ALL
    """,
)
def token_limits(spark, sf):
    user = F.col("role") == "user"
    why = eligibility.token_limit_reasons(
        F.length("text"),
        F.col("turn") * 60,
        F.when(F.col("turn") % 2 == 0, "outputTokenLimit").otherwise("endOfSequence"),
        F.when(user, 300).otherwise(800),
        user,
    )
    turns = Tables(spark, sf).conversations.select("role", joined(why).alias("reasons"))
    return _count_by(turns, "role", "reasons")


@query(
    "timing_order",
    """
    WITH t AS (SELECT l_returnflag, l_partkey AS first, CASE WHEN l_tax > 0.02 THEN l_partkey + l_suppkey END AS rend,
          CAST(floor(l_extendedprice / 10) AS BIGINT) AS done, l_suppkey AS prompt, l_linenumber - 1 AS decode FROM lineitem)
    SELECT l_returnflag, CASE WHEN NOT (0 <= first AND first <= done)
          OR (rend IS NOT NULL AND NOT (0 <= rend AND rend <= done)) OR prompt <= 0 OR decode <= 0
        THEN 'invalid-monotonic-timing' ELSE '' END AS reasons,
      coalesce(rend >= first AND done >= rend, false) AS interaction_ordered, count(*) AS rows
    FROM t GROUP BY ALL
    """,
)
def timing_order(spark, sf):
    first, done = F.col("l_partkey"), F.floor(F.col("l_extendedprice") / 10)
    rend = F.when(F.col("l_tax") > 0.02, first + F.col("l_suppkey"))
    why = eligibility.timing_reasons(
        F.lit(0), first, rend, done, F.col("l_suppkey"), F.col("l_linenumber") - 1
    )
    lines = Tables(spark, sf).lineitem.select(
        "l_returnflag",
        joined(why).alias("reasons"),
        eligibility.interaction_order_ok(first, rend, done).alias("interaction_ordered"),
    )
    return _count_by(lines, "l_returnflag", "reasons", "interaction_ordered")


@query(
    "declarations_check",
    """
    SELECT p_partkey, p_size > 5 AND p_retailprice > 950 AND p_brand <> 'Brand#7' AND
             coalesce(nullif(p_size % 11, 0) > 2, false) AS declared,
           p_size % 2 = 0 AND p_size % 3 = 0 AS inventory_complete
    FROM part
    """,
)
def declarations_check(spark, sf):
    """All declarations true, and the exclusion inventory a superset of the required one."""
    size = F.col("p_size")
    declared = eligibility.all_declared(
        [
            size > 5,
            F.col("p_retailprice") > 950,
            F.col("p_brand") != "Brand#7",
            F.nullif(size % 11, F.lit(0)) > 2,
        ]
    )
    present = F.array_compact(
        F.array(
            F.when(size % 2 == 0, F.lit("serial-number")),
            F.when(size % 3 == 0, F.lit("udid")),
            F.lit("apple-id"),
        )
    )
    complete = eligibility.covers(present, ["apple-id", "serial-number", "udid"])
    return Tables(spark, sf).part.select(
        "p_partkey", declared.alias("declared"), complete.alias("inventory_complete")
    )


@query(
    "review_triggers",
    """
    SELECT c_mktsegment, concat_ws(',',
        CASE WHEN c_custkey % 6 = 0 THEN 'declared-conflict-of-interest' END,
        CASE WHEN c_nationkey % 4 <> 0 THEN 'thermal-assistance-not-none' END,
        CASE WHEN c_nationkey % 4 = 1 OR c_acctbal < 0 THEN 'unknown-environment-field' END) AS reasons,
      count(*) AS rows
    FROM customer GROUP BY ALL
    """,
)
def review_triggers(spark, sf):
    nation = F.col("c_nationkey") % 4
    assistance = F.when(nation == 0, "none").when(nation == 1, "unknown").when(nation == 2, "cooling")
    why = eligibility.review_triggers(
        F.when(F.col("c_custkey") % 6 == 0, "disclosed").otherwise("none"),
        assistance,
        [assistance, F.when(F.col("c_acctbal") < 0, "unknown").otherwise("nominal")],
    )
    rows = Tables(spark, sf).customer.select("c_mktsegment", joined(why).alias("reasons"))
    return _count_by(rows, "c_mktsegment", "reasons")


@query(
    "pilot_eligibility",
    """
    WITH r AS (SELECT l_orderkey, count(*) FILTER (l_linenumber > 1 AND l_returnflag <> 'R') AS runs,
          bool_or(l_returnflag = 'R' AND l_linenumber = 7) AS not_run, min(l_partkey) AS prompt,
          min(l_quantity) AS shortest, bool_and(l_tax < 0.08) AS session_ok,
          arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS thermal
        FROM lineitem GROUP BY ALL)
    SELECT concat_ws(',', CASE WHEN NOT session_ok THEN 'session_environment_ineligible' END,
        CASE WHEN thermal <> 'F' THEN 'initial_thermal_state_not_nominal' END,
        CASE WHEN runs < 3 THEN 'insufficient_successful_measured_runs' END,
        CASE WHEN not_run THEN 'planned_attempt_not_run' END,
        CASE WHEN NOT (prompt BETWEEN 64 AND 256) THEN 'prompt_token_count_outside_pilot_band' END) AS reasons,
      concat_ws(',', CASE WHEN l_orderkey % 9 = 0 THEN 'runner_source_identity_missing' END,
        CASE WHEN shortest < 4 THEN 'output_below_256_tokens_not_an_eligibility_gate' END) AS warnings,
      count(*) AS results
    FROM r GROUP BY ALL
    """,
)
def pilot_eligibility(spark, sf):
    """Gating reasons and non-gating warnings stay in two lists."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    runs = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(
        F.count_if((line > 1) & (flag != "R")).alias("runs"),
        F.bool_or((flag == "R") & (line == 7)).alias("not_run"),
        F.min("l_partkey").alias("prompt"),
        F.min("l_quantity").alias("shortest"),
        F.bool_and(F.col("l_tax") < 0.08).alias("session_ok"),
        F.min_by("l_linestatus", order).alias("start"),
    )
    gating, warnings = eligibility.pilot_reasons(
        F.col("session_ok"),
        F.when(F.col("start") == "F", "nominal").otherwise("fair"),
        F.col("runs") >= 3,
        F.col("not_run"),
        F.col("prompt").between(64, 256),
        F.col("l_orderkey") % 9 != 0,
        F.col("shortest") < 4,
    )
    return (
        runs.select(joined(gating).alias("reasons"), joined(warnings).alias("warnings"))
        .groupBy("reasons", "warnings")
        .agg(F.count("*").alias("results"))
    )


@query(
    "publication_gate",
    """
    WITH f AS (SELECT c_mktsegment, c_nationkey, bool_or(c_acctbal > 9000) AS a, bool_or(c_acctbal < 1000) AS b,
          bool_or(c_custkey % 5 = 0) AS c, bool_or(c_custkey % 7 = 0) AS d, count(*) AS n,
          bool_and(c_custkey > 20) AS declared, max(c_custkey) % 6 = 0 AS conflict
        FROM customer GROUP BY ALL),
    g AS (SELECT *, a::INT + b::INT + c::INT + d::INT AS n_on FROM f)
    SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS nation, n AS results, concat_ws(',',
        CASE WHEN n_on BETWEEN 1 AND 3 THEN 'publication-flags-must-activate-together' END,
        CASE WHEN n_on = 4 AND NOT declared THEN 'contributor-declarations-pending' END,
        CASE WHEN n_on = 4 AND conflict THEN 'unexpected-conflict-of-interest' END,
        CASE WHEN n_on = 4 AND n < 12 THEN 'asserted-count-mismatch' END) AS reasons
    FROM g
    """,
)
def publication_gate(spark, sf):
    key = F.col("c_custkey")
    releases = Tables(spark, sf).customer.groupBy("c_mktsegment", "c_nationkey").agg(
        F.bool_or(F.col("c_acctbal") > 9000).alias("a"),
        F.bool_or(F.col("c_acctbal") < 1000).alias("b"),
        F.bool_or(key % 5 == 0).alias("c"),
        F.bool_or(key % 7 == 0).alias("d"),
        F.count("*").alias("results"),
        F.bool_and(key > 20).alias("declared"),
        (F.max(key) % 6 == 0).alias("conflict"),
    )
    why = eligibility.publication_reasons(
        [F.col(c) for c in "abcd"],
        F.col("declared"),
        F.when(F.col("conflict"), "financial").otherwise("none"),
        F.col("results") >= 12,
    )
    return releases.select(
        "c_mktsegment", big("c_nationkey").alias("nation"), "results", joined(why).alias("reasons")
    )


@query(
    "registry_rows",
    """
    WITH m AS (SELECT p_partkey, sha1(p_name || p_partkey) AS rev, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS publisher,
          p_size * 100 AS parameters, p_size * 100 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS base,
          p_partkey % 8 = 0 AS unpinned FROM part)
    SELECT concat_ws(',', CASE WHEN publisher IS NULL THEN 'missing-fields' END,
        CASE WHEN unpinned THEN 'source-url-not-pinned' END,
        CASE WHEN parameters > 4000 THEN 'outside-cohort' END,
        CASE WHEN base <> parameters THEN 'base-parameter-mismatch' END) AS reasons, count(*) AS rows
    FROM m GROUP BY ALL
    """,
)
def registry_rows(spark, sf):
    """Model registry rows: required fields, pinned revision, cohort and base size."""
    parameters = F.col("p_size") * 100
    revision = F.sha1(F.concat(F.col("p_name"), F.col("p_partkey").cast("string")))
    url = F.when(F.col("p_partkey") % 8 == 0, F.lit("https://models.example/main")).otherwise(
        F.concat(F.lit("https://models.example/tree/"), revision)
    )
    publisher = F.when(F.col("p_size") % 10 != 0, F.col("p_brand"))
    base = parameters + F.when(F.col("p_partkey") % 13 == 0, 1).otherwise(0)
    why = eligibility.registry_row_reasons(
        [publisher, F.col("p_type"), revision], revision, url, parameters, base, 4000
    )
    return _count_by(Tables(spark, sf).part.select(joined(why).alias("reasons")), "reasons")


@query(
    "cohort_filter",
    """
    WITH m AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size END AS parameters,
                 p_size % 6 AS b FROM part)
    SELECT CASE WHEN b = 0 THEN 'unknown' WHEN b <= 1 THEN 'up-to-1b' WHEN b <= 2 THEN '1b-to-2b'
             WHEN b <= 4 THEN '2b-to-4b' ELSE 'over-4b' END AS size_bucket, count(*) AS models
    FROM m WHERE parameters <= 30 GROUP BY ALL
    """,
)
def cohort_filter(spark, sf):
    """Models inside the size limit (an unknown size is outside), by name bucket."""
    size = F.col("p_size")
    billions = size % 6
    name = F.when(billions == 0, F.concat(F.col("p_brand"), F.lit("-mini"))).otherwise(
        F.concat(F.col("p_brand"), F.lit("/family-"), billions.cast("string"), F.lit("B-4bit"))
    )
    return (
        Tables(spark, sf)
        .part.select(F.when(size % 9 != 0, size).alias("parameters"), name.alias("name"))
        .where(F.col("parameters") <= 30)
        .groupBy(eligibility.parameter_bucket(F.col("name")).alias("size_bucket"))
        .agg(F.count("*").alias("models"))
    )
