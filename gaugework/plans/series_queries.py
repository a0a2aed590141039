"""Event-series measures and order checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.text import is_renderable
from gaugework.operators import series
from gaugework.operators.ordered import number_rows
from gaugework.plans.registry import Tables, big, micros, query, r6


def _user_events(spark, sf):
    return Tables(spark, sf).events.select(
        "user_id", "event_id", "event_type", "value", micros("ts").alias("at_us")
    )


@query(
    "token_intervals",
    """
    WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER
                 (PARTITION BY user_id ORDER BY event_id)) / 1000.0 AS gap FROM events)
    SELECT user_id, count(*) AS intervals, round(quantile_cont(gap, 0.5), 6) AS p50,
           round(quantile_cont(gap, 0.95), 6) AS p95, round(quantile_cont(gap, 0.99), 6) AS p99
    FROM g WHERE gap IS NOT NULL GROUP BY ALL
    """,
)
def token_intervals(spark, sf):
    events = _user_events(spark, sf).select("user_id", "event_id", "at_us")
    out = series.interval_percentiles(events, ["user_id"], [F.col("event_id")], "at_us", 1000.0)
    return out.select("user_id", "intervals", *[r6(p).alias(p) for p in ("p50", "p95", "p99")])


@query(
    "series_rates",
    """
    WITH s AS (SELECT user_id, count(*) AS events, arg_min(epoch_us(ts), event_id) AS f,
                      arg_max(epoch_us(ts), event_id) AS l FROM events GROUP BY ALL)
    SELECT user_id, events, round((f - 1704067200000000) / 1000.0, 6) AS first_ms,
           round((l - 1704067200000000) / 1000.0, 6) AS completion_ms,
           CASE WHEN events >= 2 AND l > f
                THEN round((events - 1) * 1000000.0 / (l - f), 9) END AS event_rate
    FROM s
    """,
)
def series_rates(spark, sf):
    """First-event time, completion time and event rate per attempt."""
    origin = 1704067200000000  # all series start their clock at 2024-01-01
    out = series.series_summary(_user_events(spark, sf), ["user_id"], "event_id", "at_us", 1e6)
    ms = lambda c: r6((F.col(c) - origin) / 1000.0)
    return out.select(
        "user_id",
        "events",
        ms("first_time").alias("first_ms"),
        ms("last_time").alias("completion_ms"),
        F.round("event_rate", 9).alias("event_rate"),
    )


@query(
    "renderable_time",
    """
    WITH t AS (SELECT conv_id, turn, role <> 'system' AND
                 regexp_matches(text, '[^\\x{09}-\\x{0D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]')
                 AS renderable FROM conversations)
    SELECT conv_id, min(CASE WHEN renderable THEN turn END) AS first_renderable,
           count(*) FILTER (renderable) AS renderable_events
    FROM t GROUP BY ALL
    """,
)
def renderable_time(spark, sf):
    turns = Tables(spark, sf).conversations.select("conv_id", "turn", "role", "text")
    shown = (F.col("role") != "system") & is_renderable(F.col("text"))
    return series.first_renderable(turns, ["conv_id"], shown, "turn")


@query(
    "peak_memory",
    """
    SELECT user_id, count(*) AS samples,
           CASE WHEN bool_and(NOT (event_type = 'error' AND value > 60))
                THEN round(max(value * 1000000) / 1048576.0, 6) END AS peak_mib
    FROM events GROUP BY ALL
    """,
)
def peak_memory(spark, sf):
    events = Tables(spark, sf).events.select("user_id", "event_type", "value")
    valid = ~((F.col("event_type") == "error") & (F.col("value") > 60))
    out = series.peak_memory(events, ["user_id"], F.col("value") * 1000000, valid)
    return out.withColumn("peak_mib", r6("peak_mib"))


@query(
    "monotonic_check",
    """
    WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t, value,
                 lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS pt,
                 lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS pv FROM events)
    SELECT user_id, bool_and(pt IS NULL OR t >= pt) AS times_non_decreasing,
           bool_and(pt IS NULL OR t > pt) AS times_strict,
           bool_and(pv IS NULL OR value >= pv) AS values_non_decreasing
    FROM p GROUP BY ALL
    """,
)
def monotonic_check(spark, sf):
    events = _user_events(spark, sf)
    order = [F.col("event_id")]
    times = series.time_order(events, ["user_id"], order, "at_us")
    values = series.time_order(events, ["user_id"], order, "value")
    return times.select(
        "user_id",
        F.col("non_decreasing").alias("times_non_decreasing"),
        F.col("strictly_increasing").alias("times_strict"),
    ).join(
        values.select("user_id", F.col("non_decreasing").alias("values_non_decreasing")), "user_id"
    )


@query(
    "index_contiguity",
    """
    SELECT l_orderkey, count(*) AS entries, min(l_linenumber) = 1 AND max(l_linenumber) = count(*)
           AND count(DISTINCT l_linenumber) = count(*) AS contiguous
    FROM lineitem GROUP BY ALL
    """,
)
def index_contiguity(spark, sf):
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber")
    return series.index_contiguity(lines, ["l_orderkey"], "l_linenumber", 1)


@query(
    "cascade",
    """
    WITH r AS (SELECT user_id, event_type, coalesce(bool_or(event_type = 'error' AND value > 30) OVER
                 (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS stopped
               FROM events)
    SELECT user_id, count(*) FILTER (stopped) AS stopped_rows,
           count(*) FILTER (stopped AND event_type <> 'error') AS contradictions
    FROM r GROUP BY ALL
    """,
)
def cascade(spark, sf):
    """Rows from the first critical one on that are not marked as stopped."""
    events = _user_events(spark, sf).select(
        "user_id",
        "event_id",
        "event_type",
        ((F.col("event_type") == "error") & (F.col("value") > 30)).alias("critical"),
    )
    marked = series.critical_stop(events, ["user_id"], [F.col("event_id")], "critical")
    return marked.groupBy("user_id").agg(
        F.count_if("stopped").alias("stopped_rows"),
        F.count_if(F.col("stopped") & (F.col("event_type") != "error")).alias("contradictions"),
    )


@query(
    "attempt_sequence",
    """
    SELECT l_orderkey, count(*) AS attempts,
           bool_and(CASE WHEN l_linenumber = 1 THEN l_returnflag <> 'R' ELSE l_returnflag <> 'A' END)
             AS roles_valid,
           count(*) = 6 AND count(DISTINCT l_linenumber) = 6 AND min(l_linenumber) = 1
             AND max(l_linenumber) = 6 AS count_valid
    FROM lineitem GROUP BY ALL
    """,
)
def attempt_sequence(spark, sf):
    lines = Tables(spark, sf).lineitem.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("idx"), "l_returnflag"
    )
    warmup = F.when(F.col("idx") == 0, F.col("l_returnflag") != "R").otherwise(
        F.col("l_returnflag") == "A"
    )
    return series.attempt_sequence(
        lines, ["l_orderkey"], "idx", warmup, rules.WARMUP_ATTEMPTS + rules.MEASURED_ATTEMPTS
    )


@query(
    "last_state",
    """
    SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('error', 'purchase')),
                             arg_min(event_type, event_id)) AS end_state
    FROM events GROUP BY ALL
    """,
)
def last_state(spark, sf):
    events = Tables(spark, sf).events.select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    transition = F.when(kind.isin("error", "purchase"), kind)
    return series.last_state(events, ["user_id"], ["event_id"], transition, kind)


@query(
    "probe_stop",
    """
    WITH r AS (SELECT user_id, event_type IN ('view', 'click') AS inspected,
                      event_type = 'signup' AS partial,
                      coalesce(bool_or(event_type = 'click' AND value > 40) OVER
                        (PARTITION BY user_id ORDER BY event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS found
               FROM events)
    SELECT user_id, count(*) FILTER (inspected) AS probes,
           count(*) FILTER (inspected AND found) AS probes_after_found,
           count(*) FILTER (partial) AS partial_probes,
           count(*) FILTER (inspected) > 32 AS over_limit
    FROM r GROUP BY ALL
    """,
)
def probe_stop(spark, sf):
    kind = F.col("event_type")
    events = Tables(spark, sf).events.select(
        "user_id",
        "event_id",
        kind.isin("view", "click").alias("inspected"),
        (kind == "signup").alias("partial"),
        ((kind == "click") & (F.col("value") > 40)).alias("renderable"),
    )
    return series.probe_rules(
        events, ["user_id"], [F.col("event_id")], rules.MAXIMUM_PROBE_EVENTS
    )


@query(
    "trace_match",
    """
    WITH tok AS (SELECT user_id AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1
                   AS idx, event_type AS token, epoch_us(ts) AS elapsed FROM events),
    tr AS (SELECT conv_id AS attempt, turn AS idx,
             CASE WHEN role = 'user' THEN 'view' ELSE 'click' END AS trace_token,
             length(text) * 10000000000 AS received FROM conversations),
    j AS (SELECT CASE WHEN token IS NULL THEN 'no-matching-token'
                 WHEN trace_token <> token THEN 'token-identity-mismatch'
                 WHEN abs(received - (elapsed - 1704067200000000)) > 5000000000000
                 THEN 'clock-relation-invalid' ELSE 'valid' END AS reason
          FROM tr LEFT JOIN tok USING (attempt, idx))
    SELECT reason, count(*) AS entries FROM j GROUP BY ALL
    """,
)
def trace_match(spark, sf):
    t = Tables(spark, sf)
    numbered = number_rows(
        _user_events(spark, sf), ["user_id"], [F.col("event_id")], "_position"
    )
    tokens = numbered.select(
        F.col("user_id").alias("attempt"),
        (big("_position") - 1).alias("idx"),
        F.col("event_type").alias("token"),
        F.col("at_us").alias("elapsed"),
    )
    trace = t.conversations.select(
        F.col("conv_id").alias("attempt"),
        F.col("turn").alias("idx"),
        F.when(F.col("role") == "user", "view").otherwise("click").alias("trace_token"),
        (F.length("text") * F.lit(10000000000)).alias("received"),
        F.lit(-1704067200000000).alias("origin"),
    )
    matched = series.trace_against_tokens(trace, tokens, ["attempt"], "idx", 5000000000000)
    return matched.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count("*").alias("entries")
    )
