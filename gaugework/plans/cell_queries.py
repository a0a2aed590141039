"""Cells, contributor weighting, variation, display selection and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.identity import minor_family, version_numbers
from gaugework.operators import cells
from gaugework.operators.ordered import first_rows, number_rows
from gaugework.plans.registry import Tables, big, query, r6


@query(
    "weighted_rank",
    """
    WITH per AS (SELECT event_type, user_id, median(value) AS v, count(value) AS n
                 FROM events GROUP BY ALL),
    cell AS (SELECT event_type, median(v) AS value, count(*) AS contributors,
                    CAST(sum(n) AS BIGINT) AS runs FROM per GROUP BY ALL)
    SELECT event_type AS cell_id, round(value, 6) AS value, contributors, runs,
           CASE WHEN contributors >= 3 THEN 'contributor-weighted'
                WHEN contributors >= 2 THEN 'reproduced' ELSE 'accepted' END AS evidence_state,
           row_number() OVER (ORDER BY value, event_type) AS rank
    FROM cell
    """,
)
def weighted_rank(spark, sf):
    """Which cell is fastest when every contributor counts once."""
    runs = Tables(spark, sf).events.select(
        F.col("event_type").alias("cell_id"), F.col("user_id").alias("contributor"), "value"
    )
    medians = cells.contributor_medians(runs, ["cell_id"], "contributor", "value")
    weighted = cells.weighted_cells(medians, ["cell_id"])
    ranked = cells.rank_cells(weighted, [], "value", False, ["cell_id"])
    return ranked.select(
        "cell_id",
        r6("value").alias("value"),
        "contributors",
        "runs",
        cells.evidence_state(F.col("contributors")).alias("evidence_state"),
        big("rank").alias("rank"),
    )


@query(
    "view_ranks",
    """
    WITH per AS (SELECT p_brand, p_type, l_suppkey, median(l_extendedprice * (1 - l_discount)) AS v,
                        count(*) AS n
                 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    cell AS (SELECT p_brand, p_type, median(v) AS value, count(*) AS contributors,
                    CAST(sum(n) AS BIGINT) AS runs FROM per GROUP BY ALL)
    SELECT p_type AS view_id, p_brand AS cell_id, round(value, 6) AS value, contributors, runs,
           row_number() OVER (PARTITION BY p_type ORDER BY round(value, 6) DESC, p_brand) AS rank
    FROM cell
    """,
)
def view_ranks(spark, sf):
    """Ranked table per view, higher is better."""
    t = Tables(spark, sf)
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("view_id"),
        F.col("p_brand").alias("cell_id"),
        F.col("l_suppkey").alias("contributor"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
    )
    cell = ["view_id", "cell_id"]
    medians = cells.contributor_medians(runs, cell, "contributor", "net_price")
    weighted = cells.weighted_cells(medians, cell).withColumn("value", r6("value"))
    return cells.rank_cells(weighted, ["view_id"], "value", True, ["cell_id"]).withColumn(
        "rank", big("rank")
    )


@query(
    "relative_mad",
    """
    WITH per AS (SELECT event_type, user_id, median(value) AS v FROM events GROUP BY ALL),
    centre AS (SELECT event_type, median(v) AS c, count(*) AS n, bool_and(v = 0) AS z
               FROM per GROUP BY ALL),
    mad AS (SELECT event_type, median(abs(v - c)) AS m, any_value(c) AS c, any_value(n) AS n,
                   any_value(z) AS z FROM per JOIN centre USING (event_type) GROUP BY ALL),
    pct AS (SELECT event_type, n, CASE WHEN n < 2 THEN NULL WHEN c = 0 AND z THEN 0.0
                   WHEN c = 0 THEN NULL ELSE m / abs(c) * 100 END AS p FROM mad)
    SELECT event_type, n AS contributors, round(p, 6) AS variation_percent,
           coalesce(p > 10, false) AS high_variation FROM pct
    """,
)
def relative_mad(spark, sf):
    runs = Tables(spark, sf).events.select("event_type", "user_id", "value")
    medians = cells.contributor_medians(runs, ["event_type"], "user_id", "value")
    return cells.relative_variation(medians, ["event_type"], "user_id").withColumn(
        "variation_percent", r6("variation_percent")
    )


@query(
    "contributor_states",
    """
    WITH cell AS (
      SELECT p_brand, p_type, p_size,
             count(DISTINCT l_suppkey) AS contributors,
             count(DISTINCT CASE WHEN l_returnflag <> 'R' AND l_discount <= 0.02
                   THEN l_suppkey END) AS eligible_contributors,
             count(*) AS runs,
             count(*) FILTER (l_returnflag <> 'R' AND l_discount <= 0.02) AS eligible_runs
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, contributors,
           eligible_contributors, runs, eligible_runs,
           CASE WHEN eligible_contributors >= 2 THEN 'reproduced'
                ELSE 'single-contributor' END AS status,
           CASE WHEN eligible_contributors >= 3 THEN 'community-aggregate'
                ELSE 'provisional' END AS aggregate_status,
           greatest(0, 2 - eligible_contributors) AS still_needed
    FROM cell
    """,
)
def contributor_states(spark, sf):
    """Counts use all runs, the two status fields only eligible contributors."""
    t = Tables(spark, sf)
    eligible = (F.col("l_returnflag") != "R") & (F.col("l_discount") <= 0.02)
    n = F.col("eligible_contributors")
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "p_type", big("p_size").alias("p_size"))
        .agg(
            F.countDistinct("l_suppkey").alias("contributors"),
            F.countDistinct(F.when(eligible, F.col("l_suppkey"))).alias("eligible_contributors"),
            F.count("*").alias("runs"),
            F.count_if(eligible).alias("eligible_runs"),
        )
        .withColumn("status", cells.community_status(n))
        .withColumn("aggregate_status", cells.aggregate_status(n))
        .withColumn("still_needed", big(cells.still_needed(n)))
    )


@query(
    "coverage_need",
    """
    WITH cell AS (SELECT o_orderpriority, c_mktsegment, o_orderstatus,
                         count(DISTINCT CASE WHEN o_totalprice > 490000 THEN o_custkey END) AS eligible,
                         count(*) AS runs
                  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT o_orderpriority, c_mktsegment, o_orderstatus, eligible, runs,
           CASE WHEN eligible >= 2 THEN 'Reproduced'
                ELSE 'Needs ' || (2 - eligible) || ' more' END AS coverage
    FROM cell
    """,
)
def coverage_need(spark, sf):
    t = Tables(spark, sf)
    need = cells.still_needed(F.col("eligible"))
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_orderpriority", "c_mktsegment", "o_orderstatus")
        .agg(
            F.countDistinct(
                F.when(F.col("o_totalprice") > 490000, F.col("o_custkey"))
            ).alias("eligible"),
            F.count("*").alias("runs"),
        )
        .withColumn(
            "coverage",
            F.when(need == 0, "Reproduced").otherwise(
                F.concat(F.lit("Needs "), need.cast("string"), F.lit(" more"))
            ),
        )
    )


@query(
    "field_summary",
    """
    WITH long AS (
      SELECT l_returnflag, l_suppkey, 'l_quantity' AS field,
             CASE WHEN l_tax < 0.05 THEN l_quantity END AS v FROM lineitem
      UNION ALL SELECT l_returnflag, l_suppkey, 'l_extendedprice',
             CASE WHEN l_discount >= 0.05 THEN l_extendedprice END FROM lineitem
      UNION ALL SELECT l_returnflag, l_suppkey, 'l_discount', l_discount FROM lineitem),
    per AS (SELECT l_returnflag, field, l_suppkey, median(v) AS m, count(v) AS n
            FROM long GROUP BY ALL)
    SELECT l_returnflag, field, round(median(m), 6) AS value, count(m) AS contributors,
           CAST(sum(n) AS BIGINT) AS runs FROM per GROUP BY ALL
    """,
)
def field_summary(spark, sf):
    """Seven-field summary rule: every field over its own eligible runs."""
    runs = Tables(spark, sf).lineitem.select(
        "l_returnflag",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_tax") < 0.05).alias("quantity_ok"),
        (F.col("l_discount") >= 0.05).alias("price_ok"),
    )
    fields = {"l_quantity": "quantity_ok", "l_extendedprice": "price_ok", "l_discount": None}
    summary = cells.field_summary(runs, ["l_returnflag"], "l_suppkey", fields)
    return summary.withColumn("value", r6("value"))


@query(
    "worst_state",
    """
    SELECT o_custkey, arg_max(o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0
        WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END)
        AS worst_state
    FROM orders GROUP BY ALL
    """,
)
def worst_state(spark, sf):
    order = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
    orders = Tables(spark, sf).orders.select("o_custkey", "o_orderpriority")
    return cells.worst_state(orders, ["o_custkey"], "o_orderpriority", order)


@query(
    "representative_row",
    """
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
           arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
           round(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 6) AS o_totalprice
    FROM orders GROUP BY ALL
    """,
)
def representative_row(spark, sf):
    orders = Tables(spark, sf).orders.select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"
    )
    first = first_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.drop("o_orderdate").withColumn("o_totalprice", r6("o_totalprice"))


@query(
    "contributor_names",
    """
    WITH raw AS (SELECT l_returnflag AS cell, l_shipdate, l_orderkey, l_linenumber, l_partkey,
                        l_quantity, l_extendedprice,
                        CASE WHEN l_linenumber % 2 = 0 THEN upper(s_name) ELSE s_name END AS spelled
                 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    first AS (SELECT cell, lower(spelled) AS contributor_key,
                     arg_min(spelled, (l_shipdate, l_orderkey, l_linenumber, l_partkey,
                                       l_quantity, l_extendedprice)) AS contributor
              FROM raw GROUP BY ALL)
    SELECT cell, contributor_key, contributor,
           row_number() OVER (PARTITION BY cell ORDER BY contributor_key) AS position FROM first
    """,
)
def contributor_names(spark, sf):
    """First spelling per contributor of a cell, in folded-name order."""
    t = Tables(spark, sf)
    runs = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_returnflag").alias("cell"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") % 2 == 0, F.upper("s_name"))
        .otherwise(F.col("s_name"))
        .alias("spelled"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return cells.first_spellings(runs, ["cell"], "spelled", order).withColumn(
        "position", big("position")
    )


@query(
    "evidence_listing",
    """
    SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS eligible,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position
    FROM orders
    """,
)
def evidence_listing(spark, sf):
    """Evidence of every cell in (created, path) order, one row per item."""
    orders = Tables(spark, sf).orders.select(
        "o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("eligible")
    )
    listed = number_rows(
        orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "position"
    )
    return listed.select("o_custkey", "o_orderkey", "eligible", big("position").alias("position"))


_VERSIONED = """
    WITH v AS (SELECT *, (p_size // 10) || '.' || (p_size % 10) || '.' || (p_partkey % 12) AS version
               FROM part),
    f AS (SELECT *, (p_size // 10) || '.' || (p_size % 10) AS family,
                 row_number() OVER (PARTITION BY p_brand, (p_size // 10) || '.' || (p_size % 10)
                   ORDER BY p_size // 10 DESC, p_size % 10 DESC, p_partkey % 12 DESC,
                            p_retailprice DESC, p_partkey DESC) AS rn FROM v)
"""


def _newest_parts(spark, sf):
    part = Tables(spark, sf).part.select(
        "p_partkey",
        "p_brand",
        "p_type",
        "p_retailprice",
        F.concat_ws(
            ".",
            F.floor(F.col("p_size") / 10).cast("string"),
            (F.col("p_size") % 10).cast("string"),
            (F.col("p_partkey") % 12).cast("string"),
        ).alias("version"),
    )
    cells_ = part.withColumn("family", minor_family(F.col("version")))
    newest = [version_numbers(F.col("version")), "p_retailprice", "p_partkey"]
    return cells.current_display(cells_, ["p_brand", "family"], newest)


@query(
    "display_select",
    _VERSIONED + "SELECT p_brand, family, version, p_partkey, p_type FROM f WHERE rn = 1",
)
def display_select(spark, sf):
    """Newest member of each display family; 10 is newer than 9."""
    return _newest_parts(spark, sf).select("p_brand", "family", "version", "p_partkey", "p_type")


@query(
    "display_ranks",
    _VERSIONED
    + """
    SELECT p_brand, family, p_partkey,
           row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank
    FROM f WHERE rn = 1 AND p_type <> 'SMALL'
    """,
)
def display_ranks(spark, sf):
    """Selection happens first, so an unranked newer cell hides an older ranked one."""
    shown = _newest_parts(spark, sf).where(F.col("p_type") != "SMALL")
    ranked = cells.rank_cells(shown, ["p_brand"], "p_retailprice", False, ["p_partkey"])
    return ranked.select("p_brand", "family", "p_partkey", big("rank").alias("rank"))
