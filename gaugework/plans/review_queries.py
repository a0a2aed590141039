"""The review pipeline and stored reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.numbers import joined
from gaugework.operators.reports import verify_reports
from gaugework.plans.registry import Tables, query
from gaugework.plans.review_pipeline import judge_reviews

# Packages are customers, records orders, named supports the orders' line suppliers.
_PIPELINE = """
    WITH p AS (SELECT c_custkey AS sub, 'm' || c_custkey AS manifest, 'r' || (c_custkey // 2) AS result, c_custkey // 3 AS session,
          CASE WHEN c_custkey % 2 = 0 THEN 'User' ELSE 'user' END || (c_custkey % 37) AS who, c_nationkey % 3 AS same
        FROM customer WHERE c_custkey % 50 <> 9),
    r AS (SELECT o_orderkey AS id, o_custkey AS sub, (o_orderdate, o_orderkey) AS pos,
          CASE WHEN o_orderkey % 20 = 7 THEN 'M' WHEN o_orderkey % 4 <= 1 THEN 'I' WHEN o_orderkey % 4 = 2 THEN 'R' ELSE 'V' END AS kind,
          o_totalprice <= 60000 AS other_manifest, p.sub IS NULL AS missing
        FROM orders LEFT JOIN p ON p.sub = o_custkey),
    s AS (SELECT DISTINCT r.id, r.sub AS own, r.pos, l_suppkey AS sup, t.sub IS NULL AS unknown, l_suppkey = r.sub AS itself,
          t.sub IS NOT NULL AND (o.sub IS NULL OR t.same <> o.same) AS unlike,
          t.sub IS NOT NULL AND coalesce(lower(o.who), '') = lower(t.who) AS dependent,
          t.sub IS NOT NULL AND t.result IS NOT DISTINCT FROM o.result AS again,
          t.sub IS NOT NULL AND t.session IS NOT DISTINCT FROM o.session AS sitting
        FROM lineitem JOIN r ON l_orderkey = r.id LEFT JOIN p AS o ON o.sub = r.sub LEFT JOIN p AS t ON t.sub = l_suppkey
        WHERE r.kind = 'R'),
    sc AS (SELECT id, count(*) AS n, bool_and(NOT (unknown OR itself OR unlike OR dependent OR again OR sitting)) AS ok FROM s GROUP BY ALL),
    c AS (SELECT r.*, n, CASE WHEN kind = 'I' OR (kind = 'M' AND sub % 2 = 0) THEN 'unreviewed'
            WHEN kind = 'V' AND sub % 2 = 1 THEN 'reproduced' ELSE 'community-submitted' END AS prev,
          CASE kind WHEN 'I' THEN 'community-submitted' WHEN 'R' THEN 'reproduced' WHEN 'V' THEN 'verified'
            ELSE 'maintainer-reference' END AS lvl,
          NOT missing AND NOT other_manifest AND (kind = 'R') = (n IS NOT NULL) AND coalesce(ok, true) AS good
        FROM r LEFT JOIN sc USING (id)),
    t1 AS (SELECT sub, min(pos) AS pos1, arg_min(lvl, pos) AS l1 FROM c WHERE good AND prev = 'unreviewed' GROUP BY ALL),
    sa AS (SELECT s.id, bool_and(pos1 IS NOT NULL) AS every, max(pos1) AS latest FROM s LEFT JOIN t1 ON sup = t1.sub GROUP BY ALL),
    d AS (SELECT c.*, pos1, l1, every IS NULL OR (every AND latest < pos) AS supported FROM c LEFT JOIN t1 USING (sub) LEFT JOIN sa USING (id)),
    t2 AS (SELECT sub, min(pos) AS pos2, arg_min(lvl, pos) AS l2 FROM d WHERE good AND supported AND prev = 'community-submitted'
            AND l1 = 'community-submitted' AND pos > pos1 GROUP BY ALL),
    e AS (SELECT d.*, pos2, l2 FROM d LEFT JOIN t2 USING (sub)),
    t3 AS (SELECT sub, min(pos) AS pos3, arg_min(lvl, pos) AS l3 FROM e WHERE good AND prev = 'reproduced' AND l2 = 'reproduced'
            AND pos > pos2 GROUP BY ALL),
    steps AS (SELECT sub, pos1, l1, pos2, l2, pos3, l3 FROM t1 LEFT JOIN t2 USING (sub) LEFT JOIN t3 USING (sub)),
    f AS (SELECT c.*, pos1, pos2, pos3, l1, l2, l3, CASE WHEN pos > pos3 THEN l3 WHEN pos > pos2 THEN l2 WHEN pos > pos1 THEN l1 ELSE 'unreviewed' END AS found,
            good AND coalesce(pos = pos1 OR pos = pos2 OR pos = pos3, pos = pos1 OR pos = pos2, pos = pos1, false) AS valid
          FROM c LEFT JOIN steps USING (sub)),
    h AS (SELECT s.*, CASE WHEN pos > pos3 THEN l3 WHEN pos > pos2 THEN l2 WHEN pos > pos1 THEN l1 ELSE 'unreviewed' END AS state
          FROM s LEFT JOIN steps ON sup = steps.sub)
"""


def _judged(spark, sf):
    t = Tables(spark, sf)
    key, sub = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    kind = (
        F.when(key % 20 == 7, "maintainer-reference-review")
        .when(key % 4 <= 1, "initial-review")
        .when(key % 4 == 2, "reproduction-review")
        .otherwise("verification-review")
    )
    number = F.col("c_custkey")
    packages = t.customer.select(
        number.alias("submission_id"),
        (number % 50 != 9).alias("valid"),
        text("m", number).alias("manifest_sha256"),
        text("d", number).alias("result_sha256"),
        text("r", F.floor(number / 2)).alias("result_id"),
        text("s", F.floor(number / 3)).alias("session_id"),
        F.concat(F.when(number % 2 == 0, "User").otherwise("user"), (number % 37).cast("string")).alias("contributor"),
        (F.col("c_nationkey") % 3).cast("string").alias("identity"),
    )
    named = t.lineitem.where("l_orderkey % 4 = 2 AND l_orderkey % 20 <> 7").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"
    )
    supports = named.groupBy("o_orderkey").agg(F.collect_set("l_suppkey").alias("supporting_ids"))
    k, odd = F.col("review_type"), sub % 2 == 1
    records = t.orders.join(supports, "o_orderkey", "left").withColumn("review_type", kind)
    records = records.select(
        key.alias("name"),
        key.alias("review_id"),
        F.lit(True).alias("name_matches"),
        sub.alias("submission_id"),
        F.col("o_orderdate").alias("reviewed_at"),
        "review_type",
        F.when((k == "initial-review") | ((k == "maintainer-reference-review") & ~odd), "unreviewed")
        .when((k == "verification-review") & odd, "reproduced")
        .otherwise("community-submitted")
        .alias("previous_level"),
        F.when(k == "initial-review", "community-submitted")
        .when(k == "reproduction-review", "reproduced")
        .when(k == "verification-review", "verified")
        .otherwise("maintainer-reference")
        .alias("assigned_level"),
        F.when(F.col("o_totalprice") > 60000, text("m", sub)).otherwise("other").alias("manifest_sha256"),
        text("r", F.floor(sub / 2)).alias("result_id"),
        text("d", sub).alias("result_sha256"),
        F.coalesce("supporting_ids", F.array().cast("array<bigint>")).alias("supporting_ids"),
    )
    return judge_reviews(records, packages)


@query(
    "review_pipeline",
    _PIPELINE
    + """
    SELECT f.id AS review_id, f.sub AS submission_id, valid, found AS level_before, concat_ws(',',
        CASE WHEN missing THEN 'package-missing-or-invalid' END, CASE WHEN NOT missing AND other_manifest THEN 'manifest-digest-mismatch' END,
        CASE WHEN prev <> found THEN 'previous-level-mismatch' END,
        CASE WHEN kind = 'M' AND prev = 'reproduced' THEN 'transition-not-allowed' END,
        CASE WHEN kind = 'R' AND n IS NULL THEN 'supporting-submissions-required' END, nullif(w.why, '')) AS errors
    FROM f LEFT JOIN (SELECT id, concat_ws(',', CASE WHEN bool_or(itself) THEN 'support-is-itself' END,
          CASE WHEN bool_or(unknown) THEN 'support-missing' END, CASE WHEN bool_or(state = 'unreviewed') THEN 'support-not-accepted' END,
          CASE WHEN bool_or(unlike) THEN 'support-not-comparison-compatible' END,
          CASE WHEN bool_or(dependent) THEN 'support-not-contributor-independent' END,
          CASE WHEN bool_or(again) THEN 'support-reuses-result' END, CASE WHEN bool_or(sitting) THEN 'support-reuses-session' END) AS why
        FROM h GROUP BY ALL) w USING (id)
    """,
)
def review_pipeline(spark, sf):
    """Every review with all it is rejected for, given the packages and the history before it."""
    verdicts, _, _ = _judged(spark, sf)
    errors = F.filter("errors", lambda e: e != "")
    return verdicts.select("review_id", "submission_id", "valid", "level_before", joined(errors).alias("errors"))


@query(
    "support_states",
    _PIPELINE + "SELECT id AS review_id, sup AS supporting_id, state AS level_at_review FROM h",
)
def support_states(spark, sf):
    """The level that every named support had just before the review that names it."""
    _, held, _ = _judged(spark, sf)
    return held.select(F.col("name").alias("review_id"), "supporting_id", "level_at_review")


@query(
    "package_levels",
    _PIPELINE
    + """
    SELECT p.sub AS submission_id, coalesce(l3, l2, l1, 'unreviewed') AS evidence_level FROM p LEFT JOIN steps USING (sub)
    """,
)
def package_levels(spark, sf):
    """The evidence level of every valid package after all reviews."""
    _, _, levels = _judged(spark, sf)
    return levels.select("submission_id", "evidence_level")


# ---- stored reports ---------------------------------------------------------

_REPORTS = """
    WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity::BIGINT AS q, l_returnflag <> 'R' AS ok,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_partkey, l_suppkey) - 1 AS pos,
          count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    d AS (SELECT k, sha256('{"resultID":"r-' || k || '","schemaVersion":"1.1.0","attempts":[' || string_agg('{"index":' || i || ',"quantity":' || q
          || ',"outcome":"' || CASE WHEN ok THEN 'completed' ELSE 'failed' END || '"}', ',' ORDER BY pos) || ']}') AS sha FROM l GROUP BY k),
    b AS (SELECT 'right' AS side, * FROM l UNION ALL
          SELECT 'stored', l.* FROM l JOIN orders ON o_orderkey = k WHERE NOT (o_orderstatus = 'O' AND pos = n - 1)),
    o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, sha, side FROM orders JOIN d ON d.k = o_orderkey, (SELECT unnest(['right', 'stored']) AS side)),
    g AS (SELECT o.*, count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS bad, median(q) FILTER (ok) AS mid
          FROM o LEFT JOIN b ON b.k = o.k AND b.side = o.side GROUP BY ALL),
    v AS (SELECT side, k, '$.result.id' AS path, CASE WHEN side = 'stored' AND p LIKE '2%' THEN '"r-x"' ELSE '"r-' || k || '"' END AS value FROM g
          UNION ALL SELECT side, k, '$.result.sha256', CASE WHEN side = 'stored' AND p LIKE '1%' THEN '"0"' ELSE '"' || sha || '"' END FROM g
          UNION ALL SELECT side, k, '$.terminalCounts.completed', done::VARCHAR FROM g
          UNION ALL SELECT side, k, '$.terminalCounts.failed', bad::VARCHAR FROM g
          UNION ALL SELECT side, k, '$.metrics.medianQuantity', coalesce((mid * 2)::BIGINT::VARCHAR, 'null') FROM g
          UNION ALL SELECT side, k, '$.attempts[' || pos || '].eligible', ok::VARCHAR FROM b
          UNION ALL SELECT side, k, '$.attempts[' || pos || '].index', i::VARCHAR FROM b
          UNION ALL SELECT side, k, '$.attempts', '[]' FROM g WHERE done + bad = 0),
    x AS (SELECT coalesce(a.k, c.k) AS k, coalesce(a.path, c.path) AS path, CASE WHEN c.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected'
            ELSE 'changed' END AS problem
          FROM (FROM v WHERE side = 'right') a FULL JOIN (FROM v WHERE side = 'stored') c ON a.k = c.k AND a.path = c.path
          WHERE a.value IS DISTINCT FROM c.value)
"""


def _checked_reports(spark, sf):
    """A result document per order, its report as it is now and as it was stored.

    Open orders got their last line after the report was stored; a few stored
    reports name another result or other bytes, and counts of finished orders
    are written as decimals, which says the same.
    """
    t = Tables(spark, sf)
    line = F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_partkey", "l_suppkey")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    outcome = lambda x: F.when(x["l_returnflag"] != "R", "completed").otherwise("failed")
    entry = lambda x: F.format_string(
        '{"index":%d,"quantity":%d,"outcome":"%s"}', x["l_linenumber"], x["q"], outcome(x)
    )
    content = F.concat(
        F.lit('{"resultID":"r-'), F.col("o_orderkey").cast("string"), F.lit('","schemaVersion":"1.1.0","attempts":['),
        F.array_join(F.transform("lines", entry), ","), F.lit("]}"),
    )
    rows = t.orders.join(lines, "o_orderkey").withColumn("content", content)
    attempts = F.from_json(F.get_json_object("content", "$.attempts"), "array<struct<index:bigint,quantity:bigint,outcome:string>>")
    rows = rows.withColumn("attempts", attempts)
    late = F.col("o_orderstatus") == "O"
    known = F.when(late, F.slice("attempts", 1, F.size("attempts") - 1)).otherwise(F.col("attempts"))
    # What both reports name several times is worked out once, in projections of its own.
    rows = rows.withColumns(
        {"known": known, "own": F.get_json_object("content", "$.resultID"), "digest": F.sha2("content", 256)}
    )
    rows = rows.withColumns({"all_done": _done(F.col("attempts")), "known_done": _done(F.col("known"))})
    priority, own, digest = F.col("o_orderpriority"), F.col("own"), F.col("digest")
    other_id = F.when(priority.startswith("2"), F.lit("r-x")).otherwise(own)
    other_sha = F.when(priority.startswith("1"), F.lit("0")).otherwise(digest)
    decimal = F.col("o_orderstatus") == "F"
    pairs = rows.select(
        "o_orderkey",
        "content",
        _report(F.col("attempts"), F.col("all_done"), own, digest, F.lit(False)).alias("recomputed"),
        _report(F.col("known"), F.col("known_done"), other_id, other_sha, decimal).alias("report"),
    )
    return verify_reports(pairs, ["o_orderkey"])


def _done(attempts):
    """Quantities of the completed attempts in ascending order."""
    done = F.filter(attempts, lambda a: a["outcome"] == "completed")
    return F.array_sort(F.transform(done, lambda a: a["quantity"]))


def _report(attempts, sizes, result_id, digest, decimal):
    """Report text of a result's attempts: counts, twice the median of completed quantities, eligibility."""
    n = F.size(sizes)
    middle = F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))
    completed = F.concat(n.cast("string"), F.when(decimal, ".0").otherwise(""))
    body = F.struct(
        F.struct(result_id.alias("id"), digest.alias("sha256"), F.lit("1.1.0").alias("schemaVersion")).alias("result"),
        F.struct((F.size(attempts) - n).alias("failed")).alias("terminalCounts"),
        F.struct(F.when(n > 0, middle).alias("medianQuantity")).alias("metrics"),
        F.transform(attempts, lambda a: F.struct(a["index"], (a["outcome"] == "completed").alias("eligible"))).alias("attempts"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    return F.replace(text, F.lit('"terminalCounts":{'), F.concat(F.lit('"terminalCounts":{"completed":'), completed, F.lit(",")))


@query(
    "report_verdicts",
    _REPORTS
    + """
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority LIKE '1%' THEN 'report-does-not-bind-result' END,
        CASE WHEN o_orderpriority LIKE '2%' THEN 'result-id-mismatch' END,
        CASE WHEN w.k IS NOT NULL THEN 'report-stale' END) AS errors, coalesce(differing, 0) AS differing
    FROM orders JOIN d ON d.k = o_orderkey LEFT JOIN (SELECT k, count(*) AS differing FROM x GROUP BY k) w ON w.k = o_orderkey
    """,
)
def report_verdicts(spark, sf):
    """Whether stored reports bind their result and equal their recomputation."""
    verdicts, _ = _checked_reports(spark, sf)
    return verdicts.select("o_orderkey", joined(F.col("errors")).alias("errors"), "differing")


@query("report_differences", _REPORTS + "SELECT k AS o_orderkey, path, problem FROM x")
def report_differences(spark, sf):
    """The paths in which a stored report differs from its recomputation."""
    _, differences = _checked_reports(spark, sf)
    return differences.select("o_orderkey", "path", "problem")
