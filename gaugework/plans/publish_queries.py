"""Reviews, score records, schema checks and published tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.identity import engine_key, profile_slug, uuid5
from gaugework.functions.numbers import joined, reasons
from gaugework.operators import conformance, publish, reviews, scores
from gaugework.operators.ordered import beside, number_rows
from gaugework.plans.registry import Tables, big, micros, query, r6
from gaugework.streaming.live_metrics import session_summaries


# ---- reviews ---------------------------------------------------------------

_REVIEWS = """
    WITH r AS (SELECT o_orderkey AS id, o_custkey AS sub, (o_orderdate, o_orderkey) AS pos,
          CASE WHEN o_orderkey % 20 = 7 THEN 'M' WHEN o_orderkey % 4 <= 1 THEN 'I' WHEN o_orderkey % 4 = 2 THEN 'R'
               ELSE 'V' END AS kind, o_totalprice > 60000 AS static_ok FROM orders),
    s AS (SELECT l_orderkey AS id, l_suppkey AS sup, l_suppkey % 10 <> o_custkey % 10 AS ok
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 4 = 2 AND l_orderkey % 20 <> 7),
    sc AS (SELECT id, count(*) AS n, bool_and(ok) AS ok FROM s GROUP BY ALL),
    c AS (SELECT r.*, CASE WHEN kind = 'I' OR (kind = 'M' AND sub % 2 = 0) THEN 'unreviewed'
            WHEN kind = 'V' AND sub % 2 = 1 THEN 'reproduced' ELSE 'community-submitted' END AS prev,
          CASE kind WHEN 'I' THEN 'community-submitted' WHEN 'R' THEN 'reproduced' WHEN 'V' THEN 'verified'
            ELSE 'maintainer-reference' END AS lvl, static_ok AND (kind = 'R') = (n IS NOT NULL) AND coalesce(ok, true) AS good
          FROM r LEFT JOIN sc USING (id)),
    t1 AS (SELECT sub, min(pos) AS pos1, arg_min(lvl, pos) AS l1 FROM c WHERE good AND prev = 'unreviewed' GROUP BY ALL),
    sa AS (SELECT s.id, bool_and(pos1 IS NOT NULL) AS every, max(pos1) AS latest FROM s LEFT JOIN t1 ON sup = t1.sub GROUP BY ALL),
    d AS (SELECT c.*, pos1, l1, every IS NULL OR (every AND latest < pos) AS supported FROM c LEFT JOIN t1 USING (sub)
          LEFT JOIN sa USING (id)),
    t2 AS (SELECT sub, min(pos) AS pos2, arg_min(lvl, pos) AS l2 FROM d WHERE good AND supported AND prev = 'community-submitted'
            AND l1 = 'community-submitted' AND pos > pos1 GROUP BY ALL),
    e AS (SELECT d.*, pos2, l2 FROM d LEFT JOIN t2 USING (sub)),
    t3 AS (SELECT sub, min(pos) AS pos3, arg_min(lvl, pos) AS l3 FROM e WHERE good AND prev = 'reproduced' AND l2 = 'reproduced'
            AND pos > pos2 GROUP BY ALL),
    f AS (SELECT e.*, pos3, l3, coalesce(pos = pos1 OR pos = pos2 OR pos = pos3, pos = pos1 OR pos = pos2, pos = pos1, false) AS chosen
          FROM e LEFT JOIN t3 USING (sub))
"""


def _folded(spark, sf):
    t = Tables(spark, sf)
    key, sub = F.col("o_orderkey"), F.col("o_custkey")
    kind = (
        F.when(key % 20 == 7, "maintainer-reference-review")
        .when(key % 4 <= 1, "initial-review")
        .when(key % 4 == 2, "reproduction-review")
        .otherwise("verification-review")
    )
    k = F.col("review_type")
    records = t.orders.select(
        key.alias("review_id"),
        key.alias("name"),
        F.col("o_orderdate").alias("reviewed_at"),
        sub.alias("submission_id"),
        kind.alias("review_type"),
        (F.col("o_totalprice") > 60000).alias("static_ok"),
    )
    odd = F.col("submission_id") % 2 == 1
    records = records.withColumn(
        "previous_level",
        F.when((k == "initial-review") | ((k == "maintainer-reference-review") & ~odd), "unreviewed")
        .when((k == "verification-review") & odd, "reproduced")
        .otherwise("community-submitted"),
    ).withColumn(
        "assigned_level",
        F.when(k == "initial-review", "community-submitted")
        .when(k == "reproduction-review", "reproduced")
        .when(k == "verification-review", "verified")
        .otherwise("maintainer-reference"),
    )
    # only reproduction reviews name supporting packages
    named = t.lineitem.where("l_orderkey % 4 = 2 AND l_orderkey % 20 <> 7").select(
        "l_orderkey", "l_suppkey"
    )
    supports = named.join(
        t.orders.select(key.alias("l_orderkey"), sub.alias("c")), "l_orderkey"
    ).select(
        F.col("l_orderkey").alias("review_id"),
        F.col("l_suppkey").alias("supporting_id"),
        (F.col("l_suppkey") % 10 != F.col("c") % 10).alias("support_ok"),
    )
    return reviews.fold_reviews(records, supports)


@query(
    "review_verdicts",
    _REVIEWS + "SELECT id AS review_id, sub AS submission_id, good AND chosen AS valid FROM f",
)
def review_verdicts(spark, sf):
    """Which review records hold, given the history before each of them."""
    return _folded(spark, sf).select("review_id", "submission_id", "valid")


@query(
    "review_levels",
    _REVIEWS
    + """
    SELECT c_custkey AS submission_id, coalesce(l3, l2, l1, 'unreviewed') AS evidence_level
    FROM customer LEFT JOIN (SELECT sub, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3
                             FROM f GROUP BY ALL) ON sub = c_custkey
    """,
)
def review_levels(spark, sf):
    submissions = Tables(spark, sf).customer.select(F.col("c_custkey").alias("submission_id"))
    return reviews.evidence_levels(submissions, _folded(spark, sf))


# ---- flat score records ----------------------------------------------------

_SCORES = """
    WITH r AS (SELECT d.doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'Suite A' WHEN source < 'src15' THEN 'Suite B' ELSE source END AS suite,
        lang, n_chars, CASE WHEN d.doc_id % 11 <> 0 THEN n_chars / 100.0 END AS score, CASE WHEN d.doc_id % 17 = 0 THEN 0 ELSE 100 END AS max_score,
        quality = 1 AS passed, CASE WHEN d.doc_id % 7 = 0 THEN 'demo-placeholder' WHEN d.doc_id % 5 = 0 THEN 'other' ELSE 'ci' END AS provenance,
        CASE toxic WHEN 1 THEN 'hot' WHEN 0 THEN 'nominal' END AS thermal FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def _score_records(spark, sf):
    t = Tables(spark, sf)
    source, doc = F.col("source"), F.col("doc_id")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(source.isin("src0", "src1"), "Suite A")
        .when(source < "src15", "Suite B")
        .otherwise(source)
        .alias("suite"),
        "lang",
        "n_chars",
        F.when(doc % 11 != 0, F.col("n_chars") / 100.0).alias("score"),
        F.when(doc % 17 == 0, 0).otherwise(100).alias("max_score"),
        (F.col("quality") == 1).alias("passed"),
        F.when(doc % 7 == 0, "demo-placeholder")
        .when(doc % 5 == 0, "other")
        .otherwise("ci")
        .alias("provenance"),
        F.when(F.col("toxic") == 1, "hot").when(F.col("toxic") == 0, "nominal").alias("thermal"),
    )


@query(
    "score_record_checks",
    _SCORES
    + """
    SELECT doc_id, concat_ws(',', CASE WHEN max_score <= 0 THEN 'max-score-not-positive' END,
        CASE WHEN score IS NULL AND provenance <> 'demo-placeholder' THEN 'score-missing' END,
        CASE WHEN score IS NOT NULL AND NOT (score >= 0 AND score <= max_score) THEN 'score-out-of-range' END,
        CASE WHEN passed IS NULL AND provenance <> 'demo-placeholder' THEN 'passed-missing' END,
        CASE WHEN provenance = 'other' THEN 'source-unsupported' END,
        CASE WHEN thermal = 'hot' THEN 'thermal-state-unsupported' END,
        CASE WHEN provenance <> 'demo-placeholder' AND thermal IS NULL AND n_chars < 300 THEN 'primary-metric-missing' END) AS problems
    FROM r
    """,
)
def score_record_checks(spark, sf):
    r = _score_records(spark, sf)
    why = scores.score_reasons(
        F.col("score"),
        F.col("max_score"),
        F.col("passed"),
        F.col("provenance"),
        F.col("thermal"),
        [F.when(F.col("n_chars") >= 300, F.col("n_chars"))],
    )
    return r.select("doc_id", joined(why).alias("problems"))


@query(
    "score_listing",
    _SCORES
    + """
    SELECT CASE suite WHEN 'Suite A' THEN 0::BIGINT WHEN 'Suite B' THEN 1::BIGINT ELSE 2::BIGINT END AS suite_position, suite, doc_id,
           row_number() OVER (PARTITION BY suite ORDER BY score DESC NULLS LAST, doc_id) AS rank
    FROM r WHERE provenance <> 'demo-placeholder'
    """,
)
def score_listing(spark, sf):
    """Ranked by score per suite, known suites first, placeholders left out."""
    kept = _score_records(spark, sf).where(scores.publishable(F.col("provenance")))
    ranked = scores.scored_listing(kept.select("suite", "doc_id", "score"), "suite", "score", "doc_id")
    position = scores.suite_position(F.col("suite"), ("Suite A", "Suite B"))
    return ranked.select(
        big(position).alias("suite_position"), "suite", "doc_id", big("rank").alias("rank")
    )


@query(
    "measurement_listing",
    """
    SELECT p_partkey, row_number() OVER (ORDER BY p_type, p_name, p_brand, p_partkey) AS position FROM part
    """,
)
def measurement_listing(spark, sf):
    """Sorted by task, model and device; measurements are never ranked."""
    part = Tables(spark, sf).part.select("p_partkey", "p_type", "p_name", "p_brand")
    order = [F.col(c) for c in ("p_type", "p_name", "p_brand", "p_partkey")]
    return number_rows(part, [], order, "position").select(
        "p_partkey", big("position").alias("position")
    )


_NATURAL = (
    "array_to_string(list_transform(regexp_extract_all(lower(p_brand), '(\\d+|\\D+)'), "
    "lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE x END), '')"
)


@query(
    "natural_sort",
    f"SELECT p_partkey, p_brand, row_number() OVER (ORDER BY {_NATURAL} DESC, p_partkey) AS position FROM part",
)
def natural_sort(spark, sf):
    """Brand#9 sorts before Brand#10, here descending."""
    part = Tables(spark, sf).part.select("p_partkey", "p_brand")
    keyed = part.withColumn("_key", scores.natural_key(F.col("p_brand")))
    return number_rows(keyed, [], [F.desc("_key"), F.col("p_partkey")], "position").select(
        "p_partkey", "p_brand", big("position").alias("position")
    )


@query(
    "search_filter",
    """
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE contains(lower(p_name || ' ' || p_brand), 'ring') AND p_type = 'ECONOMY'
    """,
)
def search_filter(spark, sf):
    part = Tables(spark, sf).part.select("p_partkey", "p_name", "p_brand", "p_type")
    found = publish.search(part, ["p_name", "p_brand"], " Ring ", {"p_type": "ECONOMY", "p_brand": None})
    return found.select("p_partkey", "p_name", "p_brand")


# ---- documents and schemas -------------------------------------------------


def _label_documents(spark, sf):
    t = Tables(spark, sf)
    doc = F.col("doc_id")
    with_null = F.to_json(
        F.struct(
            doc.alias("id"),
            F.struct(F.col("quality").alias("score"), F.col("lang").alias("lang")).alias("task"),
        ),
        {"ignoreNullFields": "false"},
    )
    without = F.to_json(
        F.struct(
            doc.cast("string").alias("id"),
            F.struct(F.col("quality").alias("score"), F.lit(" ").alias("lang")).alias("task"),
        )
    )
    return t.documents.select("doc_id", "lang", "source").join(
        t.labels.select("doc_id", "quality"), "doc_id", "left"
    ).select("doc_id", "source", F.when(doc % 3 == 0, without).otherwise(with_null).alias("text"))


@query(
    "json_paths",
    """
    WITH s AS (SELECT d.doc_id, 'task.score' AS path, CASE WHEN quality IS NOT NULL THEN 'present'
                 WHEN d.doc_id % 3 = 0 THEN 'missing' ELSE 'null' END AS state
               FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
               UNION ALL SELECT doc_id, 'task.lang', CASE WHEN doc_id % 3 = 0 THEN 'empty' ELSE 'present' END FROM documents
               UNION ALL SELECT doc_id, 'task.title', 'missing' FROM documents)
    SELECT path, state, count(*) AS documents FROM s WHERE state <> 'present' GROUP BY ALL
    """,
)
def json_paths(spark, sf):
    """Missing, null and empty are three different findings."""
    docs = _label_documents(spark, sf).withColumn("d", F.parse_json("text"))
    found = scores.path_problems(
        docs, ["doc_id"], "d", ["task.score", "task.lang", "task.title"], F.lit(False)
    )
    return found.groupBy("path", "state").agg(F.count("*").alias("documents"))


# A closed schema in the style of the evidence contracts.
_SCHEMA = {
    "type": "object",
    "required": ["id", "task"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 5},
        "task": {
            "type": "object",
            "required": ["score"],
            "properties": {
                "score": {"enum": [0, 1]},
                "lang": {"type": "string", "pattern": "^[a-z]{2}$", "minLength": 2},
            },
        },
    },
}


@query(
    "schema_conformance",
    """
    WITH d AS (SELECT d.doc_id, d.doc_id % 3 = 0 AS odd, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    m AS (SELECT '$.id: type' AS message FROM d WHERE odd
      UNION ALL SELECT '$.id: minimum' FROM d WHERE NOT odd AND doc_id < 5
      UNION ALL SELECT '$.task: required score' FROM d WHERE odd AND quality IS NULL
      UNION ALL SELECT '$.task.score: enum' FROM d WHERE NOT odd AND quality IS NULL
      UNION ALL SELECT '$.task.lang: pattern' FROM d WHERE odd
      UNION ALL SELECT '$.task.lang: minLength' FROM d WHERE odd)
    SELECT message, count(*) AS documents FROM m GROUP BY ALL
    """,
)
def schema_conformance(spark, sf):
    constraints = conformance.constraints_of(_SCHEMA)
    found = conformance.conformance_rows(_label_documents(spark, sf), ["doc_id"], "text", constraints)
    return found.groupBy("message").agg(F.count("*").alias("documents"))


@query(
    "manifest_checks",
    """
    WITH m AS (SELECT p_partkey, lower(p_brand) AS id, CASE p_size % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'retired' END AS status,
        p_partkey % 4 = 0 AS official, p_type, p_size FROM part)
    SELECT p_partkey, concat_ws(',', CASE WHEN status <> 'active' AND official THEN 'non-active-cannot-be-official' END,
        CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'STANDARD', 'PROMO') THEN 'category-unsupported' END,
        CASE WHEN p_size % 10 = p_size // 10 THEN 'metrics-not-unique' END,
        CASE WHEN p_size <= 25 THEN 'maximum-tokens-not-positive' END) AS problems FROM m
    """,
)
def manifest_checks(spark, sf):
    """Workload manifests: identifier, enumerations, unique metrics, limits."""
    size = F.col("p_size")
    status = F.when(size % 3 == 0, "active").when(size % 3 == 1, "draft").otherwise("retired")
    metrics = F.array((size % 10).cast("long"), F.floor(size / 10))
    why = reasons(
        (~F.lower("p_brand").rlike("^[a-z]+#[0-9]+$"), "id-invalid"),
        ((status != "active") & (F.col("p_partkey") % 4 == 0), "non-active-cannot-be-official"),
        (~F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD", "PROMO"), "category-unsupported"),
        (F.size(F.array_distinct(metrics)) != F.size(metrics), "metrics-not-unique"),
        (size - 25 <= 0, "maximum-tokens-not-positive"),
    )
    return Tables(spark, sf).part.select("p_partkey", joined(why).alias("problems"))


# ---- identities ------------------------------------------------------------


@query(
    "comparison_identity",
    """
    SELECT sha256('{"brand":"' || p_brand || '","flag":' ||
             CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '"' || l_returnflag || '"' END ||
             ',"size":' || p_size || '}') AS comparison_id, count(*) AS runs, count(DISTINCT l_suppkey) AS contributors
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
    """,
)
def comparison_identity(spark, sf):
    """Exact identity as a key: sorted fields, nulls kept."""
    t = Tables(spark, sf)
    fields = {
        "size": F.col("p_size"),
        "brand": F.col("p_brand"),
        "flag": F.nullif(F.col("l_returnflag"), F.lit("N")),
    }
    # Group by the plain fields first; the digest is then taken once per cell.
    runs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cells = runs.groupBy(*[c.alias(n) for n, c in fields.items()]).agg(
        F.count("*").alias("runs"), F.countDistinct("l_suppkey").alias("contributors")
    )
    key = engine_key({n: F.col(n) for n in fields})
    return cells.select(key.alias("comparison_id"), "runs", "contributors")


@query(
    "report_ids",
    """
    WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(text) || '|' || doc_id || '|policy')) AS d
               FROM documents)
    SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
           substr('89ab', CAST(('0x' || substr(d, 17, 1)) AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS report_id
    FROM h
    """,
)
def report_ids(spark, sf):
    """Deterministic report identifier from digests, policy and time."""
    identity = F.concat_ws(
        "|", F.sha2("text", 256), F.col("doc_id").cast("string"), F.lit("policy")
    )
    return Tables(spark, sf).documents.select("doc_id", uuid5(identity).alias("report_id"))


# ---- published tables ------------------------------------------------------


@query(
    "evidence_totals",
    """
    WITH c AS (SELECT l_returnflag, l_linestatus, l_suppkey % 7 AS slot, count(DISTINCT l_suppkey) AS n, count(*) AS runs
               FROM lineitem GROUP BY ALL)
    SELECT (SELECT count(*) FROM lineitem) AS results, count(*) AS cells, count(*) FILTER (runs > 30) AS ranked_cells,
           (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS contributors, count(*) FILTER (n >= 2) AS reproduced,
           count(*) FILTER (n >= 3) AS aggregates FROM c
    """,
)
def evidence_totals(spark, sf):
    lines = Tables(spark, sf).lineitem
    cells = (
        lines.groupBy("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).alias("slot"))
        .agg(F.countDistinct("l_suppkey").alias("n"), F.count("*").alias("runs"))
    )
    totals = cells.agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("runs") > 30).alias("ranked_cells"),
        F.count_if(F.col("n") >= 2).alias("reproduced"),
        F.count_if(F.col("n") >= 3).alias("aggregates"),
    )
    overall = lines.agg(
        F.count("*").alias("results"), F.countDistinct("l_suppkey").alias("contributors")
    )
    return beside(overall, totals)


@query(
    "profile_constants",
    """
    SELECT p_brand, count(*) AS rows, count(DISTINCT p_type) = 1 AS p_type_constant,
           count(DISTINCT p_size % 1) = 1 AS unit_constant FROM part GROUP BY ALL
    """,
)
def profile_constants(spark, sf):
    part = Tables(spark, sf).part.select("p_brand", "p_type", (F.col("p_size") % 1).alias("unit"))
    return publish.constant_in_group(part, ["p_brand"], ["p_type", "unit"])


_PROFILES = """
    WITH p AS (SELECT p_brand, p_type, count(*) AS source_results, count(*) FILTER (p_size > 25) AS active_results,
                 max(CASE WHEN p_size > 25 THEN p_retailprice END) AS maximum_memory FROM part GROUP BY ALL)
"""


def _profiles(spark, sf):
    part = Tables(spark, sf).part.select("p_brand", "p_type", "p_size", "p_retailprice")
    return publish.profiles(
        part, ["p_brand", "p_type"], F.col("p_size") > 25, "p_retailprice"
    )


@query(
    "profile_rows",
    _PROFILES
    + """
    SELECT 'ship-' || replace(lower(p_brand), '.', '-') || '-mlx-runtime-3.31.4-' || replace(lower(p_type || ',1'), ',', '-')
             AS profile_id, source_results, active_results, round(maximum_memory, 6) AS maximum_memory FROM p
    """,
)
def profile_rows(spark, sf):
    slug = profile_slug(
        F.concat(F.lit("publisher/"), F.col("p_brand")),
        F.lit("MLX Runtime"),
        F.lit("3.31.4"),
        F.concat(F.col("p_type"), F.lit(",1")),
    )
    return _profiles(spark, sf).select(
        slug.alias("profile_id"),
        "source_results",
        "active_results",
        r6("maximum_memory").alias("maximum_memory"),
    )


@query(
    "claim_rows",
    _PROFILES
    + """
    , c AS (SELECT unnest(['physical-device-local-inference', 'pinned-cached-artifact-load', 'runtime-token-stream',
        'fresh-attempt-context', 'model-license-metadata', 'first-run-download-path', 'swift-integration-recipe', 'offline-execution',
        'generation-cancellation', 'bundled-model-distribution', 'minimum-supported-device', 'app-store-readiness',
        'privacy-compliance']) AS claim_id, unnest(range(13)) AS i)
    SELECT p_brand, p_type, claim_id, CASE WHEN i IN (0, 1) AND active_results < 7 THEN 'unknown' WHEN i < 5 THEN 'verified'
        WHEN i < 7 THEN 'implementation-supported' ELSE 'unknown' END AS status,
      CASE WHEN i IN (0, 1) THEN active_results ELSE 0 END AS basis_rows FROM p, c
    """,
)
def claim_rows(spark, sf):
    enough = F.col("active_results") >= 7
    needs = ("physical-device-local-inference", "pinned-cached-artifact-load")
    present = F.col("source_results") >= 1
    other = (
        "runtime-token-stream",
        "fresh-attempt-context",
        "model-license-metadata",
        "first-run-download-path",
        "swift-integration-recipe",
    )
    return publish.claim_rows(
        _profiles(spark, sf),
        ["p_brand", "p_type"],
        {n: present for n in other} | {n: enough for n in needs},
        {n: F.col("active_results") for n in needs},
    )


@query(
    "publication_rows",
    """
    WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS interactive, o_totalprice > 150000 AS eligible, o_custkey % 3 <> 0 AS declared,
                 o_orderpriority <> '5-LOW' AS authorized FROM orders)
    SELECT o_orderkey, eligible AND declared AND authorized AS active,
      concat_ws(',', CASE WHEN NOT eligible THEN 'insufficient_metric_eligible_attempts' END,
        CASE WHEN NOT authorized THEN 'final_publication_approval_pending' END,
        CASE WHEN NOT declared THEN 'contributor_declarations_pending' END) AS reasons,
      concat_ws(',', 'single-device-single-runtime-verification', 'five-measured-attempts-are-not-a-general-thermal-proof',
        CASE WHEN interactive THEN 'first-renderable-proxy-is-not-screen-render-latency' END,
        CASE WHEN NOT eligible THEN 'insufficient_metric_eligible_attempts' END) AS limitations,
      eligible AND authorized AS recommendation FROM r
    """,
)
def publication_rows(spark, sf):
    """Published row: active flag, reasons, limitations and the consumer's flag."""
    eligible = F.col("o_totalprice") > 150000
    authorized = F.col("o_orderpriority") != "5-LOW"
    reason = F.when(~eligible, "insufficient_metric_eligible_attempts")
    active, why = publish.publication_state(
        eligible, authorized, F.col("o_custkey") % 3 != 0, reason
    )
    limits = publish.limitations(F.col("o_orderstatus") == "F", reason)
    return Tables(spark, sf).orders.select(
        "o_orderkey",
        active.alias("active"),
        joined(why).alias("reasons"),
        joined(limits).alias("limitations"),
        (eligible & authorized).alias("recommendation"),
    )


@query(
    "configuration_matrix",
    """
    WITH r AS (SELECT c_mktsegment, c_nationkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
    l AS (SELECT c_mktsegment, c_nationkey, 'base' AS code FROM r UNION SELECT c_mktsegment, c_nationkey, 'interactive' FROM r WHERE o_orderstatus = 'F'
          UNION SELECT c_mktsegment, c_nationkey, 'large' FROM r WHERE o_totalprice > 495000),
    ls AS (SELECT c_mktsegment, c_nationkey, string_agg(code, ',' ORDER BY code) AS limitations FROM l GROUP BY ALL)
    SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS nation, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS workloads,
           round(max(o_totalprice), 6) AS peak_memory, any_value(limitations) AS limitations
    FROM r JOIN ls USING (c_mktsegment, c_nationkey) GROUP BY c_mktsegment, c_nationkey
    """,
)
def configuration_matrix(spark, sf):
    t = Tables(spark, sf)
    codes = F.array_compact(
        F.array(
            F.lit("base"),
            F.when(F.col("o_orderstatus") == "F", F.lit("interactive")),
            F.when(F.col("o_totalprice") > 495000, F.lit("large")),
        )
    )
    runs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_mktsegment",
        big("c_nationkey").alias("nation"),
        "o_orderpriority",
        "o_totalprice",
        codes.alias("codes"),
    )
    out = publish.configuration_matrix(
        runs, ["c_mktsegment", "nation"], "o_orderpriority", "o_totalprice", "codes"
    )
    return out.withColumn("peak_memory", r6("peak_memory"))


@query(
    "filter_options",
    """
    SELECT 'p_brand' AS field, p_brand AS value, count(*) AS rows FROM part GROUP BY ALL
    UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL
    """,
)
def filter_options(spark, sf):
    return publish.filter_options(Tables(spark, sf).part, ["p_brand", "p_type"])


@query(
    "stream_sessions",
    """
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 43200000000 THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
    SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS events FROM s GROUP BY user_id, session
    """,
)
def stream_sessions(spark, sf):
    """Per-attempt summaries of event sessions, the batch form of the live metrics."""
    events = Tables(spark, sf).events.select(
        F.col("user_id").alias("attempt"), "ts", micros("ts").alias("at_us")
    )
    return session_summaries(events, "12 hours").select(
        F.col("attempt").alias("user_id"),
        F.col("first_time").alias("first_us"),
        F.col("last_time").alias("last_us"),
        "events",
    )
