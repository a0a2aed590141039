"""Duplicates, registries, digests and coverage over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.numbers import joined, reasons
from gaugework.operators import integrity
from gaugework.operators.hot_keys import lookup
from gaugework.plans.registry import Tables, big, query


def _digests(spark, sf):
    return Tables(spark, sf).documents.select(
        "doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("digest")
    )


@query(
    "dedupe_first_wins",
    """
    WITH d AS (SELECT doc_id, source, sha256(text) AS digest, row_number() OVER
                 (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)
    SELECT doc_id, source, digest FROM d WHERE n > 1
    """,
)
def dedupe_first_wins(spark, sf):
    """Later copies of any earlier document, by content digest."""
    marked = integrity.first_wins(_digests(spark, sf), "digest", ["doc_id"])
    return marked.where("duplicate").select("doc_id", "source", "digest")


@query(
    "dedupe_first_valid",
    """
    WITH d AS (SELECT doc_id, n_chars >= 200 AS valid, row_number() OVER
                 (PARTITION BY sha256(text), n_chars >= 200 ORDER BY doc_id) AS n FROM documents)
    SELECT doc_id, CASE WHEN NOT valid THEN 'invalid' WHEN n > 1 THEN 'duplicate'
                        ELSE 'accepted' END AS status FROM d
    """,
)
def dedupe_first_valid(spark, sf):
    docs = _digests(spark, sf).withColumn("valid", F.col("n_chars") >= 200)
    out = integrity.first_valid_wins(docs, "digest", ["doc_id"], "valid")
    return out.select("doc_id", "status")


@query(
    "accepted_before",
    """
    SELECT d.doc_id, d.source FROM documents d
    WHERE d.source NOT IN ('src0', 'src1', 'src2')
      AND sha256(d.text) IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1', 'src2'))
    """,
)
def accepted_before(spark, sf):
    """Documents whose digest an earlier intake already accepted."""
    docs = _digests(spark, sf)
    accepted = F.col("source").isin("src0", "src1", "src2")
    known = docs.where(accepted).select("digest").distinct().withColumn("known", F.lit(True))
    later = docs.where(~accepted).select("doc_id", "source", "digest")
    return lookup(later, known, ["digest"], "left", ["doc_id"]).where("known").select(
        "doc_id", "source"
    )


@query(
    "uniqueness_report",
    """
    SELECT 'digest' AS field, sha256(text) AS value, count(*) AS rows FROM documents
      GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'length', lang || ':' || n_chars, count(*) FROM documents
      GROUP BY ALL HAVING count(*) > 1
    """,
)
def uniqueness_report(spark, sf):
    length = F.concat_ws(":", "lang", F.col("n_chars").cast("string"))
    return integrity.repeated_values(
        _digests(spark, sf), {"digest": F.col("digest"), "length": length}
    )


@query(
    "registry_join",
    """
    SELECT l_returnflag, CASE WHEN p_partkey IS NULL THEN 'model-artifact-not-registered'
             WHEN l_linenumber % 5 IS DISTINCT FROM p_size % 5
               OR l_suppkey % 2 IS DISTINCT FROM p_partkey % 2 THEN 'model-artifact-identity-mismatch'
             ELSE 'registered' END AS reason, count(*) AS rows
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey
    GROUP BY ALL
    """,
)
def registry_join(spark, sf):
    """Snapshot of the model in each result against the model registry."""
    t = Tables(spark, sf)
    facts = t.lineitem.select(
        F.col("l_partkey").alias("entry"),
        "l_returnflag",
        "l_orderkey",
        "l_linenumber",
        (F.col("l_linenumber") % 5).alias("size"),
        (F.col("l_suppkey") % 2).alias("revision"),
    )
    registry = t.part.where("p_size <= 40").select(
        F.col("p_partkey").alias("entry"),
        (F.col("p_size") % 5).alias("known_size"),
        (F.col("p_partkey") % 2).alias("known_revision"),
    )
    out = integrity.against_registry(
        facts,
        registry,
        ["entry"],
        [("size", "known_size"), ("revision", "known_revision")],
        "model-artifact-not-registered",
        "model-artifact-identity-mismatch",
        ["l_orderkey", "l_linenumber"],
    )
    return out.groupBy("l_returnflag", F.coalesce("reason", F.lit("registered")).alias("reason")).agg(
        F.count("*").alias("rows")
    )


@query(
    "workload_join",
    """
    WITH j AS (SELECT concat_ws(',',
        CASE WHEN s_suppkey IS NULL THEN 'unsupported-workload' END,
        CASE WHEN s_nationkey % 3 <> l_linenumber % 3 THEN 'workload-identity-mismatch' END,
        CASE WHEN (s_nationkey % 2 = 0) <> (l_linestatus = 'F') THEN 'measurement-mode-mismatch' END,
        CASE WHEN s_nationkey > 12 AND l_tax > 0.04 THEN 'inference-configuration-mismatch' END) AS reasons
      FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey)
    SELECT reasons, count(*) AS rows FROM j GROUP BY ALL
    """,
)
def workload_join(spark, sf):
    t = Tables(spark, sf)
    workloads = t.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"
    )
    facts = t.lineitem.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_linestatus", "l_tax", "l_partkey"
    )
    nation = F.col("s_nationkey")
    why = reasons(
        (nation.isNull(), "unsupported-workload"),
        (nation % 3 != F.col("l_linenumber") % 3, "workload-identity-mismatch"),
        ((nation % 2 == 0) != (F.col("l_linestatus") == "F"), "measurement-mode-mismatch"),
        ((nation > 12) & (F.col("l_tax") > 0.04), "inference-configuration-mismatch"),
    )
    both = lookup(facts, workloads, ["l_suppkey"], "left", ["l_orderkey", "l_linenumber", "l_partkey"])
    return both.groupBy(joined(why).alias("reasons")).agg(F.count("*").alias("rows"))


@query(
    "stack_check",
    """
    SELECT o_orderpriority, concat_ws(',',
        CASE WHEN NOT (o_orderstatus = 'F' AND o_custkey % 4 = 1) THEN 'program-or-target-digest-mismatch' END,
        CASE WHEN o_custkey % 7 <> 3 THEN 'app-release-not-supported' END) AS reasons, count(*) AS rows
    FROM orders GROUP BY ALL
    """,
)
def stack_check(spark, sf):
    """Identity against the one trusted program, target and release."""
    why = integrity.against_trusted(
        [
            (
                [(F.col("o_orderstatus"), "F"), (F.col("o_custkey") % 4, 1)],
                "program-or-target-digest-mismatch",
            ),
            ([(F.col("o_custkey") % 7, 3)], "app-release-not-supported"),
        ]
    )
    orders = Tables(spark, sf).orders.select("o_orderpriority", joined(why).alias("reasons"))
    return orders.groupBy("o_orderpriority", "reasons").agg(F.count("*").alias("rows"))


@query(
    "runner_match",
    """
    WITH a AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS status,
                 nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey % 4 AS slot,
                 min(c_custkey) AS approval FROM customer GROUP BY ALL),
    f AS (SELECT o_orderkey, o_orderstatus AS status, nullif(c_mktsegment, 'BUILDING') AS segment,
            o_orderkey % 6 AS slot FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, approval FROM f JOIN a ON f.status = a.status
      AND f.segment IS NOT DISTINCT FROM a.segment AND f.slot = a.slot
    """,
)
def runner_match(spark, sf):
    """First approved runner equal on several fields, nulls included."""
    t = Tables(spark, sf)
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")
    nation = F.col("c_nationkey")
    approvals = t.customer.select(
        F.when(nation % 3 == 0, "F").when(nation % 3 == 1, "O").otherwise("P").alias("status"),
        segment,
        big(nation % 4).alias("slot"),
        F.col("c_custkey").alias("approval"),
    )
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        segment,
        (F.col("o_orderkey") % 6).alias("slot"),
    )
    out = integrity.first_approval(
        facts, approvals, ["status", "segment", "slot"], "approval", "approval"
    )
    return out.where(F.col("approval").isNotNull()).select("o_orderkey", "approval")


@query(
    "digest_pins",
    """
    WITH actual AS (SELECT d.doc_id, sha256(text) AS a FROM documents d JOIN labels l
                    ON d.doc_id = l.doc_id WHERE quality = 1),
    pins AS (SELECT doc_id, source, sha256(trim(text, chr(10) || ' ')) AS p FROM documents)
    SELECT source, CASE WHEN a IS NULL THEN 'missing' WHEN a <> p THEN 'digest-mismatch'
                        ELSE 'ok' END AS state, count(*) AS documents
    FROM pins LEFT JOIN actual USING (doc_id) GROUP BY ALL
    """,
)
def digest_pins(spark, sf):
    """Pinned digests of trimmed documents against the retained bytes."""
    t = Tables(spark, sf)
    docs = t.documents.select("doc_id", "source", "text")
    pins = docs.select(
        "doc_id", "source", F.sha2(F.expr("trim(BOTH '\n ' FROM text)"), 256).alias("sha256")
    )
    kept = t.labels.where("quality = 1").select("doc_id")
    actual = docs.join(kept, "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"))
    out = integrity.against_pins(pins, actual, "doc_id")
    return out.groupBy("source", "state").agg(F.count("*").alias("documents"))


@query(
    "report_pairs",
    """
    WITH j AS (SELECT l.doc_id, concat_ws(',',
        CASE WHEN d.doc_id IS NULL THEN 'result-missing' END,
        CASE WHEN sha256(d.text) <> CASE WHEN toxic = 1 THEN sha256('x' || d.text) ELSE sha256(d.text) END
             THEN 'report-does-not-bind-result' END,
        CASE WHEN CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END <> quality THEN 'report-stale' END) AS errors
      FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
    SELECT doc_id, errors FROM j
    """,
)
def report_pairs(spark, sf):
    """A stored report must bind the exact bytes and equal its recomputation."""
    t = Tables(spark, sf)
    digest = F.sha2("text", 256)
    results = t.documents.select(
        "doc_id",
        digest.alias("result_sha"),
        F.sha2(F.concat(F.lit("x"), F.col("text")), 256).alias("other_sha"),
        F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("recomputed"),
    )
    both = t.labels.join(results, "doc_id", "left")
    bound = F.when(F.col("toxic") == 1, F.col("other_sha")).otherwise(F.col("result_sha"))
    errors = reasons(
        (F.col("result_sha").isNull(), "result-missing"),
        (F.col("result_sha") != bound, "report-does-not-bind-result"),
        (F.col("recomputed") != F.col("quality"), "report-stale"),
    )
    return both.select("doc_id", joined(errors).alias("errors"))


@query(
    "support_pairs",
    """
    WITH s AS (SELECT o_orderkey, concat_ws(',',
        CASE WHEN NOT s_acctbal > 0 THEN 'support-not-accepted' END,
        CASE WHEN s_nationkey % 5 <> c_nationkey % 5 THEN 'support-not-comparison-compatible' END,
        CASE WHEN s_suppkey % 10 = c_custkey % 10 THEN 'support-not-contributor-independent' END,
        CASE WHEN l_partkey = o_orderkey THEN 'support-reuses-result' END) AS why
      FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT o_orderkey, count(*) AS supports, count(*) FILTER (why = '') AS valid_supports,
           count(*) FILTER (why LIKE '%independent%') AS dependent_supports
    FROM s GROUP BY ALL
    """,
)
def support_pairs(spark, sf):
    """Named supporting submissions: same identity, other contributor, own result."""
    t = Tables(spark, sf)
    reviews = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("l_orderkey"), "c_custkey", "c_nationkey"
    )
    named = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    supports = lookup(named, reviews, ["l_orderkey"], "inner", ["l_linenumber", "l_partkey"])
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")
    pairs = lookup(supports, suppliers, ["l_suppkey"], "inner", ["l_orderkey", "l_linenumber"])
    why = integrity.support_reasons(
        F.col("s_nationkey") % 5 == F.col("c_nationkey") % 5,
        F.col("l_suppkey") % 10 == F.col("c_custkey") % 10,
        F.col("l_partkey") == F.col("l_orderkey"),
        F.col("s_acctbal") > 0,
    )
    return (
        pairs.withColumn("why", why)
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").alias("supports"),
            F.count_if(F.size("why") == 0).alias("valid_supports"),
            F.count_if(F.array_contains("why", "support-not-contributor-independent")).alias(
                "dependent_supports"
            ),
        )
    )


@query(
    "adoption_matrix",
    """
    WITH e AS (SELECT p_brand, p_type, count(*) AS entries, count(DISTINCT p_size) AS sizes
               FROM part GROUP BY ALL),
    r AS (SELECT p_brand, p_type, count(*) AS raw FROM lineitem JOIN part ON l_partkey = p_partkey
          WHERE l_returnflag = 'A' GROUP BY ALL)
    SELECT p_brand, p_type, entries, coalesce(raw, 0) AS raw, concat_ws(',',
        CASE WHEN entries <> sizes THEN 'matrix-not-unique' END,
        CASE WHEN raw IS NULL OR raw < 12 THEN 'raw-evidence-missing' END) AS problems
    FROM e LEFT JOIN r USING (p_brand, p_type)
    """,
)
def adoption_matrix(spark, sf):
    """Adopted (artifact, workload) cells: unique rows, each backed by raw evidence."""
    t = Tables(spark, sf)
    cell = ["p_brand", "p_type"]
    entries = t.part.groupBy(*cell).agg(
        F.count("*").alias("entries"), F.countDistinct("p_size").alias("_sizes")
    )
    raw = (
        t.lineitem.where("l_returnflag = 'A'")
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(*cell)
        .agg(F.count("*").alias("raw"))
    )
    problems = reasons(
        (F.col("entries") != F.col("_sizes"), "matrix-not-unique"),
        (F.col("raw").isNull() | (F.col("raw") < 12), "raw-evidence-missing"),
    )
    return entries.join(raw, cell, "left").select(
        *cell,
        "entries",
        F.coalesce("raw", F.lit(0)).cast("long").alias("raw"),
        joined(problems).alias("problems"),
    )


@query(
    "coverage_outer",
    """
    WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
    b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 10)
    SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'missing' ELSE 'stale' END AS state
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
    """,
)
def coverage_outer(spark, sf):
    t = Tables(spark, sf)
    listed = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    actual = t.lineitem.where("l_quantity > 10").select(F.col("l_orderkey").alias("key"))
    return integrity.list_coverage(listed, actual, ["key"])


@query(
    "catalog_reconcile",
    """
    SELECT count(*) AS referenced, count(*) FILTER (NOT coalesce(p_size <= 40, false)) AS not_in_catalog,
           count(*) FILTER (p_size > 45) AS retired_in_use
    FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey
    """,
)
def catalog_reconcile(spark, sf):
    """Evidence must be a subset of the catalog and disjoint from retired entries."""
    t = Tables(spark, sf)
    used = t.lineitem.select(F.col("l_partkey").alias("k")).distinct()
    catalog = t.part.where("p_size <= 40").select(F.col("p_partkey").alias("k"))
    retired = t.part.where("p_size > 45").select(F.col("p_partkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("c"), "n")
    rows = (
        count(used, "referenced")
        .unionByName(count(used.join(catalog, "k", "left_anti"), "not_in_catalog"))
        .unionByName(count(used.join(retired, "k", "left_semi"), "retired_in_use"))
    )
    value = lambda name: F.max(F.when(F.col("c") == name, F.col("n"))).alias(name)
    return rows.agg(value("referenced"), value("not_in_catalog"), value("retired_in_use"))


@query(
    "author_match",
    """
    WITH a AS (SELECT o_orderpriority, c_name AS declared, CASE o_orderstatus WHEN 'F' THEN upper(c_name)
                 WHEN 'P' THEN c_name || 'x' END AS author
               FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderpriority, CASE WHEN author IS NULL THEN 'manual-review'
             WHEN lower(declared) <> lower(author) THEN 'fail' ELSE 'pass' END AS status,
           CASE WHEN author IS NULL THEN 'contributor-identity-unavailable'
             WHEN lower(declared) <> lower(author) THEN 'contributor-identity-mismatch' ELSE '' END AS reason,
           count(*) AS packages
    FROM a GROUP BY ALL
    """,
)
def author_match(spark, sf):
    t = Tables(spark, sf)
    name = F.col("c_name")
    author = F.when(F.col("o_orderstatus") == "F", F.upper(name)).when(
        F.col("o_orderstatus") == "P", F.concat(name, F.lit("x"))
    )
    status, reason = integrity.author_check(name, author)
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderpriority", status.alias("status"), F.coalesce(reason, F.lit("")).alias("reason")
    )
    return both.groupBy("o_orderpriority", "status", "reason").agg(F.count("*").alias("packages"))


@query(
    "denied_identities",
    """
    SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier
      WHERE s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000))
    """,
)
def denied_identities(spark, sf):
    """Rows whose (name, address) pair is on the deny list."""
    t = Tables(spark, sf)
    denied = t.supplier.select(
        F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("band")
    ).distinct()
    rows = t.customer.select(
        "c_custkey",
        F.col("c_nationkey").alias("nation"),
        F.floor(F.col("c_acctbal") / 1000).alias("band"),
    )
    return rows.join(denied, ["nation", "band"], "left_semi").select("c_custkey")


@query(
    "published_bundle",
    """
    WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT'
                 THEN sha256('Customer-' || o_custkey) ELSE sha256('Customer#' || lpad(o_custkey::VARCHAR, 9, '0'))
                 END AS d FROM orders)
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN sha256(c_name) <> d
             THEN 'digest-mismatch' ELSE 'ok' END AS state
    FROM p LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
    """,
)
def published_bundle(spark, sf):
    """Published rows against the raw bundle at their path and digest."""
    t = Tables(spark, sf)
    key = F.col("o_custkey").cast("string")
    published = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("path"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.sha2(F.concat(F.lit("Customer-"), key), 256),
        )
        .otherwise(F.sha2(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0")), 256))
        .alias("sha256"),
    )
    raw = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha256")
    )
    return integrity.against_pins(published, raw, "path").select("o_orderkey", "state")


@query(
    "policy_consistency",
    """
    SELECT (SELECT count(*) FROM nation WHERE n_regionkey NOT IN
              (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')) AS unknown_reference,
           (SELECT count(*) FROM region WHERE r_regionkey NOT IN
              (SELECT n_regionkey FROM nation WHERE n_nationkey > 3)) AS unused_reference,
           (SELECT count(*) FROM customer WHERE c_nationkey NOT IN
              (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)) AS outside_enumeration
    """,
)
def policy_consistency(spark, sf):
    """References between policy tables that point nowhere or are never used."""
    t = Tables(spark, sf)
    regions = t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("k"))
    used = t.nation.where("n_nationkey > 3").select(F.col("n_regionkey").alias("k"))
    known = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"))
    count = lambda df, other, name: df.join(other, "k", "left_anti").select(F.lit(name).alias("c"))
    rows = (
        count(t.nation.select(F.col("n_regionkey").alias("k")), regions, "unknown_reference")
        .unionByName(
            count(t.region.select(F.col("r_regionkey").alias("k")), used, "unused_reference")
        )
        .unionByName(
            count(t.customer.select(F.col("c_nationkey").alias("k")), known, "outside_enumeration")
        )
    )
    names = ("unknown_reference", "unused_reference", "outside_enumeration")
    return rows.agg(*[F.count_if(F.col("c") == n).alias(n) for n in names])


@query(
    "union_sources",
    """
    WITH u AS (SELECT c_custkey AS id, c_name AS name, 'community-submission' AS source_kind,
                      c_nationkey AS nation FROM customer
               UNION ALL SELECT s_suppkey, s_name, 'maintainer-reference', s_nationkey FROM supplier)
    SELECT id, name, source_kind, CASE WHEN source_kind = 'maintainer-reference' THEN 'maintainer-reference'
             WHEN quality = 1 THEN 'community-submitted' WHEN quality = 0 THEN 'reproduced'
             ELSE 'unreviewed' END AS evidence_level
    FROM u LEFT JOIN labels ON doc_id = id
    """,
)
def union_sources(spark, sf):
    """Official and community rows in one shape; level defaults to unreviewed."""
    t = Tables(spark, sf)
    community = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("community-submission").alias("source_kind"),
    )
    official = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.lit("maintainer-reference").alias("source_kind"),
    )
    levels = t.labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "community-submitted").otherwise("reproduced").alias("level"),
    )
    both = community.unionByName(official).join(levels, "id", "left")
    level = F.when(F.col("source_kind") == "maintainer-reference", F.col("source_kind")).otherwise(
        F.coalesce("level", F.lit("unreviewed"))
    )
    return both.select("id", "name", "source_kind", level.alias("evidence_level"))


@query(
    "set_equality",
    """
    WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 25),
    b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 25)
    SELECT x AS only_left, y AS only_right, x = 0 AND y = 0 AS equal FROM
      (SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS x,
              (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS y)
    """,
)
def set_equality(spark, sf):
    part = Tables(spark, sf).part
    cells = lambda condition: part.where(condition).select("p_brand", "p_type").distinct()
    return integrity.set_difference_counts(cells("p_size <= 25"), cells("p_size > 25"))
