"""Decisions, batches, reasons, behaviour votes and labels over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.identity import canonical_json_sha256
from gaugework.functions.numbers import joined, reasons
from gaugework.functions.text import (
    ascii_normalized_text,
    normalized_text,
    sentence_count,
    word_set,
)
from gaugework.operators import behaviour, decisions, labels
from gaugework.operators.integrity import fixed_rows
from gaugework.plans.registry import Tables, big, query
from gaugework.session import spread

_CHECKED = """
    WITH c AS (SELECT d.doc_id, d.source, n_chars < 100 AS too_short, lang NOT IN ('en', 'de', 'fr') AS lang_bad,
          coalesce(toxic = 1, false) AS toxic, l.doc_id IS NULL AS unlabelled, quality = 0 AS poor
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    p AS (SELECT doc_id, source, CASE WHEN too_short OR lang_bad OR toxic THEN 'reject'
          WHEN unlabelled OR coalesce(poor, false) THEN 'manual-review' ELSE 'auto-accept' END AS classification,
        concat_ws(',', CASE WHEN too_short THEN 'text-too-short' END, CASE WHEN lang_bad THEN 'language-unsupported' END,
          CASE WHEN toxic THEN 'contract-violated' END, CASE WHEN unlabelled THEN 'contributor-identity-unavailable' END,
          CASE WHEN poor THEN 'declared-conflict-of-interest' END) AS reason_codes FROM c)
"""


def _checked(spark, sf):
    t = Tables(spark, sf)
    both = t.documents.select("doc_id", "source", "lang", "n_chars").join(
        t.labels.withColumn("labelled", F.lit(True)), "doc_id", "left"
    )
    state = lambda bad, status, code: (
        F.when(bad, status).otherwise("pass"),
        reasons((bad, code)),
    )
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return both, {
        "structuralValidity": state(F.col("n_chars") < 100, "fail", "text-too-short"),
        "contractConformance": state(
            ~F.col("lang").isin("en", "de", "fr"), "fail", "language-unsupported"
        ),
        "digestIntegrity": state(toxic, "fail", "contract-violated"),
        "contributor": state(
            F.col("labelled").isNull(), "manual-review", "contributor-identity-unavailable"
        ),
        "conflict": state(
            F.coalesce(F.col("quality") == 0, F.lit(False)),
            "manual-review",
            "declared-conflict-of-interest",
        ),
    }


_HARD = ("structuralValidity", "contractConformance", "digestIntegrity")
_MANUAL = ("contributor", "conflict")


@query(
    "decision_fold",
    _CHECKED + "SELECT doc_id, classification, reason_codes FROM p",
)
def decision_fold(spark, sf):
    """Named checks folded into one classification with ordered reasons."""
    both, checks = _checked(spark, sf)
    rows = decisions.checks_to_rows(both, ["doc_id"], checks)
    folded = decisions.fold_checks(rows, ["doc_id"], _HARD, _MANUAL)
    return folded.withColumn("reason_codes", joined(F.col("reason_codes")))


@query(
    "batch_triage",
    _CHECKED
    + """
    , b AS (SELECT source, doc_id // 200 AS batch, count(*) AS packages, bool_or(doc_id % 97 = 0) AS scope,
              bool_or(classification = 'reject') AS rej, bool_or(classification = 'manual-review') AS man
            FROM p GROUP BY ALL)
    SELECT source, batch, packages, CASE WHEN scope OR packages > 10 OR rej THEN 'rejected'
             WHEN man THEN 'manual_review' ELSE 'auto_accept' END AS classification,
           scope OR packages > 10 AS scope_invalid FROM b
    """,
)
def batch_triage(spark, sf):
    """Packages rolled up to batches; more than ten packages reject a batch."""
    both, checks = _checked(spark, sf)
    status, _ = decisions.inline_decision(
        checks, F.array().cast("array<string>"), _HARD, _MANUAL
    )
    packages = both.select(
        "source",
        big(F.floor(F.col("doc_id") / 200)).alias("batch"),
        status.alias("classification"),
        (F.col("doc_id") % 97 == 0).alias("scope"),
    )
    return decisions.triage_batches(packages, ["source", "batch"], "classification", "scope")


@query(
    "decision_totals",
    _CHECKED
    + """
    SELECT count(*) AS input, count(*) FILTER (classification <> 'reject') AS normalized,
           count(*) FILTER (classification = 'auto-accept') AS eligible,
           count(*) FILTER (classification = 'manual-review') AS ineligible,
           count(*) FILTER (classification = 'reject') AS rejected FROM p
    """,
)
def decision_totals(spark, sf):
    """The run report: input, normalized, eligible, ineligible, rejected."""
    both, checks = _checked(spark, sf)
    status, _ = decisions.inline_decision(
        checks, F.array().cast("array<string>"), _HARD, _MANUAL
    )
    is_ = lambda s: F.count_if(F.col("s") == s)
    return both.select(status.alias("s")).agg(
        F.count("*").alias("input"),
        F.count_if(F.col("s") != "reject").alias("normalized"),
        is_("auto-accept").alias("eligible"),
        is_("manual-review").alias("ineligible"),
        is_("reject").alias("rejected"),
    )


@query(
    "reason_union",
    _CHECKED
    + """
    , e AS (SELECT source, unnest(string_split(reason_codes, ',')) AS code FROM p
            UNION ALL SELECT source, 'no-eligible-contribution' FROM p)
    SELECT source, string_agg(DISTINCT code, ',' ORDER BY code) AS reason_codes FROM e
    WHERE code <> '' GROUP BY ALL
    """,
)
def reason_union(spark, sf):
    """Sorted set of reasons per source, always with the base code."""
    both, checks = _checked(spark, sf)
    _, codes = decisions.inline_decision(checks, F.array().cast("array<string>"), _HARD, _MANUAL)
    coded = both.select("source", codes.alias("codes"))
    out = decisions.reason_union(coded, ["source"], "codes", "no-eligible-contribution")
    return out.withColumn("reason_codes", joined(F.col("reason_codes")))


@query(
    "reason_registry",
    _CHECKED
    + """
    , e AS (SELECT unnest(string_split(reason_codes, ',')) AS code FROM p)
    SELECT code, count(*) AS uses FROM e WHERE code NOT IN ('', 'text-too-short',
      'contributor-identity-unavailable') GROUP BY ALL
    """,
)
def reason_registry(spark, sf):
    """Reason codes in use that are not registered."""
    both, checks = _checked(spark, sf)
    _, codes = decisions.inline_decision(checks, F.array().cast("array<string>"), _HARD, _MANUAL)
    registry = fixed_rows(
        spark, ["code"], [("text-too-short",), ("contributor-identity-unavailable",)]
    )
    return decisions.unregistered_reasons(both.select(codes.alias("codes")), "codes", registry)


@query(
    "final_eligibility",
    """
    WITH j AS (SELECT d.doc_id, n_chars >= 100 AS s, lang <> 'es' AS p, quality = 1 AS prim, source < 'src2' AS applies,
                 coalesce(toxic = 0, false) AS ver FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    k AS (SELECT *, s AND p AND coalesce(prim, false) AS perf, concat_ws(',', CASE WHEN NOT s THEN 'schema_invalid' END,
            CASE WHEN NOT p THEN 'workload_identity_mismatch' END,
            CASE WHEN NOT coalesce(prim, false) THEN 'primary_metric_ineligible' END) AS why FROM j)
    SELECT doc_id, perf AS performance, why AS performance_reasons, perf AND (NOT applies OR ver) AS recommendation,
           concat_ws(',', nullif(why, ''), CASE WHEN applies AND NOT ver THEN 'behavior_verification_required' END)
             AS recommendation_reasons FROM k
    """,
)
def final_eligibility(spark, sf):
    t = Tables(spark, sf)
    both = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")
    performance, why, recommendation, more = decisions.final_eligibility(
        F.col("n_chars") >= 100,
        F.array(F.lit("schema_invalid")),
        F.col("lang") != "es",
        F.array(F.lit("workload_identity_mismatch")),
        F.col("quality") == 1,
        F.col("source") < "src2",
        F.coalesce(F.col("toxic") == 0, F.lit(False)),
    )
    return both.select(
        "doc_id",
        performance.alias("performance"),
        joined(why).alias("performance_reasons"),
        recommendation.alias("recommendation"),
        joined(more).alias("recommendation_reasons"),
    )


# Invented words of the given texts stand in for the policy's English terms.
_GROUPS = (("the", "die", "la", "el"), ("and", "und", "et", "y"))
_CONTRADICTIONS = ("the the", "die die")
_SPACED = "trim(regexp_replace(lower(text), '[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"


@query(
    "behaviour_votes",
    f"""
    WITH n AS (SELECT conv_id, {_SPACED} AS t FROM conversations WHERE role <> 'system'),
    w AS (SELECT conv_id, t, list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) AS words,
            len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x) <> '')) AS sentences FROM n),
    s AS (SELECT conv_id, CASE WHEN t = '' OR sentences > 6 THEN 'not-verified'
            WHEN contains(t, 'the the') OR contains(t, 'die die') THEN 'contradicted'
            WHEN list_has_any(words, ['the', 'die', 'la', 'el']) AND list_has_any(words, ['and', 'und', 'et', 'y'])
            THEN 'verified' ELSE 'not-verified' END AS st FROM w),
    v AS (SELECT conv_id, count(*) FILTER (st = 'verified') AS verified, count(*) FILTER (st = 'contradicted') AS contradicted,
            count(*) FILTER (st = 'not-verified') AS not_verified FROM s GROUP BY ALL)
    SELECT *, CASE WHEN contradicted > 0 THEN 'fail' WHEN verified >= 3 THEN 'pass' ELSE 'manual-review' END AS behaviour
    FROM v
    """,
)
def behaviour_votes(spark, sf):
    """Sentence limit, contradictions, then concepts; attempts vote per conversation.

    A system turn sets the task and is no answer to judge.
    """
    turns = Tables(spark, sf).conversations.where("role <> 'system'")
    text = ascii_normalized_text(F.col("text"))
    status = behaviour.response_status(F.col("t"), _GROUPS, _CONTRADICTIONS, 6)
    judged = turns.select("conv_id", text.alias("t")).select("conv_id", status.alias("status"))
    return behaviour.vote(judged, ["conv_id"], "status", rules.MINIMUM_ELIGIBLE_ATTEMPTS)


@query(
    "policy_votes",
    f"""
    WITH n AS (SELECT doc_id, source, {_SPACED} AS t FROM documents),
    w AS (SELECT source, t, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS words FROM n)
    SELECT source, count(*) AS responses,
      count(*) FILTER (list_has_any(words, ['safe', 'safely', 'secure', 'securely', 'saved', 'stored', 'kept', 'preserved'])
        OR list_has_any(words, ['after', 'once', 'resume', 'resumes', 'return', 'returns', 'when'])) AS with_terms,
      count(*) FILTER (contains(t, 'safe') AND (contains(t, 'iphone') OR contains(t, 'device') OR contains(t, 'local'))) AS local_hits,
      count(*) FILTER (contains(t, 'orchid-47')) AS has_reference_code,
      count(*) FILTER (contains(t, '30') AND (contains(t, 'stable') OR contains(t, 'seconds'))) AS has_stable_network_fact,
      count(*) FILTER ((contains(t, '20') OR contains(t, '15')) AND (contains(t, 'power') OR contains(t, 'charg'))) AS has_battery_power_fact
    FROM w GROUP BY ALL
    """,
)
def policy_votes(spark, sf):
    """Hits of the fixed policy terms and answer facts over whole documents."""
    docs = spread(Tables(spark, sf).documents.select("doc_id", "source", "text"), "doc_id").select(
        "source", ascii_normalized_text(F.col("text")).alias("t")
    )
    words = word_set(F.col("t"))
    group = lambda i: F.array(*[F.lit(w) for w in rules.CONCEPT_TERM_GROUPS[i]])
    facts = behaviour.five_facts(F.col("t"))
    local = F.col("t").contains("safe") & (
        F.col("t").contains("iphone") | F.col("t").contains("device") | F.col("t").contains("local")
    )
    return docs.groupBy("source").agg(
        F.count("*").alias("responses"),
        F.count_if(F.arrays_overlap(words, group(0)) | F.arrays_overlap(words, group(4))).alias(
            "with_terms"
        ),
        F.count_if(local).alias("local_hits"),
        *[
            F.count_if(facts[f]).alias(f)
            for f in ("has_reference_code", "has_stable_network_fact", "has_battery_power_fact")
        ],
    )


@query(
    "substring_rule",
    f"""
    WITH n AS (SELECT conv_id, turn, {_SPACED} AS t FROM conversations)
    SELECT conv_id, turn, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x) <> '')) AS sentences,
           t <> '' AND len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x) <> '')) <= 2
             AND contains(t, 'safe') AND (contains(t, 'iphone') OR contains(t, 'device') OR contains(t, 'local'))
             AND contains(t, 'sync') AND (contains(t, 'connect') OR contains(t, 'network') OR contains(t, 'online'))
             AND (contains(t, 'return') OR contains(t, 'restore') OR contains(t, 'available') OR contains(t, 'back')
                  OR contains(t, 'again')) AS conformant
    FROM n
    """,
)
def substring_rule(spark, sf):
    turns = Tables(spark, sf).conversations.select(
        "conv_id", "turn", ascii_normalized_text(F.col("text")).alias("t")
    )
    return turns.select(
        "conv_id",
        "turn",
        sentence_count(F.col("t")).alias("sentences"),
        behaviour.substring_conformant(F.col("t")).alias("conformant"),
    )


@query(
    "answer_contract",
    """
    WITH f AS (SELECT conv_id, contains(lower(text), '?') OR contains(lower(text), '.') AS a,
                 length(text) > 40 AS b FROM conversations WHERE role = 'assistant')
    SELECT conv_id, count(*) AS attempts, count(*) FILTER (a AND b) AS passing,
           count(*) = 5 AND count(*) FILTER (a AND b) = 5 AS eligible FROM f GROUP BY ALL
    """,
)
def answer_contract(spark, sf):
    """Attempts meeting every fact; all five must."""
    text = F.col("text")
    passes = F.forall(
        F.array(text.contains("?") | text.contains("."), F.length(text) > 40), lambda x: x
    )
    return (
        Tables(spark, sf)
        .conversations.where("role = 'assistant'")
        .groupBy("conv_id")
        .agg(F.count("*").alias("attempts"), F.count_if(passes).alias("passing"))
        .withColumn(
            "eligible",
            (F.col("attempts") == rules.MEASURED_ATTEMPTS)
            & (F.col("passing") == rules.MEASURED_ATTEMPTS),
        )
    )


@query(
    "fragment_scan",
    """
    WITH f AS (SELECT unnest(['<script', 'cookie', 'http://', 'all rights reserved', 'utf-8']) AS fragment)
    SELECT fragment, count(*) AS pages, CAST(min(page_id) AS BIGINT) AS first_page
    FROM f JOIN pages ON contains(lower(html), fragment) GROUP BY ALL
    """,
)
def fragment_scan(spark, sf):
    """Forbidden fragments found in whole documents; the list is fixed, the scan single."""
    fragments = ("<script", "cookie", "http://", "all rights reserved", "utf-8")
    hits = behaviour.fragment_hits(F.col("html"), fragments)
    pages = Tables(spark, sf).pages.select("page_id", F.explode(hits).alias("fragment"))
    return pages.groupBy("fragment").agg(
        F.count("*").alias("pages"), F.min("page_id").alias("first_page")
    )


@query(
    "label_confusion",
    """
    SELECT lang, CAST(quality AS BIGINT) AS expected, CASE WHEN n_chars >= 500 THEN 1::BIGINT ELSE 0::BIGINT END AS actual,
           count(*) AS cases FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL
    """,
)
def label_confusion(spark, sf):
    return labels.confusion(_evaluated(spark, sf), ["lang"], "expected", "actual")


def _evaluated(spark, sf):
    t = Tables(spark, sf)
    cases = t.labels.select("doc_id", big("quality").alias("expected"), "toxic")
    evaluations = t.documents.select(
        "doc_id", "lang", F.when(F.col("n_chars") >= 500, 1).otherwise(0).cast("long").alias("actual")
    )
    return labels.pair_cases(cases, evaluations, "doc_id").where(
        "problem IS NULL"
    )


@query(
    "label_accuracy",
    """
    SELECT lang, count(*) FILTER (quality = (n_chars >= 500)::INT) AS correct, count(*) AS total,
           round(count(*) FILTER (quality = (n_chars >= 500)::INT) / count(*), 6) AS accuracy
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL
    """,
)
def label_accuracy(spark, sf):
    return labels.accuracy(_evaluated(spark, sf), ["lang"], "expected", "actual")


@query(
    "label_pairing",
    """
    SELECT CASE WHEN l.doc_id IS NULL THEN 'evaluation-without-case' WHEN d.doc_id IS NULL
             THEN 'case-without-evaluation' ELSE 'paired' END AS problem, quality IS NULL AS unlabelled,
           count(*) AS rows
    FROM labels l FULL JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL
    """,
)
def label_pairing(spark, sf):
    """Cases and evaluations must pair one to one."""
    t = Tables(spark, sf)
    cases = t.labels.select("doc_id", "quality")
    both = labels.pair_cases(cases, t.documents.select("doc_id"), "doc_id")
    return both.groupBy(
        F.coalesce("problem", F.lit("paired")).alias("problem"),
        F.col("quality").isNull().alias("unlabelled"),
    ).agg(F.count("*").alias("rows"))


@query(
    "case_problems",
    """
    WITH c AS (SELECT turn AS pos, conv_id * 8 + least(turn, 5) AS case_id, CASE WHEN length(text) < 40 THEN '  ' ELSE text END
                 AS response, role FROM conversations),
    n AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS k FROM c)
    SELECT case_id, pos, CASE WHEN trim(response) = '' THEN 'blank-response'
             WHEN role NOT IN ('user', 'assistant') THEN 'unknown-label' ELSE 'duplicate-case-id' END AS problem
    FROM n WHERE trim(response) = '' OR role NOT IN ('user', 'assistant') OR k > 1
    """,
)
def case_problems(spark, sf):
    """Rows a labelled corpus may not contain."""
    cases = Tables(spark, sf).conversations.select(
        F.col("turn").alias("pos"),
        (F.col("conv_id") * 8 + F.least(F.col("turn"), F.lit(5))).alias("case_id"),
        F.when(F.length("text") < 40, F.lit("  ")).otherwise(F.col("text")).alias("response"),
        "role",
    )
    out = labels.case_problems(cases, "case_id", "response", "role", ("user", "assistant"))
    return out.select("case_id", "pos", "problem")


# Composition and lower case are NFKC and case folding for the letters of these texts, but for one.
_FOLDED = _SPACED.replace("lower(text)", "replace(lower(nfc_normalize(text)), 'ß', 'ss')")


@query(
    "nfkc_text",
    f"SELECT source, count(*) AS documents, count(DISTINCT {_FOLDED}) AS distinct_texts FROM documents GROUP BY ALL",
)
def nfkc_text(spark, sf):
    """Documents by digest of their normalised text."""
    docs = spread(Tables(spark, sf).documents.select("doc_id", "source", "text"), "doc_id").select(
        "source", F.sha2(normalized_text(F.col("text")), 256).alias("digest")
    )
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.countDistinct("digest").alias("distinct_texts")
    )


@query(
    "canonical_digest",
    """
    SELECT sha256('{"id":' || user_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"type":"'
             || event_type || '"}') AS digest, count(*) AS events
    FROM events GROUP BY ALL
    """,
)
def canonical_digest(spark, sf):
    """Digest of re-written JSON: sorted keys, no spaces."""
    text = F.to_json(
        F.struct(
            F.col("event_type").alias("type"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.col("user_id").alias("id"),
        )
    )
    distinct = (
        Tables(spark, sf).events.groupBy(text.alias("text")).agg(F.count("*").alias("events"))
    )
    return distinct.select(canonical_json_sha256(F.col("text")).alias("digest"), "events")
