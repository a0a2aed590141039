"""The whole evidence plan on packages that Spark derives from the customer table.

Each customer row becomes one two-file package: the documents are built as
JSON text, so parsing, schema conformance, digests, series checks, decisions
and ranking all run exactly as for packages read from files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from gaugework import schemas
from gaugework.functions.numbers import joined
from gaugework.operators.integrity import fixed_rows
from gaugework.plans import evidence_ranking as ranking
from gaugework.plans.registry import Tables, big, query
from gaugework.session import materialize, spread

_SHA = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("program", "target", "model", "stack", "work")}
_GENERATION = '{"maximumOutputTokens":128,"sampling":false,"temperature":0}'
_RUNTIME = '{"backend":"metal","configuration":{"fixture":true},"name":"runtime"}'
_VERIFIED = "Your draft is kept securely on this phone. It syncs once the network is back."
_CONTRADICTED = "The note was deleted."
_WEAK = "Saved locally."


def trusted_stack() -> ranking.Trusted:
    return ranking.Trusted(
        program=("text", "2", _SHA["program"]),
        target=("phone", "1", _SHA["target"]),
        workloads=[
            ("power.text.short-interaction", "1", _SHA["work"], "interactive", _GENERATION),
            ("power.text.sustained-generation", "1", _SHA["work"], "sustained", _GENERATION),
        ],
        certificate={
            "state": "active",
            "id": "runner-1",
            "program_sha256": _SHA["program"],
            "target_sha256": _SHA["target"],
            "runtime": _RUNTIME,
        },
        app_release={
            "state": "supported",
            "version": "2.0",
            "build": "1",
            "source_revision": "abc",
            "certificate_ids": ["runner-1"],
        },
        stack_sha256=_SHA["stack"],
        intake_open=True,
    )


def model_registry(spark):
    return fixed_rows(
        spark,
        [
            "entry_id",
            "sha256",
            "artifact_id",
            "artifact_revision",
            "parameter_count",
            "quantization",
            "format",
        ],
        [(f"entry-{i}", _SHA["model"], f"org/model-{i}", "r1", 600 + i, "4bit", "mlx") for i in range(3)],
    )


def _uuid(text):
    digest = F.md5(text)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def _attempt(k, i):
    """Attempt i of package k as a struct in the result layout."""
    none = lambda kind: F.lit(None).cast(kind)
    base = 1000 + (k % 97) * 10 + i * 3
    step = 100 + (k % 31) * i + k % 25
    late = k % 4 == 1
    event = lambda n, at, decoded, prefix, special, shown: F.struct(
        F.lit(n).alias("index"),
        F.lit(n + 1).alias("tokenID"),
        at.alias("receivedNanoseconds"),
        decoded.alias("decodedAtNanoseconds"),
        prefix.alias("decodedPrefix"),
        special.alias("isSpecial"),
        shown.alias("isRenderable"),
    )
    events = F.array(
        event(0, base, base + 5, F.when(late, " ").otherwise("Hi"), F.lit(False), ~late),
        event(
            1,
            base + step,
            F.when(late, base + step + 7),
            F.when(late, "Hi"),
            F.when(late, F.lit(False)),
            F.when(late, F.lit(True)),
        ),
        event(2, base + 2 * step, none("long"), none("string"), none("boolean"), none("boolean")),
    )
    first_bytes, second_bytes = 400000000 + (k % 25) * 4096, 400000000 + i * 8192
    peak = F.greatest(first_bytes, second_bytes) + F.when(k % 31 == 7, 1).otherwise(0)
    sample = lambda at, size: F.struct(
        F.lit(at).alias("elapsedNanoseconds"), size.cast("long").alias("physicalFootprintBytes")
    )
    warm = k % 11 == 2
    change = F.struct(F.lit(5).alias("elapsedNanoseconds"), F.lit("fair").alias("state"))
    failed = (i >= 1) & (k % 3 == 0) & (i <= k % 6)
    text = (
        F.when(k % 7 == 0, _CONTRADICTED).when((k % 7).isin(1, 2), _WEAK).otherwise(_VERIFIED)
    )
    return F.struct(
        i.alias("index"),
        F.when(i == 0, "warmup").otherwise("measured").alias("phase"),
        F.when(failed, "failed").otherwise("succeeded").alias("outcome"),
        F.lit("2026-07-23T12:00:00Z").alias("startedAt"),
        F.lit("2026-07-23T12:00:10Z").alias("endedAt"),
        F.struct(
            F.lit("continuous-clock").alias("clock"),
            F.lit(0).alias("requestAcceptedNanoseconds"),
            base.alias("firstTokenNanoseconds"),
            F.when(late, base + step + 7).otherwise(base + 5).alias("firstRenderableNanoseconds"),
            (base + 2 * step + 50).alias("completedNanoseconds"),
            (500 + k % 25).alias("promptEvaluationNanoseconds"),
            (2 * step).alias("decodeNanoseconds"),
        ).alias("monotonic"),
        F.struct((20 + k % 5).alias("input"), F.lit(3).alias("output")).alias("tokenCounts"),
        events.alias("tokenEvents"),
        text.alias("generatedText"),
        F.struct(
            peak.alias("peakPhysicalFootprintBytes"),
            F.array(sample(0, first_bytes), sample(10, second_bytes)).alias("samples"),
        ).alias("memory"),
        F.struct(
            F.lit("nominal").alias("start"),
            F.when(warm, "fair").otherwise("nominal").alias("end"),
            F.when(warm, F.array(change))
            .otherwise(F.array().cast("array<struct<elapsedNanoseconds:int,state:string>>"))
            .alias("transitions"),
        ).alias("thermal"),
    )


def _named(**fields):
    return F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in fields.items()])


def derived_packages(spark, sf):
    """package_id, submission, result, file_set_valid, author from every customer."""
    key = F.col("c_custkey")
    k = F.col("content_key")
    rows = Tables(spark, sf).customer.select(
        key, F.when(key % 60 == 59, key - 1).otherwise(key).alias("content_key")
    )
    # The documents grow from one small key each, so the keys are dealt to all cores first
    # (with a number: AQE would merge partitions of such small rows into one).
    rows = spread(rows, "c_custkey")
    interactive = k % 2 == 0
    number = (k % 4).cast("string")
    # The 29-row wrinkle differs from the registry on purpose.
    quantization = F.when((k % 29 == 1) & (k % 4 == 1), "8bit").otherwise("4bit")
    result = _named(
        schemaVersion=schemas.RESULT_VERSION,
        resultID=_uuid(F.concat(F.lit("r"), k.cast("string"))),
        createdAt="2026-07-23T11:59:00Z",
        productID="power",
        program=_named(id="text", version="2", manifestSHA256=_SHA["program"]),
        target=_named(id="phone", version="1", manifestSHA256=_SHA["target"]),
        runnerCertificateID="runner-1",
        appRelease=_named(
            version="2.0", build="1", sourceRevision="abc", embeddedMeasurementStackSHA256=_SHA["stack"]
        ),
        model=_named(
            registryEntryID=F.concat(F.lit("entry-"), number),
            registryEntrySHA256=_SHA["model"],
            artifactID=F.concat(F.lit("org/model-"), number),
            artifactRevision="r1",
            parameterCount=600 + k % 4,
            quantization=quantization,
            format="mlx",
        ),
        runtime=_named(name="runtime", backend="metal", configuration=_named(fixture=True)),
        device=_named(
            machineIdentifier=F.concat(F.lit("phone"), (k % 3).cast("string")),
            osVersion=F.concat(F.lit("26."), F.floor(k / 2 % 2).cast("string")),
            osBuild="A1",
        ),
        environment=_named(
            batteryLevelAtStart=F.when(k % 13 == 0, 0.2).otherwise(0.8),
            batteryStateAtStart=F.when(k % 19 == 1, "charging")
            .when(k % 23 == 2, "unknown")
            .otherwise("unplugged"),
            lowPowerModeAtStart=False,
            thermalStateAtStart="nominal",
            thermalStateAtEnd="nominal",
            thermalAssistance=F.when(k % 37 == 3, "deliberate-cooling").otherwise("none"),
        ),
        artifacts=F.array().cast("array<string>"),
        payload=_named(
            schemaVersion="payload-1",
            workload=_named(
                id=F.when(interactive, "power.text.short-interaction").otherwise(
                    "power.text.sustained-generation"
                ),
                version="1",
                sha256=_SHA["work"],
            ),
            measurementMode=F.when(interactive, "interactive").otherwise("sustained"),
            inferenceConfiguration=_named(sampling=False, temperature=0, maximumOutputTokens=128),
            attempts=F.transform(
                F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda i: _attempt(k, i)
            ),
        ),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    login = F.concat(
        F.when(key % 3 == 0, "User-").otherwise("user-"), (key % 40).cast("string")
    )
    with_result = rows.select("c_custkey", F.to_json(result, keep_nulls).alias("text"))
    digest = F.when(key % 47 == 8, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(
        F.sha2("text", 256)
    )
    folder = _uuid(key.cast("string"))
    submission = _named(
        schemaVersion=schemas.SUBMISSION_VERSION,
        submissionID=F.when(key % 50 == 3, _uuid(F.concat(F.lit("x"), key.cast("string")))).otherwise(
            folder
        ),
        createdAt="2026-07-23T11:59:30Z",
        contributor=_named(
            githubLogin=login,
            conflictOfInterest=F.when(key % 17 == 4, "disclosed").otherwise("none"),
        ),
        sourceResult=_named(path="result.json", sha256=digest, schemaVersion=schemas.RESULT_VERSION),
        declarations=_named(
            physicalDevice=True,
            publicMetadataReviewed=True,
            rawEvidenceUnmodified=True,
            containsNoPersonalData=True,
            licenseAccepted="CC-BY-4.0",
            rankingNotGuaranteed=True,
        ),
    )
    author = F.when(key % 43 == 6, "other").when(key % 41 != 5, F.lower(login))
    # Landed once: what follows reads the documents, and does not build them again.
    landed = with_result.select(
        folder.alias("package_id"),
        F.to_json(submission, keep_nulls).cast("binary").alias("submission"),
        F.col("text").cast("binary").alias("result"),
        F.lit(True).alias("file_set_valid"),
        author.alias("author"),
    )
    return materialize(landed)


_EXPECTED = """
    WITH c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 60 = 59 THEN c_custkey - 1 ELSE c_custkey END AS k,
                 md5(c_custkey::VARCHAR) AS h FROM customer),
    d AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
                   || substr(h, 21, 12) AS package_id, row_number() OVER (PARTITION BY k ORDER BY h) > 1 AS dup,
            k % 4 = 3 AS unknown_model, k % 29 = 1 AND k % 4 = 1 AS other_model, k % 31 = 7 AS raw_bad,
            CASE WHEN key % 43 = 6 THEN 'other' WHEN key % 41 <> 5 THEN 'same' END AS author,
            CASE WHEN k % 3 = 0 THEN 5 - k % 6 ELSE 5 END AS succeeded FROM c),
    e AS (SELECT *, unknown_model OR other_model OR raw_bad AS contract_bad,
            key % 47 = 8 OR key % 50 = 3 OR dup AS digest_bad,
            key % 17 = 4 AS conflict, k % 37 = 3 AS assisted, k % 23 = 2 AND k % 19 <> 1 AS unknown_env FROM d),
    f AS (SELECT *, CASE WHEN contract_bad OR digest_bad OR coalesce(author = 'other', false) THEN 'reject'
            WHEN author IS NULL OR conflict OR assisted OR unknown_env THEN 'manual-review' ELSE 'auto-accept' END AS classification,
          concat_ws(',', CASE WHEN unknown_model THEN 'model-artifact-not-registered' END,
            CASE WHEN other_model THEN 'model-artifact-identity-mismatch' END, CASE WHEN raw_bad THEN 'raw-attempt-inconsistent' END,
            CASE WHEN key % 47 = 8 THEN 'result-digest-mismatch' END,
            CASE WHEN key % 50 = 3 THEN 'submission-directory-identity-mismatch' END,
            CASE WHEN dup THEN 'duplicate-result-sha256' END,
            CASE WHEN author IS NULL THEN 'contributor-identity-unavailable' WHEN author = 'other' THEN 'contributor-identity-mismatch' END,
            CASE WHEN conflict THEN 'declared-conflict-of-interest' END, CASE WHEN assisted THEN 'thermal-assistance-not-none' END,
            CASE WHEN unknown_env THEN 'unknown-environment-field' END) AS reason_codes FROM e)
"""


def _decided(spark, sf):
    return ranking.decide(derived_packages(spark, sf), model_registry(spark), trusted_stack())


@query(
    "package_decisions",
    _EXPECTED
    + """
    SELECT package_id, classification, reason_codes, CASE WHEN k % 2 = 1 OR contract_bad THEN 'not-applicable'
        WHEN k % 7 = 0 THEN 'fail' WHEN k % 7 > 2 AND succeeded >= 3 THEN 'pass' ELSE 'manual-review' END AS behaviour
    FROM f
    """,
)
def package_decisions(spark, sf):
    """Classification, ordered reasons and behaviour of every derived package."""
    return _decided(spark, sf).select(
        "package_id", "classification", joined(F.col("reason_codes")).alias("reason_codes"), "behaviour"
    )


@query(
    "package_views",
    _EXPECTED
    + """
    , a AS (SELECT f.*, i, 1000 + (k % 97) * 10 + i * 3 AS base, 100 + (k % 31) * i + k % 25 AS step
            FROM f, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE classification = 'auto-accept' AND succeeded >= 3
              AND NOT (k % 3 = 0 AND i <= k % 6) AND k % 13 <> 0 AND k % 19 <> 1),
    r AS (SELECT key, k, CASE WHEN k % 2 = 0
              THEN median(CASE WHEN k % 4 = 1 THEN base + step + 7 ELSE base + 5 END / 1000000.0)
              ELSE median(2 / (2 * step / 1000000000.0)) END AS v FROM a GROUP BY key, k),
    i AS (SELECT key % 40 AS who, v, CASE WHEN k % 2 = 0 THEN 'interactive-responsiveness' ELSE 'sustained-generation' END AS view_id,
            sha256('{"inferenceConfiguration":{"maximumOutputTokens":128,"sampling":false,"temperature":0},"machineIdentifier":"phone'
              || k % 3 || '","measurementMode":"' || CASE WHEN k % 2 = 0 THEN 'interactive' ELSE 'sustained' END
              || '","modelArtifactID":"org/model-' || k % 4 || '","modelArtifactRevision":"r1","osBuild":"A1","osVersion":"26.'
              || (k // 2) % 2 || '","programID":"text","programVersion":"2","quantization":"4bit","runnerCertificateID":"runner-1",'
              || '"runtimeIdentity":{"backend":"metal","configuration":{"fixture":true},"name":"runtime"},"targetID":"phone","targetVersion":"1","workloadID":"power.text.'
              || CASE WHEN k % 2 = 0 THEN 'short-interaction' ELSE 'sustained-generation' END || '","workloadVersion":"1"}') AS comparison_id
          FROM r),
    p AS (SELECT view_id, comparison_id, who, median(v) AS v, count(*) AS n FROM i GROUP BY ALL),
    w AS (SELECT view_id, comparison_id, median(v) AS value, count(*) AS contributor_count, CAST(sum(n) AS BIGINT) AS submission_count
          FROM p GROUP BY ALL)
    SELECT view_id, comparison_id, round(value, CASE WHEN view_id = 'sustained-generation' THEN 3 ELSE 9 END) AS value,
      contributor_count, submission_count, CASE WHEN contributor_count >= 3 THEN 'contributor-weighted'
        WHEN contributor_count >= 2 THEN 'reproduced' ELSE 'accepted' END AS evidence_state,
      row_number() OVER (PARTITION BY view_id ORDER BY CASE WHEN view_id = 'sustained-generation' THEN -value ELSE value END, comparison_id) AS rank
    FROM w
    """,
)
def package_views(spark, sf):
    """Ranked views of the accepted packages, byte-compatible comparison digests."""
    _, views = ranking.rank_packages(
        derived_packages(spark, sf), model_registry(spark), trusted_stack()
    )
    value = F.when(F.col("view_id") == "sustained-generation", F.round("value", 3)).otherwise(
        F.round("value", 9)
    )
    return views.select(
        "view_id",
        "comparison_id",
        value.alias("value"),
        "contributor_count",
        "submission_count",
        "evidence_state",
        big("rank").alias("rank"),
    )
