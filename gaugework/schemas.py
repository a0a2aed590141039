"""Spark schemas of the evidence generations (fixed field names and types)."""

from __future__ import annotations

ATTEMPT = """STRUCT<index:BIGINT,phase:STRING,outcome:STRING,startedAt:STRING,endedAt:STRING,
  monotonic:STRUCT<clock:STRING,requestAcceptedNanoseconds:BIGINT,firstTokenNanoseconds:BIGINT,
    firstRenderableNanoseconds:BIGINT,completedNanoseconds:BIGINT,
    promptEvaluationNanoseconds:BIGINT,decodeNanoseconds:BIGINT>,
  tokenCounts:STRUCT<input:BIGINT,output:BIGINT>,
  tokenEvents:ARRAY<STRUCT<index:BIGINT,tokenID:BIGINT,receivedNanoseconds:BIGINT,
    decodedAtNanoseconds:BIGINT,decodedPrefix:STRING,isSpecial:BOOLEAN,isRenderable:BOOLEAN>>,
  generatedText:STRING,
  memory:STRUCT<peakPhysicalFootprintBytes:BIGINT,
    samples:ARRAY<STRUCT<elapsedNanoseconds:BIGINT,physicalFootprintBytes:BIGINT>>>,
  thermal:STRUCT<start:STRING,end:STRING,
    transitions:ARRAY<STRUCT<elapsedNanoseconds:BIGINT,state:STRING>>>>"""

# `runtime` and `inferenceConfiguration` stay JSON text: they are identities
# with free keys and are compared and hashed as text.
RESULT = f"""schemaVersion STRING, resultID STRING, createdAt STRING, productID STRING,
  program STRUCT<id:STRING,version:STRING,manifestSHA256:STRING>,
  target STRUCT<id:STRING,version:STRING,manifestSHA256:STRING>,
  runnerCertificateID STRING,
  appRelease STRUCT<version:STRING,build:STRING,sourceRevision:STRING,
    embeddedMeasurementStackSHA256:STRING>,
  model STRUCT<registryEntryID:STRING,registryEntrySHA256:STRING,artifactID:STRING,
    artifactRevision:STRING,parameterCount:BIGINT,quantization:STRING,format:STRING>,
  runtime STRING,
  device STRUCT<machineIdentifier:STRING,osVersion:STRING,osBuild:STRING>,
  environment STRUCT<batteryLevelAtStart:DOUBLE,batteryStateAtStart:STRING,
    lowPowerModeAtStart:BOOLEAN,thermalStateAtStart:STRING,thermalStateAtEnd:STRING,
    thermalAssistance:STRING>,
  artifacts ARRAY<STRUCT<path:STRING,sha256:STRING,mediaType:STRING,byteCount:BIGINT>>,
  payload STRUCT<schemaVersion:STRING,
    workload:STRUCT<id:STRING,version:STRING,sha256:STRING>,measurementMode:STRING,
    inferenceConfiguration:STRING,attempts:ARRAY<{ATTEMPT}>>"""

SUBMISSION = """schemaVersion STRING, submissionID STRING, createdAt STRING,
  contributor STRUCT<githubLogin:STRING,conflictOfInterest:STRING,disclosure:STRING>,
  sourceResult STRUCT<path:STRING,sha256:STRING,schemaVersion:STRING>,
  declarations STRUCT<physicalDevice:BOOLEAN,publicMetadataReviewed:BOOLEAN,
    rawEvidenceUnmodified:BOOLEAN,containsNoPersonalData:BOOLEAN,licenseAccepted:STRING,
    rankingNotGuaranteed:BOOLEAN>, environmentNotes STRING"""

# Schema versions of the current generation.
SUBMISSION_VERSION = "power-submission-1.0.0-draft.1"
RESULT_VERSION = "power-evidence-envelope-1.0.0-draft.1"

RELEASE_RESULT = """schemaVersion STRING, resultID STRING, createdAt STRING,
  benchmarkRelease STRING,
  execution STRUCT<sessionID:STRING,workloadID:STRING,workloadVersion:STRING,
    workloadCategory:STRING,fixtureSHA256:STRING,measurementModeID:STRING,runnerID:STRING,
    runnerVersion:STRING,appVersion:STRING,appBuild:STRING,appSourceCommit:STRING>,
  configuration STRING,
  model STRUCT<displayName:STRING,baseModelID:STRING,artifactID:STRING,artifactRevision:STRING,
    artifactContentHash:STRING,quantization:STRING,modelFormat:STRING,tokenizerIdentity:STRING>,
  runtime STRING,
  device STRUCT<displayName:STRING,machineIdentifier:STRING,systemName:STRING,
    systemVersion:STRING,systemBuild:STRING,physicalMemoryBytes:BIGINT>,
  environment STRUCT<buildConfiguration:STRING,debuggerAttached:BOOLEAN,
    lowPowerModeEnabled:BOOLEAN,batteryState:STRING,batteryLevelPercentAtStart:DOUBLE,
    thermalStateAtSessionStart:STRING,thermalStateAtSessionEnd:STRING>,
  modelPreparation STRUCT<artifactID:STRING,artifactRevision:STRING,
    downloadOccurredDuringSession:BOOLEAN,preparationCompleted:BOOLEAN,
    modelLoadCompleted:BOOLEAN,eligibleForPerformanceMeasurement:BOOLEAN>,
  attempts ARRAY<STRUCT<runIndex:BIGINT,role:STRING,outcome:STRING,stopReason:STRING,
    reasonCodes:ARRAY<STRING>,promptTokenCount:BIGINT,outputTokenCount:BIGINT,
    generatedText:STRING,
    tokenEvents:ARRAY<STRUCT<index:BIGINT,tokenID:BIGINT,elapsedNanoseconds:BIGINT>>,
    timingEvidence:STRUCT<generationStartNanoseconds:BIGINT,
      promptEvaluationNanoseconds:BIGINT,requestCompletionNanoseconds:BIGINT>,
    memorySamples:ARRAY<STRUCT<elapsedNanoseconds:BIGINT,physicalFootprintBytes:BIGINT>>,
    thermal:STRUCT<before:STRING,after:STRING>,
    renderabilityTrace:STRUCT<policyVersion:STRING,clockOrigin:STRING,scope:STRING,
      captureLimit:BIGINT,generationStartNanoseconds:BIGINT,outcome:STRING,
      firstRenderableTokenIndex:BIGINT,
      entries:ARRAY<STRUCT<tokenIndex:BIGINT,tokenID:BIGINT,tokenReceivedNanoseconds:BIGINT,
        decodedAtNanoseconds:BIGINT,decodedPrefix:STRING,isRenderable:BOOLEAN>>>,
    responseConformance:STRUCT<status:STRING,reasonCodes:ARRAY<STRING>>,
    derivedMetrics:STRUCT<pipelineTTFTMilliseconds:DOUBLE,
      firstRenderableProxyTTFTMilliseconds:DOUBLE,requestCompletionMilliseconds:DOUBLE,
      prefillTokensPerSecond:DOUBLE,decodeTokensPerSecond:DOUBLE,
      processPhysicalFootprintMiB:DOUBLE>>>,
  summary STRUCT<
    terminalCounts:STRUCT<completed:BIGINT,failed:BIGINT,cancelled:BIGINT,outOfMemory:BIGINT,
      notRun:BIGINT,earlyEOS:BIGINT>,
    metrics:STRUCT<medianPipelineTTFTMilliseconds:DOUBLE,
      medianFirstRenderableProxyTTFTMilliseconds:DOUBLE,
      medianRequestCompletionMilliseconds:DOUBLE,medianPrefillTokensPerSecond:DOUBLE,
      medianDecodeTokensPerSecond:DOUBLE,medianProcessPhysicalFootprintMiB:DOUBLE,
      decodeFirstToLastPercentChange:DOUBLE>>"""

REVIEW = """reviewID STRING, submissionID STRING, reviewedAt STRING, reviewType STRING,
  previousEvidenceLevel STRING, assignedEvidenceLevel STRING,
  submissionManifestSHA256 STRING, resultID STRING, resultSHA256 STRING,
  supportingSubmissionIDs ARRAY<STRING>"""


def closed(optional: tuple[str, ...] = (), **fields) -> dict:
    """Closed object schema; all fields required but the optional ones."""
    return {
        "type": "object",
        "additionalProperties": False,
        "required": [f for f in fields if f not in optional],
        "properties": fields,
    }


_TEXT = {"type": "string", "minLength": 1}
_MOMENT = {"type": "string", "format": "date-time"}
_SHA = {"type": "string", "pattern": "^[0-9a-f]{64}$"}
_COUNT = {"type": "integer", "minimum": 0}
_COUNT_OR_NULL = {"type": ["integer", "null"], "minimum": 0}
_FLAG = {"type": "boolean"}
_STATE = {"enum": ["nominal", "fair", "serious", "critical", "unknown"]}
_REFERENCE = closed(id=_TEXT, version=_TEXT, manifestSHA256=_SHA)


def submission_schema() -> dict:
    return closed(
        optional=("environmentNotes",),
        schemaVersion={"const": SUBMISSION_VERSION},
        submissionID={"type": "string", "format": "uuid"},
        createdAt={"type": "string", "format": "date-time"},
        contributor=closed(
            optional=("disclosure",),
            githubLogin=_TEXT,
            conflictOfInterest={"enum": ["none", "disclosed"]},
            disclosure={"type": ["string", "null"]},
        ),
        sourceResult=closed(path={"const": "result.json"}, sha256=_SHA, schemaVersion=_TEXT),
        declarations=closed(
            physicalDevice={"const": True},
            publicMetadataReviewed={"const": True},
            rawEvidenceUnmodified={"const": True},
            containsNoPersonalData={"const": True},
            licenseAccepted=_TEXT,
            rankingNotGuaranteed={"const": True},
        ),
        environmentNotes={"type": ["string", "null"]},
    )


def result_schema() -> dict:
    event = closed(
        index=_COUNT,
        tokenID={"type": "integer"},
        receivedNanoseconds=_COUNT,
        decodedAtNanoseconds=_COUNT_OR_NULL,
        decodedPrefix={"type": ["string", "null"]},
        isSpecial={"type": ["boolean", "null"]},
        isRenderable={"type": ["boolean", "null"]},
    )
    attempt = closed(
        optional=("failure",),
        index={"type": "integer", "minimum": 0, "maximum": 5},
        phase={"enum": ["warmup", "measured"]},
        outcome={"enum": ["succeeded", "failed", "cancelled", "oom", "not-run"]},
        startedAt=_MOMENT,
        endedAt=_MOMENT,
        monotonic=closed(
            clock={"const": "continuous-clock"},
            requestAcceptedNanoseconds=_COUNT,
            firstTokenNanoseconds=_COUNT_OR_NULL,
            firstRenderableNanoseconds=_COUNT_OR_NULL,
            completedNanoseconds=_COUNT_OR_NULL,
            promptEvaluationNanoseconds=_COUNT_OR_NULL,
            decodeNanoseconds=_COUNT_OR_NULL,
        ),
        tokenCounts=closed(input=_COUNT_OR_NULL, output=_COUNT),
        tokenEvents={"type": "array", "maxItems": 512, "items": event},
        generatedText={"type": ["string", "null"]},
        memory=closed(
            peakPhysicalFootprintBytes=_COUNT_OR_NULL,
            samples={
                "type": "array",
                "items": closed(elapsedNanoseconds=_COUNT, physicalFootprintBytes=_COUNT),
            },
        ),
        thermal=closed(
            start=_STATE,
            end=_STATE,
            transitions={
                "type": "array",
                "items": closed(elapsedNanoseconds=_COUNT, state=_STATE),
            },
        ),
        failure=closed(code=_TEXT, message=_TEXT) | {"type": ["object", "null"]},
    )
    succeeded = {"properties": {"outcome": {"const": "succeeded"}}}
    attempt |= {"if": succeeded, "then": {"properties": {"failure": {"type": "null"}}}}
    return closed(
        schemaVersion={"const": RESULT_VERSION},
        resultID={"type": "string", "format": "uuid"},
        createdAt={"type": "string", "format": "date-time"},
        productID={"const": "power"},
        program=_REFERENCE,
        target=_REFERENCE,
        runnerCertificateID=_TEXT,
        appRelease=closed(
            version=_TEXT, build=_TEXT, sourceRevision=_TEXT, embeddedMeasurementStackSHA256=_SHA
        ),
        model=closed(
            registryEntryID=_TEXT,
            registryEntrySHA256=_SHA,
            artifactID=_TEXT,
            artifactRevision=_TEXT,
            parameterCount={"type": "integer", "exclusiveMinimum": 0},
            quantization=_TEXT,
            format=_TEXT,
        ),
        runtime={"type": "object", "minProperties": 1},
        device=closed(machineIdentifier=_TEXT, osVersion=_TEXT, osBuild=_TEXT),
        environment=closed(
            batteryLevelAtStart={"type": ["number", "null"], "minimum": 0, "maximum": 1},
            batteryStateAtStart={"enum": ["unplugged", "charging", "full", "unknown"]},
            lowPowerModeAtStart=_FLAG,
            thermalStateAtStart=_STATE,
            thermalStateAtEnd=_STATE,
            thermalAssistance={
                "enum": ["none", "deliberate-cooling", "deliberate-heating", "other-assisted", "unknown"]
            },
        ),
        artifacts={
            "type": "array",
            # a package with any is refused by its contract, so a short one need not be named twice
            "items": closed(
                ("path", "sha256", "mediaType", "byteCount"),
                path=_TEXT, sha256=_SHA, mediaType=_TEXT, byteCount=_COUNT,
            ),
        },
        payload=closed(
            schemaVersion=_TEXT,
            workload=closed(id=_TEXT, version=_TEXT, sha256=_SHA),
            measurementMode=_TEXT,
            inferenceConfiguration={"type": "object"},
            attempts={
                "type": "array",
                "minItems": 6,
                "maxItems": 6,
                "items": attempt,
                # beside `items`, which behind listed ones would not look at these
                "allOf": [
                    {
                        "prefixItems": [
                            {
                                "properties": {
                                    "index": {"const": i},
                                    "phase": {"const": "warmup" if i == 0 else "measured"},
                                }
                            }
                            for i in range(6)
                        ]
                    }
                ],
            },
        ),
    )
