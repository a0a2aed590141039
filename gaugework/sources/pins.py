"""The pinned measurement stack: documents that name further documents by path and digest.

A pointer pins a stack, the stack a program, a target, policies, a registry and a
certificate, the program its contract, workloads and schemas, the registry its
models.  Every pinned file is read by the task that has its path, and its digest
is compared before any of its pins is followed, so nothing is built on a
document that was changed, however far down.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators.document_tree import document_nodes
from gaugework.operators.integrity import fixed_rows
from gaugework.plans.evidence_ranking import Trusted
from gaugework.session import materialize
from gaugework.sources.listing import read_bytes

# ---- fixed values: which pins of a document are followed -------------------
FOLLOWED = (
    # role of the document, place of the pin, role of what it names
    ("pointer", r"^\$\.measurementStack$", "stack"),
    ("pointer", r"^\$\.appRelease$", "app-release"),
    ("stack", r"^\$\.program$", "program"),
    ("stack", r"^\$\.target$", "target"),
    ("stack", r"^\$\.policies\.(runner|intake|ranking)$", "policy"),
    ("stack", r"^\$\.models\.registry$", "registry"),
    ("stack", r"^\$\.runnerCertificate$", "certificate"),
    ("program", r"^\$\.assets\[\d+\]$", "asset"),
    ("registry", r"^\$\.entries\[\d+\]$", "model"),
)
REQUIRED = (
    ("pointer", "$.measurementStack"),
    ("stack", "$.program"),
    ("stack", "$.target"),
    ("stack", "$.policies.runner"),
    ("stack", "$.policies.intake"),
    ("stack", "$.policies.ranking"),
    ("stack", "$.models.registry"),
)
ONE_ASSET = ("program-contract", "evidence-envelope-schema", "submission-schema", "validation-report-schema")
CURRENT = {"schemaVersion": "power-stack-pointer-1.0.0", "status": "active", "publicIntakeOpen": True}
CANDIDATE = {
    "schemaVersion": "power-stack-pointer-1.0.0-draft.1",
    "status": "migration-draft",
    "publicIntakeOpen": False,
    "appRelease": None,
}
PIN = "role STRING, path STRING, sha256 STRING, source STRING, place STRING, reference STRING"


class PinError(ValueError):
    """A pinned stack that can't be trusted."""


def pinned_closure(spark: SparkSession, root: str, pointer: str) -> DataFrame:
    """Every document the pointer's stack rests on, one row a pin, level by level.

    role, path, sha256, text, source (document with the pin), place (of the pin
    in it), reference (the pin's own JSON), depth.  Raises PinError for a pin
    without path and digest, a path that leaves the root, and a file that is
    missing or has another digest.  A document that several pins name is read
    once a level and followed once.
    """
    follow = fixed_rows(spark, ["role", "rule", "next_role"], list(FOLLOWED))
    pins = spark.createDataFrame([("pointer", pointer, None, None, "$", None)], PIN)
    levels: list[DataFrame] = []
    while True:
        level = _read_level(root, pins).withColumn("depth", F.lit(len(levels)))
        met = level.select("role", "path", "text").dropDuplicates(["role", "path"])
        for earlier in levels:
            met = met.join(earlier.select("role", "path"), ["role", "path"], "left_anti")
        levels.append(level)
        pins = materialize(_pins_of(met, follow))
        if pins.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _pins_of(documents: DataFrame, follow: DataFrame) -> DataFrame:
    nodes = document_nodes(documents.withColumnRenamed("path", "source"), ["role", "source"], "text")
    followed = nodes.where("kind <> 'null'").join(follow, "role").where(F.regexp_like("path", F.col("rule")))
    part = lambda name: F.get_json_object("value", f"$.{name}")
    return followed.select(
        F.col("next_role").alias("role"),
        part("path").alias("path"),
        part("sha256").alias("sha256"),
        "source",
        F.col("path").alias("place"),
        F.col("value").alias("reference"),
    )


def _read_level(root: str, pins: DataFrame) -> DataFrame:
    """The pins with the text of their files; raises if any of them can't be trusted."""
    pinned = F.col("path").isNotNull() & (F.col("sha256").isNotNull() | (F.col("role") == "pointer"))
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    shape = F.when(~pinned, "not a pinned reference").when(unsafe, "unsafe path")
    _refuse(pins.withColumn("problem", shape))
    files = pins.select("path", F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("at")).distinct()
    read = read_bytes(files, ["path"], {"content": "at"}, missing_as_null=True).select(
        "path",
        F.sha2("content", 256).alias("actual"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    )
    both = materialize(pins.join(read, "path", "left"))
    changed = F.when(F.col("actual").isNull(), "document is missing").when(
        F.col("sha256") != F.col("actual"), "digest mismatch"
    )
    _refuse(both.withColumn("problem", changed))
    return both.select(*pins.columns, "text")


def _refuse(pins: DataFrame) -> None:
    wrong = pins.where("problem IS NOT NULL").select("source", "place", "path", "problem").orderBy("source", "place").limit(5)
    said = [f"{r.source or 'pointer'} {r.place}: {r.problem} ({r.path})" for r in wrong.collect()]
    if said:
        raise PinError("; ".join(said))


def registered_models(closure: DataFrame) -> DataFrame:
    """Model registry rows for `decide`, from the pinned manifests."""
    part = lambda name: F.get_json_object("text", f"$.{name}")
    return closure.where("role = 'model'").select(
        F.get_json_object("reference", "$.registryEntryID").alias("entry_id"),
        "sha256",
        part("artifactID").alias("artifact_id"),
        part("artifactRevision").alias("artifact_revision"),
        part("parameterCount").cast("long").alias("parameter_count"),
        part("quantization").alias("quantization"),
        part("format").alias("format"),
    )


def load_trusted(spark: SparkSession, root: str, current: str, candidate: str, **more: Any) -> tuple[Trusted, DataFrame]:
    """(stack, models) that a run validates against, from the pinned documents below `root`.

    The `current` pointer counts if it is there, and must be active and open;
    before it is issued the `candidate` does, and must be closed.  `more` goes to
    Trusted (validator_revision, evaluated_at).
    """
    wanted = spark.createDataFrame([(current, f"{root.rstrip('/')}/{current}")], "path STRING, at STRING")
    issued = read_bytes(wanted, ["path"], {"content": "at"}, missing_as_null=True).first().content is not None
    closure = materialize(pinned_closure(spark, root, current if issued else candidate))
    # Without the models, whose number may grow, a stack is a few documents.
    rows = [r.asDict() for r in closure.where("role <> 'model'").collect()]
    return _trusted(rows, CURRENT if issued else CANDIDATE, more), registered_models(closure)


def _trusted(rows: list[dict], expected: dict, more: dict) -> Trusted:
    documents = {r["role"]: _object(r) for r in rows if r["role"] not in ("asset", "policy")}
    pins = {(r["role"], r["place"]): json.loads(r["reference"]) for r in rows if r["reference"]}
    pointer, program = documents["pointer"], documents.get("program", {})
    if any(pointer.get(k) != v for k, v in expected.items()) or (
        expected is CURRENT and not isinstance(pointer.get("appRelease"), dict)
    ):
        raise PinError("the pointer is neither an active one nor a closed candidate")
    found = {(r["source_role"], r["place"]) for r in _with_source(rows)}
    missing = [f"{role} {place}" for role, place in REQUIRED if (role, place) not in found]
    if missing:
        raise PinError("missing pins: " + ", ".join(missing))
    assets = [r for r in rows if r["role"] == "asset"]
    by_role = lambda role: [r for r in assets if json.loads(r["reference"]).get("role") == role]
    for role in ONE_ASSET:
        if len(by_role(role)) != 1:
            raise PinError(f"program {program.get('programID')} must pin exactly one {role}")
    contract = _object(by_role("program-contract")[0])
    stack_pin = pins["stack", "$.measurementStack"]
    certificate, app = documents.get("certificate"), documents.get("app-release")
    admission = documents["target"].get("ordinaryRankingAdmission", {})
    return Trusted(
        program=_identity(pins["program", "$.program"]),
        target=_identity(pins["target", "$.target"]),
        workloads=[_workload(w, assets) for w in contract.get("workloads", [])],
        certificate=certificate
        and {
            "state": certificate.get("state"),
            "id": certificate.get("certificateID"),
            "program_sha256": certificate.get("programManifestSHA256"),
            "target_sha256": certificate.get("targetManifestSHA256"),
            "runtime": json.dumps(certificate["runtime"]) if isinstance(certificate.get("runtime"), dict) else None,
        },
        app_release=app
        and {
            "state": app.get("state"),
            "version": app.get("version"),
            "build": app.get("build"),
            "source_revision": app.get("sourceRevision"),
            "certificate_ids": app.get("supportedRunnerCertificateIDs", []),
        },
        stack_sha256=stack_pin["sha256"],
        intake_open=pointer.get("publicIntakeOpen") is True,
        intake_policy_sha256=pins["policy", "$.policies.intake"]["sha256"],
        admission={
            "battery_state": admission.get("batteryStateAtStart"),
            "minimum_battery_percent": admission.get("minimumBatteryPercentAtStart"),
            "low_power_mode": admission.get("lowPowerModeAtStart"),
            "start_thermal_states": tuple(admission.get("allowedThermalStatesAtStart", ())),
            "thermal_assistance": admission.get("thermalAssistance"),
        },
        submission_schema=_object(by_role("submission-schema")[0]),
        result_schema=_object(by_role("evidence-envelope-schema")[0]),
        **more,
    )


def _with_source(rows: list[dict]) -> list[dict]:
    roles = {r["path"]: r["role"] for r in rows}
    return [{**r, "source_role": roles.get(r["source"])} for r in rows]


def _object(row: dict) -> dict:
    """A trusted document; all of them are JSON objects."""
    try:
        document = json.loads(row["text"] or "")
    except ValueError:
        document = None
    if not isinstance(document, dict):
        raise PinError(f"trusted document is not an object: {row['path']}")
    return document


def _identity(pin: dict) -> tuple[str, str, str]:
    return pin.get("id"), pin.get("version"), pin["sha256"]


def _workload(named: dict, assets: list[dict]) -> tuple[str, str, str, str, str]:
    pinned = [a for a in assets if a["path"] == named.get("path")]
    if not pinned or not isinstance(named.get("id"), str):
        raise PinError(f"workload is not pinned by the program: {named.get('path')}")
    document = _object(pinned[0])
    return (
        named["id"],
        document.get("workloadVersion"),
        pinned[0]["sha256"],
        document.get("measurementMode"),
        json.dumps(document.get("generation")),
    )
