"""Golden package, one-field mutations, duplicates and contributor states."""

import hashlib
import json

import pytest

from gaugework.plans import evidence_ranking as ranking
from gaugework.sources import packages as source
from gaugework.sources.sinks import run_report
from tests import builders


def _set(path, value):
    def change(document):
        node = document
        for part in path[:-1]:
            node = node[part]
        node[path[-1]] = value

    return change


MUTATIONS = {
    # name: (change of the result, expected reason)
    "peak": (_set(["payload", "attempts", 2, "memory", "peakPhysicalFootprintBytes"], 1), "raw-attempt-inconsistent"),
    "first": (_set(["payload", "attempts", 2, "monotonic", "firstTokenNanoseconds"], 99), "raw-attempt-inconsistent"),
    "renderable": (_set(["payload", "attempts", 2, "tokenEvents", 1, "isRenderable"], False), "raw-attempt-inconsistent"),
    "order": (_set(["payload", "attempts", 2, "tokenEvents", 5, "receivedNanoseconds"], 5), "raw-attempt-inconsistent"),
    "index": (_set(["payload", "attempts", 2, "tokenEvents", 5, "index"], 9), "raw-attempt-inconsistent"),
    "late probe": (
        lambda d: d["payload"]["attempts"][2]["tokenEvents"][4].update(
            decodedAtNanoseconds=400, decodedPrefix="x", isSpecial=False, isRenderable=True
        ),
        "raw-attempt-inconsistent",
    ),
    "partial probe": (_set(["payload", "attempts", 2, "tokenEvents", 4, "decodedPrefix"], "x"), "raw-attempt-inconsistent"),
    "thermal end": (_set(["payload", "attempts", 2, "thermal", "end"], "fair"), "raw-attempt-inconsistent"),
    "timing": (_set(["payload", "attempts", 2, "monotonic", "promptEvaluationNanoseconds"], 0), "invalid-monotonic-timing"),
    "program": (_set(["program", "version"], "3"), "program-or-target-digest-mismatch"),
    "model": (_set(["model", "registryEntryID"], "other"), "model-artifact-not-registered"),
    "model identity": (_set(["model", "quantization"], "8bit"), "model-artifact-identity-mismatch"),
    "mode": (_set(["payload", "measurementMode"], "x"), "measurement-mode-mismatch"),
    "inference": (_set(["payload", "inferenceConfiguration", "temperature"], 1), "inference-configuration-mismatch"),
    "runtime": (_set(["runtime", "version"], "9"), "runner-runtime-identity-mismatch"),
    "app": (_set(["appRelease", "build"], "9"), "app-release-not-supported"),
    "schema": (_set(["payload", "attempts", 1, "phase"], "warmup"), "invalid-envelope"),
    "extra key": (_set(["device", "extra"], "x"), "invalid-envelope"),
    "float integer": (_set(["model", "parameterCount"], 600.5), "invalid-envelope"),
    "version": (_set(["schemaVersion"], "old"), "unsupported-major-version"),
    "artifacts": (_set(["artifacts"], [{"path": "x"}]), "unsupported-external-artifacts"),
}


@pytest.fixture(scope="module")
def decided(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    names = {}
    names["golden"] = builders.write_package(root, 0, builders.result(1))
    names["copy"] = builders.write_package(root, 1, builders.result(1), "bob")
    for i, (name, (change, _)) in enumerate(MUTATIONS.items()):
        body = builders.result(100 + i)
        change(body)
        names[name] = builders.write_package(root, 10 + i, body)
    names["tampered"] = builders.write_package(
        root, 200, builders.result(200), change=_set(["sourceResult", "sha256"], "0" * 64)
    )
    names["disclosed"] = builders.write_package(
        root, 201, builders.result(201), change=_set(["contributor", "conflictOfInterest"], "disclosed")
    )
    hot = builders.result(202)
    hot["environment"]["batteryLevelAtStart"] = 0.1
    names["low battery"] = builders.write_package(root, 202, hot)
    failed = builders.result(203)
    for i in (1, 2, 3):
        failed["payload"]["attempts"][i]["outcome"] = "failed"
    names["failed attempts"] = builders.write_package(root, 203, failed)
    rude = builders.result(204)
    rude["payload"]["attempts"][1]["generatedText"] = "The note was deleted."
    names["contradicted"] = builders.write_package(root, 204, rude)
    folder = root / builders.write_package(root, 205, builders.result(205))
    (folder / "notes.txt").write_text("x")
    names["extra file"] = folder.name
    broken = root / builders.write_package(root, 206, builders.result(206))
    (broken / "result.json").write_text("{not json")
    names["broken"] = broken.name
    nested = root / builders.write_package(root, 207, builders.result(207))
    (nested / "sub").mkdir()
    (nested / "sub" / "result.json").write_text("{}")
    names["nested entry"] = nested.name
    (root / "README.md").write_text("listing")
    (root / "stray.txt").write_text("x")
    packages = source.with_declared_author(source.read_packages(spark, str(root)))
    frame = ranking.decide(packages, builders.models(spark), builders.trusted())
    rows = {r.package_id: r for r in frame.collect()}
    return root, frame, {n: rows[p] for n, p in names.items()}


def test_golden_package(decided):
    _, _, rows = decided
    row = rows["golden"]
    assert row.classification == "auto-accept" and row.reason_codes == []
    assert row.behaviour == "pass"
    values = {m.metric_id: m for m in row.metrics}
    assert values["first_renderable_ms"].value == pytest.approx(54.0)
    assert values["pipeline_ttft_ms"].value == pytest.approx(41.0)
    assert values["request_completion_ms"].value == pytest.approx(150.0)
    assert values["prefill_tokens_per_second"].value == pytest.approx(2500.0)
    assert values["decode_tokens_per_second"].value == pytest.approx(80.0)
    assert values["peak_physical_footprint_mib"].value == pytest.approx(625.0)
    assert values["decode_first_to_last_percent_change"].status == "not-applicable"


@pytest.mark.parametrize("name", MUTATIONS)
def test_one_field_mutation_is_rejected(decided, name):
    row = decided[2][name]
    assert row.classification == "reject"
    assert MUTATIONS[name][1] in row.reason_codes


def test_integrity(decided):
    rows = decided[2]
    assert rows["copy"].reason_codes == ["duplicate-result-sha256"]
    assert "result-digest-mismatch" in rows["tampered"].reason_codes
    assert rows["disclosed"].classification == "manual-review"
    assert "submission-package-file-set-invalid" in rows["extra file"].reason_codes
    assert "submission-package-file-set-invalid" in rows["nested entry"].reason_codes
    assert "invalid-envelope" in rows["broken"].reason_codes


def test_ineligible_evidence_is_retained(decided):
    rows = decided[2]
    low = rows["low battery"]
    assert low.classification == "auto-accept"
    assert all(m.status == "not-applicable" for m in low.metrics)
    few = {m.metric_id: m for m in rows["failed attempts"].metrics}
    assert rows["failed attempts"].classification == "auto-accept"
    assert few["decode_tokens_per_second"].reason_codes == ["insufficient-successful-measured-attempts"]


def test_behaviour_never_gates_performance(decided):
    row = decided[2]["contradicted"]
    assert row.behaviour == "fail" and row.classification == "auto-accept"
    assert {m.metric_id: m.status for m in row.metrics}["first_renderable_ms"] == "pass"


def test_run_report_and_strays(spark, decided):
    root, frame, rows = decided
    report = run_report(frame).collect()[0]
    assert report.input == len(rows) == report.accepted + report.manual_review + report.rejected
    stray = {r.path.split("/")[-1]: r.reason for r in source.unexpected_files(spark, str(root)).collect()}
    assert stray == {
        "stray.txt": "unexpected-entry",
        "notes.txt": "unexpected-package-file",
        "result.json": "unexpected-package-file",
    }


def test_closed_intake_rejects(spark, tmp_path):
    builders.write_package(tmp_path, 0, builders.result(1))
    packages = source.with_declared_author(source.read_packages(spark, str(tmp_path)))
    row = ranking.decide(packages, builders.models(spark), builders.trusted(intake_open=False)).collect()[0]
    assert row.classification == "reject" and row.reason_codes == ["public-intake-closed"]


def test_contributor_states_and_identity(spark, tmp_path):
    logins = ["Alice", "alice", "Bob", "Carol"]
    for i, login in enumerate(logins):
        builders.write_package(tmp_path, i, builders.result(i + 1), login)
    packages = source.with_declared_author(source.read_packages(spark, str(tmp_path)))
    _, views = ranking.rank_packages(packages, builders.models(spark), builders.trusted())
    rows = views.collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.contributor_count, row.submission_count) == (3, 4)
    assert row.evidence_state == "contributor-weighted" and row["rank"] == 1
    body = builders.result(1)
    identity = {
        "programID": "text", "programVersion": "2", "targetID": "phone", "targetVersion": "1",
        "runnerCertificateID": "runner-1", "workloadID": "power.text.short-interaction",
        "workloadVersion": "1", "measurementMode": "interactive", "modelArtifactID": "org/model",
        "modelArtifactRevision": "r1", "quantization": "4bit", "runtimeIdentity": body["runtime"],
        "machineIdentifier": "phone15,3", "osVersion": "26.5", "osBuild": "A1",
        "inferenceConfiguration": body["payload"]["inferenceConfiguration"],
    }
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"))
    assert row.comparison_id == hashlib.sha256(text.encode()).hexdigest()
