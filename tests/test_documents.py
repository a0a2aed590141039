"""JSON documents as paths, their comparison, and the pinned stack."""

import hashlib
import json

import pytest

from gaugework import schemas
from gaugework.operators.document_tree import compare_documents, document_nodes
from gaugework.plans import evidence_ranking as ranking
from gaugework.sources import packages as source
from gaugework.sources import pins
from tests import builders

DOCUMENT = {"a": [1, {"b.c": "é", "d": None}], "e": {}, "f": [], "g": {"h": {"i": True, "j": -2.5}}, 'q"': "x", "": 0}


def plain_nodes(value, path="$"):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
    yield path, kinds[type(value)]
    plain = lambda k: k.isascii() and k.replace("_", "a").isalnum() and not k[:1].isdigit()
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from plain_nodes(inner, f"{path}.{key}" if key and plain(key) else f"{path}[{json.dumps(key, ensure_ascii=False)}]")
    if isinstance(value, list):
        for n, inner in enumerate(value):
            yield from plain_nodes(inner, f"{path}[{n}]")


def test_nodes_of_documents(spark):
    deep = json.loads("[" * 30 + "]" * 30)
    rows = [(1, json.dumps(DOCUMENT)), (2, "{oops"), (3, None), (4, "7"), (5, json.dumps(deep)), (1, '{"a": 1}')]
    frame = spark.createDataFrame(rows, "n int, text string")
    found = sorted((r.n, r.path, r.kind) for r in document_nodes(frame, ["n"], "text").collect())
    want = [(2, "$", "invalid"), (3, "$", "invalid")]
    want += [(n, *node) for n, text in rows if n not in (2, 3) for node in plain_nodes(json.loads(text))]
    assert found == sorted(want)
    assert document_nodes(frame.limit(0), ["n"], "text").count() == 0


def test_documents_compared_path_by_path(spark):
    old = {"v": 1, "m": {"x": 1.5, "y": [1, 2, 3]}, "n": None, "s": "1", "e": {}, "big": 1e300}
    new = {"v": 1.0, "m": {"x": 1.25, "y": [1, 2]}, "n": "null", "s": 1, "e": [], "big": 1e300, "z": False}
    left = [("r", json.dumps(old)), ("same", '{"b": 1, "a": 2}'), ("gone", '{"k": 1}'), ("bad", "{")]
    right = [("r", json.dumps(new)), ("same", '{"a":2,"b":1}'), ("came", "[]"), ("bad", "{}")]
    frames = [spark.createDataFrame(rows, "id string, text string") for rows in (left, right)]
    found = {(r.id, r.path): (r.problem, r.left, r.right) for r in compare_documents(*frames, ["id"], "text").collect()}
    assert found == {
        ("r", "$.m.x"): ("changed", "1.5", "1.25"), ("r", "$.m.y[2]"): ("missing", "3", None),
        ("r", "$.n"): ("changed", "null", '"null"'), ("r", "$.s"): ("changed", '"1"', "1"),
        ("r", "$.e"): ("changed", "{}", "[]"), ("r", "$.z"): ("unexpected", None, "false"),
        ("gone", "$.k"): ("missing", "1", None), ("came", "$"): ("unexpected", None, "[]"), ("bad", "$"): ("changed", None, "{}"),
    }


def digest(data):
    return hashlib.sha256(data).hexdigest()


class Stack:
    """A pinned stack written below a root; documents are dealt digests from the leaves up."""

    def __init__(self, root):
        self.root = root

    def write(self, path, document):
        data = document if isinstance(document, bytes) else json.dumps(document).encode()
        (self.root / path).parent.mkdir(parents=True, exist_ok=True)
        (self.root / path).write_bytes(data)
        return {"path": path, "sha256": digest(data)}

    def build(self, **changes):
        modes = {"power.text.short-interaction": "interactive", "power.text.sustained-generation": "sustained"}
        works = {
            name: self.write(
                f"p/{name}.json", {"workloadVersion": "1", "measurementMode": mode, "generation": builders.GENERATION}
            )
            for name, mode in modes.items()
        }
        contract = {"workloads": [{"id": name, "path": pin["path"]} for name, pin in works.items()]}
        assets = [
            {"role": "program-contract", **self.write("p/contract.json", contract)},
            *[{"role": "workload", **pin} for pin in works.values()],
            {"role": "evidence-envelope-schema", **self.write("p/e.json", schemas.result_schema())},
            {"role": "submission-schema", **self.write("p/s.json", schemas.submission_schema())},
            {"role": "validation-report-schema", **self.write("p/v.json", {})},
            {"role": "fixture", **self.write("p/prompt.txt", b"\xff not text")},
        ]
        program = {"id": "text", "version": "2", **self.write("p/manifest.json", {"programID": "text", "assets": changes.get("assets", assets)})}
        admission = {
            "batteryStateAtStart": "unplugged", "minimumBatteryPercentAtStart": 30, "lowPowerModeAtStart": False,
            "allowedThermalStatesAtStart": ["nominal"], "thermalAssistance": "none",
        }
        target = {"id": "phone", "version": "1", **self.write("t/manifest.json", {"ordinaryRankingAdmission": admission})}
        model = {
            "artifactID": "org/model", "artifactRevision": "r1", "parameterCount": 600, "quantization": "4bit", "format": "mlx",
            "weights": [{"path": "not/here.bin", "sha256": "0" * 64}],
        }
        self.model = self.write("m/one.json", model)
        registry = self.write("m/registry.json", {"entries": [{"registryEntryID": "entry-1", **self.model}]})
        certificate = {
            "state": "active", "certificateID": "runner-1", "programManifestSHA256": program["sha256"],
            "targetManifestSHA256": target["sha256"], "runtime": builders.RUNTIME,
        }
        stack = {
            "program": program, "target": target, "models": {"registry": registry},
            "policies": {n: self.write(f"pol/{n}.json", {"n": n}) for n in ("runner", "intake", "ranking")},
            "runnerCertificate": self.write("c.json", certificate),
        }
        stack |= changes.get("stack", {})
        app = {
            "state": "supported", "version": "2.0", "build": "1", "sourceRevision": "abc",
            "supportedRunnerCertificateIDs": ["runner-1"],
        }
        self.stack = self.write("stack.json", stack)
        pointer = {
            "schemaVersion": "power-stack-pointer-1.0.0", "status": "active", "publicIntakeOpen": True,
            "measurementStack": self.stack, "appRelease": self.write("app.json", app), "unfollowed": {"path": "gone", "sha256": "0"},
        }
        self.program, self.target = program, target
        self.write("current.json", pointer | changes.get("pointer", {}))
        return self

    def load(self, spark):
        return pins.load_trusted(spark, str(self.root), "current.json", "candidate.json")


def test_trusted_stack_comes_from_its_pins(spark, tmp_path):
    stack = Stack(tmp_path).build()
    trusted, models = stack.load(spark)
    by_hand = builders.trusted(
        program=("text", "2", stack.program["sha256"]), target=("phone", "1", stack.target["sha256"]), stack_sha256=stack.stack["sha256"]
    )
    assert (trusted.program, trusted.target, trusted.app_release) == (by_hand.program, by_hand.target, by_hand.app_release)
    assert [w[:2] + w[3:] for w in trusted.workloads] == [w[:2] + w[3:] for w in by_hand.workloads]
    assert trusted.certificate["runtime"] == by_hand.certificate["runtime"] and trusted.admission == by_hand.admission
    assert trusted.intake_open and trusted.intake_policy_sha256 == digest(b'{"n": "intake"}')
    assert [tuple(r) for r in models.collect()] == [("entry-1", stack.model["sha256"], "org/model", "r1", 600, "4bit", "mlx")]
    closure = pins.pinned_closure(spark, str(tmp_path), "current.json").collect()
    assert {r.depth for r in closure} == {0, 1, 2, 3} and len(closure) == 1 + 2 + 7 + 7 + 1
    # a package that names this stack is accepted, with the digests of the written documents
    body = builders.result(1)
    body["program"]["manifestSHA256"], body["target"]["manifestSHA256"] = stack.program["sha256"], stack.target["sha256"]
    body["appRelease"]["embeddedMeasurementStackSHA256"] = stack.stack["sha256"]
    body["model"]["registryEntrySHA256"] = stack.model["sha256"]
    body["payload"]["workload"]["sha256"] = trusted.workloads[0][2]
    builders.write_package(tmp_path / "draft", 0, body)
    packages = source.with_declared_author(source.read_packages(spark, str(tmp_path / "draft")))
    row = ranking.decide(packages, models, trusted).collect()[0]
    assert (row.classification, row.reason_codes) == ("auto-accept", [])


@pytest.mark.parametrize("path", ["stack.json", "p/manifest.json", "p/power.text.short-interaction.json", "m/one.json", "p/prompt.txt"])
def test_a_changed_document_stops_the_job_however_deep(spark, tmp_path, path):
    stack = Stack(tmp_path).build()
    (tmp_path / path).write_bytes((tmp_path / path).read_bytes() + b" ")
    with pytest.raises(pins.PinError, match=f"digest mismatch .{path}"):
        stack.load(spark)
    (tmp_path / path).unlink()
    with pytest.raises(pins.PinError, match="document is missing"):
        stack.load(spark)


def test_stacks_that_cannot_be_trusted(spark, tmp_path):
    def refused(message, **changes):
        with pytest.raises(pins.PinError, match=message):
            Stack(tmp_path).build(**changes).load(spark)

    refused("not a pinned reference", stack={"target": {"path": "t/manifest.json"}})
    refused("unsafe path", stack={"target": {"path": "../t", "sha256": "0"}})
    refused("unsafe path", stack={"target": {"path": "/etc/hosts", "sha256": "0"}})
    refused("missing pins: stack .*policies.intake", stack={"policies": {"runner": None, "ranking": None}})
    refused("exactly one program-contract", assets=[])
    refused("neither an active", pointer={"publicIntakeOpen": False})
    refused("neither an active", pointer={"appRelease": None})
    # a closed candidate counts only while there is no current pointer
    Stack(tmp_path).build()
    pointer = json.loads((tmp_path / "current.json").read_text())
    (tmp_path / "current.json").unlink()
    closed = pointer | {"schemaVersion": "power-stack-pointer-1.0.0-draft.1", "status": "migration-draft", "publicIntakeOpen": False, "appRelease": None}
    (tmp_path / "candidate.json").write_text(json.dumps(closed))
    trusted, _ = Stack(tmp_path).load(spark)
    assert not trusted.intake_open and trusted.app_release is None
