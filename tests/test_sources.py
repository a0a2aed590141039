"""Scans and sinks on small folders."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugework.operators.conformance import conformance_rows
from gaugework.operators.conformance import constraints_of
from gaugework.sources import listing
from gaugework.sources import packages as source
from gaugework.sources import sinks
from gaugework.sources.listing import list_entries


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_json_folder_splits_good_and_rejected(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{oops")
    (tmp_path / "d.json").write_bytes(b'{"x": "\xff"}')
    (tmp_path / "e.txt").write_text("ignored")
    good, rejected = source.read_json_files(spark, str(tmp_path))
    assert [r.path.split("/")[-1] for r in good.collect()] == ["a.json"]
    found = {r.path.split("/")[-1]: r.problem for r in rejected.collect()}
    assert found == {
        "b.json": "top-level-value-is-not-an-object",
        "c.json": "invalid-json",
        "d.json": "unreadable-text",
    }


def test_cases_fill_both_labels(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"caseID": "1", "response": "a", "expected": "pass"}\n\n{"caseID": "2", "response": "b", "expectedSemantic": "x", "expectedBehavior": "y"}\n')
    rows = {r.caseID: (r.expectedSemantic, r.expectedBehavior) for r in source.read_cases(spark, str(path)).collect()}
    assert rows == {"1": ("pass", "pass"), "2": ("x", "y")}


def test_embedded_result(spark):
    inner = {"schemaVersion": "v", "resultID": "r", "workload": {"id": "w"}, "model": {"artifactID": "a"}, "device": {"machineIdentifier": "m"}}
    raw = json.dumps(inner).encode()
    good = ("ok", "base64-json", "sha256", base64.b64encode(raw).decode(), sha(raw), "v", "r", "w", "a", "m")
    rows = [
        good,
        ("digest", *good[1:4], "0" * 64, *good[5:]),
        ("id", *good[1:6], "other", *good[7:]),
        ("bad", *good[1:3], "###", *good[4:]),
    ]
    frame = spark.createDataFrame(
        rows,
        "submission_id string, encoding string, digest_algorithm string, bundle string, sha256 string, "
        "schema_version string, result_id string, workload_id string, artifact_id string, machine_identifier string",
    )
    found = {r.submission_id: r.reasons for r in source.check_embedded(frame).collect()}
    assert found == {
        "ok": [], "digest": ["embedded-digest-mismatch"], "id": ["result-id-mismatch"], "bad": ["invalid-base64"],
    }


def test_pinned_documents(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "policy.json").write_text("{}")
    pins = lambda digest: spark.createDataFrame([("p/policy.json", digest)], "path string, sha256 string")
    rows = source.load_pinned(spark, str(tmp_path), pins(sha(b"{}"))).collect()
    assert rows[0].text == "{}"
    with pytest.raises(Exception, match="pinned document"):
        source.load_pinned(spark, str(tmp_path), pins("0" * 64)).collect()


def test_reviews_and_official_list(spark, tmp_path):
    folder = tmp_path / "reviews"
    folder.mkdir()
    (folder / "r1.json").write_text('{"reviewID": "r1", "submissionID": "s"}')
    (folder / "r2.json").write_text('{"reviewID": "zz", "submissionID": "s"}')
    (folder / "note.txt").write_text("x")
    (folder / "README.md").write_text("x")
    records, errors = source.read_reviews(spark, str(folder))
    assert {r.name: r.name_matches for r in records.collect()} == {"r1": True, "r2": False}
    assert [r.problem for r in errors.collect()] == ["unexpected-review-entry"]
    index = tmp_path / "index.json"
    entry = lambda i, raw: {"resultID": i, "source": {"rawPath": f"raw/{i}", "rawSHA256": raw, "finalValidationPath": "v", "finalValidationSHA256": "b"}}
    index.write_text(json.dumps({"results": [entry("1", "a"), entry("2", "x"), entry("3", "a")]}))
    files = spark.createDataFrame([("raw/1", "a"), ("raw/2", "a"), ("v", "b")], "path string, sha256 string")
    found = {r.resultID: r.problem for r in source.read_official_list(spark, str(index), files).collect()}
    assert found == {"1": None, "2": "raw-digest-mismatch", "3": "raw-result-missing"}


def test_written_dataset_and_checksums(spark, tmp_path):
    frame = spark.range(20).withColumn("part", F.col("id") % 2)
    sinks.write_dataset(frame, str(tmp_path / "t"), ["part"], ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    sinks.write_json_export(frame.coalesce(1), str(tmp_path / "j"), ["id"])
    rows = sinks.checksum_inventory(spark, str(tmp_path / "j")).where("file LIKE 'part%'").collect()
    for r in rows:
        data = next((tmp_path / "j").glob(r.file)).read_bytes()
        assert r.sha256 == sha(data)


SCHEMAS = [
    # (schema, document, expected messages)
    ({"type": "integer"}, "1.5", ["$.v: type"]),
    ({"type": "integer"}, "true", ["$.v: type"]),
    ({"type": ["integer", "null"]}, "null", []),
    ({"const": "a"}, '"b"', ["$.v: const"]),
    ({"enum": ["a", None]}, "null", []),
    ({"enum": [1, 2]}, "3", ["$.v: enum"]),
    ({"required": ["a"]}, '{"b": 1}', ["$.v: required a"]),
    ({"required": ["a"]}, '{"a": null}', []),
    ({"additionalProperties": False, "properties": {"a": {}}}, '{"a": 1, "b": 2}', ["$.v: additionalProperties"]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, '{"A": 1}', ["$.v: propertyNames"]),
    ({"minProperties": 1}, "{}", ["$.v: minProperties"]),
    ({"minimum": 2}, "1", ["$.v: minimum"]),
    ({"maximum": 2}, "2.5", ["$.v: maximum"]),
    ({"exclusiveMinimum": 0}, "0", ["$.v: exclusiveMinimum"]),
    ({"minimum": 2}, '"1"', []),
    ({"minLength": 2}, '"a"', ["$.v: minLength"]),
    ({"pattern": "^it's \\d$"}, '"it\'s 5"', []),
    ({"pattern": "^\\d$"}, '"x"', ["$.v: pattern"]),
    ({"format": "uuid"}, '"x"', ["$.v: format"]),
    ({"format": "date-time"}, '"2026-07-23T12:00:00Z"', []),
    ({"format": "date-time"}, '"2026-07-23T12:00:00"', ["$.v: format"]),
    ({"minItems": 1}, "[]", ["$.v: minItems"]),
    ({"maxItems": 1}, "[1, 2]", ["$.v: maxItems"]),
    ({"uniqueItems": True}, "[1, 1]", ["$.v: uniqueItems"]),
    ({"items": {"type": "string"}}, '["a", 1]', ["$.v[*]: type"]),
    ({"prefixItems": [{"const": 1}, {"const": 2}]}, "[1, 3]", ["$.v[1]: const"]),
    ({"prefixItems": [{"const": 1}], "items": {"type": "string"}}, '[1, "a", 2]', ["$.v[*]: type"]),
    ({"prefixItems": [{"const": 1}, {}], "items": {"type": "string"}}, "[1]", []),
    ({"prefixItems": [{"const": 1}], "items": False}, "[1, 2]", ["$.v: items"]),
    ({"prefixItems": [{"const": 1}], "items": False}, "[1]", []),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}}, '{"a": 1, "b": 2}', ["$.v: additionalProperties"]),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}}, '{"a": 1, "b": "x"}', []),
    ({"additionalProperties": {"items": {"minimum": 2}}}, '{"b": [1]}', ["$.v: additionalProperties"]),
    ({"format": "date-time"}, '"2026-13-01T12:00:00Z"', ["$.v: format"]),
    ({"format": "date-time"}, '"2026-02-29T12:00:00Z"', ["$.v: format"]),
    ({"format": "date-time"}, '"2024-02-29T23:59:59.5+05:30"', []),
    ({"format": "date-time"}, '"2026-02-01T24:00:00Z"', ["$.v: format"]),
    ({"format": "date-time"}, '"2026-02-01T12:60:00Z"', ["$.v: format"]),
    ({"format": "date-time"}, "5", []),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, "4", ["$.v: allOf"]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, "2", ["$.v: oneOf"]),
    ({"if": {"minimum": 5}, "then": {"maximum": 7}, "else": {"const": 1}}, "8", ["$.v: if"]),
    ({"if": {"minimum": 5}, "then": {"maximum": 7}, "else": {"const": 1}}, "1", []),
    ({"$ref": "#/$defs/x"}, "1", ["$.v: type"]),
]


def test_schema_keywords(spark):
    for schema, text, expected in SCHEMAS:
        root = {"type": "object", "properties": {"v": schema}, "$defs": {"x": {"type": "string"}}}
        frame = spark.createDataFrame([(f'{{"v": {text}}}',)], "text string")
        rows = conformance_rows(frame, [], "text", constraints_of(root)).collect()
        assert [r.message for r in rows] == expected, (schema, text)


def test_text_that_is_no_object(spark):
    frame = spark.createDataFrame([("[1]",), ("{bad",)], "text string")
    rows = conformance_rows(frame, ["text"], "text", constraints_of({"type": "object"})).collect()
    assert {r.message for r in rows} == {"$: not a JSON object"} and len(rows) == 2


def test_listing_sees_hidden_names_empty_folders_and_links(spark, tmp_path):
    root = tmp_path / "draft"

    def package(name, *files):
        (root / name).mkdir(parents=True)
        for file in files:
            path = root / name / file
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"{name}/{file}")

    both = ("result.json", "submission.json")
    package("good", *both)
    package("hidden", *both, ".DS_Store")
    package("marked", *both, "_notes.md")
    package("nested", *both, "sub/deep/result.json")
    package("hollow", *both)
    (root / "hollow" / "sub").mkdir()
    package("empty")
    package(".quiet", *both)
    package("_half", "result.json")
    package("linked", "result.json")
    (root / "linked" / "submission.json").symlink_to(root / "good" / "submission.json")
    (root / ".loose").write_text("x")
    (root / "README.md").write_text("x")
    found = list_entries(spark, str(root), folders_per_task=2)
    assert found.count() == len({(r.folder, r.file) for r in found.collect()})
    valid = {r.package_id: r.file_set_valid for r in source.package_files(spark, str(root), found).collect()}
    assert valid == {
        "good": True, ".quiet": True, "hidden": False, "marked": False, "nested": False, "hollow": False,
        "empty": False, "_half": False, "linked": False,
    }
    stray = {r.path.removeprefix(f"{root}/"): r.reason for r in source.unexpected_files(spark, str(root), found).collect()}
    extra = "unexpected-package-file"
    assert stray == {
        ".loose": "unexpected-entry", "hidden/.DS_Store": extra, "marked/_notes.md": extra,
        "nested/sub/deep/result.json": extra, "hollow/sub": extra, "linked/submission.json": "package-entry-is-not-a-file",
    }
    rows = {r.package_id: r for r in source.read_packages(spark, f"file://{root}", None).collect()}
    assert rows.keys() == valid.keys()
    assert bytes(rows[".quiet"].result) == b".quiet/result.json" and bytes(rows["hidden"].submission) == b"hidden/submission.json"
    assert rows["empty"].result is None and rows["_half"].submission is None and rows["linked"].submission is None


def test_listing_of_an_empty_root(spark, tmp_path):
    assert list_entries(spark, str(tmp_path)).count() == 0
    assert source.read_packages(spark, str(tmp_path)).count() == 0


def test_bytes_are_read_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "BATCH_BYTES", 10)
    for n in range(7):
        (tmp_path / f"f{n}").write_text("x" * n)
    paths = spark.createDataFrame([(n, f"{tmp_path}/f{n}" if n != 3 else None) for n in range(7)], "n int, p string").coalesce(1)
    rows = listing.read_bytes(paths, ["n"], {"data": "p"}).collect()
    assert {r.n: r.data and len(r.data) for r in rows} == {0: b"", 1: 1, 2: 2, 3: None, 4: 4, 5: 5, 6: 6}
