"""Reviews over packages against a sequential pass, as-of joins, stored reports."""

import hashlib
import json
import random

import pytest

from gaugework import rules
from gaugework.operators.ordered import as_of
from gaugework.operators.reports import verify_reports
from gaugework.plans import review_pipeline as pipeline
from gaugework.sources import packages as source


def _asof_rows(seed):
    rng = random.Random(seed)
    left = [(n, rng.choice("abh") if rng.random() < 0.3 else "h", rng.choice([None, *range(40)])) for n in range(600)]
    right = [(rng.choice("abh"), rng.choice([None, *range(40)]), f"v{rng.randrange(30)}") for _ in range(500)]
    return left, right


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_equals_a_scan(sliced, strict):
    left, right = _asof_rows(strict)
    frames = (
        sliced.createDataFrame(left, "n int, k string, at int"),
        sliced.createDataFrame(right, "k string, at int, v string"),
    )
    got = {r.n: r.v for r in as_of(*frames, ["k"], "at", ["v"], strict).collect()}
    want = {}
    for n, k, at in left:
        before = [(t, v) for key, t, v in right if key == k and t is not None and at is not None and (t < at or (not strict and t == at))]
        want[n] = max(before)[1] if before else None
    assert got == want
    assert as_of(frames[0], frames[1].limit(0), ["k"], "at", ["v"]).where("v is not null").count() == 0


def sequential(packages, records):
    """The whole review history in one pass over plain dictionaries."""
    level = {s: "unreviewed" for s, p in packages.items() if p["valid"]}
    seen, verdicts, states = set(), {}, {}
    for r in sorted(records, key=lambda r: (r["reviewed_at"], r["name"])):
        errors = set()
        if r["name"] != r["review_id"]:
            errors.add("name-is-not-the-review-id")
        if r["review_id"] in seen:
            errors.add("duplicate-review-id")
        seen.add(r["review_id"])
        own = packages.get(r["submission_id"])
        own = own if own and own["valid"] else None
        now = level.get(r["submission_id"], "unreviewed")
        if own is None:
            errors.add("package-missing-or-invalid")
        else:
            for field, code in (("manifest_sha256", "manifest-digest-mismatch"), ("result_id", "result-id-mismatch"), ("result_sha256", "result-digest-mismatch")):
                if r[field] != own[field]:
                    errors.add(code)
        if r["previous_level"] != now:
            errors.add("previous-level-mismatch")
        if (r["review_type"], r["previous_level"], r["assigned_level"]) not in rules.REVIEW_TRANSITIONS:
            errors.add("transition-not-allowed")
        named = set(r["supporting_ids"])
        if (r["review_type"] == "reproduction-review") != bool(named):
            errors.add("supporting-submissions-" + ("not-allowed" if named else "required"))
        for who in named:
            state = level.get(who, "unreviewed")
            states[r["name"], who] = state
            their = packages.get(who)
            their = their if their and their["valid"] else None
            if their is None:
                errors.add("support-missing")
            if who == r["submission_id"]:
                errors.add("support-is-itself")
            if state not in rules.ACCEPTED_LEVELS:
                errors.add("support-not-accepted")
            if their:
                mine = own or {}
                if mine.get("identity") != their["identity"]:
                    errors.add("support-not-comparison-compatible")
                if (mine.get("contributor") or "").lower() == (their["contributor"] or "").lower():
                    errors.add("support-not-contributor-independent")
                for field in ("result_id", "session_id"):
                    if mine.get(field) == their[field]:
                        errors.add("support-reuses-" + field.removesuffix("_id"))
        if not errors:
            level[r["submission_id"]] = r["assigned_level"]
        verdicts[r["name"]] = (not errors, now, errors)
    return verdicts, states, level


def _history(seed):
    rng = random.Random(seed)
    packages = {
        f"s{n}": dict(
            valid=rng.random() > 0.1, manifest_sha256=f"m{n}", result_sha256=f"d{n}", result_id=f"r{n // 2}",
            session_id=f"x{n // 3}", contributor=rng.choice(["Ann", "ann", "bob", "Cy", None]), identity=rng.choice("pq"),
        )
        for n in range(20)
    }
    records = []
    for n in range(400):
        kind, previous, assigned = rng.choice(rules.REVIEW_TRANSITIONS + (("initial-review", "unreviewed", "verified"),))
        who = rng.randrange(22)
        wrong = rng.random() < 0.1
        supporting = [f"s{rng.randrange(22)}" for _ in range(rng.randrange(1, 4))] if (kind == "reproduction-review") != (rng.random() < 0.1) else []
        records.append(
            dict(
                name=f"n{n:04d}", review_id=f"n{n:04d}" if rng.random() > 0.05 else f"n{rng.randrange(n + 1):04d}",
                reviewed_at=f"2026-02-{rng.randrange(1, 25):02d}", submission_id=f"s{who}", review_type=kind, previous_level=previous,
                assigned_level=assigned, manifest_sha256="other" if wrong else f"m{who}", result_id=f"r{who // 2}", result_sha256=f"d{who}",
                supporting_ids=supporting,
            )
        )
    return packages, records


@pytest.mark.parametrize("seed", range(2))
def test_pipeline_equals_a_sequential_pass(spark, seed):
    packages, records = _history(seed)
    facts = spark.createDataFrame(
        [(s, *p.values()) for s, p in packages.items()],
        "submission_id string, valid boolean, manifest_sha256 string, result_sha256 string, result_id string, "
        "session_id string, contributor string, identity string",
    )
    rows = spark.createDataFrame(
        [(*r.values(), r["name"] == r["review_id"]) for r in records],
        "name string, review_id string, reviewed_at string, submission_id string, review_type string, previous_level string, "
        "assigned_level string, manifest_sha256 string, result_id string, result_sha256 string, supporting_ids array<string>, name_matches boolean",
    )
    verdicts, held, levels = pipeline.judge_reviews(rows, facts)
    want, states, level = sequential(packages, records)
    got = {r.name: (r.valid, r.level_before, set(r.errors)) for r in verdicts.collect()}
    assert {n: g[::2] for n, g in got.items()} == {n: w[::2] for n, w in want.items()}
    known = {r["name"] for r in records if packages.get(r["submission_id"], {}).get("valid")}
    assert all(got[n][1] == want[n][1] for n in known)
    assert {(r.name, r.supporting_id): r.level_at_review for r in held.collect()} == states
    assert {r.submission_id: r.evidence_level for r in levels.collect()} == level
    assert sum(v[0] for v in want.values()) > 15


def test_reviews_of_packages_in_folders(spark, tmp_path):
    def package(n, who, session, device="phone"):
        folder = tmp_path / "draft" / f"p{n}"
        folder.mkdir(parents=True)
        result = json.dumps({"resultID": f"r{n}", "execution": {"workloadID": "w", "sessionID": session}, "device": {"id": device}, "runtime": {"b": 1, "a": 2}}).encode()
        manifest = json.dumps({"submissionID": f"s{n}", "contributor": {"githubHandle": who}}).encode()
        (folder / "result.json").write_bytes(result)
        (folder / "submission.json").write_bytes(manifest)
        return hashlib.sha256(manifest).hexdigest(), hashlib.sha256(result).hexdigest()

    digests = {n: package(n, who, session, device) for n, who, session, device in [(1, "ann", "x", "phone"), (2, "bob", "y", "phone"), (3, "Ann", "z", "phone"), (4, "cy", "q", "pad")]}
    folder = tmp_path / "reviews"
    folder.mkdir()

    def review(name, n, at, kind, before, after, supports=(), **change):
        record = {
            "reviewID": name, "submissionID": f"s{n}", "reviewedAt": at, "reviewType": kind, "previousEvidenceLevel": before,
            "assignedEvidenceLevel": after, "submissionManifestSHA256": digests[n][0], "resultID": f"r{n}", "resultSHA256": digests[n][1],
            "supportingSubmissionIDs": list(supports),
        }
        (folder / f"{name}.json").write_text(json.dumps(record | change))

    first = ("initial-review", "unreviewed", "community-submitted")
    again = ("reproduction-review", "community-submitted", "reproduced")
    for n in (1, 2, 3):
        review(f"a{n}", n, f"2026-01-0{n}", *first)
    review("b1", 1, "2026-01-02", *again, supports=["s2"])  # s2 is accepted on this day, under an earlier name
    review("b2", 1, "2026-01-05", *again, supports=["s3"])  # the same person
    review("b3", 1, "2026-01-06", *again, supports=["s4"])  # another device, never accepted
    review("b4", 2, "2026-01-07", *again, supports=["s1"], resultSHA256="0" * 64)
    (folder / "notes.txt").write_text("x")
    read, problems = source.read_reviews(spark, str(folder))
    facts = pipeline.package_facts(source.read_packages(spark, str(tmp_path / "draft")).withColumnRenamed("file_set_valid", "valid"))
    verdicts, held, levels = pipeline.judge_reviews(pipeline.review_records(read), facts)
    got = {r.name: (r.valid, sorted(r.errors)) for r in verdicts.collect()}
    assert got == {
        "a1": (True, []), "a2": (True, []), "a3": (True, []), "b1": (True, []),
        "b2": (False, ["previous-level-mismatch", "support-not-contributor-independent"]),
        "b3": (False, ["previous-level-mismatch", "support-not-accepted", "support-not-comparison-compatible"]),
        "b4": (False, ["result-digest-mismatch"]),
    }
    assert [r.problem for r in problems.collect()] == ["unexpected-review-entry"]
    level = {r.submission_id: r.evidence_level for r in levels.collect()}
    assert level == {"s1": "reproduced", "s2": "community-submitted", "s3": "community-submitted", "s4": "unreviewed"}
    rows = spark.createDataFrame(
        [("s1", "community-submission", "a"), ("s9", "community-submission", "b"), ("s2", "maintainer-reference", "c")],
        "submission_id string, source_kind string, raw_path string",
    )
    assert {r.raw_path: r.evidence_level for r in pipeline.with_levels(rows, levels).collect()} == {
        "a": "reproduced", "b": "unreviewed", "c": "maintainer-reference",
    }


def test_stored_reports(spark):
    result = '{"resultID":"r","schemaVersion":"1"}'
    digest = hashlib.sha256(result.encode()).hexdigest()
    report = {"result": {"id": "r", "sha256": digest, "schemaVersion": "1"}, "metrics": {"x": 1.5, "n": [1, 2]}}
    change = lambda **more: json.dumps(report | more)
    rows = [
        ("equal", result, json.dumps(report, indent=1), change()),
        ("number", result, change(metrics={"x": 1.50, "n": [1.0, 2]}), change()),
        ("stale", result, change(metrics={"x": 1.25, "n": [1]}), change()),
        ("bytes", result + " ", change(), change()),
        ("names", result, change(result={"id": "q", "sha256": digest, "schemaVersion": "2"}), change()),
        ("blank", result, change(result=None), change()),
        ("list", result, "[]", change()),
        ("broken", "{", change(), change()),
        ("none", result, None, change()),
    ]
    frame = spark.createDataFrame(rows, "k string, content string, report string, recomputed string")
    verdicts, differences = verify_reports(frame, ["k"])
    got = {r.k: r.errors for r in verdicts.collect()}
    objects, stale = "result-and-report-must-be-objects", "report-stale"
    assert got == {
        "equal": [], "number": [], "stale": [stale], "bytes": ["report-does-not-bind-result"],
        "names": ["result-id-mismatch", "result-schema-mismatch", stale], "blank": ["report-has-no-result-reference", stale],
        "list": [objects, stale], "broken": [objects], "none": [objects, stale],
    }
    paths = {(r.path, r.problem) for r in differences.where("k = 'stale'").collect()}
    assert paths == {("$.metrics.x", "changed"), ("$.metrics.n[1]", "missing")}
