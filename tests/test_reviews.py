"""The three-step review fold against a sequential pass in plain Python."""

import random

import pytest

from gaugework import rules
from gaugework.operators import reviews


def sequential(records, supports):
    allowed = set(rules.REVIEW_TRANSITIONS)
    level, seen, verdict = {}, set(), {}
    for r in sorted(records, key=lambda r: (r["reviewed_at"], r["name"])):
        named = supports.get(r["review_id"], [])
        now = level.get(r["submission_id"], "unreviewed")
        ok = r["static_ok"] and r["review_id"] not in seen and r["previous_level"] == now
        seen.add(r["review_id"])
        ok = ok and (r["review_type"], r["previous_level"], r["assigned_level"]) in allowed
        ok = ok and (r["review_type"] == "reproduction-review") == bool(named)
        for who, fine in named:
            ok = ok and fine and level.get(who, "unreviewed") in rules.ACCEPTED_LEVELS
        if ok:
            level[r["submission_id"]] = r["assigned_level"]
        verdict[r["name"]] = ok
    return level, verdict


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_sequential_pass(spark, seed):
    rng = random.Random(seed)
    records, supports = [], {}
    for n in range(300):
        kind, previous, assigned = rng.choice(rules.REVIEW_TRANSITIONS + (("initial-review", "unreviewed", "verified"),))
        record = dict(
            review_id=f"r{n if rng.random() > 0.05 else rng.randrange(n + 1)}",
            name=f"n{n:04d}",
            reviewed_at=f"2026-01-{rng.randrange(1, 29):02d}",
            submission_id=f"s{rng.randrange(25)}",
            review_type=kind,
            previous_level=previous,
            assigned_level=assigned,
            static_ok=rng.random() > 0.1,
        )
        if (kind == "reproduction-review") != (rng.random() < 0.1) and record["review_id"] not in supports:
            supports[record["review_id"]] = [
                (f"s{rng.randrange(25)}", rng.random() > 0.1) for _ in range(rng.randrange(1, 3))
            ]
        records.append(record)
    flat = [(k, who, ok) for k, named in supports.items() for who, ok in named]
    frame = spark.createDataFrame(
        [tuple(r.values()) for r in records],
        "review_id string, name string, reviewed_at string, submission_id string, review_type string, "
        "previous_level string, assigned_level string, static_ok boolean",
    )
    named = spark.createDataFrame(flat, "review_id string, supporting_id string, support_ok boolean")
    folded = reviews.fold_reviews(frame, named)
    level, verdict = sequential(records, supports)
    rows = folded.collect()
    assert {r.name: r.valid for r in rows} == verdict
    assert all((r.errors == []) == r.valid for r in rows)
    subs = spark.createDataFrame([(f"s{i}",) for i in range(25)], "submission_id string")
    levels = {r.submission_id: r.evidence_level for r in reviews.evidence_levels(subs, folded).collect()}
    assert levels == {f"s{i}": level.get(f"s{i}", "unreviewed") for i in range(25)}
