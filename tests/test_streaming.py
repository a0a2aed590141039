"""Streams against the batch plan on the same rows."""

from pyspark.sql import functions as F

from gaugework.plans import evidence_ranking as ranking
from gaugework.plans.triage import scope, triage
from gaugework.sources import packages as source
from gaugework.sources.sinks import split_append
from gaugework import rules
from gaugework.streaming import intake
from gaugework.streaming.first_wins import claim, large_state
from gaugework.streaming.live_metrics import live_attempt_metrics, session_summaries
from tests import builders

VIEW = ["view_id", "comparison_id", "value", "contributor_count", "submission_count", "rank"]


def _rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_replayed_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "packages"
    root.mkdir()
    for n in range(6):
        body = builders.result(1 if n == 4 else n + 1)  # package 4 repeats package 0
        body["device"]["machineIdentifier"] = f"phone{n % 2}" if n != 4 else "phone0"
        builders.write_package(root, n, body, ["alice", "Bob", "carol"][n % 3])
    packages = source.with_declared_author(source.read_packages(spark, str(root))).select(
        "package_id", "submission", "result", "file_set_valid", "author"
    )
    landing, tables = str(tmp_path / "landing"), str(tmp_path / "tables")
    models, stack = builders.models(spark), builders.trusted()
    ordered = packages.orderBy("package_id").collect()
    for part in (ordered[:2], ordered[2:]):
        spark.createDataFrame(part, packages.schema).coalesce(1).write.mode("append").parquet(landing)
        stream = intake.read_package_stream(spark, landing)
        intake.start_intake(stream, models, stack, tables).awaitTermination()
    decided, views = ranking.rank_packages(packages, models, stack)
    columns = ["package_id", "classification", "reason_codes", "report_id"]
    assert _rows(intake.decisions(spark, tables), columns) == _rows(decided, columns)
    assert _rows(intake.live_ranking(spark, tables), VIEW) == _rows(views, VIEW)
    before = _rows(intake.decisions(spark, tables), columns)
    second = spark.createDataFrame(ordered[2:], packages.schema)
    intake.process_batch(second, 1, models, stack, tables)  # a replay changes nothing
    assert _rows(intake.decisions(spark, tables), columns) == before


def test_live_sessions_equal_batch(spark, tmp_path):
    rows = [(a, m, m * 60_000_000) for a in ("x", "y") for m in (0, 1, 2, 40, 41)]
    rows += [("z", 500, 500 * 60_000_000)]
    events = spark.createDataFrame(rows, "attempt string, minute int, at_us long").select(
        "attempt",
        F.timestamp_seconds(F.col("minute") * 60).alias("ts"),
        "at_us",
    )
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    query = (
        live_attempt_metrics(stream, "10 minutes", "5 minutes")
        .writeStream.format("memory")
        .queryName("sessions")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    columns = ["attempt", "first_time", "last_time", "events"]
    closed = session_summaries(events, "10 minutes").where("attempt <> 'z'")
    assert _rows(spark.table("sessions"), columns) == _rows(closed, columns)


def test_same_id_other_bytes_is_a_collision(spark):
    old = spark.createDataFrame([("r1", "a"), ("r2", "b")], "result_id string, result_sha256 string")
    new = spark.createDataFrame(
        [("r1", "a"), ("r2", "x"), ("r3", "c"), ("r3", "c"), ("r4", "e"), ("r4", "d")],
        "result_id string, result_sha256 string",
    )
    fresh, clash = split_append(new, old)
    assert sorted((r.result_id, r.result_sha256) for r in fresh.collect()) == [("r3", "c"), ("r4", "d")]
    assert sorted((r.result_id, r.result_sha256, r.reason) for r in clash.collect()) == [
        ("r2", "x", "result-id-collision"),
        ("r4", "e", "result-id-collision"),
    ]


def test_batch_scope_and_class(spark):
    def package(batch, n, files=("result.json", "submission.json"), status="A"):
        name = f"00000000-0000-4000-8000-{n:012d}"
        return [(batch, status, f"in/draft/{name}/{f}") for f in files]

    changes = (
        package("good", 1)
        + package("half", 2, files=("result.json",))
        + [row for n in range(11) for row in package("many", 100 + n)]
        + package("edited", 3, status="M")
        + [("other", "M", "docs/readme.md")]
        + package("manual", 4)
        + [("bad-name", "A", "in/draft/xyz/result.json"), ("bad-name", "A", "in/draft/xyz/submission.json")]
    )
    frame = spark.createDataFrame(changes, "batch_id string, status string, path string")
    verdicts = spark.createDataFrame(
        [("good", "auto-accept"), ("manual", "manual-review")], "batch_id string, classification string"
    )
    found = {r.batch_id: r for r in triage(scope(frame, "in/draft"), verdicts).collect()}
    assert found["good"].classification == "auto_accept"
    assert found["manual"].classification == "manual_review"
    assert found["other"].classification == "not_applicable" and found["other"].errors == []
    assert found["half"].errors == ["incomplete-package"]
    assert found["many"].errors == ["too-many-packages"]
    assert "non-result-only-change" in found["edited"].errors
    assert "invalid-submission-directory-name" in found["bad-name"].errors
    assert all(found[b].classification == "rejected" for b in ("half", "many", "edited", "bad-name"))


def _claims(spark, landing, folder):
    """Runs the waiting files one a batch and returns the flags, by package, of every batch."""
    stream = (
        spark.readStream.schema("result_sha256 string, package_id string, n int")
        .option("maxFilesPerTrigger", 1)
        .parquet(landing)
    )
    with large_state(spark):
        query = (
            claim(stream, "result_sha256")
            .writeStream.foreachBatch(
                lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
            )
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("batch", "package_id", "result_sha256", "n", "duplicate").collect()


def test_claims_are_kept_over_batches_restarts_and_replays(spark, tmp_path):
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "claims")
    batches = [
        [("a", "p2", 0), ("a", "p1", 1), ("b", "p3", 2), (None, "p4", 3)],
        [("b", "p0", 4), ("c", "p5", 5), (None, "p0", 6), ("d", None, 7), ("d", "p6", 8)],
        [("hot", f"q{n:05d}", n) for n in range(5000, 0, -1)] + [("a", "p1", 9)],
    ]
    taken, want = set(), {}
    for rows in batches:
        spark.createDataFrame(rows, "result_sha256 string, package_id string, n int").coalesce(1).write.mode(
            "append"
        ).parquet(landing)
        got = _claims(spark, landing, folder)  # a restart for every batch
        for digest in {d for d, _, _ in rows}:
            own = sorted((p or "", n) for d, p, n in rows if d == digest)
            for place, (_, n) in enumerate(own):
                want[digest, n] = digest in taken or place > 0
        taken |= {d for d, _, _ in rows}
        assert {(r.result_sha256, r.n): r.duplicate for r in got} == want
    last = max(int(p.name) for p in (tmp_path / "claims/progress/commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # the batch ran, and was not noted
        (tmp_path / "claims/progress/commits" / name).unlink(missing_ok=True)
    assert sorted(map(str, _claims(spark, landing, folder))) == sorted(map(str, got))


def _contributions(batch):
    rows = []
    for n in range(30):
        cell = (batch * 7 + n * n) % (5 if n % 3 else 40)
        workload, metric = [(w, m) for _, w, m in rules.VIEWS][cell % len(rules.VIEWS)]
        who = f"user{(n + batch) % 6}"
        rows.append((f"p{batch}-{n}", "x", workload, who, who, f"cell{cell}", metric, float((n * 37 + batch * 11) % 17)))
    return rows


def test_live_cells_equal_the_batch_ranking_after_ten_batches(spark, tmp_path):
    folder, landed = str(tmp_path), []
    for batch in range(10):
        rows = _contributions(batch)
        landed += rows
        frame = spark.createDataFrame(rows, intake.CONTRIBUTION_COLUMNS)
        intake.refresh_cells(frame, batch, folder)
        if batch in (4, 7):
            intake.refresh_cells(frame, batch, folder)  # a replay
            intake.compact(spark, folder, batch)
        if batch in (3, 5, 9):
            everything = spark.createDataFrame(landed, intake.CONTRIBUTION_COLUMNS)
            want = _rows(ranking.ranked_views(everything), VIEW)
            assert want and _rows(intake.live_ranking(spark, folder), VIEW) == want


def test_a_batch_opens_only_the_buckets_of_its_cells(spark, tmp_path):
    folder = str(tmp_path)
    for batch in range(3):
        intake.refresh_cells(spark.createDataFrame(_contributions(batch), intake.CONTRIBUTION_COLUMNS), batch, folder)
    log = intake.run_log(spark, folder)
    intake.compact(spark, folder, 1)
    one = spark.createDataFrame(_contributions(0)[:1], intake.CONTRIBUTION_COLUMNS)
    touched = log.touched(one)
    assert len(touched) == 1
    opened = log.read(2, touched).inputFiles()
    assert opened and all(f"/bucket={touched[0]}/" in path for path in opened)
    assert any("/base/through=1/" in path for path in opened)
    assert len(log.read(2).inputFiles()) > 10 * len(opened)


def test_an_unfinished_compaction_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    intake.refresh_cells(spark.createDataFrame(_contributions(0), intake.CONTRIBUTION_COLUMNS), 0, folder)
    before = _rows(intake.live_ranking(spark, folder), VIEW)
    intake.compact(spark, folder, 0)
    (tmp_path / "runs/base/through=0/_SUCCESS").unlink()
    assert intake.run_log(spark, folder).compacted() is None
    assert _rows(intake.live_ranking(spark, folder), VIEW) == before
    assert intake.run_log(spark, f"{folder}/none").read().count() == 0
