"""Adoption of verified evidence into a release: every rule is rows, and any row stops the write."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.hot_keys import lookup
from gaugework.operators.integrity import list_coverage, repeated_values

# ---- fixed values: what an entry must repeat of its result and its report ----
IDENTITY = ("result_id", "session_id", "workload_id", "artifact_id", "artifact_revision")
DECISIONS = ("performance_eligible", "recommendation_eligible", "primary_metric_eligible")


class AdoptionError(ValueError):
    """A release that must not be written, with the first rules it breaks."""


def _broken(rules: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(rule)) for condition, rule in rules])
    )


def _rows(df: DataFrame, rules: Sequence[tuple[Column, str]], subject: str, *earlier: Column) -> DataFrame:
    """(rule, subject, found) for every rule that a row breaks, those of the arrays `earlier` too."""
    return df.select(
        F.explode(F.concat(*earlier, _broken(rules))).alias("rule"),
        F.col(subject).cast("string").alias("subject"),
        F.lit(1).cast("long").alias("found"),
    )


def entry_violations(entries: DataFrame, results: DataFrame, reports: DataFrame) -> DataFrame:
    """Entries against the evidence they bind.

    entries: entry_id, raw_path, raw_sha256, report_path, report_sha256, IDENTITY,
    DECISIONS.  results: raw_path, sha256, IDENTITY, identity_ok (release and
    app as the adoption names them).  reports: report_path, sha256, DECISIONS,
    errors (of the pair, as from `verify_reports`).  What is compared is only
    compared where the evidence is there.
    """
    raw = results.select(
        "raw_path",
        F.struct("sha256", "identity_ok", *IDENTITY).alias("raw"),
    )
    report = reports.select("report_path", F.struct("sha256", "errors", *DECISIONS).alias("report"))
    there, told = F.col("raw").isNotNull(), F.col("report").isNotNull()
    differs = lambda side, field: F.col(side).isNotNull() & ~F.col(field).eqNullSafe(F.col(side)[field])
    raw_rules = [
        (~there, "raw-missing"),
        (there & ~F.col("raw_sha256").eqNullSafe(F.col("raw")["sha256"]), "raw-digest-mismatch"),
        (there & ~F.coalesce(F.col("raw")["identity_ok"], F.lit(False)), "source-identity-mismatch"),
        *[(differs("raw", f), f"{f.replace('_', '-')}-mismatch") for f in IDENTITY],
    ]
    report_rules = [
        (~told, "report-missing"),
        (told & ~F.col("report_sha256").eqNullSafe(F.col("report")["sha256"]), "report-digest-mismatch"),
        (told & (F.size(F.col("report")["errors"]) > 0), "report-pair-invalid"),
        *[(differs("report", f), f"{f.replace('_', '-')}-decision-mismatch") for f in DECISIONS],
    ]
    # What the result is compared with ends here: the second shuffle takes the broken rules instead.
    judged = lookup(entries, raw, ["raw_path"], "left", ["entry_id"]).select(
        "entry_id", "report_path", "report_sha256", *DECISIONS, _broken(raw_rules).alias("_rules")
    )
    both = lookup(judged, report, ["report_path"], "left", ["entry_id"], entries)
    return _rows(both, report_rules, "entry_id", F.col("_rules"))


def matrix_violations(entries: DataFrame, workloads: Sequence[str], artifacts: int | None = None) -> DataFrame:
    """Ids and cells used twice, cells of the matrix that no entry covers, and a wrong number of artifacts.

    The matrix is every adopted artifact in every workload: `workloads` is a
    policy list, so it multiplies the artifacts by a constant.
    """
    cell = F.concat_ws(" / ", "artifact_id", "workload_id")
    twice = repeated_values(
        entries, {"result-id": F.col("result_id"), "session-id": F.col("session_id"), "cell": cell}
    ).select(F.concat(F.col("field"), F.lit("-not-unique")).alias("rule"), F.col("value").alias("subject"), F.col("rows").alias("found"))
    adopted = entries.select("artifact_id", "workload_id").where(
        F.col("artifact_id").isNotNull() & F.col("workload_id").isNotNull()
    ).distinct()
    each = entries.select("artifact_id").where("artifact_id IS NOT NULL").distinct()
    wanted = each.select("artifact_id", F.explode(F.array(*map(F.lit, workloads))).alias("workload_id"))
    gaps = list_coverage(adopted, wanted, ["artifact_id", "workload_id"])
    rule = F.when(F.col("state") == "missing", "cell-not-covered").otherwise("workload-not-in-the-matrix")
    uncovered = gaps.select(rule.alias("rule"), cell.alias("subject"), F.lit(1).cast("long").alias("found"))
    found = twice.unionByName(uncovered)
    if artifacts is None:
        return found
    number = each.agg(F.count("*").alias("found")).where(F.col("found") != artifacts)
    return found.unionByName(
        number.select(F.lit("artifact-count-mismatch").alias("rule"), F.lit(str(artifacts)).alias("subject"), "found")
    )


def count_violations(entries: DataFrame, declared: dict[str, int]) -> DataFrame:
    """Declared totals (`entries`, or a decision's eligible entries) that the entries don't reach."""
    totals = entries.agg(
        F.count("*").alias("entries"), *[F.count_if(F.coalesce(F.col(d), F.lit(False))).alias(d) for d in DECISIONS]
    )
    rows = F.array(
        *[
            F.struct(F.lit(f"{n.replace('_', '-')}-count-mismatch").alias("rule"), F.lit(str(want)).alias("subject"), F.col(n).alias("found"))
            for n, want in declared.items()
        ]
    )
    told = totals.select(F.explode(rows).alias("r")).select("r.*")
    return told.where(F.col("found").cast("string") != F.col("subject"))


def list_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that a new release drops from or changes in an old one; adding is free."""
    facts = ["raw_sha256", *IDENTITY, *DECISIONS]
    before = old.select("entry_id", F.struct(*facts).alias("before"))
    after = new.select("entry_id", F.struct(*facts).alias("after"))
    both = before.join(after, "entry_id", "left")
    rules = [
        (F.col("after").isNull(), "adopted-entry-dropped"),
        (F.col("after").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")), "adopted-entry-changed"),
    ]
    return _rows(both, rules, "entry_id")


def adopt(entries: DataFrame, violations: Sequence[DataFrame], path: str) -> None:
    """Writes the entries if there is no violation; otherwise raises with the rules and an example of each."""
    found = reduce(DataFrame.unionByName, violations)
    rules = found.groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first")).orderBy("rule").collect()
    if rules:
        raise AdoptionError("; ".join(f"{r.rule}: {r.n}, such as {r.first}" for r in rules))
    entries.write.mode("errorifexists").parquet(path)
