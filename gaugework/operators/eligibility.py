"""Reason codes and admission flags; each job keeps the row and says why."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import is_finite, reasons


def admission_reasons(
    battery_state: Column,
    battery_level: Column,
    low_power: Column,
    start_thermal: Column,
    assistance: Column,
    admission: dict = rules.ADMISSION,
) -> Column:
    """One reason per failed environment condition; a null never passes."""
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return reasons(
        (fails(battery_state == admission["battery_state"]), "battery-state-ineligible"),
        (
            fails(battery_level * 100 >= admission["minimum_battery_percent"]),
            "battery-level-ineligible",
        ),
        (fails(low_power == admission["low_power_mode"]), "low-power-mode-ineligible"),
        (
            fails(start_thermal.isin(list(admission["start_thermal_states"]))),
            "start-thermal-state-ineligible",
        ),
        (fails(assistance == admission["thermal_assistance"]), "thermal-assistance-ineligible"),
    )


def release_environment_ok(
    build: Column, debugger: Column, low_power: Column, battery: Column, percent: Column, thermal: Column
) -> Column:
    """The older releases admit or refuse the environment as a whole."""
    return (
        build.eqNullSafe("Release")
        & debugger.eqNullSafe(False)
        & low_power.eqNullSafe(False)
        & battery.eqNullSafe("unplugged")
        & is_finite(percent)
        & F.coalesce(percent >= rules.RELEASE_ONE.minimum_battery_percent, F.lit(False))
        & thermal.eqNullSafe("nominal")
    )


def pilot_power_reasons(battery: Column, percent: Column) -> Column:
    return reasons(
        (battery.isNull() | (battery == "unknown"), "battery_state_unknown"),
        (battery.isin("charging", "full"), "external_power_connected"),
        (~is_finite(percent), "battery_level_unknown"),
        (percent < rules.PILOT.minimum_battery_percent, "battery_level_below_minimum"),
    )


def preparation_ok(
    artifact_matches: Column, downloaded: Column, completed: Column, loaded: Column, eligible: Column
) -> Column:
    return (
        F.coalesce(artifact_matches, F.lit(False))
        & downloaded.eqNullSafe(False)
        & completed.eqNullSafe(True)
        & loaded.eqNullSafe(True)
        & eligible.eqNullSafe(True)
    )


def all_declared(declarations: Sequence[Column]) -> Column:
    return F.forall(F.array(*declarations), lambda d: d.eqNullSafe(F.lit(True)))


def covers(present: Column, required: Sequence[str]) -> Column:
    """True when the array holds every required entry."""
    wanted = F.array(*[F.lit(r) for r in required])
    return F.coalesce(F.size(F.array_except(wanted, present)) == 0, F.lit(False))


def frozen_mismatches(
    df: DataFrame, keys: Sequence[str], group: str, fields: Sequence[str], expected: DataFrame
) -> DataFrame:
    """(keys, field, reason) for fields that differ from their frozen value, null-safe.

    `expected` has columns group, field, expected_value, reason.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("actual"))
            for f in fields
        ]
    )
    long = df.select(*keys, group, F.explode(pairs).alias("_p")).select(*keys, group, "_p.*")
    return (
        long.join(expected, [group, "field"])
        .where(~F.col("actual").eqNullSafe(F.col("expected_value")))
        .select(*keys, "field", "reason")
    )


def outcome_reasons(
    outcome: Column, codes: Column, stop: Column, has_events: Column, has_metrics: Column
) -> Column:
    """Contradictions between an attempt's outcome and the rest of its evidence."""
    allowed = F.array().cast("array<string>")
    for name, known in rules.OUTCOME_REASONS.items():
        allowed = F.when(outcome == name, F.array(*[F.lit(k) for k in known])).otherwise(allowed)
    done = outcome == "completed"
    bad_codes = (F.size(codes) == 0) | (F.size(F.array_except(codes, allowed)) > 0)
    return reasons(
        (~done & (stop.isNotNull() | bad_codes), "contradictory_outcome_evidence"),
        (~done & has_metrics, "aggregate_mismatch"),
        ((outcome == "notRun") & has_events, "contradictory_outcome_evidence"),
        (
            done
            & (
                ~F.coalesce(stop.isin(list(rules.STOP_REASONS)), F.lit(False))
                | (F.size(codes) > 0)
            ),
            "contradictory_outcome_evidence",
        ),
    )


def token_limit_reasons(
    output: Column, prompt: Column, stop: Column, limit: Column, interactive: Column
) -> Column:
    in_limit = F.coalesce((output >= 0) & (output <= limit), F.lit(False))
    in_band = F.coalesce((prompt >= 64) & (prompt <= 256), F.lit(False))
    return reasons(
        (~in_limit, "token_evidence_invalid"),
        (
            (stop == "outputTokenLimit") & ~output.eqNullSafe(limit),
            "contradictory_outcome_evidence",
        ),
        (interactive & ~in_band, "token_evidence_invalid"),
    )


def timing_reasons(
    accepted: Column,
    first_token: Column,
    renderable: Column,
    completed: Column,
    prompt: Column,
    decode: Column,
) -> Column:
    """Impossible order of the timestamps of a succeeded attempt."""
    ordered = lambda middle: F.coalesce(
        (accepted <= middle) & (middle <= completed), F.lit(False)
    )
    positive = lambda d: F.coalesce(d > 0, F.lit(False))
    bad = (
        ~ordered(first_token)
        | (renderable.isNotNull() & ~ordered(renderable))
        | ~positive(prompt)
        | ~positive(decode)
    )
    return reasons((bad, "invalid-monotonic-timing"))


def interaction_order_ok(pipeline: Column, visible: Column, completion: Column) -> Column:
    """completion >= visible >= pipeline, all present."""
    return F.coalesce((visible >= pipeline) & (completion >= visible), F.lit(False))


def review_triggers(conflict: Column, assistance: Column, environment: Sequence[Column]) -> Column:
    unknown = reduce(lambda a, b: a | b, [c.eqNullSafe("unknown") for c in environment])
    return reasons(
        (conflict.eqNullSafe("disclosed"), "declared-conflict-of-interest"),
        (~assistance.eqNullSafe("none"), "thermal-assistance-not-none"),
        (unknown, "unknown-environment-field"),
    )


def pilot_reasons(
    session_ok: Column,
    start_thermal: Column,
    enough_runs: Column,
    not_run: Column,
    prompt_in_band: Column,
    source_known: Column,
    short_output: Column,
) -> tuple[Column, Column]:
    """Gating reasons, and warnings that never gate."""
    gating = reasons(
        (~session_ok, "session_environment_ineligible"),
        (~start_thermal.eqNullSafe("nominal"), "initial_thermal_state_not_nominal"),
        (~enough_runs, "insufficient_successful_measured_runs"),
        (not_run, "planned_attempt_not_run"),
        (~prompt_in_band, "prompt_token_count_outside_pilot_band"),
    )
    warnings = reasons(
        (~source_known, "runner_source_identity_missing"),
        (short_output, "output_below_256_tokens_not_an_eligibility_gate"),
    )
    return gating, warnings


def publication_reasons(
    flags: Sequence[Column], declared: Column, conflict: Column, counts_match: Column
) -> Column:
    """The four flags activate together; then declarations and counts must hold."""
    on = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])
    active = on == len(flags)
    return reasons(
        ((on > 0) & ~active, "publication-flags-must-activate-together"),
        (active & ~declared, "contributor-declarations-pending"),
        (active & ~conflict.eqNullSafe("none"), "unexpected-conflict-of-interest"),
        (active & ~counts_match, "asserted-count-mismatch"),
    )


def registry_row_reasons(
    fields: Sequence[Column], revision: Column, url: Column, parameters: Column, base: Column, limit: int
) -> Column:
    """Checks of one model registry row; uniqueness of its id is a separate count."""
    missing = reduce(lambda a, b: a | b, [f.isNull() for f in fields])
    return reasons(
        (missing, "missing-fields"),
        (~F.coalesce(revision.rlike("^[0-9a-f]{40}$"), F.lit(False)), "invalid-artifact-revision"),
        (~F.coalesce(url.contains(revision), F.lit(False)), "source-url-not-pinned"),
        (~F.coalesce(parameters >= 1, F.lit(False)), "no-exact-parameter-count"),
        (F.coalesce(parameters > limit, F.lit(False)), "outside-cohort"),
        (~base.eqNullSafe(parameters), "base-parameter-mismatch"),
    )


def parameter_bucket(name: Column) -> Column:
    """Size bucket from the billions of parameters written in a model name."""
    text = F.regexp_extract(name, r"(?:^|[-_/\s])(\d+(?:\.\d+)?)\s*[bB](?=$|[-_/\s])", 1)
    billions = F.when(text != "", text.cast("double"))
    return (
        F.when(billions.isNull(), "unknown")
        .when(billions <= 1, "up-to-1b")
        .when(billions <= 2, "1b-to-2b")
        .when(billions <= 4, "2b-to-4b")
        .otherwise("over-4b")
    )
