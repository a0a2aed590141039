"""Checks and measures of the attempts inside one parsed result row.

An attempt array is bounded by one document, so these are array expressions
on the row itself: no explode and no shuffle of the token events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import percent_change, reasons
from gaugework.functions.text import is_renderable
from gaugework.operators.conformance import let
from gaugework.operators.metrics import attempt_values


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _all_true(flags: Column) -> Column:
    return F.forall(flags, lambda f: F.coalesce(f, F.lit(False)))


def in_order(times: Column, strictly: bool = False) -> Column:
    """Non-decreasing without nulls; strictly also forbids repeats."""
    plain = F.forall(times, lambda t: t.isNotNull()) & (times == F.array_sort(times))
    return plain & (F.size(F.array_distinct(times)) == F.size(times)) if strictly else plain


def _inspected(event: Column) -> Column:
    return (
        event["decodedAtNanoseconds"].isNotNull()
        & event["decodedPrefix"].isNotNull()
        & event["isSpecial"].isNotNull()
        & event["isRenderable"].isNotNull()
    )


def _untouched(event: Column) -> Column:
    return (
        event["decodedAtNanoseconds"].isNull()
        & event["decodedPrefix"].isNull()
        & event["isSpecial"].isNull()
        & event["isRenderable"].isNull()
    )


def series_inconsistent(attempt: Column, maximum_probes: int) -> Column:
    """True when any stated value cannot be reproduced from the raw series."""
    clock, memory, thermal = attempt["monotonic"], attempt["memory"], attempt["thermal"]
    events, samples, changes = attempt["tokenEvents"], memory["samples"], thermal["transitions"]
    received = F.transform(events, lambda e: e["receivedNanoseconds"])
    probes = F.filter(events, _inspected)
    shown = F.transform(events, lambda e: F.coalesce(_inspected(e) & e["isRenderable"], F.lit(False)))
    # One value, so that it is not searched again for every event.
    probed_later = let(
        F.array_position(shown, True).cast("int"),
        lambda first: (first > 0)
        & F.exists(
            F.transform(events, lambda e, i: (i >= first) & _inspected(e)), lambda late: late
        ),
    )
    probe_wrong = F.exists(
        probes,
        lambda e: (e["decodedAtNanoseconds"] < e["receivedNanoseconds"])
        | (
            e["isRenderable"]
            != (~e["isSpecial"] & is_renderable(e["decodedPrefix"]))
        ),
    )
    renderable_at = F.array_min(
        F.transform(
            F.filter(events, lambda e: _inspected(e) & e["isRenderable"]),
            lambda e: e["decodedAtNanoseconds"],
        )
    )
    last = F.try_element_at(received, F.lit(-1))
    span = F.when(F.size(received) >= 2, last - F.try_element_at(received, F.lit(1)))
    sample_times = F.transform(samples, lambda s: s["elapsedNanoseconds"])
    sample_bytes = F.transform(samples, lambda s: s["physicalFootprintBytes"])
    change_times = F.transform(changes, lambda c: c["elapsedNanoseconds"])
    end_state = F.when(
        F.size(changes) > 0, F.try_element_at(changes, F.lit(-1))["state"]
    ).otherwise(thermal["start"])
    incomplete = (
        clock.isNull()
        | attempt["tokenCounts"].isNull()
        | events.isNull()
        | samples.isNull()
        | changes.isNull()
    )
    return incomplete | _any(
        ~clock["requestAcceptedNanoseconds"].eqNullSafe(0),
        ~_all_true(F.transform(events, lambda e, i: e["index"] == i)),
        F.exists(events, lambda e: ~_inspected(e) & ~_untouched(e)),
        probed_later,
        probe_wrong,
        F.size(probes) > maximum_probes,
        ~in_order(received),
        ~attempt["tokenCounts"]["output"].eqNullSafe(F.size(events)),
        ~clock["firstTokenNanoseconds"].eqNullSafe(F.try_element_at(received, F.lit(1))),
        ~clock["firstRenderableNanoseconds"].eqNullSafe(renderable_at),
        ~clock["decodeNanoseconds"].eqNullSafe(span),
        clock["completedNanoseconds"] < last,
        ~in_order(sample_times),
        F.exists(sample_bytes, lambda b: b.isNull()),
        ~memory["peakPhysicalFootprintBytes"].eqNullSafe(F.array_max(sample_bytes)),
        ~in_order(change_times),
        ~thermal["end"].eqNullSafe(end_state),
    )


def timing_impossible(attempt: Column) -> Column:
    """Order of the timestamps and positive durations of a succeeded attempt."""
    clock = attempt["monotonic"]
    start, end = clock["requestAcceptedNanoseconds"], clock["completedNanoseconds"]
    between = lambda t: F.coalesce((start <= t) & (t <= end), F.lit(False))
    shown = clock["firstRenderableNanoseconds"]
    positive = lambda d: F.coalesce(d > 0, F.lit(False))
    return (attempt["outcome"] == "succeeded") & (
        ~between(clock["firstTokenNanoseconds"])
        | (shown.isNotNull() & ~between(shown))
        | ~positive(clock["promptEvaluationNanoseconds"])
        | ~positive(clock["decodeNanoseconds"])
    )


def attempt_reasons(attempts: Column, maximum_probes: int = rules.MAXIMUM_PROBE_EVENTS) -> Column:
    some = lambda test: F.coalesce(F.exists(attempts, test), F.lit(False))
    misplaced = F.exists(
        F.transform(attempts, lambda a, i: ~a["index"].eqNullSafe(i)), lambda wrong: wrong
    )
    return reasons(
        (attempts.isNull() | F.coalesce(misplaced, F.lit(False)), "invalid-attempt-sequence"),
        (some(lambda a: series_inconsistent(a, maximum_probes)), "raw-attempt-inconsistent"),
        (some(timing_impossible), "invalid-monotonic-timing"),
    )


def counted(attempts: Column) -> Column:
    """Measured attempts that succeeded, in order."""
    return F.filter(
        attempts, lambda a: (a["phase"] == "measured") & (a["outcome"] == "succeeded")
    )


_FIELDS = {
    "accepted_ns": ("monotonic", "requestAcceptedNanoseconds"),
    "first_token_ns": ("monotonic", "firstTokenNanoseconds"),
    "first_renderable_ns": ("monotonic", "firstRenderableNanoseconds"),
    "completed_ns": ("monotonic", "completedNanoseconds"),
    "prompt_ns": ("monotonic", "promptEvaluationNanoseconds"),
    "decode_ns": ("monotonic", "decodeNanoseconds"),
    "input_tokens": ("tokenCounts", "input"),
    "output_tokens": ("tokenCounts", "output"),
    "peak_bytes": ("memory", "peakPhysicalFootprintBytes"),
}


def array_median(values: Column) -> Column:
    """Exact median of a row's own array of doubles."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def metric_series(measured: Column) -> dict[str, Column]:
    """{metric id: array of the non-null values of the counted attempts}."""
    def value_of(metric):
        def pick(attempt):
            get = lambda name: attempt[_FIELDS[name][0]][_FIELDS[name][1]]
            return attempt_values(get)[metric].cast("double")

        return F.array_compact(F.transform(measured, pick))

    names = [m for m, _, _, _ in rules.METRICS if m != "decode_first_to_last_percent_change"]
    series = {m: value_of(m) for m in names}
    series["decode_first_to_last_percent_change"] = series["decode_tokens_per_second"]
    return series


def series_value(metric: str, values: Column) -> Column:
    aggregation = {m: a for m, a, _, _ in rules.METRICS}[metric]
    if aggregation == "maximum":
        return F.array_max(values)
    if aggregation == "derived":
        change = percent_change(
            F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(-1))
        )
        return F.when(F.size(values) >= 2, change)
    return array_median(values)
