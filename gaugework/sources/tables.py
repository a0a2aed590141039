"""Columnar tables out of parsed documents, one row per array entry with its position.

Written once as parquet they let later jobs read only the series and columns
they need; nested arrays inside JSON text cannot be pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.sources.sinks import write_dataset


def _exploded(df: DataFrame, keys: Sequence[str], entries: Column, position: str) -> DataFrame:
    return df.select(*keys, F.posexplode(entries).alias(position, "_e"))


def attempts(parsed: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """One row per attempt; `position` is its place, `idx` what it states."""
    rows = _exploded(parsed, keys, F.col("r")["payload"]["attempts"], "position")
    e, clock = F.col("_e"), F.col("_e")["monotonic"]
    return rows.select(
        *keys,
        "position",
        e["index"].alias("idx"),
        e["phase"].alias("phase"),
        e["outcome"].alias("outcome"),
        clock["requestAcceptedNanoseconds"].alias("accepted_ns"),
        clock["firstTokenNanoseconds"].alias("first_token_ns"),
        clock["firstRenderableNanoseconds"].alias("first_renderable_ns"),
        clock["completedNanoseconds"].alias("completed_ns"),
        clock["promptEvaluationNanoseconds"].alias("prompt_ns"),
        clock["decodeNanoseconds"].alias("decode_ns"),
        e["tokenCounts"]["input"].alias("input_tokens"),
        e["tokenCounts"]["output"].alias("output_tokens"),
        e["memory"]["peakPhysicalFootprintBytes"].alias("peak_bytes"),
        e["thermal"]["start"].alias("thermal_start"),
        e["thermal"]["end"].alias("thermal_end"),
        e["generatedText"].alias("generated_text"),
    )


def _series(parsed: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    rows = _exploded(parsed, keys, F.col("r")["payload"]["attempts"], "attempt")
    inner = rows.select(*keys, "attempt", pick(F.col("_e")).alias("_s"))
    return _exploded(inner, [*keys, "attempt"], F.col("_s"), "position").select(
        *keys, "attempt", "position", "_e.*"
    )


def token_events(parsed: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    return _series(parsed, keys, lambda a: a["tokenEvents"])


def memory_samples(parsed: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    return _series(parsed, keys, lambda a: a["memory"]["samples"])


def thermal_transitions(parsed: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    return _series(parsed, keys, lambda a: a["thermal"]["transitions"])


def trace_entries(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Renderability trace of release results (`r` in the release layout)."""
    rows = _exploded(parsed, keys, F.col("r")["attempts"], "attempt")
    inner = rows.select(*keys, "attempt", F.col("_e")["renderabilityTrace"]["entries"].alias("_s"))
    return _exploded(inner, [*keys, "attempt"], F.col("_s"), "position").select(
        *keys, "attempt", "position", "_e.*"
    )


def list_entries(parsed: DataFrame, keys: Sequence[str], entries: Column, position: str) -> DataFrame:
    """Sessions or input-length points of a bundle, with their position."""
    return _exploded(parsed, keys, entries, position).select(*keys, position, "_e.*")


def write_tables(parsed: DataFrame, folder: str) -> None:
    """Write all series tables of the parsed packages below `folder`."""
    for name, build in (
        ("attempts", attempts),
        ("token_events", token_events),
        ("memory_samples", memory_samples),
        ("thermal_transitions", thermal_transitions),
    ):
        write_dataset(build(parsed), f"{folder}/{name}")
