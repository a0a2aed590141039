"""Digests, identities, identifiers and version text."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SHA256_PATTERN = "^[0-9a-f]{64}$"
# Fixed value: the URL name space of version-5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@F.pandas_udf(StringType())
def canonical_json_sha256(texts: pd.Series) -> pd.Series:
    """SHA-256 of JSON re-written with sorted keys, no spaces and ASCII escapes; null if malformed."""

    def digest(text):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:  # one malformed document is a null, not a failed job
            return None
        compact = json.dumps(value, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(compact.encode()).hexdigest()

    return texts.map(digest)


def identity_json(plain: dict[str, Column], fragments: dict[str, Column] | None = None) -> Column:
    """JSON object text from plain columns and from columns already holding JSON."""
    text = F.to_json(
        F.struct(*[c.alias(n) for n, c in plain.items()]), {"ignoreNullFields": "false"}
    )
    for name, fragment in (fragments or {}).items():
        text = F.concat(
            F.left(text, F.length(text) - 1),
            F.lit(f',"{name}":'),
            F.coalesce(fragment, F.lit("null")),
            F.lit("}"),
        )
    return text


def engine_key(fields: dict[str, Column]) -> Column:
    """Group key for an exact identity: nulls kept, field names in sorted order."""
    ordered = {name: fields[name] for name in sorted(fields)}
    return F.sha2(identity_json(ordered), 256)


def canonical_uuid(text: Column) -> Column:
    """Lower-cased UUID text, or null when it is not canonical UUID text."""
    return F.when(F.lower(text).rlike(UUID_PATTERN), F.lower(text))


def uuid5(text: Column) -> Column:
    """Version-5 UUID of `text` in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(text, "UTF-8")))
    part = lambda start, size: F.substring(digest, start, size)
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat_ws(
        "-",
        part(1, 8),
        part(9, 4),
        F.concat(F.lit("5"), part(14, 3)),
        F.concat(variant, part(18, 3)),
        part(21, 12),
    )


def version_numbers(text: Column) -> Column:
    """The numbers in a version, of any size, as (digits, text) pairs that sort by value."""
    pair = lambda n: F.struct(F.length(n).alias("digits"), n.alias("text"))
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+)"), 1),
        lambda n: pair(F.regexp_replace(n, "^0+(?=.)", "")),
    )
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(pair(F.lit("0"))))


def minor_family(text: Column) -> Column:
    """First two numbers of a version; patch releases share a family."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    return F.when(F.size(numbers) >= 2, F.array_join(F.slice(numbers, 1, 2), ".")).otherwise(text)


def profile_slug(artifact: Column, runtime: Column, version: Column, device: Column) -> Column:
    """Profile identifier from the last part of the artifact, runtime and device."""
    return F.concat_ws(
        "-",
        F.lit("ship"),
        F.replace(F.lower(F.substring_index(artifact, "/", -1)), F.lit("."), F.lit("-")),
        F.replace(F.lower(runtime), F.lit(" "), F.lit("-")),
        version,
        F.replace(F.lower(device), F.lit(","), F.lit("-")),
    )
