"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import map_texts, materialize
from gaugework.llm.components import components

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
# Fingerprints looked at to find correlated bits and to estimate candidates.
PLAN_SAMPLE = 2048
# A bucket of this many fingerprints has its largest component looked up.
HEAVY = 256
_ROWS = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Majority of each bit over the hashes of all shingles, as a signed 64-bit number."""
    words = text.lower().split() if text else []  # bytes: only A-Z change
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = [0, *(ends[: -SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(first, ends[SHINGLE - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), _ROWS):
        ones += np.unpackbits(rows[at : at + _ROWS], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(rows)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one 64-bit fingerprint for every row."""

    def make():
        return lambda texts, _: {"fp": [fingerprint(t) for t in texts]}

    return map_texts(docs, [id_col], text_col, "fp long", make)


class Plan:
    """Bit masks of the partitions and the distance each of them is probed to."""

    def __init__(self, masks: list[int], radii: list[int]):
        kept = [(m, r) for m, r in zip(masks, radii) if r >= 0]
        self.masks = [m for m, _ in kept]
        self.radii = [r for _, r in kept]

    def keys(self, value: Column) -> Column:
        """What a fingerprint is indexed under: (part, masked bits) for every partition."""
        return F.array(
            *[
                F.struct(F.lit(i).alias("part"), value.bitwiseAND(F.lit(_signed(m))).alias("key"))
                for i, m in enumerate(self.masks)
            ]
        )

    def probes(self, value: Column) -> Column:
        """All keys within each partition's distance."""
        parts = [_around(value, i, m, r) for i, (m, r) in enumerate(zip(self.masks, self.radii))]
        return F.concat(*parts)


def _around(value: Column, part: int, mask: int, radius: int) -> Column:
    masked = value.bitwiseAND(F.lit(_signed(mask)))
    flips = F.array(*[F.lit(_signed(x)) for x in _flips(mask, radius)])
    return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), masked.bitwiseXOR(x).alias("key")))


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _flips(mask: int, radius: int) -> list[int]:
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for r in range(radius + 1) for c in itertools.combinations(bits, r)]


def make_plan(sample: np.ndarray, rows: int, distance: int = DISTANCE) -> Plan:
    """Cheapest partitions and radii for `rows` distinct fingerprints.

    For 2 to distance + 1 partitions, bits that agree or disagree most often in
    the sample are put together, so that the other partitions tell more.  By the
    generalised pigeonhole, two fingerprints within `distance` agree within the
    radius of at least one partition if the radii sum to distance - parts + 1,
    where -1 leaves a partition out.  Dynamic programming picks the radii by
    probes sent plus candidates expected.  The sample only steers cost: every
    choice finds every link.
    """
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.int8)
    with np.errstate(invalid="ignore", divide="ignore"):
        tied = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((BITS, BITS))
    best: tuple[float, Plan] | None = None
    for parts in range(2, distance + 2):
        masks = _group(tied, parts)
        radii, cost = _allocate(sample, masks, rows, distance - parts + 1)
        if best is None or cost < best[0]:
            best = (cost, Plan(masks, radii))
    return best[1]


def _group(tied: np.ndarray, parts: int) -> list[int]:
    free, masks = set(range(BITS)), []
    for p in range(parts):
        width = (BITS + p) // parts
        own = [max(free, key=lambda b: (tied[b, list(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < width:
            nearest = max(free, key=lambda b: (tied[b, own].sum(), -b))
            own.append(nearest)
            free.discard(nearest)
        masks.append(sum(1 << b for b in own))
    return masks


def _allocate(sample: np.ndarray, masks: list[int], rows: int, total: int) -> tuple[list[int], float]:
    """Radii that sum to `total`, each at least -1, at the least estimated cost."""
    highest = min(total + len(masks) - 1, 2)
    costs = [_costs(sample, m, rows, highest) for m in masks]
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, radii) in table.items():
            for r in range(-1, highest + 1):
                new = cost + (own[r] if r >= 0 else 0.0)
                if spent + r not in after or new < after[spent + r][0]:
                    after[spent + r] = (new, [*radii, r])
        table = after
    cost, radii = table[total] if total in table else (np.inf, [])
    return radii, cost


def _costs(sample: np.ndarray, mask: int, rows: int, highest: int) -> list[float]:
    """Probes plus a twentieth of the candidates (a check costs far less), by radius."""
    part = sample & np.uint64(mask)
    width = int(mask).bit_count()
    seen = np.zeros(highest + 1)
    for at in range(0, len(part), 256):
        apart = np.bitwise_count(part[at : at + 256, None] ^ part[None, :])
        seen += [(apart <= r).sum() for r in range(highest + 1)]
    pairs = max(len(part) * (len(part) - 1), 1)
    out = []
    for r in range(highest + 1):
        ball = sum(comb(width, k) for k in range(r + 1))
        share = max((seen[r] - len(part)) / pairs, ball / 2.0**width)
        out.append(rows * ball + 0.05 * rows * rows * share)
    return out


def near_links(values: DataFrame, plan: Plan, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links whose components are those of all pairs within `distance`.

    `values` (fp) are distinct.  First every fingerprint is compared with the
    least one of each bucket it is indexed in, which ties dense groups together
    at one link a member.  Then all probes are joined with the index, and pairs
    within `distance` that are not tied yet become links.  In a heavy bucket
    the rows of its largest component stand apart, and probes from that
    component skip them: nothing there could give a new link, and a dense group
    is not compared with itself.
    """
    indexed = materialize(values.select("fp", F.explode(plan.keys(F.col("fp"))).alias("k")).select("fp", "k.*"))
    buckets = indexed.groupBy("part", "key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= distance
    leaders = materialize(
        indexed.join(buckets, ["part", "key"])
        .where(near & (F.col("fp") != F.col("least")))
        .select(F.col("least").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )
    tied = materialize(components(leaders))
    placed = values.join(tied.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("comp")
    )
    placed = materialize(placed)
    rows = placed.select("fp", "comp", F.explode(plan.keys(F.col("fp"))).alias("k")).select("fp", "comp", "k.*")
    heavy = buckets.where(F.col("n") >= HEAVY).select("part", "key")
    major = materialize(
        rows.join(heavy, ["part", "key"])
        .groupBy("part", "key", "comp")
        .agg(F.count("*").alias("n"))
        .groupBy("part", "key")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("major"))
    )
    index = rows.join(major, ["part", "key"], "left").select(
        "part",
        "key",
        F.coalesce(F.col("major") == F.col("comp"), F.lit(False)).alias("big"),
        F.col("fp").alias("b"),
        F.col("comp").alias("comp_b"),
    )
    sides = F.when(
        F.col("major").isNotNull() & (F.col("major") != F.col("comp")), F.array(F.lit(False), F.lit(True))
    ).otherwise(F.array(F.lit(False)))
    probes = (
        placed.select(F.col("fp").alias("a"), "comp", F.explode(plan.probes(F.col("fp"))).alias("k"))
        .select("a", "comp", "k.*")
        .join(major, ["part", "key"], "left")
        .select("part", "key", F.explode(sides).alias("big"), "a", "comp")
    )
    fresh = (
        probes.join(index, ["part", "key", "big"])
        .where(
            (F.col("comp") != F.col("comp_b"))
            & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        )
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    return leaders.unionByName(fresh)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    prints: Callable[..., DataFrame] = fingerprints,
) -> DataFrame:
    """(id, fingerprint, component_id): groups of documents tied by near fingerprints.

    component_id is the least id that is reachable.  Copies share a fingerprint
    and so one node; texts without a word have fingerprint zero and tie like any
    other.  A null text counts as no word.  Repeated ids are rows like others; a
    null id is never a component_id unless its group has no other.
    """
    rows = materialize(prints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    count = classes.count()
    picked = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    sample = np.array([r.fp for r in picked], np.int64).view(np.uint64)
    links = materialize(near_links(classes.select("fp"), make_plan(sample, count, distance), distance))
    tied = components(links).select(F.col("node").alias("fp"), "component")
    grouped = materialize(
        classes.join(tied, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    )
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
