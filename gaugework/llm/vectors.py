"""Embedding near-duplicates: all pairs of bounded chunks, pruned by angles and by leading rotated axes."""

from __future__ import annotations

from collections import Counter, OrderedDict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import materialize
from gaugework.llm.components import components

COSINE = 0.95
# Vectors looked at for the rotation and the centres; any of both find the same links.
SAMPLE = 4096
# Rows and bytes of a chunk, at most about; small tables get chunks enough for all cores.
CHUNK = 1 << 15
CHUNK_BYTES = 8 << 20
LEAST_CHUNK, LEAST_CHUNKS = 2048, 16
# Classes of a cell, about, and rows of a tile of it.
CELL = 4096
TILE = 1024
# Rotated axes of the first filter.
PREFIX = 22
# Pairs compared at once: rows of one side and of the other.
STEP, WIDE = 1024, 256
# Chunks of a task's range, all kept once they are prepared; links it gathers before it merges their groups.
KEPT = 8
MERGED = 1 << 20
# Digests that a task remembers while it deals out vectors.
SEEN = 1 << 17


class Space:
    """Leading principal axes and centres of one dimension, from a sample of unit vectors."""

    def __init__(self, dim: int, sample: np.ndarray, cells: int):
        axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))[1][:, ::-1] if len(sample) > 1 else np.eye(dim)
        self.turn = axes[:, :PREFIX].astype(np.float32)
        self.centres = (sample[: max(1, cells)] if len(sample) else np.eye(1, dim)).astype(np.float32)
        # sums of products of whole numbers are exact, so equal vectors get the same cell in any batch
        self.exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        self.marks = np.rint(127 * self.centres).astype(self.exact)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The centre next to each vector, about."""
        out = np.empty(len(x), np.int32)
        for at in range(0, len(x), WIDE):
            part = x[at : at + WIDE]
            steps = np.rint(127 * (part / np.abs(part).max(1, keepdims=True))).astype(self.exact)
            out[at : at + WIDE] = (steps @ self.marks.T).argmax(1)
        return out


class Side:
    """A chunk as one side of a unit: rows by cell and by angle to its centre, in tiles."""

    def __init__(self, space: Space, x: np.ndarray, cells: np.ndarray):
        dim = x.shape[1]
        self.length, unit = _unit(x)
        self.unit = unit.astype(np.float32)
        turned = self.unit @ space.turn
        norm, one = (turned**2).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
        # the product of the two is a squared distance on the leading axes
        self.left, self.right = np.hstack([turned, norm, one]), np.hstack([-2 * turned, one, norm])
        # bounds of single-precision rounding, of a dot product and of that distance
        self.dot_slack = (dim + 16) * 2.0**-23
        self.slack = 16 * (dim + 16) * 2.0**-23
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        ends = np.append(starts[1:], len(cells))
        self.centres = space.centres[cells[starts]]
        self.tiles = []  # first row, row behind the last, cell, widest angle
        self.own = np.empty(len(x), np.float32)
        for cell, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            dots = self.unit[start:end] @ self.centres[cell]
            self.own[start:end] = np.arccos(np.clip(dots - self.dot_slack, -1, 1))
            for at in range(start, end, TILE):
                stop = min(at + TILE, end)
                self.tiles.append((at, stop, cell, self.own[at:stop].max()))

    def angles(self, other: Side) -> np.ndarray:
        """For each centre of the other side the least angle of each of these rows to it."""
        return np.arccos(np.clip(other.centres @ self.unit.T + self.dot_slack, -1, 1))


class Links:
    """Number of links and local group of every row."""

    def __init__(self, n: np.ndarray):
        self.n, self.count, self.group = n, np.zeros(len(n), np.int64), np.arange(len(n))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        np.add.at(self.count, u, self.n[v])
        np.add.at(self.count, v, self.n[u])
        self.tie(u, v)

    def tie(self, u: np.ndarray, v: np.ndarray) -> None:
        new = self.group[u] != self.group[v]
        if new.any():
            self.held.append((u[new], v[new]))
            self.rows += int(new.sum())
        if self.rows > MERGED:
            self.merge()

    def merge(self) -> None:
        if self.held:
            _merge(self.group, *map(np.concatenate, zip(*self.held)))
        self.held, self.rows = [], 0


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and unit vectors, in double precision."""
    wide = x.astype(np.float64)
    length = np.sqrt((wide**2).sum(1))
    return length, wide / length[:, None]


def _usable(column: pa.Array):
    """For each dimension the rows of vectors that can link, and these."""
    flat = column.values.to_numpy(zero_copy_only=False)  # null components are nan
    offsets = column.offsets.to_numpy()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[offsets[at][:, None] + np.arange(dim)]
        fit = np.isfinite(x).all(1) & x.any(1)
        at, x = at[fit], x[fit]
        if x.dtype == np.float64:  # squares of others are neither infinite nor lost
            most = np.abs(x).max(1, keepdims=True)
            x = np.where((most > 1e150) | (most < 1e-150), x / most, x)
        if len(at):
            yield dim, at, np.ascontiguousarray(x)


def _digests(x: np.ndarray) -> list[bytes]:
    data, width = memoryview(x.tobytes()), x.shape[1] * x.itemsize
    return [blake2b(data[i : i + width], digest_size=16).digest() for i in range(0, len(data), width)]


def _spaces(vectors: DataFrame) -> dict[int, Space]:
    """One rotation and its centres for each dimension in a sample of different vectors."""
    total = vectors.count()
    mixed = F.xxhash64("v")
    some = vectors.select("v").where(F.size("v") > 0)
    if total > 4 * SAMPLE:
        some = some.where(F.pmod(mixed, F.lit(total // (2 * SAMPLE))) == 0)
    table = some.dropDuplicates().orderBy(mixed).limit(SAMPLE).toArrow()
    sample: dict[int, list[np.ndarray]] = {}
    for column in table.column("v").chunks:
        for dim, _, x in _usable(column):
            sample.setdefault(dim, []).append(_unit(x)[1])
    return {dim: Space(dim, np.concatenate(x), -(-total // CELL)) for dim, x in sample.items()}


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, n_links, component_id, kept) for every vector.

    Equal vectors are one class, known by a 128-bit digest.  Every class goes
    to the cell of one of some sampled centres; cells are filled into chunks of
    bounded size, large ones are cut by digest, and a chunk is one row of a
    table.  So a vector is shuffled once and written once, whatever the size of
    the table.  Every pair of chunks is a unit that reads its two rows: a
    Cartesian product without a shuffle.

    Partners are at most the cosine's angle apart, and by the triangle
    inequality so are their angles to any centre; what passes for the centres
    of both cells is compared on the leading rotated axes, and what is close on
    these has its cosine verified in double precision.  A unit returns a number
    of links and a local group for each class, never pairs.  Groups then meet in
    connected components.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do vectors of different dimension: n_links 0, their
    own component.  A repeated id is a vector like others.  `kept` is null for a
    null id.  `vectors` is read more than once, so it has to be a stored table
    or a plan that returns the same rows again.
    """
    spark = vectors.sparkSession
    wide = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    number = np.float64 if wide else np.float32
    picked = vectors.select(
        vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>" if wide else "array<float>").alias("v")
    )
    kind = picked.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(_spaces(picked))

    def space(dim: int) -> Space:
        return shared.value.get(dim) or Space(dim, np.zeros((0, dim)), 1)

    def name(batches):
        for batch in batches:
            digest: list[bytes | None] = [None] * batch.num_rows
            dims, cells = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for dim, at, x in _usable(batch.column(1)):
                dims[at], cells[at] = dim, space(dim).cells(x)
                for i, d in zip(at.tolist(), _digests(x)):
                    digest[i] = d
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(dims), pa.array(cells)],
                names=["id", "digest", "dim", "cell"],
            )

    rows = materialize(picked.mapInArrow(name, f"id {kind}, digest binary, dim int, cell int"))
    classes = materialize(
        rows.where("digest is not null")
        .groupBy("digest", "dim", "cell")
        .agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    )
    cells = classes.groupBy("dim", "cell").count().collect()
    dims, places = _deal({(r.dim, r.cell): r["count"] for r in cells}, np.dtype(number).itemsize)
    dealt_to = spark.sparkContext.broadcast(places)

    def deal(batches):
        seen: dict[bytes, int] = {}  # what this task has passed on goes only as a number from then on
        again: Counter[bytes] = Counter()

        def repeats() -> pa.RecordBatch:
            rest = list(again)
            counts = pa.array([again[d] for d in rest], pa.int64())
            at, none = pa.array([seen[d] for d in rest], pa.int32()), pa.nulls(len(rest), pa.binary())
            seen.clear(), again.clear()
            return pa.RecordBatch.from_arrays([at, pa.array(rest, pa.binary()), counts, none], names=names)

        names = ["at", "digest", "n", "vec"]
        for batch in batches:
            for dim, _, x in _usable(batch.column(1)):
                digests = _digests(x)
                new = {}
                for i, d in enumerate(digests):
                    if d in seen or d in new:
                        again[d] += 1
                    else:
                        new[d] = i
                if new:
                    x = x[list(new.values())]
                    start, parts = dealt_to.value[dim][:, space(dim).cells(x)]
                    if not parts.all():
                        raise RuntimeError("the vectors are not the same when they are read again")
                    at = start + np.frombuffer(b"".join(new), np.uint32)[::4] % parts
                    seen.update(zip(new, at.tolist()))
                    cells = [pa.array(at, pa.int32()), pa.array(list(new), pa.binary()), pa.array(np.ones(len(x), np.int64))]
                    yield pa.RecordBatch.from_arrays(
                        [*cells, pa.array([row.tobytes() for row in x], pa.binary())], names=names
                    )
                if len(seen) > SEEN:
                    yield repeats()
        yield repeats()

    def pack(table: pa.Table) -> pa.Table:
        at = table.column("at")[0].as_py()
        dim, named, n = dims[at], table.column("digest").to_pylist(), table.column("n").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), number).reshape(-1, dim)
        cell = space(dim).cells(x)
        dots = np.einsum("ij,ij->i", _unit(x)[1], space(dim).centres[cell])
        order = np.lexsort((-dots, cell))
        return pa.table(
            {
                "at": pa.array([at], pa.int32()),
                "dim": pa.array([dim], pa.int32()),
                "digests": pa.array([b"".join([named[i] for i in order])], pa.binary()),
                "n": pa.array([n[order].tobytes()], pa.binary()),
                "cells": pa.array([cell[order].tobytes()], pa.binary()),
                "vecs": pa.array([x[order].tobytes()], pa.binary()),
            }
        )

    dealt = picked.mapInArrow(deal, "at int, digest binary, n long, vec binary").repartition("at")
    distinct = dealt.groupBy("at", "digest").agg(F.sum("n").alias("n"), F.first("vec", ignorenulls=True).alias("vec"))
    packed = distinct.groupBy("at").applyInArrow(
        pack, "at int, dim int, digests binary, n binary, cells binary, vecs binary"
    )
    chunks = materialize(packed, rows_per_file=1)
    count = len(dims)
    ranges = max(-(-count // KEPT), min(count, int((8 * spark.sparkContext.defaultParallelism) ** 0.5) + 1), 1)
    one, two = (
        chunks.coalesce(ranges).select(*[F.col(c).alias(f"{side}_{c}") for c in chunks.columns]) for side in "ab"
    )
    # half of a ring: each pair of chunks comes once, and every task has its share
    ahead = F.pmod(F.col("b_at") - F.col("a_at"), F.lit(max(1, count)))
    once = (ahead * 2 < count) | ((ahead * 2 == count) & (F.col("a_at") < F.col("b_at")))
    pairs = one.hint("shuffle_replicate_nl").join(two, once & (F.col("a_dim") - F.col("b_dim") == 0))
    fields = chunks.columns

    def join(batches):
        ready: OrderedDict[int, Side] = OrderedDict()

        def side(chunk: dict) -> tuple[Side, np.ndarray]:
            x = np.frombuffer(chunk["vecs"], number).reshape(-1, chunk["dim"])
            if chunk["at"] not in ready:
                ready[chunk["at"]] = Side(space(chunk["dim"]), x, np.frombuffer(chunk["cells"], np.int32))
                if len(ready) > KEPT + 2:
                    ready.popitem(last=False)
            ready.move_to_end(chunk["at"])
            return ready[chunk["at"]], x

        for batch in batches:
            for i in range(batch.num_rows):
                cells = [_view(column[i]) for column in batch.columns]
                a, b = dict(zip(fields, cells)), dict(zip(fields, cells[len(fields) :]))
                own = [a] if a["at"] == b["at"] else [a, b]
                links = link_rows(*side(a), *side(b), [np.frombuffer(c["n"], np.int64) for c in own], cosine)
                hit = np.flatnonzero(links.count)
                node = np.concatenate([(c["at"] << 32) + np.arange(len(c["n"]) // 8) for c in own])
                digests = np.concatenate([np.frombuffer(c["digests"], "V16") for c in own])[hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[hit]),
                        pa.array([d.tobytes() for d in digests], pa.binary()),
                        pa.array(links.count[hit]),
                        pa.array(node[links.group[hit]]),
                    ],
                    names=["node", "digest", "links", "near"],
                )

    found = materialize(pairs.mapInArrow(join, "node long, digest binary, links long, near long"))
    counted = found.groupBy("node").agg(F.first("digest").alias("digest"), F.sum("links").alias("links"))
    tied = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")).distinct())
    joined = materialize(
        counted.join(tied, "node").join(classes.select("digest", "least_id"), "digest").select(
            "digest", "links", "component", "least_id"
        )
    )
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.join(least, "component").select("digest", "links", "component_id")
    # the classes of more than one row or with a link; all other rows stand alone
    linked = (
        classes.join(named, "digest", "left")
        .where("n > 1 or links is not null")
        .select(
            "digest",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.when(F.col("links").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    out = rows.select("id", "digest").join(linked, "digest", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)


def _deal(cells: dict[tuple[int, int], int], itemsize: int) -> tuple[list[int], dict[int, np.ndarray]]:
    """Dimension of every chunk; for each dimension the first chunk of a cell, and over how many its classes go."""
    enough = max(LEAST_CHUNK, -(-sum(cells.values()) // LEAST_CHUNKS))
    widths = dict(sorted(cells))  # the last cell of each dimension
    dims: list[int] = []
    places: dict[int, np.ndarray] = {}
    filled = 0
    for (dim, cell), count in sorted(cells.items()):
        limit = max(1, min(CHUNK, enough, CHUNK_BYTES // (dim * itemsize)))
        if dim not in places:
            places[dim] = np.zeros((2, widths[dim] + 1), np.int64)
            filled = limit
        parts = -(-count // limit)
        if parts > 1 or filled + count > limit:
            dims += [dim] * parts
            filled = 0
        places[dim][:, cell] = len(dims) - parts, parts
        filled = filled + count if parts == 1 else limit
    return dims, places


def _view(cell: pa.Scalar):
    """A value; bytes are not copied."""
    return memoryview(cell.as_buffer()) if pa.types.is_binary(cell.type) else cell.as_py()


def link_rows(
    one: Side, x: np.ndarray, two: Side, y: np.ndarray, n: list[np.ndarray], cosine: float
) -> Links:
    """Links between the rows of two chunks, or within one if both sides are the same.

    `x` and `y` are the vectors as they were given, `n` the copies of each row.
    """
    same = one is two
    links = Links(np.concatenate(n))
    behind = 0 if same else len(x)
    reach = float(np.arccos(np.clip(cosine, -1, 1))) + 1e-5
    limit = np.float32(2 - 2 * cosine + one.slack)
    to_one, to_two = two.angles(one), one.angles(two)
    room, marks = np.empty(STEP * WIDE, np.float32), np.zeros(STEP * WIDE + 8, bool)
    for i, (start, stop, cell, most) in enumerate(one.tiles):
        ahead = two.tiles[i if same else 0 :]
        close = ahead[0][0] + np.flatnonzero(to_one[cell, ahead[0][0] :] <= most + reach)
        rights = two.right[close]
        cuts = np.searchsorted(close, [last for _, last, *_ in ahead]).tolist()
        for (first, _, other, _), before, behind_it in zip(ahead, [0, *cuts], cuts):
            v, right = close[before:behind_it], rights[before:behind_it]
            if not len(v):
                continue
            u = start + np.flatnonzero(to_two[other, start:stop] <= two.own[v].max() + reach)
            left = one.left[u]
            for p in range(0, len(u), STEP):
                for q in range(0, len(v), WIDE):
                    rows, columns = left[p : p + STEP], right[q : q + WIDE]
                    apart = np.matmul(rows, columns.T, out=room[: len(rows) * len(columns)].reshape(len(rows), -1))
                    near = _few(np.less_equal(apart.ravel(), limit, out=marks[: apart.size]), marks)
                    if not len(near):
                        continue
                    if len(near) * 16 > apart.size:  # most are links: what is sure needs no second look
                        near = _sure(links, one, two, u[p : p + STEP], v[q : q + WIDE], behind, near, cosine)
                    a, b = np.divmod(near, len(columns))
                    a, b = u[p + a], v[q + b]
                    if same and start == first:
                        a, b = a[a < b], b[a < b]
                    for at in range(0, len(a), 1 << 15):
                        r, s = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                        ok = _cosines(x[r], one.length[r], y[s], two.length[s]) >= cosine
                        links.add(r[ok], s[ok] + behind)
    links.merge()
    return links


def _few(flags: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where the first of `marks` are true, by words of eight: few are."""
    marks[len(flags) : len(flags) + 8] = False
    words = np.flatnonzero(marks[: -(-len(flags) // 8) * 8].view(np.uint64))
    some = (words[:, None] * 8 + np.arange(8)).ravel()
    return some[marks[some]]


def _cosines(x: np.ndarray, x_length: np.ndarray, y: np.ndarray, y_length: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x / x_length[:, None], y / y_length[:, None])


def _sure(
    links: Links, one: Side, two: Side, u: np.ndarray, v: np.ndarray, behind: int, near: np.ndarray, cosine: float
) -> np.ndarray:
    """Adds the links that no rounding can undo; those of `near` that have to be verified."""
    dots = one.unit[u] @ two.unit[v].T
    sure = dots >= cosine + one.dot_slack
    if not behind:  # one chunk with itself: each pair once
        sure &= u[:, None] < v
    a, b = np.nonzero(sure)
    links.count[u] += sure @ links.n[v + behind]
    np.add.at(links.count, v + behind, links.n[u] @ sure)
    links.tie(u[a], v[b] + behind)
    open_ = np.abs(dots.ravel()[near] - cosine) <= one.dot_slack
    return near[open_]


def _merge(group: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Gives linked rows, and all that were grouped with them, the same least row."""
    while True:
        a, b = group[u], group[v]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(group, high, low)
        while True:  # every row points at the root of its group
            up = group[group]
            if (up == group).all():
                break
            group[:] = up
