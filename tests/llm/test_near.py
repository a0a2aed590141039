"""SimHash, vectors and components against brute force."""

import os

import numpy as np
import pytest
import xxhash

from gaugework.llm import queries, simhash, vectors
from gaugework.llm.components import components
from gaugework.session import shared_folder


def groups(count, links):
    parent = list(range(count))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(count)]


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(texts):
    prints = [plain_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    return [f"{p:016x}" for p in prints], groups(len(prints), near)


def test_components_of_chains_stars_and_repeats(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 60)] + [(7, 7), (3, 0), (3, 0)]
    links += [tuple(x) for x in rng.integers(200, 300, (70, 2)).tolist()] + [(None, 4), (5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = groups(300, real)
    assert got == {n: want[n] for n in {x for link in real for x in link}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op4_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    prints, roots = plain_components([d.text for d in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, folder).collect()}
    assert got == {d.doc_id: (p, docs[r].doc_id) for d, p, r in zip(docs, prints, roots)}


def test_simhash_odd_rows(spark):
    texts = [None, "", " \t", "one", "ONE", "a b c", "a b c d", "É a b c", "é a b c", "x " * 3000, "x " * 3001]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    prints, roots = plain_components(texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (p, r) for i, (p, r) in enumerate(zip(prints, roots))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    odd = docs.where("doc_id in (3, 4)").selectExpr("if(doc_id = 3, null, doc_id) doc_id", "text")
    assert {r.component_id for r in simhash.near_duplicates(odd.unionByName(odd)).collect()} == {4}


@pytest.mark.parametrize("rows", [100, 10**4, 10**7, 10**10])
def test_any_plan_keeps_every_pair(rows):
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sample[:150] = sample[0] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    plan = simhash.make_plan(sample, rows)
    assert sum(r + 1 for r in plan.radii) == simhash.DISTANCE + 1
    assert all(a & b == 0 for i, a in enumerate(plan.masks) for b in plan.masks[:i])
    for _ in range(300):
        flipped = sum(1 << int(b) for b in rng.choice(64, simhash.DISTANCE, replace=False))
        assert any((flipped & m).bit_count() <= r for m, r in zip(plan.masks, plan.radii))


def test_dense_group_with_outsiders(spark, monkeypatch):
    """One key holds most rows: the heavy bucket's own rows are not compared with each other."""
    monkeypatch.setattr(simhash, "HEAVY", 8)
    rng = np.random.default_rng(6)
    core = int(rng.integers(0, 1 << 62))
    values = {core}
    for _ in range(400):
        values.add(core ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    values |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    values = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    near = [
        (i, j)
        for i in range(len(values))
        for j in range(i)
        if ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 4
    ]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    sample = np.array(values, np.int64).view(np.uint64)
    for rows in (len(values), 10**7):
        links = simhash.near_links(frame, simhash.make_plan(sample, rows)).collect()
        at = {v: i for i, v in enumerate(values)}
        assert groups(len(values), [(at[r.a], at[r.b]) for r in links]) == groups(len(values), near)
        assert len(links) < len(near)


def plain_links(rows, cosine):
    units = {}
    for i, v in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            units[i] = np.array(v, float) / np.linalg.norm(v)
    pairs = [
        (i, j) for i in units for j in units if j < i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    ]
    counts = [sum(i in p for p in pairs) for i in range(len(rows))]
    return counts, groups(len(rows), pairs)


def clustered(rng, dim, count, centres):
    middle = rng.normal(size=(centres, dim))
    return [(middle[rng.integers(centres)] + rng.normal(scale=0.25, size=dim)).tolist() for _ in range(count)]


@pytest.mark.parametrize("dim", [1, 3, 12, 64])
def test_vectors_equal_all_pairs(spark, dim, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(dim)
    rows = clustered(rng, dim, 150, 12)
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim]
    rows += [[float("inf")] + [1.0] * (dim - 1), [1.0] * (dim + 1), [1.0] * (dim + 1)]
    frame = spark.createDataFrame(
        [(i, v, "clash", 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, vec string, n int"
    )
    counts, roots = plain_links(rows, vectors.COSINE)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    assert got == {i: (c, r, i == r) for i, (c, r) in enumerate(zip(counts, roots))}


def test_vectors_in_many_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = clustered(rng, 16, 300, 2)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    rows = [list(map(float, r.embedding)) for r in frame.orderBy("vec_id").collect()]
    monkeypatch.setattr(vectors, "CHUNK", 20)
    counts, roots = plain_links(rows, vectors.COSINE)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    assert got == {i: (c, r) for i, (c, r) in enumerate(zip(counts, roots))}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(empty).count() == 0
    only_null = spark.createDataFrame([(1, None), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(only_null).collect()}
    assert got == {1: (0, 1, True), None: (0, None, None)}


def on_disk(spark):
    """Bytes of Spark's own files and of the shared folder."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [str(x) for x in blocks.localDirsString()] + [shared_folder(spark).removeprefix("file:")]
    return sum(os.path.getsize(f"{d}/{x}") for top in tops for d, _, names in os.walk(top) for x in names)


def test_vectors_are_not_copied_to_disk_for_each_unit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 500)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(6000, 64)).astype(np.float32)
    rows[3000:3300] = rows[:300] + rng.normal(scale=0.05, size=(300, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    before = on_disk(spark)
    near = vectors.near_vectors(frame)
    assert near.where("n_links = 1").count() == 600
    assert near.where("kept").count() == 5700
    assert on_disk(spark) - before < 4 * rows.nbytes


@pytest.mark.parametrize("noise", [0.05, 0.35])
def test_links_of_two_chunks_and_within_one(noise, monkeypatch):
    for name, value in (("TILE", 16), ("STEP", 8), ("WIDE", 4), ("MERGED", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(5, 24))
    x = middle[rng.integers(5, size=200)] + rng.normal(scale=noise, size=(200, 24)) * rng.choice([0.3, 1], (200, 1))
    x *= rng.uniform(0.1, 9, (200, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.integers(1, 4, 200)
    space = vectors.Space(24, unit[::3], 9)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert 0 < near.sum() < near.size / 2
    chunks = [np.arange(200), np.arange(90), np.arange(90, 200)]
    sides = []
    for at in chunks:
        cell = space.cells(x[at])
        order = np.lexsort((-np.einsum("ij,ij->i", unit[at], space.centres[cell]), cell))
        sides.append((at[order], vectors.Side(space, x[at][order], cell[order])))
    for one, two in ((0, 0), (1, 2), (2, 1)):
        (at, left), (to, right) = sides[one], sides[two]
        both = at if one == two else np.concatenate([at, to])
        copies = [n[at]] if one == two else [n[at], n[to]]
        got = vectors.link_rows(left, x[at], right, x[to], copies, 0.95)
        inside = near[np.ix_(both, both)].copy()
        if one != two:
            inside[: len(at), : len(at)] = inside[len(at) :, len(at) :] = False
        assert got.count.tolist() == (inside @ n[both]).tolist()
        assert got.group.tolist() == groups(len(both), np.argwhere(inside).tolist())


def test_repeated_vectors_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SEEN", 5)
    monkeypatch.setattr(vectors, "CHUNK", 7)
    rng = np.random.default_rng(13)
    base = clustered(rng, 8, 30, 6)
    rows = [base[i] for i in rng.integers(0, 30, 200)]
    rows += [[1e300] * 8, [2e300] * 8, [1e-300] * 8, [3.0] * 8, [1e-30] * 8]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(5)
    scaled = [[x / max(map(abs, v)) for x in v] for v in rows]
    counts, roots = plain_links(scaled, vectors.COSINE)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    assert got == {i: (c, r) for i, (c, r) in enumerate(zip(counts, roots))}
