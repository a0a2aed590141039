"""Conversation trie, ranked search and mixing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugework.llm import conversation_trie, mixing, ranked_search
from gaugework.session import ROWS_PER_SLICE

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, pos int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            pair = (role or "", text or "")
            tid = hashlib.md5(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, tid, pair))
    turns = {c: [t[3] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = tuple(turns.get(conv - conv % 5, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in sorted(rebuilt.items()):
        ends[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        out.add((
            convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), kids[path],
            sum(not kids[p] for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
            hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
        ))
    return out


def built(spark, rows, limit):
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    turns = conversation_trie.numbered_turns(frame)
    nodes = conversation_trie.prefix_trie(*conversation_trie.share_openings(turns), limit).select(*COLUMNS).collect()
    got = {tuple(r) for r in nodes}
    assert len(got) == len(nodes)
    return got


def trie_rows():
    rng = np.random.default_rng(11)
    rows = []
    for conv in range(60):
        shared = int(rng.integers(0, 6)) if conv % 3 else 0
        words = [f"s{t}é" for t in range(shared)] + [f"w{rng.integers(0, 3)}" for _ in range(int(rng.integers(0, 5)))]
        rows += [(conv, t, ("user", "bot")[t % 2], w, "x", 1) for t, w in enumerate(words)]
    rows += [(c, t, "user", f"same {t}", "x", 1) for c in range(100, 120) for t in range(12)]  # a group of copies
    rows += [(200, t, "user", f"long {t // 2}", "x", 1) for t in range(40)] + [(201, t, "user", f"long {t // 2}", "x", 1) for t in range(41)]
    rows += [(300, None, None, None, None, None), (300, 0, None, "a", "", 1), (300, 0, "b", None, "", 1), (300, 0, "b", None, "", 1)]
    rows += [(None, 0, "user", "nobody", "", 1), (301, 1, "user", "x" * 300_000, "", 1)]
    return rows


@pytest.mark.parametrize("limit", [3, 40, 10**6])
def test_trie_equals_all_prefixes(spark, limit):
    rows = trie_rows()
    assert built(spark, rows, limit) == plain_trie(rows)


def test_trie_with_conversations_cut_into_slices(sliced):
    rows = trie_rows()
    assert built(sliced, rows, 40) == plain_trie(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert built(spark, [], 10) == set()
    rows = [(c, 0, "user", "hi", "", 1) for c in (1, 2, 3, 4, 6, 7)]  # no opening to take
    assert built(spark, rows, 10) == plain_trie(rows)


WORDS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, top):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, own in counts:
            m = 10 + 90 * sum(own.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
                for t in set(plain_terms(text)) if own[t]
            )
            if score:
                scored.append((-score, doc is None, doc, score))
        out += [(item, r, doc, score) for r, (_, _, doc, score) in enumerate(sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:top], 1)]
    return sorted(out, key=str)


def search_tables():
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"{'Ab'[int(x) % 2]}{x}" for x in np.minimum(rng.zipf(1.4, n), 60))
    docs = [(d, text(int(rng.integers(1, 40)))) for d in range(300)]
    docs += [(900 - d, docs[5][1]) for d in range(40)] + [(None, docs[5][1]), (7, docs[5][1]), (7, docs[5][1])]
    docs += [(1000, None), (1001, ""), (1002, " \t-_"), (1003, "é Ünï A1\x00b2 " * 30_000), (1004, docs[9][1].upper())]
    items = [(i, text(15)) for i in range(25)] + [(30, docs[5][1]), (31, None), (32, "..."), (33, "nowhere"), (34, "ünï é"), (30, "Ünï")]
    return docs, items


@pytest.mark.parametrize("block, cells", [(1 << 20, 8 << 20), (300, 4000)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    docs, items = search_tables()
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, item int").repartition(3)
    wanted = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = ranked_search.rank_documents(table, wanted, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items, 10)


def test_ranked_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    none = spark.createDataFrame([], docs)
    assert ranked_search.rank_documents(none, spark.createDataFrame([(1, "a")], items)).count() == 0
    assert ranked_search.rank_documents(some, spark.createDataFrame([], items)).count() == 0
    assert ranked_search.rank_documents(some, spark.createDataFrame([(1, None)], items)).count() == 0


def test_search_leaves_out_most_of_a_tree():
    rng = np.random.default_rng(3)
    groups = [[4 * g + x for x in range(4)] for g in range(100)]
    ranks = np.array([r for g in groups for _ in range(10) for r in g])
    counts = rng.integers(1, 4, len(ranks))
    tree = ranked_search.Tree(list(range(1000)), [50] * 1000, np.arange(0, 4001, 4), ranks, counts, 400)
    seen = []
    below = tree._worthy
    tree._worthy = lambda *a: (seen.append(1), below(*a))[1]
    best = []
    tree.search(np.array([40, 41]), np.array([900, 1000]), best, 10)
    assert len(best) == 10 and {-d // 10 for _, d in best} == {10} and len(seen) < 30


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**target, **share}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def mixing_rows():
    rng = np.random.default_rng(13)
    sources = ["b", "B", None, "", "é", "zz", "tiny", "none"]
    rows = []
    for d in range(3000):
        source = sources[int(rng.integers(0, 6))] if d % 3 else "zz"  # zz holds a third and more
        rows.append((d, source, " ".join(["w"] * int(rng.zipf(1.8) % 300))))
    rows += [(5, "b", "a b c")] * 500 + [(None, "b", "x\ty")] * 70 + [(1, "tiny", "one"), (2, "none", None), (3, "none", " \n")]
    rows += [(9000, "B", "long " * 50_000), (9001, "b", "  lead and\x0b trail\r\n"), (9002, "b", "no\xa0break")]
    return rows


def mixed(spark, rows, parts, **more):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, target string")
    return mixing.plan_copies(frame.repartition(parts), **more)


def test_mixing_meets_its_targets(spark):
    rows = mixing_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += size(text)
    targets = plain_targets(dict(sizes), (1, 2, 3), 3)
    got = mixed(spark, rows, 7).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, size(t)) for d, s, t in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and (not r.size or math.floor(rate) <= r.copies <= math.ceil(rate - 1e-9))
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source] / 2 + 1e-6
    again = mixed(spark, rows, 2).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixing_takes_documents_with_their_own_probability(spark):
    rows = [(d, "ab"[d % 2], "w " * (1 + d % 7)) for d in range(140)]
    copies = Counter()
    for seed in range(40):
        for r in mixed(spark, rows, 1, weights=(1, 3), seed=seed).collect():
            copies[r.source, r.size] += r.copies
            rate = {"a": None, "b": None}
            rate[r.source] = r.target / r.source_size
            copies[r.source, "rate"] = rate[r.source]
    for source in "ab":
        for size in range(1, 8):
            count = sum(1 for d in range(140) if "ab"[d % 2] == source and 1 + d % 7 == size)
            assert copies[source, size] / 40 / count == pytest.approx(copies[source, "rate"], abs=0.12)


def test_mixing_of_odd_tables(spark):
    assert mixed(spark, [], 1).count() == 0
    assert [(r.target, r.taken) for r in mixed(spark, [(1, "a", None), (1, None, "")], 1).collect()] == [(0, 0), (0, 0)]
    alone = mixed(spark, [(1, None, "a b c")], 1).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(3, 3.0, 3)]
