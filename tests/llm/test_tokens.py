"""Packing, BPE and token counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gaugework.llm import bpe, packing, queries, token_counts
from gaugework.llm.vocabulary import split_words

BYTE, WORD = Tokenizer.from_file(queries.BYTE_BPE), Tokenizer.from_file(queries.WORD_BPE)
PARTS = [
    "a", "b", "e", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "日本", "1", "²", "_", "-", "!!", "\x1c",
    "\x85", "\xa0", "　", "ſ", "İ", "ΑΣ", "😀", "<|endoftext|>", "<|startoftext|>", "ing", "aaaa", "\r\n", "é",
]


def odd_texts(count=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(count)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*odd_texts(), None, "", "word " * 9000, "x" * 5000, "same text", "same text"]
    rows = [(i, t, "other", 7) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (0, "again", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def ids_of(text):
    return BYTE.encode(text or "", add_special_tokens=False).ids


def test_split_is_the_whole_text():
    for text in odd_texts(50):
        assert "".join(split_words(text)) == text


def test_encode_and_decode_equal_the_library(spark, docs):
    rows = bpe.encode(docs, queries.BYTE_BPE, decoded=True).collect()
    texts = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in docs.collect()), key=str)
    got = sorted(((r.doc_id is None, r.doc_id, r.decoded) for r in rows), key=str)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in texts]
    for r in rows:
        assert r.ids == ids_of(r.decoded)
        assert r.decoded == BYTE.decode(r.ids, skip_special_tokens=False)
    assert sorted(t for *_, t in got) == sorted(t for *_, t in texts)


def test_decode_of_id_lists(spark):
    rows = spark.createDataFrame(
        [(1, ids_of("Hello wörld")), (2, None), (3, []), (4, [10**6, 64])], "doc_id long, ids array<int>"
    )
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, queries.BYTE_BPE).collect()}
    assert got == {1: "Hello wörld", 2: "", 3: "", 4: BYTE.decode([64])}


def test_automaton_accepts_one_path():
    machine, _ = bpe.automaton(queries.BYTE_BPE)
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choice("aabtheinsg") for _ in range(rng.randint(1, 30)))
        assert machine.encode(word.encode()) == ids_of(word)


def test_op3_digest_columns(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op3_bpe_automaton(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = ids_of(d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(spark, docs, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    model = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path).collect()
    want = [
        (len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()
    ]
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_counts_by_sentencepiece(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs, path).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(model.encode(r.text or "")) for r in docs.collect())


def check_pieces(pieces, documents, window):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == documents.keys()
    for doc_id, own in by_doc.items():
        ids = np.array(ids_of(documents[doc_id]) + [0], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    short = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    return short


@pytest.mark.parametrize("window", [64, 1024])
def test_packing_is_complete_and_full(spark, docs, window):
    unique = docs.where("doc_id is not null and text <> 'again' or text is null")
    pieces = packing.pack(unique, queries.BYTE_BPE, window, ids=True).collect()
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)
    assert check_pieces(pieces, {r.doc_id: r.text for r in unique.collect()}, window) <= 1


def test_packing_repeated_ids_and_empty_table(spark, docs):
    twice = docs.where("doc_id is null or doc_id = 0")
    assert packing.pack(twice, queries.BYTE_BPE).selectExpr("sum(length)").first()[0] == sum(
        len(ids_of(r.text)) + 1 for r in twice.collect()
    )
    assert packing.pack(docs.limit(0), queries.BYTE_BPE).count() == 0


def test_neighbours_come_in_order_of_bm25():
    rng = np.random.default_rng(1)
    tails = [rng.integers(0, 40, rng.integers(5, 30)).astype("<u4") for _ in range(60)]
    seen = np.zeros(40)
    for t in tails:
        seen[np.unique(t)] += 1
    idf = np.log(1 + (len(tails) - seen + 0.5) / (seen + 0.5))
    average = np.mean([len(t) for t in tails])
    shard = packing.Shard(tails, idf, average)
    for number, seed in enumerate(tails[:10]):
        want = []
        for t in tails:
            norm = packing.K1 * (1 - packing.B + packing.B * len(t) / average)
            tf = {x: int((t == x).sum()) for x in set(seed.tolist()) & set(t.tolist())}
            want.append(sum(idf[x] * n * (packing.K1 + 1) / (n + norm) for x, n in tf.items()))
        assert np.allclose(shard.scores(number), want)
    windows, left = packing.fill(tails, idf, average, 50)
    pieces = [p for w in [*windows, left] for p in w]
    assert sorted(pieces) == sorted(set(pieces)) and sum(n for *_, n in pieces) == sum(map(len, tails))
    assert all(sum(n for *_, n in w) == 50 for w in windows)
    best = shard.scores(0)
    best[0] = -1
    assert windows[0][1][0] == int(best.argmax())


def test_neighbours_used_are_the_best_of_all_tails_up_to_a_million_tokens(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(3, 7))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(100, 300)))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = sorted(packing.pack(docs, queries.BYTE_BPE, ids=True).collect(), key=lambda p: (p.doc_id, p.start))
    parts = {}
    for p in pieces:
        parts.setdefault(p.doc_id, []).append(np.frombuffer(p.ids, "<u4"))
    tails = [np.concatenate(parts[i]) for i in range(len(rows))]
    assert max(map(len, tails)) < packing.WINDOW and 1.2 * (1 << 19) < sum(map(len, tails)) < 1 << 20
    seen = np.bincount(np.concatenate([np.unique(t) for t in tails]))
    average = np.mean([len(t) for t in tails])
    everything = packing.Shard(tails, np.log(1 + (len(tails) - seen + 0.5) / (seen + 0.5)), average)
    sequences = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        sequences.setdefault(p.sequence_id, []).append(p)
    met = []
    for _, own in sorted(sequences.items()):
        everything.unused[own[0].doc_id] = False
        for near in own[1:]:
            scores = everything.scores(own[0].doc_id, own[0].start)
            met.append(scores[near.doc_id] >= scores.max() - 1e-9)
            everything.unused[near.doc_id] = False
    assert len(met) > 500 and np.mean(met) == 1
