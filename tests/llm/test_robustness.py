"""Repeated ids, very long words and texts with very many spans."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import bpe, langid, quality, queries, secret_scan, toxicity
from gaugework.llm.vocabulary import Vocabulary

WORDS = {"de": "der und nicht mit auch wir sind", "en": "the and not with also we are", "fr": "le et pas avec aussi nous sommes"}


def repeated(spark):
    """Labelled documents, and one id of them with thousands of further rows."""
    rng = np.random.default_rng(1)
    rows = []
    for n in range(240):
        lang = sorted(WORDS)[n % 3]
        words = [WORDS[lang].split()[int(i)] for i in rng.integers(0, 7, 30)]
        if n % 4 == 0:
            words += ["idiot", f"password: hunter{n}xyz"]
        rows.append((n, " ".join(words), lang))
    rows += [(7, f"row {i} of one id the and", "en") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, int(n % 5 > 0), int(n % 4 == 0)) for n in range(240)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("model", ["quality", "langid", "secrets", "toxicity"])
def test_models_take_one_row_of_a_repeated_id(spark, model):
    docs, labels = repeated(spark)
    fit = {
        "quality": lambda d: quality.train(d, labels).score(np.random.default_rng(2).random((50, len(quality.FEATURES)))),
        "langid": lambda d: langid.train(d, rows=100).weights,
        "secrets": lambda d: secret_scan.train(d).weights,
        "toxicity": lambda d: toxicity.train(d, labels).pull,
    }[model]
    one = np.asarray(fit(docs.repartition(7)))
    assert np.array_equal(one, np.asarray(fit(docs.orderBy(F.desc("text")).coalesce(2)))) and one.std() > 0


def test_a_word_of_megabytes_is_encoded_in_proportion():
    machine = bpe.Automaton(Vocabulary.load(queries.BYTE_BPE))
    rng = np.random.default_rng(3)
    word = rng.integers(97, 123, 2_000_000).astype(np.uint8).tobytes()
    began = time.perf_counter()
    ids = machine.encode(word)
    assert time.perf_counter() - began < 60
    assert machine.decode(ids) == word


def test_a_text_of_a_hundred_thousand_spans():
    rng = np.random.default_rng(4)
    lines = [f"é {i} {rng.bytes(12).hex()} xK9-{i}" for i in range(100_000)]
    text = "\n".join(lines)
    tagger = secret_scan.Tagger(np.zeros((secret_scan.BUCKETS, 3)), np.zeros((3, 3)))
    places = []
    for at in range(0, 2_000_000, 20):
        places.append((at, at + 3))
    plain = text.encode()
    tagger.spans = lambda t, u: secret_scan._in_letters(u, [p for p in places if p[1] <= len(plain)])
    began = time.perf_counter()
    spans = secret_scan.find(text, plain, tagger)
    assert time.perf_counter() - began < 20
    base = [s for s in spans if s[2] != secret_scan.TAGGED]
    assert len(base) == 100_000 and len(spans) > len(base)
    some = [s for s in spans if s[2] == secret_scan.TAGGED][:300]
    assert all(b[1] <= s[0] or b[0] >= s[1] for s in some for b in base[:2000])


def test_places_in_letters():
    text = "aé€𝄞 b"
    utf8 = text.encode()
    cuts = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert secret_scan._in_letters(utf8, [(cuts[1], cuts[2]), (cuts[2], cuts[4]), (cuts[5], cuts[6])]) == [
        (1, 2, secret_scan.TAGGED), (2, 4, secret_scan.TAGGED), (5, 6, secret_scan.TAGGED),
    ]


def test_words_encoded_together_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from gaugework.llm import packing, vocabulary

    monkeypatch.setattr(vocabulary.WordIds, "ROOM", 500)
    monkeypatch.setattr(vocabulary.WordIds, "RUN", 2000)
    rng = np.random.default_rng(6)
    letters = list("abcXYZ \n\r\t'é€𝄞019,. \x85\xa0") + ["<|endoftext|>", "\n\n", "word" * 20]
    texts = ["".join(letters[int(i)] for i in rng.integers(0, len(letters), int(n))).encode() for n in rng.integers(0, 80, 3000)]
    words = packing._encoder.__wrapped__(queries.BYTE_BPE)
    library = Tokenizer.from_file(queries.BYTE_BPE)
    want = [np.array(library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(words.texts([None, *texts])) == [b"", *want]
    assert [words.text(t) for t in texts] == want
