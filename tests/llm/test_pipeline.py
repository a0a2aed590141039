"""The corpus pipeline: each stage on what the one before kept."""

import zlib

import pytest

import corpus_pipeline
from tests.llm.test_near import plain_components
from tests.llm.test_filters import plain_spans
from tests.llm.test_tokens import check_pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of every stage, each written and read again, as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    kept.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        kept.append(docs)
    return kept


def test_stages_keep_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == before.columns
        own = {r.doc_id: r for r in before.collect()}
        assert all(r.doc_id in own and r.lang == own[r.doc_id].lang for r in after.collect())


def test_near_duplicates_leave_one_of_each_group(stages):
    rows = stages[2].orderBy("doc_id").collect()
    _, roots = plain_components([r.text for r in rows])
    left = {r.doc_id for r in stages[3].collect()}
    assert len(left) == len(set(roots))
    group = {r.doc_id: root for r, root in zip(rows, roots)}
    assert {group[i] for i in left} == set(roots)


def test_secrets_are_gone(stages):
    rows = stages[4].collect()
    assert len(rows) == stages[3].count()
    assert all(plain_spans(r.text) == [] and r.n_chars == len(r.text) for r in rows)


def test_packing_takes_all(stages):
    documents = {r.doc_id: r.text for r in stages[4].collect()}
    assert check_pieces(stages[5].collect(), documents, 1024) <= 1


def test_run_gives_the_rows_of_the_stages(spark, stages):
    columns = ["doc_id", "doc_tokens"]
    run = corpus_pipeline.run(spark, FOLDER).select(columns).distinct().collect()
    assert sorted(run) == sorted(stages[5].select(columns).distinct().collect())


def test_null_and_repeated_rows(spark):
    rows = [(None, None, None, None, None, 1)] * 3 + [(7, "alone " * 3, "en", "s", 18, 2)] * 2
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, row int"
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        out.collect()
    assert corpus_pipeline.simhash_near_dedup(spark, docs, FOLDER).count() == 2


COLUMN_TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def language_rows(spark, ids, lang):
    texts = ["some words of a text", "other words here", "1 2 3 !", "", None]
    rows = [(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, COLUMN_TYPES)


@pytest.mark.parametrize(
    ("ids", "lang"),
    [
        ([1, 2, 3, 4, 5], None),
        ([None] * 5, "en"),
        # all in the fold that is held out
        ([i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2][:5], "en"),
    ],
)
def test_without_a_learned_language_texts_with_letters_stay(spark, ids, lang):
    left = corpus_pipeline.language_id(spark, language_rows(spark, ids, lang), FOLDER).collect()
    assert sorted(r.text for r in left) == ["other words here", "some words of a text"]
    assert {r.lang for r in left} == {lang}


def test_least_score_falls_with_the_number_of_languages():
    assert [corpus_pipeline.least_score(n) for n in (1, 2, 4)] == [0.3] * 3
    assert all(1 / n < corpus_pipeline.least_score(n) < 1.3 / n for n in (5, 20, 200))
