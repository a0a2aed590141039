"""Cleaning of a document table in stages, each a job over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import langid, packing, quality, secret_scan, simhash
from gaugework.llm.batches import materialize
from gaugework.llm.queries import BYTE_BPE, learned_languages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Under this probability the best language is no better than a guess: 1.2 times the
# share that each language has by chance, for four languages and more.
LEAST_SCORE = 0.3
LEAST_OVER_CHANCE = 1.2
REPLACEMENT = "[secret]"


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents written once with a number a row, since ids may be null or repeat."""
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "zstd")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the trees."""
    rules = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, lambda rows: quality.judge(rows, rules, "row").where("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language; `lang` stays as it came.

    If no row teaches a language, no text can be told to have none, so all that
    have a letter are kept.
    """
    model = learned_languages(docs)
    if not model.languages:
        return _kept(docs, lambda rows: langid.lettered(rows, ["row"]).where("lettered"))
    least = least_score(len(model.languages))
    return _kept(
        docs,
        lambda rows: langid.identify(rows, model, ["row"]).where(
            (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)
        ),
    )


def least_score(languages: int) -> float:
    return min(LEAST_SCORE, LEAST_OVER_CHANCE / languages)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near-duplicates.

    As in op4: four-word shingles, at most 4 of 64 bits apart.  Most pairs at
    a five-word similarity of 0.8 are further apart and both stay.
    """
    return _kept(docs, lambda rows: simhash.near_duplicates(rows, "row").where("row = component_id"))


def _kept(docs: DataFrame, choose) -> DataFrame:
    rows = _numbered(docs)
    return rows.join(choose(rows).select("row"), "row", "left_semi").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and counts the letters anew."""
    keep = [c for c in COLUMNS if c not in ("text", "n_chars")]
    clean = secret_scan.scan(docs, secret_scan.train(docs), keep, redact=REPLACEMENT)
    return clean.select(
        "doc_id",
        F.col("redacted").alias("text"),
        "lang",
        "source",
        F.length("redacted").cast("long").alias("n_chars"),
    )


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("packing", lexical_packing),
]

# The learned stages and the packing have no SQL form; tests/llm compares them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
