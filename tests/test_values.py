"""Numbers of any size in names and versions, malformed JSON, claims without evidence."""

from pyspark.sql import functions as F

from gaugework.functions.identity import canonical_json_sha256, version_numbers
from gaugework.operators.publish import claim_rows
from gaugework.operators.scores import natural_key


def test_natural_key_compares_whole_numbers(spark):
    ones = "1" * 21
    names = ["a2", "a10", "a010b", "a" + ones, "a" + "1" * 20 + "9", "a" + "9" * 25, "b1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", natural_key(F.col("n")))
    keys = {r.n: r.k for r in rows.collect()}
    assert sorted(names, key=keys.get) == ["a2", "a10", "a010b", "a" + ones, "a" + "1" * 20 + "9", "a" + "9" * 25, "b1"]
    assert len(set(keys.values())) == len(names)


def test_versions_of_any_length_sort_by_value(spark):
    texts = ["1.9", "1.10", "1." + "9" * 30, "2", "none", "01.9.1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    ordered = [r.t for r in rows.orderBy(version_numbers(F.col("t"))).collect()]
    assert ordered == ["none", "1.9", "01.9.1", "1.10", "1." + "9" * 30, "2"]


def test_malformed_json_has_no_digest(spark):
    rows = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, "abc"), (3, None)], "n int, t string")
    got = {r.n: r.d for r in rows.select("n", canonical_json_sha256(F.col("t")).alias("d")).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None


def test_a_claim_without_evidence_is_unknown(spark):
    rows = claim_rows(spark.createDataFrame([(1,)], "p int"), ["p"], {"runtime-token-stream": F.lit(True)}, {}).collect()
    assert {r.claim_id for r in rows if r.status != "unknown"} == {"runtime-token-stream"}
