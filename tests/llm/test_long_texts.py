"""A text of 20 MB beside short ones goes through every operator whole."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from urbanspark.llm import divergence, exact_dedup, flac, license_scan, mixing, near, packing, quality, secret_scan, simhash, toxicity

UNIT = "some words of a long text, all in a row, "
TIMES = 20_000_000 // len(UNIT)


@pytest.fixture(scope="module")
def docs(spark):
    long = F.concat(F.repeat(F.lit(UNIT), TIMES), F.lit('password = "abcdEFGH1234" the MIT license'))
    text = F.when(F.col("id") == 0, long).otherwise(F.concat(F.lit("short text number "), F.col("id").cast("string")))
    return spark.range(6).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit(0).cast("long").alias("n_chars"))


def of_long(rows):
    return rows.where("doc_id = 0").collect()[0]


def test_scans_reach_the_end(docs):
    words = 10 * TIMES + 5
    r = of_long(license_scan.license_report(docs))
    assert (r["n_base"], r["base_labels"]) == (1, "mit") and r["first_word"] > words - 10
    assert of_long(secret_scan.secret_report(docs))["n_assign"] == 1
    assert of_long(mixing.mixing_report(docs))["size"] == 10 * TIMES + 6


def test_copies_and_fingerprints(spark, docs):
    twice = docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(9).cast("long")))
    assert of_long(exact_dedup.exact_groups(twice))["group_size"] == 2
    assert {r["component_id"] for r in simhash.near_groups(twice).where("doc_id in (0, 9)").collect()} == {0}
    assert near.near_dedup(twice).count() == 6


def test_media_and_tokens(docs):
    data = (UNIT * TIMES + 'password = "abcdEFGH1234" the MIT license').encode()
    r = of_long(flac.media_report(docs))
    assert r["n_bytes"] == len(data) and r["payload_sha256"] == hashlib.sha256(flac.padded(data)).hexdigest()
    pieces = packing.packed(docs).where("doc_id = 0").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).first()
    assert pieces["n"] == pieces["all"]


def test_scores(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, int(i == 1)) for i in range(6)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs).count() == 6 and toxicity.toxicity_scores(docs, labels).count() == 6
    assert divergence.divergence_report(docs).where("part = 'pair'").count() == 2
