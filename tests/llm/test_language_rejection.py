"""Texts that no learned language is like are rejected, and dropped by the pipeline's first stage; those of the corpus stay."""

import base64
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import DATA
from glyphtally.llm import langid

FOREIGN = {
    "russian": "Вчера вечером мы долго шли вдоль реки и говорили о том, что будет завтра.",
    "chinese": "昨天晚上我们沿着河走了很久,谈论明天会发生什么事情。",
    "greek": "Χθες το βράδυ περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και μιλήσαμε.",
    "polish": "Wczoraj wieczorem długo szliśmy wzdłuż rzeki i rozmawialiśmy o tym, co będzie jutro.",
    "noise": "".join(random.Random(1).choice("bcdfghjklmnpqrstvwxz ") for _ in range(120)),
    "base64": base64.b64encode(random.Random(2).randbytes(120)).decode(),
    "long": "Вчера вечером мы долго шли вдоль реки. " * 2000,
}


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_foreign_texts_go_and_clean_ones_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    learn = docs.where("crc32(cast(doc_id as string)) % 5 <> 0")
    model = langid.fit_languages(learn)
    odd = spark.createDataFrame(list(FOREIGN.items()), "name string, text string")
    assert {r.name for r in odd.select("name", langid.language_of(model, "text")["rejected"].alias("r")).where("r").collect()} == set(FOREIGN)
    kept = docs.where("lang IS NOT NULL AND crc32(cast(doc_id as string)) % 5 = 0").select(langid.language_of(model, "text").alias("p")).where("p.lang <> 'und'")
    assert kept.where("p.rejected").count() <= 0.005 * kept.count()
    short = spark.createDataFrame([(w,) for r in docs.where("lang = 'en'").limit(20).collect() for w in r.text.split()[:5] if w.isalpha()], "text string")
    assert short.select(langid.language_of(model, "text")["rejected"].alias("r")).where("r").count() <= 0.03 * short.count()


def test_one_language_and_no_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'")
    model = langid.fit_languages(docs)
    got = spark.createDataFrame([(FOREIGN["russian"],), (docs.first().text,), ("",), (None,)], "text string").select(langid.language_of(model, "text").alias("p")).collect()
    assert [r.p.rejected for r in got] == [True, False, True, True]


def test_stage_drops_foreign_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 9 + k, t) for k, t in enumerate(FOREIGN.values())], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in ("doc_id", "text")])
    out = corpus_pipeline.identify_language(spark, docs.unionByName(odd), DATA)
    assert out.where(f"doc_id >= {10 ** 9}").count() == 0
    assert out.count() == docs.where("text RLIKE '[A-Za-zÀ-ÿ]'").count()
