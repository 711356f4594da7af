"""Token counts and toxicity queries against plain versions on the whole small table."""

import math
import os
import re
import sys
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from creaseline.llm import token_counts, toxicity  # noqa: E402
from creaseline.llm.common import shared_path  # noqa: E402
from creaseline.llm.queries import QUERIES  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_token_counts_of_the_table(spark, sf_dir, texts):
    library = brute.library("word_bpe_49k.json")
    out = QUERIES["op2_token_counts"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_filled_cache_serves_what_it_holds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cache = shared_path(spark, "cache-test")
    folder = f"{cache}/tokenizer={token_counts.tokenizer_digest(WORD)[:16]}"
    read = lambda: spark.read.schema(token_counts.CACHE_SCHEMA).parquet(folder)
    token_counts.fill_cache(docs.where(F.xxhash64("text") % 2 == 0), WORD, cache)
    half = read().count()
    # A stored count is served as it is, right or wrong: the text is not encoded again.
    planted = docs.where("text = 'never seen in any document'").unionByName(spark.createDataFrame([(-1, "never seen in any document")], "doc_id long, text string"))
    digest = planted.select(F.unhex(F.sha2(token_counts.normalised(F.col("text")), 256)).alias("content_digest"))
    digest.select("content_digest", F.lit(token_counts.tokenizer_digest(WORD)).alias("tokenizer_digest"), F.lit(777).cast("long").alias("n_tokens")).write.mode("append").parquet(folder)
    out = token_counts.token_counts(docs.unionByName(planted), WORD, cache)
    assert [r["n_tokens"] for r in out.where("doc_id = -1").collect()] == [777]
    distinct = docs.select(token_counts.normalised(F.col("text")).alias("t")).distinct().count()
    assert 0 < half < distinct and read().count() == distinct + 1


def plain_score(text, weights, bias):
    """(score, toxic sentences) of a text, word by word."""
    clean, found = 1.0, []
    for m in re.finditer(r"[^.!?\n]+[.!?]*", text or ""):
        words = re.findall(r"[^\W\d_]+", m.group().lower())
        for i in range(0, len(words), toxicity.SENTENCE_WORDS):
            features = set()
            for w in words[i : i + toxicity.SENTENCE_WORDS]:
                features |= {zlib.crc32(w.encode()) % toxicity.FEATURES, zlib.crc32(b"^" + w[:4].encode()) % toxicity.FEATURES}
            p = 1 / (1 + math.exp(-(sum(float(weights[f]) for f in features) + bias)))
            clean *= 1 - p
            if p >= 0.5:
                found.append(f"{m.start()}:{m.end()}")
    return 1 - clean, found


def test_toxicity_of_the_table(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = toxicity.train(docs, labels.where(~toxicity.held_out()))
    out = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        score, found = plain_score(texts[r["doc_id"]], weights, bias)
        assert r["score"] == pytest.approx(score, abs=1e-5)
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if all(abs(float(x) - 0.5) > 1e-6 for x in [score]):
            assert r["toxic_sentences"] == ",".join(found)


def test_toxicity_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "You dolt.", 5.0, "x", "y"), (1, "You dolt.", 5.0, "x", "y"), (2, None, 1.0, "x", "y")], "doc_id long, text string, score double, predicted string, toxic_spans string")
    out = toxicity.toxicity_scores(docs, (toxicity.fit([])[0], -6.0), spans=True)
    assert sorted(out.columns) == ["doc_id", "predicted", "score", "toxic_spans"]
    rows = out.orderBy("doc_id").collect()
    assert rows[0] == rows[1] and rows[2]["score"] == 0.0 and rows[2]["toxic_spans"] == []
