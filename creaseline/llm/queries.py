"""Registered queries of the text operators, with the parameters that they run with on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creaseline.llm import codec, decontaminate, id_store, infill, lattice, lines, near_copies, passages, pii, quality, token_counts, toxicity, whitening
from creaseline.llm.common import documents, shared_path, table

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    out = quality.quality_verdicts(docs, table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *base, *[F.round(r, 9).alias(r) for r in quality.RULES])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, from a cache that an earlier load has filled.

    The earlier load is the half of the contents whose hash is even; the run over all documents is served those from
    the cache and encodes and appends the others.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    tokenizer, cache = token_counts.default_tokenizer(WORD_TOKENIZER), shared_path(spark, "token-count-cache")
    token_counts.fill_cache(docs.where(F.xxhash64("text") % 2 == 0), tokenizer, cache)
    out = token_counts.token_counts(docs, tokenizer, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.document_classes(documents(spark, sf_dir).select("doc_id", "text"), width=2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_report(documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumn("removed_lines", F.array_join("removed_lines", ","))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return codec.round_trip_digests(docs, token_counts.default_tokenizer(WORD_TOKENIZER))


def op7_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = shared_path(spark, "id-store")
    id_store.write_ids(docs, token_counts.default_tokenizer(BYTE_TOKENIZER), path)
    return id_store.stored_documents(docs, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    out = toxicity.toxicity_scores(docs, toxicity.train(docs, labels), spans=True)
    located = F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.array_join(located, ",").alias("toxic_sentences"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "kind", "place", "words", "first_doc_id", "removed")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(documents(spark, sf_dir).select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.infilled(documents(spark, sf_dir).select("doc_id", "text")))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_token_counts, op3_decontamination, op4_near_copies, op5_line_dedup, op6_bpe_round_trip, op7_id_store, op8_toxicity, op9_repeated_passages, op10_personal_data, op11_whitening, op12_infill, op13_near_vectors)
}


def oracles() -> dict[str, str]:
    from creaseline.llm.sql import ORACLES

    return ORACLES
