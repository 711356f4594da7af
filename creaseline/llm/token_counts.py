"""Token counts through a cache keyed by content and tokenizer digests (operator 2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.bpe import Memo, opened, word_chunks
from creaseline.llm.common import map_texts, shared_path

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
LIMIT = 2048


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file: a new version has other bytes, so it has a cache of its own."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str) -> Memo:
    def make(p: str) -> Memo:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(p)
        library.no_truncation()
        library.no_padding()
        return Memo(lambda chunks: list(map(len, library.encode_batch_fast(chunks, add_special_tokens=False))), word_chunks)

    return opened("counts", path, make)


def normalised(text):
    """White-space runs as one space, none at the ends: no token of a vocabulary that drops white space changes.

    Case is kept, since special tokens are matched before the tokenizer lower-cases.  Null is the empty text.
    """
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), "^ | $", "")


def read_cache(spark: SparkSession, cache: str, digest: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where nothing has been stored.

    Two runs may have stored the same content; the counts are equal, and one row is returned.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={digest[:16]}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path.toString()).where(F.col("tokenizer_digest") == digest)
    return stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode the contents of `docs` that the cache folder lacks, once each, and append their counts.

    Contents are told apart by the SHA-256 of the normalised text.  Misses are made distinct on the map side before
    they move, and are appended in one committed write, so a failed run stores nothing.
    """
    digest = tokenizer_digest(tokenizer)
    own = docs.select(normalised(F.col("text")).alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(docs.sparkSession, cache, digest).select("content_digest")
    misses = own.join(known, "content_digest", "left_anti").dropDuplicates(["content_digest"])
    counted = map_texts(
        misses,
        lambda texts: {"n_tokens": [sum(c) for c in _counter(tokenizer)([t or "" for t in texts])]},
        {"n_tokens": T.LongType()},
    )
    counted.select("content_digest", F.lit(digest).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(
        f"{cache}/tokenizer={digest[:16]}"
    )


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Rows of `docs` without text, with `n_bytes`, `n_tokens` and `over_limit`.

    `tokenizer` is the path of a word vocabulary that drops white space; `cache` is a folder in shared storage
    (a new one if not given), to which `fill_cache` adds what it lacks.  A null text counts as empty; repeated rows
    each get their count; an empty table gives an empty table and stores nothing.  Columns of `docs` with these names
    are replaced.
    """
    spark = docs.sparkSession
    cache = cache or shared_path(spark, "token-count-cache")
    fill_cache(docs, tokenizer, cache)
    digest = tokenizer_digest(tokenizer)
    content = normalised(F.col("text"))
    kept = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit", "content_digest")]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("content_digest"),
    )
    return (
        rows.join(read_cache(spark, cache, digest), "content_digest", "left")
        .drop("content_digest")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
