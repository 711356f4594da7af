"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.session import cut_lineage, ensure_checkpoint_dir

#: Fixed value: what separates words, as a Java pattern and as a character class for Python's re.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters of text that a Python worker holds as Python objects at a time.
SLICE_CHARS = 2_000_000


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Texts pass between the JVM and Python in batches of BATCH_ROWS rows.

    Spark's default of 10,000 rows takes tens of MB for each running task, outside the heap and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/text/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return the written files as a table."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


#: Rows of a few numbers each (some tens of MB) up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Narrow `rows`, marked for a broadcast where there are at most `limit`; else left to a shuffle join."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def word_array(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def row_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, rows, texts) of a batch, so many rows that their texts hold about `limit` characters."""
    values = batch.column(batch.schema.get_field_index(column))
    start, chars, texts = 0, 0, []
    for i in range(batch.num_rows):
        text = values[i].as_py()
        texts.append(text)
        chars += len(text) if text else 0
        if chars >= limit:
            yield start, len(texts), texts
            start, chars, texts = i + 1, 0, []
    if texts:
        yield start, len(texts), texts


def map_texts(
    df: DataFrame,
    function: Callable[[list[str | None]], dict[str, list]],
    fields: dict[str, T.DataType],
    drop: tuple[str, ...] = ("text",),
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Add columns that a function computes from lists of texts, in the rows' own partitions.

    Columns of `df` named in `drop` or `fields` are replaced or dropped; the others pass through unchanged.  `after`
    runs at the end of each task, to free what the function keeps between slices: workers outlive their tasks.
    """
    kept = [f for f in df.schema.fields if f.name not in fields and f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in fields.items()])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start, count, texts in row_slices(batch):
                part = batch.slice(start, count)
                made = function(texts)
                columns = [part.column(part.schema.get_field_index(n)).cast(arrow.field(n).type) for n in names]
                columns += [pa.array(made[n], type=arrow.field(n).type) for n in fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        if after is not None:
            after()

    return df.select(*[F.col(f"`{n}`") for n in names], *([] if "text" in names else ["text"])).mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a, b): one row (node, component) per linked node, component its smallest node.

    Alternating large-star and small-star rounds; each is one join and two aggregations whose partial
    results are combined before the shuffle, and each round is cut by a checkpoint.  Empty links give no rows.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(roots.select("node", F.col("node").alias("component")))
