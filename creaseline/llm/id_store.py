"""Token-id files with a minimal perfect hash index over document keys (operator 7)."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creaseline.llm.bpe import BytePieces, Memo, byte_chunks, opened
from creaseline.llm.common import row_slices

#: Ids per shard: a shard is closed once it holds so many (a longer document has a shard of its own).
SHARD_TOKENS = 1 << 20
#: Keys per part of the index, which is built and probed in one task.
PART_KEYS = 50_000
LEVELS, GAMMA = 40, 1.5

SHARD_SCHEMA = (
    "part int, shard int, n_tokens long, id_bytes int, doc_ids array<long>, occurrences array<int>, starts array<long>, payload binary"
)
SHARD_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("payload", pa.binary()),
    ]
)
INDEX_SCHEMA = (
    "index_part long, n_keys long, level_sizes array<long>, bits binary, rest_hashes array<long>, rest_fingerprints array<long>,"
    " fingerprints array<long>, parts array<int>, shards array<int>, offsets array<long>, lengths array<long>"
)


def _library(path: str) -> tuple[Memo, np.dtype]:
    def make(p: str) -> tuple[Memo, np.dtype]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(p)
        library.no_truncation()
        library.no_padding()
        special = [t.content for t in library.get_added_tokens_decoder().values() if t.special]
        width = np.uint16 if library.get_vocab_size() <= 1 << 16 else np.uint32

        kind = "H" if width is np.uint16 else "I"
        pieces = BytePieces(p, np.dtype(width)) if BytePieces.fits(p) else None

        def by_library(chunks: list[str]) -> list[bytes]:
            return [array(kind, e.ids).tobytes() for e in library.encode_batch_fast(chunks, add_special_tokens=False)]

        def compute(chunks: list[str]) -> list[bytes]:
            plain = pieces.PLAIN("\n".join(chunks)) if pieces else []  # a chunk that holds \n is white space
            ids = dict(zip(plain, pieces(plain))) if plain else {}
            for mark in special:
                ids.pop(mark, None)
            rest = [c for c in chunks if c not in ids]
            ids.update(zip(rest, by_library(rest)))
            return [ids[c] for c in chunks]

        def chunks_of(text: str) -> list[str]:
            cuts = [text]
            for mark in special:  # the library matches these before it looks at spaces
                if mark in text:
                    cuts = [y for x in cuts for y in _cut_at(x, mark)]
            if len(cuts) == 1 and text not in special:
                return byte_chunks(text)
            return [c for x in cuts for c in ([x] if x in special else byte_chunks(x))]

        return Memo(compute, chunks_of), np.dtype(width)

    return opened("byte", path, make)


def _cut_at(text: str, mark: str) -> list[str]:
    if mark not in text:
        return [text]
    pieces = text.split(mark)
    return [x for i, piece in enumerate(pieces) for x in ([mark, piece] if i else [piece]) if x]


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write `path`/shards and `path`/index for the texts of `docs` in ascending doc_id order.

    File format: one row per shard with its place (`part`, `shard`), the raw ids of its documents one after
    another (`payload`, little-endian integers of `id_bytes` bytes, each document closed by `end_id`), and where
    each document starts.  Rows without doc_id come first; rows that repeat a doc_id follow one another by their
    text's hash and are told apart by `occurrence` (0, 1, ...).  A null text is empty.  An empty table writes
    tables without rows.  Both tables are committed by Spark's writer, so lost tasks are simply run again.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def shards(batches):
        arrow = SHARD_ARROW
        memo, width = _library(tokenizer)
        end = np.array([end_id], dtype=width).tobytes()
        part, shard, last, times = TaskContext.get().partitionId(), 0, object(), 0
        ids, keys, occurrences, starts, size = [], [], [], [], 0

        def closed():
            row = (part, shard, size, width.itemsize, keys, occurrences, starts, b"".join(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for first, count, texts in row_slices(batch):
                doc_ids = batch.column(0).slice(first, count).to_pylist()
                for doc_id, parts in zip(doc_ids, memo(texts)):
                    own = b"".join(parts) + end
                    times = times + 1 if doc_id == last else 0
                    last = doc_id
                    ids.append(own)
                    keys.append(doc_id)
                    occurrences.append(times)
                    starts.append(size)
                    size += len(own) // width.itemsize
                    if size >= shard_tokens:
                        yield closed()
                        shard += 1
                        ids, keys, occurrences, starts, size = [], [], [], [], 0
        if keys:
            yield closed()

    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/shards")
    _write_index(spark, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")


def key_hashes(doc_id="doc_id", occurrence="occurrence"):
    """Place hash and fingerprint of a key."""
    return F.xxhash64(F.col(doc_id), F.col(occurrence)), F.xxhash64(F.col(occurrence), F.col(doc_id), F.lit("fingerprint"))


def _write_index(spark: SparkSession, path: str) -> None:
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array("n_tokens"))
    keys = (
        read_shards(spark, path)
        .select("part", "shard", F.arrays_zip("doc_ids", "occurrences", "starts", ends.alias("ends")).alias("z"))
        .select("part", "shard", F.inline("z"))
        .toDF("part", "shard", "doc_id", "occurrence", "offset", "end")
    )
    place, fingerprint = key_hashes()
    total = read_shards(spark, path).agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    n_parts = max(1, -(-total // PART_KEYS))
    keys.select(
        F.pmod(place, F.lit(n_parts)).alias("index_part"), place.alias("place"), fingerprint.alias("fingerprint"),
        "part", "shard", "offset", (F.col("end") - F.col("offset")).alias("length"),
    ).groupBy("index_part").applyInPandas(_build_part, INDEX_SCHEMA).write.parquet(f"{path}/index")
    # The number of parts is part of the key's address, so it is stored beside the index.
    spark.createDataFrame([(int(n_parts),)], "n_parts long").write.parquet(f"{path}/address")


def _mixed(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Levels of a minimal perfect hash over distinct hashes: their sizes, their bits, and what is left over.

    A level keeps the keys that have a place of its bit array to themselves; the others try the next one.  A
    key's slot is the number of set bits before its own, so the slots are 0 .. n-1 without gaps.
    """
    left, sizes, levels = np.arange(len(hashes)), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(np.ceil(GAMMA * len(left))))
        at = _mixed(hashes[left], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        sizes.append(size)
        levels.append(bits)
        left = left[~alone]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool), left


def slots_of(hashes: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each hash, -1 where no level has it; hashes outside the key set get any slot or -1."""
    rank = np.cumsum(bits) - 1
    slots, open_, base = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        at = base + _mixed(hashes[open_], level, size)
        hit = bits[at]
        slots[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return slots


def _build_part(rows: pd.DataFrame) -> pd.DataFrame:
    hashes = rows["place"].to_numpy().astype(np.uint64)
    sizes, bits, left = build_hash(hashes)
    slots = slots_of(hashes, sizes, bits)
    slots[left] = np.arange(len(rows) - len(left), len(rows))
    order = np.argsort(slots)
    column = lambda name: rows[name].to_numpy()[order]
    return pd.DataFrame(
        {
            "index_part": [rows["index_part"].iloc[0]], "n_keys": [len(rows)], "level_sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()], "rest_hashes": [rows["place"].to_numpy()[left]],
            "rest_fingerprints": [rows["fingerprint"].to_numpy()[left]], "fingerprints": [column("fingerprint")],
            "parts": [column("part")], "shards": [column("shard")], "offsets": [column("offset")], "lengths": [column("length")],
        }
    )


FOUND_SCHEMA = "doc_id long, occurrence int, part int, shard int, offset long, n_tokens long"


def _probe(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({c.split()[0]: [] for c in FOUND_SCHEMA.split(", ")})
    if keys.empty or index.empty:
        return empty
    x = index.iloc[0]
    sizes = [int(s) for s in x["level_sizes"]]
    bits = np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8))[: sum(sizes)].astype(bool)
    slots = slots_of(keys["place"].to_numpy().astype(np.uint64), sizes, bits)
    rest = {k: int(x["n_keys"]) - len(x["rest_hashes"]) + i for i, k in enumerate(zip(x["rest_hashes"], x["rest_fingerprints"]))}
    for i in np.nonzero(slots < 0)[0] if rest else ():
        slots[i] = rest.get((keys["place"].iloc[i], keys["fingerprint"].iloc[i]), -1)
    ok = slots >= 0
    ok[ok] = np.asarray(x["fingerprints"])[slots[ok]] == keys["fingerprint"].to_numpy()[ok]
    at = slots[ok]
    found = keys.loc[ok, ["doc_id", "occurrence"]].reset_index(drop=True)
    for name, field in (("part", "parts"), ("shard", "shards"), ("offset", "offsets"), ("n_tokens", "lengths")):
        found[name] = np.asarray(x[field])[at]
    return found


def find_keys(keys: DataFrame, path: str) -> DataFrame:
    """Places (part, shard, offset, n_tokens) of the asked keys; unknown keys give no row.

    `keys` has doc_id and may have `occurrence` (0 if not).  A key's hash names its part of the index, the
    perfect hash its slot, and the slot's fingerprint rejects strangers; repeated keys are asked once.
    """
    spark = keys.sparkSession
    n_parts = spark.read.schema("n_parts long").parquet(f"{path}/address").first()[0]
    occurrence = F.col("occurrence") if "occurrence" in keys.columns else F.lit(0)
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), occurrence.cast("int").alias("occurrence")).distinct()
    place, fingerprint = key_hashes()
    asked = asked.select("doc_id", "occurrence", F.pmod(place, F.lit(n_parts)).alias("index_part"), place.alias("place"), fingerprint.alias("fingerprint"))
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    return asked.groupBy("index_part").cogroup(index.groupBy("index_part")).applyInPandas(_probe, FOUND_SCHEMA)


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard.  The only window without a key runs over one row per writing task."""
    sizes = read_shards(spark, path).select("part", "shard", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    return sizes.withColumn("inner", inner).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("base"))


def payload_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: (part, shard, offset, ids_crc32), read shard by shard without a shuffle of payloads."""

    def digests(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, width, starts, payload = (batch.column(i)[row].as_py() for i in range(5))
                ids = np.frombuffer(payload, dtype=f"<u{width}").astype("<u4")
                ends = [*starts[1:], len(ids)]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * len(crc), pa.int32()), "shard": pa.array([shard] * len(crc), pa.int32()), "offset": pa.array(starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                )

    rows = read_shards(spark, path).select("part", "shard", "id_bytes", "starts", "payload")
    return rows.mapInArrow(digests, "part int, shard int, offset long, ids_crc32 long")


def read_documents(keys: DataFrame, path: str) -> DataFrame:
    """Ids of the asked keys: (doc_id, occurrence, token_ids); only shards that hold one are opened."""
    found = find_keys(keys, path)

    def ids(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(r["payload"], dtype=f"<u{r['id_bytes']}")[r["offset"] : r["offset"] + r["n"]].astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([r["doc_id"]], pa.int64()), "occurrence": pa.array([r["occurrence"]], pa.int32()), "token_ids": pa.array([own], pa.list_(pa.int32()))}
                )

    shards = read_shards(keys.sparkSession, path).select("part", "shard", "id_bytes", "payload")
    rows = found.withColumnRenamed("n_tokens", "n").join(shards, ["part", "shard"])
    return rows.mapInArrow(ids, "doc_id long, occurrence int, token_ids array<int>")


def stored_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of `docs`, found through the index and read from the files."""
    spark = docs.sparkSession
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    keys = counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("occurrence"))
    found = find_keys(keys, path)
    rows = found.join(payload_digests(spark, path), ["part", "shard", "offset"]).join(shard_bases(spark, path), ["part", "shard"])
    return rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
