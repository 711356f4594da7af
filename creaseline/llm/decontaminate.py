"""Benchmark passages in documents by spaced seeds (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.llm.common import cut, small

#: Fixed masks over token positions: 1 is compared, - ignored.  Together they survive any single substitution in a
#: window of ten tokens, and most pairs of substitutions.
MASKS = ("111-1-11", "11-11-11", "1-111--11")
#: Overlap that counts: so many equal tokens on one alignment with at least PERCENT of its tokens equal.
MIN_EQUAL, PERCENT = 10, 80
#: Rows of a few numbers each up to which seeds and hits are broadcast; beyond, they meet the documents in a shuffle join.
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text."""
    runs = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def seed_hashes(masks: tuple[str, ...]) -> list[Column]:
    """Per mask, an array of the window hashes of the column `h`, by first position; empty where `h` is too short."""
    out = []
    for number, mask in enumerate(masks):
        last = F.size("h") - len(mask)
        windows = F.transform(F.sequence(F.lit(0), last), _window_hash(number, [i for i, m in enumerate(mask) if m == "1"]))
        out.append(F.when(last >= 0, windows).otherwise(F.array().cast("array<long>")))
    return out


def _window_hash(number: int, compared: list[int]):
    return lambda p: F.xxhash64(F.lit(number), *[F.get("h", p + i) for i in compared])


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(seed, item_id, item_pos, item_h): one row per mask and window of each different item text."""
    hashed = items.where("item_id is not null").select("item_id", token_hashes(F.col("text")).alias("h")).groupBy("h").agg(F.min("item_id").alias("item_id"))
    parts = [
        hashed.select("item_id", F.col("h").alias("item_h"), F.posexplode_outer(s).alias("item_pos", "seed")) for s in seed_hashes(masks)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("seed is not null")


def best_run(equal: Column, percent: int) -> Column:
    """Most equal tokens of a stretch in which at least `percent` of the tokens are equal, from an array of booleans.

    Equal tokens score 100 - percent, others -percent; a stretch with a score at or above zero, built from the best
    running score, is counted by its equal tokens.
    """
    gain, loss = 100 - percent, percent
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("equal"), F.lit(0).alias("best"))

    def step(s, e):
        score = F.when(e, s["score"] + gain).otherwise(s["score"] - loss)
        alive = score >= 0
        equal_now = F.when(alive, s["equal"] + e.cast("int")).otherwise(0)
        return F.struct(
            F.when(alive, score).otherwise(0).alias("score"), equal_now.alias("equal"), F.greatest(s["best"], equal_now).alias("best")
        )

    return F.aggregate(equal, start, step, lambda s: s["best"])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_equal: int = MIN_EQUAL,
    percent: int = PERCENT,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, n_equal, doc_start, item_tokens) for documents that hold a passage of a benchmark item.

    Tokens are lower-cased runs of letters and digits.  A seed hit gives an alignment of document and item; the
    item's tokens are compared with the document's on that alignment, and the pair counts if a stretch with
    `percent` of equal tokens has `min_equal` of them (or, for a shorter item, all of the item's tokens).
    `n_equal` is that stretch's count, `doc_start` the first token of the document that the alignment compares;
    of several alignments the one with most equal tokens is given, then the first.

    Null or empty texts, and items shorter than the shortest mask, match nothing.  Rows without doc_id are skipped,
    and rows that repeat a doc_id add to one result.  Items of equal tokens count as the one with the least id.
    Empty in, empty out.
    """
    seeds = cut(benchmark_seeds(items, masks))
    narrow_seeds = small(seeds.select("seed", "item_id", "item_pos"), broadcast_seeds)
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("row"))
    own = rows.select("doc_id", "row", token_hashes(F.col("text")).alias("h"))
    windows = own.select("doc_id", "row", F.size("h").alias("size"), F.concat(*seed_hashes(masks)).alias("windows"))
    # posexplode_outer: the filter that Spark derives from the plain form would compute `h` anew for every window.
    # The exploded rows are narrow, since a row's whole output may be buffered.
    places = windows.select("doc_id", "row", "size", F.posexplode_outer("windows").alias("at", "seed"))
    shift = (_place(F.col("size"), masks) - F.col("item_pos")).alias("shift")
    found = cut(places.join(narrow_seeds, "seed").select("doc_id", "row", "item_id", shift).distinct())
    items_h = seeds.groupBy("item_id").agg(F.first("item_h").alias("item_h"))
    hits = rows.join(small(found, broadcast_seeds), ["doc_id", "row"]).join(items_h, "item_id")
    hits = hits.select("doc_id", "item_id", "shift", "item_h", token_hashes(F.col("text")).alias("h"))
    return _verified(cut(hits).select("doc_id", "item_id", *_slices(F.col("shift"))), min_equal, percent)


def _place(size: Column, masks: tuple[str, ...]) -> Column:
    """Token position of a window from its place `at` in the concatenated windows of all masks."""
    place, before = None, F.lit(0)
    for mask in masks:
        count = F.greatest(size - len(mask) + 1, F.lit(0))
        inside = F.col("at") < before + count
        value = F.col("at") - before
        place = F.when(inside, value) if place is None else place.when(inside, value)
        before = before + count
    return place


def _slices(shift: Column) -> list[Column]:
    """The parts of document and item that an alignment puts beside each other."""
    start = F.greatest(shift, F.lit(0))
    skip = start - shift
    length = F.least(F.size("h") - start, F.size("item_h") - skip)
    return [
        start.alias("doc_start"), F.size("item_h").alias("item_tokens"),
        F.slice("h", start + 1, length).alias("x"), F.slice("item_h", skip + 1, length).alias("y"),
    ]


def _verified(hits: DataFrame, min_equal: int, percent: int) -> DataFrame:
    equal = F.zip_with("x", "y", lambda a, b: a == b)
    runs = hits.select("doc_id", "item_id", "doc_start", "item_tokens", best_run(equal, percent).alias("n_equal"))
    good = runs.where(F.col("n_equal") >= F.least(F.lit(min_equal), F.col("item_tokens")))
    best = F.max_by(F.struct("n_equal", "doc_start", "item_tokens"), F.struct("n_equal", -F.col("doc_start")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n_equal").cast("long").alias("n_equal"), F.col("b.doc_start").cast("long").alias("doc_start"), F.col("b.item_tokens").cast("long").alias("item_tokens"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of `docs` that hold no passage of a benchmark item; rows without doc_id stay."""
    found = contaminated(docs, items, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
