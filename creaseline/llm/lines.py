"""Line dedup by an exact set-similarity join with prefix, positional and length filters (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.llm.common import cut, row_slices, small, written

#: Words of a shingle (the tokens of a line), percent of similarity, and words that a compared line has at least.
WIDTH, PERCENT, MIN_WORDS = 5, 80, 1
#: Characters whose words and shingles a task holds at a time, in about ten numbers each.
SLICE = 250_000
#: Positions of the table of token frequencies: bounded, whatever the number of tokens.
BUCKETS = 1 << 16
_POWER = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(64)], dtype=np.uint64)
_hashes: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words, equal in every worker; words that come up again are looked up."""
    found = list(map(_hashes.get, words))
    if None in found:
        import xxhash

        if len(_hashes) > 700_000:
            _hashes.clear()
        digest = xxhash.xxh3_64_intdigest
        new = {words[i] for i, h in enumerate(found) if h is None}
        _hashes.update((w, digest(w.encode())) for w in new)
        found = [_hashes[w] if h is None else h for w, h in zip(words, found)]
    return np.array(found, dtype=np.uint64)


_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0xD1342543DE82EF95
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n or more of each."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of UTF-8 bytes: differences of one running polynomial, moved to power 0."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACES[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return starts, _mix((total[ends] - total[starts]) * down[starts])


def line_tokens(texts: list[str | None], width: int, min_words: int = 3) -> tuple[np.ndarray, ...]:
    """Tokens of the lines of texts: (text, line number, characters) per line, and (line, token), repeats included.

    Lines end at \\n.  A line of `min_words` words or more has its `width`-word shingles as tokens, or its whole
    word sequence where it has fewer words; other lines have no row.
    """
    own = [t or "" for t in texts]
    data = np.frombuffer(("\n".join(own) + "\n").encode(), dtype=np.uint8)
    per_text = np.array([t.count("\n") + 1 for t in own], dtype=np.int64)
    stops = np.flatnonzero(data == 10)
    starts, hashed = hashed_words(data)
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    keep = counts >= max(1, min_words)
    hashed = hashed[np.repeat(keep, counts)]
    text_of = np.repeat(np.arange(len(own)), per_text)
    number = np.arange(len(stops)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    lengths = np.diff(stops, prepend=-1) - 1
    if len(data) > sum(map(len, own)) + len(own):  # bytes that continue a character do not count
        points = np.cumsum((data & 0xC0) == 0x80, dtype=np.int64)
        lengths = lengths - np.diff(points[stops], prepend=0)
    chars = lengths
    owner, number, chars, counts = text_of[keep], number[keep].astype(np.int32), chars[keep], counts[keep]
    line_of = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(hashed) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled += hashed[k : k + n] * _POWER[k]
    whole = line_of[:n] == line_of[width - 1 : width - 1 + n]
    tokens, lines = rolled[whole], line_of[:n][whole]
    shorts = np.flatnonzero(counts < width)
    if len(shorts):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        brief = [np.add.reduce(hashed[first[i] : first[i] + counts[i]] * _POWER[: counts[i]]) + np.uint64(counts[i]) for i in shorts]
        tokens, lines = np.concatenate([tokens, np.array(brief, dtype=np.uint64)]), np.concatenate([lines, shorts])
    return owner, number, chars, lines, _mix(tokens)


def _by_line(tokens: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Order by (line, token); a stable sort of 16-bit numbers is a counting sort."""
    order = np.argsort(tokens)
    owner = lines[order]
    return order[np.argsort(owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner, kind="stable")]


def token_sets(texts: list[str | None], width: int, min_words: int = MIN_WORDS, ranks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """`line_tokens` with distinct tokens, sorted in each line.

    With `ranks` (a rank per bucket), the bucket bits of a token give way to its bucket's rank, so that tokens sort
    from rare to frequent; different tokens stay different.
    """
    owner, number, chars, lines, tokens = line_tokens(texts, width, min_words)
    if ranks is not None:
        tokens = (tokens & np.uint64((1 << 48) - 1)) | (ranks[(tokens >> np.uint64(48)).astype(np.int64)] << np.uint64(48))
    order = _by_line(tokens, lines)
    tokens, lines = tokens[order], lines[order]
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (lines[1:] != lines[:-1])
    return owner, number, chars, lines[first], tokens[first]


def token_frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """Occurrences of tokens by the first 16 bits of their hash; BUCKETS numbers reach the driver at any size."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, texts in row_slices(batch, limit=SLICE):
                total += np.bincount((line_tokens(texts, width, MIN_WORDS)[4] >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


LINES = "doc_id long, rid long, line int, chars long, k1 long, k2 long, n int, prefix array<long>"


def _key_sums(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = tokens ^ (tokens >> np.uint64(23))
    return np.add.reduceat(tokens, starts).astype(np.int64), np.add.reduceat(other * other * other, starts).astype(np.int64)


def line_rows(docs: DataFrame, width: int, percent: int, frequencies: np.ndarray) -> DataFrame:
    """One row per compared line: place, set key, size, and its prefix, tokens ordered from rare to frequent."""
    ranks = np.empty(BUCKETS, dtype=np.uint64)
    ranks[np.argsort(frequencies, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            for start, count, texts in row_slices(batch, limit=SLICE):
                owner, number, chars, lines, tokens = token_sets(texts, width, ranks=shared.value)
                if not len(owner):
                    continue
                sizes = np.bincount(lines, minlength=len(owner))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                k1, k2 = _key_sums(tokens, starts)
                prefix = sizes - (percent * sizes + 99) // 100 + 1
                rank = np.arange(len(tokens)) - np.repeat(starts, sizes)
                chosen = tokens[rank < np.repeat(prefix, sizes)].astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
                rows = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number), pa.array(chars), pa.array(k1), pa.array(k2),
                        pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen)),
                    ],
                    names=["doc_id", "rid", "line", "chars", "k1", "k2", "n", "prefix"],
                )

    return docs.select("doc_id", "rid", "text").mapInArrow(run, LINES)


def with_row_ids(docs: DataFrame) -> DataFrame:
    """Rows that can be compared, as (doc_id, rid, text): rid tells rows with the same doc_id and other texts apart."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.withColumn("rid", F.xxhash64("doc_id", "text"))


def shared_entries(classes: DataFrame) -> DataFrame:
    """(token, c, doc_id, np) of the prefix tokens that two or more classes have; np packs size and position."""
    entries = classes.select("c", "doc_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("token", "c", "doc_id", (F.col("n").cast("long") * 2**31 + F.col("pos")).alias("np"))
    often = entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    return cut(entries.join(small(cut(often)), "token"))


def _passes(x: Column, y: Column, percent: int) -> Column:
    """Length and positional filters on two packed sizes and positions."""
    n1, n2 = F.shiftright(x, 31), F.shiftright(y, 31)
    p1, p2 = x.bitwiseAND(F.lit(2**31 - 1)), y.bitwiseAND(F.lit(2**31 - 1))
    sized = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return sized & ((100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2))


def _pairs(x: DataFrame, y: DataFrame, on: Column, percent: int) -> DataFrame:
    a, b = F.col("x.c"), F.col("y.c")
    met = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & (a != b) & on & _passes(F.col("x.np"), F.col("y.np"), percent))
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def head_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes and the earliest class of each of their prefix tokens: at most one per entry."""
    heads = entries.groupBy("token").agg(F.min(F.struct("doc_id", "c", "np")).alias("h")).select("token", "h.c", "h.np")
    return _pairs(heads, entries, F.lit(True), percent)


def open_pairs(entries: DataFrame, settled: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class that no confirmed pair removes yet and a class that may stand before it."""
    rest = entries.join(settled, "c", "left_anti")
    return _pairs(entries, rest, F.col("x.doc_id") <= F.col("y.doc_id"), percent).join(tried, ["a", "b"], "left_anti")


def verified_lines(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs whose full token sets reach the similarity; only texts that a pair names are read again."""
    ends = pairs.select(F.col("ra").alias("rid"), F.col("la").alias("line")).unionByName(pairs.select(F.col("rb").alias("rid"), F.col("lb").alias("line")))
    asked = ends.groupBy("rid").agg(F.collect_set("line").alias("lines"))

    def run(batches):
        for batch in batches:
            for start, count, texts in row_slices(batch, limit=SLICE):
                owner, number, _, lines, tokens = token_sets(texts, width)
                if not len(owner):
                    continue
                wanted = [set(x) for x in batch.column(2).slice(start, count).to_pylist()]
                keep = np.array([number[i] in wanted[owner[i]] for i in range(len(owner))])
                sizes = np.bincount(lines, minlength=len(owner))[keep]
                rows_ = pa.array(owner[keep] + start)
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(tokens[keep[lines]].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_), pa.array(number[keep]), own], names=["rid", "line", "tokens"])

    sets = written(rows.join(small(cut(asked)), "rid").select("rid", "text", "lines").mapInArrow(run, "rid long, line int, tokens array<long>"), "line-sets")
    sets = sets.select("rid", "line", "tokens")
    left = sets.toDF("ra", "la", "x")
    right = sets.toDF("rb", "lb", "y")
    both = pairs.join(left, ["ra", "la"]).join(right, ["rb", "lb"])
    i, p, q = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    return both.where(100 * i >= percent * (p + q - i)).select("ra", "la", "rb", "lb").distinct()


def judged_lines(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, rid, line, chars, removed) of every compared line.

    Lines are ordered by (doc_id, hash of the row's text, line number).  A line is removed if an earlier line of
    any document has a Jaccard similarity of `percent` or more with it; equal sets are collapsed before the join.
    Every line with a word takes part; one of fewer than `width` words repeats only an equal one.
    """
    rows = with_row_ids(docs)
    lines = written(line_rows(rows, width, percent, token_frequencies(rows, width)), "lines")
    own = F.struct("doc_id", "rid", "line")
    grouped = lines.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "rid", "line", "prefix")).alias("p"))
    classes = cut(grouped.select(F.xxhash64("k1", "k2", "n").alias("c"), "k1", "k2", "n", "p.doc_id", "p.rid", "p.line", "p.prefix"))
    places = classes.select("c", "doc_id", "rid", "line")
    at = lambda side, *names: places.select(F.col("c").alias(side), *names)

    def confirmed(pairs: DataFrame) -> DataFrame:
        placed = pairs.join(at("a", F.col("rid").alias("ra"), F.col("line").alias("la")), "a").join(at("b", F.col("rid").alias("rb"), F.col("line").alias("lb")), "b")
        placed = cut(placed)
        good = verified_lines(placed.select("ra", "la", "rb", "lb"), rows, width, percent)
        links = placed.join(good, ["ra", "la", "rb", "lb"]).select("a", "b")
        return cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))

    # One earlier line is enough: variants of a line meet its earliest one first, and only what that does not
    # remove is compared with all others.
    entries = shared_entries(classes)
    tried = cut(head_pairs(entries, percent))
    first_links = confirmed(tried)
    ends = first_links.join(at("a", own.alias("oa")), "a").join(at("b", own.alias("ob")), "b")
    settled = ends.where("ob < oa").select(F.col("a").alias("c")).distinct()
    both = first_links.unionByName(confirmed(cut(open_pairs(entries, settled, tried, percent))))
    earliest = both.join(at("b", own.alias("o")), "b").groupBy(F.col("a").alias("c")).agg(F.min("o").alias("e"))
    known = classes.join(earliest, "c", "left").select("k1", "k2", "n", F.least(own, F.coalesce("e", own)).alias("first"))
    judged = lines.drop("prefix").join(known, ["k1", "k2", "n"])
    return judged.select("doc_id", "rid", "line", "chars", (F.col("first") < own).alias("removed")).distinct()


def line_report(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed, removed_chars, removed_lines (sorted line numbers)."""
    gone = judged_lines(docs, width, percent).where("removed").groupBy("rid").agg(
        F.count("*").alias("n_removed"), F.sum("chars").alias("removed_chars"), F.sort_array(F.collect_list("line")).alias("removed_lines")
    )
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("rid"), _line_count(F.col("text")).alias("n_lines"), F.col("doc_id").isNotNull().alias("_known"))
    rid = F.when(F.col("_known"), F.col("rid"))
    out = rows.withColumn("rid", rid).join(gone, "rid", "left")
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("removed_chars", zero).alias("removed_chars"), F.coalesce("removed_lines", none).alias("removed_lines"))


def _line_count(text: Column) -> Column:
    """Lines between \\n; 0 for a null or empty text."""
    value = F.coalesce(text, F.lit(""))
    return F.when(value == "", 0).otherwise(1 + F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))).cast("long")


def without_repeated_lines(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` with the lines removed that repeat an earlier line, other columns and rows unchanged.

    Lines without a word, and rows without doc_id or text, are left alone; so is the order of the
    lines that stay.  Rows that are equal in doc_id and text are changed alike.  Empty in, empty out.
    """
    gone = judged_lines(docs, width, percent).where("removed").groupBy("rid").agg(F.collect_set("line").alias("_gone"))
    marked = docs.withColumn("_rid", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))))
    joined = marked.join(gone, F.col("_rid") == F.col("rid"), "left").drop("rid")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)
