"""Time-ordered windows that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(player)`` sends a player's whole history to one task.  Every function here cuts the
timeline of a large key into chunks of about equal depth and carries the little that crosses a chunk border: the
last ``depth`` rows for row frames, one running total for cumulative frames.  Borders are places in the whole order
(date, then the ties), so a key with all its rows on one day, or without dates, is spread like any other.  The
row-level window is partitioned by (key, chunk), and the only per-key windows run over at most ``depth`` rows, or one
row, per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creaseline.session import cut_lineage

CHUNK = "_chunk"
HALO = "_halo"
#: Rows of one key that one task sorts, and how many rows of the histogram stand for them.  A chunk holds
#: ROWS_PER_CHUNK rows with a relative deviation of about one over the root of SAMPLES_PER_CHUNK.
ROWS_PER_CHUNK, SAMPLES_PER_CHUNK = 200_000, 64
#: Borders (a few values each) up to which the list of borders is broadcast; beyond, it is joined by key.
BROADCAST_BORDERS = 100_000


def _place(order: Sequence[str]) -> Column:
    """A row's place in an order with nulls last, as one comparable value."""
    return F.struct(*[x for n in order for x in (F.col(n).isNull().alias(f"n_{n}"), F.col(n))])


@dataclass
class Borders:
    """Sorted chunk borders of the keys that have any; ``table`` (keys, _borders) is None when no key has."""

    keys: list[str]
    order: list[str]
    table: DataFrame | None
    count: int = 0
    longest: int = 0

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the chunk of each: the number of its key's borders at or before its place."""
        if self.table is None:
            return rows.withColumn(CHUNK, F.lit(0))
        if self.keys:
            lists = self.table.withColumnsRenamed({k: f"_b_{k}" for k in self.keys})
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in self.keys])
            joined = rows.join(F.broadcast(lists) if self.count <= BROADCAST_BORDERS else lists, same, "left")
        else:
            joined = rows.withColumn("_borders", self.table.select("_borders").scalar())
        found = self._passed(F.col("_borders"), _place(self.order))
        return joined.withColumn(CHUNK, F.coalesce(found, F.lit(0))).drop("_borders", *[f"_b_{k}" for k in self.keys])

    def _passed(self, borders: Column, place: Column) -> Column:
        """How many sorted borders are at or before a place, by halving steps instead of a scan of the list."""
        steps = [1 << k for k in reversed(range(self.longest.bit_length()))]

        def step(passed: Column, width: Column) -> Column:
            further = passed + width
            fits = (further <= F.size(borders)) & (F.get(borders, further - 1) <= place)
            return F.when(fits, further).otherwise(passed)

        return F.when(borders.isNotNull(), F.aggregate(F.array(*[F.lit(w) for w in steps]), F.lit(0), step))


def chunk_borders(rows: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int | None = None) -> Borders:
    """Borders that cut the rows of each key into chunks of about ``rows_per_chunk``, equally deep whatever the values.

    The histogram is a sample of places, SAMPLES_PER_CHUNK for a chunk; every so many places of a key make a border.
    Only borders come from it: which chunk a row falls into changes no result.  The borders are fixed by a checkpoint
    before any row uses them.  Few keys have any, and where none has, windows over whole keys are left to Spark.
    """
    depth = ROWS_PER_CHUNK if rows_per_chunk is None else rows_per_chunk
    keys, order = list(keys), list(order)
    every = max(1, min(SAMPLES_PER_CHUNK, depth))
    seen = rows.select(*keys, _place(order).alias("_at")).sample(every / depth, 17)
    by_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_at")
    chosen = seen.withColumn("_n", F.row_number().over(by_key)).where(F.col("_n") % every == 0)
    lists = chosen.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_borders")).where(F.size("_borders") > 0)
    size = [F.coalesce(F.sum(F.size("_borders")), F.lit(0)), F.coalesce(F.max(F.size("_borders")), F.lit(0))]
    if not lists.agg(*size).first()[0]:
        return Borders(keys, order, None)
    lists = cut_lineage(lists)
    return Borders(keys, order, lists, *lists.agg(*size).first())


def ordered(names: Sequence[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def chunk_window(keys: Sequence[str], order: Sequence[str]):
    """Window over one chunk of one key, for use on the output of :func:`with_prior_rows`."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*ordered(order))


def with_prior_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    depth: int,
    flag: str | None = None,
    borders: Borders | None = None,
) -> DataFrame:
    """Rows of ``df`` plus, for each (key, chunk), copies of the rows just before the chunk.

    The copies have ``_halo = true`` and carry only ``keys``, ``order``, ``values`` and ``flag``.
    With ``flag`` the copies also cover the last ``depth`` rows for which the flag is true.  ``borders`` are taken
    from ``df`` if not given.
    """
    borders = chunk_borders(df, keys, order) if borders is None else borders
    rows = borders.apply(df)
    if borders.table is None:
        alone = rows.withColumn(HALO, F.lit(False))
        return alone.repartition(*keys) if flag else alone
    carried = list(dict.fromkeys([*order, *values, *([flag] if flag else [])]))
    within_desc = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(n).desc_nulls_first() for n in order])

    slim = rows.select(*keys, CHUNK, *[c for c in carried if c not in keys])
    tails = slim.withColumn("_rn", F.row_number().over(within_desc))
    if flag:
        # Tail of all rows and tail of the flagged rows, ranked under the one exchange on (key, chunk).
        flagged = F.coalesce(F.col(flag), F.lit(False))
        ranked = Window.partitionBy(*keys, CHUNK, flagged).orderBy(*[F.col(n).desc_nulls_first() for n in order])
        tails = tails.withColumn("_rf", F.row_number().over(ranked)).where(
            (F.col("_rn") <= depth) | (flagged & (F.col("_rf") <= depth))
        ).drop("_rf")
    else:
        tails = tails.where(F.col("_rn") <= depth)
    tails = tails.drop("_rn")

    per_key = Window.partitionBy(*keys).orderBy(CHUNK, *ordered(order))
    packed = F.struct(*[F.col(c) for c in carried])
    tails = tails.withColumn("_before", F.collect_list(packed).over(per_key.rowsBetween(-depth, -1)))
    if flag:
        per_flag = Window.partitionBy(*keys, F.coalesce(F.col(flag), F.lit(False))).orderBy(CHUNK, *ordered(order))
        tails = tails.withColumn(
            "_upto",
            F.when(F.col(flag), F.collect_list(packed).over(per_flag.rowsBetween(-(depth - 1), 0))),
        )
        tails = tails.withColumn(
            "_before",
            F.array_union(
                F.col("_before"),
                F.coalesce(
                    F.last("_upto", ignorenulls=True).over(per_key.rowsBetween(Window.unboundedPreceding, -1)),
                    F.filter("_before", lambda _: F.lit(False)),
                ),
            ),
        )
    first_of_chunk = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*ordered(order)))
    halo = (
        tails.withColumn("_first", first_of_chunk)
        .where(F.col("_first") == 1)
        .select(*keys, CHUNK, F.explode("_before").alias("_row"))
        .select(*keys, CHUNK, *[F.col("_row")[c].alias(c) for c in carried if c not in keys], F.lit(True).alias(HALO))
    )
    together = rows.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)
    # The flagged frames partition by (key, chunk, flag); one shuffle on (key, chunk) serves them as well.
    return together.repartition(*keys, CHUNK) if flag else together


def drop_prior_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, CHUNK)


def prior_rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, str]],
    depth: int = 5,
    borders: Borders | None = None,
) -> DataFrame:
    """Aggregates of the ``depth`` rows before each row; ``outputs`` maps name to (function, column)."""
    values = list(dict.fromkeys(c for _, c in outputs.values()))
    rows = with_prior_rows(df, keys, order, values, depth, borders=borders)
    frame = chunk_window(keys, order).rowsBetween(-depth, -1)
    calls = {name: getattr(F, fn)(F.col(col)).over(frame) for name, (fn, col) in outputs.items()}
    return drop_prior_rows(rows.withColumns(calls))


def add_conditional_rolling(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, outputs: dict[str, str], depth: int
) -> DataFrame:
    """Mean of each value over the last ``depth`` flagged rows before each row.

    Two steps on :func:`with_prior_rows` output of the same flag and depth: the running means on flagged
    rows, then the latest flagged row before each row.
    """
    per_flag = Window.partitionBy(*keys, CHUNK, F.col(flag)).orderBy(*ordered(order)).rowsBetween(-(depth - 1), 0)
    means = F.struct(*[F.avg(value).over(per_flag).alias(name) for name, value in outputs.items()])
    before = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    staged = rows.withColumn("_means", F.when(F.col(flag), means))
    latest = staged.withColumn("_latest", F.last("_means", ignorenulls=True).over(before))
    return latest.withColumns({name: F.col("_latest")[name] for name in outputs}).drop("_means", "_latest")


def conditional_prior(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: str,
    outputs: dict[str, str],
    depth: int = 5,
    borders: Borders | None = None,
) -> DataFrame:
    """Mean of each value over the last ``depth`` flagged rows before each row; null when there are none."""
    rows = with_prior_rows(df, keys, order, list(outputs.values()), depth, flag=flag, borders=borders)
    rows = rows.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return drop_prior_rows(add_conditional_rolling(rows, keys, order, flag, outputs, depth))


def prior_cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    borders: Borders | None = None,
    totals_from: DataFrame | None = None,
) -> DataFrame:
    """Sums over all earlier rows of the key; 0 when there are none or a key is null.

    Chunk totals are combined before the shuffle, their running sum has one row per (key, chunk), and the
    row-level frame never leaves a chunk.  ``totals_from`` names a cheaper table with the same rows to
    take borders and totals from.
    """
    source = df if totals_from is None else totals_from
    borders = chunk_borders(source, keys, order) if borders is None else borders
    rows = borders.apply(df).withColumns({f"_v_{n}": c.cast("double") for n, c in sums.items()})
    carried = {n: F.lit(0.0) for n in sums}
    if borders.table is not None:
        totals = (
            borders.apply(source).groupBy(*keys, CHUNK).agg(*[F.sum(c.cast("double")).alias(f"_t_{n}") for n, c in sums.items()])
        )
        # With no keys this window orders the chunk totals only.
        earlier = (
            (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = totals.select(*keys, CHUNK, *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums])
        rows = rows.join(carry, [*keys, CHUNK], "left")
        carried = {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0.0)) for n in sums}
    inside = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    result = {
        n: F.when(known, carried[n] + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0.0))).otherwise(F.lit(0.0))
        for n in sums
    }
    return rows.withColumns(result).drop(CHUNK, *[f"_v_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def with_table_stats(df: DataFrame, stats: DataFrame, name: str) -> DataFrame:
    """``df`` with the single row of ``stats`` as one struct column, so that it is planned and run once."""
    return df.withColumn(name, stats.select(F.struct(*stats.columns)).scalar())


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "rn", borders: Borders | None = None) -> DataFrame:
    """1-based position of each row in the total order, without sorting the table in one task."""
    numbered = prior_cumulative(df, [], order, {name: F.lit(1)}, borders)
    return numbered.withColumn(name, (F.col(name) + 1).cast("long"))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per key, as one hash-partitioned aggregate."""
    rank = F.struct(*[x for n in order for x in (F.col(n).isNull().alias(f"_n_{n}"), F.col(n))])
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key; Spark keeps at most ``n`` rows per key and map task before the shuffle."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order; null keys count as equal."""
    return top_per_key(df, keys, order, 1)
