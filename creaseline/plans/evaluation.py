"""Time-ordered splits, folds and probability metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.text import clip
from creaseline.operators.windows import global_row_number

LOG_LOSS_EPS = 1e-15


def time_position(rows: DataFrame, date: str = "date", ident: str = "match_id", ties: Sequence[str] = ()) -> DataFrame:
    """``rn`` (1-based, by date, id and ties) and the row count ``n`` on every row."""
    ranked = global_row_number(rows, [date, ident, *ties])
    total = rows.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("n", total)


def time_split(
    rows: DataFrame, test_frac: float = 0.2, minimum: int = 20, min_test: int = 1, **position
) -> DataFrame:
    """``part`` = train / test: the last share by time.

    A test block shorter than ``min_test`` is replaced by the last rows of the training block.  Fewer
    than ``minimum`` rows raise an error when the split is used.
    """
    placed = time_position(rows, **position)
    n, rn = F.col("n"), F.col("rn")
    cut = F.floor(n * F.lit(1.0 - test_frac))
    short = (n - cut) < min_test
    fallback = F.greatest(F.lit(min_test), F.floor(n / 5))
    part = (
        F.when(n < minimum, F.raise_error(F.lit(f"time split needs at least {minimum} rows")).cast("string"))
        .when(~short, F.when(rn <= cut, "train").otherwise("test"))
        .when(rn <= cut - fallback, "train")
        .when(rn <= cut, "test")
    )
    return placed.withColumn("part", part).drop("rn", "n")


def block_folds(rows: DataFrame, folds: int = 5, **position) -> DataFrame:
    """``fold``: contiguous time blocks; training data of a fold is every other block."""
    placed = time_position(rows, **position)
    fold = F.ceil(F.col("rn") * folds / F.col("n")) - 1
    return placed.withColumn("fold", fold.cast("int")).drop("rn", "n")


def expanding_folds(rows: DataFrame, **position) -> DataFrame:
    """One row per (row, fold) with ``role`` train or validate; training data always lies earlier."""
    placed = time_position(rows, **position)
    n, i = F.col("n"), F.col("rn") - 1
    splits = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 40)))
    size = F.floor(n / (splits + 1))
    exploded = placed.withColumns({"_s": splits, "_size": size}).withColumn(
        "fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))
    )
    start = n - F.col("_s") * F.col("_size") + F.col("fold") * F.col("_size")
    role = F.when(i < start, "train").when(i < start + F.col("_size"), "validate")
    return (
        exploded.withColumn("role", role)
        .where(F.col("role").isNotNull())
        .withColumn("fold", F.col("fold").cast("int"))
        .drop("_s", "_size", "rn", "n")
    )


def log_loss_term(y: Column, p: Column, eps: float = LOG_LOSS_EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return -(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))


def probability_metrics(scored: DataFrame, y: str, p: str, by: str | None = None, minimum: int = 1) -> DataFrame:
    """Row count, Brier score, log loss and accuracy at 0.5, overall or per group of enough rows."""
    yc, pc = F.col(y), F.col(p)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg((pc - yc) * (pc - yc)).alias("brier"),
        F.avg(log_loss_term(yc, pc)).alias("log_loss"),
        F.avg(((pc >= 0.5).cast("double") == yc).cast("double")).alias("accuracy"),
    ]
    valid = scored.where(yc.isNotNull() & pc.isNotNull())
    table = valid.groupBy(by).agg(*aggs) if by else valid.agg(*aggs)
    return table.where(F.col("n") >= minimum)


def reliability_table(scored: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean probability and hit rate per equal-width bin; empty bins are kept."""
    valid = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    found = valid.groupBy(
        F.greatest(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("empirical_rate"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ranking_auc(scored: DataFrame, y: str, p: str) -> DataFrame:
    """Exact area under the ROC curve: equal scores are counted together, then ranked in equally deep chunks."""
    from creaseline.operators.windows import prior_cumulative

    by_score = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(
        F.sum(F.col(y).cast("double")).alias("pos"), F.sum(F.lit(1.0) - F.col(y).cast("double")).alias("neg")
    )
    ranked = prior_cumulative(by_score, [], ["_p"], {"neg_below": F.col("neg")})
    return ranked.agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")
        ).alias("auc")
    )


def regression_metrics(scored: DataFrame, y: str, p: str) -> DataFrame:
    """Mean absolute error and R2."""
    valid = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")
    )
    sse = F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    return valid.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
        (F.lit(1.0) - F.try_divide(sse, F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
    )
