"""Quality rules whose cutoffs are chosen from labelled rows so that few good documents are lost (operator 1)."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.llm.common import WORD, cut, map_texts, written

find_words = re.compile(WORD).findall
#: What counts as a symbol, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

#: Rules: a score that grows with badness, and its candidate cutoffs from lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.9, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07),
    "upper_share": (0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2),
    "mark_share": (0.9, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1),
    "repeat_share": (0.28, 0.22, 0.17, 0.13, 0.1, 0.07),
    "duplicate_line_share": (0.9, 0.7, 0.5, 0.4, 0.3),
}
RISK, CONFIDENCE, PRICE = 0.025, 0.95, 10

BASE_FIELDS: dict[str, T.DataType] = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "n_upper_words": T.LongType(), "n_marks": T.LongType(), "n_lines": T.LongType(),
}


def repeated_window_words(words: list[str], width: int = WINDOW) -> int:
    """Words covered by windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashes[i : i + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.nonzero(np.isin(rolled, twice))[0].tolist()
    windows = [tuple(words[i : i + width]) for i in starts]
    counts = Counter(windows)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(starts, windows):
        if counts[w] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_signals(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in BASE_FIELDS}
    for text in texts:
        text = text or ""
        words = find_words(text)
        lines = [line for line in text.split("\n") if find_words(line)]
        row = (
            len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_window_words(words), sum(w.isupper() and len(w) > 1 for w in words), text.count("!"), len(lines),
        )
        for name, value in zip(BASE_FIELDS, row):
            out[name].append(value)
    return out


def _share(count: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(count) / F.col(total)).otherwise(F.lit(0.0))


def with_signals(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Base counts, `base_failed`, and one score per rule.  Columns of these names in `docs` are replaced."""
    out = map_texts(docs, base_signals, BASE_FIELDS, drop=() if keep_text else ("text",))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumns(
        {
            "base_failed": failed,
            "symbol_share": _share("n_symbols", "n_words"),
            "upper_share": _share("n_upper_words", "n_words"),
            "mark_share": _share("n_marks", "n_words"),
            "repeat_share": _share("n_repeat_words", "n_words"),
            "duplicate_line_share": _share("n_dup_lines", "n_lines"),
        }
    )


def upper_bound(failures: int, trials: int, alpha: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate at confidence 1 - alpha, by bisection."""
    if trials <= 0 or failures >= trials:
        return 1.0
    logs = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(failures + 1)]

    def cdf(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return sum(math.exp(c + k * a + (trials - k) * b) for k, c in enumerate(logs))

    low, high = failures / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and cdf(mid) > alpha:
            low = mid
        else:
            high = mid
    return high


@F.pandas_udf(T.DoubleType())
def _bound(failures: pd.Series, trials: pd.Series, alpha: pd.Series) -> pd.Series:
    known: dict = {}
    for key in set(zip(failures, trials, alpha)):
        known[key] = upper_bound(int(key[0]), int(key[1]), key[2])
    return pd.Series([known[key] for key in zip(failures, trials, alpha)], dtype="float64")


def certified_cutoffs(
    labelled: DataFrame,
    stratum: str = "lang",
    label: str = "quality",
    risk: float = RISK,
    confidence: float = CONFIDENCE,
    price: float = PRICE,
) -> DataFrame:
    """Cutoffs per (stratum, rule) under which few good documents are rejected.

    `labelled` has the rule scores, the stratum and a 0/1 label of documents that passed the base rules.  Every
    rule may spend an equal part of `risk`.  Its candidates are tested in order from lenient to strict and the
    first that fails ends the sequence, which keeps the error of a family without a charge per candidate; the
    families (strata times rules) share 1 - `confidence` by Bonferroni.  A candidate passes if the exact
    binomial upper bound of its false rejections is at most the rule's part.  Of the candidates that passed, the
    one with the most rejected bad documents less `price` times the rejected good ones is taken, ties to the
    lenient one.  A stratum or rule without a passing, useful candidate gets no row: it rejects nothing.
    """
    each = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), (F.col(rule) >= c).alias("out"))
            for rule, cutoffs in RULES.items()
            for i, c in enumerate(cutoffs)
        ]
    )
    good, bad = (F.col(label) == 1).cast("long"), (F.col(label) == 0).cast("long")
    counts = (
        labelled.select(F.col(stratum).alias("stratum"), good.alias("good"), bad.alias("bad"), F.explode(each).alias("t"))
        .groupBy("stratum", "t.rule", "t.step", "t.cutoff")
        .agg(
            F.sum("good").alias("n_good"),
            F.sum(F.when(F.col("t.out"), F.col("good")).otherwise(0)).alias("lost"),
            F.sum(F.when(F.col("t.out"), F.col("bad")).otherwise(0)).alias("caught"),
        )
    )
    counts = cut(counts)
    strata = max(1, counts.select("stratum").distinct().count())
    alpha = (1 - confidence) / (strata * len(RULES))
    tested = counts.withColumn("bound", _bound("lost", "n_good", F.lit(alpha)))
    part = risk / len(RULES)
    path = F.expr("array_sort(collect_list(struct(step, cutoff, lost, caught, n_good, bound)))")
    passing = F.aggregate(
        "path",
        F.lit(0),
        lambda n, s: F.when((s["step"] == n) & (s["bound"] <= part), n + 1).otherwise(n),
    )
    best = F.expr(
        f"array_max(transform(passed, s -> struct(s.caught - {price} * s.lost as gain, -s.step as lenient, s.cutoff as cutoff,"
        " s.lost as lost, s.caught as caught, s.n_good as n_good, s.bound as bound)))"
    )
    return (
        tested.groupBy("stratum", "rule")
        .agg(path.alias("path"))
        .withColumn("passed", F.slice("path", F.lit(1), passing))
        .where(F.size("passed") > 0)
        .withColumn("best", best)
        .where("best.gain > 0")
        .select("stratum", "rule", "best.cutoff", "best.lost", "best.caught", "best.n_good", "best.bound")
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep_text: bool = False, **options) -> DataFrame:
    """Documents with their base counts, rule scores, `base_failed` and `kept`.

    A document is kept if the base rules pass and no certified rule of its stratum rejects it.  Null and empty
    texts have no words and fail the base rules.  A null stratum is a stratum of its own.  Labels are matched by
    doc_id; null ids, null labels and ids without a document teach nothing, and repeated labels of an id count
    once, as bad if any is bad.  Repeated documents are judged alike, row by row.  Other columns of `docs` pass
    through; columns named like a count or score are replaced.  An empty table gives an empty table.
    """
    signals = written(with_signals(docs, keep_text), "signals")
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    scores = signals.where("not base_failed").select("doc_id", F.col(stratum).alias("stratum"), *RULES)
    rules = certified_cutoffs(scores.join(one, "doc_id"), "stratum", **options)
    # One row per (stratum, rule): bounded by the number of strata, so it reaches the rows as a map per stratum.
    by_stratum = rules.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    judged = signals.join(by_stratum, F.col(stratum).eqNullSafe(F.col("stratum")), "left").drop("stratum")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) >= F.col("_cutoffs")[rule], F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cutoffs")
