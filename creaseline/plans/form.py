"""Recent appearances: recency-weighted form, playing probability and selection of an eleven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creaseline.functions.franchise import known_role
from creaseline.functions.text import clean_text, lookup_key
from creaseline.operators.windows import keep_one, top_per_key

# Weights of the last ten and last five matches, most recent first.
WEIGHTS_10 = (0.22, 0.18, 0.15, 0.12, 0.10, 0.08, 0.07, 0.05, 0.02, 0.01)
WEIGHTS_5 = (0.35, 0.25, 0.18, 0.12, 0.10)
UNKNOWN_CONFIDENCE, NO_HISTORY_CONFIDENCE = 0.35, 0.5

# Smallest number of each role in an eleven, and squad sizes.
ROLE_QUOTA = {"batter": 4, "bowler": 3, "allrounder": 2}
XI_SIZE, BENCH_SIZE, MAX_OVERSEAS = 11, 2, 4

LATEST = ("date", "match_id")


def latest_rows(stats: DataFrame, n: int) -> DataFrame:
    """Last ``n`` appearances per player, ranked 1 for the latest."""
    order = [F.col(c).desc_nulls_first() for c in LATEST]
    return top_per_key(stats, ["player_id"], order, n, rank="recency")


def recent_form(stats: DataFrame, oldest_first: bool = False) -> DataFrame:
    """Weighted means over the last five and ten matches, match counts and data confidence.

    Weights follow recency; ``oldest_first`` applies them from the oldest of the kept matches instead.
    """
    last10 = latest_rows(stats.select("player_id", "match_id", "date", "runs", "wickets"), 10)
    if oldest_first:
        held = F.count(F.lit(1)).over(Window.partitionBy("player_id"))
        last10 = last10.withColumn("_held", held)

    def weight(weights: tuple[float, ...]) -> Column:
        n = len(weights)
        place = F.col("recency") if not oldest_first else F.least(F.col("_held"), F.lit(n)) - F.col("recency") + 1
        table = F.array(*[F.lit(w) for w in weights])
        return F.when(F.col("recency") <= n, F.get(table, (place - 1).cast("int")))

    weighted = last10.withColumns({"_w5": weight(WEIGHTS_5), "_w10": weight(WEIGHTS_10)})

    def mean(value: str, w: str) -> Column:
        return F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(w)) / F.sum(w)

    n10 = F.count_distinct("match_id")
    return weighted.groupBy("player_id").agg(
        F.count_distinct(F.when(F.col("recency") <= 5, F.col("match_id"))).alias("n_matches_last_5"),
        n10.alias("n_matches_last_10"),
        mean("runs", "_w5").alias("weighted_avg_runs_last_5"),
        mean("wickets", "_w5").alias("weighted_avg_wk_last_5"),
        mean("runs", "_w10").alias("weighted_avg_runs_last_10"),
        mean("wickets", "_w10").alias("weighted_avg_wk_last_10"),
        F.least(n10 / 10.0, F.lit(1.0)).alias("data_confidence"),
    )


def playing_probability(stats: DataFrame) -> DataFrame:
    """Share of five distinct matches among the player's last five rows."""
    return (
        latest_rows(stats.select("player_id", "match_id", "date"), 5)
        .groupBy("player_id")
        .agg(F.least(F.count_distinct("match_id") / 5.0, F.lit(1.0)).alias("playing_prob"))
    )


def team_rows(stats: DataFrame, team: str) -> DataFrame:
    """Rows where the team plays on either side: exact name if any row has it, else ignoring case."""
    exact = (F.trim("batting_team") == team.strip()) | (F.trim("bowling_team") == team.strip())
    folded = (lookup_key("batting_team") == team.strip().lower()) | (lookup_key("bowling_team") == team.strip().lower())
    any_exact = stats.agg(F.coalesce(F.max(exact), F.lit(False))).scalar()
    return stats.where(F.when(any_exact, exact).otherwise(folded))


def selection_table(stats: DataFrame, keys: tuple[str, ...] = ("team", "player_id")) -> DataFrame:
    """Matches among the last five and ten, selection score and latest role, per team and player."""
    one_each = keep_one(stats, [*keys, "match_id"], [F.col("date").desc_nulls_first(), F.col("role").asc()])
    order = [F.col(c).desc_nulls_first() for c in LATEST]
    last10 = top_per_key(one_each, list(keys), order, 10, rank="recency")
    m5 = F.count_distinct(F.when(F.col("recency") <= 5, F.col("match_id")))
    m10 = F.count_distinct("match_id")
    return last10.groupBy(*keys).agg(
        F.max(F.when(F.col("recency") == 1, known_role(F.col("role")))).alias("role"),
        m5.alias("matches_last_5"),
        m10.alias("matches_last_10"),
        (m5 / 5.0 * 0.6 + m10 / 10.0 * 0.4).alias("selection_score"),
    )


def pick_eleven(players: DataFrame, keys: tuple[str, ...] = ("team",)) -> DataFrame:
    """Eleven per team: role quotas first, then the best scores; then a bench of two.

    Adds ``xi_place`` (1..11 by quota, score and id) and ``slot`` in xi / bench / out.
    """
    by_role = Window.partitionBy(*keys, "role").orderBy(F.desc("selection_score"), "player_id")
    quota = F.lit(0)
    for role, n in ROLE_QUOTA.items():
        quota = F.when((F.col("role") == role) & (F.col("_in_role") <= n), 1).otherwise(quota)
    marked = players.withColumn("_in_role", F.row_number().over(by_role)).withColumn("_quota", quota)
    by_pick = Window.partitionBy(*keys).orderBy(F.desc("_quota"), F.desc("selection_score"), "player_id")
    picked = marked.withColumn("_pick", F.row_number().over(by_pick)).withColumn("_in_xi", F.col("_pick") <= XI_SIZE)
    by_score = Window.partitionBy(*keys, "_in_xi").orderBy(F.desc("selection_score"), "player_id")
    ranked = picked.withColumn("_place", F.row_number().over(by_score))
    slot = F.when(F.col("_in_xi"), "xi").when(F.col("_place") <= BENCH_SIZE, "bench").otherwise("out")
    return ranked.withColumns({"slot": slot, "place": F.col("_place")}).drop("_in_role", "_quota", "_pick", "_in_xi", "_place")


def cap_overseas(picked: DataFrame, keys: tuple[str, ...] = ("team",), cap: int = MAX_OVERSEAS) -> DataFrame:
    """Replace the lowest overseas players beyond the cap by the best domestic players outside the eleven.

    Swaps are one pass: with an excess of k, the k lowest overseas leave and the k best domestic enter,
    as far as domestic players exist.
    """
    overseas = F.coalesce(F.col("is_overseas"), F.lit(0)) == 1
    in_xi = F.col("slot") == "xi"
    team = Window.partitionBy(*keys)
    group = Window.partitionBy(*keys, "_in_xi", "_os")
    counted = picked.withColumns({"_os": overseas, "_in_xi": in_xi})
    counted = counted.withColumns(
        {
            "_excess": F.greatest(F.sum((F.col("_os") & F.col("_in_xi")).cast("int")).over(team) - F.lit(cap), F.lit(0)),
            "_domestic": F.sum((~F.col("_os") & ~F.col("_in_xi")).cast("int")).over(team),
            "_low": F.row_number().over(group.orderBy("selection_score", F.desc("player_id"))),
            "_high": F.row_number().over(group.orderBy(F.desc("selection_score"), "player_id")),
        }
    )
    swaps = F.least(F.col("_excess"), F.col("_domestic"))
    leaves = F.col("_os") & F.col("_in_xi") & (F.col("_low") <= swaps)
    enters = ~F.col("_os") & ~F.col("_in_xi") & (F.col("_high") <= swaps)
    counted = counted.withColumn("_final", (F.col("_in_xi") & ~leaves) | enters)
    bench = F.row_number().over(Window.partitionBy(*keys, "_final").orderBy(F.desc("selection_score"), "player_id"))
    slot = F.when(F.col("_final"), "xi").when(bench <= BENCH_SIZE, "bench").otherwise("out")
    return counted.withColumn("slot", slot).drop("_os", "_in_xi", "_excess", "_domestic", "_low", "_high", "_final", "place")


def squad_flags(players: DataFrame, squads: DataFrame) -> DataFrame:
    """Overseas flag of each (team, player) from the squad table."""
    table = squads.groupBy(lookup_key("team").alias("_t"), lookup_key("player_id").alias("_p")).agg(
        F.max("is_overseas").alias("is_overseas")
    )
    joined = players.join(
        table, (lookup_key("team") == F.col("_t")) & (lookup_key("player_id") == F.col("_p")), "left"
    )
    return joined.drop("_t", "_p")


def confidence_or_default(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(UNKNOWN_CONFIDENCE))


def roster_lists(rosters: DataFrame) -> DataFrame:
    """Comma list of the distinct players of each (match, team), in name order; a roster is a few names."""
    named = rosters.where(clean_text("player_id").isNotNull())
    return named.groupBy("match_id", "team").agg(
        F.array_join(F.sort_array(F.collect_set("player_id")), ",").alias("players")
    )
