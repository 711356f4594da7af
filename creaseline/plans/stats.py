"""Deliveries to player-match, team, innings and career tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.text import clean_text, lookup_key
from creaseline.operators.windows import top_per_key
from creaseline.schemas import PLAYER_MATCH

# Dismissals that give the bowler no wicket.
NOT_CREDITED = ("run out", "retired hurt", "obstructing the field")

UNKNOWN = "unknown"
_FAR = 10**15


def delivery_position() -> Column:
    """Place of a ball in its match as one number, unknown places last."""
    place = F.col("innings") * 1000000 + F.col("over") * 1000 + F.col("ball_in_over")
    return F.coalesce(place.cast("long"), F.lit(_FAR))


def kind_key() -> Column:
    return F.coalesce(lookup_key("dismissal_kind"), F.lit(""))


def delivery_indicators(deliveries: DataFrame) -> DataFrame:
    """Per ball: legal ball for batter and bowler, boundary, dismissal, wicket credit, runs conceded."""
    kind = kind_key()
    out = F.trim("player_dismissed") == F.trim("batter")
    return deliveries.withColumns(
        {
            "ball_faced": (F.col("is_wide") == 0).cast("int"),
            "is_four": (F.col("runs_off_bat") == 4).cast("int"),
            "is_six": (F.col("runs_off_bat") == 6).cast("int"),
            "batter_out": F.coalesce(out, F.lit(False)).cast("int"),
            "ball_bowled": ((F.col("is_wide") == 0) & (F.col("is_noball") == 0)).cast("int"),
            "wicket_credit": ((kind != "") & ~kind.isin(*NOT_CREDITED)).cast("int"),
            "conceded": F.col("runs_off_bat") + F.col("extras"),
        }
    )


def innings_indicators(deliveries: DataFrame) -> DataFrame:
    """Per ball of a numbered innings: total runs, powerplay runs, credited batter dismissal, run out."""
    kind = kind_key()
    total = F.col("runs_off_bat") + F.col("extras")
    out = (F.trim("player_dismissed") == F.trim("batter")) & (kind != "") & ~kind.isin(*NOT_CREDITED)
    powerplay = (F.col("over") >= 0) & (F.col("over") < 6)
    return deliveries.where(F.col("innings") > 0).withColumns(
        {
            "total_runs": total,
            "pp_runs": F.when(powerplay, total).otherwise(F.lit(0.0)),
            "batter_out": F.coalesce(out, F.lit(False)).cast("int"),
            "run_out": kind.contains("run out").cast("int"),
        }
    )


def _first(column: str, place: str = "place") -> Column:
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(place)))


def batting_lines(deliveries: DataFrame) -> DataFrame:
    """One row per (batter, match).

    The first grouping keeps team, venue and date in the key so that every aggregate is numeric and
    hashes map-side; the second one sees a handful of rows per player and match.
    """
    balls = delivery_indicators(deliveries).withColumn("place", delivery_position())
    spells = balls.groupBy(F.col("batter").alias("player_id"), "match_id", "batting_team", "venue", "date").agg(
        F.sum("runs_off_bat").alias("runs"),
        F.sum("ball_faced").alias("balls"),
        F.sum("is_four").alias("fours"),
        F.sum("is_six").alias("sixes"),
        F.max("batter_out").alias("dismissed"),
        F.min("place").alias("place"),
    )
    return spells.groupBy("player_id", "match_id").agg(
        *[F.sum(c).alias(c) for c in ("runs", "balls", "fours", "sixes")],
        F.max("dismissed").alias("dismissed"),
        *[_first(c).alias(c) for c in ("batting_team", "venue", "date")],
    )


def bowling_lines(deliveries: DataFrame) -> DataFrame:
    """One row per (bowler, match)."""
    balls = delivery_indicators(deliveries).withColumn("place", delivery_position())
    spells = balls.groupBy(F.col("bowler").alias("player_id"), "match_id", "bowling_team", "venue", "date").agg(
        F.sum("wicket_credit").alias("wickets"),
        F.sum("ball_bowled").alias("balls_bowled"),
        F.sum("conceded").alias("runs_conceded"),
        F.min("place").alias("place"),
    )
    return spells.groupBy("player_id", "match_id").agg(
        *[F.sum(c).alias(c) for c in ("wickets", "balls_bowled", "runs_conceded")],
        *[_first(c).alias(c) for c in ("bowling_team", "venue", "date")],
    )


def join_lines(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """Full outer join of both lines; date and venue come from the batting line first."""
    bowl = bowling.withColumnsRenamed({"venue": "venue_bowl", "date": "date_bowl"})
    joined = batting.join(bowl, ["player_id", "match_id"], "full")
    counts = ("runs", "balls", "fours", "sixes", "dismissed", "wickets", "balls_bowled", "runs_conceded")
    return joined.select(
        "player_id",
        "match_id",
        F.coalesce("date", "date_bowl").alias("date"),
        F.coalesce("venue", "venue_bowl").alias("venue"),
        "batting_team",
        "bowling_team",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
    )


def player_lines(deliveries: DataFrame) -> DataFrame:
    """Batting and bowling line of each (player, match) in one pass over the deliveries.

    Every ball is seen from both ends, which replaces two scans, two shuffles and the outer join.
    """
    zero, zero_d = F.lit(0), F.lit(0.0)

    def end(player: str, team: str, side: int, **values: Column) -> Column:
        names = ("runs", "balls", "fours", "sixes", "dismissed", "wickets", "balls_bowled", "runs_conceded")
        doubles = ("runs", "runs_conceded")
        return F.struct(
            F.col(player).alias("player_id"),
            F.col(team).alias("team"),
            F.lit(side).alias("side"),
            *[values.get(n, zero_d if n in doubles else zero).alias(n) for n in names],
        )

    balls = delivery_indicators(deliveries).withColumn("place", delivery_position())
    ends = F.array(
        end(
            "batter", "batting_team", 0, runs=F.col("runs_off_bat"), balls=F.col("ball_faced"),
            fours=F.col("is_four"), sixes=F.col("is_six"), dismissed=F.col("batter_out"),
        ),
        end(
            "bowler", "bowling_team", 1, wickets=F.col("wicket_credit"),
            balls_bowled=F.col("ball_bowled"), runs_conceded=F.col("conceded"),
        ),
    )
    # Dealt by match once, slim and before each ball is doubled, both groupings stay in their task; grouped before
    # the exchange, hardly a row fewer would cross it, and a map of nearly all of a task's rows spills.
    used = ("match_id", "venue", "date", "place", "batter", "bowler", "batting_team", "bowling_team", "runs_off_bat", "ball_faced", "is_four", "is_six", "batter_out", "wicket_credit", "ball_bowled", "conceded")
    dealt = balls.select(*used).repartition("match_id")
    seen = dealt.select("match_id", "venue", "date", "place", F.inline(ends)).where(
        F.trim("player_id") != ""
    )
    sums = ("runs", "balls", "fours", "sixes", "wickets", "balls_bowled", "runs_conceded")
    spells = seen.groupBy("player_id", "match_id", "side", "team", "venue", "date").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("dismissed").alias("dismissed"), F.min("place").alias("place")
    )
    ranked = spells.withColumn("ranked_place", F.col("side") * F.lit(10 * _FAR) + F.col("place"))
    return ranked.groupBy("player_id", "match_id").agg(
        _first("date", "ranked_place").alias("date"),
        _first("venue", "ranked_place").alias("venue"),
        F.min_by("team", F.when((F.col("side") == 0) & F.col("team").isNotNull(), F.col("place"))).alias("batting_team"),
        F.min_by("team", F.when((F.col("side") == 1) & F.col("team").isNotNull(), F.col("place"))).alias("bowling_team"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("dismissed").alias("dismissed"),
    )


def team_pairs(deliveries: DataFrame) -> DataFrame:
    """(match_id, team_a, team_b) in name order for matches with exactly two batting teams."""
    teams = (
        deliveries.select("match_id", clean_text("batting_team").alias("team"))
        .where(F.col("team").isNotNull())
        .groupBy("match_id", "team")
        .agg(F.lit(1).alias("one"))
    )
    return (
        teams.groupBy("match_id")
        .agg(F.min("team").alias("team_a"), F.max("team").alias("team_b"), F.count("team").alias("n"))
        .where(F.col("n") == 2)
        .drop("n")
    )


def assign_sides(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Own team and opponent of every line; both unknown unless the match has exactly two teams."""
    own = F.coalesce(clean_text("batting_team"), clean_text("bowling_team"))
    joined = lines.join(pairs, "match_id", "left").withColumn("_own", own)
    is_a, is_b = F.col("_own") == F.col("team_a"), F.col("_own") == F.col("team_b")
    return joined.withColumns(
        {
            "batting_team": F.when(is_a, F.col("team_a")).when(is_b, F.col("team_b")).otherwise(UNKNOWN),
            "bowling_team": F.when(is_a, F.col("team_b")).when(is_b, F.col("team_a")).otherwise(UNKNOWN),
        }
    ).drop("_own", "team_a", "team_b")


def role_of(balls: Column, balls_bowled: Column) -> Column:
    return (
        F.when(balls > balls_bowled * 2, "batter").when(balls_bowled > balls * 2, "bowler").otherwise("allrounder")
    )


def match_key(match_id: Column, date: Column) -> Column:
    return F.concat(match_id.cast("string"), F.lit("_"), F.date_format(date, "yyyy-MM-dd"))


def finish_player_match(lines: DataFrame) -> DataFrame:
    """Key, role and the fixed column order."""
    return lines.withColumns(
        {
            "match_key": match_key(F.col("match_id"), F.col("date")),
            "role": role_of(F.col("balls"), F.col("balls_bowled")),
            "total_balls_faced": F.col("balls"),
            "total_balls_bowled": F.col("balls_bowled"),
        }
    ).select(*PLAYER_MATCH)


def player_match_stats(deliveries: DataFrame, scorecard_rows: DataFrame | None = None) -> DataFrame:
    stats = finish_player_match(assign_sides(player_lines(deliveries), team_pairs(deliveries)))
    if scorecard_rows is not None:
        stats = stats.unionByName(scorecard_rows.select(*PLAYER_MATCH))
    return stats


def innings_table(deliveries: DataFrame) -> DataFrame:
    return innings_indicators(deliveries).groupBy("match_id", "innings", "batting_team", "bowling_team").agg(
        F.sum("total_runs").alias("runs"),
        F.sum("pp_runs").alias("pp_runs"),
        F.sum("batter_out").alias("wickets"),
        F.sum("run_out").alias("run_outs"),
    )


def pair_match_table(deliveries: DataFrame) -> DataFrame:
    """Runs, legal balls and dismissals per (match, batter, bowler).

    Slim balls are dealt by match, so that joins by match meet the result without another exchange.
    """
    kind = kind_key()
    out = (F.trim("player_dismissed") == F.trim("batter")) & (kind != "") & (kind != "nan")
    balls = deliveries.select(
        "match_id", F.trim("batter").alias("batter"), F.trim("bowler").alias("bowler"), "runs_off_bat",
        (F.col("is_wide") == 0).cast("int").alias("_ball"), F.coalesce(out, F.lit(False)).cast("int").alias("_out"),
    )
    return balls.repartition("match_id").groupBy("match_id", "batter", "bowler").agg(
        F.sum("runs_off_bat").alias("pruns"), F.sum("_ball").alias("pballs"), F.sum("_out").alias("pdism")
    )


def innings_totals(deliveries: DataFrame) -> DataFrame:
    """Runs and wicket rows of both innings per match, null for an innings that was not played."""
    total = F.col("runs_off_bat") + F.col("extras")
    wicket = (kind_key() != "").cast("int")

    def of(value: Column, innings: int) -> Column:
        return F.sum(F.when(F.col("innings") == innings, value))

    return deliveries.groupBy("match_id").agg(
        of(total, 1).alias("innings1_runs"),
        of(total, 2).alias("innings2_runs"),
        of(wicket, 1).alias("innings1_wickets"),
        of(wicket, 2).alias("innings2_wickets"),
    )


def career_summary(deliveries: DataFrame, since: str = "2020-01-01") -> tuple[DataFrame, DataFrame]:
    """Career batting and bowling lines from matches on or after ``since``."""
    balls = delivery_indicators(deliveries.where(F.col("date") >= F.lit(since).cast("date")))
    # Here every dismissal but a run out counts, for batter and bowler alike.
    wicket = ((F.coalesce(F.trim("player_dismissed"), F.lit("")) != "") & (kind_key() != "run out")).cast("int")
    balls = balls.withColumn("wicket", wicket)
    batting = balls.groupBy("batter").agg(
        F.sum("runs_off_bat").alias("runs"),
        F.sum("ball_faced").alias("balls"),
        F.sum("is_four").alias("fours"),
        F.sum("is_six").alias("sixes"),
        F.sum("wicket").alias("dismissals"),
    )
    bowling = balls.groupBy("bowler").agg(
        F.sum("wicket").alias("wickets"),
        F.sum("ball_bowled").alias("balls_bowled"),
        F.sum("conceded").alias("runs_conceded"),
    )
    return (
        batting.withColumn("strike_rate", F.try_divide(F.col("runs"), F.col("balls")) * 100),
        bowling.withColumn("overs", F.col("balls_bowled") / 6.0).withColumn(
            "economy", F.try_divide(F.col("runs_conceded"), F.col("balls_bowled") / 6.0)
        ),
    )


def top_scorers_per_match(deliveries: DataFrame, n: int = 5) -> DataFrame:
    """Actual leading run makers of each match, ranked by runs then name."""
    runs = deliveries.groupBy("match_id", "batter").agg(F.sum("runs_off_bat").alias("runs"))
    return top_per_key(runs, ["match_id"], [F.desc("runs"), F.asc("batter")], n, rank="place")


def top_wicket_takers_per_match(deliveries: DataFrame, n: int = 3) -> DataFrame:
    """Bowlers with the most wicket rows of each match."""
    wickets = (
        deliveries.where(kind_key() != "").groupBy("match_id", "bowler").agg(F.count(F.lit(1)).alias("wickets"))
    )
    return top_per_key(wickets, ["match_id"], [F.desc("wickets"), F.asc("bowler")], n, rank="place")


def match_rosters(stats: DataFrame) -> DataFrame:
    """Distinct players of each (match, team)."""
    return stats.groupBy("match_id", F.col("batting_team").alias("team"), "player_id").agg(F.lit(1).alias("one")).drop("one")


def player_count(deliveries: DataFrame) -> DataFrame:
    """Rows, matches and distinct players over the four player columns."""
    names = F.explode(F.array("batter", "bowler", "non_striker", "player_dismissed"))
    players = (
        deliveries.select(names.alias("player"))
        .where((F.col("player") != "") & (F.col("player") != "nan"))
        .groupBy("player")
        .agg(F.lit(1).alias("one"))
        .agg(F.count(F.lit(1)).alias("n_players"))
    )
    per_match = deliveries.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_match.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_matches")
    )
    return totals.withColumn("n_players", players.scalar())
