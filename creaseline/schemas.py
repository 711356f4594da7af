"""Column lists and explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _I, _L, _S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


DELIVERIES = _struct(
    match_id=_L, date=T.DateType(), venue=_S, batting_team=_S, bowling_team=_S, batter=_S, bowler=_S,
    non_striker=_S, runs_off_bat=_D, extras=_D, is_wide=_I, is_noball=_I, dismissal_kind=_S,
    player_dismissed=_S, innings=_I, over=_I, ball_in_over=_I, competition=_S,
)

# Columns a delivery file must have.
REQUIRED_DELIVERY_COLUMNS = (
    "match_id", "date", "venue", "batting_team", "bowling_team", "batter", "bowler", "runs_off_bat",
    "extras", "is_wide", "is_noball", "dismissal_kind", "player_dismissed",
)

# Header spellings accepted for each delivery column, first present spelling wins.
HEADER_ALIASES = {
    "match_id": ("match_id", "matchId"),
    "date": ("start_date", "date"),
    "venue": ("venue",),
    "batting_team": ("batting_team",),
    "bowling_team": ("bowling_team",),
    "batter": ("batter", "batter_id", "batsman", "striker"),
    "bowler": ("bowler", "bowler_id"),
    "non_striker": ("non_striker", "non_striker_id"),
    "runs_off_bat": ("runs_off_bat", "runs_batter", "batsman_runs"),
    "extras": ("extras", "runs_extras"),
    "dismissal_kind": ("dismissal_kind", "wicket_type"),
    "player_dismissed": ("player_dismissed", "batter_out_id"),
    "innings": ("innings",),
    "over": ("over",),
    "ball_in_over": ("ball_in_over",),
    "competition": ("competition",),
    "total_runs": ("total_runs",),
    "extras_type": ("extras_type",),
    "is_wide": ("is_wide", "isWide"),
    "is_noball": ("is_noball", "isNoBall"),
    "wides": ("wides",),
    "noballs": ("noballs",),
    "byes": ("byes",),
    "legbyes": ("legbyes",),
    "penalty": ("penalty",),
}

EXTRA_COMPONENTS = ("wides", "noballs", "byes", "legbyes", "penalty")

MATCH_JSON = T.StructType(
    [
        T.StructField(
            "info",
            T.StructType(
                [
                    T.StructField("dates", T.ArrayType(_S)),
                    T.StructField("venue", _S),
                    T.StructField("teams", T.ArrayType(_S)),
                    T.StructField("event", _struct(name=_S)),
                    T.StructField("competition", _S),
                ]
            ),
        ),
        T.StructField(
            "innings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("team", _S),
                        T.StructField(
                            "overs",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField(
                                            "deliveries",
                                            T.ArrayType(
                                                T.StructType(
                                                    [
                                                        T.StructField("batter", _S),
                                                        T.StructField("batsman", _S),
                                                        T.StructField("bowler", _S),
                                                        T.StructField("non_striker", _S),
                                                        T.StructField("runs", _struct(batter=_D, extras=_D)),
                                                        T.StructField(
                                                            "extras",
                                                            _struct(wides=_D, noballs=_D, byes=_D, legbyes=_D, penalty=_D),
                                                        ),
                                                        T.StructField("wickets", T.ArrayType(_struct(kind=_S, player_out=_S))),
                                                    ]
                                                )
                                            ),
                                        )
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

PLAYER_MATCH = (
    "match_key", "match_id", "player_id", "date", "venue", "batting_team", "bowling_team", "runs", "balls",
    "fours", "sixes", "dismissed", "wickets", "balls_bowled", "runs_conceded", "total_balls_faced",
    "total_balls_bowled", "role",
)

PLAYER_FEATURES = (
    "match_id", "player_id", "team", "runs", "wickets", "form_runs", "form_wickets", "form_runs_ipl",
    "form_wickets_ipl", "days_since_prev_match", "is_franchise_match", "strike_rate", "economy",
    "venue_avg_runs", "venue_avg_wickets", "venue_strike_rate", "venue_economy", "venue_avg_runs_all",
    "venue_avg_wickets_all", "venue_strike_rate_all", "venue_economy_all", "batting_matchup_sr",
    "bowling_matchup_sr", "opponent_team", "opponent_past_batting_strength",
    "opponent_past_bowling_strength", "opponent_strength", "style_bat_aggressive", "style_bat_anchor",
    "style_bowl_economical", "style_bowl_expensive_wicket_taker",
)

OFFICIAL_RESULTS = _struct(match_id=_L, winner=_S, team1=_S, team2=_S)
SQUADS = _struct(team=_S, player_id=_S, is_overseas=_I)
FIXTURES = _struct(
    match_no=_I, date=T.DateType(), day_of_week=_S, start_time=_S, home_team=_S, away_team=_S, venue_city=_S
)
ALIASES = _struct(canonical_id=_S, alias_string=_S, source=_S, priority=_I)
REGISTRY = _struct(canonical_id=_S, primary_name=_S, notes=_S)
IDENTITY = _struct(team=_S, squad_player_name=_S, stats_player_id=_S, resolution_method=_S)
BRIDGE = _struct(franchise_key=_S, stats_player_id=_S, stats_player_id_norm=_S, squad_player_name=_S)
PROFILES = _struct(
    franchise=_S, bat_first_ratio=_D, chase_ratio=_D, pp_bat_ratio=_D, bowl_first_stingy=_D,
    bowl_second_stingy=_D, bat_dom=_D, bowl_dom=_D, field_dom=_D, n_innings_bat_1=_L, n_innings_bat_2=_L,
)
BOWLING_STYLE = _struct(player_id=_S, bowling_style=_S)
SCORECARDS = _struct(
    match=_S, innings=_S, team=_S, player=_S, runs=_S, balls=_S, fours=_S, sixes=_S, dismissal=_S
)
SCORECARD_MATCHES = _struct(
    match_no=_I, stage=_S, group=_S, date=T.DateType(), venue=_S, city=_S, team1=_S, team2=_S,
    toss_winner=_S, toss_decision=_S, winner=_S, result=_S, margin=_S,
)

PREDICTION_RECORD = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("match_key", _S), ("match_date", _S), ("venue", _S), ("team1_name", _S), ("team2_name", _S),
            ("team1_bats_first", T.BooleanType()), ("pred_winner", _S), ("pred_p_team1_win", _D),
            ("pred_best_bat", _S), ("pred_best_bowl", _S), ("pred_top5_bats", T.ArrayType(_S)),
            ("pred_top3_bowls", T.ArrayType(_S)), ("pred_potm", _S), ("pred_extra", _S),
        )
    ]
)
RESULT_RECORD = _struct(
    match_key=_S, actual_winner=_S, actual_top_scorer=_S, actual_top_scorer_runs=_D,
    actual_top_wicket_bowler=_S, actual_top_wickets=_D, official_potm=_S, bbb_match_file=_S, post_notes=_S,
    actual_first_innings_team_runs=_D, actual_second_innings_team_runs=_D,
)
REVIEW_RECORD = _struct(match_key=_S, process3_notes=_S)
PAYLOAD = T.StructType(
    [
        T.StructField(n, _S)
        for n in (
            "match_id", "team1_name", "team2_name", "xi1", "xi2", "playing_xi_team1", "playing_xi_team2",
            "batting_first", "pitch_text", "pitch_report", "toss_winner", "elected_to", "venue", "notes",
            "match_date",
        )
    ]
)
