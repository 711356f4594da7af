"""Dismissal texts, toss and batting order, scores and confidence bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creaseline.functions.text import lookup_key, squeeze

# Texts of a match without a result.
NO_RESULT = ("no result", "nr", "abandoned", "match abandoned")

# Run and wicket weights of the player-of-match score by upper bound of the role code.
POTM_WEIGHTS = ((0.75, 1.1, 18.0), (1.25, 1.0, 25.0), (float("inf"), 0.45, 28.0))
POTM_RUNS_BONUS, POTM_WICKETS_BONUS = (50.0, 10.0), (3.0, 15.0)


def bowler_of_dismissal(text: Column) -> Column:
    """Bowler after the last ``b``; Unknown for not out, run out, retired or no bowler."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    none = (t == "") | (low == "not out") | low.contains("run out") | low.contains("retired")
    at_end = F.regexp_extract_all(t, F.lit(r"(?i)\bb\s+([^,|]+?)(?:\s*$)"), F.lit(1))
    anywhere = F.regexp_extract_all(t, F.lit(r"(?i)\bb\s+([^,|]+)"), F.lit(1))
    found = F.coalesce(
        F.when(F.size(at_end) > 0, F.element_at(at_end, -1)), F.when(F.size(anywhere) > 0, F.element_at(anywhere, -1))
    )
    return F.when(none, "Unknown").otherwise(F.coalesce(F.trim(found), F.lit("Unknown")))


def dismissal_kind_of(text: Column, last_ball: Column) -> Column:
    """Kind on the last ball of an innings line: run out or caught; blank on every other ball."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    return F.when(~last_ball | (t == "") | (low == "not out"), "").when(low.contains("run out"), "run out").otherwise("caught")


def dismissed_flag(text: Column) -> Column:
    return F.when(F.lower(F.coalesce(text, F.lit(""))).contains("not out"), 0.0).otherwise(1.0)


def batting_first_of_toss(toss_winner: Column, elected: Column, team1: Column, team2: Column) -> Column:
    """team1 / team2 by the toss; null when the winner's text fits neither or both teams."""
    w, e = lookup_key(toss_winner), lookup_key(elected)

    def fits(team: Column) -> Column:
        name = lookup_key(team)
        return (w == name) | name.contains(w)

    is1, is2 = F.coalesce(fits(team1), F.lit(False)), F.coalesce(fits(team2), F.lit(False))
    bats = F.coalesce(e.isin("bat", "batting"), F.lit(False))
    return (
        F.when(is1 & ~is2, F.when(bats, "team1").otherwise("team2"))
        .when(is2 & ~is1, F.when(bats, "team2").otherwise("team1"))
    )


def batting_first_of_text(text: Column) -> Column:
    key = lookup_key(text)
    return F.when(key.isin("team1", "t1", "1"), "team1").when(key.isin("team2", "t2", "2"), "team2")


def resolved_batting_first(toss_winner: Column, elected: Column, team1: Column, team2: Column, given: Column) -> Column:
    """The toss beats the given order when it can be read."""
    return F.coalesce(batting_first_of_toss(toss_winner, elected, team1, team2), batting_first_of_text(given))


def potm_score(runs: Column, wickets: Column, role_code: Column) -> Column:
    """Composite player-of-match score by role, with bonuses for more than 50 runs and for 3 wickets."""
    code = F.coalesce(role_code.cast("double"), F.lit(2.0))
    low, mixed, high = POTM_WEIGHTS
    run_weight = F.when(code < low[0], low[1]).when(code > mixed[0], high[1]).otherwise(mixed[1])
    wicket_weight = F.when(code < low[0], low[2]).when(code > mixed[0], high[2]).otherwise(mixed[2])
    bonus = F.when(runs > POTM_RUNS_BONUS[0], POTM_RUNS_BONUS[1]).otherwise(0.0) + F.when(
        wickets >= POTM_WICKETS_BONUS[0], POTM_WICKETS_BONUS[1]
    ).otherwise(0.0)
    return runs * run_weight + wickets * wicket_weight + bonus


def impact_score(runs: Column, wickets: Column, role_code: Column) -> Column:
    """Runs plus 25 per wicket; a bowler gets 18 more per wicket."""
    return runs + wickets * 25.0 + F.when(role_code == 1, wickets * 18.0).otherwise(F.lit(0.0))


def confidence_band(favourite: Column) -> Column:
    return F.when(favourite > 0.65, "HIGH").when(favourite >= 0.55, "MEDIUM").otherwise("LOW")


def is_no_result(text: Column) -> Column:
    return squeeze(text).isin(*NO_RESULT)
