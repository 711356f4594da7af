"""Pitch reports, venues and bowling styles as column expressions.

Reports, venues and player ids repeat across fixtures: apply these functions to distinct texts and join
the result back, see ``creaseline.operators.distinct.on_distinct``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creaseline.functions.text import any_contains, clip

# Words that speak for batting, for bowling, and for the chase.
BATTING_WORDS = (
    "batting", "runs", "high scoring", "high-scoring", "short boundaries", "boundary", "flat",
    "good for batting", "bat first", "score", "muscle", "belter", "sixes", "fours",
)
BOWLING_WORDS = (
    "bowling", "bowlers", "turn", "grip", "difficult to bat", "two-paced", "two paced", "seam", "movement",
)
CHASE_WORDS = ("chase", "dew", "second innings", "second-innings", "prefer to chase", "chasing")

# A report is high-par when, for some entry, every group has a word in it.
HIGH_PAR_RULES = (
    (("belter",),),
    (("199",), ("average",)),
    (("216",), ("average",)),
    (("190",), ("average",), ("score",)),
    (("200-run", "200 run ground"),),
    (("200 run",), ("ground",)),
    (("more than 200",),),
    (("ballpark",), ("200", "199")),
    (("batting paradise", "batters paradise"),),
    (("bat dominating", "batting dominating"),),
    (("250",), ("average", "par ", "score")),
    (("250",), ("galore", "runs galore", "very high scoring")),
    (("high scoring",), ("chase", "run chase")),
    (("runs on the board",), ("average", "216", "200")),
)

# Lift of the run targets, added when every group has a word in the report.
PAR_LIFTS = (
    (0.20, (("belter",),)),
    (0.24, (("199",), ("average",))),
    (0.22, (("198",), ("average",))),
    (0.26, (("216",), ("average",))),
    (0.16, (("200",),)),
    (0.10, (("200-run", "200 run ground"),)),
    (0.12, (("more than 200",),)),
    (0.14, (("250",), ("average", "par"))),
    (0.16, (("250",), ("galore", "runs galore"))),
    (0.06, (("small ground",), ("high scoring", "batting"))),
    (0.08, (("bat dominating", "batting dominating"),)),
    (0.06, (("fours",), ("sixes",))),
    (0.06, (("ballpark",),)),
    (0.05, (("economy",), ("10.", "10.2", " 10"))),
)
MAX_RUN_MULT, MAX_VENUE_RUN_MULT = 1.85, 1.88

# Run nudge of a venue whose name holds one of the words.
VENUE_NUDGES = (
    (1.028, ("ahmedabad", "narendra modi", "motera")),
    (1.032, ("jaitley", "arun jaitley")),
)

# How hard a ground is on spin, by part of its name.
VENUE_HARSHNESS = (
    ("chinnaswamy", 0.92), ("bengaluru", 0.88), ("bangalore", 0.88), ("wankhede", 0.78), ("brabourne", 0.72),
    ("dy patil", 0.70), ("mumbai", 0.65), ("eden gardens", 0.55), ("eden", 0.50), ("kolkata", 0.50),
    ("barsapara", 0.48), ("guwahati", 0.45), ("punjab cricket", 0.58), ("mohali", 0.55), ("mullanpur", 0.55),
    ("yadavindra", 0.55), ("new chandigarh", 0.55), ("dharamsala", 0.42), ("hpca", 0.42),
    ("narendra modi", 0.40), ("ahmedabad", 0.40), ("rajiv gandhi", 0.35), ("hyderabad", 0.38),
    ("chepauk", 0.12), ("chennai", 0.15), ("ma chidambaram", 0.12), ("sawai mansingh", 0.48), ("jaipur", 0.48),
)
SPIN_LOSS, PACE_GAIN = 0.24, 0.07
STYLE_MULT_LOW, STYLE_MULT_HIGH = 0.35, 1.35

# Parts of player ids that tell spin from pace; spin is tested first.
SPIN_MARKERS = (
    "rashid khan", "kuldeep yadav", "adam zampa", "ravi bishnoi", "varun chakaravarthy", "krunal pandya",
    "axar patel", "washington sundar", "ravindra jadeja", "suyash sharma", "shreyas gopal", "rahul chahar",
    "ys chahal", "mitchell santner", "akeal hosein", "maheesh theekshana", "sunil narine",
    "mujeeb ur rahman", "noor ahmad", "adil rashid", "tabraiz shamsi", "ashton agar", "fabian allen",
    "rahul tewatia", "shahbaz ahmed", "abhishek sharma", "anukul roy", "vipraj nigam", "mayank markande",
    "karn sharma", "piyush chawla", "amit mishra", "murugan ashwin", "r ashwin",
    "chahal", "zampa", "bishnoi", "chakaravarthy",
)
PACE_MARKERS = (
    "bumrah", "mohammed shami", "shami", "siraj", "nortje", "rabada", "ferguson", "milne", "boult", "southee",
    "carse", "jansen", "coetzee", "wood", "topley", "willey", "jordan", "archer", "arshdeep", "avesh khan",
    "khaleel ahmed", "prasidh krishna", "harshal patel", "deepak chahar", "mukesh kumar", "yash dayal",
    "dwarshuis", "behrendorff", "ellis", "hazlewood", "cummins", "starc", "jaydev unadkat",
    "bhuvneshwar kumar", "t natarajan", "natarajan", "umran malik", "lockie ferguson", "alzarri joseph",
    "lungi ngidi", "marco jansen", "andre russell", "sam curran", "tom curran", "hardik pandya", "vyshak",
    "vijaykumar", "yash thakur", "kulwant khejroliya", "akash singh", "kamlesh nagarkoti",
    "shardul thakur", "nathan ellis", "gus atkinson", "matheesha pathirana", "pathirana",
    "dushmantha chameera", "maheesh pathirana", "jacob duffy", "romario shepherd", "david payne",
    "harshal", "prasidh", "abhinandan singh", "eshan malinga",
)


def _rule(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    held = F.lit(True)
    for words in groups:
        held = held & any_contains(text, words)
    return held


def is_high_par(report: Column) -> Column:
    text = F.lower(report)
    found = F.lit(False)
    for groups in HIGH_PAR_RULES:
        found = found | _rule(text, groups)
    return found


def par_lift(report: Column) -> Column:
    text = F.lower(report)
    lift = F.lit(1.0)
    for value, groups in PAR_LIFTS:
        lift = lift + F.when(_rule(text, groups), F.lit(value)).otherwise(F.lit(0.0))
    return F.least(lift, F.lit(MAX_RUN_MULT))


def _per_word(text: Column, words: tuple[str, ...], weight: float) -> Column:
    total = F.lit(0.0)
    for w in words:
        total = total + F.when(text.contains(w), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def pitch_multipliers(report: Column) -> dict[str, Column]:
    """Run and wicket multipliers of both innings from one report."""
    text = F.lower(report)
    high = is_high_par(report)
    zero = F.lit(0.0)
    score = _per_word(text, BATTING_WORDS, 0.15)
    score = score - F.when(
        text.contains("grass") & ~text.contains("runs") & ~text.contains("batting"), F.lit(0.05)
    ).otherwise(zero)
    bare = F.when(high, F.lit(0.04)).otherwise(F.lit(0.08))
    score = score - F.when(text.contains("bare patch"), bare).otherwise(zero)
    score = score - F.when(high, zero).otherwise(_per_word(text, BOWLING_WORDS, 0.12))
    score = clip(score, -1.0, 1.0)
    lift = par_lift(report)
    runs = F.least((score * 0.07 + 1.0) * lift, F.lit(MAX_RUN_MULT))
    wickets = F.greatest(F.lit(1.0) - score * 0.05 - F.greatest(lift - 1.0, zero) * 0.03, F.lit(0.82))
    chase = F.least(_per_word(text, CHASE_WORDS, 0.012), F.when(high, F.lit(0.06)).otherwise(F.lit(0.04)))
    return {
        "first_innings_runs": runs,
        "second_innings_runs": F.least(runs * (chase + 1.0), F.lit(MAX_VENUE_RUN_MULT)),
        "first_innings_wickets": wickets,
        "second_innings_wickets": wickets * (F.lit(1.0) - chase * 0.5),
    }


MULTIPLIERS = ("first_innings_runs", "second_innings_runs", "first_innings_wickets", "second_innings_wickets")


def venue_run_nudge(venue: Column) -> Column:
    name = F.lower(F.coalesce(venue, F.lit("")))
    nudge = F.lit(1.0)
    for value, words in reversed(VENUE_NUDGES):
        nudge = F.when(any_contains(name, words), F.lit(value)).otherwise(nudge)
    return nudge


def resolve_multipliers(report: Column, venue: Column, override: dict[str, Column] | None = None) -> dict[str, Column]:
    """Multipliers of a fixture: explicit values win, else the report (neutral without one) times the venue nudge."""
    has_text = F.trim(F.coalesce(report, F.lit(""))) != ""
    parsed = pitch_multipliers(F.coalesce(report, F.lit("")))
    nudge = venue_run_nudge(venue)
    out = {}
    for name in MULTIPLIERS:
        value = F.when(has_text, parsed[name]).otherwise(F.lit(1.0))
        if name.endswith("runs"):
            value = F.when(nudge > 1.0, F.least(value * nudge, F.lit(MAX_VENUE_RUN_MULT))).otherwise(value)
        out[name] = F.coalesce(override[name], value) if override else value
    return out


def venue_spin_harshness(venue: Column) -> Column:
    """Highest weight among the name parts found, between 0 and 1."""
    name = F.lower(F.coalesce(venue, F.lit("")))
    hits = [F.when(name.contains(part), F.lit(weight)).otherwise(F.lit(0.0)) for part, weight in VENUE_HARSHNESS]
    return clip(F.greatest(*hits), 0.0, 1.0)


def bowling_style(player_id: Column, override: Column | None = None) -> Column:
    """spin / pace / unknown: a valid override first, then spin markers, then pace markers."""
    name = F.lower(F.trim(player_id))
    spin = any_contains(name, SPIN_MARKERS) | name.endswith(" ashwin") | (name.endswith(" chahar") & name.contains("rahul"))
    guess = F.when(spin, "spin").when(any_contains(name, PACE_MARKERS), "pace").otherwise("unknown")
    if override is None:
        return guess
    given = F.lower(F.trim(override))
    return F.coalesce(F.when(given.isin("spin", "pace", "unknown"), given), guess)


def style_wicket_multiplier(style: Column, harshness: Column) -> Column:
    raw = (
        F.when(style == "spin", F.lit(1.0) - harshness * SPIN_LOSS)
        .when(style == "pace", harshness * PACE_GAIN + 1.0)
        .otherwise(F.lit(1.0))
    )
    return F.when(harshness <= 0, F.lit(1.0)).otherwise(clip(raw, STYLE_MULT_LOW, STYLE_MULT_HIGH))
