"""Franchise names, stadium names and play-style scores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from creaseline.functions.text import clip, lookup_key

# Lower-case franchise spelling to canonical name.
CANONICAL_FRANCHISES = {
    "chennai super kings": "Chennai Super Kings",
    "csk": "Chennai Super Kings",
    "delhi capitals": "Delhi Capitals",
    "dc": "Delhi Capitals",
    "gujarat titans": "Gujarat Titans",
    "gt": "Gujarat Titans",
    "kolkata knight riders": "Kolkata Knight Riders",
    "kkr": "Kolkata Knight Riders",
    "lucknow super giants": "Lucknow Super Giants",
    "lsg": "Lucknow Super Giants",
    "mumbai indians": "Mumbai Indians",
    "mi": "Mumbai Indians",
    "punjab kings": "Punjab Kings",
    "pbks": "Punjab Kings",
    "kings xi punjab": "Punjab Kings",
    "rajasthan royals": "Rajasthan Royals",
    "rr": "Rajasthan Royals",
    "royal challengers bangalore": "Royal Challengers Bangalore",
    "royal challengers bengaluru": "Royal Challengers Bangalore",
    "rcb": "Royal Challengers Bangalore",
    "sunrisers hyderabad": "Sunrisers Hyderabad",
    "srh": "Sunrisers Hyderabad",
}

# Schedule city to stadium name.
CITY_STADIUMS = {
    "Bengaluru": "M Chinnaswamy Stadium, Bengaluru",
    "Mumbai": "Wankhede Stadium, Mumbai",
    "Chennai": "M. A. Chidambaram Stadium, Chennai",
    "Kolkata": "Eden Gardens, Kolkata",
    "Delhi": "Arun Jaitley Stadium, Delhi",
    "Ahmedabad": "Narendra Modi Stadium, Ahmedabad",
    "Hyderabad": "Rajiv Gandhi International Stadium, Hyderabad",
    "Jaipur": "Sawai Mansingh Stadium, Jaipur",
    "Lucknow": "BRSABV Ekana Cricket Stadium, Lucknow",
    "Guwahati": "Barsapara Cricket Stadium, Guwahati",
    "New Chandigarh": "Maharaja Yadavindra Singh International Cricket Stadium, Mullanpur",
    "Raipur": "Shaheed Veer Narayan Singh International Stadium, Raipur",
    "Dharamshala": "Himachal Pradesh Cricket Association Stadium, Dharamshala",
}


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def canonical_franchise(name: Column | str) -> Column:
    """Canonical franchise name; an unknown name is returned trimmed."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(_literal_map(CANONICAL_FRANCHISES), lookup_key(c)), F.trim(c))


def same_franchise(a: Column, b: Column) -> Column:
    """Equal ignoring case, or the same franchise before and after its renaming."""
    renamed = F.array(F.lit("kings xi punjab"), F.lit("punjab kings"))
    ka, kb = lookup_key(a), lookup_key(b)
    return (ka == kb) | (F.array_contains(renamed, ka) & F.array_contains(renamed, kb))


def stadium_of_city(city: Column | str) -> Column:
    c = F.trim(F.coalesce(F.col(city) if isinstance(city, str) else city, F.lit("")))
    return F.coalesce(F.try_element_at(_literal_map(CITY_STADIUMS), c), c)


def is_league_row(competition: Column) -> Column:
    """League rows: labelled IPL, named Indian Premier, or without any label."""
    c = F.coalesce(competition, F.lit(""))
    return (F.upper(F.trim(c)) == "IPL") | F.lower(c).contains("indian premier") | (c == "")


def competition_label(name: Column) -> Column:
    """IPL for any spelling of the league, else the first 64 characters."""
    c = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(c)
    return F.when(low.contains("ipl") | low.contains("indian premier"), "IPL").otherwise(F.substring(c, 1, 64))


def play_style_scores() -> dict[str, Column]:
    """Four clipped scores from strike rate, economy and form; zero where the role does not apply."""
    sr = F.coalesce(F.col("strike_rate"), F.lit(120.0))
    er = F.coalesce(F.col("economy"), F.lit(8.5))
    fr = F.coalesce(F.col("form_runs"), F.lit(0.0))
    fw = F.coalesce(F.col("form_wickets"), F.lit(0.0))
    role = lookup_key("role")
    bats, bowls = role.isin("batter", "allrounder"), role.isin("bowler", "allrounder")
    zero = F.lit(0.0)
    return {
        "style_bat_aggressive": F.when(bats, clip((sr - 126.0) / 38.0, -1.2, 1.4)).otherwise(zero),
        "style_bat_anchor": F.when(
            bats, clip((F.lit(122.0) - sr) / 28.0, 0.0, 1.3) * clip(fr / 32.0, 0.15, 1.0)
        ).otherwise(zero),
        "style_bowl_economical": F.when(bowls, clip((F.lit(8.25) - er) / 2.8, -0.8, 1.4)).otherwise(zero),
        "style_bowl_expensive_wicket_taker": F.when(
            bowls, clip((er - 8.1) / 2.9, 0.0, 1.5) * clip(fw / 2.2, 0.0, 1.1)
        ).otherwise(zero),
    }


def role_code(role: Column) -> Column:
    return F.when(lookup_key(role) == "batter", 0).when(lookup_key(role) == "bowler", 1).otherwise(2)


def known_role(role: Column) -> Column:
    key = lookup_key(role)
    return F.when(key.isin("batter", "bowler", "allrounder"), key).otherwise("allrounder")
