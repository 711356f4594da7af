"""Shared table expressions of the comparison SQL, assembled on demand into one WITH clause."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "deliveries": """
SELECT match_id, date, venue, competition,
       CASE WHEN innings = 1 THEN t1 ELSE t2 END AS batting_team,
       CASE WHEN innings = 1 THEN t2 ELSE t1 END AS bowling_team,
       concat(CASE WHEN innings = 1 THEN t1 ELSE t2 END, '_', CAST(l_suppkey % 15 AS VARCHAR)) AS batter,
       concat(CASE WHEN innings = 1 THEN t2 ELSE t1 END, '_', CAST(l_partkey % 15 AS VARCHAR)) AS bowler,
       concat(CASE WHEN innings = 1 THEN t1 ELSE t2 END, '_', CAST((l_suppkey + 1) % 15 AS VARCHAR)) AS non_striker,
       CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE) AS runs_off_bat,
       CASE WHEN is_wide = 1 OR is_noball = 1 OR (l_linenumber = 5 AND l_returnflag = 'N')
            THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS extras,
       is_wide, is_noball,
       CASE WHEN l_discount < 0.005 AND l_linestatus = 'F' THEN
            CASE CAST(round(l_tax * 100) AS INTEGER) % 4
                 WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'run out' ELSE 'lbw' END
            ELSE '' END AS dismissal_kind,
       CASE WHEN l_discount < 0.005 AND l_linestatus = 'F'
            THEN concat(CASE WHEN innings = 1 THEN t1 ELSE t2 END, '_', CAST(l_suppkey % 15 AS VARCHAR))
            ELSE '' END AS player_dismissed,
       innings, over, ball_in_over
FROM (
  SELECT l.*,
         make_date(CAST(1995 + (match_id // 84) % 30 AS INTEGER), CAST(1 + (match_id // 7) % 12 AS INTEGER),
                   CAST(1 + match_id * 4 % 28 AS INTEGER)) AS date,
         concat('V', CAST(match_id % 7 AS VARCHAR)) AS venue,
         CASE WHEN match_id % 5 = 0 THEN 'OTHER' ELSE 'IPL' END AS competition,
         concat('T', CAST(match_id % 10 AS VARCHAR)) AS t1,
         concat('T', CAST((match_id % 10 + 1 + (match_id // 10) % 9) % 10 AS VARCHAR)) AS t2,
         CAST(1 + l_orderkey % 2 AS INTEGER) AS innings,
         CAST((l_orderkey % 25) * 4 // 5 AS INTEGER) AS over,
         l_linenumber AS ball_in_over,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 1 ELSE 0 END AS is_wide,
         CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 1 ELSE 0 END AS is_noball
  FROM (SELECT *, l_orderkey // 25 AS match_id FROM lineitem) l
) m""",
    "ind": """
SELECT *,
       CASE WHEN is_wide = 0 THEN 1 ELSE 0 END AS ball_faced,
       CASE WHEN runs_off_bat = 4 THEN 1 ELSE 0 END AS is_four,
       CASE WHEN runs_off_bat = 6 THEN 1 ELSE 0 END AS is_six,
       CASE WHEN player_dismissed = batter THEN 1 ELSE 0 END AS batter_out,
       CASE WHEN is_wide = 0 AND is_noball = 0 THEN 1 ELSE 0 END AS ball_bowled,
       CASE WHEN dismissal_kind <> '' AND lower(dismissal_kind) NOT IN ('run out', 'retired hurt', 'obstructing the field')
            THEN 1 ELSE 0 END AS wicket_credit,
       runs_off_bat + extras AS conceded
FROM deliveries""",
    "bat": """
SELECT batter AS player_id, match_id, sum(runs_off_bat) AS runs, CAST(sum(ball_faced) AS BIGINT) AS balls,
       CAST(sum(is_four) AS BIGINT) AS fours, CAST(sum(is_six) AS BIGINT) AS sixes, max(batter_out) AS dismissed,
       min(batting_team) AS batting_team, min(venue) AS venue, min(date) AS date
FROM ind GROUP BY batter, match_id""",
    "bowl": """
SELECT bowler AS player_id, match_id, CAST(sum(wicket_credit) AS BIGINT) AS wickets,
       CAST(sum(ball_bowled) AS BIGINT) AS balls_bowled, sum(conceded) AS runs_conceded,
       min(bowling_team) AS bowling_team, min(venue) AS venue, min(date) AS date
FROM ind GROUP BY bowler, match_id""",
    "lines": """
SELECT coalesce(bat.player_id, bowl.player_id) AS player_id, coalesce(bat.match_id, bowl.match_id) AS match_id,
       coalesce(bat.date, bowl.date) AS date, coalesce(bat.venue, bowl.venue) AS venue,
       batting_team, bowling_team, coalesce(runs, 0) AS runs, coalesce(balls, 0) AS balls, coalesce(fours, 0) AS fours,
       coalesce(sixes, 0) AS sixes, coalesce(dismissed, 0) AS dismissed, coalesce(wickets, 0) AS wickets,
       coalesce(balls_bowled, 0) AS balls_bowled, coalesce(runs_conceded, 0) AS runs_conceded
FROM bat FULL JOIN bowl ON bat.player_id = bowl.player_id AND bat.match_id = bowl.match_id""",
    "pairs": """
SELECT match_id, min(batting_team) AS team_a, max(batting_team) AS team_b
FROM deliveries WHERE trim(batting_team) <> '' GROUP BY match_id HAVING count(DISTINCT batting_team) = 2""",
    "pms": """
SELECT concat(CAST(l.match_id AS VARCHAR), '_', strftime(date, '%Y-%m-%d')) AS match_key, l.match_id, player_id, date, venue,
       CASE WHEN coalesce(batting_team, bowling_team) = team_a THEN team_a
            WHEN coalesce(batting_team, bowling_team) = team_b THEN team_b ELSE 'unknown' END AS batting_team,
       CASE WHEN coalesce(batting_team, bowling_team) = team_a THEN team_b
            WHEN coalesce(batting_team, bowling_team) = team_b THEN team_a ELSE 'unknown' END AS bowling_team,
       runs, balls, fours, sixes, dismissed, wickets, balls_bowled, runs_conceded,
       balls AS total_balls_faced, balls_bowled AS total_balls_bowled,
       CASE WHEN balls > 2 * balls_bowled THEN 'batter' WHEN balls_bowled > 2 * balls THEN 'bowler'
            ELSE 'allrounder' END AS role
FROM lines l LEFT JOIN pairs p ON p.match_id = l.match_id""",
    "franchises": "SELECT DISTINCT batting_team AS team FROM deliveries WHERE batting_team NOT IN ('T8', 'T9')",
    "base": """
SELECT pms.*,
       CASE WHEN batting_team = '' OR batting_team = 'unknown' THEN bowling_team ELSE batting_team END AS team,
       CASE WHEN balls > 0 THEN runs / balls * 100.0 END AS match_sr,
       CASE WHEN balls_bowled > 0 THEN runs_conceded / (balls_bowled / 6.0) END AS match_econ,
       (batting_team IN (SELECT team FROM franchises) OR bowling_team IN (SELECT team FROM franchises)) AS is_franchise_match
FROM pms""",
    "fr_mean": """
SELECT *,
       CASE WHEN is_franchise_match THEN avg(runs) OVER f END AS fr_runs,
       CASE WHEN is_franchise_match THEN avg(wickets) OVER f END AS fr_wickets
FROM base
WINDOW f AS (PARTITION BY player_id, is_franchise_match ORDER BY date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "roll": """
SELECT * EXCLUDE (fr_runs, fr_wickets),
       coalesce(avg(runs) OVER p5, 0) AS form_runs, coalesce(avg(wickets) OVER p5, 0) AS form_wickets,
       coalesce(avg(match_sr) OVER p5, 0) AS strike_rate, coalesce(avg(match_econ) OVER p5, 0) AS economy,
       coalesce(last_value(fr_runs IGNORE NULLS) OVER pu, 0) AS form_runs_ipl,
       coalesce(last_value(fr_wickets IGNORE NULLS) OVER pu, 0) AS form_wickets_ipl,
       least(greatest(coalesce(CAST(date_diff('day', lag(date) OVER w, date) AS DOUBLE), 180.0), 0.0), 730.0) AS days_since_prev_match
FROM fr_mean
WINDOW w AS (PARTITION BY player_id ORDER BY date, match_id),
       p5 AS (PARTITION BY player_id ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
       pu AS (PARTITION BY player_id ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "venue_hist": """
SELECT roll.*,
       coalesce(sum(runs) OVER v, 0) AS venue_runs_sum, coalesce(sum(balls) OVER v, 0) AS venue_balls_sum,
       coalesce(sum(wickets) OVER v, 0) AS venue_wickets_sum, coalesce(sum(balls_bowled) OVER v, 0) AS venue_balls_bowled_sum,
       coalesce(sum(runs_conceded) OVER v, 0) AS venue_runs_conceded_sum,
       count(*) OVER v AS matches_at_venue
FROM roll
WINDOW v AS (PARTITION BY player_id, venue ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "venue_rates": """
SELECT *, matches_at_venue > 0 AS real_venue,
       CASE WHEN matches_at_venue > 0 THEN venue_runs_sum / matches_at_venue END AS own_venue_runs,
       CASE WHEN venue_balls_sum > 0 THEN venue_runs_sum / venue_balls_sum * 100.0 END AS own_venue_sr,
       CASE WHEN matches_at_venue > 0 THEN CAST(venue_wickets_sum AS DOUBLE) / matches_at_venue END AS own_venue_wk,
       CASE WHEN venue_balls_bowled_sum > 0 THEN venue_runs_conceded_sum / (venue_balls_bowled_sum / 6.0) END AS own_venue_econ
FROM venue_hist""",
    "venue_match": """
SELECT match_id, venue, date, sum(runs) AS sum_runs, CAST(sum(balls) AS BIGINT) AS sum_balls, CAST(sum(wickets) AS BIGINT) AS sum_wk,
       CAST(sum(balls_bowled) AS BIGINT) AS sum_bb, sum(runs_conceded) AS sum_rc, count(player_id) AS npl,
       CASE WHEN sum(balls) > 0 THEN sum(runs) / sum(balls) * 100.0 END AS match_sr,
       CASE WHEN sum(balls_bowled) > 0 THEN sum(runs_conceded) / (sum(balls_bowled) / 6.0) END AS match_econ,
       sum(runs) / count(player_id) AS avg_runs_per_player,
       CAST(sum(wickets) AS DOUBLE) / count(player_id) AS avg_wk_per_player
FROM base GROUP BY match_id, venue, date""",
    "venue_prior": """
SELECT match_id, venue,
       avg(avg_runs_per_player) OVER v AS venue_avg_runs_all, avg(avg_wk_per_player) OVER v AS venue_avg_wickets_all,
       avg(match_sr) OVER v AS venue_strike_rate_all, avg(match_econ) OVER v AS venue_economy_all
FROM venue_match
WINDOW v AS (PARTITION BY venue ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "globals": """
SELECT player_id, avg(runs) AS pglobal_avg_runs, avg(wickets) AS pglobal_avg_wk, avg(match_sr) AS pglobal_sr,
       avg(match_econ) AS pglobal_econ FROM base GROUP BY player_id""",
    "pair_match": """
SELECT p.*, d.date FROM (
  SELECT match_id, batter, bowler, sum(runs_off_bat) AS pruns, CAST(sum(ball_faced) AS BIGINT) AS pballs,
         CAST(sum(CASE WHEN player_dismissed = batter AND dismissal_kind <> '' THEN 1 ELSE 0 END) AS BIGINT) AS pdism
  FROM ind GROUP BY match_id, batter, bowler) p
LEFT JOIN (SELECT match_id, min(date) AS date FROM pms GROUP BY match_id) d ON d.match_id = p.match_id""",
    "pair_prior": """
SELECT *, CASE WHEN prev_balls > 0 THEN prev_runs / prev_balls * 100.0 END AS prior_sr FROM (
  SELECT *, coalesce(sum(pruns) OVER w, 0) AS prev_runs, CAST(coalesce(sum(pballs) OVER w, 0) AS DOUBLE) AS prev_balls,
         CAST(coalesce(sum(pdism) OVER w, 0) AS DOUBLE) AS prev_dismissals
  FROM pair_match
  WINDOW w AS (PARTITION BY batter, bowler ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q""",
    "mu_bat": """
SELECT match_id, batter AS player_id, sum(pballs * prior_sr) / sum(pballs) AS b_sr
FROM pair_prior WHERE pballs > 0 AND prior_sr IS NOT NULL GROUP BY match_id, batter""",
    "mu_bowl": """
SELECT match_id, bowler AS player_id, sum(pballs * prior_sr) / sum(pballs) AS w_sr
FROM pair_prior WHERE pballs > 0 AND prior_sr IS NOT NULL GROUP BY match_id, bowler""",
    "team_match": """
SELECT match_id, team, sum(CASE WHEN rr <= 5 THEN runs END) AS top5_runs,
       CAST(sum(CASE WHEN rw <= 5 THEN wickets END) AS DOUBLE) AS top5_wickets,
       sum(runs) AS sum_runs_all, CAST(sum(wickets) AS DOUBLE) AS sum_wickets_all, min(date) AS date
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY runs DESC, player_id) AS rr,
             row_number() OVER (PARTITION BY match_id, team ORDER BY wickets DESC, player_id) AS rw FROM base) x
GROUP BY match_id, team""",
    "team_past": """
SELECT *, avg(top5_runs) OVER p5 AS past_batting_strength, avg(top5_wickets) OVER p5 AS past_bowling_strength
FROM team_match
WINDOW p5 AS (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "blended": """
SELECT v.* EXCLUDE (own_venue_runs, own_venue_sr, own_venue_wk, own_venue_econ),
       vp.venue_avg_runs_all, vp.venue_avg_wickets_all, vp.venue_strike_rate_all, vp.venue_economy_all,
       g.pglobal_avg_runs, g.pglobal_avg_wk, g.pglobal_sr, g.pglobal_econ,
       coalesce(CASE WHEN NOT real_venue THEN 0.7 * pglobal_avg_runs + 0.3 * coalesce(venue_avg_runs_all, pglobal_avg_runs)
                ELSE own_venue_runs END, pglobal_avg_runs) AS venue_avg_runs,
       coalesce(CASE WHEN NOT real_venue THEN 0.7 * pglobal_avg_wk + 0.3 * coalesce(venue_avg_wickets_all, pglobal_avg_wk)
                ELSE own_venue_wk END, pglobal_avg_wk) AS venue_avg_wickets,
       coalesce(CASE WHEN NOT real_venue THEN 0.7 * pglobal_sr + 0.3 * coalesce(venue_strike_rate_all, pglobal_sr)
                ELSE own_venue_sr END, pglobal_sr) AS venue_strike_rate,
       coalesce(CASE WHEN NOT real_venue THEN 0.7 * pglobal_econ + 0.3 * coalesce(venue_economy_all, pglobal_econ)
                ELSE own_venue_econ END, pglobal_econ) AS venue_economy,
       NOT real_venue AS uses_venue_fallback,
       b.b_sr IS NOT NULL AS real_batting_matchup, w.w_sr IS NOT NULL AS real_bowling_matchup,
       coalesce(b.b_sr, pglobal_sr) AS batting_matchup_sr, coalesce(w.w_sr, pglobal_sr) AS bowling_matchup_sr
FROM venue_rates v
LEFT JOIN venue_prior vp ON vp.match_id = v.match_id
LEFT JOIN globals g ON g.player_id = v.player_id
LEFT JOIN mu_bat b ON b.match_id = v.match_id AND b.player_id = v.player_id
LEFT JOIN mu_bowl w ON w.match_id = v.match_id AND w.player_id = v.player_id""",
    "opp0": """
SELECT b.*, b.bowling_team AS opponent_team, t.past_batting_strength AS ob, t.past_bowling_strength AS ow,
       CASE role WHEN 'batter' THEN t.past_bowling_strength WHEN 'bowler' THEN t.past_batting_strength
            ELSE (t.past_bowling_strength + t.past_batting_strength) / 2.0 END AS os
FROM blended b LEFT JOIN team_past t ON t.match_id = b.match_id AND t.team = b.bowling_team""",
    "feat": """
SELECT * EXCLUDE (ob, ow, os, is_franchise_match), CAST(is_franchise_match AS INTEGER) AS is_franchise_match,
       coalesce(ob, avg(ob) OVER ()) AS opponent_past_batting_strength,
       coalesce(ow, avg(ow) OVER ()) AS opponent_past_bowling_strength,
       coalesce(os, avg(os) OVER ()) AS opponent_strength,
       CASE WHEN role IN ('batter', 'allrounder') THEN greatest(least((strike_rate - 126.0) / 38.0, 1.4), -1.2) ELSE 0.0 END AS style_bat_aggressive,
       CASE WHEN role IN ('batter', 'allrounder') THEN greatest(least((122.0 - strike_rate) / 28.0, 1.3), 0.0)
            * greatest(least(form_runs / 32.0, 1.0), 0.15) ELSE 0.0 END AS style_bat_anchor,
       CASE WHEN role IN ('bowler', 'allrounder') THEN greatest(least((8.25 - economy) / 2.8, 1.4), -0.8) ELSE 0.0 END AS style_bowl_economical,
       CASE WHEN role IN ('bowler', 'allrounder') THEN greatest(least((economy - 8.1) / 2.9, 1.5), 0.0)
            * greatest(least(form_wickets / 2.2, 1.1), 0.0) ELSE 0.0 END AS style_bowl_expensive_wicket_taker
FROM opp0""",
    "inn": """
SELECT match_id, innings, batting_team, bowling_team, sum(runs_off_bat + extras) AS runs,
       sum(CASE WHEN over >= 0 AND over < 6 THEN runs_off_bat + extras ELSE 0 END) AS pp_runs,
       CAST(sum(CASE WHEN player_dismissed = batter AND wicket_credit = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wickets,
       CAST(sum(CASE WHEN lower(dismissal_kind) LIKE '%run out%' THEN 1 ELSE 0 END) AS BIGINT) AS run_outs, min(competition) AS competition
FROM ind WHERE innings > 0 GROUP BY match_id, innings, batting_team, bowling_team""",
    "linn": "SELECT * FROM inn WHERE upper(trim(competition)) = 'IPL' OR lower(competition) LIKE '%indian premier%' OR competition = ''",
    "league": """
SELECT greatest(avg(CASE WHEN innings = 1 THEN runs END), 1.0) AS league_1,
       greatest(avg(CASE WHEN innings = 2 THEN runs END), 1.0) AS league_2, greatest(avg(pp_runs), 1.0) AS league_pp FROM linn""",
    "team_means": """
SELECT team, avg(CASE WHEN s = 'bat' AND innings = 1 THEN runs END) AS mean_runs_bf,
       avg(CASE WHEN s = 'bat' AND innings = 2 THEN runs END) AS mean_runs_chase,
       avg(CASE WHEN s = 'bat' THEN pp_runs END) AS mean_pp_bat,
       avg(CASE WHEN s = 'bowl' AND innings = 1 THEN runs END) AS mean_conceded_bf,
       avg(CASE WHEN s = 'bowl' AND innings = 2 THEN runs END) AS mean_conceded_chase,
       avg(CASE WHEN s = 'bowl' AND innings = 1 THEN wickets END) AS wk_1, avg(CASE WHEN s = 'bowl' AND innings = 2 THEN wickets END) AS wk_2,
       avg(CASE WHEN s = 'bowl' AND innings = 1 THEN run_outs END) AS ro_1, avg(CASE WHEN s = 'bowl' AND innings = 2 THEN run_outs END) AS ro_2,
       count(CASE WHEN s = 'bat' AND innings = 1 THEN runs END) AS n_innings_bat_1,
       count(CASE WHEN s = 'bat' AND innings = 2 THEN runs END) AS n_innings_bat_2
FROM (SELECT *, batting_team AS team, 'bat' AS s FROM linn UNION ALL SELECT *, bowling_team AS team, 'bowl' AS s FROM linn) x
GROUP BY team""",
    "team_ratio": """
SELECT team,
       greatest(least(coalesce(mean_runs_bf / league_1, 1.0), 1.45), 0.65) AS bat_first_ratio,
       greatest(least(coalesce(mean_runs_chase / league_2, 1.0), 1.45), 0.65) AS chase_ratio,
       greatest(least(coalesce(mean_pp_bat / league_pp, 1.0), 1.45), 0.65) AS pp_bat_ratio,
       greatest(least(coalesce(CASE WHEN mean_conceded_bf > 0 THEN league_1 / mean_conceded_bf END, 1.0), 1.45), 0.65) AS bowl_first_stingy,
       greatest(least(coalesce(CASE WHEN mean_conceded_chase > 0 THEN league_2 / mean_conceded_chase END, 1.0), 1.45), 0.65) AS bowl_second_stingy,
       (mean_runs_bf + mean_runs_chase) / 2.0 AS bat_raw,
       (wk_1 + wk_2) / 2.0 + 0.35 * (ro_1 + ro_2) / 2.0 AS bowl_raw,
       (wk_1 + wk_2) / 2.0 + 0.25 * (ro_1 + ro_2) / 2.0 AS field_raw,
       n_innings_bat_1, n_innings_bat_2
FROM team_means, league""",
    "team_dom": """
SELECT * EXCLUDE (b, w, f),
       CASE WHEN stddev_samp(b) OVER () < 1e-9 THEN 0.0 ELSE coalesce((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 0.0) END AS bat_dom,
       CASE WHEN stddev_samp(w) OVER () < 1e-9 THEN 0.0 ELSE coalesce((w - avg(w) OVER ()) / stddev_samp(w) OVER (), 0.0) END AS bowl_dom,
       CASE WHEN stddev_samp(f) OVER () < 1e-9 THEN 0.0 ELSE coalesce((f - avg(f) OVER ()) / stddev_samp(f) OVER (), 0.0) END AS field_dom
FROM (SELECT *, coalesce(bat_raw, median(bat_raw) OVER ()) AS b, coalesce(bowl_raw, median(bowl_raw) OVER ()) AS w,
             coalesce(field_raw, median(field_raw) OVER ()) AS f FROM team_ratio) x""",
    "prof": """
SELECT team AS franchise, bat_first_ratio, chase_ratio, pp_bat_ratio, bowl_first_stingy, bowl_second_stingy,
       bat_dom, bowl_dom, field_dom, n_innings_bat_1, n_innings_bat_2 FROM team_dom""",
    "totals": "SELECT match_id, team, sum(coalesce(runs, 0)) AS team_total_runs FROM feat GROUP BY match_id, team",
    "proxy": """
SELECT a.match_id, a.team AS team1_name, b.team AS team2_name, a.team_total_runs AS r1, b.team_total_runs AS r2,
       CASE WHEN a.team_total_runs > b.team_total_runs THEN 'team1' WHEN b.team_total_runs > a.team_total_runs THEN 'team2' ELSE 'tie' END AS winner
FROM totals a JOIN totals b ON a.match_id = b.match_id AND a.team < b.team
WHERE a.match_id IN (SELECT match_id FROM totals GROUP BY match_id HAVING count(*) = 2)""",
    "official": """
SELECT match_id, CASE WHEN match_id % 11 = 0 THEN '' WHEN i1 >= i2 THEN tm1 ELSE tm2 END AS winner FROM (
  SELECT match_id, min(CASE WHEN innings = 1 THEN batting_team END) AS tm1, min(CASE WHEN innings = 2 THEN batting_team END) AS tm2,
         coalesce(sum(CASE WHEN innings = 1 THEN runs_off_bat + extras END), 0) AS i1,
         coalesce(sum(CASE WHEN innings = 2 THEN runs_off_bat + extras END), 0) AS i2
  FROM deliveries GROUP BY match_id) x WHERE match_id % 3 <> 0""",
    "agg": """
SELECT match_id, team, avg(form_runs) AS team_avg_form_runs, avg(form_wickets) AS team_avg_form_wickets,
       avg(strike_rate) AS team_avg_strike_rate, avg(economy) AS team_avg_economy, count(player_id) AS team_n_players,
       avg(form_runs_ipl) AS team_avg_form_runs_ipl, avg(form_wickets_ipl) AS team_avg_form_wickets_ipl,
       0.4 * avg(form_runs_ipl) + 0.3 * avg(strike_rate) + 0.3 * avg(form_wickets_ipl) AS team_strength_score
FROM feat GROUP BY match_id, team""",
    "labelled": """
SELECT a.match_id, a.team AS team1_name, b.team AS team2_name, a.team_strength_score AS team1_strength, b.team_strength_score AS team2_strength,
       a.team_avg_form_runs AS team1_form_runs, b.team_avg_form_runs AS team2_form_runs,
       a.team_avg_form_runs_ipl AS team1_form_runs_ipl, b.team_avg_form_runs_ipl AS team2_form_runs_ipl,
       a.team_avg_strike_rate AS team1_strike_rate, b.team_avg_strike_rate AS team2_strike_rate,
       a.team_avg_economy AS team1_economy, b.team_avg_economy AS team2_economy,
       p.r1 AS team1_total_runs, p.r2 AS team2_total_runs, mm.venue, mm.match_date,
       CASE WHEN o.match_id IS NOT NULL AND o.winner = '' THEN 'tie' WHEN o.winner = a.team THEN 'team1' WHEN o.winner = b.team THEN 'team2'
            ELSE p.winner END AS winner,
       CASE WHEN o.match_id IS NOT NULL AND (o.winner = '' OR o.winner IN (a.team, b.team)) THEN 'official'
            WHEN p.winner IS NOT NULL THEN 'proxy' ELSE 'missing' END AS winner_source
FROM agg a JOIN agg b ON a.match_id = b.match_id AND a.team < b.team
LEFT JOIN official o ON o.match_id = a.match_id
LEFT JOIN proxy p ON p.match_id = a.match_id
LEFT JOIN (SELECT match_id, min(venue) AS venue, min(date) AS match_date FROM pms GROUP BY match_id) mm ON mm.match_id = a.match_id
WHERE a.match_id IN (SELECT match_id FROM agg GROUP BY match_id HAVING count(*) = 2)""",
    "mom_line": """
SELECT *, CASE WHEN res IS NOT NULL THEN avg(res) OVER f END AS upto FROM (
  SELECT match_id, match_date, 1 AS side, team1_name AS franchise, CASE winner WHEN 'team1' THEN 1.0 WHEN 'team2' THEN 0.0 WHEN 'tie' THEN 0.5 END AS res FROM labelled
  UNION ALL
  SELECT match_id, match_date, 2, team2_name, CASE winner WHEN 'team2' THEN 1.0 WHEN 'team1' THEN 0.0 WHEN 'tie' THEN 0.5 END FROM labelled) x
WINDOW f AS (PARTITION BY franchise, res IS NOT NULL ORDER BY match_date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "mom": """
SELECT match_id, side, coalesce(last_value(upto IGNORE NULLS) OVER (PARTITION BY franchise ORDER BY match_date, match_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS momentum FROM mom_line""",
    "mrows": """
SELECT l.*, m1.momentum AS team1_momentum, m2.momentum AS team2_momentum
FROM labelled l LEFT JOIN mom m1 ON m1.match_id = l.match_id AND m1.side = 1
LEFT JOIN mom m2 ON m2.match_id = l.match_id AND m2.side = 2""",
}

CTES.update(
    {
        "squads": """
SELECT team, player_id, CASE WHEN min(k) % 3 = 0 THEN 1 ELSE 0 END AS is_overseas FROM (
  SELECT concat('T', CAST(c_custkey % 10 AS VARCHAR)) AS team, (c_custkey // 10) % 18 AS k,
         concat('T', CAST(c_custkey % 10 AS VARCHAR), '_', CAST((c_custkey // 10) % 18 AS VARCHAR)) AS player_id FROM customer) x
GROUP BY team, player_id""",
        "train_rows": """
SELECT * EXCLUDE (m_runs, m_wickets), CASE role WHEN 'batter' THEN 0 WHEN 'bowler' THEN 1 ELSE 2 END AS role_encoded,
       coalesce(m_runs, avg(m_runs) OVER (PARTITION BY player_id), avg(m_runs) OVER ()) AS momentum_runs,
       coalesce(m_wickets, avg(m_wickets) OVER (PARTITION BY player_id), avg(m_wickets) OVER ()) AS momentum_wickets
FROM (SELECT *, 0.5 * lag(runs, 1) OVER w + 0.3 * lag(runs, 2) OVER w + 0.2 * lag(runs, 3) OVER w AS m_runs,
             0.5 * lag(wickets, 1) OVER w + 0.3 * lag(wickets, 2) OVER w + 0.2 * lag(wickets, 3) OVER w AS m_wickets,
             coalesce(stddev_samp(runs) OVER p5, 0.0) AS std_runs, coalesce(stddev_samp(wickets) OVER p5, 0.0) AS std_wickets
      FROM feat
      WINDOW w AS (PARTITION BY player_id ORDER BY date, match_id),
             p5 AS (PARTITION BY player_id ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) x""",
        "recent": """
SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY date DESC, match_id DESC) AS recency,
       row_number() OVER (PARTITION BY team, player_id ORDER BY date DESC, match_id DESC) AS team_recency FROM base""",
        "recent_w": """
SELECT *, list_extract([0.22, 0.18, 0.15, 0.12, 0.10, 0.08, 0.07, 0.05, 0.02, 0.01], recency) AS w10,
       CASE WHEN recency <= 5 THEN list_extract([0.35, 0.25, 0.18, 0.12, 0.10], recency) END AS w5 FROM recent WHERE recency <= 10""",
        "form_tab": """
SELECT player_id, count(DISTINCT CASE WHEN recency <= 5 THEN match_id END) AS n_matches_last_5, count(DISTINCT match_id) AS n_matches_last_10,
       sum(runs * w5) / sum(w5) AS weighted_avg_runs_last_5, sum(wickets * w5) / sum(w5) AS weighted_avg_wk_last_5,
       sum(runs * w10) / sum(w10) AS weighted_avg_runs_last_10, sum(wickets * w10) / sum(w10) AS weighted_avg_wk_last_10,
       least(count(DISTINCT match_id) / 10.0, 1.0) AS data_confidence
FROM recent_w GROUP BY player_id""",
        "selection": """
SELECT team, player_id, max(CASE WHEN team_recency = 1 THEN role END) AS role,
       count(DISTINCT CASE WHEN team_recency <= 5 THEN match_id END) AS matches_last_5, count(DISTINCT match_id) AS matches_last_10,
       0.6 * (count(DISTINCT CASE WHEN team_recency <= 5 THEN match_id END) / 5.0) + 0.4 * (count(DISTINCT match_id) / 10.0) AS selection_score
FROM recent WHERE team_recency <= 10 GROUP BY team, player_id""",
        "scored_sel": """
SELECT team, player_id, role, matches_last_5, matches_last_10,
       selection_score - 0.001 * ((CAST(split_part(player_id, '_', 2) AS INTEGER) * 7) % 15) AS selection_score FROM selection""",
        "picked": """
SELECT *, row_number() OVER (PARTITION BY team, pick <= 11 ORDER BY selection_score DESC, player_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY team ORDER BY quota DESC, selection_score DESC, player_id) AS pick FROM (
    SELECT *, CASE WHEN (role = 'batter' AND in_role <= 4) OR (role = 'bowler' AND in_role <= 3) OR (role = 'allrounder' AND in_role <= 2) THEN 1 ELSE 0 END AS quota
    FROM (SELECT *, row_number() OVER (PARTITION BY team, role ORDER BY selection_score DESC, player_id) AS in_role FROM scored_sel) a) b) c""",
        "decided": """
SELECT *, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS n FROM mrows WHERE winner IN ('team1', 'team2')""",
        "own_team": """
SELECT match_id, match_date, CASE WHEN team1_name = 'T3' THEN team1_total_runs ELSE team2_total_runs END AS own_runs,
       CASE WHEN team1_name = 'T3' THEN team2_total_runs ELSE team1_total_runs END AS opp_runs,
       CASE WHEN (team1_name = 'T3' AND winner = 'team1') OR (team2_name = 'T3' AND winner = 'team2') THEN 1 ELSE 0 END AS win,
       CASE WHEN team1_name = 'T3' THEN team1_total_runs - team2_total_runs ELSE team2_total_runs - team1_total_runs END AS margin
FROM mrows WHERE winner IN ('team1', 'team2') AND (team1_name = 'T3' OR team2_name = 'T3')""",
    }
)

#: The deliveries table of queries over deduplicated balls: one row per ball key, one with a dismissal if any has.
UNIQUE_DELIVERIES = f"""SELECT * FROM ({CTES['deliveries']}) x QUALIFY row_number() OVER (
PARTITION BY match_id, innings, over, ball_in_over, batter, bowler, non_striker, runs_off_bat, extras
ORDER BY dismissal_kind = '', date, venue, batting_team, bowling_team, is_wide, is_noball, dismissal_kind, player_dismissed, competition) = 1"""

_WORD = re.compile(r"[a-z_0-9]+")


def _needs(sql: str) -> list[str]:
    return [w for w in dict.fromkeys(_WORD.findall(sql)) if w in CTES]


def with_tables(sql: str, unique_balls: bool = False) -> str:
    """Prefix ``sql`` with every shared table expression it reaches, in dependency order."""
    placed: list[str] = []
    tables = {**CTES, "deliveries": UNIQUE_DELIVERIES} if unique_balls else CTES

    def place(name: str, body: str) -> None:
        for other in _needs(body):
            if other != name and other not in placed:
                place(other, tables[other])
        if name and name not in placed:
            placed.append(name)

    place("", sql)
    if not placed:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED ({tables[n].strip()})" for n in placed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
