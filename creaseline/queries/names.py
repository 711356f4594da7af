"""Registered queries: names to ids, squads, legality and loose matching of teams and venues."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions import text
from creaseline.operators.containment import best_loose_match, venue_query_pairs
from creaseline.operators.distinct import folded_names
from creaseline.plans import identity
from creaseline.queries import views
from creaseline.queries.oracle import CTES
from creaseline.queries.registry import query, rounded

_SIG = "CASE WHEN contains(trim({0}), ' ') THEN concat(substr(lower(trim({0})), 1, 1), '|', list_extract(string_split(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), ' '), -1)) END"
_NORM = "trim(regexp_replace(replace(lower({0}), '.', ' '), '\\s+', ' ', 'g'))"
_SIM = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 100.0 ELSE (1.0 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE)) * 100.0 END"

CTES.update(
    {
        "people": f"""
SELECT k, team, concat(fn, ' ', ln) AS full_name, concat(substr(fn, 1, 1), ' ', ln) AS stats_id,
       CASE k % 5 WHEN 0 THEN concat(fn, ' ', ln) WHEN 1 THEN concat(' ', upper(substr(fn, 1, 1)), '. ', ln)
            WHEN 2 THEN concat(fn, 'e ', ln) WHEN 3 THEN concat(substr(fn, 1, 1), ' ', ln) ELSE upper(concat(fn, '  ', ln)) END AS asked
FROM (SELECT c_custkey AS k, concat('T', CAST(c_custkey % 10 AS VARCHAR)) AS team,
             list_extract([{views.FIRST_NAMES}], CAST((c_custkey // 10) % 8 + 1 AS INTEGER)) AS fn,
             list_extract([{views.LAST_NAMES}], CAST((c_custkey // 80) % 9 + 1 AS INTEGER)) AS ln FROM customer) x""",
        "nsquads": """
SELECT team, full_name AS player_id, max(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) AS is_overseas
FROM people WHERE k % 7 <> 3 GROUP BY team, full_name""",
        "aliases": """
SELECT DISTINCT * FROM (SELECT stats_id AS canonical_id, full_name AS alias_string, 'seed' AS source, 1 AS priority FROM people WHERE k % 4 <> 1
UNION ALL SELECT concat(stats_id, ' jr'), full_name, 'seed', 5 FROM people WHERE k % 8 = 2) x""",
        "reg": "SELECT stats_id AS canonical_id FROM people UNION SELECT full_name FROM people WHERE k % 5 = 1",
        "alias_look": """
SELECT lower(trim(alias_string)) AS alias_key, canonical_id FROM aliases
QUALIFY row_number() OVER (PARTITION BY lower(trim(alias_string)) ORDER BY priority DESC, alias_string, canonical_id) = 1""",
        "ident": """
SELECT team, player_id AS squad_player_name, coalesce(a.canonical_id, player_id) AS stats_player_id,
       CASE WHEN a.canonical_id IS NOT NULL THEN 'alias' WHEN lower(player_id) IN (SELECT lower(canonical_id) FROM alias_look) THEN 'passthrough' ELSE 'display_as_id' END AS resolution_method
FROM nsquads s LEFT JOIN alias_look a ON a.alias_key = lower(trim(player_id))""",
        "bridge": """
SELECT lower(team) AS franchise_key, stats_player_id, lower(stats_player_id) AS stats_player_id_norm, squad_player_name FROM ident
QUALIFY row_number() OVER (PARTITION BY lower(team), lower(stats_player_id) ORDER BY squad_player_name DESC) = 1""",
        "asked_squad": "SELECT DISTINCT team, trim(asked) AS player_id FROM people",
        "lone_sig": f"""
SELECT team, sig, min(player_id) AS cand, min(is_overseas) AS os FROM (SELECT *, {_SIG.format('player_id')} AS sig FROM nsquads) x
WHERE sig IS NOT NULL GROUP BY team, sig HAVING count(*) = 1""",
        "squad_res": f"""
SELECT q.team, q.player_id, coalesce(e.player_id, b.squad_player, CASE WHEN {_SIM.format('lower(q.player_id)', 'lower(l.cand)')} > 85 THEN l.cand END) AS squad_player,
       coalesce(e.is_overseas, b.is_overseas, CASE WHEN {_SIM.format('lower(q.player_id)', 'lower(l.cand)')} > 85 THEN l.os END, 0) AS is_overseas,
       CASE WHEN e.player_id IS NOT NULL THEN 'exact' WHEN b.squad_player IS NOT NULL THEN 'bridge'
            WHEN {_SIM.format('lower(q.player_id)', 'lower(l.cand)')} > 85 THEN 'similar' ELSE 'unresolved' END AS method
FROM asked_squad q
LEFT JOIN nsquads e ON e.team = q.team AND lower(e.player_id) = lower(q.player_id)
LEFT JOIN (SELECT br.franchise_key, br.stats_player_id_norm, s.player_id AS squad_player, s.is_overseas FROM bridge br
           JOIN nsquads s ON lower(s.team) = br.franchise_key AND lower(s.player_id) = lower(br.squad_player_name)) b
  ON b.franchise_key = lower(q.team) AND b.stats_player_id_norm = lower(q.player_id)
LEFT JOIN lone_sig l ON l.team = q.team AND l.sig = {_SIG.format('q.player_id')}""",
    }
)


def _aliases(spark, sf):
    return views.alias_table(spark, sf)


@query("c15_alias_lookup", "SELECT k, coalesce(a.canonical_id, trim(asked)) AS player_id FROM people LEFT JOIN alias_look a ON a.alias_key = lower(trim(asked))")
def _(spark, sf):
    rows = identity.resolve_display_names(views.people(spark, sf), "asked", _aliases(spark, sf))
    return rows.select("k", "player_id")


def _identity(spark, sf):
    empty = views.named_squads(spark, sf).select("team", F.col("player_id").alias("squad_player_name"), F.lit("").alias("stats_player_id")).limit(0)
    return identity.identity_table(views.named_squads(spark, sf), _aliases(spark, sf), empty)


@query("c16_identity_cascade", "SELECT * FROM ident")
def _(spark, sf):
    return _identity(spark, sf)


@query("c17_bridge_build", "SELECT * FROM bridge")
def _(spark, sf):
    return identity.bridge_table(_identity(spark, sf))


def _resolution(spark, sf):
    asked = views.people(spark, sf).select("team", F.col("asked").alias("player_id"))
    return identity.resolve_to_squad(asked, views.named_squads(spark, sf), identity.bridge_table(_identity(spark, sf)))


@query("c18_squad_resolution", "SELECT * FROM squad_res")
def _(spark, sf):
    return _resolution(spark, sf)


@query(
    "c19_registry_resolution",
    f"""WITH asked AS (SELECT DISTINCT trim(asked) AS name FROM people), q AS (SELECT name, {_NORM.format('name')} AS nm FROM asked),
    qs AS (SELECT *, {_SIG.format('nm')} AS sig FROM q), ids AS (SELECT {_NORM.format('canonical_id')} AS nm, min(canonical_id) AS id FROM reg GROUP BY 1),
    al AS (SELECT {_NORM.format('alias_string')} AS nm, canonical_id AS id FROM aliases QUALIFY row_number() OVER (PARTITION BY {_NORM.format('alias_string')} ORDER BY priority DESC, canonical_id) = 1),
    si AS (SELECT name, max(struct_pack(s := sc, i := id)) AS b FROM (SELECT qs.name, ids.id, {_SIM.format('qs.nm', 'ids.nm')} AS sc FROM qs JOIN ids ON {_SIG.format('ids.nm')} = qs.sig) x WHERE sc >= 88 GROUP BY name),
    sa AS (SELECT name, max(struct_pack(s := sc, i := id)) AS b FROM (SELECT qs.name, al.id, {_SIM.format('qs.nm', 'al.nm')} AS sc FROM qs JOIN al ON {_SIG.format('al.nm')} = qs.sig) x WHERE sc >= 88 GROUP BY name)
    SELECT qs.name, CASE WHEN e.canonical_id IS NOT NULL THEN qs.name ELSE coalesce(al.id, ids.id, si.b.i, sa.b.i, qs.name) END AS stats_player_id,
    CASE WHEN e.canonical_id IS NOT NULL THEN 'exact_registry' WHEN al.id IS NOT NULL THEN 'exact_alias' WHEN ids.id IS NOT NULL THEN 'exact_registry_norm'
    WHEN si.b IS NOT NULL THEN 'fuzzy' WHEN sa.b IS NOT NULL THEN 'fuzzy_alias' ELSE 'passthrough' END AS method,
    round(CAST(CASE WHEN e.canonical_id IS NOT NULL OR al.id IS NOT NULL OR ids.id IS NOT NULL THEN 100.0 ELSE coalesce(si.b.s, sa.b.s, 50.0) END AS DOUBLE) + 1e-9, 6) + 0.0 AS score
    FROM qs LEFT JOIN reg e ON e.canonical_id = qs.name LEFT JOIN al ON al.nm = qs.nm LEFT JOIN ids ON ids.nm = qs.nm LEFT JOIN si ON si.name = qs.name LEFT JOIN sa ON sa.name = qs.name""",
)
def _(spark, sf):
    names = views.people(spark, sf).select(F.col("asked").alias("name"))
    return rounded(identity.resolve_registry(names, views.registry_table(spark, sf), _aliases(spark, sf)))


@query("c20_squad_members", "SELECT p.k, p.team, trim(p.asked) AS player_id, squad_player, is_overseas FROM people p JOIN squad_res s ON s.team = p.team AND s.player_id = trim(p.asked) WHERE squad_player IS NOT NULL")
def _(spark, sf):
    rows = views.people(spark, sf).select("k", "team", F.trim("asked").alias("player_id"))
    return identity.squad_members(rows, _resolution(spark, sf)).select("k", "team", "player_id", "squad_player", "is_overseas")


@query(
    "c21_eleven_legality",
    """SELECT fixture_id, team, n_missing, n_overseas, n_missing = 0 AND n_overseas <= 4 AS legal FROM (
    SELECT k // 110 AS fixture_id, p.team, CAST(sum(CASE WHEN squad_player IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(coalesce(is_overseas, 0)) AS BIGINT) AS n_overseas
    FROM people p LEFT JOIN squad_res s ON s.team = p.team AND s.player_id = trim(p.asked) GROUP BY k // 110, p.team) x""",
)
def _(spark, sf):
    elevens = views.people(spark, sf).select(F.expr("k div 110").alias("fixture_id"), "team", F.trim("asked").alias("player_id"))
    return identity.eleven_legality(elevens, _resolution(spark, sf))


@query(
    "h01_h05_name_keys",
    f"""SELECT DISTINCT asked, {_NORM.format('asked')} AS norm, lower(trim(asked)) AS key, {_SIG.format('asked')} AS signature,
    trim(regexp_replace(lower(trim(asked)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, round({_SIM.format('lower(asked)', 'lower(full_name)')} + 1e-9, 6) + 0.0 AS similarity FROM people""",
)
def _(spark, sf):
    p = views.people(spark, sf).select("asked", "full_name").distinct()
    return rounded(
        p.select(
            "asked", text.normal_name("asked").alias("norm"), text.lookup_key("asked").alias("key"),
            text.name_signature("asked").alias("signature"), text.slug("asked").alias("slug"),
            text.similarity(F.lower("asked"), F.lower("full_name")).alias("similarity"),
        ).distinct()
    )


@query(
    "h01_folded_names",
    """SELECT DISTINCT lower(concat(full_name, ' ', list_extract(['fin', '1', 'iv', 'x2', 'ka'], CAST(k % 5 + 1 AS INTEGER)))) AS norm, team FROM people""",
)
def _(spark, sf):
    """Names in full-width letters, ligatures, circled and superscript digits, Roman numerals and half-width kana fold to plain keys."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    odd = views.people(spark, sf).select(
        "team", F.concat_ws("\u3000", F.translate("full_name", plain, wide), F.element_at(F.array(*[F.lit(x) for x in ("\ufb01n", "\u2460", "\u2163", "x\u00b2", "\uff4b\u1d43")]), (F.col("k") % 5 + 1).cast("int"))).alias("name")
    )
    return folded_names(odd, "name", "folded").select(text.normal_name("folded").alias("norm"), "team").distinct()


_LONG_TEAMS = "concat(full_name, ' ', team)"


@query(
    "c14_loose_containment",
    """WITH asked AS (SELECT DISTINCT lower(full_name) AS asked FROM people UNION SELECT DISTINCT lower(team) FROM people UNION SELECT DISTINCT lower(concat(full_name, ' ', team, ' xi')) FROM people),
    known AS (SELECT DISTINCT lower(concat(full_name, ' ', team)) AS known FROM people UNION SELECT DISTINCT lower(full_name) FROM people)
    SELECT asked, known FROM asked, known WHERE contains(known, asked) OR contains(asked, known)
    QUALIFY row_number() OVER (PARTITION BY asked ORDER BY (asked = known) DESC, length(known) DESC, known DESC) = 1""",
)
def _(spark, sf):
    p = views.people(spark, sf)
    full = F.lower("full_name")
    asked = (
        p.select(full.alias("asked"))
        .unionByName(p.select(F.lower("team").alias("asked")))
        .unionByName(p.select(F.lower(F.concat_ws(" ", "full_name", "team", F.lit("xi"))).alias("asked")))
    )
    known = p.select(F.lower(F.concat_ws(" ", "full_name", "team")).alias("known")).unionByName(p.select(full.alias("known")))
    return best_loose_match(asked, known)


@query(
    "c13_venue_tokens",
    """WITH q AS (SELECT DISTINCT query FROM (SELECT concat(list_extract(['Ekana', 'Eden', 'MCA', 'Wankhede Stadium', 'Jaitley Delhi', 'M C', 'Lucknow Ground'], CAST(s_suppkey % 7 + 1 AS INTEGER)), CASE WHEN s_suppkey % 3 = 0 THEN ' T' || CAST(s_suppkey % 4 AS VARCHAR) ELSE '' END) AS query FROM supplier) a),
    v AS (SELECT DISTINCT coalesce(stadium, trim(venue_city)) AS venue FROM schedule LEFT JOIN stadiums ON city = trim(venue_city))
    SELECT query, venue FROM q, v WHERE contains(lower(venue), lower(trim(query))) OR len(list_filter(regexp_extract_all(lower(query), '[a-z]{4,}'), lambda t: contains(lower(venue), t))) > 0""",
)
def _(spark, sf):
    from creaseline.functions.franchise import stadium_of_city

    asked = views.table(spark, sf, "supplier").selectExpr(
        "concat(element_at(array('Ekana', 'Eden', 'MCA', 'Wankhede Stadium', 'Jaitley Delhi', 'M C', 'Lucknow Ground'), CAST(s_suppkey % 7 + 1 AS INT)), CASE WHEN s_suppkey % 3 = 0 THEN concat(' T', s_suppkey % 4) ELSE '' END) AS query"
    )
    venues = views.fixture_schedule(spark, sf).select(stadium_of_city("venue_city").alias("venue"))
    return venue_query_pairs(asked, venues, "query", "venue")


@query(
    "g05_registry_rebuild",
    "SELECT canonical_id, alias_string, source, priority FROM (SELECT canonical_id, canonical_id AS alias_string, 'stats_player_id' AS source, 0 AS priority FROM (SELECT DISTINCT player_id AS canonical_id FROM pms UNION SELECT canonical_id FROM aliases) i UNION ALL SELECT * FROM aliases) x QUALIFY row_number() OVER (PARTITION BY canonical_id, alias_string ORDER BY priority DESC, source) = 1",
)
def _(spark, sf):
    return identity.rebuild_registry(views.player_match(spark, sf), _aliases(spark, sf))[1]


@query("g05_registry_ids", "SELECT canonical_id, canonical_id AS primary_name, '' AS notes FROM (SELECT DISTINCT player_id AS canonical_id FROM pms UNION SELECT canonical_id FROM aliases) i")
def _(spark, sf):
    return identity.rebuild_registry(views.player_match(spark, sf), _aliases(spark, sf))[0]
