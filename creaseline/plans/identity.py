"""Player names to ids: aliases, registry, identity table, squads and legality of an eleven.

Every cascade is a chain of equi-joins.  Similarity is only computed inside a block of equal signature
(first initial and last name), so no all-pairs comparison exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.text import lookup_key, name_signature, normal_name, similarity
from creaseline.operators.distinct import folded_names
from creaseline.operators.similar_names import similar_pairs
from creaseline.operators.windows import keep_one

SQUAD_SIMILARITY = 85.0
REGISTRY_SIMILARITY = 88.0
MAX_OVERSEAS = 4


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """One canonical id per lower-case alias, the highest priority winning."""
    keyed = aliases.select(
        lookup_key("alias_string").alias("alias_key"),
        F.trim("canonical_id").alias("canonical_id"),
        F.trim("alias_string").alias("alias_string"),
        F.coalesce(F.col("priority").try_cast("int"), F.lit(0)).alias("priority"),
    ).where(F.col("alias_key") != "")
    order = [F.desc("priority"), F.asc("alias_string"), F.asc("canonical_id")]
    return keep_one(keyed, ["alias_key"], order).select("alias_key", "canonical_id")


def resolve_display_names(rows: DataFrame, name: str, aliases: DataFrame, output: str = "player_id") -> DataFrame:
    """Stats id of a display name by alias; the trimmed name itself without one."""
    lookup = alias_lookup(aliases).withColumnsRenamed({"canonical_id": "_cid", "alias_key": "_ak"})
    joined = rows.join(lookup, lookup_key(name) == F.col("_ak"), "left")
    return joined.withColumn(output, F.coalesce(F.col("_cid"), F.trim(name))).drop("_cid", "_ak")


def rebuild_registry(player_ids: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry of all known ids, and aliases: every id names itself at priority 0, the seed wins on equal pairs."""
    ids = (
        player_ids.select(F.trim("player_id").alias("canonical_id"))
        .unionByName(seed.select(F.trim("canonical_id").alias("canonical_id")))
        .where(F.col("canonical_id") != "")
        .distinct()
    )
    registry = ids.select("canonical_id", F.col("canonical_id").alias("primary_name"), F.lit("").alias("notes"))
    own = ids.select(
        "canonical_id",
        F.col("canonical_id").alias("alias_string"),
        F.lit("stats_player_id").alias("source"),
        F.lit(0).alias("priority"),
        F.lit(0).alias("_seed"),
    )
    given = seed.select("canonical_id", "alias_string", "source", F.col("priority").cast("int"), F.lit(1).alias("_seed"))
    order = [F.desc("_seed"), F.desc("priority"), F.asc("source")]
    aliases = keep_one(own.unionByName(given), ["canonical_id", "alias_string"], order).drop("_seed")
    return registry, aliases


def identity_table(squads: DataFrame, aliases: DataFrame, seed: DataFrame) -> DataFrame:
    """Stats id of every squad player: seed, alias, name that is an id already, else the display name."""
    lookup = alias_lookup(aliases)
    squad = squads.select(F.trim("team").alias("team"), F.trim("player_id").alias("squad_player_name")).withColumns(
        {"_t": lookup_key("team"), "_n": lookup_key("squad_player_name")}
    )
    overrides = keep_one(
        seed.select(
            lookup_key("team").alias("_t"), lookup_key("squad_player_name").alias("_n"), F.trim("stats_player_id").alias("_seed")
        ),
        ["_t", "_n"],
        [F.desc("_seed")],
    )
    known = lookup.select(lookup_key("canonical_id").alias("_n"), F.lit(True).alias("_known")).distinct()
    joined = (
        squad.join(overrides, ["_t", "_n"], "left")
        .join(lookup.select(F.col("alias_key").alias("_n"), F.col("canonical_id").alias("_alias")), "_n", "left")
        .join(known, "_n", "left")
    )
    method = (
        F.when(F.col("_seed").isNotNull() | F.col("_alias").isNotNull(), "alias")
        .when(F.col("_known"), "passthrough")
        .otherwise("display_as_id")
    )
    resolved = joined.select(
        "team",
        "squad_player_name",
        F.coalesce("_seed", "_alias", "squad_player_name").alias("stats_player_id"),
        method.alias("resolution_method"),
    )
    return keep_one(resolved, ["team", "squad_player_name"], [F.asc("stats_player_id")])


def bridge_table(identity: DataFrame) -> DataFrame:
    """(franchise key, normalised stats id) to squad name, the last squad name in name order kept."""
    rows = identity.select(
        lookup_key("team").alias("franchise_key"),
        F.trim("stats_player_id").alias("stats_player_id"),
        lookup_key("stats_player_id").alias("stats_player_id_norm"),
        F.trim("squad_player_name").alias("squad_player_name"),
    )
    return keep_one(rows, ["franchise_key", "stats_player_id_norm"], [F.desc("squad_player_name")])


def resolve_to_squad(
    asked: DataFrame, squads: DataFrame, bridge: DataFrame, threshold: float = SQUAD_SIMILARITY
) -> DataFrame:
    """Squad name of each distinct (team, player_id): exact, bridge, or a lone signature match that is similar.

    Adds ``squad_player`` (null when unresolved), ``is_overseas`` and ``method``.
    """
    pairs = asked.select(F.trim("team").alias("team"), F.trim("player_id").alias("player_id")).distinct()
    pairs = pairs.withColumns(
        {"_t": lookup_key("team"), "_p": lookup_key("player_id"), "_sig": name_signature("player_id")}
    )
    squad = keep_one(
        squads.select(
            lookup_key("team").alias("_t"),
            lookup_key("player_id").alias("_p"),
            F.trim("player_id").alias("squad_player"),
            F.coalesce(F.col("is_overseas"), F.lit(0)).alias("is_overseas"),
        ),
        ["_t", "_p"],
        [F.asc("squad_player")],
    )

    def named(prefix: str) -> Column:
        return F.struct("squad_player", "is_overseas").alias(prefix)

    exact = squad.select("_t", "_p", named("_exact"))
    bridged = (
        bridge.select(
            lookup_key("franchise_key").alias("_t"),
            lookup_key("stats_player_id_norm").alias("_id"),
            lookup_key("squad_player_name").alias("_p"),
        )
        .join(squad, ["_t", "_p"])
        .select("_t", F.col("_id").alias("_p"), named("_bridge"))
    )
    # Blocks of one signature within a team: only a block with a single squad name can match.
    lone = (
        squad.withColumn("_sig", name_signature("squad_player"))
        .where(F.col("_sig").isNotNull())
        .groupBy("_t", "_sig")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("squad_player", "is_overseas")).alias("_cand"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
    joined = (
        pairs.join(exact, ["_t", "_p"], "left")
        .join(keep_one(bridged, ["_t", "_p"], [F.asc("_bridge")]), ["_t", "_p"], "left")
        .join(lone, ["_t", "_sig"], "left")
    )
    close = similarity(lookup_key("player_id"), F.lower(F.col("_cand.squad_player"))) > threshold
    hit = F.coalesce(F.col("_exact"), F.col("_bridge"), F.when(close, F.col("_cand")))
    method = (
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_bridge").isNotNull(), "bridge")
        .when(close, "similar")
        .otherwise("unresolved")
    )
    return joined.withColumn("_hit", hit).select(
        "team",
        "player_id",
        F.col("_hit.squad_player").alias("squad_player"),
        F.coalesce(F.col("_hit.is_overseas"), F.lit(0)).alias("is_overseas"),
        method.alias("method"),
    )


def resolve_registry(
    names: DataFrame, registry: DataFrame, aliases: DataFrame, name: str = "name", threshold: float = REGISTRY_SIMILARITY
) -> DataFrame:
    """Stats id, method and score of each distinct name.

    Order: exact id, exact alias, normalised id, similar id, similar alias, the name itself (score 50).  Similar names
    are found inside (initial, last name) blocks by an exact edit-distance join, whose work follows the matches.
    """
    asked = names.select(F.trim(name).alias("name")).where(F.col("name") != "").distinct()
    asked = folded_names(asked, "name", "_form").withColumn("_norm", normal_name("_form")).drop("_form")
    asked = asked.withColumn("_sig", name_signature("_norm"))
    ids = registry.select(F.trim("canonical_id").alias("_id")).where(F.col("_id") != "").distinct()
    formed = folded_names(ids, "_id", "_form").select(normal_name("_form").alias("_norm"), F.col("_id").alias("_norm_id"))
    by_norm = keep_one(formed, ["_norm"], [F.asc("_norm_id")])
    alias_norm = keep_one(
        folded_names(aliases, "alias_string", "_form").select(
            normal_name("_form").alias("_norm"),
            F.trim("canonical_id").alias("_alias_id"),
            F.coalesce(F.col("priority").try_cast("int"), F.lit(0)).alias("_prio"),
        ).where((F.col("_norm") != "") & (F.col("_alias_id") != "")),
        ["_norm"],
        [F.desc("_prio"), F.asc("_alias_id")],
    ).drop("_prio")

    def best_similar(candidates: DataFrame, target: str, out: str) -> DataFrame:
        block = candidates.select("_norm", target, name_signature("_norm").alias("_sig")).where(F.col("_sig").isNotNull())
        close = similar_pairs(asked.select("_sig", "_norm"), block.withColumnRenamed("_norm", "_other"), ["_sig"], "_norm", "_other", threshold)
        named = close.join(block.select(F.col("_norm").alias("_other"), target), "_other")
        best = F.max_by(F.struct(F.col(target).alias("id"), F.col("score")), F.struct("score", target))
        return named.groupBy("_norm").agg(best.alias(out))

    joined = (
        asked.join(ids.select(F.col("_id").alias("name"), F.lit(True).alias("_exact")), "name", "left")
        .join(alias_norm, "_norm", "left")
        .join(by_norm, "_norm", "left")
        .join(best_similar(by_norm, "_norm_id", "_sim_id"), "_norm", "left")
        .join(best_similar(alias_norm, "_alias_id", "_sim_alias"), "_norm", "left")
    )
    steps = [
        (F.coalesce(F.col("_exact"), F.lit(False)), F.col("name"), "exact_registry", F.lit(100.0)),
        (F.col("_alias_id").isNotNull(), F.col("_alias_id"), "exact_alias", F.lit(100.0)),
        (F.col("_norm_id").isNotNull(), F.col("_norm_id"), "exact_registry_norm", F.lit(100.0)),
        (F.col("_sim_id").isNotNull(), F.col("_sim_id.id"), "fuzzy", F.col("_sim_id.score")),
        (F.col("_sim_alias").isNotNull(), F.col("_sim_alias.id"), "fuzzy_alias", F.col("_sim_alias.score")),
    ]
    pid, method, score = F.col("name"), F.lit("passthrough"), F.lit(50.0)
    for test, value, label, points in reversed(steps):
        pid = F.when(test, value).otherwise(pid)
        method = F.when(test, label).otherwise(method)
        score = F.when(test, points).otherwise(score)
    return joined.select("name", pid.alias("stats_player_id"), method.alias("method"), score.alias("score"))


def squad_members(rows: DataFrame, resolution: DataFrame) -> DataFrame:
    """Rows whose (team, player_id) resolves to a squad, with squad name and overseas flag."""
    hits = resolution.where(F.col("squad_player").isNotNull()).select("team", "player_id", "squad_player", "is_overseas")
    return rows.join(hits, ["team", "player_id"])


def eleven_legality(elevens: DataFrame, resolution: DataFrame, max_overseas: int = MAX_OVERSEAS) -> DataFrame:
    """Per (fixture_id, team): players missing from the squad, overseas count and whether the eleven is legal.

    ``elevens`` has one row per fixture, team and player.
    """
    joined = elevens.join(resolution, ["team", "player_id"], "left")
    missing = F.col("squad_player").isNull()
    return joined.groupBy("fixture_id", "team").agg(
        F.sum(missing.cast("int")).alias("n_missing"),
        F.sum(F.coalesce(F.col("is_overseas"), F.lit(0))).alias("n_overseas"),
    ).withColumn("legal", (F.col("n_missing") == 0) & (F.col("n_overseas") <= max_overseas))
