"""Merging what was drawn with what is upstream: tags, elements, changes, saved squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_tags(local: Column, upstream: Column, owned: list[str]) -> Column:
    """Upstream's tags of the keys it owns, even where it has dropped them; then ele, the mapper's or else upstream's,
    whoever owns it; then the mapper's other tags. A missing map counts as empty."""
    local, upstream = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (local, upstream))
    theirs = F.map_filter(upstream, lambda k, v: k.isin(owned) & (k != "ele"))
    height = F.when(F.map_contains_key(local, "ele"), F.map_filter(local, lambda k, v: k == "ele")).otherwise(F.map_filter(upstream, lambda k, v: k == "ele"))
    return F.map_concat(theirs, height, F.map_filter(local, lambda k, v: ~k.isin(owned) & (k != "ele")))


def reconcile(local: DataFrame, upstream: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """key, tags, state: every element of either side, as kept, added, merged or gone (upstream has dropped it)."""
    u = upstream.select(key, F.col("tags").alias("_u")).withColumn("_in_u", F.lit(True))
    both = local.withColumn("_in_l", F.lit(True)).join(u, key, "full")
    state = F.when(F.col("_in_l").isNull(), "added").when(F.col("_in_u").isNull(), F.when(F.col(key) > 0, "gone").otherwise("kept")).otherwise("merged")
    tags = F.when(F.col("_in_l").isNull(), F.col("_u")).when(F.col("_in_u").isNull(), F.col("tags")).otherwise(merge_tags(F.col("tags"), F.col("_u"), owned))
    return both.select(key, tags.alias("tags"), state.alias("state"))


def overlay(base: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Edited rows over the base."""
    return base.join(edited.select(*keys).distinct(), keys, "left_anti").unionByName(edited)


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base after changes (op create, modify or delete, at, and base's columns); of one element the last change counts."""
    w = Window.partitionBy(*keys).orderBy(F.desc("at"))
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where("op <> 'delete'").select(base.columns))


def settle(local: DataFrame, remote: DataFrame, before: DataFrame) -> DataFrame:
    """name, action of files (name, hash) at hand, at the mirror and as last fetched: place, keep, update, clash, drop, same."""
    j = local.select("name", F.col("hash").alias("l")).join(remote.select("name", F.col("hash").alias("r")), "name", "full").join(before.select("name", F.col("hash").alias("b")), "name", "full")
    return j.where("l IS NOT NULL OR r IS NOT NULL").select(
        "name",
        F.expr("""CASE WHEN l IS NULL THEN 'place' WHEN r IS NULL AND b IS NULL THEN 'keep' WHEN r IS NULL THEN CASE WHEN l = b THEN 'drop' ELSE 'keep' END
                  WHEN l = r THEN 'same' WHEN l <=> b THEN 'update' WHEN r <=> b THEN 'keep' ELSE 'clash' END""").alias("action"),
    )


def homes(nodes: DataFrame, held: DataFrame, move: bool = True) -> DataFrame:
    """feature, square: where a feature is kept. The square with most of its nodes, the first by name of equals; but the
    one that holds it already, if that has as many, or, where features do not `move`, always. nodes are (feature, square,
    node), held (feature, square); a feature without nodes has no row."""
    n = nodes.groupBy("feature", "square").agg(F.countDistinct("node").alias("n"))
    best = n.groupBy("feature").agg(F.max(F.col("n")).alias("_n"), F.min_by("square", F.struct(-F.col("n"), "square")).alias("_best"))
    was = held.select("feature", F.col("square").alias("_was")).join(n.withColumnRenamed("square", "_was"), ["feature", "_was"], "left")
    stays = F.col("_was").isNotNull() & ((F.coalesce("n", F.lit(0)) >= F.col("_n")) | F.lit(not move))
    return best.join(was, "feature", "left").select("feature", F.when(stays, F.col("_was")).otherwise(F.col("_best")).alias("square"))


def moved_ways(way: DataFrame, moved: DataFrame, imported: DataFrame) -> DataFrame:
    """way_id of ways (way_id, refs) outside the import that hold a node (node_id) upstream has moved."""
    own = way.join(imported.select("way_id").distinct(), "way_id", "left_anti")
    return own.select("way_id", F.explode("refs").alias("node_id")).join(moved.select("node_id").distinct(), "node_id", "left_semi").select("way_id").distinct()


def reconcile_square(local: dict[str, DataFrame], upstream: dict[str, DataFrame], owned: list[str]) -> dict[str, DataFrame]:
    """An import as it lands: for tables node (node_id, lon, lat, tags), way (way_id, refs, tags) and relation
    (relation_id, members, tags) of both sides, `node`, `way` and `relation` to write (geometry and members upstream's, tags
    merged), `removed` (node_id: vertices that a rewritten way left, untagged, unknown upstream, in use nowhere) and `moved`
    (way_id: ways of one's own on a node that upstream moved)."""
    out = {}
    for kind in ("node", "way", "relation"):
        here = local[kind].select(f"{kind}_id", F.col("tags").alias("_l"))
        out[kind] = upstream[kind].join(here, f"{kind}_id", "left").withColumn("tags", F.when(F.col("_l").isNull(), F.col("tags")).otherwise(merge_tags(F.col("_l"), F.col("tags"), owned))).drop("_l")
    was = local["node"].select("node_id", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    shifted = upstream["node"].join(was, "node_id").where("lon <> _x OR lat <> _y").select("node_id")
    out["moved"] = moved_ways(local["way"], shifted, upstream["way"])
    rewritten = local["way"].join(upstream["way"].select("way_id"), "way_id", "left_semi").select(F.explode("refs").alias("node_id")).distinct()
    kept = local["way"].join(upstream["way"].select("way_id"), "way_id", "left_anti")
    members = local["relation"].select("members").union(out["relation"].select("members")).select(F.explode("members").alias("m")).where("m.type = 'node'").select(F.col("m.ref").alias("node_id"))
    used = upstream["node"].select("node_id").union(out["way"].select(F.explode("refs"))).union(kept.select(F.explode("refs"))).union(members).distinct()
    tagged = local["node"].where(F.size("tags") > 0).select("node_id")
    out["removed"] = left_behind(rewritten, used, tagged).join(local["node"].select("node_id"), "node_id", "left_semi")
    return out


def left_behind(removed: DataFrame, in_use: DataFrame, tagged: DataFrame) -> DataFrame:
    """Vertices taken off a way that nothing uses and that carry no tags."""
    return removed.join(in_use, "node_id", "left_anti").join(tagged, "node_id", "left_anti").distinct()


def merged_into(lost: DataFrame, answer: DataFrame) -> DataFrame:
    """way_id of ways (way_id, seq, node_id, n) over half of whose different nodes, and one of the middle, lie on the answer's ways."""
    on = answer.select("node_id").distinct().withColumn("_on", F.lit(1))
    j = lost.join(on, "node_id", "left")
    return j.groupBy("way_id").agg(
        F.countDistinct("node_id").alias("all"), F.countDistinct(F.when(F.col("_on") == 1, F.col("node_id"))).alias("hit"),
        F.max(F.when((F.col("seq") > 0) & (F.col("seq") < F.col("n") - 1) & (F.col("_on") == 1), 1).otherwise(0)).alias("middle"),
    ).where("hit * 2 > all AND middle = 1").select("way_id", "hit")
