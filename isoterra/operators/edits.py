"""Edits as functions of tables: each gives the table after the edit, and undoing is reading the version before.

Ways are rows (way_id, refs, tags), nodes rows (node_id, lon, lat, tags); an edit is a small table of what to change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _changed(way: DataFrame, edit: DataFrame, refs: Column) -> DataFrame:
    """way with refs replaced where edit (way_id, ...) has a row."""
    j = way.join(edit, "way_id", "left").withColumn("refs", F.when(F.col("_hit"), refs).otherwise(F.col("refs")))
    return j.select(way.columns)


def _hits(edit: DataFrame) -> DataFrame:
    return edit.withColumn("_hit", F.lit(True))


def add(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def set_tags(table: DataFrame, edit: DataFrame, key: str) -> DataFrame:
    """tags replaced by edit (key, new)."""
    j = table.join(edit.select(key, F.col("new").alias("_new")), key, "left")
    return j.withColumn("tags", F.coalesce("_new", "tags")).select(table.columns)


def move_nodes(node: DataFrame, edit: DataFrame) -> DataFrame:
    j = node.join(edit.select("node_id", F.col("lon").alias("_x"), F.col("lat").alias("_y")), "node_id", "left")
    return j.withColumn("lon", F.coalesce("_x", "lon")).withColumn("lat", F.coalesce("_y", "lat")).select(node.columns)


def translate_ways(node: DataFrame, way: DataFrame, edit: DataFrame) -> DataFrame:
    """Every node of the ways of edit (way_id, dx, dy) moved; a node of several moved ways moves once."""
    moved = way.join(edit, "way_id").select(F.explode("refs").alias("node_id"), "way_id", "dx", "dy").groupBy("node_id").agg(F.min_by(F.struct("dx", "dy"), "way_id").alias("_m"))
    j = node.join(moved, "node_id", "left")
    return j.withColumn("lon", F.col("lon") + F.coalesce(F.col("_m.dx"), F.lit(0.0))).withColumn("lat", F.col("lat") + F.coalesce(F.col("_m.dy"), F.lit(0.0))).select(node.columns)


def extend_ways(way: DataFrame, edit: DataFrame) -> DataFrame:
    """Nodes of edit (way_id, nodes, at_start) put before the first or after the last."""
    return _changed(way, _hits(edit), F.when(F.col("at_start"), F.concat("nodes", "refs")).otherwise(F.concat("refs", "nodes")))


def insert_nodes(way: DataFrame, edit: DataFrame) -> DataFrame:
    """A node of edit (way_id, at, node) put before place `at`."""
    return _changed(way, _hits(edit), F.concat(F.slice("refs", F.lit(1), F.col("at")), F.array("node"), F.slice("refs", F.col("at") + 1, F.size("refs"))))


def delete_nodes(way: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes taken off every way, wherever they stand in it; a way of fewer than two nodes goes. A ring that loses its
    end stays open."""
    gone = nodes.select("node_id").distinct()
    hit = way.select("way_id", F.explode("refs").alias("node_id")).join(gone, "node_id").groupBy("way_id").agg(F.collect_set("node_id").alias("_gone"))
    j = way.join(hit, "way_id", "left")
    j = j.withColumn("refs", F.when(F.col("_gone").isNull(), F.col("refs")).otherwise(F.filter("refs", lambda r: ~F.array_contains("_gone", r))))
    return j.where(F.col("_gone").isNull() | (F.size("refs") > 1)).select(way.columns)


def reverse_ways(way: DataFrame, ids: DataFrame) -> DataFrame:
    return _changed(way, _hits(ids.select("way_id").distinct()), F.reverse("refs"))


def rotate_rings(way: DataFrame, edit: DataFrame) -> DataFrame:
    """Rings of edit (way_id, at) begin at place `at`."""
    n = F.size("refs") - 1
    return _changed(way, _hits(edit), F.concat(F.slice("refs", F.col("at") + 1, n - F.col("at")), F.slice("refs", F.lit(1), F.col("at") + 1)))


def close_rings(way: DataFrame, at: DataFrame) -> DataFrame:
    """Ways whose ends (at: node_id, place) lie at one place but are two nodes end in their first node."""
    ends = way.select("way_id", F.element_at("refs", 1).alias("a"), F.element_at("refs", -1).alias("b")).where("a <> b")
    p = at.select("node_id", "place")
    same = ends.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").where("pa = pb").select("way_id")
    return _changed(way, _hits(same), F.concat(F.slice("refs", F.lit(1), F.size("refs") - 1), F.slice("refs", 1, 1)))


def split_way(way: DataFrame, edit: DataFrame) -> DataFrame:
    """Ways of edit (way_id, at, new_id) cut at place `at`; the first piece keeps the id, tags go to both."""
    j = way.join(edit, "way_id")
    head = j.withColumn("refs", F.slice("refs", F.lit(1), F.col("at") + 1)).select(way.columns)
    tail = j.withColumn("refs", F.slice("refs", F.col("at") + 1, F.size("refs"))).withColumn("way_id", F.col("new_id")).select(way.columns)
    return delete(way, edit, "way_id").unionByName(head).unionByName(tail)


def join_ways(way: DataFrame, edit: DataFrame) -> DataFrame:
    """Way b of edit (way_id, b) joined to a by the end they share; a keeps its id and tags, b goes."""
    b = way.select(F.col("way_id").alias("b"), F.col("refs").alias("_b"))
    first, last = F.element_at("refs", 1), F.element_at("refs", -1)
    b1, b2 = F.element_at("_b", 1), F.element_at("_b", -1)
    rest, back = F.slice("_b", F.lit(2), F.size("_b")), F.slice(F.reverse("_b"), F.lit(2), F.size("_b"))
    joined = F.when(last == b1, F.concat("refs", rest)).when(last == b2, F.concat("refs", back)).when(first == b2, F.concat("_b", F.slice("refs", F.lit(2), F.size("refs")))).when(
        first == b1, F.concat(F.reverse("_b"), F.slice("refs", F.lit(2), F.size("refs")))
    )
    both = edit.join(b, "b").withColumn("_hit", F.lit(True))
    return _changed(delete(way, edit.select(F.col("b").alias("way_id")), "way_id"), both, F.coalesce(joined, F.col("refs")))


def unglue(way: DataFrame, edit: DataFrame) -> DataFrame:
    """A node of edit (way_id, node, new_id) replaced on that way alone."""
    return _changed(way, _hits(edit), F.transform("refs", lambda r: F.when(r == F.col("node"), F.col("new_id")).otherwise(r)))


def replace_section(way: DataFrame, edit: DataFrame) -> DataFrame:
    """Places lo to hi of edit (way_id, lo, hi, nodes), both included, replaced by nodes."""
    return _changed(way, _hits(edit), F.concat(F.slice("refs", F.lit(1), F.col("lo")), F.col("nodes"), F.slice("refs", F.col("hi") + 2, F.size("refs"))))


def merged_nodes(node: DataFrame, way: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """node_id, into: nodes (node_id, lon, lat, tags) at one place, a ten-millionth of a degree, that go into one of them.

    A node that must stay is upstream's (positive), tagged, or named by a relation (named: node_id): it is the one kept,
    and a place with two such is left alone. Else the largest id is kept. Also left alone are places with a node of a
    shore (way: way_id, refs, shore), and two places that one segment each of two ways joins, for there the ways run
    together."""
    at = node.select("node_id", (F.size("tags") > 0).alias("_t"), F.rint(F.col("lon") * 1e7).cast("long").alias("px"), F.rint(F.col("lat") * 1e7).cast("long").alias("py"))
    fixed = (F.col("node_id") > 0) | F.coalesce("_t", F.lit(False))
    if named is not None:
        at = at.join(named.select("node_id").distinct().withColumn("_n", F.lit(True)), "node_id", "left")
        fixed = fixed | F.coalesce("_n", F.lit(False))
    places = at.withColumn("_fixed", fixed).groupBy("px", "py").agg(F.count("*").alias("n"), F.count_if("_fixed").alias("f"), F.max(F.when(F.col("_fixed"), F.col("node_id"))).alias("kept"), F.max("node_id").alias("top"))
    places = places.where("n > 1").select("px", "py", F.coalesce("kept", "top").alias("into"), "f")
    held = at.join(places, ["px", "py"]).select("node_id", "px", "py", "into", "f")
    if way is not None:
        refs = way.select("way_id", "shore", F.posexplode("refs").alias("seq", "node_id"))
        met = refs.join(held.select("node_id", "px", "py"), "node_id")
        on_shore = met.where("shore").select("px", "py")
        after = met.select("way_id", (F.col("seq") - 1).alias("seq"), F.col("px").alias("qx"), F.col("py").alias("qy"))
        joined = met.join(after, ["way_id", "seq"]).where("px <> qx OR py <> qy").select("px", "py", "qx", "qy").distinct()
        a, b = (met.select("way_id", F.col("px").alias(f"{c}x"), F.col("py").alias(f"{c}y")).distinct() for c in "pq")
        both = joined.join(a, ["px", "py"]).join(b, ["way_id", "qx", "qy"]).groupBy("px", "py", "qx", "qy").agg(F.count("*").alias("ways")).where("ways > 1")
        together = both.select("px", "py").union(both.select("qx", "qy"))
        held = held.join(on_shore.union(together).distinct(), ["px", "py"], "left_anti")
    return held.where("f < 2 AND into <> node_id").select("node_id", "into")


def tidy_contours(way: DataFrame, merges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """way (way_id, refs, ...) laid through the nodes kept (merges: node_id, into), a node twice in a row once; a way of
    one's own (negative, no relation's member: way_id) that is no line any more, of fewer than two places or a ring of
    fewer than three, goes."""
    m = merges.select("node_id", "into")
    each = way.select("way_id", F.posexplode("refs").alias("seq", "node_id")).join(m, "node_id", "left").withColumn("to", F.coalesce("into", "node_id"))
    hit = each.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "to"))).alias("s"), F.max(F.col("into").isNotNull()).alias("_hit")).where("_hit")
    laid = hit.select("way_id", F.col("s.to").alias("_all"))
    laid = laid.select("way_id", F.filter("_all", lambda x, i: (i == 0) | (x != F.element_at("_all", F.greatest(i, F.lit(1))))).alias("_laid"))
    j = way.join(laid, "way_id", "left")
    own = F.col("way_id") < 0
    if members is not None:
        j = j.join(members.select("way_id").distinct().withColumn("_m", F.lit(True)), "way_id", "left")
        own = own & F.col("_m").isNull()
    closed = (F.size("_laid") > 1) & (F.element_at("_laid", 1) == F.element_at("_laid", -1))
    gone = own & F.col("_laid").isNotNull() & (F.size(F.array_distinct("_laid")) < F.when(closed, 3).otherwise(2))
    return j.where(~F.coalesce(gone, F.lit(False))).withColumn("refs", F.coalesce("_laid", "refs")).select(way.columns)


def drop_fill_lines(way: DataFrame, node: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """way and node without the ways that carry the tag `key`, and without the nodes that only those held."""
    fill = F.map_contains_key("tags", F.lit(key))
    kept = way.where(~fill)
    lone = way.where(fill).select(F.explode("refs").alias("node_id")).distinct().join(kept.select(F.explode("refs").alias("node_id")).distinct(), "node_id", "left_anti")
    return kept, node.join(lone, "node_id", "left_anti")


def splice_ways(way: DataFrame, edit: DataFrame) -> DataFrame:
    """Between two places of a way, both included, the nodes of another (edit: way_id, lo, hi, other): the other way goes,
    turned round if its last node is the one at lo."""
    o = way.select(F.col("way_id").alias("other"), F.col("refs").alias("_o"))
    e = edit.join(o, "other").withColumn("_hit", F.lit(True))
    turned = F.when(F.element_at("_o", -1) == F.element_at("refs", F.col("lo") + 1), F.reverse("_o")).otherwise(F.col("_o"))
    left = delete(way, edit.select(F.col("other").alias("way_id")), "way_id")
    return _changed(left, e, F.concat(F.slice("refs", F.lit(1), F.col("lo")), turned, F.slice("refs", F.col("hi") + 2, F.size("refs"))))


def replace_ways(way: DataFrame, edit: DataFrame) -> DataFrame:
    """refs of edit (way_id, new_refs) in place of a way's own."""
    return _changed(way, _hits(edit), F.col("new_refs"))


def set_levels(table: DataFrame, edit: DataFrame, key: str) -> DataFrame:
    """ele set to the text of edit (key, ele) in the tags, or taken off where that is null."""
    j = table.join(edit.select(key, F.col("ele").alias("_e"), F.lit(True).alias("_hit")), key, "left")
    rest = F.map_filter("tags", lambda k, v: k != "ele")
    new = F.when(F.col("_e").isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("ele"), F.col("_e"))))
    return j.withColumn("tags", F.when(F.col("_hit"), new).otherwise(F.col("tags"))).select(table.columns)


def delete_relation_with_parts(relation: DataFrame, way: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """relation (relation_id, members, tags) and way without the relations and those of their untagged member ways that no
    other relation names."""
    gone = relation.join(ids.select("relation_id").distinct(), "relation_id", "left_semi")
    kept = relation.join(ids.select("relation_id").distinct(), "relation_id", "left_anti")

    def parts(df: DataFrame) -> DataFrame:
        return df.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("way_id")).distinct()

    lone = parts(gone).join(parts(kept), "way_id", "left_anti").join(way.where(F.size("tags") == 0).select("way_id"), "way_id", "left_semi")
    return kept, way.join(lone, "way_id", "left_anti")


def type_water_relations(relation: DataFrame) -> DataFrame:
    """type=multipolygon for relations of water (natural=water or a water tag) without a type, all of whose members are
    outer or inner rings."""
    tag = lambda k: F.element_at("tags", F.lit(k))
    water = (tag("natural") == "water") | tag("water").isNotNull()
    rings = (F.size("members") > 0) & F.forall("members", lambda m: m["role"].isin("outer", "inner"))
    hit = F.coalesce(water, F.lit(False)) & tag("type").isNull() & rings
    return relation.withColumn("tags", F.when(hit, F.map_concat("tags", F.create_map(F.lit("type"), F.lit("multipolygon")))).otherwise(F.col("tags")))


def mend_members(relation: DataFrame, cut: DataFrame) -> DataFrame:
    """Members that name a way that was cut (cut: way_id, pieces in order, the first keeping the id) name all its pieces, in
    order and in the same role."""
    each = relation.select("relation_id", F.posexplode("members").alias("no", "m"))
    j = each.join(cut.select("way_id", "pieces"), (F.col("m.ref") == F.col("way_id")) & (F.col("m.type") == "way"), "left")
    ids = F.coalesce("pieces", F.array("m.ref"))
    j = j.select("relation_id", "no", F.col("m.type").alias("t"), F.col("m.role").alias("r"), F.posexplode(ids).alias("part", "ref"))
    again = j.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("no", "part", "t", "ref", "r"))).alias("s"))
    members = F.transform("s", lambda x: F.struct(x["t"].alias("type"), x["ref"].alias("ref"), x["r"].alias("role")))
    return relation.join(again.select("relation_id", members.alias("_m")), "relation_id", "left").withColumn("members", F.coalesce("_m", "members")).select(relation.columns)


def compound(state: dict[str, DataFrame], edits: list) -> dict[str, DataFrame]:
    """Edits, functions of tables by name, one after the other; the version before is what undoes them all."""
    for edit in edits:
        state = {**state, **edit(state)}
    return state


def latest(events: DataFrame, key: str) -> DataFrame:
    """The state after a log of edits (key, at, op, value): the last one counts, an undo takes back the one before it."""
    w = Window.partitionBy(key).orderBy("at")
    undone = F.lead("op").over(w) == "undo"
    kept = events.withColumn("_u", F.coalesce(undone, F.lit(False))).where("NOT _u AND op <> 'undo'")
    return kept.groupBy(key).agg(F.max_by("value", "at").alias("value"), F.count("*").alias("edits"))
