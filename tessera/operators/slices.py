"""Slices: named overlays of nodes and edges, their set algebra and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import member_key
from tessera.model import DEFAULT_SLICE, HYPER, Graph
from tessera.operators.build import upsert

ID = {"slice_nodes": "node_id", "slice_edges": "edge_id"}


def add(g: Graph, slice_id: str, **attrs) -> Graph:
    """A new empty slice; one of that name is an error."""
    if g.slices.where(F.col("slice_id") == slice_id).limit(1).count():
        raise ValueError(f"slice exists: {slice_id}")
    row = g.spark.range(1).select(F.lit(slice_id).alias("slice_id"), *(F.lit(v).alias(k) for k, v in attrs.items()))
    return g.having(slices=upsert(g.slices, row, ("slice_id",)))


def remove(g: Graph, slice_id: str) -> Graph:
    """Without a slice and what hangs on it; the default one is protected, the active one falls back to it."""
    if slice_id == DEFAULT_SLICE:
        raise ValueError("the default slice can't be removed")
    names = ("slices", "slice_nodes", "slice_edges", "edge_slice_attrs")
    out = g.having(**{t: g.tables[t].where(F.col("slice_id") != slice_id) for t in names})
    return out.but(active_slice=DEFAULT_SLICE) if g.active_slice == slice_id else out


def add_edges(g: Graph, rows: DataFrame, with_nodes: bool = True) -> Graph:
    """Attach edges (slice_id, edge_id) that exist, and their nodes."""
    rows = rows.select("slice_id", "edge_id").join(g.edges.select("edge_id"), "edge_id", "left_semi").select("slice_id", "edge_id").distinct()
    out = {"slice_edges": g.slice_edges.unionByName(rows).distinct()}
    if with_nodes:
        nodes = rows.join(g.members.select("edge_id", "node_id"), "edge_id").select("slice_id", "node_id")
        out["slice_nodes"] = g.slice_nodes.unionByName(nodes).distinct()
    return g.having(**out)


def add_nodes(g: Graph, rows: DataFrame) -> Graph:
    rows = rows.select("slice_id", "node_id").join(g.entities.select("node_id").distinct(), "node_id", "left_semi").select("slice_id", "node_id")
    return g.having(slice_nodes=g.slice_nodes.unionByName(rows).distinct())


def union(g: Graph, slice_ids: list[str], table: str = "slice_edges") -> DataFrame:
    """Members of any of the slices; unknown ones are ignored."""
    return g.tables[table].where(F.col("slice_id").isin(*slice_ids)).select(ID[table]).distinct()


def intersect(g: Graph, slice_ids: list[str], table: str = "slice_edges") -> DataFrame:
    """Members of all of the slices; none of an unknown or of no slice."""
    wanted = list(dict.fromkeys(slice_ids))
    rows = g.tables[table].where(F.col("slice_id").isin(*wanted)).distinct()
    return rows.groupBy(ID[table]).agg(F.count("*").alias("n")).where(F.col("n") == max(1, len(wanted))).select(ID[table])


def difference(g: Graph, a: str, b: str, table: str = "slice_edges") -> DataFrame:
    """Members of a that aren't in b; KeyError if one is unknown."""
    known = {r.slice_id for r in g.slices.where(F.col("slice_id").isin(a, b)).select("slice_id").collect()}
    if {a, b} - known:
        raise KeyError(f"unknown slices: {sorted({a, b} - known)}")
    rows = g.tables[table]
    return rows.where(F.col("slice_id") == a).select(ID[table]).distinct().join(rows.where(F.col("slice_id") == b), ID[table], "left_anti")


def create(g: Graph, name: str, nodes: DataFrame, edges: DataFrame, **attrs) -> Graph:
    """A slice of computed members."""
    g = add(g, name, **attrs)
    tag = F.lit(name).alias("slice_id")
    return g.having(slice_nodes=g.slice_nodes.unionByName(nodes.select(tag, "node_id")).distinct(), slice_edges=g.slice_edges.unionByName(edges.select(tag, "edge_id")).distinct())


def aggregate(g: Graph, sources: list[str], target: str, method: str = "union", **attrs) -> Graph:
    """Union or intersection of slices as a slice."""
    f = {"union": union, "intersection": intersect}[method]
    return create(g, target, f(g, sources, "slice_nodes"), f(g, sources, "slice_edges"), **attrs)


def stats(g: Graph, include_default: bool = True) -> DataFrame:
    """(slice_id, nodes, edges)."""
    out = g.slices.select("slice_id")
    for table, name in (("slice_nodes", "nodes"), ("slice_edges", "edges")):
        out = out.join(g.tables[table].groupBy("slice_id").agg(F.count("*").alias(name)), "slice_id", "left")
    out = out.select("slice_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))
    return out if include_default else out.where(F.col("slice_id") != DEFAULT_SLICE)


def presence(g: Graph, table: str = "slice_edges", include_default: bool = False) -> DataFrame:
    """(id, slices): of every member the slices that hold it."""
    rows = g.tables[table] if include_default else g.tables[table].where(F.col("slice_id") != DEFAULT_SLICE)
    return rows.groupBy(ID[table]).agg(F.array_sort(F.collect_set("slice_id")).alias("slices"))


def hyperedge_presence(g: Graph, members: list[str] | None = None, head: list[str] | None = None, tail: list[str] | None = None, include_default: bool = False) -> DataFrame:
    """(slice_id, edge_id) of hyperedges with exactly these members, or these sides."""
    from tessera.operators.query import hyperedges

    key = lambda xs: "\x01".join(sorted(set(xs)))
    rows = hyperedges(g)
    if members is not None:
        rows = rows.where(~F.col("directed") & (member_key(F.col("members")) == key(members)))
    else:
        rows = rows.where(F.col("directed") & (member_key(F.col("head")) == key(head or [])) & (member_key(F.col("tail")) == key(tail or [])))
    out = g.slice_edges.join(rows.select("edge_id"), "edge_id")
    return (out if include_default else out.where(F.col("slice_id") != DEFAULT_SLICE)).select("slice_id", "edge_id")


def conserved_edges(g: Graph, min_slices: int = 2, include_default: bool = False) -> DataFrame:
    """(edge_id, n) of edges in so many slices at least."""
    rows = g.slice_edges if include_default else g.slice_edges.where(F.col("slice_id") != DEFAULT_SLICE)
    return rows.groupBy("edge_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_slices)


def specific_edges(g: Graph, slice_id: str | None = None) -> DataFrame:
    """(slice_id, edge_id) of edges in one slice only; the default one counts as a slice."""
    rows = g.slice_edges.groupBy("edge_id").agg(F.count("*").alias("n"), F.min("slice_id").alias("slice_id")).where("n = 1")
    return (rows if slice_id is None else rows.where(F.col("slice_id") == slice_id)).select("slice_id", "edge_id")


def temporal_dynamics(g: Graph, ordered: list[str], table: str = "slice_edges") -> DataFrame:
    """(step, from_slice, to_slice, added, removed, net_change) between slices that follow each other.

    Every member looks at its next and previous slice in the list, so all steps take one shuffle by member.
    """
    if len(ordered) < 2:
        raise ValueError("two slices at least")
    place = F.element_at(F.create_map(*(x for k, s in enumerate(ordered) for x in (F.lit(s), F.lit(k)))), F.col("slice_id"))
    rows = g.tables[table].where(F.col("slice_id").isin(*ordered)).select(F.col(ID[table]).alias("id"), place.alias("k")).distinct()
    window = Window.partitionBy("id").orderBy("k")
    near = rows.select("k", F.lag("k").over(window).alias("before"), F.lead("k").over(window).alias("after"))
    last = len(ordered) - 1
    added = near.where((F.col("k") > 0) & ~F.coalesce(F.col("before") == F.col("k") - 1, F.lit(False))).select((F.col("k") - 1).alias("step"), F.lit(1).alias("a"), F.lit(0).alias("r"))
    removed = near.where((F.col("k") < last) & ~F.coalesce(F.col("after") == F.col("k") + 1, F.lit(False))).select(F.col("k").alias("step"), F.lit(0).alias("a"), F.lit(1).alias("r"))
    steps = g.spark.createDataFrame([(k, ordered[k], ordered[k + 1]) for k in range(last)], "step int, from_slice string, to_slice string")
    sums = added.unionAll(removed).groupBy("step").agg(F.sum("a").alias("added"), F.sum("r").alias("removed"))
    out = steps.join(sums, "step", "left").select("step", "from_slice", "to_slice", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))
    return out.withColumn("net_change", F.col("added") - F.col("removed"))


def global_count(g: Graph, kind: str) -> int:
    """Distinct members over all slices: nodes, edges or entities."""
    if kind == "edges":
        return g.slice_edges.select("edge_id").distinct().count()
    nodes = g.slice_nodes.select("node_id")
    if kind == "entities":
        nodes = nodes.union(g.slice_edges.select("edge_id"))
    return nodes.distinct().count()


def hyper_only(g: Graph) -> DataFrame:
    return g.slice_edges.join(g.edges.where(F.col("kind") == HYPER).select("edge_id"), "edge_id", "left_semi")
