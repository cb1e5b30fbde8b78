"""Projections to plain graphs: hyperedges skipped, expanded or reified; parallel edges collapsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import HYPER, TARGET, Graph
from tessera.operators.attrs import effective_weight
from tessera.operators.query import edge_pairs

# fixed values: how columns of parallel edges are put together unless told otherwise
COLLAPSE = {"capacity": "sum", "weight": "min"}


def plain(g: Graph, hyperedge_mode: str = "expand", slice: str | None = None) -> DataFrame:
    """(source, target, edge_id, weight, directed): edges of a plain graph.

    skip drops hyperedges; expand gives an arc for every source and target, and one for every pair of an undirected
    hyperedge's members; reify puts a node he::<id> between tail and head.
    """
    if hyperedge_mode not in ("skip", "expand", "reify"):
        raise ValueError(f"unknown mode: {hyperedge_mode}")
    weights = effective_weight(g, slice)
    two = edge_pairs(g)
    out = two.where(F.col("kind") != HYPER)
    arcs = None
    if hyperedge_mode == "expand":
        hyper = g.resolved().where((F.col("kind") == HYPER) & ~F.col("is_directed")).select("edge_id")
        inner = g.members.join(hyper, "edge_id", "left_semi").select("edge_id", "node_id").distinct()
        clique = inner.select("edge_id", F.col("node_id").alias("source")).join(inner.select("edge_id", F.col("node_id").alias("target")), "edge_id").where("source < target")
        out = two.unionByName(clique.select("edge_id", "source", "target", F.lit(HYPER).alias("kind"), F.lit(False).alias("is_directed")))
    elif hyperedge_mode == "reify":
        node = F.concat(F.lit("he::"), F.col("edge_id"))
        # a hyperedge is directed if it has a target: members are dealt and sorted by edge once for that, the join and the order of rows
        own = Window.partitionBy("edge_id").orderBy("node_id", "role").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = g.members.select("edge_id", "node_id", "role", F.max(F.col("role") == TARGET).over(own).alias("is_directed"))
        ends = ends.join(effective_weight(g, slice, "kind").where(F.col("kind") == HYPER).drop("kind"), "edge_id")
        into = (F.col("role") == TARGET) | ~F.col("is_directed")
        arcs = ends.select(F.when(into, F.col("node_id")).otherwise(node).alias("source"), F.when(into, node).otherwise(F.col("node_id")).alias("target"), "edge_id", "weight", F.col("is_directed").alias("directed"))
    out = out.join(weights, "edge_id").select("source", "target", "edge_id", "weight", F.col("is_directed").alias("directed"))
    if arcs is not None:
        out = out.unionByName(arcs)
    if slice is not None:
        out = out.join(g.slice_edges.where(F.col("slice_id") == slice).select("edge_id"), "edge_id", "left_semi")
    return out


def adjacent(g: Graph) -> DataFrame:
    """(source, target) of every arc of plain(g): one grouping of the members, without weights and directions."""
    side = lambda role: F.collect_set(F.when(role, F.col("node_id")))
    sides = g.members.groupBy("edge_id").agg(side(F.col("role") != TARGET).alias("s"), side(F.col("role") == TARGET).alias("t"))
    clique = (F.col("kind") == HYPER) & (F.size("t") == 0)
    rows = sides.join(g.edges.select("edge_id", "kind"), "edge_id").select("s", F.when(clique, F.col("s")).otherwise(F.col("t")).alias("t"), clique.alias("clique"))
    pairs = rows.select(F.explode("s").alias("source"), "t", "clique").select("source", F.explode("t").alias("target"), "clique")
    return pairs.where(~F.col("clique") | (F.col("source") < F.col("target"))).select("source", "target")


def collapse(edges: DataFrame, how: dict[str, str | Column] | None = None, order: str = "edge_id") -> DataFrame:
    """One row for each source and target; columns are summed, or their least, largest, mean or first taken."""
    rule = COLLAPSE | (how or {})
    named = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.mean}
    columns = [c for c in edges.columns if c not in ("source", "target", order)]
    aggregates = []
    for c in columns:
        f = rule.get(c, "first")
        aggregates.append((f if isinstance(f, Column) else named[f](c) if f in named else F.min_by(c, order)).alias(c))
    return edges.groupBy("source", "target").agg(F.count("*").alias("n_parallel"), *aggregates)


def losses(g: Graph, hyperedge_mode: str) -> list[str]:
    """What a projection to a plain graph gives up."""
    kinds = {r.kind: r["count"] for r in g.structural().groupBy("kind").count().collect()}
    out = []
    if kinds.get(HYPER):
        out.append(f"{kinds[HYPER]} hyperedges are {'dropped' if hyperedge_mode == 'skip' else hyperedge_mode + 'd' if hyperedge_mode == 'expande' else 'turned into plain edges'}")
    if g.multilayer:
        out.append("layers are flattened")
    if g.slices.count() > 1:
        out.append("slices are not kept")
    return out
