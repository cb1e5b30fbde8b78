"""Graphs from and to dictionaries of frames, feature tables for learning, and stoichiometric matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import DEFAULT_SLICE, HYPER, Graph, empty
from tessera.operators import query
from tessera.operators.build import add_edges, add_nodes, upsert
from tessera.operators.project import plain
from tessera.operators.build import with_slices


def to_frames(g: Graph, explode: bool = False, public: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, hyperedges (wide, or a row a member), slices and slice_weights."""
    from tessera.operators.attrs import public as strip

    keep = strip if public else (lambda df: df)
    pairs = query.edge_pairs(g).where(F.col("kind") != HYPER).join(g.edges.select("edge_id", "weight"), "edge_id")
    out = {
        "nodes": keep(g.nodes().select("node_id").join(g.node_attrs, "node_id", "left")),
        "edges": keep(pairs.select("edge_id", "source", "target", "weight", F.col("is_directed").alias("directed"), F.col("kind").alias("edge_type")).join(g.edge_attrs, "edge_id", "left")),
        "slices": g.slice_edges.where(F.col("slice_id") != DEFAULT_SLICE),
        "slice_weights": g.edge_slice_attrs.where("weight is not null").select("slice_id", "edge_id", "weight"),
    }
    if explode:
        role = F.when(F.col("role") == 1, "head").when(F.col("role") == -1, "tail").otherwise("member")
        out["hyperedges"] = g.members.join(g.resolved().where(F.col("kind") == HYPER).select("edge_id", F.col("is_directed").alias("directed"), "weight"), "edge_id").select("edge_id", "node_id", role.alias("role"), "weight", "directed")
    else:
        out["hyperedges"] = query.hyperedges(g)
    return out


def from_frames(spark: SparkSession, nodes=None, edges=None, hyperedges=None, slices=None, slice_weights=None, directed: bool | None = None) -> Graph:
    g = empty(spark, directed)
    if nodes is not None:
        g = add_nodes(g, nodes)
    if edges is not None:
        g = add_edges(g, edges.drop("edge_type"))
    if hyperedges is not None:
        if "role" in hyperedges.columns:
            side = lambda r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("node_id"))))
            wide = hyperedges.groupBy("edge_id").agg(side("head").alias("head"), side("tail").alias("tail"), side("member").alias("members"), F.first("weight").alias("weight"))
            hyperedges = wide.select("edge_id", "weight", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("head", "tail", "members")))
        g = add_edges(g, hyperedges.drop("directed"))
    if slices is not None:
        ends = slices.join(g.members.select("edge_id", "node_id"), "edge_id").select("slice_id", "node_id")
        g = g.having(slices=with_slices(g, slices.select("slice_id")), slice_edges=g.slice_edges.unionByName(slices.select("slice_id", "edge_id")).distinct(), slice_nodes=g.slice_nodes.unionByName(ends).distinct())
    if slice_weights is not None:
        g = g.having(edge_slice_attrs=upsert(g.edge_slice_attrs, slice_weights, ("slice_id", "edge_id")))
    return g


def features(g: Graph, node_columns: dict[str, list[str]], hyperedge_mode: str = "reify") -> dict[str, DataFrame]:
    """Tables for learning on mixed graphs: nodes numbered within their `kind` with numeric features (nulls and NaN 0), edges by kinds of their ends."""
    from tessera.operators.matrices import dense_rows

    kinds = g.node_attrs.select("node_id", F.coalesce("kind", F.lit("node")).alias("kind")) if "kind" in g.node_attrs.columns else g.nodes().select("node_id", F.lit("node").alias("kind"))
    if hyperedge_mode == "reify":
        kinds = kinds.unionByName(g.edges.where(F.col("kind") == HYPER).select(F.concat(F.lit("he::"), "edge_id").alias("node_id"), F.lit("hypernode").alias("kind")))
    rows = dense_rows(kinds, "_r", "kind", "node_id")
    first = rows.groupBy("kind").agg(F.min("_r").alias("_b"))
    numbered = rows.join(F.broadcast(first), "kind").select("node_id", "kind", (F.col("_r") - F.col("_b")).alias("index"))
    values = {c for columns in node_columns.values() for c in columns}
    cell = lambda c: F.when(F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    nodes = numbered.join(g.node_attrs.select("node_id", *(cell(c).alias(c) for c in sorted(values))), "node_id", "left").fillna(0.0)
    ends = lambda side: numbered.select(F.col("node_id").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("index").alias(f"{side}_index"))
    arcs = plain(g, hyperedge_mode).join(ends("source"), "source").join(ends("target"), "target")
    return {"nodes": nodes, "edges": arcs.select("source_kind", "target_kind", "source_index", "target_index", "weight", "edge_id")}


def from_stoichiometry(spark: SparkSession, cells: DataFrame, reactions: DataFrame | None = None) -> Graph:
    """Hyperedges of a matrix (species, reaction, value): made above 0, used up below; empty columns are left out."""
    held = cells.where("value <> 0").groupBy(F.col("reaction").alias("edge_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "value")))).alias("coefs"), (F.count_distinct(F.col("value") > 0) == 1).alias("is_boundary"))
    g = add_edges(empty(spark, True), held)
    return g if reactions is None else g.having(edge_attrs=upsert(g.edge_attrs, reactions.withColumnRenamed("reaction", "edge_id").join(held.select("edge_id"), "edge_id", "left_semi"), ("edge_id",)))
