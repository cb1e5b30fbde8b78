"""Wide tables of nodes, edges, slices, aspects and layers, and lazy filtered views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import HYPER, Graph
from tessera.operators.algebra import extract
from tessera.operators.attrs import effective_weight
from tessera.operators.matrices import incidence
from tessera.operators.query import edge_sides


def nodes_view(g: Graph) -> DataFrame:
    return g.nodes().select("node_id").join(g.node_attrs, "node_id", "left")


def edges_view(g: Graph, slice: str | None = None) -> DataFrame:
    """One row an edge: sides (joined by | for hyperedges), arrays of hyperedge members, direction, weights, attributes.

    With a slice its attributes come with the prefix slice_, and the effective weight is its own.
    """
    edges = g.resolved().where("kind <> 'placeholder'").join(edge_sides(g), "edge_id", "left")
    hyper = F.col("kind") == HYPER
    rows = edges.select(
        "edge_id", "kind", "ml_kind",
        F.array_join("sources", "|").alias("source"), F.array_join("targets", "|").alias("target"),
        F.when(hyper & F.col("is_directed"), F.col("sources")).alias("head"), F.when(hyper & F.col("is_directed"), F.col("targets")).alias("tail"),
        F.when(hyper & ~F.col("is_directed"), F.col("members")).alias("members"),
        F.col("is_directed").alias("directed"), F.col("weight").alias("global_weight"),
    )
    rows = rows.join(g.edge_attrs, "edge_id", "left").join(effective_weight(g, slice).withColumnRenamed("weight", "effective_weight"), "edge_id", "left")
    if slice is None:
        return rows
    own = g.edge_slice_attrs.where(F.col("slice_id") == slice).drop("slice_id")
    own = own.select("edge_id", *(F.col(c).alias(f"slice_{c}") for c in own.columns if c != "edge_id"))
    return rows.join(g.slice_edges.where(F.col("slice_id") == slice).select("edge_id"), "edge_id", "left_semi").join(own, "edge_id", "left")


def slices_view(g: Graph) -> DataFrame:
    return g.slices.drop("ord")


def aspects_view(g: Graph) -> DataFrame:
    labels = g.elem_layers.groupBy("aspect").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return g.aspects.join(labels, "aspect", "left")


def layers_view(g: Graph) -> DataFrame:
    """Layers with a column for each aspect, their attributes, and those of their labels with the aspect as prefix."""
    from tessera.operators.layers import all_layers

    names = [r.aspect for r in g.aspects.orderBy("ord", "aspect").collect()]
    rows = all_layers(g).select("layer", "id", *(F.element_at("layer", k + 1).alias(a) for k, a in enumerate(names)))
    rows = rows.join(g.layer_attrs, "layer", "left")
    extra = [c for c in g.elem_layers.columns if c not in ("aspect", "label")]
    for a in names if extra else ():
        own = g.elem_layers.where(F.col("aspect") == a).select(F.col("label").alias(a), *(F.col(c).alias(f"{a}__{c}") for c in extra))
        rows = rows.join(own, a, "left")
    return rows


def entity_kinds(g: Graph) -> DataFrame:
    return g.entities.select("node_id", "kind").distinct()


def chosen(df: DataFrame, condition: Column | Callable[[dict], bool], key: str) -> DataFrame:
    """Keys of the rows that a condition holds for."""
    if isinstance(condition, Column):
        return df.where(condition).select(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in rows if condition(r)], pa.string())], names=[key])

    return df.mapInArrow(run, f"{key} string")


@dataclass(frozen=True)
class View:
    """A lazy lens on a graph: filters are conditions on the node and edge tables, Python functions of a row (a dictionary; slower), sets of ids, or slices."""

    graph: Graph
    nodes: DataFrame | Column | Callable[[dict], bool] | None = None
    edges: DataFrame | Column | Callable[[dict], bool] | None = None
    slices: tuple[str, ...] = ()

    def node_ids(self) -> DataFrame:
        ids = self.graph.nodes().select("node_id")
        if isinstance(self.nodes, DataFrame):
            ids = ids.join(self.nodes.select("node_id").distinct(), "node_id", "left_semi")
        elif self.nodes is not None:
            ids = chosen(nodes_view(self.graph), self.nodes, "node_id")
        if self.slices:
            ids = ids.join(self.graph.slice_nodes.where(F.col("slice_id").isin(*self.slices)).select("node_id").distinct(), "node_id", "left_semi")
        return ids

    def edge_ids(self) -> DataFrame:
        """Edges that pass the filters and have no member outside."""
        ids = self.graph.structural().select("edge_id")
        if isinstance(self.edges, DataFrame):
            ids = ids.join(self.edges.select("edge_id").distinct(), "edge_id", "left_semi")
        elif self.edges is not None:
            ids = chosen(edges_view(self.graph), self.edges, "edge_id")
        if self.slices:
            ids = ids.join(self.graph.slice_edges.where(F.col("slice_id").isin(*self.slices)).select("edge_id").distinct(), "edge_id", "left_semi")
        if self.nodes is not None or self.slices:
            outside = self.graph.members.join(self.node_ids(), "node_id", "left_anti").select("edge_id").distinct()
            ids = ids.join(outside, "edge_id", "left_anti")
        return ids

    def obs(self) -> DataFrame:
        return nodes_view(self.graph).join(self.node_ids(), "node_id", "left_semi")

    def var(self) -> DataFrame:
        return edges_view(self.graph).join(self.edge_ids(), "edge_id", "left_semi")

    def incidence(self) -> DataFrame:
        return incidence(self.graph).join(self.edge_ids(), "edge_id", "left_semi").join(self.node_ids(), "node_id", "left_semi")

    def subview(self, nodes=None, edges=None, slices: tuple[str, ...] = ()) -> View:
        """Both views' filters together."""
        out = View(self.graph, nodes, edges, slices)
        return View(self.graph, self.node_ids().join(out.node_ids(), "node_id", "left_semi"), self.edge_ids().join(out.edge_ids(), "edge_id", "left_semi"))

    def materialize(self) -> Graph:
        return extract(self.graph, self.node_ids(), self.edge_ids())
