"""Algorithms by name over a projection of a graph, with nodes given by id or by label."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import Graph
from tessera.operators import algorithms, project

# fixed values: attributes that may hold the label of a node, in order
LABELS = ("name", "label", "title", "slug", "external_id", "string_id")


class Projection:
    """Plain nodes and edges of a graph, and algorithms on them; results name nodes by their ids."""

    def __init__(self, g: Graph, directed: bool = True, hyperedge_mode: str = "expand", slice: str | None = None, simple: bool = False, aggregates: dict | None = None):
        self.graph, self.directed = g, directed
        for loss in project.losses(g, hyperedge_mode):
            warnings.warn(loss, UserWarning, stacklevel=2)
        edges = project.plain(g, hyperedge_mode, slice)
        if directed:  # an undirected edge is an arc either way
            back = edges.where(~F.col("directed") & (F.col("source") != F.col("target")))
            edges = edges.unionByName(back.withColumns({"source": F.col("target"), "target": F.col("source")}))
        self.edges = project.collapse(edges, aggregates) if simple else edges
        self.nodes = g.nodes().select("node_id") if slice is None else g.slice_nodes.where(F.col("slice_id") == slice).select("node_id").distinct()

    def peek_nodes(self, k: int = 10) -> list[str]:
        return [r.node_id for r in self.nodes.orderBy("node_id").limit(k).collect()]

    def ids_of(self, labels: list[str], field: str | None = None) -> DataFrame:
        """(label, node_id): an id as it is, else by a label attribute."""
        wanted = self.graph.spark.createDataFrame([(x,) for x in labels], "label string")
        field = field or next((c for c in LABELS if c in self.graph.node_attrs.columns), None)
        out = wanted.join(self.nodes.withColumn("label", F.col("node_id")), "label")
        if field:
            named = self.graph.node_attrs.select(F.col(field).alias("label"), "node_id").join(self.nodes, "node_id", "left_semi")
            out = out.unionByName(wanted.join(out.select("label"), "label", "left_anti").join(named, "label").select("label", "node_id"))
        return out

    def node(self, label: str) -> str:
        """The node of an id or label; KeyError without one."""
        row = self.ids_of([label]).first()
        if row is None:
            raise KeyError(label)
        return row.node_id

    def run(self, name: str, *args, **kwargs) -> DataFrame:
        """An algorithm of ALGORITHMS; unknown names raise AttributeError."""
        if name not in ALGORITHMS:
            raise AttributeError(f"no algorithm {name}; there are {', '.join(sorted(ALGORITHMS))}")
        return ALGORITHMS[name](self, *args, **kwargs)


ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "connected_components": lambda p: algorithms.components(p.edges, p.nodes),
    "pagerank": lambda p, **kw: algorithms.pagerank(p.edges, p.nodes, **kw),
    "bfs": lambda p, *starts, **kw: algorithms.bfs_levels(p.edges, p.ids_of(list(starts)).select("node_id"), p.directed, **kw),
    "shortest_path_length": lambda p, start, **kw: algorithms.shortest_paths(p.edges if p.directed else p.edges.unionByName(p.edges.withColumns({"source": F.col("target"), "target": F.col("source")})), p.node(start), **kw),
    "triangles": lambda p: algorithms.triangles(p.edges),
    "degree_centrality": lambda p: algorithms.degree_centrality(p.edges, p.nodes),
    "in_degree": lambda p: p.edges.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("degree")),
    "out_degree": lambda p: p.edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("degree")),
}
