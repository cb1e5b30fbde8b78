"""The graph value: a schema of DataFrames and a small dictionary.

A Graph is never changed. Every operator returns a new one that shares the tables it left alone, so
a copy costs nothing and the plans of all tables stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import PLACEHOLDER

LAYER = "array<string>"
POLICY = "struct<var:string,threshold:double,scope:string,above:string,tie:string>"
SCHEMAS = {
    "entities": f"node_id string, layer {LAYER}, kind string, ord long",
    "edges": f"edge_id string, kind string, declared_directed boolean, weight double, explicit boolean, ml_kind string, ml_layers array<{LAYER}>, policy {POLICY}, ord long",
    "members": f"edge_id string, node_id string, layer {LAYER}, role byte, coef double, pos int",
    "node_attrs": "node_id string",
    "edge_attrs": "edge_id string",
    "slices": "slice_id string, ord long",
    "slice_nodes": "slice_id string, node_id string",
    "slice_edges": "slice_id string, edge_id string",
    "edge_slice_attrs": "slice_id string, edge_id string, weight double",
    "aspects": "aspect string, ord int",
    "elem_layers": "aspect string, label string",
    "layer_attrs": f"layer {LAYER}",
    "node_layer_attrs": f"node_id string, layer {LAYER}",
    "history": "version long, ts_utc timestamp, mono_ns long, op string, payload string",
    "snapshots": "label string, version long, domain string, id string",
}
KEYS = {
    "node_attrs": ("node_id",), "edge_attrs": ("edge_id",), "slices": ("slice_id",), "edge_slice_attrs": ("slice_id", "edge_id"),
    "aspects": ("aspect",), "elem_layers": ("aspect", "label"), "layer_attrs": ("layer",), "node_layer_attrs": ("node_id", "layer"),
}
# fixed values: attribute names that the tables use themselves
RESERVED = {
    "node_attrs": {"node_id"},
    "edge_attrs": {"edge_id", "source", "target", "weight", "edge_type", "directed", "slice", "slice_weight", "kind", "members", "head", "tail", "flexible"},
    "slices": {"slice_id"},
}
SOURCE, TARGET, MEMBER = 1, -1, 0
BINARY, HYPER, NODE_EDGE, STUB = "binary", "hyper", "node_edge", "placeholder"
DEFAULT_SLICE = "default"


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    tables: dict[str, DataFrame]
    directed: bool | None = None
    active_slice: str = DEFAULT_SLICE
    node_key: tuple[str, ...] = ()
    uns: dict[str, Any] = field(default_factory=dict)
    version: int = 0

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables[name]
        raise AttributeError(name)

    def having(self, **tables: DataFrame) -> Graph:
        """This graph with some tables replaced."""
        return replace(self, tables=self.tables | tables, version=self.version + 1)

    def but(self, **fields: Any) -> Graph:
        """This graph with some of its small fields replaced."""
        return replace(self, **fields, version=self.version + 1)

    @property
    def multilayer(self) -> bool:
        return not self.aspects.isEmpty()

    def nodes(self) -> DataFrame:
        """Distinct node ids with their first position."""
        return self.entities.where(F.col("kind") == "node").groupBy("node_id").agg(F.min("ord").alias("ord"))

    def structural(self) -> DataFrame:
        return self.edges.where(F.col("kind") != STUB)

    def count_nodes(self, supra: bool = False) -> int:
        nodes = self.entities.where(F.col("kind") == "node")
        return nodes.count() if supra else nodes.select("node_id").distinct().count()

    def count_edges(self) -> int:
        return self.structural().count()

    def declared(self) -> Column:
        """Declared direction of a row of edges, else the graph's, else directed."""
        return F.coalesce(F.col("declared_directed"), F.lit(self.directed), F.lit(True))

    def resolved(self) -> DataFrame:
        """edges with `is_directed`: a hyperedge is directed if it has a target side."""
        has_target = self.members.where(F.col("role") == TARGET).select("edge_id").distinct().withColumn("has_target", F.lit(True))
        edges = self.edges.join(has_target, "edge_id", "left")
        rule = F.when(F.col("kind") == HYPER, F.coalesce("has_target", F.lit(False))).otherwise(self.declared())
        return edges.withColumn("is_directed", rule).drop("has_target")

    def summary(self) -> dict[str, Any]:
        kinds = {r.kind: r["count"] for r in self.structural().groupBy("kind").count().collect()}
        return {"nodes": self.count_nodes(), "edges": sum(kinds.values()), "kinds": kinds, "slices": self.slices.count(), "directed": self.directed, "version": self.version}


def empty(spark: SparkSession, directed: bool | None = None, **uns: Any) -> Graph:
    # the filter tells the optimizer that there are no rows, so joins with them leave the plan
    tables = {name: spark.createDataFrame([], schema).where(F.lit(False)) for name, schema in SCHEMAS.items()}
    tables["slices"] = spark.createDataFrame([(DEFAULT_SLICE, 0)], SCHEMAS["slices"])
    return Graph(spark, tables, directed, uns=uns)


def flat_layer() -> Column:
    return F.array(F.lit(PLACEHOLDER))
