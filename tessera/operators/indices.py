"""Identifiers to matrix positions and back, and a registry of kept frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import Graph
from tessera.operators import matrices


def entity_rows(g: Graph) -> DataFrame:
    """(row, node_id, layer) of all entities, in order of id and layer."""
    return matrices.dense_rows(g.entities.select("node_id", "layer"), "row", "node_id", "layer")


def edge_columns(g: Graph) -> DataFrame:
    """(col, edge_id) of structural edges, in order of position and id."""
    rows = g.structural().select(F.coalesce("ord", F.lit(1 << 62)).alias("ord"), "edge_id")
    return matrices.dense_rows(rows, "col", "ord", "edge_id").select("col", "edge_id")


def to_rows(g: Graph, ids: DataFrame) -> DataFrame:
    return ids.join(entity_rows(g), "node_id")


def to_entities(g: Graph, rows: DataFrame) -> DataFrame:
    return rows.join(entity_rows(g), "row")


def to_columns(g: Graph, ids: DataFrame) -> DataFrame:
    return ids.join(edge_columns(g), "edge_id")


def to_edges(g: Graph, columns: DataFrame) -> DataFrame:
    return columns.join(edge_columns(g), "col")


def stats(g: Graph) -> dict[str, int]:
    kinds = {r.kind: r["count"] for r in g.entities.groupBy("kind").count().collect()}
    return {"nodes": kinds.get("node", 0), "edge_entities": kinds.get("edge_entity", 0), "entities": sum(kinds.values()), "edges": g.count_edges()}


class Kept:
    """Frames persisted under a name for one version of a graph; a newer version drops the old ones.

    They stay on the executors' disks and memory and can be computed again if one is lost.
    """

    BUILD: dict[str, Callable[[Graph], DataFrame]] = {
        "csr": lambda g: matrices.incidence(g).repartition("node_id"),
        "csc": lambda g: matrices.incidence(g).repartition("edge_id"),
        "adjacency": matrices.co_incidence,
        "supra": lambda g: __import__("tessera.operators.layers", fromlist=["x"]).supra_adjacency(g),
    }

    def __init__(self) -> None:
        self.held: dict[str, tuple[int, DataFrame]] = {}

    def get(self, g: Graph, name: str, build: Callable[[Graph], DataFrame] | None = None) -> DataFrame:
        if name in self.held and self.held[name][0] == g.version:
            return self.held[name][1]
        self.drop(name)
        df = (build or self.BUILD[name])(g).persist(StorageLevel.MEMORY_AND_DISK)
        self.held[name] = (g.version, df)
        return df

    def has(self, g: Graph, name: str) -> bool:
        return name in self.held and self.held[name][0] == g.version

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.held):
            if name in self.held:
                self.held.pop(name)[1].unpersist()

    def info(self) -> dict[str, dict]:
        return {n: {"version": v, "columns": df.columns, "level": str(df.storageLevel)} for n, (v, df) in self.held.items()}
