"""Delivering what a reader built into a graph, and telling what a format can't hold.

A companion folder `<path>.sidecar` holds the parts of a graph that its format loses, bound to the graph by its structural hash.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import DEFAULT_SLICE, HYPER, KEYS, NODE_EDGE, Graph
from tessera.operators.algebra import remove_edges, structural_hash, union
from tessera.operators.build import upsert
from tessera.operators.build import with_slices

# fixed values: what a graph can carry
CAPABILITIES = ("nodes", "binary_edges", "directed", "weights", "parallel_edges", "hyperedges", "edge_entities", "coefficients", "node_attributes", "edge_attributes", "slices", "slice_membership", "contextual_attributes", "multilayer", "graph_attributes")
# what each format of this package holds
PLAIN = {"nodes", "binary_edges", "directed", "weights", "parallel_edges"}
HELD = {
    "native": set(CAPABILITIES), "ndjson": set(CAPABILITIES), "frames": set(CAPABILITIES),
    "csv": PLAIN | {"edge_attributes", "slices", "slice_membership"}, "sif": {"nodes", "binary_edges", "directed"},
    "graphml": PLAIN | {"hyperedges", "node_attributes", "edge_attributes"}, "gexf": PLAIN | {"hyperedges", "node_attributes", "edge_attributes"},
    "cx2": PLAIN | {"hyperedges", "node_attributes", "edge_attributes"}, "sbml": {"nodes", "hyperedges", "directed", "coefficients"},
}
CARRIED = ("edges", "members", "entities", "node_attrs", "edge_attrs", "slices", "slice_nodes", "slice_edges", "edge_slice_attrs", "aspects", "elem_layers", "layer_attrs", "node_layer_attrs")


class ImportConflict(ValueError):
    """Edges that are there already."""


class LossWarning(UserWarning):
    """A format doesn't hold all of a graph."""


def present(g: Graph) -> set[str]:
    """Capabilities that a graph makes use of."""
    kinds = {r.kind for r in g.structural().select("kind").distinct().collect()}
    out = {"nodes", "binary_edges", "directed", "weights"}
    probes = {
        "edge_attributes": len(g.edge_attrs.columns) > 1 and not g.edge_attrs.isEmpty(),
        "node_attributes": len(g.node_attrs.columns) > 1 and not g.node_attrs.isEmpty(),
        "hyperedges": HYPER in kinds, "edge_entities": NODE_EDGE in kinds,
        "coefficients": not g.edges.where("explicit").isEmpty(),
        "slices": not g.slices.where(F.col("slice_id") != DEFAULT_SLICE).isEmpty(),
        "slice_membership": not g.slice_edges.where(F.col("slice_id") != DEFAULT_SLICE).isEmpty(),
        "contextual_attributes": not g.edge_slice_attrs.isEmpty(),
        "multilayer": g.multilayer, "graph_attributes": bool(g.uns),
    }
    return out | {k for k, v in probes.items() if v}


def losses(g: Graph, fmt: str) -> list[str]:
    return sorted(present(g) - HELD[fmt])


def write_sidecar(g: Graph, path: str, fmt: str) -> list[str]:
    """Write what the format loses beside it; warns and returns what that is."""
    lost = losses(g, fmt)
    if lost:
        warnings.warn(f"{fmt} does not hold: {', '.join(lost)}", LossWarning, stacklevel=2)
        for name in CARRIED:
            g.tables[name].write.mode("overwrite").parquet(f"{path}.sidecar/{name}")
        note = json.dumps({"format": fmt, "lost": lost, "digest": structural_hash(g), "directed": g.directed, "uns": g.uns}, default=str)
        g.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.sidecar/note")
    return lost


def apply_sidecar(g: Graph, path: str, policy: str = "auto") -> Graph:
    """The graph of a reader with all that its format lost. Policies: auto, require, ignore."""
    if policy == "ignore":
        return g
    try:
        note = json.loads("".join(r.value for r in g.spark.read.text(f"{path}.sidecar/note").collect()))
    except Exception:
        if policy == "require":
            raise
        return g
    tables = {name: g.spark.read.parquet(f"{path}.sidecar/{name}") for name in CARRIED}
    whole = g.having(**tables).but(directed=note["directed"], uns=note["uns"])
    if structural_hash(whole) != note["digest"]:
        raise ValueError("the sidecar belongs to another graph")
    return whole


def deliver(built: Graph, into: Graph | None = None, slice: str | None = None, on_conflict: str = "error") -> Graph:
    """A reader's graph as it is, or merged into another; conflicts of edges: error, skip or replace. Entities are never overwritten."""
    if slice is not None:
        tag = F.lit(slice).alias("slice_id")
        built = built.having(
            slices=with_slices(built, built.spark.createDataFrame([(slice,)], "slice_id string")),
            slice_edges=built.slice_edges.unionByName(built.edges.select(tag, "edge_id")).distinct(),
            slice_nodes=built.slice_nodes.unionByName(built.entities.select(tag, "node_id")).distinct(),
        )
    if into is None:
        return built
    shared = built.edges.join(into.edges.select("edge_id"), "edge_id", "left_semi").select("edge_id")
    if on_conflict == "error":
        found = shared.limit(5).collect()
        if found:
            raise ImportConflict(f"edges exist: {[r.edge_id for r in found]}")
    elif on_conflict == "replace":
        into = remove_edges(into, shared, errors="ignore")
    elif on_conflict != "skip":
        raise ValueError(f"unknown policy: {on_conflict}")
    out = union(into, built)
    more = {t: upsert(built.tables[t], into.tables[t], KEYS[t]) for t in ("aspects", "elem_layers", "layer_attrs", "node_layer_attrs")}
    return out.having(**more)


def public_only(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("__")))
