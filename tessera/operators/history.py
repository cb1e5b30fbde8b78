"""Mutation log, snapshots, and differences; structural checks."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import BINARY, NODE_EDGE, STUB, TARGET, Graph

DOMAINS = ("nodes", "edges", "slices")


def log(g: Graph, op: str, **payload) -> Graph:
    """This graph with one more event."""
    row = g.spark.createDataFrame([(g.version + 1, datetime.now(UTC), time.monotonic_ns(), op, json.dumps(payload, sort_keys=True, default=str))], g.history.schema)
    return g.having(history=g.history.unionByName(row))


def ids(g: Graph) -> DataFrame:
    """(domain, id) of everything that a snapshot holds; bare node ids."""
    rows = [g.nodes().select(F.lit("nodes").alias("domain"), F.col("node_id").alias("id")), g.structural().select(F.lit("edges"), "edge_id"), g.slices.select(F.lit("slices"), "slice_id")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).distinct()


def snapshot(g: Graph, label: str) -> Graph:
    rows = ids(g).select(F.lit(label).alias("label"), F.lit(g.version).cast("long").alias("version"), "domain", "id")
    return g.having(snapshots=g.snapshots.where(F.col("label") != label).unionByName(rows))


def snapshots(g: Graph) -> DataFrame:
    """(label, version, n): the snapshots that a graph holds."""
    return g.snapshots.groupBy("label").agg(F.max("version").alias("version"), F.count("*").alias("n"))


def diff(g: Graph, a: str, b: str | None = None) -> DataFrame:
    """(domain, id, change): what came and went from one snapshot to another, or to the graph as it is."""
    old = g.snapshots.where(F.col("label") == a).select("domain", "id")
    new = ids(g) if b is None else g.snapshots.where(F.col("label") == b).select("domain", "id")
    return new.subtract(old).withColumn("change", F.lit("added")).unionAll(old.subtract(new).withColumn("change", F.lit("removed")))


def export(g: Graph, path: str, fmt: str = "parquet") -> None:
    """The log as parquet, json (lines) or csv."""
    g.history.orderBy("version").write.mode("overwrite").format({"ndjson": "json"}.get(fmt, fmt)).save(path)


def violations(g: Graph) -> DataFrame:
    """(rule, key) of broken invariants; none in a sound graph."""
    entities = g.entities.select("node_id", "layer")
    edges = g.edges.select("edge_id")
    found = [
        ("member_without_edge", g.members.join(edges, "edge_id", "left_anti").select("edge_id")),
        ("member_without_entity", g.members.join(entities, ["node_id", "layer"], "left_anti").select("node_id")),
        ("edge_without_members", g.edges.where(F.col("kind") != STUB).join(g.members.select("edge_id"), "edge_id", "left_anti").select("edge_id")),
        ("twice_an_edge", g.edges.groupBy("edge_id").count().where("count > 1").select("edge_id")),
        ("twice_an_entity", g.entities.groupBy("node_id", "layer").count().where("count > 1").select("node_id")),
        ("two_sources", g.members.where(F.col("role") != TARGET).join(g.edges.where(F.col("kind").isin(BINARY, NODE_EDGE)).select("edge_id"), "edge_id", "left_semi").groupBy("edge_id").count().where("count > 1").select("edge_id")),
        ("slice_edge_without_edge", g.slice_edges.join(edges, "edge_id", "left_anti").select("edge_id")),
        ("slice_node_without_node", g.slice_nodes.join(entities.select("node_id").distinct(), "node_id", "left_anti").select("node_id")),
        ("slice_unknown", g.slice_edges.join(g.slices.select("slice_id"), "slice_id", "left_anti").select("slice_id")),
        ("weight_not_finite", g.edges.where(F.isnan("weight") | F.abs("weight").isin(float("inf"))).select("edge_id")),
    ]
    out = None
    for rule, rows in found:
        rows = rows.toDF("key").select(F.lit(rule).alias("rule"), "key")
        out = rows if out is None else out.unionAll(rows)
    return out
