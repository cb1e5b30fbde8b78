"""The native format: a folder with a Parquet table for each table of the graph, and a manifest.

Reading is lazy: a query scans the tables and columns that it uses.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tessera.model import SCHEMAS, Graph

FORMAT = "tessera-graph"
VERSION = 1


def write(g: Graph, path: str, compression: str = "zstd") -> None:
    """Tables without rows are written too: their schema may hold attributes."""
    for name in SCHEMAS:
        g.tables[name].write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
    manifest = {"format": FORMAT, "version": VERSION, "directed": g.directed, "active_slice": g.active_slice, "node_key": list(g.node_key), "uns": g.uns, "graph_version": g.version}
    g.spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> Graph:
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest.get("format") != FORMAT or manifest.get("version", 0) > VERSION:
        raise ValueError(f"not a graph of this format: {manifest.get('format')} {manifest.get('version')}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in SCHEMAS}
    return Graph(spark, tables, manifest["directed"], manifest["active_slice"], tuple(manifest["node_key"]), manifest["uns"], manifest["graph_version"])
