"""Streams of edges: incidence kept up by micro-batches, and events as a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "version long, ts_utc timestamp, mono_ns long, op string, payload string"


def event_log(events: DataFrame) -> DataFrame:
    """Events as rows of the history table; works on tables and on streams."""
    payload = F.to_json(F.struct("user_id", "value", "props"))
    return events.select(F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("ts_utc"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mono_ns"), F.col("event_type").alias("op"), payload.alias("payload"))


def incidence_of_lines(lines: DataFrame) -> DataFrame:
    """(node_id, edge_id, value): signed cells of rows (edge_id, source, target, quantity); deltas of it add up."""
    cells = F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.col("quantity").alias("v")), F.struct(F.col("target").alias("node_id"), (-F.col("quantity")).alias("v"))))
    return lines.select("edge_id", cells.alias("x")).groupBy("x.node_id", "edge_id").agg(F.sum("x.v").alias("value"))


class IncidenceSink:
    """foreachBatch target: appends the delta of every micro-batch once, under its number, so that a batch that is repeated replaces itself."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        incidence_of_lines(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def current(self, spark) -> DataFrame:
        held = spark.read.parquet(self.path)
        return held.groupBy("node_id", "edge_id").agg(F.sum("value").alias("value")).where(F.abs("value") > 1e-12)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mutations per kind and window of event time; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
