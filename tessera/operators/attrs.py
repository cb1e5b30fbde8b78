"""Attributes: per node, per edge, and in six contexts; effective weights; flexible direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import known
from tessera.model import KEYS, TARGET, Graph
from tessera.operators.build import check_names, upsert

CONTEXTS = ("slices", "edge_slice_attrs", "node_layer_attrs", "aspects", "layer_attrs", "elem_layers")


def set_attrs(g: Graph, table: str, rows: DataFrame) -> Graph:
    """Upsert attribute rows of a table by its key; a null leaves the old value. Node and edge writes re-evaluate flexible edges."""
    keys = KEYS[table]
    names = [c for c in rows.columns if c not in keys]
    check_names(table, [c for c in names if not (table == "edge_slice_attrs" and c == "weight")])
    if table == "edge_slice_attrs" and "weight" in names:
        rows = rows.withColumn("weight", F.col("weight").cast("double"))
    out = g.having(**{table: upsert(g.tables[table], rows.dropDuplicates(list(keys)), keys)})
    return flexible(out) if table in ("node_attrs", "edge_attrs") else out


def get_attr(g: Graph, table: str, name: str, default=None) -> DataFrame:
    """Keys and one attribute, with a default for nulls and for an unknown name."""
    df, keys = g.tables[table], KEYS[table]
    value = F.col(name) if name in df.columns else F.lit(None)
    return df.select(*keys, (F.coalesce(value, F.lit(default)) if default is not None else value).alias(name))


def edges_by_attr(g: Graph, name: str, value) -> DataFrame:
    return g.edge_attrs.where(F.col(name) == F.lit(value)).select("edge_id")


def effective_weight(g: Graph, slice: str | None = None, *keep: str) -> DataFrame:
    """(edge_id, weight): the slice's override unless null or NaN, else the base weight, else 1; and columns of edges to keep."""
    over = g.edge_slice_attrs.where(F.col("slice_id") == F.lit(slice or g.active_slice)).select("edge_id", known(F.col("weight")).alias("over"))
    return g.edges.join(over, "edge_id", "left").select("edge_id", F.coalesce("over", known(F.col("weight")), F.lit(1.0)).alias("weight"), *keep)


def audit(g: Graph) -> DataFrame:
    """(table, key): attribute rows whose node, edge or slice isn't there."""
    nodes, edges, slices = g.entities.select("node_id").distinct(), g.edges.select("edge_id"), g.slices.select("slice_id")
    found = [
        g.node_attrs.join(nodes, "node_id", "left_anti").select(F.lit("node_attrs").alias("table"), F.col("node_id").alias("key")),
        g.edge_attrs.join(edges, "edge_id", "left_anti").select(F.lit("edge_attrs"), "edge_id"),
        g.edge_slice_attrs.join(edges, "edge_id", "left_anti").select(F.lit("edge_slice_attrs"), "edge_id"),
        g.edge_slice_attrs.join(slices, "slice_id", "left_anti").select(F.lit("edge_slice_attrs"), "slice_id"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def flexible(g: Graph) -> Graph:
    """Re-evaluate edges with a direction policy and write their coefficients.

    Scope `edge` compares the edge's attribute with the threshold, any other the source's less the
    target's attribute with 0. Beyond it the edge runs as `above` says, below the other way; a tie
    keeps what is there, or makes the edge undirected, or takes the direction it names.
    """
    policies = g.edges.where("policy is not null and policy.var is not null")
    names = [c for c in (*g.node_attrs.columns, *g.edge_attrs.columns) if c not in ("node_id", "edge_id")]
    if not names:
        return g
    chosen = [r[0] for r in policies.select("policy.var").distinct().limit(len(names) + 1).collect()]  # at most one a column
    if not chosen:
        return g

    def values(table: DataFrame, key: str) -> DataFrame:
        have = [c for c in chosen if c in table.columns]
        if not have:
            return g.spark.createDataFrame([], f"{key} string, var string, value double")
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("var"), F.col(c).cast("double").alias("value")) for c in have)))
        return table.select(key, pairs.alias("x")).select(key, "x.var", "x.value")

    ends = g.members.groupBy("edge_id").agg(F.min(F.when(F.col("role") != TARGET, F.col("node_id"))).alias("s"), F.min(F.when(F.col("role") == TARGET, F.col("node_id"))).alias("t"))
    rows = policies.select("edge_id", "weight", "policy.*").join(ends, "edge_id")
    of_node, of_edge = values(g.node_attrs, "node_id"), values(g.edge_attrs, "edge_id")
    rows = rows.join(of_edge.select("edge_id", "var", F.col("value").alias("own")), ["edge_id", "var"], "left")
    for side in ("s", "t"):
        rows = rows.join(of_node.select(F.col("node_id").alias(side), "var", F.col("value").alias(f"of_{side}")), [side, "var"], "left")
    gap = F.when(F.col("scope") == "edge", F.col("own") - F.coalesce("threshold", F.lit(0.0))).otherwise(F.col("of_s") - F.col("of_t"))
    forward = F.coalesce(F.col("above"), F.lit("s->t")) == "s->t"
    tie = F.coalesce(F.col("tie"), F.lit("keep"))
    way = F.when(gap > 0, F.when(forward, 1).otherwise(-1)).when(gap < 0, F.when(forward, -1).otherwise(1)).when(gap == 0, F.when(tie == "undirected", 0).when(tie == "s->t", 1).when(tie != "keep", -1))
    decided = rows.select("edge_id", "weight", way.alias("way")).where("way is not null")
    at_source = F.col("role") != TARGET
    coef = F.when(F.col("way") == 0, F.col("weight")).when(at_source, F.col("way") * F.col("weight")).otherwise(-F.col("way") * F.col("weight"))
    members = g.members.join(decided, "edge_id", "left").withColumn("coef", F.when(F.col("way").isNotNull(), coef).otherwise(F.col("coef"))).select(*g.members.columns)
    edges = g.edges.join(decided.select("edge_id", F.lit(True).alias("hit")), "edge_id", "left").withColumn("explicit", F.coalesce("hit", "explicit")).select(*g.edges.columns)
    return g.having(members=members, edges=edges)


def public(df: DataFrame) -> DataFrame:
    """Without private columns (two leading underscores)."""
    return df.drop(*(c for c in df.columns if c.startswith("__")))
