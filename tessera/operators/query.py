"""Questions about structure, asked for whole sets of nodes or edges at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import HYPER, MEMBER, SOURCE, STUB, TARGET, Graph
from tessera.operators.attrs import effective_weight


def edge_sides(g: Graph) -> DataFrame:
    """(edge_id, sources, targets, members): sorted sets; every entry that is no target counts as source."""
    side = lambda role: F.array_sort(F.collect_set(F.when(role, F.col("node_id"))))
    return g.members.groupBy("edge_id").agg(side(F.col("role") != TARGET).alias("sources"), side(F.col("role") == TARGET).alias("targets"), F.array_sort(F.collect_set("node_id")).alias("members"))


def edge_list(g: Graph, slice: str | None = None) -> DataFrame:
    """(source, target, edge_id, weight) of two-sided edges that are no hyperedges, with effective weights."""
    rows = edge_pairs(g).where(F.col("kind") != HYPER).select("source", "target", "edge_id")
    return rows.join(effective_weight(g, slice or g.active_slice), "edge_id").select("source", "target", "edge_id", "weight")


def edge_pairs(g: Graph) -> DataFrame:
    """(edge_id, source, target, kind, is_directed) for each source and target of an edge."""
    side = lambda role: F.collect_set(F.when(role, F.col("node_id")))
    sides = g.members.groupBy("edge_id").agg(side(F.col("role") != TARGET).alias("s"), side(F.col("role") == TARGET).alias("t"))
    edges = g.edges.select("edge_id", "kind", ((F.col("kind") == HYPER) | g.declared()).alias("is_directed"))  # a hyperedge with a target is directed
    both = sides.where((F.size("s") > 0) & (F.size("t") > 0)).join(edges, "edge_id")
    return both.select("edge_id", F.explode("s").alias("source"), "t", "kind", "is_directed").select("edge_id", "source", F.explode("t").alias("target"), "kind", "is_directed")


def edges_between(g: Graph, pairs: DataFrame) -> DataFrame:
    """(source, target, edge_id) of edges that are no hyperedges and run from source to target, as stored."""
    return edge_pairs(g).where(F.col("kind") != HYPER).join(pairs.select("source", "target").distinct(), ["source", "target"]).select("source", "target", "edge_id")


def has_edge(g: Graph, pairs: DataFrame) -> DataFrame:
    """pairs with `found`."""
    held = edges_between(g, pairs).select("source", "target").distinct().withColumn("found", F.lit(True))
    return pairs.join(held, ["source", "target"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def neighbors(g: Graph, direction: str = "both", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(node_id, neighbor) of all nodes; undirected edges go both ways, `out` follows sources to targets."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction: {direction}")
    edges = g.edges.where(F.col("kind").isin(*kinds) if kinds else F.col("kind") != STUB).select("edge_id", "kind", g.declared().alias("declared"))
    side = lambda role: F.collect_set(F.when(role, F.col("node_id")))
    sides = g.members.groupBy("edge_id").agg(side(F.col("role") != TARGET).alias("s"), side(F.col("role") == TARGET).alias("t")).join(edges, "edge_id")
    directed = F.when(F.col("kind") == HYPER, F.size("t") > 0).otherwise(F.col("declared"))
    # a directed edge joins its sources with its targets only, an undirected one all its members
    every = F.array_union("s", "t")
    rows = sides.select(F.when(directed, F.col("s")).otherwise(every).alias("a"), F.when(directed, F.col("t")).otherwise(every).alias("b"), directed.alias("d"))
    pairs = rows.select(F.explode("a").alias("x"), "b", "d").select("x", F.explode("b").alias("y"), "d")
    # a directed self-loop makes a node its own neighbour, an undirected one doesn't
    pairs = pairs.where(F.col("d") | (F.col("x") != F.col("y")))
    forward, backward = F.struct(F.col("x").alias("node_id"), F.col("y").alias("neighbor")), F.struct(F.col("y").alias("node_id"), F.col("x").alias("neighbor"))
    ways = {"out": F.array(forward), "in": F.when(F.col("d"), F.array(backward)).otherwise(F.array(forward)), "both": F.when(F.col("d"), F.array(forward, backward)).otherwise(F.array(forward))}
    return pairs.select(F.explode(ways[direction]).alias("p")).select("p.node_id", "p.neighbor").distinct()


def incident_edges(g: Graph, nodes: DataFrame | None = None, direction: str = "both") -> DataFrame:
    """(node_id, edge_id) of edges at nodes; directed ones by side."""
    rows = g.members.join(g.resolved().where(F.col("kind") != STUB).select("edge_id", "is_directed"), "edge_id")
    if nodes is not None:
        rows = rows.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    if direction != "both":
        side = F.col("role") != TARGET if direction == "out" else F.col("role") == TARGET
        rows = rows.where(~F.col("is_directed") | side)
    return rows.select("node_id", "edge_id").distinct()


def edges_by_direction(g: Graph, directed: bool) -> DataFrame:
    """Structural edges whose declared, else default, direction is this."""
    return g.structural().where(g.declared() == directed).select("edge_id")


def edge_kind(g: Graph) -> DataFrame:
    """(edge_id, edge_kind): hyper, or the role between layers."""
    return g.structural().select("edge_id", F.when(F.col("kind") == HYPER, HYPER).otherwise(F.col("ml_kind")).alias("edge_kind"))


def hyperedges(g: Graph) -> DataFrame:
    """(edge_id, directed, weight, head, tail, members): head is the source side; undirected ones have members only."""
    sides = edge_sides(g).join(g.resolved().where(F.col("kind") == HYPER).select("edge_id", "is_directed", "weight"), "edge_id")
    return sides.select("edge_id", F.col("is_directed").alias("directed"), "weight", F.when(F.col("is_directed"), F.col("sources")).alias("head"), F.when(F.col("is_directed"), F.col("targets")).alias("tail"), F.when(~F.col("is_directed"), F.col("members")).alias("members"))


def nodes_in_order(g: Graph, limit: int | None = None) -> DataFrame:
    out = g.nodes().orderBy(F.col("ord").asc_nulls_last(), "node_id")
    return out.limit(limit) if limit is not None else out


def orphans(g: Graph) -> DataFrame:
    """Nodes without a non-zero cell."""
    from tessera.operators.matrices import degree

    return degree(g).join(g.nodes().select("node_id"), "node_id", "left_semi").where("degree = 0").select("node_id")


def select(df: DataFrame, **conditions) -> DataFrame:
    """Rows that equal all conditions."""
    for name, value in conditions.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def find(df: DataFrame, **conditions):
    """The one row that equals all conditions; KeyError without one, ValueError with more."""
    rows = select(df, **conditions).limit(2).collect()
    if not rows:
        raise KeyError(f"nothing with {conditions}")
    if len(rows) > 1:
        raise ValueError(f"more than one with {conditions}")
    return rows[0]


def is_in(df: DataFrame, name: str, values, negate: bool = False) -> DataFrame:
    """Rows whose column is among values (a list, or a frame of one column); nulls pass the negation."""
    if name not in df.columns:
        return df
    if isinstance(values, DataFrame):
        key = values.select(F.col(values.columns[0]).alias(name)).distinct()
        return df.join(key, name, "left_anti" if negate else "left_semi")
    hit = F.coalesce(F.col(name).isin(*values), F.lit(False))
    return df.where(~hit if negate else hit)


def column(df: DataFrame, key: str, name: str, default=None) -> DataFrame:
    """(key, name) with nulls filled; KeyError for an unknown column."""
    if name not in df.columns:
        raise KeyError(name)
    return df.select(key, F.coalesce(F.col(name), F.lit(default)).alias(name) if default is not None else F.col(name))


def element(df: DataFrame, position: int, *order: str):
    """The row at a position of an order, from the end if negative."""
    keys = order or ("ord",)
    if position < 0:
        rows = df.orderBy(*(F.desc(k) for k in keys)).limit(-position).collect()
        return rows[-1] if len(rows) == -position else None
    rows = df.orderBy(*keys).offset(position).limit(1).collect()
    return rows[0] if rows else None


def unique_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


ROLE_NAMES = {SOURCE: "source", TARGET: "target", MEMBER: "member"}
