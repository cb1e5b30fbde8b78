"""Graph to graph: subgraphs, set algebra, direction, removals, copies, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import HYPER, NODE_EDGE, STUB, TARGET, Graph
from tessera.operators.attrs import effective_weight
from tessera.operators.build import upsert

BY_EDGE = ("edges", "members", "edge_attrs", "slice_edges", "edge_slice_attrs")
BY_NODE = ("entities", "node_attrs", "slice_nodes", "node_layer_attrs")


def kept(g: Graph, edges: DataFrame, nodes: DataFrame) -> Graph:
    """The tables of a graph for these edge ids and node ids."""
    e, n = edges.select("edge_id").distinct(), nodes.select("node_id").distinct()
    n = n.union(g.edges.join(e, "edge_id", "left_semi").where(F.col("kind").isin(NODE_EDGE, STUB)).select("edge_id")).distinct()
    tables = {t: g.tables[t].join(e, "edge_id", "left_semi") for t in BY_EDGE}
    tables |= {t: g.tables[t].join(n, "node_id", "left_semi") for t in BY_NODE}
    return g.having(**{t: df.select(*g.tables[t].columns) for t, df in tables.items()})


def closed_edges(g: Graph, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Edges whose members are all among nodes; edges but hyperedges need both sides."""
    marked = g.members.select("edge_id", "node_id", "role").join(nodes.select("node_id", F.lit(True).alias("in")).distinct(), "node_id", "left")
    sides = marked.groupBy("edge_id").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("all"), F.bool_or(F.col("role") == TARGET).alias("t"), F.bool_or(F.col("role") != TARGET).alias("s"))
    inner = g.edges.select("edge_id", "kind").join(sides.where("all"), "edge_id").where((F.col("kind") == HYPER) | (F.col("s") & F.col("t"))).select("edge_id")
    return inner if edges is None else inner.join(edges.select("edge_id").distinct(), "edge_id", "left_semi")


def subgraph(g: Graph, nodes: DataFrame) -> Graph:
    """Induced by nodes."""
    return kept(g, closed_edges(g, nodes), nodes)


def edge_subgraph(g: Graph, edges: DataFrame) -> Graph:
    """These edges and their nodes."""
    nodes = g.members.join(edges.select("edge_id").distinct(), "edge_id", "left_semi").select("node_id")
    return kept(g, edges, nodes)


def extract(g: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    if nodes is None:
        return edge_subgraph(g, edges) if edges is not None else g
    return kept(g, closed_edges(g, nodes, edges), nodes)


def subgraph_from_slice(g: Graph, slice_id: str, resolve_weights: bool = True) -> Graph:
    """A slice as a graph; its weights become the base weights if resolved."""
    edges = g.slice_edges.where(F.col("slice_id") == slice_id)
    nodes = g.slice_nodes.where(F.col("slice_id") == slice_id)
    out = kept(g, edges, nodes.select("node_id").union(g.members.join(edges, "edge_id", "left_semi").select("node_id")))
    if not resolve_weights:
        return out
    weights = effective_weight(g, slice_id).select("edge_id", F.col("weight").alias("w"))
    rows = out.edges.join(weights, "edge_id").withColumn("old", F.col("weight")).withColumn("weight", F.col("w"))
    scale = rows.where("not explicit and old <> 0").select("edge_id", (F.col("w") / F.col("old")).alias("k"))
    members = out.members.join(scale, "edge_id", "left").withColumn("coef", F.col("coef") * F.coalesce("k", F.lit(1.0))).select(*g.members.columns)
    return out.having(edges=rows.select(*g.edges.columns), members=members)


def same_aspects(g: Graph, other: Graph) -> None:
    names = [[r.aspect for r in x.aspects.orderBy("ord", "aspect").collect()] for x in (g, other)]
    if names[0] != names[1]:
        raise ValueError("the graphs have other aspects")


def union(g: Graph, other: Graph) -> Graph:
    """All of both; of what both have, g's."""
    same_aspects(g, other)
    fresh = other.edges.join(g.edges.select("edge_id"), "edge_id", "left_anti")
    ids = fresh.select("edge_id")
    out = {
        "edges": g.edges.unionByName(fresh),
        "members": g.members.unionByName(other.members.join(ids, "edge_id", "left_semi").select(*g.members.columns)),
        "entities": g.entities.unionByName(other.entities.join(g.entities.select("node_id", "layer"), ["node_id", "layer"], "left_anti").select(*g.entities.columns)),
        "slice_nodes": g.slice_nodes.unionByName(other.slice_nodes).distinct(),
        "slice_edges": g.slice_edges.unionByName(other.slice_edges).distinct(),
    }
    for table, keys in (("node_attrs", ("node_id",)), ("edge_attrs", ("edge_id",)), ("slices", ("slice_id",)), ("edge_slice_attrs", ("slice_id", "edge_id"))):
        out[table] = upsert(other.tables[table], g.tables[table], keys)
    return g.having(**out)


def intersection(g: Graph, other: Graph) -> Graph:
    """What both have, closed: edges need all their nodes."""
    same_aspects(g, other)
    nodes = g.entities.join(other.entities.select("node_id").distinct(), "node_id", "left_semi").select("node_id")
    shared = g.edges.join(other.edges.select("edge_id"), "edge_id", "left_semi").select("edge_id")
    return kept(g, closed_edges(g, nodes, shared), nodes)


def difference(g: Graph, other: Graph) -> Graph:
    """What only g has, closed."""
    same_aspects(g, other)
    nodes = g.entities.join(other.entities.select("node_id").distinct(), "node_id", "left_anti").select("node_id")
    own = g.edges.join(other.edges.select("edge_id"), "edge_id", "left_anti").select("edge_id")
    return kept(g, closed_edges(g, nodes, own), nodes)


def symmetric_difference(g: Graph, other: Graph) -> Graph:
    return union(difference(g, other), difference(other, g))


def reverse(g: Graph) -> Graph:
    """Sides of directed edges swapped."""
    directed = g.resolved().select("edge_id", "is_directed")
    turn = F.when(F.col("is_directed"), -1).otherwise(1)
    members = g.members.join(directed, "edge_id").withColumn("role", (F.col("role") * turn).cast("byte")).withColumn("coef", F.col("coef") * turn)
    return g.having(members=members.select(*g.members.columns))


def make_undirected(g: Graph, drop_flexible: bool = True, update_default: bool = True) -> Graph:
    """No edge has a direction: hyperedges become sets of members, coefficients positive."""
    edges = g.edges.withColumn("declared_directed", F.lit(False))
    if drop_flexible:
        edges = edges.withColumn("policy", F.lit(None).cast(dict(g.edges.dtypes)["policy"]))
    weights = edges.select("edge_id", "kind", "weight", "explicit")
    members = g.members.join(weights, "edge_id")
    members = members.withColumn("role", F.when(F.col("kind") == HYPER, F.lit(0)).otherwise(F.col("role")).cast("byte")).withColumn("coef", F.when(F.col("explicit"), F.abs("coef")).otherwise(F.col("weight")))
    out = g.having(edges=edges, members=members.select(*g.members.columns))
    return out.but(directed=False) if update_default else out


def remove_edges(g: Graph, ids: DataFrame, errors: str = "raise") -> Graph:
    """Without edges; one that is an entity takes the edges at it along."""
    ids = ids.select("edge_id").distinct()
    if errors == "raise":
        missing = ids.join(g.edges.select("edge_id"), "edge_id", "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"unknown edges: {[r.edge_id for r in missing]}")
    while True:  # as many rounds as edges on edges are nested
        more = g.members.join(ids.withColumnRenamed("edge_id", "node_id"), "node_id", "left_semi").select("edge_id").distinct().join(ids, "edge_id", "left_anti")
        if more.isEmpty():
            break
        ids = ids.union(more).distinct()
    as_nodes = ids.withColumnRenamed("edge_id", "node_id")
    tables = {t: g.tables[t].join(ids, "edge_id", "left_anti") for t in BY_EDGE} | {t: g.tables[t].join(as_nodes, "node_id", "left_anti") for t in BY_NODE}
    return g.having(**{t: df.select(*g.tables[t].columns) for t, df in tables.items()})


def remove_nodes(g: Graph, ids: DataFrame, errors: str = "raise") -> Graph:
    """Without nodes, in all layers, and the edges at them."""
    ids = ids.select("node_id").distinct()
    if errors == "raise":
        missing = ids.join(g.entities.select("node_id"), "node_id", "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"unknown nodes: {[r.node_id for r in missing]}")
    g = remove_edges(g, g.members.join(ids, "node_id", "left_semi").select("edge_id"), errors="ignore")
    return g.having(**{t: g.tables[t].join(ids, "node_id", "left_anti").select(*g.tables[t].columns) for t in BY_NODE})


def set_coefficients(g: Graph, rows: DataFrame) -> Graph:
    """Explicit coefficients (edge_id, node_id, coef); both entries of a self-loop get the value."""
    new = rows.select("edge_id", "node_id", F.col("coef").cast("double").alias("new"))
    members = g.members.join(new, ["edge_id", "node_id"], "left").withColumn("coef", F.coalesce("new", "coef")).select(*g.members.columns)
    edges = g.edges.join(rows.select("edge_id", F.lit(True).alias("hit")).distinct(), "edge_id", "left").withColumn("explicit", F.coalesce("hit", "explicit")).select(*g.edges.columns)
    return g.having(members=members, edges=edges)


def rename_nodes(g: Graph, names: DataFrame) -> Graph:
    """Nodes under other names (node_id, new_id), in all tables; a new name that is there already is an error."""
    names = names.select("node_id", "new_id").distinct()
    kept = g.entities.select("node_id").distinct().join(names, "node_id", "left").select(F.coalesce("new_id", "node_id").alias("node_id"))
    clash = kept.groupBy("node_id").count().where("count > 1").limit(5).collect()
    unknown = names.join(g.entities.select("node_id"), "node_id", "left_anti").limit(5).collect()
    if clash or unknown:
        raise ValueError(f"names that are taken: {[r.node_id for r in clash]}, unknown nodes: {[r.node_id for r in unknown]}")

    def renamed(df: DataFrame) -> DataFrame:
        return df.join(names, "node_id", "left").withColumn("node_id", F.coalesce("new_id", "node_id")).select(*df.columns)

    return g.having(**{t: renamed(g.tables[t]) for t in ("entities", "members", "node_attrs", "slice_nodes", "node_layer_attrs")})


def set_weights(g: Graph, rows: DataFrame) -> Graph:
    """Other base weights (edge_id, weight); coefficients that aren't explicit follow."""
    new = rows.select("edge_id", F.col("weight").cast("double").alias("w"))
    edges = g.edges.join(new, "edge_id", "left")
    scale = edges.where("w is not null and not explicit").select("edge_id", "w")
    members = g.members.join(scale, "edge_id", "left").withColumn("coef", F.when(F.col("w").isNotNull(), F.when(F.col("coef") < 0, -F.col("w")).otherwise(F.col("w"))).otherwise(F.col("coef")))
    return g.having(edges=edges.withColumn("weight", F.coalesce("w", "weight")).select(*g.edges.columns), members=members.select(*g.members.columns))


def set_directions(g: Graph, rows: DataFrame) -> Graph:
    """Declared directions (edge_id, directed) of edges that are no hyperedges; a policy of theirs is dropped, coefficients follow."""
    edges = g.edges.join(rows.select("edge_id", F.col("directed").alias("d")), "edge_id", "left").withColumn("d", F.when(F.col("kind") != HYPER, F.col("d")))
    sign = edges.where("d is not null and not explicit").select("edge_id", "d", F.col("weight").alias("w"))
    members = g.members.join(sign, "edge_id", "left").withColumn("coef", F.when(F.col("d").isNull(), F.col("coef")).when(F.col("d") & (F.col("role") == TARGET), -F.col("w")).otherwise(F.col("w")))
    policy = F.when(F.col("d").isNull(), F.col("policy"))
    return g.having(edges=edges.withColumn("policy", policy).withColumn("declared_directed", F.coalesce("d", "declared_directed")).select(*g.edges.columns), members=members.select(*g.members.columns))


def structural_hash(g: Graph) -> int:
    """A number that depends on nodes, edges, members and weights, and on no order."""
    parts = (g.entities.select("node_id", "layer", "kind"), g.edges.select("edge_id", "kind", "declared_directed", "weight"), g.members.select("edge_id", "node_id", "layer", "role", "coef"))
    total = 0
    for k, df in enumerate(parts):
        row = df.agg(F.coalesce(F.bit_xor(F.xxhash64(*df.columns, F.lit(k))), F.lit(0)).alias("x"), F.count("*").alias("n")).first()
        total ^= row.x * (2 * k + 1) + row.n
    return total & (1 << 64) - 1
