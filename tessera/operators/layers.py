"""Layers: aspects, presence, layer algebra, couplings, and the matrices over (node, layer) pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import PLACEHOLDER, layer_id
from tessera.model import HYPER, TARGET, Graph
from tessera.operators import slices
from tessera.operators.algebra import closed_edges, kept
from tessera.operators.build import add_edges, upsert
from tessera.operators.matrices import CELL, dense_rows

KEY = "\x1f"


def lit_layer(layer: tuple[str, ...] | list[str]) -> Column:
    return F.array(*(F.lit(x) for x in layer))


def set_aspects(g: Graph, labels: dict[str, list[str]]) -> Graph:
    """Declare aspects and their labels; nodes of a flat graph move to the placeholder coordinate."""
    if not labels:
        raise ValueError("aspects can't be empty")
    aspects = g.spark.createDataFrame([(a, k) for k, a in enumerate(labels)], "aspect string, ord int")
    elements = g.spark.createDataFrame([(a, x) for a, xs in labels.items() for x in xs], "aspect string, label string")
    moved = F.when(F.size("layer") == len(labels), F.col("layer")).otherwise(F.array_repeat(F.lit(PLACEHOLDER), len(labels)))
    tables = {t: g.tables[t].withColumn("layer", moved) for t in ("entities", "members")}
    return g.having(aspects=upsert(g.aspects.limit(0), aspects, ("aspect",)), elem_layers=upsert(g.elem_layers, elements, ("aspect", "label")), **tables)


def add_labels(g: Graph, labels: dict[str, list[str]]) -> Graph:
    rows = g.spark.createDataFrame([(a, x) for a, xs in labels.items() for x in xs], "aspect string, label string")
    return g.having(elem_layers=upsert(g.elem_layers, rows, ("aspect", "label")))


def list_layers(g: Graph, aspect: str | None = None, include_placeholder: bool = False) -> DataFrame:
    rows = g.elem_layers if aspect is None else g.elem_layers.where(F.col("aspect") == aspect)
    return (rows if include_placeholder else rows.where(F.col("label") != PLACEHOLDER)).select("aspect", "label")


def all_layers(g: Graph) -> DataFrame:
    """(layer, id): product of the labels of all aspects; as many rows as declared coordinates."""
    names = [r.aspect for r in g.aspects.orderBy("ord", "aspect").collect()]
    frames = [g.elem_layers.where(F.col("aspect") == a).select(F.col("label").alias(f"l{k}")) for k, a in enumerate(names)]
    joined = reduce(lambda a, b: a.join(b), frames)
    return joined.select(F.array(*(f"l{k}" for k in range(len(names)))).alias("layer")).withColumn("id", layer_id(F.col("layer")))


def layer_nodes(g: Graph, layer) -> DataFrame:
    return g.entities.where((F.col("kind") == "node") & (F.col("layer") == lit_layer(layer))).select("node_id").distinct()


def layer_edges(g: Graph, layer, include_inter: bool = False, include_coupling: bool = False) -> DataFrame:
    """Edges within a layer; edges between layers that touch it on request."""
    touches = F.array_contains("ml_layers", lit_layer(layer))
    inside = (F.col("ml_kind") == "intra") & touches
    if include_inter:
        inside |= (F.col("ml_kind") == "inter") & touches
    if include_coupling:
        inside |= (F.col("ml_kind") == "coupling") & touches
    return g.structural().where(inside).select("edge_id")


def layer_union(g: Graph, layers, **touch: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of any of the layers."""
    parts = [(layer_nodes(g, x), layer_edges(g, x, **touch)) for x in layers]
    return tuple(reduce(DataFrame.union, (p[k] for p in parts)).distinct() for k in (0, 1))


def layer_intersection(g: Graph, layers, **touch: bool) -> tuple[DataFrame, DataFrame]:
    parts = [(layer_nodes(g, x), layer_edges(g, x, **touch)) for x in layers]
    return tuple(reduce(DataFrame.intersect, (p[k] for p in parts)) for k in (0, 1))


def layer_difference(g: Graph, a, b, **touch: bool) -> tuple[DataFrame, DataFrame]:
    return layer_nodes(g, a).subtract(layer_nodes(g, b)), layer_edges(g, a, **touch).subtract(layer_edges(g, b, **touch))


def slice_from(g: Graph, slice_id: str, members: tuple[DataFrame, DataFrame], **attrs) -> Graph:
    return slices.create(g, slice_id, *members, **attrs)


def subgraph_from(g: Graph, members: tuple[DataFrame, DataFrame], layers=None) -> Graph:
    """Graph of some nodes and edges, with the presence in these layers only."""
    nodes, edges = members
    out = kept(g, closed_edges(g, nodes, edges), nodes)
    if layers is None:
        return out
    inside = reduce(lambda a, b: a | b, (F.col("layer") == lit_layer(x) for x in layers))
    return out.having(entities=out.entities.where(inside), node_layer_attrs=out.node_layer_attrs.where(inside))


def couple(g: Graph, pairs: DataFrame, weight: float = 1.0, directed: bool = False) -> Graph:
    """Coupling edges for rows (node_id, a, b) of layers."""
    name = F.concat_ws("|", F.lit("couple"), "node_id", layer_id(F.col("a")), layer_id(F.col("b")))
    edges = pairs.select(name.alias("edge_id"), F.col("node_id").alias("source"), F.col("a").alias("source_layer"), F.col("node_id").alias("target"), F.col("b").alias("target_layer"), F.lit(weight).alias("weight"), F.lit(directed).alias("directed"))
    return add_edges(g, edges)


def presence(g: Graph) -> DataFrame:
    return g.entities.where("kind = 'node'").select("node_id", "layer")


def pairs_of_layers(g: Graph, pairs) -> DataFrame:
    """(node_id, a, b) of nodes that are in both layers of a listed pair."""
    here = presence(g)
    named = reduce(DataFrame.unionAll, (g.spark.range(1).select(lit_layer(a).alias("a"), lit_layer(b).alias("b")) for a, b in pairs))
    left = here.join(F.broadcast(named), F.col("layer") == F.col("a")).select("node_id", "a", "b")
    return left.join(here.select("node_id", F.col("layer").alias("b")), ["node_id", "b"]).select("node_id", "a", "b")


def categorical_pairs(g: Graph, aspect: str, groups: list[list[str]] | None = None) -> DataFrame:
    """(node_id, a, b): layers of a node that differ in one aspect only, both labels in one group."""
    names = [r.aspect for r in g.aspects.orderBy("ord", "aspect").collect()]
    k = names.index(aspect)
    label = F.element_at("layer", k + 1)
    rest = F.filter("layer", lambda x, i: i != k)
    here = presence(g).select("node_id", "layer", label.alias("label"), rest.alias("rest"))
    if groups is not None:
        group = g.spark.createDataFrame([(x, n) for n, xs in enumerate(groups) for x in xs], "label string, part int")
        here = here.join(F.broadcast(group), "label")
    else:
        here = here.withColumn("part", F.lit(0))
    on = ["node_id", "rest", "part"]
    return here.select(*on, F.col("layer").alias("a"), F.col("label").alias("la")).join(here.select(*on, F.col("layer").alias("b"), F.col("label").alias("lb")), on).where("la < lb").select("node_id", "a", "b")


def diagonal_pairs(g: Graph, layer_filter: dict[str, set[str]]) -> DataFrame:
    """(node_id, a, b): all pairs of a node's layers whose labels pass the filter."""
    names = [r.aspect for r in g.aspects.orderBy("ord", "aspect").collect()]
    here = presence(g)
    for aspect, labels in layer_filter.items():
        here = here.where(F.element_at("layer", names.index(aspect) + 1).isin(*labels))
    return here.select("node_id", F.col("layer").alias("a")).join(here.select("node_id", F.col("layer").alias("b")), "node_id").where(layer_id(F.col("a")) < layer_id(F.col("b")))


def flatten(g: Graph) -> Graph:
    """Nodes without layers; entries of an edge that fall together count once a role."""
    flat = F.array(F.lit(PLACEHOLDER))
    entities = g.entities.groupBy("node_id").agg(F.min("kind").alias("kind"), F.min("ord").alias("ord")).select("node_id", flat.alias("layer"), "kind", "ord")
    members = g.members.groupBy("edge_id", "node_id", "role").agg(F.first("coef").alias("coef"), F.min("pos").alias("pos")).select("edge_id", "node_id", flat.alias("layer"), "role", "coef", "pos")
    edges = g.edges.withColumn("ml_kind", F.lit("intra")).withColumn("ml_layers", F.array(flat))
    none = {t: g.tables[t].limit(0) for t in ("aspects", "elem_layers", "layer_attrs", "node_layer_attrs")}
    return g.having(entities=entities, members=members, edges=edges, **none)


# matrices over (node, layer)


def supra_key(node: str = "node_id", layer: str = "layer") -> Column:
    return F.concat(F.col(node), F.lit(KEY), layer_id(F.col(layer)))


def supra_index(g: Graph, layers=None) -> DataFrame:
    """(row, node_id, layer) in order of (node_id, layer)."""
    rows = presence(g)
    if layers is not None:
        rows = rows.where(reduce(lambda a, b: a | b, (F.col("layer") == lit_layer(x) for x in layers)))
    return dense_rows(rows, "row", "node_id", "layer")


def supra_entries(g: Graph, kinds: tuple[str, ...] = ("intra", "inter", "coupling"), layers=None) -> DataFrame:
    """(i, j, ml_kind, weight) of two-sided edges that are no hyperedges, both ways if undirected."""
    edges = g.structural().where((F.col("kind") != HYPER) & F.col("ml_kind").isin(*kinds)).select("edge_id", "weight", "ml_kind", g.declared().alias("is_directed"))
    key = supra_key()
    members = g.members
    if layers is not None:
        members = members.where(reduce(lambda a, b: a | b, (F.col("layer") == lit_layer(x) for x in layers)))
    a = members.where(F.col("role") != TARGET).select("edge_id", key.alias("i"))
    b = members.where(F.col("role") == TARGET).select("edge_id", key.alias("j"))
    rows = edges.join(a, "edge_id").join(b, "edge_id")
    both = F.when(F.col("is_directed") | (F.col("i") == F.col("j")), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return rows.select(F.explode(both).alias("x"), "ml_kind", "weight").select("x.i", "x.j", "ml_kind", "weight")


def supra_adjacency(g: Graph, kinds: tuple[str, ...] = ("intra", "inter", "coupling"), layers=None, coupling_scale: float = 1.0) -> DataFrame:
    """(i, j, value) with keys of node and layer."""
    rows = supra_entries(g, kinds, layers)
    weight = F.when(F.col("ml_kind") == "coupling", F.col("weight") * coupling_scale).otherwise(F.col("weight"))
    return rows.groupBy("i", "j").agg(F.sum(weight).alias("value")).where(F.abs("value") > CELL)


def supra_incidence(g: Graph, layers=None, include_inter: bool = True, include_coupling: bool = True) -> DataFrame:
    """(i, edge_id, value): cells of all edges of the kinds asked for; hyperedges keep their coefficients."""
    kinds = ["intra", *(["inter"] if include_inter else []), *(["coupling"] if include_coupling else [])]
    edges = g.structural().where(F.col("ml_kind").isin(*kinds)).select("edge_id")
    members = g.members.join(edges, "edge_id", "left_semi")
    if layers is not None:
        inside = reduce(lambda a, b: a | b, (F.col("layer") == lit_layer(x) for x in layers))
        outside = members.where(~inside).select("edge_id").distinct()
        members = members.join(outside, "edge_id", "left_anti")
    return members.groupBy(supra_key().alias("i"), "edge_id").agg(F.sum("coef").alias("value")).where(F.abs("value") > CELL)


def supra_degree(g: Graph, layers=None) -> DataFrame:
    """(i, value): row sums, 0 for pairs without an edge."""
    sums = supra_adjacency(g, layers=layers).groupBy("i").agg(F.sum("value").alias("value"))
    rows = presence(g) if layers is None else presence(g).where(reduce(lambda a, b: a | b, (F.col("layer") == lit_layer(x) for x in layers)))
    return rows.select(supra_key().alias("i")).join(sums, "i", "left").select("i", F.coalesce("value", F.lit(0.0)).alias("value"))


def supra_laplacian(g: Graph, kind: str = "comb", layers=None) -> DataFrame:
    """D - A, or 1 - D^-1/2 A D^-1/2 with empty rows left zero off the diagonal."""
    cells = supra_adjacency(g, layers=layers)
    degree = supra_degree(g, layers)
    if kind == "comb":
        diagonal = degree.where("value <> 0").select("i", F.col("i").alias("j"), "value")
        rows = diagonal.unionAll(cells.select("i", "j", -F.col("value")))
    else:
        root = F.when(F.col("value") > 0, 1 / F.sqrt("value")).otherwise(0.0)
        d = degree.select("i", root.alias("r"))
        scaled = cells.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("r").alias("s")), "j")
        rows = degree.select("i", F.col("i").alias("j"), F.lit(1.0).alias("value")).unionAll(scaled.select("i", "j", -F.col("value") * F.col("r") * F.col("s")))
    return rows.groupBy("i", "j").agg(F.sum("value").alias("value")).where(F.abs("value") > CELL)


def transition(g: Graph, layers=None) -> DataFrame:
    """Row-stochastic adjacency; rows without edges stay zero."""
    cells = supra_adjacency(g, layers=layers)
    total = F.sum("value").over(Window.partitionBy("i"))
    return cells.select("i", "j", F.when(total != 0, F.col("value") / total).otherwise(0.0).alias("value"))


def random_walk_step(g: Graph, p: DataFrame, layers=None) -> DataFrame:
    from tessera.operators.matrices import rtimes

    return rtimes(p, transition(g, layers))


def diffusion_step(g: Graph, x: DataFrame, tau: float = 1.0, kind: str = "comb", layers=None) -> DataFrame:
    """x - tau L x for rows (i, x)."""
    from tessera.operators.matrices import times

    flow = times(supra_laplacian(g, kind, layers), x).withColumnRenamed("value", "f")
    return x.join(flow, "i", "left").select("i", (F.col("x") - tau * F.coalesce("f", F.lit(0.0))).alias("x"))


def tensor(g: Graph, layers=None) -> DataFrame:
    """(u, a, v, b, value): entries by node and layer of either end, always both ways."""
    rows = supra_entries(g, layers=layers).select("i", "j", "weight")
    both = rows.unionAll(rows.select("j", "i", "weight")).distinct()
    part = lambda c, k: F.split_part(F.col(c), F.lit(KEY), F.lit(k))
    return both.select(part("i", 1).alias("u"), part("i", 2).alias("a"), part("j", 1).alias("v"), part("j", 2).alias("b"), F.col("weight").alias("value"))


def flatten_tensor(entries: DataFrame) -> DataFrame:
    key = lambda n, a: F.concat(F.col(n), F.lit(KEY), F.col(a))
    return entries.groupBy(key("u", "a").alias("i"), key("v", "b").alias("j")).agg(F.sum("value").alias("value"))


def unflatten(cells: DataFrame) -> DataFrame:
    """(u, a, v, b, value) of a matrix (i, j, value) over (node, layer) pairs."""
    part = lambda c, k: F.split_part(F.col(c), F.lit(KEY), F.lit(k))
    return cells.select(part("i", 1).alias("u"), part("i", 2).alias("a"), part("j", 1).alias("v"), part("j", 2).alias("b"), "value")


def tensor_index(g: Graph) -> DataFrame:
    """(axis, position, id): numbers of nodes and of layers, in order, for the two axes of a tensor."""
    nodes = dense_rows(presence(g).select(F.col("node_id").alias("id")).distinct(), "position", "id").select(F.lit("node").alias("axis"), "position", "id")
    layers = dense_rows(presence(g).select(layer_id(F.col("layer")).alias("id")).distinct(), "position", "id").select(F.lit("layer").alias("axis"), "position", "id")
    return nodes.unionAll(layers)


def node_layers(g: Graph) -> DataFrame:
    """(node_id, layers): of every node the layers it is present in."""
    return presence(g).groupBy("node_id").agg(F.array_sort(F.collect_set(layer_id(F.col("layer")))).alias("layers"))


def has_presence(g: Graph, node_id: str, layer) -> bool:
    return not presence(g).where((F.col("node_id") == node_id) & (F.col("layer") == lit_layer(layer))).isEmpty()


def layer_degrees(g: Graph, layers=None) -> DataFrame:
    """(node_id, layer, value): degrees within each layer."""
    cells = supra_adjacency(g, ("intra",), layers).groupBy("i").agg(F.sum("value").alias("value"))
    part = lambda k: F.split_part(F.col("i"), F.lit(KEY), F.lit(k))
    return cells.select(part(1).alias("node_id"), part(2).alias("layer"), "value")


def participation(g: Graph, layers=None) -> DataFrame:
    """(node_id, value): 1 less the squared shares of layers in a node's degree; 0 without edges."""
    sums = layer_degrees(g, layers).groupBy("node_id").agg(F.sum("value").alias("k"), F.sum(F.col("value") ** 2).alias("q"))
    value = F.when(F.col("k") != 0, 1 - F.col("q") / F.col("k") ** 2).otherwise(0.0)
    return g.nodes().select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce(value, F.lit(0.0)).alias("value"))


def modularity(g: Graph, partition: DataFrame, gamma: float = 1.0, omega: float = 1.0, include_inter: bool = False, layers=None) -> float:
    """Multislice modularity of (node_id, layer as joined id, community).

    The null model of a layer is the sum over its communities of their squared degree sums, so no pair of nodes is listed.
    """
    kinds = ("intra", "inter", "coupling") if include_inter else ("intra", "coupling")
    rows = supra_entries(g, kinds, layers)
    key = partition.select(F.concat(F.col("node_id"), F.lit(KEY), F.col("layer")).alias("i"), "community")
    weight = F.when(F.col("ml_kind") == "coupling", F.col("weight") * omega).otherwise(F.col("weight"))
    cells = rows.withColumn("w", weight)
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    inside = cells.join(key, "i").join(key.select(F.col("i").alias("j"), F.col("community").alias("other")), "j").where("community = other").agg(F.sum("w")).first()[0] or 0.0
    degrees = cells.where("ml_kind = 'intra'").groupBy("i").agg(F.sum("w").alias("k")).join(key, "i").withColumn("layer", F.split_part("i", F.lit(KEY), F.lit(2)))
    by = degrees.groupBy("layer", "community").agg(F.sum("k").alias("k"))
    null = by.groupBy("layer").agg((F.sum(F.col("k") ** 2) / F.sum("k")).alias("x")).agg(F.sum("x")).first()[0] or 0.0
    return (inside - gamma * null) / total
