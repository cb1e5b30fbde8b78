"""Sparse matrices as coordinate frames: incidence, adjacency, Laplacian, products.

Rows are entities (node_id, layer), columns edges. Cells that sum to zero are dropped, so a directed
self-loop leaves an empty column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import BINARY, HYPER, NODE_EDGE, STUB, TARGET, Graph

CELL = 1e-12


def incidence(g: Graph, kinds: tuple[str, ...] | None = None, signed: bool = True) -> DataFrame:
    """(node_id, layer, edge_id, value) of the structural edges of these kinds."""
    edges = g.edges.where(F.col("kind").isin(*kinds) if kinds else F.col("kind") != STUB).select("edge_id")
    value = F.col("coef") if signed else F.lit(1.0)
    cells = g.members.join(edges, "edge_id", "left_semi").groupBy("node_id", "layer", "edge_id").agg(F.sum(value).alias("value"))
    return cells.where(F.abs("value") > CELL)


def binary_incidence(g: Graph) -> DataFrame:
    return incidence(g, (BINARY, NODE_EDGE))


def hyper_incidence(g: Graph) -> DataFrame:
    return incidence(g, (HYPER,), signed=False)


def sides(g: Graph) -> DataFrame:
    """(edge_id, i, j, kind, weight, is_directed, ...): every source with every target of an edge."""
    edges = g.edges.select("edge_id", "kind", "weight", "ml_kind", g.declared().alias("is_directed"))
    a = g.members.where(F.col("role") != TARGET).select("edge_id", F.col("node_id").alias("i"), F.col("layer").alias("i_layer"))
    b = g.members.where(F.col("role") == TARGET).select("edge_id", F.col("node_id").alias("j"), F.col("layer").alias("j_layer"))
    return edges.join(a, "edge_id").join(b, "edge_id")


def adjacency(g: Graph, kinds: tuple[str, ...] = (BINARY, NODE_EDGE), weight: DataFrame | None = None) -> DataFrame:
    """(i, j, value): edge weights from source to target, both ways if undirected; parallel edges add up.

    weight: (edge_id, weight) to use instead of the base weights.
    """
    pairs = sides(g).where(F.col("kind").isin(*kinds))
    if weight is not None:
        pairs = pairs.drop("weight").join(weight, "edge_id")
    both = F.when(F.col("is_directed") | (F.col("i") == F.col("j")), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    cells = pairs.select(F.explode(both).alias("x"), "weight").groupBy("x.i", "x.j").agg(F.sum("weight").alias("value"))
    return cells.where(F.abs("value") > CELL)


def row_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("i").agg(F.sum("value").alias("value"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def add(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("i", "j", "value")
    for x in frames[1:]:
        out = out.unionAll(x.select("i", "j", "value"))
    return out.groupBy("i", "j").agg(F.sum("value").alias("value")).where(F.abs("value") > CELL)


def laplacian(cells: DataFrame) -> DataFrame:
    """Diagonal of row sums less the adjacency."""
    diagonal = row_sums(cells).select("i", F.col("i").alias("j"), "value")
    return add(diagonal, cells.withColumn("value", -F.col("value")))


def co_incidence(g: Graph) -> DataFrame:
    """B times its transpose over edges with two members at least."""
    b = binary_incidence(g)
    wide = b.groupBy("edge_id").agg(F.count("*").alias("n")).where("n > 1").select("edge_id")
    b = b.join(wide, "edge_id", "left_semi")
    left = b.select("edge_id", F.col("node_id").alias("i"), F.col("value").alias("a"))
    right = b.select("edge_id", F.col("node_id").alias("j"), F.col("value").alias("b"))
    return left.join(right, "edge_id").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value")).where(F.abs("value") > CELL)


def times(cells: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix times vector (i, x): (i, value)."""
    return cells.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def rtimes(x: DataFrame, cells: DataFrame) -> DataFrame:
    """Vector (i, x) times matrix: (i, value), by column."""
    return cells.join(x, "i").groupBy("j").agg(F.sum(F.col("value") * F.col("x")).alias("value")).select(F.col("j").alias("i"), "value")


def degree(g: Graph) -> DataFrame:
    """(node_id, degree): non-zero cells of the signed incidence, 0 for isolated nodes."""
    held = incidence(g).groupBy("node_id").agg(F.count("*").alias("degree"))
    return g.entities.select("node_id").distinct().join(held, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def member_degree(g: Graph) -> DataFrame:
    """(node_id, degree): member entries, so a self-loop counts twice."""
    held = g.members.groupBy("node_id").agg(F.count("*").alias("degree"))
    return g.entities.select("node_id").distinct().join(held, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def weighted_degree(g: Graph) -> DataFrame:
    """(node_id, value): sum of the weights of member entries.

    An entry of an edge without explicit coefficients has its weight as its size, so only the others are joined with their edges.
    """
    explicit = g.structural().where("explicit").select("edge_id", "weight")
    rows = g.members.select("edge_id", "node_id", F.abs("coef").alias("w")).join(F.broadcast(explicit) if explicit.isEmpty() else explicit, "edge_id", "left")
    return rows.groupBy("node_id").agg(F.sum(F.coalesce("weight", "w")).alias("value"))


def incidence_lists(g: Graph, values: bool = False) -> DataFrame:
    """(node_id, items): of every node its edges in order, or the cells."""
    cells = incidence(g)
    item = F.struct("edge_id", "value")
    out = cells.groupBy("node_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return out.select("node_id", F.transform("items", lambda x: x["value" if values else "edge_id"]).alias("items"))


def index(g: Graph) -> DataFrame:
    """(row, node_id, layer): dense numbers of entities in order of (node_id, layer), without one task for all rows."""
    return dense_rows(g.entities.where("kind = 'node'").select("node_id", "layer"), "row", "node_id", "layer")


def dense_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with numbers 0, 1, ... by order: numbers within sorted partitions, shifted by the sizes of those before."""
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").select(*df.columns, (F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(name))
