"""The canonical graph over the star-schema tables: parts, suppliers, customers, nations, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import BINARY, DEFAULT_SLICE, HYPER, SCHEMAS, Graph, empty, flat_layer

YEARS = tuple(f"y{y}" for y in range(1995, 2002))
FLAGS = ("flag_A", "flag_N", "flag_R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the names of the graph."""
    rows = table(spark, sf_dir, "lineitem")
    edge = F.concat_ws(":", F.lit("PS"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return rows.select(edge.alias("edge_id"), named("P", "l_partkey").alias("source"), named("S", "l_suppkey").alias("target"), F.col("l_quantity").alias("quantity"), "l_returnflag", F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year"), "l_orderkey", "l_partkey", "l_suppkey")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, kind, name, value) of all five kinds."""
    parts = [
        ("customer", "C", "c_custkey", "c_name", "c_acctbal"), ("part", "P", "p_partkey", "p_name", "p_retailprice"),
        ("supplier", "S", "s_suppkey", "s_name", "s_acctbal"), ("nation", "N", "n_nationkey", "n_name", None), ("region", "R", "r_regionkey", "r_name", None),
    ]
    out = None
    for name, prefix, key, label, value in parts:
        rows = table(spark, sf_dir, name).select(named(prefix, key).alias("node_id"), F.lit(name).alias("kind"), F.col(label).alias("name"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


def edge_tables(pairs: DataFrame, directed: bool) -> tuple[DataFrame, DataFrame]:
    """edges and members of rows (edge_id, source, target, weight)."""
    edges = pairs.select("edge_id", F.lit(BINARY).alias("kind"), F.lit(directed).alias("declared_directed"), F.col("weight").cast("double").alias("weight"), F.lit(False).alias("explicit"), F.lit("intra").alias("ml_kind"), F.array(flat_layer()).alias("ml_layers"), F.lit(None).cast(dict(empty_types())["policy"]).alias("policy"), F.lit(None).cast("long").alias("ord"))
    weight = F.col("weight").cast("double")
    ends = F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).cast("byte").alias("role"), weight.alias("coef"), F.lit(0).alias("pos")), F.struct(F.col("target").alias("node_id"), F.lit(-1).cast("byte").alias("role"), (-weight if directed else weight).alias("coef"), F.lit(1).alias("pos"))))
    members = pairs.select("edge_id", ends.alias("x")).select("edge_id", "x.node_id", flat_layer().alias("layer"), "x.role", "x.coef", "x.pos")
    return edges, members


def empty_types() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(SCHEMAS["edges"]).fields]


def supply_pairs(rows: DataFrame) -> DataFrame:
    """Lines summed by part and supplier: numbers are shuffled, names are made behind."""
    sums = rows.groupBy("l_partkey", "l_suppkey").agg(F.sum("quantity").alias("weight"), F.count("*").alias("n_lines"))
    edge = F.concat_ws(":", F.lit("PS"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return sums.select(edge.alias("edge_id"), named("P", "l_partkey").alias("source"), named("S", "l_suppkey").alias("target"), "weight", "n_lines")


def supply(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, places: bool = True) -> Graph:
    """Parts to suppliers, weighted by quantity; customers and suppliers in nations, nations in regions."""
    pairs = supply_pairs(lines(spark, sf_dir) if rows is None else rows)
    edges, members = edge_tables(pairs, True)
    found = [(edges, members)]
    if places:
        for name, prefix, key, other, of in (("customer", "C", "c_custkey", "N", "c_nationkey"), ("supplier", "S", "s_suppkey", "N", "s_nationkey"), ("nation", "N", "n_nationkey", "R", "n_regionkey")):
            tag = F.lit(f"{prefix}{other}:")
            rows_ = table(spark, sf_dir, name).select(F.concat(tag, F.col(key).cast("string")).alias("edge_id"), named(prefix, key).alias("source"), named(other, of).alias("target"), F.lit(1.0).alias("weight"))
            found.append(edge_tables(rows_, False))
    g = empty(spark)
    edges, members = found[0]
    for e, m in found[1:]:
        edges, members = edges.unionByName(e), members.unionByName(m)
    attrs = nodes(spark, sf_dir)
    ids = attrs.select("node_id") if places else members.select("node_id").distinct()
    entities = ids.select("node_id", flat_layer().alias("layer"), F.lit("node").alias("kind"), F.lit(None).cast("long").alias("ord"))
    return g.having(edges=edges, members=members, entities=entities, node_attrs=attrs, edge_attrs=pairs.select("edge_id", "n_lines"))


def orders_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """HO: the parts of an order as an undirected hyperedge; HD: its customer against its parts, with quantities as coefficients."""
    # lines are dealt by order once, as numbers; sums and joins follow that
    rows = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("quantity").alias("quantity"))
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), named("C", "o_custkey").alias("customer"))
    parts = rows.join(owner.select("l_orderkey"), "l_orderkey", "left_semi")
    layer = flat_layer().alias("layer")
    whole = F.struct(named("HO:", "l_orderkey").alias("edge_id"), F.lit(0).cast("byte").alias("role"), F.lit(1.0).alias("coef"), F.lit(0).alias("pos"))
    sold = F.struct(named("HD:", "l_orderkey").alias("edge_id"), F.lit(-1).cast("byte").alias("role"), (-F.col("quantity")).alias("coef"), F.lit(1).alias("pos"))
    both = parts.select(named("P", "l_partkey").alias("node_id"), F.explode(F.array(whole, sold)).alias("x")).select("x.edge_id", "node_id", layer, "x.role", "x.coef", "x.pos")
    head = owner.join(parts.select("l_orderkey").distinct(), "l_orderkey").select(named("HD:", "l_orderkey").alias("edge_id"), F.col("customer").alias("node_id"), layer, F.lit(1).cast("byte").alias("role"), F.lit(1.0).alias("coef"), F.lit(0).alias("pos"))
    members = both.unionAll(head)
    names = parts.select("l_orderkey").distinct().select(F.explode(F.array(named("HO:", "l_orderkey"), named("HD:", "l_orderkey"))).alias("edge_id"))
    edges = names.select("edge_id", F.lit(HYPER).alias("kind"), F.lit(None).cast("boolean").alias("declared_directed"), F.lit(1.0).alias("weight"), F.col("edge_id").startswith("HD").alias("explicit"), F.lit("intra").alias("ml_kind"), F.array(flat_layer()).alias("ml_layers"), F.lit(None).cast(dict(empty_types())["policy"]).alias("policy"), F.lit(None).cast("long").alias("ord"))
    entities = members.select("node_id").distinct().select("node_id", layer, F.lit("node").alias("kind"), F.lit(None).cast("long").alias("ord"))
    return empty(spark).having(edges=edges, members=members, entities=entities)


def sliced(spark: SparkSession, sf_dir: str) -> Graph:
    """The supply graph with slices by return flag and by year, and quantities within a slice as its weights."""
    rows = lines(spark, sf_dir)
    g = supply(spark, sf_dir, rows, places=False)
    tags = F.explode(F.array(F.concat(F.lit("flag_"), "l_returnflag"), F.concat(F.lit("y"), F.col("year").cast("string"))))
    held = rows.select("edge_id", "source", "target", "quantity", tags.alias("slice_id"))
    over = held.groupBy("slice_id", "edge_id").agg(F.sum("quantity").alias("weight"))
    both = held.groupBy("slice_id", "edge_id", "source", "target").agg(F.sum("quantity").alias("weight"))
    ends = both.select("slice_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    ids = spark.createDataFrame([(DEFAULT_SLICE, 0), *((s, k) for k, s in enumerate((*FLAGS, *YEARS), 1))], SCHEMAS["slices"])
    every = g.edges.select(F.lit(DEFAULT_SLICE).alias("slice_id"), "edge_id")
    return g.having(slices=ids, slice_edges=both.select("slice_id", "edge_id").unionAll(every), slice_nodes=ends.unionAll(g.entities.select(F.lit(DEFAULT_SLICE), "node_id")), edge_slice_attrs=over)


def layered(spark: SparkSession, sf_dir: str) -> Graph:
    """Supply by year and status: edges within layers, and couplings of a part to itself a year later."""
    rows = lines(spark, sf_dir)
    layer = F.array(F.col("year").cast("string"), F.col("status"))
    name = F.concat_ws(":", F.lit("L"), "source", "target", F.col("year").cast("string"), "status")
    intra = rows.groupBy("source", "target", "year", "status").agg(F.sum("quantity").alias("weight")).select(name.alias("edge_id"), "source", "target", layer.alias("a"), layer.alias("b"), "weight", F.lit(True).alias("directed"), F.lit("intra").alias("ml_kind"))
    here = rows.select("source", "year", "status").distinct()
    ahead = here.select("source", (F.col("year") - 1).alias("year"), "status")
    pairs = here.join(ahead, ["source", "year", "status"])
    later = F.array((F.col("year") + 1).cast("string"), F.col("status"))
    couple = pairs.select(F.concat_ws(":", F.lit("K"), "source", F.col("year").cast("string"), "status").alias("edge_id"), "source", F.col("source").alias("target"), layer.alias("a"), later.alias("b"), F.lit(1.0).alias("weight"), F.lit(False).alias("directed"), F.lit("coupling").alias("ml_kind"))
    both = intra.unionByName(couple)
    edges = both.select("edge_id", F.lit(BINARY).alias("kind"), F.col("directed").alias("declared_directed"), "weight", F.lit(False).alias("explicit"), "ml_kind", F.array_distinct(F.array("a", "b")).alias("ml_layers"), F.lit(None).cast(dict(empty_types())["policy"]).alias("policy"), F.lit(None).cast("long").alias("ord"))
    sign = F.when(F.col("directed"), -F.col("weight")).otherwise(F.col("weight"))
    ends = F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.col("a").alias("layer"), F.lit(1).cast("byte").alias("role"), F.col("weight").alias("coef"), F.lit(0).alias("pos")), F.struct(F.col("target").alias("node_id"), F.col("b").alias("layer"), F.lit(-1).cast("byte").alias("role"), sign.alias("coef"), F.lit(1).alias("pos"))))
    members = both.select("edge_id", ends.alias("x")).select("edge_id", "x.*")
    entities = rows.select(F.explode(F.array("source", "target")).alias("node_id"), layer.alias("layer")).distinct().select("node_id", "layer", F.lit("node").alias("kind"), F.lit(None).cast("long").alias("ord"))
    aspects = spark.createDataFrame([("year", 0), ("status", 1)], SCHEMAS["aspects"])
    labels = spark.createDataFrame([("year", y[1:]) for y in YEARS] + [("status", s) for s in "FO"], SCHEMAS["elem_layers"])
    return empty(spark).having(edges=edges, members=members, entities=entities, aspects=aspects, elem_layers=labels)
