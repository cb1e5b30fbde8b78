"""Delimited tables in five shapes: edge lists, coordinate triples, hyperedges, incidence, adjacency, neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean, truth, words
from tessera.model import DEFAULT_SLICE, HYPER, Graph, empty
from tessera.operators import query
from tessera.operators.build import add_edges

# fixed values: names that a column may have
NAMES = {
    "source": ["source", "src", "from", "u"],
    "target": ["target", "tgt", "dst", "to", "v"],
    "weight": ["weight", "w"],
    "directed": ["directed", "is_directed", "dir", "orientation"],
    "slice": ["slice", "slices"],
    "edge_id": ["edge", "edge_id", "id"],
    "node": ["node", "node_id", "id", "name", "label"],
    "neighbors": ["neighbors", "nbrs", "adj", "adjacency", "neighbors_out", "neighbors_in"],
    "members": ["members", "verts", "participants"],
    "head": ["head", "heads"],
    "tail": ["tail", "tails"],
    "row": ["row", "i", "r"],
    "col": ["col", "column", "j", "c"],
    "val": ["val", "value", "w", "weight"],
}
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")


def find(df: DataFrame, role: str) -> str | None:
    """The column of a role, by its names in any case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((lower[n] for n in NAMES[role] if n in lower), None)


def numeric(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith(NUMERIC)


def shape_of(df: DataFrame) -> str:
    """hyperedge, lil, coo, edge_list, incidence or adjacency, by names and then by types."""
    has = {r: find(df, r) is not None for r in NAMES}
    if has["members"] or has["head"] and has["tail"]:
        return "hyperedge"
    if has["neighbors"]:
        return "lil"
    if has["row"] and has["col"] and has["val"]:
        return "coo"
    if has["source"] and has["target"]:
        return "edge_list"
    rest = df.columns[1:]
    if len(rest) >= 2 and all(numeric(df, c) for c in rest):
        n = df.limit(len(df.columns) + 1).count()
        if not numeric(df, df.columns[0]):
            return "adjacency" if n == len(rest) else "incidence"
        if n == len(df.columns):
            return "adjacency"
    return "edge_list"


def ingest(df: DataFrame, schema: str = "auto", directed: bool | None = None, default_weight: float = 1.0) -> Graph:
    shape = shape_of(df) if schema == "auto" else schema
    readers = {"edge_list": edge_list, "coo": edge_list, "hyperedge": hyperedges, "incidence": incidence, "adjacency": adjacency, "lil": neighbour_lists}
    return readers[shape](df, directed, default_weight)


def read(spark: SparkSession, path: str, schema: str = "auto", directed: bool | None = None, sep: str = ",") -> Graph:
    return ingest(spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path), schema, directed)


def edge_list(df: DataFrame, directed: bool | None = None, default_weight: float = 1.0) -> Graph:
    """Rows with both ends; slice cells may list several slices, columns `weight:<slice>` hold weights of slices."""
    names = {r: find(df, r) for r in ("source", "target", "weight", "directed", "slice", "edge_id", "row", "col", "val")}
    source, target, weight = (names[a] or names[b] for a, b in (("source", "row"), ("target", "col"), ("weight", "val")))
    if source is None or target is None:
        raise ValueError("an edge list needs a source and a target")
    over = [c for c in df.columns if c.lower().startswith("weight:")]
    used = {source, target, weight, names["directed"], names["slice"], names["edge_id"], *over}
    attrs = [c for c in df.columns if c not in used]
    rows = df.select(
        clean(F.col(source)).alias("source"), clean(F.col(target)).alias("target"),
        F.coalesce(F.col(weight).cast("double"), F.lit(default_weight)).alias("weight") if weight else F.lit(default_weight).alias("weight"),
        F.coalesce(truth(F.col(names["directed"])), F.lit(directed)).alias("directed") if names["directed"] else F.lit(directed).cast("boolean").alias("directed"),
        words(F.col(names["slice"])).alias("slices") if names["slice"] else F.lit(None).cast("array<string>").alias("slices"),
        clean(F.col(names["edge_id"])).alias("given") if names["edge_id"] else F.lit(None).cast("string").alias("given"),
        *(F.col(c).cast("double").alias(c) for c in over), *attrs,
    ).where("source is not null and target is not null")
    # rows without an identifier are numbered within equal ends, so parallel edges stay apart
    own = F.concat_ws("|", "source", "target", F.xxhash64(*(c for c in rows.columns if c not in ("slices", "given"))).cast("string"))
    rows = rows.withColumn("edge_id", F.coalesce("given", own)).drop("given")
    g = add_edges(empty(df.sparkSession, directed), rows.drop("slices", *over))
    held = rows.where(F.size("slices") > 0).select(F.explode("slices").alias("slice_id"), "edge_id", "source", "target")
    return with_overrides(with_memberships(g, held), rows, over)


def with_memberships(g: Graph, held: DataFrame) -> Graph:
    """Slices (slice_id, edge_id, source, target) besides the default one."""
    from tessera.operators.build import with_slices

    ends = held.select("slice_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return g.having(slices=with_slices(g, held.select("slice_id")), slice_edges=g.slice_edges.unionByName(held.select("slice_id", "edge_id")).distinct(), slice_nodes=g.slice_nodes.unionByName(ends).distinct())


def with_overrides(g: Graph, rows: DataFrame, over: list[str]) -> Graph:
    if not over:
        return g
    from tessera.operators.build import upsert

    pairs = F.explode(F.array(*(F.struct(F.lit(c.split(":", 1)[1]).alias("slice_id"), F.col(f"`{c}`").alias("weight")) for c in over)))
    new = rows.select("edge_id", pairs.alias("x")).select("x.slice_id", "edge_id", "x.weight").where("weight is not null")
    return g.having(edge_slice_attrs=upsert(g.edge_slice_attrs, new, ("slice_id", "edge_id")))


def hyperedges(df: DataFrame, directed: bool | None = None, default_weight: float = 1.0) -> Graph:
    names = {r: find(df, r) for r in ("members", "head", "tail", "weight", "edge_id")}
    cells = [words(F.col(names[r])).alias(r) for r in ("members", "head", "tail") if names[r]]
    key = clean(F.col(names["edge_id"])) if names["edge_id"] else F.concat(F.lit("h|"), F.xxhash64(*(F.col(names[r]).cast("string") for r in ("members", "head", "tail") if names[r])).cast("string"))
    weight = F.coalesce(F.col(names["weight"]).cast("double"), F.lit(default_weight)) if names["weight"] else F.lit(default_weight)
    attrs = [c for c in df.columns if c not in names.values()]
    return add_edges(empty(df.sparkSession, directed), df.select(key.alias("edge_id"), *cells, weight.alias("weight"), *attrs))


def long_form(df: DataFrame) -> DataFrame:
    """(row, col, value) of a wide table whose first column names the rows."""
    first = df.columns[0]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns[1:])))
    return df.select(clean(F.col(f"`{first}`")).alias("row"), pairs.alias("x")).select("row", "x.col", "x.value").where("value is not null and value <> 0")


def incidence(df: DataFrame, directed: bool | None = None, default_weight: float = 1.0) -> Graph:
    """Columns are edges: one positive and one negative entry are a directed edge, two positive ones an undirected edge, else a hyperedge."""
    cells = long_form(df)
    up, down = F.col("value") > 0, F.col("value") < 0
    sides = cells.groupBy(F.col("col").alias("edge_id")).agg(
        F.array_sort(F.collect_list(F.when(up, F.col("row")))).alias("plus"), F.array_sort(F.collect_list(F.when(down, F.col("row")))).alias("minus"), F.max(F.abs("value")).alias("weight"))
    two = (F.size("plus") == 1) & (F.size("minus") == 1)
    pair = (F.size("plus") == 2) & (F.size("minus") == 0)
    g = add_edges(empty(df.sparkSession, directed), sides.where(two).select("edge_id", F.col("plus")[0].alias("source"), F.col("minus")[0].alias("target"), "weight", F.lit(True).alias("directed")))
    g = add_edges(g, sides.where(pair).select("edge_id", F.col("plus")[0].alias("source"), F.col("plus")[1].alias("target"), "weight", F.lit(False).alias("directed")))
    rest = sides.where(~two & ~pair)
    many = F.when(F.size("minus") == 0, F.col("plus"))
    return add_edges(g, rest.select("edge_id", many.alias("members"), F.when(many.isNull(), F.col("plus")).alias("head"), F.when(many.isNull(), F.col("minus")).alias("tail"), "weight"))


def adjacency(df: DataFrame, directed: bool | None = None, default_weight: float = 1.0) -> Graph:
    """A square table; a symmetric one gives undirected edges of one triangle. The diagonal is left out."""
    if numeric(df, df.columns[0]) and len(df.columns) > 1:
        from tessera.operators.matrices import dense_rows

        df = dense_rows(df.withColumn("_o", F.monotonically_increasing_id()), "_k", "_o").withColumn("_k", F.element_at(F.array(*(F.lit(c) for c in df.columns)), (F.col("_k") + 1).cast("int"))).select("_k", *df.columns)
    cells = long_form(df).where("row <> col")
    back = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("value").alias("other"))
    uneven = cells.join(back, ["row", "col"], "left").where("other is null or abs(value - other) > 1e-12")
    symmetric = uneven.isEmpty() if directed is None else not directed
    rows = cells.where("row < col") if symmetric else cells
    edges = rows.select(F.concat_ws("|", "row", "col").alias("edge_id"), F.col("row").alias("source"), F.col("col").alias("target"), F.col("value").alias("weight"), F.lit(not symmetric).alias("directed"))
    return add_edges(empty(df.sparkSession, not symmetric), edges)


def neighbour_lists(df: DataFrame, directed: bool | None = None, default_weight: float = 1.0) -> Graph:
    node, lists = find(df, "node") or df.columns[0], find(df, "neighbors")
    rows = df.select(clean(F.col(node)).alias("source"), F.explode(words(F.col(lists))).alias("target")).where("source is not null").distinct()
    if directed is False:
        rows = rows.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    return add_edges(empty(df.sparkSession, directed), rows.select(F.concat_ws("|", "source", "target").alias("edge_id"), "source", "target", F.lit(default_weight).alias("weight"), F.lit(directed).cast("boolean").alias("directed")))


def edges_frame(g: Graph) -> DataFrame:
    """Edge list with slices joined by bars (the default one left out) and attributes."""
    held = g.slice_edges.where(F.col("slice_id") != DEFAULT_SLICE).groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_set("slice_id")), "|").alias("slices"))
    pairs = query.edge_pairs(g).where(F.col("kind") != HYPER).select("edge_id", "source", "target", F.col("is_directed").alias("directed"))
    rows = pairs.join(g.edges.select("edge_id", "weight"), "edge_id").join(held, "edge_id", "left").join(g.edge_attrs, "edge_id", "left")
    return rows.select("source", "target", "weight", "directed", "edge_id", "slices", *(c for c in g.edge_attrs.columns if c != "edge_id"))


def hyperedges_frame(g: Graph) -> DataFrame:
    rows = query.hyperedges(g)
    return rows.select("edge_id", "directed", "weight", *(F.array_join(F.array_sort(c), "|").alias(c) for c in ("head", "tail", "members")))


def write(g: Graph, path: str, hyper: bool = False) -> None:
    (hyperedges_frame(g) if hyper else edges_frame(g)).write.mode("overwrite").option("header", True).csv(path)
