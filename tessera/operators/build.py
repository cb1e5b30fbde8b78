"""Building graphs from frames: nodes, binary edges, hyperedges, stoichiometric edges.

Edges come as frames with one row an edge. The set-at-a-time forms never number rows over one
partition: positions are taken from an `ord` column or derived from the identifier.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import PLACEHOLDER
from tessera.model import BINARY, DEFAULT_SLICE, HYPER, NODE_EDGE, RESERVED, STUB, Graph, flat_layer

ENTRY = "struct<node_id:string,layer:array<string>,coef:double>"
CORE = ("edge_id", "kind", "declared_directed", "weight", "explicit", "ml_kind", "ml_layers", "policy", "ord")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both; of a key in both the new value of a column wins unless it is null.

    Types that differ meet on the ladder int, float, text.
    """
    ladder = {"boolean": 0, "tinyint": 1, "int": 1, "bigint": 1, "float": 2, "double": 2}
    named = {0: "boolean", 1: "bigint", 2: "double", 3: "string"}
    a, b = dict(old.dtypes), dict(new.dtypes)
    both = [c for c in a if c in b and c not in keys and a[c] != b[c]]
    for c in both:
        kind = named[max(ladder.get(a[c], 3), ladder.get(b[c], 3))]
        old, new = old.withColumn(c, F.col(c).cast(kind)), new.withColumn(c, F.col(c).cast(kind))
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    left, right = old.alias("o"), new.alias("n")
    joined = left.join(right, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    pick = [F.coalesce(*(F.col(f"{side}.`{c}`") for side, frame in (("n", new), ("o", old)) if c in frame.columns)).alias(c) for c in (*keys, *columns)]
    return joined.select(*pick)


def check_names(table: str, names: Iterable[str]) -> None:
    clash = RESERVED.get(table, set()) & set(names)
    if clash:
        raise ValueError(f"reserved attribute names: {sorted(clash)}")


def add_nodes(g: Graph, nodes: DataFrame, slice: str | None = None) -> Graph:
    """Upsert nodes; columns beyond node_id, layer and ord are attributes. They join the slice, else the active one."""
    attrs = [c for c in nodes.columns if c not in ("node_id", "layer", "ord")]
    check_names("node_attrs", attrs)
    layer = F.col("layer") if "layer" in nodes.columns else flat_layer()
    order = F.col("ord").cast("long") if "ord" in nodes.columns else F.lit(None).cast("long")
    rows = nodes.where("node_id is not null").select("node_id", layer.alias("layer"), F.lit("node").alias("kind"), order.alias("ord")).dropDuplicates(["node_id", "layer"])
    out = {"entities": with_entities(g.entities, rows)}
    if attrs:
        out["node_attrs"] = upsert(g.node_attrs, nodes.select("node_id", *attrs).dropDuplicates(["node_id"]), ("node_id",))
    where = slice or g.active_slice
    out["slice_nodes"] = g.slice_nodes.unionByName(rows.select(F.lit(where).alias("slice_id"), "node_id").distinct()).distinct()
    if where != DEFAULT_SLICE:
        out["slices"] = with_slices(g, g.spark.createDataFrame([(where,)], "slice_id string"))
    return g.having(**out)


def with_entities(old: DataFrame, *new: DataFrame) -> DataFrame:
    """Entities and those of further frames that aren't among them; each frame is read once, so plans of many edits stay small."""
    rows = old.withColumn("_k", F.lit(0))
    for k, df in enumerate(new, 1):
        rows = rows.unionByName(df.withColumn("_k", F.lit(k)), allowMissingColumns=True)
    first = rows.groupBy("node_id", "layer").agg(F.min_by(F.struct("kind", "ord"), "_k").alias("x"))
    return first.select("node_id", "layer", "x.kind", "x.ord")


def with_slices(g: Graph, ids: DataFrame) -> DataFrame:
    rows = g.slices.unionByName(ids.select("slice_id").distinct(), allowMissingColumns=True)
    return rows.groupBy("slice_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in g.slices.columns if c != "slice_id"))


def entry(node: Column, coef: Column | None = None, layer: Column | None = None) -> Column:
    return F.struct(node.cast("string").alias("node_id"), (layer if layer is not None else flat_layer()).alias("layer"), (coef if coef is not None else F.lit(None)).cast("double").alias("coef"))


def layer_kind(layers: Column, nodes: Column, hyper: Column) -> Column:
    """intra within a layer, coupling between layers of one node, else inter."""
    return F.when(F.size(F.array_distinct(layers)) <= 1, "intra").when(F.size(F.array_distinct(nodes)) == 1, "coupling").otherwise("inter")


def add_edges(g: Graph, edges: DataFrame, slice: str | None = None, unique: bool = False) -> Graph:
    """Add or replace edges, one row each.

    Shapes by columns: source, target (with source_layer, target_layer); members; head, tail (head is the
    source side); coefs, a map of signed coefficients (those above 0 are targets). Others: edge_id, weight, directed, as_entity,
    policy, slice, slice_weight, ord; the rest are attributes. Of rows with one identifier the last by ord wins, without
    an ord the greatest as text. Rows without identifiers are named by their ends, source→target; parallel ones get #1, #2 and so on,
    behind those that are there; unique says that identifiers are given and none comes twice. Endpoints that are missing become nodes; an identifier given again replaces the edge but keeps its policy.
    """
    have = set(edges.columns)
    shape = {"edge_id", "source", "target", "source_layer", "target_layer", "members", "head", "tail", "coefs", "weight", "directed", "as_entity", "policy", "slice", "slice_weight", "ord"}
    attrs = [c for c in edges.columns if c not in shape]
    check_names("edge_attrs", attrs)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    none = F.lit(None).cast(f"array<{ENTRY}>")

    def side(name: str) -> Column:
        return F.transform(F.col(name), lambda x: entry(x)) if name in have else none

    def ends(name: str) -> Column:
        if name not in have:
            return none
        layer = F.coalesce(col(f"{name}_layer", "array<string>"), flat_layer())
        return F.when(F.col(name).isNotNull(), F.array(entry(F.col(name), layer=layer)))

    if "coefs" in have:
        pairs = F.transform(F.map_entries("coefs"), lambda e: entry(e["key"], e["value"]))
        first = F.filter(pairs, lambda e: e["coef"] <= 0)
        second = F.filter(pairs, lambda e: e["coef"] > 0)
    else:
        first = second = none
    nonempty = lambda c: F.when(F.size(c) > 0, c)
    hyper = (F.col("members").isNotNull() if "members" in have else F.lit(False)) | (F.col("head").isNotNull() if "head" in have else F.lit(False)) | (F.col("coefs").isNotNull() if "coefs" in have else F.lit(False))
    rows = edges.select(
        *(F.col(c) for c in attrs),
        (F.col("edge_id").cast("string") if "edge_id" in have else F.lit(None).cast("string")).alias("edge_id"),
        nonempty(F.coalesce(side("head"), side("members"), first, ends("source"))).alias("side_a"),
        nonempty(F.coalesce(side("tail"), second, ends("target"))).alias("side_b"),
        hyper.alias("hyper"),
        (F.col("coefs").isNotNull() if "coefs" in have else F.lit(False)).alias("explicit"),
        F.coalesce(col("weight", "double"), F.lit(1.0)).alias("weight"),
        col("directed", "boolean").alias("declared_directed"),
        F.coalesce(col("as_entity", "boolean"), F.lit(False)).alias("as_entity"),
        (F.col("policy") if "policy" in have else F.lit(None).cast(dict(g.edges.dtypes)["policy"])).alias("policy"),
        F.coalesce(col("slice", "string"), F.lit(slice or g.active_slice)).alias("slice_id"),
        col("slice_weight", "double").alias("slice_weight"),
        col("ord", "long").alias("ord"),
    )
    as_text = F.to_json(F.struct(*(c for c in rows.columns if not c.startswith("_"))))
    if "edge_id" not in have:
        ids = lambda c: F.array_join(F.transform(c, lambda e: e["node_id"]), "+")
        rows = rows.withColumn("edge_id", F.concat_ws("→", ids("side_a"), ids("side_b")))
        taken = g.edges.select(F.regexp_replace("edge_id", "#[0-9]{1,9}$", "").alias("edge_id"), F.expr("coalesce(try_cast(regexp_extract(edge_id, '#([0-9]{1,9})$', 1) as int), 0) + 1").alias("_t")).groupBy("edge_id").agg(F.max("_t").alias("_t"))
        number = F.coalesce("_t", F.lit(0)) + F.row_number().over(Window.partitionBy("edge_id").orderBy(F.asc_nulls_last("ord"), as_text)) - 1
        rows = rows.join(taken, "edge_id", "left").withColumn("_k", number).withColumn("edge_id", F.when(F.col("_k") > 0, F.concat_ws("#", "edge_id", F.col("_k").cast("string"))).otherwise(F.col("edge_id"))).drop("_k", "_t")
    elif not unique:
        last = Window.partitionBy("edge_id").orderBy(F.desc_nulls_last("ord"), as_text.desc())
        rows = rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    empty_side = F.array().cast(f"array<{ENTRY}>")
    everything = F.concat(F.coalesce("side_a", empty_side), F.coalesce("side_b", empty_side))
    rows = rows.withColumn("all", everything)
    kind = F.when(F.size("all") == 0, STUB).when(F.col("as_entity"), NODE_EDGE).when(F.col("hyper"), HYPER).otherwise(BINARY)
    directed = F.when(F.col("hyper"), F.col("side_b").isNotNull()).otherwise(F.coalesce(F.col("declared_directed"), F.lit(g.directed), F.lit(True)))
    layers = F.transform("all", lambda e: e["layer"])
    rows = rows.withColumn("kind", kind).withColumn("is_directed", directed).withColumn("ml_kind", layer_kind(layers, F.transform("all", lambda e: e["node_id"]), F.col("hyper"))).withColumn("ml_layers", F.array_distinct(layers))
    role = F.when(F.col("side") == 1, -1).when(F.col("side_b").isNull() & F.col("hyper") | F.col("side_b").isNull(), 0).otherwise(1).cast("byte")
    sign = F.when((F.col("side") == 1) & F.col("is_directed"), -F.col("weight")).otherwise(F.col("weight"))
    exploded = rows.select("edge_id", "weight", "explicit", "is_directed", "hyper", "side_b", F.posexplode(F.concat(F.transform(F.coalesce("side_a", empty_side), lambda e: F.struct(F.lit(0).alias("side"), e.alias("e"))), F.transform(F.coalesce("side_b", empty_side), lambda e: F.struct(F.lit(1).alias("side"), e.alias("e"))))).alias("pos", "x"))
    exploded = exploded.select("*", F.col("x.side").alias("side"), F.col("x.e.node_id").alias("node_id"), F.col("x.e.layer").alias("layer"), F.col("x.e.coef").alias("given"))
    members = exploded.select("edge_id", "node_id", "layer", role.alias("role"), F.when(F.col("explicit"), F.coalesce("given", F.lit(0.0))).otherwise(sign).alias("coef"), "pos")
    fresh = rows.select(*CORE)
    old = g.edges.select("edge_id", F.col("policy").alias("kept"))
    fresh = fresh.join(old, "edge_id", "left").withColumn("policy", F.coalesce("policy", "kept")).select(*CORE)
    ids = rows.select("edge_id")
    as_entities = rows.where(F.col("as_entity") | (F.col("kind") == STUB)).select(F.col("edge_id").alias("node_id"), flat_layer().alias("layer"), F.lit("edge_entity").alias("kind"))
    new_nodes = members.select("node_id", "layer", F.lit("node").alias("kind"))
    out = {
        "edges": g.edges.join(ids, "edge_id", "left_anti").unionByName(fresh),
        "members": g.members.join(ids, "edge_id", "left_anti").unionByName(members),
        "entities": with_entities(g.entities, as_entities, new_nodes),
        "slice_edges": g.slice_edges.unionByName(rows.select("slice_id", "edge_id")).distinct(),
        "slices": with_slices(g, rows.select("slice_id")),
    }
    touched = rows.select("slice_id", "edge_id").join(members.select("edge_id", "node_id"), "edge_id").select("slice_id", "node_id")
    out["slice_nodes"] = g.slice_nodes.unionByName(touched).distinct()
    if "slice_weight" in have:
        over = rows.where("slice_weight is not null").select("slice_id", "edge_id", F.col("slice_weight").alias("weight"))
        out["edge_slice_attrs"] = upsert(g.edge_slice_attrs, over, ("slice_id", "edge_id"))
    if attrs:
        out["edge_attrs"] = upsert(g.edge_attrs, rows.select("edge_id", *attrs), ("edge_id",))
    return g.having(**out)


def propagate(g: Graph, edge_ids: DataFrame, mode: str) -> Graph:
    """Carry edges to other slices: `shared` to those that hold all their nodes, `all` to those that hold any; `none`."""
    if mode == "none":
        return g
    if mode not in ("shared", "all"):
        raise ValueError(f"unknown propagation: {mode}")
    ends = g.members.join(edge_ids.select("edge_id").distinct(), "edge_id", "left_semi").select("edge_id", "node_id").distinct()
    size = ends.groupBy("edge_id").agg(F.count("*").alias("n"))
    hits = ends.join(g.slice_nodes, "node_id").groupBy("slice_id", "edge_id").agg(F.count("*").alias("k")).join(size, "edge_id")
    found = hits.where("k = n" if mode == "shared" else "k > 0").select("slice_id", "edge_id")
    nodes = found.join(ends, "edge_id").select("slice_id", "node_id")
    return g.having(slice_edges=g.slice_edges.unionByName(found).distinct(), slice_nodes=g.slice_nodes.unionByName(nodes).distinct())


def parallel_of(g: Graph, edges: DataFrame) -> DataFrame:
    """(edge_id, of): existing edges with the same endpoint set and the same kind as rows (edge_id, nodes, hyper); direction is ignored."""
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "\x01")
    held = g.members.groupBy("edge_id").agg(F.collect_set("node_id").alias("nodes")).join(g.edges.select("edge_id", (F.col("kind") == HYPER).alias("hyper"), "ord"), "edge_id")
    held = held.select(F.col("edge_id").alias("of"), key(F.col("nodes")).alias("key"), "hyper", "ord")
    return edges.select("edge_id", key(F.col("nodes")).alias("key"), "hyper").join(held, ["key", "hyper"]).groupBy("edge_id").agg(F.max_by("of", F.struct("ord", "of")).alias("of"))


def get_or_create_by_attrs(g: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Nodes by the graph's composite key; unknown keys become nodes named after them. Returns the graph and (key columns, node_id)."""
    from tessera.functions import composite_id

    keys = list(g.node_key)
    if not keys:
        raise ValueError("the graph has no composite node key")
    known = g.node_attrs.select("node_id", *keys) if all(k in g.node_attrs.columns for k in keys) else g.spark.createDataFrame([], "node_id string, " + ", ".join(f"`{k}` string" for k in keys))
    found = rows.select(*keys).distinct().join(known, keys, "left")
    named = found.withColumn("node_id", F.coalesce("node_id", composite_id({k: F.col(k) for k in keys})))
    return add_nodes(g, named), named


def set_node_key(g: Graph, *fields: str) -> Graph:
    """Declare that these attributes name a node; nodes that share all of them are an error."""
    twice = g.node_attrs.select(*fields).dropna().groupBy(*fields).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"nodes share the key {twice[0].asDict()}")
    return g.but(node_key=tuple(fields))


def placeholder_layer(k: int) -> Column:
    return F.array_repeat(F.lit(PLACEHOLDER), k)
