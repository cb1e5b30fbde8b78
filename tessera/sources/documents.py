"""Line and document formats: JSON lines, node-link JSON, SIF, CX2."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import clean
from tessera.model import HYPER, SCHEMAS, Graph, empty
from tessera.operators import query
from tessera.operators.build import add_edges, add_nodes

SIF_COMMENTS = r"^\s*[#!]"


def in_order(parts: list[DataFrame]) -> DataFrame:
    """Text rows of several frames (value, optional key) one after another; written, the files in order are the document.

    Partitions of a union follow each other as its frames do, so nothing is dealt again; rows with a key are sorted within theirs.
    """
    out = None
    for df in parts:
        rows = df.sortWithinPartitions("key").select("value") if "key" in df.columns else df.select("value")
        out = rows if out is None else out.unionAll(rows)
    return out


def written(df: DataFrame, path: str, compression: str = "none") -> None:
    """Text parts, packed at the level that costs least time if at all."""
    df.write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED").text(path, compression=compression)


def write_ndjson(g: Graph, path: str) -> None:
    """A folder of JSON lines for every table; the schema of attributes is kept beside it."""
    for name in SCHEMAS:
        g.tables[name].write.mode("overwrite").json(f"{path}/{name}")
    note = json.dumps({"directed": g.directed, "active_slice": g.active_slice, "node_key": list(g.node_key), "uns": g.uns, "schemas": {n: g.tables[n].schema.json() for n in SCHEMAS}}, default=str)
    g.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def read_ndjson(spark: SparkSession, path: str) -> Graph:
    note = json.loads("".join(r.value for r in spark.read.text(f"{path}/note").collect()))
    tables = {n: spark.read.schema(T.StructType.fromJson(json.loads(s))).json(f"{path}/{n}") for n, s in note["schemas"].items()}
    return Graph(spark, tables, note["directed"], note["active_slice"], tuple(note["node_key"]), note["uns"])


def node_link(g: Graph) -> DataFrame:
    """Lines of a node-link document: nodes, links in true direction, hyperedges."""
    nodes = g.nodes().select("node_id").join(g.node_attrs, "node_id", "left").select(F.col("node_id").alias("key"), F.to_json(F.struct(F.col("node_id").alias("id"), *(c for c in g.node_attrs.columns if c != "node_id"))).alias("value"))
    pairs = query.edge_pairs(g).where(F.col("kind") != HYPER).join(g.edges.select("edge_id", "weight"), "edge_id").join(g.edge_attrs, "edge_id", "left")
    links = pairs.select(F.col("edge_id").alias("key"), F.to_json(F.struct("source", "target", F.col("edge_id").alias("id"), "weight", F.col("is_directed").alias("directed"), *(c for c in g.edge_attrs.columns if c != "edge_id"))).alias("value"))
    hyper = query.hyperedges(g)
    hyper = hyper.select(F.col("edge_id").alias("key"), F.to_json(F.struct(F.col("edge_id").alias("id"), "directed", "weight", "head", "tail", "members")).alias("value"))

    def line(text: str) -> DataFrame:
        return g.spark.createDataFrame([(text,)], "value string")

    def listed(df: DataFrame) -> DataFrame:
        return df.withColumn("value", F.concat("value", F.lit(",")))

    return in_order([line(f'{{"directed": {json.dumps(g.directed)}, "graph": {json.dumps(g.uns, default=str)}, "nodes": ['), listed(nodes), line('null], "links": ['), listed(links), line('null], "hyperedges": ['), listed(hyper), line("null]}")])


def write_json(g: Graph, path: str) -> None:
    node_link(g).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Graph:
    """A node-link document that was written in parts, line by line."""
    rows = spark.read.text(path).select(F.rtrim(F.col("value")).alias("value"))
    body = rows.where(F.col("value").startswith("{") & F.col("value").endswith(",")).select(F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    link = F.get_json_object("value", "$.source").isNotNull()
    hyper = ~link & (F.get_json_object("value", "$.members").isNotNull() | F.get_json_object("value", "$.head").isNotNull())
    head = rows.where(F.col("value").startswith('{"directed"') & F.col("value").endswith("[")).limit(1).collect()
    directed = json.loads(head[0].value + "]}")["directed"] if head else None
    g = add_nodes(empty(spark, directed), from_lines(spark, body.where(~link & ~hyper), {"id": "node_id"}))
    g = add_edges(g, from_lines(spark, body.where(link), {"id": "edge_id"}))
    h = body.where(hyper).select(F.from_json("value", "id string, weight double, head array<string>, tail array<string>, members array<string>").alias("x")).select(F.col("x.id").alias("edge_id"), "x.weight", "x.head", "x.tail", "x.members")
    return add_edges(g, h)


INTEGER, NUMBER = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
KINDS = {"bigint": INTEGER, "double": NUMBER, "boolean": "^(true|false)$"}


def typed(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns cast to the narrowest of integer, number and boolean that all their values are; ids stay text."""
    tests = [c for c in columns if c not in keep]
    if not tests:
        return df
    rules = [(F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(p)), F.lit(False)).alias(f"{k}:{c}")) for c in tests for k, p in KINDS.items()]
    row = df.agg(*rules).first().asDict()
    for c in tests:
        kind = next((k for k in KINDS if row[f"{k}:{c}"]), None)
        if kind:
            df = df.withColumn(c, F.col(f"`{c}`").cast(kind))
    return df


def from_lines(spark: SparkSession, lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of flat JSON lines: a column for every name that occurs, typed by its values."""
    found = [r.k for r in lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().collect()]
    keys = sorted(set(found) | set(names))
    df = lines.select(F.from_json("value", T.StructType([T.StructField(k, T.StringType()) for k in keys])).alias("x")).select("x.*")
    df = typed(df, keys, tuple(names) + ("source", "target"))
    return df.withColumnsRenamed(names)


# SIF


def write_sif(g: Graph, path: str, relation: str = "relation", default: str = "interacts_with") -> None:
    """Lines `source TAB relation TAB target` of binary edges; nodes without edges stand alone."""
    pairs = query.edge_pairs(g).where(F.col("kind") != HYPER).join(g.edge_attrs, "edge_id", "left")
    name = F.coalesce(F.col(relation).cast("string"), F.lit(default)) if relation in g.edge_attrs.columns else F.lit(default)
    lines = pairs.select(F.concat_ws("\t", "source", name, "target").alias("value"))
    lone = query.orphans(g).select(F.col("node_id").alias("value"))
    lines.unionAll(lone).write.mode("overwrite").text(path)


def read_sif(spark: SparkSession, path: str, directed: bool = True, delimiter: str | None = None) -> Graph:
    """Lines split at tabs if they have any, else at white space; further fields are more targets of the same source."""
    rows = spark.read.text(path).where(~F.col("value").rlike(SIF_COMMENTS) & (F.trim("value") != ""))
    cut = F.split("value", delimiter) if delimiter else F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = rows.select(F.transform(cut, lambda x: F.trim(x)).alias("f"))
    lone = rows.where(F.size("f") == 1).select(F.col("f")[0].alias("node_id"))
    links = rows.where(F.size("f") >= 3).select(F.col("f")[0].alias("source"), F.col("f")[1].alias("relation"), F.explode(F.slice("f", 3, 1_000_000)).alias("target"))
    links = links.where(clean(F.col("source")).isNotNull() & clean(F.col("target")).isNotNull() & (F.lower("target") != "none"))
    links = links.groupBy("source", "relation", "target").agg(F.count("*").alias("n")).select("source", "relation", "target", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    edges = links.select(F.concat_ws("|", "source", "relation", "target", "k").alias("edge_id"), "source", "target", "relation", F.lit(directed).alias("directed"))
    return add_nodes(add_edges(empty(spark, directed), edges), lone)


# CX2

# fixed value: largest number of a node, as JSON readers take whole numbers up to 2**53 as they are
MOST = (1 << 53) - 1


def number(name: Column) -> Column:
    """Number of a node by its name alone, so that arcs need no join for it."""
    return F.xxhash64(name).bitwiseAND(F.lit(MOST))


def write_cx2(g: Graph, path: str, name: str = "graph", compression: str = "none") -> None:
    """Aspects of a CX2 document, an element a line; hyperedges as nodes he::<id> with arcs to and from them. Parts may be packed (gzip).

    Nodes are numbered by hash; if two share a number or an arc ends at none of them, they are numbered in order and joined.
    """
    from tessera.operators.matrices import dense_rows
    from tessera.operators.project import plain
    from tessera.operators.spectral import stored

    arcs = plain(g, "reify")
    named = g.entities.where(F.col("kind") == "node").select("node_id").unionAll(g.edges.where(F.col("kind") == HYPER).select(F.concat(F.lit("he::"), "edge_id")))
    ends = named.withColumn("known", F.lit(True)).unionAll(g.members.select("node_id", F.lit(False)))
    ids = stored(ends.groupBy(number(F.col("node_id")).alias("cx"), "node_id").agg(F.max("known").alias("known")))
    if ids.where("not known").isEmpty() and ids.groupBy("cx").count().where("count > 1").isEmpty():
        ids = ids.select("node_id", "cx")
        rows = arcs.withColumns({"s": number(F.col("source")), "t": number(F.col("target"))})
    else:
        ids = dense_rows(ids.where("known").select("node_id"), "cx", "node_id")
        rows = arcs.join(ids.select(F.col("node_id").alias("source"), F.col("cx").alias("s")), "source").join(ids.select(F.col("node_id").alias("target"), F.col("cx").alias("t")), "target")
    numbered = ids.join(g.node_attrs, "node_id", "left")
    attrs = [c for c in g.node_attrs.columns if c != "node_id"]
    text = [c for c in attrs if dict(g.node_attrs.dtypes)[c] == "string"]
    values = F.struct(F.col("node_id").alias("name"), *((F.coalesce(F.col(c), F.lit("")) if c in text else F.col(c)).alias(c) for c in attrs))
    nodes = numbered.select(F.lpad(F.col("cx").cast("string"), 18, "0").alias("key"), F.to_json(F.struct(F.col("cx").alias("id"), values.alias("v"))).alias("value"))
    edges = rows.select(F.to_json(F.struct(F.xxhash64("edge_id", "source", "target").alias("id"), "s", "t", F.struct("edge_id", "weight", "directed").alias("v"))).alias("value"))

    def line(text: str) -> DataFrame:
        return g.spark.createDataFrame([(text,)], "value string")

    def listed(df: DataFrame) -> DataFrame:
        return df.withColumn("value", F.concat("value", F.lit(",")))

    head = [{"CXVersion": "2.0", "hasFragments": False}, {"networkAttributes": [{"name": name}]}]
    written(in_order([line("[" + ",".join(map(json.dumps, head)) + ', {"nodes": ['), listed(nodes), line('null]}, {"edges": ['), listed(edges), line('null]}, {"status": [{"success": true}]}]')]), path, compression)


def read_cx2(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """Nodes by name, edges by their edge_id; reified hyperedges become hyperedges again.

    Elements are read once and stored. An end of an arc whose number is that of he::<edge_id> needs no join; that such a node is there
    is seen when arcs are grouped by edge. If it isn't, or if the other end is no plain node, all arcs are joined at both ends.
    """
    from tessera.operators.spectral import stored

    rows = spark.read.text(path).select(F.rtrim("value").alias("value")).where(F.col("value").startswith('{"id"'))
    body = rows.select(F.from_json(F.expr("substring(value, 1, length(value) - 1)"), "id string, s string, t string, v string").alias("x"))
    body = body.select("x.*", F.from_json("x.v", "name string, edge_id string, weight string, directed string").alias("w"))
    own = number(F.concat(F.lit("he::"), F.col("w.edge_id"))).cast("string")
    into, out = F.coalesce(own == F.col("t"), F.lit(False)), F.coalesce(own == F.col("s"), F.lit(False))
    kind = F.when(F.col("s").isNotNull(), F.when(into | out, "own").otherwise("arc")).otherwise(F.when(F.col("w.name").startswith("he::"), "hyper").otherwise("plain"))
    body = body.select("id", "s", "t", "v", "w.*", kind.alias("kind"), out.alias("out"))
    node, arc, quick = F.col("kind").isin("hyper", "plain"), ~F.col("kind").isin("hyper", "plain"), F.col("kind") == "own"
    held = stored(
        body.select(
            F.when(node, F.col("id")).alias("cx"), F.when(node, F.col("name")).alias("node_id"), F.when(F.col("kind") == "plain", F.col("v")).alias("v"),
            F.when(arc, F.col("edge_id")).alias("edge_id"), F.when(arc, F.col("weight").cast("double")).alias("weight"), F.when(arc, F.col("directed").cast("boolean")).alias("directed"),
            F.when(~quick | ~F.col("out"), F.col("s")).alias("s"), F.when(~quick | F.col("out"), F.col("t")).alias("t"), "kind",
        ),
        "kind",
    )
    nodes = held.where(node).select("cx", "node_id", "v", "kind")

    def joined(links: DataFrame) -> DataFrame:
        """Arcs with the names of both ends; numbers of hyperedges that are no longer held are made again."""
        own = number(F.concat(F.lit("he::"), F.col("edge_id"))).cast("string")
        links = links.select("edge_id", "weight", "directed", F.coalesce("s", own).alias("s"), F.coalesce("t", own).alias("t"))
        links = links.join(nodes.select(F.col("cx").alias("s"), F.col("node_id").alias("source")), "s").join(nodes.select(F.col("cx").alias("t"), F.col("node_id").alias("target")), "t")
        return links.select("edge_id", "source", "target", "weight", "directed", F.lit(True).alias("sure"))

    def guessed(links: DataFrame) -> DataFrame:
        """Arcs with the name of the end that is no hyperedge; `sure` unless that is no plain node."""
        links = links.select("edge_id", "weight", "directed", F.col("s").isNull().alias("out"), F.coalesce("s", "t").alias("cx"))
        links = links.join(nodes.where("kind = 'plain'").select("cx", F.col("node_id").alias("end")), "cx", "left")
        he = F.concat(F.lit("he::"), F.col("edge_id"))
        return links.select("edge_id", F.when(F.col("out"), he).otherwise(F.col("end")).alias("source"), F.when(F.col("out"), F.col("end")).otherwise(he).alias("target"), "weight", "directed", F.col("end").isNotNull().alias("sure"))

    def sides_of(links: DataFrame, guess: DataFrame | None) -> DataFrame:
        """Hyperedges with their sides; `sure` unless an arc isn't or the node of guessed ones is missing."""
        side = links.select("edge_id", "weight", F.col("directed").alias("d"), F.when(F.col("source").startswith("he::"), F.col("target")).alias("head"), F.when(F.col("target").startswith("he::"), F.col("source")).alias("tail"), "sure", F.lit(False).alias("guess"), F.lit(False).alias("there"))
        if guess is not None:
            side = side.unionAll(guess.select("edge_id", "weight", "directed", F.when(F.col("source").startswith("he::"), F.col("target")), F.when(F.col("target").startswith("he::"), F.col("source")), "sure", F.lit(True), F.lit(False)))
            there = nodes.where("kind = 'hyper'").where(number(F.col("node_id")).cast("string") == F.col("cx"))
            nothing = [F.lit(None).cast(k) for k in ("double", "boolean", "string", "string")]
            side = side.unionAll(there.select(F.expr("substring(node_id, 5)"), *nothing, F.lit(True), F.lit(False), F.lit(True)))
        sides = side.groupBy("edge_id").agg(
            F.max("weight").alias("weight"), F.max("d").alias("d"), F.array_sort(F.collect_set("head")).alias("head"), F.array_sort(F.collect_set("tail")).alias("tail"),
            F.count(F.when(~F.col("there"), 1)).alias("n"), (F.min("sure") & (~F.max("guess") | F.max("there"))).alias("sure"),
        )
        both = F.array_sort(F.array_union("head", "tail"))
        return stored(sides.where("n > 0").select("edge_id", "weight", F.when(F.col("d"), F.col("head")).alias("head"), F.when(F.col("d"), F.col("tail")).alias("tail"), F.when(~F.col("d"), both).alias("members"), "sure"))

    def told(links: DataFrame) -> DataFrame:
        """What has no rows is left out of the plan."""
        return links.where(F.lit(False)) if links.isEmpty() else links

    he = F.col("source").startswith("he::") | F.col("target").startswith("he::")
    links = joined(told(held.where("kind = 'arc'")))
    sides = sides_of(links.where(he), guessed(told(held.where(quick))))
    if not sides.where("not sure").isEmpty():
        links = joined(held.where(arc))
        sides = sides_of(links.where(he), None)
    g = add_edges(empty(spark, directed), links.where(~he).drop("sure"))
    g = add_edges(g, sides.drop("sure"), unique=True)
    return add_nodes(g, from_lines(spark, nodes.where("kind = 'plain'").select(F.col("v").alias("value")), {"name": "node_id"}))
