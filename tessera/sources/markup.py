"""XML formats: GraphML, GEXF and SBML, an element a line on writing, by row tags on reading.

Documents are written in parts whose concatenation is the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import HYPER, TARGET, Graph, empty
from tessera.operators.build import add_edges, add_nodes
from tessera.operators.project import plain
from tessera.operators.spectral import stored
from tessera.sources.documents import KINDS, in_order, written

# fixed values: pseudo-species of one-sided reactions
BOUNDARY_SOURCE, BOUNDARY_SINK = "__BOUNDARY_SOURCE__", "__BOUNDARY_SINK__"


def escaped(c: Column) -> Column:
    text = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def line(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string")


def cells(df: DataFrame, key: str, tag: str, attribute: str) -> Column:
    """An element for every attribute that isn't null."""
    parts = [F.concat(F.lit(f'<{tag} {attribute}="{c}"'), F.lit(' value="' if tag == "attvalue" else ">"), escaped(F.col(c)), F.lit('"/>' if tag == "attvalue" else f"</{tag}>")) for c in df.columns if c != key and dict(df.dtypes)[c] in ("string", "bigint", "int", "double", "float", "boolean")]
    return F.concat_ws("", *parts) if parts else F.lit("")


def parts_of(g: Graph, hyperedge_mode: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs with their attributes."""
    nodes = g.nodes().select("node_id").join(g.node_attrs, "node_id", "left")
    arcs = plain(g, hyperedge_mode)
    if hyperedge_mode == "reify":
        he = g.edges.where(F.col("kind") == HYPER).select(F.concat(F.lit("he::"), "edge_id").alias("node_id"), F.lit(True).alias("is_hyperedge"))
        nodes = nodes.unionByName(he, allowMissingColumns=True)
    return nodes, arcs.join(g.edge_attrs, "edge_id", "left")


def write_graphml(g: Graph, path: str, hyperedge_mode: str = "reify", compression: str = "none") -> None:
    """A GraphML document in parts, which may be packed (gzip)."""
    nodes, arcs = parts_of(g, hyperedge_mode)
    names = {"string": "string", "bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}
    keys = [f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="{names[t]}"/>' for kind, df in (("node", nodes), ("edge", arcs)) for c, t in df.dtypes if t in names and c not in ("node_id", "source", "target", "edge_id")]
    n = nodes.select(F.col("node_id").alias("key"), F.concat(F.lit('<node id="'), escaped(F.col("node_id")), F.lit('">'), cells(nodes, "node_id", "data", "key"), F.lit("</node>")).alias("value"))
    own = arcs.drop("source", "target")
    e = arcs.select(F.concat(F.lit('<edge id="'), escaped(F.col("edge_id")), F.lit('" source="'), escaped(F.col("source")), F.lit('" target="'), escaped(F.col("target")), F.lit('" directed="'), F.col("directed").cast("string"), F.lit('">'), cells(own, "edge_id", "data", "key"), F.lit("</edge>")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(keys) + f'<graph edgedefault="{"undirected" if g.directed is False else "directed"}">'
    written(in_order([line(g.spark, head), n, e, line(g.spark, "</graph></graphml>")]), path, compression)


def write_gexf(g: Graph, path: str, hyperedge_mode: str = "reify", compression: str = "none") -> None:
    """A GEXF document in parts, which may be packed (gzip)."""
    nodes, arcs = parts_of(g, hyperedge_mode)
    n = nodes.select(F.col("node_id").alias("key"), F.concat(F.lit('<node id="'), escaped(F.col("node_id")), F.lit('"><attvalues>'), cells(nodes, "node_id", "attvalue", "for"), F.lit("</attvalues></node>")).alias("value"))
    own = arcs.drop("source", "target", "weight")
    e = arcs.select(F.concat(F.lit('<edge id="'), escaped(F.col("edge_id")), F.lit('" source="'), escaped(F.col("source")), F.lit('" target="'), escaped(F.col("target")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('" type="'), F.when(F.col("directed"), "directed").otherwise("undirected"), F.lit('"><attvalues>'), cells(own, "edge_id", "attvalue", "for"), F.lit("</attvalues></edge>")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph><nodes>'
    written(in_order([line(g.spark, head), n, line(g.spark, "</nodes><edges>"), e, line(g.spark, "</edges></graph></gexf>")]), path, compression)


def wide(df: DataFrame, key: str, pairs: str, name: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A column for each name in an array of (name, value) structs, typed by its values."""
    rules = [F.coalesce(F.bool_and(F.col("v").rlike(p)), F.lit(False)).alias(kind) for kind, p in KINDS.items()]
    rows = df.select(F.explode(pairs).alias("p")).select(F.col("p")[name].alias("n"), F.col("p")[value].alias("v")).where("n is not null").groupBy("n").agg(*rules).collect()
    names = {r.n: next((k for k in KINDS if r[k] and r.n not in keep), "string") for r in rows}
    held = df.withColumn("_m", F.map_from_entries(F.transform(F.coalesce(F.col(pairs), F.expr(f"cast(array() as {dict(df.dtypes)[pairs]})")), lambda p: F.struct(p[name], p[value]))))
    return held.select(*(c for c in df.columns if c != pairs), *(F.col("_m")[n].cast(kind).alias(n) for n, kind in names.items() if n not in df.columns))


def rebuilt(nodes: DataFrame, edges: DataFrame, directed: bool | None) -> Graph:
    """A graph of plain nodes and edges (edge_id, source, target, ...), reified hyperedges put together again."""
    he = F.col("source").startswith("he::") | F.col("target").startswith("he::")
    extra = [c for c in edges.columns if c not in ("edge_id", "source", "target", "weight", "directed", "kind", "edge_type")]
    two, inner = edges.where(~he), edges.where(he)
    # what has no rows is left out of the plan
    two, inner = (df.where(F.lit(False)) if df.isEmpty() else df for df in (two, inner))
    g = add_edges(empty(nodes.sparkSession, directed), two.select("edge_id", "source", "target", "weight", "directed", *extra))
    sides = inner.groupBy("edge_id").agg(F.max("weight").alias("weight"), F.max(F.col("directed")).alias("d"), F.array_sort(F.collect_set(F.when(F.col("source").startswith("he::"), F.col("target")))).alias("h"), F.array_sort(F.collect_set(F.when(F.col("target").startswith("he::"), F.col("source")))).alias("t"))
    sides = stored(sides.select("edge_id", "weight", F.when(F.col("d"), F.col("h")).alias("head"), F.when(F.col("d"), F.col("t")).alias("tail"), F.when(~F.col("d"), F.array_sort(F.array_union("h", "t"))).alias("members")))
    g = add_edges(g, sides, unique=True)
    plain_nodes = nodes.where(~F.col("node_id").startswith("he::"))
    return add_nodes(g, plain_nodes.drop("is_hyperedge"))


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of a name in all files of a document. A part of one has no root, at which Spark's default parser stops without an error; the older one looks for tags only."""
    return spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).schema(schema).load(path)


# fixed values: elements as this module writes them, an element a line; a line with any of STRAY that is none of them needs the XML parser
TEXT = '[^"<]*'
GRAPHML_NODE = f'^<node id="{TEXT}">(?:<data key="{TEXT}">{TEXT}</data>)*+</node>$'
GRAPHML_EDGE = f'^<edge id="{TEXT}" source="{TEXT}" target="{TEXT}" directed="{TEXT}">(?:<data key="{TEXT}">{TEXT}</data>)*+</edge>$'
GEXF_NODE = f'^<node id="{TEXT}"><attvalues>(?:<attvalue for="{TEXT}" value="{TEXT}"/>)*+</attvalues></node>$'
GEXF_EDGE = f'^<edge id="{TEXT}" source="{TEXT}" target="{TEXT}" weight="{TEXT}" type="{TEXT}"><attvalues>(?:<attvalue for="{TEXT}" value="{TEXT}"/>)*+</attvalues></edge>$'
STRAY, ENTITY = r"</?(?:node|edge)(?:[\s/>]|$)|<!--|<!\[", "&(?!(?:amp|lt|gt|quot);)"


def restored(c: Column) -> Column:
    """Text that `escaped` wrote."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def element_lines(spark: SparkSession, path: str, node: str, edge: str, fixed: int, step: int) -> tuple[DataFrame, DataFrame] | None:
    """Nodes (id, data) and edges (id, attributes 2 to fixed, data) of a document of an element a line, read once and stored; None if any element is written otherwise.

    Quotes occur around attributes only, so a line cut at them has the attributes at odd places. Names of data come `step` places
    after each other; a value is an attribute (4) or the text before the next tag (2).
    """
    line = F.col("value")
    what = F.when(line.contains("&") & line.rlike(ENTITY), "stray").when(line.startswith("<edge") & line.rlike(edge), "edge").when(line.startswith("<node") & line.rlike(node), "node").when(line.rlike(STRAY), "stray").otherwise("other")
    cut = spark.read.text(path).select(what.alias("what"), line.contains("&").alias("quoted"), F.split("value", '"').alias("p"))
    first = F.when(F.col("what") == "node", 3).otherwise(2 * fixed + 1)
    own = F.col("what").isin("node", "edge")

    def piece(k: Column | int) -> Column:
        return F.get("p", F.lit(k) if isinstance(k, int) else k)

    def clear(c: Column) -> Column:
        return F.when(F.col("quoted"), restored(c)).otherwise(c)

    def pair(i: Column) -> Column:
        value = piece(i + 2) if step == 4 else F.substring_index(F.substring(piece(i + 1), F.lit(2), F.length(piece(i + 1))), "<", 1)
        return F.struct(clear(piece(i)).alias("name"), clear(value).alias("value"))

    every = F.transform(F.sequence(first, F.size("p") - 2, F.lit(step)), pair)
    data = F.when(own & (F.size("p") == first + step), F.array(pair(first))).when(own & (F.size("p") > first + step), every)
    more = [F.when(F.col("what") == "edge", clear(piece(2 * k - 1))).alias(f"a{k}") for k in range(2, fixed + 1)]
    rows = stored(cut.select("what", F.when(own, clear(piece(1))).alias("a1"), *more, data.alias("data")))
    if not rows.where("what = 'stray'").isEmpty():
        return None
    return rows.where("what = 'node'").select("a1", "data"), rows.where("what = 'edge'").drop("what")


def read_graphml(spark: SparkSession, path: str) -> Graph:
    lines = element_lines(spark, path, GRAPHML_NODE, GRAPHML_EDGE, 4, 2)
    if lines:
        nodes = wide(lines[0].withColumnRenamed("a1", "node_id"), "node_id", "data", "name", "value")
        edges = wide(lines[1].toDF("edge_id", "source", "target", "given", "data"), "edge_id", "data", "name", "value")
        return graphml(nodes, edges)
    data = "array<struct<_key:string,_VALUE:string>>"
    n = elements(spark, path, "node", f"_id string, data {data}")
    e = elements(spark, path, "edge", f"_id string, _source string, _target string, _directed string, data {data}")
    nodes = wide(n.withColumnRenamed("_id", "node_id"), "node_id", "data", "_key", "_VALUE")
    edges = wide(e.toDF("edge_id", "source", "target", "given", "data"), "edge_id", "data", "_key", "_VALUE")
    return graphml(nodes, edges)


def graphml(nodes: DataFrame, edges: DataFrame) -> Graph:
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return rebuilt(nodes, edges.withColumn("weight", weight).withColumn("directed", F.coalesce(F.col("given").cast("boolean"), F.lit(True))).drop("given"), None)


def read_gexf(spark: SparkSession, path: str) -> Graph:
    lines = element_lines(spark, path, GEXF_NODE, GEXF_EDGE, 5, 4)
    if lines:
        nodes = wide(lines[0].withColumnRenamed("a1", "node_id"), "node_id", "data", "name", "value")
        edges = wide(lines[1].select(F.col("a1").alias("edge_id"), F.col("a2").alias("source"), F.col("a3").alias("target"), F.col("a4").cast("double").alias("weight"), (F.col("a5") == "directed").alias("directed"), "data"), "edge_id", "data", "name", "value")
        return rebuilt(nodes, edges, None)
    data = "struct<attvalue:array<struct<_for:string,_value:string>>>"
    n = elements(spark, path, "node", f"_id string, attvalues {data}")
    e = elements(spark, path, "edge", f"_id string, _source string, _target string, _weight double, _type string, attvalues {data}")
    nodes = wide(n.select(F.col("_id").alias("node_id"), F.col("attvalues.attvalue").alias("data")), "node_id", "data", "_for", "_value")
    edges = wide(e.select(F.col("_id").alias("edge_id"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.coalesce("_weight", F.lit(1.0)).alias("weight"), (F.coalesce("_type", F.lit("directed")) == "directed").alias("given"), F.col("attvalues.attvalue").alias("data")), "edge_id", "data", "_for", "_value")
    return rebuilt(nodes, edges.withColumn("directed", F.col("given")).drop("given"), None)


def write_sbml(g: Graph, path: str, model: str = "model") -> None:
    """Species and reactions: members with coefficients of 0 or less are reactants, others products."""
    species = g.nodes().select(F.col("node_id").alias("key"), F.concat(F.lit('<species id="'), escaped(F.col("node_id")), F.lit('" compartment="c"/>')).alias("value"))
    ref = F.concat(F.lit('<speciesReference species="'), escaped(F.col("node_id")), F.lit('" stoichiometry="'), F.abs("coef").cast("string"), F.lit('"/>'))
    members = g.members.join(g.edges.where(F.col("kind") == HYPER).select("edge_id", "explicit"), "edge_id")
    # explicit coefficients are literal; else sources are what a reaction uses up
    used = F.when(F.col("explicit"), F.col("coef") <= 0).otherwise(F.col("role") != TARGET)
    sides = members.groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(used, ref))), "").alias("r"), F.array_join(F.array_sort(F.collect_list(F.when(~used, ref))), "").alias("p"))
    reactions = sides.select(F.col("edge_id").alias("key"), F.concat(F.lit('<reaction id="'), escaped(F.col("edge_id")), F.lit('"><listOfReactants>'), "r", F.lit("</listOfReactants><listOfProducts>"), "p", F.lit("</listOfProducts></reaction>")).alias("value"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><sbml xmlns="http://www.sbml.org/sbml/level3/version2/core" level="3" version="2"><model id="{model}"><listOfCompartments><compartment id="c"/></listOfCompartments><listOfSpecies>'
    in_order([line(g.spark, head), species, line(g.spark, "</listOfSpecies><listOfReactions>"), reactions, line(g.spark, "</listOfReactions></model></sbml>")]).write.mode("overwrite").text(path)


def read_sbml(spark: SparkSession, path: str) -> Graph:
    """Reactions as hyperedges with coefficients: used up below 0, made above, modifiers -1 unless listed already; compartments as slices."""
    refs = "struct<speciesReference:array<struct<_species:string,_stoichiometry:double>>>"
    modifiers = "struct<modifierSpeciesReference:array<struct<_species:string>>>"
    r = elements(spark, path, "reaction", f"_id string, listOfReactants {refs}, listOfProducts {refs}, listOfModifiers {modifiers}")
    s = elements(spark, path, "species", "_id string, _name string, _compartment string")

    def side(name: str, sign: int) -> DataFrame:
        return r.select(F.col("_id").alias("edge_id"), F.explode(f"{name}.speciesReference").alias("x")).select("edge_id", F.col("x._species").alias("node_id"), (sign * F.coalesce("x._stoichiometry", F.lit(1.0))).alias("coef"), F.lit(0).alias("modifier"))

    more = r.select(F.col("_id").alias("edge_id"), F.explode("listOfModifiers.modifierSpeciesReference").alias("x")).select("edge_id", F.col("x._species").alias("node_id"), F.lit(-1.0).alias("coef"), F.lit(1).alias("modifier"))
    rows = side("listOfReactants", -1).unionAll(side("listOfProducts", 1)).unionAll(more).where(~F.col("node_id").isin(BOUNDARY_SOURCE, BOUNDARY_SINK))
    sums = rows.groupBy("edge_id", "node_id").agg(F.coalesce(F.sum(F.when(F.col("modifier") == 0, F.col("coef"))), F.lit(-1.0)).alias("coef"))
    edges = sums.groupBy("edge_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "coef")))).alias("coefs"), F.count_distinct(F.col("coef") > 0).alias("sides")).select("edge_id", "coefs", (F.col("sides") == 1).alias("is_boundary"))
    nodes = s.select(F.col("_id").alias("node_id"), F.col("_name").alias("name"), F.col("_compartment").alias("compartment")).where(~F.col("node_id").isin(BOUNDARY_SOURCE, BOUNDARY_SINK))
    g = add_nodes(add_edges(empty(spark, True), edges), nodes)
    from tessera.operators.build import with_slices

    held = nodes.where("compartment is not null").select(F.col("compartment").alias("slice_id"), "node_id")
    return g.having(slices=with_slices(g, held.select("slice_id")), slice_nodes=g.slice_nodes.unionByName(held).distinct())
