"""Hand-sized graphs: every shape of edge against hand-derived matrices, degrees and neighbours."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import layer_id
from tessera.model import BINARY, NODE_EDGE, empty
from tessera.operators import algebra, attrs, build, history, layers, matrices, query
from tessera.operators.spectral import settle


def edges(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def shape(spark, name):
    if name not in MADE:
        MADE[name] = settle(made(spark, name))
    return MADE[name]


MADE = {}


def made(spark, name):
    b = "edge_id string, source string, target string, weight double"
    if name == "binary_directed":
        return build.add_edges(empty(spark, True), edges(spark, [("e_ab", "A", "B", 1.5), ("e_bc", "B", "C", 2.0)], b))
    if name == "binary_undirected":
        return build.add_edges(empty(spark, False), edges(spark, [("e_ab", "A", "B", 1.0), ("e_bc", "B", "C", 3.0)], b))
    if name == "self_loop":
        return build.add_edges(empty(spark, True), edges(spark, [("e_loop", "A", "A", 0.5), ("e_ab", "A", "B", 1.0)], b))
    if name == "parallel_edge":
        return build.add_edges(empty(spark, True), edges(spark, [("e_first", "A", "B", 1.0), ("e_second", "A", "B", 2.0)], b))
    if name == "hyper_undirected":
        return build.add_edges(empty(spark, False), edges(spark, [("h_abc", ["A", "B", "C"])], "edge_id string, members array<string>"))
    if name == "hyper_directed":
        return build.add_edges(empty(spark, True), edges(spark, [("h_ab_c", ["A", "B"], ["C"])], "edge_id string, head array<string>, tail array<string>"))
    if name == "edge_entity":
        return build.add_edges(empty(spark, True), edges(spark, [("ee_ab", "A", "B", True), ("e_meta", "ee_ab", "C", False)], "edge_id string, source string, target string, as_entity boolean"))
    if name == "placeholder_edge":
        return build.add_edges(empty(spark, True), edges(spark, [("e_ab", "A", "B"), ("e_later", None, None)], "edge_id string, source string, target string"))
    if name == "boundary_edge":
        g = build.add_edges(empty(spark, True), edges(spark, [("e_ab", "A", "B", 1.0)], b))
        return build.add_edges(g, edges(spark, [("b_out", {"A": -1.0}), ("b_in", {"A": 1.0})], "edge_id string, coefs map<string,double>"))
    if name == "coefficient_edge":
        return build.add_edges(empty(spark, True), edges(spark, [("r_1", {"A": -2.0, "B": -1.0, "C": 3.0})], "edge_id string, coefs map<string,double>"))
    if name == "multilayer":
        g = layers.set_aspects(empty(spark, True), {"phase": ["t0", "t1"]})
        rows = [("e_t0", "A", ["t0"], "B", ["t0"]), ("e_t1", "A", ["t1"], "B", ["t1"]), ("e_couple", "A", ["t0"], "A", ["t1"])]
        return build.add_edges(g, edges(spark, rows, "edge_id string, source string, source_layer array<string>, target string, target_layer array<string>"))
    raise KeyError(name)


S = {
    "binary_directed": {("A", "e_ab"): 1.5, ("B", "e_ab"): -1.5, ("B", "e_bc"): 2, ("C", "e_bc"): -2},
    "binary_undirected": {("A", "e_ab"): 1, ("B", "e_ab"): 1, ("B", "e_bc"): 3, ("C", "e_bc"): 3},
    "self_loop": {("A", "e_ab"): 1, ("B", "e_ab"): -1},
    "parallel_edge": {("A", "e_first"): 1, ("B", "e_first"): -1, ("A", "e_second"): 2, ("B", "e_second"): -2},
    "hyper_undirected": {("A", "h_abc"): 1, ("B", "h_abc"): 1, ("C", "h_abc"): 1},
    "hyper_directed": {("A", "h_ab_c"): 1, ("B", "h_ab_c"): 1, ("C", "h_ab_c"): -1},
    "edge_entity": {("A", "ee_ab"): 1, ("B", "ee_ab"): -1, ("ee_ab", "e_meta"): 1, ("C", "e_meta"): -1},
    "placeholder_edge": {("A", "e_ab"): 1, ("B", "e_ab"): -1},
    "boundary_edge": {("A", "b_out"): -1, ("A", "b_in"): 1, ("A", "e_ab"): 1, ("B", "e_ab"): -1},
    "coefficient_edge": {("A", "r_1"): -2, ("B", "r_1"): -1, ("C", "r_1"): 3},
}
A = {
    "binary_directed": {("A", "B"): 1.5, ("B", "C"): 2}, "binary_undirected": {("A", "B"): 1, ("B", "A"): 1, ("B", "C"): 3, ("C", "B"): 3},
    "self_loop": {("A", "A"): 0.5, ("A", "B"): 1}, "parallel_edge": {("A", "B"): 3}, "hyper_undirected": {}, "hyper_directed": {},
    "edge_entity": {("A", "B"): 1, ("ee_ab", "C"): 1}, "placeholder_edge": {("A", "B"): 1}, "boundary_edge": {("A", "B"): 1}, "coefficient_edge": {},
}
DEGREE = {
    "binary_directed": ("A1 B2 C1", "A1 B2 C1"), "binary_undirected": ("A1 B2 C1", "A1 B2 C1"), "self_loop": ("A1 B1", "A3 B1"), "parallel_edge": ("A2 B2", "A2 B2"),
    "hyper_undirected": ("A1 B1 C1", "A1 B1 C1"), "boundary_edge": ("A3 B1", "A3 B1"), "coefficient_edge": ("A1 B1 C1", "A1 B1 C1"), "placeholder_edge": ("A1 B1 e_later0", "A1 B1 e_later0"),
}


@pytest.mark.parametrize("name", sorted(S))
def test_matrices(spark, name):
    g = shape(spark, name)
    assert {(r.node_id, r.edge_id): r.value for r in matrices.incidence(g).collect()} == S[name]
    assert {(r.i, r.j): r.value for r in matrices.adjacency(g).collect()} == A[name]
    assert history.violations(g).count() == 0


@pytest.mark.parametrize("name", sorted(DEGREE))
def test_degrees(spark, name):
    g = shape(spark, name)
    for f, want in zip((matrices.degree, matrices.member_degree), DEGREE[name]):
        assert " ".join(f"{r.node_id}{r.degree}" for r in f(g).orderBy("node_id").collect()) == want


def test_multilayer(spark):
    g = shape(spark, "multilayer")
    kinds = {r.edge_id: r.ml_kind for r in g.edges.collect()}
    assert kinds == {"e_t0": "intra", "e_t1": "intra", "e_couple": "coupling"}
    cells = {tuple(x.replace(layers.KEY, "@") for x in (r.i, r.j)): r.value for r in layers.supra_adjacency(g).collect()}
    assert cells == {("A@t0", "B@t0"): 1, ("A@t1", "B@t1"): 1, ("A@t0", "A@t1"): 1}
    rows = g.members.groupBy("node_id", layer_id(F.col("layer")).alias("l")).count().collect()
    assert {(r.node_id, r.l): r["count"] for r in rows} == {("A", "t0"): 2, ("A", "t1"): 2, ("B", "t0"): 1, ("B", "t1"): 1}


def test_self_loops_as_neighbours(spark):
    b = "edge_id string, source string, target string, directed boolean"
    g = build.add_edges(empty(spark), edges(spark, [("d", "A", "A", True), ("u", "B", "B", False)], b))
    assert [(r.node_id, r.neighbor) for r in query.neighbors(g).collect()] == [("A", "A")]


def test_directed_hyperedge_neighbours(spark):
    g = shape(spark, "hyper_directed")
    assert {(r.node_id, r.neighbor) for r in query.neighbors(g).collect()} == {("A", "C"), ("B", "C"), ("C", "A"), ("C", "B")}


def test_replacing_an_edge_and_late_rows(spark):
    b = "edge_id string, source string, target string, weight double, ord long"
    g = build.add_edges(empty(spark, True), edges(spark, [("e", "A", "B", 1.0, 0), ("e", "A", "C", 2.0, 1)], b))
    assert [(r.edge_id, r.weight) for r in g.edges.collect()] == [("e", 2.0)]
    g = build.add_edges(g, edges(spark, [("e", "A", "D", 5.0, 2)], b))
    assert sorted(r.node_id for r in g.members.collect()) == ["A", "D"]


def test_removing_an_edge_entity_takes_its_edges(spark):
    g = algebra.remove_edges(shape(spark, "edge_entity"), spark.createDataFrame([("ee_ab",)], "edge_id string"))
    assert g.edges.count() == 0 and g.members.count() == 0
    with pytest.raises(KeyError):
        algebra.remove_edges(g, spark.createDataFrame([("none",)], "edge_id string"))


def test_flexible_direction(spark):
    policy = "struct<var:string,threshold:double,scope:string,above:string,tie:string>"
    g = build.add_edges(empty(spark, True), edges(spark, [("e", "A", "B", 2.0, ("x", 0.0, "node", "s->t", "keep"))], f"edge_id string, source string, target string, weight double, policy {policy}"))
    g = attrs.set_attrs(g, "node_attrs", spark.createDataFrame([("A", 1.0), ("B", 5.0)], "node_id string, x double"))
    assert {r.node_id: r.coef for r in g.members.collect()} == {"A": -2.0, "B": 2.0}


def test_reserved_names_and_propagation(spark):
    g = shape(spark, "binary_directed")
    with pytest.raises(ValueError):
        attrs.set_attrs(g, "edge_attrs", spark.createDataFrame([("e_ab", 1)], "edge_id string, weight long"))
    g = build.add_nodes(g, spark.createDataFrame([("A",), ("B",)], "node_id string"), slice="left")
    ids = g.edges.select("edge_id")
    assert [(r.edge_id) for r in build.propagate(g, ids, "shared").slice_edges.where("slice_id = 'left'").collect()] == ["e_ab"]
    assert build.propagate(g, ids, "all").slice_edges.where("slice_id = 'left'").count() == 2


def test_parallel_edges_without_identifiers(spark):
    b = "source string, target string, weight double"
    g = build.add_edges(empty(spark, True), edges(spark, [("A", "B", 1.0), ("A", "B", 1.0), ("B", "C", 2.0)], b))
    assert sorted(r.edge_id for r in g.edges.collect()) == ["A→B", "A→B#1", "B→C"] and history.violations(g).count() == 0
    g = build.add_edges(g, edges(spark, [("A", "B", 3.0)], b))
    assert sorted((r.edge_id, r.weight) for r in g.edges.collect()) == [("A→B", 1.0), ("A→B#1", 1.0), ("A→B#2", 3.0), ("B→C", 2.0)]
    h = build.add_edges(empty(spark, False), edges(spark, [(["B", "A"],), (["C", "A"],)], "members array<string>"))
    assert h.edges.count() == 2 and matrices.hyper_incidence(h).count() == 4
    twice = build.add_edges(empty(spark, True), edges(spark, [("e", "A", "B"), ("e", "A", "C")], "edge_id string, source string, target string"))
    assert twice.edges.count() == 1 and twice.members.count() == 2 and history.violations(twice).count() == 0


def test_kinds(spark):
    g = shape(spark, "edge_entity")
    assert {r.edge_id: r.kind for r in g.edges.collect()} == {"ee_ab": NODE_EDGE, "e_meta": BINARY}
    assert algebra.structural_hash(g) == algebra.structural_hash(shape(spark, "edge_entity"))


def test_composite_keys(spark):
    g = build.set_node_key(build.add_nodes(empty(spark), spark.createDataFrame([("n1", "a b", "x")], "node_id string, p string, q string")), "p", "q")
    g, named = build.get_or_create_by_attrs(g, spark.createDataFrame([("a b", "x"), ("c d", "y*~")], "p string, q string"))
    assert {r.p: r.node_id for r in named.collect()} == {"a b": "n1", "c d": "cid:p=c%20d|q=y%2A~"}
    assert g.count_nodes() == 2
