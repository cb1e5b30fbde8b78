"""The facade: elements, sequences, operators and dispatch."""

import pytest
from pyspark.sql import functions as F

from tessera.api import AnnotatedGraph


@pytest.fixture(scope="module")
def graph(spark):
    g = AnnotatedGraph(spark, directed=True, title="t")
    g.add_nodes(["A", ("B", {"name": "bee", "size": 2}), {"node_id": "C", "size": 3}, "lone"])
    g.add_edges([("A", "B", 2.0), ("B", "C")])
    g.add_edges("C", "C", edge_id="loop", directed=False)
    g.add_edges(edge_id="h", members=["A", "B", "C"])
    return g


def test_elements(graph):
    assert graph.shape == (4, 4) and "A" in graph and ("A", "B") in graph and ("B", "A") not in graph
    assert graph.neighbors("B") == ["A", "C"] and graph.successors("A") == ["B", "C"] and graph.predecessors("B") == ["A", "C"]
    assert graph.degree("C") == 3 and graph.degree("lone") == 0
    assert graph.get_node("B")["attrs"]["size"] == 2
    assert graph.get_edge("h")["kind"] == "hyper_undirected" and graph.get_edge("h")["source"] == ["A", "B", "C"]
    assert graph.has_edge("A", "B", edge_id="edge_0") and not graph.has_edge(edge_id="none")
    assert graph.incident_edges("A", "out") == ["edge_0", "h"]
    with pytest.raises(KeyError):
        graph.get_node("none")


def test_sequences(graph):
    assert len(graph.N) == 4 and graph.N[0] == "A" and graph.N[-1] == "lone" and list(graph.N[1:3]) == ["B", "C"]
    assert graph.N.find(size=3) == "C" and len(graph.E.select(kind="hyper")) == 1
    g = graph.copy()
    g.N["flag"] = True
    assert g.N["flag"].where("flag").count() == 4 and "flag" not in graph.value.node_attrs.columns
    with pytest.raises(KeyError):
        graph.N["none"]


def test_operators(spark, graph):
    other = AnnotatedGraph(spark, directed=True).add_edges([{"source": "A", "target": "X", "edge_id": "ax"}])
    assert (graph | other).shape == (5, 5) and (graph & other).nv == 1 and (graph - other).nv == 3
    g = graph.copy()
    g += "new"
    g -= ("A", "B")
    assert g.nv == 5 and g.ne == 3 and g.remove_orphans() == 2
    assert graph.subgraph(["A", "B"]).ne == 1 and graph.reverse().has_edge("B", "A")
    assert graph.validate() == [] and "4 nodes" in repr(graph)


def test_namespaces(graph):
    g = graph.copy()
    g.slices.add("s", note="n")
    g.slices.add_edges(g.spark.createDataFrame([("s", "edge_0")], "slice_id string, edge_id string"))
    assert [r.edge_id for r in g.slices.union(["s"]).collect()] == ["edge_0"]
    assert g.idx.stats()["nodes"] == 4
    first = g.cache.get(g.value, "csr")
    assert g.cache.get(g.value, "csr") is first and g.cache.has(g.value, "csr")
    g.cache.drop()
    assert g.view(nodes=F.col("size") > 2).obs().count() == 1
    rows = g.idx.to_columns(g.spark.createDataFrame([("h",)], "edge_id string")).collect()
    assert len(rows) == 1


def test_dispatch(graph):
    with pytest.warns(UserWarning):
        p = graph.project(directed=False)
    assert p.peek_nodes(2) == ["A", "B"] and [r.node_id for r in p.ids_of(["bee"]).collect()] == ["B"]
    assert {r.node_id: r.component for r in p.run("connected_components").collect()} == {"A": "A", "B": "A", "C": "A", "lone": "lone"}
    assert {r.node_id: r.level for r in p.run("bfs", "A").collect()} == {"A": 0, "B": 1, "C": 1}
    with pytest.raises(AttributeError):
        p.run("none")


def test_numbers_of_edges_are_not_given_twice(spark):
    g = AnnotatedGraph(spark, directed=True)
    g.add_edges("A", "B")
    g.add_edges("B", "C")
    g.remove_edges("edge_0")
    g.add_edges("C", "D")
    assert sorted(g.E.ids()) == ["edge_1", "edge_2"] and ("B", "C") in g and ("C", "D") in g
    g.remove_edges("edge_2")
    g.add_edges([("D", "E"), {"source": "E", "target": "F", "edge_id": "own"}, ("F", "G")])
    assert sorted(g.E.ids()) == ["edge_1", "edge_3", "edge_4", "own"]
    ops = [(r.op, r.payload) for r in g.value.history.orderBy("version").collect()]
    assert [o for o, _ in ops].count("add_edges") == 4 and '"edge_0"' in dict(ops[2:3])["remove_edges"]


def test_edits_in_place(spark):
    g = AnnotatedGraph(spark, directed=True).add_edges([("A", "B", 2.0)])
    g.rename_node("A", "X").set_weight("edge_0", 5.0).set_direction("edge_0", False).mark("here")
    assert {r.node_id: r.coef for r in g.value.members.collect()} == {"X": 5.0, "B": 5.0} and not g.has_node("A") and g.validate() == []
    assert g.neighbors("B", "out") == ["X"]
    with pytest.raises(ValueError):
        g.rename_node("X", "B")
    assert g.value.history.where("op = 'mark'").count() == 1 and g.clear_history().value.history.count() == 0
    assert set(g.memory_usage()) == set(g.value.tables)
    with pytest.raises(KeyError):
        g.project().run("shortest_path_length", "nobody")


def test_native_format(spark, graph, tmp_path):
    graph.write(str(tmp_path / "g"))
    assert AnnotatedGraph.read(spark, str(tmp_path / "g")).shape == graph.shape
