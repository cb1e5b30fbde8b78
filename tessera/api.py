"""A graph that feels mutable: element by element or set by set, over the immutable value.

Single elements are for exploring: each call is a Spark job. Work on many at once with frames.
Tables that a change touches are checkpointed, so that plans of long edits stay short.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import HYPER, Graph, empty
from tessera.operators import algebra, attrs, build, dispatch, history, indices, layers, matrices, query, slices, spectral, views
from tessera.operators.spectral import cut
from tessera.sources import native


def told(x: Any) -> Any:
    """An argument as the log keeps it: frames by their columns, other values as they are."""
    if isinstance(x, DataFrame):
        return {"frame": x.columns}
    if isinstance(x, (str, int, float, bool, type(None))):
        return x
    if isinstance(x, dict):
        return {str(k): told(v) for k, v in x.items()}
    return [told(v) for v in x] if isinstance(x, (list, tuple, set)) else str(x)


class Namespace:
    """Operators of a module with the graph put in first; those that return a graph change it."""

    def __init__(self, owner: AnnotatedGraph, module):
        self._owner, self._module = owner, module

    def __getattr__(self, name: str):
        f = getattr(self._module, name)

        def call(*args, **kwargs):
            out = f(self._owner.value, *args, **kwargs)
            if isinstance(out, Graph):
                self._owner._set(out, name, args=[told(x) for x in args], **{k: told(x) for k, x in kwargs.items()})
                return self._owner
            return out

        return call


class Sequence:
    """An ordered axis of nodes or edges: columns by name, elements by position, ranges by slice."""

    def __init__(self, owner: AnnotatedGraph, kind: str, rows: DataFrame | None = None):
        self._owner, self._kind, self._rows = owner, kind, rows
        self._key = f"{kind}_id"

    def frame(self) -> DataFrame:
        if self._rows is not None:
            return self._rows
        g = self._owner.value
        if self._kind == "node":
            return g.nodes().join(g.node_attrs, "node_id", "left")
        held = g.resolved().where("kind <> 'placeholder'").select("edge_id", "ord", "weight", F.col("is_directed").alias("directed"), "kind")
        return held.join(g.edge_attrs, "edge_id", "left")

    def ids(self) -> list[str]:
        return [r[0] for r in self.frame().orderBy(F.col("ord").asc_nulls_last(), self._key).select(self._key).collect()]

    def __len__(self) -> int:
        return self.frame().count()

    def __iter__(self) -> Iterator[str]:
        return (r[0] for r in self.frame().orderBy(F.col("ord").asc_nulls_last(), self._key).select(self._key).toLocalIterator())

    def __contains__(self, item: str) -> bool:
        return not self.frame().where(F.col(self._key) == item).isEmpty()

    def __getitem__(self, key):
        order = (F.col("ord").asc_nulls_last(), F.col(self._key))
        if isinstance(key, str):
            return query.column(self.frame(), self._key, key)
        if isinstance(key, int):
            row = self.frame().orderBy(*order).offset(key).limit(1).collect() if key >= 0 else self.frame().orderBy(F.col("ord").desc_nulls_first(), F.desc(self._key)).offset(-key - 1).limit(1).collect()
            if not row:
                raise IndexError(key)
            return row[0][self._key]
        start, stop = key.start or 0, key.stop
        rows = self.frame().orderBy(*order).offset(start)
        return Sequence(self._owner, self._kind, rows if stop is None else rows.limit(max(0, stop - start)))

    def __setitem__(self, name: str, values: Any) -> None:
        table = f"{self._kind}_attrs"
        if isinstance(values, DataFrame):
            rows = values
        elif isinstance(values, (list, tuple)):
            rows = self._owner.spark.createDataFrame(list(zip(self.ids(), values)), [self._key, name])
        else:
            rows = self.frame().select(self._key, F.lit(values).alias(name))
        self._owner._set(attrs.set_attrs(self._owner.value, table, rows), f"set_{table}")

    def select(self, **conditions) -> Sequence:
        return Sequence(self._owner, self._kind, query.select(self.frame(), **conditions))

    def find(self, **conditions) -> str:
        return query.find(self.frame(), **conditions)[self._key]


class AnnotatedGraph:
    def __init__(self, spark: SparkSession, directed: bool | None = None, aspects: dict[str, list[str]] | None = None, value: Graph | None = None, log: bool = True, **uns):
        self.spark, self._log = spark, log
        self.value = value or empty(spark, directed, **uns)
        if aspects:
            self.value = layers.set_aspects(self.value, aspects)
        self.cache = indices.Kept()
        self._next = 0

    def _set(self, value: Graph, op: str = "edit", **payload) -> None:
        value = history.log(value, op, **payload) if self._log else value
        changed = {t: df for t, df in value.tables.items() if df is not self.value.tables.get(t)}
        self.value = value.having(**{t: cut(df) for t, df in changed.items()})

    # namespaces

    slices = property(lambda self: Namespace(self, slices))
    layers = property(lambda self: Namespace(self, layers))
    attrs = property(lambda self: Namespace(self, attrs))
    views = property(lambda self: Namespace(self, views))
    ops = property(lambda self: Namespace(self, algebra))
    history = property(lambda self: Namespace(self, history))
    matrices = property(lambda self: Namespace(self, matrices))
    spectral = property(lambda self: Namespace(self, spectral))
    idx = property(lambda self: Namespace(self, indices))
    query = property(lambda self: Namespace(self, query))
    N = property(lambda self: Sequence(self, "node"))
    E = property(lambda self: Sequence(self, "edge"))
    B = property(lambda self: matrices.binary_incidence(self.value))
    H = property(lambda self: matrices.hyper_incidence(self.value))
    S = property(lambda self: matrices.incidence(self.value))
    A = property(lambda self: matrices.adjacency(self.value))
    L = property(lambda self: matrices.laplacian(self.A))
    obs = property(lambda self: views.nodes_view(self.value))
    var = property(lambda self: views.edges_view(self.value))
    uns = property(lambda self: self.value.uns)
    nv = property(lambda self: self.value.count_nodes())
    nv_supra = property(lambda self: self.value.count_nodes(supra=True))
    ne = property(lambda self: self.value.count_edges())
    shape = property(lambda self: (self.nv, self.ne))

    def __matmul__(self, x: DataFrame) -> DataFrame:
        return matrices.times(self.A, x)

    def __rmatmul__(self, x: DataFrame) -> DataFrame:
        return matrices.rtimes(x, self.A)

    # building

    def add_nodes(self, nodes: DataFrame | str | Iterable[Any], slice: str | None = None, **common) -> AnnotatedGraph:
        """A frame, an id with attributes, or many ids, (id, attributes) pairs or dictionaries."""
        if not isinstance(nodes, DataFrame):
            nodes = [nodes] if isinstance(nodes, (str, dict, tuple)) else list(nodes)
            rows = [{"node_id": n} if isinstance(n, str) else {"node_id": n[0], **n[1]} if isinstance(n, tuple) else dict(n) for n in nodes]
            nodes = self._frame([common | r for r in rows])
        self._set(build.add_nodes(self.value, nodes, slice), "add_nodes", columns=nodes.columns, slice=slice)
        return self

    def add_edges(self, *args: Any, slice: str | None = None, **fields) -> AnnotatedGraph:
        """A frame, two ends with fields, an iterable of dictionaries or (source, target[, weight]) tuples, or members=/head=/tail=/coefs=."""
        if len(args) == 1 and isinstance(args[0], DataFrame):
            rows = args[0]
        else:
            if len(args) == 2 and all(isinstance(x, str) for x in args):
                found = [{"source": args[0], "target": args[1]} | fields]
            elif args:
                found = [dict(zip(("source", "target", "weight"), e)) | fields if isinstance(e, (tuple, list)) else fields | dict(e) for e in args[0]]
            else:
                found = [fields]
            start = self._numbers(sum("edge_id" not in r for r in found))
            own = (f"edge_{k}" for k in itertools.count(start))
            rows = self._frame([r if "edge_id" in r else {"edge_id": next(own)} | r for r in found])
        self._set(build.add_edges(self.value, rows, slice), "add_edges", columns=rows.columns, slice=slice)
        return self

    def _numbers(self, n: int) -> int:
        """The first of n numbers for edges; none is given twice, whatever was removed in between."""
        if n:
            number = F.expr(r"try_cast(regexp_extract(edge_id, '^edge_([0-9]{1,18})$', 1) as bigint)")
            last = self.value.edges.agg(F.max(number)).first()[0]
            self._next = max(self._next, 0 if last is None else last + 1) + n
        return self._next - n

    def _frame(self, rows: list[dict]) -> DataFrame:
        """A frame of dictionaries; ints stay ints, absent keys are null."""
        from pyspark.sql import types as T

        def kind(vs):
            vs = [v for v in vs if v is not None]
            if any(isinstance(v, dict) for v in vs):
                return T.MapType(T.StringType(), T.DoubleType())
            if any(isinstance(v, (list, tuple, set)) for v in vs):
                return T.ArrayType(T.StringType())
            if vs and all(isinstance(v, bool) for v in vs):
                return T.BooleanType()
            if vs and all(isinstance(v, int) for v in vs):
                return T.LongType()
            if vs and all(isinstance(v, (int, float)) for v in vs):
                return T.DoubleType()
            return T.StringType()

        names = list(dict.fromkeys(k for r in rows for k in r))
        kinds = {n: kind([r.get(n) for r in rows]) for n in names}

        def cell(v, t):
            if v is None:
                return None
            if isinstance(t, T.MapType):
                return {str(k): float(x) for k, x in v.items()}
            if isinstance(t, T.ArrayType):
                return [str(x) for x in v]
            return float(v) if isinstance(t, T.DoubleType) else str(v) if isinstance(t, T.StringType) else v

        return self.spark.createDataFrame([tuple(cell(r.get(n), kinds[n]) for n in names) for r in rows], T.StructType([T.StructField(n, kinds[n]) for n in names]))

    def remove_nodes(self, ids: DataFrame | str | Iterable[str], errors: str = "raise") -> AnnotatedGraph:
        self._set(algebra.remove_nodes(self.value, self._ids(ids, "node_id"), errors), "remove_nodes", ids=told(ids), errors=errors)
        return self

    def remove_edges(self, ids: DataFrame | str | Iterable[str], errors: str = "raise") -> AnnotatedGraph:
        self._set(algebra.remove_edges(self.value, self._ids(ids, "edge_id"), errors), "remove_edges", ids=told(ids), errors=errors)
        return self

    def remove_orphans(self) -> int:
        lone = cut(query.orphans(self.value))
        n = lone.count()
        self.remove_nodes(lone, errors="ignore")
        return n

    def _ids(self, ids, name: str) -> DataFrame:
        return ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(x,) for x in ([ids] if isinstance(ids, str) else ids)], f"{name} string")

    def make_undirected(self, **kw) -> AnnotatedGraph:
        self._set(algebra.make_undirected(self.value, **kw), "make_undirected", **kw)
        return self

    def set_node_key(self, *fields: str) -> AnnotatedGraph:
        self._set(build.set_node_key(self.value, *fields), "set_node_key", fields=list(fields))
        return self

    def get_or_create_node_by_attrs(self, **values) -> str:
        g, named = build.get_or_create_by_attrs(self.value, self._frame([values]))
        node_id = named.first().node_id
        self._set(g, "get_or_create")
        return node_id

    # edits in place

    def rename_node(self, old: str, new: str) -> AnnotatedGraph:
        self._set(algebra.rename_nodes(self.value, self.spark.createDataFrame([(old, new)], "node_id string, new_id string")), "rename_node", old=old, new=new)
        return self

    def set_weight(self, edge_id: str, weight: float) -> AnnotatedGraph:
        self._set(algebra.set_weights(self.value, self.spark.createDataFrame([(edge_id, float(weight))], "edge_id string, weight double")), "set_weight", edge_id=edge_id, weight=weight)
        return self

    def set_direction(self, edge_id: str, directed: bool) -> AnnotatedGraph:
        self._set(algebra.set_directions(self.value, self.spark.createDataFrame([(edge_id, directed)], "edge_id string, directed boolean")), "set_direction", edge_id=edge_id, directed=directed)
        return self

    def memory_usage(self) -> dict[str, int]:
        """Bytes that the optimiser expects of each table."""
        return {t: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t, df in self.value.tables.items()}

    def mark(self, label: str) -> AnnotatedGraph:
        """A named event in the log."""
        self.value = self.value.having(history=cut(history.log(self.value, "mark", label=label).history))
        return self

    def clear_history(self) -> AnnotatedGraph:
        self.value = self.value.having(history=self.value.history.limit(0))
        return self

    def list_snapshots(self) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in history.snapshots(self.value).orderBy("version", "label").collect()]

    # single elements

    def neighbors(self, node_id: str, direction: str = "both") -> list[str]:
        held = self.value.members.where(F.col("node_id") == node_id).select("edge_id").distinct()
        near = self.value.having(members=self.value.members.join(held, "edge_id", "left_semi"), edges=self.value.edges.join(held, "edge_id", "left_semi"))
        return sorted(r.neighbor for r in query.neighbors(near, direction).where(F.col("node_id") == node_id).collect())

    def successors(self, node_id: str) -> list[str]:
        return self.neighbors(node_id, "out")

    def predecessors(self, node_id: str) -> list[str]:
        return self.neighbors(node_id, "in")

    def incident_edges(self, nodes: str | Iterable[str], direction: str = "both") -> list[str]:
        rows = query.incident_edges(self.value, self._ids(nodes, "node_id"), direction)
        return sorted({r.edge_id for r in rows.collect()})

    def degree(self, node_id: str) -> int:
        row = matrices.degree(self.value).where(F.col("node_id") == node_id).first()
        if row is None:
            raise KeyError(node_id)
        return row.degree

    def has_node(self, node_id: str) -> bool:
        return not self.value.entities.where(F.col("node_id") == node_id).isEmpty()

    def has_edge(self, source: str | None = None, target: str | None = None, edge_id: str | None = None) -> bool:
        rows = self.value.edges.where(F.col("edge_id") == edge_id).select("edge_id") if edge_id is not None else None
        if source is not None:
            pairs = self.spark.createDataFrame([(source, target)], "source string, target string")
            between = query.edges_between(self.value, pairs).select("edge_id")
            rows = between if rows is None else rows.join(between, "edge_id", "left_semi")
        return not rows.isEmpty()

    def get_node(self, node_id: str) -> dict[str, Any]:
        rows = self.value.entities.where(F.col("node_id") == node_id).collect()
        if not rows:
            raise KeyError(node_id)
        held = self.value.node_attrs.where(F.col("node_id") == node_id).first()
        return {"node_id": node_id, "kind": rows[0].kind, "layers": [tuple(r.layer) for r in rows], "attrs": held.asDict() if held else {}}

    def get_edge(self, edge_id: str) -> dict[str, Any]:
        """An edge with its sides; an undirected one has all members on both."""
        row = self.value.resolved().where(F.col("edge_id") == edge_id).first()
        if row is None:
            raise KeyError(edge_id)
        sides = query.edge_sides(self.value.having(members=self.value.members.where(F.col("edge_id") == edge_id))).first()
        both = sides.members if sides else []
        kind = row.kind if row.kind != HYPER else f"hyper_{'directed' if row.is_directed else 'undirected'}"
        return {"edge_id": edge_id, "kind": kind, "weight": row.weight, "directed": row.is_directed, "source": sides.sources if sides and row.is_directed else both, "target": sides.targets if sides and row.is_directed else both}

    def __len__(self) -> int:
        return self.nv

    def __bool__(self) -> bool:
        return not self.value.nodes().isEmpty()

    def __iter__(self) -> Iterator[str]:
        return iter(self.N)

    def __contains__(self, item) -> bool:
        return self.has_node(item) if isinstance(item, str) else self.has_edge(*item)

    def __iadd__(self, other) -> AnnotatedGraph:
        return self.add_nodes(other) if isinstance(other, str) else self.add_edges(*other)

    def __isub__(self, other) -> AnnotatedGraph:
        if isinstance(other, str):
            return self.remove_nodes(other)
        pairs = self.spark.createDataFrame([tuple(other)], "source string, target string")
        return self.remove_edges(query.edges_between(self.value, pairs).select("edge_id"))

    def _with(self, value: Graph) -> AnnotatedGraph:
        out = AnnotatedGraph(self.spark, value=value, log=self._log)
        out._next = self._next
        return out

    def __or__(self, other: AnnotatedGraph) -> AnnotatedGraph:
        return self._with(algebra.union(self.value, other.value))

    def __ior__(self, other: AnnotatedGraph) -> AnnotatedGraph:
        self._set(algebra.union(self.value, other.value), "merge")
        return self

    def __and__(self, other: AnnotatedGraph) -> AnnotatedGraph:
        return self._with(algebra.intersection(self.value, other.value))

    def __sub__(self, other: AnnotatedGraph) -> AnnotatedGraph:
        return self._with(algebra.difference(self.value, other.value))

    def __xor__(self, other: AnnotatedGraph) -> AnnotatedGraph:
        return self._with(algebra.symmetric_difference(self.value, other.value))

    def copy(self) -> AnnotatedGraph:
        return self._with(self.value)

    def subgraph(self, nodes) -> AnnotatedGraph:
        return self._with(algebra.subgraph(self.value, self._ids(nodes, "node_id")))

    def edge_subgraph(self, edges) -> AnnotatedGraph:
        return self._with(algebra.edge_subgraph(self.value, self._ids(edges, "edge_id")))

    def reverse(self) -> AnnotatedGraph:
        return self._with(algebra.reverse(self.value))

    def view(self, nodes=None, edges=None, slices: tuple[str, ...] = ()) -> views.View:
        return views.View(self.value, nodes, edges, slices)

    def project(self, **options) -> dispatch.Projection:
        """Plain graph for algorithms: `project().run("pagerank")`."""
        return dispatch.Projection(self.value, **options)

    def validate(self, strict: bool = True) -> list[tuple[str, str]]:
        found = [(r.rule, r.key) for r in history.violations(self.value).limit(1000).collect()]
        if found and strict:
            raise ValueError(f"broken invariants: {found[:10]}")
        return found

    def write(self, path: str, **options) -> None:
        native.write(self.value, path, **options)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> AnnotatedGraph:
        return cls(spark, value=native.read(spark, path))

    def __repr__(self) -> str:
        s = self.value.summary()
        return f"AnnotatedGraph({s['nodes']} nodes, {s['edges']} edges, {s['slices']} slices, version {s['version']})"
