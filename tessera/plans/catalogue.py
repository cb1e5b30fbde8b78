"""Named queries over the canonical graph, one operator each, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import HYPER, Graph, empty
from tessera.operators import algebra, algorithms, attrs, build, dispatch, history, indices, layers, matrices, project, query, slices, spectral, views
from tessera.plans import market
from tessera.sources import delimited, delivery, documents, frames, markup, native
from tessera.streaming import deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# common table expressions of the oracle
PS = """ln as (select 'PS:' || l_partkey || ':' || l_suppkey as edge_id, 'P' || l_partkey as source, 'S' || l_suppkey as target, l_quantity as quantity, l_returnflag as flag, l_linestatus as status, year(l_shipdate) as year, l_orderkey, l_partkey from lineitem),
ps as (select edge_id, source, target, sum(quantity) as weight, count(*) as n_lines from ln group by edge_id, source, target)"""
ALL = PS + """,
e as (select edge_id, source, target, weight, true as directed from ps
  union all select 'CN:' || c_custkey, 'C' || c_custkey, 'N' || c_nationkey, 1.0, false from customer
  union all select 'SN:' || s_suppkey, 'S' || s_suppkey, 'N' || s_nationkey, 1.0, false from supplier
  union all select 'NR:' || n_nationkey, 'N' || n_nationkey, 'R' || n_regionkey, 1.0, false from nation),
ends as (select edge_id, source as node_id, weight as coef, weight, 'a' as side, directed from e union all select edge_id, target, case when directed then -weight else weight end, weight, 'b', directed from e),
nodes as (select 'C' || c_custkey as node_id, 'customer' as kind, c_name as name, c_acctbal as value from customer
  union all select 'P' || p_partkey, 'part', p_name, p_retailprice from part
  union all select 'S' || s_suppkey, 'supplier', s_name, s_acctbal from supplier
  union all select 'N' || n_nationkey, 'nation', n_name, null from nation
  union all select 'R' || r_regionkey, 'region', r_name, null from region),
adj as (select i, j, sum(weight) as value from (select source as i, target as j, weight from e union all select target, source, weight from e where not directed) group by i, j)"""
ORDERS = PS + """,
op as (select l_orderkey, source, sum(quantity) as quantity from ln where l_orderkey in (select o_orderkey from orders) group by l_orderkey, source),
hm as (select 'HO:' || l_orderkey as edge_id, source as node_id, 0 as role, 1.0 as coef from op
  union all select 'HD:' || o_orderkey, 'C' || o_custkey, 1, 1.0 from orders where o_orderkey in (select l_orderkey from op)
  union all select 'HD:' || l_orderkey, source, -1, -quantity from op)"""
SLICED = PS + """,
se as (select slice_id, edge_id, sum(quantity) as weight, min(source) as source, min(target) as target from (
    select 'flag_' || flag as slice_id, edge_id, source, target, quantity from ln union all select 'y' || year, edge_id, source, target, quantity from ln) group by slice_id, edge_id),
sn as (select distinct slice_id, source as node_id from se union select distinct slice_id, target from se)"""
LAYERED = PS + """,
li as (select 'L:' || source || ':' || target || ':' || year || ':' || status as edge_id, source, target, year, status, sum(quantity) as weight from ln group by source, target, year, status),
pr as (select distinct source as node_id, year, status from ln union select distinct target, year, status from ln),
lc as (select 'K:' || a.node_id || ':' || a.year || ':' || a.status as edge_id, a.node_id, a.year, a.status from (select * from pr where node_id like 'P%') a join pr b on a.node_id = b.node_id and b.year = a.year + 1 and a.status = b.status),
sx as (select source || '~' || year || '×' || status as i, target || '~' || year || '×' || status as j, 'intra' as ml_kind, weight from li
  union all select node_id || '~' || year || '×' || status, node_id || '~' || (year + 1) || '×' || status, 'coupling', 1.0 from lc
  union all select node_id || '~' || (year + 1) || '×' || status, node_id || '~' || year || '×' || status, 'coupling', 1.0 from lc),
sa as (select i, j, sum(weight) as value from sx group by i, j),
sk as (select node_id || '~' || year || '×' || status as i from pr),
sd as (select sk.i, coalesce(d.value, 0) as value from sk left join (select i, sum(value) as value from sa group by i) d on d.i = sk.i)"""


def shown(df: DataFrame) -> DataFrame:
    """Keys of (node, layer) with a visible separator; doubles rounded."""
    for c, kind in df.dtypes:
        if c in ("i", "j") and kind == "string":
            df = df.withColumn(c, F.replace(c, F.lit(layers.KEY), F.lit("~")))
        if kind == "double":
            df = df.withColumn(c, F.round(c, 6))
    return df


def register(name: str, graph: Callable | None, sql: str | None):
    """Decorator: a query from a graph of the market, and its SQL."""

    def hold(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(f(graph(spark, sf_dir)) if graph else f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return hold


def joined(column: str):
    return F.array_join(F.array_sort(column), "|")


supply, orders, sliced, layered = market.supply, market.orders_graph, market.sliced, market.layered


def supply_only(spark: SparkSession, sf_dir: str) -> Graph:
    return market.supply(spark, sf_dir, places=False)


def ids(spark: SparkSession, sf_dir: str, prefix: str, n: int) -> DataFrame:
    """The nodes of a kind whose number divides by n."""
    return market.nodes(spark, sf_dir).where(F.col("node_id").startswith(prefix) & (F.substring("node_id", 2, 20).cast("long") % n == 0)).select("node_id")


# tables

register("node_table", supply, f"with {ALL} select node_id, kind, name, round(value, 6) as value from nodes")(views.nodes_view)


@register("edge_table", supply, f"with {ALL} select e.edge_id, 'binary' as kind, e.source, e.target, e.directed, round(e.weight, 6) as global_weight, ps.n_lines from e left join ps on ps.edge_id = e.edge_id")
def _(g):
    return views.edges_view(g).select("edge_id", "kind", "source", "target", "directed", "global_weight", "n_lines")


@register("select_edges_eq", supply, f"with {PS} select edge_id, n_lines from ps where n_lines = 2")
def _(g):
    return query.select(g.edge_attrs, n_lines=2)


@register("edges_by_attr", supply, f"with {PS} select edge_id from ps where n_lines = 3")
def _(g):
    return attrs.edges_by_attr(g, "n_lines", 3)


@register("attr_isin", supply, f"with {ALL} select node_id, name from nodes where kind in ('nation', 'region')")
def _(g):
    return query.is_in(g.node_attrs, "kind", ["nation", "region"]).select("node_id", "name")


@register("attr_not_in", supply, f"with {ALL} select node_id, kind from nodes where kind not in ('customer', 'part')")
def _(g):
    return query.is_in(g.node_attrs, "kind", ["customer", "part"], negate=True).select("node_id", "kind")


@register("attr_default", supply, f"with {ALL} select node_id, round(coalesce(value, -1), 6) as value from nodes")
def _(g):
    return query.column(g.node_attrs, "node_id", "value", -1.0)


register("edges_by_direction", supply, f"with {ALL} select edge_id from e where not directed")(lambda g: query.edges_by_direction(g, False))
register("edge_kind", layered, f"with {LAYERED} select edge_id, 'intra' as edge_kind from li union all select edge_id, 'coupling' from lc")(query.edge_kind)
register("entity_kinds", supply, f"with {ALL} select node_id, 'node' as kind from nodes")(views.entity_kinds)

# degrees and neighbours

register("degree_cells", supply, f"with {ALL} select n.node_id, count(x.edge_id) as degree from nodes n left join (select edge_id, node_id from ends group by edge_id, node_id having sum(coef) <> 0) x on x.node_id = n.node_id group by n.node_id")(matrices.degree)
register("member_degree", supply, f"with {ALL} select n.node_id, count(x.edge_id) as degree from nodes n left join ends x on x.node_id = n.node_id group by n.node_id")(matrices.member_degree)
register("weighted_degree", supply, f"with {ALL} select node_id, round(sum(weight), 6) as value from ends group by node_id")(matrices.weighted_degree)
register("neighbors_out", supply, f"with {ALL} select source as node_id, target as neighbor from e union select target, source from e where not directed")(lambda g: query.neighbors(g, "out"))
register("neighbors_in", supply, f"with {ALL} select target as node_id, source as neighbor from e union select source, target from e where not directed")(lambda g: query.neighbors(g, "in"))
register("neighbors_both", supply, f"with {ALL} select source as node_id, target as neighbor from e union select target, source from e")(query.neighbors)
register("hyper_neighbors", orders, f"with {ORDERS} select distinct a.node_id, b.node_id as neighbor from hm a join hm b on a.edge_id = b.edge_id and a.node_id <> b.node_id where (a.role = 0 or (a.role = 1 and b.role = -1)) and a.edge_id like 'HD%'")(lambda g: query.neighbors(algebra.edge_subgraph(g, g.edges.where(F.col("edge_id").startswith("HD"))), "out"))


register("edge_list", supply, f"with {ALL} select source, target, edge_id, round(weight, 6) as weight from e")(query.edge_list)


@register("has_edge", None, "select 'P' || p_partkey as source, 'S1' as target, p_partkey in (select l_partkey from lineitem where l_suppkey = 1) as found from part")
def _(spark, sf_dir):
    pairs = ids(spark, sf_dir, "P", 1).select(F.col("node_id").alias("source"), F.lit("S1").alias("target"))
    return query.has_edge(supply(spark, sf_dir), pairs)


register("orphans", supply, f"with {ALL} select node_id from nodes where node_id not in (select node_id from ends)")(query.orphans)

# matrices

register("incidence_signed", supply, f"with {ALL} select node_id, edge_id, round(sum(coef), 6) as value from ends group by node_id, edge_id having sum(coef) <> 0")(lambda g: matrices.incidence(g).select("node_id", "edge_id", "value"))
register("incidence_hyper", orders, f"with {ORDERS} select node_id, edge_id, cast(count(*) as double) as value from hm group by node_id, edge_id")(lambda g: matrices.hyper_incidence(g).select("node_id", "edge_id", "value"))
register("incidence_coefficients", orders, f"with {ORDERS} select node_id, edge_id, round(sum(coef), 6) as value from hm group by node_id, edge_id having sum(coef) <> 0")(lambda g: matrices.incidence(g, (HYPER,)).select("node_id", "edge_id", "value"))
register("incidence_lists", supply_only, f"with {PS} select node_id, string_agg(edge_id, '|' order by edge_id) as items from (select source as node_id, edge_id from ps union all select target, edge_id from ps) group by node_id")(lambda g: matrices.incidence_lists(g).select("node_id", F.array_join("items", "|").alias("items")))
register("adjacency", supply, f"with {ALL} select i, j, round(value, 6) as value from adj where value <> 0")(matrices.adjacency)
register("laplacian", supply, f"with {ALL} select i, j, round(sum(value), 6) as value from (select i, i as j, value from adj union all select i, j, -value from adj) group by i, j having abs(sum(value)) > 1e-9")(lambda g: matrices.laplacian(matrices.adjacency(g)))


@register("matvec", None, f"with {ALL} select i, round(sum(a.value * s_acctbal), 2) as value from adj a join supplier on a.j = 'S' || s_suppkey group by i")
def _(spark, sf_dir):
    x = market.table(spark, sf_dir, "supplier").select(market.named("S", "s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    return matrices.times(matrices.adjacency(supply(spark, sf_dir)), x).select("i", F.round("value", 2).alias("value"))


@register("rmatvec", None, f"with {ALL} select j as i, round(sum(a.value * p_retailprice), 2) as value from adj a join part on a.i = 'P' || p_partkey group by j")
def _(spark, sf_dir):
    x = market.table(spark, sf_dir, "part").select(market.named("P", "p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return matrices.rtimes(x, matrices.adjacency(supply(spark, sf_dir))).select("i", F.round("value", 2).alias("value"))


register("node_index", supply, f"with {ALL} select row_number() over (order by node_id) - 1 as row, node_id from nodes")(lambda g: matrices.index(g).select("row", "node_id"))

# hyperedges

register("hyper_members", orders, f"with {ORDERS} select edge_id, string_agg(case when role <> -1 then node_id end, '|' order by node_id) as sources, coalesce(string_agg(case when role = -1 then node_id end, '|' order by node_id), '') as targets from hm group by edge_id")(lambda g: query.edge_sides(g).select("edge_id", joined("sources").alias("sources"), joined("targets").alias("targets")))


@register("hyper_exact_match", orders, f"with {ORDERS}, k as (select edge_id, string_agg(node_id, '|' order by node_id) as m, count(*) as n from hm where role = 0 group by edge_id) select a.edge_id, min(b.edge_id) as twin from k a join k b on a.m = b.m and a.n >= 2 and a.edge_id <> b.edge_id group by a.edge_id")
def _(g):
    rows = query.hyperedges(g).where(~F.col("directed") & (F.size("members") >= 2)).select("edge_id", joined("members").alias("m"))
    return rows.join(rows.select(F.col("edge_id").alias("other"), "m"), "m").where("edge_id <> other").groupBy("edge_id").agg(F.min("other").alias("twin"))


# subgraphs and algebra


@register("subgraph_nodes", None, f"with {ALL} select edge_id from e where (source not like 'P%' or cast(substr(source, 2) as bigint) % 2 = 0) and source not like 'C%'")
def _(spark, sf_dir):
    keep = ids(spark, sf_dir, "P", 2).union(market.nodes(spark, sf_dir).where("kind in ('supplier', 'nation', 'region')").select("node_id"))
    return algebra.subgraph(supply(spark, sf_dir), keep).edges.select("edge_id")


@register("subgraph_edges", supply, f"with {PS} select source as node_id from ps where n_lines >= 3 union select target from ps where n_lines >= 3")
def _(g):
    return algebra.edge_subgraph(g, g.edge_attrs.where("n_lines >= 3")).nodes().select("node_id")


@register("extract_subgraph", None, f"with {PS} select edge_id from ps where n_lines >= 2 and cast(substr(source, 2) as bigint) % 3 = 0")
def _(spark, sf_dir):
    g = supply(spark, sf_dir)
    keep = ids(spark, sf_dir, "P", 3).union(ids(spark, sf_dir, "S", 1))
    return algebra.extract(g, keep, g.edge_attrs.where("n_lines >= 2")).edges.select("edge_id")


@register("view_predicate", supply, "select 'SN:' || s_suppkey as edge_id from supplier where s_acctbal > 0")
def _(g):
    return views.View(g, nodes=((F.col("kind") == "supplier") & (F.col("value") > 0)) | (F.col("kind") == "nation")).edge_ids()


def by_year(low: int, high: int):
    return lambda spark, sf_dir: market.supply(spark, sf_dir, market.lines(spark, sf_dir).where(F.col("year").between(low, high)), places=False)


def two(f):
    return lambda spark, sf_dir: f(by_year(1995, 1998)(spark, sf_dir), by_year(1997, 2001)(spark, sf_dir)).edges.select("edge_id", "weight")


TWO = PS + """, a as (select edge_id, min(source) as source, min(target) as target, sum(quantity) as weight from ln where year between 1995 and 1998 group by edge_id), b as (select edge_id, min(source) as source, min(target) as target, sum(quantity) as weight from ln where year between 1997 and 2001 group by edge_id),
an as (select source as n from a union select target from a), bn as (select source as n from b union select target from b)"""
register("graph_union", None, f"with {TWO} select edge_id, round(weight, 6) as weight from a union all select edge_id, round(weight, 6) from b where edge_id not in (select edge_id from a)")(two(algebra.union))
register("graph_intersection", None, f"with {TWO} select edge_id, round(weight, 6) as weight from a where edge_id in (select edge_id from b)")(two(algebra.intersection))
register("graph_difference", None, f"with {TWO} select edge_id, round(weight, 6) as weight from a where edge_id not in (select edge_id from b) and source not in (select n from bn) and target not in (select n from bn)")(two(algebra.difference))
register("graph_symdiff", None, f"with {TWO} select edge_id, round(weight, 6) as weight from a where edge_id not in (select edge_id from b) and source not in (select n from bn) and target not in (select n from bn) union all select edge_id, round(weight, 6) from b where edge_id not in (select edge_id from a) and source not in (select n from an) and target not in (select n from an)")(two(algebra.symmetric_difference))
register("reverse", supply, f"with {ALL} select edge_id, node_id, case when directed then (case side when 'a' then -1 else 1 end) else (case side when 'a' then 1 else -1 end) end as role, round(case when directed then -coef else coef end, 6) as coef from ends")(lambda g: algebra.reverse(g).members.select("edge_id", "node_id", F.col("role").cast("int").alias("role"), "coef"))
register("make_undirected", supply, f"with {ALL} select edge_id, node_id, round(weight, 6) as coef from ends")(lambda g: algebra.make_undirected(g).members.select("edge_id", "node_id", "coef"))


@register("remove_nodes", None, f"with {ALL} select edge_id from e where source not in (select 'S' || s_suppkey from supplier where s_suppkey % 2 = 0) and target not in (select 'S' || s_suppkey from supplier where s_suppkey % 2 = 0)")
def _(spark, sf_dir):
    return algebra.remove_nodes(supply(spark, sf_dir), ids(spark, sf_dir, "S", 2)).edges.select("edge_id")


@register("remove_edges", supply, f"with {ALL} select e.edge_id from e left join ps on ps.edge_id = e.edge_id where ps.n_lines is null or ps.n_lines < 2")
def _(g):
    return algebra.remove_edges(g, g.edge_attrs.where("n_lines >= 2")).edges.select("edge_id")


@register("snapshot_diff", None, f"with {TWO}, x as (select 'edges' as domain, edge_id as id from a union all select 'nodes', n from an), y as (select 'edges' as domain, edge_id as id from b union all select 'nodes', n from bn) select domain, id, 'added' as change from (select * from y except select * from x) union all select domain, id, 'removed' from (select * from x except select * from y)")
def _(spark, sf_dir):
    old = history.snapshot(by_year(1995, 1998)(spark, sf_dir), "then")
    new = by_year(1997, 2001)(spark, sf_dir).having(snapshots=old.snapshots)
    return history.diff(new, "then").where("domain <> 'slices'")


register("validate_violations", sliced, "select '' as rule, '' as key where false")(history.violations)
register("history_log", None, "select event_id as version, event_type as op, user_id from events")(lambda spark, sf_dir: deltas.event_log(market.table(spark, sf_dir, "events")).select("version", "op", F.get_json_object("payload", "$.user_id").cast("long").alias("user_id")))

# slices

register("slice_union", sliced, f"with {SLICED} select distinct edge_id from se where slice_id in ('y1995', 'y1997')")(lambda g: slices.union(g, ["y1995", "y1997", "none"]))
register("slice_intersect", sliced, f"with {SLICED} select edge_id from se where slice_id in ('flag_A', 'y1995') group by edge_id having count(*) = 2")(lambda g: slices.intersect(g, ["flag_A", "y1995"]))
register("slice_difference", sliced, f"with {SLICED} select edge_id from se where slice_id = 'flag_R' and edge_id not in (select edge_id from se where slice_id = 'flag_A')")(lambda g: slices.difference(g, "flag_R", "flag_A"))
register("slice_stats", sliced, f"with {SLICED} select s.slice_id, s.edges, n.nodes from (select slice_id, count(*) as edges from se group by slice_id) s join (select slice_id, count(*) as nodes from sn group by slice_id) n on n.slice_id = s.slice_id")(lambda g: slices.stats(g, include_default=False))
register("conserved_edges", sliced, f"with {SLICED} select edge_id, count(*) as n from se group by edge_id having count(*) >= 4")(lambda g: slices.conserved_edges(g, 4))
register("specific_edges", lambda s, d: (lambda g: g.having(slice_edges=g.slice_edges.where("slice_id like 'y%'")))(sliced(s, d)), f"with {SLICED} select min(slice_id) as slice_id, edge_id from se where slice_id like 'y%' group by edge_id having count(*) = 1")(slices.specific_edges)
register("node_presence", sliced, f"with {SLICED} select node_id, string_agg(slice_id, '|' order by slice_id) as slices from sn group by node_id")(lambda g: slices.presence(g, "slice_nodes").select("node_id", joined("slices").alias("slices")))
register("edge_presence", sliced, f"with {SLICED} select edge_id, string_agg(slice_id, '|' order by slice_id) as slices from se group by edge_id")(lambda g: slices.presence(g).select("edge_id", joined("slices").alias("slices")))
register("temporal_dynamics", sliced, f"with {SLICED}, y as (select distinct cast(substr(slice_id, 2) as int) as y, edge_id from se where slice_id like 'y%') select k - 1995 as step, 'y' || k as from_slice, 'y' || (k + 1) as to_slice, (select count(*) from y b where b.y = k + 1 and not exists (select 1 from y a where a.y = k and a.edge_id = b.edge_id)) as added, (select count(*) from y a where a.y = k and not exists (select 1 from y b where b.y = k + 1 and a.edge_id = b.edge_id)) as removed, (select count(*) from y where y.y = k + 1) - (select count(*) from y where y.y = k) as net_change from (select unnest(range(1995, 2001)) as k)")(lambda g: slices.temporal_dynamics(g, list(market.YEARS)))
register("effective_weight", sliced, f"with {SLICED} select ps.edge_id, round(coalesce(se.weight, ps.weight), 6) as weight from ps left join se on se.edge_id = ps.edge_id and se.slice_id = 'flag_A'")(lambda g: attrs.effective_weight(g, "flag_A"))
register("edges_view_slice", sliced, f"with {SLICED} select ps.edge_id, ps.source, ps.target, round(ps.weight, 6) as global_weight, round(se.weight, 6) as effective_weight, round(se.weight, 6) as slice_weight from ps join se on se.edge_id = ps.edge_id and se.slice_id = 'y1996'")(lambda g: views.edges_view(g, "y1996").select("edge_id", "source", "target", "global_weight", "effective_weight", "slice_weight"))
register("subgraph_from_slice", sliced, f"with {SLICED} select edge_id, source as node_id, round(weight, 6) as coef from se where slice_id = 'y1999' union all select edge_id, target, round(-weight, 6) from se where slice_id = 'y1999'")(lambda g: algebra.subgraph_from_slice(g, "y1999").members.select("edge_id", "node_id", "coef"))
register("slice_aggregate", sliced, f"with {SLICED} select edge_id from se where slice_id in ('y1995', 'y1996', 'y1997') group by edge_id having count(*) = 3")(lambda g: slices.aggregate(g, ["y1995", "y1996", "y1997"], "all3", "intersection").slice_edges.where("slice_id = 'all3'").select("edge_id"))
register("adjacency_slice", sliced, f"with {SLICED} select source as i, target as j, round(sum(weight), 6) as value from se where slice_id = 'flag_N' group by source, target")(lambda g: matrices.adjacency(g, weight=g.edge_slice_attrs.where("slice_id = 'flag_N'").select("edge_id", "weight")))

# layers

L95F = ("1995", "F")
register("layer_nodes", layered, f"with {LAYERED} select node_id from pr where year = 1995 and status = 'F'")(lambda g: layers.layer_nodes(g, L95F))
register("layer_edges", layered, f"with {LAYERED} select edge_id from li where year = 1995 and status = 'F' union all select edge_id from lc where (year = 1995 or year = 1994) and status = 'F'")(lambda g: layers.layer_edges(g, L95F, include_coupling=True))
register("layer_union", layered, f"with {LAYERED} select distinct node_id from pr where status = 'F' and year in (1995, 1996)")(lambda g: layers.layer_union(g, [L95F, ("1996", "F")])[0])
register("layer_intersection", layered, f"with {LAYERED} select node_id from pr where year = 1995 group by node_id having count(*) = 2")(lambda g: layers.layer_intersection(g, [L95F, ("1995", "O")])[0])
register("layer_difference", layered, f"with {LAYERED} select node_id from pr where year = 1995 and status = 'F' and node_id not in (select node_id from pr where year = 1995 and status = 'O')")(lambda g: layers.layer_difference(g, L95F, ("1995", "O"))[0])
register("layers_product", layered, "select y || '×' || s as id, y as year, s as status from (select cast(unnest(range(1995, 2002)) as varchar) as y) a cross join (select unnest(['F', 'O']) as s) b")(lambda g: views.layers_view(g).select("id", "year", "status"))
register("coupling_pairs", layered, f"with {LAYERED} select a.node_id, '1995×F' as a, '1996×O' as b from pr a join pr b on a.node_id = b.node_id where a.year = 1995 and a.status = 'F' and b.year = 1996 and b.status = 'O'")(lambda g: layers.pairs_of_layers(g, [(L95F, ("1996", "O"))]).select("node_id", F.array_join("a", "×").alias("a"), F.array_join("b", "×").alias("b")))
register("categorical_coupling", layered, f"with {LAYERED} select a.node_id, a.year || '×' || a.status as a, b.year || '×' || b.status as b from pr a join pr b on a.node_id = b.node_id and a.status = b.status and a.year < b.year where a.year <= 1997 and b.year <= 1997")(lambda g: layers.categorical_pairs(g, "year", [["1995", "1996", "1997"]]).select("node_id", F.array_join("a", "×").alias("a"), F.array_join("b", "×").alias("b")))
register("diagonal_coupling", layered, f"with {LAYERED} select a.node_id, a.year || '×' || a.status as a, b.year || '×' || b.status as b from pr a join pr b on a.node_id = b.node_id and a.year || '×' || a.status < b.year || '×' || b.status where a.year in (1995, 2001) and b.year in (1995, 2001)")(lambda g: layers.diagonal_pairs(g, {"year": {"1995", "2001"}}).select("node_id", F.array_join("a", "×").alias("a"), F.array_join("b", "×").alias("b")))
register("supra_index", layered, f"with {LAYERED} select row_number() over (order by node_id, cast(year as varchar), status) - 1 as row, node_id, year || '×' || status as layer from pr")(lambda g: layers.supra_index(g).select("row", "node_id", F.array_join("layer", "×").alias("layer")))
register("supra_adjacency", layered, f"with {LAYERED} select i, j, round(value, 6) as value from sa")(layers.supra_adjacency)
register("supra_incidence", layered, f"with {LAYERED} select source || '~' || year || '×' || status as i, edge_id, round(weight, 6) as value from li union all select target || '~' || year || '×' || status, edge_id, round(-weight, 6) from li union all select node_id || '~' || year || '×' || status, edge_id, 1.0 from lc union all select node_id || '~' || (year + 1) || '×' || status, edge_id, 1.0 from lc")(layers.supra_incidence)
register("supra_degree", layered, f"with {LAYERED} select i, round(value, 6) as value from sd")(layers.supra_degree)
register("supra_laplacian_comb", layered, f"with {LAYERED} select i, j, round(sum(value), 6) as value from (select i, i as j, value from sd union all select i, j, -value from sa) group by i, j having abs(sum(value)) > 1e-9")(layers.supra_laplacian)
register("supra_laplacian_norm", layered, f"with {LAYERED} select i, i as j, 1.0 as value from sk union all select sa.i, sa.j, round(-sa.value * (case when a.value > 0 then 1 / sqrt(a.value) else 0 end) * (case when b.value > 0 then 1 / sqrt(b.value) else 0 end), 6) from sa join sd a on a.i = sa.i join sd b on b.i = sa.j where a.value > 0 and b.value > 0")(lambda g: layers.supra_laplacian(g, "norm"))
register("block_intra", layered, f"with {LAYERED} select i, j, round(sum(weight), 6) as value from sx where ml_kind = 'intra' group by i, j")(lambda g: layers.supra_adjacency(g, ("intra",)))
register("block_coupling", layered, f"with {LAYERED} select i, j, round(sum(weight), 6) as value from sx where ml_kind = 'coupling' group by i, j")(lambda g: layers.supra_adjacency(g, ("coupling",)))
register("supra_scaled", layered, f"with {LAYERED} select i, j, round(sum(case ml_kind when 'coupling' then 2.5 else 1 end * weight), 6) as value from sx group by i, j")(lambda g: layers.supra_adjacency(g, coupling_scale=2.5))
register("transition_matrix", layered, f"with {LAYERED} select i, j, round(value / sum(value) over (partition by i), 6) as value from sa")(layers.transition)
register("random_walk_step", layered, f"with {LAYERED}, t as (select i, j, value / sum(value) over (partition by i) as value from sa) select j as i, round(sum(value / (select count(*) from sk)), 6) as value from t group by j")(lambda g: (lambda p: layers.random_walk_step(g, p))(layers.presence(g).select(layers.supra_key().alias("i"), (F.lit(1.0) / layers.presence(g).count()).alias("x"))))
register("diffusion_step", layered, f"with {LAYERED} select sd.i, round(1 - 0.1 * (sd.value - coalesce(a.s, 0)), 6) as x from sd left join (select i, sum(value) as s from sa group by i) a on a.i = sd.i")(lambda g: layers.diffusion_step(g, layers.presence(g).select(layers.supra_key().alias("i"), F.lit(1.0).alias("x")), 0.1))
register("layer_degree_vectors", layered, f"with {LAYERED} select source as node_id, year || '×' || status as layer, round(sum(weight), 6) as value from li group by source, year, status")(layers.layer_degrees)
register("participation_coefficient", layered, f"with {LAYERED}, d as (select source, year, status, sum(weight) as k from li group by source, year, status), p as (select source, 1 - sum(k * k) / (sum(k) * sum(k)) as v from d group by source) select n.node_id, round(coalesce(p.v, 0), 6) as value from (select distinct node_id from pr) n left join p on p.source = n.node_id")(layers.participation)
register("tensor_view", layered, f"with {LAYERED} select split_part(i, '~', 1) as u, split_part(i, '~', 2) as a, split_part(j, '~', 1) as v, split_part(j, '~', 2) as b, round(weight, 6) as value from (select distinct i, j, weight from (select i, j, weight from sx union all select j, i, weight from sx))")(layers.tensor)
register("flatten_layers", layered, f"with {LAYERED} select edge_id, source as node_id, 1 as role, round(weight, 6) as coef from li union all select edge_id, target, -1, round(-weight, 6) from li union all select edge_id, node_id, 1, 1.0 from lc union all select edge_id, node_id, -1, 1.0 from lc")(lambda g: layers.flatten(g).members.select("edge_id", "node_id", F.col("role").cast("int").alias("role"), "coef"))


@register("multislice_modularity", layered, f"with {LAYERED}, x as (select * from sx), k as (select i, cast(substr(split_part(i, '~', 1), 2) as bigint) % 3 as c from sk), t as (select sum(weight) as m from x), ins as (select sum(x.weight) as s from x join k a on a.i = x.i join k b on b.i = x.j where a.c = b.c), dg as (select i, sum(weight) as k from x where ml_kind = 'intra' group by i), bl as (select split_part(dg.i, '~', 2) as l, k.c, sum(dg.k) as k from dg join k on k.i = dg.i group by 1, 2), nu as (select sum(z) as s from (select l, sum(k * k) / sum(k) as z from bl group by l)) select round((ins.s - nu.s) / t.m, 6) as value from ins, nu, t")
def _(g):
    part = layers.presence(g).select("node_id", F.array_join("layer", "×").alias("layer"), (F.substring("node_id", 2, 20).cast("long") % 3).alias("community"))
    return g.spark.createDataFrame([(float(layers.modularity(g, part)),)], "value double")


# projections and algorithms

register("project_reify", orders, f"with {ORDERS} select case when role = 1 then 'he::' || edge_id else node_id end as source, case when role = 1 then node_id else 'he::' || edge_id end as target, edge_id from hm where edge_id like 'HD%' and false union all select case when role = 1 then node_id else 'he::' || edge_id end, case when role = 1 then 'he::' || edge_id else node_id end, edge_id from hm where false union all select case when role = 1 then 'he::' || edge_id else node_id end, case when role = 1 then node_id else 'he::' || edge_id end, edge_id from hm")(lambda g: project.plain(g, "reify").select("source", "target", "edge_id"))
register("project_expand", orders, f"with {ORDERS} select a.node_id as source, b.node_id as target, a.edge_id from (select * from hm where role = 1) a join (select * from hm where role = -1) b on a.edge_id = b.edge_id union all select a.node_id, b.node_id, a.edge_id from (select * from hm where role = 0) a join (select * from hm where role = 0) b on a.edge_id = b.edge_id and a.node_id < b.node_id")(lambda g: project.plain(g, "expand").select("source", "target", "edge_id"))


@register("collapse_multiedges", None, f"with {PS}, f as (select source, target, flag, sum(quantity) as weight, count(*) as capacity, edge_id || ':' || flag as edge_id from ln group by source, target, flag, edge_id) select source, target, count(*) as n_parallel, round(min(weight), 6) as weight, cast(sum(capacity) as bigint) as capacity, min_by(flag, edge_id) as flag from f group by source, target")
def _(spark, sf_dir):
    rows = market.lines(spark, sf_dir).groupBy("source", "target", F.col("l_returnflag").alias("flag"), "edge_id").agg(F.sum("quantity").alias("weight"), F.count("*").alias("capacity"))
    return project.collapse(rows.withColumn("edge_id", F.concat_ws(":", "edge_id", "flag")))


def plain_supply(spark, sf_dir):
    return project.plain(supply(spark, sf_dir))


register("degree_centrality", None, f"with {ALL} select n.node_id, round(count(x.edge_id) / (select count(*) - 1 from nodes), 6) as value from nodes n left join ends x on x.node_id = n.node_id group by n.node_id")(lambda spark, sf_dir: algorithms.degree_centrality(plain_supply(spark, sf_dir), market.nodes(spark, sf_dir)))


# streams

register("stream_incidence", None, f"with {PS} select node_id, edge_id, round(sum(v), 6) as value from (select source as node_id, edge_id, weight as v from ps union all select target, edge_id, -weight from ps) group by node_id, edge_id")(lambda spark, sf_dir: deltas.incidence_of_lines(market.lines(spark, sf_dir)))


# over all rows

register("incident_edges_out", None, f"with {ALL} select node_id, edge_id from ends where (side = 'a' or not directed) and node_id like 'S%'")(lambda spark, sf_dir: query.incident_edges(supply(spark, sf_dir), ids(spark, sf_dir, "S", 1), "out"))
register("incident_edges_in", None, f"with {ALL} select node_id, edge_id from ends where (side = 'b' or not directed) and node_id like 'S%'")(lambda spark, sf_dir: query.incident_edges(supply(spark, sf_dir), ids(spark, sf_dir, "S", 1), "in"))
register("edges_between", None, f"with {ALL} select source, target, edge_id from e where source like 'P%'")(lambda spark, sf_dir: query.edges_between(supply(spark, sf_dir), market.supply_pairs(market.lines(spark, sf_dir))))
register("co_incidence", None, f"with {PS}, b as (select edge_id, source as n, weight as v from ps union all select edge_id, target, -weight from ps) select x.n as i, y.n as j, round(sum(x.v * y.v), 6) as value from b x join b y on x.edge_id = y.edge_id group by x.n, y.n having abs(sum(x.v * y.v)) > 1e-9")(lambda spark, sf_dir: matrices.co_incidence(market.supply(spark, sf_dir, places=False)))

def triangles_of(g: Graph) -> DataFrame:
    held = g.having(edges=spectral.stored(g.edges.select("edge_id", "kind")), members=spectral.stored(g.members.select("edge_id", "node_id", "role")))
    return algorithms.triangles(project.adjacent(held), held.members)


register("triangles", orders, f"with {ORDERS}, x as (select distinct a.node_id as a, b.node_id as b from hm a join hm b on a.edge_id = b.edge_id and a.role = 0 and b.role = 0 and a.node_id < b.node_id), t as (select p.a, p.b, q.b as c from x p join x q on p.b = q.a join x r on r.a = p.a and r.b = q.b) select node_id, count(*) as triangles from (select a as node_id from t union all select b from t union all select c from t) group by node_id")(lambda g: triangles_of(algebra.edge_subgraph(g, g.edges.where("edge_id like 'HO:%'"))))


# to the end: no bound on levels, all edges, all rounds. Their SQL has more rounds than the graph is deep (a test says so)

LEVELS = "p as (select source as a, target as b from e union select target, source from e), r(node_id, level) as (select 'R0', 0 union select p.b, r.level + 1 from r join p on p.a = r.node_id where r.level < 9)"


def spread(rounds: int) -> str:
    """Least labels handed on for a number of rounds."""
    steps = ["p as materialized (select source as a, target as b from e union select target, source from e)", "l0 as materialized (select node_id, node_id as least from nodes)"]
    steps += [f"l{k} as materialized (select l.node_id, least(l.least, coalesce(x.m, l.least)) as least from l{k - 1} l left join (select p.a, min(q.least) as m from p join l{k - 1} q on q.node_id = p.b group by p.a) x on x.a = l.node_id)" for k in range(1, rounds + 1)]
    return ", ".join(steps) + f" select node_id, least as component from l{rounds}"


def ranks(rounds: int) -> str:
    steps = ["od as materialized (select source, count(*) as k from e group by source)", "r0 as materialized (select node_id, 1.0 / (select count(*) from nodes) as rank from nodes)"]
    steps += [f"r{k} as materialized (select n.node_id, 0.15 / c.n + 0.85 * l.lost / c.n + 0.85 * coalesce(g.got, 0) as rank from nodes n cross join (select cast(count(*) as double) as n from nodes) c cross join (select coalesce(sum(rank), 0) as lost from r{k - 1} where node_id not in (select source from od)) l left join (select e.target, sum(r.rank / od.k) as got from e join r{k - 1} r on r.node_id = e.source join od on od.source = e.source group by e.target) g on g.target = n.node_id)" for k in range(1, rounds + 1)]
    return ", ".join(steps) + f" select node_id, round(rank, 6) as rank from r{rounds}"


def from_r0(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("R0",)], "node_id string")


register("bfs_levels", None, f"with recursive {ALL}, {LEVELS} select node_id, min(level) as level from r group by node_id")(lambda spark, sf_dir: algorithms.bfs_levels(plain_supply(spark, sf_dir), from_r0(spark), directed=False))
register("components", None, f"with {ALL}, {spread(12)}")(lambda spark, sf_dir: algorithms.components(plain_supply(spark, sf_dir), market.nodes(spark, sf_dir)))
register("pagerank", None, f"with {ALL}, {ranks(20)}")(lambda spark, sf_dir: algorithms.pagerank(plain_supply(spark, sf_dir), market.nodes(spark, sf_dir)))


@register("shortest_paths", None, f"with recursive {ALL}, {LEVELS} select node_id, cast(min(level) as double) as distance from r group by node_id")
def _(spark, sf_dir):
    arcs = plain_supply(spark, sf_dir).select("source", "target", F.lit(1.0).alias("weight"))
    return algorithms.shortest_paths(arcs.unionAll(arcs.select("target", "source", "weight")), "R0")


# building: parallel edges, edges named twice, edges between layers, direction by attributes

register("add_parallel_edges", None, "select 'P' || l_partkey || '→S' || l_suppkey || case when k = 0 then '' else '#' || k end as edge_id from (select l_partkey, l_suppkey, row_number() over (partition by l_partkey, l_suppkey) - 1 as k from lineitem)")(lambda spark, sf_dir: build.add_edges(empty(spark, True), market.lines(spark, sf_dir).select("source", "target", F.col("quantity").cast("double").alias("weight"))).edges.select("edge_id"))


@register("add_edges_twice", None, "select 'O' || l_orderkey as edge_id, 'P' || l_partkey as source, 'S' || l_suppkey as target, round(cast(l_quantity as double), 6) as weight from (select *, row_number() over (partition by l_orderkey order by ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity desc) as k from lineitem) where k = 1")
def _(spark, sf_dir):
    rows = market.table(spark, sf_dir, "lineitem").select(market.named("O", "l_orderkey").alias("edge_id"), market.named("P", "l_partkey").alias("source"), market.named("S", "l_suppkey").alias("target"), F.col("l_quantity").cast("double").alias("weight"), (((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")).cast("long").alias("ord"))
    return query.edge_list(build.add_edges(empty(spark, True), rows)).select("edge_id", "source", "target", "weight")


def between_years(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts in one year to suppliers in the next."""
    rows = market.lines(spark, sf_dir).groupBy("source", "target", "year").agg(F.sum("quantity").alias("weight"))
    edges = rows.select(F.concat_ws(":", "source", "target", F.col("year").cast("string")).alias("edge_id"), "source", F.array(F.col("year").cast("string")).alias("source_layer"), "target", F.array((F.col("year") + 1).cast("string")).alias("target_layer"), "weight")
    return build.add_edges(layers.set_aspects(empty(spark, True), {"year": [str(y) for y in range(1990, 2005)]}), edges)


register("block_inter", between_years, f"with {PS} select source || '~' || year as i, target || '~' || (year + 1) as j, round(sum(quantity), 6) as value from ln group by source, target, year")(lambda g: layers.supra_adjacency(g, ("inter",)))


@register("flexible_direction", supply, f"with {ALL}, w as (select ps.edge_id, ps.source, ps.target, ps.weight, a.value - b.value as gap from ps join nodes a on a.node_id = ps.source join nodes b on b.node_id = ps.target) select edge_id, source as node_id, round(case when gap < 0 then -weight else weight end, 6) as coef from w union all select edge_id, target, round(case when gap < 0 then weight else -weight end, 6) from w")
def _(g):
    policy = F.struct(F.lit("value").alias("var"), F.lit(0.0).alias("threshold"), F.lit("node").alias("scope"), F.lit("s->t").alias("above"), F.lit("keep").alias("tie"))
    ruled = g.having(edges=g.edges.withColumn("policy", F.when(F.col("edge_id").startswith("PS"), policy)))
    return attrs.flexible(ruled).members.where(F.col("edge_id").startswith("PS")).select("edge_id", "node_id", "coef")


@register("composite_node_keys", None, "select n_name, 'cid:n_name=' || replace(n_name, ' ', '%20') || '|n_regionkey=' || n_regionkey as node_id from nation")
def _(spark, sf_dir):
    rows = market.table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return build.get_or_create_by_attrs(build.set_node_key(build.add_nodes(empty(spark), rows.select(F.lit("n0").alias("node_id"), F.lit("-").alias("n_name"), F.lit("-").alias("n_regionkey")).limit(1)), "n_name", "n_regionkey"), rows)[1].select("n_name", "node_id")


def propagated(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = sliced(spark, sf_dir)
        return build.propagate(g, g.edges, mode).slice_edges.where("slice_id like 'y%'").select("slice_id", "edge_id").distinct()

    return run


register("propagate_shared", None, f"with {SLICED} select distinct a.slice_id, ps.edge_id from ps join sn a on a.node_id = ps.source join sn b on b.node_id = ps.target and b.slice_id = a.slice_id where a.slice_id like 'y%'")(propagated("shared"))
register("propagate_all", None, f"with {SLICED} select a.slice_id, ps.edge_id from ps join sn a on a.node_id = ps.source where a.slice_id like 'y%' union select b.slice_id, ps.edge_id from ps join sn b on b.node_id = ps.target where b.slice_id like 'y%'")(propagated("all"))

# invariants that are broken on purpose


@register("validate_planted", supply_only, "select 'member_without_edge' as rule, 'ghost' as key union all select 'member_without_entity', 'nowhere' union all select 'edge_without_members', 'bare' union all select 'twice_an_edge', 'twin' union all select 'twice_an_entity', 'double' union all select 'two_sources', 'two' union all select 'slice_edge_without_edge', 'lost' union all select 'slice_node_without_node', 'absent' union all select 'slice_unknown', 'unknown' union all select 'weight_not_finite', 'endless'")
def _(g):
    def edges(*ids: str) -> DataFrame:
        made = g.spark.createDataFrame([(i, float("inf") if i == "endless" else 1.0, f"{i}-a", f"{i}-b") for i in ids], "edge_id string, weight double, source string, target string")
        return market.edge_tables(made, True)

    sound, members = edges("two", "endless", "twin")
    bare, _ = edges("bare", "twin")
    stray = members.limit(1)
    odd = stray.withColumns({"edge_id": F.lit("ghost"), "node_id": F.lit("two-a")}).unionByName(stray.withColumns({"edge_id": F.lit("two"), "node_id": F.lit("nowhere"), "role": F.lit(1).cast("byte")}))
    names = members.select("node_id").distinct().unionAll(g.spark.createDataFrame([("double",), ("double",)], "node_id string"))
    entities = names.select("node_id", F.array(F.lit("_")).alias("layer"), F.lit("node").alias("kind"), F.lit(None).cast("long").alias("ord"))
    return history.violations(g.having(
        edges=g.edges.unionByName(sound).unionByName(bare), members=g.members.unionByName(members).unionByName(odd), entities=g.entities.unionByName(entities),
        slice_edges=g.slice_edges.unionByName(g.spark.createDataFrame([("default", "lost"), ("unknown", "bare")], "slice_id string, edge_id string")),
        slice_nodes=g.slice_nodes.unionByName(g.spark.createDataFrame([("default", "absent")], "slice_id string, node_id string")),
    )).distinct()


@register("audit_planted", supply_only, "select 'node_attrs' as \"table\", 'stray' as key union all select 'edge_attrs', 'loose' union all select 'edge_slice_attrs', 'loose' union all select 'edge_slice_attrs', 'nowhere'")
def _(g):
    frame = g.spark.createDataFrame
    g = g.having(node_attrs=g.entities.select("node_id").unionAll(frame([("stray",)], "node_id string")), edge_attrs=g.edge_attrs.unionByName(frame([("loose", 1)], "edge_id string, n_lines long")), edge_slice_attrs=frame([("nowhere", "loose", 1.0)], "slice_id string, edge_id string, weight double"))
    return attrs.audit(g)


# counts, positions, labels, slices with attributes, wholly flattened and unflattened matrices

register("global_counts", sliced, f"with {SLICED} select 'nodes' as kind, count(*) as n from (select source as x from ps union select target from ps) union all select 'edges', count(*) from ps union all select 'entities', count(*) from (select source as x from ps union select target from ps union select edge_id from ps)")(lambda g: g.spark.createDataFrame([(k, slices.global_count(g, k)) for k in ("nodes", "edges", "entities")], "kind string, n long"))
register("entity_counts", supply, f"with {ALL} select 'nodes' as name, count(*) as n from nodes union all select 'edge_entities', 0 union all select 'entities', count(*) from nodes union all select 'edges', count(*) from e")(lambda g: g.spark.createDataFrame(list(indices.stats(g).items()), "name string, n long"))
register("edge_columns", supply, f"with {ALL} select row_number() over (order by edge_id) - 1 as col, edge_id from e")(indices.edge_columns)
register("entity_rows", supply, f"with {ALL} select row_number() over (order by node_id) - 1 as row, node_id from nodes")(lambda g: indices.entity_rows(g).select("row", "node_id"))
register("peek_nodes", supply, f"with {ALL} select node_id from nodes order by node_id limit 10")(lambda g: g.spark.createDataFrame([(x,) for x in dispatch.Projection(g).peek_nodes(10)], "node_id string"))
register("label_to_id", supply, "select r_name as label, 'R' || r_regionkey as node_id from region where r_name in ('ASIA', 'EUROPE') union all select 'N3', 'N3'")(lambda g: dispatch.Projection(g).ids_of(["ASIA", "EUROPE", "N3", "nobody"]))
register("find_node", supply, "select 'R' || r_regionkey as node_id, r_name as name from region where r_name = 'AFRICA'")(lambda g: g.spark.createDataFrame([(lambda r: (r.node_id, r.name))(query.find(g.node_attrs, name="AFRICA", kind="region"))], "node_id string, name string"))
register("intrinsic_columns", supply, f"with {ALL} select edge_id, 'binary' as kind, directed, round(weight, 6) as weight from e")(lambda g: g.resolved().select("edge_id", "kind", F.col("is_directed").alias("directed"), "weight"))
register("slices_view", sliced, "select 'y' || y as slice_id, y as year from (select unnest(range(1995, 2002)) as y) union all select 'flag_' || f, null from (select unnest(['A', 'N', 'R']) as f) union all select 'default', null")(lambda g: views.slices_view(attrs.set_attrs(g, "slices", g.spark.createDataFrame([(y, int(y[1:])) for y in market.YEARS], "slice_id string, year long"))))
register("layer_attributes", layered, "select y || '×' || s as id, y as year, s as status, y - 1990 as year__age from (select unnest(range(1995, 2002)) as y) a cross join (select unnest(['F', 'O']) as s) b")(lambda g: views.layers_view(attrs.set_attrs(g, "elem_layers", g.spark.createDataFrame([("year", y[1:], int(y[1:]) - 1990) for y in market.YEARS], "aspect string, label string, age long"))).select("id", "year", "status", "year__age"))
register("public_attributes", supply, f"with {ALL} select node_id, kind, name, round(value, 6) as value from nodes")(lambda g: attrs.public(g.node_attrs.withColumn("__cache", F.lit(1))))
register("project_skip", orders, f"with {ORDERS} select edge_id as source, edge_id as target, edge_id from hm where false")(lambda g: project.plain(g, "skip").select("source", "target", "edge_id"))
register("project_skip_binary", supply, f"with {ALL} select source, target, edge_id, round(weight, 6) as weight, directed from e")(lambda g: project.plain(g, "skip"))
register("supra_unflatten", layered, f"with {LAYERED} select split_part(i, '~', 1) as u, split_part(i, '~', 2) as a, split_part(j, '~', 1) as v, split_part(j, '~', 2) as b, round(value, 6) as value from sa")(lambda g: layers.unflatten(layers.supra_adjacency(g)))
register("tensor_flatten", layered, f"with {LAYERED} select i, j, round(sum(weight), 6) as value from (select distinct i, j, weight from (select i, j, weight from sx union all select j, i, weight from sx)) group by i, j")(lambda g: layers.flatten_tensor(layers.tensor(g)))
register("tensor_index", layered, f"with {LAYERED} select 'node' as axis, row_number() over (order by node_id) - 1 as position, node_id as id from (select distinct node_id from pr) union all select 'layer', row_number() over (order by l) - 1, l from (select distinct year || '×' || status as l from pr)")(layers.tensor_index)
register("node_layers", layered, f"with {LAYERED} select node_id, string_agg(year || '×' || status, '|' order by year || '×' || status) as layers from pr group by node_id")(lambda g: layers.node_layers(g).select("node_id", F.array_join("layers", "|").alias("layers")))
register("neighbors_python_view", supply, "select 'SN:' || s_suppkey as edge_id from supplier where s_acctbal > 0")(lambda g: views.View(g, nodes=lambda r: r["kind"] == "nation" or r["kind"] == "supplier" and r["value"] > 0).edge_ids())
register("rename_nodes", supply, f"with {ALL} select edge_id, replace(source, 'N', 'nation-') as source, replace(replace(target, 'N', 'nation-'), 'R', 'R') as target from e")(lambda g: query.edge_list(algebra.rename_nodes(g, g.node_attrs.where("kind = 'nation'").select("node_id", F.replace("node_id", F.lit("N"), F.lit("nation-")).alias("new_id")))).select("edge_id", "source", "target"))
register("set_weights", supply, f"with {ALL} select edge_id, node_id, round(case when edge_id like 'CN%' then 2.5 else coef end, 6) as coef from ends")(lambda g: algebra.set_weights(g, g.edges.where("edge_id like 'CN%'").select("edge_id", F.lit(2.5).alias("weight"))).members.select("edge_id", "node_id", "coef"))
register("set_directions", supply, f"with {ALL} select edge_id, node_id, round(case when edge_id like 'SN%' and side = 'b' then -coef else coef end, 6) as coef from ends")(lambda g: algebra.set_directions(g, g.edges.where("edge_id like 'SN%'").select("edge_id", F.lit(True).alias("directed"))).members.select("edge_id", "node_id", "coef"))

# spectra of a ring of the regions, whose eigenvalues are known


def ring(spark: SparkSession, sf_dir: str) -> Graph:
    rows = market.table(spark, sf_dir, "region")
    n = rows.count()
    return build.add_edges(empty(spark, False), rows.select(market.named("ring", "r_regionkey").alias("edge_id"), market.named("R", "r_regionkey").alias("source"), F.concat(F.lit("R"), ((F.col("r_regionkey") + 1) % n).cast("string")).alias("target"), F.lit(1.0).alias("weight")))


RING = "select k, 2 - 2 * cos(2 * pi() * k / n) as value from (select unnest(range(0, (select count(*) from region))) as k), (select count(*) as n from region)"
register("laplacian_spectrum", ring, f"select cast(row_number() over (order by value, k) - 1 as int) as k, round(value, 6) + 0 as value from ({RING})")(lambda g: g.spark.createDataFrame([(k, abs(round(v, 6))) for k, (v, _) in enumerate(spectral.smallest_laplacian(g, 5))], "k int, value double"))
register("algebraic_connectivity", ring, f"select round(min(value), 6) as value from ({RING}) where k > 0")(lambda g: g.spark.createDataFrame([(spectral.algebraic_connectivity(g)[0],)], "value double"))
register("coupling_sweep", ring, f"select s as scale, (select round(min(value), 6) from ({RING}) where k > 0) as value from (select unnest([0.0, 1.0, 2.0]) as s)")(lambda g: g.spark.createDataFrame(list(zip([0.0, 1.0, 2.0], spectral.sweep(g, [0.0, 1.0, 2.0]))), "scale double, value double"))
register("dominant_walk_value", ring, "select 1.0 as value")(lambda g: g.spark.createDataFrame([(round(spectral.dominant_walk_pair(g)[0], 4),)], "value double"))
register("versatility", ring, "select 'R' || r_regionkey as node_id, 1.0 as value from region")(lambda g: spectral.versatility(g).select("node_id", F.round("value", 3).alias("value")))

# files: a graph is written to the shared folder and read back


def scratch(spark: SparkSession) -> str:
    return f"{spectral.shared_folder(spark)}/tessera-io-{uuid.uuid4().hex[:12]}"


def through(write: Callable, read: Callable, graph: Callable, show: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark)
        write(graph(spark, sf_dir), path)
        spectral.free_shuffles(spark)
        return show(read(spark, path))

    return run


def weighted(g: Graph) -> DataFrame:
    return query.edge_list(g).select("edge_id", "source", "target", "weight")


def sided(g: Graph) -> DataFrame:
    return query.edge_sides(g).select("edge_id", joined("sources").alias("sources"), joined("targets").alias("targets"))


EDGES_SQL = f"with {ALL} select edge_id, source, target, round(weight, 6) as weight from e"
SIDES_SQL = f"with {ORDERS} select edge_id, string_agg(case when role <> -1 then node_id end, '|' order by node_id) as sources, coalesce(string_agg(case when role = -1 then node_id end, '|' order by node_id), '') as targets from hm group by edge_id"
FORMATS = {"native": (native.write, native.read), "ndjson": (documents.write_ndjson, documents.read_ndjson), "json": (documents.write_json, documents.read_json), "cx2": (lambda g, path: documents.write_cx2(g, path, compression="gzip"), documents.read_cx2), "graphml": (lambda g, path: markup.write_graphml(g, path, compression="gzip"), markup.read_graphml), "gexf": (lambda g, path: markup.write_gexf(g, path, compression="gzip"), markup.read_gexf)}
for fmt, (writer, reader) in FORMATS.items():
    register(f"io_{fmt}_edges", None, EDGES_SQL)(through(writer, reader, supply, weighted))
    register(f"io_{fmt}_hyperedges", None, SIDES_SQL)(through(writer, reader, orders, sided))
register("io_csv_edges", None, EDGES_SQL)(through(delimited.write, lambda spark, path: delimited.read(spark, path, "edge_list"), supply, weighted))
register("io_csv_hyperedges", None, SIDES_SQL)(through(lambda g, path: delimited.write(g, path, hyper=True), lambda spark, path: delimited.read(spark, path, "hyperedge"), orders, sided))
register("io_sif_edges", None, f"with {ALL} select source, target from e")(through(documents.write_sif, documents.read_sif, supply, lambda g: query.edge_list(g).select("source", "target")))
register("io_sbml_reactions", None, f"with {ORDERS} select edge_id, node_id, round(coef, 6) as coef from hm where edge_id like 'HD%'")(through(markup.write_sbml, markup.read_sbml, lambda spark, sf_dir: (lambda g: algebra.edge_subgraph(g, g.edges.where("edge_id like 'HD:%'")))(orders(spark, sf_dir)), lambda g: g.members.select("edge_id", "node_id", "coef")))
register("io_frames", supply, EDGES_SQL)(lambda g: weighted(frames.from_frames(g.spark, **{k: v for k, v in frames.to_frames(g).items() if k in ("nodes", "edges")})))
register("io_frames_members", orders, SIDES_SQL)(lambda g: sided(frames.from_frames(g.spark, hyperedges=frames.to_frames(g, explode=True)["hyperedges"])))
register("ingest_coordinates", None, f"with {PS} select source, target, round(weight, 6) as weight from ps")(lambda spark, sf_dir: query.edge_list(delimited.ingest(market.supply_pairs(market.lines(spark, sf_dir)).select(F.col("source").alias("row"), F.col("target").alias("col"), F.col("weight").cast("double").alias("val")))).select("source", "target", "weight"))
register("ingest_neighbour_lists", None, f"with {PS} select source, target from ps")(lambda spark, sf_dir: query.edge_list(delimited.ingest(market.supply_pairs(market.lines(spark, sf_dir)).groupBy(F.col("source").alias("node")).agg(F.array_join(F.collect_list("target"), "|").alias("neighbors")))).select("source", "target"))
register("ingest_incidence", None, "select 'NR' || n_nationkey as edge_id, 'N' || n_nationkey as source, 'R' || n_regionkey as target, 1.0 as weight from nation")(lambda spark, sf_dir: weighted(delimited.ingest(nation_table(spark, sf_dir), "incidence")))
register("ingest_adjacency", None, "select 'R' || a.r_regionkey as source, 'R' || b.r_regionkey as target, cast(1 + (a.r_regionkey + b.r_regionkey) % 2 as double) as weight from region a join region b on a.r_regionkey < b.r_regionkey")(lambda spark, sf_dir: query.edge_list(delimited.ingest(region_table(spark, sf_dir), "adjacency")).select("source", "target", "weight"))


def nation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by edges, wide: a nation runs to its region."""
    rows = market.table(spark, sf_dir, "nation")
    cells = rows.select(market.named("N", "n_nationkey").alias("node"), market.named("NR", "n_nationkey").alias("edge"), F.lit(1.0).alias("v")).unionAll(rows.select(market.named("R", "n_regionkey"), market.named("NR", "n_nationkey"), F.lit(-1.0)))
    return cells.groupBy("node").pivot("edge").agg(F.sum("v"))


def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    cells = rows.crossJoin(rows.withColumnRenamed("k", "l")).select(market.named("R", "k").alias("node"), market.named("R", "l").alias("other"), (1.0 + (F.col("k") + F.col("l")) % 2).alias("v"))
    return cells.groupBy("node").pivot("other").agg(F.sum("v"))


def delivered(policy: str):
    return lambda spark, sf_dir: delivery.deliver(by_year(1997, 2001)(spark, sf_dir), by_year(1995, 1998)(spark, sf_dir), on_conflict=policy).edges.select("edge_id", "weight")


register("deliver_skip", None, f"with {TWO} select edge_id, round(weight, 6) as weight from a union all select edge_id, round(weight, 6) from b where edge_id not in (select edge_id from a)")(delivered("skip"))
register("deliver_replace", None, f"with {TWO} select edge_id, round(weight, 6) as weight from b union all select edge_id, round(weight, 6) from a where edge_id not in (select edge_id from b)")(delivered("replace"))


@register("sidecar", None, f"with {SLICED} select slice_id, edge_id, round(weight, 6) as weight from se")
def _(spark, sf_dir):
    path, g = scratch(spark), sliced(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", delivery.LossWarning)
        documents.write_sif(g, path)
        delivery.write_sidecar(g, path, "sif")
    return delivery.apply_sidecar(documents.read_sif(spark, path), path, "require").edge_slice_attrs.select("slice_id", "edge_id", "weight")


@register("history_export", None, "select event_id as version, event_type as op from events")
def _(spark, sf_dir):
    path = scratch(spark)
    history.export(empty(spark).having(history=deltas.event_log(market.table(spark, sf_dir, "events"))), path, "ndjson")
    return spark.read.schema("version long, op string").json(path)


@register("stream_batches", None, f"with {PS} select node_id, edge_id, round(sum(v), 6) as value from (select source as node_id, edge_id, weight as v from ps union all select target, edge_id, -weight from ps) group by node_id, edge_id")
def _(spark, sf_dir):
    """Incidence kept up by micro-batches of the lines' files."""
    path = scratch(spark)
    rows = market.lines(spark, sf_dir).select("edge_id", "source", "target", "quantity")
    rows.repartition(4).write.parquet(f"{path}/in")
    sink = deltas.IncidenceSink(f"{path}/out")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return sink.current(spark)
