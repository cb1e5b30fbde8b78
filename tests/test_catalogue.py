"""Every query of the catalogue against its SQL, at the smallest scale."""

import pytest

from tessera.plans import catalogue
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sql, name):
    assert rows_of_spark(catalogue.QUERIES[name](spark, SF)) == rows_of_sql(sql, catalogue.ORACLES[name])


def test_pagerank_sums_to_one(spark):
    total = catalogue.QUERIES["pagerank"](spark, SF).agg({"rank": "sum"}).first()[0]
    assert abs(total - 1) < 0.01


def reached(start, ahead):
    level, front = {start: 0}, [start]
    while front:
        front = [b for b in {b for a in front for b in ahead.get(a, ())} if b not in level]
        level |= dict.fromkeys(front, max(level.values()) + 1)
    return level


def test_whole_graph_by_brute_force(spark, sql):
    nodes = {r[0] for r in sql.execute(f"with {catalogue.ALL} select node_id from nodes").fetchall()}
    ahead = {}
    for a, b in sql.execute(f"with {catalogue.ALL} select source, target from e").fetchall():
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set()).add(a)
    want = reached("R0", ahead)
    assert 3 < max(want.values()) < 9  # the SQL follows nine levels
    assert {r.node_id: r.level for r in catalogue.QUERIES["bfs_levels"](spark, SF).collect()} == want
    least = {}
    for x in sorted(nodes):
        if x not in least:
            least |= dict.fromkeys(reached(x, ahead), x)
    assert {r.node_id: r.component for r in catalogue.QUERIES["components"](spark, SF).collect()} == least


def test_whole_pagerank_by_brute_force(spark):
    links = [(r.source, r.target) for r in catalogue.plain_supply(spark, SF).select("source", "target").collect()]
    nodes = sorted(r.node_id for r in catalogue.market.nodes(spark, SF).select("node_id").collect())
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        lost = sum(v for x, v in rank.items() if x not in out)
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for a, to in out.items():
            for b in to:
                new[b] += 0.85 * rank[a] / len(to)
        rank = new
    got = {r.node_id: r["rank"] for r in catalogue.QUERIES["pagerank"](spark, SF).collect()}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) <= 1e-6 for x in rank)
