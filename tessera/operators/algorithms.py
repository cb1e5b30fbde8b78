"""Graph algorithms over plain edges (source, target): components, levels, ranks, triangles, paths."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.spectral import cut, stored


def both_ways(edges: DataFrame) -> DataFrame:
    pairs = edges.select("source", "target")
    return pairs.unionAll(pairs.select("target", "source")).where("source <> target").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, component): the least id that a node reaches, by smallest neighbours and jumps."""
    pairs = both_ways(edges)
    held = cut(pairs.where("source > target").select(F.col("source").alias("a"), F.col("target").alias("b")))
    while True:
        low = cut(held.groupBy("a").agg(F.min("b").alias("m")))
        jump = low.alias("x").join(low.alias("y"), F.col("x.m") == F.col("y.a"), "left").select(F.col("x.a").alias("a"), F.coalesce("y.m", "x.m").alias("b"), F.col("y.m").isNotNull().alias("moved"))
        rest = held.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        new = cut(jump.unionAll(rest).groupBy("a", "b").agg(F.max("moved").alias("moved")))
        held = new.select("a", "b")
        if new.where("moved").isEmpty():
            break
    ids = (nodes.select("node_id") if nodes is not None else pairs.select(F.col("source").alias("node_id"))).distinct()
    return ids.join(held.select(F.col("a").alias("node_id"), F.col("b").alias("component")), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def bfs_levels(edges: DataFrame, starts: DataFrame, directed: bool = True, most: int | None = None) -> DataFrame:
    """(node_id, level): fewest steps from any start, below `most` if given; nodes out of reach are left out."""
    pairs = cut(edges.select("source", "target").distinct() if directed else both_ways(edges))  # once, not in every round
    seen = cut(starts.select("node_id", F.lit(0).alias("level")).distinct())
    front = seen
    for level in itertools.count(1) if most is None else range(1, most):
        ahead = front.join(pairs, front.node_id == pairs.source).select(F.col("target").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        front = cut(ahead.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node_id, rank) after a fixed number of rounds; parallel edges weigh as one each, dangling rank goes to all."""
    links = cut(edges.select("source", "target"))
    out = links.groupBy("source").agg(F.count("*").alias("n"))
    moves = cut(links.join(out, "source"))
    n = nodes.count()
    rank = cut(nodes.select("node_id").distinct().withColumn("rank", F.lit(1.0 / max(1, n))))
    for _ in range(rounds):
        lost = rank.join(out, rank.node_id == out.source, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).first().lost
        got = moves.join(rank, moves.source == rank.node_id).groupBy("target").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        rank = cut(rank.select("node_id").join(got, rank.node_id == got.target, "left").select("node_id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return rank


COLOURS = 16  # of nodes; a task has three, or three sets of equally many


def triangles(edges: DataFrame, nodes: DataFrame | None = None, most: int = 3_000_000) -> DataFrame:
    """(node_id, triangles); nodes: all those of the edges, if at hand.

    Nodes have colours by a hash without collisions, and edges lie in a file of their two colours. A task for each three
    colours (or sets of them: about `most` edges a task, while 16 colours suffice) reads the edges among them and counts
    the triangles of just these three, so neither wedges nor copies of edges are written anywhere.
    """
    spark = edges.sparkSession
    ids = nodes.select("node_id") if nodes is not None else edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    ids = stored(ids.where("node_id is not null").distinct())
    n = ids.count()
    seed = next(k for k in itertools.count() if ids.agg(F.count_distinct(F.xxhash64(F.lit(k), "node_id"))).first()[0] == n)
    ends = edges.where("source <> target").select(*(F.xxhash64(F.lit(seed), c).alias(c) for c in ("source", "target")))
    a, b = F.least("source", "target"), F.greatest("source", "target")
    colour = [F.pmod(x, F.lit(COLOURS)).cast("int") for x in (a, b)]
    rows = ends.select((F.least(*colour) * COLOURS + F.greatest(*colour)).alias("block"), F.pmod(F.shiftright(a, 8), F.lit(16)).cast("int").alias("part"), a.alias("a"), b.alias("b"))
    # dealt once: equal edges meet in their block's part
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "block", "part").distinct()
    held = stored(dealt.drop("part").sortWithinPartitions("block", "a", "b"), "block")
    path, total = held.inputFiles(), held.count()
    root = path[0].split("/block=")[0] if path else ""
    sets = next((k for k in (1, 2, 4, 8) if total * (6 if k > 1 else 1) <= most * k * k), COLOURS)
    trios = list(itertools.combinations_with_replacement(range(sets), 3))
    chosen = spark.createDataFrame(trios, "x int, y int, z int").repartition(min(len(trios), 4 * parts), "x", "y", "z")
    counted = chosen.mapInArrow(counter(root, sets, COLOURS), "code long, n long")
    sums = stored(counted.groupBy("code").agg(F.sum("n").alias("triangles")))
    named = ids.select("node_id", F.xxhash64(F.lit(seed), "node_id").alias("code"))
    return named.join(sums, "code").select("node_id", "triangles")


def counter(root: str, sets: int, colours: int):
    """A function of tasks, whole in itself: executors need no copy of this package."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def edges_of(trio):
            if not root:  # no edges
                return [np.zeros(0, np.int64)] * 2
            wanted = {tuple(sorted(p)) for p in ((trio[0], trio[1]), (trio[0], trio[2]), (trio[1], trio[2]))}
            store, top = fs.FileSystem.from_uri(root if root.startswith("file:") or "://" in root else f"file://{root}")
            found = []
            for i in range(colours):
                for j in range(i, colours):
                    if tuple(sorted((i % sets, j % sets))) in wanted:
                        for f in store.get_file_info(fs.FileSelector(f"{top}/block={i * colours + j}", allow_not_found=True)):
                            if f.path.endswith(".parquet"):
                                found.append(pq.read_table(f.path, columns=["a", "b"], filesystem=store, partitioning=None))
            return [pa.concat_tables(found)[c].to_numpy() for c in ("a", "b")] if found else [np.zeros(0, np.int64)] * 2

        def count(trio):
            """Codes of nodes and their triangles: each edge runs from its end of lower degree, and two edges of a node are closed by a third or not."""
            a, b = edges_of(trio)
            code, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n, m = len(code), len(a)
            order = np.argsort(np.bincount(at, minlength=n), kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            at = rank[at]
            key = np.sort(np.minimum(at[:m], at[m:]) * n + np.maximum(at[:m], at[m:]))
            del a, b, at
            low, high = key // max(n, 1), key % max(n, 1)
            others = np.cumsum(np.bincount(low, minlength=n))[low] - np.arange(m) - 1  # edges behind this one at its node
            bits = max(16, int(m * 12).bit_length())
            slot = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            seen[slot(key)] = True
            paint, sums, ahead, begin = code[order] % sets, np.zeros(n, np.int64), np.cumsum(others), 0
            while begin < m:
                before = int(ahead[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ahead, before + 1_000_000, "right")))
                first = np.repeat(np.arange(begin, end), others[begin:end])
                second = first + 1 + np.arange(len(first)) - np.repeat(ahead[begin:end] - others[begin:end] - before, others[begin:end])
                third = high[first] * n + high[second]
                maybe = np.flatnonzero(seen[slot(third)])
                third = third[maybe]
                maybe = maybe[key[np.minimum(np.searchsorted(key, third), m - 1)] == third]
                corners = np.stack([low[first[maybe]], high[first[maybe]], high[second[maybe]]])
                just = (np.sort(paint[corners], axis=0) == np.array(trio)[:, None]).all(axis=0)
                sums += np.bincount(corners[:, just].reshape(-1), minlength=n)
                begin = end
            hit = np.flatnonzero(sums)
            return code[order][hit], sums[hit]

        for batch in batches:
            for trio in zip(*(c.to_pylist() for c in batch.columns)):
                code, n = count(trio)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    return run


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, value): degree over the number of other nodes."""
    n = nodes.count()
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d"))
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", (F.coalesce("d", F.lit(0)) / max(1, n - 1)).alias("value"))


def shortest_paths(edges: DataFrame, start: str) -> DataFrame:
    """(node_id, distance) by relaxation over edges (source, target, weight) with weights of 0 or more, until nothing gets shorter."""
    links = cut(edges.groupBy("source", "target").agg(F.min("weight").alias("weight")))
    if not links.where("weight < 0").isEmpty():
        raise ValueError("weights below 0")
    best = cut(links.sparkSession.createDataFrame([(start, 0.0, True)], "node_id string, distance double, fresh boolean"))
    while not best.where("fresh").isEmpty():  # only what got shorter in a round reaches further
        ahead = best.where("fresh").join(links, F.col("node_id") == F.col("source")).select(F.col("target").alias("node_id"), (F.col("distance") + F.col("weight")).alias("distance"), F.lit(True).alias("fresh"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(ahead)
        best = cut(both.groupBy("node_id").agg(F.min("distance").alias("distance"), F.min(F.when(~F.col("fresh"), F.col("distance"))).alias("old")).select("node_id", "distance", F.coalesce(F.col("distance") < F.col("old"), F.lit(True)).alias("fresh")))
    return best.drop("fresh")
