"""Approximate nearest neighbours through low-dimensional stable projections.

Largest inner product becomes smallest distance: every vector gets one more component that lifts
it to the greatest norm of all, a query 0, and queries are scaled to that norm. A Gaussian (2-stable)
matrix projects to DIMENSIONS; squared projected over squared true distance is then chi-square distributed
with as many degrees of freedom. A kd-tree over the projections, split at medians of a sample of at most SAMPLE rows, holds
every vector; its leaves keep the exact bounds of all their rows.

A query takes leaves in order of projected distance, FIRST_LEAVES at first and twice as many in each round, and every vector of a
leaf is verified by its true inner product. It stops when the chi-square test says that a vector as near as
its k-th best would lie within the leaves taken with probability CONFIDENCE, or when no leaf is left.

Leaves are dealt out in blocks of bounded size, and so are the queries that meet there: a leaf is copied as
often as its queries of a round fill blocks. Of equal vectors only the k + 1 smallest ids can be among the k
nearest of any query; others are set aside. Inner products of a block come from one matrix product, whose last bits depend
on its shape; what may be among the k best by them is summed again in the order of the components, so equal vectors tie.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as query nor candidate; repeated rows count once; of an id with several vectors the least vector asks, and
each is a candidate; ties go to the smaller id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Stash

DIMENSIONS = 8
SAMPLE = 1 << 18  # rows whose projections, 64 bytes each, split the tree
LEAF = 256
MOST_LEAVES = 1 << 16  # their bounds, 9 MB, go to the driver and with the tasks
FIRST_LEAVES = 8
SLACK = 1e-9  # of the product of two norms: far more than a sum in another order differs by
CONFIDENCE = 0.95
BLOCK = 8_192  # vectors, and queries, that meet in one group


def chi_square_below(x: np.ndarray, k: int) -> np.ndarray:
    """Distribution function of chi-square with k (even) degrees of freedom."""
    half, total = x / 2, np.zeros_like(x)
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(k // 2):
            total += np.exp(j * np.log(np.maximum(half, 1e-300)) - half - lgamma(j + 1))
    return np.where(np.isinf(x), 1.0, 1 - np.minimum(1, total))


def chi_square_at(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(np.array([mid]), k)[0] < p else (low, mid)
    return high


@dataclass
class Tree:
    """kd-tree whose node i has children 2i+1 and 2i+2; leaves are numbered from the left."""

    matrix: np.ndarray  # (d + 1, m)
    norm: float
    axis: np.ndarray
    cut: np.ndarray
    depth: int

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = np.einsum("ij,ij->i", x, x)
        if query:
            return (x * (self.norm / np.sqrt(size))[:, None]) @ self.matrix[:-1]
        return x @ self.matrix[:-1] + np.sqrt(np.maximum(0, self.norm**2 - size))[:, None] * self.matrix[-1]

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.axis[at]] > self.cut[at])
        return at - (2**self.depth - 1)


def grow(projected: np.ndarray, matrix: np.ndarray, norm: float, depth: int) -> Tree:
    tree = Tree(matrix, norm, np.zeros(2**depth, np.int64), np.zeros(2**depth), depth)
    rows = {0: projected}
    for node in range(2**depth - 1):
        p = rows.pop(node)
        if len(p):
            tree.axis[node] = axis = int(np.ptp(p, axis=0).argmax())
            tree.cut[node] = np.median(p[:, axis])
        right = p[:, tree.axis[node]] > tree.cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = p[~right], p[right]
    return tree


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of their components whatever the number of rows."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


BEST = "array<struct<away:double,vec_id:long>>"
BEST_ARROW = pa.list_(pa.struct([("away", pa.float64()), ("vec_id", pa.int64())]))


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that is_query holds for."""
    spark = vectors.sparkSession
    stash = Stash(spark, "neighbours")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))")).alias("norm")).orderBy(F.desc("n"), "d").limit(1).collect()
    answer = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], answer)
    d, n, norm = lengths[0]
    rows = stash.keep(rows.where(F.size("v") == d).dropDuplicates(["vec_id", "v"]), "rows")
    leaves = max(1, min(MOST_LEAVES, n // LEAF))
    depth = int(leaves).bit_length() - 1
    matrix = np.random.default_rng(seed).standard_normal((d + 1, DIMENSIONS))
    flat = Tree(matrix, norm * (1 + 1e-9), np.zeros(0, np.int64), np.zeros(0), 0)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = flat.project(matrix_of(batch.column(0)), False) if batch.num_rows else np.zeros((0, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in p], pa.binary())], names=["p"])

    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(min(SAMPLE, 32 * leaves)).select("v").mapInArrow(projected, "p binary").toArrow()["p"]
    tree = grow(np.frombuffer(b"".join(sample.to_pylist())).reshape(-1, DIMENSIONS), matrix, flat.norm, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = tree.project(matrix_of(batch.column(1)), False) if batch.num_rows else np.zeros((0, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tree.leaf(p)), pa.array([r.tobytes() for r in p], pa.binary())], names=["vec_id", "v", "leaf", "p"])

    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("vec_id", "v", F.row_number().over(order).alias("copy")).where(F.col("copy") <= k + 1).select("vec_id", "v")
    placed = stash.keep(few.mapInArrow(place, "vec_id long, v array<double>, leaf long, p binary"), "placed")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, size = np.full((2**depth, DIMENSIONS), np.inf), np.full((2**depth, DIMENSIONS), -np.inf), np.zeros(2**depth, np.int64)
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            p = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, DIMENSIONS)
            np.minimum.at(low, leaf, p)
            np.maximum.at(high, leaf, p)
            size += np.bincount(leaf, minlength=2**depth)
        full = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), *(pa.array(x[full].tolist(), pa.list_(pa.float64())) for x in (low, high))], names=["leaf", "n", "low", "high"])

    names = [f"{x}{j}" for x in ("low", "high") for j in range(DIMENSIONS)]
    per_leaf = placed.select("leaf", "p").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(bounds, "leaf long, n long, low array<double>, high array<double>")
    aggregates = [(F.min if x.startswith("low") else F.max)(F.col(x.rstrip("0123456789"))[int(x.lstrip("lowhig"))]).alias(x) for x in names]
    held = per_leaf.groupBy("leaf").agg(F.sum("n").alias("n"), *aggregates).collect()  # at most MOST_LEAVES rows
    number = np.array([r.leaf for r in held], np.int64)
    low = np.array([[r[x] for x in names[:DIMENSIONS]] for r in held])
    high = np.array([[r[x] for x in names[DIMENSIONS:]] for r in held])
    sizes = spark.createDataFrame([(int(r.leaf), -(-r.n // BLOCK)) for r in held], "leaf long, blocks long")
    enough = chi_square_at(CONFIDENCE, DIMENSIONS)

    queries = rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    state = stash.keep(queries.withColumn("best", F.expr(f"cast(array() as {BEST})")), "state-0")

    def choose(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = matrix_of(part.column(1))
                    p = tree.project(x, True)[:, None]
                    away = (np.maximum(0, np.maximum(low - p, p - high)) ** 2).sum(axis=2)
                    by = np.argsort(away, axis=1, kind="stable")[:, begin:end]
                    near = np.take_along_axis(away, by, 1)
                    best = part.column(2).to_pylist()
                    kth = np.array([-b[k - 1]["away"] if len(b) >= k else -np.inf for b in best])
                    scale = tree.norm / np.sqrt(np.einsum("ij,ij->i", x, x))
                    distance = np.maximum(1e-12, 2 * tree.norm**2 - 2 * kth * scale)
                    row, column = np.nonzero(near <= enough * distance[:, None])
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(number[by[row, column]]), part.column(0).take(pa.array(row))], names=["leaf", "query_id"])

        return run

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["vec_id"].to_numpy()
        asked, out = left["query_id"].to_numpy(), []
        if len(ids) and len(asked):
            x, q = matrix_of(right["v"].combine_chunks()), matrix_of(left["q"].combine_chunks())
            by = np.argsort(ids, kind="stable")
            ids, x = ids[by], x[by]
            longest = np.sqrt(np.einsum("ij,ij->i", x, x).max())
            top = min(k, len(ids)) - 1
            for at in range(0, len(q), 512):
                block = q[at : at + 512]
                away = -(block @ x.T)
                away[asked[at : at + 512, None] == ids] = np.inf
                slack = SLACK * longest * np.sqrt(np.einsum("ij,ij->i", block, block))
                near = away <= (np.partition(away, top, axis=1)[:, top] + slack)[:, None]
                row, column = np.nonzero(near & np.isfinite(away))
                exact = -dots(block[row], x[column])
                by = np.lexsort((ids[column], exact, row))
                row, column, exact = row[by], column[by], exact[by]
                cut = np.searchsorted(row, np.arange(len(block) + 1))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    b = min(b, a + k)
                    out.append([{"away": d, "vec_id": i} for d, i in zip(exact[a:b].tolist(), ids[column[a:b]].tolist())])
        return pa.table({"query_id": pa.array(asked[: len(out)], pa.int64()), "found": pa.array(out, BEST_ARROW)})

    begin, step = 0, FIRST_LEAVES
    for turn in range(1, 64):
        pairs = stash.keep(state.mapInArrow(choose(begin, begin + step), "leaf long, query_id long"), f"pairs-{turn}")
        # (leaf, rows' blocks, queries' blocks): as many rows as leaves
        shares = pairs.groupBy("leaf").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as long)").alias("parts")).join(F.broadcast(sizes), "leaf")
        shares = stash.keep(shares, f"shares-{turn}")
        if shares.isEmpty():  # whoever takes no leaf of a round takes none that lies farther away
            break
        split = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
        sent = pairs.join(F.broadcast(shares), "leaf").select("leaf", F.pmod(F.xxhash64("query_id"), "parts").alias("part"), split("blocks", "block"), "query_id")
        sent = sent.join(state.select("query_id", F.col("v").alias("q")), "query_id")
        dealt = placed.select("vec_id", "v", "leaf").join(F.broadcast(shares), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), split("parts", "part"), "vec_id", "v")
        keys = ["leaf", "block", "part"]
        found = sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(verify, f"query_id long, found {BEST}")
        merged = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
        state = stash.keep(state.join(merged, "query_id", "left").select("query_id", "v", F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.expr(f"cast(array() as {BEST})")))), 1, k).alias("best")), f"state-{turn}")
        for name in ("state", "pairs", "shares"):
            stash.drop(f"{name}-{turn - 1}")
        begin, step = begin + step, 2 * step
        if begin >= len(held):
            break
    out = state.select("query_id", F.posexplode("best").alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.away")).alias("score"))
