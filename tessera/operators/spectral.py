"""Eigenvalues of layered graphs: on the driver below a size, by distributed power iteration beyond it.

Matrices are made symmetric first. Vectors of the iteration are frames; lineage is cut by checkpoints.
"""

from __future__ import annotations

import gc
import uuid
import warnings
from collections.abc import Callable
from tempfile import mkdtemp

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import Graph
from tessera.operators import layers

SMALL = 1_500  # rows up to which a matrix is solved on the driver
ROUNDS = 200


def symmetric(cells: DataFrame) -> DataFrame:
    half = F.col("value") / 2
    return cells.select("i", "j", half.alias("value")).unionAll(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), half)).groupBy("i", "j").agg(F.sum("value").alias("value"))


def dense(cells: DataFrame, ids: list[str]) -> np.ndarray:
    at = {x: k for k, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in cells.collect():
        out[at[r.i], at[r.j]] += r.value
    return (out + out.T) / 2


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where there is none and one machine does it all."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + mkdtemp(prefix="tessera-checkpoint-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds that nothing refers to them."""
    spark.range(1).collect()  # listeners hold the last query that ended
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Rows written as Parquet to the shared folder, much smaller than a checkpoint; shuffle files of finished steps go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-rows-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def settle(g: Graph) -> Graph:
    """The graph with all its tables checkpointed: plans after many edits start anew."""
    return g.having(**{t: cut(df) for t, df in g.tables.items()})


class NotSettled(UserWarning):
    """A power iteration ended at its last round."""


def power(cells: DataFrame, start: DataFrame, apart: list[DataFrame] = (), rounds: int = ROUNDS, tolerance: float = 1e-10) -> tuple[float, DataFrame]:
    """Dominant eigenpair of a symmetric matrix, orthogonal to unit vectors (i, x); warns if the value still moves in the last round.

    A round writes the product beside the vector once; all sums that it needs are one aggregate of that.
    """
    x, last, value = start, None, 0.0
    for _ in range(rounds):
        y = cells.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
        held = x.join(y, "i", "left").select("i", "x", F.coalesce("y", F.lit(0.0)).alias("y"))
        for k, v in enumerate(apart):
            held = held.join(v.select("i", F.col("x").alias(f"v{k}")), "i")
        held = cut(held)
        sums = [F.sum(F.col(a) * F.col(b)) for a, b in (("y", "y"), ("x", "y"), *(p for k in range(len(apart)) for p in (("y", f"v{k}"), ("x", f"v{k}"))))]
        yy, xy, *dots = (z or 0.0 for z in held.agg(*sums).first())
        along, before = dots[::2], dots[1::2]
        norm = max(0.0, yy - sum(d * d for d in along)) ** 0.5
        if not norm:
            return 0.0, x
        value = xy - sum(d * e for d, e in zip(along, before))
        rest = F.col("y")
        for k, d in enumerate(along):
            rest = rest - F.lit(d) * F.col(f"v{k}")
        x = held.select("i", (rest / norm).alias("x"))
        if last is not None and abs(value - last) <= tolerance * max(1.0, abs(value)):
            return value, cut(x)
        last = value
    warnings.warn(f"the value still moves after {rounds} rounds", NotSettled, stacklevel=2)
    return value, cut(x)


def start_vector(ids: DataFrame) -> DataFrame:
    raw = ids.select("i", (F.pmod(F.xxhash64("i"), F.lit(1000)) / 1000.0 + 0.5).alias("x"))
    norm = raw.agg(F.sqrt(F.sum(F.col("x") ** 2))).first()[0] or 1.0
    return cut(raw.select("i", (F.col("x") / norm).alias("x")))


def smallest_of(cells: DataFrame, ids: DataFrame, k: int) -> list[tuple[float, DataFrame]]:
    """The k smallest eigenvalues of a positive matrix made symmetric, and their vectors (i, x)."""
    n = ids.count()
    if n <= SMALL:
        names = sorted(r.i for r in ids.collect())
        values, vectors = np.linalg.eigh(dense(cells, names))
        return [(float(values[j]), ids.sparkSession.createDataFrame(list(zip(names, vectors[:, j].tolist())), "i string, x double")) for j in range(min(k, n))]
    # the largest of c - L, one after another
    both = cut(symmetric(cells))
    c = 2 * (both.where("i = j").agg(F.max("value")).first()[0] or 0.0)
    shifted = cut(both.select("i", "j", -F.col("value")).toDF("i", "j", "value").unionAll(ids.select("i", F.col("i").alias("j"), F.lit(c))).groupBy("i", "j").agg(F.sum("value").alias("value")))
    found: list[DataFrame] = []
    out = []
    for _ in range(min(k, n)):
        value, x = power(shifted, start_vector(ids), found)
        found.append(x)
        out.append((c - value, x))
    return out


def smallest_laplacian(g: Graph, k: int = 6, kind: str = "comb", among=None) -> list[tuple[float, DataFrame]]:
    """The k smallest eigenvalues of the supra Laplacian and their whole vectors (i, x)."""
    return smallest_of(layers.supra_laplacian(g, kind, among), layers.supra_degree(g, among).select("i"), k)


def algebraic_connectivity(g: Graph, among=None) -> tuple[float, DataFrame]:
    pairs = smallest_laplacian(g, 2, "comb", among)
    return pairs[1] if len(pairs) > 1 else (0.0, g.spark.createDataFrame([], "i string, x double"))


def dominant_walk_pair(g: Graph, among=None) -> tuple[float, DataFrame]:
    """Top eigenpair of the symmetric part of the transition matrix."""
    cells = cut(symmetric(layers.transition(g, among)))
    return power(cells, start_vector(layers.supra_degree(g, among).select("i")))


def versatility(g: Graph, among=None, rounds: int = 60) -> DataFrame:
    """(node_id, value): absolute entries of the dominant supra eigenvector per node, over the largest."""
    cells = cut(symmetric(layers.supra_adjacency(g, layers=among)))
    _, x = power(cells, start_vector(layers.supra_degree(g, among).select("i")), rounds=rounds)
    sums = x.groupBy(F.split_part("i", F.lit(layers.KEY), F.lit(1)).alias("node_id")).agg(F.sum(F.abs("x")).alias("value"))
    top = sums.agg(F.max("value")).first()[0] or 1.0
    return sums.select("node_id", (F.col("value") / top).alias("value"))


def sweep(g: Graph, scales: list[float], metric: str | Callable[[DataFrame], float] = "algebraic_connectivity", among=None) -> list[float]:
    """A metric of the supra matrix for each scale of coupling."""
    out = []
    for s in scales:
        cells = layers.supra_adjacency(g, layers=among, coupling_scale=s)
        if callable(metric):
            out.append(metric(cells))
            continue
        from tessera.operators.matrices import laplacian

        pairs = smallest_of(laplacian(cells), layers.supra_degree(g, among).select("i"), 2)
        out.append(pairs[1][0] if len(pairs) > 1 else 0.0)
    return out
