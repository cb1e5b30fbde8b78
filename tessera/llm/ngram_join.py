"""Exact n-gram Jaccard join by vertical partitioning.

The global order of n-grams runs from rare to frequent: by the logarithm of a counter that the
n-gram shares with few others (a table of fixed size, summed over all documents), then by hash.

1. Documents with equal sets form classes (128-bit set hashes).
2. Two sets of Jaccard similarity t share an n-gram within the first n - ceil(t n) + 1 of each, in
   global order. Only those are dealt out by n-gram; an n-gram of one document falls away.
3. In each n-gram's group every document is paired with one hub, the one whose n-gram stands
   first, if the places left after their first common n-gram can hold enough overlap.
4. The global order is cut into fragments of equal weight. Overlaps of pairs are counted in each
   fragment separately and summed per pair; linked pairs join components.
5. What step 3 left out are pairs across components. They are listed by a join of documents
   outside their hub's component with their group, under the same bounds, and verified alike.

6. Links end within components, so there every pair of different sets is verified, by blocks of
   BLOCK_SETS sets against each other, and each set's links are counted.

No group of an n-gram is listed pair by pair, none is capped, and no link is lost.

Defined cases: null or empty texts and texts without words have an empty set and link with nothing; texts with
fewer words than the n-gram have one n-gram, the whole; copies share a class; rows without an
identifier can't be named in a link and get component null; repeated identifiers count as one
document with the links of all its rows, and each row returns its own set size. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, Stash, components, mix64, pieces, powers, prefix_hashes, range_hashes, small_or_plain, text_buffer, tidy, words_of

SKETCH_BITS = 24  # counters of the global order: 16 million, whatever the input
COUNTED = 2 << 20  # n-grams that a task holds before it counts them
BLOCKS = 64
FRAGMENTS = 4
BLOCK_SETS = 256
MANY = 200  # copies of a class that are joined by its hash whatever the size of a partition
SHINGLE_BASE = 0xD1342543DE82EF95


def gram_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, flat, and their n+1 offsets."""
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    start, end, words = words_of(data, offsets)
    code = range_hashes(prefix_hashes(data), start, end)
    count = np.diff(words)
    scale = powers(SHINGLE_BASE, width)
    full = np.zeros(max(0, len(code) - width + 1), np.uint64)
    for j in range(width):
        full += code[j : len(code) - width + 1 + j] * scale[j]
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    ends = np.cumsum(grams)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    which = np.repeat(np.arange(len(count)), grams)
    at = np.repeat(words[:-1], grams) + np.arange(len(out)) - np.repeat(ends - grams, grams)
    long = count[which] >= width
    out[long] = mix64(full[at[long]])
    for size in range(1, width):
        rows = np.flatnonzero(count == size)
        held = sum((code[words[rows] + j] * scale[j] for j in range(size)), np.zeros(len(rows), np.uint64))
        out[ends[rows] - 1] = mix64(held ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
    offsets = np.append(0, ends)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (which[1:] != which[:-1])
    return out[new], np.append(0, np.cumsum(new))[offsets]


def sums_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return total[offsets[1:]] - total[offsets[:-1]]


def scan_sets(docs: DataFrame, width: int) -> DataFrame:
    """One row a document (doc, n, s1, s2) and, for each task, the rows of its counters (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.uint16)  # a task's own counts end at 65535: order alone depends on them
        waiting: list[np.ndarray] = []

        def count() -> None:
            slots, times = np.unique(np.concatenate(waiting), return_counts=True)
            counters[slots] = np.minimum(counters[slots] + times, 65535)
            waiting.clear()

        names = ["doc", "n", "s1", "s2", "block", "counts"]
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                grams, offsets = gram_sets(part.column(1), width)
                waiting.append((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                if sum(map(len, waiting)) > COUNTED:
                    count()
                rows = [part.column(0), np.diff(offsets), sums_of(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), offsets).view(np.int64), sums_of(mix64(grams + np.uint64(0x14057B7EF767814F)), offsets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(rows, kinds)), *(pa.nulls(part.num_rows, k) for k in kinds[4:])], names=names)
        if waiting:
            count()
        for k, held in enumerate(counters.reshape(BLOCKS, -1)):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds[:4]), pa.array([k], kinds[4]), pa.array([zlib.compress(held.tobytes(), 1)], kinds[5])], names=names)
        del counters
        tidy()

    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # counters a task: few tasks, little traffic
    return docs.coalesce(tasks).mapInArrow(run, "doc long, n long, s1 long, s2 long, block int, counts binary")


def global_order(scanned: DataFrame) -> np.ndarray:
    """Logarithmic rank of every counter (uint8) and, behind, the weight of each rank: a few MB, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(raw), np.uint16)
                held[k] = held[k] + counts if k in held else counts.astype(np.int64)
        for k, counts in held.items():
            rank = np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)
            weight = np.bincount(rank, weights=counts, minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rank.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], names=["block", "rank", "weight"])

    rows = scanned.where("block is not null").select("block", "counts").repartition("block").mapInArrow(run, "block int, rank binary, weight binary").collect()
    rank = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.uint8)
    weight = np.zeros(256)
    for r in rows:
        rank[r.block] = np.frombuffer(r.rank, np.uint8)
        weight += np.frombuffer(r.weight)
    return rank.reshape(-1), weight


def prefix_rows(docs: DataFrame, width: int, share: int, rank: np.ndarray) -> DataFrame:
    """(key, doc, n, pos): the first n-grams of each set in global order; copies within a task come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                grams, offsets = gram_sets(part.column(1), width)
                key = rank[grams >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)
                marks = zip(sums_of(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), offsets).tolist(), sums_of(mix64(grams + np.uint64(0x14057B7EF767814F)), offsets).tolist())
                keys, owners = [], []
                for k, (a, b, doc, mark) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(0).to_pylist(), marks)):
                    if a == b or doc is None or mark in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add(mark)
                    p = b - a - (share * (b - a) + 99) // 100 + 1
                    held = key[a:b]
                    if p < b - a:
                        held = np.partition(held, p - 1)[:p]
                    keys.append(np.sort(held))
                    owners.append(k)
                if not keys:
                    continue
                size = np.array([len(x) for x in keys])
                owner = np.repeat(owners, size)
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                rows = [np.concatenate(keys).view(np.int64), part.column(0).to_numpy(zero_copy_only=False)[owner].astype(np.int64), np.diff(offsets)[owner].astype(np.int32), pos.astype(np.int32)]
                for at in range(0, len(owner), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in rows], names=["key", "doc", "n", "pos"])
        tidy()

    return docs.mapInArrow(run, "key long, doc long, n int, pos int")


def fragment_rows(docs: DataFrame, width: int, rank: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(doc, fragment, grams): each set cut at the pivots of the global order."""
    share = weight / max(1.0, weight.sum())
    below = np.cumsum(share) - share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                grams, offsets = gram_sets(part.column(1), width)
                q = rank[grams >> np.uint64(64 - SKETCH_BITS)]
                place = np.minimum(FRAGMENTS - 1, FRAGMENTS * (below[q] + share[q] * (grams.astype(np.float64) / 2.0**64))).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows) * FRAGMENTS, np.diff(offsets)) + place
                by = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[by], np.arange(part.num_rows * FRAGMENTS + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(grams[by].view(np.int64)))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, FRAGMENTS).astype(np.int64)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), part.num_rows)), lists], names=["doc", "fragment", "grams"])
        tidy()

    return docs.where("doc is not null").mapInArrow(run, "doc long, fragment int, grams array<long>").where(F.size("grams") > 0)


def enough(a: str, b: str, share: int):
    """Whether `a` common n-grams suffice for sets of together `b`: 100 i >= share (b - i)."""
    return F.expr(f"{100 + share} * ({a}) >= {share} * ({b})")


def verified(pairs: DataFrame, parts: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose overlaps, counted by fragment and summed, reach the similarity."""
    # hubs first: their rows are few bytes a pair, then each document meets its own parts
    cut = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))).alias("p")
    hub = cut.join(parts.alias("y"), F.expr("p.b = y.doc and p.fragment = y.fragment")).selectExpr("p.a", "p.b", "p.na", "p.nb", "p.fragment", "y.grams as right").alias("h")
    both = hub.join(parts.alias("x"), F.expr("h.a = x.doc and h.fragment = x.fragment"))
    counted = both.select("h.a", "h.b", "h.na", "h.nb", F.size(F.array_intersect("x.grams", "h.right")).alias("part"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return summed.where(enough("overlap", "na + nb", share))


def linked(doc: np.ndarray, values: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents among `left` and, of each, the number of other documents among `right` that it links with; left and right: rows in order of doc."""
    size = np.diff(offsets)
    take = lambda rows: np.repeat(offsets[rows], size[rows]) + np.arange(size[rows].sum()) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
    grams, owner = values[take(right)], np.repeat(np.arange(len(right)), size[right])
    by = np.argsort(grams, kind="stable")
    grams, owner = grams[by], owner[by]
    names, first = np.unique(doc[right], return_index=True)
    lefts, number = np.unique(doc[left], return_inverse=True)
    hit = np.zeros((len(lefts), len(names)), bool)
    for k, row in zip(number, left):
        own = values[offsets[row] : offsets[row + 1]]
        low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        count = high - low
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        overlap = np.bincount(owner[at], minlength=len(right))
        near = (100 + share) * overlap >= share * (size[row] + size[right])
        hit[k] |= np.logical_or.reduceat(near, first)
    hit &= lefts[:, None] != names[None, :]
    return lefts, hit.sum(axis=1)


def link_counts(docs: DataFrame, named: DataFrame, copies: DataFrame, found: DataFrame, width: int, share: int) -> DataFrame:
    """(head, n_links): of every class in a component the other classes that it links with."""
    # one set a class; a repeated identifier brings the sets of all its rows
    again = named.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", F.lit(True).alias("again"))
    nodes = found.unionAll(found.select("component", "component")).distinct()  # a component's least node has no row
    sets = nodes.withColumnRenamed("node", "doc").join(copies, "doc", "left").join(again, "doc", "left").where("head is null or head = doc or again")
    sets = sets.select("doc", F.coalesce("head", "doc").alias("head"), "component")
    size = sets.groupBy("component").agg(F.expr(f"cast(ceil(count(distinct head) / {BLOCK_SETS}) as int)").alias("blocks"))
    sets = sets.join(size, "component").withColumn("block", F.expr("cast(pmod(xxhash64(head), blocks) as int)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                grams, offsets = gram_sets(part.column(1), width)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], lists], names=["head", "component", "blocks", "block", "grams"])
        tidy()

    rows = docs.join(sets, "doc").select("doc", "text", "head", "component", "blocks", "block").mapInArrow(run, "head long, component long, blocks int, block int, grams array<long>").where(F.size("grams") > 0)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "head", "grams")

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("head")
        lists = table["grams"].combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        doc, block = table["head"].to_numpy(), table["block"].to_numpy()
        values, offsets = lists.flatten().to_numpy(), offsets - offsets[0]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        parts = []
        if len(left) and len(right):
            parts.append(linked(doc, values, offsets, left, right, share))
            if i != j:
                parts.append(linked(doc, values, offsets, right, left, share))
        return pa.table({"head": pa.array(np.concatenate([x for x, _ in parts] or [np.zeros(0, np.int64)]), pa.int64()), "n": pa.array(np.concatenate([x for _, x in parts] or [np.zeros(0, np.int64)]), pa.int64())})

    return met.groupBy("component", "i", "j").applyInArrow(count, "head long, n long").groupBy("head").agg(F.sum("n").alias("n_links"))


def join(docs: DataFrame, width: int = 5, share: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links: other classes whose sets reach the similarity
    with the row's own."""
    spark = docs.sparkSession
    stash = Stash(spark, "ngram")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    scanned = stash.keep(scan_sets(docs, width), "scanned")
    rank, weight = global_order(scanned)
    rows = scanned.where("block is null").select("doc", "n", "s1", "s2")
    named = rows.where("n > 0 and doc is not null")
    classes = named.groupBy("s1", "s2", "n").agg(F.min("doc").alias("head"), F.count("*").alias("copies")).where("copies > 1")
    classes = stash.keep(classes, "classes")
    # a class of a third of all rows isn't read by one task: classes above a share of a partition are sent to the rows, ten a partition at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share_of = max(MANY, named.count() // (10 * parts))
    key = ["s1", "s2", "n"]
    marked = named.join(F.broadcast(classes.where(F.col("copies") > share_of).select(*key, F.col("head").alias("hot"))), key, "left")
    plain = marked.where("hot is null").join(classes.where(F.col("copies") <= share_of), key).select("doc", "head")
    copies = stash.keep(marked.where("hot is not null").select("doc", F.col("hot").alias("head")).unionAll(plain).distinct(), "copies")

    def headed(pairs: DataFrame) -> DataFrame:
        """Pairs between the first documents of their classes; members of one class need none."""
        for side in ("a", "b"):
            pairs = pairs.join(copies.select(F.col("doc").alias(side), F.col("head").alias(f"head_{side}")), side, "left")
        return pairs.select(F.coalesce("head_a", "a").alias("a"), F.coalesce("head_b", "b").alias("b"), "na", "nb").where("a <> b").distinct()

    window = Window.partitionBy("key").orderBy("pos", "doc")
    index = prefix_rows(docs, width, share, rank).select("*", F.first(F.struct("doc", "n", "pos")).over(window).alias("hub"), F.lead("doc").over(window).alias("next"), F.row_number().over(window).alias("row"))
    # beside its hub; `third`: the group has more than the two
    index = index.where("row > 1").select("key", "doc", "n", "pos", F.expr("row > 2 or next is not null").alias("third"), F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    index = stash.keep(index, "index")
    stars = index.where("doc <> hub").where(enough("least(n - pos, hub_n - hub_pos)", "n + hub_n", share))
    stars = stash.keep(headed(stars.select(F.col("doc").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("hub_n").alias("nb")).distinct()), "stars")

    def parts_of(pairs: DataFrame, name: str) -> DataFrame:
        wanted = stash.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), f"{name}-docs")
        few = small_or_plain(wanted, wanted.count())
        return stash.keep(fragment_rows(docs.join(few, "doc", "left_semi").select("doc", "text"), width, rank, weight), f"{name}-parts")

    links = stash.keep(verified(stars, parts_of(stars, "stars"), share).select("a", "b"), "links")
    # a repeated identifier binds the classes of its rows
    same = copies.withColumnRenamed("head", "b").withColumnRenamed("doc", "a").where("a <> b")
    found = components(stash, links.unionAll(same), "first")

    few = small_or_plain(found, found.count())
    tagged = index.where("third").join(few.select(F.col("node").alias("doc"), "component"), "doc", "left").join(few.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    tagged = stash.keep(tagged.select("key", "doc", "n", "pos", "hub", F.coalesce("component", "doc").alias("component"), F.coalesce("hub_component", "hub").alias("hub_component")).where("doc <> hub"), "tagged")
    outside = tagged.where("component <> hub_component").alias("o")
    across = outside.join(tagged.alias("m"), F.expr("o.key = m.key and o.component <> m.component and (m.component = m.hub_component or o.doc < m.doc)") & enough("least(o.n - o.pos, m.n - m.pos)", "o.n + m.n", share))
    across = stash.keep(headed(across.select(F.col("o.doc").alias("a"), F.col("m.doc").alias("b"), F.col("o.n").alias("na"), F.col("m.n").alias("nb")).distinct()), "across")
    if across.limit(1).count():
        more = verified(across, parts_of(across, "across"), share).select("a", "b")
        links = stash.keep(links.unionAll(more), "all-links")
        found = components(stash, links.unionAll(same), "second")
    degree = stash.keep(link_counts(docs, named, copies, found, width, share), "degree")
    labels = rows.join(copies, "doc", "left").withColumn("head", F.coalesce("head", "doc"))
    labels = labels.join(found.withColumnRenamed("node", "doc"), "doc", "left").join(degree, "head", "left")
    return labels.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "head").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
