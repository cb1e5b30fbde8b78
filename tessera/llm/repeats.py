"""Exact removal of repeated byte strings through suffix arrays of shards.

A byte goes if a string of `length` bytes over it starts earlier as well: in a smaller document, or
further left in the same one. Strings are judged on the input, as UTF-8 bytes, within documents.

1. Every string of `length` bytes has an anchor, its first substring of ANCHOR bytes of least
   hash. Strings with one anchor occurrence follow each other: they form a slice. Equal strings
   have equal anchors, so slices meet by the anchor's hash; anchors that stand alone fall away.
2. Of equal slices with equal anchors only the earliest can be new; tasks settle theirs before anything is
   shuffled, so that a slice in a third of all documents arrives once a task.
3. The earliest slices whose anchor has other slices too are fetched and dealt to shards by
   anchor. Ends of a slice whose strings' hashes occur once at their anchor can't be repeats and fall away.
   What is left in a shard forms one string, each anchor's slices in order of documents, whose suffixes are
   sorted by external induction with their common prefixes; neighbours that share `length` symbols are one
   string, and all but the first occurrence are repeats.
4. An anchor with more than HOT such slices (a passage's end in very many documents) isn't dealt as a whole:
   its slices fall apart into their strings, which meet by their own hashes, again settled by task first.
5. Repeats of steps 2 to 4 come together by document as spans, and the rest of the bytes is kept.

Equality of slices, and of the strings of step 4, is decided by two 64-bit hashes, that of strings in a shard by their bytes.
A shard may be far larger than memory: its text, queues and marks go to files of the shared folder.

Defined cases: null texts are empty; texts shorter than `length` stay whole; rows that share an identifier (or
have none: they come first) are put in order of their text and count as different documents;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Stash, pieces, prefix_hashes, range_hashes, sliding_least, small_or_plain, text_buffer, tidy
from tessera.llm.suffix_array import CHUNK, Buckets, Sequence, Store, joined, sort_suffixes

ANCHOR = 32
PLACES = 1 << 24  # of a block of windows, whatever the text's size
SHARDS = 3  # a shuffle partition: a smaller shard, a smaller worker
SEEN = 200_000  # slices a task remembers to settle copies early; the shuffle settles the rest
HOT = 256  # slices of an anchor that are dealt to one shard; those of others are dealt as strings


def slices_of(texts: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Of every slice: text's number, first string's start, number of strings, anchor's hash, slice's hash."""
    data, offsets = text_buffer(texts)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = prefix_hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    code = range_hashes(sums, at, at + ANCHOR)
    # the upper bits of the hash, then the place in its block of windows: the leftmost of equal ones is least
    width = length - ANCHOR + 1
    anchor = np.zeros(len(code) - width + 1, np.int64)
    for a in range(0, len(anchor), PLACES - width):
        part = code[a : a + PLACES - 1]
        least = sliding_least(part & np.uint64(~(PLACES - 1) & (1 << 64) - 1) | np.arange(len(part), dtype=np.uint64), width)
        anchor[a : a + len(least)] = a + (least & np.uint64(PLACES - 1)).astype(np.int64)
    # a slice ends where the anchor changes, a text begins, or its last string is over
    new = np.ones(len(anchor) + 1, bool)
    new[1:-1] = anchor[1:] != anchor[:-1]
    bounds = np.concatenate([offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])])
    new[bounds[bounds < len(anchor)]] = True
    low = np.flatnonzero(new)
    count, low = np.diff(low), low[:-1]
    owner = np.searchsorted(offsets, low, "right") - 1
    inside = low + length <= offsets[owner + 1]
    low, count, owner = low[inside], count[inside], owner[inside]
    if not len(low):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    held = anchor[low]
    whole = range_hashes(sums, low, low + count - 1 + length) + (held - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return owner, low - offsets[owner], count, code[held], whole


def earliest(h: np.ndarray, s: np.ndarray, doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, s, doc, low), and whether each of that order opens its (h, s)."""
    by = np.lexsort((low, doc, s, h))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (s[by][1:] != s[by][:-1])
    return by, new


def merged(doc: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts, with runs that touch put together."""
    by = np.lexsort((low, doc))
    doc, low, high = doc[by], low[by], (low + count)[by]
    new = np.ones(len(by), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(high, first) if len(first) else high
    return doc[first], low[first], ends - low[first]


MARK = "doc long, low int, count int, h long, s long"  # h and s null: these strings are repeats


def marks(doc, low, count, h=None, s=None) -> pa.RecordBatch:
    n = len(doc)
    codes = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (h, s)]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(low.astype(np.int32)), pa.array(count.astype(np.int32)), *codes], names=["doc", "low", "count", "h", "s"])


class Settled:
    """Settles copies that one task sees itself."""

    def __init__(self) -> None:
        self.seen: dict[tuple[int, int], tuple[int, int]] = {}

    def part(self, doc: np.ndarray, low: np.ndarray, count: np.ndarray, h: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The earliest slices so far, and the others as repeats."""
        if not len(doc):
            return
        by, new = earliest(h, s, doc, low)
        doc, low, count, h, s = doc[by], low[by], count[by], h[by], s[by]
        first = np.flatnonzero(new)
        copied = np.diff(np.append(first, len(by))) > 1
        fresh = new.copy()
        for k, hot, key in zip(first.tolist(), copied.tolist(), zip(h[first].tolist(), s[first].tolist())):
            if key in self.seen:
                fresh[k] = (int(doc[k]), int(low[k])) < self.seen[key]
            elif hot and len(self.seen) < SEEN:
                self.seen[key] = (int(doc[k]), int(low[k]))
        yield marks(doc[fresh], low[fresh], count[fresh], h[fresh], s[fresh])
        yield marks(*merged(doc[~fresh], low[~fresh], count[~fresh]))


def slice_rows(docs: DataFrame, length: int) -> DataFrame:
    """Slices of all texts; copies that a task sees itself come as repeats at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = Settled()
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                owner, low, count, h, s = slices_of(part.column(1), length)
                doc = part.column(0).to_numpy(zero_copy_only=False)[owner].astype(np.int64)
                yield from settled.part(doc, low, count, h, s)
        tidy()

    return docs.mapInArrow(run, MARK)


def settle(rows: DataFrame, partitions: int) -> DataFrame:
    """Repeats among equal slices, and the earliest slices that share their anchor with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = pa.compute.is_null(batch.column(3))
            if pa.compute.any(done).as_py():
                yield batch.filter(done)
                batch = batch.filter(pa.compute.invert(done))
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        if not held:
            return
        doc, low, count, h, s = map(np.concatenate, zip(*held))
        del held
        by, new = earliest(h, s, doc, low)
        doc, low, count, h, s = doc[by], low[by], count[by], h[by], s[by]
        yield marks(*merged(doc[~new], low[~new], count[~new]))
        doc, low, count, h, s = doc[new], low[new], count[new], h[new], s[new]
        other = np.zeros(len(h), bool)
        other[1:] = h[1:] == h[:-1]
        other[:-1] |= other[1:]
        yield marks(doc[other], low[other], count[other], h[other], s[other])

    return rows.repartition(partitions, "h", F.when(F.col("h").isNull(), F.col("doc"))).mapInArrow(run, MARK)


def string_codes(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every string of a slice: of all its bytes, and of their second half."""
    sums = prefix_hashes(np.frombuffer(raw, np.uint8))
    at = np.arange(len(raw) - length + 1)
    return range_hashes(sums, at, at + length), range_hashes(sums, at + length // 2, at + length)


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Slices (doc, low, count, h, bytes) cut from their documents; slices of hot anchors as strings (doc, low, 1, h, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, names = Settled(), ["doc", "low", "count", "h", "s", "bytes"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                whole: list[tuple] = []
                strings: list[tuple] = []
                for doc, text, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode()
                    for r in rows:
                        held = raw[r["low"] : r["low"] + r["count"] - 1 + length]
                        if r["hot"]:
                            strings.append((np.full(r["count"], doc), r["low"] + np.arange(r["count"]), np.ones(r["count"], np.int64), *string_codes(held, length)))
                        else:
                            whole.append((doc, r["low"], r["count"], r["h"], None, held))
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*whole), kinds)], names=names)
                if strings:
                    for x in settled.part(*joined(strings)):
                        yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.binary())], names=names)

    grouped = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "low", "count", "hot")).alias("rows"))
    return docs.join(grouped, "doc").select("doc", "text", "rows").mapInArrow(run, f"{MARK}, bytes binary")


class Shard:
    """Slices of a shard as one string: a separator behind each, and a last symbol of its own."""

    def __init__(self, store: Store, length: int):
        self.store, self.length = store, length
        self.text, self.at, self.doc, self.low, self.count = (Sequence(store, t) for t in (np.int16, np.int64, np.int64, np.int64, np.int64))
        self.repeated, self.least = Buckets(store), np.zeros(0, np.int64)

    def add(self, doc: np.ndarray, low: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
        """More slices; those that share a string in order of (doc, low)."""
        if not len(size):
            return
        self.at.append(len(self.text) + np.cumsum(size + 1) - size - 1)
        symbols = np.ones(len(data) + len(size), np.int16)
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.int16) + 2
        self.text.append(symbols)
        self.doc.append(doc)
        self.low.append(low)
        self.count.append(size - self.length + 1)

    def visit(self, position: np.ndarray, common: np.ndarray) -> None:
        """Of suffixes that share a string all but the first in the text are repeats."""
        position = np.append(self.least, position)
        first = np.flatnonzero(np.append(np.ones(len(self.least), bool), common < self.length))
        lowest = np.minimum.reduceat(position, first)
        self.least = lowest[-1:]
        again = position[position != np.repeat(lowest, np.diff(np.append(first, len(position))))]
        if len(again):
            block = again // CHUNK
            for k in np.unique(block).tolist():
                self.repeated.push(k, again[block == k])

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs (doc, low, count) of strings that start earlier in the shard."""
        self.text.append(np.zeros(1, np.int16))
        for x in (self.text, self.at, self.doc, self.low, self.count):
            x.done()
        sort_suffixes(self.text, 257, self.length, self.visit, self.store)
        begin, most = 0, CHUNK // self.length + 3
        for k in range(len(self.text) // CHUNK + 1):
            end = min(len(self.at), begin + most)
            at, doc, low, count = (x.slice(begin, end) for x in (self.at, self.doc, self.low, self.count))
            frames = list(self.repeated.take(k))
            if frames:
                place = np.sort(joined(frames)[0])
                which = np.searchsorted(at, place, "right") - 1
                inside = place - at[which] < count[which]  # others run over the end of a slice
                place, which = place[inside], which[inside]
                if len(place):
                    yield merged(doc[which], low[which] + place - at[which], np.ones(len(place), np.int64))
            begin += max(0, int(np.searchsorted(at, (k + 1) * CHUNK, "right")) - 1)


def shared_parts(doc: np.ndarray, low: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, low, data, size) of each slice from its first to its last string whose hash occurs again among these; slices without such a string go."""
    sums = prefix_hashes(data)
    size = np.diff(offsets) - length + 1
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) + np.repeat(offsets[:-1] - ends + size, size)
    code = range_hashes(sums, at, at + length)
    order = np.sort(code)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    k = np.minimum(np.searchsorted(twice, code), max(0, len(twice) - 1))
    again = np.flatnonzero(twice[k] == code) if len(twice) else np.zeros(0, np.int64)
    owner = np.searchsorted(ends, again, "right")
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    owner, begin, last = owner[first], at[again[first]], at[again[np.append(first[1:], len(again)) - 1]] if len(first) else first
    held = last - begin + length
    within = np.arange(int(held.sum())) + np.repeat(begin - np.cumsum(held) + held, held)
    return doc[owner], low[owner] + begin - offsets[owner], data[within], held


def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by h, cut anew so that none ends within an anchor's slices."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        end = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
        if end or rest and rest[-1].column(0)[-1].as_py() != h[0]:
            yield pa.Table.from_batches([*rest, batch.slice(0, end)]).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(end))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def sort_shards(slices: DataFrame, partitions: int, length: int, root: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        shard = Shard(store, length)
        try:
            for batch in by_anchor(batches):
                data, offsets = text_buffer(batch.column(3))
                shard.add(*shared_parts(batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), data, offsets, length))
            if len(shard.text):
                for found in shard.repeats():
                    yield marks(*found)
        finally:
            store.close()
        tidy()

    return slices.repartition(partitions, "h").sortWithinPartitions("h", "doc", "low").select("h", "doc", "low", "bytes").mapInArrow(run, MARK)


def remove(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array of [start, end)) of every row, and the columns to carry along."""
    spark = docs.sparkSession
    stash = Stash(spark, "repeats")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.lit(1).alias("one"), *carry).alias("carried"))
    ids = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").limit(1).count()
    docs = docs.withColumn("id", F.col("doc"))
    if ids:
        ordered = docs.orderBy(F.col("doc").asc_nulls_first(), "text").withColumn("doc", F.monotonically_increasing_id())
        docs = stash.keep(ordered, "ordered")
    settled = stash.keep(settle(slice_rows(docs.select("doc", "text"), length), n), "settled")
    wanted = settled.where("h is not null")
    hot = stash.keep(wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot")), "hot")
    anchors = hot.count()
    wanted = wanted.join(small_or_plain(hot, anchors), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    fetched = fetch(docs.select("doc", "text"), wanted, length)
    if anchors:
        fetched = stash.keep(fetched, "fetched")
    again = sort_shards(fetched.where("bytes is not null"), SHARDS * n, length, f"{stash.root}/sorts").select("doc", "low", "count")
    if anchors:
        strings = fetched.where("bytes is null").drop("bytes")
        again = again.unionAll(settle(strings, n).where("h is null").select("doc", "low", "count"))
    again = stash.keep(again, "again")
    found = settled.where("h is null").select("doc", "low", "count").unionAll(again)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("low", "count")).alias("rows"))
    both = docs.join(spans, "doc", "left").select("id", "text", "rows", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        for batch in batches:
            for part in pieces(batch):
                out = []
                for i, held, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw, at, kept, cuts = held.encode(), 0, [], []
                    for a, b in sorted((r["low"], r["low"] + r["count"] - 1 + length) for r in rows or ()):
                        if cuts and a <= cuts[-1]["end"]:
                            cuts[-1]["end"] = max(b, cuts[-1]["end"])
                        else:
                            cuts.append({"start": a, "end": b})
                    for c in cuts:
                        kept.append(raw[at : c["start"]])
                        at = c["end"]
                    out.append((i, len(raw), b"".join([*kept, raw[at:]]), cuts))
                if out:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*out), kinds)), part.column(3)], names=["id", "n_bytes", "kept", "spans", "carried"])

    schema = T.StructType.fromDDL("id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>").add(both.schema["carried"])
    done = both.mapInArrow(run, schema)
    return done.select(F.col("id").alias(doc_id), "n_bytes", "kept", "spans", *(F.col("carried")[c].alias(c) for c in carry))
