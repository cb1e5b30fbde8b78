"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-case words (runs of letters and digits). Windows of SEED
words that both hold join texts with items: only an item's windows that the fewest items hold are asked for, as many as
leave too few others to cover enough of it. For a pair whose shared windows could cover
enough of the item, tiles are laid greedily: Karp-Rabin hashes of a search length find common
word strings that touch no tile, the longest are marked first, and the search length runs down to SEED.
Tiles never overlap in either sequence, so a passage whose sentences were reordered is still
covered. A text is contaminated by an item if tiles cover `threshold` of the item's words.

The benchmark is sent with the tasks in blocks of at most BLOCK_WORDS words; every block is one pass over the texts,
so its size is bounded and no item is left out.

Defined cases: null and empty texts and items match nothing; an item with fewer words than SEED is matched as
a whole; equal items each give a row; rows of texts come back one by one, in no order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, pieces, powers, prefix_hashes, range_hashes, ship, text_buffer

SEED = 4
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
BASE = 0xA0761D6478BD642F
INVERSE = pow(BASE, -1, 1 << 64)
FIRST_LENGTH = 32
PAIRS = 1 << 20  # window pairs looked at together
SOLID = np.zeros(256, bool)
SOLID[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of many texts, and their n+1 offsets."""
    data, offsets = text_buffer(pa.array([(t or "").lower() for t in texts], pa.string()))
    solid = SOLID[data]
    for lead, width in ((0xC2, 2), (0xE2, 3), (0xE3, 3)):  # signs, dashes and quotes beyond ASCII
        at = np.flatnonzero(data == lead)
        if width == 3:
            at = at[data[at + 1] <= (0x81 if lead == 0xE2 else 0x80)]
        for j in range(width):
            solid[at + j] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1 : len(data)]
    last[:-1] &= ~solid[1:] | edge[1 : len(data)]
    start = np.flatnonzero(first)
    return range_hashes(prefix_hashes(data), start, np.flatnonzero(last) + 1), np.searchsorted(start, offsets)


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of `width` words."""
    n = max(0, len(codes) - width + 1)
    scale = powers(BASE, width)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += codes[j : j + n] * scale[j]
    return mix64(out + np.uint64(width))


class Ranges:
    """Hashes of all ranges of a sequence, for comparing two of them without reading their words."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.append(np.uint64(0), np.cumsum(mix64(codes + np.uint64(1)) * powers(BASE, len(codes)), dtype=np.uint64))
        self.back = powers(INVERSE, len(codes) + 1)

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def runs_ahead(free: np.ndarray) -> np.ndarray:
    """Of every place the number of free ones from there on."""
    n = len(free)
    stop = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def tiles_of(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, words), longest first, of two word sequences; of equal ones the leftmost."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    in_item, in_text = Ranges(item), Ranges(text)
    tiles: list[tuple[int, int, int]] = []
    length = min(FIRST_LENGTH, len(item), len(text))
    while length >= max(1, least):
        room_item, room_text = runs_ahead(free_item), runs_ahead(free_text)
        open_item, open_text = np.flatnonzero(room_item >= length), np.flatnonzero(room_text >= length)
        held = windows(text, length)[open_text] if len(open_text) else np.zeros(0, np.uint64)
        want = windows(item, length)[open_item] if len(open_item) else held[:0]
        by = np.argsort(want, kind="stable")
        low, high = np.searchsorted(want[by], held, "left"), np.searchsorted(want[by], held, "right")
        times = high - low
        found: list[tuple[int, int, int]] = []
        edges = np.searchsorted(np.cumsum(times), np.arange(0, times.sum() + PAIRS, PAIRS), "left")
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            n = times[x : y + 1] if y + 1 >= len(times) else times[x:y]
            rows = np.repeat(np.arange(x, x + len(n)), n)
            a = open_item[by[low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)]]
            b = open_text[rows]
            # a match that goes on to the left is part of a longer one
            left = (a > 0) & (b > 0)
            left[left] = free_item[a[left] - 1] & free_text[b[left] - 1] & (item[a[left] - 1] == text[b[left] - 1])
            a, b = a[~left], b[~left]
            size, most = np.full(len(a), length), np.minimum(room_item[a], room_text[b])
            while (size < most).any():  # doubling search for the longest common range
                middle = (size + most + 1) // 2
                same = in_item.of(a, middle) == in_text.of(b, middle)
                size, most = np.where(same, middle, size), np.where(same, most, middle - 1)
            found += zip((-size).tolist(), a.tolist(), b.tolist())
        longest = -min(found)[0] if found else 0
        if longest > 2 * length:  # start again with that length: longer matches come first
            length = longest
            continue
        heapq.heapify(found)
        while found:
            n, a, b = heapq.heappop(found)
            open_ = free_item[a : a - n] & free_text[b : b - n]
            if open_.all():
                free_item[a : a - n] = free_text[b : b - n] = False
                tiles.append((a, b, -n))
                continue
            cut = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
            for x, y in zip(cut[::2].tolist(), cut[1::2].tolist()):  # what is left of it, in its turn
                if y - x >= length:
                    heapq.heappush(found, (x - y, a + x, b + x))
        length -= 1 if length <= 2 * least else max(1, length // 4)
    return tiles


PAIR = "struct<item_id:long,item_words:int,covered:int,longest:int,tiles:array<struct<item_start:int,text_start:int,words:int>>>"
PAIR_ARROW = pa.struct([("item_id", pa.int64()), ("item_words", pa.int32()), ("covered", pa.int32()), ("longest", pa.int32()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("words", pa.int32())])))])


def covered_by(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Places among n that lie in a window."""
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, starts, 1)
    np.add.at(reach, np.minimum(n, starts + width), -1)
    return np.flatnonzero(np.cumsum(reach)[:-1])


class Benchmark:
    """Word codes of a block of items, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        codes, offsets = word_codes([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        seeds, owner, place = [], [], []
        for k, w in enumerate(self.words):
            if len(w):
                held = windows(w, min(SEED, len(w)))
                seeds.append(held)
                owner.append(np.full(len(held), k))
                place.append(np.arange(len(held)))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        by = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[by]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[by]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[by]
        # of each item the windows in the fewest items, as many as no text that covers enough can miss
        name, many = np.unique(self.seeds, return_counts=True)
        often = many[np.searchsorted(name, self.seeds)] if len(name) else many
        rank = np.lexsort((self.place, often, self.owner))
        size = np.bincount(self.owner, minlength=len(items))
        within = np.empty(len(rank), np.int64)
        within[rank] = np.arange(len(rank)) - (np.cumsum(size) - size)[self.owner[rank]]
        words = np.array([len(w) for w in self.words], np.int64)
        span = np.maximum(1, np.minimum(SEED, words))
        needed = np.maximum(1, np.ceil(np.ceil(threshold * words) / span).astype(np.int64))
        asked = np.flatnonzero(within <= (size - needed)[self.owner])
        self.asked, self.asked_owner = self.seeds[asked], self.owner[asked]
        self.table = np.zeros(1 << 22, bool)
        self.table[self.asked >> np.uint64(42)] = True
        self.sorted_seeds = {}
        self.widths = sorted({min(SEED, len(w)) for w in self.words if len(w)})

    def match(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, dict]]:
        codes, offsets = word_codes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        pairs = []
        by_width = {w: windows(codes, w) for w in self.widths}
        for width, held in by_width.items():
            at = np.flatnonzero(self.table[held >> np.uint64(42)] & (owner[: len(held)] == owner[width - 1 :]) if len(held) else [])
            low, high = np.searchsorted(self.asked, held[at], "left"), np.searchsorted(self.asked, held[at], "right")
            times = high - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs.append(np.unique(owner[np.repeat(at, times)] * len(self.ids) + self.asked_owner[which]))
        for p in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
            text, k = divmod(p, len(self.ids))
            item = self.words[k]
            width = min(SEED, len(item))
            begin, end = int(offsets[text]), int(offsets[text + 1])
            held = by_width[width][begin : max(begin, end - width + 1)]
            if k not in self.sorted_seeds:
                seeds = windows(item, width)
                by = np.argsort(seeds, kind="stable")
                self.sorted_seeds[k] = seeds[by], by
            seeds, by = self.sorted_seeds[k]
            # places of the item and of the text that lie in a window of both
            of_text = np.isin(held, seeds)
            of_item = by[np.isin(seeds, held)]
            if len(covered_by(of_item, width, len(item))) < threshold * len(item):
                continue
            keep = covered_by(np.flatnonzero(of_text), width, end - begin)
            # a gap between them stays a gap
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            words = np.insert(codes[begin + keep], gap, np.uint64(0))
            where = np.insert(keep, gap, -1)
            tiles = tiles_of(item, words, width)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(item):
                yield text, {"item_id": self.ids[k], "item_words": len(item), "covered": covered, "longest": max(n for _, _, n in tiles), "tiles": [{"item_start": x, "text_start": int(where[y]), "words": n} for x, y, n in tiles]}


def blocks_of(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; only one block at a time is with the driver."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t) // 5 + 1
        if size > BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns of docs but the text and those of the result's names, and one row for each item that contaminates a row: item_id, item_words, covered, longest, tiles."""
    ship(docs.sparkSession)
    made = ("found", *(f.name for f in PAIR_ARROW))
    docs = docs.drop(*(c for c in made if c != text))
    kept = [c for c in docs.columns if c != text]
    out = None
    for items in blocks_of(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            held = Benchmark(items, threshold)
            for batch in batches:
                for part in pieces(batch, 4 << 20, text):
                    found = list(held.match(part.column(part.schema.get_field_index(text)).to_pylist(), threshold))
                    if found:
                        rows = pa.array([x for x, _ in found])
                        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).take(rows) for c in kept), pa.array([x for _, x in found], PAIR_ARROW)], names=[*kept, "found"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
        one = docs.select(*kept, text).mapInArrow(run, f"{fields}, found {PAIR}")
        out = one if out is None else out.unionAll(one)
    if out is None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
        out = docs.sparkSession.createDataFrame([], f"{fields}, found {PAIR}")
    return out.select(*kept, "found.*")
