"""Suffixes in order, with common prefixes, by external induced sorting.

Every suffix is a tuple: its position, the symbols in front of it, and the length of its common
prefix with the tuple before it. Left-to-right induction takes tuples from a priority queue in
order of their first symbol and pushes the suffix in front of each that is L-type; right-to-left
induction does the same for S-type ones. A tuple carries the symbols it needs, so the text is read
only where a monotone run is longer than that. The common prefix of two suffixes that are pushed one after
another is one more than the least common prefix between their sources; since it counts no further than `depth`,
the least value since any earlier tuple follows from `depth` + 1 numbers.

1. The text is scanned from its end. Leftmost S-type positions are seeds, in order of their symbol
   and of the length of its run (a longer run comes first).
2. Induction from the seeds sorts the substrings between them (run included), and equal ones get
   one name. Names in order of position form the reduced string.
3. The reduced string is sorted by doubling if it is at most `base_case` long, else by recursion.
   Common prefixes in names become common prefixes in symbols.
4. Induction from the seeds in that order gives all suffixes, from the greatest down.

Queues, stacks and sequences hold what they may in memory and go to files of the shared folder beyond it. Queues
are cut into ranges of symbols: a range of several symbols fits in memory and is parted when its
turn comes; a symbol too frequent for that has a range of its own, read piece by piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np

from tessera.llm.common import open_store

MEMORY = 64 << 20  # bytes that the queues of a sort hold before they go to files
BASE_CASE = 1 << 20  # names that are sorted in memory
CHUNK = 1 << 18  # symbols of a scan, and tuples of a block
PAGE = 2048  # symbols of a lookup
COUNT = np.uint64(56)  # place of the number of symbols that a tuple carries
BITS = 56
LOW = np.uint64((1 << BITS) - 1)


class Store:
    """Files of one task in a folder that is shared; none is made before something needs it."""

    def __init__(self, root: str | None, memory: int = MEMORY):
        self.root, self.memory = root, memory
        self.files: dict[str, object] = {}
        self.system = self.folder = None

    def create(self):
        if self.system is None:
            if self.root is None:
                raise MemoryError("a sort beyond its memory needs a shared folder")
            self.system, root = open_store(self.root)
            self.folder = f"{root}/sort-{uuid.uuid4().hex}"
            self.system.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{len(self.files)}-{uuid.uuid4().hex[:8]}"
        return path, self.system.open_output_stream(path, compression=None)

    def read(self, path: str, offset: int, kind: np.dtype, n: int) -> np.ndarray:
        if path not in self.files:
            self.files[path] = self.system.open_input_file(path)
        return np.frombuffer(self.files[path].read_at(n * kind.itemsize, offset), kind)

    def remove(self, path: str) -> None:
        if path in self.files:
            self.files.pop(path).close()
        self.system.delete_file(path)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files = {}
        if self.system is not None:
            self.system.delete_dir(self.folder)
            self.system = None


class Buckets:
    """Frames (tuples of arrays of one length) by bucket, in order of arrival; they go to files beyond the memory."""

    def __init__(self, store: Store, share: int = 6):
        self.store, self.memory, self.held = store, store.memory // share, 0
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.filed: dict[int, list[tuple]] = {}
        self.paths: list[str] = []

    def push(self, bucket: int, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.setdefault(bucket, []).append(columns)
            self.held += sum(x.nbytes for x in columns)
            if self.held > self.memory:
                self.spill()

    def spill(self) -> None:
        path, out = self.store.create()
        at = 0
        with out:
            for bucket, frames in self.parts.items():
                columns = joined(frames)
                self.filed.setdefault(bucket, []).append((path, at, len(columns[0]), [x.dtype for x in columns]))
                for x in columns:
                    out.write(np.ascontiguousarray(x).data)
                    at += x.nbytes
        self.paths.append(path)
        self.parts, self.held = {}, 0

    def __contains__(self, bucket: int) -> bool:
        return bucket in self.parts or bucket in self.filed

    def take(self, bucket: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """All frames of a bucket, which is empty from now on."""
        filed, frames = self.filed.pop(bucket, []), self.parts.pop(bucket, [])
        self.held -= sum(x.nbytes for f in frames for x in f)
        return self.frames(filed, frames, backwards)

    def frames(self, filed: list, frames: list, backwards: bool) -> Iterator[tuple[np.ndarray, ...]]:
        def read(where):
            path, at, n, kinds = where
            cut = range(0, n, CHUNK)
            for a in reversed(cut) if backwards else cut:
                m, base, out = min(CHUNK, n - a), at, []
                for kind in kinds:
                    out.append(self.store.read(path, base + a * kind.itemsize, kind, m))
                    base += n * kind.itemsize
                yield tuple(out)

        def merged():
            waiting, size = [], 0
            for f in reversed(frames) if backwards else frames:
                waiting.append(f)
                size += len(f[0])
                if size >= CHUNK:
                    yield joined(waiting[::-1] if backwards else waiting)
                    waiting, size = [], 0
            if waiting:
                yield joined(waiting[::-1] if backwards else waiting)

        if backwards:
            yield from merged()
        for where in reversed(filed) if backwards else filed:
            yield from read(where)
        if not backwards:
            yield from merged()

    def close(self) -> None:
        self.parts, self.filed, self.held = {}, {}, 0
        for path in self.paths:
            self.store.remove(path)
        self.paths = []


def joined(frames: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return frames[0] if len(frames) == 1 else tuple(np.concatenate(x) for x in zip(*frames))


class Sequence:
    """Numbers in order: an array while they are few, else a file of which pages are read."""

    def __init__(self, store: Store, kind):
        self.store, self.kind, self.size = store, np.dtype(kind), 0
        self.parts: list[np.ndarray] = []
        self.held, self.path, self.out, self.array = 0, None, None, None

    def append(self, values: np.ndarray) -> None:
        values = values.astype(self.kind, copy=False)
        self.parts.append(values)
        self.size += len(values)
        self.held += values.nbytes
        if self.held > self.store.memory // 4:
            if self.out is None:
                self.path, self.out = self.store.create()
            for x in self.parts:
                self.out.write(np.ascontiguousarray(x).data)
            self.parts, self.held = [], 0

    def done(self) -> Sequence:
        if self.out is None:
            self.array = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        else:
            for x in self.parts:
                self.out.write(np.ascontiguousarray(x).data)
            self.out.close()
        self.parts = []
        return self

    def __len__(self) -> int:
        return self.size

    def slice(self, a: int, b: int) -> np.ndarray:
        a, b = max(0, a), min(b, self.size)
        if b <= a:
            return np.zeros(0, self.kind)
        return self.array[a:b] if self.array is not None else self.store.read(self.path, a * self.kind.itemsize, self.kind, b - a)

    def take(self, index: np.ndarray) -> np.ndarray:
        if self.array is not None:
            return self.array[index]
        by = np.argsort(index, kind="stable")
        asked, out = index[by], np.empty(len(index), self.kind)
        page = asked // PAGE
        cut = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(index) else []
        for a, b in zip(cut, [*cut[1:], len(index)]):
            base = int(page[a]) * PAGE
            out[by[a:b]] = self.slice(base, base + PAGE)[asked[a:b] - base]
        return out

    def close(self) -> None:
        self.array = None
        if self.path:
            self.store.remove(self.path)
            self.path = None


def least(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the ranges [a, b] (not empty) of a table of minima."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << k) + 1])
    return out


def minima(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Minima of all ranges whose length is a power of two, up to the longest asked for."""
    table = [values]
    while 2 << (len(table) - 1) <= longest:
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    return table


class History:
    """Common prefixes of the tuples taken so far, as far as the future needs them."""

    def __init__(self, depth: int):
        self.depth, self.at = depth, 0
        self.latest = np.full(depth + 1, -1, np.int64)  # of each length the last tuple with no longer a common prefix

    def since(self, index: np.ndarray) -> np.ndarray:
        """Least common prefix of all tuples after each index; more than depth without one."""
        return np.searchsorted(self.latest, index, "right")

    def add(self, common: np.ndarray) -> None:
        last = np.full(self.depth + 1, -1, np.int64)
        last[common] = self.at + np.arange(len(common))
        self.latest = np.maximum(self.latest, np.maximum.accumulate(last))
        self.at += len(common)


class Queue:
    """Priority queue of tuples by first symbol; of one symbol, first in first out.

    Tuples (symbol, position, symbols in front, substring length) come with the least common
    prefix since the tuple that their range got before them, and leave with that of their symbol.
    """

    def __init__(self, store: Store, edges: np.ndarray, singles: np.ndarray, history: History):
        self.edges, self.singles, self.history = edges, singles, history  # first symbol of each range, whether it has no other
        self.waiting = Buckets(store)
        self.last = np.full(len(edges), -1, np.int64)
        self.now, self.low = -1, 0

    def push(self, common: np.ndarray, which: np.ndarray, symbol: np.ndarray, position: np.ndarray, front: np.ndarray, size: np.ndarray) -> None:
        """Tuples induced by the tuples `which` of a block with these common prefixes; the block is history afterwards."""
        if len(which):
            one = len(self.edges) == 1
            home = np.zeros(len(which), np.int64) if one else np.searchsorted(self.edges, symbol, "right") - 1
            table = None
            for here in (True, False):
                if here and (self.now < 0 or self.singles[self.now]) or not here and one and self.now >= 0 and not self.singles[0]:
                    continue
                pick = np.arange(len(which)) if one or self.now < 0 or self.singles[self.now] else np.flatnonzero((home == self.now) == here)
                if not len(pick):
                    continue
                slot = symbol[pick] - self.low if here else home[pick]
                by = np.argsort(slot.astype(np.int16), kind="stable") if len(slot) and slot.max() < 1 << 15 else np.argsort(slot, kind="stable")
                pick, slot = pick[by], slot[by]
                source = which[pick]
                first = np.append(True, slot[1:] != slot[:-1])
                inner = np.flatnonzero(~first)
                raw = np.empty(len(pick), np.int64)
                if len(inner):
                    a, b = source[inner - 1] + 1, source[inner]
                    longest = int((b - a).max()) + 1
                    if table is None or 2 << (len(table) - 1) <= longest:
                        table = minima(common, longest)
                    raw[inner] = least(table, a, b)
                cut = np.flatnonzero(first)
                before = (self.own if here else self.last)[slot[cut]]
                lead = np.minimum.accumulate(common[: source[cut].max() + 1])[source[cut]]
                carried = np.minimum(self.history.since(before), lead)
                if here:
                    carried = np.minimum(carried, self.floor[slot[cut]])
                raw[cut] = np.where(before < 0, -1, carried)
                raw = np.minimum(raw + 1, self.history.depth).astype(np.uint8)
                end = np.append(cut[1:], len(pick))
                (self.own if here else self.last)[slot[cut]] = self.history.at + source[end - 1]
                columns = (symbol[pick], position[pick], front[pick], size[pick], raw)
                if here:
                    self.floor[slot[cut]] = 255
                    for s, a, b in zip(slot[cut].tolist(), cut.tolist(), end.tolist()):
                        self.parts.setdefault(s + self.low, []).append(tuple(x[a:b] for x in columns))
                else:
                    for s, a, b in zip(slot[cut].tolist(), cut.tolist(), end.tolist()):
                        self.waiting.push(s, *(x[a:b] for x in columns))
        self.history.add(common)

    def open(self, k: int, low: int, high: int) -> None:
        """Make a range of symbols the current one; the tuples of several symbols are parted."""
        self.now, self.low = k, low
        if self.singles[k]:
            return
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.own = np.full(high - low, -1, np.int64)
        self.floor = np.full(high - low, 255, np.uint8)
        frames = list(self.waiting.take(k))
        if not frames:
            return
        symbol, position, front, size, common = joined(frames)
        by = np.argsort(symbol, kind="stable")
        cut = np.flatnonzero(np.append(True, symbol[by][1:] != symbol[by][:-1]))
        end = np.append(cut[1:], len(by))
        # common counts one more than the least since the tuple before, in this range
        table = minima(common, len(by))
        own = np.zeros(len(by), np.uint8)
        inner = np.ones(len(by), bool)
        inner[cut] = False
        inner = np.flatnonzero(inner)
        own[inner] = least(table, by[inner - 1] + 1, by[inner])
        final = by[end - 1]  # of each symbol its last tuple, and what came after it
        slots = symbol[by[cut]] - low
        later = np.flatnonzero(final < len(by) - 1)
        self.floor[slots[later]] = least(table, final[later] + 1, np.full(len(later), len(by) - 1)) - 1
        self.own[slots] = self.last[k]
        columns = tuple(x[by] for x in (symbol, position, front, size)) + (own,)
        for s, a, b in zip(slots.tolist(), cut.tolist(), end.tolist()):
            self.parts[s + low] = [tuple(x[a:b] for x in columns)]

    def holds(self, symbol: int) -> bool:
        return self.now in self.waiting if self.singles[self.now] else symbol in self.parts

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, ...]]:
        if self.singles[self.now]:
            yield from self.waiting.take(self.now)
            return
        frames = self.parts.pop(symbol, [])
        while frames:
            n = k = 0
            while k < len(frames) and n < CHUNK:
                n += len(frames[k][0])
                k += 1
            yield joined(frames[:k])
            frames = frames[k:]

    def close(self) -> None:
        self.waiting.close()
        self.parts = {}


class Front:
    """Symbols in front of positions, as many as a tuple carries: the nearest in the lowest bits, their number on top."""

    def __init__(self, text: Sequence, greatest: int):
        self.text, self.width = text, max(1, int(greatest).bit_length())
        self.most = BITS // self.width
        self.shift, self.mask = np.uint64(self.width), np.uint64((1 << self.width) - 1)

    def of(self, position: np.ndarray) -> np.ndarray:
        out = np.zeros(len(position), np.uint64)
        for j in range(self.most, 0, -1):
            out <<= self.shift
            at = position - j
            inside = np.flatnonzero(at >= 0)
            out[inside] |= self.text.take(at[inside]).astype(np.uint64)
        return out | np.minimum(position, self.most).astype(np.uint64) << COUNT

    def in_chunk(self, symbols: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
        """The same for places `at` of an array that begins with up to `most` symbols before them."""
        out = np.zeros(len(at), np.uint64)
        for j in range(self.most, 0, -1):
            out <<= self.shift
            inside = np.flatnonzero(at - j >= 0)
            out[inside] |= symbols[at[inside] - j].astype(np.uint64)
        return out | np.minimum(at + base, self.most).astype(np.uint64) << COUNT

    def filled(self, position: np.ndarray, front: np.ndarray) -> np.ndarray:
        empty = np.flatnonzero((front >> COUNT == 0) & (position > 0))
        if len(empty):
            front = front.copy()
            front[empty] = self.of(position[empty])
        return front

    def step(self, front: np.ndarray) -> np.ndarray:
        return (front & LOW) >> self.shift | ((front >> COUNT) - np.uint64(1)) << COUNT


def scan_seeds(text: Sequence, front: Front, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(symbol, position, front, run) of all leftmost S-type positions, chunk by chunk from the end; the last symbol is one."""
    n, right = len(text), len(text)
    after, after_s, after_run = -1, True, 0  # symbol right of the chunk, its type and its run
    while right > 0:
        left = max(0, right - CHUNK)
        lead = min(left, max(1, front.most))
        held = text.slice(left - lead, right).astype(np.int64)
        own = held[lead:]
        size = len(own)
        following = np.append(own[1:], after)
        at = np.where(own != following, np.arange(size), size)
        at = np.minimum.accumulate(at[::-1])[::-1]  # next place that differs from its follower
        inner = at < size
        near = np.minimum(at, size - 1)
        is_s = np.where(inner, own[near] < following[near], after_s)
        run = np.where(inner, at - np.arange(size) + 1, size - np.arange(size) + after_run)
        if right == n:
            is_s[-1] = True
        ahead = held[lead - 1 : -1] if lead else np.append(-1, own[:-1])
        # S-type behind a greater symbol, which is L-type
        star = np.flatnonzero(is_s & (ahead > own))
        if n == 1:
            star = np.zeros(1, np.int64)
        yield own[star], left + star, front.in_chunk(held, star + lead, left - lead), np.minimum(run[star], depth).astype(np.uint8)
        after, after_s, after_run, right = int(own[0]), bool(is_s[0]), min(int(run[0]), depth), left


class Ranges:
    """Cuts symbols into ranges by how often they stand: several rare symbols share one, up to a limit."""

    def __init__(self, limit: int):
        self.limit, self.edges, self.singles, self.held = max(1, limit), [0], [True], 0
        self.several = False

    def add(self, symbol: int, count: int) -> None:
        """The next symbol in order."""
        if self.several and self.held + count > self.limit:
            self.edges.append(symbol)
            self.singles.append(True)
            self.held, self.several = 0, False
        self.singles[-1] = not self.several and count > self.limit
        self.held += count
        self.several = True

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.edges, np.int64), np.array(self.singles, bool)


def induce(text: Sequence, greatest: int, depth: int, ranges: tuple[np.ndarray, np.ndarray], front: Front, seeds, visit: Callable, store: Store) -> None:
    """Take suffixes from the greatest down: visit(position, common, starred, substring length) by blocks.

    seeds.open(range) and seeds.take(symbol, rounds) give the sorted seeds; common: with the suffix visited before.
    """
    edges, singles = ranges
    ends = np.append(edges[1:], greatest + 1)
    history = History(depth)
    queue, larger = Queue(store, edges, singles, history), Buckets(store)
    runs: dict[int, int] = {}
    try:
        for k, (low, high) in enumerate(zip(edges.tolist(), ends.tolist())):
            queue.open(k, low, high)
            seeds.open(k)
            for c in range(low, high):
                rounds = 0
                while queue.holds(c):  # suffixes that begin with a run of c come in rounds
                    rounds += 1
                    for _, position, before, size, common in queue.take(c):
                        before = front.filled(position, before)
                        larger.push(0, np.full(len(position), c), position, before, size, common)
                        ahead = (before & front.mask).astype(np.int64)
                        go = np.flatnonzero((position > 0) & (ahead >= c))
                        queue.push(common, go, ahead[go], position[go] - 1, front.step(before[go]), np.minimum(size[go], depth - 1) + np.uint8(1))
                if rounds > 1:
                    runs[c] = min(rounds, depth)
                for position, before, size, common in seeds.take(c, rounds):
                    before = front.filled(position, before)
                    go = np.flatnonzero(position > 0)
                    ahead = (before[go] & front.mask).astype(np.int64)
                    queue.push(common, go, ahead, position[go] - 1, front.step(before[go]), np.minimum(size[go], depth - 1) + np.uint8(1))
        queue.close()

        history = History(depth)
        queue = Queue(store, edges, singles, history)
        stack = Backwards(larger.take(0, backwards=True))
        for k in range(len(edges) - 1, -1, -1):
            low, high = int(edges[k]), int(ends[k])
            queue.open(k, low, high)
            for c in range(high - 1, low - 1, -1):
                rounds = 0
                while queue.holds(c):
                    rounds += 1
                    for _, position, before, size, common in queue.take(c):
                        before = front.filled(position, before)
                        ahead = (before & front.mask).astype(np.int64)
                        go = np.flatnonzero((position > 0) & (ahead <= c))
                        queue.push(common, go, ahead[go], position[go] - 1, front.step(before[go]), np.minimum(size[go], depth - 1) + np.uint8(1))
                        visit(position, common, (position > 0) & (ahead > c), size)
                # the greatest L-type and the least S-type suffix of c begin with their longest runs
                shared = min(rounds, runs.get(c, 1))
                for position, before, size, common in stack.take(c):
                    common = np.append(np.uint8(shared), common)
                    shared, common = int(common[-1]), common[:-1]
                    ahead = (before & front.mask).astype(np.int64)
                    go = np.flatnonzero((position > 0) & (ahead < c))
                    queue.push(common, go, ahead[go], position[go] - 1, front.step(before[go]), np.minimum(size[go], depth - 1) + np.uint8(1))
                    visit(position, common, np.zeros(len(position), bool), size)
        end = np.array([len(text) - 1], np.int64)
        visit(end, np.zeros(1, np.uint8), np.ones(1, bool), np.ones(1, np.uint8))
    finally:
        queue.close()
        larger.close()


class Backwards:
    """Tuples (symbol, ...) of a stack, from its top, by symbol."""

    def __init__(self, frames: Iterator[tuple[np.ndarray, ...]]):
        self.frames, self.held = frames, None

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, ...]]:
        while True:
            if self.held is None:
                frame = next(self.frames, None)
                if frame is None:
                    return
                self.held = tuple(x[::-1] for x in frame)
            n = int(np.searchsorted(-self.held[0], -symbol, "right"))
            if not n:
                return
            yield tuple(x[:n] for x in self.held[1:])
            self.held = tuple(x[n:] for x in self.held) if n < len(self.held[0]) else None
            if self.held is not None:
                return


class FirstSeeds:
    """Seeds in order of symbol and run, equal ones in order of arrival."""

    def __init__(self, store: Store, ranges: tuple[np.ndarray, np.ndarray], depth: int):
        self.edges, self.singles = ranges
        self.depth, self.waiting, self.now = depth, Buckets(store), 0

    def add(self, symbol: np.ndarray, position: np.ndarray, before: np.ndarray, run: np.ndarray) -> None:
        home = np.searchsorted(self.edges, symbol, "right") - 1
        bucket = home * (self.depth + 1) + np.where(self.singles[home], self.depth - run.astype(np.int64), 0)
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])) if len(by) else []
        for a, b in zip(cut, [*cut[1:], len(by)]):
            at = by[a:b]
            self.waiting.push(int(bucket[at[0]]), symbol[at], position[at], before[at], run[at])

    def open(self, k: int) -> None:
        self.now = k
        if self.singles[k]:
            return
        frames = list(self.waiting.take(k * (self.depth + 1)))
        self.held = joined(frames) if frames else None
        if frames:
            by = np.lexsort((-self.held[3].astype(np.int64), self.held[0]))
            self.held = tuple(x[by] for x in self.held)

    def take(self, symbol: int, rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(position, front, run, common); of two runs the shorter one is common to both."""
        shared = rounds
        for position, before, run in self.blocks(symbol):
            common = run.copy()
            common[0] = min(shared, int(run[0]))
            shared = self.depth
            yield position, before, run, common

    def blocks(self, symbol: int) -> Iterator[tuple[np.ndarray, ...]]:
        if self.singles[self.now]:
            for run in range(self.depth, -1, -1):
                for frame in self.waiting.take(self.now * (self.depth + 1) + self.depth - run):
                    yield frame[1:]
        elif self.held is not None:
            a, b = np.searchsorted(self.held[0], [symbol, symbol + 1]).tolist()
            for at in range(a, b, CHUNK):
                yield tuple(x[at : min(b, at + CHUNK)] for x in self.held[1:])


class SortedSeeds:
    """Seeds (symbol, position, front, common) whose order is known, as frames in ascending order."""

    def __init__(self, frames: Iterator[tuple[np.ndarray, ...]], text: Sequence, depth: int):
        self.frames, self.text, self.depth, self.held = frames, text, depth, None

    def open(self, k: int) -> None:
        pass

    def take(self, symbol: int, rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
        opens = True
        while True:
            if self.held is None:
                self.held = next(self.frames, None)
                if self.held is None:
                    return
            n = int(np.searchsorted(self.held[0], symbol, "right"))
            if not n:
                return
            position, before, common = (x[:n] for x in self.held[1:])
            if opens:
                common = common.copy()
                common[0] = 0
                if rounds:  # the least seed begins with its longest run, the greatest L-type suffix with `rounds`
                    ahead = self.text.slice(int(position[0]), int(position[0]) + min(rounds, self.depth))
                    differs = np.flatnonzero(ahead != symbol)
                    common[0] = differs[0] if len(differs) else len(ahead)
                opens = False
            yield position, before, np.zeros(n, np.uint8), common
            self.held = tuple(x[n:] for x in self.held) if n < len(self.held[0]) else None
            if self.held is not None:
                return


def doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string in memory by their first `depth` names, and the names each has in common with the one before."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while step < depth and rank.max() + 1 < n:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        held = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, held[1:] != held[:-1]))
        ranks.append(rank.astype(np.int32))
        step *= 2
    common = np.zeros(n, np.int64)
    i, j = order[1:].copy(), order[:-1].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(i, j) < n)
        same = inside[ranks[k][i[inside]] == ranks[k][j[inside]]]
        common[1 + same] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    return order, common


class Naming:
    """Gives names to the sorted substrings as they are visited, from the greatest down."""

    def __init__(self, store: Store, depth: int, limit: int):
        self.depth, self.count, self.stars = depth, -1, 0
        self.between, self.length = depth, 0  # since the star before: least common prefix, that star's length
        self.by_place = Buckets(store)
        self.gaps = Sequence(store, np.uint8)  # common prefix of each name with the one before, in order of visit
        self.counts: list[tuple[int, int]] = []
        self.ranges, self.open_count = Ranges(limit), 0

    def visit(self, position: np.ndarray, common: np.ndarray, starred: np.ndarray, size: np.ndarray) -> None:
        at = np.flatnonzero(starred)
        if not len(at):
            if len(common):
                self.between = min(self.between, int(common.min()))
            return
        shared = np.minimum.reduceat(common[: at[-1] + 1], np.append(0, at[:-1] + 1)).astype(np.int64)
        shared[0] = min(shared[0], self.between)
        rest = common[at[-1] + 1 :]
        self.between = int(rest.min()) if len(rest) else self.depth
        length = size[at].astype(np.int64)
        new = shared < np.minimum(self.depth, np.maximum(length, np.append(self.length, length[:-1])))
        if not self.stars:
            new[0] = True
        self.length, self.stars = int(length[-1]), self.stars + len(at)
        name = self.count + np.cumsum(new)
        self.gaps.append(shared[new].astype(np.uint8))
        cut = np.flatnonzero(new)
        ends = np.append(cut, len(at))
        self.open_count += int(ends[0])
        for a, b in zip(cut.tolist(), ends[1:].tolist()):
            if self.count >= 0:
                self.ranges.add(self.count, self.open_count)
            self.count += 1
            self.open_count = b - a
        place, block = position[at], position[at] // CHUNK
        by = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.append(True, block[by][1:] != block[by][:-1]))
        for a, b in zip(edge, [*edge[1:], len(by)]):
            self.by_place.push(int(block[by[a]]), place[by[a:b]], name[by[a:b]])

    def done(self, store: Store, blocks: int) -> tuple[Sequence, Sequence, Sequence]:
        """Positions and names in order of position, names in ascending order, and the gaps."""
        self.ranges.add(self.count, self.open_count)
        places, names = Sequence(store, np.int64), Sequence(store, np.int64)
        for k in range(blocks):
            frames = list(self.by_place.take(k))
            if frames:
                place, name = joined(frames)
                by = np.argsort(place, kind="stable")
                places.append(place[by])
                names.append(self.count - name[by])
        self.by_place.close()
        return places.done(), names.done(), self.gaps.done()


def upside_down(ranges: Ranges, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of descending numbers 0..count as ranges of ascending names."""
    edges, singles = ranges.arrays()
    last = np.append(edges[1:], count + 1) - 1
    return (count - last)[::-1], singles[::-1]


def symbols_in_common(places: Sequence, names: Sequence, table: list[np.ndarray], count: int, depth: int, small: np.ndarray, great: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common symbols of pairs of seeds that have `shared` names in common."""
    out = np.full(len(small), depth, np.int64)
    near = np.flatnonzero((2 * shared < depth) & (np.maximum(small, great) + shared < len(places)))
    if len(near):
        small, great, shared = small[near], great[near], shared[near]
        apart = places.take(small + shared) - places.take(small)
        a, b = names.take(small + shared).astype(np.int64), names.take(great + shared).astype(np.int64)
        differs = a != b
        low, high = np.minimum(a, b), np.maximum(a, b)
        rest = np.full(len(near), depth, np.int64)
        rest[differs] = least(table, count - high[differs] + 1, count - low[differs])
        out[near] = np.minimum(depth, apart + rest)
    return out


def sort_suffixes(text: Sequence, greatest: int, depth: int, visit: Callable[[np.ndarray, np.ndarray], None], store: Store, ranges: tuple[np.ndarray, np.ndarray] | None = None, base_case: int = BASE_CASE) -> None:
    """visit(position, common) by blocks: all suffixes from the greatest down by their first `depth` symbols, each with
    the length (depth at most, 255 at most) of its common prefix with the one visited before.

    The last symbol must be 0 and stand nowhere else.
    """
    limit = max(1, store.memory // 6 // 32)
    if ranges is None:
        count = np.zeros(greatest + 1, np.int64)
        for a in range(0, len(text), CHUNK):
            count += np.bincount(text.slice(a, a + CHUNK), minlength=greatest + 1)
        cut = Ranges(limit)
        for symbol, n in enumerate(count.tolist()):
            cut.add(symbol, n)
        ranges = cut.arrays()
    front = Front(text, greatest)
    seeds = FirstSeeds(store, ranges, depth)
    for frame in scan_seeds(text, front, depth):
        seeds.add(*frame)
    naming = Naming(store, depth, limit)
    induce(text, greatest, depth, ranges, front, seeds, naming.visit, store)
    seeds.waiting.close()
    places, names, gaps = naming.done(store, len(text) // CHUNK + 1)
    m, top = len(places), naming.count
    table = minima(gaps.slice(0, len(gaps)), len(gaps)) if top + 1 < m else [gaps.slice(0, len(gaps))]
    sorted_seeds = Buckets(store)

    def dressed(position: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
        return text.take(position).astype(np.int64), position, np.zeros(len(position), np.uint64), common.astype(np.uint8)

    if m <= base_case:
        held = names.slice(0, m)
        order, shared = doubled(held, depth // 2 + 1)
        at = places.slice(0, m)
        common = np.zeros(m, np.int64)
        common[1:] = symbols_in_common(places, names, table, top, depth, order[:-1], order[1:], shared[1:])
        frames = (dressed(at[order[a : a + CHUNK]], common[a : a + CHUNK]) for a in range(0, m, CHUNK))
    else:
        last = np.zeros(0, np.int64)

        def keep(index: np.ndarray, shared: np.ndarray) -> None:
            nonlocal last
            great = np.append(last, index[:-1])
            common = np.zeros(len(index), np.int64)
            first = len(index) - len(great)
            common[first:] = symbols_in_common(places, names, table, top, depth, index[first:], great, shared[first:].astype(np.int64))
            last = index[-1:]
            sorted_seeds.push(0, places.take(index), common.astype(np.uint8))

        sort_suffixes(names, top, depth, keep, store, upside_down(naming.ranges, top), base_case)

        def upwards() -> Iterator[tuple[np.ndarray, ...]]:
            shared = np.zeros(1, np.uint8)
            for position, common in sorted_seeds.take(0, backwards=True):
                # common is with the greater neighbour
                position, common = position[::-1], common[::-1]
                yield dressed(position, np.append(shared, common[:-1]))
                shared = common[-1:]

        frames = upwards()
    induce(text, greatest, depth, ranges, front, SortedSeeds(frames, text, depth), lambda position, common, *_: visit(position, common), store)
    for x in (sorted_seeds, places, names, gaps):
        x.close()


def suffix_array(text: np.ndarray, depth: int, store: Store | None = None, base_case: int = BASE_CASE) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of an array by their first `depth` symbols, and the common prefix of each with the one before."""
    store = store or Store(None, 1 << 40)
    held = Sequence(store, np.int64)
    held.append(np.asarray(text))
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    sort_suffixes(held.done(), int(np.max(text)), depth, lambda position, common: blocks.append((position.copy(), common.copy())), store, base_case=base_case)
    position, common = joined(blocks)
    return position[::-1], np.append(0, common[::-1][:-1]).astype(np.int64)
