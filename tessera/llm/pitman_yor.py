"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Tokens are lower-cased words and an end. Every observed pair of preceding words is a restaurant, whose
parent is that of the one preceding word, whose parent is the root, which seats all words; a text
begins behind two marks of its start. A dish of a restaurant is a word that followed its context. Tables of a
restaurant are customers of its parent. The root's base measure has no atoms: its new tables are words not seen
before, which are one outcome, and each known word has one table there.

A sweep takes customers out and seats them again one at a time, given all others: of each dish as many as it
has, drawn at random in dishes of up to MOVES customers, each once in larger ones. Dishes of one sweep see the restaurants'
totals and parents' probabilities as the sweep before left them (the usual parallel Gibbs scheme). Then discounts and strengths of the
three levels are drawn from their conditional on a grid. After BURN_IN sweeps, predictive probabilities are averaged
over SAMPLES. Random numbers are hashes of dish, customer and sweep: neither lost tasks nor the
number of parts change a result.

Restaurants and dishes live in parts, by hash. Chunks of documents and parts, whose numbers grow with the bytes of text alone, write each other lists:
a chunk asks with sorted keys, the part answers in the same order. A chunk keeps its tokens, so texts are read once. Dishes with one customer have
one table whatever the sweep, so they are only counted. Lists are rows of one table of mail that is
grouped by receiver in each step; no list is larger than a part or a chunk. Long lists stay in files of the shared folder, which the sender
writes and the receiver reads: what is shuffled says where they are.

Keys of grams are 40 bits of a hash within their part; words are 56-bit hashes. Of grams of a chunk that share a key, the first one's words stand for all.

Defined cases: null and empty texts are an end alone; an empty training set gives every token probability 1 as the only outcome;
rows without identifier or with a repeated one are scored row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, lgamma
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, Stash, mix64, open_store, pieces, prefix_hashes, range_hashes, text_buffer, tidy, words_of

BURN_IN, SAMPLES = 2, 3
MOVES = 8  # customers of a dish up to which its tables are rows of a matrix
FEW = 64  # dishes below which a sweep goes on one by one
NUMBERS = 1 << 15  # random numbers of a sweep that are drawn at once
TRIALS = 2, 4, 8, 16  # draws at once for customers whose first was not accepted
CHUNK_BYTES = 8 << 20  # of texts, on average
PART_BYTES = 16 << 20  # of texts for each part
PIECE_BYTES = 256 << 10  # of texts that are cut into words at once, so that their arrays stay in the cache
LONG = 64 << 10  # a longer text is a chunk of its own
MOST_ROWS = 4096
RUNS = 512  # of rows that follow each other in a file, for each chunk
BLOCK = 1 << 17  # of numbers that are worked out at once, so that what lies between stays in the cache
INLINE = 1 << 10  # bytes up to which a list stands in its row
TASKS = 4  # for each core, at most, among which receivers are dealt
END = np.uint64(0x9D39247E33776D41 & ~255)
START = np.uint64(0x51ED270B9F3C8A6D & ~255)
WORD_BITS = np.uint64(~255 & (1 << 64) - 1)
KEY = np.uint64(40)
LOW_BITS = np.uint64((1 << 40) - 1)
EXACT_BINS, OCTAVE = 1024, 64
DISCOUNTS = np.arange(0.02, 0.99, 0.02)
STRENGTHS = 10 ** np.arange(-1, 3.01, 1 / 3)
MAIL = "part long, peer long, n long, data binary, kind int"
# kinds of mail
(GRAMS, GRAM_COUNTS, PAIRS, DISHES, ASKED_GRAMS, PARENTS, PAIR_CLASSES, FOUND_PAIRS, LOW_DISHES, ASKED_PAIRS, WORDS, WORD_REFS, HIGH, LOW, ROOT, HIGH_PARENTS, LOW_WORDS, TOKENS) = range(1, 19)
(HIGH_SEATS, LOW_SEATS, ROOT_SEATS, SENT_TABLES, SENT_SUMS, TOTALS, CHANCES, GRAM_ANSWERS, PAIR_ANSWERS, WORD_ANSWERS) = range(20, 30)
(OPEN_HIGH, HELD_HIGH, SIZES_HIGH, OPEN_LOW, HELD_LOW, SIZES_LOW, HELD_ROOT, SUMS) = range(40, 48)  # counts for the driver


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (56-bit word hashes) of all tokens of a batch, each text's end included, and their n+1 offsets."""
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    start, end, words = words_of(data, offsets)
    held = range_hashes(prefix_hashes(data), start, end) & WORD_BITS
    out = np.full(len(held) + len(texts), END, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(words))
    out[np.arange(len(held)) + owner] = held
    return out, words + np.arange(len(texts) + 1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.uint64)
    for k in range(0, len(a), BLOCK):
        out[k : k + BLOCK] = mix64(mix64(a[k : k + BLOCK]) * np.uint64(0x9E3779B97F4A7C15) + b[k : k + BLOCK])
    return out


def gram_codes(word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all tokens their trigram, bigram, context of two words, and that of one; begin: where texts begin."""
    one = np.append(START, word[:-1])[: len(word)]
    one[begin] = START
    both = pair(one, word)
    # the two words before a token are the pair that ends one token earlier
    two = np.append(np.uint64(0), both[:-1])[: len(word)]
    two[begin] = pair(np.array([START]), np.array([START]))
    return pair(two, word), both, two, one


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where each stands first, and the place of every value among them."""
    by, sort = sorted_by(x)
    new = np.ones(len(x), bool)
    np.not_equal(sort[1:], sort[:-1], out=new[1:])
    kind = index_type(len(x))
    cut = np.flatnonzero(new)
    keys, first = sort.take(cut), by.take(cut).astype(kind)
    del sort, cut
    place = np.empty(len(x), kind)
    rank = np.cumsum(new, dtype=kind)
    rank -= kind(1)
    place[by] = rank
    return keys, first, place


def index_type(n: int) -> type:
    """Places among n values, in half the memory unless there are very many."""
    return np.int32 if n < 1 << 31 else np.int64


def order_of(x: np.ndarray) -> np.ndarray:
    """Stable order of uint64 values."""
    return sorted_by(x)[0]


def sorted_by(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of uint64 values, and the values in it: their leading bits and their places are sorted as one number, which costs a fifth of an argsort.

    Values that differ in trailing bits alone may come out of order; then, which is rare for hashes, they are sorted in full.
    """
    bits = max(1, (len(x) - 1).bit_length())
    free = np.uint64(64 - int(x.max()).bit_length() if len(x) else 0)
    low = np.uint64((1 << bits) - 1)
    both = x << free
    both &= ~low
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    both &= low
    by = both.view(np.int64)
    sort = x.take(by)
    if not bool((sort[1:] >= sort[:-1]).all()):
        by = np.argsort(x, kind="stable")
        sort = x.take(by)
    return by, sort


def ranked_few(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of every value among them, by a hash table: for values that repeat often."""
    held = pa.array(x).dictionary_encode()
    values, _, place = ranked(held.dictionary.to_numpy())
    return values, place.take(held.indices.to_numpy())


# lists of numbers as bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, byte planes apart, compressed; sorted uint64 ones as differences."""
    body, head = [], [np.uint32(len(arrays)).tobytes()]
    for x in arrays:
        x = np.ascontiguousarray(x)
        rising = x.dtype == np.uint64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        if rising:
            x = np.diff(x, prepend=np.uint64(0))
            x = x.astype(np.uint32) if int(x.max()) < 1 << 32 else x
        kind = x.dtype.str.encode().ljust(7) + (b"+" if rising else b"=")
        head.append(kind + np.uint32(len(x)).tobytes())
        whole = x.view(f"u{x.itemsize}")
        body += [(whole >> whole.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(x.itemsize)]
    raw = b"".join(head + body)
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(data, np.uint32, 1)[0])
    raw = pa.decompress(data[4:], decompressed_size=size, codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.uint32, 1)[0])
    heads = [(raw[4 + 12 * k : 12 + 12 * k], int(np.frombuffer(raw, np.uint32, 1, 12 + 12 * k)[0])) for k in range(count)]
    at, out = 4 + 12 * count, []
    for kind, n in heads:
        t = np.dtype(kind[:7].decode().strip())
        whole = np.dtype(f"u{t.itemsize}").type
        x = np.frombuffer(raw, np.uint8, n, at).astype(whole)
        for k in range(1, t.itemsize):
            x |= np.frombuffer(raw, np.uint8, n, at + k * n).astype(whole) << whole(8 * k)
        x = x.view(t)
        out.append(np.cumsum(x, dtype=np.uint64) if kind[7:] == b"+" else x)
        at += n * t.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


class Mail:
    """What one receiver got, by kind and sender, and what it sends. root: the shared folder of long lists."""

    def __init__(self, table: pa.Table | None, root: str | None = None):
        self.got: dict[int, list[tuple[int, bytes]]] = {}
        self.out: list[tuple] = []
        self.files: dict[bytes, pa.NativeFile] = {}
        self.root = root
        if table is not None:
            for peer, n, kind, data in zip(*(table[x].to_pylist() for x in ("peer", "n", "kind", "data"))):
                self.got.setdefault(kind, []).append((peer, data, n) if n else (peer, data))
        for held in self.got.values():
            held.sort(key=lambda x: x[0])  # whatever order it came in

    def list_of(self, data: bytes, n: int = 0) -> list[np.ndarray]:
        """A list that stands in its row, or n bytes of a file."""
        if not n:
            return unpack(data)
        name = data[8:]
        if name not in self.files:
            store, path = open_store(f"{self.root}/{name.decode()}")
            self.files[name] = store.open_input_file(path)
        return unpack(self.files[name].read_at(n, int.from_bytes(data[:8], "little")))

    def of(self, kind: int) -> list[tuple[int, list[np.ndarray]]]:
        out = [(peer, self.list_of(*data)) for peer, *data in self.got.get(kind, [])]
        self.close()
        return out

    def own(self, kind: int) -> list[np.ndarray] | None:
        held = self.got.get(kind)
        return self.list_of(*held[0][1:]) if held else None

    def close(self) -> None:
        for file in self.files.values():
            file.close()
        self.files = {}

    def send(self, part: int, peer: int, kind: int, *arrays: np.ndarray) -> None:
        self.out.append((int(part), int(peer), 0, pack(*arrays), kind))

    def count(self, kind: int, values: np.ndarray) -> None:
        """Tell the driver how often each value occurs, large ones to within a hundredth."""
        few = values < EXACT_BINS
        times = np.bincount(values[few] if values.dtype.itemsize == 8 else values[few].astype(np.int64))
        times[:1] = 0
        bins = np.flatnonzero(times)
        self.out += [(-1, b, n, None, kind) for b, n in zip(bins.tolist(), times[bins].tolist())]
        bins, times = np.unique(bin_of(values[~few]), return_counts=True)
        self.out += [(-1, b, n, None, kind) for b, n in zip(bins.tolist(), times.tolist())]

    def sum(self, which: int, value: int) -> None:
        self.out.append((-1, which, int(value), None, SUMS))

    def shelve(self, name: str) -> None:
        """Write long lists to files of the shared folder, one of each kind; rows keep where they stand.

        A repeated task writes files of other names, and only rows of the one that ended well are read.
        """
        files: dict[int, tuple] = {}
        for k, (part, peer, _, data, kind) in enumerate(self.out):
            if data is None or len(data) <= INLINE:
                continue
            if kind not in files:
                folder, file = f"{name}/kind={kind}", uuid4().hex
                store, path = open_store(f"{self.root}/{folder}")
                store.create_dir(path, recursive=True)
                files[kind] = store.open_output_stream(f"{path}/{file}"), f"{folder}/{file}".encode()
            out, at = files[kind]
            self.out[k] = part, peer, len(data), out.tell().to_bytes(8, "little") + at, kind
            out.write(data)
        for out, _ in files.values():
            out.close()

    def table(self) -> pa.Table:
        names, kinds = ["part", "peer", "n", "data", "kind"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        columns = list(zip(*self.out)) or [()] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)


def bin_of(values: np.ndarray) -> np.ndarray:
    values = values[values > 0]
    return np.where(values < EXACT_BINS, values, EXACT_BINS + np.floor(OCTAVE * np.log2(np.maximum(values, EXACT_BINS) / EXACT_BINS)).astype(np.int64))


def value_of(bins: np.ndarray) -> np.ndarray:
    return np.where(bins < EXACT_BINS, bins, np.round(EXACT_BINS * 2.0 ** ((bins - EXACT_BINS + 0.5) / OCTAVE)))


def home(code: np.ndarray, parts: int) -> np.ndarray:
    """Part and key of codes of grams, in one number."""
    return (code & np.uint64(0xFFFFFF)) % np.uint64(parts) << KEY | code >> np.uint64(24)


def word_home(code: np.ndarray, parts: int) -> np.ndarray:
    return (code >> np.uint64(8) & np.uint64(0xFFFFFF)) % np.uint64(parts)


def by_part(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of sorted part numbers."""
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    return zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(part)])


class Chunk:
    """Tokens of the documents of a chunk, and the sorted lists that it asks with."""

    def __init__(self, ids: pa.ChunkedArray, learn: np.ndarray, sizes: np.ndarray, codes: np.ndarray, at: np.ndarray, parts: int):
        self.parts, self.ids, self.learned, self.sizes, self.seen, self.at = parts, ids, learn, sizes, codes, at
        self.word, self.learn = codes.take(at[:-1]), np.repeat(learn, sizes)
        self.gram, self.pair, self.two, self.one = gram_codes(self.word, np.cumsum(sizes) - sizes)

    @classmethod
    def of_docs(cls, docs: pa.Table, parts: int) -> Chunk:
        word, sizes = [], []
        for batch in docs.select(["text"]).to_batches():
            for part in pieces(batch, PIECE_BYTES):
                codes, offsets = token_codes(part.column(0))
                word.append(codes)
                sizes.append(np.diff(offsets))
        # by first appearance: frequent words get small numbers, which take few bytes
        seen = pa.array(np.append(np.concatenate(word), START)).dictionary_encode()
        return cls(docs["doc_id"], docs["learn"].to_numpy().astype(bool), np.concatenate(sizes), seen.dictionary.to_numpy(), seen.indices.to_numpy(), parts)

    def keep(self, name: int, mail: Mail) -> None:
        """Send itself what it is: each step needs the tokens, none the texts."""
        held = pa.BufferOutputStream()
        table = pa.table({"doc_id": self.ids})
        with pa.ipc.new_stream(held, table.schema) as out:
            out.write_table(table)
        mail.send(name, name, TOKENS, np.frombuffer(held.getvalue(), np.uint8), self.learned, small(self.sizes), self.seen, small(self.at))

    @classmethod
    def kept(cls, mail: Mail, parts: int) -> Chunk:
        ids, learn, sizes, codes, at = mail.own(TOKENS)
        return cls(pa.ipc.open_stream(ids.tobytes()).read_all()["doc_id"], learn, sizes.astype(np.int64), codes, at.astype(index_type(len(codes))), parts)

    def grams(self) -> None:
        """Once; the codes of grams go, as no step needs them but by their ranks."""
        lead = home(self.two, self.parts)
        lead &= ~LOW_BITS  # a dish lives with its context
        self.gram >>= np.uint64(24)
        lead |= self.gram
        self.gram = None
        self.keys3, self.first3, self.at3 = ranked(lead)

    def pairs(self) -> None:
        """Once and after grams(), if at all; the codes go."""
        start = pair(np.array([START]), np.array([START]))
        codes = np.append(self.pair, start)
        begin = self.two == start[0]
        self.gram = self.pair = self.two = None
        self.keys2, self.first2, at = ranked(home(codes, self.parts))
        self.at2 = at[:-1]
        self.ahead = np.where(begin, at[-1], np.append(at[-1], self.at2[:-1]))  # of the context of two words

    def words(self) -> None:
        part = word_home(self.seen, self.parts)
        by = order_of(self.seen)
        by = by.take(np.argsort(part.take(by).astype(np.uint16 if self.parts <= 1 << 16 else np.uint64), kind="stable"))
        place = np.empty(len(by), index_type(len(by)))
        place[by] = np.arange(len(by), dtype=place.dtype)
        self.codes, self.code_part = self.seen.take(by), part.take(by)
        at = place.take(self.at)
        self.at1 = at[:-1]
        self.at_one = np.where(self.one == START, at[-1], np.append(at[-1], self.at1[:-1]))  # of the word before

    def tally(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at, minlength=n)


def in_order(mail: Mail, kind: int) -> list[np.ndarray]:
    """Answers of all parts, one after another."""
    held = [x for _, x in mail.of(kind)]
    return [np.concatenate(x) for x in zip(*held)]


def ask_grams(chunk: Chunk, name: int, mail: Mail) -> None:
    chunk.keep(name, mail)
    chunk.grams()
    own = chunk.tally(chunk.at3[chunk.learn], len(chunk.keys3))
    for p, a, b in by_part(chunk.keys3 >> KEY):
        mail.send(p, name, GRAMS, chunk.keys3[a:b] & LOW_BITS, small(own[a:b]))


def count_grams(part: int, mail: Mail) -> None:
    """Answer how often each gram stands in training texts, and whether the chunk is the first that has it there."""
    asked = mail.of(GRAMS)
    keys, own = (np.concatenate(x) for x in zip(*(x for _, x in asked)))
    _, _, which = ranked(keys)
    total = np.bincount(which, own).astype(np.int64)
    first = np.zeros(len(keys), bool)
    held = np.flatnonzero(own > 0)
    first[held[np.unique(which[held], return_index=True)[1]]] = True
    at = 0
    for peer, (k, _) in asked:
        mail.send(peer, part, GRAM_COUNTS, small(total.take(which[at : at + len(k)])), first[at : at + len(k)])
        at += len(k)


def ask_pairs(chunk: Chunk, name: int, mail: Mail) -> None:
    chunk.grams()
    chunk.pairs()
    total, first = in_order(mail, GRAM_COUNTS)
    n, size = total.take(chunk.at3), len(chunk.keys2)
    lone, several = np.flatnonzero(chunk.learn & (n == 1)), np.flatnonzero(chunk.learn & (n > 1))
    fields = [chunk.tally(chunk.at2.take(lone), size), chunk.tally(chunk.at2.take(several), size) > 0, chunk.tally(chunk.ahead.take(lone), size), chunk.tally(chunk.ahead[chunk.learn], size)]
    for p, a, b in by_part(chunk.keys2 >> KEY):
        mail.send(p, name, PAIRS, chunk.keys2[a:b] & LOW_BITS, *(small(x[a:b]) for x in fields))
    multi = np.flatnonzero(total > 1)
    for p, a, b in by_part(chunk.keys3[multi] >> KEY):
        mail.send(p, name, ASKED_GRAMS, chunk.keys3[multi[a:b]] & LOW_BITS)
    new = np.flatnonzero(first & (total > 1))
    at = chunk.first3[new]
    for p, a, b in by_part(chunk.keys3[new] >> KEY):
        mail.send(p, name, DISHES, chunk.keys3[new[a:b]] & LOW_BITS, chunk.keys2[chunk.ahead[at[a:b]]] & LOW_BITS, chunk.keys2[chunk.at2[at[a:b]]], small(total[new[a:b]]))


def count_pairs(part: int, mail: Mail) -> None:
    """Gather restaurants of two words and the classes of pairs: 0 never a dish, 1 with one customer, 2 with more."""
    asked = mail.of(PAIRS)
    keys, lone, several, opened, held = (np.concatenate(x) for x in zip(*(x for _, x in asked)))
    pairs, first, which = ranked(keys)
    lone, opened, held = (np.bincount(which, x).astype(np.int64) for x in (lone, opened, held))
    kind = np.where((lone > 1) | (np.bincount(which, several) > 0), 2, lone)
    dishes = mail.of(DISHES)
    dynamic = np.zeros(len(pairs), bool)
    if dishes:
        gram, two, parent, n = (np.concatenate(x) for x in zip(*(x for _, x in dishes)))
        by = np.argsort(gram, kind="stable")
        gram, two, parent, n = gram[by], two[by], parent[by], n[by]
        contexts, at = np.unique(two, return_inverse=True)
        place = np.searchsorted(pairs, contexts)
        dynamic[place] = True
        parents, at_parent = np.unique(parent, return_inverse=True)
        mail.send(part, part, HIGH, gram, small(at), small(opened[place]), contexts)
        mail.send(part, part, HIGH_PARENTS, parents, small(at_parent), small(n), small(held[place]))
        for q, a, b in by_part(parents >> KEY):
            mail.send(q, part, PARENTS, parents[a:b] & LOW_BITS)
    rest = ~dynamic & (held > 0)
    mail.count(OPEN_HIGH, opened[rest])
    mail.count(HELD_HIGH, held[rest])
    found = np.flatnonzero(kind == 2)
    if len(found):
        mail.send(part, part, FOUND_PAIRS, pairs[found], small(lone[found]))
    fresh = np.zeros(len(keys), bool)
    fresh[first] = True
    at = 0
    for peer, (k, *_) in asked:
        w = which[at : at + len(k)]
        mail.send(peer, part, PAIR_CLASSES, kind.take(w).astype(np.uint8), fresh[at : at + len(k)], dynamic.take(w), small(opened.take(w)), small(held.take(w)))
        at += len(k)


def ask_words(chunk: Chunk, name: int, mail: Mail) -> None:
    chunk.pairs()
    chunk.words()
    kind, fresh, dynamic, _, _ = in_order(mail, PAIR_CLASSES)
    new = np.flatnonzero((kind == 2) & fresh)
    at = chunk.first2[new]
    for p, a, b in by_part(chunk.keys2[new] >> KEY):
        mail.send(p, name, LOW_DISHES, chunk.keys2[new[a:b]] & LOW_BITS, chunk.one[at[a:b]], chunk.word[at[a:b]])
    asked = np.flatnonzero((kind == 2) | dynamic)
    for p, a, b in by_part(chunk.keys2[asked] >> KEY):
        mail.send(p, name, ASKED_PAIRS, chunk.keys2[asked[a:b]] & LOW_BITS)
    size = len(chunk.codes)
    lone = np.flatnonzero(chunk.learn & (kind.take(chunk.at2) == 1))  # such a pair stands once in all training texts
    fields = [chunk.tally(chunk.at1[chunk.learn], size), chunk.tally(chunk.at1[lone], size), chunk.tally(chunk.at_one[lone], size)]
    for p, a, b in by_part(chunk.code_part):
        mail.send(p, name, WORDS, chunk.codes[a:b], *(small(x[a:b]) for x in fields))


def gather(part: int, mail: Mail, parts: int) -> None:
    """The dishes of restaurants of one word, and the words of a part."""
    found = mail.own(FOUND_PAIRS)
    if found is not None:
        keys, one, word = (np.concatenate(x) for x in zip(*(x for _, x in mail.of(LOW_DISHES))))
        by = np.argsort(keys, kind="stable")
        one, word = one[by], word[by]
        refs = []
        for code in (word, one):
            home_of = word_home(code, parts)
            sort = np.lexsort((code, home_of))
            new = np.append(True, code[sort][1:] != code[sort][:-1])
            at = np.empty(len(code), np.int64)
            at[sort] = np.cumsum(new) - 1
            refs.append((code[sort][new], home_of[sort][new], at))
        mail.send(part, part, LOW, *found)
        mail.send(part, part, LOW_WORDS, *(small(at) for _, _, at in refs), *(x for c, h, _ in refs for x in (c, h.astype(np.uint32))))
        for p in np.unique(np.concatenate([h for _, h, _ in refs])).tolist():
            mail.send(p, part, WORD_REFS, *(c[h == p] for c, h, _ in refs))
    asked = mail.of(WORDS)
    if asked:
        codes, n, lone, opened = (np.concatenate(x) for x in zip(*(x for _, x in asked)))
        codes, which = ranked_few(codes)
        n, lone, opened = (np.bincount(which, x).astype(np.int64) for x in (n, lone, opened))
        mail.send(part, part, ROOT, codes, small(n), small(lone), small(opened))
        mail.sum(0, n.sum())
        mail.sum(1, np.count_nonzero(n))


# seating


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(key ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) / float(1 << 53)


def leave(held: np.ndarray, rows, u: np.ndarray) -> None:
    """One customer, drawn at random, of each of these rows of table sizes goes."""
    sub = held[rows]
    ahead = sub.cumsum(axis=1)
    at = (ahead <= np.floor(u * ahead[:, -1])[:, None]).sum(axis=1)
    held[rows, at] -= 1


def sit(held: np.ndarray, rows, u: np.ndarray, v: np.ndarray, pull: np.ndarray, slope: np.ndarray, begun: np.ndarray, discount: float) -> None:
    """One customer more for each of these rows: at a table by its size less the discount, or at a new one by `pull`."""
    sub = held[rows]
    taken = sub > 0
    tables = taken.sum(axis=1)
    rest = np.maximum(0.0, sub.sum(axis=1) - discount * tables)
    new_weight = np.maximum(1e-300, pull + slope * (tables - begun))
    fresh = u * (new_weight + rest) < new_weight
    weights = np.where(taken, sub - discount, 0.0).cumsum(axis=1)
    at = (weights <= (v * weights[:, -1])[:, None]).sum(axis=1)
    at = np.minimum(at, sub.shape[1] - 1)
    at = np.where(taken[np.arange(len(at)), at], at, taken.argmax(axis=1))
    at = np.where(fresh | (tables == 0), taken.argmin(axis=1), at)
    held[rows, at] += 1


GOLDEN, WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def numbered(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Random numbers by dish and draw."""
    return (mix64(key ^ number * np.uint64(GOLDEN)) >> np.uint64(11)) / float(1 << 53)


def numbered_one(key: int, number: int) -> float:
    """The same for one dish, in plain numbers."""
    x = key ^ number * GOLDEN & WORD
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & WORD
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & WORD
    return ((x ^ x >> 33) >> 11) / 9007199254740992.0


def whole_sweep(key: np.ndarray, want: np.ndarray, tables: np.ndarray, sizes: np.ndarray, pull: np.ndarray, slope: np.ndarray, discount: float, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish and their sizes after customers came or went and then each was seated again once.

    A table is drawn by its size less the discount: that of another customer drawn at random, until it is accepted
    by 1 - discount / size. So a customer costs the same however many there are.
    """
    by = np.argsort(-want, kind="stable")
    begin = np.cumsum(tables) - tables
    have, room = np.add.reduceat(sizes, begin)[by], np.maximum(want, np.add.reduceat(sizes, begin))[by]
    size = np.zeros(int(room.sum()), np.int64)
    at = np.cumsum(room) - room
    count, wanted, keys, a, b, begun = (x[by].copy() for x in (tables, want, key, pull, slope, tables))
    local = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    size[np.repeat(at, count) + local] = sizes[np.repeat(begin[by], count) + local]
    free = np.arange(len(size))  # of a dish, from its number of tables on: places without one
    seat = np.zeros(len(size), np.int64)
    seat[np.repeat(at, have) + np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have)] = np.repeat(np.arange(len(size)), size)
    base = sweep << 32

    def draw(d: np.ndarray, number: int) -> np.ndarray:
        return numbered(keys[d], np.full(1, number & (1 << 64) - 1, np.uint64))

    def leave_table(d: np.ndarray, table: np.ndarray) -> None:
        size[table] -= 1
        gone = size[table] == 0
        count[d[gone]] -= 1
        free[at[d[gone]] + count[d[gone]]] = table[gone]

    def tried_again(d: np.ndarray, who: np.ndarray, others: np.ndarray, number: int) -> np.ndarray:
        """Tables of customers whose first draw was not accepted."""
        table, left, trial, turn = np.empty(len(d), np.int64), np.arange(len(d)), 1, 0
        while len(left):
            e, several = d.take(left), TRIALS[min(turn, len(TRIALS) - 1)]
            numbers = np.array([number + (k << 48) & WORD for k in range(trial, trial + several)], np.uint64)
            x = numbered(keys.take(e)[:, None], numbers) * others.take(left)[:, None]
            j = x.astype(np.int64)
            found = seat.take(at.take(e)[:, None] + j + (j >= who.take(left)[:, None]))
            held = size.take(found)
            x -= j
            x *= held
            sure = x < held - discount
            first = sure.argmax(axis=1)
            row = np.arange(len(left))
            table[left] = found[row, first]  # of those without one, any, until their turn
            left, trial, turn = left[~sure[row, first]], trial + several, turn + 1
        return table

    def find_table(d: np.ndarray, who: np.ndarray, others: np.ndarray, number: int) -> None:
        # one number decides all of it: where it falls among the weights, which customer that is, and how far into them
        places, tables = at[d], count[d]
        fresh_weight = np.maximum(1e-300, a[d] + b[d] * (tables - begun[d]))
        rest = np.maximum(0.0, others - discount * tables)
        x = draw(d, number) * (fresh_weight + rest) - fresh_weight
        fresh = (x < 0) | (rest == 0)
        x = np.where(fresh, 0, x) / np.where(fresh, 1, rest) * others
        j = np.minimum(x.astype(np.int64), np.maximum(0, others - 1))
        table = seat[places + j + (j >= who)]
        table[fresh] = free[places[fresh] + tables[fresh]]
        count[d[fresh]] += 1
        held = size[table]
        left = np.flatnonzero(~fresh & ((x - j) * held >= held - discount))
        table[left] = tried_again(d[left], who[left], others[left], number)
        size[table] += 1
        seat[at[d] + who] = table

    now = have.copy()
    for step in range(int(np.max(have - wanted, initial=0))):
        d = np.flatnonzero(have - wanted > step)
        j = at[d] + (draw(d, base + 4 * step) * now[d]).astype(np.int64)
        leave_table(d, seat[j])
        now[d] -= 1
        seat[j] = seat[at[d] + now[d]]
    more = wanted - have
    rising = np.sort(more)[::-1]
    several = max(0, int(rising[FEW])) if len(rising) > FEW else 0
    for step in range(several):
        d = np.flatnonzero(more > step)
        find_table(d, now[d], now[d], base + 4 * step)
        now[d] += 1
    for d in np.flatnonzero(more > several).tolist():
        # the same for a few dishes, draw by draw, in plain numbers
        first, k, others, tables_now = int(at[d]), int(keys[d]), int(now[d]), int(count[d])
        cut = slice(first, first + int(room[d]))
        seats, held, open_places = (seat[cut] - first).tolist(), size[cut].tolist(), (free[cut] - first).tolist()
        fa, fb, fbegun = float(a[d]), float(b[d]), int(begun[d])
        numbers = np.uint64(base) + np.uint64(4) * np.arange(several, int(more[d]), dtype=np.uint64)
        for step, u in enumerate(numbered(keys[d : d + 1], numbers).tolist(), several):
            new_weight = max(1e-300, fa + fb * (tables_now - fbegun))
            old_weight = max(0.0, others - discount * tables_now)
            x = u * (new_weight + old_weight) - new_weight
            if x < 0 or not old_weight:
                table = open_places[tables_now]
                tables_now += 1
            else:
                x, trial = x / old_weight * others, 1
                j = min(int(x), others - 1)
                table = seats[j]
                while (x - j) * held[table] >= held[table] - discount:
                    x = numbered_one(k, base + 4 * step + (trial << 48)) * others
                    j = int(x)
                    table = seats[j]
                    trial += 1
            held[table] += 1
            seats[others] = table
            others += 1
        seat[cut], size[cut], count[d] = np.array(seats) + first, held, tables_now
    base += 1 << 31
    step, active = 0, int(np.searchsorted(-wanted, 0, "left"))
    while active > FEW:
        # steps whose random numbers are drawn at once
        ahead = min(max(1, NUMBERS // active), int(wanted[active - 1]) - step)
        draws = numbered(keys[:active], (np.uint64(base) + np.uint64(4) * np.arange(step, step + ahead, dtype=np.uint64))[:, None])
        places, n, tables, first, pull_now, slope_now = at[:active], wanted[:active] - 1, count[:active], begun[:active], a[:active], b[:active]
        last = np.maximum(0, n - 1)
        for u in draws:
            here = places + step
            table = seat.take(here)
            held = size.take(table)
            held -= 1
            size[table] = held
            d = (held == 0).nonzero()[0]
            if len(d):
                tables[d] -= 1
                free[places[d] + tables[d]] = table[d]
            fresh_weight = slope_now * (tables - first)
            fresh_weight += pull_now
            np.maximum(fresh_weight, 1e-300, out=fresh_weight)
            rest = np.maximum(0.0, n - discount * tables)
            x = u * (fresh_weight + rest)
            x -= fresh_weight
            d = np.flatnonzero((x < 0) | (rest == 0))
            x[d], rest[d] = 0, 1
            x /= rest
            x *= n
            j = np.minimum(x.astype(np.int64), last)
            x -= j
            j += j >= step
            j += places
            table = seat.take(j)
            if len(d):
                table[d] = free[places[d] + tables[d]]
                tables[d] += 1
            held = size.take(table)
            x *= held
            refused = x >= held - discount
            refused[d] = False
            left = np.flatnonzero(refused)
            if len(left):
                table[left] = tried_again(left, np.full(len(left), step), n[left], base + 4 * step)
                held[left] = size[table[left]]
            size[table] = held + 1
            seat[here] = table
            step += 1
        active = int(np.searchsorted(-wanted, -step, "left"))
    for d in range(active):
        # the same, draw by draw, in plain numbers
        n, first, k, tables_now = int(wanted[d]), int(at[d]), int(keys[d]), int(count[d])
        cut = slice(first, first + int(room[d]))
        seats, held, open_places = (seat[cut] - first).tolist(), size[cut].tolist(), (free[cut] - first).tolist()
        fa, fb, fbegun, most = float(a[d]), float(b[d]), int(begun[d]), n - 2
        new_weight = max(1e-300, fa + fb * (tables_now - fbegun))
        old_weight = max(0.0, n - 1 - discount * tables_now)
        for low in range(step, n, 1 << 16):
            numbers = np.uint64(base) + np.uint64(4) * np.arange(low, min(n, low + (1 << 16)), dtype=np.uint64)
            for i, u in enumerate(numbered(keys[d : d + 1], numbers).tolist(), low):
                table = seats[i]
                left = held[table] - 1
                held[table] = left
                if not left:
                    tables_now -= 1
                    open_places[tables_now] = table
                    new_weight = max(1e-300, fa + fb * (tables_now - fbegun))
                    old_weight = max(0.0, n - 1 - discount * tables_now)
                x = u * (new_weight + old_weight) - new_weight
                if x < 0 or not old_weight:
                    table = open_places[tables_now]
                    tables_now += 1
                    new_weight = max(1e-300, fa + fb * (tables_now - fbegun))
                    old_weight = max(0.0, n - 1 - discount * tables_now)
                else:
                    x = x / old_weight * (n - 1)
                    j = int(x)
                    if j > most:
                        j = most
                    table = seats[j + 1 if j >= i else j]
                    size_now = held[table]
                    if (x - j) * size_now >= size_now - discount:
                        trial = 1
                        while (x - j) * held[table] >= held[table] - discount:
                            x = numbered_one(k, base + 4 * i + (trial << 48)) * (n - 1)
                            j = int(x)
                            table = seats[j + (j >= i)]
                            trial += 1
                held[table] += 1
                seats[i] = table
        size[cut], count[d] = held, tables_now
    # back in the order given
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    n = room[back]
    values = size[np.repeat(at[back], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    return count[back], values[values > 0]


def seated_again(key: np.ndarray, want: np.ndarray, tables: np.ndarray, sizes: np.ndarray, pull: np.ndarray, slope: np.ndarray, discount: float, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish, and their sizes, after customers came or went (to `want`) and all were seated again.

    pull: weight of a new table; slope: by how much it grows with each table of the dish.
    """
    begin = np.cumsum(tables) - tables
    have = np.add.reduceat(sizes, begin) if len(tables) else np.zeros(0, np.int64)
    more, fewer, moves = np.maximum(0, want - have), np.maximum(0, have - want), np.minimum(want, MOVES)
    room = np.minimum(np.maximum(want, have), tables + more + moves)
    width = 1 << np.ceil(np.log2(np.maximum(1, room))).astype(np.int64)
    out_tables, parts = np.ones(len(tables), np.int64), []
    # one customer has one table; whoever of two is seated again finds the other one alone
    alone = np.flatnonzero((want == 1) & (have == 1))
    parts.append((alone, np.ones(len(alone), np.int64)))
    two = np.flatnonzero((want == 2) & (have == 2))
    weight = np.maximum(1e-300, pull[two] + slope[two] * (1 - tables[two]))
    apart = uniform(key[two], sweep << 32) * (weight + 1 - discount) < weight
    out_tables[two[apart]] = 2
    parts += [(two[apart], np.ones(2 * int(apart.sum()), np.int64)), (two[~apart], np.full(int((~apart).sum()), 2, np.int64))]
    rest = np.ones(len(tables), bool)
    rest[alone] = rest[two] = False
    large = np.flatnonzero(rest & (np.maximum(want, have) > MOVES))
    rest[large] = False
    if len(large):
        held = sizes[np.repeat(begin[large] - np.cumsum(tables[large]) + tables[large], tables[large]) + np.arange(int(tables[large].sum()))]
        out_tables[large], held = whole_sweep(key[large], want[large], tables[large], held, pull[large], slope[large], discount, sweep)
        parts.append((large, held))
    for w in np.unique(width[rest]).tolist():
        every = np.flatnonzero(rest & (width == w))
        every = every[np.argsort(-moves[every], kind="stable")]
        for cut in range(0, len(every), max(1, (1 << 21) // w)):
            rows = every[cut : cut + max(1, (1 << 21) // w)]
            held = np.zeros((len(rows), w), np.int64)
            line = np.repeat(np.arange(len(rows)), tables[rows])
            column = np.arange(len(line)) - np.repeat(np.cumsum(tables[rows]) - tables[rows], tables[rows])
            held[line, column] = sizes[np.repeat(begin[rows], tables[rows]) + column]
            k, salt, begun, a, b = key[rows], sweep << 32, tables[rows], pull[rows], slope[rows]
            for step in range(int(fewer[rows].max())):
                pick = np.flatnonzero(fewer[rows] > step)
                leave(held, pick, uniform(k[pick], salt + 4 * step))
            for step in range(int(more[rows].max())):
                pick = np.flatnonzero(more[rows] > step)
                sit(held, pick, uniform(k[pick], salt + 4 * step + 1), uniform(k[pick], salt + 4 * step + 2), a[pick], b[pick], begun[pick], discount)
            salt += 1 << 31
            for step in range(int(moves[rows].max())):
                pick = np.arange(int(np.searchsorted(-moves[rows], -step, "left")))
                leave(held, pick, uniform(k[pick], salt + 4 * step))
                sit(held, pick, uniform(k[pick], salt + 4 * step + 1), uniform(k[pick], salt + 4 * step + 2), a[pick], b[pick], begun[pick], discount)
            taken = held > 0
            out_tables[rows] = taken.sum(axis=1)
            parts.append((rows, held[taken]))
    flat = np.empty(int(out_tables.sum()), np.int64)
    start = np.cumsum(out_tables) - out_tables
    for rows, values in parts:
        n = out_tables[rows]
        flat[np.repeat(start[rows], n) + np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out_tables, flat


def first_seats(customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A state to begin with: one large table and, for many customers, some of one customer."""
    tables = np.maximum(1, np.sqrt(customers).astype(np.int64) // 2)
    sizes = np.ones(int(tables.sum()), np.int64)
    sizes[np.cumsum(tables) - tables] = customers - tables + 1
    return tables, sizes


def seat_high(part: int, mail: Mail, sweep: int, strength: float, discount: float) -> None:
    """Seat the dishes of restaurants of two words; their tables are customers of the pairs."""
    held = mail.own(HIGH)
    if held is None:
        return
    gram, at, opened, _ = held
    parents, at_parent, n, total = mail.own(HIGH_PARENTS)
    n, opened = n.astype(np.int64), opened.astype(np.int64)
    if sweep == 0:
        tables, sizes = first_seats(n)
    else:
        tables, sizes = (x.astype(np.int64) for x in mail.own(HIGH_SEATS))
        open_tables = opened + np.bincount(at, tables, len(opened)).astype(np.int64)
        chance = np.concatenate([x[0] for _, x in mail.of(CHANCES)]).astype(np.float64)[at_parent]
        tables, sizes = seated_again(gram, n, tables, sizes, (strength + discount * open_tables[at]) * chance, discount * chance, discount, 2 * sweep)
    mail.send(part, part, HIGH_SEATS, small(tables), small(sizes))
    mail.count(OPEN_HIGH, opened + np.bincount(at, tables, len(opened)).astype(np.int64))
    mail.count(HELD_HIGH, total.astype(np.int64))
    mail.count(SIZES_HIGH, sizes)
    sums = np.bincount(at_parent, tables, len(parents)).astype(np.int64)
    for q, a, b in by_part(parents >> KEY):
        mail.send(q, part, SENT_TABLES, small(sums[a:b]))


def low_totals(mail: Mail, word_part: np.ndarray, one_part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Customers of each word at the root, and tables and customers of each restaurant of one word, as last told."""
    return tuple(np.concatenate(x).astype(np.float64) for x in zip(*(x for _, x in mail.of(TOTALS))))


def seat_low(part: int, mail: Mail, sweep: int, strength: float, discount: float, root: tuple[float, float, float]) -> None:
    """Seat the pairs that more than one table of their restaurants sends; their tables are customers of the words."""
    held = mail.own(LOW)
    if held is None:
        return
    pairs, lone = held
    at_word, at_one, words, word_part, ones, one_part = mail.own(LOW_WORDS)
    customers = lone.astype(np.int64)  # at least 1 below: grams that share a key may leave a pair without a sender
    sent = {peer: x[0] for peer, x in mail.of(SENT_TABLES)}
    for peer, (keys,) in mail.of(PARENTS):
        customers[np.searchsorted(pairs, keys)] += sent[peer].astype(np.int64)
    customers = np.maximum(1, customers)
    if sweep == 0:
        tables, sizes = first_seats(customers)
    else:
        tables, sizes = (x.astype(np.int64) for x in mail.own(LOW_SEATS)[1:])
        at_root, opened, _ = low_totals(mail, word_part, one_part)
        chance = np.maximum(1e-12, at_root[at_word] - root[1]) / (root[0] + root[2])
        tables, sizes = seated_again(pairs, customers, tables, sizes, (strength + discount * opened[at_one]) * chance, discount * chance, discount, 2 * sweep + 1)
    mail.send(part, part, LOW_SEATS, small(customers), small(tables), small(sizes))
    mail.count(SIZES_LOW, sizes)
    sums = [np.bincount(at_word, tables, len(words)), np.bincount(at_one, tables, len(ones)), np.bincount(at_one, customers, len(ones))]
    sums = [x.astype(np.int64) for x in sums]
    for p in np.unique(np.append(word_part, one_part)).tolist():
        mail.send(p, part, SENT_SUMS, *(small(x[h == p]) for x, h in zip(sums, (word_part, one_part, one_part))))


def seat_root(part: int, mail: Mail) -> None:
    held = mail.own(ROOT)
    if held is None:
        return
    codes, _, lone, opened = held
    at_root, opened = lone.astype(np.int64), opened.astype(np.int64)
    customers = opened.copy()
    sums = {peer: x for peer, x in mail.of(SENT_SUMS)}
    places = {peer: tuple(np.searchsorted(codes, x) for x in refs) for peer, refs in mail.of(WORD_REFS)}
    for peer, (w, o) in places.items():
        tables, one_tables, one_customers = sums[peer]
        at_root[w] += tables.astype(np.int64)
        opened[o] += one_tables.astype(np.int64)
        customers[o] += one_customers.astype(np.int64)
    for peer, (w, o) in places.items():
        mail.send(peer, part, TOTALS, small(at_root[w]), small(opened[o]), small(customers[o]))
    mail.send(part, part, ROOT_SEATS, small(at_root), small(opened), small(customers))
    mail.count(OPEN_LOW, opened)
    mail.count(HELD_LOW, customers)
    mail.count(HELD_ROOT, at_root)
    mail.sum(2, at_root.sum())


def tell_chances(part: int, mail: Mail, strength: float, discount: float, root: tuple[float, float, float]) -> None:
    """Send each restaurant of two words the probabilities of its dishes one word shorter."""
    held = mail.own(LOW)
    if held is None:
        return
    pairs, _ = held
    at_word, at_one, _, word_part, _, one_part = mail.own(LOW_WORDS)
    customers, tables, _ = (x.astype(np.float64) for x in mail.own(LOW_SEATS))
    at_root, opened, total = low_totals(mail, word_part, one_part)
    chance = np.maximum(1e-12, at_root[at_word] - root[1]) / (root[0] + root[2])
    chance = (np.maximum(0, customers - discount * tables) + (strength + discount * opened[at_one]) * chance) / (strength + total[at_one])
    for peer, (keys,) in mail.of(PARENTS):
        mail.send(peer, part, CHANCES, chance[np.searchsorted(pairs, keys)].astype(np.float32))


def answer(part: int, mail: Mail) -> None:
    """Tables and customers of every sample for what the chunks asked for."""
    high, low, root = mail.own(HIGH), mail.own(LOW), mail.own(ROOT)
    high_seats, low_seats, root_seats = ([x for _, x in mail.of(k)] for k in (HIGH_SEATS, LOW_SEATS, ROOT_SEATS))
    if high is not None:
        opened = [high[2].astype(np.int64) + np.bincount(high[1], tables, len(high[2])).astype(np.int64) for tables, _ in high_seats]
        for peer, (keys,) in mail.of(ASKED_GRAMS):
            at = np.searchsorted(high[0], keys)
            mail.send(peer, part, GRAM_ANSWERS, *(small(tables[at]) for tables, _ in high_seats))
    for peer, (keys,) in mail.of(ASKED_PAIRS):
        columns, none = [], np.zeros(len(keys), np.int64)
        if low is not None:
            low_at = np.minimum(np.searchsorted(low[0], keys), len(low[0]) - 1)
            low_hit = low[0].take(low_at) == keys
        if high is not None:
            high_at = np.minimum(np.searchsorted(high[3], keys), len(high[3]) - 1)
            high_hit = high[3].take(high_at) == keys
        for k in range(SAMPLES):
            dish = [none, none] if low is None else [np.where(low_hit, x.take(low_at), 0) for x in low_seats[k][:2]]
            columns += [*dish, none if high is None else np.where(high_hit, opened[k].take(high_at), 0)]
        mail.send(peer, part, PAIR_ANSWERS, *map(small, columns))
    for peer, (codes, *_) in mail.of(WORDS):
        at = np.searchsorted(root[0], codes)
        mail.send(peer, part, WORD_ANSWERS, root[1][at], *(small(x[at]) for held in root_seats for x in held))


Level = tuple[float, float]  # strength and discount


def scores_of(chunk: Chunk, mail: Mail, total: float, vocabulary: float, samples: list[tuple[Level, Level, Level, float]], tokens: bool) -> pa.Table:
    """Scores of the texts of a chunk. Counts stay in the few bytes that they come in until a block of grams is worked out."""
    chunk.grams()
    chunk.pairs()
    chunk.words()
    length = len(chunk.learn)
    first2 = np.minimum(chunk.first2, length - 1)  # the pair of two starts is no token's
    one, word = chunk.at_one.take(first2), chunk.at1.take(first2)
    chunk.word = chunk.one = chunk.at_one = chunk.first2 = chunk.keys2 = None
    # what all tokens of a pair or of a gram share is worked out once for each
    ahead, shorter = chunk.ahead.take(chunk.first3), chunk.at2.take(chunk.first3)
    grams_held = len(chunk.keys3)
    chunk.ahead = chunk.at2 = chunk.first3 = chunk.keys3 = None
    n, _ = in_order(mail, GRAM_COUNTS)
    kind, _, dynamic, open_two, held_two = in_order(mail, PAIR_CLASSES)
    known, *root = in_order(mail, WORD_ANSWERS)
    multi, asked = np.flatnonzero(n > 1), np.flatnonzero((kind == 2) | dynamic)
    grams, pairs = in_order(mail, GRAM_ANSWERS), in_order(mail, PAIR_ANSWERS)
    chance = np.zeros(grams_held)
    for k, ((s0, d0), (s1, d1), (s2, d2), customers) in enumerate(samples):
        at_root, opened, held = (x.astype(np.float64) for x in root[3 * k : 3 * k + 3])
        p = np.where(at_root > 0, at_root - d0, s0 + d0 * vocabulary) / (s0 + customers)
        count, tables = (kind == 1).astype(np.float64), (kind == 1).astype(np.float64)
        context = open_two.astype(np.float64)
        if len(asked):
            c, t, o = (x.astype(np.float64) for x in pairs[3 * k : 3 * k + 3])
            count[asked], tables[asked] = np.where(c > 0, c, count[asked]), np.where(c > 0, t, tables[asked])
            context[asked] = np.where(dynamic[asked], o, context[asked])
            del c, t, o
        p = (np.maximum(0, count - d1 * tables) + (s1 + d1 * opened).take(one) * p.take(word)) / (s1 + held).take(one)
        del count, tables
        for a in range(0, grams_held, BLOCK):
            some = slice(a, a + BLOCK)
            own, two, less = n[some].astype(np.int64), ahead[some], shorter[some]
            seats = np.minimum(own, 1).astype(np.float64)
            if len(multi):
                i, j = np.searchsorted(multi, (a, a + BLOCK))
                seats[multi[i:j] - a] = grams[k][i:j]
            chance[some] += (np.maximum(0, own - d2 * seats) + (s2 + d2 * context.take(two)) * p.take(less)) / (s2 + held_two.take(two))
    del one, word, ahead, shorter, n, kind, dynamic, open_two, held_two, root, multi, asked, grams, pairs
    chance /= len(samples)
    log_p = np.log10(chance, out=chance).take(chunk.at3)
    del chance
    chunk.at3 = None
    known = known.astype(np.int64)
    size = chunk.sizes
    begin = np.cumsum(size) - size

    def sums(of_words: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_words.take(chunk.at1), begin)

    rows = [sums((known > 0).astype(np.int64)), sums(np.log10((known + 0.1) / (total + 0.1 * (vocabulary + 1)))), np.add.reduceat(log_p, begin)]
    names = ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    arrays = [chunk.ids, *map(pa.array, (chunk.learned, size, rows[0], np.full(len(size), int(total)), rows[1], rows[2]))]
    if tokens:
        arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(log_p)))
        names.append("token_scores")
    return pa.table(arrays, names)


# strengths and discounts


def log_gammas(values: np.ndarray) -> np.ndarray:
    return np.array([lgamma(x) for x in values.tolist()])


def likelihood(counts: dict[int, tuple[np.ndarray, np.ndarray]], opened: int, held: int, sizes: int, strength: float, discount: float) -> float:
    """Log probability of a level's seating, but for what depends on neither parameter."""
    t, tn = counts[opened]
    c, cn = counts[held]
    s, sn = counts[sizes]
    tables = (t - 1) * np.log(discount) + log_gammas(strength / discount + t) - lgamma(strength / discount + 1)
    return float(tn @ tables - cn @ (log_gammas(strength + c) - lgamma(strength + 1)) + sn @ (log_gammas(s - discount) - lgamma(1 - discount)))


def drawn(grid: np.ndarray, weight: np.ndarray, u: float) -> float:
    p = np.exp(weight - weight.max())
    return float(grid[min(len(grid) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), u)))])


def parameters(counts: dict[int, tuple[np.ndarray, np.ndarray]], old: Level, level: int, sweep: int) -> Level:
    """Discount given the strength, then strength given the discount, from their grids."""
    names = ((-1, -2, HELD_ROOT), (OPEN_LOW, HELD_LOW, SIZES_LOW), (OPEN_HIGH, HELD_HIGH, SIZES_HIGH))[level]
    if not len(counts[names[0]][0]):
        return old
    u = uniform(np.array([level, level + 3], np.uint64), sweep)
    strength = old[0]
    discount = drawn(DISCOUNTS, np.array([likelihood(counts, *names, strength, d) for d in DISCOUNTS.tolist()]), u[0])
    strength = drawn(STRENGTHS, np.array([likelihood(counts, *names, s, discount) for s in STRENGTHS.tolist()]), u[1])
    return strength, discount


class Office:
    """Steps of the exchange: mail is written to the shared folder by kind and read by the kinds that a step needs."""

    def __init__(self, stash: Stash, parts: int = 1):
        self.stash, self.at = stash, {}
        # rows say little, so adaptive execution would put all receivers into one task
        self.tasks = max(1, min(2 * parts, TASKS * stash.spark.sparkContext.defaultParallelism))

    def post(self, mail: Callable[[], DataFrame], name: str) -> None:
        path = f"{self.stash.root}/{name}"
        mail().write.mode("overwrite").partitionBy("kind").parquet(path)
        self.stash.sweep()  # nothing refers to the frame any more, so its shuffle files go
        self.at[name] = self.stash.spark.read.schema(MAIL).option("basePath", path).parquet(path)

    def rows(self, rows: Callable[[], DataFrame], name: str) -> DataFrame:
        """A result that is no mail, written too."""
        path = f"{self.stash.root}/{name}"
        frame = rows()
        schema = frame.schema
        frame.write.mode("overwrite").parquet(path)
        del frame
        self.stash.sweep()
        return self.stash.spark.read.schema(schema).parquet(path)

    def kinds(self, name: str, *kinds: int) -> DataFrame:
        return self.at[name].where(F.col("kind").isin(*kinds))

    def drop(self, *names: str) -> None:
        for name in names:
            if self.at.pop(name, None) is not None:
                self.stash.drop(name)
                self.stash.drop(f"lists/{name}")

    def forget(self, name: str, *kinds: int) -> None:
        """Mail that no later step reads."""
        for kind in kinds:
            self.stash.drop(f"{name}/kind={kind}")
            self.stash.drop(f"lists/{name}/kind={kind}")

    def dealt(self, *mail: DataFrame):
        """Mail by receiver."""
        return reduce(DataFrame.unionByName, mail).repartition(self.tasks, "part").groupBy("part")

    def step(self, name: str, work: Callable[[int, Mail], None], *mail: DataFrame) -> None:
        """Every part does its work with its mail."""
        root = self.stash.root

        def run(key: tuple, table: pa.Table) -> pa.Table:
            held = Mail(table, root)
            work(key[0].as_py(), held)
            held.close()
            held.shelve(f"lists/{name}")
            out = held.table()
            tidy()
            return out

        self.post(lambda: self.dealt(*mail).applyInArrow(run, MAIL), name)

    def rows_told(self, *names: str) -> list:
        both = self.kinds(names[0], *range(OPEN_HIGH, SUMS + 1))
        for name in names[1:]:
            both = both.unionByName(self.kinds(name, *range(OPEN_HIGH, SUMS + 1)))
        return both.groupBy("kind", "peer").agg(F.sum("n").alias("n")).collect()

    def told(self, *names: str, before: list = ()) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, int]]:
        """Counts and sums for the driver, with those of rows told before: a few thousand rows whatever the input."""
        counts: dict[int, dict[int, int]] = {}
        for r in [*before, *self.rows_told(*names)]:
            counts.setdefault(r.kind, {})
            counts[r.kind][r.peer] = counts[r.kind].get(r.peer, 0) + r.n
        sums = counts.pop(SUMS, {})
        arrays = {k: (value_of(np.array(sorted(v), np.int64)).astype(np.float64), np.array([v[x] for x in sorted(v)], np.float64)) for k, v in counts.items()}
        return arrays, sums


def extent(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text."""
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return n, total or 0


def parts_for(total: int) -> int:
    """Parts grow with the texts alone: with the partitions of a session, lists between them would grow with their square."""
    return max(1, ceil(total / PART_BYTES))


def chunks(text: str, file: Column, row: Column, n: int, total: int) -> Column:
    """Chunk of every row: by hash of runs of rows that follow each other in a file, about CHUNK_BYTES of text; a LONG text alone.

    The number of chunks grows with rows and bytes alone, however many files hold them.
    """
    several = max(1, ceil(total / CHUNK_BYTES), ceil(n / MOST_ROWS))
    run = max(1, n // (RUNS * several))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return F.when(size > LONG, F.xxhash64(file, row, F.lit(1))).otherwise(F.pmod(F.xxhash64(file, F.floor(row / run)), F.lit(several)))


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", shard: Column | None = None, tokens: bool = False, parts: int | None = None) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row; the rows of `learn` are trained on.

    tokens: also `token_scores`, the log10 probability of every token. shard: chunk that a row belongs to, best of `chunks`; hashed chunks are made
    without it. parts: among how many restaurants are dealt, else that of `parts_for`.
    """
    stash = Stash(docs.sparkSession, "lm")
    root = stash.root
    if shard is None or parts is None:
        _, total = extent(docs, text)
        parts = parts or parts_for(total)
        shard = F.pmod(F.xxhash64(doc_id, text), F.lit(ceil(total / CHUNK_BYTES) or 1)) if shard is None else shard
    office = Office(stash, parts)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), shard.cast("long").alias("shard"))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        held = Mail(None, root)
        ask_grams(Chunk.of_docs(table, parts), key[0].as_py(), held)
        held.shelve("lists/grams")
        out = held.table()
        tidy()
        return out

    def ask(name: str, work: Callable[[Chunk, int, Mail], None], *mail: DataFrame) -> None:
        """Every chunk writes to the parts, with the answers that it has."""
        office.step(name, lambda shard, held: work(Chunk.kept(held, parts), shard, held), office.kinds("grams", TOKENS), *mail)

    office.post(lambda: docs.groupBy("shard").applyInArrow(first, MAIL), "grams")
    office.step("gram-counts", count_grams, office.kinds("grams", GRAMS))
    office.forget("grams", GRAMS)
    ask("pairs", ask_pairs, office.kinds("gram-counts", GRAM_COUNTS))
    office.step("pair-classes", count_pairs, office.kinds("pairs", PAIRS, DISHES))
    office.forget("pairs", PAIRS, DISHES)
    asked = office.kinds("pairs", ASKED_GRAMS)
    ask("words", ask_words, office.kinds("pair-classes", PAIR_CLASSES))
    office.step("dishes", lambda part, mail: gather(part, mail, parts), office.kinds("pair-classes", FOUND_PAIRS), office.kinds("words", LOW_DISHES, WORDS))
    office.forget("pair-classes", FOUND_PAIRS)
    office.forget("words", LOW_DISHES)
    _, sums = office.told("dishes")
    lone_contexts = office.rows_told("pair-classes")
    total, vocabulary = float(sums.get(0, 0)), float(sums.get(1, 0))

    high, low = office.kinds("pair-classes", HIGH, HIGH_PARENTS), office.kinds("dishes", LOW, LOW_WORDS).unionByName(office.kinds("pair-classes", PARENTS))
    words = office.kinds("dishes", ROOT, WORD_REFS)
    levels: list[Level] = [(1.0, 0.5)] * 3
    root_total = 0.0
    samples: list[tuple[Level, Level, Level, float]] = []
    for sweep in range(BURN_IN + SAMPLES + 1):
        top, one, two = levels
        seats = (*top, root_total)
        if sweep:
            last = f"-{sweep - 1}"
            office.step(f"chances-{sweep}", lambda part, mail, one=one, seats=seats: tell_chances(part, mail, *one, seats), low, office.kinds(f"low{last}", LOW_SEATS), office.kinds(f"root{last}", TOTALS))
            office.step(f"high-{sweep}", lambda part, mail, k=sweep, two=two: seat_high(part, mail, k, *two), high, office.kinds(f"high{last}", HIGH_SEATS), office.kinds(f"chances-{sweep}", CHANCES))
            office.drop(f"chances-{sweep}")
            told = [office.kinds(f"low{last}", LOW_SEATS), office.kinds(f"root{last}", TOTALS)]
        else:
            office.step("high-0", lambda part, mail, two=two: seat_high(part, mail, 0, *two), high)
            told = []
        office.step(f"low-{sweep}", lambda part, mail, k=sweep, one=one, seats=seats: seat_low(part, mail, k, *one, seats), low, office.kinds(f"high-{sweep}", SENT_TABLES), *told)
        office.step(f"root-{sweep}", lambda part, mail: seat_root(part, mail), words, office.kinds(f"low-{sweep}", SENT_SUMS))
        if 0 < sweep <= BURN_IN + 1:
            office.drop(f"high{last}", f"low{last}", f"root{last}")
        counts, sums = office.told(f"high-{sweep}", f"low-{sweep}", f"root-{sweep}", before=lone_contexts)
        root_total = float(sums.get(2, 0))
        empty = np.zeros(0), np.zeros(0)
        counts = {k: counts.get(k, empty) for k in range(OPEN_HIGH, SUMS)}
        counts[-1] = (np.array([vocabulary]), np.ones(1)) if vocabulary else empty
        counts[-2] = (np.array([root_total]), np.ones(1)) if vocabulary else empty
        levels = [parameters(counts, old, k, sweep) for k, old in enumerate(levels)]
        if sweep > BURN_IN:
            samples.append((*levels, root_total))

    kept = range(BURN_IN + 1, BURN_IN + SAMPLES + 1)
    office.forget("pair-classes", PARENTS, HIGH_PARENTS)
    office.forget("dishes", LOW_WORDS, WORD_REFS)
    high = office.kinds("pair-classes", HIGH)

    def seats_of(name: str, kind: int) -> list[DataFrame]:
        """Of all samples, whose number stands for the sender."""
        return [office.kinds(f"{name}-{k}", kind).withColumn("peer", F.lit(k).cast("long")) for k in kept]

    # one kind after another, so that what the next does not need is gone before it is dealt
    office.step("word-answers", answer, office.kinds("dishes", ROOT), office.kinds("words", WORDS), *seats_of("root", ROOT_SEATS))
    office.drop(*(f"root-{k}" for k in kept))
    office.forget("dishes", ROOT)
    office.forget("words", WORDS)
    office.step("gram-answers", answer, high, asked, *seats_of("high", HIGH_SEATS))
    office.drop("pairs")
    office.step("pair-answers", answer, high, office.kinds("dishes", LOW), office.kinds("words", ASKED_PAIRS), *seats_of("high", HIGH_SEATS), *seats_of("low", LOW_SEATS))
    office.drop(*(f"{name}-{k}" for k in kept for name in ("high", "low")), "dishes", "words")
    office.forget("pair-classes", HIGH)
    answers = office.kinds("grams", TOKENS)
    for name, kind in (("word-answers", WORD_ANSWERS), ("gram-answers", GRAM_ANSWERS), ("pair-answers", PAIR_ANSWERS), ("gram-counts", GRAM_COUNTS), ("pair-classes", PAIR_CLASSES)):
        answers = answers.unionByName(office.kinds(name, kind))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema += ", token_scores array<double>" if tokens else ""

    def final(table: pa.Table) -> pa.Table:
        held = Mail(table, root)
        found = scores_of(Chunk.kept(held, parts), held, total, vocabulary, samples, tokens)
        held.close()
        tidy()
        return found

    scored = office.rows(lambda: office.dealt(answers).applyInArrow(final, schema), "scores")
    office.drop("grams", "gram-counts", "pair-classes", "word-answers", "gram-answers", "pair-answers")
    return scored
