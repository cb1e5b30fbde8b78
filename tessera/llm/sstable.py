"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier:

    blocks   entries of about BLOCK bytes; each entry: shared key bytes (1), rest of the key
             (length 1, bytes), value length (4), value: little-endian ids of `width` bytes
    index    for each block: first key (9), offset (8), bytes (4), entries (4)
    Bloom    bit set of double-hashed keys
    footer   fixed size: places of index and Bloom filter, counts, width, magic

A key is 1 and the identifier as 8 big-endian bytes with the sign bit flipped, so that byte order is
number order; a null identifier is nine zero bytes and comes first. A lookup asks the Bloom filter,
bisects the block index and reads one block (or the next ones, where copies of a key go on).

Defined cases: a null or empty text holds the end id only; repeated identifiers are all kept, in
order of their text; an empty table gives shards without entries. Tasks write to a name of their own and
rename, so a repeated attempt replaces whole files.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, open_store, pieces, ship, text_buffer

MAGIC = b"TSSTAB01"
FOOTER = struct.Struct("<QQQQIIQ8s")
INDEX = struct.Struct(">9sQII")
BLOCK = 32 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
CACHE_WORDS = 1_000_000  # bounds a Python worker's memory; results don't depend on it
_TOKENIZERS: dict[str, tuple] = {}


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Entries must come in key order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at, self.docs, self.tokens = 0, 0, 0
        self.block, self.held, self.first, self.last, self.n = [], 0, b"", b"", 0
        self.index, self.keys = [], []

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        if self.held and self.held + len(value) > BLOCK:
            self.flush()
        same = 0
        if self.n:
            while same < 9 and key[same] == self.last[same]:
                same += 1
        else:
            self.first = key
        entry = bytes((same, 9 - same)) + key[same:] + struct.pack("<I", len(value)) + value
        self.block.append(entry)
        self.held += len(entry)
        self.n += 1
        if key != self.last or not self.docs:
            self.keys.append(key)
        self.last = key
        self.docs += 1
        self.tokens += len(value) // self.width

    def flush(self) -> None:
        if self.n:
            held = b"".join(self.block)
            self.out.write(held)
            self.index.append(INDEX.pack(self.first, self.at, len(held), self.n))
            self.at += len(held)
            self.block, self.held, self.n = [], 0, 0

    def close(self) -> None:
        self.flush()
        bits = max(64, (len(self.keys) * BLOOM_BITS + 7) // 8 * 8)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[probes(key, bits)] = 1
        index, packed = b"".join(self.index), np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), self.docs, self.tokens, len(self.index), self.width, bits, MAGIC))


class ShardReader:
    """Binary-search lookup and ordered scan of one shard file."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - FOOTER.size)
        at, bloom, self.docs, self.tokens, n, self.width, self.bits, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut off")
        file.seek(at)
        self.index = [INDEX.unpack(x) for x in re.findall(b"(?s).{%d}" % INDEX.size, file.read(n * INDEX.size))]
        self.bloom = file.read(end - FOOTER.size - bloom)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, n = self.index[k]
        self.file.seek(at)
        held, at, key = self.file.read(size), 0, b""
        for _ in range(n):
            same, rest = held[at], held[at + 1]
            key = key[:same] + held[at + 2 : at + 2 + rest]
            at += 2 + rest
            size = int.from_bytes(held[at : at + 4], "little")
            yield key, held[at + 4 : at + 4 + size]
            at += 4 + size

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            for key, value in self.block(k):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document of that identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        firsts = [x[0] for x in self.index]
        k = max(0, bisect.bisect_left(firsts, key) - 1)
        out = []
        while k < len(firsts) and firsts[k] <= key:
            out += [np.frombuffer(v, f"<u{self.width}") for x, v in self.block(k) if x == key]
            k += 1
        return out


def _kinds() -> np.ndarray:
    """1: ASCII letters; 2: ASCII marks that always part from letters and open no special token; 3: white space."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(65, 91), *range(97, 123)]] = 1
    kinds[[*b'.,;:!?()"%$#&*-+=/']] = 2
    kinds[[*b" \n\t\r"]] = 3
    return kinds


KINDS = _kinds()


class WordTokenizer:
    """The tokenizers library, asked once for each distinct segment of many texts.

    A segment is white space and what follows it, cut between ASCII letters and marks: no
    vocabulary piece, normaliser rule or pre-token crosses these places. ASCII capitals are lowered
    first (the normaliser does it anyway), but not before a byte of another alphabet, where
    a combining mark may stand, nor in texts that may hold a special token.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, segments: list[str]) -> list[bytes]:
        """Ids of distinct segments; those not asked for in a whole generation are forgotten."""
        young, old = self.young, self.old
        missing = [x for x in segments if x not in young]
        for x in missing:
            if x in old:
                young[x] = old[x]
        missing = [x for x in missing if x not in old]
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            young.update((w, array("HI"[self.width // 4], e.ids).tobytes()) for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)))
        out = [young[x] for x in segments]
        if len(young) > CACHE_WORDS // 2:
            self.young, self.old = {}, young
        return out

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        data, offsets = text_buffer(texts)
        end = np.array([end_id], self.kind).tobytes()
        if not len(data):
            return [end] * len(texts)
        if b"<|" not in data.tobytes():
            plain = np.append(data[1:] < 0x80, True)
            data = np.where(plain, LOWER[data], data)
        kind = KINDS[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] == 3) & (kind[:-1] != 3) | (kind[1:] + kind[:-1] == 3) & (kind[1:] != 3) & (kind[:-1] != 3)
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        buffers = [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.StringArray.from_buffers(len(starts) - 1, buffers[1], buffers[2]).dictionary_encode()
        held = self.known(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(held), self.kind)
        size = np.array([len(x) for x in held], np.int64) // self.width
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        count = size[which]
        ends = np.cumsum(count)
        ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - (ends - count), count)].tobytes()
        at = (np.append(0, ends)[np.searchsorted(starts, offsets)] * self.width).tolist()
        return [ids[a:b] + end for a, b in zip(at[:-1], at[1:])]


def tokenizer_of(model: str) -> WordTokenizer:
    if model not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[model] = WordTokenizer(model)
    return _TOKENIZERS[model]


def write(df: DataFrame, model_path: str, to: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Plan that encodes whole texts and writes shards to the shared folder `to`; run it once.

    Rows: shard, path, n_docs, n_tokens. Texts are dealt by ranges of the identifier, so shards follow each
    other in ascending order.
    """
    spark = df.sparkSession
    ship(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    ranged = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard = tokenizer_of(model), TaskContext.get().partitionId()
        store, folder = open_store(to)
        store.create_dir(folder, recursive=True)
        path, own = f"{folder}/shard-{shard:06d}.sst", f"{folder}/.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(own, compression=None) as out:
            writer = ShardWriter(out, tokenizer.width)
            for batch in batches:
                for part in pieces(batch):
                    for i, value in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1), end_id)):
                        writer.add(i, value)
            writer.close()
        store.move(own, path)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [f"shard-{shard:06d}.sst"], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    return ranged.mapInArrow(run, "shard long, name string, n_docs long, n_tokens long")


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all shards: start counts the tokens of all documents before.

    ids: little-endian unsigned 32-bit integers. The manifest has one row a shard; only its running
    sum is taken in one task.
    """
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    dealt = manifest.select("shard", "name", F.coalesce(before, F.lit(0)).alias("before")).repartitionByRange(n, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as file:
                    reader = ShardReader(file)
                    rows: list[tuple] = []
                    for k, (i, value) in enumerate(reader.scan(), 1):
                        ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                        rows.append((i, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        if len(rows) == 512 or k == reader.docs:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])
                            rows = []

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(folder: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of a document by binary search in the shards of a folder."""
    from pyarrow import fs

    store, root = open_store(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.base_name):
        if info.base_name.endswith(".sst"):
            with store.open_input_file(info.path) as file:
                if found := ShardReader(file).get(doc_id):
                    return found
    return []
