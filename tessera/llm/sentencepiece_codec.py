"""SentencePiece BPE encoding and decoding with numpy merge rounds.

A text is cut where no vocabulary piece can cross: before a run of spaces and around line ends
without a piece of their own. Every distinct segment of a batch is encoded once. Encoding keeps
all segments of a batch in one flat symbol array; each round ranks all neighbouring pairs, takes
the segmented minimum of every segment, merges its leftmost occurrence (and further ones as far
as no merge makes a better pair), and compacts, until no pair remains. In a long segment the minimum is taken
around each pair as far as the longest piece reaches: no piece that a better pair elsewhere may grow into can touch
it before its turn. So distant parts merge side by side, and parts without pairs are closed.

Defined cases: a null or empty text gives only the end id and decodes to ''; other columns pass
through, those of a result's name are replaced; ties in rank go to the leftmost pair, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import pieces, ship, sliding_least, text_buffer, tidy

NO_RANK = np.iinfo(np.int32).max
LONG = 400  # symbols from which a segment is merged by neighbourhoods
CACHE_SEGMENTS = 600_000  # bounds a Python worker's memory; results don't depend on it
_MODELS: dict[bytes, PieceModel] = {}


class PieceModel:
    """Vocabulary, pair ranks and byte forms of a SentencePiece BPE model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size, self.eos, unk = sp.get_piece_size(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        normal = {p: i for i, p in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any("▁" in p.lstrip("▁") for p in normal):
            raise ValueError("pieces that cross a word's start are not supported")
        if sp.encode("A  ") != sp.encode("A") + [normal["▁▁"]]:
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if unk in self.byte_ids:
            raise ValueError("a model with byte fallback is needed")
        order = sorted(normal.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank_of = np.full(self.size, NO_RANK, np.int32)
        self.rank_of[order] = np.arange(len(order))
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.reach = 2 * max(len(p) for p in normal) + 2
        left, right, made = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if (a := normal.get(p[:cut])) is not None and (b := normal.get(p[cut:])) is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by], np.array(made, np.int32)[by]
        if any(len(p) > 1 and any(self.char_id[ord(c)] < 0 for c in p) for p in normal):
            raise ValueError("pieces with characters outside the vocabulary are not supported")
        raw = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.lone_lines = bool(self.char_id[10] < 0)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece made of each pair, and its rank (NO_RANK: none)."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        hit = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        made = np.where(hit, self.pair_made[at], -1)
        return made, np.where(hit, self.rank_of[made], NO_RANK)

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids (int32, native order) of each segment; a space stands for the word mark."""
        if not segments:
            return []
        joined = "".join(segments).replace(" ", "▁")
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(s) for s in segments], np.int64)
        word = np.repeat(np.arange(len(segments), dtype=np.int64), size)
        sym, word = self.char_id[code], word
        # characters outside the vocabulary: minus (code point + 2)
        sym = np.where(sym < 0, -(code.astype(np.int32)) - 2, sym)
        done_sym, done_word = [], []
        for k in np.flatnonzero(size > LONG).tolist():
            done_sym.append(self.merged_apart(sym[word == k]))
            done_word.append(np.full(len(done_sym[-1]), k, np.int64))
        short = size[word] <= LONG
        sym, word = sym[short], word[short]
        while len(sym):
            made, rank = self.pairs(sym[:-1], sym[1:])
            rank[word[1:] != word[:-1]] = NO_RANK
            rank = np.append(rank, NO_RANK).astype(np.int32)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(sym)))
            best_here = np.repeat(best, length)
            open_ = best_here < NO_RANK
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                if not open_.any():
                    sym, word = sym[:0], word[:0]
                    break
                sym, word, rank, best_here = sym[open_], word[open_], rank[open_], best_here[open_]
                made = np.append(made, -1)[open_]
                starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                length = np.diff(np.append(starts, len(sym)))
            else:
                made = np.append(made, -1)
            hit = np.flatnonzero(rank == best_here)
            # of overlapping occurrences every other one, from the left
            run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[within % 2 == 0]
            new = made[hit]
            before, after = hit - 1, hit + 2
            left = np.where(before >= 0, sym[before], -1)
            joins = np.append(False, hit[1:] == hit[:-1] + 2)
            left = np.where(joins, np.append(-1, new[:-1]), left)
            left = np.where((before >= 0) & (word[before] == word[hit]), left, -1)
            inside = after < len(sym)
            at = np.where(inside, after, 0)
            right = np.where(inside & (word[at] == word[hit]), sym[at], -1)
            worse = np.minimum(self.pairs(left, new)[1], self.pairs(new, right)[1]) < rank[hit]
            # a better pair arises at `worse`: later occurrences of that segment wait
            owner = word[hit]
            lead = np.append(True, owner[1:] != owner[:-1])
            ahead = np.cumsum(worse) - worse
            first = np.flatnonzero(lead)
            base = np.repeat(ahead[first], np.diff(np.append(first, len(hit))))
            go = hit[ahead == base]
            sym[go] = made[go]
            keep = np.ones(len(sym), bool)
            keep[go + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        by = np.argsort(word, kind="stable")
        sym, word = sym[by], word[by]
        if (sym < 0).any():
            sym, word = self.fall_back(sym, word)
        ends = np.searchsorted(word, np.arange(len(segments) + 1)) * 4
        held = sym.astype(np.int32).tobytes()
        return [held[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def merged_apart(self, sym: np.ndarray) -> np.ndarray:
        """Symbols of one long segment after all merges; each round merges every pair that is the best within reach."""
        place, near = np.arange(len(sym)), self.reach
        made, rank = (np.append(x, y) for x, y in zip(self.pairs(sym[:-1], sym[1:]), (-1, NO_RANK)))
        rank = rank.astype(np.int32)
        joined = np.append(np.ones(len(sym) - 1, bool), False)  # to the next symbol of the array
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pad = np.full(near, NO_RANK, np.int32)
        while True:
            low = sliding_least(np.concatenate([pad, rank, pad]), 2 * near + 1)
            live = low < NO_RANK
            if not live.all():
                live[1:] |= live[:-1]
                done.append((place[~live], sym[~live]))
                if not live.any():
                    break
                joined = (joined & np.append(live[1:], False))[live]
                sym, place, rank, made, low = (x[live] for x in (sym, place, rank, made, low))
            hit = np.flatnonzero((rank == low) & (rank < NO_RANK))
            run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[within % 2 == 0]
            new = made[hit]
            joins = np.append(False, hit[1:] == hit[:-1] + 2)
            left = np.where(joins, np.append(-1, new[:-1]), sym[np.maximum(0, hit - 1)])
            left = np.where((hit > 0) & joined[np.maximum(0, hit - 1)], left, -1)
            right = np.where(joined[hit + 1], sym[np.minimum(hit + 2, len(sym) - 1)], -1)
            worse = np.minimum(self.pairs(left, new)[1], self.pairs(new, right)[1]) < rank[hit]
            # of equal pairs within reach the left one comes first: whoever is right of one that has to wait,
            # or of a merge that makes a better pair, waits too
            held_up = sliding_least(np.append(pad, np.where(rank > low, rank, NO_RANK).astype(np.int32)), near + 1)[hit] == rank[hit]
            lead = np.flatnonzero(np.append(True, np.diff(hit) > near))
            ahead = np.cumsum(worse) - worse + np.cumsum(held_up)
            base = (ahead - held_up)[lead]
            go = hit[ahead == np.repeat(base, np.diff(np.append(lead, len(hit))))]
            sym[go] = made[go]
            joined[go] = joined[go + 1]
            keep = np.ones(len(sym), bool)
            keep[go + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[go] = True
            sym, place, rank, made, joined, fresh = (x[keep] for x in (sym, place, rank, made, joined, fresh))
            again = np.flatnonzero(fresh | np.append(fresh[1:], False))
            after = np.minimum(again + 1, len(sym) - 1)
            made[again], rank[again] = self.pairs(sym[again], np.where(joined[again], sym[after], -1))
        place, sym = (np.concatenate(x) for x in zip(*done))
        return sym[np.argsort(place)]

    def fall_back(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters outside the vocabulary by the ids of their UTF-8 bytes."""
        code = np.where(sym < 0, -(sym.astype(np.int64)) - 2, 0)
        width = np.where(sym >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        out, owner = np.repeat(sym, width), np.repeat(word, width)
        which = np.flatnonzero(np.repeat(sym < 0, width))
        raw = np.frombuffer("".join(map(chr, code[sym < 0].tolist())).encode("utf-8"), np.uint8)
        out[which] = self.byte_ids[raw]
        return out, owner

    def known(self, segments: list[str]) -> list[bytes]:
        """Ids of distinct segments; those not asked for in a whole generation are forgotten."""
        young, old = self.young, self.old
        missing = [x for x in segments if x not in young]
        for x in missing:
            if x in old:
                young[x] = old[x]
        missing = [x for x in missing if x not in old]
        young.update(zip(missing, self.encode_segments(missing)))
        out = [young[x] for x in segments]
        if len(young) > CACHE_SEGMENTS // 2:
            self.young, self.old = {}, young
        return out

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of many texts, each with its end id, and their n+1 offsets."""
        data, offsets = text_buffer(pa.array([(" " + t.replace("▁", " ")) if t else "" for t in texts], pa.string()))
        n = len(texts)
        if not len(data):
            return np.full(n, self.eos, np.int32), np.arange(n + 1)
        gap = data == 32
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = gap[1:] & ~gap[:-1]
        if self.lone_lines:
            line = data == 10
            cut[1:-1] |= line[1:] != line[:-1]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        coded = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        held = self.known(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(held), np.int32)
        size = np.array([len(x) for x in held], np.int64) >> 2
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        count = size[which]
        ends = np.cumsum(count)
        ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - (ends - count), count)]
        at = np.append(0, ends)[np.searchsorted(starts, offsets)]
        out = np.full(len(ids) + n, self.eos, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        return out, at + np.arange(n + 1)

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each row of ids; one leading space, the dummy prefix, goes."""
        size = self.raw_len[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_at[ids] - (ends - size), size)
        held = self.raw[at].tobytes()
        cut = np.append(0, ends)[offsets].tolist()
        out = []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            part = held[a + 1 : b] if held[a : a + 1] == b" " and a < b else held[a:b]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:  # ids that no text gives: the library's replacement rules
                out.append(self.sp.decode(ids[offsets[k] : offsets[k + 1]].tolist()))
        return out


def model_of(proto: bytes) -> PieceModel:
    """The model, once a Python worker."""
    if proto not in _MODELS:
        _MODELS.clear()
        _MODELS[proto] = PieceModel(proto)
    return _MODELS[proto]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its whole texts; the model file is read by the driver and sent with the tasks."""
    ship(df.sparkSession)
    df = df.drop(ids)
    with open(model_path, "rb") as f:
        proto = f.read()
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto)
        for batch in batches:
            for part in pieces(batch, 2 << 20, text):
                flat, offsets = model.encode_texts(part.column(part.schema.get_field_index(text)).to_pylist())
                held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, held], names=[*part.schema.names, ids])
        tidy()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids decode to ''."""
    ship(df.sparkSession)
    df = df.drop(text)
    with open(model_path, "rb") as f:
        proto = f.read()
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(part.schema.get_field_index(ids))
                size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False)
                out = model.decode_flat(flat, np.append(0, np.cumsum(size)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with ids and decoded text instead of its text, in one pass of one Python worker a task."""
    ship(df.sparkSession)
    with open(model_path, "rb") as f:
        proto = f.read()
    kept = [f for f in df.schema.fields if f.name not in (text, ids, decoded, "same")]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False), T.StructField("same", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(proto)
        for batch in batches:
            for part in pieces(batch, 2 << 20, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                flat, offsets = model.encode_texts(texts)
                out = model.decode_flat(flat, offsets)
                held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                same = pa.array([a == (b or "") for a, b in zip(out, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), held, pa.array(out, pa.string()), same], names=schema.names)
        tidy()

    return df.mapInArrow(run, schema)
