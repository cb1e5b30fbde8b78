"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts the n-grams (3 and 4 bytes, letters only, words padded) of every labelled text,
in CODES counters a language, summed over all documents. A language contains an n-gram that makes at
least RATE of its n-grams, so at most 1 / RATE of them, whatever the input. The filters of all
languages share their slots: slot i holds bit i of every language's filter side by side, and the
conjunction of an n-gram's slots is the mask of all languages that contain it. A text's bits are
counted per language, corrected by each filter's rate of false positives, and the largest share decides.

Defined cases: texts without a letter, null or empty ones are `und` with score 0; so is everything
if no text has a language. Equal shares go to the language with more training texts, then by name. score: the largest
corrected share over the sum of the two largest. Rows, repeated ones too, come back one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, Stash, mix64, pieces, text_buffer

SIZES = (3, 4)
CODE_BITS = 20
BLOCK = 1 << 16
RATE = 4e-6
HASHES = 3
SLOT_BITS = 21


def _folded() -> np.ndarray:
    """Lower case; other ASCII bytes than letters are gaps."""
    out = LOWER.copy()
    out[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32
    return out


FOLDED = _folded()


def gram_codes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the codes of all n-grams of a batch and the number of their text."""
    data, offsets = text_buffer(texts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)
    held = np.full(len(owner), 32, np.uint8)
    held[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = FOLDED[data]
    wide, gap = held.astype(np.uint32), held == 32
    for n in SIZES:
        m = len(held) - n + 1
        if m <= 0:
            continue
        packed = wide[:m].copy()
        for j in range(1, n):
            packed <<= np.uint32(8)
            packed |= wide[j : j + m]
        # gaps side by side say nothing, nor does an n-gram of two texts
        use = owner[:m] == owner[n - 1 :]
        for j in range(n - 1):
            use &= ~(gap[j : j + m] & gap[j + 1 : j + 1 + m])
        at = np.flatnonzero(use)
        x = (packed[at] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        yield x >> np.uint32(32 - CODE_BITS), owner[:m][at]


@dataclass
class LanguageModel:
    languages: list[str]  # by number of training texts
    slots: np.ndarray  # one row of masks for every 64 languages, a mask a slot
    false_rate: np.ndarray


def probes(codes: np.ndarray) -> list[np.ndarray]:
    """Slots of each code."""
    x = mix64(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [(x >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1) for k in range(HASHES)]


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Model of all rows of docs with a language; what the driver gets has a fixed size for each language."""
    stash = Stash(docs.sparkSession, "langid")
    docs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for part in pieces(batch):
                names, which = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                for name, n in zip(names, np.bincount(which, minlength=len(names)).tolist()):
                    seen[name] = seen.get(name, 0) + n
                for codes, owner in gram_codes(part.column(1)):
                    both = np.bincount(which[owner] << CODE_BITS | codes, minlength=len(names) << CODE_BITS).reshape(len(names), -1)
                    for name, counts in zip(names, both):
                        held[name] = held[name] + counts if name in held else counts
        for name, counts in held.items():
            for k, part in enumerate(counts.reshape(-1, BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([seen[name] if not k else 0], pa.int64()), pa.array([int(part.sum())], pa.int64()), pa.array([zlib.compress(part.astype(np.int64).tobytes(), 1)], pa.binary())], names=["lang", "block", "texts", "grams", "counts"])

    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    counted = stash.keep(docs.coalesce(tasks).mapInArrow(count, "lang string, block int, texts long, grams long, counts binary"), "counts")
    totals = {r.lang: (r.texts, r.grams) for r in counted.groupBy("lang").agg(F.sum("texts").alias("texts"), F.sum("grams").alias("grams")).collect()}
    languages = sorted(totals, key=lambda x: (-totals[x][0], x))

    def contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, k, raw in zip(*(x.to_pylist() for x in batch.columns)):
                counts = np.frombuffer(zlib.decompress(raw), np.int64)
                held[name, k] = held[name, k] + counts if (name, k) in held else counts
        for (name, k), counts in held.items():
            codes = np.flatnonzero(counts >= max(2, RATE * totals[name][1])).astype(np.int32) + k * BLOCK
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([codes.tobytes()], pa.binary())], names=["lang", "codes"])

    rows = counted.select("lang", "block", "counts").repartition("lang", "block").mapInArrow(contained, "lang string, codes binary").collect()
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), kind)
    for r in rows:
        word, bit = divmod(languages.index(r.lang), 64)
        for p in probes(np.frombuffer(r.codes, np.int32)):
            slots[word, p] |= kind(1 << bit)
    fill = np.array([np.count_nonzero(slots[k // 64] & kind(1 << k % 64)) for k in range(len(languages))]) / (1 << SLOT_BITS)
    stash.drop()
    return LanguageModel(languages, slots, fill**HASHES)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row; these two replace kept ones of their names."""
    kept = tuple(c for c in kept if c not in ("lang_pred", "score"))
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    n = len(model.languages)
    languages, packed, false_rate = model.languages, zlib.compress(model.slots.tobytes(), 1), model.false_rate
    kind = model.slots.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.frombuffer(zlib.decompress(packed), kind).reshape(-1, 1 << SLOT_BITS)
        # mask of every code: the conjunction of its slots, looked up once a task
        masks = np.bitwise_and.reduce([slots[:, p] for p in probes(np.arange(1 << CODE_BITS))])
        for batch in batches:
            for part in pieces(batch, 2 << 20, text):
                texts = part.column(part.schema.get_field_index(text))
                hits = np.zeros((part.num_rows, max(1, n)))
                total = np.zeros(part.num_rows)
                for codes, owner in gram_codes(texts):
                    total += np.bincount(owner, minlength=part.num_rows)
                    for k in range(n):
                        if not k % 64:
                            mask = masks[k // 64][codes]
                        hits[:, k] += np.bincount(owner, weights=mask >> kind.type(k % 64) & kind.type(1), minlength=part.num_rows)
                share = hits[:, :n] / np.maximum(1, total)[:, None]
                share = np.maximum(0, (share - false_rate) / np.maximum(1e-9, 1 - false_rate)) if n else np.zeros((part.num_rows, 1))
                best = share.argmax(axis=1)
                first = share.max(axis=1)
                two = np.sort(share, axis=1)[:, -2:].sum(axis=1)
                score = np.where(two > 0, first / np.maximum(two, 1e-12), 0.0)
                letters = [bool(t) and (t.isalpha() or any(map(str.isalpha, t))) for t in texts.to_pylist()]
                names = [languages[k] if ok and n else "und" for k, ok in zip(best.tolist(), letters)]
                score = np.where(np.array(letters, bool) & (n > 0), score, 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, text).mapInArrow(run, schema)
