"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon (learnt from the labels, besides a few fixed words), the
share of its hits with a second-person word within NEAR words, hits after undoing look-alike
characters, capitals, shouted words, punctuation, repeated characters, words that mix letters
with other signs, and size. The trees are fitted by the driver on a sample of at most SAMPLE labelled rows, the
smallest by a hash of their id; a quarter of them only calibrates. Counts for the lexicon cover the
sample as well. Scoring covers every row.

Defined cases: null and empty texts are scored by their features, which are all zero; labels that are null are not
learnt from, of contradicting labels of an id the larger counts; without labels of both kinds every
score is the share of label 1 (0 without any labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pieces, ship, tidy

SAMPLE = 20_000  # bound of the labelled rows that a model is fitted on
LEXICON = 2_000  # bound of the learnt lexicon
NEAR = 6
# fixed values: insults in common use, and second-person words of the languages at hand
SEED_WORDS = "idiot moron stupid dumb loser scum clown pathetic worthless disgusting trash garbage fool imbecile".split()
SECOND_PERSON = set("you your yours u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
LOOK_ALIKE = str.maketrans("013457@$!|+", "oieastasilt")
WORD = re.compile(r"\S+").findall
EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())
NAMES = ("hits", "distinct", "seed_hits", "weight", "top_weight", "near", "disguised", "capitals", "shouted", "punctuation", "calls", "repeated", "mixed", "digits", "size", "mean_word")


def tokens(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    raw = text.split()
    n = max(1, len(raw))
    words = [w.strip(EDGE) for w in text.lower().split()]
    get = lexicon.get
    hits = [(k, w) for k, w in enumerate(words) if w in lexicon]
    weights = [get(w) for _, w in hits]
    near = 0
    for k, _ in hits:
        near += not SECOND_PERSON.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1])
    odd = [w for w in words if not w.isalpha()]
    mixed = [w for w in odd if any(map(str.isalpha, w))]
    disguised = sum(w.translate(LOOK_ALIKE).replace("*", "") in lexicon for w in mixed)
    upper = sum(map(str.isupper, raw))
    signs = sum(text.count(c) for c in ".,;:!?*#$%&")
    return [
        100 * len(hits) / n,
        len({w for _, w in hits}),
        100 * sum(w in SEEDS for _, w in hits) / n,
        math.log1p(sum(weights)),
        max(weights, default=0.0),
        near / n * 100,
        disguised / n * 100,
        sum(map(str.isupper, text)) / len(text),
        upper / n,
        signs / len(text),
        (text.count("!") + text.count("?")) / n,
        len(REPEATED(text)) / n,
        len(mixed) / n,
        sum(map(str.isdigit, text)) / len(text),
        math.log1p(n),
        len(text) / n,
    ]


SEEDS = set(SEED_WORDS)
REPEATED = re.compile(r"([^\W\d_])\1{3,}").findall


@dataclass
class Trees:
    """Boosted regression trees of logistic loss over binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    base: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, least: float = 8.0, ridge: float = 1.0) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 64))) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        wide = max(len(e) for e in self.edges) + 1
        p = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        raw = np.full(len(y), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            tree: list[tuple[int, float, int, int, float]] = []
            todo = [(np.arange(len(y)), 0, None)]
            while todo:
                rows, level, parent = todo.pop(0)
                me = len(tree)
                if parent is not None:
                    at, side = parent
                    node = list(tree[at])
                    node[2 + side] = me
                    tree[at] = tuple(node)
                value = rate * g[rows].sum() / (h[rows].sum() + ridge)
                tree.append((-1, 0.0, -1, -1, value))
                if level < depth and len(rows) >= 2 * least:
                    best = (1e-6, -1, -1)
                    for f in range(x.shape[1]):
                        gs = np.cumsum(np.bincount(bins[rows, f], g[rows], wide))
                        hs = np.cumsum(np.bincount(bins[rows, f], h[rows], wide))
                        ns = np.cumsum(np.bincount(bins[rows, f], minlength=wide))
                        gain = gs**2 / (hs + ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                        gain[(ns < least) | (ns[-1] - ns < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], f, k)
                    if best[1] >= 0:
                        _, f, k = best
                        cut = self.edges[f][min(k, len(self.edges[f]) - 1)]
                        tree[me] = (f, float(cut), -1, -1, value)
                        left = bins[rows, f] <= k
                        todo += [(rows[left], level + 1, (me, 0)), (rows[~left], level + 1, (me, 1))]
            self.trees.append(tree)
            raw += self.leaf(tree, x)
        return self

    @staticmethod
    def leaf(tree, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), np.int64)
        for _ in range(64):
            inner = feature[at] >= 0
            if not inner.any():
                break
            goes = x[np.arange(len(x)), feature[at]] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self.leaf(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x by pooling adjacent violators."""
    by = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[by].tolist(), y[by].tolist()):
        blocks.append([a, a, b, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            _, high, s, n = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = high, blocks[-1][2] + s, blocks[-1][3] + n
    xs = [v for b in blocks for v in (b[0], b[1])]
    # one more label of the usual share in every pool: a pool of a few rows decides nothing
    share = y.mean()
    ys = [v for b in blocks for v in [(b[2] + share) / (b[3] + 1)] * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        return np.interp(self.trees.raw(x), *self.knots)


def count_words(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(word, n): texts of the sample that hold the word, of one kind of label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held = set(tokens(text or ""))
                found.update(held if only is None else held & only)
        found.pop("", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return sample.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    ship(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    totals = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sum(n for k, n in totals.items() if k > 0), totals.get(0, 0)
    if not bad or not good:
        return ToxicityModel({}, None, None, bad / max(1, bad + good))
    # a word counts if it stands in one of 60 toxic texts at least
    often = count_words(rows.where("toxic > 0"), None).where(F.col("n") >= max(3, bad / 60)).collect()
    held = {r.word: r.n for r in often}
    clean = {r.word: r.n for r in count_words(rows.where("toxic = 0"), frozenset(held)).collect()}
    weight = {w: math.log((n + 0.5) / (bad + 1)) - math.log((clean.get(w, 0) + 0.5) / (good + 1)) for w, n in held.items()}
    lexicon = {w: x for w, x in sorted(weight.items(), key=lambda p: (-p[1], p[0]))[:LEXICON] if x > 1.2}
    lexicon |= {w: 3.0 for w in SEED_WORDS if w not in lexicon}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column(0).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["toxic", "fold", "x"])

    found = rows.select("text", "toxic", "fold").mapInArrow(run, "toxic int, fold long, x binary").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist())).reshape(-1, len(NAMES))
    y = (found["toxic"].to_numpy() > 0).astype(float)
    fold = found["fold"].to_numpy()
    by = np.lexsort((*x.T, y, fold))  # an order that doesn't depend on tasks
    x, y, fold = x[by], y[by], fold[by]
    fit = fold > 0 if 0 < y[fold == 0].mean() < 1 and 0 < y[fold > 0].mean() < 1 else np.ones(len(y), bool)
    trees = Trees().fit(x[fit], y[fit])
    rest = ~fit if not fit.all() else fit
    return ToxicityModel(lexicon, trees, isotonic(trees.raw(x[rest]), y[rest]), bad / (bad + good))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with the toxicity of their whole texts in a column `toxicity`, which replaces one of that name."""
    ship(docs.sparkSession)
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                x = np.array([features(t, model.lexicon) for t in texts]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x), pa.float64())], names=[*part.schema.names, "toxicity"])
        tidy()

    return docs.mapInArrow(run, schema)
