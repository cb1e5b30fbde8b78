"""Operators on small tables against brute force, with nulls, ties, repeats, long texts and odd columns."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, neighbours, ngram_join, pitman_yor, queries, repeats, sentencepiece_codec, sstable, toxicity, warc
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, rows int"


def table(spark, texts, langs=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], (langs or {}).get(k, "en"), "s", 1, 7, "x", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def rows_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def odd_texts():
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    texts = [None, "", " \n", "one", "ONE", "a b c", "x " * 4000, " ".join(base), " ".join(base)]
    for k in range(40):  # a group of near copies, some beyond the threshold
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"new{k}_{rng.randint(0, 999)}"
        texts.append(" ".join(w))
    line = " ".join(f"common{j}" for j in range(30))
    texts += [line + " " + " ".join(f"d{k}_{j}" for j in range(60)) for k in range(30)]
    return texts


def test_ngram_join(spark):
    texts = odd_texts()
    want = components({k: shingles(t) for k, t in enumerate(texts)})
    got = ngram_join.join(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(shingles(t)), want[k]) for k, t in enumerate(texts)}
    assert ngram_join.join(table(spark, texts).limit(0)).count() == 0


def test_op2_on_documents(spark):
    docs = rows_of(spark)
    want = components({i: shingles(t) for i, t in docs})
    assert {r.doc_id: r.component_id for r in queries.op2_ngram_join(spark, SF).collect()} == want


def test_every_link_counts(spark, monkeypatch):
    """Links between different texts of one component, not of a hub alone; against brute force, in one block and in many."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words, "x1"]), " ".join([*words, "y1 y2"]), " ".join(words[:50]), " ".join(words[:44]), " ".join(words), "one two three", "one  two three", ""]
    texts += [" ".join([*words[4:], *(f"n{k}" for k in range(j))]) for j in range(1, 9)]
    sets = [frozenset(zip(*(t.split()[j:] for j in range(5)))) if len(t.split()) >= 5 else frozenset([tuple(t.split())] if t else []) for t in texts]
    kinds = set(sets)
    want = {k: sum(100 * len(s & o) >= 75 * len(s | o) for o in kinds if o != s and s and o) for k, s in enumerate(sets)}
    assert max(want.values()) > 3
    for size in (256, 2):
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", size)
        assert {r.doc_id: r.n_links for r in ngram_join.join(table(spark, texts)).collect()} == want


def without_repeats(docs, n=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if raw[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            else:
                seen.add(raw[k : k + n])
        out[i] = (bytes(x for x, g in zip(raw, gone) if not g), sum(b and not a for a, b in zip(bytes(1) + bytes(gone), gone)))
    return out


def test_repeats(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(60, 300))) for _ in range(8)]
    texts = [None, "", "é" * 120, "a" * 500, "xyz" * 90]
    for _ in range(40):
        texts.append("".join(rng.choice([rng.choice(passages), "q" * rng.randint(1, 160), "".join(rng.choice("abc") for _ in range(70))]) for _ in range(rng.randint(0, 5))))
    texts.append(texts[7])
    want = without_repeats(list(enumerate(texts)))
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in repeats.remove(table(spark, texts)).collect()}
    assert got == want
    # rows that share an identifier, or have none, count as documents of their own, in order of text
    twice = passages[0] * 2
    same = table(spark, [(5, "p" * 50 + twice), (5, twice), (None, twice)])
    want = without_repeats([(0, twice), (1, twice), (2, "p" * 50 + twice)])
    assert sorted((str(r.doc_id), len(r.kept)) for r in repeats.remove(same).collect()) == sorted([("None", len(want[0][0])), ("5", len(want[1][0])), ("5", len(want[2][0]))])


def test_repeats_of_a_hot_anchor(spark, monkeypatch):
    """A passage that ends in another way in each document: its boundary slices share an anchor and are dealt string by string."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    texts = ["".join(rng.choice("klmno ") for _ in range(rng.randint(0, 90))) + passage[: rng.randint(300, 400)] + "".join(rng.choice("pqrst ") for _ in range(rng.randint(0, 150))) for _ in range(120)]
    want = without_repeats(list(enumerate(texts)))
    for hot in (3, 1000):
        monkeypatch.setattr(repeats, "HOT", hot)
        assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in repeats.remove(table(spark, texts)).collect()} == want


def test_repeats_in_a_text_of_20_mib(spark):
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 700, np.uint8)).decode()
    long = bytes(rng.integers(97, 123, 17 << 20, np.uint8)).decode()
    texts = [passage, long + passage[:500] + long[: 3 << 20]]
    got = {r.doc_id: (len(r.kept), [(x.start, x.end) for x in r.spans]) for r in repeats.remove(table(spark, texts)).collect()}
    assert got == {0: (700, []), 1: (17 << 20, [(17 << 20, len(texts[1]))])}


def test_op6_on_documents(spark):
    want = without_repeats(rows_of(spark))
    for r in queries.op6_suffix_dedup(spark, SF).collect():
        kept, spans = want[r.doc_id]
        assert (r.kept_sha256, r.n_spans, r.n_removed) == (hashlib.sha256(kept).hexdigest(), spans, r.n_bytes - len(kept))


def test_op1_and_op5(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    docs = sorted(rows_of(spark))
    sp = SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    for i, t in docs:
        ids = [*sp.encode(t or ""), 2]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    words = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_MODEL))
    got = {r.doc_id: r for r in queries.op5_token_shards(spark, SF).collect()}
    start = 0
    for i, t in docs:
        ids = np.array([*words.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_codec_and_shards_on_odd_rows(spark, tmp_path):
    texts = [*odd_texts()[:8], (3, "again"), (None, "no id")]
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, texts), path), path).collect()
    assert all(r.decoded == (r.text or "") and r.key == "x" for r in coded)
    folder = str(tmp_path / "s")
    manifest = spark.createDataFrame(sstable.write(table(spark, texts), queries.tokenizer_path(queries.WORD_MODEL), folder, shards=3).collect())
    back = sstable.read(spark, manifest, folder).orderBy("start").collect()
    assert len(back) == len(texts) and back[0].doc_id is None and len(sstable.lookup(folder, 3)) == 2
    empty = sstable.write(table(spark, texts).limit(0), queries.tokenizer_path(queries.WORD_MODEL), str(tmp_path / "e"), shards=2)
    assert sstable.read(spark, spark.createDataFrame(empty.collect(), empty.schema), str(tmp_path / "e")).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    docs = table(spark, [None, "", "x Alpha, beta gamma delta; then epsilon zeta eta theta. " + "word " * 30_000, "alpha beta gamma", (9, "nothing here")])
    rows = decontaminate.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.covered, r.key) for r in rows} == {(2, 1, 8, "x")} and len(rows) == 2
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def test_op3_on_documents(spark):
    found = {r.doc_id for r in queries.op3_decontaminate(spark, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, t in rows_of(spark) if any(b in t for b in items)} <= found


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype("float32")
    x[300:330] = x[10]  # more equal vectors than are asked for
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [1.0] * 15 + [float("nan")]), (1060, [1.0] * 3), (1080, [1.0] * 15 + [None]), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    hit, exact = 0, lambda a, b: float(functools.reduce(lambda t, j: t + a[j] * b[j], range(16), 0.0))
    for q in range(0, 600, 20):
        s = np.array([exact(y[q], v) for v in y])
        s[q] = -np.inf
        want = np.argsort(-s, kind="stable")[:20]
        hit += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(abs(score - y[v] @ y[q]) < 1e-9 for v, score in got[q]) and len(got[q]) == 20
        # of what was found: nearest first, equal scores by id, and of equal vectors the smallest ids
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0])) and len({s for v, s in got[q] if v == 10 or 300 <= v < 330}) <= 1
        copies = sorted(v for v, _ in got[q] if v == 10 or 300 <= v < 330)
        assert copies == [v for v in [10, *range(300, 330)] if v != q][: len(copies)]
        if set(want.tolist()) == {v for v, _ in got[q]}:
            assert [v for v, _ in got[q]] == want.tolist() and [score for _, score in got[q]] == s[want].tolist()
    assert set(got) == set(range(0, 600, 20)) and hit / (20 * 30) >= 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert len(neighbours.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()) == 4


def test_op4_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(vectors.embedding.values).astype(float), vectors.vec_id.values
    got = queries.op4_neighbours(spark, SF).toPandas()
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(ids[np.argsort(-s, kind="stable")[:20]]) & set(got.vec_id[got.query_id == ids[q]]))
    assert hit / len(got) >= 0.9


def test_op7_equals_sql(spark):
    for name, sql in queries.ORACLES.items():
        assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), sql)


def test_revisits(spark):
    tag = {"etag": '"a"'}
    rows = [
        ("r1", "response", "http://A.com:80/x?b=2&a=1#f", "2020-01-01T00:00:00Z", 200, tag, b"one"),
        ("r2", "response", "http://a.com/x?a=1&b=2", "2020-02-01T00:00:00Z", 200, tag, b"two"),
        ("r2", "response", "http://a.com/x?a=1&b=2", "2020-02-01T00:00:00Z", 200, tag, b"two"),
        ("r3", "response", "http://a.com/x?a=1&b=2", "2020-03-01T00:00:00Z", 404, tag, b"none"),
        ("v1", "revisit", "HTTP://a.com/x?a=1&b=2", "2020-01-15T00:00:00Z", 304, {"etag": 'W/"a"', "vary": "q", "server": "s"}, None),
        ("v2", "revisit", "http://a.com/x?a=1&b=2", "2020-04-15T00:00:00Z", 304, {"etag": '"b"'}, None),
        ("v3", "revisit", "http://a.com/x?a=1&b=2", "2020-04-15T00:00:00Z", 304, None, None),
        ("v4", "revisit", "http://a.com/x?a=1&b=2", "2020-01-01T00:00:00Z", 304, tag, None),
        ("v5", "revisit", None, None, 304, tag, None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert {k: (r.original_id, r.outcome) for k, r in got.items()} == {"v1": ("r1", "resolved"), "v2": ("r2", "mismatch"), "v3": ("r2", "unchecked"), "v4": (None, "no_original"), "v5": (None, "no_original")}
    assert bytes(got["v1"].body) == b"one" and got["v1"].headers == {"etag": 'W/"a"', "vary": "q"} and got["v2"].body is None


def test_languages(spark):
    en, fr = "the and of that with this have from they will", "le la les des une dans pour avec sur pas"
    texts = [en, fr] * 30 + [None, "", "123 !?", "the", "é", "avec " * 20_000]
    langs = {k: ("en", "fr")[k % 2] for k in range(60)} | {60: None, 61: None}
    docs = table(spark, texts, langs)
    model = langid.train(docs.where("doc_id < 50"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert all(got[k][0] == ("en", "fr")[k % 2] for k in range(60)) and got[65][0] == "fr" and got[63][0] == "en"
    assert got[60] == got[61] == got[62] == ("und", 0.0) and got[64][0] in ("en", "fr")
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_many_languages(spark):
    rng = random.Random(11)
    words = [["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(12)] for _ in range(130)]
    texts = [" ".join(w) for w in words for _ in range(2)]
    docs = table(spark, texts, {k: f"l{k // 2:03d}" for k in range(260)})
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got == {k: f"l{k // 2:03d}" for k in range(260)}


def test_op8_held_out(spark):
    got = queries.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()


def test_toxicity(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["fine", "good", "day", "river", "stone"]) for _ in range(30)) + (" you are an idiot and a zork" if k % 4 == 0 else "") for k in range(400)]
    docs = table(spark, [*texts, None, "", "Z" * 100_000])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "zork" in model.lexicon
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(300, 400)) and all(0 <= v <= 1 for v in got.values())
    assert {r.toxicity for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


CATS = ["the cat sat on the mat " * (k % 5 + 1) + f"w{k}" for k in range(120)] + [None, "", "the " * 30_000]


@pytest.fixture(scope="module")
def cats(spark):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    return {r.doc_id: r for r in pitman_yor.score(table(spark, CATS), learn).collect()}


@pytest.mark.xfail(strict=True, reason="30,000 of the held-out tokens are 'the' behind 'the the', which training never has: by its posterior the model gives them less than the unigram base")
def test_held_out_beats_the_base_on_a_run_of_one_word(cats):
    held = [r for r in cats.values() if not r.learn]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model(spark, cats):
    texts, got = CATS, cats
    docs, learn = table(spark, texts), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    split = {k: (t or "").lower().split() + [None] for k, t in enumerate(texts)}
    count = collections.Counter(w for k, ws in split.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total, kinds = sum(count.values()), len(count)
    for k, ws in split.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel_tol=1e-9)
        assert r.score <= 0
    held = [r for k, r in got.items() if not r.learn and k < 120]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.score(docs.limit(0), learn).count() == 0


def test_model_sums_to_one(spark):
    """Probabilities of all known words and of the unknown one, in the root and behind a frequent word."""
    words = [f"w{k}" for k in range(12)]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    docs = table(spark, [*texts, *(f"zz{w}" for w in "ab"), *[w for w in words]]).select("doc_id", "text")
    learn = F.col("doc_id") < 60
    got = {r.doc_id: r for r in pitman_yor.score(docs, learn).collect()}
    first = sum(10 ** (got[62 + k].score) for k in range(12))
    assert 0 < first < 1  # each is the word and an end


def test_op10_beats_the_base(spark):
    held = queries.op10_pitman_yor(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, SF).cache()
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "ngram_join":
            want = components({i: shingles(t) for i, t in before.items()})
            assert after == {i: before[i] for i in before if want[i] == i}
        elif name == "suffix_dedup":
            assert after == {i: x.decode("utf-8", "replace") for i, (x, _) in without_repeats(list(before.items())).items()}
        elif name == "decontamination":
            assert all(after[i] == before[i] for i in after)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(after) and all(r.round_trip for r in out.values()) and len(out) > 0.5 * len(rows)


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op3_decontaminate", "op8_language"])
def test_no_shuffle_of_texts(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rare_contexts_count(spark):
    """Words far below a hundredth of all tokens decide what follows them, one and two words on."""
    texts = [f"a{k} b{k} mid x{k} y z{k}" for k in range(300)] * 2
    asked = ["a7 b7", "a7 b8", "x7 y z7", "x7 y z8"]
    docs = table(spark, [*texts, *asked]).select("doc_id", "text")
    got = {r.doc_id: r for r in pitman_yor.score(docs, F.col("doc_id") < 600).collect()}
    pair, other, triple, crossed = (got[600 + k] for k in range(4))
    assert pair.score - other.score > 1 and triple.score - crossed.score > 1
    assert pair.base_score == other.base_score


def test_contexts_sum_to_one(spark):
    """Behind two given words, all known words and the unknown one; an end follows each in the same way."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(6)) for _ in range(40)]
    words = sorted({w for t in texts for w in t.split()})
    docs = table(spark, [*texts, *[f"a {w}" for w in [*words, "zz"]], "a", *[f"a b {w}" for w in [*words, "zz"]], "a b"]).select("doc_id", "text")
    rows = pitman_yor.score(docs, F.col("doc_id") < 40, tokens=True).where("doc_id >= 40").collect()
    assert {r.train_tokens for r in rows} == {40 * 7}
    behind = {1: {}, 2: {}}
    for r in rows:
        split = [*texts, *[f"a {w}" for w in [*words, "zz"]], "a", *[f"a b {w}" for w in [*words, "zz"]], "a b"][r.doc_id].split()
        assert math.isclose(sum(r.token_scores), r.score, rel_tol=1e-12)
        for k in (1, 2):
            if split[:k] == ["a", "b"][:k] and k < len(r.token_scores):
                behind[k][split[k] if k < len(split) else None] = 10 ** r.token_scores[k]
    for k in (1, 2):  # behind the start and a; behind a and b
        assert len(behind[k]) == len(words) + 2 and math.isclose(sum(behind[k].values()), 1, rel_tol=1e-9)


def test_parts_change_no_score(spark):
    """One part and one chunk, or ten and several: the same scores, whoever comes first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    learn = F.col("doc_id") % 5 != 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts, shard in (("1", F.lit(1)), ("10", F.pmod(F.xxhash64("doc_id"), F.lit(7)))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in pitman_yor.score(docs, learn, shard=shard).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 60


@pytest.fixture(scope="module")
def odd_folders(spark, tmp_path_factory):
    """Tables with nulls, empty texts, repeated rows and identifiers, and columns more than usual; and the same tables without rows."""
    root = tmp_path_factory.mktemp("odd")
    texts = [t for t in odd_texts() if t is None or len(t) < 3000]
    rows = [(k if k % 11 else None, t, ("en", "fr", None)[k % 3], "s", len(t or ""), 1, "x", 2) for k, t in enumerate(texts)]
    rows += [(3, "again the same identifier", "en", "s", 1, 1, "x", 2), rows[8], rows[8]]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int, found string, toxicity int"),
        "labels": spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, " ".join(f"common{j}" for j in range(20))), (2, None), (3, "")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(k, [float(k % 7), 1.0, 0.5]) for k in range(45)] + [(None, [1.0, 1.0, 1.0]), (60, None)], "vec_id long, embedding array<float>"),
        "pages": spark.createDataFrame([(1, "http://a/x", "<p>1</p>"), (2, "http://a/x", None), (3, None, ""), (None, "http://b/", "z")], "page_id long, url string, html string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(root / "odd" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(root / "none" / f"{name}.parquet"))
    return str(root / "odd"), str(root / "none"), len(rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_odd_and_empty_tables(spark, odd_folders, name):
    odd, none, n = odd_folders
    got = queries.QUERIES[name](spark, odd).collect()
    if name not in ("op3_decontaminate", "op4_neighbours", "op7_warc_revisits"):
        assert len(got) == n  # a row for every document, whatever its identifier
    assert queries.QUERIES[name](spark, none).collect() == []


def test_pipeline_of_odd_and_empty_tables(spark, odd_folders):
    import corpus_pipeline

    odd, none, _ = odd_folders
    out = corpus_pipeline.run(spark, odd).collect()
    ids = {r.doc_id for r in out}
    assert None in ids and 2 in ids and 20 < len(out) and all(r.round_trip for r in out)
    assert corpus_pipeline.run(spark, none).collect() == []


def test_mail_of_op10_grows_with_texts_alone(spark, tmp_path, monkeypatch):
    """Forty small files and forty partitions of shuffles: no list for each two of them."""
    texts = [" ".join(f"w{(k * j) % 23}" for j in range(12)) for k in range(400)]
    table(spark, texts).select("doc_id", "text").repartition(40).write.parquet(str(tmp_path / "documents.parquet"))
    sent, post, before = {}, pitman_yor.Office.post, spark.conf.get("spark.sql.shuffle.partitions")

    def counted(self, mail, name, *mode):
        post(self, mail, name, *mode)
        if name in ("grams", "gram-counts"):
            sent[name] = self.at[name].where(F.col("kind") < 40).count()

    monkeypatch.setattr(pitman_yor.Office, "post", counted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert queries.op10_pitman_yor(spark, str(tmp_path)).count() == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sent["grams"] <= 4 and sent["gram-counts"] <= 2
