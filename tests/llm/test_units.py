"""Kernels without Spark: encoders, suffix arrays, tiles, shards, WARC records, trees."""

import io
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, ngram_join, neighbours, pitman_yor, repeats, sentencepiece_codec, sstable, suffix_array, toxicity, warc
from tessera.llm.queries import PIECE_MODEL, WORD_MODEL, tokenizer_path
from tessera.llm.sentencepiece_codec import PieceModel


@pytest.fixture(scope="module")
def pieces():
    with open(tokenizer_path(PIECE_MODEL), "rb") as f:
        return PieceModel(f.read())


def test_pieces_equal_the_library(pieces):
    rng = random.Random(1)
    letters = "aabbehlotn  \n▁éñ漢字😀\x00<s>0123'’\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdetion") for _ in range(400)) for _ in range(60)]
    texts += ["", None, "a" * 3000, "ab" * 2000, "the" * 1000, " " * 100, "�", "ab" * 30_000 + "zq" * 9_000]
    flat, offsets = pieces.encode_texts(texts)
    decoded = pieces.decode_flat(flat, offsets)
    for k, (t, want) in enumerate(zip(texts, pieces.sp.encode([t or "" for t in texts]))):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == [*want, pieces.eos]
        assert decoded[k] == pieces.sp.decode(want)


def test_long_segments_equal_the_library(pieces, monkeypatch):
    """Neighbourhoods merge side by side: as the library does, on runs, on letters without a space, on short texts too."""
    rng = random.Random(4)
    texts = ["a" * 9001, "ab" * 4000, "abcab" * 2000, "the" * 5000, "." * 999 + "-" * 700 + "=" * 77 + "_" * 500, "".join(rng.choice("0011223456789") for _ in range(9000))]
    texts += ["".join(rng.choice(rng.choice(["ab", "aab", "etaoin", "inghte", "...-", "é漢a", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(rng.randint(401, 3000))) for _ in range(25)]
    texts += ["".join(rng.choice("etaoin.-") for _ in range(rng.randint(4, 60))) for _ in range(400)] + ["a" * n for n in range(1, 120)]
    for limit in (sentencepiece_codec.LONG, 3):
        monkeypatch.setattr(sentencepiece_codec, "LONG", limit)
        pieces.young, pieces.old = {}, {}
        flat, offsets = pieces.encode_texts(texts)
        for k, want in enumerate(pieces.sp.encode(texts)):
            assert flat[offsets[k] : offsets[k + 1]].tolist() == [*want, pieces.eos]


def test_words_equal_the_library():
    with open(tokenizer_path(WORD_MODEL), encoding="utf-8") as f:
        t = sstable.WordTokenizer(f.read())
    rng = random.Random(2)
    letters = [*"aAbBhHiItTsSdl'’.,!-<|> \n\téÉß1234Σσς漢字İK_̱̇", "'s", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "the"]
    for trial in range(40):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(60)]
        texts = [x.replace("<", "").replace("|", "") for x in texts] if trial % 2 else texts
        got = [np.frombuffer(x, "<u2").tolist() for x in t.encode(pa.array([*texts, None]), 1)]
        assert got == [[*e.ids, 1] for e in t.library.encode_batch([*texts, ""], add_special_tokens=False)]


def common_prefixes(text, order, depth):
    out = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < depth and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        out.append(k)
    return out


def test_suffix_arrays(tmp_path):
    """Order and common prefixes: in memory; by recursion down to two names; with queues and sequences of a few hundred bytes on disk."""
    rng = random.Random(3)
    for trial in range(60):
        text = [rng.randint(1, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 60))] + [0]
        if trial % 3 == 0:
            text = (text[:4] * 12)[:40] + text
            text = [x or 1 for x in text[:-1]] + [0]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        for memory, base in ((1 << 20, 1 << 20), (1 << 20, 2), (600, 1 << 20), (600, 2)):
            store = suffix_array.Store(str(tmp_path), memory)
            order, common = suffix_array.suffix_array(np.array(text), 200, store, base)
            store.close()
            assert order.tolist() == want and common.tolist() == common_prefixes(text, want, 200)
    assert not list(tmp_path.iterdir())


def test_suffixes_by_their_first_symbols(tmp_path):
    rng = random.Random(8)
    for _ in range(40):
        text = [rng.randint(1, 2) for _ in range(rng.randint(0, 70))] + [0]
        depth = rng.choice([3, 6])
        for memory, base in ((1 << 20, 1 << 20), (600, 2)):
            store = suffix_array.Store(str(tmp_path), memory)
            order, common = suffix_array.suffix_array(np.array(text), depth, store, base)
            store.close()
            heads = [text[i : i + depth] for i in order]
            assert heads == sorted(heads) and sorted(order) == list(range(len(text))) and common.tolist() == common_prefixes(text, order, depth)


def test_a_shard_beyond_its_memory(tmp_path):
    """A shard ten times as large as what its queues and sequences may hold gives the same runs."""
    rng = np.random.default_rng(5)
    base = rng.integers(97, 123, 8000, np.uint8)
    cut = [(k, int(a), base[a : a + 168]) for k, a in enumerate(rng.integers(0, 7800, 700))]
    cut += [(len(cut) + k, 3, rng.integers(97, 99, 168, dtype=np.uint8)) for k in range(20)]

    def runs(memory):
        store = suffix_array.Store(str(tmp_path), memory)
        shard = repeats.Shard(store, 100)
        for doc, low, raw in cut:
            shard.add(np.array([doc]), np.array([low]), raw, np.array([len(raw)]))
        found = [x for run in shard.repeats() for x in zip(*(y.tolist() for y in run))]
        store.close()
        return sorted({(d, p) for d, a, n in found for p in range(a, a + n)})

    seen, want = set(), []
    for doc, low, raw in cut:
        for k in range(69):
            key = raw[k : k + 100].tobytes()
            if key in seen:
                want.append((doc, low + k))
            seen.add(key)
    assert runs(64 << 20) == runs(12_000) == want


def test_slices_before_they_are_sorted(tmp_path):
    """Slices meet by anchor over the borders of batches; only what may be a repeat is sorted, and no repeat is lost."""
    rng = np.random.default_rng(6)
    anchors = {}
    for h in range(50):
        raw = rng.integers(97, 123, 168, np.uint8)
        other = np.where(np.arange(168) < 110, raw, rng.integers(65, 90, 168, np.uint8)).astype(np.uint8)
        anchors[h] = [raw, rng.integers(48, 58, 168, np.uint8), *([other] if h % 5 == 0 else [])]
    rows = [(h, 10 * k + h % 3, 7 * k, raw.tobytes()) for h, held in anchors.items() for k, raw in enumerate(held)]
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("low", pa.int32()), ("bytes", pa.binary())])
    whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    for step in (1, 2, 7, 1000):
        parts = list(repeats.by_anchor(iter([whole.slice(k, step) for k in range(0, len(rows), step)])))
        assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist()
        assert sum(len(set(p.column(0).to_pylist())) for p in parts) == 50
        kept = []
        for p in parts:
            data, offsets = repeats.text_buffer(p.column(3))
            if p.num_rows:
                doc, low, held, size = repeats.shared_parts(p.column(1).to_numpy(), p.column(2).to_numpy().astype(np.int64), data, offsets, 100)
                at = np.cumsum(size) - size
                kept += [(d, a, held[x : x + n].tobytes()) for d, a, x, n in zip(doc.tolist(), low.tolist(), at.tolist(), size.tolist())]
        want = [(10 * k + h % 3, 7 * k, anchors[h][k][:110].tobytes()) for h in range(0, 50, 5) for k in (0, 2)]
        assert sorted(kept) == sorted(want)


def test_slices_of():
    """Every string of every text lies in one slice, and equal strings under equal anchors."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 31, 99, 100, 101, 400, 0, 250)] + ["é" * 80, None, "a" * 300]
    owner, low, count, h, _ = repeats.slices_of(pa.array(texts), 100)
    found = [(o, p, a) for o, b, n, a in zip(owner.tolist(), low.tolist(), count.tolist(), h.tolist()) for p in range(b, b + n)]
    assert [x[:2] for x in found] == [(k, p) for k, t in enumerate(texts) for p in range(len((t or "").encode()) - 99)]
    seen = {}
    for o, p, a in found:
        assert seen.setdefault(texts[o].encode()[p : p + 100], a) == a


def test_tiles():
    rng = random.Random(4)

    def plain(item, text, least):
        a, b, covered = [1] * len(item), [1] * len(text), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(item)):
                for j in range(len(text)):
                    n = 0
                    while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < least:
                return covered
            a[i : i + n], b[j : j + n], covered = [0] * n, [0] * n, covered + n

    for _ in range(150):
        item, text = ([rng.randint(1, 6) for _ in range(rng.randint(4, 24))] for _ in range(2))
        tiles = decontaminate.tiles_of(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert sum(n for _, _, n in tiles) == plain(item, text, 3)
        assert all(item[i : i + n] == text[j : j + n] for i, j, n in tiles)


def test_tiles_of_repetitive_texts():
    """Thousands of equal words: as many tiles as fit, in little time."""
    one = np.full(20_000, 7, np.uint64)
    began = time.time()
    tiles = decontaminate.tiles_of(one[:200], one, 4)
    assert sum(n for _, _, n in tiles) == 200 and time.time() - began < 20
    rng = np.random.default_rng(1)
    tiles = decontaminate.tiles_of(rng.integers(0, 3, 300).astype(np.uint64), rng.integers(0, 3, 6000).astype(np.uint64), 4)
    assert sum(n for _, _, n in tiles) >= 280 and time.time() - began < 40


def test_matches_equal_brute_force():
    """Every text against every item, by tiles over whole sequences."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for k in range(25)] + [(90, ""), (91, "w1 w2 w3")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None]
    for k in range(20):  # passages cut in three and put together in another order
        w = rng.choice(items[:25])[1].split()
        a, b = sorted(rng.randint(0, len(w)) for _ in range(2))
        texts.append(" ".join([*w[b:], "zz", *w[:a], "yy", *w[a:b]]))
    words = lambda t: np.array([hash(x) & (1 << 62) - 1 for x in (t or "").split()], np.uint64)
    want = {}
    for t, text in enumerate(texts):
        for i, item in items:
            w = words(item)
            if len(w):
                covered = sum(n for _, _, n in decontaminate.tiles_of(w, words(text), min(4, len(w))))
                if covered >= 0.5 * len(w):
                    want[t, i] = covered
    got = {(t, r["item_id"]): r["covered"] for t, r in decontaminate.Benchmark(items).match(texts, 0.5)}
    assert got == want and len(want) > 20


def test_reordered_passages():
    item = "one two three four five six. seven eight nine ten eleven twelve"
    b = decontaminate.Benchmark([(7, item), (8, "short one"), (9, "")])
    text = "Intro words. SEVEN eight nine, ten eleven twelve! then one two three four five six and more"
    found = dict(b.match([text, None, "", "one two three only", "a short  ONE!"], 0.5))
    assert found[0]["item_id"] == 7 and found[0]["covered"] == 12 and len(found[0]["tiles"]) == 2
    assert found[4]["item_id"] == 8 and set(found) == {0, 4}


def test_shard_files(tmp_path):
    docs = [(None, b"\1\0"), (-5, b""), (0, b"\2\0\3\0"), (7, b"\4\0"), (7, b"\5\0"), *((k, bytes(2 * (k % 50))) for k in range(1000, 6000))]
    path = tmp_path / "shard-000000.sst"
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 2)
        for i, v in docs:
            w.add(i, v)
        w.close()
    with pa.OSFile(str(path)) as f:
        r = sstable.ShardReader(f)
        assert list(r.scan()) == docs and len(r.index) > 3
        assert [x.tolist() for x in r.get(7)] == [[4], [5]] and r.get(8) == []
        assert len(r.get(5999)[0]) == 5999 % 50 and [x.tolist() for x in r.get(None)] == [[1]]
    assert sstable.lookup(str(tmp_path), 0)[0].tolist() == [2, 3]
    with pytest.raises(ValueError):
        path.write_bytes(path.read_bytes()[:-1])
        with pa.OSFile(str(path)) as f:
            sstable.ShardReader(f)


def test_warc_records():
    rows = [{"record_id": f"urn:{k}", "warc_type": "response", "uri": "http://a/", "date": "2020-01-01T00:00:00Z", "status": 200, "headers": {"etag": '"x"'}, "body": b"WARC/1.1 in a body\r\n\r\n" * (k * 900)} for k in range(4)]
    rows.append({"record_id": "urn:r", "warc_type": "revisit", "uri": None, "date": None, "status": 304, "headers": {}, "body": None})
    raw = b"".join(map(warc.record_bytes, rows))
    assert list(warc.parse(io.BytesIO(raw))) == rows
    import gzip

    assert list(warc.parse(io.BytesIO(gzip.decompress(raw)))) == rows


def test_gram_sets():
    texts = ["A b  c\td e F", "a b c d e f", "a b", "a b c d e a b c d e", "", None, "  ", "x y z w v"]
    grams, offsets = ngram_join.gram_sets(pa.array(texts), 5)
    sets = [set(grams[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    assert [len(s) for s in sets] == [2, 2, 1, 5, 0, 0, 0, 1] and sets[0] == sets[1] and sets[0] & sets[3]


def test_slices_cover_every_string():
    text = "".join(random.Random(5).choice("abcdef") for _ in range(900)) + "z" * 300
    owner, low, count, _, _ = repeats.slices_of(pa.array([text, "short", None, text[:150]]), 100)
    assert sorted(x for a, n, o in zip(low, count, owner) if o == 0 for x in range(a, a + n)) == list(range(len(text) - 99))
    assert count[owner == 3].sum() == 51 and not (owner == 1).any()


def test_slices_beyond_16_mib():
    rng = np.random.default_rng(9)
    passage = bytes(rng.integers(97, 123, 600, np.uint8))
    for at in ((1 << 24) - 300, (1 << 24) + 5000):
        long = bytes(rng.integers(97, 123, at, np.uint8)) + passage + b"z" * 40
        owner, low, count, h, s = repeats.slices_of(pa.array([long.decode()]), 100)
        _, _, _, alone, whole = repeats.slices_of(pa.array([passage.decode()]), 100)
        assert count.sum() == len(long) - 99 and (low[1:] == low[:-1] + count[:-1]).all()
        # all slices of the passage but those at its ends meet their copies
        assert set(zip(alone[1:-1].tolist(), whole[1:-1].tolist())) <= set(zip(h.tolist(), s.tolist()))


def test_trees_and_isotonic():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    raw = toxicity.Trees().fit(x[:2000], y[:2000]).raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.9
    knots = toxicity.isotonic(raw, y[2000:])
    assert (np.diff(knots[1]) >= 0).all() and 0 <= knots[1].min() <= knots[1].max() <= 1
    assert len(toxicity.features(None, {})) == len(toxicity.features("You IDIOT!!! i*iot 1d10t", {"idiot": 2.0})) == len(toxicity.NAMES)


def test_seating_is_the_posterior():
    """After many sweeps, numbers of tables of like dishes are distributed as all seatings say: Gibbs, one customer at a time."""
    for customers in (2, 5):
        seats_of(customers)


def seats_of(customers):
    n, pull, slope, discount = 4000, 0.3, 0.1, 0.4
    key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919)
    tables, sizes = pitman_yor.first_seats(np.full(n, customers))
    for sweep in range(12):
        chance = np.full(n, 1.0)
        tables, sizes = pitman_yor.seated_again(key, np.full(n, customers), tables, sizes, pull + slope * tables, slope * chance, discount, sweep)
        assert sizes.sum() == n * customers and (sizes > 0).all()
    # each part counts alike, once for each labelled set of customers
    want = {}

    def sets(left):
        if not left:
            yield []
            return
        for rest in sets(left[1:]):
            yield [[left[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [left[0], *rest[k]], *rest[k + 1 :]]

    for s in sets(list(range(customers))):
        w = 1.0
        for k, block in enumerate(s):
            w *= pull + slope * k
            for j in range(1, len(block)):
                w *= j - discount
        want[len(s)] = want.get(len(s), 0) + w
    total = sum(want.values())
    for t, w in want.items():
        p = w / total
        assert abs((tables == t).mean() - p) < 4 * (p * (1 - p) / n) ** 0.5 + 0.01


def test_customers_come_and_go():
    rng = np.random.default_rng(2)
    have = rng.integers(1, 400, 300)
    tables, sizes = pitman_yor.first_seats(have)
    want = np.maximum(1, have + rng.integers(-90, 90, 300))
    key = np.arange(300, dtype=np.uint64)
    tables, sizes = pitman_yor.seated_again(key, want, tables, sizes, np.full(300, 0.7), np.full(300, 0.01), 0.5, 3)
    begin = np.cumsum(tables) - tables
    assert (np.add.reduceat(sizes, begin) == want).all() and (tables >= 1).all() and (tables <= want).all()


def test_whole_sweep_seats_every_customer():
    """A sweep ends near the posterior however many customers a dish has, and each dish's result is its own."""
    n, customers, pull, discount = 60, 400, 1e-3, 0.1
    key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919)
    # all alone at first, while new tables are hardly ever wanted: every customer has to move
    start = np.full(n, customers), np.ones(n * customers, np.int64)
    args = np.full(n, pull), np.full(n, 0.0), discount
    tables, sizes = start
    for sweep in (1, 2, 3):
        tables, sizes = pitman_yor.seated_again(key, np.full(n, customers), tables, sizes, *args, sweep)
        assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == customers).all()
    assert tables.mean() < 100  # seats of 8 customers a sweep would leave at least 376
    # in a matrix of dishes and one by one
    many = pitman_yor.seated_again(key, np.full(n, customers + 9), *start, *args, 1)
    alone = [pitman_yor.seated_again(key[k : k + 1], np.full(1, customers + 9), start[0][:1], start[1][:customers], args[0][:1], args[1][:1], discount, 1) for k in range(n)]
    assert many[0].tolist() == [int(t[0]) for t, _ in alone] and many[1].tolist() == np.concatenate([s for _, s in alone]).tolist()


def test_whole_sweeps_reach_the_posterior():
    """Number of tables of 40 customers, against generalized Stirling numbers."""
    n, customers, pull, slope, discount = 4000, 40, 0.8, 0.3, 0.4
    key = np.arange(n, dtype=np.uint64) * np.uint64(104729)
    tables, sizes = pitman_yor.first_seats(np.full(n, customers))
    for sweep in range(12):
        tables, sizes = pitman_yor.seated_again(key, np.full(n, customers), tables, sizes, pull + slope * tables, np.full(n, slope), discount, sweep)
    ways = {1: 1.0}
    for c in range(1, customers):
        ways = {t: ways.get(t - 1, 0.0) + (c - discount * t) * ways.get(t, 0.0) for t in range(1, c + 2)}
    weight = {t: w * float(np.prod(pull + slope * np.arange(t))) for t, w in ways.items()}
    total = sum(weight.values())
    for t, w in weight.items():
        p = w / total
        assert abs((tables == t).mean() - p) < 4 * (p * (1 - p) / n) ** 0.5 + 0.002


def test_lists_as_bytes():
    rng = np.random.default_rng(4)
    arrays = [np.sort(rng.integers(0, 1 << 40, 1000).astype(np.uint64)), rng.integers(0, 9, 1000).astype(np.uint8), np.zeros(0, np.uint64), rng.random(7).astype(np.float32), np.array([True, False])]
    back = pitman_yor.unpack(pitman_yor.pack(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back)) and len(pitman_yor.pack(arrays[0])) < 5 * 1000


def test_chi_square():
    assert abs(neighbours.chi_square_at(0.95, 8) - 15.507) < 0.01


def test_order_of_is_stable_where_leading_bits_agree():
    """Values that differ in their last bits alone, in any number, stand in full order and equal ones as they came."""
    rng = np.random.default_rng(5)
    close = np.uint64(1 << 63) + rng.integers(0, 5, 5000).astype(np.uint64)
    for x in (close, rng.integers(0, 1 << 62, 5000).astype(np.uint64), np.zeros(0, np.uint64), np.zeros(3, np.uint64)):
        assert (pitman_yor.order_of(x) == np.argsort(x, kind="stable")).all()


def test_kept_chunk_is_the_same():
    docs = pa.table({"doc_id": ["x", None, "y"], "learn": [True, False, True], "text": ["A b a", None, "b c"]})
    mail = pitman_yor.Mail(None)
    chunk = pitman_yor.Chunk.of_docs(docs, 7)
    chunk.keep(3, mail)
    back = pitman_yor.Chunk.kept(pitman_yor.Mail(mail.table()), 7)
    assert back.ids.to_pylist() == ["x", None, "y"] and back.sizes.tolist() == [4, 1, 3] and back.learn.tolist() == [True] * 4 + [False] + [True] * 3
    for name in ("word", "gram", "pair", "two", "one"):
        assert (getattr(chunk, name) == getattr(back, name)).all()


def test_scoring_memory():
    """Scoring a chunk takes a bounded number of bytes a token: two run in an executor at once, beside its heap."""
    rng = np.random.default_rng(3)
    n_tokens = 1 << 18
    codes = np.append(pitman_yor.mix64(np.arange(1, 40_001, dtype=np.uint64)) & pitman_yor.WORD_BITS, pitman_yor.START)
    at = np.append(rng.integers(0, 40_000, n_tokens), 40_000)
    chunk = pitman_yor.Chunk(pa.chunked_array([np.arange(256)]), np.ones(256, bool), np.full(256, n_tokens // 256), codes, at, 1)
    mail = pitman_yor.Mail(None)
    chunk.keep(0, mail)
    chunk.grams()
    chunk.pairs()
    chunk.words()
    grams, pairs, words = (len(x) for x in (chunk.keys3, chunk.keys2, chunk.codes))
    byte = lambda n, k=1: [rng.integers(1, 3, n).astype(np.uint8) for _ in range(k)]
    count = np.bincount(chunk.at3, minlength=grams).astype(np.uint8)
    got = {pitman_yor.GRAM_COUNTS: [count, count > 0], pitman_yor.PAIR_CLASSES: [*byte(pairs), np.ones(pairs, bool), np.ones(pairs, bool), *byte(pairs, 2)]}
    got |= {pitman_yor.WORD_ANSWERS: byte(words, 10), pitman_yor.GRAM_ANSWERS: byte(np.count_nonzero(count > 1), 3), pitman_yor.PAIR_ANSWERS: byte(pairs, 9)}
    mail.got = {k: [(0, pitman_yor.pack(*x))] for k, x in got.items()} | {pitman_yor.TOKENS: [(0, mail.out[0][3])]}
    del chunk
    tracemalloc.start()
    try:
        held = pitman_yor.scores_of(pitman_yor.Chunk.kept(mail, 1), mail, 1e6, 1e4, [((1.0, 0.5), (2.0, 0.6), (3.0, 0.7), 1e5)] * 3, False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held.num_rows == 256 and np.isfinite(held["score"].to_numpy()).all()
    assert peak < 200 * n_tokens, peak / n_tokens


def test_members_are_fed_once(monkeypatch):
    """What lies behind the end of a gzip member is not handed on for every member: reading grows with the file, not with members times the size of a read."""
    rows = [{"record_id": f"r{k}", "warc_type": "response", "uri": f"http://x/{k}", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"etag": f'"{k}"'}, "body": bytes([k % 251]) * 50} for k in range(3000)]
    raw, fed = b"".join(map(warc.record_bytes, rows)), [0]
    made = warc.zlib.decompressobj

    class Counted:
        def __init__(self, bits):
            self.held = made(bits)

        def decompress(self, data):
            fed[0] += len(data)
            return self.held.decompress(data)

        def __getattr__(self, name):
            return getattr(self.held, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    got = list(warc.parse(io.BytesIO(raw)))
    assert [(r["record_id"], r["headers"], r["body"]) for r in got] == [(r["record_id"], r["headers"], r["body"]) for r in rows]
    assert fed[0] < 60 * len(raw), fed[0] / len(raw)
    assert [(r["record_id"], r["headers"], r["body"]) for r in warc.parse(io.BytesIO(raw), False)] == [(r["record_id"], None, r["body"]) for r in rows]


def test_long_lists_stay_out_of_the_rows(tmp_path):
    """A row of mail says where a long list stands in a file of the shared folder; the receiver reads it there."""
    keys = np.sort(pitman_yor.mix64(np.arange(50_000, dtype=np.uint64)))
    mail = pitman_yor.Mail(None, f"file://{tmp_path}")
    for peer in range(3):
        mail.send(7, peer, pitman_yor.GRAMS, keys + np.uint64(peer), np.arange(50_000))
    mail.send(7, 9, pitman_yor.GRAMS, keys[:3], np.arange(3))
    mail.send(7, 7, pitman_yor.HIGH, keys)
    mail.shelve("lists/step")
    table = mail.table()
    assert table.nbytes < 2000 and sorted(p.name for p in (tmp_path / "lists/step").iterdir()) == [f"kind={pitman_yor.GRAMS}", f"kind={pitman_yor.HIGH}"]
    back = pitman_yor.Mail(table, f"file://{tmp_path}")
    got = back.of(pitman_yor.GRAMS)
    assert [peer for peer, _ in got] == [0, 1, 2, 9] and all((x == keys + np.uint64(peer)).all() for peer, (x, _) in got[:3]) and (got[3][1][0] == keys[:3]).all()
    assert (back.own(pitman_yor.HIGH)[0] == keys).all() and not back.own(pitman_yor.LOW)
