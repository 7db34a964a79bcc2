import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolode.llm import language, mixing_lm
from tests.llm.brute import WORD, lower


def held(df, parts, left):
    return F.crc32(df["doc_id"].cast("string").cast("binary")) % parts == left


@pytest.fixture(scope="module")
def corpus(docs):
    r = random.Random(4)
    parts = {"en": ["th", "er", "ing", "on", "ea"], "fr": ["eau", "ou", "é", "que", "oi"], "de": ["sch", "ung", "ei", "ß", "ver"]}
    rows = []
    for i in range(240):
        lang = r.choice(list(parts))
        lines = [" ".join("".join(r.choices(parts[lang], k=r.randrange(1, 4))) for _ in range(r.randrange(3, 12))) for _ in range(5)]
        rows.append((i, "\n".join(lines).capitalize(), lang if i % 9 else None, "s"))
    return docs([*rows, (1000, None), (1001, ""), (1002, "12 !", None, "s"), (1003, "é" * 3000, None, "s"), (None, "the thing"), (7, "the thing"), (7, "the thing")])


def test_language_on_held_out(corpus):
    got = language.languages(corpus, held(corpus, 4, 2)).collect()
    lang = {r.doc_id: r.lang for r in corpus.collect() if r.doc_id is not None and r.doc_id < 240 and r.lang}
    out = [r for r in got if r.held_out and r.doc_id in lang and r.doc_id != 7]
    assert len(out) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by_id[1000] == by_id[1001] == by_id[1002] == ("und", 0.0)
    assert by_id[1003][0] == "fr" and all(0 <= s <= 1 for _, s in by_id.values())
    assert len(got) == corpus.count()


def test_language_without_labels(docs, empty):
    df = docs([(1, "words of a kind", None, "s")])
    assert [(r.lang_pred, r.score) for r in language.languages(df, F.lit(False)).collect()] == [("und", 0.0)]
    assert language.languages(empty, F.lit(False)).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language.load(language._path(None))
    r = np.random.default_rng(0)
    model = r.random((pieces.size + 1, 2))
    model /= model.sum(axis=0)
    number = {p: i for i, p in enumerate(pieces.names)}

    def plain(word):
        sums = [np.ones(2)] + [np.zeros(2) for _ in word]
        for e in range(1, len(word) + 1):
            for b in range(e):
                i = number.get(word[b:e], pieces.size if e - b == 1 else None)
                if i is not None:
                    sums[e] = sums[e] + sums[b] * model[i]
        return np.log(sums[-1])

    words = ["▁the", "▁station", "▁ß漢éa", "▁" + "ing" * 15, "▁x"]
    assert np.allclose(language.word_scores(pieces, model, words), [plain(w) for w in words])
    long = "▁" + "tion" * 16
    assert np.allclose(language._long_score(pieces, model, long), plain(long))


def test_rare_runs_stay_in_range():
    """45 letters unseen in a language of 1e9 uses, alone and in a longer text."""
    pieces = language.load(language._path(None))
    total = np.full((pieces.size + 1, 2), 0.1)
    total[0] = 1e9
    total[:, 1] = 1.0
    model = total / total.sum(axis=0)
    word = "".join(chr(0x10480 + i % 20) for i in range(45))
    for n in (20, 40, 45, 59, 60, 61, 200):
        run = ("▁" + word * 5)[: n + 1]
        assert np.isfinite(language.word_scores(pieces, model, [run])).all()
        assert np.allclose(language.word_scores(pieces, model, [run]), language._long_score(pieces, model, run))
    run = language._predicted(language._path(None), ["a", "b"], np.log([0.5, 0.5]), model)
    import pyarrow as pa

    out = next(run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([word])], ["doc_id", "t"])])))
    assert 0 <= out["score"][0].as_py() <= 1
    # learning: the word's letters are all used, and nothing is lost or not a number
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([word]), pa.array([7])], ["lang", "word", "n"])
    uses = next(language._expected(language._path(None), ["a", "b"], model)(iter([batch])))
    by_piece = dict(zip(uses["piece"].to_pylist(), uses["uses"].to_pylist(), strict=True))
    assert by_piece[pieces.size] == 7 * 45 * language._FRACTION


def test_expectation_steps_raise_the_likelihood(corpus, spark):
    labelled = corpus.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").alias("t"), "lang")
    path, total = language._path(None), []
    for steps in (0, 1, 3):
        langs, _, model = language.train(labelled, path, steps)
        words = [("▁" + w, langs.index(r.lang)) for r in labelled.collect() for w in language._spell(r.t)]
        scores = language.word_scores(language.load(path), model, [w for w, _ in words])
        total.append(sum(s[i] for s, (_, i) in zip(scores, words, strict=True)))
    assert total[0] < total[1] < total[2]


def test_base_score_and_counts(corpus):
    got = {r.doc_id: r for r in mixing_lm.log_probabilities(corpus, held(corpus, 5, 1)).collect() if r.doc_id != 7}
    rows = [(r.doc_id, [*WORD.findall(lower(r.text)), ""]) for r in corpus.collect()]
    count = {}
    for i, words in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for w in words:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, words in rows:
        if i == 7:
            continue
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.score < 0


def test_model_beats_chance_and_reruns_agree(corpus):
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in mixing_lm.log_probabilities(corpus, held(corpus, 5, 1)).collect()} for _ in range(2))
    assert a == b
    texts = [r.text for r in corpus.collect() if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    bits = -sum(s for (i, _), s in a.items() if i is not None and i < 240 and zlib.crc32(str(i).encode()) % 5 == 1) / math.log10(2)
    assert bits / sum(len(t.encode()) for t in texts) < 3


def _model(words):
    """A model of a few words, learned in place."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([3] * len(words))], ["word", "c"])
    counts = 1 + next(mixing_lm._symbol_counts(iter([batch])))["n"].to_numpy()
    tables = np.zeros((len(mixing_lm.ORDERS), mixing_lm.SLOTS), np.uint32)
    parts = pa.Table.from_batches(list(mixing_lm._slot_counts(counts)(iter([batch]))))
    for k in range(len(mixing_lm.ORDERS)):
        for s in set(parts["s"].to_pylist()):
            own = parts.filter((pa.compute.field("k") == k) & (pa.compute.field("s") == s))
            out = mixing_lm._slices((pa.scalar(k), pa.scalar(s)), own)
            tables[k, s : s + mixing_lm._SLICE] = np.frombuffer(out["t"][0].as_py(), np.uint32)
    weights = np.full((mixing_lm.GATES, len(mixing_lm.ORDERS)), 0.4)
    return mixing_lm.Model(counts, np.stack([mixing_lm.log_odds(t) for t in tables]), weights)


def test_word_probabilities_sum_to_at_most_one():
    scorer = mixing_lm.Scorer(_model([b"ab", b"ba", b"abba", b""]))
    letters = [bytes([x]) for x in range(256) if x not in b"\n"]
    words = [b""] + letters + [x + y for x in (b"a", b"b") for y in letters]
    total = np.exp(scorer.word_scores(words)).sum(axis=0)
    assert (total < 1).all()
    # all first symbols at once: their paths make a whole
    nodes, bits, length = mixing_lm.huffman(scorer.model.counts)
    assert np.isclose((0.5**length).sum(), 1)


def test_document_score_by_hand():
    """One text, read a line at a time with the slopes' weights updated as told."""
    scorer = mixing_lm.Scorer(_model([b"ab", b"ba", b""]))
    slopes = len(mixing_lm.SLOPES)
    by_line = np.log(np.array([[0.1, 0.2, 0.3], [0.05, 0.01, 0.02], [0.1, 0.2, 0.3]])[:, :slopes])
    end = np.log(np.array([0.5, 0.4, 0.3])[:slopes])
    weight, total, seen, before = np.ones(slopes) / slopes, 0.0, [[0.2, 2.0], [0.2, 2.0]], 0
    for i, (p, c, mine) in enumerate(zip(np.exp(by_line), [0, 4, 0], [0, 0, 1], strict=True)):
        spelled = float(weight @ p)
        weight = weight * p / spelled
        repeat = seen[before][0] / seen[before][1]
        share = 0.5 * c / 10 + (0.5 * mine / i if i else 0)
        known = c > 0 or mine > 0
        total += math.log(repeat * share * known + (1 - repeat) * spelled)
        seen[before][0] += known
        seen[before][1] += 1
        before = int(known)
    total += math.log(float(weight @ np.exp(end)))
    assert math.isclose(scorer.document(by_line, end, [5, 6, 5], [0, 4, 0], 10), total)


def test_corrections_and_the_word_before_by_hand():
    """Two texts a bit at a time: the word before counts, each gate is corrected."""
    r = np.random.default_rng(1)
    model = _model([b"ab", b"ba", b"abba", b""])
    assert mixing_lm.ORDERS == (1, 2, 3, 5, 0) and mixing_lm.NEWTON == 3
    model.pairs = r.normal(size=mixing_lm.PAIR_SLOTS).astype(np.float32)
    model.pairs[r.random(mixing_lm.PAIR_SLOTS) < 0.3] = 0
    model.pair_weights = r.random((2 * mixing_lm.GATES, 2))
    scorer, words = mixing_lm.Scorer(model), [b"ab", b"ba", b"abba", b"x", b""]
    docs = [np.append(r.integers(0, 4, n), 4) for n in (90, 40)]
    want, block = [], mixing_lm.BLOCK
    for doc in docs:
        slope, offset = np.ones(mixing_lm.GATES), np.zeros(mixing_lm.GATES)
        sums = np.tile([0.0, mixing_lm.INERTIA, 0.0, mixing_lm.INERTIA / 4], (mixing_lm.GATES, 1))
        for n, i in enumerate(doc):
            slots, bits, place, _, key = scorer.coder.expand([words[i]])
            last = mixing_lm._before([words[doc[n - 1]]])[0] if n else np.uint32(0)
            total = np.zeros(len(mixing_lm.SLOPES))
            for b in range(len(bits)):
                x = np.array([model.tables[k][slots[k][b]] for k in range(len(mixing_lm.ORDERS))])
                g = int((x != 0).sum()) * mixing_lm.PLACES + int(place[b])
                pair = model.pairs[mixing_lm._slot(key[b : b + 1] ^ last, mixing_lm.PAIR_SLOTS)[0]]
                first, second = model.pair_weights[2 * g + int(pair != 0)]
                m = first * float(x @ model.weights[g]) + second * float(pair)
                z = slope[g] * m + offset[g]
                total -= [math.log1p(math.exp(e * (-z if bits[b] else z))) for e in mixing_lm.SLOPES]
                p = 1 / (1 + math.exp(-z))
                sums[g] += ((bits[b] - p) * m, p * (1 - p) * m * m, bits[b] - p, p * (1 - p))
            want.append(total)
            if (n + 1) % block == 0:
                slope, offset = 1 + sums[:, 0] / sums[:, 1], sums[:, 2] / sums[:, 3]
    assert np.allclose(scorer.word_scores(words, docs), want, rtol=1e-3)


def test_the_word_before_decides(docs, spark):
    """After one word comes x, after another y; texts that swap them score less."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["sun xo", "fog ye"]) for _ in range(60))) for i in range(200)]
    df = docs([*rows, (1000, "sun xo fog ye sun xo"), (1001, "sun ye fog xo sun ye")])
    score = {r.doc_id: r.score for r in mixing_lm.log_probabilities(df, F.col("doc_id") >= 1000).collect()}
    assert score[1000] > score[1001] + 1


def test_weights_come_from_all_words(spark):
    """One word more than the 300,000 of the old sample must not halve the symbols."""
    known = spark.range(300_001).selectExpr("cast(concat('w', id) as binary) AS word", "2L AS c")
    pairs = spark.createDataFrame([], "spelled binary, each binary, before binary, times binary")
    model = mixing_lm._learned(known, 300_001, pairs, 0)
    assert model.counts[ord("w")] == 1 + 2 * 300_001 and model.counts[mixing_lm.STOP] == 1 + 2 * 300_001


def test_slot_counts_beyond_32_bits():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"ab"], pa.binary()), pa.array([1 << 33])], ["word", "c"])
    coder = mixing_lm.Coder(np.ones(mixing_lm.SYMBOLS))
    slots, bits, *_ = coder.expand([b"ab"])
    parts = pa.Table.from_batches(list(mixing_lm._slot_counts(np.ones(mixing_lm.SYMBOLS))(iter([batch]))))
    for slot, bit in zip(slots[-1].tolist(), bits.tolist(), strict=True):
        s = slot // mixing_lm._SLICE * mixing_lm._SLICE
        k = len(mixing_lm.ORDERS) - 1
        out = mixing_lm._slices((pa.scalar(k), pa.scalar(s)), parts.filter((pa.compute.field("k") == k) & (pa.compute.field("s") == s)))
        both = int(np.frombuffer(out["t"][0].as_py(), np.uint32)[slot - s])
        assert (both >> 16, both & 0xFFFF) == ((0xFFFF, 0) if bit else (0, 0xFFFF))


def test_bits_per_byte(corpus):
    scored = mixing_lm.log_probabilities(corpus, held(corpus, 5, 1))
    rows, size = scored.collect(), {r.doc_id: len((r.text or "").encode()) for r in corpus.collect()}
    for r in rows:
        if r.doc_id != 7:
            assert r.n_bytes == size[r.doc_id]
        assert (r.bits_per_byte is None) == (r.n_bytes == 0)
        assert not r.n_bytes or math.isclose(r.bits_per_byte, -r.score / math.log10(2) / r.n_bytes, abs_tol=1e-5)
    for t in mixing_lm.total_bits_per_byte(scored).collect():
        own = [r for r in rows if r.held_out == t.held_out]
        assert t.n_bytes == sum(r.n_bytes for r in own)
        assert math.isclose(t.bits_per_byte, -sum(r.score for r in own) / math.log10(2) / t.n_bytes, rel_tol=1e-9)


def test_models_travel_compressed():
    """Every executor and the driver keep each model that is sent on their disks."""
    import pickle

    r = np.random.default_rng(3)
    tables = (r.integers(0, 3, (len(mixing_lm.ORDERS), mixing_lm.SLOTS)) * (r.random(mixing_lm.SLOTS) < 0.1)).astype(np.uint32)
    pairs = mixing_lm.log_odds(r.integers(0, 4, mixing_lm.PAIR_SLOTS + 5).astype(np.uint32))
    sent = pickle.dumps(mixing_lm.Model(np.ones(mixing_lm.SYMBOLS), tables, None, pairs))
    assert len(sent) < (tables.nbytes + pairs.nbytes) / 4
    got = pickle.loads(sent)
    assert got.weights is None and (got.tables == tables).all() and (got.pairs == pairs).all()
    assert got.tables.dtype == tables.dtype and got.pairs.dtype == pairs.dtype
    assert pickle.loads(pickle.dumps(mixing_lm.Model(got.counts, tables))).pairs is None


def test_models_of_learning_leave_the_disk(spark):
    """Only the model to score with may stay, not those that its weights came from."""
    import os

    def held():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(spark.sparkContext._temp_dir) for f in files)

    known = spark.range(2000).selectExpr("cast(concat('w', id) as binary) AS word", "2L AS c")
    pairs = spark.createDataFrame([], "spelled binary, each binary, before binary, times binary")
    before = held()
    mixing_lm._learned(known, 2000, pairs, 0)
    assert held() - before < 1 << 20


def test_scores_do_not_depend_on_what_is_held_at_once(monkeypatch):
    """The words of a few documents at a time, whatever their order and number."""
    r = np.random.default_rng(5)
    model = _model([b"ab", b"ba", b"abba", b""])
    model.pairs = r.normal(size=mixing_lm.PAIR_SLOTS).astype(np.float32)
    model.pair_weights = r.random((2 * mixing_lm.GATES, 2))
    words = [b"ab", b"ba", b"abba", b"x", b"never", b""]
    docs = [np.append(r.integers(0, 4, n), 5) for n in (90, 3, 0, 40, 200)]
    whole = mixing_lm.Scorer(model).word_scores(words, docs)
    held = []
    spelled = mixing_lm.Scorer._spelled
    monkeypatch.setattr(mixing_lm.Scorer, "_spelled", lambda self, own: held.append(own) or spelled(self, own))
    for tokens, documents in ((1, 1), (60, 2), (150, 400)):
        monkeypatch.setattr(mixing_lm, "TOKENS", tokens)
        monkeypatch.setattr(mixing_lm, "DOCUMENTS", documents)
        assert (mixing_lm.Scorer(model).word_scores(words, docs) == whole).all()
    assert [b""] in held and not any(b"never" in own for own in held)


def test_pairs_of_a_chunk():
    """Every word of the texts learned from with a hash of the word before, once with its uses."""
    import pyarrow as pa

    texts = ["Sun fog sun\nfog", "fog sun sun fog fog", "", "left out of it", "x"]
    chunk, want = mixing_lm._Chunk(), {}
    for text in texts:
        chunk.add(text)
    which = [True, True, True, False, True]
    for text in (x for x, use in zip(texts, which, strict=True) if use):
        last = 0
        for w in [*lower(text).encode().split(), b""]:
            want[w, last] = want.get((w, last), 0) + 1
            last = int(mixing_lm._before([w])[0])
    got = {}
    for words, after, before, times in mixing_lm._pair_parts(pa.RecordBatch.from_pylist([chunk.pairs(which)])):
        got |= {(words[i], int(b)): int(n) for i, b, n in zip(after, before, times, strict=True)}
    assert got == want and sum(want.values()) == 4 + 5 + 1 + 4 * 1
    assert chunk.pairs([False] * 5) is None


def test_empty(empty):
    assert mixing_lm.log_probabilities(empty, F.lit(False)).count() == 0
