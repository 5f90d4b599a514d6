import re

import numpy as np
import pyarrow as pa
from cases import documents, empty, rows, with_clashes

from claimloom.llm import queries
from claimloom.llm import toxicity as T

SMALL = T.Settings(word_rows=1 << 10, char_rows=1 << 11, per_class=60, rounds=3)


def _net(s=SMALL, seed=1):
    net = T.Network.fresh(s)
    rng = np.random.default_rng(seed)
    net.p["c"] += np.float32(rng.standard_normal())
    return net


def test_gradients_agree_with_differences():
    s = T.Settings(window=5, word_rows=8, char_rows=8, word_dim=2, char_dim=2, hidden=3, attention=2)
    net = T.Network.fresh(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4, 4))
    index = rng.integers(0, 4, (3, 5))
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    grad = rng.standard_normal(3)
    _, kept = net.forward(x, index, mask, keep=True)
    got, d_x = net.backward(x, mask, kept, grad)

    def loss():
        return float(net.forward(x, index, mask) @ grad)

    for values, d in [*((net.p[k], got[k].reshape(net.p[k].shape)) for k in net.p), (x, d_x)]:
        flat = values.reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 7)):
            old = flat[k]
            flat[k] = old + 1e-3
            high = loss()
            flat[k] = old - 1e-3
            low = loss()
            flat[k] = old
            assert abs((high - low) / 2e-3 - d.reshape(-1)[k]) < 2e-3


def test_windows_cover_every_word():
    s = T.Settings()
    rows_ = np.cumsum([0, 0, 1, 31, 32, 33, 500, 0])
    row, begin, length = T.cut_windows(rows_, s)
    covered = np.zeros(rows_[-1], bool)
    for r, b, n in zip(row, begin, length, strict=True):
        assert rows_[r] <= b and b + n <= rows_[r + 1] and 0 < n <= s.window
        covered[b : b + n] = True
    assert covered.all()
    assert set(row.tolist()) == {1, 2, 3, 4, 5}


def plain_words(text):
    """Runs of letters, digits and wider characters, lower-cased."""
    return re.findall(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", text.lower())


def plain_logit(net, words):
    """One window, word by word, by the equations of the gated unit and of the attention."""
    s, p = net.s, {k: v.astype(np.float64) for k, v in net.p.items()}
    h = s.hidden

    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    xs = []
    for word in words:
        own = T.textscan.Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), T.textscan.SIGNS)
        marked = [256, *word.encode(), 257]
        grams = []
        for n in s.grams:
            for k in range(len(marked) - n + 1):
                code = 0
                for b in marked[k : k + n]:
                    code = (code * 0x9E3779B97F4A7C15 + b + 1) % 2**64
                grams.append(int(T.textscan.mix(np.array([(code + n) % 2**64], np.uint64))[0]) % s.char_rows)
        chars = net.char[grams].astype(np.float64).sum(0) / np.sqrt(len(grams))
        xs.append(np.concatenate((net.word[int(own.hashes()[0]) % s.word_rows], chars)))
    sides = []
    for side, order in ((0, xs), (1, xs[::-1])):
        state, states = np.zeros(h), []
        for x in order:
            a, r = x @ p["wx"][side] + p["b"][side][0], state @ p["wh"][side]
            update, reset = sigmoid(a[:h] + r[:h]), sigmoid(a[h : 2 * h] + r[h : 2 * h])
            candidate = np.tanh(a[2 * h :] + reset * r[2 * h :])
            state = update * state + (1 - update) * candidate
            states.append(state)
        sides.append(states if side == 0 else states[::-1])
    joined = [np.concatenate(pair) for pair in zip(*sides, strict=True)]
    energy = np.array([np.tanh(j @ p["wa"] + p["ba"]) @ p["va"] for j in joined])
    weight = np.exp(energy - energy.max())
    pooled = sum(w * j for w, j in zip(weight / weight.sum(), joined, strict=True))
    return float(pooled @ p["u"] + p["c"][0])


def plain_score(net, text):
    words, s = plain_words(text or ""), net.s
    if not words:
        return 0.0
    starts = [0]
    while starts[-1] + s.window < len(words):
        starts.append(starts[-1] + s.stride)
    logits = sorted((plain_logit(net, words[k : k + s.window]) for k in starts), reverse=True)
    evidence = [logits[0], logits[1] if len(logits) > 1 else -6.0, np.log(len(logits))]
    return float(1 / (1 + np.exp(-(np.dot(evidence, net.scale[:-1]) + net.scale[-1]))))


def test_scores_against_a_plain_forward_pass():
    """Whole texts, window by window, with a network of random weights and a calibration that uses all evidence."""
    net = _net()
    rng = np.random.default_rng(5)
    for k in net.p:
        net.p[k] = net.p[k] + rng.standard_normal(net.p[k].shape).astype(np.float32) * 0.3
    net.char *= 4
    net.word *= 4
    net.scale = np.array([0.9, 0.4, -0.3, 0.2])
    vocabulary = ["été", "naïve", "中文", "a", "It's", "x1", "LONGER-word", "\U0001f600", "the", "of", "ΩΑ"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 31, 32, 33, 56, 57, 80, 81, 300, 1500)]
    texts += ["", None, " \n", "!!!", "one\tand\x0btwo", "a" * 4000]
    got = net.scores(pa.array(texts))
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(got, want, atol=2e-4), list(zip(got, want, strict=True))
    assert np.ptp(want) > 0.2


def test_unusable_labels_do_not_shrink_the_sample(spark):
    """Labelled rows without a text, or with one too long, are not drawn."""
    rows_ = [(k, f"{'vile' if k % 2 else 'kind'} words number {k}") for k in range(400)]
    docs = spark.createDataFrame(rows_ + [(k, None if k % 2 else "x" * 50) for k in range(400, 4000)], "doc_id long, text string")
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    s = T.Settings(word_rows=64, char_rows=64, per_class=100, fit_chars=40, rounds=1, steps=1)
    drawn, share = T.sample(docs, labels, "doc_id", "text", "toxic", s)
    assert [tuple(r) for r in drawn.groupBy("y").count().orderBy("y").collect()] == [(0, 100), (1, 100)]
    assert abs(share - 0.5) < 0.05


def test_score_does_not_depend_on_neighbours():
    net = _net()
    texts = ["a b c", "", None, "some other words " * 40, "été 'x'"]
    together = net.scores(pa.array(texts))
    alone = np.concatenate([net.scores(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert together[1] == together[2] == 0


def test_awkward_rows_and_empty_tables(spark):
    net = _net()
    got = rows(T.score(with_clashes(documents(spark)), net))
    assert len(got) == documents(spark).count()
    assert all(0 <= s <= 1 for _, s in got)
    assert rows(T.score(empty(spark), net)) == []
    assert T.accepted(with_clashes(documents(spark)), net, 2.0).columns == with_clashes(documents(spark)).columns
    assert T.accepted(documents(spark), net, 0.0).count() == 0


def test_fit_without_labels(spark):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int")
    net = T.fit(documents(spark), labels, s=SMALL)
    assert all(s <= 0.5 for _, s in rows(T.score(documents(spark), net)))
    assert T.fit(empty(spark), labels.limit(0), s=SMALL).scores(pa.array(["a"])).shape == (1,)


def test_held_out_accuracy(spark):
    """On labels that the fit never sees: nearly all toxic texts found, few others taken."""
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op2_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    pairs = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    toxic = [r.predicted for r in pairs if r.toxic == 1]
    clean = [r.predicted for r in pairs if r.toxic == 0]
    assert len(toxic) >= 100
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.05
