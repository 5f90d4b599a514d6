"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word embedding and, beside it, the mean of the embeddings
of its character n-grams with its ends marked, so unseen forms of a word are read from their
characters. A GRU runs over the words of a window in both directions; attention pools its
states into one vector and a linear layer gives the window's logit. A text is cut into
overlapping windows that cover all of it; its two worst windows and their number give its score
by a calibration fitted on labelled texts the network was not trained on.

Only texts are labelled, not windows. Training therefore starts from the windows of a toxic
text that hold its most telling words, and goes on with those the network itself finds worst;
clean texts give random windows and their worst ones. The training sample is bounded
(`Settings.per_class` texts per class of at most `Settings.fit_chars` characters); scoring runs
over whole texts, batch by batch, in Arrow.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import textscan


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 24
    word_rows: int = 1 << 16
    char_rows: int = 1 << 17
    word_dim: int = 8
    char_dim: int = 8
    hidden: int = 12
    attention: int = 8
    #: Bounds of the training sample: texts of either class, and characters of such a text.
    per_class: int = 1200
    fit_chars: int = 20_000
    rounds: int = 5
    #: Steps of a round at least; a small sample is gone through several times.
    steps: int = 50
    batch: int = 128
    #: Share of words whose own embedding is left out in a training step.
    drop: float = 0.3
    rate: float = 0.01
    seed: int = 7
    grams: tuple[int, ...] = (3, 4, 5)


#: Windows that go through the network at once when texts are scored.
STEP = 1024

# ---- words -------------------------------------------------------------------------


def scan_words(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, textscan.Words, np.ndarray]]:
    """(first row, row after the last, words, hashes) of blocks of texts, lower-cased a block at a time."""
    for a, b, *_ in textscan.blocks(column, limit):
        data, offs = textscan.buffers(pc.utf8_lower(column.slice(a, b - a).fill_null("")))
        words = textscan.Words(data, offs, textscan.SIGNS)
        yield a, b, words, words.hashes()


def char_grams(words: textscan.Words, at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for some words: all rows, and where those of a word start."""
    size = words.ends[at] - words.starts[at] + 2
    first = np.cumsum(size) - size
    stream = np.empty(int(size.sum()), np.uint64)
    inner = np.ones(len(stream), bool)
    inner[first] = inner[first + size - 1] = False
    where = np.arange(len(stream)) - np.repeat(first, size) - 1 + np.repeat(words.starts[at], size)
    stream[inner] = words.data[where[inner]]
    stream[first], stream[first + size - 1] = 256, 257
    left = np.repeat(first + size, size) - np.arange(len(stream))  # characters to the word's end
    code = np.zeros(len(stream), np.uint64)
    rows, of = [], []
    word = np.repeat(np.arange(len(at)), size)
    for n in range(1, max(s.grams) + 1):
        code = code[: len(stream) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + stream[n - 1 :] + np.uint64(1)
        if n in s.grams:
            fits = left[: len(code)] >= n
            rows.append((textscan.mix(code[fits] + np.uint64(n)) % np.uint64(s.char_rows)).astype(np.int64))
            of.append(word[: len(code)][fits])
    rows, of = np.concatenate(rows), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return rows[order], np.searchsorted(of[order], np.arange(len(at)))


def cut_windows(rows: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of the overlapping windows that cover every row."""
    count = np.diff(rows)
    n = np.where(count > 0, np.maximum(1, -(-(count - s.window) // s.stride) + 1), 0)
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = rows[row] + k * s.stride
    return row, begin, np.minimum(s.window, rows[row + 1] - begin)


# ---- network -----------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    s: Settings
    word: np.ndarray  # embeddings of words and of character n-grams
    char: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    #: Calibration: a factor for each kind of evidence, and an offset.
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))

    @classmethod
    def fresh(cls, s: Settings) -> Network:
        rng = np.random.default_rng(s.seed)
        d, h, a = s.word_dim + s.char_dim, s.hidden, s.attention

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        p = {
            "wx": normal(2, d, 3 * h),  # input, recurrent and bias; update, reset, candidate
            "wh": normal(2, h, 3 * h),
            "b": np.zeros((2, 1, 3 * h), np.float32),
            "wa": normal(2 * h, a),
            "ba": np.zeros(a, np.float32),
            "va": normal(a, 1)[:, 0],
            "u": normal(2 * h, 1)[:, 0],
            "c": np.zeros(1, np.float32),
        }
        small = rng.standard_normal((s.word_rows + s.char_rows, s.word_dim)).astype(np.float32) * 0.1
        return cls(s, small[: s.word_rows], rng.standard_normal((s.char_rows, s.char_dim)).astype(np.float32) * 0.1, p)

    def inputs(self, word_row: np.ndarray, gram_rows: np.ndarray, gram_at: np.ndarray) -> np.ndarray:
        """Vectors of distinct words, some thousands at a time."""
        ends = np.append(gram_at, len(gram_rows))
        chars = np.empty((len(word_row), self.s.char_dim), np.float32)
        for k in range(0, len(word_row), 8192):
            at = ends[k : k + 8193]
            some = self.char[gram_rows[at[0] : at[-1]]]
            chars[k : k + 8192] = np.add.reduceat(some, at[:-1] - at[0]) / np.sqrt(np.diff(at))[:, None]
        return np.concatenate((self.word[word_row], chars), 1)

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: x projects distinct words, index (window, place) says which, mask which are real."""
        h, n, t = self.s.hidden, *index.shape
        p = self.p
        pre = np.matmul(x[None], p["wx"]) + p["b"]  # (direction, word, 3h), once per distinct word
        both = np.stack((index, index[:, ::-1]))
        masks = np.stack((mask, mask[:, ::-1])).astype(np.float32)[..., None]
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((t, 2, n, h), np.float32)
        saved = []
        for k in range(t):
            a = np.stack((pre[0][both[0, :, k]], pre[1][both[1, :, k]]))
            r = np.matmul(state, p["wh"])
            gates = _sigmoid(a[..., : 2 * h] + r[..., : 2 * h])
            z, reset = gates[..., :h], gates[..., h:]
            cand = np.tanh(a[..., 2 * h :] + reset * r[..., 2 * h :])
            m = masks[:, :, k]
            new = state + m * (1 - z) * (cand - state)
            if keep:
                saved.append((state, r[..., 2 * h :], z, reset, cand, m))
            state = states[k] = new
        joined = np.concatenate((states[:, 0], states[::-1, 1]), -1)  # (t, n, 2h)
        tanh = np.tanh(joined @ p["wa"] + p["ba"])
        energy = np.where(mask.T, tanh @ p["va"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * joined).sum(0)
        logit = pooled @ p["u"] + p["c"][0]
        return (logit, (both, joined, tanh, weight, pooled, saved)) if keep else logit

    def backward(self, x: np.ndarray, mask: np.ndarray, kept: tuple, grad: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the word vectors, from those of the logits."""
        both, joined, tanh, weight, pooled, saved = kept
        h, p = self.s.hidden, self.p
        g = {"u": pooled.T @ grad, "c": np.array([grad.sum()], np.float32)}
        d_pooled = grad[:, None] * p["u"]
        d_joined = weight[..., None] * d_pooled
        d_weight = (joined * d_pooled).sum(-1)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0)) * mask.T
        g["va"] = np.tensordot(tanh, d_energy, ((0, 1), (0, 1)))
        d_tanh = d_energy[..., None] * p["va"] * (1 - tanh * tanh)
        g["wa"] = np.tensordot(joined, d_tanh, ((0, 1), (0, 1)))
        g["ba"] = d_tanh.sum((0, 1))
        d_joined = d_joined + d_tanh @ p["wa"].T
        d_states = np.stack((d_joined[..., :h], d_joined[::-1, :, h:]), 1)
        d_pre = np.zeros((2, len(x), 3 * h), np.float32)
        g["wh"] = np.zeros_like(p["wh"])
        back = p["wh"].transpose(0, 2, 1)
        carry = np.zeros_like(saved[0][0])
        for k in range(len(saved) - 1, -1, -1):
            state, rec, z, reset, cand, m = saved[k]
            d = carry + d_states[k]
            d_cand = d * m * (1 - z) * (1 - cand * cand)
            d_z = d * m * (state - cand) * z * (1 - z)
            d_reset = d_cand * rec * reset * (1 - reset)
            d_gate = np.concatenate((d_z, d_reset, d_cand * reset), -1)
            g["wh"] += np.matmul(state.transpose(0, 2, 1), d_gate)
            carry = d * (1 - m * (1 - z)) + np.matmul(d_gate, back)
            d_in = np.concatenate((d_z, d_reset, d_cand), -1)
            for side in (0, 1):
                np.add.at(d_pre[side], both[side, :, k], d_in[side])
        g["b"] = d_pre.sum(1, keepdims=True)
        g["wx"] = np.matmul(x.T[None], d_pre)
        return g, np.matmul(d_pre, p["wx"].transpose(0, 2, 1)).sum(0)

    # ---- scoring

    def block(self, words: textscan.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and logit of every window of a block of texts."""
        row, begin, length = cut_windows(words.rows, self.s)
        if not len(row):
            return row, np.zeros(0, np.float32)
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        x = self.inputs((hashes[first] % np.uint64(self.s.word_rows)).astype(np.int64), *char_grams(words, first, self.s))
        out = np.empty(len(row), np.float32)
        place = np.arange(self.s.window)
        for k in range(0, len(row), STEP):
            mask = place < length[k : k + STEP, None]
            index = of[np.minimum(begin[k : k + STEP, None] + place, len(of) - 1)]
            used, index = np.unique(index, return_inverse=True)
            out[k : k + STEP] = self.forward(x[used], index.reshape(mask.shape), mask)
        return row, out

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Per text: its two worst windows' logits, and the log of the number of windows; nan without words."""
        out = np.full((len(column), 3), np.nan)
        for a, _, words, hashes in scan_words(column):
            row, logit = self.block(words, hashes)
            if not len(row):
                continue
            order = np.lexsort((-logit, row))
            row, logit = row[order], logit[order].astype(np.float64)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            size = np.diff(np.append(first, len(row)))
            second = np.where(size > 1, logit[np.minimum(first + 1, len(row) - 1)], -6.0)  # as good as clean
            out[a + row[first]] = np.column_stack((logit[first], second, np.log(size)))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated probabilities; 0 without words."""
        found = self.evidence(column)
        logits = np.nan_to_num(found) @ self.scale[:-1] + self.scale[-1]
        return np.where(np.isnan(found[:, 0]), 0.0, _sigmoid(np.clip(logits, -60, 60)))


# ---- training ----------------------------------------------------------------------


def _calibrate(found: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve over the evidence, slightly shrunk so that they stay finite."""
    mean, spread = found.mean(0), np.maximum(found.std(0), 1e-6)
    x = np.column_stack(((found - mean) / spread, np.ones(len(found))))
    w = np.zeros(x.shape[1])
    ridge = np.diag([2e-3] * found.shape[1] + [1e-4]) * weights.sum()
    for _ in range(50):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weights * (labels - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
    own = w[:-1] / spread
    return np.append(own, w[-1] - own @ mean)


def train(texts: list[str], labels: np.ndarray, share: float, s: Settings = Settings()) -> Network:
    """A network fitted to labelled texts. share: of toxic texts where scores will be used.

    A sixth of the texts is kept for the calibration.
    """
    net = Network.fresh(s)
    if not len(texts) or labels.min() == labels.max():
        net.p["u"][:] = 0  # nothing to tell apart: the share is all that is known
        net.scale = np.array([0, 0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))])
        return net
    rng = np.random.default_rng(s.seed)
    labels = np.asarray(labels, np.float32)
    aside = rng.permutation(len(texts)) % 6 == 0
    fit_texts = [t for t, out in zip(texts, aside, strict=True) if not out]
    fit_labels = labels[~aside]
    # one block: the sample is bounded, and a vocabulary of distinct words serves all steps
    (_, _, words, hashes) = next(scan_words(pa.array(fit_texts, pa.large_string()), 1 << 40))
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    word_row = (hashes[first] % np.uint64(s.word_rows)).astype(np.int64)
    parts = [char_grams(words, first[k : k + 20_000], s) for k in range(0, len(first), 20_000)]
    base = np.cumsum([0, *(len(rows) for rows, _ in parts)])
    gram_rows = np.concatenate([rows.astype(np.int32) for rows, _ in parts])
    gram_at = np.concatenate([at + b for (_, at), b in zip(parts, base, strict=False)])
    del parts
    gram_size = np.diff(np.append(gram_at, len(gram_rows)))
    textscan.release()

    # how telling words and n-grams are by the texts they occur in: a start for the embeddings
    toxic, total = float(fit_labels.sum()), len(fit_labels)
    counts = [[np.zeros(n, np.float32) for _ in range(2)] for n in (s.word_rows, s.char_rows)]
    for k, label in enumerate(fit_labels):
        own = np.unique(of[words.rows[k] : words.rows[k + 1]])
        size = gram_size[own]
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(gram_at[own], size)
        for (every, hit), rows in zip(counts, (word_row[own], gram_rows[each]), strict=True):
            rows = np.unique(rows)
            every[rows] += 1
            hit[rows] += label

    def telling(every: np.ndarray, hit: np.ndarray) -> np.ndarray:
        prior = toxic / total  # shrunk towards it, so that a rare word tells little
        return np.log((hit + 3 * prior) / (every - hit + 3 * (1 - prior))) - np.log(prior / (1 - prior))

    word_tell, gram_tell = (telling(*c) for c in counts)
    net.word[:, 0] = np.clip(word_tell / 2, -2, 2)
    net.char[:, 0] = np.clip(gram_tell / 2, -2, 2)
    best_gram = np.maximum.reduceat(gram_tell[gram_rows], gram_at)
    tell = np.maximum(word_tell[word_row], best_gram)[of]

    row, begin, length = cut_windows(words.rows, s)
    place = np.arange(s.window)
    mask = place < length[:, None]
    index = of.astype(np.int32)[np.minimum(begin[:, None] + place, len(of) - 1)]
    rank = np.where(mask, tell[np.minimum(begin[:, None] + place, len(of) - 1)], -np.inf).max(1)
    window_label = fit_labels[row]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    sums = np.full(s.word_rows, 1e-3, np.float32), np.full(s.char_rows, 1e-3, np.float32)
    steps = 0

    def worst(scores: np.ndarray, of_label: float, per_text: int) -> np.ndarray:
        own = np.flatnonzero(window_label == of_label)
        own = own[np.lexsort((-scores[own], row[own]))]
        place_in = np.arange(len(own)) - np.searchsorted(row[own], row[own])
        return own[place_in < per_text]

    for turn in range(s.rounds):
        if turn:
            x = net.inputs(word_row, gram_rows, gram_at)
            rank = np.empty(len(row), np.float32)
            for k in range(0, len(row), 2048):
                used, local = np.unique(index[k : k + 2048], return_inverse=True)
                rank[k : k + 2048] = net.forward(x[used], local.reshape(mask[k : k + 2048].shape), mask[k : k + 2048])
        clean = np.flatnonzero(window_label == 0)
        chosen = np.concatenate((worst(rank, 1.0, 1), worst(rank, 0.0, 3), rng.choice(clean, min(len(clean), int(total)), False)))
        passes = max(1, -(-s.steps * s.batch // len(chosen)))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for k in range(0, len(chosen), s.batch):
            at = chosen[k : k + s.batch]
            used, local = np.unique(index[at], return_inverse=True)
            local = local.reshape(index[at].shape)
            grams = np.concatenate([gram_rows[gram_at[w] : gram_at[w] + gram_size[w]] for w in used])
            grams_at = np.cumsum(gram_size[used]) - gram_size[used]
            x = net.inputs(word_row[used], grams, grams_at)
            known = (rng.random((len(x), 1)) >= s.drop).astype(np.float32)
            x[:, : s.word_dim] *= known  # some words are read from their characters alone
            logit, kept = net.forward(x, local, mask[at], keep=True)
            grad = ((_sigmoid(logit) - window_label[at]) / len(at)).astype(np.float32)
            g, d_x = net.backward(x, mask[at], kept, grad)
            steps += 1
            norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
            for name, v in g.items():
                m1, m2 = moments[name]
                v = v.reshape(net.p[name].shape) / norm
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                net.p[name] -= s.rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)
            d_chars = np.repeat(d_x[:, s.word_dim :] / np.sqrt(gram_size[used])[:, None], gram_size[used], axis=0)
            for table, rows, d, seen in ((net.word, word_row[used], d_x[:, : s.word_dim] * known, sums[0]), (net.char, grams, d_chars, sums[1])):
                some, of_row = np.unique(rows, return_inverse=True)
                total_d = np.zeros((len(some), d.shape[1]), np.float32)
                np.add.at(total_d, of_row, d.astype(np.float32))
                seen[some] += (total_d * total_d).mean(1)
                table[some] -= 0.03 * total_d / np.sqrt(seen[some])[:, None]

    left = [t for t, out in zip(texts, aside, strict=True) if out]
    y = labels[aside]
    weights = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    found = net.evidence(pa.array(left, pa.large_string()))
    with_words = ~np.isnan(found[:, 0])
    net.scale = _calibrate(found[with_words], y[with_words], weights[with_words])
    return net


def held_out(id_col: str) -> F.Column:
    """Whether labels of this id are kept away from the fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, s: Settings
) -> tuple[DataFrame, float]:
    """(id, y, text) of the training sample, and the share of toxic labels.

    It is drawn by a hash of the id: `per_class` texts of either class, among the labelled rows
    that are not held out and have a text of 1 to `fit_chars` characters.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    marks = marks.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    counts = marks.agg(F.sum("y"), F.count("*")).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.length("text").between(1, s.fit_chars))
    usable = marks.join(texts.select("id").distinct(), "id", "left_semi")  # ids alone are shuffled
    drawn = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(s.per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = F.broadcast(drawn)  # 2 * per_class rows at most
    rows = texts.join(drawn, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return rows, float(counts[0] or 0) / counts[1] if counts[1] else 0.0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    s: Settings = Settings(),
) -> Network:
    """Train on a bounded sample of the labelled rows that are not held out (see `sample`).

    One task trains, and only the network, a few megabytes, comes to the driver.
    """
    rows, share = sample(docs, labels, id_col, text_col, label_col, s)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts = [], [], []
        for batch in batches:
            for into, column in zip((ids, marks, texts), batch.columns, strict=True):
                into += column.to_pylist()
        order = sorted(range(len(ids)), key=lambda k: str(ids[k]))
        net = train([texts[k] for k in order], np.array([marks[k] for k in order], np.float32), share, s)
        found = pickle.dumps(net)
        del ids, marks, texts, net
        textscan.release()
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["net"])

    found = rows.repartition(1).mapInArrow(work, "net binary").collect()
    return pickle.loads(found[0].net) if found else train([], np.zeros(0, np.float32), share, s)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: whole texts, all overlapping windows.

    Null and empty texts, and texts without a word, score 0. Repeated rows get the same score;
    null ids stay null; an empty table gives no rows. Other columns are not read, whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few megabytes by its settings
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["id", "score"])
            textscan.release()

    return rows.mapInArrow(scan, f"id {kind}, score double")


def accepted(docs: DataFrame, net: Network, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that score below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < limit))
            textscan.release()

    return docs.mapInArrow(keep, docs.schema)
