"""Toxicity: a bidirectional gated recurrent network over overlapping windows of words.

A word enters as the sum of an embedding of the word and the mean of embeddings
of its letter groups; both tables are hashed. A forward and a backward recurrent
layer read a window, attention pools their states, one number comes out. The
score of a text is its highest window, put on a scale of 0 to 1 by a logistic
fit on training texts that the network was not fitted to.

Training runs in numpy on the driver over a bounded sample: at most
MOST_TRAINING labelled texts of each class and of TRAINING_CHARS at most, chosen
by a hash of their id. Inputs are texts only. A label marks a text, not a
window: from the second epoch on, the network is fitted to the highest windows
of each text.

Scoring covers every window of every whole text, in slices of SLICE_BYTES of
whole texts, with no shuffle. A null text is an empty text; a text without words
is one window with an empty word. Without labels of both classes every text
scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmill.llm.tables import give_back, ship

WINDOW, STRIDE = 24, 12
MOST_TRAINING = 1500
TRAINING_CHARS = 20_000
SLICE_BYTES = 1 << 20
WORD_BUCKETS, GROUP_BUCKETS = 1 << 14, 1 << 14
WIDTH, STATE, ATTENTION = 20, 10, 8
EPOCHS, BATCH, RATE = 7, 192, 0.01
STEPS = 250
"""Small samples are gone over more often, until there were so many steps."""
_INFER = 4096

Parameters = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Words:
    """Distinct words of some texts with their hashed features."""

    def __init__(self):
        self.ids: dict[str, int] = {"": 0}

    def of(self, text: str) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in text.lower().split()), np.int32)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word bucket of each word; buckets of its letter groups on end; where they begin."""
        raw = [w.strip(".,;:!?\"'()[]{}*#$%&|<>").encode("utf-8") for w in self.ids]
        joined = np.frombuffer(b"".join(b"^" + w + b"$\0" for w in raw), np.uint8).astype(np.uint64)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 3
        ends = np.cumsum(lengths)
        # Groups of three and four bytes that begin at each byte, the zero marking an end.
        three = joined[:-2] << np.uint64(16) | joined[1:-1] << np.uint64(8) | joined[2:]
        four = three[:-1] << np.uint64(8) | joined[3:]
        odd = np.uint64(0x9E3779B97F4A7C15)
        at = np.arange(len(joined))
        word_at = np.repeat(np.arange(len(raw)), lengths)
        room = ends[word_at] - at - 1
        hashed = lambda x, salt: ((x + np.uint64(salt)) * odd >> np.uint64(64 - 14)).astype(np.int32)
        ok3, ok4 = np.flatnonzero(room[: len(three)] >= 3), np.flatnonzero(room[: len(four)] >= 4)
        groups = np.concatenate([hashed(three[ok3], 0), hashed(four[ok4], 1 << 40)])
        owner = np.concatenate([word_at[ok3], word_at[ok4]])
        # Every word has a group at least: the empty word takes its own.
        missing = np.setdiff1d(np.arange(len(raw)), owner, assume_unique=False)
        groups = np.concatenate([groups, np.zeros(len(missing), np.int32)])
        owner = np.concatenate([owner, missing])
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(raw)))
        rolled = np.add.reduceat(joined * _powers(at - (ends - lengths)[word_at]), ends - lengths) if len(raw) else joined
        return hashed(rolled, 7), groups[order], starts


def _powers(exponents: np.ndarray) -> np.ndarray:
    base = np.uint64(0x100000001B3)
    table = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(exponents.max(initial=0)), base, np.uint64))])
    return table[exponents]


def windows_of(words: np.ndarray) -> np.ndarray:
    """Word ids of overlapping windows, -1 behind the end of a short text."""
    n = len(words)
    if n <= WINDOW:
        row = np.full((1, WINDOW), -1, np.int32)
        row[0, :n] = words
        if n == 0:
            row[0, 0] = 0
        return row
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return words[starts[:, None] + np.arange(WINDOW)]


def fresh_parameters(seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {
        "word": draw(0.01, WORD_BUCKETS, WIDTH), "group": draw(0.01, GROUP_BUCKETS, WIDTH),
        "attend": draw(0.3, 2 * STATE, ATTENTION), "attend_bias": np.zeros(ATTENTION, np.float32),
        "query": draw(0.5, ATTENTION), "out": draw(0.3, 2 * STATE), "out_bias": np.zeros(1, np.float32),
    }
    for way in ("f", "b"):
        p[f"in_{way}"] = draw(WIDTH**-0.5, WIDTH, 3 * STATE)
        p[f"bias_{way}"] = np.zeros(3 * STATE, np.float32)
        p[f"state_{way}"] = draw(STATE**-0.5, STATE, 3 * STATE)
    return p


def embed(p: Parameters, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    words, groups, starts = features
    out = p["word"][words]
    bounds = np.append(starts, len(groups))
    for i in range(0, len(words), 20_000):
        part = bounds[i : i + 20_001]
        sums = np.add.reduceat(p["group"][groups[part[0] : part[-1]]], part[:-1] - part[0])
        out[i : i + 20_000] += sums / np.diff(part)[:, None].astype(np.float32)
    return out


def _recur(inputs: np.ndarray, windows: np.ndarray, state: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
    """States (steps, windows, STATE) of a layer; `inputs` is what each distinct word adds to the gates."""
    n, h2 = len(windows), 2 * STATE
    h = np.zeros((n, STATE), np.float32)
    states = np.empty((WINDOW, n, STATE), np.float32)
    padded = bool((windows < 0).any())
    for t in reversed(range(WINDOW)) if backward else range(WINDOW):
        x = inputs[windows[:, t]]
        u = h @ state
        gates = _sigmoid(x[:, :h2] + u[:, :h2])
        z, r = gates[:, :STATE], gates[:, STATE:]
        new = np.tanh(x[:, h2:] + r * u[:, h2:])
        after = new + z * (h - new)
        if padded:
            after = np.where((windows[:, t] >= 0)[:, None], after, h)
        if keep is not None:
            keep.append((t, h, z, r, new, u[:, h2:]))
        h = states[t] = after
    return states


def _forward(p: Parameters, embedded: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """A number for each window, before the logistic function."""
    layers = []
    for way in ("f", "b"):
        inputs = embedded @ p[f"in_{way}"] + p[f"bias_{way}"]
        steps = None if keep is None else keep.setdefault(way, [])
        layers.append(_recur(inputs, windows, p[f"state_{way}"], way == "b", steps))
    states = np.concatenate(layers, axis=2)
    shaped = np.tanh(states @ p["attend"] + p["attend_bias"])
    weight = np.where((windows >= 0).T, shaped @ p["query"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", weight, states)
    if keep is not None:
        keep.update(states=states, shaped=shaped, weight=weight, pooled=pooled)
    return pooled @ p["out"] + p["out_bias"][0]


def _gradients(p: Parameters, features, windows: np.ndarray, labels: np.ndarray) -> Parameters:
    embedded, keep = embed(p, features), {}
    logits = _forward(p, embedded, windows, keep)
    d_logit = (_sigmoid(logits.copy()) - labels) / len(labels)
    g = {"out": keep["pooled"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    states, shaped, weight = keep["states"], keep["shaped"], keep["weight"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnd,nd->tn", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["query"] = np.einsum("tn,tna->a", d_score, shaped)
    d_shaped = d_score[:, :, None] * p["query"] * (1 - shaped**2)
    g["attend"] = np.einsum("tnd,tna->da", states, d_shaped)
    g["attend_bias"] = d_shaped.sum(axis=(0, 1))
    d_states = d_states + d_shaped @ p["attend"].T
    d_embedded = np.zeros_like(embedded)
    valid = windows >= 0
    for i, way in enumerate(("f", "b")):
        own = d_states[:, :, i * STATE : (i + 1) * STATE]
        d_inputs = np.zeros((len(embedded), 3 * STATE), np.float32)
        g_state = np.zeros_like(p[f"state_{way}"])
        d_h = np.zeros((len(windows), STATE), np.float32)
        for t, h, z, r, new, u_new in reversed(keep[way]):
            d_h = d_h + own[t]
            on = valid[:, t][:, None]
            d_on = np.where(on, d_h, 0)
            d_new = d_on * (1 - z) * (1 - new**2)
            d_z = d_on * (h - new) * z * (1 - z)
            d_r = d_new * u_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_inputs, windows[valid[:, t], t], d_x[valid[:, t]])
            g_state += h.T @ d_u
            d_h = np.where(on, d_on * z, d_h) + d_u @ p[f"state_{way}"].T
        g[f"state_{way}"] = g_state
        g[f"bias_{way}"] = d_inputs.sum(axis=0)
        g[f"in_{way}"] = embedded.T @ d_inputs
        d_embedded += d_inputs @ p[f"in_{way}"].T
    words, groups, starts = features
    counts = np.diff(np.append(starts, len(groups)))
    g["word"], g["group"] = np.zeros_like(p["word"]), np.zeros_like(p["group"])
    np.add.at(g["word"], words, d_embedded)
    np.add.at(g["group"], groups, np.repeat(d_embedded / counts[:, None].astype(np.float32), counts, axis=0))
    return g


def _part(features, used: np.ndarray):
    """Features of some of the words, in the order of `used`."""
    words, groups, starts = features
    ends = np.append(starts[1:], len(groups))
    counts = (ends - starts)[used]
    begin = np.cumsum(counts) - counts
    index = np.arange(counts.sum()) + np.repeat(starts[used] - begin, counts)
    return words[used], groups[index], begin


def score_windows(p: Parameters, embedded: np.ndarray, windows: np.ndarray) -> np.ndarray:
    parts = [_forward(p, embedded, windows[i : i + _INFER]) for i in range(0, len(windows), _INFER)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _highest(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(logits, np.cumsum(counts) - counts)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Parameters:
    """Parameters with `scale`: the logistic fit of the highest window and the log of their number."""
    rng = np.random.default_rng(seed)
    words, y = Words(), np.array(labels, np.float32)
    per_text = [windows_of(words.of(t)) for t in texts]
    features = words.features()
    counts = np.array([len(w) for w in per_text])
    every = np.concatenate(per_text)
    owner = np.repeat(np.arange(len(texts)), counts)
    fitted = rng.random(len(texts)) < 0.8
    # About two windows of each text of a class and three more of the others.
    epochs = max(EPOCHS, int(np.ceil(STEPS / np.ceil(5 * len(texts) / BATCH))))
    p = fresh_parameters(seed)
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        # By chance in the first epoch, then by the height of the windows; of clean texts some by chance as well.
        height = rng.random(len(every)) if epoch == 0 else score_windows(p, embed(p, features), every)
        order = np.lexsort((-height, owner))
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
        positive = y[owner] == 1
        chosen = np.where(positive, rank < (8 if epoch == 0 else 2), (rank < (4 if epoch == 0 else 2)) | (rng.random(len(every)) < 3 / counts[owner]))
        chosen = np.flatnonzero(chosen & fitted[owner])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            rows = chosen[i : i + BATCH]
            used, local = np.unique(np.append(every[rows].ravel(), 0), return_inverse=True)
            local = local[:-1].reshape(len(rows), WINDOW) - (1 if used[0] < 0 else 0)
            used = used[used >= 0]
            g = _gradients(p, _part(features, used), local.astype(np.int32), y[owner[rows]])
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    top = _highest(score_windows(p, embed(p, features), every), counts)
    kept = ~fitted if len(set(y[~fitted])) == 2 else np.ones(len(texts), bool)
    p["scale"] = _logistic(_top_features(top, counts)[kept], y[kept])
    return p


def _top_features(top: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(top)), np.clip(top, -30, 30), np.log(counts)], axis=1).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (s * (1 - s))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (s - y) + ridge * w)
    return w


def score_texts(p: Parameters, texts: list[str]) -> np.ndarray:
    words = Words()
    per_text = [windows_of(words.of(t)) for t in texts]
    counts = np.array([len(w) for w in per_text])
    logits = score_windows(p, embed(p, words.features()), np.concatenate(per_text))
    return 1 / (1 + np.exp(-np.clip(_top_features(_highest(logits, counts), counts) @ p["scale"], -30, 30)))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > SLICE_BYTES:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Parameters | None:
    """A model from the labelled texts that are not held out; None where a class is missing."""
    own = labels.where(~held_out()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Ids are chosen first, so that only the chosen texts move.
    chosen = []
    for label in (0, 1):
        of = own.where(F.col("toxic") == label).where("doc_id is not null")
        chosen += of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    ids = docs.sparkSession.createDataFrame(chosen, own.schema)
    texts = docs.select("doc_id", "text").where(F.length("text") <= TRAINING_CHARS).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    sample = sorted(texts.select("doc_id", "text", "toxic").collect())
    if len({r.toxic for r in sample}) < 2:
        return None
    model = train([r.text for r in sample], [r.toxic for r in sample])
    del sample
    # The driver does not keep what the training took.
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Parameters | None, text: str = "text") -> DataFrame:
    """Adds `score` (0 to 1) and `predicted`; columns of these names are replaced."""
    ship(docs.sparkSession)
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    # About 3 MB whatever the input: the sizes of the tables are fixed above.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = [x.as_py() or "" for x in texts]
            parts = [score_texts(shared.value, some) for some in _slices(raw)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())
        give_back()

    scored = docs.withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
