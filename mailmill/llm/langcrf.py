"""Language of every word, and so of a text, by a linear-chain conditional random field.

A word's score for a language is the sum of learned weights of its first and last one to
four letters, of its groups of two and three letters, and of its shares among languages in
a lexicon; learned weights of passing from one language to the next do the rest. Forward
and backward sums give each word a distribution over the languages, exact over the whole
text: blocks of BLOCK words become one matrix each, sums run over the matrices of a text,
then inside all blocks at once. So texts of several languages get their words labelled
part by part. A text's distribution is the mean of that of its words.

The lexicon counts every word of every training text; a word enters where it makes one of
LEXICON words of a language at least, so there are at most LEXICON for each language. The
field is fitted on the driver in numpy to a bounded sample: about SAMPLE texts of each
language, by a hash of their id, and up to WINDOWS windows of WINDOW words of each, spread
over the whole text. Half of the windows are spliced with one of another language, from
which the field learns how rarely a text changes.

Words are runs of letters. A text that is null or holds no letter is `und` with score 0, as
is every text where nothing could be learned. Rows without an id are predicted but not
learned from; repeated rows count as often as they stand there. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.rows import mapped, named_type, streamed
from mailmill.llm.tables import ship, stored

UNKNOWN = "und"
SAMPLE, WINDOWS, WINDOW = 500, 4, 32
LEXICON = 4000
BUCKETS = 1 << 16
EPOCHS, BATCH, RATE = 3, 64, 0.3
BLOCK = 64
_BLOCKS_AT_ONCE = 2048
_SLICE_CHARS = 2 << 20
_RATES = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_PIECE_CHARS = 1 << 20


def _found(text: str) -> Iterator[list[str]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + _PIECE_CHARS
        while end < len(text) and text[end - 1].isalnum():
            end += 1
        words = _WORD.findall(text, at, end)
        # The pattern also takes signs such as a half; they alone are no word.
        yield words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]
        at = end


# Features and the field, in numpy


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words on end, and how many each has."""
    letters = np.frombuffer("".join(f"^{w.lower()}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w.lower()) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(letters))
    left, right = place - begins[owner], ends[owner] - place
    odd = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))

    def hashed(group: np.ndarray, salt: int) -> np.ndarray:
        return ((group + np.uint64(salt << 56)) * odd >> shift).astype(np.int32)

    found, owners = [], []
    group = letters
    for size in range(2, 6):
        # Groups that begin at each letter; marks of begin and end are letters too.
        group = group[:-1] * np.uint64(1_000_003) + letters[size - 1:]
        at = np.arange(len(group))
        inside = right[at] >= size
        for some, salt in ((inside & (size < 4), size), (inside & (left[at] == 0), 8 + size), (inside & (right[at] == size), 16 + size)):
            at_some = np.flatnonzero(some)
            found.append(hashed(group[at_some], salt))
            owners.append(owner[at_some])
    whose = np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(found)[order], np.bincount(whose, minlength=len(words))


class Field:
    """Learned weights; what a task needs to label words."""

    def __init__(self, labels: list[str], lexicon: dict[str, list[float]]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.groups, self.shares = np.zeros((BUCKETS, k)), 2 * np.eye(k)
        self.bias, self.start = np.zeros(k), np.zeros(k)
        self.passing = np.eye(k)

    def shares_of(self, words: list[str]) -> np.ndarray:
        none = [0.0] * len(self.labels)
        return np.array([self.lexicon.get(w.lower(), none) for w in words]).reshape(len(words), len(none))

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word for each language."""
        if not words:
            return np.zeros((0, len(self.labels)))
        features, counts = _features(words)
        begins = np.cumsum(counts) - counts
        return np.add.reduceat(self.groups[features], begins, axis=0) + self.shares_of(words) @ self.shares + self.bias


def _softened(scores: np.ndarray, axis: int | None = None) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=axis, keepdims=True), -60))


def _normal(x: np.ndarray, axes=-1) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def label_shares(field: Field, scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distributions of the words `ids` of texts of `lengths` words, some blocks at a time.

    Yields the text of each block, which of its places hold words, and their distributions.
    """
    k = len(field.labels)
    each = _softened(scores, axis=1)
    passing, start = _softened(field.passing), _softened(field.start)
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * BLOCK
    held = np.minimum(np.repeat(lengths, blocks) - nth * BLOCK, BLOCK)
    spots = np.arange(BLOCK)

    def words_of(some: slice) -> tuple[np.ndarray, np.ndarray]:
        inside = spots < held[some, None]
        return inside, each[ids[np.where(inside, begin[some, None] + spots, 0)]]

    parts = [slice(a, a + _BLOCKS_AT_ONCE) for a in range(0, len(text), _BLOCKS_AT_ONCE)]
    whole = np.empty((len(text), k, k))
    for some in parts:
        inside, emitted = words_of(some)
        matrix = np.broadcast_to(np.eye(k), (len(inside), k, k)).copy()
        for s in range(BLOCK):
            stepped = (matrix.reshape(-1, k) @ passing).reshape(-1, k, k)
            if s == 0:
                stepped[nth[some] == 0] = start
            stepped *= emitted[:, s, None, :]
            matrix = np.where(inside[:, s, None, None], _normal(stepped, (1, 2)), matrix)
        whole[some] = matrix
    ahead, behind = np.full((len(text), k), 1 / k), np.full((len(text), k), 1 / k)
    for b in range(1, blocks.max(initial=0)):
        at = np.flatnonzero(nth == b)
        ahead[at] = _normal(np.einsum("nk,nkj->nj", ahead[at - 1], whole[at - 1]))
    for b in range(blocks.max(initial=0) - 1, 0, -1):
        at = np.flatnonzero(nth == b)
        behind[at - 1] = _normal(np.einsum("nkj,nj->nk", whole[at], behind[at]))
    for some in parts:
        inside, emitted = words_of(some)
        there = np.empty((len(inside), BLOCK, k))
        now = ahead[some]
        for s in range(BLOCK):
            stepped = now @ passing
            if s == 0:
                stepped[nth[some] == 0] = start
            now = np.where(inside[:, s, None], _normal(stepped * emitted[:, s]), now)
            there[:, s] = now
        now = behind[some]
        for s in range(BLOCK - 1, -1, -1):
            there[:, s] *= now
            now = np.where(inside[:, s, None], _normal((emitted[:, s] * now) @ passing.T), now)
        yield text[some], inside, _normal(there)


def train(windows: list[tuple[list[str], str]], lexicon: dict[str, list[float]], labels: list[str], seed: int = 7) -> Field:
    """The field fitted to windows of words of one language each, half of them spliced."""
    field, k = Field(labels, lexicon), len(labels)
    index = {label: n for n, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    windows = sorted((words[:WINDOW], index[label]) for words, label in windows if words)
    rng.shuffle(windows)
    known: dict[str, int] = {}
    ids, truth = np.zeros((len(windows), WINDOW), np.int64), np.full((len(windows), WINDOW), -1)
    for n, (words, label) in enumerate(windows):
        other, second = windows[rng.integers(len(windows))]
        if rng.random() < 0.5 and second != label:
            cut = rng.integers(1, len(words) + 1)
            rest = other[: max(0, WINDOW - cut)]
            words, own = words[:cut] + rest, [label] * cut + [second] * len(rest)
        else:
            own = [label] * len(words)
        ids[n, : len(words)] = [known.setdefault(w, len(known)) for w in words]
        truth[n, : len(words)] = own
    features, counts = _features(list(known))
    begins = np.cumsum(counts) - counts
    shares = field.shares_of(list(known))
    weights = [field.groups, field.shares, field.bias, field.passing, field.start]
    squares = [np.full_like(w, 1e-2) for w in weights]
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            inside = truth[some] >= 0
            used, where = np.unique(ids[some], return_inverse=True)
            where = where.reshape(inside.shape)
            own = np.repeat(begins[used], counts[used]) + np.arange(counts[used].sum()) - np.repeat(np.cumsum(counts[used]) - counts[used], counts[used])
            groups = features[own]
            scores = np.add.reduceat(field.groups[groups], np.cumsum(counts[used]) - counts[used], axis=0) + shares[used] @ field.shares + field.bias
            emitted = _softened(scores, axis=1)[where]
            passing, start = _softened(field.passing), _softened(field.start)
            there, back = np.empty((*inside.shape, k)), np.empty((*inside.shape, k))
            now = _normal(start * emitted[:, 0])
            there[:, 0] = now
            for s in range(1, WINDOW):
                now = np.where(inside[:, s, None], _normal((now @ passing) * emitted[:, s]), now)
                there[:, s] = now
            now = np.full((len(some), k), 1 / k)
            pairs = np.zeros((k, k))
            for s in range(WINDOW - 1, -1, -1):
                back[:, s] = now
                ahead = np.where(inside[:, s, None], emitted[:, s] * now, 0)
                if s:
                    joint = there[:, s - 1, :, None] * passing * ahead[:, None, :]
                    pairs += _normal(joint, (1, 2)).sum(axis=0)
                now = np.where(inside[:, s, None], _normal(ahead @ passing.T), now)
            right = np.eye(k)[np.maximum(truth[some], 0)]
            fault = (right - _normal(there * back)) * inside[..., None]
            both = inside[:, 1:]
            seen = np.bincount((truth[some][:, :-1] * k + truth[some][:, 1:])[both], minlength=k * k).reshape(k, k)
            by_word = np.stack([np.bincount(where.ravel(), fault[..., c].ravel(), len(used)) for c in range(k)], axis=1)
            spread = np.repeat(by_word, counts[used], axis=0)
            by_group = np.stack([np.bincount(groups, spread[:, c], BUCKETS) for c in range(k)], axis=1)
            slopes = [by_group, shares[used].T @ by_word, by_word.sum(axis=0), seen - pairs, fault[:, 0].sum(axis=0)]
            for weight, square, slope in zip(weights, squares, slopes):
                slope = slope / len(some)
                square += slope**2
                weight += RATE * slope / np.sqrt(square)
    return field


# In Spark


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_counts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(word, lang, count), added up for as many texts as fit."""
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        own = counts.setdefault(lang, Counter())
        for words in _found(text):
            own.update(words)
        if sum(map(len, counts.values())) > 200_000:
            yield from ((w, of, n) for of, c in counts.items() for w, n in c.items())
            counts.clear()
    yield from ((w, of, n) for of, c in counts.items() for w, n in c.items())


def lexicon_of(texts: DataFrame, share: int = LEXICON) -> DataFrame:
    """(word, lang, n, total) of the words that make one of `share` words of some language at least."""
    counted = streamed(texts.select("lang", "text"), _word_counts, "word string, lang string, n long")
    counts = stored(counted.groupBy(F.lower("word").alias("word"), "lang").agg(F.sum("n").alias("n")), "lexicon")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # One row for each language.
    told = counts.join(F.broadcast(totals), "lang")
    # At most `share` words for each language.
    chosen = told.where(F.col("n") * share >= F.col("total")).select("word").distinct()
    return told.join(F.broadcast(chosen), "word")


def _windows(text: str, lang: str) -> Iterator[tuple]:
    """Windows of words, spread over the whole text."""
    words = sum(map(len, _found(text)))
    starts = sorted({n * max(0, words - WINDOW) // max(1, WINDOWS - 1) for n in range(WINDOWS)})
    at, some = 0, {s: [] for s in starts}
    for part in _found(text):
        for s, own in some.items():
            own += part[max(0, s - at): max(0, s + WINDOW - at)]
        at += len(part)
    for own in some.values():
        if own:
            yield lang, own


def train_languages(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field learned from the texts that are not held out; None where there are none."""
    ship(docs.sparkSession)
    own = docs.where(~held_out()).where("doc_id is not null and lang is not null and text is not null")
    own = own.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    # One row for each language.
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    lexicon: dict[str, list[float]] = {}
    for r in lexicon_of(own).collect():
        lexicon.setdefault(r.word, [0.0] * len(labels))[labels.index(r.lang)] = r.n / r.total
    lexicon = {w: [x / sum(of) for x in of] for w, of in lexicon.items()}
    rates = F.create_map(*[F.lit(v) for c in labels for v in (c, min(_RATES, -(-sample * _RATES // counts[c])))])
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(_RATES)) < rates[F.col("lang")])
    windows = mapped(chosen.select("text", "lang"), _windows, "lang string, words array<string>").collect()
    if not windows:
        return None
    return train([(r.words, r.lang) for r in windows], lexicon, labels)


def _ids(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers of them, and how many each text has."""
    known: dict[str, int] = {}
    parts, lengths = [np.zeros(0, np.int32)], []
    for text in texts:
        n = 0
        for words in _found(text):
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            n += len(words)
        lengths.append(n)
    return list(known), np.concatenate(parts), np.array(lengths, np.int64)


def text_languages(field: Field, texts: list[str]) -> list[tuple[str, float]]:
    """Language and its share of each text."""
    words, ids, lengths = _ids(texts)
    sums = np.zeros((len(texts), len(field.labels)))
    if words:
        for text, inside, shares in label_shares(field, field.scores(words), ids, lengths):
            np.add.at(sums, text, (shares * inside[..., None]).sum(axis=1))
    best = sums.argmax(axis=1)
    return [
        (field.labels[b], float(min(1.0, row[b] / n))) if n else (UNKNOWN, 0.0)
        for b, row, n in zip(best.tolist(), sums, lengths.tolist())
    ]


def word_languages(field: Field, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, language, share) of each word of a text, in characters."""
    spans = [m.span() for m in _WORD.finditer(text) if any(map(str.isalpha, m.group()))]
    words, ids, lengths = _ids([text])
    if not spans:
        return []
    shares = np.concatenate([s[inside] for _, inside, s in label_shares(field, field.scores(words), ids, lengths)])
    best = shares.argmax(axis=1)
    return [(a, b, field.labels[c], float(s[c])) for (a, b), c, s in zip(spans, best.tolist(), shares)]


def predict_languages(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    ship(docs.sparkSession)
    # A few MB: hashed weights, and at most LEXICON words for each language.
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def told(some: list[tuple]) -> Iterator[tuple]:
        if shared.value is None:
            found = [(UNKNOWN, 0.0)] * len(some)
        else:
            found = text_languages(shared.value, [t for _, t in some])
        return ((i, *f) for (i, _), f in zip(some, found))

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        some, size = [], 0
        for doc_id, text in rows:
            some.append((doc_id, text or ""))
            size += len(text or "")
            if size > _SLICE_CHARS or len(some) == 2000:
                yield from told(some)
                some, size = [], 0
        if some:
            yield from told(some)

    schema = f"{named_type(docs, 'doc_id')}, lang_pred string, score double"
    return streamed(docs.select("doc_id", "text"), rows_of, schema)


def label_runs(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, start, end, lang, share): runs of words of one language in every text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def runs(doc_id, text) -> Iterator[tuple]:
        run = None
        for start, end, lang, share in word_languages(shared.value, text or ""):
            if run and run[2] == lang:
                run[1:] = end, lang, run[3] + share, run[4] + 1
            else:
                if run:
                    yield doc_id, *run[:3], run[3] / run[4]
                run = [start, end, lang, share, 1]
        if run:
            yield doc_id, *run[:3], run[3] / run[4]

    schema = f"{named_type(docs, 'doc_id')}, start long, end long, lang string, share double"
    return mapped(docs.select("doc_id", "text"), runs, schema)
