"""Language-model scores from an Elias-Fano n-gram trie.

    blocks    texts as word hashes, about BLOCK_WORDS words a row, written once
    counts    each block sends its distinct n-grams, packed and dealt by hash, with
              how often its training texts hold them; the sums over all blocks go back.
              Words and pairs go first, then each longer n-gram in a pass of its own,
              so that the disk holds what one pass sends
    trie      from what came back a block builds the part of the model that its
              texts can reach: a level for each order, its successors and pointers
              in Elias-Fano lists, probabilities and back-off weights in 16 bits
    score     a word is looked up among the successors of its context, then of
              shorter contexts, whose weights are added on the way down; an n-gram that
              a block has often is looked up once

The probability of a word after a context h of n - 1 words is smoothed towards that
after the shorter context: (c(h w) + STRENGTH p(w | shorter)) / (c(h) + STRENGTH);
the shortest is that of the word alone, c / (N + V), and V / (N + V) for the one
unknown word that stands for all that training lacks. Every text starts with a mark and ends with one that counts as a
word. Logarithms lie between LOWEST and 0 in steps of 1 / SCALE.

A common n-gram is one number per block before the shuffle, so no key is hot. A part
of the trie is as large as its block's texts need; a task holds one block, or one
part of the dealt n-grams, about as many as SHARE blocks have. A key costs some 5.7 bytes
in blocks of BLOCK_WORDS. A text longer than BLOCK_WORDS is a block of its own.
Null text is empty text: its end mark is all it has. Repeated rows are scored alike.
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.lines import mixed, slices, word_hashes, words_of
from mailmill.llm.tables import give_back, ship, stored, tidy

ORDER = 3
"""Longer n-grams work as well: each order sends one more list of n-grams of every block, in a pass of its own."""
STRENGTH = 80.0
BLOCK_WORDS = 1_500_000
SHARE = 2
LOWEST, SCALE = -40.0, 1600

_ODD = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(1), np.uint64(2)
"""Hashes of the marks; a word's hash that equals one of them is a chance of one in 10**19."""


class EliasFano:
    """A rising list of numbers: low bits as they are, high bits as gaps in a bit row.

    `successor` finds where numbers at or above some bounds begin. The bit row
    keeps a running count per 64 bits, from which numbers at some places are worked
    out, and a directory of where each high part begins.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, begins: np.ndarray, bits: int, n: int):
        self.low, self.high, self.ones, self.begins, self.bits, self.n = low, high, ones, begins, bits, n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
        low = (values & ((1 << bits) - 1)).astype(kind)
        part = values >> bits
        row = np.zeros(-(-((top >> bits) + n + 1) // 64) * 64, np.uint8)
        row[part + np.arange(n)] = 1
        high = np.packbits(row, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint32)
        begins = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=(top >> bits) + 1))]).astype(np.int32)
        return cls(low, high, ones, begins, bits, n)

    def all(self) -> np.ndarray:
        """All numbers, front to back."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return (at - np.arange(self.n) << self.bits) + self.low.astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Numbers at some places."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        rest = at - self.ones[word]
        bit = word.astype(np.int64) << 6
        content = self.high[word]
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(content & np.uint64((1 << width) - 1)).astype(np.int64)
            go = rest >= part
            rest = np.where(go, rest - part, rest)
            bit = np.where(go, bit + width, bit)
            content = np.where(go, content >> np.uint64(width), content)
        return (bit - at << self.bits) + self.low[at].astype(np.int64)

    def successor(self, bounds: np.ndarray) -> np.ndarray:
        """For each bound the place of the first number that is not below it."""
        part, want = bounds >> self.bits, bounds & ((1 << self.bits) - 1)
        beyond = part > len(self.begins) - 2
        part[beyond] = len(self.begins) - 2
        low, high = np.where(beyond, self.n, self.begins[part]), np.where(beyond, self.n, self.begins[part + 1])
        open_ = np.flatnonzero(low < high)
        while len(open_):
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            below = self.low[middle].astype(np.int64) < want[open_]
            a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
            low[open_], high[open_] = a, b
            open_ = open_[a < b]
        return low

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """For each number its place, or -1."""
        if not self.n:
            return np.full(len(numbers), -1, np.int64)
        at = self.successor(numbers)
        part = np.minimum(numbers >> self.bits, len(self.begins) - 2)
        same = self.low[np.minimum(at, self.n - 1)].astype(np.int64) == numbers & ((1 << self.bits) - 1)
        return np.where(same & (at < self.begins[part + 1]), at, -1)


class Trie:
    """Levels of n-grams; the children of a node are successors in the next level.

    Level k lists context * words + word over all its n-grams, rising; the place of
    an n-gram there is its node. `pointers` say where the children of a node begin,
    `values` hold steps of the logarithms.
    """

    def __init__(self, words: int, lists: list[EliasFano], pointers: list[EliasFano], values: list[np.ndarray], weights: list[np.ndarray]):
        self.words, self.lists, self.pointers, self.values, self.weights = words, lists, pointers, values, weights

    def child(self, level: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of each word among the successors of a node, or -1."""
        found = np.full(len(node), -1, np.int32)
        parent = np.append(np.diff(self.pointers[level].all()) > 0, False)
        real = np.flatnonzero(parent[node])
        found[real] = self.lists[level].find(node[real] * np.int64(self.words) + word[real])
        return found

    def score(self, ids: np.ndarray, position: np.ndarray, start: int, grams: list[Grams]) -> np.ndarray:
        """Log10 of each word after those before it in its text.

        `ids` are the words of texts on end, `position` the places within each text.
        """
        context, levels = _before(ids, position, start), []
        for level, gram in enumerate(grams[1:]):
            node = self.child(level, context[gram.sample], ids[gram.sample])[gram.where]
            levels.append((context, node))
            context = _before(node, position, -1)
        total, done = np.zeros(len(ids)), np.zeros(len(ids), bool)
        for level, (context, node) in reversed(list(enumerate(levels))):
            hit = np.flatnonzero((node >= 0) & ~done)
            total[hit] += _steps_back(self.values[level + 1][node[hit]])
            done[hit] = True
            # A context that training has, without this word: its weight, and on to a shorter one.
            miss = np.flatnonzero((context >= 0) & ~done)
            total[miss] += _steps_back(self.weights[level][context[miss]])
        rest = np.flatnonzero(~done)
        total[rest] += _steps_back(self.values[0][ids[rest]])
        return total


def _before(values: np.ndarray, position: np.ndarray, first: int) -> np.ndarray:
    """For each place what the place before it has; `first` where a text begins."""
    return np.where(position == 0, np.int32(first), np.concatenate([values[:1], values[:-1]]))


def _steps(logs: np.ndarray) -> np.ndarray:
    return np.round((np.clip(logs, LOWEST, 0) - LOWEST) * SCALE).astype(np.uint16)


def _steps_back(steps: np.ndarray) -> np.ndarray:
    return steps / SCALE + LOWEST


def trained(doc_id: str = "doc_id") -> Column:
    """Whether a document is learned from. Those without an id are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as hashes of lower-case words, each ended by END, many in a row."""
    parts: list[tuple] = []
    held = 0

    def row() -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        columns = [
            pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())),
            pa.array([[t for p in parts for t in p[1]]], pa.list_(pa.bool_())),
            pa.array([np.concatenate([p[2] for p in parts]).tolist()], pa.list_(pa.int64())),
            *_pack_words(np.concatenate([p[3] for p in parts])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "learned", "counts", "words", "places"])

    for batch in batches:
        ids, learned = batch.column("doc_id").to_pylist(), batch.column("learned").to_pylist()
        texts = [(x.as_py() or b"").lower() for x in batch.column("text").cast(pa.binary())]
        for at, some in slices(texts):
            raw, _, starts, ends, owner = words_of(some)
            hashes = word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
            counts = np.bincount(owner, minlength=len(some)) if len(owner) else np.zeros(len(some), np.int64)
            words = np.insert(hashes, np.cumsum(counts), END)
            counts = counts + 1
            if parts and held + len(words) > BLOCK_WORDS:
                yield row()
                parts, held = [], 0
            parts.append((ids[at : at + len(some)], learned[at : at + len(some)], counts, words))
            held += len(words)
    if parts:
        yield row()


def _pack_words(words: np.ndarray) -> list[pa.Array]:
    """The distinct hashes, common ones first, and the compressed places in that list."""
    values, where, n = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    packed = zstandard.ZstdCompressor(level=3).compress(rank[where].tobytes())
    return [pa.array([values[order].tobytes()], pa.binary()), pa.array([packed], pa.binary())]


def gram_keys(words: np.ndarray, counts: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each length in turn a 64-bit key of the n-gram that ends at each word; 0 where the text is too short.

    A text's first word has a START before it.
    """
    first = np.cumsum(counts) - counts
    position = np.arange(len(words)) - np.repeat(first, counts)
    keys = words
    yield keys
    for length in range(2, order + 1):
        before = np.concatenate([words[:1], keys[:-1]])
        if length == 2:
            before = np.where(position == 0, START, before)
            ok = np.ones(len(words), bool)
        else:
            ok = position >= length - 2
        keys = np.where(ok, mixed(before * _ODD + words + np.uint64(length)), np.uint64(0))
        yield keys


def _read_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["places"]), np.uint32)
    return np.frombuffer(row["words"], np.uint64)[places], np.array(row["counts"], np.int64), np.array(row["learned"], bool)


class Grams(NamedTuple):
    """The sorted keys of the n-grams of one length, for each place which is there, and for each one place that it is at."""

    keys: np.ndarray
    where: np.ndarray
    sample: np.ndarray


def _distinct(keys: np.ndarray) -> Grams:
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return Grams(keys[new], where, order[new])


def distinct_grams(words: np.ndarray, counts: np.ndarray, lengths: Iterable[int]) -> list[Grams]:
    """The n-grams of a block of each length.

    The list of single words has START as well, behind the last place.
    """
    return [
        _distinct(np.append(keys, START) if length == 1 else keys)
        for length, keys in enumerate(gram_keys(words, counts, max(lengths)), 1) if length in lengths
    ]


def _held(gram: Grams, weight: np.ndarray, texts: int) -> np.ndarray:
    """How often training texts of the block hold each n-gram; START once each."""
    weight = weight if len(weight) == len(gram.where) else np.append(weight, float(texts))
    return np.bincount(gram.where, weight, len(gram.keys)).astype(np.int64)


def _shares_of(keys: np.ndarray, shares: int) -> list[tuple[int, slice]]:
    """The shares that some of the sorted keys are dealt to, and which they are: a share is a stretch of all hashes."""
    share = (keys >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
    edge = np.flatnonzero(np.diff(share)) + 1
    begin, end = np.concatenate([[0], edge]), np.append(edge, len(keys))
    return [(int(share[a]), slice(a, b)) for a, b in zip(begin, end)] if len(keys) else []


def _dealt_rows(lengths: tuple[int, ...], shares: int):
    """A block's n-grams in packed lists, a row for each length and share of the hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts, learned = _read_block(row)
                weight = np.repeat(learned, counts).astype(float)
                for length, gram in zip(lengths, distinct_grams(words, counts, lengths)):
                    n = _held(gram, weight, learned.sum())
                    out = _shares_of(gram.keys, shares)
                    columns = [
                        pa.array([s for s, _ in out], pa.int32()), pa.array([row["block"]] * len(out)), pa.array([length] * len(out), pa.int32()),
                        pa.array([_packed_keys(gram.keys[at]) for _, at in out], pa.binary()), pa.array([_small(n[at]) for _, at in out], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["share", "block", "length", "keys", "n"])

    return tidy(rows)


def _small(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, compressed, behind that number of bytes."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(numbers.astype(f"<u{width}").tobytes())


def _large(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Rising 64-bit numbers: the gaps of their first 24 bits, which compress, and the other 40 as they are."""
    high = (keys >> np.uint64(40)).astype(np.int64)
    gaps = _small(np.diff(high))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return struct.pack("<qq", high[0], len(gaps)) + gaps + low


def _unpacked_keys(packed: bytes) -> np.ndarray:
    first, size = struct.unpack_from("<qq", packed)
    low = np.frombuffer(packed, np.uint8, offset=16 + size).reshape(-1, 5)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, :5] = low
    high = np.cumsum(np.concatenate([[first], _large(packed[16 : 16 + size])]))
    return keys.view("<u8").ravel() + (high.astype(np.uint64) << np.uint64(40))


def _sum_share(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of a share over all blocks, back to each block in the order it sent; and totals under no block."""
    lengths = table.column("length").to_pylist()
    packed, counts = table.column("keys"), table.column("n")
    back: list[bytes | None] = [None] * len(lengths)
    vocabulary = tokens = 0
    for length in set(lengths):
        rows = [i for i, x in enumerate(lengths) if x == length]
        keys = [_unpacked_keys(packed[i].as_py()) for i in rows]
        ends = np.cumsum([len(k) for k in keys])
        gram = _distinct(np.concatenate(keys))
        sums = np.bincount(gram.where, np.concatenate([_large(counts[i].as_py()) for i in rows]), len(gram.keys)).astype(np.int64)
        if length == 1:
            real = gram.keys != START
            vocabulary, tokens = int((sums[real] > 0).sum()), int(sums[real].sum())
        for i, at in zip(rows, np.split(gram.where, ends[:-1])):
            back[i] = _small(sums[at])
    share = key[0].as_py()
    give_back()
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), None], pa.string()), "share": pa.array([share] * (len(back) + 1), pa.int32()),
        "length": pa.array([*lengths, 0], pa.int32()), "sums": pa.array([*back, None], pa.binary()),
        "vocabulary": pa.array([0] * len(back) + [vocabulary], pa.int64()), "tokens": pa.array([0] * len(back) + [tokens], pa.int64()),
    })


def build_trie(grams: list[Grams], sums: list[np.ndarray], ids: np.ndarray, position: np.ndarray, vocabulary: int, tokens: int) -> Trie:
    """The trie of a block, from the sums of its n-grams; `ids` are its words' places among the single ones."""
    singles = grams[0].keys
    start = int(np.searchsorted(singles, START))
    n_words = len(singles)
    # All words that training lacks are one unknown word, as likely as that a new one comes.
    p = np.where(sums[0] > 0, sums[0], max(vocabulary, 1)) / max(tokens + vocabulary, 1)
    values, weights, lists, pointers = [_steps(np.log10(p))], [], [], []
    # What follows a word as a context: the start once a text, the end never.
    follows = sums[0].copy()
    end = int(np.searchsorted(singles, END))
    if end < n_words and singles[end] == END:
        follows[end] = 0
    context_count = follows
    # The context's node and the probability of each place's shorter n-gram, level by level.
    context_node, place_prob = _before(ids, position, start), p[ids]
    for gram, own in zip(grams[1:], sums[1:]):
        context, word = context_node[gram.sample], ids[gram.sample]
        total = np.append(context_count, 0)[context]
        prob = (own + STRENGTH * place_prob[gram.sample]) / (total + STRENGTH)
        # Every n-gram that training has is entered; its context is a node since training has that too.
        kept = np.flatnonzero((own > 0) & (gram.keys != 0))
        listed = context[kept] * np.int64(n_words) + word[kept]
        rank = np.argsort(listed)
        kept = kept[rank]
        lists.append(EliasFano.of(listed[rank]))
        sizes = np.bincount(context[kept], minlength=len(context_count))
        pointers.append(EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])))
        values.append(_steps(np.log10(prob[kept])))
        weights.append(_steps(np.where(context_count > 0, np.log10(STRENGTH / (context_count + STRENGTH)), 0.0)))
        if len(lists) == len(grams) - 1:
            break
        node = np.full(len(own), -1, np.int32)
        node[kept] = np.arange(len(kept))
        place_prob = np.where(gram.keys[gram.where] != 0, prob[gram.where], place_prob)
        context_count = np.where(word[kept] == end, 0, own[kept])
        # The context of the next length ends at the word before; a text's first word has none.
        context_node = _before(node[gram.where], position, -1)
    return Trie(n_words, lists, pointers, values, weights)


def _score_rows(order: int, shares: int, vocabulary: int, tokens: int):
    names = ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"]

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        sent = {(r["share"], r["length"]): r["sums"] for r in right.to_pylist()}
        for row in left.to_pylist():
            words, counts, learned = _read_block(row)
            grams = distinct_grams(words, counts, range(1, order + 1))
            del words
            sums = [
                np.concatenate([_large(sent[share, length]) for share, _ in _shares_of(gram.keys, shares)])
                for length, gram in enumerate(grams, 1)
            ]
            ids, begin = grams[0].where[:-1], np.cumsum(counts) - counts
            position = (np.arange(len(ids)) - np.repeat(begin, counts)).astype(np.int32)
            trie = build_trie(grams, sums, ids, position, vocabulary, tokens)
            logs = trie.score(ids, position, int(np.searchsorted(grams[0].keys, START)), grams)
            single = sums[0]
            del grams, sums, trie
            base = np.log10((single + 1) / (tokens + vocabulary + 1))[ids]
            parts = [
                row["doc_ids"], row["learned"], counts, np.add.reduceat((single > 0)[ids].astype(np.int64), begin),
                np.add.reduceat(base, begin), np.add.reduceat(logs, begin),
            ]
            for column, part in zip(out, parts):
                column.extend(part)
        give_back()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(c, k) for name, c, k in zip(names, out, kinds)})

    return score


def score_texts(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    `learn` says which rows the model learns from; all are scored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), learn.alias("learned"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(_block_rows, "block string, doc_ids array<long>, learned array<boolean>, counts array<long>, words binary, places binary"), "word-blocks")
    shares = max(1, blocks.count() // SHARE)
    kinds = "block string, share int, length int, sums binary, vocabulary long, tokens long"
    passes = []
    for lengths in [tuple(range(1, min(order, 2) + 1)), *((k,) for k in range(3, order + 1))]:
        dealt = blocks.mapInArrow(_dealt_rows(lengths, shares), "share int, block string, length int, keys binary, n binary")
        passes.append(stored(dealt.groupBy("share").applyInArrow(_sum_share, kinds), "gram-sums"))
    totals = passes[0].where("block is null").agg(F.sum("vocabulary").alias("v"), F.sum("tokens").alias("n")).first()
    vocabulary, tokens = totals.v or 0, totals.n or 0
    back = functools.reduce(DataFrame.unionByName, passes).where("block is not null").select("block", "share", "length", "sums")
    kinds = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score_rows(order, shares, vocabulary, tokens), kinds)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
