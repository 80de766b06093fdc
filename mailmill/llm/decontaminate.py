"""Benchmark decontamination by latent semantic retrieval.

    terms     words of the benchmark items, how many texts hold each, and how often two
              stand in one half passage, counted over all documents; terms in more than
              COMMON of the texts weigh nothing
    basis     randomised SVD of the TF-IDF of all half passages, from those counts: their
              sums lie in stripes of rows that tasks multiply, the driver takes the products
              one by one. The items count as much as all documents together
    search    every passage of every document against all items by cosine in the
              basis; a passage is PASSAGE words long and begins every half passage
    check     of what is near enough: the longest common subsequence of words of
              item and passage with its surroundings, and the item's answer, its
              last sentence, where the subsequence alone does not decide

Items come in blocks of BLOCK items, so that what is broadcast is bounded; each
block is one pass over the documents to count and one to search. Counts of pairs take
MOST_CELLS numbers a task: a block of more terms than fit is counted in further passes. Every passage of a whole text is compared
with every item of the block; nothing is capped. No shuffle of texts.

Words are runs of letters and digits, lower-cased. Null and empty texts, and items
without words, match nothing. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailmill.llm.lines import slices, word_hashes, words_of
from mailmill.llm.tables import give_back, ship, stored, tidy

PASSAGE = 48
COMMON = 0.1
RANK, OVERSAMPLED = 160, 32
MOST_CELLS, STRIPE_CELLS = 1 << 24, 1 << 18
MOST_MET = 1 << 25
"""Words after which a task sends its counts, which stay below 2**31."""
COSINE = 0.42
SURE, LIKELY, ANSWER = 0.6, 0.45, 0.8
LEAST_ANSWER = 3
BLOCK = 500

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Items:
    """Benchmark items of a block, with their words as 64-bit hashes."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[int]
    """How many of its last words are an item's answer; 0 where it has one sentence only."""


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts on end and the number of words of each."""
    raw, _, starts, ends, owner = words_of([t.lower() for t in texts], _BETWEEN)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    return (word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)), counts


def read_items(rows: list[tuple[int, str]]) -> Items:
    found = Items([], [], [])
    for item_id, text in rows:
        raw = (text or "").encode("utf-8")
        words, _ = tokens([raw])
        if item_id is None or not len(words):
            continue
        sentences = [s for s in raw.replace(b"!", b".").replace(b"?", b".").split(b".") if len(tokens([s])[0])]
        answer = len(tokens([sentences[-1]])[0]) if len(sentences) > 1 else 0
        found.ids.append(item_id)
        found.words.append(words)
        found.answers.append(answer)
    return found


class Index:
    """Terms with their weights, the basis, and the items in it."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, basis: np.ndarray, items: Items):
        self.terms, self.weight, self.items = terms, weight, items
        self.vectors = (weight[:, None] * basis).astype(np.float32)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        rows = [self.vectors[self.find(w)[1]].sum(axis=0) for w in items.words]
        self.matrix = _unit(np.array(rows, np.float32).reshape(len(rows), -1))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms of any weight: their places, and which."""
        return find_terms(words, self.terms, self.seen)

    def weighty(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms of a weight."""
        place, at = self.find(words)
        real = self.weight[at] > 0
        return place[real], at[real]


def find_terms(words: np.ndarray, terms: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are terms, and which."""
    place = np.flatnonzero(seen[(words & np.uint64(len(seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(terms, words[place]), len(terms) - 1)
    real = terms[at] == words[place]
    return place[real], at[real]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def segments_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half passages: first word of each, text of each, and whether it is the last of its text."""
    half = PASSAGE // 2
    many = -(-counts // half)
    owner = np.repeat(np.arange(len(counts)), many)
    within = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    first = (np.cumsum(counts) - counts)[owner] + within * half
    return first, owner, within == many[owner] - 1


def passage_vectors(place: np.ndarray, at: np.ndarray, counts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of passages in the basis, with their first words and texts; from places and numbers of terms."""
    first, owner, last = segments_of(counts)
    real = index.weight[at] > 0
    place, at = place[real], at[real]
    segment = np.searchsorted(first, place, side="right") - 1
    sums = np.zeros((len(first), index.vectors.shape[1]), np.float32)
    if len(place):
        begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        for i in range(0, len(begin), 4096):
            part = begin[i : i + 4096]
            stop = begin[i + 4096] if i + 4096 < len(begin) else len(place)
            sums[segment[part]] = np.add.reduceat(index.vectors[at[part[0] : stop]], part - part[0], axis=0)
    following = np.concatenate([sums[1:], np.zeros((1, sums.shape[1]), np.float32)])
    following[last] = 0
    # The last half passage of a text is the end of the one before.
    single = np.concatenate([[True], owner[1:] != owner[:-1]]) & last
    kept = np.flatnonzero(~last | single)
    return _unit((sums + following)[kept]), first[kept], owner[kept]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of `a`."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def check(item: list[int], answer: int, near: list[int]) -> tuple[bool, float]:
    """Whether a passage holds an item, and the share of the item's words in common order.

    `near` has the passage's words that the item has as well, in order; no other word
    can be part of a common subsequence.
    """
    share = lcs(item, near) / len(item)
    if share >= SURE:
        return True, share
    if share >= LIKELY and answer >= LEAST_ANSWER:
        return lcs(item[-answer:], near) / answer >= ANSWER, share
    return False, share


def common_at_most(term: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words the item and each stretch of `term` share, in whatever order.

    No common subsequence is longer. A word counts as often as the item has it: where
    as many equal ones stand before it in its stretch, it does not count.
    """
    times = np.bincount(item)
    order = np.argsort(term, kind="stable")
    back = np.arange(len(order)) - times[term[order]]
    same = (back >= 0) & (term[order[back]] == term[order])
    earlier = np.empty(len(term), np.int64)
    earlier[order] = np.where(same, order[back], -1)
    out = np.zeros(len(low), np.int64)
    for i in range(0, len(low), 1024):
        a, n = low[i : i + 1024], high[i : i + 1024] - low[i : i + 1024]
        begin = np.cumsum(n) - n
        counts = earlier[np.repeat(a - begin, n) + np.arange(n.sum())] < np.repeat(a, n)
        out[i : i + 1024] = np.add.reduceat(counts.astype(np.int64), begin)
    return out


def covered(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers that lie in any of the stretches, rising; both ends rise."""
    low = np.maximum(low, np.concatenate([[0], high[:-1]]))
    n = np.maximum(high - low, 0)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def near_passages(vectors: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, item and cosine of all pairs that are near enough, item by item."""
    found = []
    for i in range(0, len(vectors), 4096):
        cosine = vectors[i : i + 4096] @ matrix.T
        p, q = np.nonzero(cosine >= COSINE)
        found.append((p + i, q, cosine[p, q]))
    passage, item, cosine = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(item, kind="stable")
    return passage[order], item[order], cosine[order]


def search(texts: list[bytes], index: Index) -> list[tuple[int, int, int, float, float]]:
    """(text, item, first word, cosine, share) of every passage that holds an item."""
    words, counts = tokens(texts)
    if not len(words) or not len(index.items.ids):
        return []
    place, at = index.find(words)
    vectors, first, owner = passage_vectors(place, at, counts, index)
    ends = np.cumsum(counts)
    passage, item, cosine = near_passages(vectors, index.matrix)
    found = []
    edges = np.searchsorted(item, np.arange(len(index.items.ids) + 1))
    for q in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[q], edges[q + 1])
        own = np.searchsorted(index.terms, index.items.words[q])
        begin, text = first[passage[mine]], owner[passage[mine]]
        # The surroundings reach as far as an item that overlaps the passage.
        left, right = np.maximum(begin - len(own), ends[text] - counts[text]), np.minimum(begin + PASSAGE + len(own), ends[text])
        near = covered(np.searchsorted(place, left), np.searchsorted(place, right))
        # The item's words by small numbers, which sort fast; 0 is any other word.
        distinct = np.unique(own)
        number = np.zeros(len(index.terms), np.uint16 if len(distinct) < 1 << 16 else np.uint32)
        number[distinct] = np.arange(1, len(distinct) + 1)
        own, term = number[own], number[at[near]]
        shared = np.flatnonzero(term != 0)
        there, term = place[near[shared]], term[shared]
        low, high = np.searchsorted(there, left), np.searchsorted(there, right)
        listed, answer = own.tolist(), index.items.answers[q]
        # Few passages share enough words to have them in order.
        some = np.flatnonzero(high - low >= LIKELY * len(own))
        if not len(some):
            continue
        for k in some[common_at_most(term, own, low[some], high[some]) >= LIKELY * len(own)]:
            real, share = check(listed, answer, term[low[k] : high[k]].tolist())
            if real:
                t = int(text[k])
                found.append((t, int(q), int(begin[k] - (ends[t] - counts[t])), float(cosine[mine][k]), share))
    return found


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]


def count_pairs(cells: np.ndarray, low: int, segment: np.ndarray, at: np.ndarray) -> None:
    """Adds how often two terms stand in one half passage; `cells` has a row for each term from `low` on.

    Where the rows are all terms, a pair is added under the one that comes first in the text
    only, else under each that has a row.
    """
    high, n = low + len(cells), cells.shape[1]
    flat, one = cells.reshape(-1), np.int32(1)

    def add(rows: np.ndarray, columns: np.ndarray) -> None:
        if len(cells) < n:
            inside = np.flatnonzero((rows >= low) & (rows < high))
            rows, columns = rows[inside], columns[inside]
        np.add.at(flat, (rows - low) * np.int64(n) + columns, one)

    # A half passage has PASSAGE // 2 words.
    for step in range(1, PASSAGE // 2):
        same = np.flatnonzero(segment[step:] == segment[:-step])
        if not len(same):
            break
        add(at[same], at[same + step])
        if len(cells) < n:
            add(at[same + step], at[same])


def pair_stripes(cells: np.ndarray, low: int, occurs: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """First term and rows of each stripe of the sum over half passages of t t', t being how often each term occurs."""
    n = cells.shape[1]
    step = max(1, most // n)
    for i in range(0, len(cells), step):
        rows = cells[i : i + step]
        rows = rows + cells[:, i : i + step].T if len(cells) == n else rows.copy()
        own = np.arange(len(rows))
        rows[own, low + i + own] += occurs[low + i : low + i + len(rows)]
        if rows.any():
            yield low + i, rows


def _counts(terms: np.ndarray, low: int, high: int, in_stripe: int, most_met: int):
    """Stripes of counts of pairs of the terms from `low` to `high`. With those from 0 on, as the
    stripe -1, how many texts there are and how many hold each term."""
    n = len(terms)
    seen = np.zeros(1 << 18, bool)
    seen[(terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def stripe(first: int, numbers: np.ndarray) -> pa.RecordBatch:
        packed = zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([packed], pa.binary())], names=["stripe", "cells"])

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, occurs = np.zeros((high - low, n), np.int32), np.zeros(n, np.int32)
        total, held, met = 0, np.zeros(n, np.int64), 0
        for batch in batches:
            for _, some in slices(_texts(batch)):
                words, counts = tokens(some)
                place, at = find_terms(words, terms, seen)
                if low == 0:
                    text = np.searchsorted(np.cumsum(counts), place, side="right")
                    held += np.bincount(np.unique(text * np.int64(n) + at) % n, minlength=n)
                    total += len(some)
                first, _, _ = segments_of(counts)
                count_pairs(cells, low, np.searchsorted(first, place, side="right") - 1, at)
                occurs += np.bincount(at, minlength=n).astype(np.int32)
                met += len(words)
                if met >= most_met:
                    for i, part in pair_stripes(cells, low, occurs, in_stripe):
                        yield stripe(i, part)
                    cells[:], occurs[:], met = 0, 0, 0
        if low == 0:
            yield stripe(-1, np.append(held, total))
        for i, part in pair_stripes(cells, low, occurs, in_stripe):
            yield stripe(i, part)

    return rows


def _unpacked(row: dict) -> np.ndarray:
    kind = np.int64 if row["stripe"] < 0 else np.int32
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["cells"]), kind).astype(np.int64)


@tidy
def _stripe_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each stripe; those of one stripe come beside each other."""
    stripe, total = None, np.zeros(0, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["stripe", "cells"])

    for batch in batches:
        for part in batch.to_pylist():
            if part["stripe"] != stripe:
                if stripe is not None:
                    yield row()
                stripe, total = part["stripe"], np.int64(0)
            total = total + _unpacked(part)
    if stripe is not None:
        yield row()


def _products(weight: np.ndarray, right: np.ndarray):
    """Of each stripe its part of x right, x being the sum of a a' over half passages a; and of the trace of x."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                first = part["stripe"]
                x = np.frombuffer(part["cells"], np.int64).reshape(-1, len(weight)).astype(float)
                own = weight[first : first + len(x)]
                trace = float((x[np.arange(len(x)), first + np.arange(len(x))] * own**2).sum())
                product = own[:, None] * (x @ (weight[:, None] * right))
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([product.tobytes()], pa.binary()), pa.array([trace])], names=["stripe", "product", "trace"])

    return rows


def count_terms(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(stripe, cells): the counts of `_counts` over all documents, stored."""
    n = len(terms)
    step = max(1, MOST_CELLS // n)
    counted = None
    for low in range(0, n, step):
        some = docs.select("text").mapInArrow(_counts(terms, low, min(low + step, n), STRIPE_CELLS, MOST_MET), "stripe int, cells binary")
        counted = some if counted is None else counted.unionByName(some)
    dealt = counted.repartition("stripe").sortWithinPartitions("stripe")
    return stored(dealt.mapInArrow(_stripe_sums, "stripe int, cells binary"), "term-pairs")


def build_index(docs: DataFrame, items: Items, seed: int = 3) -> Index:
    terms = np.unique(np.concatenate(items.words))
    counted = count_terms(docs, terms)
    # One number for each word of the block's items, and the number of texts; no row where there are no texts.
    told = counted.where("stripe < 0").first()
    held = np.frombuffer(told.cells, np.int64) if told else np.zeros(len(terms) + 1, np.int64)
    total, df = max(int(held[-1]), 1), held[:-1].astype(float)
    weight = np.where(df > COMMON * total, 0.0, np.log((total + 1) / (df + 1)) + 0.1)
    if not weight.any():
        weight[:] = 1.0
    plain = Index(terms, weight, np.ones((len(terms), 1)), items)
    rows = np.zeros((len(items.words), len(terms)), np.float32)
    for i, w in enumerate(items.words):
        place, at = plain.weighty(w)
        np.add.at(rows[i], at, weight[at])
    rows = _unit(rows)
    pairs = counted.where("stripe >= 0")

    def times(right: np.ndarray) -> np.ndarray:
        """The product with the documents' matrix and the items', both of trace 1."""
        product, trace = np.zeros(right.shape), 0.0
        for part in pairs.mapInArrow(_products(weight, right), "stripe int, product binary, trace double").toLocalIterator():
            some = np.frombuffer(part.product).reshape(-1, right.shape[1])
            product[part.stripe : part.stripe + len(some)] = some
            trace += part.trace
        return product / (trace or 1.0) + rows.T @ (rows @ right) / len(rows)

    width = min(RANK + OVERSAMPLED, len(terms))
    right = np.random.default_rng(seed).standard_normal((len(terms), width))
    for _ in range(2):
        right, _ = np.linalg.qr(times(right))
    _, vectors = np.linalg.eigh(right.T @ times(right))
    basis = right @ vectors[:, ::-1][:, : min(RANK, width)]
    return Index(terms, weight, basis, items)


def item_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast index for each block of items."""
    spark = docs.sparkSession
    ship(spark)
    ranked = benchmark.where("item_id is not null").select("item_id", "text")
    blocks = max(1, -(-ranked.count() // BLOCK))
    for block in range(blocks):
        own = ranked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = read_items([(r.item_id, r.text) for r in own])
        if items.ids:
            shared = spark.sparkContext.broadcast(build_index(docs, items))
            # The driver does not keep what making the index took.
            give_back()
            yield shared


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, cosine, share): every passage of a document that holds an item."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word int, cosine double, share double")
    for index in item_blocks(docs, benchmark):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(_search_rows(index), out.schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item, with all their columns. Nothing is shuffled."""
    own = docs.select("doc_id", F.col(text).alias("text"))
    for index in item_blocks(own, benchmark):
        docs = docs.where(~_holds(index)(F.col(text)))
    return docs


def _holds(index):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for at, some in slices([x.as_py() or b"" for x in texts.cast(pa.binary())]):
            out[[at + hit[0] for hit in search(some, index.value)]] = True
        return pa.array(out)

    return holds


def _search_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, some in slices(_texts(batch)):
                hits = [(ids[at + t], index.items.ids[q], w, c, s) for t, q, w, c, s in search(some, index)]
                columns = list(zip(*hits)) if hits else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "first_word", "cosine", "share"])

    return rows
