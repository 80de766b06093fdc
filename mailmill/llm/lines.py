"""Line dedup: multi-line chunks that occur elsewhere already are removed from texts.

Chunks are CHUNK words, also over line ends; of the chunks that begin at any ROOM words
beside each other the one of the least hash is taken. The choice depends on nearby words
only, so equal passages have equal chunks wherever they stand, and one of LEAST_WORDS words
is not without one (but for some that begin with one word CHUNK times over).

    chunks   (key, place, hash) of every chunk, also where a text repeats it
    repeated hashes that occur in two texts or more
    runs     chunks that stand side by side in a text and in the text of the
             smallest key that has them, with equal bytes between
    spans    runs compared byte by byte with that other text, then made longer on
             both sides while the bytes agree
    result   texts without their spans of LEAST_WORDS words or more

The text of the smallest key keeps a passage, as often as it has it. A key is a hash of
id and text, so repeated rows share it, are compared once and cut alike. Texts travel compressed. Only hashes are
grouped globally; a chunk in a third of all texts is one row per task before the
shuffle, and the joins on it are split by adaptive execution.

A text that loses its last word goes; empty and null texts stay as they are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailmill.llm.tables import ship, stored, tidy
from mailmill.operators.bounded import broadcast_if_small

LEAST_WORDS = 25
CHUNK = 8
"""Words of a chunk."""
ROOM = LEAST_WORDS - CHUNK + 1
"""Words beside each other of which one begins a chunk, so that any LEAST_WORDS words hold a whole chunk."""
CONTEXT = 320
"""As many equal bytes beside a run as this are cut back to whole words."""
SLICE_BYTES = 1 << 20
CHUNKED_BYTES = 1 << 18
"""Bytes cut into chunks at a time; the arrays for it take some fifty times as many."""
SEGMENT = 24
"""Chunks of a run that are compared in one piece."""

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_SPACES = [b" ", b"\t", b"\n", b"\v", b"\f", b"\r"]
_GAP = re.compile(rb"\s")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _power_tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    size = 1 << bits
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.ones(size, np.uint64)
        table[1:] = np.uint64(base & _MASK)
        tables.append(np.cumprod(table, dtype=np.uint64))
    return tables[0], tables[1]


def byte_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes times powers, and the inverse powers."""
    powers, inverse = _power_tables(max(16, int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    values = raw.astype(np.uint64)
    values += np.uint64(1)
    values *= powers[: len(raw)]
    np.cumsum(values, out=sums[1:])
    return sums, inverse


def hashes_between(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, from sums of bytes times powers."""
    return hashes_between(*byte_sums(raw), starts, ends)


def words_of(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts on end, where each begins, and start, end and text of each word. `space` marks the bytes between words."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths) - lengths
    space = space[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    owner = np.searchsorted(begins, starts, side="right") - 1
    return raw, begins, starts, ends, owner


def _slid(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each value and those behind it, `width` together, as far as there are so many."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.concatenate([best(out[:-step], out[step:]), out[len(out) - step :]]) if step < len(out) else out
        have += step
    return out


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each chunk its text, hash, hash of the bytes up to the next one, and first and last byte (within
    its text), also with ROOM words on each side. No equal passage goes on further without a chunk."""
    raw, begins, starts, ends, owner = words_of(texts)
    n = len(starts) - CHUNK + 1
    # A chunk may begin at each word that CHUNK - 1 more words of its text follow.
    fits = owner[: max(n, 0)] == owner[CHUNK - 1 :] if n > 0 else np.zeros(0, bool)
    if not fits.any():
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    sums = byte_sums(raw)
    value = hashes_between(*sums, starts[:n], np.where(fits, ends[CHUNK - 1 :], ends[:n]))
    # One word on and on has no least chunk; there every CHUNK words begin one.
    again = fits & np.concatenate([[False], fits[:-1] & (value[1:] == value[:-1]) & (owner[1:n] == owner[: n - 1])])
    since = np.arange(n) - np.maximum.accumulate(np.where(again, 0, np.arange(n)))
    open_ = fits & ~again
    value_open = np.where(open_, value, np.uint64(_MASK))
    whole = np.zeros(n, bool)
    whole[: max(0, n - ROOM + 1)] = (owner[: max(0, n - ROOM + 1)] == owner[ROOM - 1 : n]) & fits[ROOM - 1 :]
    least = np.where(whole, _slid(value_open, ROOM, np.minimum), np.uint64(0))
    # The greatest of the least values of all stretches that a word is in is its own where it is the least of one.
    most = _slid(least[::-1], ROOM, np.maximum)[::-1]
    at = np.flatnonzero((open_ & (most == value_open)) | (again & (since % CHUNK == 0)))
    own = owner[at]
    upto = ends[at + CHUNK - 1]
    if len(at):
        upto = np.where(np.append(own[1:] == own[:-1], False), np.append(starts[at[1:]], 0), upto)
    link = hashes_between(*sums, starts[at], upto)
    first = np.searchsorted(owner, own)
    last = np.searchsorted(owner, own, side="right") - 1
    left, right = starts[np.maximum(at - ROOM, first)], ends[np.minimum(at + CHUNK - 1 + ROOM, last)]
    return own, value[at].view(np.int64), link.view(np.int64), *(x - begins[own] for x in (starts[at], ends[at + CHUNK - 1], left, right))


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in order, `most` bytes together or one longer text, with the number of those before."""
    at, some, size = 0, [], 0
    for i, text in enumerate(texts):
        if some and size + len(text) > most:
            yield at, some
            at, some, size = i, [], 0
        some.append(text)
        size += len(text)
    if some:
        yield at, some


@tidy
def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy()
        texts = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
        for at, some in slices(texts, CHUNKED_BYTES):
            own, hashes, links, *_ = chunks_of(some)
            place = np.arange(len(own)) - np.searchsorted(own, own)
            # The first of equal chunks of a text may stand for them in other texts; all are looked for there.
            # Chunks come by text and place, and the sort keeps that order among equal ones.
            order = np.lexsort((hashes, own))
            first = np.ones(len(own), bool)
            hashed, whose = hashes[order], own[order]
            first[order[1:]] = (hashed[1:] != hashed[:-1]) | (whose[1:] != whose[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at + own]), pa.array(place.astype(np.int32)), pa.array(hashes), pa.array(links), pa.array(first)],
                names=["key", "place", "hash", "link", "first"],
            )


def _key(text: str, doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _packed(texts: pa.Array) -> pa.Array:
    tool = zstandard.ZstdCompressor(level=1)
    return pa.array([None if (t := x.as_py()) is None else tool.compress(t) for x in texts.cast(pa.binary())], pa.binary())


def _unpacked(packed: pa.Array) -> Iterator[bytes]:
    tool = zstandard.ZstdDecompressor()
    return (tool.decompress(x.as_py()) for x in packed)


@tidy
def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run of chunks, and of what stands beside it."""
    names = ["key", "first", "last", "start", "end", "left", "body", "right"]
    for batch in batches:
        keys = batch.column("key").to_pylist()
        runs = batch.column("wanted").to_pylist()
        for at, some in slices(list(_unpacked(batch.column("packed"))), CHUNKED_BYTES):
            own, _, _, starts, ends, lefts, rights = chunks_of(some)
            base = np.searchsorted(own, np.arange(len(some)))
            rows: list[tuple] = []
            for i, text in enumerate(some):
                for w in runs[at + i]:
                    a, b = int(starts[base[i] + w["first"]]), int(ends[base[i] + w["last"]])
                    rows.append((keys[at + i], w["first"], w["last"], a, b, text[lefts[base[i] + w["first"]] : a], text[a:b], text[b : rights[base[i] + w["last"]]]))
                    if len(rows) > 2000:
                        yield _batch(rows, names)
                        rows = []
            yield _batch(rows, names)


_PIECE = "key long, first int, last int, start int, end int, left binary, body binary, right binary"
_PIECE_ARROW = [pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 3]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_ARROW)], names=names)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    unlike = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (unlike.bit_length() + 7) // 8


def grown(left: bytes, right: bytes, other_left: bytes, other_right: bytes) -> tuple[int, int]:
    """Bytes by which a match grows on both sides, in whole words.

    CONTEXT bytes may begin or end inside a word, and inside a character, of the text.
    """
    n = _common(left[::-1], other_left[::-1])
    if n == CONTEXT or any(n < len(x) and not x[len(x) - n - 1 : len(x) - n].isspace() for x in (left, other_left)):
        # The agreement begins inside a word: from the next space on.
        tail = left[len(left) - n :]
        gap = _GAP.search(tail)
        n = n - gap.start() if gap else 0
    m = _common(right, other_right)
    if m == CONTEXT or any(0 < m < len(x) and not x[m : m + 1].isspace() for x in (right, other_right)):
        m = max(0, *(right.rfind(space, 0, m) for space in _SPACES))
    return n, m


def _span(start: pa.Array, end: pa.Array, left: pa.Array, body: pa.Array, right: pa.Array, o_left: pa.Array, o_body: pa.Array, o_right: pa.Array) -> pa.Array:
    starts, ends, unlike = [], [], []
    for s, e, lt, bd, rt, ol, ob, rr in zip(*(c.to_pylist() for c in (start, end, left, body, right, o_left, o_body, o_right))):
        n, m = grown(lt, rt, ol, rr) if bd == ob else (0, 0)
        starts.append(s - n)
        ends.append(e + m)
        unlike.append(bd != ob)
    return pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"], mask=pa.array(unlike, pa.bool_()))


def without(text: bytes, spans: list[dict], least: int) -> tuple[bytes, int]:
    """A text without its spans, joined where they meet, of `least` words or more; and the words removed."""
    joined: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if joined and not text[joined[-1][1] : a].strip():
            joined[-1][1] = max(joined[-1][1], b)
        elif joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    kept, at, removed = [], 0, 0
    for a, b in joined:
        n = len(text[a:b].split())
        if n >= least:
            kept.append(text[at:a])
            at, removed = b, removed + n
    kept.append(text[at:])
    return b"".join(kept), removed


def repeated_runs(chunks: DataFrame) -> DataFrame:
    """(key, first, last, other, o_first): runs of chunks that stand in the text `other` as well."""
    home = chunks.where("first").groupBy("hash").agg(
        F.count("*").alias("n"), F.min("key").alias("other"), F.min_by("place", "key").alias("o_place"), F.min_by("link", "key").alias("o_link"))
    # One row for each repeated hash; the chunks of a frequent one are not sorted to meet it.
    home = home.where("n > 1").drop("n").hint("shuffle_hash")
    moved = chunks.drop("first").join(home, "hash").where("key != other").withColumn("shift", F.col("o_place") - F.col("place"))
    # A run goes on while chunks stand side by side in both texts, with the same bytes up to the next.
    side = Window.partitionBy("key", "other", "shift").orderBy("place")
    goes_on = (F.lag("place").over(side) == F.col("place") - 1) & F.lag(F.col("link") == F.col("o_link")).over(side)
    marked = moved.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("_new").over(side))
    runs = marked.groupBy("key", "other", "shift", "island").agg(F.min("place").alias("from"), F.max("place").alias("to"))
    runs = runs.withColumn("first", F.explode(F.sequence("from", "to", F.lit(SEGMENT))))
    runs = runs.withColumn("last", F.least(F.col("first") + SEGMENT - 1, "to"))
    return runs.select("key", "first", "last", "other", (F.col("first") + F.col("shift")).alias("o_first"), (F.col("last") + F.col("shift")).alias("o_last"))


def one_of_each(keyed: DataFrame) -> DataFrame:
    """Rows of (key, text), those of one key once.

    Keys are counted without their texts; only texts of keys that came more than once are grouped.
    """
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = broadcast_if_small(stored(several, "keys"))
    once = keyed.join(several, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return keyed.join(several, "key", "left_anti").unionByName(once)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, start, end) of bytes that stand in a text of a smaller key as well."""
    keyed = one_of_each(docs.where(F.col(text).isNotNull()).select(_key(text, doc_id).alias("key"), F.col(text).alias("text")))
    chunks = stored(keyed.mapInArrow(_chunk_rows, "key long, place int, hash long, link long, first boolean"), "chunks")
    runs = stored(repeated_runs(chunks), "runs")
    ranges = runs.select("key", "first", "last").unionByName(runs.select(F.col("other").alias("key"), F.col("o_first").alias("first"), F.col("o_last").alias("last")))
    wanted = ranges.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("wanted"))
    pack = F.arrow_udf(_packed, "binary")
    packed = keyed.select("key", pack("text").alias("packed"))
    pieces = stored(packed.join(wanted, "key").mapInArrow(_piece_rows, _PIECE), "pieces")
    other = pieces.select(F.col("key").alias("other"), F.col("first").alias("o_first"), F.col("last").alias("o_last"), F.col("left").alias("o_left"), F.col("body").alias("o_body"), F.col("right").alias("o_right"))
    both = runs.join(pieces, ["key", "first", "last"]).join(other, ["other", "o_first", "o_last"])
    span = F.arrow_udf(_span, "struct<start:int,end:int>")("start", "end", "left", "body", "right", "o_left", "o_body", "o_right")
    return both.select("key", span.alias("span")).where("span is not null").select("key", "span.start", "span.end")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs` with repeated passages cut from `text`, and `n_removed_words`.

    Other columns stay; a column called `n_removed_words` is replaced.
    """
    ship(docs.sparkSession)
    spans = repeated_spans(docs, text, doc_id).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = stored(spans, "spans").withColumnsRenamed({"key": "_lines_key", "spans": "_lines_spans"})

    @F.arrow_udf("struct<text:string,removed:bigint>")
    def cut(packed: pa.Array, all_spans: pa.Array) -> pa.Array:
        texts, removed = [], []
        for raw, own in zip(_unpacked(packed), all_spans):
            kept, n = without(raw, own.as_py(), least) if len(own) else (raw, 0)
            texts.append(kept)
            removed.append(n)
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64())], ["text", "removed"])

    order = docs.columns
    whole = docs.withColumn("_lines_key", _key(text, doc_id)).withColumn("_lines_packed", F.arrow_udf(_packed, "binary")(F.coalesce(F.col(text), F.lit(""))))
    whole = whole.withColumn("_lines_null", F.col(text).isNull()).drop(text)
    joined = whole.join(spans, "_lines_key", "left").withColumn("_lines_new", cut("_lines_packed", F.coalesce("_lines_spans", F.array().cast("array<struct<start:int,end:int>>"))))
    out = joined.withColumns({
        text: F.when(~F.col("_lines_null"), F.col("_lines_new.text")),
        "n_removed_words": F.col("_lines_new.removed"),
    })
    left = out.where((F.col("n_removed_words") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[c for c in order if c != "n_removed_words"], "n_removed_words")
