"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

Forced boundaries: two neighbouring byte symbols that stand side by side in no
token of the vocabulary can never be merged into one token, so the text is cut
there for certain. The fragments between such cuts are encoded each by itself
and their ids put together again; the result is that of merging the whole word.

A null text is an empty text: no ids, and ids that are null or empty decode to
''. Texts are encoded whole, whatever their length. Repeated rows are treated
alike, an empty table gives no rows, further columns stay as they are. What stands
between two spaces, words and fragments are remembered per worker, each in about
REMEMBERED_BYTES at most; the memory of a task holds one Arrow batch.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from tokenizers import Tokenizer

from mailmill.llm.tables import give_back, ship

REMEMBERED_BYTES = 48 << 20
_ENTRY = 200
"""About what an entry takes besides its key and value."""
_SHORT = 24
_BITS = 20
_ID = (1 << _BITS) - 1
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [letters[b] for b in range(256)]


class _Remembered(dict):
    """Results by key, made when first asked for; emptied when they take too much room."""

    def __init__(self, make: Callable, most: int = REMEMBERED_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        self.held += _ENTRY + 5 * len(key)
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        return value


class Vocabulary:
    """Ids, merge ranks and forced boundaries of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        # Ids of a pair to its rank and the id it becomes, each in one number.
        self.merges = {
            self.ids[a] << _BITS | self.ids[b]: rank << _BITS | self.ids[a + b] for rank, (a, b) in enumerate(pairs)
        }
        self.tokens = {i: t for t, i in self.ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.specials.items()})
        self.letters = byte_letters()
        self.joined = {p for token in self.ids for p in _neighbours(self.symbols(token))}
        self.byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.inner = [self.ids[letter] for letter in self.letters]
        self.last = [self.ids[letter + self.end] for letter in self.letters]
        # Whether two bytes may be merged, inside a word and at its end.
        self.may_join, self.may_end = bytearray(1 << 16), bytearray(1 << 16)
        for left, right in self.joined:
            if left in self.byte_of:
                if right in self.byte_of:
                    self.may_join[self.byte_of[left] << 8 | self.byte_of[right]] = 1
                if right.removesuffix(self.end) in self.byte_of and right.endswith(self.end):
                    self.may_end[self.byte_of[left] << 8 | self.byte_of[right.removesuffix(self.end)]] = 1
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find_words = regex.compile(pattern).findall
        self.library = Tokenizer.from_file(path)
        self.agreed, self.odd = set(map(chr, range(128))), set()
        self.find_specials = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.pieces = _Remembered(self.encode_fragment)
        self.words = _Remembered(self.encode_word)
        self.parts = _Remembered(self.round_trip_part)

    def forget(self) -> None:
        for remembered in (self.pieces, self.words, self.parts):
            remembered.clear()
            remembered.held = 0

    def symbols(self, token: str) -> list[str]:
        """Byte symbols of a token as the vocabulary writes it; the last may carry the word's end."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fragments(self, word: bytes) -> Iterator[bytes]:
        """A word cut at every forced boundary; its last byte ends the word."""
        begin, last = 0, len(word) - 1
        may = self.may_join
        for at in range(1, last + 1):
            if at == last:
                may = self.may_end
            if not may[word[at - 1] << 8 | word[at]]:
                yield word[begin:at]
                begin = at
        yield word[begin:]

    def encode_fragment(self, key: bytes) -> bytes:
        """Ids of a fragment; the last one of a word has a line end behind it, which no word holds."""
        if key[-1] == 10:
            ids = [self.inner[b] for b in key[:-2]]
            ids.append(self.last[key[-2]])
        else:
            ids = [self.inner[b] for b in key]
        return array("i", self.merge(ids)).tobytes()

    def merge(self, ids: list[int]) -> list[int]:
        """A fragment after all merges, the lowest rank first, of equal ranks the leftmost."""
        return self._merge_short(ids) if len(ids) <= _SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        found = self.merges.get
        ways = [found(a << _BITS | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ways:
            best = min(ways)
            if best == _NEVER:
                break
            at = ways.index(best)
            ids[at : at + 2] = [best & _ID]
            del ways[at]
            if at:
                ways[at - 1] = found(ids[at - 1] << _BITS | ids[at], _NEVER)
            if at < len(ways):
                ways[at] = found(ids[at] << _BITS | ids[at + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, in n log n for n symbols."""
        ids = list(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        found = self.merges.get
        heap = [(way >> _BITS, i, pair) for i, pair in enumerate(a << _BITS | b for a, b in zip(ids, ids[1:])) if (way := found(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, pair = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] < 0 or nxt >= len(ids) or ids[at] << _BITS | ids[nxt] != pair:
                continue
            ids[at], ids[nxt] = self.merges[pair] & _ID, -1
            after[at] = after[nxt]
            if after[nxt] < len(ids):
                before[after[nxt]] = at
            for i in (before[at], at):
                if i >= 0 and after[i] < len(ids):
                    new = ids[i] << _BITS | ids[after[i]]
                    if (way := found(new)) is not None:
                        heapq.heappush(heap, (way >> _BITS, i, new))
        return [i for i in ids if i >= 0]

    def encode_bytes(self, word: bytes) -> bytes:
        *inner, last = self.fragments(word)
        return b"".join(map(self.pieces.__getitem__, [*inner, last + b"\n"]))

    def encode_word(self, word: str) -> bytes:
        return self.encode_bytes(word.encode("utf-8"))

    def round_trip_part(self, part: str) -> tuple[bytes, str]:
        """Ids of what stands between two spaces, and what they decode to."""
        packed = b"".join(map(self.words.__getitem__, self.find_words(part)))
        return packed, self.decode(array("i", packed).tolist())

    def is_odd(self, text: str) -> bool:
        """Whether the text has a letter that the library, of another Unicode version, puts in another class."""
        for c in set(text) - self.agreed - self.odd:
            probe = f"a{c}{c}a{c}#1{c}"
            theirs = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(probe))]
            own = ["".join(self.letters[b] for b in w.encode("utf-8")) for w in self.find_words(_lowered(probe))]
            (self.agreed if theirs == own else self.odd).add(c)
        return bool(self.odd) and not self.odd.isdisjoint(text)

    def parts_of(self, text: str) -> list[tuple[bytes, str]]:
        """Ids and decoded text of the parts of a text without special tokens. No word holds a space."""
        if not text.isascii():
            if self.is_odd(text):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                packed = b"".join(self.encode_bytes(bytes([self.byte_of[c] for c in w])) for w, _ in words if w)
                return [(packed, self.decode(array("i", packed).tolist()))]
            text = _lowered(text)
        else:
            text = text.lower()
        return list(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """The ids of a text, four bytes each, and what they decode to."""
        if "<|" not in text and not any(s in text for s in self.specials):
            parts = self.parts_of(text)
        else:
            special = {s: (array("i", [i]).tobytes(), s) for s, i in self.specials.items()}
            parts = []
            for piece in self.find_specials.split(text):
                parts += [special[piece]] if piece in special else self.parts_of(piece)
        return b"".join([ids for ids, _ in parts]), " ".join([shown for ids, shown in parts if ids])

    def encode_packed(self, text: str) -> bytes:
        return self.round_trip(text)[0]

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of known ids with a space between, as the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def _lowered(text: str) -> str:
    """Composed and in lower case letter by letter: a sigma at a word's end is no exception."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _neighbours(parts: list[str]) -> zip:
    return zip(parts, parts[1:])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: Column, path: str) -> Column:
    """array<int>: ids of each text under the tokenizer file at `path` on every worker."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        words = vocabulary(path)
        packed = [words.encode_packed(text.as_py() or "") for text in texts]
        offsets = np.cumsum([0, *map(len, packed)]) // 4
        ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)

    return ids_of(text)


def decode(ids: Column, path: str) -> Column:
    """Text of each array of ids."""

    @F.arrow_udf(StringType())
    def text_of(rows: pa.Array) -> pa.Array:
        words = vocabulary(path)
        ends, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        spans = zip(ends[:-1], ends[1:])
        return pa.array([words.decode(flat[a:b].tolist()) for a, b in spans], pa.string())

    return text_of(ids)


_BOTH = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds `ids` and `decoded`; columns that have these names already are replaced.

    Both come from one call: a text is decoded part by part as it is encoded, which is
    `decode(encode(text))`, as decoded parts stand side by side with a space between.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(path)
        for texts in batches:
            packed, shown = zip(*[words.round_trip(text.as_py() or "") for text in texts]) if len(texts) else ((), ())
            offsets = pa.array(np.cumsum([0, *map(len, packed)]) // 4, pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(shown, pa.string())], fields=list(_BOTH))
        words.forget()
        give_back()

    own = docs.select("*", both(F.col(text)).alias("_bpe"))
    return own.withColumns({"ids": F.col("_bpe.ids"), "decoded": F.col("_bpe.decoded")}).drop("_bpe")


def bpe_digest(coded: DataFrame) -> DataFrame:
    """Counts and digests of `round_trip`, a row per document."""
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
