"""Quality rules: how well public vocabularies fit a text.

Two public tokenizers measure a text: a byte-level vocabulary and one of pieces
that falls back to bytes. A text passes if its characters per token, its shares of
byte-fallback tokens and of tokens that hold marks only, and the entropy of its
tokens lie in the bands of its script (the script of most of its letters). Base counts of words, symbols and repeats
come from the same pass.

Words end at ASCII white space. Each distinct word of a slice of a batch is
tokenized once; everything else is array work over the slice. A slice holds
whole texts of SLICE_BYTES together, or a single longer text, so memory grows
with the longest text only. No shuffle.

A null or empty text has no words, fails the base rule and has zero measures.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.tables import ship

SLICE_BYTES = 4 << 20
WORDS = 300_000
WINDOW = 8

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "script:string,chars_per_token:double,chars_per_piece:double,fallback_share:double,mark_share:double,entropy:double>"
)
_ARROW = pa.struct([
    *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    ("script", pa.string()),
    *[(n, pa.float64()) for n in ("chars_per_token", "chars_per_piece", "fallback_share", "mark_share", "entropy")],
])


@dataclass(frozen=True)
class Band:
    """What a text of a script may measure. Bands are wide: they reject what no prose of the script has."""

    least_per_token: float
    most_per_token: float
    least_per_piece: float
    most_fallback: float
    most_marks: float
    least_entropy: float


BANDS = {
    "latin": Band(1.45, 8.0, 1.4, 0.12, 0.15, 2.5),
    "cyrillic": Band(0.5, 8.0, 1.2, 0.12, 0.2, 2.5),
    "greek": Band(0.4, 8.0, 0.9, 0.3, 0.2, 2.5),
    "han": Band(0.3, 4.0, 0.4, 0.6, 0.25, 2.5),
    "other": Band(0.2, 8.0, 0.3, 0.9, 0.3, 2.0),
}

# Symbols of the base rule, and the first and last letters of scripts by code point.
SYMBOLS = b"#*$%&|<>"
_SCRIPTS = (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("han", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0xAC00, 0xD7A3), ("han", 0x20000, 0x3134F))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False
_LATIN = np.zeros(256, bool)
_LATIN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = True
_HIGH = np.zeros(256, bool)
_HIGH[0xCA:0x100] = True


@functools.lru_cache(maxsize=2)
def _tools(ranks_path: str, pieces_path: str):
    import base64

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    merged = tiktoken.Encoding("ranks", pat_str=r"\s*\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    every = range(pieces.GetPieceSize())
    is_byte = np.array([pieces.IsByte(i) for i in every])
    plain = [pieces.IdToPiece(i).replace("\u2581", "") for i in every]
    # A piece of marks only. Bytes of fallback are letters of rarer scripts as a rule.
    is_mark = np.array([bool(p) and not any(c.isalnum() for c in p) for p in plain]) & ~is_byte
    return merged, pieces, is_byte, is_mark, {}


def _tokens_of(words: list[bytes], tools) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: number of byte-level tokens, of pieces; all pieces on end."""
    merged, pieces, _, _, known = tools
    if len(known) > WORDS:
        known.clear()
    new = [w for w in words if w not in known]
    texts = [w.decode("utf-8", "replace") for w in new]
    spaced = [" " + t for t in texts]
    for word, text, ids in zip(new, spaced, pieces.encode(texts, num_threads=1)):
        known[word] = (len(merged.encode_ordinary(text)), np.array(ids, np.int32))
    found = [known[w] for w in words]
    n_tokens = np.fromiter((n for n, _ in found), np.int64, len(found))
    n_pieces = np.fromiter((len(p) for _, p in found), np.int64, len(found))
    flat = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int32)
    return n_tokens, n_pieces, flat


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(word_ids: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window that its document holds twice or more."""
    covered = np.zeros(len(word_ids) + 1, np.int64)
    n = len(word_ids) - window + 1
    if n < 2:
        return covered[:-1] > 0
    starts = np.flatnonzero(doc[:n] == doc[window - 1 :])
    mixed = _mixed(word_ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    key = doc[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(window):
        key = (key + mixed[starts + k]) * np.uint64(0x2545F4914F6CDD1D + 2 * k)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    a, b = starts[order[same]], starts[order[same + 1]]
    # Equal keys are compared word by word.
    real = doc[a] == doc[b]
    for k in range(window):
        real &= word_ids[a + k] == word_ids[b + k]
    hit = np.unique(np.concatenate([a[real], b[real]]))
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + window, -1)
    return np.cumsum(covered)[:-1] > 0


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line and line.split(None, 1)]
    return len(lines) - len(set(lines))


def _script(text: str) -> str:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {"latin": int(((codes < 0x250) & (codes >= 0xC0)).sum() + (((codes | 32) >= 97) & ((codes | 32) <= 122)).sum())}
    for name, low, high in _SCRIPTS:
        counts[name] = counts.get(name, 0) + int(((codes >= low) & (codes <= high)).sum())
    counts["other"] = int((codes >= 0x250).sum()) - sum(counts[n] for n in ("greek", "cyrillic", "han"))
    best = max(counts, key=lambda n: counts[n])
    return best if counts[best] > 0 else "other"


def measure(texts: list[bytes], tools) -> list[np.ndarray | list[str]]:
    """The columns of RESULT for some texts."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, n) + 1
    starts = np.cumsum(lengths) - lengths

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), starts) if n else np.zeros(0, np.int64)

    space = _SPACE[raw]
    word_chars = per_text(~space & _HEAD[raw])
    n_symbols = per_text(_SYMBOL[raw])
    n_latin, n_high = per_text(_LATIN[raw]), per_text(_HIGH[raw])
    words = [w for t in texts for w in t.split()]
    begins = ~space & np.concatenate([[True], space[:-1]])
    n_words = per_text(begins)
    doc = np.repeat(np.arange(n), n_words)
    ids: dict[bytes, int] = {}
    word_ids = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeat = np.bincount(doc, repeated_words(word_ids, doc), n).astype(np.int64)

    n_tokens, n_pieces, flat = _tokens_of(list(ids), tools)
    ends = np.cumsum(n_pieces)
    of_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[flat])])[np.concatenate([[0], ends])])
    bytes_of_word, marks_of_word = of_word(tools[2]), of_word(tools[3])
    tokens = np.bincount(doc, n_tokens[word_ids], n)
    pieces = np.bincount(doc, n_pieces[word_ids], n)
    fallback = np.bincount(doc, bytes_of_word[word_ids], n)
    marks = np.bincount(doc, marks_of_word[word_ids], n)

    # Pieces of every text, then how often each text has each.
    many = n_pieces[word_ids]
    shift = np.repeat((ends - n_pieces)[word_ids] - (np.cumsum(many) - many), many)
    all_pieces = flat[np.arange(len(shift)) + shift]
    key = np.sort(np.repeat(doc, many) * np.int64(1 << 20) + all_pieces)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(key)]]))
    of = key[edge] >> 20
    share = count / np.maximum(pieces[of], 1)
    entropy = np.bincount(of, -share * np.log2(share), n) if len(of) else np.zeros(n)

    per = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    scripts = ["latin" if lat > high else _script(t.decode("utf-8", "replace")) for lat, high, t in zip(n_latin, n_high, texts)]
    dup = np.fromiter(map(_duplicate_lines, texts), np.int64, n)
    return [n_words, word_chars, n_symbols, dup, repeat, scripts, per(word_chars, tokens), per(word_chars, pieces), per(fallback, pieces), per(marks, pieces), entropy]


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > SLICE_BYTES:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def measures(text: Column, ranks_path: str, pieces_path: str) -> Column:
    """A struct of RESULT for each text."""

    @F.arrow_udf(RESULT)
    def measured(texts: pa.Array) -> pa.Array:
        tools = _tools(ranks_path, pieces_path)
        raw = [x.as_py() or b"" for x in texts.cast(pa.binary())]
        parts = [measure(some, tools) for some in _slices(raw)]
        columns = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(_ARROW))]
        arrays = [pa.array(c, field.type) for c, field in zip(columns, _ARROW)]
        return pa.StructArray.from_arrays(arrays, fields=list(_ARROW))

    return measured(text)


def judge_quality(docs: DataFrame, ranks_path: str, pieces_path: str, text: str = "text", bands: dict[str, Band] = BANDS) -> DataFrame:
    """Adds the measures, `base_failed`, `kept` and `reason`; columns of these names are replaced."""
    ship(docs.sparkSession)
    measured = docs.withColumn("_quality", measures(F.col(text), ranks_path, pieces_path))
    names = [f.name for f in _ARROW]
    wide = measured.withColumns({n: F.col(f"_quality.{n}") for n in names}).drop("_quality")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reason = F.when(F.col("base_failed"), "base")
    for script, b in bands.items():
        of = F.col("script") == script
        reason = (
            reason.when(of & ~F.col("chars_per_token").between(b.least_per_token, b.most_per_token), "characters per token")
            .when(of & (F.col("chars_per_piece") < b.least_per_piece), "characters per piece")
            .when(of & (F.col("fallback_share") > b.most_fallback), "byte fallback")
            .when(of & (F.col("mark_share") > b.most_marks), "marks")
            .when(of & (F.col("entropy") < b.least_entropy), "entropy")
        )
    judged = wide.withColumn("base_failed", base_failed).withColumn("reason", reason)
    return judged.withColumn("kept", F.col("reason").isNull())
