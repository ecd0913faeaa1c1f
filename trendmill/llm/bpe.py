"""BPE by speculation: greedy longest match proposes, pair checks verify.

A sequence of BPE tokens is the encoding of its text exactly when every pair of
neighbours encodes to itself, so a word whose greedy tokens pass that test in
all places is done. The pairs of a whole batch are tested at once against a
fixed-size table of known answers; only words with a failing pair are merged
symbol by symbol.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .text import U, chunks, mix

MEMO_BYTES = 64 << 20  # of written words that a worker keeps
PAIR_BITS = 20


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


class WordBpe:
    """Encoder and decoder for a word-end BPE file (NFC, lower case, split by pattern)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if model["type"] != "BPE" or len(split) != 1 or not model.get("end_of_word_suffix") or spec.get("decoder"):
            raise ValueError("a BPE file with word ends, one split pattern and no decoder is expected")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(split[0]["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.token = {k: t for t, k in self.vocab.items()} | {k: t for t, k in self.special.items()}
        self.end = model["end_of_word_suffix"]
        self.longest = max(map(len, self.vocab))
        self.reach: dict[str, int] = {}  # length of the longest token by its first three letters
        for token in self.vocab:
            if len(token) > self.reach.get(token[:3], 0):
                self.reach[token[:3]] = len(token)
        self.size = max(self.token) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(self.vocab[a] * self.size + self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        self.ends = {c: self.vocab[c + self.end] for c in byte_letters().values()}
        self.library = Tokenizer.from_str(source)
        self.byte_of = {letter: b for b, letter in byte_letters().items()}
        self.known = np.zeros(1 << PAIR_BITS, dtype=np.uint64)
        self.pieces: dict[str, tuple[str, str]] = {}
        self.held = 0

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: again and again the leftmost pair of the lowest rank, from a heap over linked neighbours."""
        symbols, size, rank, many = list(symbols), self.size, self.rank.get, len(symbols)
        after, before = [*range(1, many), -1], [*range(-1, many - 1)]
        waiting = [(r, k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(a * size + b)) is not None]
        heapify(waiting)
        while waiting:
            r, k = heappop(waiting)
            right = after[k]
            # a pair that has changed since has another rank; a place that was merged away has no symbol
            if symbols[k] < 0 or right < 0 or rank(symbols[k] * size + symbols[right]) != r:
                continue
            symbols[k], symbols[right], after[k] = self.made[r], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := rank(symbols[k] * size + symbols[after[k]])) is not None:
                    heappush(waiting, (r, k))
            left = before[k]
            if left >= 0 and (r := rank(symbols[left] * size + symbols[k])) is not None:
                heappush(waiting, (r, left))
        return [s for s in symbols if s >= 0]

    def symbols(self, text: str) -> list[int]:
        """Ids of single letters; a trailing word end belongs to the last letter."""
        if text.endswith(self.end) and len(text) > len(self.end):
            *body, last = text[: -len(self.end)]
            return [*map(self.vocab.__getitem__, body), self.ends[last]]
        return [*map(self.vocab.__getitem__, text)]

    def greedy(self, word: str) -> list[int]:
        out, at, size = [], 0, len(word)
        while at < size:
            last = self.vocab.get(word[at:] + self.end) if size - at <= self.longest else None
            if last is not None:
                out.append(last)
                return out
            for stop in range(min(size - 1, at + self.reach.get(word[at : at + 3], 2)), at, -1):
                token = self.vocab.get(word[at:stop])
                if token is not None:
                    out.append(token)
                    at = stop
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Does each pair encode to itself? A left of -1 asks about the right token alone."""
        codes = (left + 1).astype(np.uint64) * U(self.size) + right.astype(np.uint64) + U(1)
        codes, back = np.unique(codes, return_inverse=True)
        slot = (mix(codes) >> U(64 - PAIR_BITS)).astype(np.int64)
        answer = self.known[slot]
        fits = (answer & U(1)).astype(bool)
        for k in np.flatnonzero(answer >> U(1) != codes).tolist():
            a, b = divmod(int(codes[k]) - 1, self.size)
            text = ([self.token[a - 1]] if a else []) + [self.token[b]]
            fits[k] = self.merged(self.symbols("".join(text))) == ([a - 1] if a else []) + [b]
            self.known[slot[k]] = codes[k] << U(1) | U(fits[k])
        return fits[back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each byte-level word."""
        proposed = [self.greedy(w) for w in words]
        if not proposed:
            return proposed
        size = np.array([len(p) for p in proposed])
        right = np.concatenate(proposed)
        left = np.concatenate([[-1], right[:-1]])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        left[start] = -1
        alone = np.repeat(size == 1, size)
        asked = (left >= 0) | alone
        fits = np.ones(len(right), dtype=bool)
        fits[asked] = self.compatible(left[asked], right[asked])
        for k in np.flatnonzero(~np.logical_and.reduceat(fits, start)).tolist():
            proposed[k] = self.merged(self.symbols(words[k] + self.end))
        return proposed

    def decode(self, ids: list[int]) -> list[str]:
        return [self.token[k] for k in ids]

    def _written(self, ids: list[int]) -> tuple[str, str]:
        return "".join(f"{k} " for k in ids), "".join(f"{t} " for t in self.decode(ids))

    def _normal(self, text: str) -> list[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # characters that this Python doesn't know yet: the library's tables decide
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]
        # lower() treats a final sigma by its context, the file's rule doesn't
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if not self.specials or not any(s in text for s in self.special):
            return self._normal(text)
        out: list[str] = []
        at = 0
        for found in self.specials.finditer(text):
            out += [*self._normal(text[at : found.start()]), found.group()]
            at = found.end()
        return out + self._normal(text[at:])

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w not in self.special]
        letters = byte_letters()
        self.pieces |= {w: self._written([self.special[w]]) for w in new if w in self.special}
        for word, ids in zip(plain, self.encode_words([w.encode().decode("latin-1").translate(letters) for w in plain]), strict=True):
            self.pieces[word] = self._written(ids)
        # three strings of at least 50 bytes a word
        self.held += sum(300 + len(w) + sum(map(len, self.pieces[w])) for w in new)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, decimal ids and decoded text, joined by spaces."""
        if self.held > MEMO_BYTES:
            self.pieces.clear()
            self.held = 0
        split = [self._split(t) for t in texts]
        found = [list(map(self.pieces.get, own)) for own in split]
        gaps = [[k for k, f in enumerate(own) if f is None] for own in found]
        self._learn(list({own[k]: None for own, missing in zip(split, gaps, strict=True) for k in missing}))
        for own, written, missing in zip(split, found, gaps, strict=True):
            for k in missing:
                written[k] = self.pieces[own[k]]
            ids, decoded = "".join([a for a, _ in written]), "".join([b for _, b in written])
            yield ids.count(" "), ids[:-1], decoded[:-1]


@lru_cache(maxsize=2)
def _codec(source: str) -> WordBpe:
    return WordBpe(source)


def bpe_encode_decode(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: decimal ids and decoded text, both joined by spaces; then the columns ``keep``.

    ``tokenizer`` is the path of a word-end BPE file on the driver. A null or empty
    text has no tokens and two empty strings. Rows are independent: order, repeats,
    null ids and other columns of ``docs`` change nothing, an empty table gives no
    rows, and a text of any length is encoded whole.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for chunk in chunks(texts):
                done = list(codec.encode_texts(texts.slice(chunk.first, chunk.rows).to_pylist()))
                first, *more = (c.slice(chunk.first, chunk.rows) for k, c in enumerate(batch.columns) if k != 1)
                yield pa.RecordBatch.from_arrays(
                    [first, *(pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))), *more],
                    names=["doc_id", "n_tokens", "ids", "decoded", *keep],
                )

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    found = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    return own.mapInArrow(run, T.StructType([own.schema.fields[0], *found, *own.schema.fields[2:]]))
