"""Token ids in files of byte-aligned variable-length codes.

The store is a table of blocks in ascending document order. A block holds whole
documents: their ids and lengths, the block's token ids from most to least
frequent, two control bits a token in one byte string and the tokens' ranks, one
to four bytes each, in another. Control bytes are apart from data, so decoding is
one table lookup per control byte and a few numpy gathers.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .text import Chunk, chunks, span_hashes

MEMO_BYTES = 64 << 20  # of either half of a worker's memo
BLOCK_TOKENS = 1 << 20
CHUNK_BYTES = 1 << 21
#: Bytes that surely begin a visible character; those of white space don't.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
SCHEMA = "part int, block int, first_token long, doc_ids array<long>, n_tokens array<int>, ranked binary, control binary, payload binary"
LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    four[: len(values)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    begin = np.concatenate([[0], np.cumsum(extra.astype(np.int64) + 1)])
    data = np.zeros(begin[-1], dtype=np.uint8)
    for k in range(4):
        own = extra >= k
        data[begin[:-1][own] + k] = values[own] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, payload: bytes, count: int) -> np.ndarray:
    """The ``count`` values of ``pack``."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    begin = np.cumsum(size, dtype=np.int64) - size
    data = np.concatenate([np.frombuffer(payload, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    out = data[begin].astype(np.uint32)
    for k in range(1, 4):
        own = np.flatnonzero(size > k)
        out[own] |= data[begin[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryEncoder:
    """The library's ids, with a memo of the parts of texts.

    For a byte-level file without normaliser a space before a visible character
    always begins a token, so a text's ids are those of its parts, one after
    another. Each distinct part of a chunk is looked up once. Texts that hold a
    special token, and other kinds of files, go through the library whole.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.special = [t["content"] for t in spec["added_tokens"]]
        before = spec.get("pre_tokenizer") or {}
        self.by_parts = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        vocab = self.library.get_vocab(True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[k for t, k in vocab.items() if t.startswith("Ġ")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new parts; many that begin with a space share one library call."""
        spaced = [p for p in new if p[:1] == b" "]
        heads = [p for p in new if p[:1] != b" "]
        groups = [spaced[k : k + 128] for k in range(0, len(spaced), 128)]
        for group, ids in zip(groups, self.whole([b"".join(g).decode() for g in groups]), strict=True):
            begin = np.flatnonzero(self.opens[np.frombuffer(ids, dtype=np.uint32)])
            if len(begin) == len(group):
                at = [*(4 * begin).tolist(), len(ids)]
                self.memo.update((p, ids[a:b]) for p, a, b in zip(group, at, at[1:], strict=False))
            else:  # a part with spaces inside
                heads += group
        self.memo.update(zip(heads, self.whole([p.decode() for p in heads]), strict=True))

    def encode(self, chunk: Chunk) -> list[bytes]:
        """Little-endian 32-bit ids of every text of a chunk."""
        raw = chunk.data.tobytes()
        borders = chunk.offsets.tolist()
        if not self.by_parts:
            return self.whole([raw[a:b].decode() for a, b in zip(borders, borders[1:], strict=False)])
        if self.held > MEMO_BYTES:  # what is used again moves on to the new half
            self.memo, self.older, self.held = {}, self.memo, 0
        cut = np.zeros(len(chunk.data) + 1, dtype=bool)
        cut[:-1][:-1] = (chunk.data[:-1] == 0x20) & VISIBLE[chunk.data[1:]]
        cut[chunk.offsets[1:-1] - 1] = False  # the next character is another text's
        cut[chunk.offsets] = True
        cut[-1] = False
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(chunk.data))[: len(start)]
        _, first, back = np.unique(span_hashes(chunk.data, start, stop), return_index=True, return_inverse=True)
        parts = [raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        missing = [p for p in parts if p not in self.memo]
        self.memo.update((p, self.older[p]) for p in missing if p in self.older)
        self._learn([p for p in missing if p not in self.memo])
        own = [self.memo[p] for p in parts]
        self.held += sum(180 + len(p) + len(self.memo[p]) for p in missing)
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        begin = np.cumsum(size) - size
        each = size[back]
        end = np.cumsum(each)
        ids = np.frombuffer(b"".join(own), dtype=np.uint32)[np.repeat(begin[back] - end + each, each) + np.arange(end[-1] if len(end) else 0)].tobytes()
        at = np.concatenate([[0], 4 * end])[np.searchsorted(start, chunk.offsets)].tolist()
        out = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        if any(s.encode() in raw for s in self.special):
            for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                if any(s.encode() in raw[a:b] for s in self.special):
                    out[k] = self.whole([raw[a:b].decode()])[0]
        return out


@lru_cache(maxsize=2)
def _encoder(source: str) -> LibraryEncoder:
    return LibraryEncoder(source)


def _block(part: int, block: int, first: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    all_ids = np.frombuffer(b"".join(ids), dtype=np.uint32)
    counts = np.bincount(all_ids)
    ranked = np.lexsort((np.arange(len(counts)), -counts))[: int((counts > 0).sum())].astype(np.uint32)
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, payload = pack(rank[all_ids])
    row = {"part": part, "block": block, "first_token": first, "doc_ids": doc_ids, "n_tokens": [len(i) // 4 for i in ids], "ranked": ranked.tobytes(), "control": control, "payload": payload}
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id`` to each, and write the store at ``path``.

    Documents stand in ascending ``doc_id`` order, null ids first; repeated ids are
    ordered by their texts. A null or empty text has only the end id. A text is
    never cut; one beyond the block size makes a larger block of its own. An empty
    table writes an empty store. Other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype=np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source.value)
        part = TaskContext.get().partitionId()
        block = first = held = 0
        ids: list[bytes] = []
        names: list[int | None] = []
        for batch in batches:
            own_names = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), CHUNK_BYTES):
                new = encoder.encode(chunk)
                for name, own in zip(own_names[chunk.first : chunk.first + chunk.rows], new, strict=True):
                    ids.append(own + end)
                    names.append(name)
                    held += len(own) // 4 + 1
                    if held >= BLOCK_TOKENS:
                        yield _block(part, block, first, names, ids)
                        block, first, held, ids, names = block + 1, first + held, 0, [], []
        if ids:
            yield _block(part, block, first, names, ids)

    placed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids`` of a store.

    ``start`` counts the ids of all documents before. Only one row per written
    part is gathered for it.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("own"))
    before = totals.select("part", F.expr("coalesce(sum(own) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = np.array(row["n_tokens"], dtype=np.int64)
                ranked = np.frombuffer(row["ranked"], dtype=np.uint32)
                tokens = ranked[unpack(row["control"], row["payload"], int(size.sum()))].astype("<u4")
                stop = np.cumsum(size)
                begin = stop - size
                own = [tokens[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                columns = {
                    "part": pa.array([row["part"]] * len(own), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(begin + row["first_token"], pa.int64()),
                    "n_tokens": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(t.tobytes()) for t in own], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    read = blocks.mapInArrow(run, schema).join(before, "part")
    return read.withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
