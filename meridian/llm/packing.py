"""Cost-balanced packing of tokenized documents into sequences of bounded length.

The work of a sequence is estimated as linear plus quadratic attention cost of its pieces. Documents are
tokenized where they lie and packed block by block within a partition, so nothing is shuffled and memory is
bounded by a block. In a block, pieces in descending order go to the sequence of least cost that still has
room; a piece that fits nowhere is cut at the sequence with the most room. What fills no whole sequence is
carried into the next block, so one sequence of a partition, its last, may fall short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from meridian.llm.common import slices, texts
from meridian.llm.tokens import CACHE_PIECES, encoder

MAX_TOKENS = 2048
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, in units of one token's linear work.
LINEAR = 1.0
QUADRATIC = 1.0 / 12288
#: Tokens packed together; the sequences among which a block is balanced are this over max_tokens.
BLOCK_TOKENS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())])


def assign(lengths: list[int], n_sequences: int, max_tokens: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Places pieces into n_sequences: (piece, from, length, sequence, offset), and what found no room: (piece, from, length)."""
    cost = np.zeros(n_sequences)
    room = np.full(n_sequences, max_tokens, dtype=np.int64)
    placed: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []
    free = n_sequences * max_tokens
    for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
        at, n = 0, lengths[i]
        while n:
            if not free:
                left.append((i, at, n))
                break
            s = int(np.where(room >= n, cost, np.inf).argmin())
            if room[s] < n:
                s = int(room.argmax())
            take = min(n, int(room[s]))
            placed.append((i, at, take, s, max_tokens - int(room[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            free -= take
            at, n = at + take, n - take
    return placed, left


class Packer:
    """Packs one partition's documents; add() and end() give rows of SCHEMA."""

    def __init__(self, partition: int, max_tokens: int, block_tokens: int, linear: float, quadratic: float):
        self.first, self.count, self.max, self.block = partition << 40, 0, max_tokens, max(block_tokens, max_tokens)
        self.linear, self.quadratic = linear, quadratic
        self.pieces: list[tuple[int | None, int, np.ndarray, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), self.max):
            part = ids[at : at + self.max]
            self.pieces.append((doc_id, at, part, len(ids)))
            self.tokens += len(part)
            if self.tokens >= self.block:
                yield self.pack(self.tokens // self.max)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.tokens >= self.max:
            yield self.pack(self.tokens // self.max)
        if self.tokens:
            yield self.pack(1)

    def pack(self, n: int) -> pa.RecordBatch:
        placed, left = assign([len(p[2]) for p in self.pieces], n, self.max, self.linear, self.quadratic)
        rows: list[tuple] = []
        for i, at, size, s, offset in placed:
            doc, start, ids, total = self.pieces[i]
            rows.append((doc, start + at, size, ids[at : at + size].tobytes(), total, self.first + self.count + s, offset, self.linear * size + self.quadratic * size * size))
        self.count += n
        self.pieces = [(d, start + at, ids[at : at + size].copy(), total) for (d, start, ids, total), at, size in ((self.pieces[i], at, size) for i, at, size in left)]
        self.tokens = sum(len(p[2]) for p in self.pieces)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = MAX_TOKENS, block_tokens: int = BLOCK_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, cache: int = CACHE_PIECES) -> DataFrame:
    """Pieces of documents(doc_id, text) with their ids (little-endian unsigned 32-bit) and places in sequences.

    A null or empty text is one piece, its end id. A null doc_id stays null; repeated rows are packed each;
    other columns are ignored; an empty table gives no pieces. Rows of one sequence come from one partition. cache is
    how many pieces of text a worker keeps the ids of, and has no bearing on the result.
    """

    def run(batches):
        enc = encoder(tokenizer, cache)
        end = np.array([end_id], "<u4")
        packer = Packer(TaskContext.get().partitionId(), max_tokens, block_tokens, linear, quadratic)
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                yield from packer.add(doc, np.concatenate([enc.ids(text).astype("<u4"), end]))
        yield from packer.end()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
