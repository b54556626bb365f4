"""Packing token documents into fixed windows by minimum bin slack.

Each task packs the documents of its own input partition as they stream by, so there is
no shuffle and memory is bounded by `pool_items` remainders.  A document fills whole
windows by itself; what is left of it (shorter than a window) waits in a pool.  When the
pool is full, windows are filled from it: the longest remainder opens a window, and a
subset-sum dynamic program over a bitset of reachable lengths picks the multiset of
other remainders that comes closest to the capacity; the counts are backtracked from the
bitsets kept for each length.  A gap that is left is filled by cutting one remainder,
and the last window of a task is split into power-of-two sequences, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_tokenizer, worker_bpe
from .common import give_back, text_bytes

#: sequence_id = input partition * SEQUENCES_PER_TASK + number in the task.
SEQUENCES_PER_TASK = 1 << 40

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, ids binary"
)


@dataclass
class Piece:
    """A run of a document's ids that is not yet in a sequence."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n])
        return head, Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:])


def closest_counts(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length sum as close to capacity as any multiset within counts.

    Bit s of `reach` is set if some choice sums to s.  Each length's count is split
    into powers of two, so a length costs O(log count) shifts; the bitset before each
    shift is kept and walked backwards to find the choice.
    """
    whole = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & whole
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + k
            best -= length * k
    return chosen


@dataclass
class Packer:
    window: int
    emit: Callable[[list[Piece]], None]
    pool: dict[int, list[Piece]] = field(default_factory=dict)
    n_pool: int = 0

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.window:
            head, piece = piece.cut(self.window)
            self.emit([head])
        if len(piece.ids):
            self._put(piece)

    def _put(self, piece: Piece) -> None:
        if piece.ids.base is not None:  # a view would keep all ids of its document
            piece.ids = piece.ids.copy()
        self.pool.setdefault(len(piece.ids), []).append(piece)
        self.n_pool += 1

    def _take(self, length: int) -> Piece:
        same = self.pool[length]
        piece = same.pop()
        if not same:
            del self.pool[length]
        self.n_pool -= 1
        return piece

    def fill(self, down_to: int = 0) -> None:
        """Fill windows until at most down_to remainders wait."""
        while self.n_pool > down_to:
            content = [self._take(max(self.pool))]
            room = self.window - len(content[0].ids)
            for length, k in closest_counts({x: len(y) for x, y in self.pool.items()}, room).items():
                content += [self._take(length) for _ in range(k)]
                room -= length * k
            if room and self.pool:  # what waits is longer than the gap, else it had been chosen
                head, rest = self._take(max(self.pool)).cut(room)
                content.append(head)
                self._put(rest)
                room = 0
            if room:
                self._split(content, self.window - room)
            else:
                self.emit(content)

    def _split(self, content: list[Piece], total: int) -> None:
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            left, sequence = 1 << bit, []
            while left:
                piece = content.pop(0)
                if len(piece.ids) > left:
                    piece, rest = piece.cut(left)
                    content.insert(0, rest)
                left -= len(piece.ids)
                sequence.append(piece)
            self.emit(sequence)


class _Rows:
    """Collects pieces as columns of PIECES."""

    def __init__(self, task: int):
        self.next_id, self.bytes = task * SEQUENCES_PER_TASK, 0
        self.columns: list[list] = [[] for _ in range(9)]

    def emit(self, sequence: list[Piece]) -> None:
        offset, total = 0, sum(len(p.ids) for p in sequence)
        for p in sequence:
            raw = p.ids.astype("<u4").tobytes()
            row = (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, self.next_id, offset, total, raw)
            for column, value in zip(self.columns, row, strict=True):
                column.append(value)
            offset += len(p.ids)
            self.bytes += len(raw)
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.binary()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names)
        self.columns, self.bytes = [[] for _ in range(9)], 0
        return out


def pack_documents(
    docs: DataFrame,
    window: int = 1024,
    tokenizer: str | None = None,
    separator: int = 0,
    pool_items: int = 4096,
    flush_bytes: int = 8 << 20,
) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens.

    docs needs doc_id and text; other columns are ignored, whatever their names.  Rows
    with a null doc_id or a repeated doc_id are documents of their own, equal texts too.
    A null or empty text is one token, the separator; a very long one fills windows as it
    is cut.  Returns one row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, ids
    (little-endian unsigned 32-bit).  An empty table gives no rows.  The same input
    partitions give the same rows.
    """
    path = tokenizer or default_tokenizer()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, rows = worker_bpe(path), _Rows(TaskContext.get().partitionId())
        packer, end = Packer(window, rows.emit), np.array([separator], np.uint32)
        for batch in batches:
            doc_ids, column = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 512):
                texts = [x.decode("utf-8", "replace") for x in column[a : a + 512].to_pylist()]
                for doc_id, ids in zip(doc_ids[a : a + 512].to_pylist(), bpe.encode(texts), strict=True):
                    packer.add(Piece(doc_id, 0, len(ids) + 1, np.concatenate((ids, end))))
                    if packer.n_pool >= pool_items:
                        packer.fill(pool_items // 2)
                    if rows.bytes >= flush_bytes:
                        yield rows.batch()
                        give_back()
        packer.fill()
        yield rows.batch()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(task, PIECES)
