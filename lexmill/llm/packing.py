"""Hierarchical packing of token sequences into several context sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import lean, table, text_slices
from lexmill.llm.tokens import MEMO_WORDS, encoder, tokenizer_path

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 16_384


class Packer:
    """Packs pieces of one task's documents; every closed window is full.

    A document gives up whole windows of the longest tier first; what is left
    goes to the shortest tier that holds it. Tiers are packed from the longest:
    its longest piece opens a window, whose gap takes the longest whole pieces
    of shorter tiers that fit, and then the head of one more, whose rest goes
    back to the tiers. A window that nothing is left for waits for the next
    documents. At the end the waiting pieces, fewer ids than one longest window
    holds, are cut into windows of powers of two, which need no padding.

    Each tier's windows form step groups of ``step_tokens`` ids, so that all
    steps of a tier, and of different tiers, cost the same.
    """

    def __init__(self, emit, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.emit, self.tiers, self.top = emit, tuple(sorted(tiers, reverse=True)), max(tiers)
        self.stacks: list[list] = [[] for _ in range(self.top + 1)]
        self.mask, self.tokens = 0, 0  # which lengths wait, and their ids
        self.step, self.sequences, self.groups = step_tokens, 0, 0
        self.open: dict[int, list[int]] = {}

    def add(self, doc, n: int, at: int) -> None:
        """A document's ids; ``doc`` is what emit gets back, ``at`` where its ids start there."""
        whole = n - n % self.top
        for start in range(0, whole, self.top):
            self._close(self.top, [(doc, start, self.top, at)])
        if n - whole:
            self._wait((doc, whole, n - whole, at))

    def _wait(self, piece) -> None:
        self.stacks[piece[2]].append(piece)
        self.mask |= 1 << piece[2]
        self.tokens += piece[2]

    def _take(self, most: int):
        """The longest waiting piece of at most so many ids, or None."""
        k = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if k < 1:
            return None
        piece = self.stacks[k].pop()
        if not self.stacks[k]:
            self.mask &= ~(1 << k)
        self.tokens -= k
        return piece

    def _shortest(self):
        low = self.mask & -self.mask
        return self._take(low.bit_length() - 1) if low else None

    def _close(self, size: int, pieces) -> None:
        group = self.open.setdefault(size, [self.groups, 0])
        if group[1] == 0:
            group[0], self.groups = self.groups, self.groups + 1
        offset = 0
        for doc, start, n, at in pieces:
            self.emit(doc, start, n, at, self.sequences, offset, size, group[0])
            offset += n
        self.sequences += 1
        group[1] = (group[1] + size) % self.step

    def pack(self) -> None:
        """Closes all windows that the waiting pieces can fill."""
        for size, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.tokens >= size and (first := self._take(size)) is not None:
                if first[2] <= below:  # this tier is empty
                    self._wait(first)
                    break
                pieces, gap = [first], size - first[2]
                while gap and (more := self._take(gap)) is not None:
                    pieces.append(more)
                    gap -= more[2]
                if gap:  # only longer pieces wait: the shortest gives its head
                    doc, start, n, at = self._shortest()
                    pieces.append((doc, start, gap, at))
                    self._wait((doc, start + gap, n - gap, at))
                self._close(size, pieces)

    def finish(self) -> None:
        self.pack()
        size = self.top
        while self.tokens:
            while size > self.tokens:
                size //= 2
            pieces, gap = [], size
            while gap:
                piece = self._take(gap)
                if piece is None:
                    doc, start, n, at = self._shortest()
                    piece = (doc, start, gap, at)
                    self._wait((doc, start + gap, n - gap, at))
                pieces.append(piece)
                gap -= piece[2]
            self._close(size, pieces)


def _pack(path: str, end_id: int, tiers, step_tokens: int, with_ids: bool, memo_words: int, slice_bytes: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = encoder(path, memo_words), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(doc, start, n, at, sequence, offset, tier, group):
            doc_id, total, ids = doc
            own = ids[at + start : at + start + n]
            rows.append((doc_id, start, n, zlib.crc32(own), total, base + sequence, offset, tier, base + group, *([own.tolist()] if with_ids else [])))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        packer = Packer(emit, tiers, step_tokens)
        for batch in text_slices(batches, limit=slice_bytes):
            ids, lens = coder.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(lens), end_id).astype("<u4")
            lens, at = (lens + 1).tolist(), 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lens, strict=True):
                rest = n - n % packer.top
                # What waits keeps its own copy, not the whole batch.
                if rest:
                    packer.add((doc_id, n, ids[at : at + n]), rest, 0)
                if n - rest:
                    packer._wait(((doc_id, n, ids[at + rest : at + n].copy()), rest, n - rest, -rest))
                at += n
            packer.pack()
            if rows:
                yield flush()
        packer.finish()
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, tiers=TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False, memo_words: int = MEMO_WORDS, slice_bytes: int = 4_000_000) -> DataFrame:
    """One row per piece: its document, place there, checksum, sequence, place there, tier and step group.

    Every id of every document, ``end_id`` after each, lies in exactly one piece.
    Sequences are windows of the tiers, or of a smaller power of two at the end
    of a task, and all are full: there is no padding at all. A task packs the
    documents of its own input split, so nothing is shuffled; sequence ids are
    unique, as the task's number is in their upper bits.

    Null and empty texts are ``end_id`` alone. Null ids stay null. Each row is a
    document, also one that repeats an id. An empty table gives no pieces. Extra
    columns are ignored. A text longer than a window spans many.

    ``memo_words`` and ``slice_bytes`` bound a worker's memory, at some cost in
    time; the result does not depend on them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lean(_pack(tokenizer or tokenizer_path(), end_id, tuple(tiers), step_tokens, with_ids, memo_words, slice_bytes)), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
