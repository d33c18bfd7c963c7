"""Token-ID output: a static range asymmetric numeral system over interleaved blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, crc32_ids, lean, table, text_slices
from lexmill.llm.tokens import encoder, tokenizer_path

BITS = 20  # the frequencies of a table sum to 2**BITS
LANES = 2048  # interleaved states of a block
BLOCK_IDS = 262_144  # a block closes after the document that reaches so many ids
CHECKPOINT_STEPS = 128  # steps of all lanes between two checkpoints
MAGIC = b"LXR1"
_LOW = np.uint64(1 << 32)  # states lie in [2**32, 2**64)
_HEAD = struct.Struct("<4sIIIIII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**BITS; every symbol that occurs keeps at least 1."""
    counts = np.asarray(counts, np.float64)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (2**BITS / max(counts.sum(), 1)))), 0).astype(np.int64)
    if not out.any():
        out[0] = 1
    # Rounding up the rare ones may have taken too much: the frequent ones give it back.
    order, excess = np.argsort(-out, kind="stable"), int(out.sum()) - 2**BITS
    if excess < 0:
        out[order[0]] -= excess
    for i in order:
        if excess <= 0:
            break
        give = min(excess, int(out[i]) // 2)
        out[i], excess = out[i] - give, excess - give
    return out


class Coder:
    """Encodes and decodes blocks of ids by one shared frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.both = (self.freq << np.uint64(32)) | (np.cumsum(self.freq) - self.freq).astype(np.uint64)  # with the sums before: one look for two
        self.slots: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        """Lane j takes the ids j, j + LANES, ...; ids are coded last to first, so words are read first to last."""
        n, steps = len(ids), -(-len(ids) // LANES)
        freq = self.both[ids]
        cum = freq & np.uint64(0xFFFFFFFF)
        freq >>= np.uint64(32)
        state = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = []
        points: list[tuple[int, bytes]] = []
        written, room, bits = 0, np.uint64(64 - BITS), np.uint64(BITS)
        for t in range(steps - 1, -1, -1):
            a, b = t * LANES, min((t + 1) * LANES, n)
            f, x = freq[a:b], state[: b - a]
            over = (x >> room) >= f
            if over.any():
                words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
                written += int(over.sum())
                x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            state[: b - a] = (q << bits) + (x - q * f) + cum[a:b]
            if t and t % CHECKPOINT_STEPS == 0:
                points.append((written, state.astype("<u8").tobytes()))
        stream = np.concatenate(words)[::-1].astype("<u4").tobytes() if words else b""
        marks = b"".join(struct.pack("<I", written - w) + s for w, s in reversed(points))
        body = state.astype("<u8").tobytes() + marks + stream
        return _HEAD.pack(MAGIC, n, LANES, len(points), written, crc32_ids(ids), zlib.crc32(body)) + body

    def decode(self, blob: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a block; or those between two checkpoints, which other tasks need not have decoded."""
        magic, n, lanes, points, n_words, ids_crc, body_crc = _HEAD.unpack_from(blob)
        body = memoryview(blob)[_HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != body_crc:
            raise ValueError("damaged block: its payload has another checksum")
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 65536 else np.int32), self.freq.astype(np.int64))
        wide, steps = 8 * lanes, -(-n // lanes)
        state, at = np.frombuffer(body, "<u8", lanes).copy(), 0
        words = np.frombuffer(body, "<u4", n_words, wide + points * (wide + 4))
        if first:
            mark = wide + (first - 1) * (wide + 4)
            at = struct.unpack_from("<I", body, mark)[0]
            state = np.frombuffer(body, "<u8", lanes, mark + 4).copy()
        begin, end = first * CHECKPOINT_STEPS, steps if last is None else min(steps, last * CHECKPOINT_STEPS)
        out, mask, bits = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.int32), np.uint64(2**BITS - 1), np.uint64(BITS)
        for t in range(begin, end):
            k = min(lanes, n - t * lanes)
            x = state[:k]
            low = x & mask
            ids = self.slots[low]
            out[(t - begin) * lanes : (t - begin) * lanes + k] = ids
            both = self.both[ids]
            x = (both >> np.uint64(32)) * (x >> bits) + low - (both & np.uint64(0xFFFFFFFF))
            under = x < _LOW
            if m := int(under.sum()):
                x[under] = (x[under] << np.uint64(32)) | words[at : at + m]
                at += m
            state[:k] = x
        if not first and last is None and crc32_ids(out) != ids_crc:
            raise ValueError("damaged block: its ids have another checksum")
        return out


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = encoder(path), TaskContext.get().partitionId(), 0
        counts = np.zeros(max(end_id + 1, coder.tokenizer.get_vocab_size()), np.int64)
        for batch in text_slices(batches):
            ids, lens = coder.encode(batch.column("text").to_pylist())
            ends = np.cumsum(lens)
            ids = np.insert(ids, ends, end_id).astype("<u2" if coder.tokenizer.get_vocab_size() <= 65536 else "<u4")
            counts += np.bincount(ids, minlength=len(counts))
            lens = lens + 1
            starts = start + np.cumsum(lens) - lens
            start += int(lens.sum())
            offsets = np.concatenate([[0], np.cumsum(lens * ids.itemsize)]).astype(np.int32)
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lens), part, np.int32)), batch.column("doc_id"), pa.array(starts), pa.array(lens), blob, pa.array(np.full(len(lens), ids.itemsize, np.int32))], names)
        # The task's counts end its rows, so the frequencies need no second pass over the ids.
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.array([8], pa.int32())], names)

    names = ["part", "doc_id", "rel", "n_tokens", "ids", "wide"]
    return run


def _ids(batch: pa.RecordBatch, i: int, wide: int) -> np.ndarray:
    return np.frombuffer(batch.column("ids")[i].as_buffer(), f"<u{wide}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            counts = _ids(batch, i, 8).astype(np.int64)
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["id", "n"])


def _blocks(freq, bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = Coder(freq.value), bases.value
        names = ["part", "start", "doc_ids", "lengths", "block"]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        held: list[tuple] = []  # part, place there, doc ids, lengths, ids of whole documents that follow each other
        size = 0

        def block() -> pa.RecordBatch:
            part, rel = held[0][:2]
            row = [part, base[part] + rel, sum((h[2] for h in held), []), np.concatenate([h[3] for h in held]).tolist(), coder.encode(np.concatenate([h[4] for h in held]).astype(np.int64))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part, rel, n, wide = (batch.column(c).to_numpy() for c in ("part", "rel", "n_tokens", "wide"))
            doc_ids, column = batch.column("doc_id").to_pylist(), batch.column("ids")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, np.int32, len(n) + 1, column.offset * 4).astype(np.int64)
            # A block ends with its part, at a gap, and with the document that fills it.
            gap = np.concatenate([[False], (part[1:] != part[:-1]) | (rel[1:] != rel[:-1] + n[:-1])])
            if held and (held[-1][0] != part[0] or held[-1][1] + int(held[-1][3].sum()) != rel[0]):
                yield block()
                size = 0
            upto, a = np.cumsum(n), 0
            while a < len(n):
                full = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK_IDS - size)) + 1
                more = np.flatnonzero(gap[a + 1 : full])
                b = min(len(n), full) if not len(more) else a + 1 + int(more[0])
                own = np.frombuffer(data, np.uint8)[offsets[a] : offsets[b]].tobytes()
                held.append((int(part[a]), int(rel[a]), doc_ids[a:b], n[a:b], np.frombuffer(own, f"<u{wide[a]}")))
                size += int(n[a:b].sum())
                if size >= BLOCK_IDS or len(more):
                    yield block()
                    size = 0
                a = b
        if held:
            yield block()

    return run


def _documents(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = coder.decode(row["block"]), np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                crcs = [crc32_ids(ids[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - n), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_ids(docs: DataFrame, spark: SparkSession, out: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode every text, append ``end_id`` and write the ids to the folder ``out`` in ascending id order.

    ``out/table`` has the shared frequencies, ``out/blocks`` the blocks: each row
    is one independent block of whole documents (``part, start, doc_ids, lengths,
    block``); their ids ascend within a file and over the files in the order of
    their names, however the scans of the steps are split. Parquet
    is only the container, so that any store that Spark writes to will do and a
    failed task leaves nothing behind; ``block`` is the coder's own format, with a
    header, two checksums, the last states, checkpoints and the word stream.

    Null and empty texts are ``end_id`` alone. Null ids come first; rows that
    repeat an id follow each other in the order of their texts. An empty table
    gives an empty set of blocks. Extra columns are ignored.
    """
    path = tokenizer or tokenizer_path()
    space = Workspace(spark, "ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ids = space.save(ranged.mapInArrow(lean(_tokenise(path, end_id)), "part int, doc_id long, rel long, n_tokens long, ids binary, wide int"), "ids", "lz4")
    # One number per task and one per symbol of the vocabulary: both bounded, both small.
    bases, before = {}, 0
    for part, n in sorted(ids.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases[part], before = before, before + n
    counted = ids.filter("rel < 0").select("ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([end_id, *(r[0] for r in counted)]), np.int64)
    for i, n in counted:
        counts[i] = n
    freq = frequencies(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "id int, freq long").coalesce(1).write.mode("overwrite").parquet(f"{out}/table")
    sc = spark.sparkContext
    blocks = ids.filter("rel >= 0").mapInArrow(_blocks(sc.broadcast(freq), sc.broadcast(bases)), "part int, start long, doc_ids array<long>, lengths array<long>, block binary")
    # A scan deals splits out by their size; the coded blocks, the smallest form of the ids, are put in order again, a file for each part.
    blocks = blocks.repartitionById(max(bases, default=0) + 1, "part").sortWithinPartitions("start")
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{out}/blocks")
    space.drop("ids")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a folder that ``write_ids`` wrote; each block decodes by itself."""
    rows = spark.read.parquet(f"{out}/table").collect()
    freq = np.zeros(1 + max(r["id"] for r in rows), np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    blocks = spark.read.schema("part int, start long, doc_ids array<long>, lengths array<long>, block binary").parquet(f"{out}/blocks")
    return blocks.mapInArrow(_documents(spark.sparkContext.broadcast(freq)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), spark, space.root)
    return read_ids(spark, space.root)
