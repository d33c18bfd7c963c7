"""Language-model scores by a hidden Markov model over the whole vocabulary."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, crc_remainder, table, text_slices
from lexmill.llm.shingles import column_bytes, place_hashes, word_places

STATES = 8
#: Hash slots; the most frequent word of each is a symbol of its own. All others are emitted by class, whatever the vocabulary's size.
SLOTS = 65_536
CLASSES = 81
#: Baum-Welch passes over all training documents: until one gains less than this share of the log likelihood, and at most so many.
SETTLED, PASSES = 1e-3, 8
PRIOR = 200.0  # weight of the corpus distribution in every state's emissions
SEGMENT = 1024  # symbols of a training sequence; longer texts are several
FLUSH = 400_000  # distinct words that a counting task holds
TASK_SYMBOLS = 8_000_000  # of a training task, where the cores stay busy
SLICE = 600_000  # symbols that advance together
FLOOR = 1e-6  # of the transitions' mass, even over the states, so that a few steps never underflow

log = logging.getLogger(__name__)


def word_classes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The classes of words by shape: two bytes from the first one beyond ASCII, the last byte, the length."""
    high = np.append(np.flatnonzero(body >= 128), len(body))
    at = high[np.searchsorted(high, starts)]
    inside = at + 1 < ends
    at = np.where(inside, at, 0)
    letter = np.where(inside, 1 + (body[at].astype(np.int64) * 31 + body[np.minimum(at + 1, len(body) - 1)]) % 8, 0)
    last, size = body[ends - 1], ends - starts
    plain = (last >= 128) | ((last >= 48) & (last < 58)) | (((last | 32) >= 97) & ((last | 32) < 123))
    end = np.where(plain, 0, np.where(np.isin(last, np.frombuffer(b".,;:?", np.uint8)), 1, 2))
    return ((letter * 3 + end) * 3 + np.where(size <= 4, 0, np.where(size <= 8, 1, 2))).astype(np.int64)


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)


def time_major(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, active, offsets): sequences longest first, how many go on at each step, and where a step's symbols start."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes[order[0]]) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(steps), "left")
    return order, active, np.concatenate([[0], np.cumsum(active)]).astype(np.int64)


def forward(ids: np.ndarray, bounds: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Log10 likelihood of every sequence by the scaled forward recursion, in doubles; all sequences advance together."""
    sizes = np.diff(bounds)
    order, active, at = time_major(sizes)
    begin, logs = bounds[:-1][order], np.zeros(len(sizes))
    top = emit.max(1)
    shape, a, t = emit / top[:, None], None, 0
    while t < len(active):
        until = max(t + 1, int(np.searchsorted(at, at[t] + SLICE, "right")) - 1)
        step = np.repeat(np.arange(t, until), active[t:until])
        e = shape[ids[begin[np.arange(at[t], at[until]) - at[step]] + step]]
        for u in range(t, until):
            k, own = active[u], e[at[u] - at[t] : at[u + 1] - at[t]]
            a = start * own if a is None else (a[:k] @ trans) * own
            ahead = active[u + 1] if u + 1 < len(active) else 0
            if u % 8 == 7 or ahead < k:
                s = a.sum(1)
                a /= s[:, None]
                logs[:k] += np.log10(s)
        t = until
    out = np.zeros(len(sizes))
    out[order] = logs
    if len(ids):
        own = np.log10(top)[ids]
        sums = np.concatenate([[0.0], np.cumsum(own)])
        out += sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def expect(ids: np.ndarray, bounds: np.ndarray, kind: np.ndarray, start: np.ndarray, trans: np.ndarray, emit: np.ndarray, counts: tuple) -> float:
    """Adds the expected counts of (start by kind, trans, emit) of non-empty sequences; their natural log likelihood.

    Scaled forward-backward in single precision. Emissions are divided by the
    highest of their symbol, so a few steps need no scaling.
    """
    sizes = np.diff(bounds)
    order, active, at = time_major(sizes)
    step = np.repeat(np.arange(len(active)), active)
    symbols = ids[bounds[:-1][order][np.arange(at[-1]) - at[step]] + step]
    top = emit.max(1)
    e = (emit / top[:, None]).astype(np.float32)[symbols]
    m = trans.astype(np.float32)
    alpha, beta, scale, logs = np.empty_like(e), np.empty_like(e), np.ones(len(e), np.float32), 0.0
    a = start[kind[order]].astype(np.float32) * e[: active[0]]
    for t, k in enumerate(active.tolist()):
        o = at[t]
        if t:
            a = a[:k] @ m
            a *= e[o : o + k]
        if t % 4 == 0:
            s = a.sum(1)
            a /= s[:, None]
            logs += float(np.log(s).sum(dtype=np.float64))
            scale[o : o + k] = s
        alpha[o : o + k] = a
        ahead = active[t + 1] if t + 1 < len(active) else 0
        if ahead < k:
            logs += float(np.log(a[ahead:].sum(1)).sum(dtype=np.float64))
    back, b = np.ascontiguousarray(m.T), None
    for t in range(len(active) - 1, -1, -1):
        own = beta[at[t] : at[t + 1]]
        own[:] = 1
        if b is not None:
            n = len(b)
            own[:n] = (e[at[t + 1] : at[t + 1] + n] * b) @ back
            if t % 4 == 0:
                own[:n] /= own[:n].sum(1)[:, None]
        b = own
    gamma = alpha * beta
    total = gamma.sum(1)
    first = int(active[0])
    after = e[first:] * beta[first:] / (total[first:] * scale[first:])[:, None]
    before = np.arange(first, len(e)) - np.repeat(active[:-1], active[1:])
    counts[1][:] += trans * (alpha[before].T @ after)
    gamma /= total[:, None]
    np.add.at(counts[0], kind[order], gamma[:first])
    for k in range(len(trans)):
        counts[2][:, k] += np.bincount(symbols, gamma[:, k], len(emit))
    return logs + float(np.log(top)[symbols].sum())


class Model:
    """Start chances of a text and of a later segment, transitions, and emissions of slots, classes and the end, in this order."""

    def __init__(self, totals: np.ndarray, states: int = STATES, seed: int = 5):
        self.unigram = (totals + 1) / (totals + 1).sum()
        rng = np.random.default_rng(seed)
        self.start = np.full((2, states), 1 / states)
        self.trans = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        self.emit = self.unigram[:, None] * np.exp(0.5 * rng.standard_normal((len(totals), states)))
        self.emit /= self.emit.sum(0)

    def update(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> None:
        self.start = (start + 1) / (start + 1).sum(1, keepdims=True)
        self.trans = (1 - FLOOR) * (trans + 1) / (trans + 1).sum(1, keepdims=True) + FLOOR / len(trans)
        emit = emit + PRIOR * self.unigram[:, None]
        self.emit = emit / emit.sum(0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, cls, n``: how often a task's words occur, by hash; cls is -1 for the ends of its texts."""
    held: list[np.ndarray] = []
    docs = 0

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        h, cls, n = np.concatenate(parts, axis=1)
        found, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return np.stack([found, cls[first], np.bincount(inverse, n.astype(np.float64), len(found)).astype(np.uint64)])

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1].astype(np.int32)), pa.array(rows[2].astype(np.int64))], ["h", "cls", "n"])

    for batch in text_slices(batches):
        body, bounds = column_bytes(batch.column("text"))
        starts, ends = word_places(body, bounds)
        docs += batch.num_rows
        if len(starts):
            h, first, n = np.unique(place_hashes(body, starts, ends), return_index=True, return_counts=True)
            held.append(np.stack([h, word_classes(body, starts[first], ends[first]).astype(np.uint64), n.astype(np.uint64)]))
            if sum(x.shape[1] for x in held[1:]) >= FLUSH:
                held = [merge(held)]
                if held[0].shape[1] >= FLUSH:
                    yield flush(held.pop())
    if held:
        yield flush(merge(held))
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([-1], pa.int32()), pa.array([docs])], ["h", "cls", "n"])


_TAIL = pa.list_(pa.struct([("h", pa.int64()), ("cls", pa.int32()), ("n", pa.int32())]))


def _encode(shared):
    """Symbols of every text with an end after it, the base score and number of its words that have slots, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winners, base, end = shared.value
        slots = len(winners)
        row = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches):
            body, bounds = column_bytes(batch.column("text"))
            starts, ends = word_places(body, bounds)
            h, texts = place_hashes(body, starts, ends), batch.num_rows
            slot, own = slot_of(h, slots), np.searchsorted(starts, bounds)
            hit = winners[slot] == h
            symbols, text = slot.astype("<i4"), np.repeat(np.arange(texts), np.diff(own))
            miss = np.flatnonzero(~hit)
            cls = word_classes(body, starts[miss], ends[miss])
            symbols[miss] = slots + cls
            sums = np.bincount(text[hit], base[slot[hit]], texts) + end
            known = np.bincount(text[hit], minlength=texts)
            # Every text's own words without a slot, each once.
            by = np.lexsort((h[miss], text[miss]))
            mh, mt, mc = h[miss][by], text[miss][by], cls[by]
            new = np.ones(len(by), bool)
            new[1:] = (mh[1:] != mh[:-1]) | (mt[1:] != mt[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(by)))
            rows = pa.StructArray.from_arrays([pa.array(mh[at].view(np.int64)), pa.array(mc[at].astype(np.int32)), pa.array(n.astype(np.int32))], fields=list(_TAIL.value_type))
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(mt[at], np.arange(texts + 1)).astype(np.int32)), rows)
            full = np.insert(symbols, own[1:], slots + CLASSES)
            edges = ((own + np.arange(texts + 1)) * 4).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), texts, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(full.astype("<i4").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(texts)), batch.column("doc_id"), ids, pa.array(sums), pa.array(known), tail], ["row", "doc_id", "ids", "base", "known", "tail"])
            row += texts

    return run


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their symbols and bounds; every row has a symbol, as a text has its end."""
    for batch in text_slices(batches, "ids", 4 * SLICE):
        offsets = np.frombuffer(batch.column("ids").buffers()[1], np.int32, batch.num_rows + 1, batch.column("ids").offset * 4).astype(np.int64)
        body = np.frombuffer(batch.column("ids").buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        yield batch, np.frombuffer(body.tobytes(), "<i4"), (offsets - offsets[0]) // 4


def segments(bounds: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of segments of at most ``size`` symbols, none across two texts, and their kinds: 0 opens a text, 1 goes on."""
    n = -(-np.diff(bounds) // size)
    which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.append(np.repeat(bounds[:-1], n) + which * size, bounds[-1]), (which > 0).astype(np.int64)


def _learn(shared):
    """Expected counts by row of (start, trans, emit), and the log likelihood as one row more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, trans, emit = shared.value
        counts, like = (np.zeros_like(start), np.zeros_like(trans), np.zeros_like(emit)), 0.0
        for _, ids, bounds in _symbols(batches):
            cuts, kind = segments(bounds)
            a = 0
            while a < len(kind):
                b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + SLICE, "right")) - 1)
                like += expect(ids[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], kind[a:b], start, trans, emit, counts)
                a = b
        rows = np.concatenate([*counts, np.full((1, len(trans)), like)])
        found = np.flatnonzero(rows.any(1))
        names = ["symbol", *(f"c{k}" for k in range(rows.shape[1]))]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *(pa.array(rows[found, k].astype(np.float32)) for k in range(rows.shape[1]))], names)

    return run


def baum_welch(texts: DataFrame, tokens: int, model: Model, spark: SparkSession, passes: int = PASSES) -> list[float]:
    """Fits the model to rows of ``ids`` in place, in distributed passes; the log likelihood before each of them."""
    states, likes = len(model.trans), []
    names = [f"c{k}" for k in range(states)]
    # A task's counts have a row per symbol, so tasks are few and long, but enough to keep the cores busy.
    cores = spark.sparkContext.defaultParallelism
    texts = texts.coalesce(min(4 * cores, max(cores, tokens // TASK_SYMBOLS)))
    for _ in range(passes):
        shared = spark.sparkContext.broadcast((model.start, model.trans, model.emit))
        learnt = texts.mapInArrow(_learn(shared), "symbol int, " + ", ".join(f"{c} float" for c in names))
        found = learnt.groupBy("symbol").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in names)).toArrow()
        shared.unpersist()
        summed = np.zeros((3 + states + len(model.emit), states))
        summed[found.column("symbol").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in names])
        likes.append(float(summed[-1, 0]))
        log.info("pass %d: log likelihood %.6g", len(likes), likes[-1])
        model.update(summed[:2], summed[2 : 2 + states], summed[2 + states : -1])
        if len(likes) > 1 and likes[-1] - likes[-2] <= SETTLED * abs(likes[-1]):
            break
    return likes


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, trans, emit = shared.value
        for batch, ids, bounds in _symbols(batches):
            score = pa.array(forward(ids, bounds, start[0], trans, emit))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(bounds)), batch.column("known"), batch.column("base"), score], ["row", "doc_id", "n_tokens", "n_slot", "base", "hmm"])

    return run


def _slot(slots: int) -> Column:
    return (F.shiftrightunsigned("h", 20) % slots).cast("int")


def score_texts(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, states: int = STATES, slots: int = SLOTS, passes: int = PASSES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Tokens are the words, lower-cased in A-Z, and one end per document. All rows
    outside the held-out fold are learnt from, whole. Words are told apart by
    64-bit hashes of all their bytes.

    The words are counted over the cluster. Their hashes fall into ``slots``, and
    the most frequent word of each slot is a symbol of the hidden Markov model;
    every other word, seen or not, belongs to one of CLASSES classes by its
    shape. A state emits a symbol, and a class emits its word by the word's own
    share (c + 1) / (n + v + 1), n and v being the class's tokens and distinct
    words in training. So the model is of one kind for any vocabulary. A text's
    likelihood is the forward recursion's over symbols times the shares of its
    words without slots; those need exact counts, which a join brings, so no task
    holds the vocabulary. Emissions of their own for all seen words were tried:
    no better on training texts, and worse on others by a bit a token.

    Seeded noise breaks the symmetry of the states. Texts are encoded once; every
    pass over the training documents runs forward-backward on whole texts, longer
    ones in segments of SEGMENT symbols, whose first states have chances of their
    own; the expected counts of all tasks are summed by symbol. There are passes
    until the log likelihood settles (SETTLED), ``passes`` at most, at any size.
    Scores then come from the recursion over the uncut texts.

    Null and empty texts are the end alone. A null id counts as the empty text
    where folds are dealt. Each row is a document, also one that repeats an id.
    Without training rows every symbol is equally likely. An empty table gives no
    rows; extra columns are ignored.
    """
    space, sc = Workspace(spark, "hmm"), spark.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = crc_remainder("doc_id", folds) == held_fold
    counted = rows.filter(~held).select("text").mapInArrow(_count, "h long, cls int, n long")
    counts = space.save(counted.groupBy("h", "cls").agg(F.sum("n").alias("n")), "counts")
    per_class = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    words, ends = [r for r in per_class if r["cls"] >= 0], sum(r["n"] for r in per_class if r["cls"] < 0)
    tokens, distinct = sum(r["n"] for r in words) + ends, sum(r["v"] for r in words) + (ends > 0)
    words_of, unit = counts.filter("cls >= 0"), float(tokens + distinct + 1)
    # One row per slot at most comes to the driver.
    most = words_of.groupBy(_slot(slots).alias("slot")).agg(F.max(F.struct("n", "h", "cls")).alias("m")).select("slot", "m.*").toArrow()
    slot, top_n, top_h, top_cls = (most.column(c).to_numpy() for c in ("slot", "n", "h", "cls"))
    winners, totals, sizes = np.zeros(slots, np.uint64), np.zeros(slots + CLASSES + 1), np.zeros((CLASSES, 2))
    winners[slot], totals[slot], totals[-1] = top_h.view(np.uint64), top_n, ends
    for r in words:
        sizes[r["cls"]] = r["n"], r["v"]
    sizes -= np.stack([np.bincount(top_cls, top_n, CLASSES), np.bincount(top_cls, minlength=CLASSES)], 1)
    totals[slots:-1] = sizes[:, 0]
    kind = rows.schema["doc_id"].dataType.simpleString()
    book = sc.broadcast((winners, np.log10((totals[:slots] + 1) / unit), float(np.log10((ends + 1) / unit))))
    encoded = rows.mapInArrow(_encode(book), f"row long, doc_id {kind}, ids binary, base double, known long, tail array<struct<h:long,cls:int,n:int>>")
    encoded = space.save(encoded, "encoded", "lz4")
    model = Model(totals, states)
    baum_welch(encoded.filter(~held).select("ids"), tokens, model, spark, passes)
    shared = sc.broadcast((model.start, model.trans, model.emit))
    scored = encoded.select("row", "doc_id", "ids", "base", "known").mapInArrow(_score(shared), f"row long, doc_id {kind}, n_tokens long, n_slot long, base double, hmm double")
    scored = space.save(scored, "scored")
    rare = encoded.select("row", F.inline("tail")).join(words_of.select("h", F.col("n").alias("c")), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = F.element_at(F.array(*(F.lit(float(n + v + 1)) for n, v in sizes.tolist())), F.col("cls") + 1)
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(unit))).alias("rare_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / share)).alias("rare_hmm"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    zero, one = F.lit(0.0), int(ends > 0)
    return (
        scored
        .join(rare, "row", "left")
        .select(
            "doc_id",
            held.alias("held_out"),
            "n_tokens",
            (F.col("n_slot") + one + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
            (F.col("hmm") + F.coalesce("rare_hmm", zero)).alias("score"),
        )
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), spark)
