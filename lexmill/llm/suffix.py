"""Exact removal of repeated 100-byte strings by range-partitioned, locally sorted suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, lean, table, text_slices
from lexmill.llm.shingles import column_bytes, mix

LENGTH = 100  # bytes of a repeated string
GRAM = 32  # leading bytes that place a suffix
WINDOW = LENGTH - GRAM + 1  # grams of a string
LEFT = LENGTH - GRAM  # bytes before a gram that a string holding it can reach
RIGHT_WORDS, LEFT_WORDS = -(-LENGTH // 8), -(-LEFT // 8)  # eight-byte words of the two sides of a context
BROADCAST_IDS = 2_000_000
SMALL = 48  # rows that a sort no longer partitions
CHUNK = 1 << 22  # starts of strings that are sampled at once, whatever the length of a text
SLICE = 8_000_000  # bytes of text whose contexts are settled before they are shuffled
HELD = 300_000  # contexts that a bucket takes in before it settles what repeats
GROUPS = 30_000  # contexts, in whole groups of a gram, that are compared at once
SPLITTER_SAMPLE, MOST_SAMPLED = 64, 1_000_000  # sampled suffixes for each bucket, and in all
PLACE, FP = 47, 13  # bits: a place is a text's fingerprint, then position, bytes to the left, and reach

_RNG = np.random.default_rng(100_003)
_BYTES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = int(_RNG.integers(2**61, 2**62)) * 8 + 5  # odd: it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE % 2**64, pow(_BASE, -1, 2**64))):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _POWERS[i] = np.cumprod(full)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(body: np.ndarray, which: int) -> np.ndarray:
    """Sums from which ``ranges`` takes the hash of any range in constant time."""
    up, _ = powers(len(body) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[which][body] * up[: len(body)])])


def ranges(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sums[b] - sums[a]) * powers(len(sums))[1][a]


def anchors(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, first start, last start) of the sampled suffixes of all texts in ``body``.

    Of each LENGTH-byte string the gram with the least hash is sampled, the first
    one of equals: equal strings sample the same gram at the same distance. The
    strings that sample one gram start side by side, from the first start to the
    last. Long bodies are taken in chunks of starts.
    """
    parts = []
    ends = np.repeat(bounds[1:], np.diff(bounds))  # of each byte's text
    for begin in range(0, len(body) - LENGTH + 1, CHUNK):
        own = body[begin : begin + CHUNK + LENGTH - 1]
        n = len(own)
        sums = prefix_hashes(own, 0)
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][: n - GRAM + 1])
        low = np.uint64((1 << 28) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOW:
            least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        starts = np.flatnonzero(np.arange(begin, begin + len(least)) + LENGTH <= ends[begin : begin + len(least)])
        if len(starts):
            picked = (least[starts] & low).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
            at = picked[new]
            parts.append((at + begin, gram[at], starts[new] + begin, starts[np.append(new[1:], len(starts)) - 1] + begin))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, position, bytes to the left, bytes to the right) of places."""
    left, reach = (place >> 8) & 255, place & 255
    return (place >> PLACE) & ((1 << FP) - 1), (place >> 16) & ((1 << 31) - 1), left, LENGTH + reach - left


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, doc_id, place``: of a gram that a slice repeats, only the first row (bit 60) needs company elsewhere, and the others (bit 61) do not."""
    for batch in text_slices(batches, limit=2_000_000):
        body, bounds = column_bytes(batch.column("text"))
        at, gram, first, last = anchors(body, bounds)
        text = np.searchsorted(bounds, at, "right") - 1
        doc, fp = batch.column("doc_id").to_numpy()[text], batch.column("fp").to_numpy()[text].astype(np.int64)
        place = (fp << PLACE) | ((at - bounds[text]) << 16) | ((at - first) << 8) | (last - first)
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        several = np.zeros(len(g), bool)
        several[:-1] = ~new[1:]
        flags = np.where(new, several.astype(np.int64) << 60, np.int64(1) << 61)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(doc[order]), pa.array(place[order] | flags)], ["gram", "doc_id", "place"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by gram, whose gram may occur elsewhere: a prefilter by hash, which settles nothing."""
    ahead: tuple | None = None  # the last row so far: its gram, id and place, and whether the row before shares its gram

    def out(doc, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place & ((1 << 60) - 1))], ["doc_id", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        gram, doc, place = (batch.column(c).to_numpy() for c in ("gram", "doc_id", "place"))
        same = gram[1:] == gram[:-1]
        keep = (place >> 60) > 0
        keep[1:] |= same
        keep[:-1] |= same
        if ahead is not None:
            keep[0] |= ahead[0] == gram[0]
            if ahead[3] or ahead[0] == gram[0]:
                yield out(np.array([ahead[1]]), np.array([ahead[2]]))
        ahead = gram[-1], doc[-1], place[-1], bool(keep[-1])
        keep[-1] = False
        if keep.any():
            yield out(doc[keep], place[keep])
    if ahead is not None and ahead[3]:
        yield out(np.array([ahead[1]]), np.array([ahead[2]]))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian 8-byte words: three-way partitions by one word at a time, vectorised.

    Rows below, at and above a pivot's word are parted; only those at it go on to
    the next word, so leading words that rows share are read once. Small parts
    are finished by a comparison sort of what is left of their rows.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, w = todo.pop()
        if b - a < 2 or w == words.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= SMALL:
            order[a:b] = rows[np.lexsort(words[rows, w:].T[::-1])]
            continue
        key = words[rows, w]
        pivot = np.sort(key[[0, (b - a) // 2, -1]])[1]
        below, above = key < pivot, key > pivot
        m, n = int(below.sum()), int(above.sum())
        order[a:b] = np.concatenate([rows[below], rows[~(below | above)], rows[above]])
        todo += [(a, a + m, w), (a + m, b - n, w + 1), (b - n, b, w)]
    return order


def windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, words: int, backwards: bool = False) -> np.ndarray:
    """Rows of ``words`` big-endian words: the ``size`` bytes from ``begin`` on, or backwards before it, then zeros."""
    step, parts = np.arange(words * 8), [np.zeros((0, words), np.uint64)]
    for a in range(0, len(begin), 16_384):
        own, n = begin[a : a + 16_384, None], size[a : a + 16_384, None]
        out = data[np.clip(own + (-1 - step if backwards else step), 0, len(data) - 1)]
        out[step >= n] = 0
        parts.append(out.view(">u8").astype(np.uint64))
    return np.concatenate(parts)


def settle(keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, covered rows): sorted by multikey quicksort, neighbours with one context keep the earliest place.

    A row is covered whole where an earlier place has the same bytes on both
    sides; rows at one place of one id do not cover each other.
    """
    order = multikey_quicksort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(1)
    group = np.cumsum(new) - 1
    pos = (place >> 16) & ((1 << 31) - 1)
    inner = np.lexsort((pos[order], doc[order], group))
    order = order[inner]
    first = order[np.flatnonzero(new)[group]]
    later = (doc[order] > doc[first]) | (pos[order] > pos[first])
    return first[new], order[later]


def repeated_spans(doc: np.ndarray, pos: np.ndarray, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray) -> np.ndarray:
    """Whether an earlier row has the same string, for rows of contexts (bytes; ``left`` backwards) in the order of ``right``, by bytes to the left.

    Neighbours' common prefixes cut the order into runs at every depth. A string
    that starts o bytes before the gram is the same in two rows if they share a
    run at depth LENGTH - o and the o bytes to the left.
    """
    n = len(doc)
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(1), differ.argmax(1), right.shape[1])
    place = np.empty(n, np.int64)
    place[np.lexsort((pos, doc))] = np.arange(n)
    # Classes of equal bytes to the left, one byte more at a time: exact, no hash.
    side, dup = np.zeros(n, np.int64), np.zeros((n, WINDOW), bool)
    for o in range(int(left_len.max(initial=0)) + 1):
        if o:
            side = np.unique(side * 256 + left[:, o - 1], return_inverse=True)[1]
        depth = LENGTH - o
        run = np.concatenate([[0], np.cumsum(common < depth)])
        rows = np.flatnonzero((right_len >= depth) & (left_len >= o))
        if len(rows) < 2:
            continue
        key = run[rows] * n + side[rows]
        own = np.lexsort((place[rows], key))
        rows, key = rows[own], key[own]
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        first = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        dup[rows, o] = (doc[rows] > doc[first]) | (pos[rows] > pos[first])
    return dup


def spans_of(dup: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of repeated strings of each row."""
    edge = np.zeros((len(dup), WINDOW + 2), np.int8)
    edge[:, 1:-1] = dup
    steps = np.diff(edge, axis=1)
    row, low = np.nonzero(steps == 1)
    high = np.nonzero(steps == -1)[1] - 1
    return row, pos[row] - high, pos[row] - low + LENGTH


_ROWS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("context", pa.binary())])


def _contexts(shared, buckets: int):
    """Contexts by bucket; those that a slice of texts settles have no bytes and need no company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value
        for batch in text_slices(batches, limit=SLICE):
            body, bounds = column_bytes(batch.column("text"))
            lists = batch.column("places")
            place = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            doc = batch.column("doc_id").to_numpy()[row]
            _, pos, left, right = unpack(place)
            at = bounds[row] + pos
            keys = np.concatenate([windows(body, at, right, RIGHT_WORDS), windows(body, at, left, LEFT_WORDS, True), (left * 256 + right).astype(np.uint64)[:, None]], 1)
            stay, covered = settle(keys, doc, place)
            bucket = np.searchsorted(splitters, _strings(keys[stay, :RIGHT_WORDS]), "right").astype(np.int32)
            for a in range(0, len(stay), 16_384):
                own = stay[a : a + 16_384]
                # The bytes to the right, then those to the left, backwards; the place tells how many are whose.
                size = left[own] + right[own]
                byte, step = np.ascontiguousarray(keys[own, :-1].astype(">u8")).view(np.uint8), np.arange(8 * (RIGHT_WORDS + LEFT_WORDS))
                data = byte[(step < right[own, None]) | ((step >= 8 * RIGHT_WORDS) & (step < 8 * RIGHT_WORDS + left[own, None]))]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                context = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 16_384]), pa.array(doc[own]), pa.array(place[own]), context], schema=_ROWS)
            if len(covered):
                away = (mix(doc[covered].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(away), pa.array(doc[covered]), pa.array(place[covered]), pa.nulls(len(covered), pa.binary())], schema=_ROWS)

    return run


def _strings(words: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings, which compare as their bytes do."""
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{words.shape[1] * 8}").ravel()


def _keys(context: pa.Array, place: np.ndarray) -> np.ndarray:
    _, _, left, right = unpack(place)
    body, bounds = column_bytes(context)
    return np.concatenate([windows(body, bounds[:-1], right, RIGHT_WORDS), windows(body, bounds[:-1] + right, left, LEFT_WORDS), (left * 256 + right).astype(np.uint64)[:, None]], 1)


_SPANS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("string", pa.binary())])


def _spans(doc, place, a, b, strings=None) -> pa.RecordBatch:
    fp = unpack(place)[0].astype(np.int32)
    text = pa.nulls(len(doc), pa.binary()) if strings is None else pa.array(strings, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(fp), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), text], schema=_SPANS)


def _compare(shared):
    """Repeated spans of a bucket's contexts, and the strings of those that meet its boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.unique(np.array([x[:GRAM] for x in shared.value], f"S{GRAM}"))
        held: list[tuple] = []
        count = 0

        def covered(doc, place) -> pa.RecordBatch:
            _, pos, left, right = unpack(place)
            return _spans(doc, place, pos - left, pos + right)

        def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            keys, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            stay, gone = settle(keys, doc, place)
            held[:] = [(keys[stay], doc[stay], place[stay])]
            return doc[gone], place[gone]

        for batch in batches:
            if not batch.num_rows:
                continue
            context, doc, place = batch.column("context"), batch.column("doc_id").to_numpy(), batch.column("place").to_numpy()
            bare = context.is_null().to_numpy(zero_copy_only=False)
            if bare.any():
                yield covered(doc[bare], place[bare])
            if not bare.all():
                full = np.flatnonzero(~bare)
                held.append((_keys(context.take(pa.array(full)), place[full]), doc[full], place[full]))
                count += len(full)
                if count >= HELD:
                    gone = together()
                    count = 0
                    if len(gone[0]):
                        yield covered(*gone)
        if not held:
            return
        gone = together()
        if len(gone[0]):
            yield covered(*gone)
        keys, doc, place = held.pop()  # in the order of their bytes
        lead = _strings(keys[:, : GRAM // 8])
        new = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
        sizes = np.diff(np.append(new, len(lead)))
        edge = np.isin(lead[new], edges) if len(edges) else np.zeros(len(new), bool)
        wanted = np.flatnonzero((sizes > 1) | edge)
        a = 0
        while a < len(wanted):
            b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[wanted[a:]]), GROUPS, "right")) + a)
            own = wanted[a:b]
            rows = np.repeat(new[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))
            k, d, p = keys[rows], doc[rows], place[rows]
            _, pos, left, right = unpack(p)
            byte = np.ascontiguousarray(k[:, :-1].astype(">u8")).view(np.uint8)
            right_bytes, left_bytes = byte[:, : RIGHT_WORDS * 8], byte[:, RIGHT_WORDS * 8 :]
            dup = repeated_spans(d, pos, right_bytes, right, left_bytes, left)
            row, x, y = spans_of(dup, pos)
            if len(row):
                yield _spans(d[row], p[row], x, y)
            # What is left at a boundary may have its like in another bucket.
            border = np.repeat(edge[own], sizes[own])
            offset = np.arange(WINDOW)
            row, o = np.nonzero(border[:, None] & ~dup & (offset <= left[:, None]) & (LENGTH - offset <= right[:, None]))
            for c in range(0, len(row), 50_000):
                r, q = row[c : c + 50_000], o[c : c + 50_000]
                strings = [left_bytes[i, :n][::-1].tobytes() + right_bytes[i, : LENGTH - n].tobytes() for i, n in zip(r.tolist(), q.tolist(), strict=True)]
                yield _spans(d[r], p[r], pos[r] - q, pos[r] - q + LENGTH, strings)
            a = b

    return run


def splitters(rows: DataFrame, hits: DataFrame, buckets: int, spark: SparkSession) -> np.ndarray:
    """At most ``buckets`` - 1 suffixes that cut a bounded sample into equal parts."""
    n = min(SPLITTER_SAMPLE * buckets, MOST_SAMPLED)
    total = hits.count()
    if not total or buckets < 2:
        return np.zeros(0, f"S{RIGHT_WORDS * 8}")
    picked = hits.filter(F.pmod(F.xxhash64("doc_id", "place"), F.lit(1 << 40)) < int(min(1.0, n / total) * (1 << 40)))
    picked = picked.groupBy("doc_id", "fp").agg(F.collect_list("place").alias("places"))
    texts = rows.join(F.broadcast(picked), ["doc_id", "fp"])  # about n rows at most

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2_000_000):
            body, bounds = column_bytes(batch.column("text"))
            lists = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            _, pos, _, right = unpack(lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(_strings(windows(body, bounds[row] + pos, right, RIGHT_WORDS)).tolist(), pa.binary())], ["suffix"])

    sample = texts.mapInArrow(suffixes, "suffix binary").collect()
    found = np.sort(np.array([bytes(r["suffix"]) for r in sample], f"S{RIGHT_WORDS * 8}"))
    if not len(found):
        return found
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets])


def merge_spans(starts: np.ndarray, ends: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes of a text of n bytes."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    a, b = np.maximum(starts[order], 0), np.minimum(ends[order], n)
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return list(zip(a[at].tolist(), reach[np.append(at[1:], len(a)) - 1].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in text_slices([big], limit=2_000_000):
            body, bounds = column_bytes(batch.column("text"))
            data, out = body.tobytes(), [[], [], [], [], []]
            for i, (a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True)):
                text = data[bounds[i] : bounds[i + 1]]
                spans = merge_spans(np.array(a, np.int64), np.array(b, np.int64), len(text))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                for column, v in zip(out, (len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": s, "end": e} for s, e in spans]), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_strings(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` per row; ``spans`` are the removed byte ranges.

    Every byte goes that lies in a LENGTH-byte string which also starts earlier:
    in a smaller id, or in the same document further left. Strings are judged on
    the input and never cross documents. All is decided on bytes.

    1. Of all suffixes those are sampled whose gram is the least of some string;
       each repeated string is then found around the sampled suffix it holds. A
       hash of the gram drops suffixes whose gram occurs once: a prefilter.
    2. The others get their context, the bytes that the strings around them
       reach. Within a slice of texts, contexts are sorted by multikey quicksort,
       and whoever repeats an earlier one whole is covered.
    3. Contexts are ranged by their suffixes with sampled splitters, which may
       cut inside a gram, and sorted in each bucket by multikey quicksort. Equal
       neighbours are settled as in a slice; the rest are compared by the
       prefixes they share with their neighbours and the bytes to the left.
    4. Suffixes in several buckets can share a string only if they begin with
       the gram of a splitter between them. The strings of these that are still
       open are compared across the boundaries, by an aggregate on their bytes
       with partial minima, so a gram that fills many buckets is no one's task.
    5. Spans are merged per document.

    Null and empty texts have 0 bytes. Rows with a null id are never compared.
    Rows that repeat an id are one place: they do not cover each other at equal
    positions. An empty table gives no rows; extra columns are ignored. Long
    texts are sampled in chunks; a text may have what a string of Spark can hold.
    """
    space = Workspace(spark, "suffix")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.pmod(F.xxhash64("text"), F.lit(1 << FP)).cast("int"))
    sampled = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).mapInArrow(lean(_sample), "gram long, doc_id long, place long")
    # Rows that need no company are dealt out by their place.
    dealt = sampled.repartition(parts, F.when(F.shiftright("place", 61) == 1, F.xxhash64("doc_id", "place")).otherwise(F.col("gram")))
    hits = space.save(dealt.sortWithinPartitions("gram").mapInArrow(_judge, "doc_id long, place long"), "hits")
    hits = hits.withColumn("fp", F.shiftrightunsigned("place", PLACE).cast("int"))
    cuts = spark.sparkContext.broadcast(splitters(rows, hits, parts, spark))
    lists = hits.groupBy("doc_id", "fp").agg(F.collect_list("place").alias("places"))
    contexts = _only(rows, lists, spark, space, "lists").mapInArrow(lean(_contexts(cuts, parts)), "bucket int, doc_id long, place long, context binary")
    ranged = contexts.repartitionById(parts, "bucket").select("doc_id", "place", "context")
    spans = space.save(ranged.mapInArrow(lean(_compare(cuts)), "doc_id long, fp int, a int, b int, string binary"), "spans")
    space.drop("lists")
    border = spans.filter("string IS NOT NULL")
    first = border.groupBy("string").agg(F.min(F.struct("doc_id", "a")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("string").alias("_s"), F.col("_first.doc_id").alias("_d"), F.col("_first.a").alias("_p"))
    across = border.join(first, F.col("string") == F.col("_s")).filter((F.col("doc_id") > F.col("_d")) | (F.col("a") > F.col("_p")))
    gone = spans.filter("string IS NULL").select("doc_id", "fp", "a", "b").unionByName(across.select("doc_id", "fp", "a", "b"))
    gone = space.save(gone.groupBy("doc_id", "fp").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "gone")
    touched = _only(rows, gone, spark, space, None).mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
    ids = gone.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"))
    few = gone.count() <= BROADCAST_IDS
    same = (rows["doc_id"] == F.col("_d")) & (rows["fp"] == F.col("_f"))
    others = rows.join(F.broadcast(ids) if few else ids, same, "left_anti")
    zero = F.lit(0).cast("long")
    others = others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return touched.unionByName(others)


def _only(rows: DataFrame, lists: DataFrame, spark: SparkSession, space: Workspace, name: str | None) -> DataFrame:
    """The texts that ``lists`` is about, with their lists; no other text is shuffled while the ids are few enough to broadcast."""
    lists = space.save(lists, name) if name else lists
    ids = lists.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"))
    if lists.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_d")) & (F.col("fp") == F.col("_f")), "left_semi")
    return rows.join(lists.hint("shuffle_hash"), ["doc_id", "fp"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents"), spark).drop("spans")


ORACLE = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
starts AS MATERIALIZED (SELECT doc_id, UNNEST(list_transform(range(len(t) // 2 - 99), lambda p: {'p': p, 's': substr(t, 2 * p + 1, 200)}), recursive := true) FROM docs WHERE len(t) >= 200),
first AS (SELECT s, MIN((doc_id, p)) AS f FROM starts GROUP BY s HAVING COUNT(*) > 1),
later AS (
  SELECT doc_id, p FROM starts JOIN first ON starts.s = first.s WHERE (doc_id, p) <> f),
edges AS (SELECT *, COALESCE(p > LAG(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, TRUE) AS opens FROM later),
numbered AS (SELECT *, SUM(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges),
runs AS (SELECT doc_id, run, MIN(p) AS a, MAX(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, run, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a, a AS b FROM runs
  UNION ALL SELECT doc_id, MAX(run) + 1, MAX(b), NULL FROM runs GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, string_agg(CASE WHEN g.b IS NULL THEN substr(t, 2 * g.a + 1) ELSE substr(t, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY run) AS rest
  FROM gaps g JOIN docs ON docs.doc_id = g.doc_id GROUP BY g.doc_id),
spans AS (SELECT doc_id, SUM(b - a) AS n, COUNT(*) AS k FROM runs GROUP BY doc_id)
SELECT docs.doc_id, (len(t) // 2)::BIGINT AS n_bytes, COALESCE(spans.n, 0)::BIGINT AS n_removed, COALESCE(spans.k, 0)::BIGINT AS n_spans,
       sha256(unhex(COALESCE(rest, t))) AS kept_sha256
FROM docs LEFT JOIN spans ON spans.doc_id = docs.doc_id LEFT JOIN kept ON kept.doc_id = docs.doc_id
"""
