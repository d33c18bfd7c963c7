"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, free_name, lean, table, text_slices
from lexmill.llm.shingles import mix, overlap, shingle_hashes, shingle_sets, word_hashes

SAMPLES = 128  # MinHash values of a set
BITS = 256  # of an odd sketch
#: A pair at the wanted similarity shares no band with this probability at most, and its sketches differ in more bits than allowed at five standard errors.
MISSED, ERRORS = 1e-7, 5
#: A contested group's rows meet in blocks of so many, or of so many shingles in all.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Ids up to this number are broadcast to pick texts for confirmation; beyond it they are joined.
BROADCAST_IDS = 2_000_000

_RNG = np.random.default_rng(7_919)
_MUL = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_ROW = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_SAMPLE = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_SET = np.uint64(0xD1342543DE82EF95)


def minhashes(values: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES permutations of 32 bits over one set."""
    short = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 2048):
        np.minimum(least, ((short[None, a : a + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=least)
    return least


def rows_of_band(percent: int) -> int:
    """The most rows a band can have at which a pair at the similarity is not missed; 4 for 80, so 32 bands."""
    for rows in (8, 7, 6, 5, 4, 3, 2, 1):
        if (1 - (percent / 100) ** rows) ** (SAMPLES // rows) <= MISSED:
            return rows
    raise ValueError(f"{SAMPLES} samples cannot find pairs that are {percent} per cent similar")


def most_bits(percent: int) -> int:
    """In how many bits the sketches of a pair at the similarity may differ."""
    s = percent / 100
    mean = BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - s) / BITS))
    slope, share = 2 * SAMPLES * np.exp(-4 * SAMPLES * (1 - s) / BITS), mean / BITS
    return int(mean + ERRORS * np.sqrt(BITS * share * (1 - share) + slope**2 * s * (1 - s) / SAMPLES))


def bands(samples: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit key per band of ``width`` rows of samples; the band's number is hashed in."""
    n = SAMPLES // width
    rows = samples[:, : n * width].astype(np.uint64).reshape(len(samples), n, width)
    return mix((rows * _ROW[:width]).sum(2, dtype=np.uint64) + _BAND[:n])


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """BITS parities per row: bit h(i, sample i) is flipped once for every sample."""
    n = len(samples)
    place = (mix(samples.astype(np.uint64) ^ _SAMPLE) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((place + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS).reshape(n, BITS)
    return np.packbits((flips & 1).astype(np.uint8), axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two sketches differ."""
    left = np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log(left)


def _sign(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2_000_000):
            hashes, bounds = shingle_hashes(*word_hashes(batch.column("text")), k)
            n = batch.num_rows
            samples, sizes, h = np.zeros((n, SAMPLES), np.uint32), np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a < b:
                    own = np.unique(hashes[a:b])
                    sizes[i], samples[i] = len(own), minhashes(own)
                    h[0, i], h[1, i] = own.sum(), mix(own * _SET).sum()
            keys, sketch = bands(samples, width).view(np.int64), odd_sketches(samples)
            wide = keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * wide, wide, dtype=np.int32)), pa.array(keys.ravel()))
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), lists, blob], ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for big in batches:
            for batch in text_slices([big], "text_b", 2_000_000):
                keep = np.zeros(batch.num_rows, bool)
                right = shingle_sets(batch.column("text_b"), k)
                for i, text in enumerate(batch.column("text_a").to_pylist()):
                    if text != last_text:  # rows come in the order of a
                        last_text, last = text, shingle_sets(pa.array([text], pa.string()), k)[0]
                    both = overlap(last, right[i])
                    keep[i] = both > 0 and 100 * both >= percent * (len(last) + len(right[i]) - both)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, space: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough. Only texts in pairs move."""
    pairs = space.save(pairs, f"{name}-pairs")
    ids = space.save(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["_id"], "left_semi")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    out = both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_confirm(k, percent), "a long, b long")
    return space.save(out.distinct(), f"{name}-links")


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``id, component`` for every end of an edge: the least id that it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step
    needs the least neighbour of every node, an aggregate with partial minima,
    and one join, so a hub is never one task's list. Every step is written and
    read again. The number of steps grows with the logarithm of the longest path.
    """
    now = space.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least).distinct()
        step += 1
        now = space.save(small, f"{name}-{step}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in text_slices([big], limit=2_000_000):
                sets = [x.tobytes() for x in shingle_sets(batch.column("text"), k)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "values"])

    return run


def _meet(percent: int):
    """Rows sorted by (leader, salt): links between components, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            lead, salt = batch.column("leader").to_numpy(), batch.column("salt").to_numpy()
            edges = np.flatnonzero((np.diff(lead) != 0) | (np.diff(salt) != 0)) + 1
            if held and (held[-1].column("leader")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (lead[0], salt[0]):
                yield _links(held, percent)
                held = []
            cuts = [0, *edges.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a and held:
                    yield _links(held, percent)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield _links(held, percent)

    return run


def _links(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """A spanning set of the links between a block of a group and a block of its rows outside the largest component.

    There are never more links than components less one. Pairs that a link found
    earlier has joined need no look. Close sketches are tried first.
    """
    t = pa.Table.from_batches(parts).combine_chunks()
    size, ids, comp, outer = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n_shingles", "id", "component", "outer"))
    raw, column, most = t.column("sketch").to_pylist(), t.column("values"), most_bits(percent)
    sketch = np.frombuffer(b"".join(raw), np.uint64).reshape(len(size), BITS // 64)
    names, root = np.unique(comp, return_inverse=True)
    out: list[tuple[int, int]] = []
    sets: dict[int, np.ndarray] = {}

    def values(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(column[i].as_py(), np.uint64)
        return sets[i]

    all_rows = np.flatnonzero(outer == 0)
    all_rows = all_rows[np.lexsort((ids[all_rows], size[all_rows]))]
    others = np.flatnonzero(outer == 1)
    for i in others[np.lexsort((ids[others], size[others]))].tolist() if len(names) > 1 else []:
        low, high = np.searchsorted(size[all_rows], -(-int(size[i]) * percent // 100)), np.searchsorted(size[all_rows], int(size[i]) * 100 // percent, "right")
        own = all_rows[low:high]
        apart = np.bitwise_count(sketch[own] ^ sketch[i]).sum(1)
        near = np.flatnonzero((apart <= most) & (root[own] != root[i]))
        for j in own[near[np.argsort(apart[near], kind="stable")]].tolist():
            if root[i] == root[j]:
                continue
            both = overlap(values(i), values(j))
            if both and 100 * both >= percent * int(size[i] + size[j] - both):
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[i]] = root[j]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, spark: SparkSession, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Words are lower-cased in A-Z; a document's set has its distinct k-word
    shingles, or the whole sequence where it has fewer words. Documents whose
    sets' Jaccard similarity is ``percent`` per cent or more are linked;
    ``component_id`` is the least id that a document reaches.

    1. Every set is sampled by MinHash; the samples give band keys and an odd
       sketch. Equal sets are one class, which its least id stands for.
    2. In each band bucket all classes meet the bucket's least id, its leader: a
       star, not all pairs. Sketches that are close enough go to confirmation
       on the full sets; confirmed links give components.
    3. Buckets that still hold several components are searched in full, with
       their shingle sets, in blocks of bounded size: every row outside a group's
       largest component meets all rows of the group, and no two rows of that
       component meet. Pairs of different components whose sketches are close
       are confirmed inside the task, which returns a spanning set of the links.
       So no link between components is lost for meeting at the wrong leader, and
       what leaves a group of copies is as many rows as it has members at most.

    The bands' width and the sketches' bound follow from ``percent``, which can
    be 15 at least and 100 at most.

    Null and empty texts have no shingles and are linked with nothing. A null id
    keeps a null component and is kept. Rows that repeat an id are one node, with
    the links of all its texts. An empty table gives no rows; extra columns are
    ignored.
    """
    if not 15 <= percent <= 100:
        raise ValueError("percent must be from 15 to 100")
    space = Workspace(spark, "neardup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = space.save(rows.mapInArrow(lean(_sign(k, rows_of_band(percent))), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"), "signatures")
    sets = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = space.save(sets.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "classes")
    rep = classes.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), "id")
    copies = sets.select("doc_id", "h1", "h2").join(rep, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))).filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    keys = classes.select("id", F.explode("bands").alias("key"))
    # Written, so that the join below is one of two shuffles, of which adaptive execution splits a hot key's.
    buckets = space.save(keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    members = space.save(keys.join(buckets, "key"), "members")
    traits = classes.select("id", "n_shingles", "sketch")
    star = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    left, right = (traits.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    star = star.join(right, "b").join(left, "a").filter(f"n_a * 100 >= n_b * {percent} AND n_b * 100 >= n_a * {percent}")
    links = confirmed(star.mapInArrow(_close(percent), "a long, b long"), rows, k, percent, space, "star")
    label = components(links, space, "first")
    # Buckets with several components left; two members have met already.
    known = members.filter("members > 2").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = space.save(known, "known")
    apart = known.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("key")
    apart = space.save(apart, "apart").hint("merge")  # both sides are shuffled, and a hot key's shuffle is split
    # Buckets of one leader meet as one group: bands of one family of texts mostly share it.
    group = space.save(known.join(apart, "key", "left_semi").select("leader", "id", "component").distinct(), "groups")
    group = group.join(traits, "id")
    parts = group.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = parts.groupBy("leader").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("top"))

    def blocks(n, s):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")

    sizes = sizes.select("leader", F.col("top.component").alias("top"), blocks(F.col("n"), F.col("s")).alias("many"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("few"))
    sizes = space.save(sizes, "sizes")
    placed = group.join(sizes, "leader")
    own = F.xxhash64("id")
    # Each block of all rows meets each block of those outside the largest component.
    inner = placed.select("leader", "id", "component", "n_shingles", "sketch", "few", F.pmod(own, F.col("many").cast("long")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("y"), F.lit(0).alias("outer"))
    outer = placed.filter("component <> top").select("leader", "id", "component", "n_shingles", "sketch", "few", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many").cast("long") - 1)).alias("x"), F.pmod(own, F.col("few")).cast("int").alias("y"), F.lit(1).alias("outer"))
    placed = inner.unionByName(outer).withColumn("salt", F.col("x") * F.col("few") + F.col("y"))
    ids = space.save(group.select("id").distinct(), "contested")
    few = ids.count() <= BROADCAST_IDS
    sets = rows.join(F.broadcast(ids) if few else ids, rows["doc_id"] == ids["id"], "left_semi").mapInArrow(_sets(k), "doc_id long, values binary")
    placed = placed.join(sets, F.col("id") == F.col("doc_id"))
    # A repeated id may have texts of other sizes than the class it stands for.
    placed = placed.filter(F.octet_length("values") == F.col("n_shingles") * 8)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select("leader", "salt", "id", "component", "outer", "n_shingles", "sketch", "values").repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt")
    all_links = links.union(placed.mapInArrow(_meet(percent), "a long, b long"))
    label = components(all_links.union(copies), space, "final")
    out = sig.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _close(percent: int):
    most = most_bits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("s_a", "s_b"))
            near = pa.array(np.bitwise_count(a ^ b).sum(1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

    return run


def drop_near_duplicates(docs: DataFrame, spark: SparkSession, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the least id stays, in one row of the least text."""
    flags = near_duplicates(docs, spark, k=k, percent=percent, id_col=id_col, text_col=text_col)
    gone = free_name(docs, "gone_")
    flags = flags.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(gone)).agg(F.bool_and("kept").alias("_kept"), F.count(F.lit(1)).alias("_seen")).filter("NOT _kept OR _seen > 1")
    flags = Workspace(spark, "flags").save(flags, "flags")
    once = docs.join(flags.select(gone), docs[id_col] == F.col(gone), "left_anti")
    # Kept ids in several rows: equal ids are one document, by one aggregate with partial minima.
    again = docs.join(flags.filter("_kept").select(gone), docs[id_col] == F.col(gone), "left_semi")
    rest = F.struct(*(F.col(c) for c in docs.columns))
    least = again.groupBy(F.col(id_col).alias(gone)).agg(F.min_by(rest, F.struct(F.col(text_col).isNull(), text_col)).alias("_row"))
    return once.unionByName(least.select("_row.*"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), spark, k=4)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
one AS (SELECT doc_id, UNNEST(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 80 * (x.n + y.n - COUNT(*))),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, c) AS (SELECT DISTINCT a, a FROM pairs UNION SELECT pairs.b, reach.c FROM reach JOIN pairs ON pairs.a = reach.id WHERE reach.c < pairs.b),
least AS (SELECT id, MIN(c) AS c FROM reach GROUP BY id)
SELECT sizes.doc_id, n AS n_shingles, COALESCE(c, sizes.doc_id) AS component_id, COALESCE(c, sizes.doc_id) = sizes.doc_id AS kept
FROM sizes LEFT JOIN least ON least.id = sizes.doc_id
"""
