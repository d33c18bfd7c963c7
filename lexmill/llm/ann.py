"""Approximate nearest neighbours: an inverted file whose lists are scanned by adaptive dimension sampling."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, lean, least_hashes, table
from lexmill.llm.topk import matrices, valid_vectors

#: Rows that the lists' centres are fitted on, of which the first SEED_ROWS also bound each query's k-th distance and JUDGES ask for the probe share.
SAMPLE_ROWS, SEED_ROWS, JUDGES = 32_768, 1024, 400
#: The lists are the square root of the rows, as many as the sample can tell apart at most; so many vector lengths have lists.
MOST_LISTS, FITTED_LENGTHS = 8192, 16
#: The share of the sample's nearest rows that the probed lists shall hold; and rows that they hold at least, for each one asked for.
TARGET, LEAST = 0.97, 10
SHARD = 65_536  # rows that a task holds
COLUMNS = 16  # of a block of dimensions
EPSILON = 2.1  # of the hypothesis test (Gao and Long, 2023)

log = logging.getLogger(__name__)


def fit(sample: np.ndarray, lists: int, seed: int = 11, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation and the centres of spherical k-means, in the rotated space."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = sample @ rotation
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
    return rotation, centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int | None = None) -> np.ndarray:
    """The numbers of the lists of each row, nearest first; a few thousand rows at a time."""
    parts = [np.zeros((0, n or len(centres)), np.int64)]
    for a in range(0, len(x), 4096):
        near = x[a : a + 4096] @ centres.T
        parts.append(near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n])
    return np.concatenate(parts)


def probe_share(x: np.ndarray, centres: np.ndarray, k: int) -> float:
    """The least share of rows to probe, nearest lists first, so that TARGET of the k nearest of sampled rows are among them."""
    asked = x[:JUDGES]
    own = nearest_lists(x, centres, 1)[:, 0]
    sizes = np.bincount(own, minlength=len(centres))
    order = nearest_lists(asked, centres)
    upto = np.cumsum(sizes[order], axis=1)
    place = np.argsort(order, axis=1)  # of each list among a row's
    like = asked @ x.T
    like[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-like, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    rows = np.take_along_axis(upto, np.take_along_axis(place, own[best], 1), 1)
    return float(np.quantile(rows / len(x), TARGET, method="higher")) if rows.size else 1.0


class Lengths:
    """What tasks know of vectors of one length: the turned space, the lists and the share of rows to probe."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, lists: int, k: int):
        self.rotation, self.centres = fit(unit, lists)
        self.share = probe_share(unit @ self.rotation, self.centres, k)
        self.seed_ids, self.seeds = ids[:SEED_ROWS], unit[:SEED_ROWS]
        self.sizes = np.zeros(len(self.centres), np.int64)


def adaptive_scan(blocks: list[np.ndarray], rows: np.ndarray, q: np.ndarray, radius: float, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, int]:
    """Those of ``rows`` that may be among the k nearest of ``q``, and how many were given up before their last column block.

    ``blocks`` are the vectors' columns. Rows are taken in slices. After each
    block the partial squared distance, scaled to all dimensions, is tested
    against the k-th distance so far: after s of d dimensions a random rotation
    keeps it within a factor (1 + epsilon / sqrt(s))**2 of the truth but for a
    small probability, so rows above that are abandoned. What survives all blocks
    updates the distance.
    """
    kept, dist, given_up, d = [], np.zeros(0), 0, len(q)
    for a in range(0, len(rows), 512):
        own = rows[a : a + 512]
        part, e = np.zeros(len(own)), 0
        for x in blocks:
            c, e = e, e + x.shape[1]
            diff = x[own] - q[c:e]
            part = part + np.einsum("ij,ij->i", diff, diff)
            if e < d:
                alive = part * (d / e) <= radius * (1 + epsilon / np.sqrt(e)) ** 2
                given_up += int(len(own) - alive.sum())
                own, part = own[alive], part[alive]
                if not len(own):
                    break
        kept.append(own)
        dist = np.concatenate([dist, part])
        if len(dist) >= k:
            radius = min(radius, float(np.partition(dist, k - 1)[k - 1]))
    own = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return own[dist <= radius * (1 + 1e-9) + 1e-12], given_up


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1] * 8), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _assign(shared):
    """``list, d, id, radius, vector``: every row in its nearest list; lengths without lists have one."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for d, rows, x in matrices(batch):
                known = shared.value.get(d)
                own = nearest_lists(_units(x) @ known.rotation, known.centres, 1)[:, 0] if known else np.zeros(len(rows), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(rows), d, np.int32)), pa.array(ids[rows]), pa.array(np.full(len(rows), -1.0)), _binary(x.astype("<f8"))], ["list", "d", "id", "radius", "vector"])

    return run


def _bound(shared, k: int):
    """Queries with a bound of their k-th distance: that among a few rows."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for d, rows, x in matrices(batch):
                known, radius = shared.value.get(d), np.full(len(rows), np.inf)
                if known and len(known.seeds) > k:
                    like = np.where(known.seed_ids[None, :] == ids[rows][:, None], -np.inf, _units(x) @ known.seeds.T)
                    kth = np.sort(like, axis=1)[:, -k]
                    radius = np.where(np.isfinite(kth), np.maximum(2 - 2 * kth, 0) + 1e-9, np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), pa.array(np.full(len(rows), d, np.int32)), pa.array(ids[rows]), pa.array(radius), _binary(x.astype("<f8"))], ["list", "d", "id", "radius", "vector"])

    return run


class Shard:
    """A task's rows of one vector length, in lists, and searches in them."""

    def __init__(self, known: Lengths | None, lists: np.ndarray, ids: np.ndarray, full: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.known, self.ids, self.full = known, ids[order], full[order]
        self.norms = np.sqrt((self.full * self.full).sum(1))
        turned = (self.full / self.norms[:, None]) @ (known.rotation if known else np.eye(full.shape[1]))
        self.blocks = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in range(0, turned.shape[1], COLUMNS)]
        self.edges = np.searchsorted(lists[order], np.arange((len(known.centres) if known else 1) + 1))

    def probed(self, turned: np.ndarray, k: int) -> list[np.ndarray]:
        """Row numbers in the lists that each query probes, nearest lists first.

        The lists are those that hold the probe share of all rows of the table,
        and LEAST * (k + 1) rows at least: one rule at any size.
        """
        if self.known is None:
            return [np.arange(len(self.ids))] * len(turned)
        order = nearest_lists(turned, self.known.centres)
        upto = np.cumsum(self.known.sizes[order], axis=1)
        need = max(self.known.share * upto[0, -1], LEAST * (k + 1)) if len(turned) else 0
        n = (upto < need).sum(1) + 1
        out = []
        for i in range(len(turned)):
            own = order[i, : n[i]]
            a, size = self.edges[own], self.edges[own + 1] - self.edges[own]
            out.append(np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
        return out

    def search(self, own_ids: np.ndarray, asked: np.ndarray, radius: np.ndarray, k: int) -> tuple[list, list, list, int, int]:
        norms = np.sqrt((asked * asked).sum(1))
        turned = asked / norms[:, None]
        turned = turned @ self.known.rotation if self.known else turned
        ids, near, scores, given_up, scanned = [], [], [], 0, 0
        for i, (own, rows) in enumerate(zip(own_ids.tolist(), self.probed(turned, k), strict=True)):
            at, lost = adaptive_scan(self.blocks, rows, turned[i], float(radius[i]), k + 1)  # one more, as the query may be there itself
            given_up, scanned = given_up + lost, scanned + len(rows)
            at = at[self.ids[at] != own]
            score = (self.full[at] * asked[i]).sum(1) / (self.norms[at] * norms[i])
            best = np.lexsort((self.ids[at], -score))[:k]
            ids += [own] * len(best)
            near += self.ids[at][best].tolist()
            scores += score[best].tolist()
        return ids, near, scores, given_up, scanned


def _scan(shared, k: int):
    """A shard's rows come first and are held; its queries follow in batches of any number."""
    names = ["query_id", "vec_id", "score"]

    def vectors(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)

    def run(batches):
        shard, held, ready, given_up, scanned = None, {}, {}, 0, 0
        for batch in batches:
            which, kind, d = (batch.column(c).to_numpy() for c in ("shard", "kind", "d"))
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(kind) != 0) | (np.diff(d) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if which[a] != shard:
                    shard, held, ready = which[a], {}, {}
                part, n = batch.slice(a, b - a), int(d[a])
                ids, x = part.column("id").to_numpy(), vectors(part.column("vector"))
                if kind[a] == 0:
                    held.setdefault(n, []).append((part.column("list").to_numpy(), ids, x))
                    continue
                if n in held:
                    ready[n] = Shard(shared.value.get(n), *(np.concatenate(c) for c in zip(*held.pop(n), strict=True)))
                if n in ready:
                    *found, lost, seen = ready[n].search(ids, x, part.column("radius").to_numpy(), k)
                    given_up, scanned = given_up + lost, scanned + seen
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names)
        log.info("%d of %d scanned vectors given up before their last block", given_up, scanned)

    return run


def nearest(vectors: DataFrame, spark: SparkSession, *, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the k nearest rows by cosine of every row whose id is divisible by ``every``.

    The centres are fitted on at most ``sample_rows`` rows (the least hashes of
    id and vector); every row is indexed in its nearest centre's list, and there
    are as many lists as the square root of the rows. On the sample it is measured
    which share of the rows must be probed, nearest lists first, to hold TARGET of
    the nearest; a query probes that share of the table. Lists are scanned by
    adaptive dimension sampling; scores are then computed in double precision on
    the original vectors.

    The index is dealt out in shards of at most about SHARD rows, each with a part
    of every list, and a query goes to each shard once, whatever it probes there.
    A task holds its shard and takes its queries batch by batch, so neither a hot
    list nor many queries gather in one task.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Vectors of another length than the query's are no
    candidates for it; the FITTED_LENGTHS most frequent lengths have lists, others
    are scanned whole. Ties go to the smaller id. A row that repeats an id is a
    candidate of its own; rows with the query's id are not, and of those the least
    vector asks. With k candidates or fewer all are returned. No queries or an
    empty table give no rows; extra columns are ignored.
    """
    space, sc = Workspace(spark, "ann"), spark.sparkContext
    rows = space.save(valid_vectors(vectors, id_col, vec_col).filter(F.exists("v", lambda x: x != 0)), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(FITTED_LENGTHS).collect()
    known: dict[int, Lengths] = {}
    for r in lengths:
        found = least_hashes(rows.filter(F.size("v") == r["d"]), ["vec_id", "v"], sample_rows // len(lengths)).toArrow().combine_chunks()
        ids = found.column("vec_id").to_numpy()
        x = found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), r["d"])
        known[r["d"]] = Lengths(ids, _units(x), int(min(MOST_LISTS, max(1, np.sqrt(r["count"])))), k)
        log.info("length %d: %d rows, %d lists, share to probe %.3f", r["d"], r["count"], len(known[r["d"]].centres), known[r["d"]].share)
    shape = "list int, d int, id long, radius double, vector binary"
    index = space.save(rows.mapInArrow(lean(_assign(sc.broadcast(known))), shape), "index")
    total = 0
    for r in index.groupBy("d", "list").count().filter(F.col("d").isin(list(known))).collect():  # one row per list
        known[r["d"]].sizes[r["list"]] = r["count"]
    total = index.count()
    model = sc.broadcast(known)
    shards = max(1, -(-total // SHARD), min(2 * sc.defaultParallelism, -(-total // 4096)))
    placed = index.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).withColumn("kind", F.lit(0))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_bound(model, k), shape)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1))
    met = placed.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "d")
    found = met.mapInArrow(_scan(model, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), spark)
