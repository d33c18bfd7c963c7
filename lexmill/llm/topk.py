"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import table

#: Rows that a task takes in before it searches them, vectors whose sorted lists it holds at once, and queries of one round.
HELD, CHUNK, ROUND = 65_536, 8192, 8192
SCALE = 1024
DEPTHS = 8  # of the lists' reading: each doubles the one before, the last is the whole list
EXACT = float(2**53)  # integers below it are exact in doubles

log = logging.getLogger(__name__)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v array<double>`` of the rows with an id and a non-empty vector of finite numbers."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) for each vector length in a batch."""
    column = batch.column("v")
    bounds = column.offsets.to_numpy()
    flat, lens = column.values.to_numpy(zero_copy_only=False), np.diff(bounds)
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        yield int(d), rows, flat[bounds[rows][:, None] + np.arange(d)]


def box_and_ball(weights: np.ndarray, edges: np.ndarray, norm: float) -> float:
    """The most that ``weights`` (not negative) times a vector can be whose components are at most ``edges`` and whose length is at most ``norm``."""
    inside = float(edges @ edges)
    if inside <= norm * norm or not weights.any():
        return float(weights @ edges)
    # The best vector follows the weights, cut at the edges: y = min(edge, factor * weight).
    ratio = np.where(weights > 0, edges / np.maximum(weights, 1e-300), np.inf)
    order = np.argsort(ratio)
    e, w = edges[order], weights[order]
    cut = np.concatenate([[0.0], np.cumsum(e * e)])[:-1]  # of those before, at their edges
    rest = np.cumsum((w * w)[::-1])[::-1]
    room = norm * norm - cut
    factor = np.sqrt(np.maximum(room, 0) / np.maximum(rest, 1e-300))
    fits = np.flatnonzero((factor <= ratio[order]) & (room >= 0))
    if not len(fits):  # negative edges alone exceed the length: no such vector, but stay on the safe side
        return float(weights @ edges)
    i = int(fits[0])
    return float(w[:i] @ e[:i] + factor[i] * rest[i])


class Lists:
    """The sorted lists of a block of vectors, one per dimension of a turned basis, and threshold searches in them.

    The basis is that of the block's principal axes, in which variance falls as
    fast as it can, so that few lists matter to a query. Inner products are the
    same in it but for rounding, which ``slack`` covers; scores themselves are
    computed on the integers.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt((x * x).sum(1).max(initial=0)))
        self.axes = np.linalg.eigh(x.T @ x)[1] if np.isfinite(self.norm) and self.norm < EXACT else np.eye(x.shape[1])
        self.y = x @ self.axes
        self.order = np.argsort(self.y, axis=0, kind="stable")  # ascending; read backwards for positive weights
        self.scored = self.asked = 0

    def _exact(self, q: np.ndarray) -> np.ndarray:
        """Scores as whole numbers of any size, cut to 64 bits."""
        rows = [[int(v) for v in r] for r in self.x.tolist()]
        own = [int(v) for v in q.tolist()]
        top = 2**63 - 1
        return np.array([max(-top - 1, min(top, sum(a * b for a, b in zip(r, own, strict=True)))) for r in rows], np.int64)

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best``, (-score, id) in ascending order, with what this block adds.

        The lists are read in steps of double depth, best values for the query
        first, and deeper the more a list weighs. What a list shows is first
        summed over the query's heavy dimensions; the rest is bounded by the two
        remaining lengths, and only what can still reach the k-th score is scored
        in full. No vector that has not been seen can score more than the values
        at the present depths allow together, within the block's greatest length;
        when that bound is below the k-th score, the search ends. At a bound
        equal to it an unseen vector could still tie, so it goes on.
        """
        n = len(self.ids)
        self.asked += n
        length = float(np.sqrt(q @ q))
        if not length * self.norm < EXACT:
            found = self._exact(q)
            self.scored += n
            return sorted([*best, *((-int(s), int(i)) for s, i in zip(found, self.ids, strict=True) if i != own)])[:k]
        slack = 1e-9 * length * self.norm + 1e-6
        if len(best) >= k and length * self.norm + slack < -best[-1][0]:
            return best
        p = self.axes.T @ q
        weights = np.abs(p)
        by_weight = np.argsort(-weights, kind="stable")
        energy = np.cumsum(weights[by_weight] ** 2)
        heavy = by_weight[: int(np.searchsorted(energy, 0.9 * energy[-1])) + 1]
        rest = float(np.sqrt(max(0.0, energy[-1] - energy[len(heavy) - 1])))
        spread = weights * np.abs(self.y[self.order[-1], np.arange(len(p))] - self.y[self.order[0], np.arange(len(p))])
        benefit = np.minimum(1.0, spread / max(float(spread.max(initial=0)), 1e-300))
        seen, up = self.ids == own, p < 0
        depths = np.zeros(len(p), np.int64)
        for step in range(DEPTHS):
            before, depths = depths, np.where(step == DEPTHS - 1, n, np.maximum(depths, np.ceil(n * benefit / 2 ** (DEPTHS - 1 - step)).astype(np.int64)))
            if step == DEPTHS - 1:
                new = ~seen
            else:
                new = np.zeros(n, bool)
                for j in np.flatnonzero(depths > before):
                    a, b = before[j], depths[j]
                    new[self.order[a:b, j] if up[j] else self.order[n - b : n - a, j]] = True
                new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            if len(at) and len(best) >= k:
                part = self.y[at][:, heavy]
                left = np.sqrt(np.maximum((self.x[at] ** 2).sum(1) - (part * part).sum(1), 0))
                at = at[part @ p[heavy] + rest * left + slack >= -best[-1][0]]
            if len(at):
                self.scored += len(at)
                scores = self.x[at] @ q
                if len(best) >= k:
                    good = scores >= -best[-1][0]
                elif len(at) > k:
                    good = scores >= np.partition(scores, -k)[-k]
                else:
                    good = np.ones(len(at), bool)
                best = sorted([*best, *zip((-scores[good]).astype(np.int64).tolist(), self.ids[at[good]].tolist(), strict=True)])[:k]
            if seen.all():
                break
            if len(best) >= k:
                edges = np.where(up, -self.y[self.order[np.minimum(depths, n - 1), np.arange(len(p))], np.arange(len(p))], self.y[self.order[np.maximum(n - 1 - depths, 0), np.arange(len(p))], np.arange(len(p))])
                if box_and_ball(weights, edges, self.norm) + slack < -best[-1][0]:
                    break
        return best


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        held: dict[int, list] = {}

        def meet(d: int) -> None:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(d), strict=True))
            if d in queries.value:
                # Long vectors first: they raise the k-th score that shorter ones must reach.
                with np.errstate(over="ignore"):
                    order = np.argsort(-(x * x).sum(1), kind="stable")
                ids, x = ids[order], x[order]
                for a in range(0, len(ids), CHUNK):
                    lists = Lists(ids[a : a + CHUNK], x[a : a + CHUNK])
                    for q, weights in zip(*queries.value[d], strict=True):
                        best[d, q] = lists.search(weights, q, k, best.get((d, q), []))
                    log.info("%d of %d vectors scored in full", lists.scored, lists.asked)

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for d, rows, x in matrices(batch):
                held.setdefault(d, []).append((ids[rows], scaled(x)))
                if sum(len(i) for i, _ in held[d]) >= HELD:
                    meet(d)
        for d in list(held):
            meet(d)
        for (_, q), found in best.items():
            if found:
                score, ids = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), pa.array(ids, pa.int64()), pa.array([-s for s in score], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), whole numbers in doubles; what would be beyond doubles is the greatest of them."""
    top = np.finfo(float).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -top, top)


def exact_topk(vectors: DataFrame, spark: SparkSession, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row whose id is divisible by ``every``.

    Components become floor(1024 * x); the score is the integer inner product,
    summed in doubles where lengths tell that all sums stay below 2**53, and else
    in whole numbers of any size, cut to 64 bits at the end. Ties go to the
    smaller id. Rows with the query's own id are no candidates.

    Queries come to the table in rounds of about ``ROUND`` (a hash of the id
    deals them out), so what is broadcast does not grow with the data. Each task
    sorts its own rows into lists and searches them by the threshold algorithm,
    carrying the k-th score from block to block; k rows per query and task are
    shuffled.

    Null ids, and vectors that are null, empty or hold null or non-finite
    components, take no part. A row that repeats an id is a candidate of its own;
    of rows that repeat a query's id the least vector asks. Vectors of another
    length than the query's are no candidates for it. No queries, or an empty
    table, give no rows; extra columns are ignored.
    """
    rows = valid_vectors(vectors, id_col, vec_col)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    rounds = max(1, -(-asked.count() // ROUND))
    parts = []
    for r in range(rounds):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).collect()
        sets: dict[int, tuple[list, list]] = {}
        for q in own:
            ids, v = sets.setdefault(len(q["v"]), ([], []))
            ids.append(q["vec_id"])
            v.append(q["v"])
        block = {d: (ids, scaled(np.array(v))) for d, (ids, v) in sets.items()}
        parts.append(rows.mapInArrow(_search(spark.sparkContext.broadcast(block), k), "query_id long, vec_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), spark)


ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
