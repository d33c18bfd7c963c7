"""Dense vectors: normalisation, pooling, encoding, filtered exact top-k."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BATCH = 64
#: Requests that meet a table in one round, rows that are scored together, scores that are held at a time.
ROUND, BLOCK, CELLS = 8192, 4096, 1 << 20
#: Lengths between which single precision tells which pairs to sum exactly.
SHORT, LONG = 1e-12, 1e15


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null for vectors of different lengths."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, z: s + z))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, z: s + z))


def l2_normalise(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def masked_mean(df: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """``key, pooled``: per position the sum of masked vectors over the sum of masks, which is 1e-9 at least."""
    cells = df.select(key, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("_i", "_x"))
    sums = cells.groupBy(key, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("_v"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda r: r["_v"]).alias("pooled"))


def hashing_model(dims: int = 384) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """An offline stand-in for a sentence encoder: signed word hashes, unit norm. Any function of this shape can take its place."""

    def make():
        import zlib

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").lower().split()[:512]:
                    h = zlib.crc32(w.encode())
                    out[i, h % dims] += 1 if h >> 31 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return make


def encode(df: DataFrame, text: str, model: Callable = None, out: str = "embedding") -> DataFrame:
    """A unit vector per text, in Arrow batches of BATCH rows; the model is made once per worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(model or hashing_model(), return_type=ArrayType(FloatType()), batch_size=BATCH)
    return df.withColumn(out, udf(F.col(text)))


def _packed(df: DataFrame) -> DataFrame:
    """All rows as the Arrow bytes of one row, with the key 0 to join it by."""

    def pack(batches):
        import pyarrow as pa

        held = list(batches)
        if held:
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            yield pa.RecordBatch.from_pydict({"_first": pa.array([0], pa.int32()), "_asked": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return df.repartition(1).mapInArrow(pack, "_first int, _asked binary")


def _matrices(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors: their rows and their values. A vector that is null or holds null has none."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat, at = column.values.slice(at[0], at[-1] - at[0]), at - at[0]
    size = np.where(np.asarray(column.is_valid()), np.diff(at), -1)
    if flat.null_count:
        size[np.searchsorted(at, np.flatnonzero(np.asarray(flat.is_null())), "right") - 1] = -1
    values = flat.cast("double", safe=False).fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == n)
        out[n] = rows, values[at[rows][:, None] + np.arange(n)]
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in the order of the components as ``dot`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _firsts(values: np.ndarray, most: int) -> np.ndarray:
    """The rows less those behind ``most`` earlier ones of the same bits, which they cannot pass."""
    rows = np.arange(len(values))
    if len(values) <= most or not values.shape[1]:
        return rows[:most]
    bits = np.ascontiguousarray(values).view(np.uint64)
    factors = np.random.default_rng(7).integers(1, 2**63, bits.shape[1], np.uint64) | np.uint64(1)
    mixed = ((bits ^ (bits >> np.uint64(29))) * factors).sum(1)
    order = np.argsort(mixed, kind="stable")
    mixed = mixed[order]
    if not (mixed[most:] == mixed[:-most]).any():
        return rows
    opens = np.searchsorted(mixed, mixed)
    equal = (bits[order] == bits[order[opens]]).all(1)
    place = np.cumsum(equal)
    return np.sort(order[~(equal & (place - place[opens] >= most))])


class _Side(NamedTuple):
    """Vectors of one length, whose own lengths follow their components in ``single``.

    ``grade``: 0 where single precision tells near scores, 1 where double does, 2 for what is not finite.
    """

    values: np.ndarray
    single: np.ndarray
    lengths: np.ndarray
    grade: np.ndarray

    def take(self, rows) -> _Side:
        return _Side(*(x[rows] for x in self))


def _side(values: np.ndarray) -> _Side:
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        lengths = np.sqrt((values * values).sum(1))
        greatest = np.abs(values).max(1, initial=0)
        # Squares may vanish where the components do not.
        lengths = np.where(lengths < SHORT, greatest * np.sqrt(values.shape[1]), lengths)
        grade = np.where((greatest == 0) | (lengths > SHORT) & (lengths < LONG), 0, np.where(np.isfinite(lengths), 1, 2))
        return _Side(values, np.column_stack([values, lengths]).astype(np.float32), lengths, grade)


def _may(a: _Side, b: _Side, most: int, low: np.ndarray) -> np.ndarray:
    """Which pairs of finite vectors may reach ``low``, which rises where the product itself shows as many rows above it.

    The rounding error of a pair is within a multiple of the product of both
    lengths, so with the lengths as a further component the product is a bound.
    """
    single = not (a.grade.any() or b.grade.any())
    left, right = (x.single if single else np.column_stack([x.values, x.lengths]) for x in (a, b))
    size, width = right.shape
    sign = np.ones(width, right.dtype)
    sign[-1] = 4 * (width + 2) * np.finfo(right.dtype).eps
    fresh = np.flatnonzero(np.isneginf(low))
    if len(fresh) and size > most:
        least = (left[fresh] * np.where(np.arange(width) < width - 1, sign, -sign)) @ right.T
        if (groups := 8 * most) < size:
            # The greatest of each group are different rows.
            least = np.maximum.reduceat(least, np.arange(groups) * size // groups, axis=1)
        low[fresh] = np.partition(least, least.shape[1] - most, axis=1)[:, least.shape[1] - most]
    with np.errstate(over="ignore"):
        return ~((left * sign) @ right.T < (low - 1e-300).astype(right.dtype)[:, None])


def _best(a: _Side, b: _Side, most: int, floor: np.ndarray, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``request, row, score`` of the best rows of each request that beat its ``floor``, which rises to the last of as many.

    Matrix products tell which pairs can be among them within their rounding
    error; only these are summed exactly, about CELLS values at a time. Of equal
    scores the earlier row counts, NaN is above all numbers, and pairs with what
    is not finite are always summed. ``best`` has the best scores of each request
    among all rows so far, by which its floor rises further.
    """
    low = floor.copy()
    if not (a.grade.any() or b.grade.any()):
        may = _may(a, b, most, low)
    else:
        may = np.ones((len(a.values), len(b.values)), bool)
        for g in (0, 1):
            for h in (0, 1):
                own, rows = np.flatnonzero(a.grade == g), np.flatnonzero(b.grade == h)
                if len(own) and len(rows):
                    bound = low[own]
                    may[np.ix_(own, rows)] = _may(a.take(own), b.take(rows), most, bound)
                    low[own] = bound
    q, r = np.divmod(np.flatnonzero(may), len(b.values))
    step = max(1, CELLS // max(1, a.values.shape[1]))
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.concatenate([np.zeros(0), *(_exact(a.values[q[i : i + step]], b.values[r[i : i + step]]) for i in range(0, len(q), step))])
    beats = ~(score <= floor[q]) | np.isneginf(floor[q])
    q, r, score = q[beats], r[beats], score[beats]
    order = np.lexsort((r, -score, ~np.isnan(score), q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, r, score, place = (x[place < most] for x in (q, r, score, place))
    marks, last = np.where(np.isnan(score), np.inf, score), place == most - 1
    floor[q[last]] = np.maximum(floor[q[last]], marks[last])
    if best is not None and len(q):
        met, slot = np.unique(q, return_inverse=True)
        more = np.full((len(met), most), -np.inf)
        more[slot, place] = marks
        best[met] = np.partition(np.concatenate([best[met], more], axis=1), most, axis=1)[:, most:]
        floor[met] = np.maximum(floor[met], best[met].min(1))
    return q, r, score


def _meet(vector: str, query: str, asked_columns: list[str], most: int, kept_rows: list[str], kept_asked: list[str]):
    def run(batches):
        import pyarrow as pa

        asked = None
        for batch in batches:
            if asked is None:
                blob = batch.column("_asked").drop_null()
                if not len(blob):
                    continue
                asked = pa.ipc.open_stream(blob[0].as_buffer()).read_all().combine_chunks().select(asked_columns).to_batches()[0]
                wanted = {n: (ids, _side(a)) for n, (ids, a) in _matrices(asked.column(query)).items()}
                brings = asked.select(kept_asked)
                floor, seen = np.full(asked.num_rows, -np.inf), np.zeros(asked.num_rows, np.int64)
                tops = np.full((asked.num_rows, most), -np.inf) if asked.num_rows * most <= CELLS else None
            rows, found = batch.select([c for c in batch.schema.names if c != "_asked"]), []
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                held = _matrices(part.column(vector))
                none = {n: np.setdiff1d(np.arange(part.num_rows), held[n][0]) for n in held}
                for n, (ids, a) in wanted.items():
                    if n not in held:
                        continue
                    theirs, b = held[n]
                    few = _firsts(b, most)
                    theirs, b = theirs[few], _side(b[few])
                    step = max(1, CELLS // len(few))
                    for k in range(0, len(ids), step):
                        some = ids[k : k + step]
                        own, best = floor[some], None if tops is None else tops[some]
                        q, r, score = _best(a.take(slice(k, k + step)), b, most, own, best)
                        floor[some] = own
                        if best is not None:
                            tops[some] = best
                        found.append((some[q], theirs[r] + at, score))
                # Rows without a score come last, and only where too few have one.
                scored = np.zeros(asked.num_rows, np.int64)
                lacks = np.full(asked.num_rows, -1, np.int64)
                for n, (ids, _) in wanted.items():
                    scored[ids], lacks[ids] = len(held[n][0]) if n in held else 0, n
                seen += scored
                for i in np.flatnonzero(seen < most).tolist():
                    blank = none.get(int(lacks[i]), np.arange(part.num_rows))[:most]
                    found.append((np.full(len(blank), i), blank + at, np.full(len(blank), -np.inf)))
                    found[-1] = (*found[-1], True)
            if not found:
                continue
            q, r, score = (np.concatenate([f[i] for f in found]) for i in range(3))
            blank = np.concatenate([np.full(len(f[0]), len(f) > 3) for f in found])
            # The floor has risen since: what is below it now has as many better rows in this task.
            stays = blank | ~(score < floor[q])
            q, r, score, blank = q[stays], r[stays], score[stays], blank[stays]
            rows = rows.select(kept_rows)
            for at in range(0, len(q), BLOCK):
                cut = slice(at, at + BLOCK)
                left, right = rows.take(pa.array(r[cut])), brings.take(pa.array(q[cut]))
                yield pa.RecordBatch.from_arrays([*left.columns, *right.columns, pa.array(score[cut], mask=blank[cut])], names=[*left.schema.names, *right.schema.names, "score"])

    return run


def search_many(requests: DataFrame, vectors: DataFrame, k: int | Column, *, request_key: str = "label", order: str = "ord", where: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The k best rows per request by inner product, exact, for many requests in one job.

    ``requests`` (``label, query_vector``) meet the table in rounds of at most
    about ROUND, dealt out by a hash, so what is broadcast does not grow with
    them: a round's requests are one row of bytes, which joins each task's first
    row and no other. The table's filters and columns are pushed into the scan. A
    task scores its rows in order by matrix products and keeps per request the
    score that a further row has to beat, so few rows more than the largest k
    leave it, with the columns of both sides that ``keep`` names (all, if None;
    ``request_key``, ``order`` and what ``k`` needs always).
    """
    rows = vectors if where is None else vectors.filter(where)
    if not isinstance(k, int):
        requests = requests.withColumn("_k", k)
    asked_columns = requests.columns
    count, most = requests.agg(F.count(F.lit(1)), F.lit(k) if isinstance(k, int) else F.max("_k")).first()
    rounds, most = max(1, -(-count // ROUND)), int(most or 0)
    named = {*(rows.columns + asked_columns if keep is None else keep), request_key, order, "_k"}
    kept_rows, kept_asked = ([c for c in df.columns if c in named] for df in (rows, requests))
    if most <= 0:
        return rows.select(kept_rows).join(requests.select(kept_asked)).limit(0).drop("_k").withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    dealt = F.pmod(F.xxhash64(F.col(request_key)), F.lit(rounds))
    schema = StructType([*(rows.schema[c] for c in kept_rows), *(requests.schema[c] for c in kept_asked), StructField("score", DoubleType())])
    # Only a task's first row has a key to join by, so the bytes are not copied for the others.
    first = F.when(F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0, 0)
    marked = rows.repartition(order).sortWithinPartitions(order).withColumn("_first", first)
    run = _meet("embedding", "query_vector", asked_columns, most, kept_rows, kept_asked)

    def met(own: DataFrame) -> DataFrame:
        return marked.join(F.broadcast(_packed(own)), "_first", "left").drop("_first").mapInArrow(run, schema)

    scored = reduce(DataFrame.unionByName, [met(requests.filter(dealt == r) if rounds > 1 else requests) for r in range(rounds)])
    w = Window.partitionBy(request_key).orderBy(F.desc("score"), order)
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return best if isinstance(k, int) else best.filter(F.col("rank") <= F.col("_k")).drop("_k")
