"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import crc_remainder, free_name, lean, least_hashes, release, table, text_slices
from lexmill.llm.shingles import _BLANK, column_bytes, word_hashes

#: The field is fitted on at most so many labelled documents, those with the least hashes of their ids, and on so many lines in all.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 400_000
THRESHOLD = 0.3
L2 = 1e-3

_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 65:91] = True  # A-Z
_CLASS[1, 48:58] = True  # digits
_CLASS[2, [ord(c) for c in ".,;:'\"?()-"]] = True  # punctuation of sentences
_CLASS[3, 33:127] = True  # other symbols
_CLASS[3, 48:58] = _CLASS[3, 65:91] = _CLASS[3, 97:123] = False
_CLASS[3] &= ~_CLASS[2]
_CLASS[4, 128:] = True  # beyond ASCII
OWN = 14  # features of a line itself
NEAR = [4, 5, 6, 8, 9]  # those that a line also has of the lines before and after it
WIDTH = OWN + 2 * len(NEAR) + 2


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in bytes, bounds of each text's lines). Lines are what ``\\n`` separates; a null text is one empty line."""
    body, bounds = column_bytes(column)
    n = len(bounds) - 1
    breaks = np.flatnonzero(body == 10)
    # A line starts where a text starts and after every break.
    starts = np.concatenate([bounds[:-1], breaks + 1])
    texts = np.concatenate([np.arange(n), np.searchsorted(bounds, breaks, "right") - 1])
    order = np.lexsort((np.concatenate([np.zeros(n, np.int64), np.arange(1, len(breaks) + 1)]), texts))
    starts, texts = starts[order], texts[order]
    lines = np.searchsorted(texts, np.arange(n + 1))
    last = np.zeros(len(starts), bool)
    last[lines[1:] - 1] = True
    ends = np.where(last, bounds[texts + 1], np.append(starts[1:], len(body)) - 1)
    length = ends - starts

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[ends] - sums[starts]

    inside = ~_BLANK[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    opens = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[opens] = inside[opens]
    at = np.flatnonzero(begins)
    hashes, _ = word_hashes(column)
    words = np.diff(np.searchsorted(at, np.concatenate([starts, [len(body) + 1]])))
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    symbol = _CLASS[3][body]
    same = []
    line = np.repeat(np.arange(len(starts)), words)
    for lag in (1, 2, 3):
        equal = (hashes[lag:] == hashes[:-lag]) & (line[lag:] == line[:-lag])
        same.append(np.bincount(line[lag:][equal], minlength=len(starts)) / np.maximum(words - lag, 1))
    w, b = np.maximum(words, 1), np.maximum(length, 1)
    own = np.zeros((len(starts), OWN))
    own[:, 0] = 1
    own[:, 1] = share(_CLASS[0][body]) / b
    own[:, 2] = share(_CLASS[1][body]) / b
    own[:, 3] = share(_CLASS[2][body]) / b * 5
    own[:, 4] = share(symbol) / b * 5
    own[:, 5] = share(closes & symbol) / w
    own[:, 6] = same[0]
    own[:, 7] = same[1]
    own[:, 8] = same[2]
    own[:, 9] = share(begins & symbol) / w
    own[:, 10] = share(inside) / w / 10
    own[:, 11] = np.log1p(words) / 5
    own[:, 12] = share(_CLASS[4][body]) / b
    own[:, 13] = words == 0
    out = np.zeros((len(starts), WIDTH))
    out[:, :OWN] = own
    k, first = len(NEAR), np.zeros(len(starts), bool)
    first[lines[:-1]] = True
    out[1:, OWN : OWN + k] = own[:-1, NEAR]
    out[first, OWN : OWN + k] = 0
    out[:-1, OWN + k : OWN + 2 * k] = own[1:, NEAR]
    out[last, OWN + k : OWN + 2 * k] = 0
    out[:, -2], out[:, -1] = first, last
    return out, length, lines


def marginals(scores: np.ndarray, lines: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts at once: P(good) per line, expected transitions, and the log partition sums' total.

    ``scores`` are the lines' scores of label good against bad. Texts are taken in
    descending order of their lines, so at each step the first rows are active.
    """
    n = np.diff(lines)
    order = np.argsort(-n, kind="stable")
    begin, count = lines[:-1][order], n[order]
    steps = int(count[0]) if len(count) else 0
    active = [int(np.searchsorted(-count, -t, "left")) for t in range(steps)]  # texts of more than t lines
    local = np.exp(np.stack([np.zeros_like(scores), scores], 1) - np.maximum(scores, 0)[:, None])
    m = np.exp(trans)
    alpha = np.zeros((len(scores), 2))
    beta = np.ones((len(scores), 2))
    scale = np.zeros(len(scores))
    for t in range(steps):
        rows = begin[: active[t]] + t
        a = local[rows] * (np.array([1.0, np.exp(start)]) if t == 0 else alpha[rows - 1] @ m)
        scale[rows] = s = a.sum(1)
        alpha[rows] = a / s[:, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        rows = begin[: active[t + 1]] + t
        ahead = local[rows + 1] * beta[rows + 1] / scale[rows + 1][:, None]
        beta[rows] = ahead @ m.T
        pairs += m * (alpha[rows].T @ ahead)
    p = alpha * beta
    total = float(np.log(scale).sum() + np.maximum(scores, 0).sum())
    return p[:, 1] / p.sum(1), pairs, total


def fit_field(x: np.ndarray, lines: np.ndarray, good: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, transitions and start of the field that maximise the labels' conditional likelihood, by Adam."""
    texts = np.repeat(np.arange(len(lines) - 1), np.diff(lines))
    inner = texts[1:] == texts[:-1]
    first = lines[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][inner].astype(int), good[1:][inner].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 5)
    mean, square, d = np.zeros_like(theta), np.zeros_like(theta), x.shape[1]
    for step in range(1, steps + 1):
        p, pairs, _ = marginals(x @ theta[:d], lines, theta[d : d + 4].reshape(2, 2), theta[-1])
        gradient = np.concatenate([x.T @ (good - p), (seen - pairs).ravel(), [(good[first] - p[first]).sum()]]) / len(x) - L2 * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta += 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:d], theta[d : d + 4].reshape(2, 2), float(theta[-1])


def good_share(p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The marginals' mean over each text, weighted by the lines' lengths with their break."""
    weight = np.concatenate([[0], np.cumsum(length + 1)])
    sums = np.concatenate([[0], np.cumsum(p * (length + 1))])
    return (sums[lines[1:]] - sums[lines[:-1]]) / (weight[lines[1:]] - weight[lines[:-1]])


def calibrate(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of P(label 1) on a document's good share: logistic regression by Newton's method."""
    z, theta = np.stack([np.ones_like(share), share - 0.5], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ theta)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, z.T @ (label - p) - 0.05 * theta)
    return float(theta[0]), max(0.0, float(theta[1]))


class Model:
    """A fitted field and its calibration."""

    def __init__(self, x: np.ndarray, length: np.ndarray, lines: np.ndarray, label: np.ndarray):
        good = np.repeat(label, np.diff(lines)).astype(float)
        texts = np.repeat(np.arange(len(label)), np.diff(lines))
        self.weights, self.trans, self.start = fit_field(x, lines, good)
        # Lines of bad documents that look good become good, but never all of a document.
        p = self.lines(x, lines)
        worst = np.full(len(label), np.inf)
        np.minimum.at(worst, texts, p)
        good = np.where((label[texts] == 0) & (p > 0.5) & (p > worst[texts]), 1.0, good)
        self.weights, self.trans, self.start = fit_field(x, lines, good)
        self.bias, self.slope = calibrate(good_share(self.lines(x, lines), length, lines), label)

    def lines(self, x, lines) -> np.ndarray:
        return marginals(x @ self.weights, lines, self.trans, self.start)[0]

    def scores(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * (share - 0.5))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=2_000_000):
        x, length, lines = line_features(batch.column("text"))
        flat = pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(lines[:-1], lines[1:], strict=True)], pa.binary())
        lens = pa.array([length[a:b].astype("<i8").tobytes() for a, b in zip(lines[:-1], lines[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), flat, lens], ["label", "x", "length"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model | None:
    """A model from labelled documents outside the held-out fold, or None where there are none.

    Labels are taken by id: null ids and null labels teach nothing, and of
    several labels of an id the least counts. What comes to the driver is bounded
    by ``sample_docs`` and ``sample_lines``: documents are left out, from the
    greatest hash on and the longest first among those that alone hold more than
    a hundredth of the lines, until the rest have no more lines than that.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_remainder(id_col, folds) != held_fold))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    known = least_hashes(known, ["_id"], sample_docs)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    taught = rows.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_id", "text", "label", F.xxhash64("_id").alias("_h"))
    # Ids and numbers of lines first: a few thousand rows without texts.
    sizes = taught.groupBy("_id", "_h").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1).alias("n")).collect()
    if sum(r["n"] for r in sizes) > sample_lines:
        room, kept = sample_lines, []
        for r in sorted(sizes, key=lambda r: (r["n"] > sample_lines // 100, r["_h"])):
            if r["n"] <= room:
                room -= r["n"]
                kept.append(r["_id"])
        taught = taught.filter(F.col("_id").isin(kept))
    found = taught.mapInArrow(_features, "label int, x binary, length binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], bytes(r["x"]), bytes(r["length"])))  # whatever the order of tasks
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in found]).astype(float)
    length = np.concatenate([np.frombuffer(r["length"], "<i8") for r in found])
    lines = np.concatenate([[0], np.cumsum([len(r["length"]) // 8 for r in found])])
    return Model(x, length, lines, np.array([r["label"] for r in found], float).clip(0, 1))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in text_slices(batches, limit=2_000_000):
            x, length, lines = line_features(batch.column("text"))
            share = good_share(m.lines(x, lines), length, lines) if m else np.ones(batch.num_rows)
            score = m.scores(share) if m else np.full(batch.num_rows, 0.5)
            names = [c for c in batch.schema.names if c != "text"]
            extra = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(share), pa.array(np.diff(lines))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + extra, [*names, "score", "predicted", "good_share", "n_lines"])

    return run


def score_documents(docs: DataFrame, model: Model | None, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, good_share, n_lines`` per row.

    Every line of the whole text gets P(good) by forward-backward; the mean
    weighted by length is ``good_share``, and ``score`` its calibrated chance of
    label 1. Nothing but the text is an input. Null and empty texts are one empty
    line. Without a model every score is 0.5. Null and repeated ids, and extra
    columns, change nothing; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_score(spark.sparkContext.broadcast(model))), f"doc_id {kind}, score double, predicted int, good_share double, n_lines long")


def keep_good(docs: DataFrame, model: Model | None, spark: SparkSession, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, in their own columns.

    The score is an Arrow UDF beside the rows, so no join or shuffle is needed.
    """
    shared, flag = spark.sparkContext.broadcast(model), free_name(docs, "predicted_")

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column.cast(pa.string())], ["text"])
            parts = [b.column("predicted") for b in _score(shared)(iter([batch]))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.int32())
        release()

    predict.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judge = F.arrow_udf(predict, "int")
    return docs.withColumn(flag, judge(F.col(text_col))).filter(F.col(flag) == 1).drop(flag)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, spark)
    return scored.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "good_share", "n_lines")
