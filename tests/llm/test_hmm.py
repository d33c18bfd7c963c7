import itertools
import math
import zlib
from collections import Counter

import numpy as np

import pyarrow as pa

from lexmill.llm.common import crc_remainder, least_hashes
from lexmill.llm.hmm import CLASSES, Model, _encode, baum_welch, expect, forward, score_texts, segments, slot_of, word_classes
from lexmill.llm.shingles import column_bytes, place_hashes, word_places


def test_recursions_equal_enumeration():
    rng = np.random.default_rng(2)
    start, trans, emit = rng.dirichlet(np.ones(3), 2), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    ids, bounds, kind = np.array([0, 4, 2, 1, 1, 3, 0, 2, 2]), np.array([0, 6, 7, 9]), np.array([0, 1, 1])
    counts = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((5, 3))
    like = expect(ids, bounds, kind, start, trans, emit, counts)
    want_counts = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((5, 3))
    want, first = [], []
    for (a, b), kd in zip(itertools.pairwise(bounds), kind, strict=True):
        own, weights = ids[a:b], {}
        for z in itertools.product(range(3), repeat=int(b - a)):
            p = 1.0
            for t, s in enumerate(z):
                p *= (start[kd][s] if t == 0 else trans[z[t - 1], s]) * emit[own[t], s]
            weights[z] = p
        total = sum(weights.values())
        want.append(math.log(total))
        first.append(math.log10(sum(p * start[0][z[0]] / start[kd][z[0]] for z, p in weights.items())))
        for z, p in weights.items():
            for t, s in enumerate(z):
                want_counts[2][own[t], s] += p / total
                if t:
                    want_counts[1][z[t - 1], s] += p / total
                else:
                    want_counts[0][kd][s] += p / total
    assert math.isclose(like, sum(want), rel_tol=1e-5)
    assert np.allclose(forward(ids, bounds, start[0], trans, emit), first, rtol=1e-12)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(counts, want_counts, strict=True))


def test_long_sequences_do_not_underflow():
    rng = np.random.default_rng(4)
    trans = np.full((3, 3), 1e-7) + np.eye(3) * (1 - 3e-7)
    emit = np.full((3, 3), 1e-9) + np.eye(3)
    ids, bounds = rng.integers(3, size=40_000), np.array([0, 39_000, 39_000, 40_000])
    a, logs = np.full(3, 1 / 3), 0.0
    for t, s in enumerate(ids[:39_000]):
        a = (a if t == 0 else a @ trans) * emit[s]
        logs += math.log10(a.sum())
        a /= a.sum()
    got = forward(ids, bounds, np.full(3, 1 / 3), trans, emit)
    assert math.isclose(got[0], logs, rel_tol=1e-12) and got[1] == 0
    cuts, kind = segments(bounds, 1024)
    assert np.diff(cuts).max() == 1024 and np.diff(cuts).min() > 0 and (kind == 0).sum() == 2 and cuts[-1] == 40_000
    counts = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((3, 3))
    assert math.isfinite(expect(ids, cuts, kind, np.full((2, 3), 1 / 3), trans, emit, counts))
    assert np.allclose(counts[2].sum(), 40_000, rtol=1e-5) and np.allclose(counts[0].sum(), len(kind))


def test_scores_equal_plain_python(spark):
    """``score`` with a fitted model, word by word: a slot's word by its emission, others by class and share."""
    rng = np.random.default_rng(6)
    vocabulary = [f"{'wé'[i % 2]}{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 3 * 20 : i % 3 * 20 + 30], size=int(rng.integers(1, 60))))) for i in range(120)]
    slots, kept = 16, {}
    real = Model.update
    Model.update = lambda self, *a: (real(self, *a), kept.update(m=self))[0]
    try:
        got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark, slots=slots).collect()
    finally:
        Model.update = real
    model = kept["m"]
    words = sorted({w for _, t in rows for w in t.split()})
    body, bounds = column_bytes(pa.array(words))
    starts, ends = word_places(body, bounds)
    h, cls = place_hashes(body, starts, ends), word_classes(body, starts, ends)
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    best = {}
    for w, x, s in zip(words, h.view(np.int64).tolist(), slot_of(h, slots).tolist(), strict=True):
        if c[w]:
            best[s] = max(best.get(s, (0, 0, "")), (c[w], x, w))
    own = {w: s for s, (_, _, w) in best.items()}
    rare = {w: int(k) for w, k in zip(words, cls, strict=True) if w not in own}
    n, v = Counter(), Counter()
    for w, k in rare.items():
        n[k] += c[w]
        v[k] += c[w] > 0
    assert len(rare) > 20 and len(own) > 10
    for r in got:
        a, logs, words = None, 0.0, [*dict(rows)[r.doc_id].split(), None]
        for w in words:
            e = model.emit[slots + CLASSES] if w is None else model.emit[own[w]] if w in own else model.emit[slots + rare[w]] * (c[w] + 1) / (n[rare[w]] + v[rare[w]] + 1)
            a = (model.start[0] if a is None else a @ model.trans) * e
            logs += math.log10(a.sum())
            a /= a.sum()
        assert math.isclose(r.score, logs, rel_tol=1e-9), r


def test_likelihood_rises(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    slots = 4096
    book = spark.sparkContext.broadcast((np.zeros(slots, np.uint64), np.zeros(slots), 0.0))
    ids = docs.mapInArrow(_encode(book), "row long, doc_id long, ids binary, base double, known long, tail array<struct<h:long,cls:int,n:int>>").select("ids")
    model = Model(np.ones(slots + CLASSES + 1))
    likes = baum_welch(ids, 1, model, spark, passes=6)
    assert len(likes) >= 3 and all(b > a for a, b in itertools.pairwise(likes))


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def check(rows, got):
    """Counts and base scores against plain Python; ids may repeat, so rows are compared as multisets."""
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows)
    own = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in got)
    assert [x[:3] for x in own] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in own], [x[3] for x in want], rtol=1e-12, atol=1e-9)
    assert all(r.held_out == held[r.doc_id] and r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "again and again"), (None, "no id É é"), (5, "x " * 5000), (6, "The the THE"), (7, "\x0b\t\n")] + [(i, f"w{i} w{i % 7} the") for i in range(10, 40)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    check(rows, score_texts(df, spark, slots=4).collect())
    assert score_texts(df.limit(0), spark).count() == 0


def test_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score_texts(docs, spark, slots=8192).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    base, own = (-sum(x) / n for x in zip(*((r.base_score, r.score) for r in held), strict=True))
    print("bits a token", base * math.log2(10), own * math.log2(10))
    assert own < base - 0.1


def test_words_of_all_documents_get_states(spark):
    """Words that only documents outside the 1,000 least hashes of ids have are told apart by state."""
    first = {r.doc_id for r in least_hashes(spark.range(3000).toDF("doc_id").filter(~(crc_remainder("doc_id", 7) == 2)), ["doc_id"], 1000).collect()}
    rng = np.random.default_rng(3)
    rows = [(i, "one " * 12 if i in first else " ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(100, size=40))) for i in range(3000)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark).filter("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert (sum(r.score for r in got) - sum(r.base_score for r in got)) / n * math.log2(10) > 0.8  # a document's words are all of one kind, which is worth a bit each
