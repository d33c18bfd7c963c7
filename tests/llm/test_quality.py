import itertools
import zlib

import numpy as np
import pyarrow as pa

from lexmill.llm import quality
from lexmill.llm.quality import WIDTH, keep_good, line_features, marginals, score_documents, train


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([0, 1, 5, 8])
    s, trans, start = rng.standard_normal(8), rng.standard_normal((2, 2)), 0.3
    p, pairs, total = marginals(s, lines, trans, start)
    logs, want, want_pairs = 0.0, [], np.zeros((2, 2))
    for a, b in zip(lines[:-1], lines[1:], strict=True):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(b - a)):
            e = start * y[0] + sum(s[a + t] * y[t] for t in range(b - a)) + sum(trans[u, v] for u, v in itertools.pairwise(y))
            weights[y] = np.exp(e)
        z = sum(weights.values())
        logs += np.log(z)
        want += [sum(w for y, w in weights.items() if y[t]) / z for t in range(b - a)]
        for y, w in weights.items():
            for u, v in itertools.pairwise(y):
                want_pairs[u, v] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(total, logs)


def test_lines_of_odd_texts():
    texts = [None, "", "a", "a\n", "\n\nb b b b", "x!! y!!\nplain words here."]
    x, length, lines = line_features(pa.array(texts, pa.string()))
    assert x.shape == (int(lines[-1]), WIDTH)
    assert np.diff(lines).tolist() == [1, 1, 1, 2, 3, 2]
    assert length.tolist() == [0, 0, 1, 1, 0, 0, 0, 7, 7, 17]
    assert x[7, 6] == 1 and x[8, 5] == 1 and x[9, 5] == 0 and x[9, 14 + 1] == 1
    assert line_features(pa.array([], pa.string()))[0].shape == (0, WIDTH)


def test_held_out_accuracy_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [(truth[r.doc_id], r.score, r.predicted) for r in score_documents(docs, model, spark).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(t == p for t, _, p in got) >= 0.95 * len(got)
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in got)
    rows = [(1, None, 5), (None, "", 6), (1, "Some plain words, and a few more of them.", 7), (2, "JUNK!! " * 50_000, 8)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, predicted_ int")
    scores = {(r.doc_id, r.n_lines): r for r in score_documents(odd, model, spark).collect()}
    assert len(scores) == 3 and scores[2, 1].predicted == 0
    kept = keep_good(odd, model, spark)
    assert kept.columns == odd.columns and 7 in {r.predicted_ for r in kept.collect()} and 8 not in {r.predicted_ for r in kept.collect()}
    assert {r.score for r in score_documents(odd, None, spark).collect()} == {0.5}
    assert train(docs.limit(0), labels) is None and train(docs, labels.limit(0)) is None
    assert score_documents(odd.limit(0), model, spark).count() == 0


def test_scores_equal_enumeration(spark):
    """The query's score of short texts by enumerating all labellings of their lines, weighing by length, and the logistic."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = train(docs, labels)
    texts = ["one line of plain words.", "BUY!! ### $$$\nplain words follow here, some more\n\n#1 #2 #3 #4", "a\nb\nc\nd\ne\nf", "", None, "Ünï cödé\nx x x x x x"]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m, spark).collect()}
    for i, t in enumerate(texts):
        x, _, _ = line_features(pa.array([t], pa.string()))
        lines, s = (t or "").split("\n"), x @ m.weights
        weights = {y: np.exp(m.start * y[0] + sum(a * b for a, b in zip(s, y, strict=True)) + sum(m.trans[u, v] for u, v in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(lines))}
        z, sizes = sum(weights.values()), [len(line.encode()) + 1 for line in lines]
        good = [sum(w for y, w in weights.items() if y[j]) / z for j in range(len(lines))]
        share = sum(g * n for g, n in zip(good, sizes, strict=True)) / sum(sizes)
        assert abs(got[i] - 1 / (1 + np.exp(-(m.bias + m.slope * (share - 0.5))))) < 1e-9


def test_sample_is_bounded_in_lines(spark, monkeypatch):
    """Very long labelled documents are left out first; the rest still teach."""
    seen = []
    monkeypatch.setattr(quality, "Model", lambda x, length, lines, label: seen.append((len(lines) - 1, len(x))))
    rows = [(i, "word and word.\n" * (5000 if i % 10 == 3 else i % 7 + 1)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    train(docs, labels, sample_lines=600)
    documents, lines = seen[0]
    assert lines <= 600 and documents > 90
    train(docs, labels, sample_lines=10**6)
    assert seen[1][0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))
