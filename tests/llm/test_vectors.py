import numpy as np

from lexmill.llm.ann import Lengths, adaptive_scan, nearest
from lexmill.llm.topk import Lists, box_and_ball, exact_topk, scaled

INF, NAN = float("inf"), float("nan")


def test_threshold_search_equals_scan():
    rng = np.random.default_rng(3)
    for n, d, k in ((1, 4, 3), (50, 4, 5), (3000, 8, 10)):
        x, ids = np.floor(rng.standard_normal((n, d)) * 4), rng.permutation(n)  # few values: many ties
        lists = Lists(ids, x)
        for q in [*np.floor(rng.standard_normal((20, d)) * 3), np.zeros(d)]:
            want = sorted(zip((-(x @ q)).tolist(), ids.tolist(), strict=True))
            want = [w for w in want if w[1] != 0][:k]
            assert lists.search(q, 0, k, []) == want


def test_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(300):
        w, e = np.abs(rng.standard_normal(5)), rng.standard_normal(5) + 0.5
        norm = float(np.linalg.norm(np.minimum(e, 0)) + rng.random() * 2)
        bound = box_and_ball(w, e, norm)
        y = np.minimum(e, rng.standard_normal((4000, 5)) * norm)
        y = y[(y * y).sum(1) <= norm * norm]
        assert not len(y) or (y @ w).max() <= bound + 1e-9


def share_scored(x, queries, k=10):
    """The share of vectors that searches score in full, each search checked against a scan."""
    ids, blocks = np.arange(len(x)), [Lists(np.arange(a, min(a + 8192, len(x))), x[a : a + 8192]) for a in range(0, len(x), 8192)]
    for i in queries:
        best = []
        for b in blocks:
            best = b.search(x[i], i, k, best)
        scores = x @ x[i]
        scores[i] = -np.inf
        order = np.lexsort((ids, -scores))[:k]
        assert best == [(-int(scores[j]), int(j)) for j in order]
    return sum(b.scored for b in blocks) / (len(x) * len(queries))


def test_search_stops_early():
    """64 dimensions whose spread falls by a tenth each, as embeddings have it, in a random basis: a few per cent are scored."""
    rng = np.random.default_rng(6)
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    x = scaled((rng.standard_normal((20_000, 64)) * 0.9 ** np.arange(64)) @ turn)
    share = share_scored(x, range(0, 20_000, 1000))
    print("share scored in full, falling spread:", share)
    assert share < 0.1


def test_share_on_the_table(spark):
    """The table's vectors have no such spread; there the two remaining lengths bound what the lists cannot."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = scaled(np.array([r.embedding for r in rows], np.float32).astype(float))
    share = share_scored(x, range(0, len(x), 100))
    print("share scored in full, sf0.1:", share)
    assert share < 0.5


def test_sums_beyond_doubles(spark):
    rows = [(0, [1e15, 3.0, 1.0]), (1, [1e15, 1.0, 1.0]), (2, [1e15, 2.0, -1e3]), (3, [1e3, 1.0, 1.0]), (4, [-1e300, 1e300, 0.5])]
    got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark, k=4).collect()
    ints = {i: [int(np.floor(v * 1024)) for v in x] for i, x in rows}
    top = 2**63 - 1
    want = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(ints[0], ints[i], strict=True)))), i) for i in (1, 2, 3, 4))
    assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits, lost, blocks = 0, 0, [x[:, c : c + 16] for c in range(0, 64, 16)]
    for q in x[:50]:
        true = set(np.argsort(((x - q) ** 2).sum(1))[:6].tolist())
        found, given_up = adaptive_scan(blocks, np.arange(4000), q, np.inf, 6)
        hits, lost = hits + len(true & set(found.tolist())), lost + given_up
    print("given up early:", lost / (50 * 4000))
    assert hits >= 0.97 * 300 and lost > 0.15 * 50 * 4000


ROWS = [(0, [1.0, 0.5], 1), (100, [0.5, -1.0], 1), (3, [0.25, 0.25], 2), (4, [0.25, 0.25], 2), (4, [0.25, 0.25], 2), (5, None, 0), (6, [1.0, None], 0), (7, [NAN, 1.0], 0), (8, [INF, 1.0], 0), (9, [], 0), (None, [1.0, 1.0], 0), (10, [1.0, 1.0, 1.0], 0), (11, [0.0, 0.0], 0), (100, [0.75, -1.0], 1)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(2)


def ranked(rows, every, k, score):
    ok = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-s, i) for i, w in ok if i != q and len(w) == len(v) and (s := score(v, w)) is not None)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def inner(v, w):
    return int(np.floor(np.array(v, np.float32).astype(float) * 1024) @ np.floor(np.array(w, np.float32).astype(float) * 1024))


def cosine(v, w):
    v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
    return float(v @ w / np.sqrt((v @ v) * (w @ w))) if v.any() and w.any() else None


def test_exact_topk_odd_rows(spark):
    assert sorted(map(tuple, exact_topk(frame(spark), spark, k=3).collect())) == ranked(ROWS, 100, 3, inner)
    assert exact_topk(frame(spark, []), spark).count() == 0


def test_nearest_odd_rows(spark):
    rows = [*ROWS, (50, [1.0, 1.0, 0.5], 0), (13, [0.0, 1.0, 0.5], 0), (150, [1e300, 1e300], 0)]
    rows[-1] = (150, [1e30, 2e30], 0)
    got = sorted(map(tuple, nearest(frame(spark, rows), spark, k=3).collect()))
    want = ranked(rows, 50, 3, cosine)
    assert [g[:3] for g in got] == [w[:3] for w in want]  # so few that all are probed
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    assert nearest(frame(spark, []), spark).count() == 0


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, 0) for r in vectors.collect()]
    want = {(q, i) for q, _, i, _ in ranked(rows, 50, 5, cosine)}
    got = {(r.query_id, r.vec_id) for r in nearest(vectors, spark).collect()}
    print("recall on sf0.1:", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)


def test_clusters_need_few_probes(spark):
    """On vectors with clusters, a fifth of the rows is enough; hot ids and one hot list change nothing."""
    rng = np.random.default_rng(9)
    middles = rng.standard_normal((40, 32))
    x = middles[np.minimum(rng.integers(60, size=6000), 39)] + 0.4 * rng.standard_normal((6000, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    known = Lengths(np.arange(6000), unit, 77, 5)
    print("share to probe:", known.share)
    assert known.share <= 0.2
    ids = np.where(np.arange(6000) % 3 == 0, 7, np.arange(6000))
    got = nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(3), spark).collect()
    hits = total = 0
    for q in range(0, 6000, 50):
        if q % 3:
            like = np.where(ids == q, -np.inf, unit @ unit[q])
            want = np.sort(like)[::-1][:5]
            own = sorted((r.score for r in got if r.query_id == q), reverse=True)
            hits, total = hits + sum(o >= want[-1] - 1e-12 for o in own), total + 5
    assert hits >= 0.9 * total
