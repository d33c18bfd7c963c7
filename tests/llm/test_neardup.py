import random

import pytest

from lexmill.llm import neardup
from lexmill.llm.neardup import drop_near_duplicates, near_duplicates


def brute(rows, k, percent):
    """Components by comparing all pairs of shingle sets as words."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(x)
    pairs = {(x, y) for v in where.values() for x in v for y in v if x < y}
    for x, y in pairs:
        (a, s), (b, t) = sets[x], sets[y]
        if a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def fixture():
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    common = [word() for _ in range(60)]
    for _ in range(60):
        rows.append((len(rows), " ".join(word() for _ in range(rng.randint(1, 80)))))
    for g in range(6):
        base = [word() for _ in range(120)]
        for c in range(2 + 12 * g):  # near copies, with similarities on both sides of the limit
            w = base[:]
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) + 1000, " ".join(w) if c % 5 else "  ".join(base).upper()))
    for _ in range(40):
        rows.append((len(rows) + 2000, " ".join([word() for _ in range(40)] + common)))
    rng.shuffle(rows)
    return [*rows, (9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "ONE "), (9006, "one two three"), (9007, "É é"), (9008, "é É"), (None, "one"), (9004, "one"), (5, rows[0][1])]


def test_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    assert rows_of(near_duplicates(df, spark, k=4)) == brute(rows, 4, 80)


@pytest.mark.parametrize("percent", [40, 60, 95])
def test_other_similarities(spark, percent):
    rows = fixture()
    rng = random.Random(11)
    base = [f"v{i}" for i in range(100)]
    for c in range(40):
        rows.append((20_000 + c, " ".join(w if rng.random() > 0.1 * (c % 3) else f"x{rng.randrange(10**6)}" for w in base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(near_duplicates(df, spark, k=1, percent=percent)) == brute(rows, 1, percent)


def test_blocks_of_contested_groups(spark, monkeypatch):
    """Groups of several blocks, of rows and of components outside the largest, keep every link."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(near_duplicates(df, spark, k=4)) == brute(rows, 4, 80)


def test_similarities_that_cannot_be_found(spark):
    with pytest.raises(ValueError, match="percent"):
        near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark, percent=5)
    assert [neardup.rows_of_band(p) for p in (15, 60, 80, 100)] == [1, 2, 4, 8]


def test_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(near_duplicates(docs, spark, k=4)) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)


def test_empty_and_kept_rows(spark):
    schema = "doc_id long, text string, gone_ int"
    assert near_duplicates(spark.createDataFrame([], schema), spark).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text, 1), (2, text, 2), (2, text, 3), (9, None, 4), (None, text, 5), (7, "other words here", 6)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, schema), spark)
    assert kept.columns == ["doc_id", "text", "gone_"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, text), (2, text), (7, "other words here"), (9, "")]
