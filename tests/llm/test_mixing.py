import random

import pytest

from lexmill.llm.mixing import mix, repeat_documents, source_targets


def filled(sizes, cycle=3, most=3):
    """Clamp and reshare until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % cycle + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_equal_the_loop(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i:02d}": rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 100_000)]) for i in range(n)} | {None: 5}
        df = spark.createDataFrame(list(sizes.items()), "source string, words long")
        got = {r.source: r.target for r in source_targets(df, "source", "words", 3, 3).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "é", None]), 0) for i in range(300)]
    rows += [(900, None, "a", 0), (901, "", "only-empty", 0), (None, "no id", "b", 0), (5, "again", "b", 0), (5, "again", "b", 0), (902, "x y z\x0b" * 20_000, "long", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = mix(df, spark).collect()
    assert len(got) == len(rows) and all(r._size == len((r.text or "").encode().split()) for r in got)
    sizes, taken, longest = {}, {}, {}
    for r in got:
        assert 0 <= r.reps <= 3
        for d, v in ((sizes, r._size), (taken, r._size * r.reps)):
            d[r.source] = d.get(r.source, 0) + v
        longest[r.source] = max(longest.get(r.source, 0), r._size)
    want = filled(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = sorted((str(r.doc_id), r._size, r.reps) for r in mix(df.repartition(5), spark).collect())
    assert again == sorted((str(r.doc_id), r._size, r.reps) for r in got)
    copies = repeat_documents(df, spark)
    assert copies.columns == df.columns and copies.count() == sum(r.reps for r in got if r._size)
    assert mix(df.limit(0), spark).count() == 0
