import hashlib
import random

import numpy as np
import pytest

from lexmill.llm import suffix
from lexmill.llm.suffix import merge_spans, multikey_quicksort, repeated_strings


def brute(rows, length=100):
    """By a dictionary of all strings: (id, bytes, removed, spans, hash) of each row."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                s = b[p : p + length]
                first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < (i, p):
                gone[p : p + length] = 1
        rest = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_sort_and_merge():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 3, (3000, 5), dtype=np.uint64)
    got = words[multikey_quicksort(words)]
    assert (got == words[np.lexsort(words.T[::-1])]).all()
    assert merge_spans(np.array([50, -3, 10, 8]), np.array([70, 5, 20, 10]), 60) == [(0, 5), (8, 20), (50, 60)]


def test_equals_brute_force(spark):
    rng, rows = random.Random(8), []
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 130, 168, 250, 900)]
    for _ in range(150):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            parts += [p[a : a + rng.choice([len(p), rng.randint(90, 200)])], text(rng.randint(0, 80))]
        rows.append((len(rows), "".join(parts)))
    rows += [(500, None), (501, ""), (502, "x" * 350), (503, "x" * 100), (504, "ab " * 120), (None, passages[6]), (7, rows[7][1]), (9, passages[5] + "z"), (-4, passages[6][300:600]), (600, rows[3][1] * 2)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    assert rows_of(repeated_strings(df, spark)) == brute(rows)
    assert repeated_strings(df.limit(0), spark).count() == 0


@pytest.mark.parametrize("buckets", [1, 97])
def test_grams_that_fill_buckets(spark, monkeypatch, buckets):
    """One gram with many contexts is cut by splitters, and its strings meet across the boundaries; long bodies are sampled in chunks."""
    monkeypatch.setattr(suffix, "CHUNK", 1000)  # executors fork from this process's modules only in part; the result is the same either way
    rng, gram = random.Random(5), "the same leading words of many texts, "
    tails = ["".join(rng.choice("xyz ") for _ in range(rng.randint(40, 90))) for _ in range(120)]
    heads = ["".join(rng.choice("pq ") for _ in range(70)) for _ in range(12)]
    rows = [(i, rng.choice(heads) + gram + rng.choice(tails) + str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        assert rows_of(repeated_strings(df, spark)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chunks_of_long_bodies(monkeypatch):
    body = np.frombuffer("".join(random.Random(2).choice("abc") for _ in range(5000)).encode(), np.uint8)
    bounds = np.array([0, 1700, 1750, 5000])
    want = suffix.anchors(body, bounds)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    got = suffix.anchors(body, bounds)
    starts = lambda x: sorted((s, int(p)) for p, _, a, b in zip(*x, strict=True) for s in range(a, b + 1))
    assert starts(got) == starts(want) and [s for s, _ in starts(got)] == [*range(1601), *range(1750, 4901)]


def test_nothing_goes_without_the_sort(spark, monkeypatch):
    """What decides is the sort: with an order that parts equal contexts and no comparison nothing is removed."""
    rows = [(i, "a passage that several documents share, word for word, and that is long enough to be found by the search " * 2 + str(i)) for i in range(6)]
    body = np.frombuffer(b"".join(t.encode() for _, t in rows), np.uint8)
    bounds = np.cumsum([0, *(len(t) for _, t in rows)])
    at, _, first, last = suffix.anchors(body, bounds)
    text = np.searchsorted(bounds, at, "right") - 1
    place = ((at - bounds[text]) << 16) | ((at - first) << 8) | (last - first)
    _, _, left, right = suffix.unpack(place)
    keys = np.concatenate([suffix.windows(body, at, right, suffix.RIGHT_WORDS), suffix.windows(body, at, left, suffix.LEFT_WORDS, True)], 1)
    stay, covered = suffix.settle(keys, text, place)
    assert len(covered) > len(stay) / 2 and len(stay) + len(covered) == len(at)
    monkeypatch.setattr(suffix, "multikey_quicksort", lambda w: np.argsort(text, kind="stable"))
    apart = suffix.settle(keys, text, place)
    assert len(apart[1]) < len(covered)


def test_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(repeated_strings(docs, spark)) == brute([(r.doc_id, r.text) for r in docs.collect()])
