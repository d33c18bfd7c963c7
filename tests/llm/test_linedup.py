import random

from lexmill.llm.linedup import dedup_lines


def brute(rows, width=3):
    first = {}
    for i, t in rows:
        ls = t.split("\n") if i is not None and t is not None else []
        for p in range(len(ls) - width + 1):
            w = tuple(ls[p : p + width])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        gone = {q for p in range(len(ls) - width + 1) if i is not None and first[tuple(ls[p : p + width])] < (i, p) for q in range(p, p + width)}
        spans = sum(q - 1 not in gone for q in gone)
        out.append((i, None if t is None else "\n".join(x for q, x in enumerate(ls) if q not in gone), len(ls), len(gone), spans))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcde") * rng.randint(0, 2) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "\n\n\n\n"), (903, "x\n" * 500), (None, rows[3][1]), (4, rows[4][1]), (-1, rows[9][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, key int").repartition(3)
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "key", "_n_lines", "n_removed", "n_spans"]
    assert sorted(((r.doc_id, r.text, r._n_lines, r.n_removed, r.n_spans) for r in got.collect()), key=str) == brute(rows)
    assert dedup_lines(df.limit(0)).count() == 0
