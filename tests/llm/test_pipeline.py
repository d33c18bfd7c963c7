from collections import Counter

import corpus_pipeline as pipeline
from test_neardup import brute as near_brute
from test_tokens import check_packing

D = "/root/testdata/sf0.001"


def thin(rows, width=3):
    """Line dedup by a dictionary of windows."""
    first = {}
    for i, t in sorted(rows):
        ls = t.split("\n")
        for p in range(len(ls) - width + 1):
            first.setdefault(tuple(ls[p : p + width]), (i, p))
    out = {}
    for i, t in rows:
        ls = t.split("\n")
        gone = {q for p in range(len(ls) - width + 1) if first[tuple(ls[p : p + width])] < (i, p) for q in range(p, p + width)}
        if len(gone) < len(ls):
            out[i] = "\n".join(x for q, x in enumerate(ls) if q not in gone)
    return out


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, steps = docs.columns, {"documents": docs}
    for name, stage in pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, D).write.parquet(out)
        docs = steps[name] = spark.read.parquet(out)
        assert docs.columns == columns or name == "packing"
    text = {k: [(r.doc_id, r.text) for r in v.select("doc_id", "text").collect()] for k, v in steps.items() if k != "packing"}
    # Quality: labelled good documents stay, most labelled bad ones go.
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {i for i, _ in text["quality"]}
    good, bad = ([i for i in truth if truth[i] == y] for y in (1, 0))
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)
    assert dict(text["line_dedup"]) == thin(text["quality"])
    assert {i for i, _ in text["near_dedup"]} == {i for i, _, c, _ in near_brute(text["line_dedup"], 5, 80) if c == i}
    # Mixing: sources near their targets, nothing more than three times.
    source = {r.doc_id: r.source for r in steps["near_dedup"].collect()}
    size = {i: len(t.encode().split()) for i, t in text["near_dedup"]}
    times = Counter(i for i, _ in text["mixing"])
    assert set(times) <= set(size) and max(times.values()) <= 3
    totals, taken = Counter(), Counter()
    for i, s in source.items():
        totals[s] += size[i]
        taken[s] += size[i] * times[i]
    assert abs(sum(taken.values()) - sum(totals.values())) <= len(totals) * max(size.values())
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(totals))}
    full = {s for s in totals if taken[s] == 3 * totals[s]}
    left = sum(totals.values()) - sum(3 * totals[s] for s in full)
    for s in totals.keys() - full:
        assert abs(taken[s] - left * weights[s] / sum(weights[x] for x in totals.keys() - full)) <= max(size[i] for i in size if source[i] == s)
    packed = {}
    for i, t in text["mixing"]:
        packed.setdefault(i, []).append(t)
    check_packing(steps["packing"].collect(), packed)


CLASHES = ("n_lines", "n_removed", "n_spans", "_s", "_k", "size", "reps", "key", "id", "component", "kept", "predicted_", "slice_", "gone_", "_row")
LINES = [f"the committee met on day {i} and agreed to read the report of its member number {i} again before the summer" for i in range(30)]


def odd(spark):
    """Null, empty, blank and long texts, a null source, null and repeated ids, repeated rows, ties and clashing columns."""
    page = "\n".join(LINES[:6])
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t\n ", None), (4, page, "b"), (4, page, "b"), (5, page + "\nOne more line that only this text has.", None)]
    rows += [(None, "\n".join(LINES[6:12]), "b"), (None, "\n".join(LINES[6:12]), "b"), (6, "\n".join(f"{x} in chapter {k}" for k in range(40) for x in LINES), "c"), (7, "\n".join(LINES[12:20]), "c"), (8, "\n".join(LINES[12:20]), "c")]
    rows += [(9, "\n".join(LINES[20:25]), "a"), (9, "\n".join(LINES[25:29]), "a")]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), *([3] * len(CLASHES))) for i, t, s in rows], schema).repartition(3)


def test_stages_on_odd_rows(spark, tmp_path):
    docs, texts = odd(spark), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        assert docs.filter(" OR ".join(f"`{c}` <> 3" for c in CLASHES)).count() == 0
        texts[name] = Counter((r.doc_id, r.text) for r in docs.collect())
        given = Counter((r.doc_id, r.text) for r in before.collect())
        if name == "quality":  # equal texts share their fate, and no row is made
            fate = {}
            for (i, t), n in given.items():
                assert texts[name][i, t] in (0, n)
                assert fate.setdefault(t, texts[name][i, t] > 0) == (texts[name][i, t] > 0)
        if name == "line_dedup":
            assert sum(texts[name].values()) <= sum(given.values())
            assert {(i, t) for i, t in given if i is None or not t} <= set(texts[name])
        if name == "near_dedup":
            ids = [i for i, n in texts[name].items() for _ in range(n) if i[0] is not None]
            assert len(ids) == len({i for i, _ in ids})
            assert all(texts[name][i, t] == n for (i, t), n in given.items() if i is None)
            assert {i for i, t in given if not (t or "").split()} <= {i for i, _ in texts[name]}
        if name == "mixing":
            assert all((t or "").split() for _, t in texts[name]) and all(n <= 3 * given[k] for k, n in texts[name].items())
    packed = {}
    for (i, t), n in texts["mixing"].items():
        packed.setdefault(i, []).extend([t] * n)
    check_packing(docs.collect(), packed)


def test_empty_table_and_session_options(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    assert pipeline.apply(spark, odd(spark).limit(0), D).count() == 0
    assert spark.conf.get(name) == before
