"""Queries against plain Python on small tables."""

import hashlib
import re
import textwrap

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def run(spark, name, d=D):
    return entry.queries()[name](spark, d).collect()


def test_evidence_of_all_items(spark, tmp_path):
    texts = [f"item {i}\n" + f"word{i} \t" * (i * 9) for i in range(70)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    blocks = {}
    for i, t in enumerate(texts):
        cited = f"SMC {i}" if i % 2 == 0 else f"c{i}"
        blocks.setdefault(f"part {i % 3}", []).append(f"[{cited}] \n" + textwrap.shorten(t, width=1200, placeholder=" …"))
    want = {k: k.upper() + ":\n" + "\n\n".join(v) for k, v in blocks.items()}
    got = {r.label: (r.n, r.digest) for r in run(spark, "evidence_prompt", tmp_path)}
    assert got == {k: (len(v), hashlib.md5(v.encode()).hexdigest()) for k, v in want.items()}


def brute_matches(rows):
    """Per customer: its norm, number and street, and the candidates (score, street_all, attempt, PIN) in order of choice."""
    kinds = ("St", "Ave", "Dr", "Rd")
    parcels = sorted((f"{k % 60} {seg} {kinds[n % 4]}", str(k), k % 60, seg, kinds[n % 4].upper(), k % 3 == 0, k % 7 == 0) for k, n, seg in rows if n % 5)
    out = {}
    for k, _, seg in rows:
        asked = (f" {k % 60}  {seg.lower()} Street, Seattle WA 98101", f"{seg} avenue", f"{k % 60} {seg[:4]} road", f"{k % 60} Nowhere Boulevard")[k % 100 // 25]
        norm = re.sub(r"\s+", " ", asked.strip().upper())
        for cut in (",.*$", "SEATTLE.*$", "WA.*$", r"\d{5}.*$"):
            norm = re.sub(cut, "", norm)
        for word, short in (("STREET", "ST"), ("AVENUE", "AVE"), ("ROAD", "RD"), ("BOULEVARD", "BLVD")):
            norm = re.sub(rf"\b{word}\b", short, norm)
        norm = norm.strip()
        m = re.match(r"(\d+)\s+(.+)$", norm)
        number, street = m.groups() if m else (None, norm)
        tests = (
            lambda p, f: f.startswith(norm) and number in (None, str(p[2])),
            lambda p, f: number == str(p[2]) and f.startswith(f"{number} {street.split(' ')[0]}"),
            lambda p, f: street in f,
            lambda p, f: number == str(p[2]),
        )
        attempt, found = next(((a, hit) for a, t in enumerate(tests, 1) if (hit := [p for p in parcels if t(p, p[0].upper())][:10])), (0, []))
        need, scored = street.split(" "), []
        for p in found:
            f, hits = p[0].upper(), sum(t in p[3:5] for t in need)
            points = 120 if f == norm else 80 if f.startswith(norm) else 40 if norm in f else 0
            points += 0 if number is None else 45 if int(number) == p[2] else -35
            points += hits * 25 + 35 * (hits == len(need)) - 30 * (len(need) - hits) - 50 * (hits == 0) + 10 * p[5] - 5 * p[6]
            scored.append((points, hits == len(need), p[1], p[0], f))
        kept = [x for x in scored if x[1]] or scored
        best = min(kept, key=lambda x: (not x[1], -x[0], x[3], x[2]), default=None)
        status = "none" if best is None else "weak" if best[0] < 40 else "wrong_street" if not best[1] and best[4] != norm else "matched"
        out[k] = norm, number, street, "|".join(need), {(attempt, p[1]) for p in found}, {(x[2], x[0], x[1]) for x in kept}, (best and best[2], status)
    return out


def test_matches_of_all_customers(spark):
    rows = [(r.c_custkey, r.c_nationkey, r.c_mktsegment) for r in spark.read.parquet(f"{D}/customer.parquet").collect()]
    want = brute_matches(rows)
    assert {r.request: (r.norm, r.number, r.street, r.tokens) for r in run(spark, "address_norm")} == {k: v[:4] for k, v in want.items()}
    assert sorted((r.request, r.attempt, r.PIN) for r in run(spark, "cascade_lookup")) == sorted((k, *x) for k, v in want.items() for x in v[4])
    assert sorted((r.request, r.PIN, r.score, r.street_all) for r in run(spark, "match_score")) == sorted((k, *x) for k, v in want.items() for x in v[5])
    assert {r.request: (r.PIN, r.match_status) for r in run(spark, "match_pick")} == {k: v[6] for k, v in want.items()}


def test_all_matches_of_boolean_and_near(spark, tmp_path):
    kinds = ("he came with it", "for one", "with no word from me", "from a b c with", "from a b c d with", "none")
    rows = [(i, kinds[i % 6], "en", "s") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in run(spark, "fts_boolean", tmp_path)) == [i for i in range(1500) if i % 6 in (0, 1)]
    assert sorted(r.doc_id for r in run(spark, "fts_near", tmp_path)) == [i for i in range(1500) if i % 6 in (2, 3)]
