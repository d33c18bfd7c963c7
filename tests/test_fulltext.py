import random
import sqlite3

import pytest

from lexmill.operators import fulltext

WORDS = ["yard", "yards", "rear", "tree", "permit", "Café", "23", "the", "setback", "naïve"]
QUERIES = ["yard", "rear yard", "yard OR tree", "yard NOT tree", '"rear yard"', "rear + yard", "yar*", "text : section", "chunk_id : section", "(yard OR tree) AND permit", "yard OR (tree AND permit)", "cafe", "the", "yard yard", '"23"', "^tree", "{chunk_id text} : permit"]
QUERIES += ["yard NOT tree AND permit", "yard AND permit NOT tree", "yard rear NOT tree NOT permit", "yard NOT tree OR permit", "- chunk_id : section", "- {text} : section", "text : (chunk_id : section OR yard)", "-text:(section OR yard)", "text : yard tree", "yard NOT (tree AND permit)", "{text} : (yard AND NEAR(tree permit, 4))"]


def test_equals_fts5(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"smc-{rng.randint(22, 23)}-section-{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(1, 90)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_id, text)")
    db.executemany("INSERT INTO f(rowid, chunk_id, text) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "ord int, chunk_id string, text string").cache()
    fulltext.write_index(df, "ord", ["chunk_id", "text"], str(tmp_path / "index"))
    index, plain = fulltext.open_index(spark, str(tmp_path / "index")), fulltext.build_index(df, "ord", ["chunk_id", "text"])
    assert (index.rows, index.mean_length) == (plain.rows, plain.mean_length) and sorted(index.postings.collect()) == sorted(plain.postings.collect())
    index.postings = index.postings.cache()
    for q in QUERIES:
        got = {r.ord: r["rank"] for r in fulltext.match(index, fulltext.parse(q, ["chunk_id", "text"])).collect()}
        want = dict(db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", [q]))
        assert got.keys() == want.keys(), q
        if "^" not in q and "NEAR" not in q:  # of these, only the matches are the same
            assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want), q


@pytest.mark.parametrize("bad", ["", "23.44", "yard,tree", "o'brien", "(yard", "nosuch : yard", "yard OR", '"open', "(yard OR tree) permit", "yard (permit)", "(yard)(tree)", "- yard"])
def test_syntax_errors(bad):
    with pytest.raises(fulltext.QueryError):
        fulltext.parse(bad, ["chunk_id", "text"])
