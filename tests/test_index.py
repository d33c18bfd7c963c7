import random
from collections import Counter

from pyspark.sql import functions as F

from lexmill.operators import fulltext


def docs(spark, n, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choice(["of", "the", "a", "yard", "Été", "of of"]) for _ in range(rng.randint(0, 30)))) for i in range(n)], "ord long, text string").repartition(3)


def test_one_list_per_term_and_text(spark, tmp_path, monkeypatch):
    """The index used to have a row per token, which a shuffle sorted."""
    monkeypatch.setattr(fulltext, "RUN", 50)
    df = docs(spark, 300)
    fulltext.write_index(df, "ord", ["text"], str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i/postings"))
    assert stored.count() == stored.select("term", "ord").distinct().count() < stored.agg(F.sum("tf")).first()[0]
    index, plain = fulltext.open_index(spark, str(tmp_path / "i")), fulltext.build_index(df, "ord", ["text"])
    assert index.single and sorted(index.postings.collect()) == sorted(plain.postings.collect())
    phrase = fulltext.parse('"of the"', ["text"])
    got = {r.ord: r["rank"] for r in fulltext.match(index, phrase).collect()}
    texts = {r.ord: r.text.split() for r in df.collect()}
    assert got.keys() == {k for k, w in texts.items() if ("of", "the") in zip(w, w[1:], strict=False)}
    assert got == {r.ord: r["rank"] for r in fulltext.match(plain, phrase).collect()}


def test_counts_of_repeated_ids(spark, tmp_path):
    for name, df in (("once", docs(spark, 200)), ("twice", docs(spark, 200).union(docs(spark, 150, 8)))):
        fulltext.write_index(df, "ord", ["text"], str(tmp_path / name))
        index = fulltext.open_index(spark, str(tmp_path / name))
        tf, where, total = Counter(), {}, Counter()
        for r in df.collect():
            for i, w in enumerate(r.text.lower().replace("é", "e").split()):
                tf[w] += 1
                total[w] += i
                where.setdefault(w, set()).add(r.ord)
        assert index.single == (name == "once")
        assert {r.term: (r.tf, r.df, r.positions) for r in fulltext.term_counts(index).collect()} == {w: (tf[w], len(where[w]), total[w]) for w in tf}
