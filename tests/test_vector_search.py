import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import vectors


def plain(requests, rows, k):
    """Every pair scored by ``dot`` and ranked by a window."""
    scored = rows.crossJoin(requests).withColumn("score", vectors.dot(F.col("embedding"), F.col("query_vector")))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def made(spark, n, seed):
    """Vectors with many copies, halves that tie, other lengths, nulls inside and outside, and what is not finite."""
    rng = random.Random(seed)
    kinds = [[rng.choice([-0.5, 0.1, 0.25, 1.0]) for _ in range(6)] for _ in range(12)]
    odd = [None, [], [1.0] * 3, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), 0.0, 1.0, 1.0, 1.0, 1.0], [1e300] * 6]
    return [(i, rng.choice(odd) if rng.random() < 0.1 else rng.choice(kinds)) for i in range(n)]


def test_products_equal_every_pair(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "CELLS", 500)
    rows = spark.createDataFrame(made(spark, 900, 1), "ord long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v, i % 4) for i, v in made(spark, 60, 2)], "label long, query_vector array<double>, top_k int")
    for k in (4, F.col("top_k")):
        for table in (rows, rows.filter("ord < 3")):
            got, want = vectors.search_many(asked, table, k), plain(asked, table, k)
            one = lambda df: sorted((r.label, r["rank"], r.ord, repr(r.score)) for r in df.select("label", "rank", "ord", "score").collect())
            assert one(got) == one(want)


def test_few_rows_leave_a_task(spark):
    """Every pair's score used to be sorted by the JVM: now a task hands on little more than k rows per request."""
    rows = spark.range(20000).select(F.col("id").alias("ord"), F.array(*(F.sin(F.col("id") * (i + 1)).cast("float") for i in range(8))).alias("embedding"))
    asked = rows.filter("ord % 1000 = 0").select(F.col("ord").alias("label"), F.col("embedding").alias("query_vector"))
    found = vectors.search_many(asked, rows, 5)
    assert found.count() == 100
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.label, r.ord) for r in found.filter("rank = 1 AND label = 1000").collect()] == [(r.label, r.ord) for r in plain(asked, rows, 1).filter("label = 1000").collect()]


def test_requests_reach_a_task_once(spark):
    """The requests' bytes used to be joined to every row, which copied rows times requests."""
    rows = spark.range(3000).select(F.col("id").alias("ord"), F.array(*(F.sin(F.col("id") * (i + 1)) for i in range(4))).alias("embedding"), F.lit("text").alias("text"))
    asked = rows.filter("ord % 500 = 0").select(F.col("ord").alias("label"), F.col("embedding").alias("query_vector"), F.lit(2).alias("top_k"))
    assert "NestedLoop" not in vectors.search_many(asked, rows, 2)._jdf.queryExecution().toString()
    found = vectors.search_many(asked, rows, F.col("top_k"), keep=["text"])
    assert set(found.columns) == {"label", "ord", "text", "score", "rank"}
    one = lambda df: sorted((r.label, r["rank"], r.ord, repr(r.score)) for r in df.select("label", "rank", "ord", "score").collect())
    assert one(found) == one(plain(asked, rows, 2))
    assert vectors.search_many(asked.filter("label < 0"), rows, 3).count() == 0


def test_lengths_of_every_size_equal_every_pair(spark, monkeypatch):
    """Lengths beyond single precision, beyond its error and beyond double's squares, with copies and zeros."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "ROUND", 16)
    rng = random.Random(5)
    some = [(i, [rng.choice([0.0, 1.0, -0.5, 0.3]) * 10.0 ** rng.choice([-200, -160, -30, -11, 0, 0, 0, 7, 20, 150]) for _ in range(5)] if rng.random() < 0.7 else [0.1, -0.5, 0.0, 0.2, 1.0]) for i in range(700)]
    rows = spark.createDataFrame(some, "ord long, embedding array<double>")
    asked = spark.createDataFrame(some[:40], "label long, query_vector array<double>")
    for a, r in ((asked, rows), (asked.withColumn("query_vector", F.col("query_vector").cast("array<float>")), rows.withColumn("embedding", F.col("embedding").cast("array<float>")))):
        one = lambda df: sorted((x.label, x["rank"], x.ord, repr(x.score)) for x in df.select("label", "rank", "ord", "score").collect())
        assert one(vectors.search_many(a, r, 3)) == one(plain(a, r, 3))


def test_few_pairs_are_summed(spark, monkeypatch):
    """One frequent vector, a long one or an infinite one used to send every pair of a block to the exact sum, all at once."""
    import numpy as np
    import pyarrow as pa

    summed = []
    exact = vectors._exact
    monkeypatch.setattr(vectors, "_exact", lambda a, b: summed.append(len(a)) or exact(a, b))
    rng = np.random.default_rng(3)
    values = rng.normal(size=(8000, 16))
    values[::2] = values[0]
    values[4001], values[17] = np.inf, 1e9
    asked = pa.table({"label": np.arange(50), "query_vector": list(np.concatenate([values[:1].repeat(25, 0), rng.normal(size=(25, 16))]))})
    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), asked.schema) as out:
        out.write_table(asked)
    batch = pa.RecordBatch.from_pydict({"ord": pa.array(range(8000)), "embedding": list(values), "_asked": pa.array([sink.getvalue().to_pybytes()] + [None] * 7999)})
    found = pa.Table.from_batches(vectors._meet("embedding", "query_vector", asked.column_names, 4, ["ord"], ["label"])([batch]))
    assert sum(summed) < 50 * 8000 // 50
    assert len(found) < 50 * 40
    assert found.column_names == ["ord", "label", "score"]
