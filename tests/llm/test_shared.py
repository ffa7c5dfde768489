"""Joins that split hot keys, running combinations, components."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from waymark.llm import linededup, shared


def test_running_sums_and_extremes(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randrange(-50, 50) for _ in range(k)]) for k in (0, 1, 2, 3, 7, 8, 9, 100, 1000)]
    df = spark.createDataFrame(rows, "k int, v array<long>")
    got = df.select("k", "v", shared.running(F.col("v")).alias("sums"), shared.running(F.col("v"), F.greatest, -100).alias("most")).collect()
    for r in got:
        assert r.sums == [sum(r.v[: i + 1]) for i in range(r.k)] and r.most == [max(r.v[: i + 1]) for i in range(r.k)]


def largest_share(df, n):
    return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("top")).collect()) / n


@contextmanager
def conf(spark, values):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_meet_splits_hot_keys(spark):
    n = 30_000
    many = spark.range(n).select(F.when(F.col("id") % 3 == 0, -7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("v"))
    one = many.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}):
        inner = shared.meet(many, one, "k", n, F.xxhash64("v"))
        left = shared.meet(many, one, "k", n, F.xxhash64("v"), "left")
        assert inner.columns == ["k", "v", "top"] and inner.count() == n * 2 // 3 and left.count() == n
        assert inner.where("k = -7 and top = 29997").count() == n // 3 and left.where("k is null and top is null").count() == n // 3
        # A plain join has a third of the rows in one task, this not twice a fair share.
        assert largest_share(many.join(one, "k", "left"), n) > 0.33
        assert largest_share(left, n) < 2 / 16


def test_components_of_a_hub(spark):
    hub = [(50_000, k) for k in range(1, 20_001)]
    chain = [(60_000 + k, 60_001 + k) for k in range(200)]
    edges = spark.createDataFrame([*hub, *chain, (70_000, 70_000)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in shared.components(edges).collect()}
    assert got == {50_000: 1, **{k: 1 for k in range(2, 20_001)}, **{60_001 + k: 60_000 for k in range(200)}}


def test_a_chunk_in_a_third_of_all_texts(spark):
    rng = random.Random(8)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
    licence = [words() for _ in range(10)]
    rows = [(k, "\n".join([words(), *(licence if k % 3 == 0 else []), words(), words()])) for k in range(3000)]
    got = linededup.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = {r.doc_id: r._n_removed for r in got}
    assert gone[0] == 0 and all(gone[k] == 0 for k in range(3000) if k % 3)
    assert len({gone[k] for k in range(3, 3000, 3)} - {0}) <= 3 and min(gone[k] for k in range(3, 3000, 3)) >= 4


def test_whole_copies_lose_all_lines(spark):
    rng = random.Random(9)
    text = lambda n: "\n".join(f"line {rng.randrange(10**9)}" for _ in range(n))
    rows = [(k, text(k)) for k in range(2, 40)]
    copies = [(100 + k, t) for k, t in rows]
    got = {r.doc_id: r for r in linededup.mark_repeats(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert all(got[k]._n_removed == 0 and got[100 + k]._n_removed == k and got[100 + k]._kept == "" for k in range(2, 40))
