"""Leave-one-out evaluation, confusion rates, parameter sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folds(uids: DataFrame) -> DataFrame:
    """(test, train) pairs of uids(uid): each against all others. Pairs are what leave-one-out is, so uids are trajectories of one batch."""
    a, b = uids.select(F.col("uid").alias("test")).distinct(), uids.select(F.col("uid").alias("train")).distinct()
    return a.join(b, F.col("test") != F.col("train"))


def fold_sizes(uids: DataFrame) -> DataFrame:
    """(test, n, least): of each of the folds() how many uids are learned from and the least of them, without the pairs: all others are all less the own one."""
    each = uids.where("uid is not null").select(F.col("uid").alias("test")).distinct()
    two = each.orderBy("test").limit(2).agg(F.min("test").alias("_least"), F.max("test").alias("_next"))
    whole = each.agg((F.count("*") - 1).alias("n")).crossJoin(two)
    least = F.when(F.col("test") == F.col("_least"), F.col("_next")).otherwise(F.col("_least"))
    return each.crossJoin(F.broadcast(whole)).where("n > 0").select("test", "n", least.alias("least"))


def rates(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows(anomalous, outcome) by keys: auc = (TPR + TNR) / 2, and auc_swapped with the arguments exchanged; 0 where a class is missing."""
    n = lambda a, o: F.sum(F.when((F.col("anomalous") == a) & (F.col("outcome") == o), 1).otherwise(0))
    c = rows.groupBy(*keys).agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, True).alias("fp"), n(False, False).alias("tn"))
    half = lambda a, b, x, y: F.when((a + b > 0) & (x + y > 0), (a / (a + b) + x / (x + y)) / 2).otherwise(0.0)
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.withColumns({"auc": half(tp, fn, tn, fp), "auc_swapped": half(tp, fp, tn, fn)})


def delays(detected: DataFrame, truth: DataFrame, key: str = "uid") -> DataFrame:
    """(key, anomalous, outcome, delay): first detection less true onset in seconds, only where it is not negative."""
    first = detected.where("anomaly").groupBy(key).agg(F.min("ts").alias("first_ts"))
    both = truth.join(first, key, "left").withColumn("outcome", F.col("first_ts").isNotNull())
    late = (F.unix_micros(F.col("first_ts").cast("timestamp")) - F.unix_micros(F.col("onset").cast("timestamp"))) / 1e6
    return both.select(key, "anomalous", "outcome", F.when(late >= 0, late).alias("delay"))


def train_test(rows: DataFrame, train: DataFrame, test: DataFrame, key: str = "uid") -> DataFrame:
    """rows with `test`: whether the row's key is in test or in train (test where it is in both). ValueError if it is in neither."""
    known = test.select(key, F.lit(True).alias("test")).unionByName(train.select(key, F.lit(False).alias("test"))).groupBy(key).agg(F.max("test").alias("test"))
    found = rows.join(known, key, "left")
    if (lost := found.where("test is null").select(key).first()) is not None:
        raise ValueError(f"{key} {lost[0]} is in neither set")
    return found


def sweep(results: DataFrame, *params: str) -> DataFrame:
    """Medians over batches by parameter set; null where there is nothing to take one of."""
    return results.groupBy(*params).agg(*[F.median(c).alias(f"median_{c}") for c in ("auc", "fit_time", "detect_time", "delay") if c in results.columns])
