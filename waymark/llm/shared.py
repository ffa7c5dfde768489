"""What the text operators share: reading tables, staging intermediate results, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, and where that is unset a temporary
    folder (one machine) or a folder in the warehouse (a cluster)."""
    conf = spark.sparkContext.getConf()
    if shared := conf.get("spark.checkpoint.dir", None):
        return shared
    app = spark.sparkContext.applicationId
    if app not in _own:
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        _own[app] = tempfile.mkdtemp(prefix="waymark-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir')}/_waymark"
    return _own[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here, and a lost executor
    costs no more than a reread. The files go when the program ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def release(staged: DataFrame) -> None:
    """Deletes the files of a staged result once all that was made of it is staged itself."""
    _remove(staged.sparkSession, staged.staged_at)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: A key is hot if it holds more than this share of the rows that meet, so there are never more hot keys than this.
HOT_KEYS = 1024
#: Rows of a key that one task may hold whatever the share.
HOT_LEAST = 256


def hot_limit(total: int) -> int:
    return max(HOT_LEAST, total // HOT_KEYS)


def deal(many: DataFrame, hot: DataFrame, key: str, salt: Column) -> DataFrame:
    """many with `_salt`: rows of a hot key (of hot(key, _parts), fewer than HOT_KEYS rows) spread over its parts, others 0. Rows
    whose key is null spread too, as they meet nothing."""
    spread = F.when(F.col(key).isNull(), F.pmod(salt, F.lit(HOT_KEYS))).otherwise(F.coalesce(F.pmod(salt, F.col("_parts")), F.lit(0)))
    return many.join(F.broadcast(hot), key, "left").withColumn("_salt", spread.cast("int")).drop("_parts")


def copies(one: DataFrame, limit: int) -> DataFrame:
    """one(key, n, ...) with `_salt`: as many rows as deal() spreads the n rows of the key over."""
    return one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n"), F.lit(1)) / limit).cast("int") - 1)))


def hot_keys(one: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, _parts) of the keys of one(key, n, ...) with more than limit rows."""
    return one.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias("_parts"))


def meet(many: DataFrame, one: DataFrame, key: str, total: int, salt: Column, how: str = "inner") -> DataFrame:
    """many joined with one on key, no task holding more than a fixed share of a key's rows.

    one has a row for each key and `n`, the number of rows of many that have it; total: the sum of n. The join splits hot keys by itself, since
    Spark's skew handling leaves joins alone whose other side is an aggregate on the same key. The salt must differ between the rows of a key.
    """
    limit = hot_limit(total)
    hot = hot_keys(one, key, limit)
    if how == "inner" and hot.isEmpty():
        return many.join(one.drop("n"), key)
    return deal(many, hot, key, salt).join(copies(one, limit), [key, "_salt"], how).drop("_salt", "n")


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, start: int = 0) -> Column:
    """Running sums (or another associative combination with the neutral element start) of an array of longs, by doubling steps: n log n
    work and arrays of the same length only, where a fold that appends would copy its result at each step."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    back = lambda acc, s: F.concat(F.array_repeat(F.lit(start).cast("long"), F.least(s, F.size(acc))), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - s, F.lit(0))))
    return F.aggregate(steps, values.cast("array<bigint>"), lambda acc, s: F.zip_with(acc, back(acc, s), lambda a, b: combine(a, b)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once a row even where use names it within a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _with_least(edges: DataFrame, limit: int | None) -> DataFrame:
    """edges(a, b) with m, the least b of each a. Nodes of more than limit edges meet their m by broadcast: of these there are at most
    as many as limit goes into the number of edges. No limit: there are no such nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if limit is None:
        return edges.join(least.drop("n"), "a")
    known = edges.join(F.broadcast(least.where(F.col("n") > limit).select("a", F.col("m").alias("hot"))), "a", "left")
    rest = known.where("hot is null").select("a", "b").join(least.select("a", "m"), "a")
    return known.where("hot is not null").select("a", "b", F.col("hot").alias("m")).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), long columns: rows (node, root), root the least node reachable,
    for each node that is not its own root.

    Alternates large-star and small-star rounds, each a grouped minimum that its edges meet again, until a round changes nothing. The
    edges of a hub stay where they are and get the hub's minimum by a broadcast of bounded size; nothing but two numbers a round
    reaches the driver.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node has no more edges after the first half of a round than it had neighbours before.
        limit = hot_limit(2 * seen[0])
        widest = both.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        limit = limit if widest is not None and widest > limit else None
        large = _with_least(both, limit).select("a", "b", F.least("a", "m").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _with_least(large.where("a <> b").distinct(), limit)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, edges = edges, stage(small.select("e.*").where("a <> b").distinct(), "edges")
        release(before)
        now = _state(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
