"""Centroid clustering with Hamerly's bounds, exact on integer vectors.

The state of a vector is its components, its cluster, one upper bound of the distance to its own centroid and one lower bound of the distance to the
second nearest. A round loosens both by how far the centroids drifted (the upper by its own centroid's drift, the lower by the largest drift
of the others) and keeps the cluster of every vector whose upper bound is strictly below the lower one, or below half the distance from its
centroid to the next. Others get the exact distance to their own centroid first, and those that stay ambiguous a full scan of all centroids in exact integers.
Bounds are rounded outwards, so they only ever save work. A round is one pass without a shuffle: the state is written to the shared folder and the one before
it goes; new centroids come from the sums of the vectors that moved, grouped by both clusters. The driver holds centroids alone.

Defined cases: vectors that are null, of another length, or that hold null or non-finite components take no part and give no row. Repeated rows count
as often as they occur. Ties between centroids go to the smaller number; where hashes of ids are equal, the lesser components begin first; null ids begin
last. With fewer vectors than centroids there are as many centroids as vectors. An empty cluster keeps its centroid. Components beyond 2^31 either way
count as 2^31, and distances beyond a long as its largest value. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import release, stage, table

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SALT = "2:"
SCALE = 256
WIDEST = 1 << 31
_LONGEST = (1 << 63) - 1
#: Relative slack by which bounds are rounded outwards.
_OUT = 1e-12
STATE = "vec_id long, x array<bigint>, cluster int, before int, upper double, lower double"


def integers(vectors: DataFrame, components: int | None, scale: int = SCALE) -> DataFrame:
    """vectors with `x`, their components as integers floor(scale * component), without the rows that take no part."""
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & usable)
    if components is not None:
        kept = kept.where(F.size("embedding") == components)
    whole = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(WIDEST)), F.lit(-WIDEST)))
    return kept.withColumn("x", whole.cast("array<bigint>"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _exact(*parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The integer arrays as doubles where all sums of squared differences stay below 2^53, else as Python's integers."""
    most = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    kind = np.float64 if parts[0].shape[-1] * (2 * most) ** 2 < 1 << 53 else object
    return tuple(p.astype(kind) for p in parts)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all centres."""
    x, centres = _exact(x, centres)
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]


def own_squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the centre in the same row."""
    x, centres = _exact(x, centres)
    return ((x - centres) ** 2).sum(1)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Bounds:
    """What a round needs to know of the centroids: where they are, how far they drifted, and half the way to the next."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None) -> None:
        self.centres = centres
        n = len(centres)
        self.drift = np.zeros(n) if before is None else _roots(own_squares(centres, before)) * (1 + _OUT)
        between = _roots(squares(centres, centres)) + np.where(np.eye(n, dtype=bool), np.inf, 0)
        self.half = between.min(1) / 2 * (1 - _OUT)
        largest = int(np.argmax(self.drift))
        self.others = np.full(n, self.drift[largest])
        self.others[largest] = np.delete(self.drift, largest).max(initial=0)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds, and how many rows had a full scan. Rows of cluster -1 have none yet."""
        known = cluster >= 0
        own = np.where(known, cluster, 0)
        upper = np.where(known, (upper + self.drift[own]) * (1 + _OUT), np.inf)
        lower = np.where(known, lower - self.others[own], -np.inf)
        lower = np.where(known, lower - np.abs(lower) * _OUT, lower)
        least = np.where(known, np.maximum(lower, self.half[own]), -np.inf)
        open_ = np.flatnonzero(upper >= least)
        tight = open_[known[open_]]
        if len(tight):
            upper[tight] = _roots(own_squares(x[tight], self.centres[own[tight]])) * (1 + _OUT)
            open_ = np.flatnonzero(upper >= least)
        cluster = cluster.copy()
        if len(open_):
            d = squares(x[open_], self.centres)
            best = d.argmin(1)  # the first of equals
            rows = np.arange(len(open_))
            upper[open_] = _roots(d[rows, best]) * (1 + _OUT)
            rest = d.astype(np.float64)
            rest[rows, best] = np.inf
            lower[open_] = np.sqrt(rest.min(1)) * (1 - _OUT)
            cluster[open_] = best
        return cluster, upper, lower, len(open_)


def _round(state: DataFrame, bounds: Bounds) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            before = b.column("cluster").to_numpy()
            x = matrix(b.column("x"), shared.value.centres.shape[1])
            cluster, upper, lower, _ = shared.value.assign(x, before, b.column("upper").to_numpy(), b.column("lower").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "x", "cluster", "before", "upper", "lower"])

    return state.select("vec_id", "x", "cluster", "upper", "lower").mapInArrow(run, STATE)


def _measured(state: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) with exact squared distances."""
    shared = state.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = b.column("cluster").to_numpy()
            d = own_squares(matrix(b.column("x"), shared.value.shape[1]), shared.value[cluster])
            d = d.astype(np.int64) if d.dtype != object else np.array([min(v, _LONGEST) for v in d], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "cluster", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def _moved(state: DataFrame, components: int) -> list:
    """Of the vectors that moved, counts and sums of components by both clusters: a bounded number of rows."""
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(components)]
    return state.where("before <> cluster").groupBy("before", "cluster").agg(F.count("*").alias("n"), *sums).collect()


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, salt: str = SALT, tally: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of vectors(vec_id, embedding), and the final centroids.

    The first centroids are the vectors whose salted ids have the smallest SHA-256. tally, if given, gets the number of vectors that moved in each round.
    """
    kept = integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), components)
    unset = [F.lit(-1).alias("cluster"), F.lit(-1).alias("before"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower")]
    state = stage(kept.select("vec_id", "x", *unset), "cluster-state")
    named = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = state.orderBy(named.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    if not first:
        return state.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), np.zeros((0, components), np.int64)
    centres = np.array([r.x for r in first], np.int64)
    sums, counts, before = [[0] * components for _ in centres], [0] * len(centres), None
    for k in range(rounds + 1):
        old, state = state, stage(_round(state, Bounds(centres, before)), "cluster-state")
        release(old)
        if k == rounds:
            break
        moved = _moved(state, components)
        for r in moved:
            for place, sign in ((r.cluster, 1), (r.before, -1)):
                if place >= 0:
                    counts[place] += sign * r.n
                    sums[place] = [s + sign * v for s, v in zip(sums[place], r[3:], strict=True)]
        if tally is not None:
            tally.append(sum(r.n for r in moved))
        before, centres = centres, np.array([[s // n for s in own] if n else list(was) for own, n, was in zip(sums, counts, centres.tolist(), strict=True)], np.int64)
    return _measured(state, centres), centres


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = stage(found, "clusters")
    within = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(within.values()), _LONGEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    about = [(k, min(within.get(k, 0), _LONGEST), total, d) for k, d in enumerate(digests)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_rounds() -> str:
    """Each round's assignment and centroids as common table expressions."""
    nearest = "SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(kept.x, {c}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, k := k)) AS m FROM kept, {c} GROUP BY r"
    out = []
    for i in range(ROUNDS):
        out.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})")
        out.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (SELECT a{i}.m.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, {COMPONENTS + 1}) t(j) GROUP BY 1, 2) GROUP BY k) n ON n.k = c{i}.k)""")
    return ",\n".join([*out, f"last AS MATERIALIZED ({nearest.format(c=f'c{ROUNDS}')})"])


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {COMPONENTS}),
c0 AS MATERIALIZED (SELECT k, x FROM (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id) NULLS LAST, x) - 1 AS k, x FROM kept) WHERE k < {CLUSTERS}),
{_sql_rounds()}
SELECT vec_id, last.m.k::INTEGER AS cluster, last.m.d AS distance, (sum(last.m.d) OVER (PARTITION BY last.m.k))::BIGINT AS cluster_inertia, (sum(last.m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256
FROM last JOIN kept USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.k = last.m.k
"""
