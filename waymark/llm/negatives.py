"""Hard-negative mining over k-means inverted lists with stored centroid radii.

Rows become integer vectors. Centroids are fitted on a bounded sample; every row enters the list of its nearest centroid, and each list stores its radius, the
largest distance of a member to the centroid. For an anchor a the scores in a list lie between a.c - |a| r and a.c + |a| r (Cauchy-Schwarz). An anchor visits
the lists in falling order of the upper bound, skips those whose bounds lie outside all its score windows, and stops when the bound falls strictly below its
kth score. Visits are made in waves of 4, 16, 64, ... lists, so a handful of joins serve all anchors. Lists are cut into blocks and the anchors that visit a
list into chunks of bounded size; a task scores one chunk against one block and keeps k rows for each anchor and window. Scores are exact integers and bounds have
slack outwards, so the results are those of brute force: pruning saves work and never loses a row.

Two searches use this: the best rows of the same label (positives), then, for each positive, the best rows of other labels whose score lies in the
window that the positive's score gives.

Defined cases: rows whose label or vector is null, or whose vector holds null or non-finite components, take no part. Repeated rows are rows of their own, so a
copy of an anchor is one of its positives. Ties go to the smaller vec_id, null ids last; a null id is no anchor. Vectors of different lengths never meet; those
of lengths that the sample lacks, empty ones included, form one list for each length. An anchor without positives, or with an empty window (negative scores),
gives no rows. Components beyond 2^31 count as 2^31, scores beyond a long as its largest or smallest value. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.centroids import integers, matrix
from waymark.llm.shared import release, stage, table

POSITIVES = 5
NEGATIVES = 10
LEAST, MOST = 30, 90
ANCHORS_EVERY = 100
#: At most so many centroids, fitted on at most so many rows a centroid and on vectors of at most so many components.
CENTROIDS = 2048
SAMPLE_EACH = 16
SAMPLE_WIDTH = 1024
LLOYD_ROUNDS = 4
#: Components of vectors in a block of a list, and in a chunk of the anchors that visit it.
BLOCK_FLOATS = 1 << 20
CHUNK_FLOATS = 1 << 22
FIRST_VISITS, GROWTH = 4, 4
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
WINDOWS = "array<struct<lo:bigint,hi:bigint,kth:bigint>>"


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the distinct rows of a sample, in its order."""
    x = np.unique(x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(LLOYD_ROUNDS):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _centroids(rows: DataFrame, n: int, most: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, fitted in one task on a bounded sample of the rows."""
    k = min(most, max(4, math.isqrt(n)))
    wanted = k * SAMPLE_EACH
    share = min(1.0, 2 * wanted / max(n, 1))
    at = F.xxhash64("row", "x")
    near = rows.where((F.pmod(at, F.lit(1 << 20)) < max(1, int(share * (1 << 20)))) & F.col("dim").between(1, SAMPLE_WIDTH))
    sample = near.orderBy(at, "row").limit(wanted).select("dim", "x").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        whole = pa.Table.from_batches(found).combine_chunks()
        dims = whole.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = whole.filter(pa.array(dims == dim)).combine_chunks()
            fitted = _fit(matrix(own.column("x").combine_chunks(), int(dim)).astype(np.float64), math.ceil(k * len(own) / len(dims)))
            yield pa.RecordBatch.from_arrays([pa.array([int(dim)] * len(fitted), pa.int32()), pa.array(fitted.tolist(), pa.list_(pa.float64()))], ["dim", "c"])

    out: dict[int, list] = {}
    for r in sample.mapInArrow(run, "dim int, c array<double>").collect():
        out.setdefault(r.dim, []).append(r.c)
    return {dim: np.array(c) for dim, c in out.items()}


def _listed(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """rows with `cluster` (-1: no centroids for this length) and `r`, the distance to its centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cluster, r = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if (centres := shared.value.get(int(dim))) is None:
                    continue
                at = np.flatnonzero(dims == dim)
                x = matrix(b.column("x").take(pa.array(at)), int(dim)).astype(np.float64)
                near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
                cluster[at], r[at] = near, np.linalg.norm(x - centres[near], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(r)], [*b.schema.names, "cluster", "r"])

    columns = ["row", "vec_id", "label", "dim", "x"]
    return rows.select(columns).mapInArrow(run, "row long, vec_id long, label long, dim int, x array<bigint>, cluster int, r double")


@dataclass
class Lists:
    """The index: its rows, its lists (dim, cluster, blocks), and the centroids with their radii for the bounds."""

    rows: DataFrame
    blocks: DataFrame
    centroids: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index(vectors: DataFrame, centroids: int = CENTROIDS, block_floats: int = BLOCK_FLOATS) -> Lists:
    """Inverted lists over all usable rows of vectors(vec_id, label, embedding)."""
    kept = integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("label is not null"), None)
    rows = stage(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("dim"), "x"), "list-rows")
    fitted = _centroids(rows, rows.count(), centroids)
    listed = stage(_listed(rows, fitted), "lists")
    release(rows)
    lists = listed.groupBy("dim", "cluster").agg(F.count("*").alias("n"), F.max("r").alias("radius"))
    blocks = lists.select("dim", "cluster", F.ceil(F.col("n") * F.greatest("dim", F.lit(1)) / block_floats).cast("int").alias("blocks"), "radius")
    blocks = stage(blocks, "list-sizes")
    # Only lists with a centroid come here, so no more than there are centroids.
    bounds = {dim: (c, np.linalg.norm(c, axis=1), np.full(len(c), -1.0)) for dim, c in fitted.items()}
    for r in blocks.where("cluster >= 0").collect():
        bounds[r.dim][2][r.cluster] = r.radius
    return Lists(listed, blocks, bounds)


def next_visits(x: np.ndarray, windows: list[dict], seen: int, step: int, about: tuple | None) -> tuple[list[int], int]:
    """The next `step` lists that an anchor has to visit, in falling order of their upper bounds, from place `seen` of that order on,
    and the place where the next wave goes on."""
    if about is None:
        return ([-1], 1) if seen == 0 and windows else ([], seen)
    centres, norms, radii = about
    if seen >= len(centres) or not windows:
        return [], seen
    dot, size = centres @ x, float(np.linalg.norm(x))
    slack = 1e-9 * size * (norms + radii) + 1e-6
    upper, lower = dot + size * radii + slack, dot - size * radii - slack
    order = np.argsort(-upper, kind="stable")[seen:]
    needed = np.zeros(len(order), bool)
    for w in windows:
        needed |= (upper[order] >= max(w["lo"], w["kth"])) & (lower[order] <= w["hi"])
    needed &= radii[order] >= 0  # a radius below zero: the list is empty
    at = np.flatnonzero(needed)[:step]
    if len(at) < step:
        return order[at].tolist(), len(centres)
    return order[at].tolist(), seen + int(at[-1]) + 1


def _visits(state: DataFrame, lists: Lists, step: int) -> DataFrame:
    """state with the `clusters` of the next wave; anchors that have none are done and left out."""
    shared = state.sparkSession.sparkContext.broadcast(lists.centroids)
    columns = ["q", "label", "dim", "x", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, windows, seen, dims = b.column("x"), b.column("windows").to_pylist(), b.column("seen").to_pylist(), b.column("dim").to_pylist()
            found = [next_visits(xs[i].values.to_numpy(zero_copy_only=False).astype(np.float64), windows[i], seen[i], step, shared.value.get(dims[i])) for i in range(len(b))]
            has = pa.array([bool(c) for c, _ in found])
            out = [*(b.column(c) for c in columns), pa.array([s for _, s in found], pa.int32()), pa.array([c for c, _ in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, [*columns, "seen", "clusters"]).filter(has)

    return state.select(*columns, "seen").mapInArrow(run, f"q long, label long, dim int, x array<bigint>, windows {WINDOWS}, seen int, clusters array<int>")


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of x, held within a long."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    s = a.astype(object) @ x.astype(object).T
    return np.clip(s, _LOW, _HIGH).astype(np.int64)


def best(score: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores among ok, highest first; of equal scores the earlier place."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        s = score[at]
        kth = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > kth]
        at = np.concatenate([above, at[s == kth][: k - len(above)]])
    return at[np.lexsort((at, -score[at].astype(object) if score.size and score.min() == _LOW else -score[at]))]


def _scored(k: int, same: bool):
    """The best k rows of a block for each anchor of a chunk and each of its windows."""

    def run(key: tuple, block: pa.Table, chunk: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if block.num_rows and chunk.num_rows:
            width = int(key[0].as_py())
            block = block.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()  # nulls come last
            ids, rows, labels = block.column("vec_id"), block.column("row").to_numpy(), block.column("label").to_numpy()
            x = matrix(block.column("x").combine_chunks(), width)
            chunk = chunk.combine_chunks()
            names, own, windows = chunk.column("q").to_numpy(), chunk.column("label").to_numpy(), chunk.column("windows").to_pylist()
            anchors = matrix(chunk.column("x").combine_chunks(), width)
            for start in range(0, len(names), 128):
                scores = _scores(anchors[start : start + 128], x)
                for i, score in enumerate(scores, start):
                    fit = ((labels == own[i]) == same) & (rows != names[i])
                    for slot, w in enumerate(windows[i]):
                        at = best(score, fit & (score >= max(w["lo"], w["kth"])) & (score <= w["hi"]), k)
                        for column, values in zip(out, ([names[i]] * len(at), [slot] * len(at), score[at].tolist(), ids.take(pa.array(at)).to_pylist(), rows[at].tolist()), strict=True):
                            column.extend(values)
        return pa.table(dict(zip(("q", "slot", "score", "vec_id", "row"), map(pa.array, out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())), strict=True)))

    return run


def search(lists: Lists, anchors: DataFrame, k: int, same: bool, chunk_floats: int = CHUNK_FLOATS, tally: list | None = None) -> DataFrame:
    """(q, slot, score, vec_id, row, rank): for each of anchors(q, label, dim, x, windows) and each of its windows the first k rows of the same label, or of
    others. tally, if given, gets the number of lists that all anchors visit in each wave."""
    spark = lists.rows.sparkSession
    tops = spark.createDataFrame([], "q long, slot int, score long, vec_id long, row long, rank int")
    state, step, written = anchors.withColumn("seen", F.lit(0)), FIRST_VISITS, None
    place = ["dim", "cluster", "block", "chunk"]
    while True:
        going = stage(_visits(state, lists, step), "visits")
        if going.isEmpty():
            return tops
        each = going.select("q", "label", "dim", "x", "windows", F.explode("clusters").alias("cluster"))
        sizes = each.groupBy("dim", "cluster").agg(F.count("*").alias("visits"))
        sizes = sizes.select("dim", "cluster", F.ceil(F.col("visits") * F.greatest("dim", F.lit(1)) / chunk_floats).cast("int").alias("chunks"))
        sizes = stage(sizes.join(lists.blocks.select("dim", "cluster", "blocks"), ["dim", "cluster"]), "visit-sizes")
        if tally is not None:
            tally.append(each.count())
        chunks = each.join(sizes, ["dim", "cluster"]).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
        chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*place, "q", "label", "x", "windows")
        blocks = lists.rows.join(sizes, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*place, "row", "vec_id", "label", "x")
        found = blocks.groupBy(place).cogroup(chunks.groupBy(place)).applyInArrow(_scored(k, same), "q long, slot int, score long, vec_id long, row long")
        order = Window.partitionBy("q", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        merged = tops.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        tops = stage(merged, "tops")
        kth = tops.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        held = F.transform("windows", lambda w, i: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), F.coalesce(F.try_element_at("kth", i), w["kth"]).alias("kth")))
        state = going.join(kth, "q", "left").select("q", "label", "dim", "x", held.alias("windows"), "seen")
        for old in written or ():
            release(old)
        step, written = step * GROWTH, (going, sizes, tops)


def _window(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(_LOW).cast("long").alias("kth"))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, centroids: int = CENTROIDS, block_floats: int = BLOCK_FLOATS, chunk_floats: int = CHUNK_FLOATS) -> DataFrame:
    """For each row of vectors(vec_id, label, embedding) that meets the condition `anchor` on vec_id and label, and each of its best `positives` rows of the same label, the
    best `negatives` rows of other labels that score between least and most percent of the positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    lists = index(vectors, centroids, block_floats)
    anchors = lists.rows.where(anchor).select(F.col("row").alias("q"), F.col("vec_id").alias("anchor_id"), "label", "dim", "x")
    whole = anchors.withColumn("windows", F.array(_window(F.lit(_LOW), F.lit(_HIGH))))
    found = search(lists, whole, positives, True, chunk_floats)
    score = F.col("score").cast("decimal(20,0)")
    lo, hi = F.ceil(score * least / 100), F.floor(score * most / 100)
    found = stage(found.where("score >= 0").select("q", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), _window(lo, hi).alias("w")), "positives")
    # At most `positives` rows for each anchor.
    windows = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("ws"))
    wanted = anchors.join(windows.select("q", F.transform("ws", lambda w: w["w"]).alias("windows")), "q")
    held = search(lists, wanted.drop("anchor_id"), negatives, False, chunk_floats).select("q", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = held.join(found.drop("w"), ["q", "place"]).join(anchors.select("q", "anchor_id"), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % ANCHORS_EVERY == 0)


OP11_SQL = f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
s AS MATERIALIZED (SELECT a.r AS q, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM r a JOIN r b ON len(a.x) = len(b.x) AND a.r <> b.r WHERE a.vec_id % {ANCHORS_EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.q, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.q = p.q AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
