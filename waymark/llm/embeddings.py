"""Near-duplicate vectors through a pivot-permutation index.

Equal vectors form one class, so copies cost one row. Reference points (pivots) are a fixed-size sample of the classes, about
twice the square root of their number (64 to 65536). A vector is described by its nearest pivots in order (8 of up to 200 pivots, more
of more) and enters the inverted list of each. Within a list the vectors that share a second pivot are found first, and only pairs that share
two pivots or more are candidates; candidates are verified by cosine in double precision. A pair that shares more counts where its least two
shared pivots are. A list is cut into blocks of at most `block_floats` components, and each pair of blocks is a task of its own, so no task
holds more than two blocks however hot a list is. A task gives the number of links of each vector and a spanning forest, never the pairs.

Recall: every vector is indexed, links are lost only where two vectors at cosine 0.9 or more share fewer than two pivots. The length of the
permutations grows with the pivots so that this stays rare in a dense cluster too (a third of a million vectors at mutual cosine 0.8:
0.96 of the pairs at cosine 0.9 found); the tests measure it against brute force.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept. Vectors of different
lengths never link. Rows that repeat a vec_id and vector link with each other like any copies; a null vec_id never names a
component unless all its ids are null. Pivots that are equally near count in order of their number. Very long vectors make smaller blocks. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import components, meet, stage, table
from waymark.llm.simhash import Forest

NEAREST = 8
PIVOTS = 1 << 16
BLOCK_FLOATS = 1 << 20
#: Distances to pivots that a task holds at a time.
NEAR_FLOATS = 1 << 22
COSINE = 0.9


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all rows have one length and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutation(x: np.ndarray, pivots: np.ndarray, nearest: int, most: int = NEAR_FLOATS) -> np.ndarray:
    """The closest pivots of each row, closest first. Rows are taken so many at a time that no array has more than `most` distances."""
    k = min(nearest, len(pivots))
    out, step = np.empty((len(x), k), np.int64), max(1, most // max(len(pivots), 1))
    for at in range(0, len(x), step):
        near = -(x[at : at + step] @ pivots.T)
        top = np.argpartition(near, k - 1, axis=1)[:, :k]
        out[at : at + step] = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def nearest_for(pivots: int) -> int:
    """Length of the permutations: so many of more pivots that two vectors at cosine 0.9 in one dense cluster still share two."""
    return math.ceil(NEAREST * max(1.0, pivots / 200) ** 0.3)


def _pivots(classes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Sampled reference points by vector length."""
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sizes.items():
        wanted = int(min(most, max(64, 2 * math.sqrt(n))))
        rows = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "id").limit(wanted).select("embedding").toArrow()
        out[dim] = _units(rows.column("embedding").combine_chunks())
    return out


def _dealt(classes: DataFrame, nearest: int | None, most: int) -> DataFrame:
    """(id, dim, perm) of classes: perm holds the nearest pivots, closest first."""
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part, own = b.filter(pa.array(dims == dim)), pivots.value[int(dim)]
                perm = permutation(_units(part.column(2)), own, nearest or nearest_for(len(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(perm.tolist(), pa.list_(pa.int32()))], ["id", "dim", "perm"])

    return classes.select("id", "dim", "embedding").mapInArrow(run, "id long, dim int, perm array<int>")


def _least_two(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The two least pivots that the permutations p and q share, of each row."""
    same = (p[:, :, None] == q[:, None, :]).any(2)
    return np.partition(np.where(same, p, np.iinfo(np.int64).max), 1, axis=1)[:, :2]


def _links(cosine: float):
    """Links of a list (the vectors that have its pivot) within a block or between two. Those of a list that have a second pivot in
    common are the inverted list of that pair of pivots: only its pairs share two pivots, and only they are verified."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, pivot, lo, hi = (k.as_py() for k in key)
        rows = rows.combine_chunks()
        ids, copies, block = (rows.column(c).to_numpy() for c in ("id", "n", "b"))
        order = np.lexsort((ids, block))
        ids, copies, block = ids[order], copies[order], block[order]
        x = _units(rows.column("embedding").combine_chunks())[order]
        perm = np.array(rows.column("perm").to_pylist(), np.int64).reshape(len(ids), -1)[order]
        cut = int((block == lo).sum())
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        member, place = np.nonzero(perm > pivot)
        second = perm[member, place]
        by = np.lexsort((member, second))
        for own in np.split(by, np.flatnonzero(np.diff(second[by])) + 1) if len(by) else []:
            pair = np.array([pivot, second[own[0]]])
            own = member[own]
            left, right = (own, own) if lo == hi else (own[own < cut], own[own >= cut])
            for at in range(0, len(left), 256):
                i, j = np.nonzero(x[left[at : at + 256]] @ x[right].T >= cosine)
                i, j = left[at + i], right[j]
                i, j = i[i < j], j[i < j]
                for s in range(0, len(i), 1 << 16):
                    p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    # A pair with more shared pivots counts where the least two are.
                    ok = (_least_two(perm[p], perm[q]) == pair).all(1)
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    forest.join(p, q)
        has = np.flatnonzero(links)
        return pa.table({"id": ids[has], "links": links[has], "root": ids[forest.flat()[has]]})

    return run


def vector_groups(vectors: DataFrame, cosine: float = COSINE, nearest: int | None = None, pivots: int = PIVOTS, block_floats: int = BLOCK_FLOATS) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors(vec_id, embedding).

    nearest: length of the permutations, set from the number of pivots where it is None; pivots: at most so many; block_floats: at most so
    many components of vectors in a block.
    """
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    vectors = vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding"))
    classes = vectors.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("id"), "vec_id", "n", F.size("embedding").alias("dim"), "embedding"), "vectors")
    lists = stage(_dealt(classes, nearest, pivots), "pivot-lists")
    each = lists.select("id", "dim", "perm", F.explode("perm").alias("list"))
    # One row for each list, so no more than there are pivots.
    long = each.groupBy("dim", "list").agg(F.ceil(F.count("*") * F.col("dim") / block_floats).cast("int").alias("blocks"))
    each = each.join(F.broadcast(long), ["dim", "list"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.join(classes.select("id", "n", "embedding"), "id").withColumns({"lo": F.least("b", "other"), "hi": F.greatest("b", "other")})
    found = each.select("dim", "list", "lo", "hi", "b", "id", "n", "embedding", "perm").groupBy("dim", "list", "lo", "hi").applyInArrow(_links(cosine), "id long, links long, root long")
    found = stage(found, "vector-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = classes.select("id", "vec_id", "n", "embedding").join(counted, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    groups = groups.select("embedding", "vec_id", F.col("n").alias("rows"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    groups = stage(groups, "vector-groups")
    least = groups.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    total = groups.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    named = meet(groups, least, "root", total[0], F.xxhash64("vec_id")).select("embedding", F.col("rows").alias("n"), "n_links", "component_id")
    out = meet(vectors, stage(named, "vector-names"), "embedding", total[1], F.xxhash64("vec_id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_groups(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
