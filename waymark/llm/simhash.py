"""Near-duplicate groups by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints are computed a document at a time. Links (at most `distance` differing bits, 2 or fewer) are
sought among distinct fingerprints only, so groups of exact copies cost one fingerprint each. The 64 bits fall into
four blocks; two fingerprints that differ in two bits or fewer agree on two blocks at least, so each of the
six pairs of blocks deals the fingerprints out by those 32 bits. Inside such a group fingerprints stand in
order of Gray rank and form a tree: a node holds the bits that all below it share. Two nodes are compared on bits that
both hold and that no ancestor pair had compared; once the accumulated difference passes the limit, all
pairs below are pruned. A group gives a spanning forest of its links, never all pairs. Groups with more than a fixed share of the fingerprints
are dealt once more by the pairs of blocks of their open bits, which leaves at most 65536 rows in a group.

Nulls: a null text counts as empty; documents without words have fingerprint zero and link like any others. Repeated
rows get equal results; a null doc_id stays null and never names a component (a component of such rows only has
a null id). A very long text is one vote count, made in steps of bounded size. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import HOT_KEYS, components, meet, stage, table

BLOCKS = 4
FAN_OUT = 8
PAIRS_AT_ONCE = 1 << 20
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints of a group that one task may hold whatever their share of all.
GROUP_ROWS = 1 << 16


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of all `width`-word shingles of a text; 0 if it has no words."""
    words = raw.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[part], ends[part], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row of documents; fp has the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py() or b"", width, seed) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayTree:
    """Levels of nodes over fingerprints that are in order of (group, Gray rank); a node never spans groups."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        everything = np.full(len(fps), ~np.uint64(0))
        self.levels = [(fps, everything, None, None)]
        ids = group
        while len(ids) and (ids[1:] == ids[:-1]).any():
            first = np.r_[True, ids[1:] != ids[:-1]]
            begin = np.flatnonzero(first)
            within = np.arange(len(ids)) - begin[np.cumsum(first) - 1]
            start = np.flatnonzero(within % FAN_OUT == 0)
            pattern, mask, *_ = self.levels[-1]
            ones = np.bitwise_and.reduceat(pattern & mask, start)
            zeros = np.bitwise_and.reduceat(~pattern & mask, start)
            self.levels.append((ones, ones | zeros, start, np.diff(np.r_[start, len(ids)])))
            ids = ids[start]

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i < j) of fingerprints of one group that differ in at most `distance` bits."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
        while stack:
            level, a, b, spent, done = stack.pop()
            if level == 0:
                yield a, b
                continue
            _, _, start, size = self.levels[level]
            pattern, mask, *_ = self.levels[level - 1]
            step = max(1, PAIRS_AT_ONCE // FAN_OUT**2)
            for at in range(0, len(a), step):
                p, q, acc, known = (x[at : at + step] for x in (a, b, spent, done))
                n, m = size[p], size[q]
                of = np.repeat(np.arange(len(p)), n * m)
                k = np.arange(len(of)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                c, d = start[p][of] + k // m[of], start[q][of] + k % m[of]
                ok = c < d if level == 1 else c <= d
                ok |= p[of] != q[of]
                c, d, of = c[ok], d[ok], of[ok]
                common = mask[c] & mask[d]
                total = acc[of] + np.bitwise_count((pattern[c] ^ pattern[d]) & common & ~known[of])
                ok = total <= distance
                if ok.any():
                    stack.append((level - 1, c[ok], d[ok], total[ok], common[ok]))


class Forest:
    """Union-find over indexes; the least index of a tree is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flat(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root = self.flat()
            x, y = root[a], root[b]
            if not (differ := x != y).any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _forest(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the groups in a partition that is sorted by (which, block, more, sub); a group is held whole, others stream."""

    def solve(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        at = np.lexsort((gray_rank(fps), group))
        group, fps = group[at], fps[at]
        forest = Forest(len(fps))
        for a, b in GrayTree(fps, group).links(distance):
            forest.join(a, b)
        root = forest.flat()
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (linked, root[linked])], ["a", "b"])

    held = (np.empty((0, 4), np.int64), np.empty(0, np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([held[0], np.stack([np.asarray(c) for c in batch.columns[:4]], axis=1)])
        fps = np.r_[held[1], np.asarray(batch.column(4)).view(np.uint64)]
        new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        last = np.flatnonzero(new)[-1]
        if last:
            yield solve(np.cumsum(new)[:last], fps[:last])
        held = keys[last:], fps[last:]
    if len(held[0]):
        yield solve(np.zeros(len(held[0]), np.int64), held[1])


def _agreeing(fp: Column, size: int, first: int) -> list[Column]:
    """(which, block) for each pair of the BLOCKS blocks of `size` bits from bit `first` on: the bits of that pair."""
    blocks = [((1 << size) - 1) << (first + size * i) for i in range(BLOCKS)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [F.struct(F.lit(k).cast("long").alias("which"), fp.bitwiseAND(F.lit(signed(blocks[i] | blocks[j]))).alias("block")) for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))]


def _dealt(distinct: DataFrame, group_rows: int) -> DataFrame:
    """(which, block, more, sub, fp): distinct fingerprints by the pairs of blocks they may share. Groups of more than group_rows
    rows are dealt once more, by the pairs of four blocks of the bits that the first pair leaves open; two
    fingerprints within two bits of each other agree on one of these as well. 16 open bits are left then, so no group has more than 65536 rows."""
    size = 64 // BLOCKS
    each = distinct.select("fp", F.explode(F.array(*_agreeing(F.col("fp"), size, 0))).alias("k")).select("fp", "k.which", "k.block")
    counted = stage(each.groupBy("which", "block").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "simhash-blocks")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Large groups above a share of their rows are fewer than HOT_KEYS: they stay where they are and learn it by a broadcast. The other large
    # ones, any number of them, are too small to weigh on a task and learn it in a join.
    hot, warm = (counted.where(c).select("which", "block", F.lit(True).alias("hot")) for c in (F.col("n") > total // HOT_KEYS, F.col("n") <= total // HOT_KEYS))
    each = each.join(F.broadcast(hot), ["which", "block"], "left")
    if not warm.isEmpty():
        each = each.where("hot is not null").unionByName(each.where("hot is null").drop("hot").join(warm, ["which", "block"], "left"))
    # The open bits of a pair of blocks, side by side in the low 32 bits.
    pairs = list(combinations(range(BLOCKS), 2))
    part = lambda i: F.shiftrightunsigned("fp", size * i).bitwiseAND((1 << size) - 1)
    open_bits = [F.shiftleft(part(b), size).bitwiseOR(part(a)) for i, j in pairs for a, b in [[x for x in range(BLOCKS) if x not in (i, j)]]]
    low = F.element_at(F.array(*open_bits), (F.col("which") + 1).cast("int"))
    none = F.array(F.struct(F.lit(-1).cast("long").alias("which"), F.lit(0).cast("long").alias("block")))
    each = each.withColumn("low", low)
    again = F.explode(F.when(F.col("hot"), F.array(*_agreeing(F.col("low"), size // 2, 0))).otherwise(none)).alias("s")
    return each.select("which", "block", "fp", again).select("which", "block", F.col("s.which").alias("more"), F.col("s.block").alias("sub"), "fp")


def near_groups(fps: DataFrame, distance: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(fp, root) for each distinct fingerprint of fps: root is the least fingerprint reachable by links."""
    if not 0 <= distance <= BLOCKS - 2:
        raise ValueError(f"distance must be from 0 to {BLOCKS - 2}")
    distinct = fps.select("fp").distinct()
    keys = ["which", "block", "more", "sub"]
    dealt = _dealt(distinct, group_rows).repartition(*keys).sortWithinPartitions(*keys)
    links = dealt.mapInArrow(lambda it: _forest(it, distance), "a long, b long")
    roots = components(links)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, width: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text); component_id is the least doc_id that links reach."""
    fps = stage(fingerprints(docs, width, seed), "simhash")
    groups = stage(near_groups(fps, distance), "simhash-groups")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).join(groups, "fp")
    names = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = stage(least.join(names, "root").select("fp", "component_id", "n"), "simhash-names")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return meet(fps, named, "fp", total, F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
