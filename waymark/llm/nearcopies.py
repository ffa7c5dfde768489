"""Groups of documents whose word shingles have a Jaccard similarity of 0.8 or more; the decision is exact.

Documents with equal sets of shingles (a 128-bit hash of the set) are one class. Candidates come twice:

1. Long SimHash fingerprints collapse dense groups at little cost. They have 256 bits, made of the set; `TABLES` fixed random choices of
`KEY_BITS` bits each deal the distinct fingerprints out; in a group the Gray-order tree over the first 64 bits prunes, the other bits decide, and a
spanning forest of the closest pairs goes on, block by block in groups longer than `BLOCK`. This pass may miss links.
2. Prefix filtering finds every link that the first left out. Shingles have one order for all texts, frequent ones last (the order decides
the work alone, never the result); two sets at the similarity must share one of the first n - ceil(similarity * n) + 1. Lists of these prefixes give
the pairs of different groups that sizes, positions and the number of shared prefix shingles still allow; none that could reach the similarity is left out.
Pairs of a list longer than `LIST` do not leave the task: the groups that long lists join are a cluster, whose texts are cut into blocks by bytes, and
each pair of blocks is a task that finds and verifies its pairs and gives a spanning forest. Work in such a cluster grows with its square, what
is sent grows with its square over the block size.

Candidates of both are verified on whole texts: exact Jaccard similarity of the sets of shingles (64-bit hashes). Components of verified edges are the groups.

Nulls: a null text counts as empty; texts without words form one class. Texts of fewer words than a shingle are one shingle. A null doc_id
never names a group and is never removed. Repeated rows are one class. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import components, meet, release, stage
from waymark.llm.simhash import SHINGLES_AT_ONCE, Forest, GrayTree, gray_rank

WIDTH = 5
SIMILARITY = 0.8
WORDS = 4
KEY_BITS = 18
TABLES = 72
#: Members of a group that meet all others at once; of larger groups the trees of each block go on by their roots.
BLOCK = 512
#: Bits that may differ in the first 64 and in all 256: far above what similarity 0.8 gives on average (10 and 39).
FIRST_BITS = 18
ALL_BITS = 54

#: Shingles that the common order of shingles knows as frequent.
FREQUENT = 1 << 18
PAIRS_AT_ONCE = 1 << 20
#: Entries of a list whose pairs leave the task; the groups of longer lists are compared in blocks of so many bytes.
LIST = 128
BLOCK_BYTES = 16 << 20
#: Keeps rounding from losing a pair at the similarity itself.
SLACK = 1e-9

_SEEDS = np.array([0x9E3779B97F4A7C15 * (k + 1) % (1 << 64) for k in range(WORDS)], np.uint64)
_CHOICES = np.stack([np.random.default_rng(k).choice(64 * WORDS, KEY_BITS, replace=False) for k in range(TABLES)])


def shingles(raw: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text joined by single spaces, and where each shingle starts and ends."""
    words = raw.lower().split()
    width = min(width, len(words))
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    return b" ".join(words), starts.tolist(), ends[width - 1 :].tolist()


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    joined, starts, ends = shingles(raw, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 3) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def _fingerprint(found: np.ndarray) -> bytes:
    """Each distinct shingle has one vote on each bit."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        x = found[at : at + SHINGLES_AT_ONCE, None] + _SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = np.ascontiguousarray(x ^ (x >> np.uint64(31)))
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found)).tobytes()


def long_fingerprint(raw: bytes, width: int) -> bytes:
    return _fingerprint(shingle_set(raw, width))


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(similarity * n - SLACK).astype(np.int64) + 1)


def index_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """Of the smaller of two sets at the similarity, one of so many first shingles is the first that both have."""
    return n - np.ceil(2 * similarity / (1 + similarity) * n - SLACK).astype(np.int64) + 1


def _prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: float) -> bytes:
    """The first shingles of a set in the common order, 32 bits of each (a clash only adds candidates)."""
    at = np.searchsorted(frequent, found)
    at[at == len(frequent)] = 0
    place = np.where(frequent[at] == found, rank[at], 0) if len(frequent) else np.zeros(len(found), np.int64)
    n = int(prefix_length(np.array([len(found)]), similarity)[0])
    return found[np.lexsort((found, place))[:n]].astype(np.uint32).tobytes()


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come often in a quarter of the texts, sorted, and their ranks, rarest first. They only order the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def often() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(found[count > 1].view(np.int64)), pa.array(count[count > 1])], ["h", "n"])

        for b in batches:
            for raw in b.column(0):
                held.append(shingle_set(raw.as_py() or b"", width))
                n += len(held[-1])
                if n >= 1 << 21:
                    yield often()
                    held, n = [], 0
        yield often()

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)) == 0).select(F.col("text").cast("binary").alias("text"))
    most = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    found = most.column("h").to_numpy().view(np.uint64)
    at = np.argsort(found)
    return found[at], (len(found) - np.arange(len(found)))[at]


def _prints(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, digest, fp, size, prefix) for each row of docs: all but doc_id follow from the set of shingles."""
    order = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(_digest(s), _fingerprint(s), len(s), _prefix(s, *order.value, similarity)) for s in (shingle_set(x.as_py() or b"", width) for x in b.column(1))]
            digest, fp, size, prefix = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(fp, pa.binary()), pa.array(size, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "digest", "fp", "size", "prefix"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, digest binary, fp binary, size long, prefix binary")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, key, id, fp) for each table."""
    weights = 1 << np.arange(KEY_BITS)
    for b in batches:
        if not b.num_rows:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
        for t in range(TABLES):
            keys = bits[:, _CHOICES[t]].astype(np.int64) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t)), pa.array(keys), b.column(0), b.column(1)], ["t", "key", "id", "fp"])


def _span(forest: Forest, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Joins pairs that come closest first, and returns the edges that did it: each tree takes its closest edge, again and again."""
    kept = []
    while True:
        root = forest.flat()
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return kept
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        best = np.full(len(root), len(a))
        np.minimum.at(best, x, np.arange(len(a)))
        np.minimum.at(best, y, np.arange(len(a)))
        best = np.unique(best[best < len(a)])
        kept.append(np.stack([a[best], b[best]]))
        forest.join(a[best], b[best])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the closest pairs; partitions come sorted by (t, key), a group is held whole."""

    def solve(group: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        at = np.lexsort((gray_rank(fps[:, 0]), group))
        group, ids, fps = group[at], ids[at], fps[at]
        forest, kept, active, block = Forest(len(ids)), [np.empty((2, 0), np.int64)], np.arange(len(ids)), BLOCK
        while len(active):
            g = group[active]
            begin = np.searchsorted(g, g)
            part = (np.arange(len(g)) - begin) // block
            for a, b in GrayTree(fps[active, 0], np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (part[1:] != part[:-1])])).links(FIRST_BITS):
                a, b = active[a], active[b]
                far = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64)
                close = np.flatnonzero(far <= ALL_BITS)
                close = close[np.argsort(far[close], kind="stable")]
                kept += _span(forest, a[close], b[close])
            many = np.unique(g[part > 0])
            left = active[np.isin(g, many) & (forest.flat()[active] == active)]
            block = block if len(left) <= len(active) // 2 else block * 2
            active = left
        a, b = ids[np.concatenate(kept, axis=1)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WORDS), np.uint64))
    for b in batches:
        if not b.num_rows:
            continue
        group = b.column(0).to_numpy() << KEY_BITS | b.column(1).to_numpy()
        fps = np.frombuffer(b"".join(b.column(3).to_pylist()), ">u8").astype(np.uint64).reshape(-1, WORDS)
        now = (np.r_[held[0], group], np.r_[held[1], b.column(2).to_numpy()], np.concatenate([held[2], fps]))
        last = int(np.searchsorted(now[0], now[0][-1])) if (np.diff(now[0]) >= 0).all() else int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1
        if last:
            yield solve(*(x[:last] for x in now))
        held = tuple(x[last:] for x in now)
    if len(held[0]):
        yield solve(*held)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, comp, size, at) for each shingle of the prefixes."""
    for b in batches:
        prefixes = [np.frombuffer(x.as_py(), np.uint32) for x in b.column(3)]
        n = np.array([len(x) for x in prefixes], np.int64)
        if not n.sum():
            continue
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes).view(np.int32)), *(b.column(k).take(of) for k in range(3)), pa.array(at.astype(np.int32))], ["h", "id", "comp", "size", "at"])


def _pairs(run: np.ndarray, comp: np.ndarray, size: np.ndarray, at: np.ndarray, similarity: float, first_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of entries of one list and of different groups that may reach the similarity by their sizes and places, and how many shingles
    they must share then; entries come sorted by (run, size), a run is a list.

    first_only: pairs are wanted once at least and not in every list, so entries too late in the smaller set to be the first that both share
    begin none.
    """
    spread = int(size.max(initial=0) / similarity) + 2
    n = np.searchsorted(run * spread + size, run * spread + np.floor(size / similarity + SLACK).astype(np.int64), "right") - np.arange(len(run)) - 1
    if first_only:
        # Sets of one size count in their order here.
        n[at >= index_length(size, similarity)] = 0
    total = np.cumsum(n)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
        m = n[first:last]
        a = np.repeat(np.arange(first, last), m)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        first = last
        differ = comp[a] != comp[b]
        a, b = a[differ], b[differ]
        wanted = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - SLACK).astype(np.int64)
        ok = np.minimum(at[a], at[b]) + np.minimum(size[a] - at[a], size[b] - at[b]) >= wanted
        yield a[ok], b[ok], wanted[ok]


def _meeting(similarity: float):
    """Of lists of up to LIST entries the pairs that may reach the similarity, with `least`, the number of prefix shingles that they must share: more
    common shingles than these and the rest of one set they cannot have. Of longer lists each group with the list's first (least null), as they
    are to meet elsewhere; a pair that shares a long list is met there, so it does not matter that its short ones count too few.
    Partitions come sorted by h; a long list streams."""

    def batch(a: np.ndarray, b: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()) if least is None else pa.array(least)], ["a", "b", "least"])

    def short(h: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((size, h))
        run, ids, comp, size, at = (x[order] for x in (np.cumsum(np.r_[0, h[1:] != h[:-1]])[: len(h)], ids, comp, size, at))
        rest = size - prefix_length(size, similarity)
        for a, b, wanted in _pairs(run, comp, size, at, similarity, False):
            yield batch(ids[a], ids[b], wanted - np.maximum(rest[a], rest[b]))

    def long(comp: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        others = np.unique(comp)
        others = others[others != first]
        yield batch(np.full(len(others), first), others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(5))
        streaming, first = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            held = tuple(np.r_[x, c.to_numpy()] for x, c in zip(held, b.columns, strict=True))
            h = held[0]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[begin, len(h)])
            # A list that may go on with the next batch waits, unless it is long already.
            done = size <= LIST
            done[-1] = False
            if streaming is not None and h[0] == streaming:
                done[0] = False
            keep = np.repeat(done, size)
            yield from short(*(x[keep] for x in held))
            for k in np.flatnonzero(~done):
                part = slice(begin[k], begin[k] + size[k])
                if streaming != h[begin[k]]:
                    if size[k] <= LIST:
                        continue
                    streaming, first = h[begin[k]], int(held[2][begin[k]])
                yield from long(held[2][part], first)
            last = begin[-1] if streaming != h[-1] else len(h)
            held = tuple(x[last:] for x in held)
        if len(held[0]):
            yield from short(*held)

    return run


def _dense(similarity: float):
    """A spanning forest of the links within a block of a cluster or between two; rows: lo, hi, b, id, comp, size, prefix, s."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        rows = rows.combine_chunks()
        ids, comp, size, block = (rows.column(c).to_numpy() for c in ("id", "comp", "size", "b"))
        prefixes = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("prefix")]
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("s")]
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        m = np.array([len(x) for x in prefixes])
        doc = np.repeat(np.arange(len(ids)), m)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)
        token = np.concatenate(prefixes).astype(np.int64)
        order = np.lexsort((size[doc], token))
        token, doc, at = token[order], doc[order], at[order]
        found = [np.empty(0, np.int64)]
        for a, b, _ in _pairs(np.cumsum(np.r_[0, token[1:] != token[:-1]])[: len(token)], comp[doc], size[doc], at, similarity, True):
            a, b = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
            if lo != hi:
                across = block[a] != block[b]
                a, b = a[across], b[across]
            found.append(np.unique(a * len(ids) + b))
        pairs = np.unique(np.concatenate(found))
        left, right = pairs // len(ids), pairs % len(ids)
        forest, mark = Forest(len(ids)), np.zeros(len(names), bool)
        for part in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(left)) + 1) if len(pairs) else []:
            a, others = left[part[0]], right[part]
            own = flat[begin[a] : begin[a] + size[a]]
            mark[own] = True
            n = size[others]
            starts = np.cumsum(n) - n
            both = np.add.reduceat(mark[flat[np.repeat(begin[others] - starts, n) + np.arange(int(n.sum()))]].astype(np.int64), starts)
            mark[own] = False
            near = others[both >= similarity * (size[a] + n - both) - SLACK]
            forest.join(np.full(len(near), a), near)
        root = forest.flat()
        linked = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[linked], "b": ids[root[linked]]})

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both) - SLACK)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (b.column(0), b.column(1))], ["a", "b"])

    return run


def _sets(width: int):
    """(id, s): the set of each class, from (id, digest, text); one doc_id may have other texts, which the digest tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(raw.as_py() or b"", width) for raw in b.column(2)]
            ok = pa.array([_digest(s) == d.as_py() for s, d in zip(found, b.column(1), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), pa.array([s.tobytes() for s in found], pa.binary()).filter(ok)], ["id", "s"])

    return run


def _class_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the sets of the classes named in ids(id)."""
    wanted = ids.join(classes.select("id", "least", "digest"), "id")
    texts = docs.select(F.col("doc_id").alias("least"), F.col("text").cast("binary").alias("text")).join(wanted, "least")
    return texts.select("id", "digest", "text").mapInArrow(_sets(width), "id long, s binary").groupBy("id").agg(F.min("s").alias("s"))


def _sure(docs: DataFrame, classes: DataFrame, edges: DataFrame, width: int, similarity: float) -> DataFrame:
    """The edges (a, b) between classes whose sets reach the similarity."""
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stage(_class_sets(docs, classes, ids, width), "shingle-sets")
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    sure = stage(pairs.select("a", "b", "sa", "sb").mapInArrow(_verified(similarity), "a long, b long"), "sure-edges")
    release(sets)
    return sure


def _sure_within(docs: DataFrame, classes: DataFrame, comps: DataFrame, stars: DataFrame, width: int, similarity: float, block_bytes: int) -> DataFrame:
    """A spanning forest of the links between classes of comps(id, comp, size, prefix) whose groups meet in long lists: stars(a, b) of groups.

    Groups that such lists join are a cluster. Its classes are cut into blocks by the bytes of their sets, and each pair of blocks is a task that
    verifies its pairs where they lie, so neither a pair nor more than two blocks leaves or enters a task.
    """
    roots = components(stars)
    cluster = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().withColumnsRenamed({"node": "comp", "root": "cluster"})
    cluster = stage(comps.groupBy("comp").agg(F.count("*").alias("n")).join(cluster, "comp"), "dense-groups")
    total = cluster.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = stage(meet(comps, cluster, "comp", total, F.xxhash64("id")), "dense-classes")
    sets = _class_sets(docs, classes, members.select("id"), width)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.ceil(F.sum("size") * 8 / block_bytes).cast("int").alias("blocks"))
    each = meet(members, sizes, "cluster", total, F.xxhash64("id")).join(sets, "id").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("cluster", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "b", "id", "comp", "size", "prefix", "s")
    return stage(each.groupBy("cluster", "lo", "hi").applyInArrow(_dense(similarity), "a long, b long"), "dense-edges")


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, group_id) for each row of docs(doc_id, text): group_id is the least doc_id of the row's group."""
    prints = stage(_prints(docs, width, similarity), "long-prints")
    same = [F.first(c).alias(c) for c in ("fp", "size", "prefix")]
    classes = stage(prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), *same).select(F.monotonically_increasing_id().alias("id"), "digest", "least", "rows", "fp", "size", "prefix"), "print-classes")
    dealt = classes.select("id", "fp").mapInArrow(_dealt, "t long, key long, id long, fp binary")
    edges = dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_close, "a long, b long")
    sure = _sure(docs, classes, stage(edges.distinct(), "near-edges"), width, similarity)
    roots = components(sure).withColumnRenamed("node", "id")
    comps = classes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("comp"), "size", "prefix")
    lists = comps.mapInArrow(_listed, "h int, id long, comp long, size long, at int")
    met = stage(lists.repartition("h").sortWithinPartitions("h").mapInArrow(_meeting(similarity), "a long, b long, least long").groupBy("a", "b", F.col("least").isNull().alias("dense")).agg(F.count("*").alias("n"), F.max("least").alias("least")).where("dense or n >= least"), "prefix-edges")
    found = [sure, _sure(docs, classes, met.where("not dense").select("a", "b"), width, similarity)]
    if not (stars := met.where("dense").select("a", "b")).isEmpty():
        found.append(_sure_within(docs, classes, comps, stars, width, similarity, block_bytes))
    roots = components(reduce(DataFrame.unionByName, found)).withColumnRenamed("node", "id")
    named = stage(classes.join(roots, "id", "left").select("digest", "least", "rows", F.coalesce("root", "id").alias("root")), "near-classes")
    total = named.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    names = named.groupBy("root").agg(F.min("least").alias("group_id"), F.count("*").alias("n"))
    named = meet(named, names, "root", total[0], F.xxhash64("digest")).select("digest", F.col("rows").alias("n"), "group_id")
    return meet(prints.select("doc_id", "digest"), stage(named, "near-names"), "digest", total[1], F.xxhash64("doc_id")).select("doc_id", "group_id")


def without_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose group holds a smaller doc_id; rows that repeat a kept doc_id and text go too.
    Rows with a null doc_id stay. Columns called `_gone`, `_twice` or `_text` are refused."""
    if clash := {"_gone", "_twice", "_text"} & set(docs.columns):
        raise ValueError(f"columns must not be called {sorted(clash)}")
    groups = stage(near_copies(docs.select("doc_id", "text"), width, similarity), "near-groups")
    marks = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("group_id")).alias("_gone"), (F.count("*") > 1).alias("_twice"))
    kept = docs.join(marks.where("doc_id is not null and (_gone or _twice)"), "doc_id", "left").where("_gone is null or not _gone")
    once = kept.where("_twice is null or not _twice")
    again = kept.where("_twice").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))
