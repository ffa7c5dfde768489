"""Benchmark decontamination through suffix arrays over the training words.

Each task cuts its documents into shards of `shard_words` words and gives each shard a suffix array, built by prefix
doubling; a suffix ends at the first word that no item has, and suffixes too short for any window stay out. Every suffix of the benchmark that begins with
a window is searched in it: a binary search for the window gives the places of all its occurrences, and narrowing that range word by word
gives the suffix's longest verbatim match and where it lies. Documents with an occurrence of a window are the affected ones. The benchmark is
read in blocks of `block_items` items and `block_words` words, so what a task holds (and what is broadcast) is bounded whatever the
benchmark's size, and every block meets every shard.

Words: A-Z lowered, runs of bytes that are neither ASCII punctuation, controls nor white space. An item of fewer words than a
window is one window; an item without words (null, empty) has none and matches nothing.
Nulls: a null text has no words and is never contaminated; null doc_ids stay null, null item_ids are ignored. Repeated documents
are judged alike; repeated items each count unless they share their id. A very long text is a shard of its own; a very long item is searched in
overlapping pieces. Empty tables give no rows, or no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import bound, running, stage, table

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 4_000_000

#: Upper case ASCII becomes lower case, other ASCII except digits and lower case becomes a space.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


class Queries:
    """One block of benchmark items, each a list of words: the vocabulary, the distinct windows in groups of one length with the suffixes that
    begin with each, and the words themselves.

    Suffixes are places in `text`, where items stand one after the other; `item` and `end` tell a place's item and where that ends.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t], np.int64) for _, t in items]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text = np.concatenate([*texts, np.empty(0, np.int64)])
        self.begin = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(items)), sizes)
        self.item, self.end = np.array([i for i, _ in items], np.int64), self.begin + sizes
        self.longest = int(sizes.max(initial=0))
        found: dict[int, dict[bytes, list[int]]] = {}
        for ids, first in zip(texts, self.begin.tolist(), strict=True):
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(ids[k : k + n].tobytes(), []).append(first + k)
        self.groups = []
        for n, by in sorted(found.items()):
            suffixes = list(by.values())
            owners = [sorted({int(self.item[self.of[s]]) for s in x}) for x in suffixes]
            self.groups.append((n, np.frombuffer(b"".join(by), np.int64).reshape(-1, n), *_flat(owners), *_flat(suffixes)))
        self.shortest = min(found, default=0)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, values) of lists one after the other."""
    size = np.array([len(x) for x in lists], np.int64)
    return np.cumsum(size) - size, size, np.array([i for x in lists for i in x], np.int64)


def _picked(first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all values of the lists `which`, and for each the place in which of its list."""
    n = size[which]
    return np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(np.arange(len(which)), n)


def suffix_array(ids: np.ndarray, run: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` of ids in order of the suffixes there, as far as their first `depth` words tell; prefix doubling.

    A suffix ends at the first 0; run: how many words it has.
    """
    live = np.flatnonzero(ids)
    rank = np.zeros(len(ids) + 1, np.int64)
    values, inverse = np.unique(ids[live], return_inverse=True)
    rank[live] = inverse + 1
    k, classes = 1, len(values)
    while k < depth:
        second = np.where(run[live] > k, rank[np.minimum(live + k, len(ids))], 0)
        values, inverse = np.unique(rank[live] * (classes + 1) + second, return_inverse=True)
        if len(values) == classes:
            break
        rank[live] = inverse + 1
        k, classes = 2 * k, len(values)
    return at[np.argsort(rank[at], kind="stable")]


def _compare(ids: np.ndarray, starts: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Sign of (words from starts) - (query), on as many words as the queries have."""
    sign = np.zeros(len(starts), np.int8)
    for k in range(queries.shape[1]):
        undecided = sign == 0
        sign[undecided] = np.sign(ids[starts[undecided] + k] - queries[undecided, k])
    return sign


def search(ids: np.ndarray, array: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array whose suffixes begin with each query."""
    ends = []
    for least in (0, 1):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(array))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            below = np.zeros(len(queries), bool)
            below[open_] = _compare(ids, array[mid[open_]], queries[open_]) < least
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


def longest(ids: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, q: Queries, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, first place of the range) of the longest match of each suffix of q, from the ranges where its first `depth` words occur: the range
    is narrowed by one word after the other."""
    lo, hi, depth, active = lo.copy(), hi.copy(), depth.copy(), np.arange(len(suffix))
    end = q.end[q.of[suffix]]
    while len(active := active[suffix[active] + depth[active] < end[active]]):
        d, want = depth[active], q.text[suffix[active] + depth[active]]
        bounds = []
        for least in (0, 1):
            a, b = lo[active], hi[active]
            while (open_ := a < b).any():
                mid = (a + b) // 2
                below = np.zeros(len(a), bool)
                below[open_] = ids[array[mid[open_]] + d[open_]] - want[open_] < least
                a, b = np.where(open_ & below, mid + 1, a), np.where(open_ & ~below, mid, b)
            bounds.append(a)
        ok = bounds[1] > bounds[0]
        active = active[ok]
        lo[active], hi[active] = bounds[0][ok], bounds[1][ok]
        depth[active] += 1
    return depth, array[lo]


def _judge(texts: list[list[int]], q: Queries, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a shard: hit words of each document; (document number, item_id) columns; (document number, start, length) of runs; for each item
    found its longest match: (document number, item_id, start in the item, start in the document, length)."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int(sizes.sum()) + len(texts) + window + 1, np.int64)
    for s, t in zip(begin, texts, strict=True):
        ids[s : s + len(t)] = t
    cover, pairs, matches = np.zeros(len(ids) + 1, np.int64), [], []
    stop = np.flatnonzero(ids == 0)
    run = np.r_[stop, len(ids)][np.searchsorted(stop, np.arange(len(ids)))] - np.arange(len(ids))
    at = np.flatnonzero(run >= q.shortest) if q.shortest else np.empty(0, np.int64)
    if len(at):
        # Words of runs too short for any window stay out.
        left = np.arange(len(ids)) - np.r_[-1, stop][np.searchsorted(stop, np.arange(len(ids)))] - 1
        array = suffix_array(np.where(left + run >= q.shortest, ids, 0), run, at, q.longest)
        for n, queries, o_first, o_size, owners, s_first, s_size, suffixes in q.groups:
            lo, hi = search(ids, array, queries)
            hits = hi - lo
            which = np.repeat(np.arange(len(queries)), hits)
            place = array[np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(int(hits.sum()))]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + n, -1)
            doc = np.searchsorted(begin, place, "right") - 1
            key = np.unique(doc * len(queries) + which)
            doc, which = key // len(queries), key % len(queries)
            own, of = _picked(o_first, o_size, which)
            pairs.append(np.stack([doc[of], owners[own]]))
            which = np.flatnonzero(hits)
            own, of = _picked(s_first, s_size, which)
            size, place = longest(ids, array, lo[which][of], hi[which][of], np.full(len(own), n), q, suffixes[own])
            matches.append(np.stack([place, suffixes[own], size]))
    hit = np.cumsum(cover)[: len(ids)] > 0
    total = np.r_[0, np.cumsum(hit)]
    n_hit = total[begin + sizes] - total[begin]
    edges = np.diff(np.r_[0, hit.astype(np.int8), 0])
    spans = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)])
    owner = np.searchsorted(begin, spans[0], "right") - 1
    found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
    place, suffix, size = np.concatenate(matches, axis=1) if matches else np.empty((3, 0), np.int64)
    item = q.item[q.of[suffix]]
    order = np.lexsort((place, -size, item))
    order = order[np.r_[True, item[order][1:] != item[order][:-1]]] if len(order) else order
    place, suffix, size, item = (x[order] for x in (place, suffix, size, item))
    doc = np.searchsorted(begin, place, "right") - 1
    return n_hit, found, np.stack([owner, spans[0] - begin[owner], spans[1] - spans[0]]), np.stack([doc, item, suffix - q.begin[q.of[suffix]], place - begin[doc], size])


def _blocks(benchmark: DataFrame, size: int, most: int, window: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of at most `size` items and `most` words; a longer item goes in pieces that overlap by a window less a word."""
    block, held = [], 0
    for r in benchmark.where("item_id is not null").select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t")).toLocalIterator():
        text = words(bytes(r.t))
        for at in range(0, max(1, len(text) - window + 1), most):
            piece = text[at : at + most + window - 1]
            if block and (len(block) == size or held + len(piece) > most + window - 1):
                yield block
                block, held = [], 0
            block.append((r.item_id, piece))
            held += len(piece)
    if block:
        yield block


SPAN = "array<struct<start:long,length:long>>"
LONGEST = "array<struct<item_id:long,item_start:long,start:long,length:long>>"
MATCHES = f"row long, doc_id long, n_words long, n_hit long, items array<long>, spans {SPAN}, longest {LONGEST}"


def _matches(docs: DataFrame, items: list[tuple[int, list[bytes]]], window: int, shard_words: int) -> DataFrame:
    q = docs.sparkSession.sparkContext.broadcast(Queries(items, window))
    struct = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", struct("start", "length")), ("longest", struct("item_id", "item_start", "start", "length"))])

    def flush(rows: list, texts: list, q: Queries) -> pa.RecordBatch:
        n_hit, pairs, spans, matches = _judge(texts, q, window)
        items: list[list[int]] = [[] for _ in texts]
        for d, i in pairs.T.tolist():
            items[d].append(i)
        where: list[list[dict]] = [[] for _ in texts]
        for d, s, n in spans.T.tolist():
            where[d].append({"start": s, "length": n})
        best: list[list[dict]] = [[] for _ in texts]
        for d, *v in matches.T.tolist():
            best[d].append(dict(zip(("item_id", "item_start", "start", "length"), v, strict=True)))
        columns = [[r[0] for r in rows], [r[1] for r in rows], [len(t) for t in texts], n_hit, items, where, best]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, texts, held = q.value, [], [], 0
        number = block.vocabulary
        for b in batches:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                got = words(text.as_py() or b"")
                rows.append((row, doc_id))
                texts.append([number.get(w, 0) for w in got])
                held += len(got)
                if held >= shard_words:
                    yield flush(rows, texts, block)
                    rows, texts, held = [], [], 0
        if rows:
            yield flush(rows, texts, block)

    return docs.select("row", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, MATCHES)


def _joined_runs(spans: Column) -> Column:
    """The overlapping or touching ones of sorted spans joined to maximal runs."""

    def opened(v: Column) -> Column:
        before = F.concat(F.array(F.lit(-1).cast("long")), F.slice(v["reach"], F.lit(1), F.size(v["reach"]) - 1))
        opens = F.transform(F.zip_with(v["spans"], before, lambda s, end: s["start"] > end), lambda new, i: F.when(new, i))
        return F.struct(v["spans"].alias("spans"), v["reach"].alias("reach"), F.filter(opens, lambda i: i.isNotNull()).alias("opens"))

    def joined(v: Column) -> Column:
        end = lambda j: F.get(v["reach"], F.coalesce(F.get(v["opens"], j + 1), F.size(v["spans"])) - 1)
        start = lambda i: F.get(v["spans"], i)["start"]
        return F.transform(v["opens"], lambda i, j: F.struct(start(i).alias("start"), (end(j) - start(i)).alias("length")))

    reach = running(F.transform(spans, lambda s: s["start"] + s["length"]), F.greatest)
    found = bound(bound(F.struct(spans.alias("spans"), reach.alias("reach")), opened), joined)
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast(SPAN))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, n_hit, items (ids of items with occurring windows, sorted), spans
    (word positions of the maximal runs of hit words), longest (of the items whose longest match within its shard lies here: item_id,
    item_start, start, length, in words)."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    blocks = _blocks(benchmark, block_items, block_words, window)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _matches(docs, first, window, shard_words).drop("row")
    # Rows are numbered once, as each block reads them again.
    docs = stage(docs, "benchmark-docs")
    together = reduce(DataFrame.unionByName, (_matches(docs, items, window, shard_words) for items in chain([first, second], blocks)))
    flat = lambda c: F.flatten(F.collect_list(c))
    together = together.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), F.array_sort(flat("spans")).alias("spans"), flat("longest").alias("longest"))
    together = together.withColumn("spans", _joined_runs(F.col("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return together.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", "longest")


def longest_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(item_id, item_start, doc_id, start, length): the longest verbatim match of each item that has one of a window or more, in words;
    of equal ones the least doc_id, then the earliest. An item in pieces has its matches cut at their ends."""
    each = benchmark_matches(docs, benchmark, **options).select("doc_id", F.explode("longest").alias("m"))
    best = F.struct(F.col("m.length").alias("length"), (-F.col("doc_id")).alias("d"), (-F.col("m.start")).alias("s"))
    found = each.groupBy("m.item_id").agg(F.max_by(F.struct("doc_id", "m"), best).alias("b"))
    return found.select("item_id", "b.m.item_start", "b.doc_id", "b.m.start", "b.m.length")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that no benchmark window occurs in; rows of one doc_id go together; rows with a null doc_id stay."""
    hit = benchmark_matches(docs, benchmark, **options).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws, least({WINDOW}, len({_WORDS})) AS n FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[k + 1:k + n], ' ') AS w FROM (SELECT *, unnest(range(len(ws) - n + 1)) AS k FROM items WHERE n > 0)),
places AS (SELECT doc_id, n, p, array_to_string(ws[p + 1:p + n], ' ') AS w FROM (SELECT d.*, s.n, unnest(range(len(ws) - s.n + 1)) AS p FROM docs d, (SELECT DISTINCT n FROM windows) s WHERE len(ws) >= s.n)),
hits AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
