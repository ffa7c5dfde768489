"""Removal of every byte that a repeated string of 100 bytes covers, by suffix arrays over shards of text.

Two equal strings of `length` bytes have the same least hash among their `GRAM`-byte substrings, at the same place; that substring is
their anchor. All starts that share an anchor form a segment of text. Strings can only be equal where anchors are, so:

1. each unit (some MB of consecutive documents) sends the hashes of its anchors, once each, to buckets; buckets return those that
   several units hold;
2. each unit sends the segments at returned (or locally repeated) anchors to the anchors' buckets, equal segments once;
3. a bucket is a shard: of equal segments the first stays and the others are covered whole; the text of the groups that hold different
   segments gets a suffix array by induced sorting, permuted common prefixes join suffixes into classes that share `length` bytes, and
   all but the first start of a class are covered;
4. units read their documents again and take the covered bytes out.

Copies of whole documents (equal SHA-256) are settled beforehand by one small row each. Hashes only deal segments out; bytes are
compared in the shards. A hot passage reaches a bucket at most once a unit and context. Units travel compressed; they are cut once and staged, so a
task that is run again sees the same ones. The numbers of buckets and of tasks grow with the input, so what a shard holds does not.

Order: "earlier" is a smaller doc_id (null first), rows of one doc_id in order of reading; then the start.
Nulls: a null text counts as empty. Repeated rows are documents of their own (the first stays). Texts under `length` bytes are kept whole. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.sais import permuted_reach, suffix_array
from waymark.llm.shared import meet, release, stage, table

LENGTH = 100
GRAM = 40
UNIT_BYTES = 4 << 20
HASHED_AT_ONCE = 1 << 20
PLACE_BITS = np.uint64(21)
BUCKETS_A_PARTITION = 4
#: Text a bucket stands for at most, and a task: larger inputs have more buckets and more tasks.
BUCKET_BYTES = 4 << 20
TASK_BYTES = 64 << 20
LEVEL = 3

_FACTOR = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int) -> np.ndarray:
    if base not in _powers:
        _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(HASHED_AT_ONCE + 4096, base, np.uint64)])
    return _powers[base]


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of each GRAM-byte substring."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_FACTOR)[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _power(pow(_FACTOR, -1, 1 << 64))[: n - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts) of each segment; the segments part the starts of length-byte strings."""
    text, wide = np.frombuffer(raw, np.uint8), length - GRAM + 1
    hashes, starts = [], []
    for at in range(0, max(0, len(text) - length + 1), HASHED_AT_ONCE):
        full = _gram_hashes(text[at : at + HASHED_AT_ONCE + length - 1])
        # The low bits hold the place: of equal hashes the leftmost is the anchor, and each anchor has its own segment.
        least = (full >> PLACE_BITS << PLACE_BITS) | np.arange(len(full), dtype=np.uint64)
        n, span = len(least) - wide + 1, 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[wide - span : wide - span + n])
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        hashes.append(full[(least[new] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)])
        starts.append(new + at)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(starts)
    return np.concatenate(hashes), first, np.diff(np.r_[first, len(text) - length + 1])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(unit, doc_ids, texts) of consecutive documents."""
    unit, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_py() or b""
            ids.append(doc_id)
            texts.append(raw)
            held += len(raw)
            if held >= UNIT_BYTES:
                yield unit, ids, texts
                unit, ids, texts, held = unit + 1, [], [], 0
    if ids:
        yield unit, ids, texts


def _batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


UNIT = pa.schema([("unit", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary())])
UNIT_DDL = "unit long, doc int, doc_id long, sha string, bucket int, blob binary"


def _scan(buckets: int, length: int):
    """For each unit: a row with its compressed documents' hashes by bucket, and a row for each document's identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, docs in (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            ids, texts = _unpacked(docs)
            found = np.unique(np.concatenate([anchors(t, length)[0] for t in texts]))
            by = (found % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(by, kind="stable")
            # Borders of equal buckets: work and memory follow the unit's hashes, not the number of buckets.
            full, cuts = np.unique(by[order], return_index=True)
            n, m = len(ids), len(full)
            blobs = [own.tobytes() for own in np.split(found[order], cuts[1:])] if m else []
            yield _batch(UNIT, [[unit] * (n + m), [*range(n), *[None] * m], [*ids, *[None] * m], [*[hashlib.sha256(t).hexdigest() for t in texts], *[None] * m], [*[None] * n, *full.tolist()], [*[None] * n, *blobs]])

    return run


BACK = pa.schema([("unit", pa.int64()), ("blob", pa.binary()), ("copy", pa.int32())])
BACK_DDL = "unit long, blob binary, copy int"


def _shared_hashes(rows: pa.Table) -> pa.Table:
    """Of a bucket's hashes, those of several units, back to each unit that holds them."""
    units, blobs = rows.column("unit").to_pylist(), [np.frombuffer(b, np.uint64) for b in rows.column("blob").to_pylist()]
    found, count = np.unique(np.concatenate(blobs), return_counts=True)
    shared = found[count > 1]
    back = [(u, b[np.isin(b, shared, assume_unique=True)]) for u, b in zip(units, blobs, strict=True)]
    back = [(u, b) for u, b in back if len(b)]
    return pa.Table.from_batches([_batch(BACK, [[u for u, _ in back], [b.tobytes() for _, b in back], [None] * len(back)])])


PACKED_DDL = "unit long, docs binary, size long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each unit's documents in one compressed value."""
    for unit, ids, texts in _units(batches):
        sizes = np.array([len(t) for t in texts], np.int64)
        known = np.array([i is not None for i in ids], np.int64)
        head = np.concatenate([[len(ids)], known, [i or 0 for i in ids], sizes]).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([zstandard.compress(head + b"".join(texts), LEVEL)], pa.binary()), pa.array([int(sizes.sum())], pa.int64())], ["unit", "docs", "size"])


def _unpacked(packed: bytes) -> tuple[list, list[bytes]]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    known, ids, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    ends = np.cumsum(sizes) + 8 * (3 * n + 1)
    return [i if k else None for k, i in zip(known.tolist(), ids.tolist(), strict=True)], [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


#: What a segment brings to its shard: anchor's hash, doc_id (null: the least), unit, document, start, number of starts.
HEAD = np.dtype([("hash", "<u8"), ("doc_id", "<i8"), ("unit", "<i8"), ("doc", "<i4"), ("start", "<i8"), ("n", "<i4")])
SENT = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("blob", pa.binary())])
SENT_DDL = "bucket int, unit long, blob binary"


def _segments(buckets: int, length: int):
    def run(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        """Segments to send (bucket not null), and starts covered within the unit (bucket null)."""
        unit = key[0].as_py()
        sent: dict[int, list] = {}
        covered = []
        for packed in docs.column("docs").to_pylist():
            ids, texts = _unpacked(packed)
            copies = {c for c in back.column("copy").to_pylist() if c is not None}
            shared = np.unique(np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(b, np.uint64) for b in back.column("blob").to_pylist() if b is not None]]))
            order = sorted((d for d in range(len(ids)) if d not in copies), key=lambda d: (ids[d] is not None, ids[d] or 0, d))
            found = {d: anchors(texts[d], length) for d in order}
            every, count = np.unique(np.concatenate([np.empty(0, np.uint64), *[f[0] for f in found.values()]]), return_counts=True)
            wanted = np.union1d(shared, every[count > 1])
            wanted = wanted if len(wanted) else np.zeros(1, np.uint64)
            seen: set[bytes] = set()
            for d in order:
                h, first, n = found[d]
                for k in np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h).tolist():
                    s, m = int(first[k]), int(n[k])
                    segment = texts[d][s : s + m + length - 1]
                    if segment in seen:
                        covered.append((d, s, m))
                        continue
                    seen.add(segment)
                    sent.setdefault(int(h[k]) % buckets, []).append(((int(h[k]), np.iinfo(np.int64).min if ids[d] is None else ids[d], unit, d, s, m), segment))
        rows = [(b, unit, zstandard.compress(len(x).to_bytes(8, "little") + np.array([y[0] for y in x], HEAD).tobytes() + b"".join(y[1] for y in x), LEVEL)) for b, x in sent.items()]
        rows.append((None, unit, np.array(covered, np.int64).tobytes()))
        return pa.Table.from_batches([_batch(SENT, [list(c) for c in zip(*rows, strict=True)])])

    return run


COVERED = pa.schema([("unit", pa.int64()), ("blob", pa.binary())])
COVERED_DDL = "unit long, blob binary"


def _covered(length: int):
    def run(rows: pa.Table) -> pa.Table:
        """Covered starts of a shard by unit: (document, start, number) triples."""
        heads, bodies = [], []
        for blob in rows.column("blob").to_pylist():
            raw = zstandard.decompress(blob)
            n = int.from_bytes(raw[:8], "little")
            head = np.frombuffer(raw, HEAD, n, 8)
            ends = np.cumsum(head["n"].astype(np.int64) + length - 1) + 8 + n * HEAD.itemsize
            heads.append(head)
            bodies += [raw[e - k - length + 1 : e] for e, k in zip(ends.tolist(), head["n"].tolist(), strict=True)]
        head = np.concatenate(heads)
        order = np.lexsort((head["start"], head["doc"], head["unit"], head["doc_id"]))
        first: dict[bytes, int] = {}
        groups: dict[int, int] = {}
        hit = []
        for k in order.tolist():
            if first.setdefault(bodies[k], k) != k:
                hit.append((int(head["unit"][k]), int(head["doc"][k]), int(head["start"][k]), int(head["n"][k])))
            else:
                groups[h] = groups.get(h := int(head["hash"][k]), 0) + 1
        mixed = [k for k in first.values() if groups[int(head["hash"][k])] > 1]
        if mixed:
            hit += _shard(head[mixed], [bodies[k] for k in mixed], length)
        by: dict[int, list] = {}
        for u, *triple in hit:
            by.setdefault(u, []).append(triple)
        return pa.Table.from_batches([_batch(COVERED, [list(by), [np.array(x, np.int64).tobytes() for x in by.values()]])])

    return run


def _shard(head: np.ndarray, segments: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """Covered starts among different segments, given in order: all but the first start of each class."""
    size = np.array([len(s) for s in segments])
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(segments), np.uint8)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8) + np.uint8(1)  # UTF-8 never holds 255
    array = suffix_array(text)
    reach = permuted_reach(text, array, length)
    owner = np.repeat(np.arange(len(segments)), size + 1)
    start = np.arange(len(text)) - begin[owner]
    whole = start + length <= size[owner]
    classes = np.cumsum(~reach[array])
    ok = whole[array]
    at, classes = array[ok], classes[ok]
    begins = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    least = np.repeat(np.minimum.reduceat(owner[at], begins), np.diff(np.r_[begins, len(at)]))
    gone = np.zeros(len(text) + 1, np.int8)
    gone[at[owner[at] > least]] = 1
    edge = np.diff(np.r_[np.int8(0), gone])
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(head["unit"][o]), int(head["doc"][o]), int(head["start"][o] + start[a]), int(b - a)) for a, b, o in zip(lo.tolist(), hi.tolist(), owner[lo].tolist(), strict=True)]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string, kept binary"


def _finished(length: int, keep_text: bool):
    def run(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        copies = {c for c in hits.column("copy").to_pylist() if c is not None}
        triples = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(b, np.int64) for b in hits.column("blob").to_pylist() if b is not None]]).reshape(-1, 3)
        triples = triples[np.lexsort((triples[:, 1], triples[:, 0]))]
        out: list[list] = [[] for _ in RESULT]
        for packed in docs.column("docs").to_pylist():
            ids, texts = _unpacked(packed)
            cuts = np.searchsorted(triples[:, 0], np.arange(len(ids) + 1))
            for d, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                spans: list[list[int]] = []
                if d in copies:
                    spans = [[0, len(text)]] if len(text) >= length else []
                for _, s, n in triples[cuts[d] : cuts[d + 1]].tolist():
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s + n - 1 + length)
                    else:
                        spans.append([s, s + n - 1 + length])
                kept = text
                if spans:
                    kept = b"".join(text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)], strict=True))
                for column, v in zip(out, (doc_id, len(text), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    column.append(v)
        return pa.Table.from_batches([_batch(RESULT, out)])

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, removed (spans of bytes), kept_sha256, kept (bytes; null unless keep_text)."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    # Units are cut once and staged: every later pass reads the same ones.
    packed = stage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_packed, PACKED_DDL), "units")
    size = packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks * BUCKETS_A_PARTITION, size // BUCKET_BYTES)
    dealt = lambda df, key: df.repartition(n, key) if (n := size // TASK_BYTES) > tasks else df
    packed = packed.select("unit", "docs")
    scanned = stage(packed.mapInArrow(_scan(buckets, length), UNIT_DDL), "anchors")
    place = F.struct("doc_id", "unit", "doc")
    names = scanned.where("sha is not null").select("sha", "doc_id", "unit", "doc")
    first = stage(names.groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    copies = meet(names, first, "sha", first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], F.xxhash64("unit", "doc")).where(place != F.col("first"))
    copies = stage(copies.select("unit", F.lit(None).cast("binary").alias("blob"), F.col("doc").alias("copy")), "copies")
    shared = dealt(scanned.where("bucket is not null").select("bucket", "unit", "blob"), "bucket").groupBy("bucket").applyInArrow(_shared_hashes, BACK_DDL)
    sent = dealt(packed, "unit").groupBy("unit").cogroup(dealt(shared.unionByName(copies), "unit").groupBy("unit")).applyInArrow(_segments(buckets, length), SENT_DDL)
    sent = stage(sent, "segments")
    release(scanned)
    covered = dealt(sent.where("bucket is not null"), "bucket").groupBy("bucket").applyInArrow(_covered(length), COVERED_DDL)
    covered = covered.unionByName(sent.where("bucket is null").select("unit", "blob")).withColumn("copy", F.lit(None).cast("int"))
    return dealt(packed, "unit").groupBy("unit").cogroup(dealt(covered.unionByName(copies), "unit").groupBy("unit")).applyInArrow(_finished(length, keep_text), RESULT_DDL)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
