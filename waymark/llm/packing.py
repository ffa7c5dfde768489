"""Packing of tokenized documents into training sequences: bounded-space online packing.

Each input partition keeps `open_windows` windows. A document is cut into full windows and a rest; the rest goes
into the open window where it fits best. When none fits, the fullest window is topped up with
the first ids of the rest and emitted, and the remaining ids go on as before, so emitted windows have no padding. What
stays open at the end of a partition is merged in a second pass: the partitions are grouped by `merge_group`, each
group packs its leftovers again, and its last ids are cut into sequences whose lengths are powers of two, which need no padding.
No window, list of windows or id sequence of more than one document passes through the driver.

Nulls: a null text counts as empty; an empty text is one piece holding only the end id. A null doc_id stays null. Repeated
rows are packed once each. A very long text is encoded whole and cut into windows as it comes. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.shared import stage, table

LENGTH = 2048
OPEN_WINDOWS = 8
MERGE_GROUP = 64
END_ID = 1
GROUP_SHIFT = 32

PIECES = T.StructType([T.StructField(name, T.LongType()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
OPEN = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType())])


class ByteBpe:
    """Ids of the byte-level vocabulary as its JSON file defines them.

    The rank file beside it holds the same vocabulary and merges and is encoded several times faster; the JSON's own
    tokenizer encodes texts that hold a string it treats as special.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_tokenizer: dict[str, ByteBpe] = {}


def byte_bpe(name: str) -> ByteBpe:
    """One tokenizer a worker."""
    if name not in _tokenizer:
        _tokenizer[name] = ByteBpe(name)
    return _tokenizer[name]


class Packer:
    """Open windows; a window is a list of (doc_id, start, ids, doc_tokens). Emitted windows collect in `full`."""

    def __init__(self, length: int, windows: int):
        self.length, self.most = length, windows
        self.open: list[list] = []
        self.free: list[int] = []
        self.full: list[list] = []

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        at = 0
        while len(ids) - at >= self.length:
            self.full.append([(doc_id, start + at, ids[at : at + self.length], total)])
            at += self.length
        if at == len(ids):
            return
        rest = len(ids) - at
        fits = [(f, k) for k, f in enumerate(self.free) if f >= rest]
        if not fits and len(self.open) < self.most:
            self.open.append([])
            self.free.append(self.length)
            fits = [(self.length, len(self.open) - 1)]
        if fits:
            k = min(fits)[1]
        else:
            k = min(range(len(self.free)), key=self.free.__getitem__)
            cut = at + self.free[k]
            self.open[k].append((doc_id, start + at, ids[at:cut], total))
            self._emit(k)
            self.add(doc_id, start + cut, ids[cut:], total)
            return
        self.open[k].append((doc_id, start + at, ids[at:], total))
        self.free[k] -= rest
        if not self.free[k]:
            self._emit(k)

    def _emit(self, k: int) -> None:
        self.full.append(self.open.pop(k))
        self.free.pop(k)

    def finish(self) -> list[list]:
        """Windows for the ids still open: whole ones first, then one for each power of two of the rest."""
        pieces = sorted((p for w in self.open for p in w), key=lambda p: -len(p[2]))
        total, self.open, self.free = sum(len(p[2]) for p in pieces), [], []
        sizes = [self.length] * (total // self.length) + [1 << b for b in range(self.length.bit_length() - 1, -1, -1) if (total % self.length) >> b & 1]
        out, window, room, left = [], [], 0, iter(sizes)
        for doc_id, start, ids, n in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room, window = next(left), []
                    out.append(window)
                got = ids[at : at + room]
                window.append((doc_id, start + at, got, n))
                at, room = at + len(got), room - len(got)
        return out


def _rows(windows: list[list], first_id: int | None, part: int, keep_ids: bool) -> dict[str, list]:
    out: dict[str, list] = {f.name: [] for f in OPEN.fields}
    for k, window in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in window:
            raw = np.ascontiguousarray(ids).tobytes()
            for name, v in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), total, None if first_id is None else first_id + k, offset, raw if keep_ids else None, part), strict=True):
                out[name].append(v)
            offset += len(ids)
    return out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", length: int = LENGTH, open_windows: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of `length` ids at most; one row a piece, columns as PIECES."""
    schema = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in OPEN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, packer, n = TaskContext.get().partitionId(), byte_bpe(tokenizer), Packer(length, open_windows), 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                packer.add(doc_id, 0, ids, len(ids))
                if len(packer.full) >= 512:
                    yield pa.RecordBatch.from_pydict(_rows(packer.full, (part << GROUP_SHIFT) + n, part, False), schema)
                    n, packer.full = n + len(packer.full), []
        yield pa.RecordBatch.from_pydict(_rows(packer.full, (part << GROUP_SHIFT) + n, part, False), schema)
        yield pa.RecordBatch.from_pydict(_rows(packer.open, None, part, True), schema)

    pieces = pa.schema([(n, pa.int64()) for n in PIECES.names])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        packer, group = Packer(length, open_windows), key[0].as_py()
        for r in rows.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist():
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        made = _rows(packer.full + packer.finish(), -((group + 1) << GROUP_SHIFT), group, False)
        return pa.Table.from_pydict({n: made[n] for n in PIECES.names}, pieces)

    packed = stage(docs.select("doc_id", "text").mapInArrow(run, OPEN), "packed")
    left = packed.where("ids is not null").groupBy((F.col("part") / merge_group).cast("long").alias("g")).applyInArrow(merge, PIECES)
    return packed.where("ids is null").select(PIECES.names).unionByName(left)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
