r"""Personal data: pattern spans, and terms that the corpus shows to reveal a protected entity.

Base kinds (email, ip, card, phone) are found leftmost and without overlaps, then filtered; a match that fails is not retried. The
values found are the protected entities. The method adds spans of kind `term`: for each entity e and each word t within `reach`
words of a mention of e, co-occurrence over the corpus gives the disclosure p(e|t) = n(e,t)/n(t) and the pointwise mutual information
log2(n(e,t) N / (n(e) n(t))), in counts of distinct texts. A term that passes both thresholds for some entity, with `support` texts or more,
reveals it, and every occurrence in the corpus becomes a span; sanitised texts replace base spans by their kind and terms by `<TERM>`.

Only terms that can pass go on to the count over all texts: near-entity texts bound n(t) from below. They reach the tasks as a bitmap of
fixed size (2^24 bits), whose few false hits the following join removes, so nothing that is broadcast grows with the data.

A term in a third of all texts is counted with map-side combining and its places are dealt over parts of its hash.

Nulls: a null text counts as empty; a null doc_id stays null. Repeated rows get equal results and count as one text. Terms that tie are
all judged, each by itself. A very long text is scanned whole, in time linear in its length. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import meet, stage, table

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 5
SUPPORT = 3
DISCLOSURE = 0.5
INFORMATION = 4.0
BITS = 24

#: The base patterns (the first sign stands alone where a pattern begins with a run).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that begins no address begins none further on, and a match ends with a whole run: so only whole runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part (never into the match before), then forward over the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    found = [(0, *x) for x in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _near(text: str, spans: list[tuple[int, int, int]], reach: int) -> set[tuple[str, str]]:
    """(entity, term) pairs: terms among the nearest words on either side of a mention, outside all spans."""
    words = [(m.start(), m[0].lower()) for m in WORD.finditer(text)]
    begins = [w[0] for w in words]
    taken = set()
    for _, s, e in spans:
        taken.update(range(bisect.bisect_left(begins, s), bisect.bisect_left(begins, e)))
    out = set()
    for kind, s, e in spans:
        i, j = bisect.bisect_left(begins, s), bisect.bisect_left(begins, e)
        entity = f"{KINDS[kind]}:{text[s:e].lower()}"
        out.update((entity, words[k][1]) for k in (*range(max(0, i - reach), i), *range(j, min(len(words), j + reach))) if k not in taken)
    return out


def _pairs(docs: DataFrame, reach: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, int]] = []
            for value in b.column(0):
                text = value.as_py() or ""
                if spans := base_spans(text):
                    mark = xxhash.xxh64_intdigest(text, 42) - (1 << 63)
                    out += [(e, t, mark) for e, t in sorted(_near(text, spans, reach))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["entity", "term", "mark"])

    return docs.select("text").mapInArrow(run, "entity string, term string, mark long").distinct()


def _bitmap(terms: DataFrame) -> np.ndarray:
    """One bit for each of 2^BITS hash values: whether a term has it."""
    bit = F.xxhash64("term").bitwiseAND((1 << BITS) - 1) + 1
    rows = terms.select(bit.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    size = len(rows[0].bits) if rows else 0
    for r in rows:
        out[(r.k - 1) * size : r.k * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _hits(text: str, spans: list[tuple[int, int, int]], known: dict[str, bool]) -> list[dict]:
    """The known words of a text, and whether they are free of base spans."""
    found = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text) if known[m[0]]]
    begins = np.array(sorted(s for _, s, _ in spans), np.int64)
    ends = np.array(sorted(e for *_, e in spans), np.int64)
    # A word overlaps as many spans as begin before its end, less those that end before its start.
    over = np.searchsorted(begins, [e for *_, e in found], "left") - np.searchsorted(ends, [s for _, s, _ in found], "right")
    return [{"term": t, "start": s, "end": e, "free": not n} for (t, s, e), n in zip(found, over.tolist(), strict=True)]


SCANNED = "row long, doc_id long, text string, base array<struct<kind:int,start:long,end:long>>, hits array<struct<term:string,start:long,end:long,free:boolean>>, mark long"


def _scan(docs: DataFrame, bitmap: np.ndarray, keep_text: bool) -> DataFrame:
    """Base spans of each row, and the places of words whose bit is set."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    hit = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("free", pa.bool_())]))

    class Known(dict):
        def __missing__(self, word: str) -> bool:
            if len(self) > 300_000:
                self.clear()
            h = xxhash.xxh64_intdigest(word.lower(), 42) & ((1 << BITS) - 1)
            got = self[word] = bool(sent.value[h >> 3] >> (h & 7) & 1)
            return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            bases, hits, marks = [], [], []
            for value in b.column(2):
                text = value.as_py() or ""
                spans = base_spans(text)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                some = any(map(known.__getitem__, WORD.findall(text)))
                hits.append(_hits(text, spans, known) if some else [])
                marks.append(xxhash.xxh64_intdigest(text, 42) - (1 << 63))
            text = b.column(2) if keep_text else pa.nulls(len(bases), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array(bases, span), pa.array(hits, hit), pa.array(marks, pa.int64())], ["row", "doc_id", "text", "base", "hits", "mark"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, SCANNED)


def find_private(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, disclosure: float = DISCLOSURE, information: float = INFORMATION, keep_text: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, text (null unless keep_text), base and terms, arrays of (kind, start, end) in code points."""
    pairs = stage(_pairs(docs, reach), "pii-pairs")
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    near = pairs.select("term", "mark").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    can = stage(both.join(near, "term").where(F.col("n_both") >= disclosure * F.col("n_near")).select("entity", "term", "n_both"), "pii-terms")
    scanned = stage(_scan(docs, _bitmap(can), keep_text), "pii-scan")
    texts = scanned.select("mark").distinct().count()
    n_entity = pairs.select("entity", "mark").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    hits = scanned.select("row", "mark", F.explode("hits").alias("h"))
    n_term = hits.groupBy(F.col("h.term").alias("term"), "mark").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("n_term"), F.sum("n").alias("n"))
    told = can.join(n_term, "term").join(n_entity, "entity")
    bits = F.log2(F.col("n_both") * F.lit(float(texts)) / (F.col("n_entity") * F.col("n_term")))
    revealing = stage(told.where((F.col("n_both") >= disclosure * F.col("n_term")) & (bits >= information)).groupBy("term").agg(F.first("n").alias("n")), "pii-revealing")
    terms = hits.select("row", F.col("h.term").alias("term"), F.struct(F.lit(4).alias("kind"), F.col("h.start").alias("start"), F.col("h.end").alias("end")).alias("s"), F.col("h.free").alias("free"))
    terms = meet(terms, revealing, "term", revealing.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], F.xxhash64("row", "s.start"))
    terms = terms.where("free").groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("terms"))
    out = scanned.join(terms, "row", "left")
    free = F.coalesce("terms", F.array().cast("array<struct<kind:int,start:long,end:long>>"))
    return out.select("doc_id", "text", "base", free.alias("terms"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets; of overlapping spans the first, then longest, counts."""
    found = find_private(docs, keep_text=True, **options).select("doc_id", "text", F.concat("base", "terms").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, parts = 0, []
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        at = s["end"]
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(run, "doc_id long, text string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"))
