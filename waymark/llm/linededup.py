"""Line dedup by content-defined chunks of lines.

A text is cut at line feeds. Each line has a hash, and a rolling hash goes over the hashes of `WINDOW` lines. A chunk ends at a line whose rolling
hash is less than those of both neighbours, so boundaries depend on the lines around them alone and come back in step after an
insertion, and a chunk has two lines at least (the first and the last two lines of a text end no chunk but the last). Chunks of `least_lines`
lines or more that occur again anywhere (in order of doc_id, then place) are removed; the first occurrence stays. Hashes only find
candidates: a chunk counts as repeated if its bytes equal those of the first. Everything is DataFrame functions.

What stays: a repeated passage loses the chunks that lie within it whole. The lines before its first and after its last inner boundary share a
chunk with their surroundings and stay, about two lines at either end; a document that is a whole copy loses all its lines.

A hot chunk (in a third of all texts, say) is counted with map-side combining, and its rows are dealt over as many parts of its hash as
its count asks for, so no task holds more than a fixed share of them. Texts move twice: as chunks that meet their likes, and whole to meet
their removed chunks.

Nulls: a null text counts as empty for the decision and stays null; a null doc_id comes before all others. Rows that repeat both doc_id
and text are one document and get one result each; of rows with one doc_id but different texts the lesser text hash comes first. Chunks of
white space only are never removed. A very long text is one row whose lines stay one array; a long run of equal lines is one chunk. An empty
table gives no rows; further columns are kept by `remove_repeats` unless they begin with `_` (ValueError).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import copies, deal, hot_keys, hot_limit, stage, table

WINDOW = 2
FACTOR = 31
LEAST_LINES = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _shifted(values: Column, by: int) -> Column:
    """values moved `by` places to the right (to the left where it is negative); zeros come in, the size stays."""
    n = F.size(values)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.least(F.lit(abs(by)), n))
    if by < 0:
        return F.concat(F.slice(values, F.lit(1 - by), F.greatest(n + by, F.lit(0))), zeros)
    return F.concat(zeros, F.slice(values, F.lit(1), F.greatest(n - by, F.lit(0))))


def _cut(docs: DataFrame) -> DataFrame:
    """docs with `_doc` (what names the document), `_lines` and `_ends` (index of the last line of each chunk)."""
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    hashes = F.transform("_lines", lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long"))
    marked = docs.withColumn("_doc", key).withColumn("_lines", _lines(F.col("text"))).withColumn("_hashes", hashes)
    add = lambda factor: lambda now, before: now + before * factor
    rolled = reduce(lambda acc, j: F.zip_with(acc, _shifted(F.col("_hashes"), j), add(FACTOR**j)), range(1, WINDOW), F.col("_hashes"))
    marked = marked.withColumn("_rolled", rolled)
    three = F.arrays_zip(_shifted(F.col("_rolled"), 1).alias("before"), F.col("_rolled").alias("now"), _shifted(F.col("_rolled"), -1).alias("after"))
    least = lambda p, i: (i >= 1) & (i <= F.size("_lines") - 3) & (p["now"] < p["before"]) & (p["now"] < p["after"])
    flags = F.transform(three, lambda p, i: F.when(least(p, i), i).otherwise(F.lit(-1)))
    ends = F.array_union(F.filter(flags, lambda i: i >= 0), F.array(F.size("_lines") - 1))
    return marked.withColumn("_ends", ends).drop("_hashes", "_rolled")


def _chunks(cut: DataFrame, least_lines: int) -> DataFrame:
    """(_doc, k, n, chunk, hash) for each chunk that may be removed."""
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("_ends", F.lit(1), F.size("_ends") - 1), lambda e: e + 1))
    each = cut.select("_doc", "_lines", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("_ends").alias("e"))).alias("k", "c"))
    n = F.col("c.e") - F.col("c.s") + 1
    each = each.where(n >= least_lines).select("_doc", "k", F.array_join(F.slice("_lines", F.col("c.s") + 1, n), "\n").alias("chunk"))
    return each.where(F.trim("chunk") != "").withColumn("hash", F.xxhash64("chunk"))


def repeated_chunks(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """(_doc, removed): numbers of the chunks of each document that occur earlier; documents without any are left out."""
    chunks = _chunks(_cut(docs.select("doc_id", "text")), least_lines)
    place = F.struct("_doc", "k")
    twice = chunks.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("hash", "n")
    twice = stage(twice, "line-chunks")
    limit = hot_limit(twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    salt = F.xxhash64("_doc.doc_id", "_doc.hash", "k")
    # Sort-merge whatever the sizes: what a few repeated chunks cost is then what many cost.
    again = deal(chunks, hot_keys(twice, "hash", limit), "hash", salt).join(copies(twice, limit).hint("merge"), ["hash", "_salt"])
    # The first of a chunk: within each part where it lies, then over the parts, then back to all of them.
    first = again.groupBy("hash", "_salt", "chunk").agg(F.min(place).alias("first"), F.first("n").alias("n"))
    first = copies(first.groupBy("hash", "chunk").agg(F.min("first").alias("first"), F.first("n").alias("n")), limit)
    first = first.select("hash", "_salt", F.col("chunk").alias("first_chunk"), "first")
    later = again.join(first.hint("merge"), ["hash", "_salt"]).where((F.col("chunk") == F.col("first_chunk")) & (place != F.col("first")))
    return later.groupBy("_doc").agg(F.collect_set("k").alias("removed"))


def mark_repeats(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """docs with `_n_lines`, `_n_removed` (lines) and `_kept` (the text without removed chunks)."""
    if clash := [c for c in docs.columns if c.startswith("_")]:
        raise ValueError(f"columns must not begin with _: {clash}")
    removed = repeated_chunks(docs, least_lines)
    removed = removed.select(F.col("_doc.doc_id").alias("_id"), F.col("_doc.hash").alias("_hash"), F.array_sort("removed").alias("_removed"))
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    match = keyed["doc_id"].eqNullSafe(removed["_id"]) & (keyed["_text_hash"] == removed["_hash"])
    cut = _cut(keyed.join(removed.hint("shuffle_hash"), match, "left").drop("_id", "_hash", "_text_hash"))
    gone = F.transform("_removed", lambda k: F.struct(F.when(k == 0, 0).otherwise(F.get(F.col("_ends"), k - 1) + 1).alias("s"), F.get(F.col("_ends"), k).alias("e")))
    cut = cut.withColumn("_gone", gone)
    n_removed = F.aggregate("_gone", F.lit(0), lambda acc, g: acc + g["e"] - g["s"] + 1)
    # The stretches between removed chunks.
    begins = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda g: g["e"] + 1))
    finish = F.concat(F.transform("_gone", lambda g: g["s"]), F.array(F.size("_lines")))
    cut = cut.withColumn("_stays", F.filter(F.arrays_zip(begins.alias("s"), finish.alias("e")), lambda z: z["s"] < z["e"]))
    kept = F.array_join(F.flatten(F.transform("_stays", lambda z: F.slice(F.col("_lines"), z["s"] + 1, z["e"] - z["s"]))), "\n")
    cut = cut.withColumns({"_n_lines": F.size("_lines"), "_n_removed": F.when(F.col("_removed").isNull(), 0).otherwise(n_removed), "_kept": F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)})
    return cut.select(*docs.columns, "_n_lines", "_n_removed", "_kept")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated chunks taken out of text, and n_chars (where there is one) set anew."""
    marked = mark_repeats(docs, **options)
    counted = {"n_chars": F.when(F.col("_n_removed") > 0, F.char_length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return marked.withColumns({"text": F.col("_kept"), **counted}).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("_kept", F.lit(""))
    return marked.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


_ROLLED = " + ".join(["h", *[f"{FACTOR**j} * coalesce(lag(h, {j}) OVER w, 0)" for j in range(1, WINDOW)]])
OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, len(string_split(coalesce(text, ''), chr(10))) AS size
  FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
rolled AS (SELECT *, {_ROLLED} AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (
  SELECT *, CASE WHEN i = size - 1 OR (i BETWEEN 1 AND size - 3 AND r < lag(r) OVER w AND r < lead(r) OVER w) THEN 1 ELSE 0 END AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM marked),
chunks AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, k),
judged AS (SELECT *, n >= {LEAST_LINES} AND trim(chunk) <> '' AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM chunks),
kept AS (
  SELECT doc_id, sum(n) AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, length(text) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""
