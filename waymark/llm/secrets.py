"""Secret scans: candidates by pattern, separated by how many repositories and owners hold them.

Everything is DataFrame functions: positions come from splitting a text at a pattern and running sums of lengths in code points. Base
kinds are found leftmost and without overlaps, then filtered (a match that fails is not retried). The method adds a fourth kind,
`owned`: long mixed tokens (letters and digits, `TOKEN_LENGTH` or more) which no base span covers, kept only if the corpus shows them
to be specific to few owners. Ownership: a candidate's hash is counted by distinct repositories (the `source` column) and distinct
owners (documents' distinct texts, as the tables name no owner). Values that `COPIED_SOURCES` or more repositories hold, or `COPIED_OWNERS` or
more owners, are widely copied examples; the others are live-looking. Rows of a value that very many hold are dealt over parts of its hash.

Nulls: a null text counts as empty, a null source as one further source, a null doc_id stays null. Repeated rows get equal results and
count once as owners (same text). A very long text is one row; its work grows with n log n in its matches. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import meet, running, stage, table

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: The runs that these two match end where the shorter matches would end, so the least length can stand in the pattern.
ACCESS = rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"
HEX = rf"[0-9a-f]{{{LEAST['hex']},}}"
KINDS = ("assign", "access", "hex", "owned")

TOKEN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}"
COPIED_SOURCES = 3
COPIED_OWNERS = 10
_FAR = 1 << 62

SPAN = "struct<start:long,kind:int,end:long,value:string>"


def _pieces(text: Column, pattern: str, value: Column | None = None) -> Column:
    """Array of (gap, n, v): for each match, leftmost and non-overlapping, the code points since the match before, its own, and its value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Zipped, so that each array is made once a text; there is one piece more than there are matches.
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), *([] if value is None else [value.alias("v")]))
    return F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z: F.struct(F.char_length(z["gap"]).cast("long").alias("gap"), F.char_length(z["m"]).cast("long").alias("n"), z["m" if value is None else "v"].alias("v")))


def _placed(pieces: str, kind: int) -> Column:
    """Array of SPAN of a column of pieces: running sums of their lengths give the ends."""
    ends = running(F.transform(pieces, lambda p: p["gap"] + p["n"]))
    span = lambda p, end: F.struct((end - p["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["v"].alias("value"))
    return F.when(F.size(pieces) > 0, F.zip_with(pieces, ends, span)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _where(needed: Column, pieces: Column) -> Column:
    """The pieces where a cheap test says that there can be any."""
    return F.when(needed, pieces).otherwise(F.array().cast("array<struct<gap:long,n:long,v:string>>"))


def _uncovered(spans: str) -> Column:
    """The spans of kind 3 in a sorted array of spans that no span of another kind overlaps: the greatest end of those that begin before
    or with it and the least start of those that begin after it tell."""
    end = F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(-1).cast("long")))
    start = F.transform(F.reverse(F.col(spans)), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(F.lit(_FAR).cast("long")))
    zipped = F.arrays_zip(F.col(spans).alias("s"), running(end, F.greatest, -1).alias("reach"), F.reverse(running(start, F.least, _FAR)).alias("next"))
    free = F.filter(zipped, lambda z: (z["s"]["kind"] == 3) & (z["reach"] <= z["s"]["start"]) & (z["next"] >= z["s"]["end"]))
    return F.transform(free, lambda z: z["s"])


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) with `base` and `more`: arrays of SPAN, in order of start, then kind."""
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("owner"),
        _where(text.rlike(r"[:=]"), _pieces(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))).alias("p_assign"),
        _where(F.contains(text, F.lit("AKIA")), _pieces(text, ACCESS)).alias("p_access"),
        _where(text.rlike(HEX), _pieces(text, HEX)).alias("p_hex"),
        _where(text.rlike(TOKEN), _pieces(text, TOKEN)).alias("p_tokens"),
    )
    spans = {name: _placed(f"p_{name}", kind) for kind, name in enumerate(("assign", "access", "hex", "tokens"))}
    spans["assign"] = F.filter(spans["assign"], lambda s: F.char_length(s["value"]) >= LEAST["assign"])
    found = found.select("doc_id", "source", "owner", *[c.alias(n) for n, c in spans.items()])
    mixed = F.filter("tokens", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).withColumn("tokens", mixed)
    found = found.withColumn("every", F.array_sort(F.concat("base", "tokens")))
    free = F.when((F.size("base") == 0) | (F.size("tokens") == 0), F.col("tokens")).otherwise(_uncovered("every"))
    return found.select("doc_id", "source", "owner", "assign", "access", "hex", "base", free.alias("more"))


def _each(found: DataFrame, *columns: str) -> DataFrame:
    """A row for each span of found, with its value's hash; whole values are hashed with SHA-256."""
    rows = found.where(F.size("base") + F.size("more") > 0).select(*columns, F.explode(F.concat("base", "more")).alias("s"))
    return rows.withColumn("value_hash", F.sha2(F.col("s.value").cast("binary"), 256))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, sources, owners, n) of every candidate value; n counts its spans."""
    each = _each(found, "source", "owner").groupBy("value_hash", "source", "owner").agg(F.count("*").alias("n"))
    by_source = each.groupBy("value_hash", "source").agg(F.count("*").alias("owners"), F.sum("n").alias("n"))
    return by_source.groupBy("value_hash").agg(F.count("*").alias("sources"), F.sum("owners").alias("owners"), F.sum("n").alias("n"))


def scan_secrets(docs: DataFrame, copied_sources: int = COPIED_SOURCES, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, assign, access, hex, base (arrays of SPAN), owned
    (added spans of values that are not widely copied), live (the spans, of all kinds, of such values)."""
    docs = docs.select("doc_id", "text", "source")
    found = stage(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    few = stage(ownership(found).where((F.col("sources") < copied_sources) & (F.col("owners") < copied_owners)).select("value_hash", "n"), "owned-values")
    total = few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = meet(_each(found, "row"), few, "value_hash", total, F.xxhash64("row", "s.start")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("live"))
    out = found.join(kept, "row", "left").withColumn("live", F.coalesce("live", F.array().cast(f"array<{SPAN}>")))
    return out.select("doc_id", "assign", "access", "hex", "base", F.filter("live", lambda s: s["kind"] == 3).alias("owned"), "live")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "owned")).alias("spans"))


def _sql_spans(pattern: str, kind: int, group: int) -> str:
    """Spans of one kind as rows: lengths of the pieces between matches and of the matches, added up."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, owner, {kind} AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start, length(ms[i]) AS n, vs[i] AS value
      FROM (SELECT doc_id, source, owner, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, source, owner, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS ms, regexp_extract_all(text, '{quoted}', {group}) AS vs FROM docs))"""


OP6_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS owner FROM documents),
base AS (SELECT *, start + n AS "end" FROM (
  {_sql_spans(ASSIGN, 0, 2)} UNION ALL {_sql_spans(ACCESS, 1, 0)} UNION ALL {_sql_spans(HEX, 2, 0)}) WHERE kind > 0 OR length(value) >= {LEAST["assign"]}),
tokens AS (SELECT *, start + n AS "end" FROM ({_sql_spans(TOKEN, 3, 0)}) WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')),
more AS (SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t."end" AND t.start < b."end")),
few AS (SELECT value FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY value HAVING count(DISTINCT source) < {COPIED_SOURCES} AND count(DISTINCT owner) < {COPIED_OWNERS}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE value IN (SELECT value FROM few)),
listed AS (SELECT doc_id, kind, start, "end", ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || "end" AS s FROM every),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
  string_agg(s, ',' ORDER BY start, kind, "end") FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind, "end") AS spans FROM listed GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN by_doc USING (doc_id)
"""
