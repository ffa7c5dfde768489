r"""Chat formatting: layouts are recognised by a fingerprint of field paths and mapped to canonical turns.

A layout is declared by its nested field paths (`messages[].role` and so on) and a mapping to an array of turns. The paths of the fields that
a row holds (that are not null) are hashed, and the hash selects the mapping, so one table may hold rows of several layouts. The table of
hashes also lists what rows with nulls hold: such a row belongs to the smallest layout that its fields are part of. A row that holds more, because
further columns happen to be fields of another layout, belongs to the layout of which it holds most fields, of equal ones to the larger. Rows that
two layouts of one size fit alike are refused. No Python runs on executors.

Template: each turn is `### role:`, a line feed, the text, `</turn>`, a line feed. Inside roles and texts `\` becomes `\\`,
`###` becomes `\h` and `</turn>` becomes `\t`; inside roles also `:` becomes `\c` and a line feed `\n`. So neither mark occurs in an
escaped text, and reading back is exact. The loss mask is a list of spans of the formatted string, in code
points: the texts of assistant turns.

Nulls: null texts and roles count as empty; rows with a null conversation id form one conversation. Ties of turn are in order of role,
then text; repeated rows are turns of their own. A null or empty list of messages gives no turns. Empty tables give no rows.
A conversation is one output string, so its turns do meet in one row; conversations are spread by their id. Very long texts and very many
turns are rows like any other: spans are running sums, so their work is n log n in the turns. Further columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.shared import bound, running, table

TURNS = "array<struct<role:string,text:string>>"
END = "</turn>\n"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves; arrays add []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(column: str, role: str, text: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("conv_id", F.coalesce(F.transform(column, lambda m: _turn(m[role], m[text])), F.array().cast(TURNS)).alias("turns"))


def _pair(question: Callable[[], Column], answer: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("conv_id", F.array(_turn(F.lit("user"), question()), _turn(F.lit("assistant"), F.col(answer))).alias("turns"))


def _instruction() -> Column:
    more = F.coalesce(F.col("input"), F.lit(""))
    return F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(F.lit("")))


def _by_turn(df: DataFrame) -> DataFrame:
    rows = df.select("conv_id", F.struct("turn", _turn(F.col("role"), F.col("text")).alias("t")).alias("r"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r")).select("conv_id", F.transform("r", lambda r: r["t"]).alias("turns"))


Mapping = Callable[[DataFrame], DataFrame]

#: Declared layouts: their paths, and what makes (conv_id, turns) of them.
LAYOUTS: dict[tuple[str, ...], Mapping] = {
    ("conv_id", "turn", "role", "text"): _by_turn,
    ("conv_id", "messages[].role", "messages[].content"): _messages("messages", "role", "content"),
    ("conv_id", "conversations[].from", "conversations[].value"): _messages("conversations", "from", "value"),
    ("conv_id", "instruction", "input", "output"): _pair(_instruction, "output"),
    ("conv_id", "instruction", "output"): _pair(lambda: F.col("instruction"), "output"),
    ("conv_id", "prompt", "completion"): _pair(lambda: F.col("prompt"), "completion"),
    ("conv_id", "prompt", "response"): _pair(lambda: F.col("prompt"), "response"),
}


def _fields(layout: tuple[str, ...]) -> dict[str, list[str]]:
    """The paths of a layout by the column that they lie in, without the conversation's id."""
    out: dict[str, list[str]] = {}
    for path in layout:
        if path != "conv_id":
            out.setdefault(path.split("[")[0].split(".")[0], []).append(path)
    return out


def fingerprint_table(layouts: list[tuple[str, ...]]) -> dict[str, int]:
    """Fingerprint of every set of paths that a row may hold -> number of the layout it selects, -1 for several.

    A layout's own paths select it. A row that lacks some (nulls) selects the layout whose part it is, the one with the fewest
    paths; if several of that size fit, it is ambiguous. A row with nothing but its id selects a layout only where there is no other.
    """
    whole = {fingerprint(p for p in layout if p != "conv_id"): k for k, layout in enumerate(layouts)}
    fits: dict[str, list[tuple[int, int]]] = {}
    for k, layout in enumerate(layouts):
        fields = list(_fields(layout).values())
        for n in range(0 if len(layouts) == 1 else 1, len(fields)):
            for part in combinations(fields, n):
                fits.setdefault(fingerprint(p for paths in part for p in paths), []).append((len(layout), k))
    best = {mark: [k for n, k in own if n == min(own)[0]] for mark, own in fits.items()}
    return {mark: own[0] if len(own) == 1 else -1 for mark, own in best.items()} | whole


def row_layout(df: DataFrame, layouts: list[tuple[str, ...]]) -> Column:
    """Number of the layout that the fingerprint of a row's non-null paths selects: null without one, -1 for several."""
    columns = {c: paths for layout in layouts for c, paths in _fields(layout).items()}
    every: dict[str, set[str]] = {c: {p for layout in layouts for p in _fields(layout).get(c, [])} for c in columns}
    held = F.concat(*[F.when(F.col(c).isNotNull(), F.array(*[F.lit(p) for p in sorted(paths)])).otherwise(F.array().cast("array<string>")) for c, paths in every.items()])
    mark = F.substring(F.sha2(F.array_join(F.array_sort(held), "\n").cast("binary"), 256), 1, 16)
    numbers = F.create_map(*[F.lit(x) for item in fingerprint_table(layouts).items() for x in item])
    return F.try_element_at(numbers, mark)


def fullest_layout(layouts: list[tuple[str, ...]]) -> Column:
    """Number of the layout of which a row holds most fields, of equal ones the larger; -1 for several."""
    held = lambda layout: reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), len(paths)).otherwise(0) for c, paths in _fields(layout).items()])
    ranks = F.array(*[F.struct(held(layout).alias("held"), F.lit(len(layout)).alias("size"), F.lit(k).alias("k")) for k, layout in enumerate(layouts)])
    top = bound(ranks, lambda every: bound(F.array_max(every), lambda best: F.filter(every, lambda r: (r["held"] == best["held"]) & (r["size"] == best["size"]))))
    return bound(top, lambda best: F.when(F.size(best) == 1, F.get(best, 0)["k"]).otherwise(-1))


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table whose rows have any of the declared layouts; fields of no layout are ignored.

    A table that holds the fields of no layout raises ValueError. In a table with the fields of several layouts each row is mapped by its
    own fingerprint; a row that fits several alike, or none, fails the job with its fingerprint's cause (nothing is guessed or dropped), but a
    row of nulls, which has no turns.
    """
    have = set(field_paths(df.schema))
    layouts = [p for p in LAYOUTS if have >= set(p)]
    if not layouts:
        raise ValueError(f"no declared layout has its fields among {sorted(have)}")
    number = row_layout(df, layouts)
    if len(layouts) > 1:
        columns = {c for layout in layouts for c in _fields(layout)}
        nothing = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in sorted(columns)])
        refuse = F.raise_error(F.lit("a row fits no declared layout, or several alike")).cast("int")
        fullest = fullest_layout(layouts)
        number = F.when(nothing, -2).when(number >= 0, number).when(fullest >= 0, fullest).otherwise(refuse)
    mark = next(name for n in range(len(df.columns) + 1) if (name := f"_layout{n}") not in df.columns)
    marked = df.withColumn(mark, number)
    made = [LAYOUTS[layout](marked.where(F.col(mark) == k)) for k, layout in enumerate(layouts)]
    if len(layouts) > 1:
        made.append(marked.where(F.col(mark) == -2).select("conv_id", F.array().cast(TURNS).alias("turns")))
    return reduce(DataFrame.unionByName, made)


def _escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(_escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Inverse of the escapes: pairs of backslashes are read first, from the left."""

    def plain(piece: Column) -> Column:
        for marked, sign in (("\\h", "###"), ("\\t", "</turn>"), ("\\c", ":"), ("\\n", "\n")):
            piece = F.replace(piece, F.lit(marked), F.lit(sign))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a table in any declared layout."""
    made = canonical_turns(df).select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("learn"), F.concat(F.lit("### "), _escape_role(t["role"]), F.lit(":\n")).alias("head"), _escape(t["text"]).alias("body"))).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    sizes = F.transform("parts", lambda p: F.struct(p["learn"].alias("learn"), F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body")))
    made = made.withColumns({"formatted": formatted, "sizes": sizes})
    ends = running(F.transform("sizes", lambda p: (p["head"] + p["body"] + len(END)).cast("long")))
    span = lambda p, end: F.struct(p["learn"].alias("learn"), (end - len(END) - p["body"]).cast("int").alias("start"), (end - len(END)).cast("int").alias("end"))
    spans = F.transform(F.filter(F.zip_with("sizes", ends, span), lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"]))
    return made.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""
    parts = F.split(formatted, END, -1)
    body = lambda p: F.instr(p, ":\n")
    one = lambda p: F.struct(unescape(F.substring(p, F.lit(5), body(p) - 5)).alias("role"), unescape(F.substring(p, body(p) + 2, F.char_length(p))).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined. Code points have four bytes each here, so a span is cut where it lies."""
    cut = lambda wide, s: F.decode(F.substring(wide, s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32")
    return F.array_join(bound(F.encode(formatted, "UTF-32"), lambda wide: F.transform(spans, lambda s: unescape(cut(wide, s)))), "")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    one = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))
    made = format_chats(table(spark, sf_dir, "conversations")).unionByName(format_chats(one))
    turns = F.col("turns")
    made = made.withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", masked(F.col("formatted"), F.col("loss_spans")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size(turns).cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), digest(F.col("learned")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n') AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
