"""Closed frequent sequences: bidirectional extension checks over projected sequences, dealt to tasks by the first token of the pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.tokens import list_parts
from waymark.sources.tables import staged

#: At most so many tasks for a group of sequences, one for each so many tokens: a sequence goes to those that have one of its tokens.
DEALS = 64
DEAL_TOKENS = 4096

Places = list[tuple[int, int]]


def _leftmost(seq: list[int], pattern: list[int]) -> list[int]:
    out, at = [], 0
    for t in pattern:
        at = seq.index(t, at)
        out.append(at)
        at += 1
    return out


def _backwards(seq: list[int], pattern: list[int], end: int) -> list[int]:
    """Places of the last match of pattern in seq[:end]."""
    out, at = [], end
    for t in reversed(pattern):
        at -= 1
        while seq[at] != t:
            at -= 1
        out.append(at)
    return out[::-1]


def _gap_filled(seqs: list[list[int]], pattern: list[int], places: Places, within: bool) -> bool:
    """Whether some token stands, in all sequences, before the same token of the pattern and after the leftmost match of what comes before it.

    within: up to the last place in the leftmost match (then no pattern that begins so is closed), else up to the last place at all (then this one is not).
    """
    bounds = []
    for k, end in places:
        seq = seqs[k]
        first = _leftmost(seq, pattern)
        bounds.append((seq, [0, *(f + 1 for f in first)], _backwards(seq, pattern, end if within else len(seq))))
    bounds.sort(key=lambda b: len(b[0]))
    for i in range(len(pattern)):
        common: set[int] | None = None
        for seq, after, before in bounds:
            here = set(seq[after[i] : before[i]])
            common = here if common is None else common & here
            if not common:
                break
        if common:
            return True
    return False


def mine(seqs: list[list[int]], least: int, firsts: list[int], worth: Callable[[int, Places], bool] | None = None) -> Iterator[tuple[list[int], list[int]]]:
    """Closed patterns that begin with one of firsts, in lexicographic order, each with the numbers of the sequences that hold it.

    Where all sequences go on with the same token, only that token is followed: whatever skips it could be made longer by it. worth(length, places) may
    cut off what no longer matters; nothing is kept of patterns found.
    """
    for first in sorted(firsts):
        places = [(k, s.index(first) + 1) for k, s in enumerate(seqs) if first in s]
        if len(places) < least or _gap_filled(seqs, [first], places, True):
            continue
        stack = [([first], places)]
        while stack:
            pattern, places = stack.pop()
            while all(end < len(seqs[k]) for k, end in places) and len({seqs[k][end] for k, end in places}) == 1:
                pattern.append(seqs[places[0][0]][places[0][1]])
                places = [(k, end + 1) for k, end in places]
            if worth and not worth(len(pattern), places):
                continue
            heads: dict[int, Places] = {}
            for k, end in places:
                for t, at in {t: i for i, t in reversed(list(enumerate(seqs[k][end:], end)))}.items():
                    heads.setdefault(t, []).append((k, at + 1))
            if all(len(h) < len(places) for h in heads.values()) and not _gap_filled(seqs, pattern, places, False):
                yield pattern, [k for k, _ in places]
            for t in sorted(heads, reverse=True):
                if len(heads[t]) >= least and not _gap_filled(seqs, [*pattern, t], heads[t], True):
                    stack.append(([*pattern, t], heads[t]))


def _dealt(seqs: DataFrame, group: str, deal_tokens: int) -> DataFrame:
    """seqs(group, seq) with a number for each sequence, once for each deal that has one of its tokens; `firsts`: the tokens that begin the deal's patterns."""
    size = F.sum(F.size("seq")).over(W.partitionBy(group))
    numbered = seqs.select(group, "seq", F.monotonically_increasing_id().alias("id")).withColumn("deals", F.greatest(F.lit(1), F.least(F.lit(DEALS), F.ceil(size / deal_tokens))))
    deal = lambda t: F.pmod(F.xxhash64(t), F.col("deals")).cast("int")
    each = numbered.withColumn("deal", F.explode(F.array_distinct(F.transform("seq", deal))))
    return each.withColumn("firsts", F.array_distinct(F.filter("seq", lambda t: deal(t) == F.col("deal"))))


def _mined(seqs: DataFrame, group: str, deal_tokens: int, find: Callable[[list[list[int]], list[int]], list[tuple]], columns: str) -> DataFrame:
    """(group, columns) of what find(sequences, firsts) gives for each deal: (number of a sequence or none, count, pattern). A deal is a row and many are in a batch, whose tokens are
    numbered at once, in their order."""
    one = _dealt(seqs, group, deal_tokens).groupBy(group, "deal").agg(F.collect_list(F.struct("id", "seq")).alias("rows"), F.array_distinct(F.flatten(F.collect_set("firsts"))).alias("firsts"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (rows, spans), (firsts, starts) = list_parts(b.column("rows")), list_parts(b.column("firsts"))
            tokens, ends = list_parts(rows.field("seq"))
            known = pc.unique(tokens)
            known = known.take(pc.sort_indices(known))
            number, begin, token, ids = pc.index_in(tokens, known).to_pylist(), pc.index_in(firsts, known).to_pylist(), known.to_pylist(), rows.field("id").to_pylist()
            out: list[list] = [[] for _ in range(4)]
            for k in range(b.num_rows):
                lists = [number[ends[j] : ends[j + 1]] for j in range(spans[k], spans[k + 1])]
                for holder, n, pattern in find(lists, begin[starts[k] : starts[k + 1]]):
                    for column, value in zip(out, (k, None if holder is None else ids[spans[k] + holder], n, [token[t] for t in pattern]), strict=True):
                        column.append(value)
            found = {"id": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int64()), "seq": pa.array(out[3], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([b.column(group).take(pa.array(out[0], pa.int64())), *(found[c] for c in names)], [group, *names])

    return one.select(group, "rows", "firsts").mapInArrow(run, f"`{group}` {seqs.schema[group].dataType.simpleString()}, {columns}")


def closed_patterns(seqs: DataFrame, group: str, least: int, deal_tokens: int = DEAL_TOKENS) -> DataFrame:
    """(group, freq, seq): all closed patterns that at least `least` sequences of the group hold."""

    def find(lists: list[list[int]], firsts: list[int]) -> list[tuple]:
        return [(None, len(holders), list(pattern)) for pattern, holders in mine(lists, least, firsts)]

    return _mined(seqs, group, deal_tokens, find, "n long, seq array<string>").withColumnRenamed("n", "freq")


def covering_patterns(seqs: DataFrame, group: str, least: int, deal_tokens: int = DEAL_TOKENS) -> DataFrame:
    """(group, freq, seq): for each sequence its longest closed pattern (the least of equals), counted.

    A task keeps the longest pattern of each sequence so far and leaves branches that cannot beat it; the longest of all tasks is found in Spark.
    """

    def find(lists: list[list[int]], firsts: list[int]) -> list[tuple]:
        best: dict[int, list[int]] = {}
        worth = lambda n, places: any(n + len(lists[k]) - end > len(best.get(k, ())) for k, end in places)
        for pattern, holders in mine(lists, least, firsts, worth):
            for k in holders:
                if len(pattern) > len(best.get(k, ())):
                    best[k] = pattern
        return [(k, len(p), p) for k, p in best.items()]

    found = _mined(seqs, group, deal_tokens, find, "id long, n long, seq array<string>")
    longest = found.groupBy(group, "id").agg(F.min(F.struct((-F.col("n")).alias("n"), "seq")).alias("p"))
    return longest.groupBy(group, F.col("p.seq").alias("seq")).agg(F.count("*").alias("freq")).select(group, "freq", "seq")


def extract_support(seqs: DataFrame, group: str, least: int = 1) -> DataFrame:
    """covering_patterns(), staged; ValueError where there are too few sequences or no pattern is frequent."""
    if least < 1:
        raise ValueError("the least support must be at least 1")
    found = staged(covering_patterns(seqs, group, least), "support")
    if found.isEmpty():
        raise ValueError(f"no pattern is held by {least} sequences")
    return found
