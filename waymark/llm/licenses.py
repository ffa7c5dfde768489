"""License scans through a positional rare-token index, in DataFrame functions only.

Each licence has templates, words of its notices in order. How rare a template word is, is counted over all documents (inverse document frequency), and the
index keeps for each template the places of its `INDEX_WORDS` rarest words. A file looks up the highest-IDF licence words it holds, those with at least half
the weight of its rarest one. Postings are intersected by relative position: a word at place p of the file and place q of the template votes for the alignment
p - q. Alignments whose words carry `LEAST_SHARE` percent of the template's weight, two different words at least, are candidates, and a candidate counts if all mandatory
key phrases of the template stand in its stretch of the file, give or take `SLACK` words.

Base places, where a fixed phrase's words stand consecutively, are found apart from that and always kept. The score is 1 with a base place, else the greatest
share of a verified template, else 0.

Files meet the index by a broadcast of its postings, whose number the templates fix. Only votes are shuffled, by file and alignment, so a line that a third of
all files hold makes no large group. Defined cases: a null text is empty: no words, no labels, score 0. Repeated rows get equal results and each counts as a document; a
null doc_id stays null. A very long text is one row, its work linear in its words. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX_WORDS = 8
LEAST_SHARE = 60
SLACK = 3

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, notice, mandatory key phrases. The notices are the usual public ones, shortened to what all their variants share.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def vocabulary(templates: tuple = TEMPLATES) -> list[str]:
    return sorted({w for _, text, phrases in templates for part in (text, *phrases) for w in part.split()} | {w for p, _ in BASE for w in p.split()})


def licence_words(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """docs(doc_id, text) with `row`, `n_words` and `hits`: the licence words with their places, in order."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = docs.select("doc_id", F.filter(F.split(lowered, BETWEEN, -1), lambda w: w != "").alias("words"))
    # Word and place only where a word counts, so that a text without licence words makes no further array.
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary(templates)), F.struct(i.alias("pos"), w.alias("word")))), lambda h: h.isNotNull())
    return words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def base_places(hits: str) -> Column:
    """Array of (pos, label), one for each place of a base phrase."""

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def stands(h: Column, i: Column) -> Column:
            at = [F.get(F.col(hits), i + k) for k in range(1, len(rest) + 1)]
            return (h["word"] == first) & F.forall(F.array(*[F.coalesce((x["word"] == w) & (x["pos"] == h["pos"] + k), F.lit(False)) for k, (x, w) in enumerate(zip(at, rest, strict=True), 1)]), lambda ok: ok)

        return F.transform(F.filter(hits, stands), lambda h: F.struct(h["pos"].cast("long").alias("pos"), F.lit(label).alias("label")))

    return F.concat(*[places(p, label) for p, label in BASE])


def rare_index(found: DataFrame, n: int, templates: tuple = TEMPLATES, index_words: int = INDEX_WORDS) -> list[tuple]:
    """(word, weight, template, place, total) of each template's rarest words; total is the weight of all its places. Weights are inverse
    document frequencies over all of found, in thousandths, so their sums are exact."""
    words = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    held = {r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}  # as many rows as template words
    weight = {w: 1 + math.floor(1000 * math.log((n + 1) / (held.get(w, 0) + 1))) for w in vocabulary(templates)}
    out = []
    for t, (_, text, _) in enumerate(templates):
        rare = set(sorted(set(text.split()), key=lambda w: (-weight[w], w))[:index_words])
        places = [(w, weight[w], t, q) for q, w in enumerate(text.split()) if w in rare]
        out += [(*p, sum(x[1] for x in places)) for p in places]
    return out


def alignments(found: DataFrame, index: DataFrame, least_share: int = LEAST_SHARE) -> DataFrame:
    """(row, template, at, share): where the look-up words of a file and a template's postings agree on one relative position."""
    words = index.groupBy("word").agg(F.first("weight").alias("weight"))
    hits = found.where(F.size("hits") > 1).select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word").join(F.broadcast(words), "word")
    rarest = hits.groupBy("row").agg(F.max("weight").alias("most"))
    looked = hits.join(rarest, "row").where(F.col("weight") * 2 >= F.col("most")).drop("weight", "most")
    votes = looked.join(F.broadcast(index), "word").groupBy("row", "template", (F.col("pos") - F.col("place")).alias("at"))
    votes = votes.agg(F.sum("weight").alias("sum"), F.first("total").alias("total"), F.min("word").alias("a"), F.max("word").alias("b"))
    return votes.where((F.col("sum") * 100 >= F.col("total") * least_share) & (F.col("a") < F.col("b"))).select("row", "template", "at", (F.col("sum") / F.col("total")).alias("share"))


def verified(found: DataFrame, aligned: DataFrame, templates: tuple = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """(row, labels, share) of files with at least one alignment whose mandatory key phrases all stand in its stretch of the file."""
    about = [(t, label, len(text.split()), [f" {p} " for p in phrases]) for t, (label, text, phrases) in enumerate(templates)]
    about = found.sparkSession.createDataFrame(about, "template int, label string, length int, phrases array<string>")
    stretch = F.filter("hits", lambda h: h["pos"].between(F.col("at") - slack, F.col("at") + F.col("length") - 1 + slack))
    near = aligned.join(F.broadcast(about), "template").join(found.select("row", "hits"), "row").withColumn("near", stretch)
    # Words that follow each other are joined by a blank, others by a bar.
    apart = lambda h, i: F.concat(F.when(h["pos"] == F.get("near", i - 1)["pos"] + 1, F.lit("")).otherwise(F.lit("| ")), h["word"])
    joined = near.withColumn("line", F.concat(F.lit(" "), F.array_join(F.transform("near", apart), " "), F.lit(" ")))
    kept = joined.where(F.forall("phrases", lambda p: F.contains(F.col("line"), p)))
    return kept.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, index_words: int = INDEX_WORDS, least_share: int = LEAST_SHARE, slack: int = SLACK) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, base (array of (pos, label)), labels (base ones and the method's, sorted), score."""
    parsed = licence_words(docs.select("doc_id", "text"), templates)
    found = stage(parsed.select("row", "doc_id", "n_words", "hits", base_places("hits").alias("base")), "licence-words")
    index = found.sparkSession.createDataFrame(rare_index(found, found.count(), templates, index_words), "word string, weight long, template int, place int, total long")
    method = stage(verified(found, alignments(found, index, least_share), templates, slack), "licences")
    out = found.select("row", "doc_id", "n_words", "base").join(method, "row", "left")
    base = F.transform("base", lambda b: b["label"])
    labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("labels", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce("share", F.lit(0.0)), 6))
    return out.select("doc_id", "n_words", "base", labels.alias("labels"), score.alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    places = F.transform("base", lambda b: b["pos"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _sql_rows(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


_PHRASES = [(t, p, i, w, len(phrase.split())) for t, (_, _, phrases) in enumerate(TEMPLATES) for p, phrase in enumerate(phrases) for i, w in enumerate(phrase.split())]

OP13_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
vocab(word) AS {_sql_rows([(w,) for w in vocabulary()])},
templates(t, label, length) AS {_sql_rows([(t, label, len(text.split())) for t, (label, text, _) in enumerate(TEMPLATES)])},
places(t, place, word) AS {_sql_rows([(t, q, w) for t, (_, text, _) in enumerate(TEMPLATES) for q, w in enumerate(text.split())])},
phrases(t, p, i, word, n) AS {_sql_rows(_PHRASES)},
basics(p, label, i, word, n) AS {_sql_rows([(k, label, i, w, len(p.split())) for k, (p, label) in enumerate(BASE) for i, w in enumerate(p.split())])},
hits AS MATERIALIZED (SELECT * FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs) WHERE word IN (SELECT word FROM vocab)),
weights AS MATERIALIZED (SELECT word, 1 + floor(1000 * ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (coalesce(n, 0) + 1)))::BIGINT AS weight
  FROM vocab LEFT JOIN (SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word) USING (word)),
rare AS (SELECT t, word FROM (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) AS k FROM (SELECT DISTINCT t, word FROM places) JOIN weights USING (word)) WHERE k <= {INDEX_WORDS}),
posts AS (SELECT t, place, word, weight, sum(weight) OVER (PARTITION BY t) AS total FROM places JOIN rare USING (t, word) JOIN weights USING (word)),
indexed AS (SELECT hits.*, weight FROM hits JOIN weights USING (word) WHERE word IN (SELECT word FROM rare)),
looked AS (SELECT * FROM indexed JOIN (SELECT r, max(weight) AS most FROM indexed GROUP BY r) USING (r) WHERE weight * 2 >= most),
aligned AS MATERIALIZED (SELECT r, t, pos - place AS off, sum(posts.weight) / any_value(total) AS share FROM looked JOIN posts USING (word) GROUP BY r, t, pos - place
  HAVING sum(posts.weight) * 100 >= any_value(total) * {LEAST_SHARE} AND count(DISTINCT word) > 1),
stand AS (SELECT r, t, off, p FROM aligned JOIN templates USING (t) JOIN phrases USING (t) JOIN hits USING (r, word) WHERE pos BETWEEN off - {SLACK} AND off + length - 1 + {SLACK}
  GROUP BY r, t, off, p, pos - i HAVING count(*) = any_value(n)),
verified AS (SELECT r, t, off FROM stand GROUP BY r, t, off HAVING count(DISTINCT p) = (SELECT count(DISTINCT p) FROM phrases WHERE phrases.t = stand.t)),
method AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM verified JOIN aligned USING (r, t, off) JOIN templates USING (t) GROUP BY r),
based AS (SELECT r, p, any_value(label) AS label, pos - i AS start FROM hits JOIN basics USING (word) GROUP BY r, p, pos - i HAVING count(*) = any_value(n)),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM based GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(share, 0), 6) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN method USING (r)
"""
