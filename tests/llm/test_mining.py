"""Centroid clustering, hard negatives and licence scans against plain versions, with awkward rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.llm import centroids, licenses, negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dim=64, seed=3, hot=0):
    """Vectors around a few centres, of which `hot` are one and the same, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    rows = [(i, (centres[i % 7] + rng.normal(size=dim) * 0.5).astype(np.float32).tolist(), int(i % 10)) for i in range(n)]
    rows += [(n + i, rows[0][1], 0 if i % 2 else 1) for i in range(hot)]
    bad = [rows[1][1][:-1] + [float("nan")], rows[1][1][:-1] + [None], rows[1][1][:-1] + [float("inf")], None]
    rows += [(10_000 + i, b, 1) for i, b in enumerate(bad)]
    return [*rows, (3, rows[3][1], 3), (None, rows[4][1], 4), (20_000, rows[5][1], None), (20_100, [0.5] * (dim - 1), 2), (20_200, [0.25] * (dim - 1), 2), (20_300, [], 1), (20_400, [], 1), (20_500, [], 2)]


def usable(rows, dim=None):
    return [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and (dim is None or len(r[1]) == dim)]


def whole(v):
    return [int(np.floor(256 * float(x))) for x in v]


def plain_clusters(rows, k, rounds):
    kept = [(i, whole(v)) for i, v, _ in usable(rows, 64)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            own = [x for (_, x), c in zip(kept, of) if c == j]
            if own:
                centres[j] = [sum(v) // len(own) for v in zip(*own)]
    return sorted(repr((i, near(x)[1], near(x)[0])) for i, x in kept), centres


def as_table(where, rows):
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}), where / "embeddings.parquet")
    return str(where)


def same_as_sql(spark, where, name, table, without=lambda r: False):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = queries.QUERIES[name](spark, where)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return [dict(zip(names, r)) for r in got]


@pytest.mark.parametrize(("n", "k", "hot"), [(300, 40, 150), (25, 40, 0), (60, 5, 0)])
def test_clusters_equal_the_plain_rounds(spark, n, k, hot):
    rows, tally = vectors(n, hot=hot), []
    found, centres = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS), clusters=k, rounds=5, tally=tally)
    want, plain = plain_clusters(rows, k, 5)
    assert sorted(repr((r.vec_id, r.cluster, r.distance)) for r in found.collect()) == want
    assert centres.tolist() == plain and len(tally) == 5 and tally[0] == len(want)


def test_bounds_never_change_a_result_and_save_scans():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(4000, 16)) * 40 + rng.integers(0, 6, size=(4000, 1)) * 300).astype(np.int64)
    centres, before = x[:12].copy(), None
    cluster, upper, lower = np.full(4000, -1), np.full(4000, np.inf), np.full(4000, -np.inf)
    scans = []
    for _ in range(8):
        bounds = centroids.Bounds(centres, before)
        cluster, upper, lower, n = bounds.assign(x, cluster, upper, lower)
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(4000), cluster])
        rest = np.sort(d, 1)[:, 1]
        assert (upper >= own).all() and (lower <= np.sqrt(rest)).all()
        scans.append(n)
        before, centres = centres, np.array([x[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else centres[j] for j in range(12)])
    assert scans[0] == 4000 and min(scans) < 2000


def test_distances_of_ties_and_wide_components():
    x = np.array([[0, 0], [1 << 31, -(1 << 31)]], np.int64)
    c = np.array([[1, 0], [-1, 0], [1 << 31, 1 << 31]], np.int64)
    d = centroids.squares(x, c)
    assert d[0, 0] == d[0, 1] == 1 and d[1, 2] == (1 << 32) ** 2
    assert centroids.Bounds(c, None).assign(x, np.array([-1, -1]), np.array([np.inf] * 2), np.array([-np.inf] * 2))[0].tolist() == [0, 0]


def test_clusters_of_nothing_and_of_extra_columns(spark):
    none, centres = centroids.cluster_vectors(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert none.count() == 0 and len(centres) == 0
    clashing = spark.createDataFrame([(1, [1.0] * 64, 1), (2, [1.0] * 64, 1)], VECTORS).withColumns({"x": F.lit("x"), "cluster": F.lit("y"), "before": F.lit(1), "upper": F.lit(2)})
    assert [(r.cluster, r.distance) for r in centroids.cluster_vectors(clashing)[0].collect()] == [(0, 0), (0, 0)]


def test_op12_query_against_sql(spark, tmp_path):
    got = same_as_sql(spark, as_table(tmp_path, vectors(400, hot=120)), "op12_centroids", "embeddings")
    assert len({r["cluster"] for r in got}) > 20 and len({r["inertia"] for r in got}) == 1


def plain_negatives(rows, every):
    kept = [(n, i, label, np.array(whole(v), object)) for n, (i, v, label) in enumerate(usable(rows)) if label is not None]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, i, label, a in kept:
        if i is None or i % every:
            continue
        met = [(int(a.dot(x)) if len(a) else 0, j, m, other) for m, j, other, x in kept if m != n and len(x) == len(a)]
        for ps, p, *_ in sorted((t for t in met if t[3] == label), key=key)[:5]:
            fit = sorted((t for t in met if t[3] != label and 30 * ps <= 100 * t[0] <= 90 * ps), key=key)[:10]
            out += [(i, p, k, t[1], ps, t[0]) for k, t in enumerate(fit, 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("every", "hot", "block", "chunk"), [(10, 200, 64 * 20, 64 * 6), (25, 0, 1 << 20, 1 << 22)])
def test_hard_negatives_equal_brute_force(spark, every, hot, block, chunk):
    """With tiny blocks and chunks a hot list is cut both ways."""
    rows = vectors(300, hot=hot)
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % every == 0, block_floats=block, chunk_floats=chunk)
    got = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect()]
    assert sorted(map(repr, got)) == plain_negatives(rows, every) and len(got) > 300


def test_lists_are_skipped_and_no_row_is_lost():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(50, 8)) * 100
    members = [c + rng.normal(size=(40, 8)) * 5 for c in centres]
    about = (centres, np.linalg.norm(centres, axis=1), np.array([np.linalg.norm(m - c, axis=1).max() for m, c in zip(members, centres)]))
    visited = 0
    for a in centres[:10] + rng.normal(size=(10, 8)):
        scores = [np.sort(m @ a)[::-1] for m in members]
        lo, hi = 0.3 * (a @ a), 0.9 * (a @ a)
        every = np.concatenate(scores)
        want = np.sort(every[(every >= lo) & (every <= hi)])[::-1][:5]
        window, seen, got, step = {"lo": lo, "hi": hi, "kth": -np.inf}, 0, np.zeros(0), 2
        while True:
            lists, seen = negatives.next_visits(a, [window], seen, step, about)
            if not lists:
                break
            visited += len(lists)
            near = np.concatenate([got, *(scores[j][(scores[j] >= lo) & (scores[j] <= hi)] for j in lists)])
            got = np.sort(near)[::-1][:5]
            window["kth"] = got[4] if len(got) == 5 else -np.inf
            step *= 2
        assert np.allclose(got, want)
    assert visited < 250


def test_best_takes_the_earlier_of_equals():
    score = np.array([5, 7, 7, 1, 7, 5])
    ok = np.array([True] * 6)
    assert negatives.best(score, ok, 2).tolist() == [1, 2] and negatives.best(score, ok, 4).tolist() == [1, 2, 4, 0]
    assert negatives.best(score, score < 6, 9).tolist() == [0, 5, 3] and len(negatives.best(score, score > 9, 3)) == 0


def test_op11_query_against_sql(spark, tmp_path):
    got = same_as_sql(spark, as_table(tmp_path, vectors(600, hot=200)), "op11_hard_negatives", "embeddings")
    assert {r["anchor_id"] for r in got} >= {0, 100} and all(r["rank"] <= 10 for r in got)


def test_negatives_of_nothing_and_of_extra_columns(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, F.col("vec_id") % 2 == 0).count() == 0
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [-1.0, 0.0], 2)]
    clashing = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit("r"), "q": F.lit("q"), "cluster": F.lit("c"), "windows": F.lit("w"), "dim": F.lit(1), "x": F.lit(1)})
    assert [tuple(r) for r in negatives.hard_negatives(clashing, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 131072, 65536)]


GPL = "This work is licensed under the GNU General Public License, version 3."
LICENCES = [
    (1, "Text. Released under the MIT License. And UNDER THE mit-license", ["mit"], [2, 7]),
    (2, f"some words before\n{GPL}\nand after", ["gpl-3"], []),
    (3, "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0", ["apache-2", "cc-by-nc"], [3, 9]),
    (4, "mit stands under the other license", [], []),
    (5, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction", ["mit"], []),
    (6, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software", [], []),
    (7, "licensed under the gnu general public license version 4", [], []),
    (8, None, [], []),
    (9, "", [], []),
    (10, "café 42 ﬁn", [], []),
    (None, GPL, ["gpl-3"], []),
]


def test_licences_by_rare_words_and_key_phrases(spark):
    rng = random.Random(5)
    filler = [(100 + i, " ".join(rng.choice(["the", "under", "of", "lorem", "ipsum", "dolor"]) for _ in range(30)), [], []) for i in range(200)]
    rows = LICENCES + filler + [(2, LICENCES[1][1], ["gpl-3"], [])]
    long = " ".join(rng.choice(["the", "license", "under", "version", "word"]) for _ in range(60_000))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, long + " " + GPL)], "doc_id long, text string")
    got = licenses.scan_licenses(docs.withColumns({"row": F.lit("r"), "hits": F.lit(1), "labels": F.lit("x"), "base": F.lit(None)})).collect()
    seen = sorted((repr((r.doc_id, list(r.labels), sorted(b.pos for b in r.base))) for r in got if r.doc_id != 900))
    assert seen == sorted(repr((i, labels, places)) for i, _, labels, places in rows)
    assert [r.n_words for r in got if r.doc_id == 10] == [3] and [("gpl-3" in r.labels, r.n_words) for r in got if r.doc_id == 900] == [(True, 60_012)]
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_licences_of_an_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op13_query_against_sql(spark, tmp_path):
    rng = random.Random(6)
    lines = [t for _, t, _, _ in LICENCES if t]
    rows = LICENCES + [(1000 + i, " ".join(rng.choice(["the", "of", "license", "version", "2", "mit", "lorem", rng.choice(lines)]) for _ in range(rng.choice([3, 20, 200])))) for i in range(150)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), tmp_path / "documents.parquet")
    got = same_as_sql(spark, str(tmp_path), "op13_licenses", "documents")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        ws = word.findall((text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        at = sorted(i for p, _ in licenses.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(at), at[0] if at else None, at[-1] if at else None)
