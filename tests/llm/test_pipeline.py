"""The near-copy stage against brute force, and the whole pipeline against a plain version of its stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import linededup, nearcopies, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))


def sets(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for base in range(25):
        w = text(rng, rng.choice([60, 150, 400])).split()
        rows.append((base * 10, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 8])):
                v[rng.randrange(len(v))] = "edit"
            rows.append((base * 10 + k, " ".join(v)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: r.group_id for r in nearcopies.near_copies(df).collect()}
    root = {i: i for i, _ in rows if i is not None}
    pairs = [(a, b) for a, s in rows for b, t in rows if a is not None and b is not None and a < b and similarity(s, t) >= 0.8]
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.95 * len(pairs) and len(pairs) > 40
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[i] <= got[i] <= i for i in root)
    kept = nearcopies.without_near_copies(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in root if got[i] == i) and None in ids
    assert nearcopies.near_copies(df.where("false")).count() == 0


def test_dense_groups_are_solved_by_blocks(spark, monkeypatch):
    rng = random.Random(1)
    w = text(rng, 300).split()
    rows = [(i, " ".join([*w[:i], "edit", *w[i + 1 :]])) for i in range(250)]
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    fps = [nearcopies.long_fingerprint(t.encode(), 5) for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(250, np.int64)), pa.array(np.zeros(250, np.int64)), pa.array(range(250)), pa.array(fps, pa.binary())], ["t", "key", "id", "fp"])
    edges = [e for b in nearcopies._close([batch]) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(edges) <= 249
    root = list(range(250))
    for _ in range(250):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(root)) <= 3


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(7)
    bench = [(k, text(rng, 30)) for k in range(4)]
    rows = [(i, text(rng, 80) + "\n" + text(rng, 20)) for i in range(60)]
    rows += [(100 + i, text(rng, 30) + " stupid idiot moron scum " * 3) for i in range(30)]
    rows += [(200 + i, rows[5 + i][1]) for i in range(5)]
    shared = "\n".join(text(rng, 9) for _ in range(12))
    rows += [(220 + i, f"{text(rng, 70)}\n{shared}\n{text(rng, 20)}") for i in range(6)]
    rows += [(300 + i, text(rng, 20) + " " + bench[i][1] + " " + text(rng, 20)) for i in range(4)]
    rows += [(400, None), (401, "")]
    docs = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(t or "") for _, t in rows]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [k for k, _ in bench], "text": [t for _, t in bench]}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows if i < 125], "quality": [1] * 85, "toxic": [int(100 <= i < 130) for i, _ in rows if i < 125]}), tmp_path / "labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(frame, spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = {r.doc_id: r.score for r in toxicity.score_documents(frame, model).collect()}
    assert sum(scores[i] < 0.3 for i in range(125, 130)) == 0 and sum(scores[i] >= 0.3 for i in range(60)) == 0
    clean = {i: t for i, t in rows if scores[i] < 0.3}
    # Lines: chunks seen before go.
    seen, texts = set(), {}
    for i in sorted(clean):
        lines, chunks, now = (clean[i] or "").split("\n"), [], []
        h = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in lines]
        rolled = [h[k] + 31 * (h[k - 1] if k else 0) for k in range(len(h))]
        for k, line in enumerate(lines):
            now.append(line)
            if (1 <= k <= len(lines) - 3 and rolled[k] < min(rolled[k - 1], rolled[k + 1])) or k == len(lines) - 1:
                chunks.append(now)
                now = []
        kept = []
        for c in chunks:
            whole = "\n".join(c)
            if len(c) >= linededup.LEAST_LINES and whole.strip(" ") and whole in seen:
                continue
            seen.add(whole)
            kept.append(whole)
        texts[i] = "\n".join(kept)
    assert sum(len(texts[i]) < len(clean[i] or "") for i in range(221, 226)) == 5
    stays = [i for i in sorted(texts) if not any(j < i and similarity(texts[j], texts[i]) >= 0.8 for j in texts)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(w[k : k + 10]) for _, t in bench for w in [words(t)] for k in range(len(w) - 9)}
    final = [i for i in stays if not any(tuple(words(texts[i])[k : k + 10]) in windows for k in range(len(words(texts[i])) - 9))]
    assert {p.doc_id for p in pieces} == set(final) and not {300, 301, 302, 303} & set(final)

    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in final:
        ids = [*exact.encode(texts[i], add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own)


def test_stage_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, "/root/testdata/sf0.001").schema.names == docs.columns
    assert docs.where(F.col("doc_id") < 0).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], DOCS).repartition(3)


def test_true_copies_of_a_template_are_not_displaced(spark, monkeypatch):
    # Unrelated texts of one template are closer by fingerprint bits than the bit limits; true mates are at 0.81 or so.
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    rng = random.Random(12)
    base, rows = text(rng, 500).split(), []
    for k in range(120):
        mate = [*base, *text(rng, 100).split()]
        other = list(mate)
        for at in range(3, 12):
            other[at * 40 + k % 30] = f"edit{k}"
        rows += [(2 * k, " ".join(mate)), (2 * k + 1, " ".join(other))]
    links = {(a, b) for a in range(240) for b in range(a + 1, 240) if similarity(rows[a][1], rows[b][1]) >= 0.8}
    assert {(2 * k, 2 * k + 1) for k in range(120)} <= links
    root = list(range(240))
    for _ in range(240):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    got = {r.doc_id: r.group_id for r in nearcopies.near_copies(frame(spark, rows)).collect()}
    assert got == dict(enumerate(root))
    # The same where the first pass finds nothing, lists are long and clusters have several blocks.
    monkeypatch.setattr(nearcopies, "ALL_BITS", -1)
    monkeypatch.setattr(nearcopies, "LIST", 8)
    got = {r.doc_id: r.group_id for r in nearcopies.near_copies(frame(spark, rows), block_bytes=200_000).collect()}
    assert got == dict(enumerate(root))


def test_lists_stream_over_batches(monkeypatch):
    """Long lists give a star of their groups, short ones their pairs, however the rows come in batches."""
    monkeypatch.setattr(nearcopies, "LIST", 8)
    rng = np.random.default_rng(2)
    h = np.sort(np.repeat(np.arange(40), rng.integers(1, 30, 40)))
    columns = [h, np.arange(len(h)), rng.integers(0, 500, len(h)), np.full(len(h), 50), np.zeros(len(h), np.int64)]
    want_pairs, want_groups = set(), {}
    for k in np.unique(h):
        ids, comp = columns[1][h == k].tolist(), columns[2][h == k].tolist()
        if len(ids) <= 8:
            want_pairs |= {(a, b) for a in ids for b in ids if a < b and columns[2][a] != columns[2][b]}
        elif len(set(comp)) > 1:
            want_groups[k] = set(comp)
    for n in (1, 3, 7, 1000):
        found = list(nearcopies._meeting(0.8)(pa.RecordBatch.from_arrays([pa.array(c[i : i + n]) for c in columns], ["h", "id", "comp", "size", "at"]) for i in range(0, len(h), n)))
        rows = {tuple(r.values()) for b in found for r in b.to_pylist()}
        assert {(a, b) for a, b, least in rows if least is not None} == want_pairs
        stars = {(a, b) for a, b, least in rows if least is None and a != b}
        for own in want_groups.values():
            assert any(own <= {c, *(b for a, b in stars if a == c), *(a for a, b in stars if b == c)} for c in own)


def test_equal_fingerprints_do_not_make_copies(spark):
    rng = random.Random(13)
    rows = [(k, "| " * 600 + text(rng, 400)) for k in range(4)]
    assert max(similarity(rows[0][1], t) for _, t in rows[1:]) < 0.1
    assert {r.doc_id for r in nearcopies.without_near_copies(frame(spark, rows)).collect()} == {0, 1, 2, 3}


def test_repeated_shingles_do_not_hide_copies(spark):
    rng = random.Random(14)
    rows = []
    for k in range(10):
        w = text(rng, 300)
        rows += [(2 * k, w), (2 * k + 1, w + (" " + text(rng, 10)) * 40)]
    # Pairs at 0.80 to 0.85: so many single words differ.
    for k in range(10, 210):
        w = text(rng, 104).split()
        v = list(w)
        v[10] = v[50] = "edit"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    near = [similarity(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(210)]
    assert min(near[:10]) > 0.9 and min(near[10:]) >= 0.8 and max(near[10:]) < 0.85
    got = {r.doc_id: r.group_id for r in nearcopies.near_copies(frame(spark, rows)).collect()}
    assert all(got[2 * k + 1] == 2 * k == got[2 * k] for k in range(210))


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "g h")]
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("row", "id", "digest", "root", "n", "rows", "least", "t", "key", "__text", "__row", "group_id")})
    kept = nearcopies.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a b c d e f"), (1, "g h"), (None, "a b c d e f")], key=repr)
    with pytest.raises(ValueError):
        nearcopies.without_near_copies(docs.withColumn("_gone", F.lit(1)))


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
