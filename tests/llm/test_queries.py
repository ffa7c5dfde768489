"""Each query of the text operators on small tables with awkward rows, against SQL or a plain version of its contract."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from waymark.llm import chat, decontam, linededup, pii, queries, secrets, toxicity

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def words(rng, n, pool=300):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def documents():
    """(doc_id, text, source): copies, near copies, shared passages, secrets, personal data, nulls, empties, repeated rows, a long text."""
    rng = random.Random(31)
    rows = [(i, "\n".join(words(rng, rng.choice([3, 12, 40])) for _ in range(rng.choice([1, 2, 9]))), f"s{i % 4}") for i in range(80)]
    passage = "\n".join(words(rng, 12, 10**6) for _ in range(8))
    rows += [(100 + i, f"{words(rng, 20)}\n{passage}\n{words(rng, 9)}", "hot") for i in range(15)]
    rows += [(200 + i, rows[4][1], "hot") for i in range(12)]
    near = words(rng, 300, 10**6).split()
    rows += [(300 + i, " ".join([*near[:i], "edit", *near[i + 1 :]]), "s1") for i in range(6)]
    rows += [(320 + i, f"{words(rng, 15)} mallory wrote from m{i % 2}@mail.example.org at 10.0.0.{i} {words(rng, 15)}", "s2") for i in range(8)]
    rows += [(340 + i, f"call +45 (12) 34-56-78 card 4111 1111 1111 1111 {i} token = 'abcdefghijklmno{i}' AKIAABCDEFGHIJKLMN{i}", "s3") for i in range(3)]
    rows += [(350, "key Zx9aB3dE5aB3dE5aB3dE5aB and 0123456789abcdef01", "s0"), (360, words(rng, 20_000, 5000), "s1")]
    rows += [(370 + i, words(rng, 15) + (" stupid idiot moron" if i % 2 else " kind words here"), "s2") for i in range(60)]
    rows += [(500, None, "s0"), (501, "", None), (502, " \n\t ", "s0"), (503, "é" * 150 + "\U0001f600 ok", "s0"), (3, rows[3][1], "s3"), (3, rows[3][1], "s3"), (None, words(rng, 30), "s0"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    where, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(4)
    rows = documents()
    put = lambda name, **columns: pq.write_table(pa.table(columns), where / f"{name}.parquet")
    put("documents", doc_id=pa.array([r[0] for r in rows], pa.int64()), text=pa.array([r[1] for r in rows], pa.string()), lang=["en"] * len(rows), source=pa.array([r[2] for r in rows], pa.string()), n_chars=[len(r[1] or "") for r in rows])
    put("labels", doc_id=pa.array(list(range(370, 430)), pa.int64()), quality=[1] * 60, toxic=[i % 2 for i in range(60)])
    texts = {r[0]: r[1] for r in rows}
    items = [(k, " ".join(texts[100 + k].split()[5 + k : 40 + k])) for k in range(5)] + [(7, "w1 w2"), (8, None), (9, " .. "), (10, texts[302].upper())]
    put("benchmark", item_id=pa.array([i for i, _ in items], pa.int64()), text=pa.array([t for _, t in items], pa.string()))
    centres = rng.normal(size=(25, 12))
    vectors = [(centres[i % 25] + rng.normal(size=12) * 0.15).astype(np.float32).tolist() for i in range(400)]
    vectors += [vectors[0]] * 30 + [None, [0.0] * 12, [float("nan")] * 12]
    put("embeddings", vec_id=pa.array(range(len(vectors)), pa.int64()), embedding=pa.array(vectors, pa.list_(pa.float32())), label=[0] * len(vectors))
    turns = [(c, t, role, None if (c, t) == (3, 1) else f"### {c} {t} </turn> \\h é") for c in range(12) for t, role in enumerate(("system", "user", "assistant", "assistant")) if (c + t) % 5]
    put("conversations", conv_id=pa.array([x[0] for x in turns], pa.int64()), turn=[x[1] for x in turns], role=[x[2] for x in turns], text=pa.array([x[3] for x in turns], pa.string()))
    return str(where)


def run(spark, tables, name):
    return queries.QUERIES[name](spark, tables)


def same(spark, tables, name, sql, without="false"):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    df = run(spark, tables, name)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    want = found.fetchall()
    key = names.index("doc_id") if "doc_id" in names else None
    # SQL names a document by its id: repeated and null ids are held by the operators' own tests.
    twice = lambda r: key is not None and (r[key] is None or r[key] == 3)
    assert sorted(map(repr, (r for r in got if not twice(r)))) == sorted(map(repr, (r for r in want if not twice(r))))
    assert sum(map(twice, got)) in (0, 5)


def test_op1_line_dedup(spark, tables):
    same(spark, tables, "op1_line_dedup", linededup.OP1_SQL)


def test_op6_secrets(spark, tables):
    same(spark, tables, "op6_secrets", secrets.OP6_SQL)


def test_op7_decontamination(spark, tables):
    same(spark, tables, "op7_decontamination", decontam.OP7_SQL)


def test_op10_chat(spark, tables):
    same(spark, tables, "op10_chat", chat.OP10_SQL)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_op2_substrings(spark, tables):
    seen, want = set(), []
    for doc_id, text, _ in in_order(documents()):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        edges = np.diff(np.r_[0, gone.astype(int)])
        want.append((doc_id, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, tables, "op2_substrings").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(w[2] for w in want) > 10_000


def linked(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[root(a)] = root(b)
    return [root(i) for i in range(n)]


def test_op3_simhash(spark, tables):
    rows, fps = documents(), []
    for _, text, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        n = min(3, len(w))
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else [], np.uint64)
        fps.append(sum(1 << b for b in range(64) if ((h >> np.uint64(b)) & np.uint64(1)).sum() * 2 > len(h)))
    root = linked(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for (d, *_), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, f"{f:016x}", least.get(r)) for (d, *_), f, r in zip(rows, fps, root, strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, tables, "op3_simhash").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_op4_toxicity(spark, tables):
    got = run(spark, tables, "op4_toxicity").collect()
    rows = documents()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # Scores by the plain formula: mean of the weights of all subwords and the neutral vectors, bias, logistic function.
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet").where(~toxicity.held_out(pytest.importorskip("pyspark.sql.functions").col("doc_id")))
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in got if r.doc_id is not None}
    for d, text, _ in rows:
        if d is not None:
            ids = [i for w in decontam.words((text or "").encode()) for i in toxicity.subwords(w)]
            z = model.bias + sum(float(model.weight[i]) for i in ids) / (len(ids) + toxicity.NEUTRAL)
            assert scores[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    held = [d for d in range(370, 430) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([scores[d] for d in held if d % 2]) > np.mean([scores[d] for d in held if not d % 2])


def test_op5_embeddings(spark, tables):
    vectors = pq.read_table(f"{tables}/embeddings.parquet").column("embedding").to_pylist()
    x = np.array([v if v and np.isfinite(v).all() and any(v) else [0.0] * 12 for v in vectors], np.float64)
    size = np.linalg.norm(x, axis=1)
    x = x / np.where(size, size, 1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in run(spark, tables, "op5_embeddings").collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum() > 1000
    root = linked(len(x), [(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    assert all(root[got[i].component_id] == root[i] and got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept for i in (430, 431, 432))


def slow_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [2 * d - 9 * (2 * d > 9) if k % 2 else d for k, d in enumerate(reversed(digits))]
            if (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and sum(double) % 10 == 0, 8 <= len(digits) <= 15)[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_op8_pii(spark, tables):
    rows = documents()
    texts = {t or "" for _, t, _ in rows}
    near, holds = {}, {}
    for t in texts:
        spans = slow_spans(t)
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        for w in {w for *_, w in found}:
            holds.setdefault(w, set()).add(t)
        free = lambda s, e, spans=spans: not any(a < e and s < b for _, a, b in spans)
        for kind, s, e in spans:
            before, after = [w for w in found if w[0] < s][-pii.REACH :], [w for w in found if w[0] >= e][: pii.REACH]
            for a, b, w in before + after:
                if free(a, b):
                    near.setdefault((kind, t[s:e].lower(), w), set()).add(t)
    entity = {}
    for (kind, e, _), where in near.items():
        entity.setdefault((kind, e), set()).update(where)
    reveals = set()
    for (kind, e, w), both in near.items():
        bits = math.log2(len(both) * len(texts) / (len(entity[kind, e]) * len(holds[w])))
        if len(both) >= pii.SUPPORT and len(both) >= pii.DISCLOSURE * len(holds[w]) and bits >= pii.INFORMATION:
            reveals.add(w)
    assert "mallory" in reveals or "wrote" in reveals
    want = []
    for d, t, _ in rows:
        base = slow_spans(t or "")
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in reveals and not any(a < m.end() and m.start() < b for _, a, b in base)]
        listed = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        want.append((d, *[sum(k == n for k, *_ in base) for n in range(4)], hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + [f"term:{s}:{e}" for s, e in terms])))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in run(spark, tables, "op8_pii").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_op9_packing(spark, tables):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t, _ in documents():
        want.setdefault(d, []).append([*exact.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = run(spark, tables, "op9_packing").collect()
    for d, lists in want.items():
        own = [p for p in pieces if p.doc_id == d]
        assert sum(p.length for p in own) == sum(map(len, lists)) and sorted({p.doc_tokens for p in own}) == sorted({len(x) for x in lists})
        for p in own:
            assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in lists)
        if len(lists) == 1:
            own.sort(key=lambda p: p.start)
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
    padded = sum(2048 - n for own in by_seq.values() if (n := sum(p.length for p in own)).bit_count() > 1)
    assert padded == 0
