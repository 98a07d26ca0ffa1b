"""Operators 11 to 13 against brute force, with edge rows, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import embedding_dedup as ED, hard_negatives as HN, resampling as RS
from corpusloom.llm.common import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, score long, node string, cell long, keys array<int>, rank int, v double"


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# 12: importance resampling


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=900), st.lists(st.tuples(st.integers(0, 899), st.integers(1, 900)), min_size=1, max_size=20))
def test_span_crcs(data, spans):
    spans = [(a % len(data), n) for a, n in spans]
    start = np.array([a for a, _ in spans])
    end = np.array([min(len(data), a + n) for a, n in spans])
    got = RS.span_crcs(np.frombuffer(data, np.uint8), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]


@pytest.mark.parametrize("piece", [40, 700, 1 << 20])
@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 5)])
def test_features_piece_by_piece(monkeypatch, piece, least, most):
    """Runs never cross texts, and pieces neither lose nor repeat a run, also where one word is longer than pieces."""
    monkeypatch.setattr(RS, "PIECE", piece)
    draw = random.Random(piece * 10 + most)
    texts = ["", "a", "A b", "x" * 900 + " y " + "é" * 700, "  ", "漢字"] + ["".join(draw.choice("abXY09 \n.,é漢😀İ\x7f") for _ in range(draw.randrange(250))) for _ in range(80)] + [""]
    features = RS.Features(least, most, 997)
    n_words, found = [0] * len(texts), [[] for _ in texts]
    for of, buckets, word in features.of(*RS._bytes(pa.array(["skipped", *texts])[1:])):
        for i in word:
            n_words[i] += 1
        for i, b in zip(of, buckets):
            found[i].append(b)
    for i, t in enumerate(texts):
        w = plain_words(t)
        want = [zlib.crc32(" ".join(w[k:k + n]).encode()) % 997 for n in range(least, most + 1) for k in range(len(w) - n + 1)]
        assert n_words[i] == len(w) and sorted(found[i]) == sorted(want)


def brute_scores(docs, bench, least_words=20):
    buckets = lambda t: [zlib.crc32(w.encode()) % 10000 for w in plain_words(t)]
    own = [(i, buckets(t)) for i, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, f in own:
        for b in f:
            s[b] += 1
    for x in bench:
        for b in buckets(x):
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def test_resampling_query_is_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute_scores(docs, bench)
    eligible = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(eligible[:10 * len(eligible) // 100])}
    got = QUERIES["op12_importance_resampling"](spark, sf)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted((*r, rank.get(r[0])) for r in want) and rank


def test_resampling_edges(spark):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice("ab bc cd de ef".split()) for _ in range(n))
    texts = [None, "", "  ", text(19), text(20), "Wort " * 30_000, "x" * 300_000] + [text(40)] * 3 + [text(25) for _ in range(30)]
    rows = [(None if k == 12 else 5 if k in (7, 8, 9) else k, t, 1, 2, 3, 4) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight int, rank int, doc int, t int")
    target = spark.createDataFrame([("ab ab",), (None,), ("",)], "text string")
    got = RS.scored(docs, target, share=(50, 100)).select("doc.*", "n_words", F.col("weight").alias("w"), "score", F.col("rank").alias("r")).collect()
    want = brute_scores([(r[0], r[1]) for r in rows], ["ab ab"])
    assert sorted((str(g["doc_id"]), g["n_words"], g["w"], g["score"]) for g in got) == sorted((str(w[0]), *w[1:]) for w in want)
    drawn = sorted((g for g in got if g["r"] is not None), key=lambda g: g["r"])
    eligible = sum(w[1] >= 20 for w in want)
    assert [g["r"] for g in drawn] == list(range(1, eligible // 2 + 1))
    keys = sorted(((-w[3], w[0] is None, w[0] or 0) for w in want if w[1] >= 20))
    assert [(-g["score"], g["doc_id"] is None, g["doc_id"] or 0) for g in drawn] == keys[:eligible // 2]
    kept = RS.sample(docs, target, share=(50, 100))
    assert kept.columns == docs.columns and kept.count() == eligible // 2
    assert RS.scored(docs.limit(0), target).count() == 0 and RS.scored(docs, target.limit(0)).count() == len(rows)


# 13: near-duplicate vectors


def brute_links(rows, least):
    good = {k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = [set() for _ in rows]
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, w = (np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in (a, b))
                if u @ w / math.sqrt((u @ u) * (w @ w)) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                todo += [x for x in near[todo.pop()] if x not in group and not group.add(x)]
            seen |= group
            first = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
            for x in group:
                out[x] = (rows[x][0], len(near[x]), first, rows[x][0] == first)
    return sorted(out, key=str)


def crowd(seed, n, dim=16, spread=0.02):
    """Vectors around a few centres: chains, hot clusters, copies."""
    g = np.random.default_rng(seed)
    centres = g.standard_normal((4, dim))
    pick = np.minimum(g.geometric(0.6, n) - 1, 3)
    return (centres[pick] + spread * g.standard_normal((n, dim)) * g.choice([0, 1, 3], (n, 1))).tolist()


def test_near_vectors_edges(spark, monkeypatch):
    monkeypatch.setattr(ED, "BLOCK", 40)  # buckets of several blocks
    monkeypatch.setattr(ED, "SMALL", 12)
    odd = [None, [], [0.0, 0.0], [NAN, 1.0], [INF, 1.0], [None, 1.0], [1e300, 2e300], [1e-300, 2e-300], [-1.0, -2.0], [1.0, 2.0], [1.0, 2.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    rows = [(k, v, 1) for k, v in enumerate(odd)]
    rows += [(100 + k, v, k % 2) for k, v in enumerate(crowd(5, 260))]
    rows += [(7, [3.0, 6.0], 1), (8, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (400, crowd(5, 1)[0], 0)]
    df = spark.createDataFrame([(*r, 1, "n", 2, [3], 4, 5.0) for r in rows], VECTORS)
    planes = ED.Planes(tables=24, bits=6)
    got = sorted(map(tuple, ED.near_vectors(df, planes=planes).collect()), key=str)
    want = [(i, n, c, True if i is None else kept) for i, n, c, kept in brute_links(rows, 0.98)]
    assert got == want
    assert ED.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_recall_and_precision(spark, sf):
    """With the query's own planes on the given vectors and disturbed copies of them: no link too many, nearly none missing."""
    given = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    g = np.random.default_rng(1)
    near = [(10_000 + i, (np.array(v) + 0.024 * g.standard_normal(len(v)) * np.linalg.norm(v)).tolist(), lab) for i, v, lab in given[:250]]
    rows = given + near
    got = ED.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = {r[0]: r[1] for r in brute_links(rows, 0.98)}
    assert all(r.n_links <= want[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * sum(want.values()) > 100
    query = QUERIES["op13_embedding_near_dedup"](spark, sf).collect()
    assert sorted(map(tuple, query), key=str) == brute_links(given, 0.98)


# 11: hard negatives


def brute_mine(rows, every, positives=5, negatives=3, low=(50, 100), high=(95, 100)):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [r for k, r in enumerate(good) if r not in good[:k]]
    out = []
    for a in good:
        if a[0] % every == 0:
            scored = [(-sum(x * y for x, y in zip(a[1], r[1])), r) for r in good if r is not a and len(r[1]) == len(a[1])]
            scored.sort(key=lambda s: (s[0], s[1][0]))
            for sp, p in [s for s in scored if s[1][2] == a[2]][:positives]:
                inside = [(s, r) for s, r in scored if r[2] != a[2] and low[0] * -sp <= low[1] * -s and high[1] * -s <= high[0] * -sp]
                out += [(a[0], p[0], k + 1, r[0], -sp, -s) for k, (s, r) in enumerate(inside[:negatives])]
    return sorted(out)


def test_mining_query_is_brute_force(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    got = QUERIES["op11_hard_negatives"](spark, sf)
    assert sorted(map(tuple, got.collect())) == brute_mine(rows, 50)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_mining_edges(spark, monkeypatch):
    """Ties, repeated rows, negative and equal scores, several blocks and cells, few positives, vectors that take no part."""
    monkeypatch.setattr(HN, "ANCHORS", 7)
    monkeypatch.setattr(HN, "ROWS", 50)
    monkeypatch.setattr(HN, "STEP", 16)
    g = np.random.default_rng(2)
    rows = [(k, (g.integers(-3, 6, 3) / 4.0).tolist(), int(g.integers(0, 3))) for k in range(240)]
    odd = [None, [NAN, 1.0, 1.0], [INF, 1.0, 1.0], [None, 1.0, 1.0], [], [1.0, 1.0], [0.0, 0.0, 0.0]]
    rows += [(300 + k, v, 1) for k, v in enumerate(odd)] + [(310, [1.0, 1.0], 2), (None, [1.0, 1.0, 1.0], 1), (320, [1.0, 1.0, 1.0], None), (330, [1.0, 1.0, 1.0], 9)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, 1, "n", 2, [3], 4, 5.0) for r in rows], VECTORS)
    got = sorted(map(tuple, HN.mine(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_mine(rows, 10) and len({r[0] for r in got}) > 15
    got = sorted(map(tuple, HN.mine(df, F.col("vec_id") % 10 == 0, positives=9, negatives=5, low=(0, 1), high=(1, 1)).collect()))
    assert got == brute_mine(rows, 10, 9, 5, (0, 1), (1, 1))
    assert HN.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_products_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 5.0], [-(2.0**80), 1.0]])
    assert HN.products(a, b).tolist() == [[HN.MOST, -HN.MOST]] and HN.products(a / 2**20, b[:1] / 2**20).dtype == np.float64
    big = np.array([[2.0**31, 1.0]])
    assert HN.products(big, np.array([[2.0**31 - 1, 7.0]])).tolist() == [[2**62 - 2**31 + 7]]
