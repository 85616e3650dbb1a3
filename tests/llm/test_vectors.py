"""Shards, clusters and whitening against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tablekeep.llm import common, heap_kmeans, kd_shards, queries, vectors, whitening

from .conftest import EDGE, make_docs

SF0001 = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id string, cluster string, vector string"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)


# --- shards

def crc_rows(rows):
    return Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


def brute_tree(points, first, shares, whole, out):
    """The same cuts in one process: points are (key of dims, h1, t, weight, ref)."""
    if shares == 1 or not points:
        for p in points:
            out[first].append(p[-1])
        return
    sides = [(min(p[0][d] for p in points), max(p[0][d] for p in points)) for d in range(4)]
    whole = whole or [max(1, b - a) for a, b in sides]
    dim = max(range(4), key=lambda d: (sides[d][1] - sides[d][0]) / whole[d])
    key = lambda p: (p[0][dim], p[1], p[2])
    weights = Counter()
    for p in points:
        weights[key(p)] += p[3]
    left = shares // 2
    target, before, cut = sum(weights.values()) * left / shares, 0, None
    for k in sorted(weights):
        if before > target:
            break
        cut = (k, target - before > before + weights[k] - target)
        before += weights[k]
    below = [p for p in points if key(p) < cut[0] or (key(p) == cut[0] and cut[1])]
    above = [p for p in points if not (key(p) < cut[0] or (key(p) == cut[0] and cut[1]))]
    brute_tree(below, first, left, whole, out)
    brute_tree(above, first + left, shares - left, whole, out)


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_tree_against_brute_force(spark, shards):
    docs = common.load(spark, SF0001, "documents")
    rows = kd_shards.points(docs)
    total = rows.selectExpr("sum(n * size)").first()[0]
    keyed = common.stage(kd_shards.keyed(rows, total / shards), "test-keyed")
    points = [((r.d0, r.d1, r.d2, r.d3), r.h1, r.t, r.m * r.size, (r.doc_id, r.piece)) for r in keyed.collect()]
    want = defaultdict(list)
    brute_tree(points, 0, shards, None, want)
    got = defaultdict(list)
    for r in kd_shards.tree(keyed, shards, 0.0).collect():
        got[r.node].append((r.doc_id, r.piece))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_shards_edge_rows(spark, edge, empty):
    rows = kd_shards.shard_report(edge, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == crc_rows(EDGE)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards.shard_report(empty, 4).count() == 0
    texts = kd_shards.shard_documents(edge, 4).collect()
    assert Counter((r.doc_id, r.text) for r in texts) == Counter(EDGE)
    assert {r.shard for r in kd_shards.shard_documents(edge, target_bytes=1 << 30).collect()} == {0}


def test_shards_of_hot_groups_are_even(spark):
    hot = [(7, "one row many times over " * 4)] * 4000 + [(i, "a text that many rows share " * 5) for i in range(3000)]
    cold = [(10_000 + i, f"text {i} " * (5 + i % 40)) for i in range(4000)]
    pairs = [(20_000 + i, f"pair {i // 2} " * 9) for i in range(400)]
    rows = kd_shards.shard_report(make_docs(spark, hot + cold + pairs).repartition(4), 8).collect()
    assert len(rows) == len(hot + cold + pairs)
    size, shards = Counter(), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        shards[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(s - mean) < 0.03 * mean for s in size.values())
    small = {zlib.crc32(t.encode()) for _, t in pairs}
    assert all(len(shards[c]) == 1 for c in small)


# --- clusters

def brute_clusters(rows, k, rounds, dims, seed=3):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda p: ((0, hashlib.sha256(f"{seed}:{p[0]}".encode()).hexdigest()) if p[0] is not None else (1, ""), p[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, own) if o == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def spread(n, dims, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dims))
    return [(i, (middle[i % 6] + 0.35 * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


ODD = [(1, None), (2, []), (3, [1.0, float("nan"), 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, 2.0]), (6, [float("inf"), 0.0, 0.0])]


def test_clusters_against_brute_force(spark):
    ties = [(100 + i, [float(x), float(y), 0.0]) for i, (x, y) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2), (1, 1), (1, 1), (1, 0), (0, 1)] * 3)]
    rows = ODD + ties + [(None, [0.5, 0.5, 0.5]), (100, [0.0, 0.0, 0.0])] + [(1000 + i, v) for i, v in spread(600, 3)]
    for k, rounds in ((5, 6), (8, 1), (1, 2), (3, 0)):
        found = heap_kmeans.cluster(make_vectors(spark, rows), "vec_id", "embedding", k=k, rounds=rounds, dims=3)
        want, centroids = brute_clusters(rows, k, rounds, 3)
        assert Counter(map(tuple, found.assigned.collect())) == Counter(want)
        assert found.centroids.at.tolist() == centroids


def test_heaps_pop_less_and_lose_nothing(spark):
    rows = spread(3000, 4)
    found = heap_kmeans.cluster(make_vectors(spark, rows), "vec_id", "embedding", k=6, rounds=12, dims=4)
    assert Counter(map(tuple, found.assigned.collect())) == Counter(brute_clusters(rows, 6, 12, 4)[0])
    assert found.popped[0] == 3000 and min(found.popped) < 1500


def test_clusters_of_few_or_no_vectors(spark):
    assert heap_kmeans.cluster_report(make_vectors(spark, [])).count() == 0
    assert heap_kmeans.cluster_report(make_vectors(spark, ODD)).count() == 0
    one = [(9, [0.25] * 64), (9, [0.25] * 64)]
    got = heap_kmeans.cluster_report(make_vectors(spark, one + ODD)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got] == [(9, 0, 0, 0, 0)] * 2
    assert got[0].centroid_sha256 == hashlib.sha256(",".join(["256"] * 64).encode()).hexdigest()


def test_cluster_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF0001}/embeddings.parquet'")
    want = Counter(con.execute(heap_kmeans.report_sql()).fetchall())
    assert Counter(map(tuple, queries.op12_heap_clusters(spark, SF0001).collect())) == want


def test_large_components_are_exact_or_refused():
    x = np.array([[1 << 26, -(1 << 26)], [3, 4]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in x] for p in x]
    assert heap_kmeans.squared_distances(x, x).tolist() == want
    import pyarrow as pa
    with pytest.raises(ValueError, match="do not fit"):
        vectors.whole(pa.array([[1e9, 0.0]]), 2)


# --- whitening

def test_positive_pivots_count_eigenvalues():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 20):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T
            if rng.random() < 0.5:
                np.fill_diagonal(a, 0)
            e = np.linalg.eigvalsh(a)
            if np.abs(e).min() > 1e-9:
                assert whitening.positive_pivots(a) == (e > 0).sum()
    assert whitening.positive_pivots(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", [[9, 7, 5, 3, 2, 1, 0.5, 0.1, 0.01, 0], [4] * 10, [5, 5, 5, 2, 2, 1, 1, 1, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5, 0.1, 0, 0, 0, 0],
                                    [1e6, 1, 1e-3, 0, 0, 0, 0, 0, 0, 0], [0] * 10])
def test_leading_eigenpairs(values):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    a = (q * np.array(values)) @ q.T
    a = (a + a.T) / 2
    pairs = whitening.Spectrum(a).leading(8)
    want = [v for v in values if v > 1e-11 * max(values)][:8] if max(values) else []
    assert len(pairs) == len(want)
    assert np.allclose([e for e, _ in pairs], want, rtol=1e-9, atol=1e-13 * max(values + [1e-300]))
    v = np.array([w for _, w in pairs]).reshape(-1, 10)
    assert np.abs(v @ v.T - np.eye(len(v))).max(initial=0) < 1e-10
    assert all(np.linalg.norm(a @ w - e * w) < 1e-12 * max(values) for e, w in pairs)


def check_whitening(rows, got):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = Counter()
    for (i, _), row in zip(rows, ((n * x - s) ** 2).sum(axis=1)):
        deviation[i, int(row)] += 1
    f = (n * x - s).astype(float) / n
    e, q = np.linalg.eigh(f.T @ f / n)
    e, q = e[::-1], q[:, ::-1]
    m = min(8, int((e > 1e-9 * e[0]).sum()))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    assert len(got) == m * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, m + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    for c in range(1, m + 1):
        mine = sorted((r.vec_id, r.whitened) for r in got if r.component == c)
        assert np.allclose([r.explained for r in got if r.component == c], e[c - 1] / e.sum(), rtol=1e-9)
        want = sorted((i, z) for (i, _), z in zip(rows, f @ q[:, c - 1] / np.sqrt(e[c - 1])))
        a, b = np.array([z for _, z in mine]), np.array([z for _, z in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_against_numpy(spark):
    rows = [(i, (np.array(v) * np.arange(1, 11)).astype(np.float32).tolist()) for i, v in spread(400, 10)]
    odd = [*ODD, (7, [float("nan")] * 10), (8, [None] * 10)]
    check_whitening(rows, whitening.whitening_report(make_vectors(spark, rows + odd)).collect())


def test_whitening_of_the_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in common.load(spark, SF0001, "embeddings").collect()]
    check_whitening(rows, queries.op13_whitening(spark, SF0001).collect())


def test_whitening_of_flat_or_no_vectors(spark):
    assert whitening.whitening_report(make_vectors(spark, [])).count() == 0
    assert whitening.whitening_report(make_vectors(spark, ODD[:2])).count() == 0
    assert whitening.whitening_report(make_vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(50)]  # one direction only
    got = whitening.whitening_report(make_vectors(spark, line + [(None, [3.0, 6.0, 0.0])] * 2)).collect()
    assert {r.component for r in got} == {1} and len(got) == 52 and got[0].identity_error < 1e-9
    assert abs(got[0].explained - 1) < 1e-12


def test_exact_sums_beyond_doubles():
    model = whitening.Whitening(10**7, [10**12 + 3] * 4, np.ones(1), np.ones((4, 1)), 1.0)
    x = np.array([[100000 + 70000, 100001, 99999, 12345], [1, 2, 3, 4]], np.int64)
    want = [sum((10**7 * int(v) - (10**12 + 3)) ** 2 for v in row) for row in x]
    assert model.deviations(x) == want
