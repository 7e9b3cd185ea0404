import math
import random

import numpy as np
import pytest

from tapeworks.llm import hilbert, mtree

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, dim int"


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    x = vectors(900, 6)
    rows = [(k, [float(v) for v in x[k]], 0, 0.0, 0, 0) for k in range(900)]
    hot = rows[7][1]
    rows += [(900 + k, hot, 1, 0.0, 0, 0) for k in range(300)]
    rows += [(2000, None, 0, 0.0, 0, 0), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 0.0, 0, 0), (2040, [math.nan] * 6, 0, 0.0, 0, 0), (2060, [math.inf] * 6, 0, 0.0, 0, 0), (2100, [0.0] * 6, 0, 0.0, 0, 0), (None, hot, 0, 0.0, 0, 0), rows[20], (2200, [1.0, 2.0], 0, 0.0, 0, 0), (2300, [], 0, 0.0, 0, 0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def usable(table, nonzero):
    out = {}
    for r in table.collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v)):
            out[r.vec_id] = v
    return out


def brute(rows, every, k, score):
    out = []
    for q, v in rows.items():
        if q % every == 0:
            found = sorted((-score(v, w), i) for i, w in rows.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_against_brute_force(table, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 100)
    monkeypatch.setattr(mtree, "LEAF", 10)
    monkeypatch.setattr(mtree, "ROUTES", 5)
    monkeypatch.setattr(mtree, "QUERIES", 3)
    rows = {i: [math.floor(1024 * float(x)) for x in v] for i, v in usable(table, False).items()}
    want = brute(rows, 100, 10, lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)))
    assert sorted(tuple(r) for r in mtree.top_k(table).collect()) == want


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(k, [float(rng.randrange(-(2**28), 2**28)) for _ in range(3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(4 * x) for x in v] for i, v in rows}
    want = brute(whole, 10, 7, lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)))
    assert sorted(tuple(r) for r in mtree.top_k(df, 7, 10, 4).collect()) == want


def test_components_beyond_64_bits(spark):
    rows = [(0, [1e15, 2.0]), (10, [-1e15, 1.0]), (20, [1e300, 1.7e308]), (3, [5e14, 1.0]), (4, [0.5, -0.5]), (5, [2.0**70, 0.0]), (6, [-(2.0**70), 3.0])]
    largest = int(np.finfo(float).max)
    whole = {i: [math.floor(x * 1024) if abs(x) < 1e305 else largest for x in v] for i, v in rows}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = brute(whole, 10, 4, lambda v, w: clip(sum(a * b for a, b in zip(v, w, strict=True))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in mtree.top_k(df, 4, 10).collect()) == want


def stored(ids, x):
    """A page of integer vectors, in the space of its own."""
    x = np.asarray(x, float)
    power = int(np.frexp(np.abs(x).max())[1])
    space = mtree.Space(power, float((np.ldexp(x, -power) ** 2).sum(1).max()), np.zeros((1, x.shape[1] + 1)))
    row = mtree.page_row(x.shape[1], 0, list(ids), [v.tobytes() for v in x], space).to_pylist()[0]
    return mtree.Page(x.shape[1], *(row[n] for n in ("centre", "radius", "ids", "vectors", "heads", "starts", "radii", "parents", "gaps"))), space


def test_page_bounds_spare_work():
    x = np.vstack([np.full((200, 4), 1000), np.full((200, 4), -1000)]) + np.random.default_rng(1).integers(-9, 9, (400, 4))
    page, space = stored(range(400), x)
    seen = []
    old = mtree.products
    try:
        mtree.products = lambda a, q: seen.append(len(a)) or old(a, q)
        top = page.search(np.full(4, 900.0), -1, 3, space)
    finally:
        mtree.products = old
    assert sum(seen) < 400
    best = sorted((x @ np.full(4, 900)).tolist())[::-1]
    assert sorted(s for s, _ in top)[::-1] == best[:3]
    assert sorted(s for s, _ in page.search(np.full(4, 900.0), -1, 9, space, best[2])) == sorted(b for b in best if b >= best[2])[-9:] and page.search(np.full(4, 900.0), -1, 3, space, best[0] + 1) == []


def test_pages_are_spared_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 64)
    monkeypatch.setattr(mtree, "LEAF", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    x = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = sorted(tuple(r) for r in mtree.top_k(df, report=report).collect())
    y = np.floor(1024 * x)
    want = []
    for q in range(0, 4000, 100):
        s = (y @ y[q]).astype(int)
        order = [i for i in np.lexsort((np.arange(4000), -s)).tolist() if i != q][:10]
        want += [(q, n + 1, i, int(s[i])) for n, i in enumerate(order)]
    assert got == want and report["pages"] >= 60 and report["visits"] < 0.3 * report["possible"], report


def test_neighbours_recall_and_scores(table):
    rows = usable(table, True)
    want = brute(rows, 20, 20, lambda v, w: float(sum(a * b for a, b in zip(v, w, strict=True))))
    got = sorted(tuple(r) for r in hilbert.neighbours(table).collect())
    pairs = {(q, i) for q, _, i, _ in want}
    assert len({(q, i) for q, _, i, _ in got} & pairs) >= 0.9 * len(pairs)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, _, i, s in got if (q, i) in exact)
    assert len(got) == len(want)


def recall_of(got, x, queries, k=20):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in queries:
        s = x @ x[q]
        s[q] = -9
        hits.append(len(found[q] & set(np.argsort(-s, kind="stable")[:k].tolist())) / k)
    return np.mean(hits)


def test_windows_prune_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(1000, 64))
    x = centres[rng.integers(0, 1000, 30_000)] + 0.2 * rng.normal(size=(30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = hilbert.neighbours(df, every=200, cuts=400, report=report).collect()
    assert recall_of(got, x, range(0, 30_000, 200)) >= 0.9
    assert report[64]["chunks"] >= 50 and report[64]["compared"] < 0.1 and report[64]["recall"] >= 0.95, report



def test_hilbert_curve_steps_by_one():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mtree.top_k(none).count() == 0 and hilbert.neighbours(none).count() == 0


def test_recall_of_queries_in_a_hot_cluster(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    hot = rng.permutation(6000)[:2000]
    x[hot] = x[hot[0]] + 1e-4 * rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = hilbert.neighbours(df, every=40, report=report).collect()
    mine = [q for q in range(0, 6000, 40) if q in set(hot.tolist())]
    assert report[64]["chunks"] >= 50 and recall_of(got, x, mine) >= 0.9 and recall_of(got, x, range(0, 6000, 40)) >= 0.9, report
