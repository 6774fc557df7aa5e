"""Searches against brute force over all pairs."""

import numpy as np
import pandas as pd
import pytest

from crowdtide.llm import mtree, multi_index, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 2) for i, v in rows], SCHEMA)


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def brute(rows, every, k, score):
    want = {}
    for q, v in {i: v for i, v in reversed(rows) if i % every == 0}.items():
        hits = sorted((-score(v, w), i) for i, w in rows if i != q)[:k]
        want[q] = [(i, -s) for s, i in hits]
    return want


def cosine(v, w):
    a, b = np.array(v, np.float64), np.array(w, np.float64)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def product(v, w):
    floor = lambda x: [int(np.floor(256 * float(c))) for c in x]
    return sum(a * b for a, b in zip(floor(v), floor(w)))


def random_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, dim)]) for i in range(n)]


BAD = [
    (1000, None), (1050, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5),
    (1200, []), (1250, [1.0, 2.0]), (None, [1.0] * 6),
]


def test_products_are_exact_with_ties_and_copies(spark, saved):
    rows = random_rows(300, 6, 1)
    rows += [(300 + i, rows[7][1]) for i in range(200)] + [(500, [0.0] * 6), (501, [0.0] * 6)]
    folder = saved(embeddings=table(spark, rows + BAD))
    got = found(mtree.op8_mtree(spark, folder))
    assert got == brute(rows, 50, 5, product)


def test_products_with_fewer_candidates_than_asked(spark, saved):
    rows = [(0, [0.5, -0.25]), (3, [0.1, 0.2]), (50, [-1.0, 2.0])]
    got = found(mtree.op8_mtree(spark, saved(embeddings=table(spark, rows))))
    assert got == brute(rows, 50, 5, product)


def test_products_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 64)
    monkeypatch.setattr(vectors, "QUERIES_PER_TASK", 5)
    rows = random_rows(700, 5, 2)
    frame = spark.createDataFrame([(i, [float(np.floor(256 * x)) for x in v]) for i, v in rows], "vec_id long, x array<double>")
    queries = frame.filter("vec_id % 35 = 0").selectExpr("vec_id AS query_id", "x")
    assert found(mtree.search(frame, queries, 4)) == brute(rows, 35, 4, product)


@pytest.mark.parametrize("large", [40_000.0, 3e5, 2e6])
def test_products_of_large_components(spark, saved, large):
    """Products beyond 53 bits are exact, and no row is left out for its size."""
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in random_rows(300, 6, 7)]
    rng = np.random.default_rng(8)
    for i in rng.choice(300, 120, replace=False):
        rows[i][1][int(rng.integers(6))] = float(np.float32(large * rng.normal()))
    rows += [(300, rows[0][1]), (301, [large] * 6), (302, [large + 2.0] + [large] * 5)]
    assert found(mtree.op8_mtree(spark, saved(embeddings=table(spark, rows)))) == brute(rows, 50, 5, product)


def test_clustered_vectors_leave_pages_closed():
    """Most pages are dismissed by their bounds where the vectors have clusters."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 400, (40, 8))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 8)))
    top = float((x * x).sum(1).max())
    points = np.hstack([x, np.sqrt(top - (x * x).sum(1))[:, None]])
    pages = mtree.build(points)
    none = b""
    frame = pd.DataFrame([
        {
            "page": n, "parent": p.parent, "radius": p.radius, "apart": p.apart, "centre": p.centre.tobytes(),
            "ids": none if p.rows is None else p.rows.tobytes(), "points": none if p.rows is None else points[p.rows].tobytes(),
            "distances": none if p.rows is None else p.distances.tobytes(),
        }
        for n, p in enumerate(pages)
    ])
    opened = []
    for q in range(0, 4000, 500):
        tree = mtree.Tree(frame, 9)
        best = tree.search(np.append(x[q], 0.0)[None], np.array([q]), 5, np.array([np.inf]), top)
        scores = np.where(np.arange(4000) == q, -np.inf, x @ x[q])
        assert best.id.tolist() == np.lexsort((np.arange(4000), -scores))[:5].tolist()
        opened.append(tree.opened / len(pages))
    assert np.mean(opened) < 0.4


def test_pages_cover_their_rows():
    points = np.random.default_rng(3).normal(size=(900, 4))
    points[100:400] = points[5]
    pages = mtree.build(points, page=20, fan=4)
    rows = np.sort(np.concatenate([p.rows for p in pages if p.rows is not None]))
    assert (rows == np.arange(900)).all()
    for p in pages:
        if p.rows is not None:
            away = np.linalg.norm(points[p.rows] - p.centre, axis=1)
            assert np.allclose(away, p.distances) and away.max() <= p.radius + 1e-9
        if p.parent >= 0:
            assert np.isclose(p.apart, np.linalg.norm(p.centre - pages[p.parent].centre))


def recall(got, want):
    """Share of the true hits found: over all queries, and of the worst one."""
    shares = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    return np.mean(shares), min(shares)


def test_neighbours_with_odd_rows(spark, saved):
    rows = random_rows(400, 6, 4)
    rows += [(400 + i, rows[9][1]) for i in range(150)]
    folder = saved(embeddings=table(spark, rows + BAD + [(1300, [0.0] * 6)]))
    got, want = found(multi_index.op1_multi_index(spark, folder)), brute(rows, 50, 5, cosine)
    assert got.keys() == want.keys() and all(len(got[q]) == 5 and q not in {i for i, _ in got[q]} for q in got)
    assert recall(got, want)[0] >= 0.9


def test_a_share_of_one_is_exact(spark):
    rows = random_rows(500, 6, 4)
    rows += [(500 + i, rows[9][1]) for i in range(150)] + [(700 + i, [2 * x for x in rows[9][1]]) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = frame.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v")
    got, want = found(multi_index.search(frame, queries, share=1.0)), brute(rows, 50, 5, cosine)
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


@pytest.mark.parametrize("copies", [0, 5000])
def test_neighbours_recall_through_the_traversal(spark, monkeypatch, copies):
    """Random directions, the hardest case; copies of one vector take nothing from the others' share."""
    monkeypatch.setattr(multi_index, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(vectors, "QUERIES_PER_TASK", 60)
    rows = random_rows(10000, 32, 5)
    rows += [(20000 + i, rows[3][1]) for i in range(copies)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = frame.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "v")
    got = found(multi_index.search(frame, queries, 5))
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.array([i for i, _ in rows])
    want = {}
    for q in got:
        score = np.where(ids == q, -2, v @ v[np.flatnonzero(ids == q)[0]])
        want[q] = [(int(ids[i]), 0) for i in np.lexsort((ids, -np.round(score, 12)))[:5]]
    assert len(got) == 100 + copies // 100 and recall(got, want)[0] >= 0.9


def test_traversal_takes_pairs_in_order():
    rng = np.random.default_rng(6)
    first, second = rng.random(9), rng.random(7)
    counts = np.ones((9, 7), np.int64)
    pairs = multi_index.traverse(first, second, counts, 40)
    sums = [first[i] + second[j] for i, j in pairs]
    assert sums == sorted(sums) and len(set(pairs)) == 40
    assert np.isclose(sums[-1], np.sort((first[:, None] + second).ravel())[39])


@pytest.mark.parametrize("query", [mtree.op8_mtree, multi_index.op1_multi_index])
def test_empty_table(spark, saved, query):
    for rows in ([], [(0, None)]):
        assert query(spark, saved(embeddings=table(spark, rows))).count() == 0


def test_repeated_rows(spark, saved):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    for query in (mtree.op8_mtree, multi_index.op1_multi_index):
        got = found(query(spark, saved(embeddings=table(spark, rows))))
        assert [i for i, _ in got[0]] == [1, 1, 2]
