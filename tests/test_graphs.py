import itertools
import math
import random

import pytest

from crowdtide.operators import graph_metrics as K


def _edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, weight long")


def _scores(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_pagerank_and_hits_hand_cases(spark):
    pair = _edges(spark, [("a", "b", 2), ("b", "a", 2)])
    assert _scores(K.pagerank(pair), "PageRank") == pytest.approx({"a": 0.5, "b": 0.5})
    fan = _edges(spark, [("a", "b", 1), ("a", "c", 1)])
    scores = K.hits(fan)
    assert _scores(scores, "HubScore") == pytest.approx({"a": 1, "b": 0, "c": 0})
    assert _scores(scores, "AuthorityScore") == pytest.approx({"a": 0, "b": 0.5, "c": 0.5})


def test_hits_moves_no_shares_to_few_authorities(spark, monkeypatch):
    """Scores of few nodes are broadcast to one table of edges; of many, a second one is hashed by target."""
    rng, made = random.Random(3), []
    edges = _edges(spark, [(f"c{rng.randrange(20)}", f"s{rng.randrange(6)}", rng.randrange(1, 5)) for _ in range(80)])
    links = K.Links
    monkeypatch.setattr(K, "Links", lambda *a, **b: made.append(a[1]) or links(*a, **b))
    few = K.hits(edges)
    assert made == ["source"]
    monkeypatch.setattr(K, "SMALL_SIDE", 5)
    many = K.hits(edges)
    assert made[1:] == ["source", "target"]
    for col in ("HubScore", "AuthorityScore"):
        assert _scores(few, col) == pytest.approx(_scores(many, col), abs=1e-9)


def test_hub_pieces_do_not_change_scores(spark):
    """A node with a third of all edges is cut into pieces of five."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(30)]
    rows = {("hub", n): rng.randrange(1, 4) for n in names}
    rows |= {(rng.choice(names), rng.choice([*names, "hub"])): rng.randrange(1, 4) for _ in range(70)}
    edges = _edges(spark, [(s, t, w) for (s, t), w in rows.items()])
    assert K.Links(edges, "source", 5).hubs is not None
    for run, tol, cols in ((K.pagerank, 2e-3, ["PageRank"]), (K.hits, 0.05, ["HubScore", "AuthorityScore"])):
        whole, cut = run(edges, tol=tol), run(edges, tol=tol, piece=5)
        for col in cols:
            assert _scores(cut, col) == pytest.approx(_scores(whole, col), abs=1e-9)
            assert sum(_scores(cut, col).values()) == pytest.approx(1)


def _pagerank_plain(rows, alpha, tol):
    nodes = sorted({n for s, t, _ in rows for n in (s, t)})
    out = {n: sum(w for s, _, w in rows if s == n) for n in nodes}
    x = {n: 1 / len(nodes) for n in nodes}
    delta = math.inf
    while delta >= len(nodes) * tol:
        lost, before = sum(x[n] for n in nodes if not out[n]), x
        x = {
            n: alpha * (sum(x[s] * w / out[s] for s, t, w in rows if t == n) + lost / len(nodes))
            + (1 - alpha) / len(nodes)
            for n in nodes
        }
        delta = sum(abs(x[n] - before[n]) for n in nodes)
    return x


def test_pagerank_with_dangling_nodes(spark):
    rows = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "d", 2), ("b", "a", 1)]
    got = _scores(K.pagerank(_edges(spark, rows), tol=1e-4), "PageRank")
    assert got == pytest.approx(_pagerank_plain(rows, 0.85, 1e-4), abs=1e-12)


def _betweenness_plain(rows):
    """All simple paths, the shortest by weight kept."""
    nodes = sorted({n for s, t, _ in rows for n in (s, t)})
    weight = {(s, t): w for s, t, w in rows if s != t}
    score = dict.fromkeys(nodes, 0.0)
    for a, b in itertools.permutations(nodes, 2):
        best, paths = None, []
        for size in range(len(nodes) - 1):
            for middle in itertools.permutations([n for n in nodes if n not in (a, b)], size):
                steps = list(zip((a, *middle), (*middle, b)))
                if all(s in weight for s in steps):
                    length = sum(weight[s] for s in steps)
                    if best is None or length < best:
                        best, paths = length, []
                    if length == best:
                        paths.append(middle)
        for path in paths:
            for node in path:
                score[node] += 1 / len(paths)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_hand_case(spark):
    line = _edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    got = _scores(K.betweenness(line, node_frac=1.0), "BetweennessCentrality")
    assert got == pytest.approx({"a": 0, "b": 1 / 3, "c": 1 / 3, "d": 0})


def test_betweenness_matches_path_enumeration(spark):
    rng = random.Random(1)
    names = "abcdef"
    rows = {(rng.choice(names), rng.choice(names)): rng.randrange(1, 4) for _ in range(16)}
    rows = [(s, t, w) for (s, t), w in rows.items()]
    n = len({x for s, t, _ in rows for x in (s, t)})
    got = K.betweenness(_edges(spark, rows), node_frac=1.0, state_rows=3 * n, piece=2)
    assert _scores(got, "BetweennessCentrality") == pytest.approx(_betweenness_plain(rows), abs=1e-9)


def test_betweenness_of_a_long_line(spark, monkeypatch):
    monkeypatch.setattr(K, "STEPS_PER_SUM", 2)
    line = _edges(spark, [(f"n{i}", f"n{i + 1}", 1) for i in range(5)])
    got = _scores(K.betweenness(line, node_frac=1.0), "BetweennessCentrality")
    assert got == pytest.approx({f"n{i}": i * (5 - i) / 20 for i in range(6)})


def test_betweenness_rejects_weights_below_one(spark):
    with pytest.raises(Exception, match="weights of at least 1"):
        K.betweenness(_edges(spark, [("a", "b", 0), ("b", "c", 1)]), 1.0).collect()


def test_degree_distributions(spark):
    degrees = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 4)], "id string, degree long")
    got = [tuple(r)[1:] for r in K.degree_cdf(degrees).orderBy("k").collect()]
    assert got == [(0.5, 0.5), (0.25, 0.75), (0.25, 1.0)]
    with pytest.raises(Exception, match="too small"):
        K.log_bin_histogram(degrees).collect()
