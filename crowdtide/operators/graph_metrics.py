"""Node metrics and degree distributions of directed weighted graphs.

Edge tables are laid out once, hashed by the joined end and kept for all rounds. A hub may
have a third of all edges, so the edges of every large node are cut into numbered pieces and
its (one-row) state is copied to each piece; no task ever holds all edges of a hub.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crowdtide.operators.graph_build import nodes_of
from crowdtide.operators.scale import hash_rank, ordered_index
from crowdtide.operators.shortest_paths import Core, summed
from crowdtide.scratch import Rounds, materialize

HUB_PIECE = 100_000  # edges per piece of a hub
EDGES_PER_TASK = 100_000  # tasks grow in number with the edges, not in size
WIDE_TASK = 2_000_000  # of scores that are summed in a task before they are sent
SMALL_SIDE = 500_000  # nodes whose scores are broadcast
STEPS_PER_SUM = 16  # tables of a walk that are kept apart
CORE_EDGES = 5_000_000  # edges between entered nodes that every task holds
CORE_NODES = 2_000_000
SOURCE_BATCHES = 4  # batches of sources in a task


class NotConvergedError(ArithmeticError):
    """An iteration reached its last round before its scores settled."""


class Links:
    """Edges hashed by (``end``, piece); pieces of a node hold about ``piece`` edges each."""

    def __init__(self, edges: DataFrame, end: str, piece: int = HUB_PIECE, wide: bool = False):
        self.end, other = end, "target" if end == "source" else "source"
        counts = edges.groupBy(end).agg(F.count(F.lit(1)).alias("_c"))
        hubs = counts.filter(F.col("_c") > piece).select(
            F.col(end).alias("id"), F.ceil(F.col("_c") / piece).cast("int").alias("_pieces")
        )
        hubs = materialize(hubs, "hubs")
        self.hubs = None if hubs.isEmpty() else hubs
        self.keys = [end]
        if self.hubs is not None:
            self.keys.append("_piece")
            spot = F.coalesce(F.pmod(F.xxhash64(other), "_pieces"), F.lit(0)).cast("int")
            edges = (
                edges.join(self.hubs, F.col(end) == F.col("id"), "left")
                .withColumn("_piece", spot)
                .drop("id", "_pieces")
            )
        rows = edges.count()
        parts = max(1, math.ceil(rows / EDGES_PER_TASK))
        if wide:  # larger tasks sum more before they send, but no core is left idle
            parts = min(parts, max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / WIDE_TASK)))
        ordered = edges.repartition(parts, *self.keys).sortWithinPartitions(*self.keys)
        self.table = ordered.persist(StorageLevel.MEMORY_AND_DISK)
        self.table.count()  # a filled cache has a known layout, so rounds neither shuffle nor sort edges

    def join(self, state: DataFrame) -> DataFrame:
        """Edges with the state(id, …) of their ``end``; hubs' state is copied per piece."""
        if self.hubs is not None:
            piece = F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
            state = state.join(self.hubs, "id", "left").withColumn("_piece", piece).drop("_pieces")
        state = state.withColumnRenamed("id", self.end)
        return self.table.join(state, self.keys).drop("_piece")

    def close(self) -> None:
        self.table.unpersist()


def degrees(edges: DataFrame, mode: str = "in") -> DataFrame:
    """Edges per node, without weights; nodes without such edges do not appear."""
    ends = {"in": ["target"], "out": ["source"], "all": ["source", "target"]}[mode]
    return (
        edges.select(F.explode(F.array(*ends)).alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def pagerank(
    edges: DataFrame,
    alpha: float = 0.85,
    tol: float = 1e-8,
    max_rounds: int = 100,
    piece: int = HUB_PIECE,
) -> DataFrame:
    """(id, PageRank) of a weighted graph; nodes without out-edges spread their rank evenly.

    Rounds end when the ranks change by less than ``nodes · tol`` in sum; if ``max_rounds`` do not
    get there, that is an error. Every round writes
    its ranks, one row per node, so plans stay short and lost executors cost one round; the
    change and the rank of nodes without out-edges are read off that table.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark, "pagerank")
    out = edges.groupBy(F.col("source").alias("id")).agg(F.sum("weight").alias("_out"))
    nodes, size = Rounds(spark, "nodes").write(
        nodes_of(edges).join(out, "id", "left"),
        n=F.count(F.lit(1)),
        lost=F.count_if(F.col("_out").isNull()),
    )
    n = size["n"]
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("PageRank"))
    links = Links(edges, "source", piece)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    lost, delta, done = size["lost"] / n, math.inf, 0
    try:
        while done < max_rounds and delta >= n * tol:
            ranks, seen = rounds.write(
                _pagerank_round(links, ranks, lost, n, alpha),
                delta=F.sum("_delta"),
                lost=F.sum(F.when(F.col("_out").isNull(), F.col("rank")).otherwise(0.0)),
            )
            lost, delta = seen["lost"], seen["delta"]
            done += 1
    finally:
        links.close()
    if delta >= n * tol:
        raise NotConvergedError(f"PageRank still changes by {delta} after {max_rounds} rounds")
    return ranks.select("id", F.col("rank").alias("PageRank"))


def _pagerank_round(links: Links, ranks: DataFrame, lost: float, n: int, alpha: float) -> DataFrame:
    share = ranks.filter("_out IS NOT NULL").select("id", (F.col("rank") / F.col("_out")).alias("_share"))
    received = (
        links.join(share)
        .groupBy(F.col("target").alias("_to"))
        .agg(F.sum(F.col("_share") * F.col("weight")).alias("_in"))
    )
    rank = alpha * F.coalesce("_in", F.lit(0.0)) + F.lit((1 - alpha + alpha * lost) / n)
    return ranks.join(received, F.col("id") == F.col("_to"), "left").select(
        "id", "_out", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("_delta")
    )


def hits(edges: DataFrame, tol: float = 1e-6, max_rounds: int = 100, piece: int = HUB_PIECE) -> DataFrame:
    """(id, HubScore, AuthorityScore), each summing to 1, by weighted power rounds.

    Scores that still change by ``tol`` after ``max_rounds`` are an error. A round goes from
    hub scores over authorities to new hub scores in one plan; only the
    nodes that can be hubs, those with out-edges, are kept between rounds. Where at most ``SMALL_SIDE`` nodes
    have in-edges their scores are broadcast to the edges by source, so a round does not move the hubs' shares.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark, "hits")
    hubs, size = Rounds(spark, "nodes").write(edges.select(F.col("source").alias("id")).distinct(), n=F.count(F.lit(1)))
    if size["n"] == 0:
        return hubs.select("id", F.lit(0.0).alias("HubScore"), F.lit(0.0).alias("AuthorityScore"))
    n = nodes_of(edges).count()
    few = edges.select("target").distinct().count() <= SMALL_SIDE
    by_source = Links(edges, "source", piece, wide=True)
    by_target = None if few else Links(edges, "target", piece)
    # The first round starts from 1/n at all nodes; those without out-edges add nothing.
    hubs = hubs.withColumn("h", F.lit(1.0 / n))
    done, delta = 0, math.inf
    try:
        while done < max_rounds and delta >= tol:
            authorities = _authorities(by_source, hubs)
            if by_target is None:
                met = by_source.table.join(F.broadcast(authorities.withColumnRenamed("id", "target")), "target")
            else:
                met = by_target.join(authorities)
            raw = (
                met.groupBy(F.col("source").alias("id"))
                .agg(F.sum(F.col("a") * F.col("weight")).alias("_raw"))
            )
            both = hubs.select("id", F.col("h").alias("_old")).join(raw, "id")
            table, seen = rounds.write(both, total=F.sum("_raw"))
            fresh = F.col("_raw") / seen["total"]
            delta = table.agg(F.sum(F.abs(fresh - F.col("_old")))).first()[0]
            if done == 0:  # nodes that are no hubs fall from 1/n to 0
                delta += (n - size["n"]) / n
            hubs = table.select("id", fresh.alias("h"))
            done += 1
        if delta >= tol:
            raise NotConvergedError(f"hub scores still change by {delta} after {max_rounds} rounds")
        authorities, seen = Rounds(spark, "authorities").write(
            _authorities(by_source, hubs), total=F.sum("a")
        )
    finally:
        by_source.close()
        if by_target is not None:
            by_target.close()
    scores = hubs.join(authorities, "id", "full_outer")
    return scores.select(
        "id",
        F.coalesce("h", F.lit(0.0)).alias("HubScore"),
        F.coalesce(F.col("a") / seen["total"], F.lit(0.0)).alias("AuthorityScore"),
    )


def _authorities(by_source: Links, hubs: DataFrame) -> DataFrame:
    return (
        by_source.join(hubs)
        .groupBy(F.col("target").alias("id"))
        .agg(F.sum(F.col("h") * F.col("weight")).alias("a"))
    )


def betweenness(
    edges: DataFrame,
    node_frac: float = 0.5,
    seed: int = 42,
    state_rows: int = 1_000_000_000,
    piece: int = HUB_PIECE,
    core_edges: int = CORE_EDGES,
) -> DataFrame:
    """(id, BetweennessCentrality) with weights as distances, from a seeded share of sources.

    Where the edges that do not leave a source from outside are at most ``core_edges``, every task holds them
    and takes its own sources, so that nothing is moved per source but its edges. Larger graphs
    run in batches of sources; a batch holds at most one row per (source, node), and its number
    of sources keeps that under ``state_rows``. Within a batch all sources advance together:
    distances by rounds of relaxation, then path counts forwards and dependencies backwards
    along shortest-path edges.
    """
    spark = edges.sparkSession
    too_short = F.raise_error(F.lit("betweenness needs weights of at least 1")).cast("long")
    proper = edges.filter("source <> target").withColumn(
        "weight", F.when(F.col("weight") >= 1, F.col("weight").cast("long")).otherwise(too_short)
    )
    nodes = materialize(nodes_of(edges), "nodes")
    n = nodes.count()
    k = math.floor(n * node_frac)
    if n <= 2 or k == 0:
        return nodes.select("id", F.lit(0.0).alias("BetweennessCentrality"))
    sources = hash_rank(nodes, [], "id", seed, "_rank").filter(F.col("_rank") < k)
    scale = n / k / ((n - 1) * (n - 2))

    def scaled(total: DataFrame) -> DataFrame:
        return nodes.join(total, "id", "left").select(
            "id", (F.coalesce("delta", F.lit(0.0)) * scale).alias("BetweennessCentrality")
        )

    proper = materialize(proper, "proper")
    total = _dependencies_in_tasks(proper, materialize(sources.select(F.col("id").alias("s")), "sources"), core_edges)
    if total is not None:
        return scaled(total)
    # Batches by hash: even, and the number of a source needs no global order.
    batches = math.ceil(k / max(1, state_rows // n))
    sources = materialize(
        sources.select(F.col("id").alias("s"), F.pmod(F.xxhash64("id"), F.lit(batches)).alias("_b")),
        "sources",
    )
    links = Links(proper, "source", piece)
    total, sums = None, Rounds(spark, "dependencies")
    try:
        for number in range(batches):
            start = sources.filter(F.col("_b") == number).select("s")
            part = _dependencies(links, start)
            if total is not None:
                part = part.unionByName(total).groupBy("id").agg(F.sum("delta").alias("delta"))
            total, _ = sums.write(part)
    finally:
        links.close()
    return scaled(total)


def _dependencies_in_tasks(edges: DataFrame, sources: DataFrame, core_edges: int) -> DataFrame | None:
    """(id, delta) as ``_dependencies``, by tasks that hold the core; none if there is more of it."""
    spark = edges.sparkSession
    entered = materialize(edges.select(F.col("target").alias("id")).distinct(), "entered")
    inner = materialize(edges.join(entered, F.col("source") == F.col("id"), "left_semi"), "core")
    count = entered.count()
    if count > CORE_NODES or inner.count() > core_edges:
        return None
    numbers = materialize(ordered_index(entered, ["id"], "v").select("id", F.col("v").cast("int").alias("v")), "numbers")
    number = {end: numbers.select(F.col("id").alias(end), F.col("v").alias(at)) for end, at in (("source", "_u"), ("target", "v"))}
    found = inner.join(number["source"], "source").join(number["target"], "target").select("_u", "v", "weight").toArrow()
    # A source that is entered has its edges in the core; the others bring theirs along.
    inside = sources.join(numbers, F.col("s") == F.col("id")).select(
        "s", F.col("v").alias("own"), F.array().cast("array<struct<v:int,weight:bigint,n:bigint>>").alias("firsts")
    )
    outside = (
        sources.join(entered, F.col("s") == F.col("id"), "left_anti")
        .join(edges, F.col("s") == F.col("source"))
        .join(number["target"], "target")
        .groupBy("s", "v", "weight").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("s").agg(F.collect_list(F.struct("v", "weight", "n")).alias("firsts"))
        .select("s", F.lit(None).cast("int").alias("own"), "firsts")
    )
    starts = materialize(inside.unionByName(outside), "starts")
    size = starts.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("firsts", lambda e: e["weight"])))).first()
    core = Core(*(found.column(c).to_numpy() for c in range(3)), count, size[1] or 0)
    shared, cores = spark.sparkContext.broadcast(core), spark.sparkContext.defaultParallelism
    parts = max(1, min(size[0], 4 * cores), math.ceil(size[0] / (SOURCE_BATCHES * core.batch)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(shared.value, batches)

    tasks = starts.repartition(parts, "s").select("own", "firsts").mapInArrow(add_up, "v int, delta double")
    sums = materialize(tasks.groupBy("v").agg(F.sum("delta").alias("delta")), "dependencies")
    return sums.join(numbers, "v").select("id", "delta")


def _dependencies(links: Links, start: DataFrame) -> DataFrame:
    """(id, delta): dependency of the sources in ``start(s)`` on every node, summed."""
    spark = start.sparkSession
    # Distances: relax the edges of improved nodes until nothing improves.
    rounds = Rounds(spark, "distances")
    best = start.select("s", F.col("s").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("_new"))
    improved = 1
    while improved:
        frontier = best.filter("_new").select("s", "id", "dist")
        reached = (
            links.join(frontier)
            .groupBy("s", F.col("target").alias("id"))
            .agg(F.min(F.col("dist") + F.col("weight")).alias("_found"))
        )
        both = best.drop("_new").join(reached, ["s", "id"], "full_outer")
        better = F.col("_found").isNotNull() & (F.col("dist").isNull() | (F.col("_found") < F.col("dist")))
        best, seen = rounds.write(
            both.select(
                "s", "id", F.when(better, F.col("_found")).otherwise(F.col("dist")).alias("dist"),
                better.alias("_new"),
            ),
            improved=F.count_if(F.col("_new")),
        )
        improved = seen["improved"]
    best = best.select("s", "id", "dist")
    # Edges on shortest paths, per source.
    ends = best.select("s", F.col("id").alias("target"), F.col("dist").alias("_end"))
    dag = materialize(
        links.join(best)
        .withColumn("_end", F.col("dist") + F.col("weight"))
        .join(ends, ["s", "target", "_end"])
        .select("s", F.col("source").alias("u"), F.col("target").alias("v")),
        "paths",
    )
    # Path counts: walk all paths one edge per round and add up the arrivals. A node counts
    # as "hop" rows at each length of its paths; weights ≥ 1 make every walk end.
    walk = start.select("s", F.col("s").alias("u"), F.lit(1.0).alias("x"))
    arrivals = _walk(walk, dag, "u", "v", F.col("x"))
    sigma = materialize(
        arrivals.groupBy("s", F.col("u").alias("id")).agg(F.sum("x").alias("sigma")), "sigma"
    )
    # Dependencies: every reached node sends 1 back, split by path counts. A share that
    # arrives at u through v is σ[u]/σ[v] of what v sends.
    left, right = sigma.select("s", F.col("id").alias("u"), F.col("sigma").alias("_su")), sigma.select(
        "s", F.col("id").alias("v"), F.col("sigma").alias("_sv")
    )
    back = materialize(
        dag.join(left, ["s", "u"]).join(right, ["s", "v"])
        .select("s", "u", "v", (F.col("_su") / F.col("_sv")).alias("_share")),
        "back",
    )
    ones = sigma.select("s", F.col("id").alias("v"), F.lit(1.0).alias("x"))
    sent = _walk(ones, back, "v", "u", F.col("x") * F.col("_share"), first=False)
    return (
        sent.filter("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("delta"))
    )


def _walk(state: DataFrame, paths: DataFrame, at: str, to: str, value: Column, first: bool = True) -> DataFrame:
    """Move values along ``paths`` round by round; all arrivals, with the start if ``first``."""
    steps, table = [state] if first else [], Rounds(state.sparkSession, "walk", STEPS_PER_SUM + 1)
    while True:
        moved = (
            state.join(paths, ["s", at])
            .withColumn("_x", value)
            .groupBy("s", F.col(to).alias("_to"))
            .agg(F.sum("_x").alias("x"))
            .select("s", F.col("_to").alias(at), "x")
        )
        state, seen = table.write(moved, rows=F.count(F.lit(1)))
        if not seen["rows"]:
            break
        steps.append(state)
        if len(steps) >= STEPS_PER_SUM:
            steps = [materialize(_union(steps).groupBy("s", at).agg(F.sum("x").alias("x")), "walked")]
    return _union(steps) if steps else state


def _union(steps: list[DataFrame]) -> DataFrame:
    total = steps[0]
    for step in steps[1:]:
        total = total.unionByName(step)
    return total


def node_metrics(edges: DataFrame, node_frac: float = 0.5, seed: int = 42) -> DataFrame:
    """PageRank, hub, authority and betweenness scores by node."""
    edges = materialize(edges, "edges")
    return (
        pagerank(edges)
        .join(hits(edges), "id")
        .join(betweenness(edges, node_frac, seed), "id")
    )


# --- degree distributions -----------------------------------------------------------------
# A histogram of degrees has at most about √(2·edges) rows, since d different degrees need
# at least d(d+1)/2 edge ends; windows over a whole histogram are bounded by that.


def degree_histogram(degree_rows: DataFrame) -> DataFrame:
    return degree_rows.groupBy(F.col("degree").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def degree_pdf(degree_rows: DataFrame) -> DataFrame:
    """(k, n, pdf)."""
    histogram = degree_histogram(degree_rows)
    total = histogram.agg(F.sum("n")).scalar()
    return histogram.withColumn("pdf", F.col("n") / total)


def degree_cdf(degree_rows: DataFrame) -> DataFrame:
    """(k, pdf, cdf)."""
    upto = W.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    histogram = degree_histogram(degree_rows)
    total = histogram.agg(F.sum("n")).scalar()
    return histogram.select(
        "k", (F.col("n") / total).alias("pdf"), (F.sum("n").over(upto) / total).alias("cdf")
    )


BIN_EDGES = 100


def log_bin_edges(histogram: DataFrame) -> DataFrame:
    """One row with the bin edges: 100 powers of ten from 1 to 10^(⌊ln max⌋ − 1)."""
    top = F.floor(F.ln(F.max("k").cast("double"))) - 1
    stop = F.when(top >= 1, top.cast("double")).otherwise(
        F.raise_error(F.lit("the largest degree is too small for logarithmic bins")).cast("double")
    )
    last = BIN_EDGES - 1
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.pow(F.lit(10.0), F.when(i == last, F.col("stop")).otherwise(i * (F.col("stop") / last))),
    )
    return histogram.agg(stop.alias("stop")).select(edges.alias("edges"))


def log_bin_histogram(degree_rows: DataFrame) -> DataFrame:
    """(bin, lo, hi, n) for all 99 bins; the last bin is closed, larger values are dropped."""
    histogram = degree_histogram(degree_rows)
    edges = log_bin_edges(histogram)
    last = BIN_EDGES - 1
    passed = F.size(F.filter("_edges", lambda e: e <= F.col("k")))
    counted = (
        histogram.withColumn("_edges", edges.scalar())
        .withColumn("_passed", passed)
        .filter((F.col("_passed") >= 1) & (F.col("k") <= F.element_at("_edges", -1)))
        .groupBy((F.least("_passed", F.lit(last)) - 1).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    bins = edges.select(
        F.posexplode(F.slice("edges", 1, last)).alias("bin", "lo"), F.col("edges").alias("_all")
    ).select("bin", "lo", F.get(F.col("_all"), F.col("bin") + 1).alias("hi"))
    return bins.join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def log_bin_ccdf(degree_rows: DataFrame) -> DataFrame:
    """(k, ccdf) for every degree: one minus the binned CDF, linear within a bin."""
    bins = log_bin_histogram(degree_rows)
    upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)  # 99 rows
    total = F.sum("n").over(W.partitionBy())
    steps = bins.select(
        "bin", "lo", "hi", (F.col("n") / total).alias("p"), (F.sum("n").over(upto) / total).alias("cdf")
    )
    table = steps.agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "p", "cdf"))).alias("t")).scalar()
    rows = degree_histogram(degree_rows).select("k").withColumn("_t", table)
    spot = F.get(F.filter("_t", lambda b: (b["lo"] <= F.col("k")) & (F.col("k") < b["hi"])), 0)
    inside = rows.withColumn("_b", spot)
    below = F.col("_b.cdf") - F.col("_b.p") * (F.col("_b.hi") - F.col("k")) / (F.col("_b.hi") - F.col("_b.lo"))
    first = F.get(F.col("_t"), 0)["lo"]
    return inside.select(
        "k",
        F.when(F.col("_b").isNotNull(), 1 - below)
        .when(F.col("k") < first, F.lit(1.0))
        .otherwise(F.lit(0.0))
        .alias("ccdf"),
    )
