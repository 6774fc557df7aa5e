"""Queries over graph construction, node metrics, power laws and the incremental graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.operators import graph_build as G
from crowdtide.operators import graph_metrics as K
from crowdtide.operators import powerlaw as P
from crowdtide.operators.datasets import top_k
from crowdtide.plans import tables as T
from crowdtide.scratch import materialize, new_folder
from crowdtide.streaming.incremental import compact_graph, read_graph, update_graph


# --- construction -------------------------------------------------------------------------
# Orders are posts of customers; order lines are the followers' and repeaters' records.


def _order_posts(spark: SparkSession, folder: str) -> DataFrame:
    orders = T.table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("ID"), F.col("o_custkey").cast("string").alias("UserID")
    )


def follower_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers follow the users whose number equals a part they sold."""
    lines = T.table(spark, folder, "lineitem")
    followers = lines.select(
        F.col("l_partkey").cast("string").alias("user_id"), F.col("l_suppkey").cast("string").alias("follower_id")
    ).distinct()
    return G.follower_edges(_order_posts(spark, folder), followers)


def retweet_edges(spark: SparkSession, folder: str) -> DataFrame:
    lines = T.table(spark, folder, "lineitem")
    retweets = lines.select(
        F.col("l_orderkey").cast("string").alias("tweet_id"), F.col("l_suppkey").cast("string").alias("user_id")
    )
    pairs = G.retweet_edges(_order_posts(spark, folder), retweets)
    return G.accumulate_weights(pairs)


def _mentioning_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as posts that mention a customer, a too long name and an unknown one."""
    lines = T.table(spark, folder, "lineitem")
    content = F.concat(
        F.lit("to @c"), F.col("l_partkey").cast("string"),
        F.when(F.col("l_returnflag") == "A", " and @someone_with_a_long_name!").otherwise(" @nobody"),
    )
    return lines.select(F.col("l_suppkey").cast("string").alias("UserID"), content.alias("Content"))


def _short_names(spark: SparkSession, folder: str) -> DataFrame:
    customers = T.table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    return customers.select(F.concat(F.lit("id"), key).alias("id"), F.concat(F.lit("C"), key).alias("Username"))


def mention_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.mention_edges(_mentioning_posts(spark, folder), _short_names(spark, folder))
    return G.accumulate_weights(edges)


def accumulate_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Followers, repeats and mentions in one graph."""
    posts = _order_posts(spark, folder)
    lines = T.table(spark, folder, "lineitem")
    followers = lines.select(
        F.col("l_partkey").cast("string").alias("user_id"), F.col("l_suppkey").cast("string").alias("follower_id")
    ).distinct()
    retweets = lines.select(
        F.col("l_orderkey").cast("string").alias("tweet_id"), F.col("l_suppkey").cast("string").alias("user_id")
    )
    mentions = G.mention_edges(_mentioning_posts(spark, folder), _short_names(spark, folder))
    return G.accumulate_weights(
        G.follower_edges(posts, followers), G.retweet_edges(posts, retweets), mentions
    )


def email_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.email_edges(T.mail(spark, folder))


def email_edges_all(spark: SparkSession, folder: str) -> DataFrame:
    return G.email_edges(T.mail(spark, folder), ("to", "cc", "bcc"))


def non_email_report(spark: SparkSession, folder: str) -> DataFrame:
    return G.non_email_report(G.email_edges(T.mail(spark, folder)))


def drop_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.drop_nodes(G.email_edges(T.mail(spark, folder)))


def drop_listed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The user graph without users of one market segment."""
    listed = T.table(spark, folder, "customer").filter("c_mktsegment = 'MACHINERY'")
    return G.drop_listed_nodes(
        T.user_graph(spark, folder), listed.select(F.col("c_custkey").cast("string").alias("id"))
    )


def drop_isolated(spark: SparkSession, folder: str) -> DataFrame:
    edges = materialize(G.email_edges(T.mail(spark, folder)), "edges")  # read twice, built once
    return G.drop_isolated(G.nodes_of(edges), G.drop_nodes(edges))


def relabel_string(spark: SparkSession, folder: str) -> DataFrame:
    lines = T.table(spark, folder, "lineitem")
    pairs = lines.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return G.accumulate_weights(G.relabel_string(pairs))


def rename_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Users renamed to their market segment, so that many nodes merge."""
    info = T.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("Username")
    )
    return G.rename_nodes(T.user_graph(spark, folder), info)


def rename_nodes_last(spark: SparkSession, folder: str) -> DataFrame:
    info = T.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("Username")
    )
    return G.rename_nodes(T.user_graph(spark, folder), info, merge="last")


def add_attributes(spark: SparkSession, folder: str) -> DataFrame:
    attributes = T.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), "c_name", "c_acctbal"
    )
    return G.add_attributes(G.nodes_of(T.user_graph(spark, folder)), attributes)


def _mixed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Part numbers as user ids, part of them unknown, and brands as ids that are no numbers."""
    parts = T.table(spark, folder, "part")
    return parts.select(F.col("p_partkey").cast("string").alias("id")).unionByName(
        parts.select(F.col("p_brand").alias("id"))
    )


def resolve_users(spark: SparkSession, folder: str) -> DataFrame:
    return G.resolve_users(_mixed_ids(spark, folder), T.users(spark, folder))


def join_names(spark: SparkSession, folder: str) -> DataFrame:
    degrees = K.degrees(T.user_graph(spark, folder), "all")
    return G.join_names(degrees, T.users(spark, folder))


def incremental_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines landing by ship date, folded into the graph of parts and suppliers.

    Half of the dates land, the stream runs over several batches and stops; after a compaction the
    rest lands and the stream resumes.
    """
    lines = T.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    landed, out, state = new_folder(spark, "landed"), new_folder(spark, "graph"), new_folder(spark, "state")
    spark.createDataFrame([], lines.schema).write.parquet(landed)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(landed)

    def edges_of(batch: DataFrame) -> DataFrame:
        return batch.select(
            F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target")
        )

    years = F.year("l_shipdate")
    for part in (years < 1996, (years >= 1996) & (years < 1998), (years >= 1998) | years.isNull()):
        lines.filter(part).repartitionByRange(2, "l_shipdate").write.mode("append").parquet(landed)
        update_graph(stream, edges_of, out, state).awaitTermination()
        compact_graph(spark, out)
    return read_graph(spark, out)


# --- metrics ------------------------------------------------------------------------------


def _degrees(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return K.degrees(T.user_graph(spark, folder), mode)

    return query


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    ranks = K.pagerank(materialize(T.user_graph(spark, folder), "edges"), tol=1e-12)
    return ranks.select("id", F.round("PageRank", 8).alias("PageRank"))


def pagerank_nations(spark: SparkSession, folder: str) -> DataFrame:
    ranks = K.pagerank(materialize(T.nation_graph(spark, folder), "edges"), tol=1e-10)
    return ranks.select("id", T.r6("PageRank").alias("PageRank"))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    scores = K.hits(materialize(T.user_graph(spark, folder), "edges"), tol=1e-10)
    return scores.select(
        "id", T.r6("HubScore").alias("HubScore"), T.r6("AuthorityScore").alias("AuthorityScore")
    )


def betweenness(spark: SparkSession, folder: str) -> DataFrame:
    scores = K.betweenness(materialize(T.user_graph(spark, folder), "edges"))
    return scores.select("id", T.r6("BetweennessCentrality").alias("BetweennessCentrality"))


def node_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of the nation graph."""
    scores = K.node_metrics(materialize(T.nation_graph(spark, folder), "edges"))
    return scores.select("id", *[F.round(c, 4).alias(c) for c in scores.columns[1:]])


def top_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    ranks = pagerank(spark, folder)
    return top_k(ranks, "PageRank")


def _out_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return K.degrees(T.user_graph(spark, folder), "out")


def degree_pdf(spark: SparkSession, folder: str) -> DataFrame:
    return K.degree_pdf(_out_degrees(spark, folder)).select("k", "n", T.r6("pdf").alias("pdf"))


def degree_cdf(spark: SparkSession, folder: str) -> DataFrame:
    return K.degree_cdf(_out_degrees(spark, folder)).select("k", T.r6("pdf").alias("pdf"), T.r6("cdf").alias("cdf"))


def _all_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(K.degrees(T.user_graph(spark, folder), "all"), "degrees")


def log_bin_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = K.log_bin_histogram(_all_degrees(spark, folder))
    return bins.select(F.col("bin").cast("long").alias("bin"), T.r6("lo").alias("lo"), T.r6("hi").alias("hi"), "n")


def log_bin_ccdf(spark: SparkSession, folder: str) -> DataFrame:
    return K.log_bin_ccdf(_all_degrees(spark, folder)).select("k", T.r6("ccdf").alias("ccdf"))


# --- power laws ---------------------------------------------------------------------------

SIMS = 1000


def fit_power_law(spark: SparkSession, folder: str) -> DataFrame:
    fit = P.fit_power_law(_all_degrees(spark, folder))
    return fit.select("xmin", F.round("gamma", 4).alias("gamma"), T.r6("ks").alias("ks"), "ntail")


def bootstrap_fit(spark: SparkSession, folder: str) -> DataFrame:
    return P.bootstrap_spread(P.bootstrap_fit(_all_degrees(spark, folder), SIMS))


def bootstrap_pvalue(spark: SparkSession, folder: str) -> DataFrame:
    return P.bootstrap_pvalue(_all_degrees(spark, folder), SIMS)


def sample_power_law(spark: SparkSession, folder: str) -> DataFrame:
    """One draw per order line, as a histogram."""
    lines = T.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    )
    return P.draw_power_law(lines, "id", 2.5, 5).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = P.bootstrap_histogram(T.table(spark, folder, "events"), "value")
    return bins.select("bin", T.r6("lo").alias("lo"), T.r6("hi").alias("hi"), "n")


def fit_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.fit_report(materialize(T.user_graph(spark, folder), "edges"), n_sims=SIMS)


QUERIES = {
    "follower_edges": follower_edges,
    "retweet_edges": retweet_edges,
    "mention_edges": mention_edges,
    "accumulate_weights": accumulate_weights,
    "email_edges": email_edges,
    "email_edges_all": email_edges_all,
    "non_email_report": non_email_report,
    "drop_nodes": drop_nodes,
    "drop_listed_nodes": drop_listed_nodes,
    "drop_isolated": drop_isolated,
    "relabel_string": relabel_string,
    "rename_nodes": rename_nodes,
    "rename_nodes_last": rename_nodes_last,
    "add_attributes": add_attributes,
    "resolve_users": resolve_users,
    "join_names": join_names,
    "incremental_graph": incremental_graph,
    "degrees_in": _degrees("in"),
    "degrees_out": _degrees("out"),
    "degrees_all": _degrees("all"),
    "pagerank": pagerank,
    "pagerank_nations": pagerank_nations,
    "hits": hits,
    "betweenness": betweenness,
    "node_metrics": node_metrics,
    "top_pagerank": top_pagerank,
    "degree_pdf": degree_pdf,
    "degree_cdf": degree_cdf,
    "log_bin_histogram": log_bin_histogram,
    "log_bin_ccdf": log_bin_ccdf,
    "fit_power_law": fit_power_law,
    "bootstrap_fit": bootstrap_fit,
    "bootstrap_pvalue": bootstrap_pvalue,
    "sample_power_law": sample_power_law,
    "bootstrap_histogram": bootstrap_histogram,
    "fit_report": fit_report,
}

_FOLLOW = """follow AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS source, CAST(l_partkey AS VARCHAR) AS target
  FROM lineitem WHERE l_partkey IN (SELECT o_custkey FROM orders))"""

_MENTION = """mention AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS source, 'id' || c_custkey AS target
  FROM lineitem JOIN customer ON l_partkey = c_custkey
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'someone_with_a_long_name' FROM lineitem
  WHERE l_returnflag = 'A')"""

_RETWEET = """retweet AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS source, CAST(o_custkey AS VARCHAR) AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_DEGREE = f"""WITH {T.USER_GRAPH_SQL},
i AS (SELECT target AS id, count(*) AS degree FROM edges GROUP BY 1),
o AS (SELECT source AS id, count(*) AS degree FROM edges GROUP BY 1),
a AS (SELECT id, CAST(sum(degree) AS BIGINT) AS degree
      FROM (SELECT * FROM i UNION ALL SELECT * FROM o) GROUP BY 1)"""

_LOG_BINS = f"""{_DEGREE},
h AS (SELECT degree AS k, count(*) AS n FROM a GROUP BY 1),
s AS (SELECT floor(ln(max(k))) - 1 AS stop FROM h),
e AS (SELECT i, CASE WHEN i = 99 THEN pow(10, stop) ELSE pow(10, i * (stop / 99)) END AS x
      FROM s, (SELECT unnest(generate_series(0, 99)) AS i)),
b AS (SELECT lo.i AS bin, lo.x AS lo, hi.x AS hi FROM e lo JOIN e hi ON hi.i = lo.i + 1),
c AS (SELECT bin, lo, hi, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS n FROM b
      LEFT JOIN h ON h.k >= lo AND (h.k < hi OR (bin = 98 AND h.k = hi)) GROUP BY bin, lo, hi)"""


def _pagerank_ctes(rounds: int) -> str:
    """Fixed rounds, enough for the ranks to settle beyond the compared places."""
    return f"""outs AS MATERIALIZED (SELECT source, sum(weight) AS w FROM edges GROUP BY 1),
num AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
moves AS MATERIALIZED (
  SELECT e.source, e.target, e.weight / o.w AS share FROM edges e JOIN outs o ON e.source = o.source),
ranks AS (
  SELECT 0 AS round, id, 1 / n AS x FROM nodes, num
  UNION ALL
  SELECT max(g.round) + 1, g.id, 0.85 * (sum(g.got) + max(d.lost) / max(n)) + 0.15 / max(n)
  FROM (SELECT r.round, m.target AS id, r.x * m.share AS got FROM ranks r JOIN moves m ON r.id = m.source
        UNION ALL SELECT round, id, 0 FROM ranks) g,
       (SELECT coalesce(sum(x), 0) AS lost FROM ranks WHERE id NOT IN (SELECT source FROM outs)) d, num
  WHERE g.round < {rounds} GROUP BY g.id),
pagerank AS (SELECT id, x AS "PageRank" FROM ranks WHERE round = {rounds})"""


def _hits_ctes(rounds: int) -> str:
    return f"""hubs AS (
  SELECT 0 AS round, id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS h FROM nodes
  UNION ALL
  SELECT round, id, h / sum(h) OVER () FROM (
    SELECT max(a.round) + 1 AS round, e.source AS id, sum(a.a * e.weight) AS h
    FROM (SELECT max(p.round) AS round, f.target AS id, sum(p.h * f.weight) AS a
          FROM hubs p JOIN edges f ON p.id = f.source GROUP BY f.target) a
    JOIN edges e ON a.id = e.target WHERE a.round < {rounds} GROUP BY e.source)),
hub AS (SELECT id, h FROM hubs WHERE round = {rounds}),
auth AS (SELECT id, a / sum(a) OVER () AS a FROM (
  SELECT e.target AS id, sum(h * weight) AS a FROM hub JOIN edges e ON id = e.source GROUP BY 1)),
hits AS (SELECT nodes.id, coalesce(h, 0) AS "HubScore", coalesce(a, 0) AS "AuthorityScore"
  FROM nodes LEFT JOIN hub ON nodes.id = hub.id LEFT JOIN auth ON nodes.id = auth.id)"""


def _betweenness_ctes(doublings: int = 4, frac: float = 0.5) -> str:
    """Distances by doubling the length of paths, then path counts and dependencies."""
    ctes = [
        "proper AS MATERIALIZED (SELECT source, target, weight AS w FROM edges WHERE source <> target)",
        "d0 AS MATERIALIZED (SELECT source AS s, target AS v, w AS d FROM proper)",
    ]
    for i in range(doublings):
        ctes.append(
            f"""d{i + 1} AS MATERIALIZED (SELECT s, v, min(d) AS d FROM (
  SELECT s, v, d FROM d{i} UNION ALL
  SELECT a.s, b.v, a.d + b.d FROM d{i} a JOIN d{i} b ON a.v = b.s WHERE a.s <> b.v) GROUP BY 1, 2)"""
        )
    ctes.append(
        f"""picked AS MATERIALIZED (SELECT id FROM nodes ORDER BY md5(id || '|42'), id
  LIMIT (SELECT CAST(floor(count(*) * {frac}) AS BIGINT) FROM nodes)),
dist AS MATERIALIZED (SELECT s, v, d FROM d{doublings} WHERE s IN (SELECT id FROM picked)
  UNION ALL SELECT id, id, 0 FROM picked),
dag AS MATERIALIZED (SELECT a.s, e.source AS u, e.target AS v FROM dist a JOIN proper e ON a.v = e.source
  JOIN dist b ON b.s = a.s AND b.v = e.target AND b.d = a.d + e.w),
walk AS (SELECT 0 AS hop, id AS s, id AS v, 1.0::DOUBLE AS x FROM picked
  UNION ALL SELECT max(hop) + 1, w.s, g.v, sum(w.x) FROM walk w JOIN dag g ON w.s = g.s AND w.v = g.u
  GROUP BY w.s, g.v),
sigma AS MATERIALIZED (SELECT s, v, sum(x) AS n FROM walk GROUP BY 1, 2),
shares AS MATERIALIZED (SELECT g.s, g.u, g.v, a.n / b.n AS share FROM dag g
  JOIN sigma a ON a.s = g.s AND a.v = g.u JOIN sigma b ON b.s = g.s AND b.v = g.v),
back AS (SELECT 0 AS hop, s, v, 1.0::DOUBLE AS x FROM sigma
  UNION ALL SELECT max(hop) + 1, b.s, g.u, sum(b.x * g.share) FROM back b JOIN shares g ON b.s = g.s AND b.v = g.v
  GROUP BY b.s, g.u),
delta AS (SELECT v AS id, sum(x) AS x FROM back WHERE hop > 0 AND s <> v GROUP BY 1),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n, floor(count(*) * {frac}) AS k FROM nodes),
between_ AS (SELECT nodes.id, coalesce(x, 0) * n / k / ((n - 1) * (n - 2)) AS "BetweennessCentrality"
  FROM size, nodes LEFT JOIN delta ON nodes.id = delta.id)"""
    )
    return ",\n".join(ctes)


def _zeta_sql(s: str, a: str) -> str:
    """Hurwitz zeta times a to the power s: direct terms and the Euler–Maclaurin rest."""
    n = 15
    direct = " + ".join(f"pow(({a} + {i}) / {a}, -({s}))" for i in range(n))
    end = f"({a} + {n})"
    first = f"({s}) / 12 * pow({end}, -1)"
    second = f"({s}) * (({s}) + 1) * (({s}) + 2) / 720 * pow({end}, -3)"
    third = f"({s}) * (({s}) + 1) * (({s}) + 2) * (({s}) + 3) * (({s}) + 4) / 30240 * pow({end}, -5)"
    return f"({direct} + pow({end} / {a}, -({s})) * ({end} / (({s}) - 1) + 0.5 + {first} - {second} + {third}))"


_GOLDEN = 0.6180339887498949
_POWER_LAW = f"""{_DEGREE.replace('WITH', 'WITH RECURSIVE', 1)},
h AS MATERIALIZED (SELECT CAST(degree AS DOUBLE) AS k, count(*) AS n FROM a GROUP BY 1),
c AS MATERIALIZED (
  SELECT x.k AS xmin, sum(y.n) AS size, sum(y.n * ln(y.k / x.k)) / sum(y.n) AS m
  FROM h x JOIN h y ON y.k >= x.k GROUP BY 1 HAVING count(*) > 1),
g AS (
  SELECT 0 AS step, xmin, size, m, 1.0001::DOUBLE AS lo, 1000.0::DOUBLE AS hi FROM c
  UNION ALL
  SELECT step + 1, xmin, size, m, CASE WHEN la < lb THEN lo ELSE pa END, CASE WHEN la < lb THEN pb ELSE hi END
  FROM (SELECT *, ln({_zeta_sql('pa', 'xmin')}) + pa * m AS la, ln({_zeta_sql('pb', 'xmin')}) + pb * m AS lb
        FROM (SELECT *, hi - {_GOLDEN} * (hi - lo) AS pa, lo + {_GOLDEN} * (hi - lo) AS pb FROM g WHERE step < 70))),
fits AS MATERIALIZED (SELECT xmin, size, (lo + hi) / 2 AS gamma FROM g WHERE step = 70 AND lo + hi > 2.0004 AND lo + hi < 1999.9998),
gaps AS (
  SELECT f.xmin, f.size, gamma, abs(sum(h.n) OVER (PARTITION BY f.xmin ORDER BY h.k) / f.size
    - (1 - pow((h.k + 1) / f.xmin, -gamma) * {_zeta_sql('gamma', '(h.k + 1)')} / {_zeta_sql('gamma', 'f.xmin')})) AS gap
  FROM fits f JOIN h ON h.k >= f.xmin),
ks AS (SELECT xmin, max(size) AS ntail, max(gamma) AS gamma, max(gap) AS ks FROM gaps GROUP BY 1)
SELECT CAST(xmin AS BIGINT) AS xmin, round(gamma, 4) AS gamma, round(ks, 6) AS ks, CAST(ntail AS BIGINT) AS ntail
FROM ks ORDER BY ks, xmin LIMIT 1"""


SQL = {
    "sample_power_law": """WITH s AS (SELECT k, power(CAST(k AS DOUBLE), -2.5) AS w FROM range(5, 1048576) r(k)),
t AS (SELECT k, sum(w) OVER (ORDER BY k DESC) + power(1048576.0, -1.5) / 1.5 + power(1048576.0, -2.5) / 2
             + 2.5 * power(1048576.0, -3.5) / 12 AS beyond FROM s),
u AS (SELECT CAST('0x' || substr(md5(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) || '|42'), 1, 13) AS BIGINT)
             / 4503599627370496.0 AS u FROM lineitem),
d AS (SELECT (1 - u) * (SELECT max(beyond) FROM t) AS target FROM u)
SELECT t.k, count(*) AS n FROM d ASOF JOIN t ON d.target <= t.beyond GROUP BY 1""",
    "fit_power_law": _POWER_LAW,
    "follower_edges": f"WITH {_FOLLOW} SELECT source, target FROM follow",
    "retweet_edges": f"WITH {_RETWEET} SELECT source, target, count(*) AS weight FROM retweet GROUP BY 1, 2",
    "mention_edges": f"WITH {_MENTION} SELECT source, target, count(*) AS weight FROM mention GROUP BY 1, 2",
    "accumulate_weights": f"""WITH {_FOLLOW}, {_RETWEET}, {_MENTION}
SELECT source, target, count(*) AS weight FROM (
  SELECT * FROM follow UNION ALL SELECT * FROM retweet UNION ALL SELECT * FROM mention) GROUP BY 1, 2""",
    "email_edges": f"WITH {T.MAIL_SQL} SELECT source, target, weight FROM edges",
    "email_edges_all": f"""WITH {T.MAIL_SQL}, copies AS (
  SELECT DISTINCT source, source AS target, o_orderkey FROM mail WHERE o_orderpriority LIKE '2%')
SELECT source, target, weight FROM edges
UNION ALL SELECT source, target, count(*) FROM copies GROUP BY 1, 2""",
    "non_email_report": f"""WITH {T.MAIL_SQL}
SELECT count(DISTINCT target) AS nodes, count(*) AS edges FROM edges WHERE target NOT LIKE '%@%'""",
    "drop_nodes": f"WITH {T.MAIL_SQL} SELECT source, target, weight FROM edges WHERE target LIKE '%@%'",
    "drop_listed_nodes": f"""WITH {T.USER_GRAPH_SQL},
x AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT source, target, weight FROM edges
WHERE source NOT IN (SELECT id FROM x) AND target NOT IN (SELECT id FROM x)""",
    "drop_isolated": f"""WITH {T.MAIL_SQL}
SELECT source AS id FROM edges WHERE target LIKE '%@%' UNION
SELECT target FROM edges WHERE target LIKE '%@%'""",
    "relabel_string": """SELECT CAST(l_partkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target,
       count(*) AS weight FROM lineitem GROUP BY 1, 2""",
    "rename_nodes": f"""WITH {T.USER_GRAPH_SQL}
SELECT a.c_mktsegment AS source, b.c_mktsegment AS target, CAST(sum(weight) AS BIGINT) AS weight
FROM edges JOIN customer a ON source = CAST(a.c_custkey AS VARCHAR)
JOIN customer b ON target = CAST(b.c_custkey AS VARCHAR) GROUP BY 1, 2""",
    "rename_nodes_last": f"""WITH {T.USER_GRAPH_SQL}
SELECT a.c_mktsegment AS source, b.c_mktsegment AS target,
       arg_max(weight, place) AS weight
FROM (SELECT *, row_number() OVER (ORDER BY source, target) AS place FROM edges)
JOIN customer a ON source = CAST(a.c_custkey AS VARCHAR)
JOIN customer b ON target = CAST(b.c_custkey AS VARCHAR) GROUP BY 1, 2""",
    "add_attributes": f"""WITH {T.USER_GRAPH_SQL}
SELECT id, c_name, c_acctbal FROM nodes JOIN customer ON id = CAST(c_custkey AS VARCHAR)""",
    "resolve_users": """WITH ids AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id FROM part UNION SELECT p_brand FROM part),
j AS (SELECT id, c_name, c_mktsegment || '/' || c_name AS full_name,
             regexp_full_match(id, '[0-9]+') AS num
      FROM ids LEFT JOIN customer ON id = CAST(c_custkey AS VARCHAR)),
u AS (SELECT id, 'Unknown#' || row_number() OVER (ORDER BY id) AS label FROM j WHERE num AND c_name IS NULL)
SELECT j.id, CASE WHEN NOT num THEN j.id ELSE coalesce(c_name, label) END AS "Username",
       CASE WHEN NOT num THEN j.id ELSE coalesce(full_name, label) END AS "Name"
FROM j LEFT JOIN u ON j.id = u.id""",
    "join_names": f"""{_DEGREE}
SELECT id, degree, c_name AS "Username", c_mktsegment || '/' || c_name AS "Name"
FROM a LEFT JOIN customer ON id = CAST(c_custkey AS VARCHAR)""",
    "incremental_graph": """SELECT CAST(l_partkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target,
       count(*) AS weight FROM lineitem GROUP BY 1, 2""",
    "degrees_in": f"{_DEGREE} SELECT id, degree FROM i",
    "degrees_out": f"{_DEGREE} SELECT id, degree FROM o",
    "degrees_all": f"{_DEGREE} SELECT id, degree FROM a",
    "degree_pdf": f"""{_DEGREE}, h AS (SELECT degree AS k, count(*) AS n FROM o GROUP BY 1)
SELECT k, n, round(n / (SELECT sum(n) FROM h), 6) AS pdf FROM h""",
    "degree_cdf": f"""{_DEGREE}, h AS (SELECT degree AS k, count(*) AS n FROM o GROUP BY 1)
SELECT k, round(n / (SELECT sum(n) FROM h), 6) AS pdf,
       round(sum(n) OVER (ORDER BY k) / (SELECT sum(n) FROM h), 6) AS cdf FROM h""",
    "log_bin_histogram": f"{_LOG_BINS} SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM c",
    "log_bin_ccdf": f"""{_LOG_BINS},
t AS (SELECT sum(n) AS total FROM c),
f AS (SELECT bin, lo, hi, n / total AS p, sum(n) OVER (ORDER BY bin) / total AS cdf FROM c, t)
SELECT h.k, round(coalesce(1 - (cdf - p * (hi - h.k) / (hi - lo)), 0), 6) AS ccdf
FROM h LEFT JOIN f ON h.k >= lo AND h.k < hi""",
    "bootstrap_histogram": """WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events),
g AS (SELECT CAST(unnest(generate_series(0, 19)) AS INTEGER) AS bin),
c AS (SELECT least(CAST(floor((value - lo) / w) AS INTEGER), 19) AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT g.bin, round(lo + g.bin * w, 6) AS lo, round(lo + (g.bin + 1) * w, 6) AS hi, coalesce(n, 0) AS n
FROM s, g LEFT JOIN c ON g.bin = c.bin""",
    "pagerank": f"""WITH RECURSIVE {T.USER_GRAPH_SQL}, {_pagerank_ctes(60)}
SELECT id, round("PageRank", 8) AS "PageRank" FROM pagerank""",
    "top_pagerank": f"""WITH RECURSIVE {T.USER_GRAPH_SQL}, {_pagerank_ctes(60)}
SELECT id, round("PageRank", 8) AS "PageRank" FROM pagerank ORDER BY round("PageRank", 8) DESC, id LIMIT 10""",
    "pagerank_nations": f"""WITH RECURSIVE {T.NATION_GRAPH_SQL}, {_pagerank_ctes(60)}
SELECT id, round("PageRank", 6) AS "PageRank" FROM pagerank""",
    "hits": f"""WITH RECURSIVE {T.USER_GRAPH_SQL}, {_hits_ctes(40)}
SELECT id, round("HubScore", 6) AS "HubScore", round("AuthorityScore", 6) AS "AuthorityScore" FROM hits""",
    "betweenness": f"""WITH RECURSIVE {T.USER_GRAPH_SQL}, {_betweenness_ctes()}
SELECT id, round("BetweennessCentrality", 6) AS "BetweennessCentrality" FROM between_""",
    "node_metrics": f"""WITH RECURSIVE {T.NATION_GRAPH_SQL}, {_pagerank_ctes(60)}, {_hits_ctes(40)},
{_betweenness_ctes()}
SELECT id, round("PageRank", 4) AS "PageRank", round("HubScore", 4) AS "HubScore",
       round("AuthorityScore", 4) AS "AuthorityScore",
       round("BetweennessCentrality", 4) AS "BetweennessCentrality"
FROM pagerank JOIN hits USING (id) JOIN between_ USING (id)""",
}
