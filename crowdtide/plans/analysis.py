"""Queries over statistics, time series and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.functions.text import text_length
from crowdtide.operators import datasets as D
from crowdtide.operators import sentiment as N
from crowdtide.operators import stats as A
from crowdtide.plans import tables as T


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, dates to text."""
    return df.select(
        *[
            T.r6(c).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def daily_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.daily_stats(T.table(spark, folder, "events"), "ts", ["value", "user_id"]))


def daily_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.daily_quantiles(T.table(spark, folder, "events"), "ts", ["value", "user_id"]))


def daily_quantiles_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with so little room that the parts around the wanted ranks are cut again."""
    events = T.table(spark, folder, "events")
    return _rounded(A.daily_quantiles(events, "ts", ["value", "user_id"], in_memory_values=4, splits=50, accuracy=100))


def join_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.join_stats(T.table(spark, folder, "events"), "ts", ["value"]))


def fill_calendar(spark: SparkSession, folder: str) -> DataFrame:
    orders = T.table(spark, folder, "orders")
    return _rounded(A.daily_stats(orders, "o_orderdate", ["o_totalprice"], fill=True))


def monthly_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.monthly_stats(T.table(spark, folder, "orders"), "o_orderdate", ["o_totalprice"]))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def column_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(A.column_stats(T.table(spark, folder, "lineitem"), COLUMNS))


def text_length_query(spark: SparkSession, folder: str) -> DataFrame:
    return T.documents(spark, folder).select("id", text_length(F.col("text")).cast("long").alias("length"))


def stack_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of scores, of daily volumes and of text lengths in one table."""
    events = T.table(spark, folder, "events")
    lengths = T.documents(spark, folder).select(text_length(F.col("text")).alias("text"))
    return _rounded(
        A.stack_metrics(
            A.column_stats(events, ["value"]),
            A.column_stats(A.daily_stats(events, "ts", [], fill=True), ["vol"]),
            A.column_stats(lengths, ["text"]),
        )
    )


def count_by(spark: SparkSession, folder: str) -> DataFrame:
    return A.count_by(T.annotations(spark, folder), "target")


def share_pct(spark: SparkSession, folder: str) -> DataFrame:
    return A.share_pct(A.count_by(T.labelled_documents(spark, folder), "target"))


def log_color_norm(spark: SparkSession, folder: str) -> DataFrame:
    events = T.table(spark, folder, "events").select("event_id", "value")
    return A.log_color_norm(events, "value").select("event_id", T.r6("norm").alias("norm"))


def linear_color_norm(spark: SparkSession, folder: str) -> DataFrame:
    events = T.table(spark, folder, "events").select("event_id", "value")
    return A.linear_color_norm(events, "value").select("event_id", T.r6("norm").alias("norm"))


def graph_size(spark: SparkSession, folder: str) -> DataFrame:
    return A.graph_size(T.user_graph(spark, folder))


def post_score(spark: SparkSession, folder: str) -> DataFrame:
    posts, tweets = T.all_posts(spark, folder), T.event_tweets(spark, folder)
    total = D.total_dataset(posts, tweets).select("type", "id")
    return N.post_score(total, posts, tweets).select("type", "id", T.r6("score").alias("score"))


def label_name(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.labelled_documents(spark, folder)
    return docs.select("id", N.label_name(F.col("target")).alias("sentiment"))


def sentiment_score(spark: SparkSession, folder: str) -> DataFrame:
    posts = T.sentiment_events(spark, folder)
    parts = None
    for mode in N.MODES:
        one = N.sentiment_score(posts, mode).select(F.lit(mode).alias("mode"), T.r6("score").alias("score"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(N.daily_sentiment(T.sentiment_events(spark, folder)))


def daily_sentiment_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as posts: small tables have days without orders, which become 0."""
    orders = T.table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("datetime"),
        F.col("o_totalprice").alias("score"),
        F.when(F.col("o_orderstatus") == "F", "positive")
        .when(F.col("o_orderstatus") == "O", "negative")
        .otherwise("neutral")
        .alias("sentiment"),
    )
    return _rounded(N.daily_sentiment(orders))


def argmax_class(spark: SparkSession, folder: str) -> DataFrame:
    vectors = T.table(spark, folder, "embeddings")
    return vectors.select("vec_id", N.argmax_class(F.col("embedding")).alias("class"))


_DAILY_QUANTILES = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       round(quantile_cont(value, 0.25), 6) AS value_q25, round(quantile_cont(value, 0.75), 6) AS value_q75,
       round(quantile_cont(CAST(user_id AS DOUBLE), 0.25), 6) AS user_id_q25,
       round(quantile_cont(CAST(user_id AS DOUBLE), 0.75), 6) AS user_id_q75
FROM events GROUP BY 1"""

QUERIES = {
    "daily_stats": daily_stats,
    "daily_quantiles": daily_quantiles,
    "daily_quantiles_cut": daily_quantiles_cut,
    "join_stats": join_stats,
    "fill_calendar": fill_calendar,
    "monthly_stats": monthly_stats,
    "column_stats": column_stats,
    "text_length": text_length_query,
    "stack_metrics": stack_metrics,
    "count_by": count_by,
    "share_pct": share_pct,
    "log_color_norm": log_color_norm,
    "linear_color_norm": linear_color_norm,
    "graph_size": graph_size,
    "post_score": post_score,
    "label_name": label_name,
    "sentiment_score": sentiment_score,
    "daily_sentiment": daily_sentiment,
    "daily_sentiment_sparse": daily_sentiment_sparse,
    "argmax_class": argmax_class,
}


def _stats_sql(column: str, relation: str, name: str | None = None) -> str:
    return f"""SELECT '{name or column}' AS "column", round(avg({column}), 6) AS mean,
       round(stddev_samp({column}), 6) AS std, round(quantile_cont({column}, 0.25), 6) AS q25,
       round(quantile_cont({column}, 0.5), 6) AS q50, round(quantile_cont({column}, 0.75), 6) AS q75,
       round(CAST(max({column}) AS DOUBLE), 6) AS "max" FROM {relation}"""


_INDEX = """(sum(CASE sentiment WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0 END)
        / nullif(sum(score), 0))"""

SQL = {
    "daily_stats": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS vol,
       round(avg(value), 6) AS value_mean, round(avg(user_id), 6) AS user_id_mean
FROM events GROUP BY 1""",
    **dict.fromkeys(("daily_quantiles", "daily_quantiles_cut"), _DAILY_QUANTILES),
    "join_stats": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS vol,
       round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.25), 6) AS value_q25,
       round(quantile_cont(value, 0.75), 6) AS value_q75 FROM events GROUP BY 1""",
    "fill_calendar": """WITH s AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS vol, avg(o_totalprice) AS m FROM orders GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT CAST(c.day AS VARCHAR) AS day, coalesce(vol, 0) AS vol, round(coalesce(m, 0), 6) AS o_totalprice_mean
FROM c LEFT JOIN s ON c.day = s.day""",
    "monthly_stats": """SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
       count(*) AS vol, round(avg(o_totalprice), 6) AS o_totalprice_mean FROM orders GROUP BY 1""",
    "column_stats": " UNION ALL ".join(_stats_sql(c, "lineitem") for c in COLUMNS),
    "text_length": "SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS length FROM documents",
    "stack_metrics": " UNION ALL ".join(
        [
            _stats_sql("value", "events"),
            _stats_sql("vol", "(SELECT CAST(count(*) AS DOUBLE) AS vol FROM events GROUP BY CAST(ts AS DATE))"),
            _stats_sql("n", "(SELECT CAST(length(text) AS DOUBLE) AS n FROM documents)", "text"),
        ]
    ),
    "count_by": """SELECT CASE WHEN toxic = 0 THEN CAST(quality AS VARCHAR) END AS target, count(doc_id) AS n
FROM labels GROUP BY 1""",
    "share_pct": f"""WITH {T.THREE_CLASS_SQL}
SELECT target, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct
FROM labelled GROUP BY target""",
    "log_color_norm": """WITH b AS (
  SELECT ln(greatest(1, quantile_cont(value, 0.25))) AS lo, ln(max(value)) AS hi FROM events)
SELECT event_id, CASE WHEN value > 0 THEN round((ln(value) - lo) / (hi - lo), 6) END AS norm FROM events, b""",
    "linear_color_norm": """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, round((value - lo) / (hi - lo), 6) AS norm FROM events, b""",
    "graph_size": f"""WITH {T.USER_GRAPH_SQL}
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges""",
    "post_score": """SELECT 'reddit_post' AS type, CAST(doc_id AS VARCHAR) AS id,
       round(n_chars * ((doc_id % 100) / 100.0::DOUBLE), 6) AS score FROM documents
UNION ALL SELECT 'tweet', CAST(event_id AS VARCHAR), floor(value) FROM events""",
    "label_name": f"""WITH {T.THREE_CLASS_SQL}
SELECT id, CASE target WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS sentiment
FROM labelled""",
    "sentiment_score": f"""WITH {T.SENTIMENT_SQL}
SELECT 'both' AS mode, round({_INDEX}, 6) AS score FROM posts
UNION ALL SELECT 'reddit', round({_INDEX}, 6) FROM posts WHERE type = 'reddit_post'
UNION ALL SELECT 'twitter', round({_INDEX}, 6) FROM posts WHERE type = 'tweet'""",
    "daily_sentiment": f"""WITH {T.SENTIMENT_SQL},
s AS (SELECT day, {_INDEX} AS score FROM posts GROUP BY day),
c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT CAST(c.day AS VARCHAR) AS day, CASE WHEN s.day IS NULL THEN 0 ELSE round(score, 6) END AS score
FROM c LEFT JOIN s ON c.day = s.day""",
    "daily_sentiment_sparse": f"""WITH posts AS (
  SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS score,
         CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM orders),
s AS (SELECT day, {_INDEX} AS score FROM posts GROUP BY day),
c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT CAST(c.day AS VARCHAR) AS day, CASE WHEN s.day IS NULL THEN 0 ELSE round(score, 6) END AS score
FROM c LEFT JOIN s ON c.day = s.day""",
    "argmax_class": """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class
FROM embeddings""",
}
