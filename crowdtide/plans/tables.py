"""The test tables in the roles of posts, labels, users, mail and graphs.

``*_SQL`` strings are the same roles as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.functions.times import timestamp_to_epoch
from crowdtide.operators.scale import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(col: Column | str) -> Column:
    """Numbers are compared to six places."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# --- posts --------------------------------------------------------------------------------
# Documents are posts of one site when English and of the other site otherwise.


def _posts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("n_chars").alias("score"),
        F.col("text").alias("selftext"),
        F.col("source").alias("title"),
        (F.lit(1704067200.0) + F.col("doc_id") * 61.5).alias("created_utc"),
        (F.pmod(F.col("doc_id"), F.lit(100)) / 100.0).alias("upvote_ratio"),
        F.pmod(F.col("doc_id"), F.lit(17)).alias("num_comments"),
    )


def reddit(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"), "doc_id")
    return _posts(docs.filter("lang = 'en'"))


def all_posts(spark: SparkSession, folder: str) -> DataFrame:
    return _posts(table(spark, folder, "documents"))


def foreign_tweets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("lang <> 'en'")
    return docs.select(
        F.col("doc_id").cast("string").alias("ID"),
        F.col("source").alias("UserID"),
        F.col("text").alias("Content"),
    )


def event_tweets(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        F.col("ts").alias("Date"),
        F.col("user_id").cast("string").alias("UserID"),
        F.concat_ws(" ", "event_type", "props").alias("Content"),
        F.col("event_id").cast("string").alias("ID"),
        F.floor("value").alias("LikeCount"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Quality as the label, toxic posts as irrelevant ones."""
    labels = table(spark, folder, "labels")
    return labels.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("toxic") == 0, F.col("quality").cast("string")).alias("target"),
        (F.col("toxic") == 1).alias("is_irrelevant"),
    )


def notes_of(annotated: DataFrame, posts: DataFrame, id_col: str) -> DataFrame:
    """The annotations of one site's posts."""
    return annotated.join(posts.select(F.col(id_col).alias("id")), "id", "left_semi")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, target) with three classes."""
    target = F.when(F.col("is_irrelevant"), 2).otherwise(F.col("target").cast("int"))
    return documents(spark, folder).join(
        annotations(spark, folder).select("id", target.alias("target")), "id"
    )


def sentiment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored posts: purchases are positive, errors negative, views from tweets."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("score"),
        F.when(F.col("event_type") == "purchase", "positive")
        .when(F.col("event_type") == "error", "negative")
        .otherwise("neutral")
        .alias("sentiment"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "tweet").otherwise("reddit_post").alias("type"),
    )


SENTIMENT_SQL = """posts AS (
  SELECT CAST(ts AS DATE) AS day, value AS score,
         CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative'
                         ELSE 'neutral' END AS sentiment,
         CASE WHEN user_id % 2 = 0 THEN 'tweet' ELSE 'reddit_post' END AS type
  FROM events)"""

THREE_CLASS_SQL = """labelled AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text,
         CASE WHEN l.toxic = 1 THEN 2 ELSE l.quality END AS target
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# --- graphs -------------------------------------------------------------------------------


def user_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers as users with one range of ids; weight counts order lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_custkey").cast("string").alias("source"),
            F.col("l_suppkey").cast("string").alias("target"),
        )
        .agg(F.count(F.lit(1)).alias("weight"))
    )


USER_GRAPH_SQL = """edges AS MATERIALIZED (
  SELECT CAST(o_custkey AS VARCHAR) AS source, CAST(l_suppkey AS VARCHAR) AS target,
         count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT source AS id FROM edges UNION SELECT target FROM edges)"""


def nation_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Nations linked by order lines from the customer's to the supplier's nation.

    Lines are counted per customer and supplier before the names are joined.
    """
    pairs = user_graph(spark, folder)
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("source"), "c_nationkey"
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("target"), "s_nationkey"
    )
    return (
        pairs.join(customers, "source")
        .join(suppliers, "target")
        .groupBy(
            F.col("c_nationkey").cast("string").alias("source"),
            F.col("s_nationkey").cast("string").alias("target"),
        )
        .agg(F.sum("weight").alias("weight"))
    )


NATION_GRAPH_SQL = """edges AS MATERIALIZED (
  SELECT CAST(c_nationkey AS VARCHAR) AS source, CAST(s_nationkey AS VARCHAR) AS target,
         count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT source AS id FROM edges UNION SELECT target FROM edges)"""


def mail(spark: SparkSession, folder: str) -> DataFrame:
    """One message per order: from the customer to the suppliers of its lines.

    Urgent orders have no To but supplier names in X-To; high ones copy the customer in Cc.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    lists = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("s")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    urgent = F.col("o_orderpriority").startswith("1")
    addresses = F.array_join(
        F.transform("s", lambda x: F.concat(F.lit("s"), x["l_suppkey"].cast("string"), F.lit("@shop.example"))),
        ", \n\t",
    )
    names = F.array_join(
        F.transform("s", lambda x: F.concat(F.lit("Supplier "), x["l_suppkey"].cast("string"))), ", "
    )
    customer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@shop.example"))
    raw = F.concat(
        F.lit("Message-ID: "), F.col("o_orderkey").cast("string"),
        F.lit("\nFrom: "), customer,
        F.when(urgent, F.concat(F.lit("\nX-To: "), names)).otherwise(F.concat(F.lit("\nTo: "), addresses)),
        F.when(F.col("o_orderpriority").startswith("2"), F.concat(F.lit("\nCc: "), customer)).otherwise(""),
        F.lit("\nSubject: order\n\nTo: nobody@body.example\n"),
    )
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"), raw.alias("raw")
    )


MAIL_SQL = """mail AS (
  SELECT 'c' || o_custkey || '@shop.example' AS source,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'Supplier ' || l_suppkey
              ELSE 's' || l_suppkey || '@shop.example' END AS target,
         o_orderkey, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT source, target, count(*) AS weight FROM mail GROUP BY 1, 2)"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("Username"),
        F.concat_ws("/", "c_mktsegment", "c_name").alias("Name"),
    )


def epoch(col: str) -> Column:
    return timestamp_to_epoch(F.col(col))
