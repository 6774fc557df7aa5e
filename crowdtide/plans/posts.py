"""Queries over sources, sinks and dataset shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.functions import text as X
from crowdtide.functions.times import epoch_to_timestamp, parse_date
from crowdtide.operators import datasets as D
from crowdtide.plans import tables as T
from crowdtide.scratch import new_folder
from crowdtide.sources import graphs as G
from crowdtide.sources import posts as P
from crowdtide.sources.messages import header_field, header_lines, read_messages
from crowdtide.sources.schemas import POST_COLUMNS

PER_OBJECT = 1000  # entries per written JSON object
FILES_PER_TASK = 2000  # written mail files


def _object_of(id_col: str) -> Column:
    """Number of the JSON object that holds an entry: ids are numbers in one run."""
    return F.floor(F.col(id_col).cast("long") / PER_OBJECT)


def _post_structs(posts: DataFrame) -> DataFrame:
    fields = [
        F.col(c) if c in posts.columns else F.lit(None).cast(t).alias(c)
        for c, t in POST_COLUMNS.items()
    ]
    return posts.select("id", F.struct(*fields).alias("post"))


def read_posts_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written as objects keyed by id, one object per line, and read back."""
    path = new_folder(spark, "posts")
    entries = _post_structs(T.all_posts(spark, folder))
    objects = entries.groupBy(_object_of("id")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "post")))).alias("value")
    )
    objects.select("value").write.text(path)
    return P.read_posts_by_id(spark, path, layout="lines").select(
        "id", "title", "score", F.md5("selftext").alias("text_md5"), "created_utc", "upvote_ratio",
        "num_comments", F.col("author").isNull().alias("no_author"),
    )


def read_columnar_json(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written as column-oriented objects and read back."""
    path = new_folder(spark, "columns")
    columns = {"UserID": "string", "Content": "string", "ID": "string", "LikeCount": "long"}
    rows = T.event_tweets(spark, folder).withColumn("_f", _object_of("ID"))
    entry = F.struct(F.col("ID").alias("k"), *columns)
    lists = rows.groupBy("_f").agg(F.collect_list(entry).alias("r"))
    maps = lists.select(
        F.to_json(
            F.struct(*[F.map_from_arrays(F.col("r.k"), F.col(f"r.{c}")).alias(c) for c in columns])
        ).alias("value")
    )
    maps.write.text(path)
    return P.read_columnar_json(spark, path, columns, layout="lines")


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "annotations")
    notes = T.annotations(spark, folder).withColumn("_f", _object_of("id"))
    objects = notes.groupBy("_f").agg(
        F.collect_list(F.when(~F.col("is_irrelevant"), F.struct("id", "target"))).alias("flat"),
        F.collect_list(F.when(F.col("is_irrelevant"), F.struct("id", F.lit(1).alias("one")))).alias("irr"),
    )
    nested = F.to_json(F.struct(F.map_from_entries("irr").alias("irrelevant")))
    flat = F.to_json(F.map_from_entries("flat"))
    inner = F.substr(flat, F.lit(2))  # without the opening brace
    head = F.substr(nested, F.lit(1), F.length(nested) - 1)  # without the closing brace
    value = F.when(F.size("flat") == 0, nested).otherwise(F.concat(head, F.lit(","), inner))
    objects.select(value.alias("value")).write.text(path)
    return P.read_annotations(spark, path, layout="lines")


def read_edgelist(spark: SparkSession, folder: str) -> DataFrame:
    """A graph written as CSV and read back."""
    path = new_folder(spark, "edgelist")
    edges = T.user_graph(spark, folder)
    G.write_edgelist_csv(edges, path)
    return G.read_edgelist(spark, path)


def read_weighted_edgelist(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "weighted")
    G.write_weighted_edgelist(T.user_graph(spark, folder), path)
    return G.read_weighted_edgelist(spark, path)


def read_undirected_edgelist(spark: SparkSession, folder: str) -> DataFrame:
    """Both directions of a pair fold into one; weights that agree make the result fixed."""
    path = new_folder(spark, "undirected")
    edges = T.user_graph(spark, folder)
    symmetric = F.char_length(F.concat("source", "target"))
    G.write_weighted_edgelist(edges.withColumn("weight", symmetric.cast("long")), path)
    return G.read_weighted_edgelist(spark, path, directed=False)


def read_messages_query(spark: SparkSession, folder: str) -> DataFrame:
    """One mail file per supplier, read back with its header."""
    path = new_folder(spark, "mail")
    suppliers = T.table(spark, folder, "supplier")
    raw = F.concat(
        F.lit("From: s"), F.col("s_suppkey").cast("string"), F.lit("@shop.example\nTo: n"),
        F.col("s_nationkey").cast("string"), F.lit("@nation.example\nSubject: "), F.col("s_name"),
        F.lit("\n\nbody\n"),
    )
    files = suppliers.select(F.col("s_suppkey").alias("box"), raw.alias("value"))
    # A file takes far longer than its few bytes, so many tasks write them; a box stays with one.
    tasks = max(spark.sparkContext.defaultParallelism, -(-suppliers.count() // FILES_PER_TASK))
    files.repartition(tasks, "box").write.partitionBy("box").text(path)
    lines = header_lines(F.col("raw"))
    return read_messages(spark, path).select(
        header_field(lines, "from").alias("sender"),
        header_field(lines, "to").alias("recipient"),
        header_field(lines, "subject").alias("subject"),
    )


def header_fields(spark: SparkSession, folder: str) -> DataFrame:
    lines = T.mail(spark, folder).select(header_lines(F.col("raw")).alias("h"))
    return lines.select(
        header_field(F.col("h"), "Message-ID").alias("message"),
        header_field(F.col("h"), "From").alias("sender"),
        header_field(F.col("h"), "X-To").isNotNull().alias("has_xto"),
        F.size(F.split(F.coalesce(header_field(F.col("h"), "To"), F.lit("")), "@")).cast("long").alias("parts"),
        header_field(F.col("h"), "Cc").alias("cc"),
    )


def write_json(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "json")
    posts = T.all_posts(spark, folder)
    G.write_json(posts, path)
    return spark.read.schema(posts.schema).json(path).select(
        "id", "score", F.md5("selftext").alias("text_md5"), "created_utc"
    )


def write_edgelist_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "csv")
    G.write_edgelist_csv(T.user_graph(spark, folder), path)
    schema = "id long, source string, target string, weight long"
    return spark.read.csv(path, schema=schema, header=True)


def write_node_metadata_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "nodes")
    G.write_node_metadata_csv(T.users(spark, folder), path, index="Username")
    return spark.read.csv(path, schema="id string, Name string", header=True)


def write_graphml(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges written as GraphML and read back line by line."""
    path = new_folder(spark, "graphml")
    nodes = T.users(spark, folder).select("id", F.concat_ws(" & ", "Username", "Name").alias("Name"))
    G.write_graphml(nodes, T.user_graph(spark, folder), path, ["Name"])
    return spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line").rlike("^<(node|edge) "))


def filter_posts_window(spark: SparkSession, folder: str) -> DataFrame:
    posts = T.all_posts(spark, folder).select(
        "id", "created_utc", F.col("selftext").alias("text"), F.col("title").alias("subreddit"),
        (F.col("num_comments") < 12).alias("is_self"),
    )
    kept = P.filter_posts_window(posts, 1704070000.0, 1704110000.0, "src3", "the|der|la")
    return kept.select("id", "created_utc", "subreddit")


def search_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with one post a day from 2020 on."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("doc_id", F.lit(1000)).cast("int"))
    docs = T.table(spark, folder, "documents").select(
        F.col("doc_id").alias("ID"), day.cast("timestamp_ntz").alias("Date"), F.col("text").alias("Content")
    )
    found = P.search_posts(docs, "2020-03-01", "2022-04-15", "license|idiot|nicht")
    return found.select("ID", F.md5("Content").alias("text_md5"), F.to_date("Date").cast("string").alias("day"))


def drop_removed(spark: SparkSession, folder: str) -> DataFrame:
    orders = T.table(spark, folder, "orders")
    selftext = (
        F.when(F.col("o_orderstatus") == "F", "[removed]")
        .when(F.col("o_orderpriority").startswith("5"), "[deleted]")
        .when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority"))
    )
    return P.drop_removed(orders.select(F.col("o_orderkey").alias("id"), selftext.alias("selftext")))


def project_submission(spark: SparkSession, folder: str) -> DataFrame:
    author = F.when(
        F.col("num_comments") > 3, F.struct(F.col("title").alias("name"), F.col("id").alias("id"))
    )
    raw = T.all_posts(spark, folder).withColumn("author", author).withColumn("extra", F.lit(1))
    return P.project_submission(raw).select(
        "id", "score", "title", "num_comments", F.col("author.name").alias("author_name"),
        F.col("author.id").alias("author_id"), F.col("author").isNull().alias("no_author"),
    )


def project_tweet(spark: SparkSession, folder: str) -> DataFrame:
    events = T.table(spark, folder, "events")
    link = F.struct(F.col("event_id").alias("id"))
    raw = events.select(
        F.col("ts").alias("date"),
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.col("event_type").alias("content"),
        F.col("event_id").alias("id"),
        F.floor("value").alias("likeCount"),
        F.lit(0).alias("replyCount"),
        F.pmod("user_id", F.lit(9)).alias("retweetCount"),
        F.when(F.col("event_type") == "click", link).alias("quotedTweet"),
        F.when(F.col("event_type") == "view", link).alias("retweetedTweet"),
    )
    return P.project_tweet(raw).withColumn("Date", T.epoch("Date"))


def parse_date_query(spark: SparkSession, folder: str) -> DataFrame:
    days = T.table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.select("event_id", parse_date(F.col("day")).alias("epoch"))


def post_text(spark: SparkSession, folder: str) -> DataFrame:
    part = T.table(spark, folder, "part")
    return part.select("p_partkey", X.post_text(F.col("p_name"), F.col("p_type")).alias("text"))


def _sides(spark: SparkSession, folder: str):
    reddit, tweets = T.reddit(spark, folder), T.foreign_tweets(spark, folder)
    notes = T.annotations(spark, folder)
    return reddit, T.notes_of(notes, reddit, "id"), tweets, T.notes_of(notes, tweets, "ID")


def label_irrelevant(spark: SparkSession, folder: str) -> DataFrame:
    reddit, reddit_notes, tweets, tweet_notes = _sides(spark, folder)
    both = D.label_irrelevant(reddit_notes, D.reddit_texts(reddit), D.REDDIT).unionByName(
        D.label_irrelevant(tweet_notes, D.tweet_texts(tweets), D.TWEET)
    )
    return both.withColumn("text", F.md5("text"))


def label_annotated(spark: SparkSession, folder: str) -> DataFrame:
    reddit, reddit_notes, tweets, tweet_notes = _sides(spark, folder)
    both = D.label_annotated(reddit_notes, D.reddit_texts(reddit), D.REDDIT).unionByName(
        D.label_annotated(tweet_notes, D.tweet_texts(tweets), D.TWEET)
    )
    return both.withColumn("text", F.md5("text"))


def train_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return D.train_dataset(*_sides(spark, folder)).withColumn("text", F.md5("text"))


def alt_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return D.alt_dataset(*_sides(spark, folder)).withColumn("text", F.md5("text"))


def total_dataset(spark: SparkSession, folder: str) -> DataFrame:
    total = D.total_dataset(T.all_posts(spark, folder), T.event_tweets(spark, folder))
    return total.select("type", "id", F.md5("text").alias("text_md5"), T.epoch("datetime").alias("epoch"))


def epoch_query(spark: SparkSession, folder: str) -> DataFrame:
    seconds = T.table(spark, folder, "events").select("event_id", (T.epoch("ts") + 0.25).alias("s"))
    moment = epoch_to_timestamp(F.col("s"))
    return seconds.select("event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSS").alias("moment"))


def drop_irrelevant(spark: SparkSession, folder: str) -> DataFrame:
    return D.drop_irrelevant(T.annotations(spark, folder)).select("id", "target")


def annotation_queue(spark: SparkSession, folder: str) -> DataFrame:
    posts = T.documents(spark, folder).select("id", F.char_length("text").cast("long").alias("chars"))
    return D.annotation_queue(posts, T.annotations(spark, folder))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answers about documents: the type gives the answer, the last one counts."""
    events = T.table(spark, folder, "events")
    answer = (
        F.when(F.col("event_type") == "error", "0")
        .when(F.col("event_type") == "purchase", "1")
        .when(F.col("event_type") == "signup", "3")
        .when(F.col("event_type") == "view", "4")
        .otherwise("2")
    )
    return events.select(
        F.col("user_id").cast("string").alias("id"), answer.alias("answer"), F.col("event_id").alias("answered_at")
    )


def annotation_merge(spark: SparkSession, folder: str) -> DataFrame:
    return D.annotation_merge(T.annotations(spark, folder), _answers(spark, folder))


def annotation_progress(spark: SparkSession, folder: str) -> DataFrame:
    return D.annotation_progress(T.annotations(spark, folder))


def annotation_progress_running(spark: SparkSession, folder: str) -> DataFrame:
    return D.annotation_progress_running(_answers(spark, folder)).select("answered_at", "annotated", "negatives")


def highlight_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    marked = X.highlight_terms(F.col("text"), ["the", "der", "les"], "<<MARK>>")
    return docs.select("id", F.md5(marked).alias("text_md5"), (F.char_length(marked) - F.char_length("text")).cast("long").alias("grown"))


def sort_by_time(spark: SparkSession, folder: str) -> DataFrame:
    posts = T.event_tweets(spark, folder).select(F.col("Date").alias("datetime"), F.col("ID").alias("id"))
    return D.sort_by_time(posts).select("id", T.epoch("datetime").alias("epoch"))


def top_k(spark: SparkSession, folder: str) -> DataFrame:
    orders = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return D.top_k(orders, "o_totalprice")


def results_filter(spark: SparkSession, folder: str) -> DataFrame:
    parts = T.table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("Name"))
    return D.results_filter(parts, "AN")


def infer_types(spark: SparkSession, folder: str) -> DataFrame:
    events = T.table(spark, folder, "events")
    raw = events.select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    typed = P.infer_types(raw, {"value": "double", "k": "long"})
    return typed.select("event_id", T.r6("value").alias("value"), "k")


QUERIES = {
    "read_posts_by_id": read_posts_by_id,
    "read_columnar_json": read_columnar_json,
    "read_annotations": read_annotations,
    "read_edgelist": read_edgelist,
    "read_weighted_edgelist": read_weighted_edgelist,
    "read_undirected_edgelist": read_undirected_edgelist,
    "read_messages": read_messages_query,
    "header_fields": header_fields,
    "write_json": write_json,
    "write_edgelist_csv": write_edgelist_csv,
    "write_node_metadata_csv": write_node_metadata_csv,
    "write_graphml": write_graphml,
    "filter_posts_window": filter_posts_window,
    "search_posts": search_posts,
    "drop_removed": drop_removed,
    "project_submission": project_submission,
    "project_tweet": project_tweet,
    "parse_date": parse_date_query,
    "post_text": post_text,
    "label_irrelevant": label_irrelevant,
    "label_annotated": label_annotated,
    "train_dataset": train_dataset,
    "alt_dataset": alt_dataset,
    "total_dataset": total_dataset,
    "epoch_to_timestamp": epoch_query,
    "drop_irrelevant": drop_irrelevant,
    "annotation_queue": annotation_queue,
    "annotation_merge": annotation_merge,
    "annotation_progress": annotation_progress,
    "annotation_progress_running": annotation_progress_running,
    "highlight_terms": highlight_terms,
    "sort_by_time": sort_by_time,
    "top_k": top_k,
    "results_filter": results_filter,
    "infer_types": infer_types,
}

_POSTS = """posts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS score, text AS selftext, source AS title,
         1704067200.0::DOUBLE + doc_id * 61.5::DOUBLE AS created_utc,
         (doc_id % 100) / 100.0::DOUBLE AS upvote_ratio, doc_id % 17 AS num_comments, lang
  FROM documents)"""

_LABELLED = """irr AS (
  SELECT CASE WHEN lang = 'en' THEN source || ' ' || text ELSE text END AS text,
         CASE WHEN lang = 'en' THEN 'reddit_post' ELSE 'tweet' END AS type,
         CAST(l.doc_id AS VARCHAR) AS id, '2' AS target,
         CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS block
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1),
ann AS (
  SELECT CASE WHEN lang = 'en' THEN source || ' ' || text ELSE text END AS text,
         CASE WHEN lang = 'en' THEN 'reddit_post' ELSE 'tweet' END AS type,
         CAST(l.doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS target,
         CASE WHEN lang = 'en' THEN 2 ELSE 3 END AS block
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 0)"""

_ANSWERS = """answers AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS answered_at,
         CASE event_type WHEN 'error' THEN '0' WHEN 'purchase' THEN '1' WHEN 'signup' THEN '3'
                         WHEN 'view' THEN '4' ELSE '2' END AS answer
  FROM events)"""

_NOTES = """notes AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN toxic = 0 THEN CAST(quality AS VARCHAR) END AS target, toxic = 1 AS is_irrelevant
  FROM labels)"""

SQL = {
    "read_posts_by_id": f"""WITH {_POSTS}
SELECT id, title, score, md5(selftext) AS text_md5, created_utc, upvote_ratio, num_comments,
       true AS no_author FROM posts""",
    "read_columnar_json": """SELECT event_id AS row_idx, CAST(user_id AS VARCHAR) AS "UserID",
       event_type || ' ' || props AS "Content", CAST(event_id AS VARCHAR) AS "ID",
       CAST(floor(value) AS BIGINT) AS "LikeCount" FROM events""",
    "read_annotations": f"WITH {_NOTES} SELECT id, target, is_irrelevant FROM notes",
    "read_edgelist": f"WITH {T.USER_GRAPH_SQL} SELECT source, target, weight FROM edges",
    "read_weighted_edgelist": f"WITH {T.USER_GRAPH_SQL} SELECT source, target, weight FROM edges",
    "read_undirected_edgelist": f"""WITH {T.USER_GRAPH_SQL}
SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target,
       length(source || target) AS weight FROM edges""",
    "read_messages": """SELECT 's' || s_suppkey || '@shop.example' AS sender,
       'n' || s_nationkey || '@nation.example' AS recipient, s_name AS subject FROM supplier""",
    "header_fields": """SELECT CAST(o_orderkey AS VARCHAR) AS message,
       'c' || o_custkey || '@shop.example' AS sender, o_orderpriority LIKE '1%' AS has_xto,
       CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 1 + count(*) END AS parts,
       CASE WHEN o_orderpriority LIKE '2%' THEN 'c' || o_custkey || '@shop.example' END AS cc
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_custkey, o_orderpriority""",
    "write_json": f"""WITH {_POSTS}
SELECT id, score, md5(selftext) AS text_md5, created_utc FROM posts""",
    "write_edgelist_csv": f"""WITH {T.USER_GRAPH_SQL}
SELECT row_number() OVER (ORDER BY source, target) - 1 AS id, source, target, weight FROM edges""",
    "write_node_metadata_csv": """SELECT c_name AS id, c_mktsegment || '/' || c_name AS "Name" FROM customer""",
    "write_graphml": f"""WITH {T.USER_GRAPH_SQL}
SELECT '<node id="' || c_custkey || '"><data key="d0">' || c_name || ' &amp; ' || c_mktsegment || '/'
       || c_name || '</data></node>' AS line FROM customer
UNION ALL
SELECT '<edge source="' || source || '" target="' || target || '"><data key="d1">' || weight
       || '</data></edge>' FROM edges""",
    "filter_posts_window": f"""WITH {_POSTS}
SELECT id, created_utc, title AS subreddit FROM posts
WHERE created_utc > 1704070000.0 AND created_utc < 1704110000.0 AND title = 'src3'
  AND num_comments < 12 AND regexp_matches(selftext, 'the|der|la', 'i')""",
    "search_posts": """WITH p AS (
  SELECT doc_id AS "ID", md5(text) AS text_md5, text, DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS d FROM documents)
SELECT "ID", text_md5, CAST(d AS VARCHAR) AS day FROM p
WHERE d >= DATE '2020-03-01' AND d < DATE '2022-04-15' AND regexp_matches(text, 'license|idiot|nicht', 'i')""",
    "drop_removed": """WITH p AS (SELECT o_orderkey AS id,
  CASE WHEN o_orderstatus = 'F' THEN '[removed]' WHEN o_orderpriority LIKE '5%' THEN '[deleted]'
       WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END AS selftext FROM orders)
SELECT id, selftext FROM p WHERE selftext IS NULL OR selftext NOT IN ('[removed]', '[deleted]')""",
    "project_submission": f"""WITH {_POSTS}
SELECT id, score, title, num_comments, CASE WHEN num_comments > 3 THEN title END AS author_name,
       CASE WHEN num_comments > 3 THEN id END AS author_id, num_comments <= 3 AS no_author
FROM posts""",
    "project_tweet": """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS "Date", CAST(user_id AS VARCHAR) AS "UserID",
       event_type AS "Content", CAST(event_id AS VARCHAR) AS "ID",
       CAST(floor(value) AS BIGINT) AS "LikeCount", 0 AS "ReplyCount", user_id % 9 AS "RetweetCount",
       CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END AS "QuotedTweet",
       CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END AS "RetweetedTweet" FROM events""",
    "parse_date": "SELECT event_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS epoch FROM events",
    "post_text": "SELECT p_partkey, p_name || ' ' || p_type AS text FROM part",
    "label_irrelevant": f"WITH {_LABELLED} SELECT md5(text) AS text, type, id, target FROM irr",
    "label_annotated": f"""WITH {_LABELLED}
SELECT md5(text) AS text, type, id, target FROM ann""",
    "train_dataset": f"WITH {_LABELLED} SELECT md5(text) AS text, type, id, target FROM ann",
    "alt_dataset": f"""WITH {_LABELLED}, u AS (SELECT * FROM irr UNION ALL SELECT * FROM ann)
SELECT md5(text) AS text, type, id, target, block,
       row_number() OVER (ORDER BY block, id) - 1 AS idx FROM u""",
    "total_dataset": f"""WITH {_POSTS}
SELECT 'reddit_post' AS type, id, md5(title || ' ' || selftext) AS text_md5,
       CAST(floor(created_utc) AS BIGINT) AS epoch FROM posts
UNION ALL
SELECT 'tweet', CAST(event_id AS VARCHAR), md5(event_type || ' ' || props),
       CAST(floor(epoch(ts)) AS BIGINT) FROM events""",
    "epoch_to_timestamp": """SELECT event_id,
       strftime(date_trunc('second', ts) + INTERVAL 250 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS moment
FROM events""",
    "drop_irrelevant": f"WITH {_NOTES} SELECT id, target FROM notes WHERE NOT is_irrelevant",
    "annotation_queue": """SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS chars,
       md5(doc_id || '|42') AS order_key
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY order_key""",
    "annotation_merge": f"""WITH {_NOTES}, {_ANSWERS},
latest AS (SELECT id, arg_max(answer, answered_at) AS answer FROM answers WHERE answer <> '4' GROUP BY id)
SELECT id, target, is_irrelevant FROM notes
UNION ALL
SELECT id, CASE WHEN answer <> '3' THEN answer END, answer = '3' FROM latest
WHERE id NOT IN (SELECT id FROM notes)""",
    "annotation_progress": f"""WITH {_NOTES}
SELECT count(*) FILTER (WHERE NOT is_irrelevant) AS annotated,
       count(*) FILTER (WHERE NOT is_irrelevant AND target = '0') AS negatives FROM notes""",
    "annotation_progress_running": f"""WITH {_ANSWERS}
SELECT answered_at, CAST(sum(CASE WHEN answer IN ('3', '4') THEN 0 ELSE 1 END) OVER w AS BIGINT) AS annotated,
       CAST(sum(CASE WHEN answer = '0' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS negatives
FROM answers WINDOW w AS (ORDER BY answered_at, id)""",
    "highlight_terms": """SELECT CAST(doc_id AS VARCHAR) AS id,
       md5(regexp_replace(text, 'the|der|les', '<<MARK>>', 'gi')) AS text_md5,
       length(regexp_replace(text, 'the|der|les', '<<MARK>>', 'gi')) - length(text) AS grown
FROM documents""",
    "sort_by_time": """SELECT CAST(event_id AS VARCHAR) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch
FROM events ORDER BY ts, id""",
    "top_k": "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, id LIMIT 10",
    "results_filter": "SELECT p_partkey, p_type AS \"Name\" FROM part WHERE contains(p_type, 'AN')",
    "infer_types": """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 6) END AS value,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
}
