"""Labelled and total datasets from posts and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crowdtide.functions.text import post_text
from crowdtide.functions.times import epoch_to_timestamp
from crowdtide.operators.scale import ordered_index, running_totals, seeded_hash

REDDIT, TWEET = "reddit_post", "tweet"
IRRELEVANT = "2"


def reddit_texts(reddit: DataFrame) -> DataFrame:
    return reddit.select("id", post_text(F.col("title"), F.col("selftext")).alias("text"))


def tweet_texts(tweets: DataFrame) -> DataFrame:
    return tweets.select(F.col("ID").alias("id"), F.col("Content").alias("text"))


def drop_irrelevant(annotations: DataFrame) -> DataFrame:
    return annotations.filter(~F.col("is_irrelevant"))


def _attach(labels: DataFrame, texts: DataFrame, kind: str, strict: bool) -> DataFrame:
    """Labels (id, target) with the post text; a label without post fails when strict."""
    posts = texts.select("id", "text", F.lit(True).alias("_found"))
    text = F.col("text")
    if strict:
        text = F.when(F.col("_found"), text).otherwise(
            F.raise_error(F.concat(F.lit("no post with id "), F.col("id"))).cast("string")
        )
    joined = labels.join(posts, "id", "left" if strict else "inner")
    return joined.select(text.alias("text"), F.lit(kind).alias("type"), "id", "target")


def label_irrelevant(
    annotations: DataFrame, texts: DataFrame, kind: str, strict: bool = True
) -> DataFrame:
    """Irrelevant posts of one source with target "2"."""
    labels = annotations.filter("is_irrelevant").select("id", F.lit(IRRELEVANT).alias("target"))
    return _attach(labels, texts, kind, strict)


def label_annotated(
    annotations: DataFrame, texts: DataFrame, kind: str, strict: bool = True
) -> DataFrame:
    """Labelled posts of one source; with ``strict`` a label for an unknown post fails."""
    return _attach(drop_irrelevant(annotations).select("id", "target"), texts, kind, strict)


def train_dataset(
    reddit: DataFrame, reddit_notes: DataFrame, tweets: DataFrame, tweet_notes: DataFrame
) -> DataFrame:
    """Labelled posts of both sources without the irrelevant ones."""
    return label_annotated(reddit_notes, reddit_texts(reddit), REDDIT).unionByName(
        label_annotated(tweet_notes, tweet_texts(tweets), TWEET)
    )


def alt_dataset(
    reddit: DataFrame, reddit_notes: DataFrame, tweets: DataFrame, tweet_notes: DataFrame
) -> DataFrame:
    """Irrelevant and labelled posts of both sources in four blocks, numbered in block order."""
    posts, short = reddit_texts(reddit), tweet_texts(tweets)
    blocks = [
        label_irrelevant(reddit_notes, posts, REDDIT),
        label_irrelevant(tweet_notes, short, TWEET),
        label_annotated(reddit_notes, posts, REDDIT),
        label_annotated(tweet_notes, short, TWEET),
    ]
    rows = blocks[0].withColumn("block", F.lit(0))
    for number, block in enumerate(blocks[1:], start=1):
        rows = rows.unionByName(block.withColumn("block", F.lit(number)))
    return ordered_index(rows, ["block", "id"], "idx")


def total_dataset(reddit: DataFrame, tweets: DataFrame) -> DataFrame:
    """All posts of both sources with one kind of time."""
    posts = reddit.select(
        F.lit(REDDIT).alias("type"),
        post_text(F.col("title"), F.col("selftext")).alias("text"),
        "id",
        epoch_to_timestamp(F.col("created_utc")).alias("datetime"),
    )
    short = tweets.select(
        F.lit(TWEET).alias("type"),
        F.col("Content").alias("text"),
        F.col("ID").alias("id"),
        F.col("Date").cast("timestamp_ntz").alias("datetime"),
    )
    return posts.unionByName(short)


def annotation_queue(posts: DataFrame, annotations: DataFrame, seed: int = 42) -> DataFrame:
    """Posts that are neither labelled nor irrelevant, in seeded random order."""
    open_posts = posts.join(annotations.select("id"), "id", "left_anti")
    return open_posts.withColumn("order_key", seeded_hash(F.col("id"), seed)).orderBy("order_key", "id")


def annotation_merge(annotations: DataFrame, answers: DataFrame) -> DataFrame:
    """Fold answers (id, answer, answered_at) into annotations.

    "4" skips, "3" marks irrelevant, any other answer is the label. The last answer of a post
    counts; a post that was annotated before keeps its old entry.
    """
    latest = (
        answers.filter(F.col("answer") != "4")
        .groupBy("id")
        .agg(F.max_by("answer", "answered_at").alias("answer"))
    )
    is_irrelevant = F.col("answer") == "3"
    new = latest.select(
        "id",
        F.when(~is_irrelevant, F.col("answer")).alias("target"),
        is_irrelevant.alias("is_irrelevant"),
    )
    fresh = new.join(annotations.select("id"), "id", "left_anti")
    return annotations.select("id", "target", "is_irrelevant").unionByName(fresh)


def annotation_progress(annotations: DataFrame) -> DataFrame:
    """Number of labelled posts and of negative ones among them."""
    return annotations.agg(
        F.count_if(~F.col("is_irrelevant")).alias("annotated"),
        F.count_if(~F.col("is_irrelevant") & (F.col("target") == "0")).alias("negatives"),
    )


def annotation_progress_running(answers: DataFrame) -> DataFrame:
    """The two totals after every answer, in order of ``answered_at`` and id.

    Skipped and irrelevant posts leave the totals as they are.
    """
    return running_totals(
        answers,
        ["answered_at", "id"],
        {
            "annotated": (~F.col("answer").isin("3", "4")).cast("long"),
            "negatives": (F.col("answer") == "0").cast("long"),
        },
    )


def sort_by_time(posts: DataFrame, time_col: str = "datetime", id_col: str = "id") -> DataFrame:
    return posts.orderBy(time_col, id_col)


def top_k(df: DataFrame, metric: str, k: int = 10, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(metric).desc(), F.col(tie)).limit(k)


def results_filter(results: DataFrame, part: str = "NB", col: str = "Name") -> DataFrame:
    return results.filter(F.contains(F.col(col), F.lit(part)))

