"""Post scores and sentiment over time."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, functions as F

from crowdtide.operators.datasets import REDDIT, TWEET
from crowdtide.operators.stats import day_of, fill_calendar

LABEL_NAMES = {0: "negative", 1: "positive", 2: "neutral"}
MODES = {"both": None, "reddit": REDDIT, "twitter": TWEET}


def post_score(total: DataFrame, reddit: DataFrame, tweets: DataFrame) -> DataFrame:
    """Add ``score``: votes times vote ratio for Reddit, likes for tweets, else 0.

    The two metric tables become one keyed by (type, id), so the posts are joined once.
    """
    values = reddit.select(
        F.lit(REDDIT).alias("type"), "id", (F.col("score") * F.col("upvote_ratio")).alias("score")
    ).unionByName(
        tweets.select(
            F.lit(TWEET).alias("type"), F.col("ID").alias("id"), F.col("LikeCount").cast("double").alias("score")
        )
    )
    return total.join(values, ["type", "id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def label_name(label: Column) -> Column:
    number = label.cast("int")
    chain = None
    for key, name in LABEL_NAMES.items():
        chain = F.when(number == key, name) if chain is None else chain.when(number == key, name)
    wrong = F.concat(F.lit("no sentiment for label "), F.coalesce(label.cast("string"), F.lit("null")))
    return chain.otherwise(F.raise_error(wrong).cast("string"))


def predict_all(model: Transformer, posts: DataFrame, out: str = "sentiment") -> DataFrame:
    """Posts with the model's sentiment name; a row-wise transform, no join."""
    scored = model.transform(posts)
    return scored.select(*posts.columns, label_name(F.col("prediction")).alias(out))


def _in_mode(posts: DataFrame, mode: str) -> DataFrame:
    kind = MODES[mode]
    return posts if kind is None else posts.filter(F.col("type") == kind)


def sentiment_index() -> Column:
    """(positive − negative) / all scores of a group; null when the scores sum to 0."""
    score = F.col("score")
    signed = F.when(F.col("sentiment") == "positive", score).when(
        F.col("sentiment") == "negative", -score
    )
    return F.try_divide(F.sum(F.coalesce(signed, F.lit(0.0))), F.sum(score))


def sentiment_score(posts: DataFrame, mode: str = "both") -> DataFrame:
    return _in_mode(posts, mode).agg(sentiment_index().alias("score"))


def daily_sentiment(posts: DataFrame, mode: str = "both", time_col: str = "datetime") -> DataFrame:
    """Score of every day from the first to the last; days without posts are 0.

    A day that has posts but whose scores sum to 0 stays null.
    """
    days = _in_mode(posts, mode).groupBy(day_of(time_col).alias("day"))
    return fill_calendar(days.agg(sentiment_index().alias("score")), "day")


def argmax_class(probabilities: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
