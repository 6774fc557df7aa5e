"""Posts and annotations: JSON readers, filters and projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.functions.text import matches_query
from crowdtide.sources.schemas import AUTHOR, POST_COLUMNS, TWEET_COLUMNS

REMOVED = ("[removed]", "[deleted]")


STRICT = {"mode": "FAILFAST"}  # a broken object fails the read instead of vanishing


def _objects(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """JSON texts that are objects, one per row in column ``value``.

    ``file``: each file is one object. ``lines``: each line is one object.
    """
    if layout not in ("file", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    texts = spark.read.text(path, wholetext=layout == "file")
    return texts.filter(F.trim("value") != "")


def _indented_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of objects written with four-space indents whose values are objects.

    A file is split at the end of each entry, so one large file is still read by many tasks.
    """
    entry = F.regexp_replace(F.col("value"), r"^\{\s*\n|\n    \}\s*\}\s*$", "")
    return (
        spark.read.text(path, lineSep="\n    },\n")
        .filter(~F.col("value").rlike(r"^\s*\{?\s*\}?\s*$"))
        .select(F.concat(F.lit("{"), entry, F.lit("}}")).alias("value"))
    )


def read_posts_by_id(
    spark: SparkSession, path: str, columns: Mapping[str, str] = POST_COLUMNS, layout: str = "file"
) -> DataFrame:
    """Object keyed by post id to one row per post; layouts ``file``, ``lines``, ``indented``."""
    fields = ", ".join(f"{c}: {t}" for c, t in columns.items())
    entries = f"map<string, struct<{fields}>>"
    texts = _indented_entries(spark, path) if layout == "indented" else _objects(spark, path, layout)
    rows = texts.select(F.explode(F.from_json("value", entries, STRICT)).alias("id", "_post"))
    return rows.select("id", "_post.*")


def read_columnar_json(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] = TWEET_COLUMNS,
    layout: str = "file",
    index: str = "row_idx",
) -> DataFrame:
    """Column-oriented objects (``{column: {row: value}}``) to rows.

    Every column lists the same rows in the same order; anything else fails the read.
    """
    shape = ", ".join(f"{c} map<string,{t}>" for c, t in columns.items())
    maps = _objects(spark, path, layout).select(F.from_json("value", shape, STRICT).alias("_o")).select("_o.*")
    first = next(iter(columns))
    same_rows = F.lit(True)
    for c in columns:
        same_rows = same_rows & F.map_keys(c).eqNullSafe(F.map_keys(first))
    zipped = F.arrays_zip(
        F.map_keys(first).alias(index), *[F.map_values(c).alias(c) for c in columns]
    )
    checked = F.when(same_rows, zipped).otherwise(
        F.raise_error(F.lit("columns do not list the same rows"))
    )
    names = [index, *columns]
    rows = maps.select(F.explode(checked).alias("_row"))
    return rows.select(
        *[
            (F.col("_row")[name].cast("long") if name == index else F.col("_row")[name]).alias(name)
            for name in names
        ]
    )


def read_annotations(spark: SparkSession, path: str, layout: str = "file") -> DataFrame:
    """Label object with a nested ``irrelevant`` object to (id, target, is_irrelevant)."""
    flat = "map<string, string>"
    entries = _objects(spark, path, layout).select(
        F.explode(F.from_json("value", flat, STRICT)).alias("key", "value")
    )
    is_nested = F.col("key") == "irrelevant"
    rows = F.when(
        is_nested,
        F.transform(
            F.map_keys(F.from_json("value", flat, STRICT)),
            lambda k: F.struct(
                k.alias("id"),
                F.lit(None).cast("string").alias("target"),
                F.lit(True).alias("is_irrelevant"),
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.col("key").alias("id"),
                F.col("value").alias("target"),
                F.lit(False).alias("is_irrelevant"),
            )
        )
    )
    return entries.select(F.inline(rows))


def drop_removed(posts: DataFrame, col: str = "selftext") -> DataFrame:
    """Posts whose text is not a removal mark; posts without text stay."""
    return posts.filter(F.col(col).isNull() | ~F.col(col).isin(*REMOVED))


def filter_posts_window(
    posts: DataFrame,
    after: Column | int,
    before: Column | int,
    subreddit: str | None = None,
    query: str | None = None,
    time_col: str = "created_utc",
    text_col: str = "text",
) -> DataFrame:
    """Text posts of a subreddit in an open time window, not removed, that match a query.

    The flags ``is_self``, ``user_removed`` and ``mod_removed`` are used where present.
    """
    kept = posts.filter((F.col(time_col) > after) & (F.col(time_col) < before))
    if subreddit is not None:
        kept = kept.filter(F.col("subreddit") == subreddit)
    for flag, wanted in (("is_self", True), ("user_removed", False), ("mod_removed", False)):
        if flag in posts.columns:
            kept = kept.filter(F.col(flag) == F.lit(wanted))
    if query is not None:
        kept = kept.filter(matches_query(F.col(text_col), query))
    return kept


def search_posts(
    posts: DataFrame,
    since: str,
    until: str,
    query: str = "gme|gamestop",
    time_col: str = "Date",
    text_col: str = "Content",
) -> DataFrame:
    """Posts with a keyword, from ``since`` up to but not including ``until`` (dates)."""
    moment = F.col(time_col)
    in_time = (moment >= F.lit(since).cast("timestamp_ntz")) & (
        moment < F.lit(until).cast("timestamp_ntz")
    )
    return posts.filter(in_time & matches_query(F.col(text_col), query))


def project_submission(raw: DataFrame) -> DataFrame:
    """Id, the six kept fields, and the author as a struct or null."""
    author = F.when(
        F.col("author").isNotNull(), F.struct(F.col("author.name"), F.col("author.id"))
    ).cast(AUTHOR)
    return raw.select(
        "id", "score", "selftext", "title", "created_utc", "upvote_ratio", "num_comments",
        author.alias("author"),
    )


def project_tweet(raw: DataFrame) -> DataFrame:
    """The nine kept columns; ids of quoted and repeated posts, or null."""
    return raw.select(
        F.col("date").alias("Date"),
        F.col("user.id").cast("string").alias("UserID"),
        F.col("content").alias("Content"),
        F.col("id").cast("string").alias("ID"),
        F.col("likeCount").alias("LikeCount"),
        F.col("replyCount").alias("ReplyCount"),
        F.col("retweetCount").alias("RetweetCount"),
        F.col("quotedTweet.id").cast("string").alias("QuotedTweet"),
        F.col("retweetedTweet.id").cast("string").alias("RetweetedTweet"),
    )


def infer_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns to declared types; a value that does not fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})

