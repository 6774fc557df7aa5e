"""Directed weighted graphs from posts and mail: edges(source, target, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crowdtide.functions.text import extract_mentions, strip_controls
from crowdtide.operators.scale import in_tasks, ordered_index
from crowdtide.scratch import materialize
from crowdtide.sources.messages import header_field, header_lines, split_recipients

MAX_USER_NAME = 15  # longer names cannot be looked up and stay as text


def _as_pairs(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"))


def follower_edges(tweets: DataFrame, followers: DataFrame) -> DataFrame:
    """One (follower, author) pair per follower of every distinct author.

    Only the presence of the author matters, so the posts are a semi join and the (skewed)
    follower table is never multiplied.
    """
    authors = tweets.select(F.col("UserID").alias("user_id"))
    kept = followers.join(authors, "user_id", "left_semi")
    return _as_pairs(kept, "follower_id", "user_id")


def retweet_edges(tweets: DataFrame, retweets: DataFrame) -> DataFrame:
    """(retweeter, author) for every retweet of a known tweet."""
    authors = tweets.select(F.col("ID").alias("tweet_id"), "UserID")
    return _as_pairs(retweets.join(authors, "tweet_id"), "user_id", "UserID")


def mention_edges(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """(author, mentioned user) for every mention.

    Names are looked up in ``users(id, Username)``; unknown names are dropped, names too long
    for a lookup are kept as text. Equal mentions of one author are counted before the lookup.
    """
    named = (
        tweets.select("UserID", F.explode(extract_mentions(F.col("Content"))).alias("name"))
        .groupBy("UserID", "name")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    is_long = F.char_length("name") > MAX_USER_NAME
    lookup = users.groupBy(F.lower("Username").alias("_key")).agg(F.min("id").alias("_id"))
    found = named.filter(~is_long).withColumn("_key", F.lower("name")).join(lookup, "_key")
    source = F.col("UserID").cast("string").alias("source")
    known = found.select(source, F.col("_id").cast("string").alias("target"), "weight")
    kept = named.filter(is_long).select(source, F.col("name").alias("target"), "weight")
    return known.filter("target IS NOT NULL").unionByName(kept)


def accumulate_weights(*pairs: DataFrame) -> DataFrame:
    """Sum repeated edges; rows without a weight count 1. Equal pairs meet on the map side."""
    rows = None
    for part in pairs:
        weight = F.col("weight") if "weight" in part.columns else F.lit(1)
        part = part.select("source", "target", weight.cast("long").alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def email_edges(messages: DataFrame, fields: Sequence[str] = ("to",)) -> DataFrame:
    """Weighted sender → recipient edges of messages(raw).

    Recipients come from To, or from X-To without a To; a message with neither is skipped.
    With "cc" and "bcc" in ``fields`` those are added; a Bcc that occurs in the Cc text is not.
    """
    heads = messages.select(header_lines(F.col("raw")).alias("_lines"))
    names = {"sender": "From", "to": "To", "xto": "X-To", "cc": "Cc", "bcc": "Bcc"}
    parts = heads.select(*[header_field(F.col("_lines"), n).alias(k) for k, n in names.items()])
    direct = F.coalesce("to", "xto")
    none = F.array().cast("array<string>")
    lists = [split_recipients(direct)]
    if "cc" in fields:
        lists.append(F.coalesce(split_recipients(F.col("cc")), none))
    if "bcc" in fields:
        blind = split_recipients(F.col("bcc"))
        if "cc" in fields:
            blind = F.filter(blind, lambda r: F.col("cc").isNull() | ~F.contains(F.col("cc"), r))
        lists.append(F.coalesce(blind, none))
    pairs = parts.filter(direct.isNotNull() & F.col("sender").isNotNull()).select(
        strip_controls(F.col("sender")).alias("source"), F.explode(F.concat(*lists)).alias("target")
    )
    return accumulate_weights(pairs)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def is_address(col: str):
    return F.contains(F.col(col), F.lit("@"))


def non_email_report(edges: DataFrame) -> DataFrame:
    """Nodes that are no mail address, and edges that touch one."""
    touching = edges.filter(~(is_address("source") & is_address("target")))
    count = touching.agg(F.count(F.lit(1))).scalar()
    return (
        nodes_of(touching)
        .filter(~is_address("id"))
        .agg(F.count(F.lit(1)).alias("nodes"))
        .withColumn("edges", count)
    )


def drop_nodes(edges: DataFrame) -> DataFrame:
    """Edges between mail addresses only."""
    return edges.filter(is_address("source") & is_address("target"))


def drop_listed_nodes(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """Edges that touch no node of ``listed(id)``."""
    kept = edges.join(listed.select(F.col("id").alias("source")), "source", "left_anti")
    return kept.join(listed.select(F.col("id").alias("target")), "target", "left_anti").select(*edges.columns)


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    return nodes.join(nodes_of(edges), "id", "left_semi")


def relabel_string(edges: DataFrame) -> DataFrame:
    return edges.withColumns({c: F.col(c).cast("string") for c in ("source", "target")})


def rename_nodes(edges: DataFrame, info: DataFrame, col: str = "Username", merge: str = "sum") -> DataFrame:
    """Replace node ids by ``info[col]``; an id without a name fails.

    Nodes with the same name become one. Their parallel edges are summed, or with
    ``merge="last"`` the edge of the largest (source, target) ids counts.
    """
    names = info.select(F.col("id").cast("string").alias("_id"), F.col(col).alias("_name"))
    # The largest ids are found by sorting; tasks that grow in number keep a sort small.
    named = in_tasks(materialize(edges, "edges"), "source", "target") if merge == "last" else edges
    for end in ("source", "target"):
        missing = F.raise_error(F.concat(F.lit("no name for node "), F.col(f"_{end}"))).cast("string")
        named = (
            named.withColumnRenamed(end, f"_{end}")
            .join(names, F.col(f"_{end}") == F.col("_id"), "left")
            .withColumn(end, F.coalesce(F.col("_name"), missing))
            .drop("_id", "_name")
        )
    if merge == "sum":
        return named.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    if merge == "last":
        return named.groupBy("source", "target").agg(
            F.max_by("weight", F.struct("_source", "_target")).alias("weight")
        )
    raise ValueError(f"unknown merge {merge!r}")


def add_attributes(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attach every attribute column to the nodes; a missing value fails."""
    cols = [c for c in attributes.columns if c != "id"]
    joined = nodes.join(attributes, "id", "left")

    def checked(c: str):
        text = F.concat(F.lit("node "), F.col("id").cast("string"), F.lit(f" has no {c}"))
        kind = dict(attributes.dtypes)[c]
        return F.coalesce(F.col(c), F.raise_error(text).cast(kind)).alias(c)

    return joined.select(*nodes.columns, *[checked(c) for c in cols])


def resolve_users(ids: DataFrame, users: DataFrame) -> DataFrame:
    """(id, Username, Name) for every id.

    Ids that are not numbers name themselves; unknown numbers become ``Unknown#n``, counted
    from 1 in order of id.
    """
    known = users.select(F.col("id").cast("string").alias("id"), "Username", "Name")
    joined = ids.select(F.col("id").cast("string").alias("id")).distinct().join(known, "id", "left")
    numeric = F.col("id").rlike(r"^\p{Nd}+$")
    unresolved = joined.filter(numeric & F.col("Username").isNull())
    label = F.concat(F.lit("Unknown#"), F.col("n").cast("string"))
    numbered = ordered_index(unresolved.select("id"), ["id"], "n", start=1).select(
        "id", label.alias("Username"), label.alias("Name")
    )
    resolved = joined.filter(~numeric | F.col("Username").isNotNull()).select(
        "id",
        F.when(numeric, F.col("Username")).otherwise(F.col("id")).alias("Username"),
        F.when(numeric, F.col("Name")).otherwise(F.col("id")).alias("Name"),
    )
    return resolved.unionByName(numbered)


def join_names(metrics: DataFrame, names: DataFrame) -> DataFrame:
    return metrics.join(names.select("id", "Username", "Name"), "id", "left")
