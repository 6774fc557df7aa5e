"""Declared schemas of the landed data, as column types by name or as DDL."""

from __future__ import annotations

AUTHOR = "struct<name:string,id:string>"

POST_COLUMNS = {
    "score": "long",
    "selftext": "string",
    "title": "string",
    "created_utc": "double",
    "upvote_ratio": "double",
    "num_comments": "long",
    "author": AUTHOR,
}

TWEET_COLUMNS = {
    "Date": "string",
    "UserID": "string",
    "Content": "string",
    "ID": "string",
    "LikeCount": "long",
    "ReplyCount": "long",
    "RetweetCount": "long",
    "QuotedTweet": "string",
    "RetweetedTweet": "string",
}

EDGES = "source string, target string, weight long"
EDGE_FILE = "id long, source string, target string, weight long"
