"""Text features: vocabulary, token ids, term counts, TF-IDF in long form, shortening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crowdtide.functions import text as X
from crowdtide.operators.scale import dealt_texts, lookup, ordered_index, quantile_name, quantiles
from crowdtide.scratch import materialize


# --- shortening ---------------------------------------------------------------------------


def shorten_text(
    df: DataFrame,
    text_col: str = "text",
    out: str = "short",
    window: int = 10,
    keywords: Sequence[str] = X.KEYWORDS,
    sep: str = X.SEPARATOR,
    max_length: Column | float | None = None,
) -> DataFrame:
    """Keep the words around words that start with a keyword.

    Every hit is followed by up to ``window + 1`` words; the last of them writes the separator,
    unless the next hit comes first. A hit outside such a run, or on its last word, opens a new
    one: separator, the words before it except the nearest, the hit. A hit's share depends only
    on its neighbours, so the output is put together from slices, in time linear in the text.
    With ``max_length`` the output ends, with a separator, after the word that made it longer.
    """
    reach = window + 1
    pattern = X.keyword_pattern(keywords).replace("(?iu)", "(?iu)^")
    nothing = F.array().cast("array<struct<text:string,at:int>>")

    def item(text: Column, at: Column) -> Column:
        return F.struct(text.alias("text"), at.cast("int").alias("at"))

    mark = F.lit(sep)
    staged = df.withColumn("_w", X.words(F.col(text_col)))
    staged = staged.withColumn(
        "_hits",
        F.filter(F.transform("_w", lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull()),
    )
    size = F.size("_w")

    def share(hit: Column, k: Column) -> Column:
        previous = F.get(F.col("_hits"), k - 1)
        following = F.coalesce(F.get(F.col("_hits"), k + 1), size)
        first = F.greatest(F.lit(0), hit - window)
        lead = F.slice("_w", first + 1, F.greatest(F.lit(0), hit - 1 - first))
        opening = F.concat(
            F.array(item(mark, hit)),
            F.transform(lead, lambda w: item(w, hit)),
            F.array(item(F.get(F.col("_w"), hit), hit)),
        )
        last = F.least(following, hit + reach, size - 1)
        run = F.transform(F.slice("_w", hit + 2, last - hit), lambda w, j: item(w, hit + 1 + j))
        return F.concat(
            F.when((k == 0) | (hit - previous >= reach), opening).otherwise(nothing),
            run,
            F.when(last == hit + reach, F.array(item(mark, last))).otherwise(nothing),
        )

    staged = staged.withColumn("_items", F.flatten(F.transform("_hits", share)))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["text"]), " ")

    result = joined(F.col("_items"))
    if max_length is not None:
        limit = max_length if isinstance(max_length, Column) else F.lit(float(max_length))
        staged = staged.withColumn("_cut", F.get(F.col("_items"), F.floor(limit).cast("int"))["at"])
        cut = F.concat(
            F.filter("_items", lambda x: x["at"] <= F.col("_cut")),
            F.when(F.col("_cut") < size - 1, F.array(item(mark, F.col("_cut")))).otherwise(nothing),
        )
        result = F.when(F.col("_cut").isNull(), result).otherwise(joined(cut))
    return staged.withColumn(out, result).drop("_w", "_hits", "_items", "_cut")


def auto_max_length(df: DataFrame, text_col: str = "text", p: float = 0.6, **sizes: int) -> DataFrame:
    """One row: the quantile of the text lengths in characters.

    It is rounded to nine places, as an interpolation error just below a whole number would
    change a limit on counts.
    """
    lengths = df.select(F.char_length(text_col).alias("length"))
    return quantiles(lengths, [], ["length"], [p], **sizes).select(
        F.round(quantile_name("length", p), 9).alias("max_length")
    )


def shorten_long_texts(
    df: DataFrame, text_col: str = "text", out: str = "short", **options
) -> DataFrame:
    """Replace links, and shorten the texts that are at least as long as the automatic limit.

    The limit is a number of characters that also limits the words of the output.
    """
    limit = auto_max_length(df, text_col).scalar()
    marked = df.withColumn("_limit", limit).withColumn(
        "_linked", X.replace_links_chars(F.col(text_col))
    )
    is_long = F.char_length(text_col) >= F.col("_limit")
    short = shorten_text(
        marked.withColumn("_source", F.when(is_long, F.col("_linked"))),
        "_source", "_short", max_length=F.col("_limit"), **options,
    )
    return short.withColumn(out, F.when(is_long, F.col("_short")).otherwise(F.col("_linked"))).drop(
        "_limit", "_linked", "_source", "_short"
    )


# --- vocabulary and token ids -------------------------------------------------------------


def units(text: Column, mode: str) -> Column:
    if mode == "word":
        return X.words(text)
    if mode == "character":
        return X.characters(text)
    raise ValueError(f"unknown mode {mode!r}")


def build_vocab(
    df: DataFrame, text_col: str = "text", mode: str = "word", max_tokens: int | None = None
) -> DataFrame:
    """Tokens by falling frequency, ties by token; the first ``max_tokens`` if given."""
    counts = (
        df.select(F.explode(units(F.col(text_col), mode)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
        .orderBy(F.col("freq").desc(), "token")
    )
    return counts if max_tokens is None else counts.limit(max_tokens)


def index_vocab(vocab: DataFrame, first: int = 2) -> DataFrame:
    """Number the tokens from 2; 0 is padding and 1 an unknown token."""
    return ordered_index(materialize(vocab, "vocab"), [-F.col("freq"), "token"], "token_id", first)


def vectorize_text(
    df: DataFrame,
    vocab: DataFrame,
    text_col: str = "text",
    id_col: str = "id",
    mode: str = "word",
    standardize: str | None = "lower_and_strip_punctuation",
) -> DataFrame:
    """Token ids of every text in order, unknown tokens as 1; ``vocab`` from ``index_vocab``."""
    text = F.col(text_col)
    if standardize:
        text = X.standardize(text, standardize)
    # The texts are hashed by id before they are cut, and a written vocabulary has a known size: where it
    # is small enough to be broadcast, the tokens of a text are found and gathered where they are.
    known_tokens = materialize(vocab.select("token", "token_id"), "token-ids")
    texts = dealt_texts(df.select(id_col, text_col), id_col, text_col)
    positions = texts.select(id_col, F.posexplode(units(text, mode)).alias("pos", "token"))
    known = positions.join(known_tokens, "token", "left")
    lists = known.groupBy(id_col).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(1)).cast("int").alias("t")))
            ),
            lambda s: s["t"],
        ).alias("tokens")
    )
    return df.select(id_col).join(lists, id_col, "left").select(
        id_col, F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens")
    )


# --- TF-IDF in long form ------------------------------------------------------------------


def term_rows(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "id",
    ngram_range: tuple[int, int] = (1, 1),
    analyzer: str = "word",
    longest: bool = False,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per term occurrence: (id, also ..., term).

    With ``longest`` and characters there is one row per place instead: the longest term that starts
    there, whose beginnings are the others.
    """
    lo, hi = ngram_range
    if analyzer == "word":
        staged = df.select(F.col(id_col).alias("id"), *also, X.tokenize_word(F.col(text_col)).alias("_u"))
        terms = X.ngrams(F.col("_u"), lo, hi)
    elif analyzer == "char":
        staged = df.select(
            F.col(id_col).alias("id"), *also,
            X.characters(X.collapse_whitespace(F.col(text_col))).alias("_u"),
        )
        terms = X.longest_char_ngrams(F.col("_u"), lo, hi) if longest else X.char_ngrams(F.col("_u"), lo, hi)
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    return staged.select("id", *also, F.explode(terms).alias("term"))


def char_term_totals(df: DataFrame, text_col: str = "text", id_col: str = "id", ngram_range: tuple[int, int] = (3, 5)) -> DataFrame:
    """(term, tf): uses of every character n-gram over all texts.

    Only the longest n-gram of every place is counted; the shorter ones are beginnings of the
    different ones that are left.
    """
    lo, hi = ngram_range
    places = term_rows(df, text_col, id_col, ngram_range, "char", longest=True)
    counted = places.groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = F.sequence(F.lit(lo), F.char_length("term"))
    parts = counted.select(F.explode(F.transform(lengths, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("term"), "tf")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"))


def term_counts(
    df: DataFrame, text_col: str = "text", id_col: str = "id", also: tuple[str, ...] = (), **options
) -> DataFrame:
    """(id, also ..., term, tf) of texts with unique ids.

    The texts are hashed by id before they are cut into terms, which moves far less than the
    terms would, and the terms are then counted where they are, in tasks of about equal text.
    """
    texts = dealt_texts(df.select(id_col, *also, text_col), id_col, text_col)
    rows = term_rows(texts, text_col, id_col, also=also, **options)
    return rows.groupBy("id", *also, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """Terms in at least ``min_df`` texts; ``counts`` has one row per (id, term)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)


def tfidf_fit(df: DataFrame, min_df: int = 1, **options) -> DataFrame:
    """(term, df, idf) learned on ``df``; the number of texts includes those without terms."""
    frequencies = doc_freq(term_counts(df, **options), min_df)
    n = df.agg(F.count(F.lit(1))).scalar()
    return frequencies.withColumn("idf", F.ln((1 + n) / (1 + F.col("df"))) + 1)


def tfidf_transform(df: DataFrame, fitted: DataFrame, **options) -> DataFrame:
    """(id, term, tf, w) with rows of unit length; terms that were not fitted are dropped."""
    fitted = materialize(fitted.select("term", "df", "idf"), "fitted")
    weighted = lookup(term_counts(df, **options), fitted, "term", "df", ["idf"], "id").select(
        "id", "term", "tf", (F.col("tf") * F.col("idf")).alias("_w")
    )
    # A window per text is bounded by the terms of one text and needs a single shuffle.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("id")))
    return weighted.select("id", "term", "tf", (F.col("_w") / norm).alias("w"))
