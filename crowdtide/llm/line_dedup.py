r"""Line dedup over documents of any number, returning bitmaps of the lines that stay.

A line's key is the line without blanks at both ends, A-Z lowered. Texts are cut once into
(key hash, document, position) and only these travel on. They are range-partitioned by key hash and
document and sorted by key hash, document and position, so every task streams along its range and the
first row of a key and document is that document's first occurrence. The first occurrences are added
up per key, at first within the ranges and then over them: a key that a third of all documents hold
fills several ranges, as the document is part of the order, and leaves one partial sum in each.

Keys found in enough documents lose their lines. What returns is, per document, a compressed bitmap:
words of 64 lines each, and only those words in which a line goes. Texts are not part of it;
``apply_bitmaps`` joins them when the cleaned texts are wanted.

All of it is DataFrame functions. Hashes have 128 bits from two seeds.

A document is a ``doc_id``. Rows that repeat an id count as one document, and each row keeps a bitmap
of its own, by the hash of its text; a null id is a document like others. A null text counts as empty
and an empty text is one empty line. Lines with an empty key always stay. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from crowdtide.llm import frames
from crowdtide.scratch import materialize

MIN_DOCS = 10
#: Blanks at the ends of a line; a line holds no newline itself.
BLANKS = " \t\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ("doc_id", "text_hash")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; plain ASCII takes the fast way of the built-in function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line with a key, ``pos`` from 0."""
    text = frames.text_column()
    cut = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(text_lines(text)).alias("pos", "line"))
    keyed = cut.select(*_DOC, "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).filter("key <> ''")
    # a first column of another value starts the second hash from another seed
    return keyed.select(*_DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent_keys(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n, first): keys of at least ``min_docs`` documents and their first occurrence of all.

    ``hashes`` should be a written table, as range partitioning samples it first.
    """
    order = ["h1", "h2", "doc_id", "text_hash", "pos"]
    ranges = hashes.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions(*order)
    # the partitioning already holds a key's rows of a document together: no further shuffle or sort
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("text_hash", "pos")
    firsts = ranges.withColumn("nth", F.row_number().over(stream)).filter("nth = 1")
    place = F.struct(F.col("doc_id").isNull().alias("none"), *_DOC, "pos")
    found = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return found.filter(F.col("n") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, spare_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_dropped, words): what goes from each document that loses a line.

    ``words`` is an array of (word, keep): bit ``i`` of ``keep`` is set if line ``64 * word + i``
    stays. Words without a line that goes are left out, and so are documents without one.
    ``spare_first`` keeps the first occurrence of a key, that of the smallest document and position.
    """
    hashes = materialize(line_hashes(docs), "line-hashes")
    # Written, so that its size is known: a small table is broadcast, a large one joined by shuffles
    # that adaptive execution splits at hot keys.
    frequent = materialize(frequent_keys(hashes, min_docs), "frequent-lines")
    lost = hashes.join(frequent, ["h1", "h2"])
    if spare_first:
        same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        lost = lost.filter(~(same & (F.col("pos") == F.col("first.pos"))))
    # repeated rows of one document give the same bits, so bits are merged and not added
    bit = F.expr("shiftleft(1L, cast(pos % 64 AS int))")
    words = lost.groupBy(*_DOC, F.expr("cast(pos div 64 AS int)").alias("word")).agg(F.bit_or(bit).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("keep"))
    return words.groupBy(*_DOC).agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("words")
    )


def kept_text(text: Column, words: Column) -> Column:
    """The text without the lines that the bitmap drops."""
    gone = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w["keep"], i) == 0),
                lambda i: w["word"] * 64 + i,
            ),
        )
    )
    lines = text_lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(words.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, the cleaned ``text``, n_lines (before) and n_dropped of every document."""
    text = frames.text_column()
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    marks = bitmaps.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n_dropped", "words")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return own.join(marks, same, "left").select(
        "doc_id", kept_text(F.col("text"), F.col("words")).alias("text"),
        (newlines + 1).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Line counts and a digest of the lines kept of every document."""
    docs = frames.table(spark, folder, "documents").select("doc_id", "text")
    cleaned = apply_bitmaps(docs, materialize(keep_bitmaps(docs), "bitmaps"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT row, doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) >= {MIN_DOCS})
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.row, k.doc_id
"""
