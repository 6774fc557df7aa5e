"""Queries over text functions and features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.functions import text as X
from crowdtide.operators import features as W
from crowdtide.operators.terms import project
from crowdtide.plans import tables as T

KEYWORDS = ("the", "der", "les")
WINDOW = 3


def replace_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = T.table(spark, folder, "pages")
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" now"))
    return pages.select("page_id", X.replace_links(text).alias("text"), F.md5(X.replace_links(F.col("html"))).alias("html_md5"))


def replace_links_chars(spark: SparkSession, folder: str) -> DataFrame:
    pages = T.table(spark, folder, "pages")
    text = F.concat(F.lit("see "), F.col("url"), F.lit("! now"))
    return pages.select("page_id", X.replace_links_chars(text).alias("text"))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    return docs.select("id", F.md5(X.clean_text(F.col("text"))).alias("text_md5"))


def strip_controls(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    return docs.select("id", F.md5(X.strip_controls(F.col("text"))).alias("text_md5"))


def standardize(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    return docs.select("id", F.md5(X.standardize(F.col("text"))).alias("text_md5"))


def extract_mentions(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    return docs.select("id", F.explode(X.extract_mentions(F.col("text"))).alias("name"))


def shorten_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    short = W.shorten_text(docs, window=WINDOW, keywords=KEYWORDS)
    return short.select("id", F.md5("short").alias("text_md5"), F.char_length("short").cast("long").alias("length"))


def shorten_long_texts(spark: SparkSession, folder: str) -> DataFrame:
    short = W.shorten_long_texts(T.documents(spark, folder), window=WINDOW, keywords=KEYWORDS)
    return short.select("id", F.md5("short").alias("text_md5"), F.char_length("short").cast("long").alias("length"))


def auto_max_length(spark: SparkSession, folder: str) -> DataFrame:
    return W.auto_max_length(T.documents(spark, folder)).select(T.r6("max_length").alias("max_length"))


def build_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return W.build_vocab(T.documents(spark, folder), max_tokens=1000)


def build_vocab_chars(spark: SparkSession, folder: str) -> DataFrame:
    return W.build_vocab(T.documents(spark, folder), mode="character")


def vectorize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids as one text per document; the vocabulary comes from the English half."""
    docs = T.documents(spark, folder)
    train = T.reddit(spark, folder).select("id", X.standardize(F.col("selftext")).alias("text"))
    vocab = W.index_vocab(W.build_vocab(train, max_tokens=500))
    ids = W.vectorize_text(docs, vocab)
    return ids.select("id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def tokenize_word(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder)
    return docs.select("id", F.array_join(X.tokenize_word(F.col("text")), " ").alias("tokens"))


def ngrams(spark: SparkSession, folder: str) -> DataFrame:
    rows = W.term_counts(T.documents(spark, folder), ngram_range=(2, 3))
    return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def char_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return W.char_term_totals(T.documents(spark, folder), ngram_range=(3, 5))


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return W.doc_freq(W.term_counts(T.documents(spark, folder)), 5)


def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Weights learned on one site's posts and applied to all documents."""
    train = T.reddit(spark, folder).select("id", F.col("selftext").alias("text"))
    fitted = W.tfidf_fit(train, min_df=3)
    return W.tfidf_transform(T.documents(spark, folder), fitted).select("id", "term", "tf", T.r6("w").alias("w"))


def pca(spark: SparkSession, folder: str) -> DataFrame:
    """Variance of each projected dimension; it falls from one to the next."""
    vectors = T.table(spark, folder, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    projected = project(vectors, "v", "p", 8).transform(vectors)
    cells = projected.select(F.posexplode(vector_to_array("p")).alias("dim", "x"))
    return cells.groupBy("dim").agg((T.r6(F.avg("x")) + 0.0).alias("mean"), T.r6(F.var_samp("x")).alias("variance"))


def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    """All components together keep the variance of the vectors."""
    vectors = T.table(spark, folder, "embeddings").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    projected = project(vectors, "v", "p", 64).transform(vectors)
    cells = projected.select(F.posexplode(vector_to_array("p")).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.var_samp("x").alias("v")).agg(T.r6(F.sum("v")).alias("variance"))


QUERIES = {
    "replace_links": replace_links,
    "replace_links_chars": replace_links_chars,
    "clean_text": clean_text,
    "strip_controls": strip_controls,
    "standardize": standardize,
    "extract_mentions": extract_mentions,
    "shorten_text": shorten_text,
    "shorten_long_texts": shorten_long_texts,
    "auto_max_length": auto_max_length,
    "build_vocab": build_vocab,
    "build_vocab_chars": build_vocab_chars,
    "vectorize_text": vectorize_text,
    "tokenize_word": tokenize_word,
    "ngrams": ngrams,
    "char_ngrams": char_ngrams,
    "doc_freq": doc_freq,
    "tfidf": tfidf,
    "pca": pca,
    "pca_variance": pca_variance,
}

# The link, mention, bracket and punctuation patterns in the SQL below are fixed values, as in functions/text.py.
_TOKENS = """tokens AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang,
         regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS u FROM documents)"""

_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""

_SHORT_ITEMS = f"""w AS (
  SELECT id, generate_subscripts(u, 1) - 1 AS i, unnest(u) AS word, len(u) AS n FROM words),
h AS (SELECT *, regexp_matches(word, '^(?i)(the|der|les)') AS hit FROM w),
p AS (
  SELECT *, max(CASE WHEN hit THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING) AS last FROM h),
items AS (
  SELECT id, i, n, 0 AS part, 0 AS j, word AS text FROM p WHERE i - last <= {WINDOW + 1}
  UNION ALL SELECT id, i, n, 1, 0, '...' FROM p WHERE i - last = {WINDOW + 1}
  UNION ALL SELECT id, i, n, 2, 0, '...' FROM p WHERE hit AND (last IS NULL OR i - last >= {WINDOW + 1})
  UNION ALL SELECT a.id, a.i, a.n, 3, b.i, b.word FROM p a JOIN p b ON a.id = b.id
    AND b.i >= greatest(0, a.i - {WINDOW}) AND b.i <= a.i - 2
    WHERE a.hit AND (a.last IS NULL OR a.i - a.last >= {WINDOW + 1})
  UNION ALL SELECT id, i, n, 4, 0, word FROM p WHERE hit AND (last IS NULL OR i - last >= {WINDOW + 1})),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, part, j) AS place FROM items)"""

def _pca_sql(k: int, squarings: int = 14) -> str:
    """Variances along the components: powers of the covariance by squaring, then deflation."""
    parts = ["""x AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
y AS MATERIALIZED (SELECT vec_id, d, x - avg(x) OVER (PARTITION BY d) AS y FROM x),
c0 AS MATERIALIZED (
  SELECT a.d AS i, b.d AS j, sum(a.y * b.y) / (count(*) - 1) AS c FROM y a JOIN y b USING (vec_id) GROUP BY 1, 2)"""]
    for n in range(k):
        before = f"c{n}"
        for p in range(squarings):
            parts.append(f"""p{n}_{p} AS MATERIALIZED (
  WITH s AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM {before} a JOIN {before} b ON a.j = b.i GROUP BY 1, 2)
  SELECT i, j, c / (SELECT sum(c) FROM s WHERE i = j) AS c FROM s)""")
            before = f"p{n}_{p}"
        # a column of the power is the component, up to its length
        parts.append(f"""v{n} AS MATERIALIZED (
  WITH s AS (SELECT i, c AS v FROM {before} WHERE j = (SELECT arg_max(j, c) FROM {before} WHERE i = j))
  SELECT i, v / (SELECT sqrt(sum(v * v)) FROM s) AS v FROM s),
l{n} AS MATERIALIZED (SELECT sum(a.v * c * b.v) AS l FROM c{n} m JOIN v{n} a ON a.i = m.i JOIN v{n} b ON b.i = m.j),
c{n + 1} AS MATERIALIZED (SELECT m.i, m.j, c - l * a.v * b.v AS c FROM c{n} m JOIN v{n} a ON a.i = m.i JOIN v{n} b ON b.i = m.j, l{n})""")
    rows = " UNION ALL ".join(f"SELECT {n} AS dim, 0.0::DOUBLE AS mean, round(l, 6) AS variance FROM l{n}" for n in range(k))
    return "WITH " + ",\n".join(parts) + "\n" + rows


SQL = {
    "replace_links": r"""SELECT page_id, regexp_replace('see ' || url || ' now', 'http[s]*:\/\/[^\s]+', '[link]', 'g') AS text,
       md5(regexp_replace(html, 'http[s]*:\/\/[^\s]+', '[link]', 'g')) AS html_md5 FROM pages""",
    "replace_links_chars": r"""SELECT page_id,
       regexp_replace('see ' || url || '! now', 'http[\p{L}\p{N}_:/\.\=\#\?\-\$\&]+', '[link]', 'g') AS text FROM pages""",
    "clean_text": r"""SELECT CAST(doc_id AS VARCHAR) AS id, md5(regexp_replace(lower(regexp_replace(
       replace(text, chr(10), ' '), '[\(\)\[\]\{\}]', ' ', 'g')), 'http[\p{L}\p{N}_:/\.\=\#\?\-\$\&]+', '[link]', 'g'))
       AS text_md5 FROM documents""",
    "strip_controls": """SELECT CAST(doc_id AS VARCHAR) AS id,
       md5(replace(replace(text, chr(10), ''), chr(9), '')) AS text_md5 FROM documents""",
    "standardize": f"""SELECT CAST(doc_id AS VARCHAR) AS id,
       md5(regexp_replace(lower(text), '{_PUNCT}', '', 'g')) AS text_md5 FROM documents""",
    "extract_mentions": r"""SELECT CAST(doc_id AS VARCHAR) AS id,
       unnest(regexp_extract_all(text, '@([\p{L}\p{N}_]+)', 1)) AS name FROM documents""",
    "shorten_text": f"""WITH words AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(text, '\\S+') AS u FROM documents), {_SHORT_ITEMS},
short AS (SELECT id, string_agg(text, ' ' ORDER BY place) AS short FROM placed GROUP BY id)
SELECT d.id, md5(coalesce(short, '')) AS text_md5, length(coalesce(short, '')) AS length
FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d LEFT JOIN short s ON d.id = s.id""",
    "shorten_long_texts": f"""WITH q AS (SELECT round(quantile_cont(length(text), 0.6), 9) AS m FROM documents),
linked AS (SELECT CAST(doc_id AS VARCHAR) AS id, length(text) >= m AS long, m,
  regexp_replace(text, 'http[\\p{{L}}\\p{{N}}_:/\\.\\=\\#\\?\\-\\$\\&]+', '[link]', 'g') AS t FROM documents, q),
words AS (SELECT id, regexp_extract_all(t, '\\S+') AS u FROM linked WHERE long), {_SHORT_ITEMS},
cut AS (SELECT p.id, p.i FROM placed p, q WHERE p.place = floor(m) + 1),
kept AS (
  SELECT p.id, p.place, p.text FROM placed p LEFT JOIN cut c ON p.id = c.id WHERE c.id IS NULL OR p.i <= c.i
  UNION ALL SELECT DISTINCT p.id, 1000000000, '...' FROM placed p JOIN cut c ON p.id = c.id AND p.i = c.i
    WHERE c.i < p.n - 1),
short AS (SELECT id, string_agg(text, ' ' ORDER BY place) AS short FROM kept GROUP BY id),
final AS (SELECT l.id, CASE WHEN long THEN coalesce(short, '') ELSE t END AS s
  FROM linked l LEFT JOIN short s ON l.id = s.id)
SELECT id, md5(s) AS text_md5, length(s) AS length FROM final""",
    "pca": _pca_sql(8),
    "pca_variance": """WITH c AS (
  SELECT generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
v AS (SELECT var_samp(x) AS v FROM c GROUP BY dim)
SELECT round(sum(v), 6) AS variance FROM v""",
    "auto_max_length": "SELECT round(quantile_cont(length(text), 0.6), 6) AS max_length FROM documents",
    "build_vocab": r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM documents)
SELECT token, count(*) AS freq FROM w GROUP BY token ORDER BY freq DESC, token LIMIT 1000""",
    "build_vocab_chars": """WITH w AS (SELECT unnest(string_split(text, '')) AS token FROM documents)
SELECT token, count(*) AS freq FROM w GROUP BY token""",
    "vectorize_text": f"""WITH std AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang,
         regexp_extract_all(regexp_replace(lower(text), '{_PUNCT}', '', 'g'), '\\S+') AS u FROM documents),
w AS (SELECT id, lang, generate_subscripts(u, 1) AS pos, unnest(u) AS token FROM std),
v AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) + 1 AS tid FROM (
  SELECT token, count(*) AS freq FROM w WHERE lang = 'en' GROUP BY token) ORDER BY freq DESC, token LIMIT 500),
j AS (SELECT id, string_agg(CAST(coalesce(tid, 1) AS VARCHAR), ' ' ORDER BY pos) AS tokens
  FROM w LEFT JOIN v ON w.token = v.token GROUP BY id)
SELECT std.id, coalesce(tokens, '') AS tokens FROM std LEFT JOIN j ON std.id = j.id""",
    "tokenize_word": f"WITH {_TOKENS} SELECT id, array_to_string(u, ' ') AS tokens FROM tokens",
    "ngrams": f"""WITH {_TOKENS}, t AS (
  SELECT id, generate_subscripts(u, 1) AS pos, unnest(u) AS a FROM tokens),
n AS (SELECT id, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT id, a || ' ' || b AS term FROM n WHERE b IS NOT NULL
      UNION ALL SELECT id, a || ' ' || b || ' ' || c FROM n WHERE c IS NOT NULL)
SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM g GROUP BY term""",
    "char_ngrams": r"""WITH s AS (
  SELECT doc_id AS id, string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '') AS u FROM documents),
t AS (SELECT id, generate_subscripts(u, 1) AS pos, unnest(u) AS a FROM s),
n AS (SELECT a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d, lead(a, 4) OVER w AS e
      FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT a || b || c AS term FROM n WHERE c IS NOT NULL
      UNION ALL SELECT a || b || c || d FROM n WHERE d IS NOT NULL
      UNION ALL SELECT a || b || c || d || e FROM n WHERE e IS NOT NULL)
SELECT term, count(*) AS tf FROM g GROUP BY term""",
    "doc_freq": f"""WITH {_TOKENS}, t AS (SELECT DISTINCT id, unnest(u) AS term FROM tokens)
SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 5""",
    "tfidf": f"""WITH {_TOKENS}, t AS (SELECT id, lang, unnest(u) AS term FROM tokens),
tf AS (SELECT id, lang, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE lang = 'en')) / (1.0 + count(*))) + 1 AS idf
  FROM tf WHERE lang = 'en' GROUP BY term HAVING count(*) >= 3),
w AS (SELECT id, term, tf, tf * idf AS w FROM tf JOIN idf USING (term)),
n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id)
SELECT w.id, term, tf, round(w / norm, 6) AS w FROM w JOIN n ON w.id = n.id""",
}
