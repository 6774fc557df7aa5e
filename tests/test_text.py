import random

import pytest
from pyspark.sql import functions as F

from crowdtide.functions import text as X
from crowdtide.operators import features as Fe
from crowdtide.operators import terms as Te


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def expected_short(text, window, keys, sep, limit):
    """The rule stated per word from its last hit, apart from the slices the operator uses."""
    words = text.split()
    reach, last, pieces = window + 1, None, []
    for i, word in enumerate(words):
        piece = []
        if last is not None and i - last <= reach:
            piece.append(word)
        if last is not None and i - last == reach:
            piece.append(sep)
        if word.lower().startswith(keys):
            if last is None or i - last >= reach:
                piece += [sep, *words[max(0, i - window) : max(0, i - 1)], word]
            last = i
        pieces.append(piece)
    out = []
    for piece in pieces:
        if limit is not None and len(out) > limit:
            return " ".join([*out, sep])
        out += piece
    return " ".join(out)


def test_shorten_hand_cases(spark):
    rows = spark.createDataFrame(
        [("a b c d GME e f g h",), ("a $GME b",), ("",), (None,)], "text string"
    )
    got = [r["short"] for r in Fe.shorten_text(rows, window=2).collect()]
    assert got[0] == "... c GME e f g ..."
    assert got[1] == "" and got[2] == "" and not got[3]


@pytest.mark.parametrize("limit", [None, 0, 3, 7.5, 20])
def test_shorten_matches_the_rule(spark, limit):
    rng = random.Random(3)
    texts = [
        " ".join(rng.choice(["gme", "Gamestop!", "a", "bb", "ccc", "dd", "xgme"]) for _ in range(rng.randrange(40)))
        for _ in range(120)
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for window in (0, 1, 3):
        got = Fe.shorten_text(rows, window=window, max_length=limit).orderBy("i").collect()
        for row in got:
            want = expected_short(row["text"], window, ("gme", "gamestop"), "...", limit)
            assert row["short"] == want, row["text"]


def test_shorten_is_linear_in_long_texts(spark):
    text = "gme " + "word " * 200_000 + "gme"
    rows = spark.createDataFrame([(text,)], "text string")
    assert Fe.shorten_text(rows, window=2).first()["short"] == "... gme word word word ... ... word gme"


def test_links_and_cleaning(spark):
    assert _one(spark, "see https://a.b/c?d=1! x", X.replace_links) == "see [link] x"
    assert _one(spark, "see https://a.b/c?d=1! x", X.replace_links_chars) == "see [link]! x"
    assert _one(spark, "A\n(b) [C] http://x.y", X.clean_text) == "a  b   c  [link]"
    assert _one(spark, "a\tb\nc", X.strip_controls) == "abc"
    assert _one(spark, "Don't, STOP.", X.standardize) == "dont stop"
    assert _one(spark, "I like GME and GameStop", X.highlight_terms).count(X.TERM_MARK) == 2


def test_tokens_and_mentions(spark):
    assert _one(spark, "Ein Ääh-Test, a b2 _x 漢字", X.tokenize_word) == ["ein", "ääh", "test", "b2", "_x", "漢字"]
    assert _one(spark, "hi @Ann_1, mail b@c.d @", X.extract_mentions) == ["Ann_1", "c"]


def test_ngrams(spark):
    rows = spark.createDataFrame([("a1 b2 c3",), ("x9",), ("",)], "t string").select(X.tokenize_word(F.col("t")).alias("u"))
    got = [r[0] for r in rows.select(X.ngrams(F.col("u"), 1, 2)).collect()]
    assert got == [["a1", "b2", "c3", "a1 b2", "b2 c3"], ["x9"], []]
    chars = spark.createDataFrame([("A  \n bé",)], "t string").select(
        X.characters(X.collapse_whitespace(F.col("t"))).alias("u")
    )
    assert chars.select(X.char_ngrams(F.col("u"), 2, 3)).first()[0] == ["a ", " b", "bé", "a b", " bé"]


def test_tfidf_hand_case(spark):
    docs = spark.createDataFrame([("1", "aa bb"), ("2", "aa cc")], "id string, text string")
    fitted = Fe.tfidf_fit(docs)
    got = {(r["id"], r["term"]): r["w"] for r in Fe.tfidf_transform(docs, fitted).collect()}
    assert got["1", "aa"] == pytest.approx(0.579739, abs=1e-6)
    assert got["1", "bb"] == pytest.approx(0.814802, abs=1e-6)
    unseen = spark.createDataFrame([("3", "zz aa")], "id string, text string")
    assert Fe.tfidf_transform(unseen, fitted).collect()[0]["w"] == pytest.approx(1.0)


def test_ml_features_equal_long_form(spark):
    docs = spark.createDataFrame(
        [("1", "aa bb http://x.y"), ("2", "aa cc cc"), ("3", "bb")], "id string, text string"
    )
    model = Te.text_features(docs, min_df=1, ngram_range=(1, 2))
    vocabulary = {r["i"]: r["term"] for r in model.terms.collect()}
    assert [vocabulary[i] for i in range(len(vocabulary))] == sorted(vocabulary.values())
    long_form = {
        (r["id"], r["term"]): r["w"]
        for r in Fe.tfidf_transform(docs, Fe.tfidf_fit(docs, ngram_range=(1, 2)), ngram_range=(1, 2)).collect()
    }
    for row in model.with_vectors(model.transform(docs)).collect():
        vector = row["features"]
        cells = {(row["id"], vocabulary[i]): v for i, v in zip(vector.indices, vector.values)}
        assert cells == pytest.approx({k: v for k, v in long_form.items() if k[0] == row["id"]})


def test_projection_is_centred_and_ordered(spark):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(1)
    rows = spark.createDataFrame(
        [(Vectors.dense([rng.gauss(5, s) for s in (3, 1, 0.2)]),) for _ in range(200)], ["v"]
    )
    got = [list(r["p"]) for r in Te.project(rows, "v", "p", 2).transform(rows).collect()]
    for dim in range(2):
        assert abs(sum(g[dim] for g in got)) < 1e-6
    spread = [sum(g[d] ** 2 for g in got) for d in range(2)]
    assert spread[0] > spread[1]
    assert abs(sum(g[0] * g[1] for g in got)) < 1e-6


def test_vocabulary_and_ids(spark):
    docs = spark.createDataFrame([("1", "b a b"), ("2", "a c")], "id string, text string")
    vocab = Fe.build_vocab(docs)
    assert [(r["token"], r["freq"]) for r in vocab.collect()] == [("a", 2), ("b", 2), ("c", 1)]
    ids = Fe.vectorize_text(
        spark.createDataFrame([("1", "c! A z b"), ("2", "")], "id string, text string"), Fe.index_vocab(vocab)
    )
    assert {r["id"]: r["tokens"] for r in ids.collect()} == {"1": [4, 2, 1, 3], "2": []}
