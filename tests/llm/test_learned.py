"""Learned operators: held-out accuracy, the linear-time identity, and odd rows."""

import zlib

import numpy as np
import pytest

from crowdtide.llm import frames, quality, toxicity
from crowdtide.llm.labelled import Sample, sample

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, words=60):
    syllables = ["ba", "ne", "to", "ri", "lum", "sa", "ko", "end"]
    made = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(words)]
    return " ".join(w + "." if rng.random() < 0.12 else w for w in made)


def corpus(n=600):
    """Documents, a sixth toxic by one word of some forms, a fifth poor by shouting or tables."""
    rng = np.random.default_rng(21)
    rows, labels = [], []
    for i in range(n):
        text, toxic, good = prose(rng, int(rng.integers(20, 120))), int(i % 6 == 0), int(i % 5 != 0)
        if toxic:
            words = text.split(" ")
            words.insert(int(rng.integers(0, len(words))), "zugrak" + str(rng.choice(["", "s", "um", "en"])))
            text = " ".join(words)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", " | ")
        rows.append((i, text))
        labels.append((i, good, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, docs_of, saved):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "... !!"), (None, "no id"), (5, rows[5][1]), (1003, "word " * 40_000)]
    labels += [(None, 1, 1), (7, None, None), (3, 1, 0), (2000, 0, 1)]
    return saved(
        documents=docs_of(rows + odd, ("score", "predicted")), labels=spark.createDataFrame(labels, LABELS)
    )


def outcome(frame, truth, n):
    got = frame.toPandas()
    assert len(got) == n + 6 and got.score.between(0, 1).all() and got.score.notna().all()
    held = got[got.held_out & (got.doc_id < n)].drop_duplicates("doc_id")
    assert set(got.doc_id[got.held_out]) == {i for i in got.doc_id.dropna() if zlib.crc32(str(int(i)).encode()) % 3 == 1}
    y = np.array([truth[int(i)] for i in held.doc_id])
    return got, held, y


def test_toxicity_on_held_out_documents(spark, folder):
    rows, labels = corpus()
    got, held, y = outcome(toxicity.op4_toxicity(spark, folder), {i: t for i, _, t in labels}, len(rows))
    assert (got.predicted == (got.score >= 0.7)).all()
    assert (held.predicted.to_numpy() == y).mean() > 0.97
    texts = dict(rows)
    for r in held[(held.predicted == 1) & (y == 1)].itertuples():
        assert "zugrak" in texts[int(r.doc_id)][int(r.first_start) : int(r.first_end)].lower()
    assert (got[got.doc_id.isin([1000, 1001, 1002])].score == 0).all()


def test_quality_on_held_out_documents(spark, folder):
    rows, labels = corpus()
    got, held, y = outcome(quality.op9_quality(spark, folder), {i: q for i, q, _ in labels}, len(rows))
    assert (got.predicted == (got.score >= 0.5)).all()
    assert (held.predicted.to_numpy() == y).mean() > 0.97


def test_noisy_or_and_gradient():
    """The score is one minus the product over sentences; fitting raises the likelihood."""
    rows, labels = corpus(200)
    data = Sample([(t,) for _, t in rows], np.array([t for _, _, t in labels], float), np.ones(200))
    model = toxicity.fit(data)
    for _, text in rows[:20]:
        p = [1 / (1 + np.exp(-(model.bias + sum(map(model.word, words))))) for _, _, words in toxicity.sentences(text)]
        score, spans, n = toxicity._score(text, frames.Memo(model.word), model.bias)
        assert np.isclose(score, 1 - np.prod(1 - np.array(p))) and n == len(p)
        assert [s[2] for s in spans] == [x for x in p if x >= toxicity.OFFENDING]

    def loss(m):
        s = np.array([toxicity._score(t, frames.Memo(m.word), m.bias)[0] for _, t in rows])
        return -np.log(np.where(data.labels == 1, s, 1 - s) + 1e-9).mean()

    assert loss(model) < loss(toxicity.Model(np.zeros(toxicity.BUCKETS), toxicity.BIAS))


def test_pairs_by_sums_of_squares():
    rng = np.random.default_rng(22)
    model = quality.Model(0.3, rng.normal(size=quality.SIZE), rng.normal(0, 0.3, (quality.SIZE, quality.RANK)))
    index, x = quality.features("Some words | and SOME more!!\nwords words".encode(), 41, quality._bucket)
    pairs = sum(
        model.factors[i] @ model.factors[j] * x[a] * x[b]
        for a, i in enumerate(index) for b, j in enumerate(index) if a < b
    )
    assert np.isclose(model(index, x), 0.3 + model.linear[index] @ x + pairs)


def test_gradient_of_the_factorisation_machine():
    """One step lowers the loss, and constant labels give a constant."""
    rows, labels = corpus(120)
    data = Sample([(t, len(t)) for _, t in rows], np.array([q for _, q, _ in labels], float), np.ones(120))
    losses = []
    for epochs in (0, 3, 30):
        model = quality.fit(data, epochs=epochs)
        z = np.array([model(*quality.features(t.encode(), len(t), quality._bucket)) for _, t in rows])
        losses.append(np.log1p(np.exp(np.where(data.labels == 1, -z, z))).mean())
    assert losses[0] > losses[1] > losses[2]
    for label, sign in ((0.0, -1), (1.0, 1)):
        one = Sample(data.rows[:3], np.full(3, label), np.ones(3))
        assert quality.fit(one)(*quality.features(b"", None, quality._bucket)) * sign > 10


def test_the_sample_is_bounded_and_balanced(spark, docs_of):
    rows, labels = corpus()
    docs, known = docs_of(rows), spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, 1)], LABELS)
    data = sample(docs, known, "toxic", None, 100, 20_000)
    assert len(data) <= 100 and 45 <= data.labels.sum() <= 50
    assert np.isclose((data.weights * data.labels).sum() / data.weights.sum(), 1 / 6, atol=0.03)
    again = sample(docs, known, "toxic", None, 100, 20_000)
    assert again.rows == data.rows
    assert max(len(t) for (t,) in sample(docs, known, "toxic", None, 100, 200).rows) <= 200


def test_tables_without_rows_or_labels(spark, docs_of, saved):
    none, empty = spark.createDataFrame([], LABELS), docs_of([])
    some = docs_of([(1, "a text"), (2, None)])
    for query in (toxicity.op4_toxicity, quality.op9_quality):
        assert query(spark, saved(documents=empty, labels=none)).count() == 0
        assert {round(r["score"], 9) for r in query(spark, saved(documents=some, labels=none)).collect()} <= {0.0, 0.5}


def varied(n, seed=23):
    """Clean sentences, each of its own words."""
    rng = np.random.default_rng(seed)
    return [prose(rng, 6).replace(".", "").capitalize() + "." for _ in range(n)]


def test_long_clean_documents_score_by_their_words(spark, docs_of):
    """Many clean sentences are no evidence; one toxic sentence among them is."""
    rows, labels = corpus()
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, LABELS))
    clean = varied(20_000)
    toxic = [*clean[:9_000], "You zugrak bane torilum.", *clean[9_000:]]
    one = toxicity._score(toxic[9_000], frames.Memo(model.word), model.bias)[0]
    texts = docs_of([(1, " ".join(clean)), (2, " ".join(toxic)), (3, " ".join(clean[:10]))])
    got = {r["doc_id"]: r for r in toxicity.score(texts, model, ("doc_id",)).collect()}
    assert got[1]["score"] < 0.1 and got[3]["score"] < 0.1 and got[1]["n_sentences"] == 20_000
    assert got[2]["score"] >= one > 0.7 and len(got[2]["offending"]) == 1
    untrained = toxicity.Model(np.zeros(toxicity.BUCKETS), -8.0)
    assert toxicity._score(" ".join(clean), frames.Memo(untrained.word), -8.0)[0] < 0.1


def test_long_labelled_documents_are_in_the_sample(spark, docs_of):
    rows = [(i, "some words. " * (4_000 if i % 3 == 0 else 5)) for i in range(60)]
    docs, known = docs_of(rows), spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS)
    data = sample(docs, known, "toxic", None, 8_000, None, characters=40_000_000)
    assert sorted(t for (t,) in data.rows) == sorted(t for _, t in rows)
    part = sample(docs, known, "toxic", None, 8_000, None, characters=400_000)
    for label in (0, 1):
        own = [len(t) for (t,), y in zip(part.rows, part.labels) if y == label]
        assert sum(own) <= 200_000 and max(own) == 48_000 and min(own) == 60
