"""The stages' decisions against a plain run on a small corpus, and their SQL where there is some."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_learned import LABELS, corpus

import corpus_pipeline
from crowdtide.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, docs_of, saved):
    rows, labels = corpus(500)
    clean = [t for i, t in rows if i % 6 and i % 5]
    copies = [(2000 + i, clean[i]) for i in range(40)] + [(2100 + i, clean[0].upper()) for i in range(30)]
    extra = [(3000, f"{clean[1]} write to a.b@c.example"), (3001, None), (3002, ""), (None, "a text without an id and its own words"), (2000, clean[0])]
    return saved(
        documents=docs_of(rows + copies + extra, ("score", "fp", "row", "masked", "label")),
        labels=spark.createDataFrame(labels, LABELS),
    )


def test_stages(spark, folder):
    from crowdtide.scratch import materialize

    rows, labels = corpus(500)
    toxic, good = {i for i, _, t in labels if t}, {i for i, q, _ in labels if q}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    kept = {i for i in seen["toxicity"] if i is not None and i < 500}
    assert len(kept & toxic) <= 3 and len(set(range(500)) - toxic - kept) <= 3
    kept = {i for i in seen["quality"] if i is not None and i < 500}
    assert len(kept - good) <= 3 and len((good - toxic) - kept) <= 6
    unique = seen["near_duplicates"]
    assert not any(i is not None and 2000 <= i < 2200 for i in unique)
    assert len(unique) == len(set(unique)) and kept <= set(unique)
    assert seen["pii"] == unique or sorted(map(str, seen["pii"])) == sorted(map(str, unique))
    assert {i for i in seen["packing"]} == set(unique)


def test_run_and_empty_table(spark, folder, docs_of, saved):
    assert corpus_pipeline.run(spark, folder).count() > 300
    empty = saved(documents=docs_of([]), labels=spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_sql(spark, name):
    import check_oracles as C

    con = C.database(SMALL)
    _, rows, problem = C.compare(spark, con, SMALL, name, registry.QUERIES[name], registry.SQL[name])
    assert problem is None and rows > 0


def test_one_document_of_each_group(spark, docs_of):
    """The stage against all pairs of fingerprints, with copies, null ids and repeated ids."""
    import numpy as np

    from crowdtide.llm import simhash

    rng = np.random.default_rng(41)
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 900, 200)]
        rows.append((i, " ".join(words)))
        for c in range(int(rng.integers(0, 4))):
            own = list(words)
            own[int(rng.integers(200))] = "other"
            rows.append((100 + 10 * i + c, " ".join(own)))
    rows += [(None, rows[0][1]), (None, "an own text of a null id"), (3000, rows[5][1].upper()), (rows[2][0], "a repeated id")]
    rows += [(4000 + i, rows[7][1]) for i in range(300)] + [(5000, None), (5001, ""), (5002, " \n")]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    left, want = set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            one = todo.pop()
            close = {j for j in left if (prints[one] ^ prints[j]).bit_count() <= 2}
            left -= close
            group |= close
            todo += close
        want.append(min(group, key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j)))
    docs = docs_of(rows, ("row", "fp", "best")).coalesce(1)
    kept = simhash.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr)
    assert got == sorted([rows[j] for j in want], key=repr)
    assert 60 <= len(want) < 160


def test_a_repeated_id_is_one_row_of_the_sample(spark, docs_of):
    from crowdtide.llm.labelled import sample

    docs = docs_of([(1, f"text {i % 700:03d}") for i in range(5000)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABELS)
    found = sample(docs, labels, "toxic", None, 100, None)
    assert sorted(r[0] for r in found.rows) == ["other", "text 000"]
