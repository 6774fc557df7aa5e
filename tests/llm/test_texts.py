"""Operators over documents: brute force, exact round trips and defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from crowdtide.llm import kneser_ney, packing, pii, sentence_pieces, simhash
from crowdtide.llm.components import _large_star, _small_star, components, with_least

ODD = ["", " ", None, "a", "a b", "A  b\t\n c", "é 日本 ▁ \x00 x", "word " * 30_000, "<|endoftext|> z", "\n\n", "x" * 40_000]


# --- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text, words=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, bits):
    """Smallest key reachable per key."""
    left, out = dict(fps), {}
    while left:
        start = next(iter(left))
        group, todo = {start}, [left.pop(start)]
        while todo:
            f = todo.pop()
            near = [k for k, g in left.items() if (f ^ g).bit_count() <= bits]
            for k in near:
                group.add(k)
                todo.append(left.pop(k))
        out |= dict.fromkeys(group, min(group))
    return out


def test_fingerprints(spark, docs_of, saved):
    rows = list(enumerate(t for t in ODD if t is None or len(t) < 40_000 or " " in t))
    folder = saved(documents=docs_of(rows, ("fp", "component_id")))
    got = {r["doc_id"]: r for r in simhash.op10_simhash(spark, folder).collect()}
    want = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in want.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_groups(want, 2)


@pytest.mark.parametrize("bits,cell,shared", [(2, 32, 2), (2, 3, 2), (4, 16, 4), (4, 2, 3)])
def test_groups_of_close_fingerprints(spark, bits, cell, shared):
    """Random centres with chains and balls around them; small cells force the shared points."""
    rng = np.random.default_rng(bits * 100 + cell)
    fps = []
    for _ in range(40):
        f = int(rng.integers(0, 1 << 63)) << 1 | 1
        fps.append(f)
        for _ in range(int(rng.integers(0, 25))):
            for b in rng.choice(64, int(rng.integers(1, bits + 2)), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
            if rng.random() < 0.3:
                f = fps[int(rng.integers(0, len(fps)))]
    fps += fps[:30] + [0, 0, 3, (1 << 64) - 1]
    keyed = dict(enumerate(fps))
    frame = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in keyed.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(frame, "doc_id", bits, cell, shared).collect()}
    assert got == brute_groups(keyed, bits)


def test_manhattan_is_a_lower_bound(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b)) for a, b in rng.integers(-(1 << 63), 1 << 63, (500, 2))]
    from pyspark.sql import functions as F

    e = simhash.embedding
    frame = spark.createDataFrame(rows, "a long, b long").select(
        "a", "b", simhash.manhattan(e(F.col("a")), e(F.col("b"))).alias("m")
    )
    for r in frame.collect():
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        counts = lambda x: [(x >> s & 3).bit_count() for s in range(0, 64, 2)]
        assert r["m"] == sum(abs(p - q) for p, q in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_components_of_hubs_and_chains(spark):
    hub = [(5000, i) for i in range(5001, 9000)] + [(i, 12_000) for i in range(5001, 7000)]
    chain = [(i, i + 1) for i in range(100)] + [(300, 300), (None, 4), (7, None), (50, 51)]
    frame = spark.createDataFrame(hub + chain, "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert got == dict.fromkeys([*range(5000, 9000), 12_000], 5000) | dict.fromkeys(range(101), 0)


def test_a_hub_is_dealt_to_many_tasks(spark):
    from pyspark.sql import functions as F

    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        rows = spark.range(8000).select(F.lit(1).alias("k"), "id")
        found = with_least(rows, "k", F.col("id"), "m", F.col("id")).withColumn("task", F.spark_partition_id())
        tasks = found.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(t["n"] for t in tasks) == 8000 and {t["m"] for t in tasks} == {0}
    assert max(t["n"] for t in tasks) < 2000


def test_null_ids_and_an_empty_table(spark, docs_of, saved):
    folder = saved(documents=docs_of([(None, "same words here"), (None, "same words here"), (4, "same words here")]))
    assert {r["component_id"] for r in simhash.op10_simhash(spark, folder).collect()} == {4}
    assert simhash.op10_simhash(spark, saved(documents=docs_of([]))).count() == 0


# --- personal data ------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s)),
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if keep[k](m.group())]


HARD = [
    "a@b.com_x@d.e.f, @x.y a@ a@b a@b. .@-.-", "x@y.z@u.v.w q@r..s", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111, 4111111111111111 4111 1111 1111 1112", "+1 (555) 010-9999 +1+2 3456789 +12",
    "+41 4111 1111 1111 1111", "é😀 mail.x+y%z@host-1.example.org 10.0.0.255", "9" * 5000 + ".1.1", "a" * 5000 + "@", "1 2 3 4 5 6",
    "٣٣٣ 12٣4.1.1.1", "", None,
]


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(9)
    made = ["".join(rng.choice(list("a1.@+- ()_4"), 60)) for _ in range(3000)]
    for text in HARD + made:
        assert pii.base_spans(text or "") == plain_spans(text), text


@pytest.fixture(scope="module")
def pii_field():
    return pii.fit(pii.made_up())


def test_the_field_finds_what_patterns_miss(pii_field):
    for text, want in [
        ("call (743) 555-3824 now", ("phone", "(743) 555-3824")), ("card 4111.1111.1111.1111 x", ("card", "4111.1111.1111.1111")),
        ("write bob.x (at) mail.example.com ok", ("email", "bob.x (at) mail.example.com")),
    ]:
        spans = pii.add_spans(text, pii.base_spans(text), pii_field)
        assert [(k, text[a:b]) for k, a, b in spans] == [want]
    for text in ("in 1999 about 73963 of 21989.9 units", "nothing here", "at (at) noon", "sum 12345678 items"):
        assert pii.add_spans(text, [], pii_field) == []


def test_decoding_and_gradient_against_all_segmentations():
    """The programme's best segmentation and expected features equal those of a full enumeration."""
    rng = np.random.default_rng(10)
    isle = pii.island("x +1 55 66 1.2.3.4 7", 0, 20)
    pii_field = pii.Field(rng.normal(0, 0.5, (pii.BUCKETS, 4)), rng.normal(0, 0.5, (5, 4)))
    scores = pii_field.scores(isle)

    def all_from(at, previous):
        if at == len(isle):
            yield 0.0, []
            return
        for s, rest in all_from(at + 1, 0):
            yield s, rest
        for c in np.flatnonzero(isle.first == at):
            for kind in range(4):
                gain = scores[c, kind] + pii_field.follow[previous, kind]
                for s, rest in all_from(int(isle.last[c]) + 1, kind + 1):
                    yield s + gain, [(int(c), previous, kind), *rest]

    every = list(all_from(0, 0))
    best = max(every, key=lambda e: e[0])[1]
    assert pii_field.decode(isle) == [(k, isle.edges[isle.first[c]], isle.edges[isle.last[c] + 1]) for c, _, k in best]
    total = sum(np.exp(s) for s, _ in every)
    want = np.zeros((pii.BUCKETS, 4))
    for s, chosen in every:
        for c, _, kind in chosen:
            np.add.at(want[:, kind], isle.features[c], np.exp(s) / total)
    got, follow = np.zeros((pii.BUCKETS, 4)), np.zeros((5, 4))
    pii._gradient(pii_field, isle, {}, got, follow)
    assert np.allclose(got, want) and len(every) > 50


def test_islands_give_the_spans_of_whole_texts(pii_field):
    long, rng = "x" * 60, random.Random(11)
    words = ["the", long, "12 345", "+49", "555-0100", "(at)", "[AT]", "@", "mail.example.com", "\n", "é", "9" * 30, "a.b", "  ", "?"]
    texts = [f"write to {long} (at) {long}.example.com or call", f"{long}[at]{long}.com", long * 10 + "[at]b.com", "", long]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in range(1, 90)]
    for text in texts:
        base = pii.base_spans(text)
        whole = [
            (pii.KINDS[k], a, b)
            for start, end in pii._free(base, 0, len(text))
            for k, a, b in pii_field.decode(pii.island(text, start, end))
        ]
        assert pii.add_spans(text, base, pii_field) == whole, text
    start = len("write to ")
    found = pii.add_spans(texts[0], [], pii_field)
    assert [s[0] for s in found] == ["email"] and found[0][1] <= start and found[0][2] >= start + 60 + len(" (at) ") + 60


def test_pii_query(spark, docs_of, saved):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3]), (None, HARD[0])]
    got = pii.op2_pii(spark, saved(documents=docs_of(rows, ("base", "spans")))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_spans(HARD[r["doc_id"] or 0])
        joined = ",".join(":".join(map(str, s)) for s in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert pii.op2_pii(spark, saved(documents=docs_of([]))).count() == 0


def test_masked_documents_keep_their_columns(spark, docs_of):
    docs = docs_of([(1, "mail a.b@c.de or 10.0.0.1."), (2, None), (3, "plain")], ("masked", "c0"))
    got = {r["doc_id"]: r for r in pii.mask_documents(spark, docs, "").collect()}
    assert got[1]["text"] == "mail <email> or <ip>." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "plain" and got[3]["masked"] == 1.5


# --- packing ------------------------------------------------------------------------------


def test_tournament_is_first_fit():
    rng = np.random.default_rng(11)
    lengths = rng.integers(1, 100, 400)
    bins, free = [], []
    for item in np.argsort(-lengths, kind="stable"):
        place = next((b for b, f in enumerate(free) if f >= lengths[item]), len(free))
        if place == len(free):
            bins.append([])
            free.append(100)
        bins[place].append(item)
        free[place] -= lengths[item]
    assert packing.first_fit_decreasing(lengths, 100) == bins
    assert packing.first_fit_decreasing(np.array([], np.int64), 100) == []


def test_encoder_equals_the_tokenizer():
    encode = packing.Encoder(packing.default_tokenizer())
    more = ["  a", "a \n b", "a\n", "don't we'll  's", "a\x1c b", "a \x85 b", "a\xa0 b c ", " x<|endoftext|> y "]
    texts = [t or "" for t in ODD if t != "x" * 40_000] + more
    for _ in range(2):  # new words, then remembered ones
        for text, ids in zip(texts, map(encode, texts)):
            want = encode._tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, encode.kind).tolist() == want


def test_packing_keeps_every_id_once(spark, docs_of, saved, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"text {i} " * (i * 7 % 90)) for i in range(150)] + [(None, "x"), (5, "again")]
    folder = saved(documents=docs_of(rows, ("grp", "ids")))
    pieces = packing.pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), group=40).toPandas()
    tokenizer = packing.Encoder(packing.default_tokenizer())._tokenizer
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows if i not in (5, None))
    got = Counter()
    for key, own in pieces[pieces.doc_id.notna() & (pieces.doc_id != 5)].groupby("doc_id"):
        own = own.sort_values("start")
        raw = b"".join(own.ids)
        assert (own.start == own.length.cumsum() - own.length).all() and own.length.sum() == own.doc_tokens.iloc[0]
        got[(int(key), tuple(np.frombuffer(raw, "<u4").tolist()))] += 1
    assert got == want
    assert (pieces.ids_crc32 == pieces.ids.map(zlib.crc32)).all() and (pieces.ids.str.len() == 4 * pieces.length).all()
    placed = pieces.sort_values(["sequence_id", "offset"])
    own = placed.groupby("sequence_id").length
    assert (placed.offset == own.cumsum() - placed.length).all() and own.sum().max() <= 1024
    assert len(pieces[pieces.doc_id.isna()]) == 1 and (pieces.doc_id == 5).sum() == 2
    assert packing.op5_packing(spark, saved(documents=docs_of([]))).count() == 0


# --- Kneser-Ney ---------------------------------------------------------------------------


def plain_model(texts, order=2):
    """Modified Kneser-Ney in dictionaries: probability of an n-gram's last word, and the tokens' counts."""
    grams = [Counter() for _ in range(order + 1)]
    for text in texts:
        tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + ["end"]
        padded = ["start"] * (order - 1) + tokens
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(tokens)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def cuts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] and y else 0.5 for k in (1, 2, 3)]
        return [0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))]

    cut = [None, *(cuts(g.values()) for g in grams[1:])]
    pairs = sum(grams[1].values())
    free = sum(cut[1][min(c, 3)] for c in grams[1].values()) / pairs
    followers = {}
    for level in grams[2:]:
        for gram, c in level.items():
            followers.setdefault(gram[:-1], []).append(c)

    def p(gram):
        d, c = cut[len(gram)], grams[len(gram)][gram]
        if len(gram) == 1:
            return max(c - d[min(c, 3)], 0) / pairs + free / (len(grams[1]) + 1)
        own = followers.get(gram[:-1])
        if own is None:
            return p(gram[1:])
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in own) * p(gram[1:])) / sum(own)

    tokens = Counter()
    for gram, c in grams[order].items():
        tokens[gram[-1]] += c
    return p, tokens


CORPUS = ["the cat sat on the mat", "The dog sat on the log", "a cat and a dog", "", None, "the the the the", "on the mat the cat sat", "x"]


def check_scores(got, rows, held, order):
    p, tokens = plain_model([t for i, t in rows if not held[i]], order)
    total, types, texts = sum(tokens.values()), len(tokens), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = re.findall(rb"[^\x20\x09-\x0D]+", (texts[r["doc_id"]] or "").encode().lower()) + ["end"]
        padded = ["start"] * (order - 1) + own
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(t in tokens for t in own)
        assert np.isclose(r["base_score"], sum(np.log10((tokens[t] + 1) / (total + types + 1)) for t in own), atol=1e-9)
        want = sum(np.log10(p(tuple(padded[i : i + order]))) for i in range(len(own)))
        assert np.isclose(r["score"], want, atol=1e-9)
    return total


ROWS = [(i, CORPUS[i % len(CORPUS)] if i % 5 else f"{CORPUS[i % 3]} word{i}") for i in range(60)] + [(None, "the cat")]
HELD = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in ROWS}


def test_scores_equal_a_plain_model(spark, docs_of, saved, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TOKENS_PER_SHARD", 12)
    got = kneser_ney.op6_kneser_ney(spark, saved(documents=docs_of(ROWS, ("shard", "score")))).collect()
    total = check_scores(got, ROWS, HELD, 3)
    assert all((r["held_out"], r["train_tokens"]) == (HELD[r["doc_id"]], total) for r in got)


@pytest.mark.parametrize("order", [2, 4])
def test_other_orders_and_small_batches(spark, docs_of, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "TOKENS_PER_SHARD", 60)
    monkeypatch.setattr(kneser_ney, "FLUSH", 17)
    docs = docs_of(ROWS)
    model = kneser_ney.train(docs.filter(docs.doc_id.isin([i for i in HELD if i is not None and not HELD[i]])), order)
    rows = ROWS[:-1]
    check_scores(kneser_ney.score(docs.filter("doc_id is not null"), model, ("doc_id",)).collect(), rows, HELD, order)


def test_probabilities_sum_to_one(spark, docs_of):
    rows = list(enumerate(CORPUS * 3))
    model = kneser_ney.train(docs_of(rows))
    _, tokens = plain_model([t for _, t in rows])
    words = [xxhash.xxh64_intdigest(w) for w in tokens if w != "end"]
    every = np.array([*words, int(kneser_ney.END), 12345], np.uint64)
    the, start = xxhash.xxh64_intdigest(b"the"), int(kneser_ney.START)
    for context in ((the, the), (start, start), (start, the), (999, the), (the, 999), (999, 999)):
        found, _ = kneser_ney.probabilities(model, [*(np.full(len(every), c, np.uint64) for c in context), every])
        assert np.isclose(found.sum(), 1.0) and (found > 0).all()


def test_counts_above_a_byte_and_empty_tables(spark, docs_of, saved):
    model = kneser_ney.train(docs_of([(1, "a b " * 500)]), 2)
    a, b = (np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in (b"a", b"b"))
    assert model.find([a, b])[0, 0] == 500 and model.find([b, a])[0, 0] == 499 and model.tokens == 1001
    assert model.find([a])[0].tolist() == [2, 500, 0, 0, 1, 500] and model.find([b - 1])[0].tolist() == [0] * 6
    assert kneser_ney.op6_kneser_ney(spark, saved(documents=docs_of([]))).count() == 0
    only = [(i, "all held out") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = kneser_ney.op6_kneser_ney(spark, saved(documents=docs_of(only))).collect()
    assert {(r["score"], r["train_tokens"]) for r in got} == {(0.0, 0)}


def test_lost_files_are_errors(spark, docs_of):
    model = kneser_ney.train(docs_of([(1, "a b a c")]))
    word = np.array([xxhash.xxh64_intdigest(b"a")], np.uint64)
    model.folder += "-gone"
    with pytest.raises(FileNotFoundError):
        model.find([word])
    with pytest.raises(ValueError):
        kneser_ney.train(docs_of([(1, "a")]), 1)
    with pytest.raises(ValueError):
        kneser_ney.mounted("hdfs://somewhere/folder")


# --- SentencePiece ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(sentence_pieces.default_model())


def test_viterbi_against_trying_all_pieces(pieces):
    table = {}
    for key in pieces.automaton:
        size, score, i = pieces.automaton.get(key)
        table[key] = (score, i)
    longest = max(map(len, table))
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("aethnr ée▁\n日."), int(rng.integers(1, 60)))) for _ in range(300)]
    weight = {i: score for score, i in table.values()}
    for text in texts:
        marked = (" " + text).replace("▁", "\0").replace(" ", "▁")
        best = [0.0]
        for end in range(1, len(marked) + 1):
            starts = [s for s in range(max(0, end - longest), end) if marked[s:end] in table]
            best.append(max([best[end - 1] + pieces.fallback] + [best[s] + table[marked[s:end]][0] for s in starts]))
        raw, fallen = pieces.encode(text)
        ids = np.frombuffer(raw, "<u4")
        total = fallen * pieces.fallback + sum(weight.get(int(i), 0.0) for i in ids)
        assert np.isclose(total, best[-1], atol=1e-9) and pieces.decode(ids) == text


def test_pieces_round_trip(spark, docs_of, saved, pieces):
    rows = list(enumerate(ODD)) + [(0, "again"), (None, "no id")]
    got = sentence_pieces.op3_sentence_pieces(spark, saved(documents=docs_of(rows, ("ids", "decoded")))).collect()
    assert len(got) == len(rows) and all(r["restored"] for r in got)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        if i is not None and i > 0:
            raw, fallen = pieces.encode(t or "")
            assert (by[i]["n_ids"], by[i]["n_fallback"], by[i]["ids_crc32"]) == (len(raw) // 4, fallen, zlib.crc32(raw))
    assert sentence_pieces.op3_sentence_pieces(spark, saved(documents=docs_of([]))).count() == 0


def test_a_round_of_stars_reads_its_links_few_times(spark):
    links = spark.range(40).selectExpr("id + 1 AS a", "id AS b")
    round_plan = _small_star(_large_star(links))._jdf.queryExecution().optimizedPlan().toString()
    assert round_plan.count("Range (") <= 4
    assert {tuple(r) for r in components(links).collect()} == {(n, 0) for n in range(41)}
