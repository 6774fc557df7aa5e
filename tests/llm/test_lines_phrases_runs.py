"""Line dedup, collocations and periodic runs against plain loops on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from crowdtide.llm import collocations, count_transducers, line_dedup, periodic_runs

BLANK = " \t\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- line dedup ---------------------------------------------------------------------------------


def plain_lines(rows, least, spare=False):
    """(doc_id, lines before, dropped, kept text) of every row."""
    holders, first = defaultdict(set), {}
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            key = line.strip(BLANK).translate(LOWER)
            holders[key].add(i)
            place = (i is None, i or 0, pos)
            first[key] = min(first.get(key, place), place)
    lost = {k for k, d in holders.items() if k and len(d) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(BLANK).translate(LOWER) for x in lines]
        gone = [k in lost and not (spare and first[k] == (i is None, i or 0, p)) for p, k in enumerate(keys)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def some_lines(seed):
    rng = random.Random(seed)
    pool = [f"Line Ä{i} of Many" for i in range(30)] + ["", "  ", "\x0b", "é", "É", "x "]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", "\r"]) for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    long = "\n".join(rng.choice(pool) if n % 3 else f"own line {n}" for n in range(1500))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, "Line Ä1 of Many\nown"), (103, long), rows[3], rows[4]]


@pytest.mark.parametrize("least,spare", [(10, False), (10, True), (1, False), (61, True)])
def test_lines_equal_a_plain_loop(docs_of, least, spare):
    rows = some_lines(7)
    docs = docs_of(rows, ("pos", "h1", "words", "line", "text_hash"))
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least, spare)).collect()
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found), key=repr)
    assert got == plain_lines(rows, least, spare)


def test_a_hot_line_and_its_bitmaps(docs_of):
    """One line in every document, many times in one of them: bits only where a line goes."""
    rows = [(i, f"own {i}\nTHE HOT LINE\nmore {i}") for i in range(400)] + [(1000, "\n".join(["the hot line"] * 200 + ["end"]))]
    maps = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(docs_of(rows)).collect()}
    assert len(maps) == 401
    assert [(w["word"], w["keep"]) for w in maps[5]["words"]] == [(0, ~2)]
    assert [w["word"] for w in maps[1000]["words"]] == [0, 1, 2, 3] and maps[1000]["n_dropped"] == 200


def test_no_shuffle_between_ranges_and_first_occurrences(spark, docs_of):
    """The window uses the order of the ranges: one range exchange, one for the partial sums."""
    from crowdtide.scratch import materialize

    hashes = materialize(line_dedup.line_hashes(docs_of(some_lines(8))))
    plan = line_dedup.frequent_keys(hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_lines_of_an_empty_table(docs_of):
    docs = docs_of([])
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).count() == 0


# --- collocations -------------------------------------------------------------------------------


def plain_phrases(rows, least, cover, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in long.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not any(
                100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in long.items() if len(q) > len(p)
            ):
                rated.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rated)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some_phrases(seed, n=300):
    rng = random.Random(seed)
    pool = ["New", "york", "city", "hall", "café", "ÀB", "of", "the", "the", "the", "a\x01b", "z"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))))
            parts.append(rng.choice([". ", ", ", "\n", " ! ", "\t", ":"]))
        rows.append((rng.choice(["en", "fr", None]), "".join(parts) + rng.choice(["", "new york city hall", "New  York\tcity"])))
    return rows + [(None, None), ("en", ""), ("xx", "only once"), ("en", "the " * 5000)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1.5) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase double").repartition(6)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("words,shard,lookups", [(2_000_000, 3_000_000, 100_000), (150, 900, 40)])
def test_phrases_equal_a_plain_loop(spark, monkeypatch, words, shard, lookups):
    """With few words per range and shard, hot words are split over ranges and parts over salts."""
    monkeypatch.setattr(collocations, "RANGE_WORDS", words)
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "LOOKUPS", lookups)
    rows = some_phrases(3)
    docs = frame_of(spark, rows)
    for least, cover, most in ((30, 80, 2000), (5, 60, 7)):
        found = collocations.collocations(docs, least, cover, most).collect()
        got = sorted(tuple(r[c] for c in COLUMNS) for r in found)
        assert got == plain_phrases(rows, least, cover, most)
        assert len(got) > 10


def test_fences_split_a_hot_word(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_WORDS", 1000)
    docs = frame_of(spark, some_phrases(3, 3000)).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    fences = collocations.fences_of(docs, docs.selectExpr("sum(octet_length(text))").first()[0])
    assert len(fences) > 15 and sum(f[:2] == (b"en", b"the") for f in fences) > 1


def test_phrases_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0


def test_scores_beyond_64_bits(spark):
    """The score's product passes 64 bits from some trillions on."""
    from pyspark.sql import functions as F

    big = 5 * 10**15
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    score = row.select(F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + r)")).first()[0]
    assert score == 2_000_000 * big // (2 * big + 3)


def random_windows(rng, n, words):
    rows = rng.integers(1, words + 1, (n, 4)).astype(np.int32)
    rows[np.arange(4) >= rng.integers(1, 5, (n, 1))] = 0
    return count_transducers.sorted_windows(rows)


def test_transducers_count_share_and_unite():
    rng = np.random.default_rng(5)
    names = [b"w%02d" % i for i in range(12)]
    parts, total = [], Counter()
    for n in (0, 1, 40, 3000):
        windows, times = random_windows(rng, n, len(names))
        made = count_transducers.CountTransducer.build(names, windows, times)
        back = count_transducers.CountTransducer.load(made.dump())
        got = Counter({tuple(w): c for w, c in zip(*(x.tolist() for x in back.windows()))})
        assert got == Counter({tuple(w): c for w, c in zip(windows.tolist(), times.tolist())})
        total += got
        parts.append(back)
    whole = count_transducers.union(parts)
    prefixes = Counter()
    for w, c in total.items():
        for k in range(1, 5):
            if w[k - 1]:
                prefixes[w[:k]] += c
    for rows, weight, _ in whole.paths():
        for row, f in zip(rows.tolist(), weight.tolist()):
            assert prefixes.pop(tuple(row)) == f
    assert not prefixes and whole.total == sum(total.values())
    # equal endings are stored once
    plain = count_transducers.CountTransducer.build(whole.words, *count_transducers.sorted_windows(*whole.windows()), share=False)
    assert len(whole.levels[3].word) < len(plain.levels[3].word) / 3


def test_composition_gives_the_other_weights():
    rng = np.random.default_rng(6)
    ours, theirs = [b"a", b"b", b"c", b"x"], [b"b", b"c", b"d"]
    asked, _ = random_windows(rng, 80, len(ours))
    windows, times = random_windows(rng, 300, len(theirs))
    acceptor = count_transducers.CountTransducer.build(ours, asked, np.ones(len(asked), np.int64), share=False)
    other = count_transducers.CountTransducer.build(theirs, windows, times)
    count = Counter()
    for w, c in zip(windows.tolist(), times.tolist()):
        for k in range(1, 5):
            if w[k - 1]:
                count[tuple(theirs[x - 1] for x in w[:k])] += c
    seen = 0
    for rows, weight in acceptor.compose(other):
        for row, f in zip(rows.tolist(), weight.tolist()):
            assert f == count[tuple(ours[x - 1] for x in row)]
            seen += f > 0
    assert seen > 10


# --- periodic runs ------------------------------------------------------------------------------


def plain_runs(words, least=6, repeats=4):
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, repeats * q):
                part = words[start : start + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            i += i == start
    return sorted(found)


def some_words(rng, most=40):
    words = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(0, most))]
    if len(words) > 4 and rng.random() < 0.6:
        a, p = rng.randrange(len(words)), rng.randrange(1, 6)
        for i in range(a, len(words)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least,repeats", [(6, 4), (2, 2), (6, 3)])
def test_runs_equal_all_periods(least, repeats):
    rng = random.Random(9)
    for _ in range(1500):
        words = some_words(rng)
        want = plain_runs(words, least, repeats)
        assert periodic_runs.runs_of(words, least, repeats) == want
        parts = periodic_runs.possible(np.array(words, np.int64), np.zeros(len(words), np.int64), least, repeats)
        cut = [(b + s, n, p) for b, e in parts for s, n, p in periodic_runs.runs_of(words[b:e], least, repeats)]
        assert sorted(cut) == want


def test_long_periodic_texts_stay_fast():
    for words, want in (([1] * 30000, (0, 30000, 1)), ([i % 900 for i in range(30000)], (0, 30000, 900))):
        tree = periodic_runs.SuffixTree(words)
        segments = sum(len(tree.access(i)) for i in range(len(words)))
        assert segments < 3 * len(words)
        assert periodic_runs.runs_of(words) == [want]


def test_runs_query_equals_a_plain_loop(spark, docs_of, saved):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        words = [f"W{w}" for w in some_words(rng, 60)] if i % 3 else [f"W{rng.randrange(500)}" for _ in range(rng.randrange(0, 300))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b", " \x0c\r "]) for w in words)))
    rows += [(500, None), (501, ""), (502, "   "), (None, "a " * 50), (None, ""), (rows[7][0], rows[7][1]), (503, "x y " * 9000)]
    folder = saved(documents=docs_of(rows, ("start", "runs", "length")))
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = plain_runs(words) if n < 5000 else [(0, n, 2)]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{p}\n" for s, m, p in found), " ".join(w for k, w in enumerate(words) if k not in gone))]
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r[c] for c in names) for r in periodic_runs.op13_periodic_runs(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 100


def test_runs_of_an_empty_table(docs_of):
    assert periodic_runs.periodic_runs(docs_of([])).count() == 0
