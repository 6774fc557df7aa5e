r"""Phrase collocation mining with weighted acyclic automata.

Texts are cut into pieces and those into words, per language. Each word begins a window of up to four
words of its piece, and the count of a phrase is that of the windows that begin with it.

* **Shards.** A task turns the windows of some million words at a time into sorted windows and cuts
  these at fences, a fixed list of windows that splits all windows into ranges of about equal size. The
  stretch of each range becomes a count transducer of its own (``count_transducers``).
* **Union by prefix range.** The transducers of a range meet in one group, where they are united and
  their weights summed. Phrases of enough weight leave it. Only the at most eight phrases that begin a
  fence can also occur in another range; these always leave, and a last sum puts their parts
  together. As fences are whole windows, a word or pair that begins a third of all windows is split over
  several ranges, and a window that repeats is one entry per shard.
* **Parts.** A candidate's parts of either side of every cut are looked up in the ranges where they
  lie: a range's parts form an acceptor, which is composed with the transducer of that range's phrases.
  Parts that many candidates ask for are salted, each salt with a copy of the small transducer.

Scores and comparisons are exact: decimals where products can pass 64 bits.

Nulls: a null text is empty, a null language is ``und``. Repeated rows count as often as they occur;
ids are not read, nor other columns. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from crowdtide.llm import frames
from crowdtide.llm.count_transducers import DEPTH, CountTransducer, sorted_windows, union
from crowdtide.scratch import materialize

MIN_COUNT = 30
MOST_WORDS = DEPTH
SCALE = 2_000_000
COVER = 80
MOST = 2000
#: Words that a task gathers before it writes transducers, and words of a prefix range.
SHARD_WORDS, RANGE_WORDS = 1_500_000, 1_500_000
#: Fences are taken from about this many windows of each range.
SAMPLED, SAMPLED_RANGES, MOST_SAMPLED = 200, 4, 200_000
#: Parts looked up in one group.
LOOKUPS = 100_000
_TABLE = bytes(
    32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts with A-Z lowered; a newline stands between pieces."""
    line = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    return [t for t in line.split(b" ") if t]


def windows_of(ids: np.ndarray) -> np.ndarray:
    """The windows that begin at every word; number 0 separates pieces and fills short windows."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])
    columns = [padded[:n]]
    for d in range(1, DEPTH):
        columns.append(np.where(columns[-1] == 0, 0, padded[d : n + d]))
    begins = ids != 0
    return np.stack([c[begins] for c in columns], axis=1)


class Shard:
    """Words of a language gathered in a task."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b"\n"]
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        found = tokens(texts)
        self.ids += [np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
        self.size += len(found) + 1

    def windows(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Sorted words, different windows of their numbers in order, and counts."""
        words = sorted(w for w in self.numbers if w != b"\n")
        rank = np.zeros(len(words) + 1, np.int32)
        rank[[self.numbers[w] for w in words]] = np.arange(1, len(words) + 1)
        return words, *sorted_windows(windows_of(rank[np.concatenate(self.ids)]))


class _Rows:
    """Windows as tuples of a language and words, for comparison with fences."""

    def __init__(self, lang: bytes, words: list[bytes], windows: np.ndarray):
        self.lang, self.words, self.windows = lang, [b"", *words], windows

    def __len__(self) -> int:
        return len(self.windows)

    def __getitem__(self, i: int) -> tuple:
        return self.lang, *(self.words[w] for w in self.windows[i])


def _before(rows: _Rows, fence: tuple) -> int:
    """Number of windows before a fence."""
    low, high = 0, len(rows)
    while low < high:
        middle = (low + high) // 2
        if rows[middle] < fence:
            low = middle + 1
        else:
            high = middle
    return low


def _cut(rows: _Rows, fences: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of the stretches of windows that lie in a range."""
    if not len(rows):
        return
    first, last = bisect_right(fences, rows[0]), bisect_right(fences, rows[len(rows) - 1])
    begin = 0
    for r in range(first, last + 1):
        end = _before(rows, fences[r]) if r < last else len(rows)
        if end > begin:
            yield r, begin, end
        begin = end


def _key(lang: str, phrase: str) -> tuple:
    own = phrase.encode().split(b" ")
    return lang.encode(), *own, *[b""] * (DEPTH - len(own))


def _shards(docs: DataFrame, fences: list[tuple] | None, keep: int = 1) -> DataFrame:
    """(range, lang, data) with fences; without, (lang, w0 .. w3): one of ``keep`` windows by hash."""
    most = SHARD_WORDS
    schema = "range int, lang string, data binary" if fences is not None else "lang binary, " + ", ".join(f"w{d} binary" for d in range(DEPTH))

    def emit(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        words, windows, times = shard.windows()
        rows = _Rows(lang.encode(), words, windows)
        if fences is None:
            chosen = [rows[i] for i in range(keep // 2, len(rows), keep)]
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*chosen)], names=["lang", *(f"w{d}" for d in range(DEPTH))])
            return
        for r, begin, end in _cut(rows, fences):
            part = windows[begin:end]
            used = np.unique(part)
            used = used[used > 0]
            small = np.zeros(len(words) + 1, np.int32)
            small[used] = np.arange(1, len(used) + 1)
            data = CountTransducer.build([words[w - 1] for w in used], small[part], times[begin:end]).dump()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([lang]), pa.array([data], pa.binary())], names=["range", "lang", "data"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = defaultdict(Shard)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                grouped = defaultdict(list)
                for lang, text in zip(batch.column("lang").to_pylist(), frames.byte_texts(batch.column("text"))):
                    grouped[lang].append(text)
                for lang, texts in grouped.items():
                    shards[lang].add(texts)
                while sum(s.size for s in shards.values()) >= most:
                    lang = max(shards, key=lambda x: shards[x].size)
                    yield from emit(lang, shards.pop(lang))
        for lang in list(shards):
            yield from emit(lang, shards.pop(lang))
        frames.give_back()

    return docs.mapInArrow(run, schema)


def fences_of(docs: DataFrame, total_chars: int) -> list[tuple]:
    """Windows that split all windows into ranges, from a sample of documents by hash.

    They decide which task counts what, and nothing else. There is one to each ``RANGE_WORDS`` words. The
    sample's text is about that of ``SAMPLED_RANGES`` ranges; it gives some ``SAMPLED`` windows per range, and at most
    ``MOST_SAMPLED`` in all, which also bounds the number of ranges.
    """
    ranges = -(-total_chars // (RANGE_WORDS * 6))
    if ranges < 2:
        return []
    keep = max(1, SAMPLED_RANGES * RANGE_WORDS // min(SAMPLED * ranges, MOST_SAMPLED))
    parts = max(1, ranges // SAMPLED_RANGES)
    sample = docs.filter(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(parts)) == 0)
    found = _shards(sample, None, keep).collect() or _shards(docs, None, keep * parts).collect()
    rows = sorted(tuple(bytes(x) for x in r) for r in found)
    return sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []


def _united(fences: list[tuple], least: int):
    """(lang, words, phrase, f) of a range: the word count, heavy phrases, and all that begin a fence."""

    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        edges = {f[: 1 + d] for f in fences[max(r - 1, 0) : r + 1] for d in range(1, DEPTH + 1) if f[d]}
        made: list[tuple] = []
        by_lang = defaultdict(list)
        for lang, data in zip(table.column("lang").to_pylist(), table.column("data")):
            by_lang[lang].append(data)
        for lang, data in by_lang.items():
            whole = union(CountTransducer.load(x.as_buffer()) for x in data)
            words = [w.decode() for w in whole.words]
            made.append((lang, 0, "", whole.total))
            own = {e[1:] for e in edges if e[0] == lang.encode()}
            for n, (rows, weight, _) in enumerate(whole.paths(least), 1):
                made += [(lang, n, " ".join(words[w - 1] for w in row), f) for row, f in zip(rows.tolist(), weight.tolist())]
            # phrases that begin a fence are parts of a sum, however light
            number = {w: i for i, w in enumerate(whole.words, 1)}
            asked = sorted({tuple([number[w] for w in e] + [0] * (DEPTH - len(e))) for e in own if all(w in number for w in e)})
            if asked:
                acceptor = CountTransducer.build(whole.words, np.array(asked, np.int32), np.ones(len(asked), np.int64), share=False)
                for n, (rows, weight) in enumerate(acceptor.compose(whole), 1):
                    made += [
                        (lang, n, " ".join(words[w - 1] for w in row), f)
                        for row, f in zip(rows.tolist(), weight.tolist()) if 0 < f < least
                    ]
        frames.give_back()
        columns = list(zip(*made)) if made else [()] * 4
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "words", "phrase", "f"])

    return run


def frequent_phrases(docs: DataFrame, fences: list[tuple], min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, words, phrase, f): phrases of 1 to 4 words with f of at least ``min_count``, and all words under ''."""
    united = _shards(docs, fences).groupBy("range").applyInArrow(
        _united(fences, min_count), "lang string, words int, phrase string, f long"
    )
    summed = united.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return summed.filter((F.col("f") >= min_count) | (F.col("words") == 0))


def _acceptor(keys: list[tuple]) -> CountTransducer:
    """Automaton of sorted, different sequences of a language and words."""
    words = sorted({w for k in keys for w in k if w})
    number = {w: i for i, w in enumerate(words, 1)} | {b"": 0}
    rows = np.array([[number[w] for w in k] for k in keys], np.int32).reshape(-1, DEPTH)
    return CountTransducer.build(words, rows, np.ones(len(rows), np.int64), share=False)


def _weighted(keys: list[tuple], counts: list[int]) -> CountTransducer:
    """Transducer that gives every sequence its count, whether or not longer ones begin with it."""
    made = _acceptor(keys)
    known = dict(zip(keys, counts))
    for level, (rows, _, _) in zip(made.levels, made.paths()):
        level.weight = np.array(
            [known.get((*(made.words[w - 1] for w in row), *[b""] * (DEPTH - len(row))), 0) for row in rows.tolist()], np.int64
        )
    return made


def _looked_up(key: tuple, phrases: pa.Table, parts: pa.Table) -> pa.Table:
    """The parts' counts: their acceptor composed with the transducer of the range's phrases."""
    known, asked = defaultdict(dict), defaultdict(set)
    for lang, phrase, f in zip(*(phrases.column(c).to_pylist() for c in ("lang", "phrase", "f"))):
        known[lang][_key(lang, phrase)[1:]] = f
    rows = list(zip(*(parts.column(c).to_pylist() for c in ("lang", "part"))))
    for lang, part in rows:
        asked[lang].add(_key(lang, part)[1:])
    found = {}
    for lang, keys in asked.items():
        if lang not in known:
            continue
        order = sorted(known[lang])
        acceptor = _acceptor(sorted(keys))
        for sequences, weight in acceptor.compose(_weighted(order, [known[lang][k] for k in order])):
            for row, f in zip(sequences.tolist(), weight.tolist()):
                found[lang, b" ".join(acceptor.words[w - 1] for w in row).decode()] = f
    weight = pa.array([found.get(r, 0) for r in rows], pa.int64())
    return pa.table([*(parts.column(c) for c in ("lang", "phrase", "cut", "side")), weight], names=["lang", "phrase", "cut", "side", "f"])


def with_ranges(phrases: DataFrame, column: str, fences: list[tuple]) -> DataFrame:
    """Adds ``range``, where a phrase of the column lies."""

    def work(batch: pa.RecordBatch) -> dict:
        keys = zip(batch.column("lang").to_pylist(), batch.column(column).to_pylist())
        return {"range": pa.array([bisect_right(fences, _key(*k)) for k in keys], pa.int32())}

    return frames.map_columns(phrases, work, "range int", tuple(phrases.columns), rows=1 << 16)


def part_counts(frequent: DataFrame, fences: list[tuple]) -> DataFrame:
    """(lang, phrase, cut, l, r): counts of both sides of every cut of the phrases of two words or more."""
    placed = materialize(with_ranges(frequent.filter("words > 0"), "phrase", fences), "phrases")
    own = F.split("phrase", " ")
    cuts = placed.filter("words > 1").select("lang", "phrase", own.alias("own"), F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    side = F.explode(F.array(F.lit("l"), F.lit("r"))).alias("side")
    part = F.when(F.col("side") == "l", F.expr("slice(own, 1, cut)")).otherwise(F.expr("slice(own, cut + 1, size(own))"))
    parts = cuts.select("lang", "phrase", "cut", "own", side).select("lang", "phrase", "cut", "side", F.array_join(part, " ").alias("part"))
    parts = materialize(with_ranges(parts, "part", fences), "parts")
    many = materialize(parts.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / LOOKUPS).cast("int").alias("salts")), "salts")
    dealt = parts.join(many, "range").withColumn("salt", F.expr("cast(pmod(xxhash64(lang, phrase, cut, side), salts) AS int)")).drop("salts")
    copied = placed.join(many, "range").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    keys = ("range", "salt")
    found = copied.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(
        _looked_up, "lang string, phrase string, cut int, side string, f long"
    )
    sides = [F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in ("l", "r")]
    return found.groupBy("lang", "phrase", "cut").agg(*sides)


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, cover: int = COVER, most: int | None = MOST
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the sides of its weakest cut, ``n`` all words, and
    ``score`` is ``floor(2000000 a / (l + r))``, the least of all cuts (ties: the earliest). Phrases that lie
    in a longer candidate with at least ``cover`` percent of their count are left out. Ranks go by
    score, then ``a``, both falling, then phrase in byte order, up to ``most`` (None: all).
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), frames.text_column().alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fences = fences_of(rows, chars)
    frequent = materialize(frequent_phrases(rows, fences, min_count), "phrases")
    score = F.expr(f"(cast(a AS decimal(20,0)) * {SCALE}) div (cast(l AS decimal(20,0)) + r)")
    long = frequent.filter("words > 1").withColumnRenamed("f", "a")
    cuts = part_counts(frequent, fences).join(long, ["lang", "phrase"]).withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("words").alias("words"), F.min(F.struct("score", "cut", "l", "r")).alias("least")
    )
    inner = long.filter("words > 2").withColumn("own", F.split("phrase", " ")).select(
        "lang", "a", F.explode(F.expr(
            "flatten(transform(sequence(2, words - 1), n -> "
            "transform(sequence(1, words - n + 1), i -> array_join(slice(own, i, n), ' '))))"
        )).alias("phrase")
    )
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    totals = frequent.filter("words = 0").select("lang", F.col("f").alias("n"))
    left = weakest.join(covers, ["lang", "phrase"], "left").filter(
        f"longer IS NULL OR 100 * cast(longer AS decimal(20,0)) < {cover} * cast(a AS decimal(20,0))"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "least.l", "least.r", "least.score").withColumn("rank", F.row_number().over(order).cast("long"))
    if most is not None:
        ranked = ranked.filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations(frames.table(spark, folder, "documents"))


OP12_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM i, (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS own FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
t AS (
  SELECT lang, k, phrase, a, cut, array_to_string(own[1 : cut], ' ') AS one, array_to_string(own[cut + 1 :], ' ') AS two
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (
  SELECT t.lang, t.k, t.phrase, t.a, t.cut, x.f AS l, y.f AS r,
    CAST(CAST(t.a AS HUGEINT) * {SCALE} // (x.f + y.f) AS BIGINT) AS score
  FROM t JOIN f x ON x.lang = t.lang AND x.phrase = t.one JOIN f y ON y.lang = t.lang AND y.phrase = t.two),
m AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (
  SELECT lang, sub, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(own[i : i + z - 1], ' ') AS sub
    FROM c, (VALUES (2), (3)) AS q(z), (VALUES (1), (2), (3)) AS o(i) WHERE z < k AND i + z - 1 <= k) GROUP BY ALL),
r AS (
  SELECT m.lang, phrase, a, l, r, score,
    row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM m LEFT JOIN b ON m.lang = b.lang AND m.phrase = b.sub
  WHERE longer IS NULL OR 100 * longer < {COVER} * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON r.lang = n.lang WHERE rank <= {MOST}
"""
