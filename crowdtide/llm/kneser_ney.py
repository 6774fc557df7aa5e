"""Interpolated modified Kneser-Ney n-grams of any order from two in sorted hash arrays.

Tasks hash the words of whole texts, sum the n-grams of some million tokens at a time and send them to
shards as codes into a small dictionary. A shard sums its n-grams and writes them as a sorted array of
hashes beside an array of counts. For the order below it sends on the n-grams' ends (how often, and after
how many different words) and their contexts (how often, and before how many words seen once, twice or
more), whose shards do the same, down to the words. All arrays lie in the shared folder. Scoring tasks map
them into memory and look up sorted batches of hashes, so a task needs memory for its batch only,
however large the model is. A file that is missing or cut short is an error.

Shards form a grid over context and last word, so a very common word spreads over a row or column
of them, and a rare one meets few.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.llm import frames
from crowdtide.scratch import new_folder

FLUSH = 3_000_000
SLICE = 1_500_000
TOKENS_PER_SHARD = 4_000_000
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n<s>", b"\n</s>"))  # no word holds a newline
_U8 = np.dtype("<u8")
_U4 = np.dtype("<u4")


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lowered; exactly the runs without ASCII white space."""
    return text.lower().split()


def _hash_memo() -> frames.Memo:
    return frames.Memo(xxhash.xxh64_intdigest, 400_000)


def token_hashes(texts: list[bytes], known, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-gram that ends at every token, as one row of tokens per place, and every text's number of tokens."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in lists], np.int64)
    tokens = np.empty(int(sizes.sum()), _U8)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = np.fromiter((known[w] for words in lists for w in words), np.uint64, int(inner.sum()))
    tokens[ends] = END
    place = np.arange(len(tokens)) - np.repeat(ends - sizes + 1, sizes)
    grams = [tokens]
    for back in range(1, order):
        before = np.full(len(tokens), START, _U8)
        before[back:] = tokens[:-back]
        before[place < back] = START
        grams.insert(0, before)
    return grams, sizes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def bigram_hashes(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(contexts) + tokens * np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the first word, of the first two, and so on to the whole n-grams."""
    found = [words[0]]
    for word in words[1:]:
        found.append(bigram_hashes(found[-1], word))
    return found


def _folded(codes: np.ndarray, size: int) -> np.ndarray:
    """One number per column of codes below ``size``, in the order of the columns."""
    bits = np.uint64(max(1, int(size - 1).bit_length()))
    key = codes[0].astype(np.uint64)
    for row in codes[1:]:
        if len(key) and int(key.max()).bit_length() + int(bits) > 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (key << bits) | row.astype(np.uint64)
    return key


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)


def _added(values: list[np.ndarray], firsts: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(v, firsts) if len(firsts) else v[:0] for v in values]


@dataclass(frozen=True)
class Grid:
    """Shards of n-grams by context and last word, and of words."""

    rows: int
    columns: int
    words: int

    def shard(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        row = _mixed(contexts) % np.uint64(self.rows)
        return (row * np.uint64(self.columns) + _mixed(tokens) % np.uint64(self.columns)).astype(np.int64)

    def of(self, words: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
        return self.shard(hashes[-2], words[-1]) if len(words) > 1 else self.word_shard(words[0])

    def shards(self, level: int) -> int:
        return self.rows * self.columns if level > 1 else self.words

    def word_shard(self, words: np.ndarray) -> np.ndarray:
        return ((words >> np.uint64(32)) * np.uint64(self.words) >> np.uint64(32)).astype(np.int64)


def _write(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array so that a repeated or parallel attempt leaves the same whole file."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    values.tofile(part := f"{path}.{os.getpid()}")
    os.replace(part, path)


def _mapped(path: str, kind) -> np.ndarray:
    """A written array; one that is not there raises an error."""
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def mounted(folder: str) -> str:
    """Path of a shared folder that workers can map; stores without a mount are refused."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped into memory: {folder} must be a mounted folder")
    return url.path


#: Of an n-gram below the highest order: after how many different words it occurs, how often it is a context,
#: before how many words seen once, twice and more often, and how often it ends a longer n-gram.
COLUMNS = ("before", "total", "n1", "n2", "n3", "count")
ENDS, CONTEXTS = (0, 5), (1, 2, 3, 4)


def _width(level: int, order: int) -> int:
    """Stored columns: an n-gram of the highest order has its count only; counts of others are asked of words."""
    return 1 if level == order else len(COLUMNS) - (level > 1)


def _store(folder: str, level: int, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """Write sorted hashes, their values in a byte each, and the places and values that need more."""
    flat = np.stack(values, 1).ravel()
    large = np.flatnonzero(flat >= 255)
    _write(folder, f"{level}-{shard}.keys", keys)
    _write(folder, f"{level}-{shard}.values", np.minimum(flat, 255).astype(np.uint8))
    _write(folder, f"{level}-{shard}.large", np.stack([large, flat[large]], 1).astype(_U8))


@lru_cache(maxsize=256)
def _stored(folder: str, level: int, shard: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    path = f"{folder}/{level}-{shard}"
    keys, values = _mapped(f"{path}.keys", _U8), _mapped(f"{path}.values", np.uint8)
    if len(values) != len(keys) * columns:
        raise OSError(f"{path}: {len(keys)} hashes but {len(values)} values")
    return keys, values.reshape(-1, columns), _mapped(f"{path}.large", _U8).reshape(-1, 2)


@dataclass
class Model:
    """Where the arrays lie, the corpus totals and each order's discounts for counts 1, 2 and more."""

    folder: str
    grid: Grid
    order: int
    tokens: int = 0
    types: int = 0
    bigrams: int = 0
    discounts: list[np.ndarray] = field(default_factory=list)
    rest: float = 1.0  # mass that the discounts of words free for unseen ones

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """Stored values of n-grams, one row each; zeros for unknown ones."""
        level, columns = len(words), _width(len(words), self.order)
        hashes = gram_hashes(words)
        keys, first, inverse = np.unique(hashes[-1], return_index=True, return_inverse=True)
        shards = self.grid.of([w[first] for w in words], [h[first] for h in hashes])
        found = np.zeros((len(keys), columns), np.int64)
        order = np.argsort(shards, kind="stable")
        edges = np.searchsorted(shards[order], np.arange(self.grid.shards(level) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            here = order[edges[s] : edges[s + 1]]
            own, values, large = _stored(self.folder, level, int(s), columns)
            at, hit = _places(own, keys[here])
            small = values[at[hit]].astype(np.int64)
            row, column = np.nonzero(small == 255)
            if len(row):
                place = np.searchsorted(large[:, 0], (at[hit][row] * columns + column).astype(np.uint64))
                small[row, column] = large[place, 1]
            found[here[hit]] = small
        return found[inverse]


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted hashes in a sorted array, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _classes(counts: np.ndarray) -> list[np.ndarray]:
    return [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of modified Kneser-Ney from how many n-grams occur once to four times.

    Where a count of counts is zero the estimate does not exist, and half a count is taken off.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] and y else 0.5 for k in (1, 2, 3)]
    return np.clip(found, 0.0, [1.0, 2.0, 3.0])


# --- counting -----------------------------------------------------------------------------

#: n n-grams of a shard: a dictionary of hashes, the words as codes into it, and its ends (0) or contexts (1) with their values.
_ROWS = "shard int, n int, at int, words binary, codes binary, values binary"
_ROW_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("n", pa.int32()), ("at", pa.int32()),
    ("words", pa.binary()), ("codes", pa.binary()), ("values", pa.binary()),
])


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest ones first, compressed."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: pa.Buffer, kind: np.dtype, rows: int, n: int) -> np.ndarray:
    raw = pa.Codec("zstd", compression_level=1).decompress(data, rows * n * kind.itemsize)
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(rows, n)


def _sent(shards: np.ndarray, words: np.ndarray, codes: np.ndarray, values: list[np.ndarray], at: int) -> Iterator[dict]:
    """Rows of n-grams for their shards, with the words that each shard's part needs, the commonest first."""
    order = np.argsort(shards, kind="stable")
    cuts = _firsts(shards[order])
    for begin, end in zip(cuts, [*cuts[1:], len(order)]):
        part = order[begin:end]
        used, local, uses = np.unique(codes[:, part], return_inverse=True, return_counts=True)
        by_use = np.argsort(-uses, kind="stable")
        place = np.empty(len(used), _U4)
        place[by_use] = np.arange(len(used))
        yield {
            "shard": int(shards[part[0]]), "n": len(part), "at": at, "words": words[used[by_use]].astype(_U8).tobytes(),
            "codes": _packed(place[local]), "values": _packed(np.stack([v[part] for v in values]).astype(_U8)),
        }


def _total_row(totals: np.ndarray) -> dict:
    return {"shard": -1, "n": 0, "at": 0, "words": b"", "codes": b"", "values": totals.astype(_U8).tobytes()}


def _received(table: pa.Table, level: int, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All words of a shard in order, and its n-grams as codes with their values."""
    rows = [r for r in zip(*(table.column(c) for c in table.column_names[1:])) if r[0].as_py()]
    own = [np.frombuffer(r[2].as_buffer(), _U8) for r in rows]
    words = np.unique(np.concatenate(own or [np.zeros(0, _U8)]))
    size = sum(r[0].as_py() for r in rows)
    codes = np.empty((level, size), np.uint32)
    values = [np.zeros(size, np.int64) for _ in range(1 if level == order else len(COLUMNS))]
    begin = 0
    for (n, at, _, local, numbers), known in zip(rows, own):
        n = n.as_py()
        part = slice(begin, begin + n)
        codes[:, part] = np.searchsorted(words, known)[_unpacked(local.as_buffer(), _U4, level, n)]
        places = (0,) if level == order else (ENDS, CONTEXTS)[at.as_py()]
        for place, v in zip(places, _unpacked(numbers.as_buffer(), _U8, len(places), n)):
            values[place][part] = v
        begin += n
    return words, codes, values


def _count(grid: Grid, order: int):
    """Per task: n-grams of some million tokens, summed, sent to their shards."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # The words of contexts are tokens too, but for those before the first tokens of a piece.
        words = np.unique(np.concatenate([x for grams in held for x in (grams[-1], *(g[:order] for g in grams), [START])]))
        codes = np.stack([np.searchsorted(words, np.concatenate(place)).astype(np.uint32) for place in zip(*held)])
        key = _folded(codes, len(words))
        by_key = np.argsort(key, kind="stable")
        firsts = _firsts(key[by_key])
        counts = np.diff(np.append(firsts, len(key)))
        codes = codes[:, by_key[firsts]]
        grams = [words[c] for c in codes]
        for row in _sent(grid.of(grams, gram_hashes(grams)), words, codes, [counts], 0):
            yield pa.RecordBatch.from_pylist([row], schema=_ROW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _hash_memo(), [], 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                grams, _ = token_hashes(frames.byte_texts(whole.column("text").slice(begin, 1000)), known, order)
                for at in range(0, len(grams[-1]), FLUSH):
                    held.append([g[at : at + FLUSH] for g in grams])
                    size += len(held[-1][-1])
                    if size >= FLUSH:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _totals_of(table: pa.Table) -> np.ndarray:
    return np.sum([np.frombuffer(x.as_buffer(), _U8) for x in table.column("values") if len(x.as_buffer())], 0)


def _sum_totals(key, table):
    return pa.Table.from_pylist([_total_row(_totals_of(table))], schema=_ROW_SCHEMA)


def _stored_level(folder: str, grid: Grid, level: int, order: int):
    """Per shard of an order: sum and write the n-grams; send ends and contexts to the order below.

    Shard -1 adds up how many n-grams of each order occur once to four times, and the numbers of
    tokens, words and pairs of neighbours.
    """

    def run(key, table):
        shard = key[0].as_py()
        if shard < 0:
            return _sum_totals(key, table)
        words, codes, values = _received(table, level, order)
        folded = _folded(codes, len(words))
        by_key = np.argsort(folded, kind="stable")
        firsts = _firsts(folded[by_key])
        values = _added([v[by_key] for v in values], firsts)
        codes = codes[:, by_key[firsts]]
        grams = [words[c] for c in codes]
        hashes = gram_hashes(grams)[-1]
        by_hash = np.argsort(hashes)
        _store(folder, level, shard, hashes[by_hash], [v[by_hash] for v in values[: _width(level, order)]])
        often, count = values[0], values[0 if level == order else 5]
        totals = np.zeros(4 * order + 3, np.int64)
        totals[4 * level - 4 : 4 * level] = np.bincount(np.minimum(often, 5), minlength=6)[1:5]
        rows = []
        if level == 1:
            totals[-3:] = count.sum(), (count > 0).sum(), often.sum()
        else:
            live = often > 0
            codes, often, count = codes[:, live], often[live], count[live]
            context = _firsts(_folded(codes[:-1], len(words)))  # lie together in the order of the n-grams
            seen = _added([often, *_classes(often)], context)
            end = _folded(codes[1:], len(words))
            by_end = np.argsort(end, kind="stable")
            ends = _firsts(end[by_end])
            ending = _added([np.ones(len(by_end), np.int64), count[by_end]], ends)
            for part, sums, at in ((codes[:-1, context], seen, 1), (codes[1:, by_end[ends]], ending, 0)):
                lower = [words[c] for c in part]
                rows += _sent(grid.of(lower, gram_hashes(lower)), words, part, sums, at)
        return pa.Table.from_pylist([*rows, _total_row(totals)], schema=_ROW_SCHEMA)

    return run


def train(docs: DataFrame, order: int = 3) -> Model:
    """Count all texts of ``docs`` and store the model of an order of at least two in the shared folder.

    Null texts count as empty ones, which have an end token only. Without rows every text gets
    the uniform probability of an unknown word. Repeated rows count as often as they occur.
    """
    if order < 2:
        raise ValueError("the order is at least two")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(1, -(-((size["n"] or 0) // 6 + size["rows"]) // TOKENS_PER_SHARD))
    side = max(1, round(shards**0.5))
    grid = Grid(side, -(-shards // side), max(1, -(-shards // 4)))
    folder = mounted(new_folder(spark, "kneser-ney"))
    rows = texts.mapInArrow(_count(grid, order), _ROWS)
    none = F.lit(b"").cast("binary")
    for level in range(order, 0, -1):
        # Every shard gets a row, so that each writes its files, and one that is missing is an error.
        every = spark.range(grid.shards(level)).select(
            F.col("id").cast("int").alias("shard"), F.lit(0).alias("n"), F.lit(0).alias("at"),
            none.alias("words"), none.alias("codes"), none.alias("values"),
        )
        rows = rows.union(every).groupBy("shard").applyInArrow(_stored_level(folder, grid, level, order), _ROWS)
    found = np.frombuffer(rows.groupBy("shard").applyInArrow(_sum_totals, _ROWS).first()["values"], _U8)
    counts = found[: 4 * order].reshape(order, 4).tolist()
    model = Model(folder, grid, order, *[int(x) for x in found[-3:]], [discounts(n) for n in counts])
    if model.tokens:
        once, twice = counts[0][:2]
        model.rest = float(model.discounts[0] @ [once, twice, model.types - once - twice]) / model.bigrams
    return model


# --- scoring ------------------------------------------------------------------------------


def _discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return np.maximum(counts - np.concatenate([[0.0], discount])[np.minimum(counts, 3)], 0.0)


def probabilities(model: Model, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Kneser-Ney probability and training count of the last word of every n-gram after its context."""
    words = model.find(grams[-1:])
    count, p = words[:, 5], np.full(len(words), model.rest / (model.types + 1))
    if model.bigrams:
        p += _discounted(words[:, 0], model.discounts[0]) / model.bigrams
    stats = words
    for level in range(2, model.order + 1):
        whole, context = grams[-level:], grams[-level:-1]
        # The context is mostly the n-gram of the order below that ends one token before.
        known = np.zeros(len(p), bool)
        known[1:] = gram_hashes(context)[-1][1:] == gram_hashes(grams[1 - level :])[-1][:-1]
        seen = np.empty_like(stats)
        seen[1:] = stats[:-1]
        seen[~known] = model.find([c[~known] for c in context])
        if level < model.order:
            stats = model.find(whole)
            often = stats[:, 0]
        else:
            often = np.zeros(len(p), np.int64)
            at = np.flatnonzero((seen[:, 1] > 0) & (count > 0))
            often[at] = model.find([w[at] for w in whole])[:, 0]
        total = np.maximum(seen[:, 1], 1)
        discount = model.discounts[level - 1]
        high = _discounted(often, discount) / total + (seen[:, 2:5] @ discount) / total * p
        p = np.where(seen[:, 1] > 0, high, p)
    return p, count


def score(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with n_tokens, n_known, base_score, score (log10) and perplexity of whole texts.

    Null texts are empty ones; repeated rows are scored each, and an empty table gives no rows.
    """

    class Work:
        def __init__(self):
            self.known = _hash_memo()

        def __call__(self, batch: pa.RecordBatch) -> dict:
            grams, sizes = token_hashes(frames.byte_texts(batch.column("text")), self.known, model.order)
            columns = [np.empty(len(grams[-1])) for _ in range(3)]
            for begin in range(0, len(grams[-1]), SLICE):
                part = slice(begin, begin + SLICE)
                p, count = probabilities(model, [g[part] for g in grams])
                columns[0][part] = np.log10(p)
                columns[1][part] = np.log10((count + 1) / (model.tokens + model.types + 1))
                columns[2][part] = count > 0
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(c, starts) if len(starts) else c[:0] for c in columns]
            return {
                "n_tokens": pa.array(sizes), "n_known": pa.array(sums[2].astype(np.int64)),
                "base_score": pa.array(sums[1]), "score": pa.array(sums[0]),
                "perplexity": pa.array(10 ** np.minimum(-sums[0] / sizes, 300.0)),
            }

    made = "n_tokens long, n_known long, base_score double, score double, perplexity double"
    return frames.map_columns(docs.select(*dict.fromkeys([*keep, "text"])), Work, made, keep, rows=1000)


def op6_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document under a model of those that are not held out."""
    docs = frames.table(spark, folder, "documents").select("doc_id", "text")
    held_out = frames.in_part(F.col("doc_id"), 7, 2)
    model = train(docs.filter(~held_out))
    return score(docs, model, ("doc_id",)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity",
    )
