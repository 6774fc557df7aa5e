"""Packing of token sequences by first-fit decreasing.

Documents are dealt to randomised groups of a few thousand, and each group is packed on its own.
Whole sequences are cut off the front of long documents; the rests are placed in decreasing order
into the first sequence with room, found by descending a tournament tree whose inner nodes hold
the largest free capacity below them.
"""

from __future__ import annotations

import json
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.llm import frames

CAPACITY = 1024
GROUP = 8192
REMEMBERED = 300_000
#: Fixed value: the pattern by which byte-level tokenizers cut texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(path: str):
    """The tokenizer's merges as ranks for the faster library, or none where ids could differ.

    Equal ids need plain byte-level BPE, cut by the common pattern, whose merges are numbered in
    the order of their ids.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or ()]
    plain = (
        model.get("type", "BPE") == "BPE" and pairs and not model.get("dropout") and not model.get("ignore_merges")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and whole.get("normalizer") is None and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    )
    if not plain:
        return None
    vocabulary, letters = model["vocab"], _byte_letters()
    made = [vocabulary[a + b] for a, b in pairs]
    if made != sorted(set(made)) or len(vocabulary) != len(made) + 256 or made[0] != 256:
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Byte-level BPE ids; texts are cut at single spaces, where no token crosses."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._ranked = ranked(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._known = frames.Memo(self._after_space, REMEMBERED)

    def _encode(self, text: str) -> bytes:
        if self._ranked is None or any(t in text for t in self._added):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranked.encode_ordinary(text)
        return np.asarray(ids, self.kind).tobytes()

    def _after_space(self, part: str) -> bytes | None:
        """Ids of a space and a part; none if white space goes on, so that no cut is allowed."""
        return None if not part or part[-1].isspace() else self._encode(" " + part)

    def _with_white_space(self, parts: list[str]) -> bytes:
        """Ids of a text with runs of white space, cut only at spaces after something else."""
        pieces, held = [], []
        for part in parts:
            held.append(part)
            if part and not part[-1].isspace():
                pieces.append(" ".join(held))
                held = [""]
        return b"".join(map(self._encode, [*pieces, " ".join(held)]))

    def __call__(self, text: str) -> bytes:
        """Ids as consecutive little-endian integers of ``kind``."""
        first, *rest = parts = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._with_white_space(parts)
        try:
            return self._encode(first) + b"".join(map(self._known.__getitem__, rest))
        except TypeError:  # a part without ids
            return self._with_white_space(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Tournament:
    """Free capacities of sequences; finds the first with enough room in logarithmic time."""

    def __init__(self, leaves: int, capacity: int):
        self.size = 1 << max(leaves - 1, 0).bit_length()
        self.free = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Take ``length`` from the first leaf with that much room; returns the leaf."""
        free, node = self.free, 1
        while node < self.size:
            node *= 2
            if free[node] < length:
                node += 1
        leaf = node - self.size
        free[node] -= length
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return leaf


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of every bin; items are numbers of ``lengths``, each at most the capacity."""
    tree, bins = Tournament(len(lengths), capacity), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        place = tree.place(int(lengths[item]))
        if place == len(bins):
            bins.append([])
        bins[place].append(item)
    return bins


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length): whole ones first, then the packed rests."""
    whole = [
        [(doc, capacity * i, capacity)] for doc, n in enumerate(lengths.tolist()) for i in range(n // capacity)
    ]
    rest = lengths % capacity
    docs = np.flatnonzero(rest)
    bins = first_fit_decreasing(rest[docs], capacity)
    return whole + [
        [(int(d), int(lengths[d] - rest[d]), int(rest[d])) for d in docs[items]] for items in bins
    ]


def _pieces(group: int, keys: list, ids: list[np.ndarray], capacity: int, with_ids: bool) -> pd.DataFrame:
    rows = []
    for number, sequence in enumerate(pack(np.array([len(x) for x in ids], np.int64), capacity)):
        offset = 0
        for doc, start, length in sequence:
            raw = ids[doc][start : start + length].astype("<u4").tobytes()
            rows.append((keys[doc], start, length, crc32(raw), len(ids[doc]), (group << 32) | number, offset, raw))
            offset += length
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    made = pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    return made if with_ids else made.drop(columns="ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP,
    end_id: int = 0, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's ids end with ``end_id``; a null or empty text is that id alone. ``ids`` are
    little-endian unsigned 32-bit integers. Rows are dealt to groups by a hash of their place in
    the input, so repeated ids or texts never meet in one large group; a group has about ``group``
    documents at every size of the input. An empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group))

    def encode(batch: pa.RecordBatch) -> dict:
        tokens = encoder(path)
        end = np.array([end_id], tokens.kind).tobytes()
        return {"ids": pa.array([tokens(t or "") + end for t in batch.column("text").to_pylist()], pa.binary())}

    placed = docs.select(
        "doc_id", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp")
    )
    encoded = frames.map_columns(placed, encode, "ids binary", ("doc_id", "grp"))

    def fill(key, rows):
        kind, rows = encoder(path).kind, rows.sort_values("doc_id", kind="stable")
        ids = [np.frombuffer(x, kind) for x in rows["ids"]]
        keys = [None if pd.isna(k) else int(k) for k in rows["doc_id"]]
        return _pieces(int(key[0]), keys, ids, capacity, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.groupBy("grp").applyInPandas(fill, schema + (", ids binary" if with_ids else ""))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document."""
    return pack_documents(frames.table(spark, folder, "documents"), with_ids=False)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: pieces with their ids."""
    return pack_documents(docs)
