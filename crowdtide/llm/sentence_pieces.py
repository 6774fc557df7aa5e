"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The automaton holds all pieces. It reads a text once, and at every position the output links name all
pieces that end there; each relaxes the best score of the position from that of its start. A character
in no piece falls back to its bytes. Of equal scores, the longest last piece wins.

No piece has a space after another character, and none a line break beside others, so the best path of
a text is that of its words one after the other, and words are remembered.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.llm import frames

SPACE = "▁"
REMEMBERED = 48
FALLBACK_PENALTY = 10.0
_PART = re.compile(r"\n| *[^ \n]+| +")


class Pieces:
    """The pieces of a model file: an automaton for encoding and their bytes for decoding."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        scores = [model.get_score(i) for i in range(size)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        in_bytes = set(self.byte_ids)
        plain = [
            i for i in range(size)
            if i not in in_bytes and not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        if any(not model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no pieces for bytes to fall back on")
        if any(SPACE in names[i].lstrip(SPACE) or ("\n" in names[i] and len(names[i]) > 1) for i in plain):
            raise ValueError("pieces reach over words, which this encoder cuts at")
        if all(float(scores[i]).is_integer() for i in plain):  # ranks of merges, no log probabilities
            scores = [-float(np.log(2.0 - s)) for s in scores]
        self.fallback = min(scores[i] for i in plain) - FALLBACK_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(names[i], (len(names[i]), scores[i], i))
        self.automaton.make_automaton()
        self.raw = [n.replace(SPACE, " ").encode() for n in names]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self.known = frames.Memo(self.best, 400_000)

    def best(self, word: str) -> tuple[bytes, int]:
        """Ids (little-endian, 32 bits) of the best path over a word, and its characters in bytes."""
        n = len(word)
        marked = word.replace(SPACE, "\0").replace(" ", SPACE)  # a real U+2581 is spelt in bytes
        score, piece = array("d", [0.0]) + array("d", [-np.inf]) * n, array("i", [-1]) * (n + 1)
        length = array("i", [1]) * (n + 1)
        matches = self.automaton.iter(marked)
        end, (size, gain, found) = next(matches, (n, (0, 0.0, 0)))
        for at in range(n):
            top, choice, step = score[at] + self.fallback, -1, 1
            while end == at:
                reached = score[at + 1 - size] + gain
                if reached > top or (reached == top and size > step):
                    top, choice, step = reached, found, size
                end, (size, gain, found) = next(matches, (n, (0, 0.0, 0)))
            score[at + 1], piece[at + 1], length[at + 1] = top, choice, step
        ids, fallen, at = [], 0, n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(word[at - 1].encode()))
                fallen += 1
            at -= length[at]
        return np.array(ids[::-1], "<u4").tobytes(), fallen

    def encode(self, text: str) -> tuple[bytes, int]:
        """Ids of a whole text, and how many characters fell back to bytes. An empty text has none."""
        if not text:
            return b"", 0
        parts = _PART.findall(" " + text)
        found = [self.known[p] if len(p) <= REMEMBERED else self.best(p) for p in parts]
        return b"".join(f[0] for f in found), sum(f[1] for f in found)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the first piece's leading space, set by encoding, goes."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``ids``, ``n_fallback`` and ``ids_crc32`` of whole texts; null texts are empty.

    The checksum is over little-endian 32-bit ids. The model's scores weigh the pieces; where they
    are merge ranks, the logarithm of the rank does, by Zipf's law. Repeated rows are encoded each, and
    an empty table gives no rows.
    """
    path = model or default_model()

    def work(batch: pa.RecordBatch) -> dict:
        known = pieces(path)
        found = [known.encode(t or "") for t in batch.column("text").to_pylist()]
        lengths = np.array([len(f[0]) // 4 for f in found], np.int64)
        values = np.frombuffer(b"".join(f[0] for f in found), "<u4").astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return {
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            "n_fallback": pa.array([f[1] for f in found], pa.int64()),
            "ids_crc32": pa.array([crc32(f[0]) for f in found], pa.int64()),
        }

    made = "ids array<int>, n_fallback long, ids_crc32 long"
    return frames.map_columns(docs.select(*dict.fromkeys([*keep, "text"])), work, made, keep)


def decode(encoded: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the ``decoded`` text of ``ids``; null ids count as none."""
    path = model or default_model()

    def work(batch: pa.RecordBatch) -> dict:
        known, ids = pieces(path), batch.column("ids")
        texts = [known.decode(x.values.to_numpy()) if x.is_valid else "" for x in ids]
        return {"decoded": pa.array(texts, pa.string())}

    return frames.map_columns(encoded.select(*dict.fromkeys([*keep, "ids"])), work, "decoded string", keep)


def op3_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by number and checksum, and whether decoding restores the text."""
    docs = frames.table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(docs, keep=("doc_id", "text"))
    decoded = decode(encoded, keep=("doc_id", "text", "ids", "n_fallback", "ids_crc32"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "n_fallback", "ids_crc32",
        (F.col("decoded") == F.col("text")).alias("restored"),
    )
