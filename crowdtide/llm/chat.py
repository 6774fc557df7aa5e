r"""Chat formatting by columnar byte assembly.

A turn becomes ``<|role|>`` newline, its text, ``<|end|>`` newline. Control strings inside roles and
texts get a backslash after their first character, and backslashes are doubled, so no text can
look like a mark and taking every backslash off restores the text. The controls are ``<|`` and ``|>``
of the template itself and the foreign ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``.

A batch is assembled without touching single turns: lengths of all segments, their cumulative
offsets and the scatter indices are numpy arrays, and headers, texts and footers are copied into one
preallocated buffer that becomes an Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.llm import frames
from crowdtide.scratch import materialize

LEARNED = "assistant"
TURNS_PER_PIECE = 512
FOOTER = b"<|end|>\n"
_CONTROL = r"\\|<\||\|>|</?s>|\[/?INST\]"
_ESCAPED = re.compile(rb"\\|<(?=\||/?s>)|\|(?=>)|\[(?=/?INST\])")
_TURN = re.compile(rb"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>\n((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.DOTALL)
_TAKEN = re.compile(rb"\\(.)", re.DOTALL)


def escape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\g<0>\\", text)


def unescape(text: bytes) -> bytes:
    return _TAKEN.sub(rb"\1", text)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts read back; text that is no sequence of turns is an error."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        found.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return found


def _escaped(column: pa.Array) -> pa.Array:
    """Binary column with escaped values; only those that hold a control are rewritten."""
    column = pc.fill_null(column.cast(pa.string()), "")
    marked = pc.match_substring_regex(column, _CONTROL)
    raw = column.cast(pa.binary())
    if pc.any(marked).as_py():
        rewritten = pa.array([escape(t) for t in raw.filter(marked).to_pylist()], pa.binary())
        raw = pc.replace_with_mask(raw, marked, rewritten)
    return raw


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a binary column's values."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def _scatter(target: np.ndarray, places: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy every value to its place in the target."""
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    target[np.repeat(places, lengths) + within] = data[np.repeat(starts, lengths) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns, the turns' offsets, and start and end of every text in it."""
    role, text = _escaped(roles), _escaped(texts)
    role_data, role_starts, role_lengths = _bytes_of(role)
    text_data, text_starts, text_lengths = _bytes_of(text)
    opening, closing, foot = (np.frombuffer(x, np.uint8) for x in (b"<|", b"|>\n", FOOTER))
    sizes = np.stack([
        np.full(len(role), len(opening)), role_lengths, np.full(len(role), len(closing)), text_lengths,
        np.full(len(role), len(foot)),
    ], axis=1)
    edges = np.concatenate([[0], np.cumsum(sizes.ravel())])
    places = edges[:-1].reshape(sizes.shape)
    buffer = np.empty(int(edges[-1]), np.uint8)
    for at, mark in ((0, opening), (2, closing), (4, foot)):
        buffer[places[:, at, None] + np.arange(len(mark))] = mark
    _scatter(buffer, places[:, 1], role_data, role_starts, role_lengths)
    _scatter(buffer, places[:, 3], text_data, text_starts, text_lengths)
    turns = np.concatenate([places[:, 0], edges[-1:]])
    return buffer, turns, places[:, 3], places[:, 3] + text_lengths


def _characters(buffer: np.ndarray) -> np.ndarray:
    """Code points before every byte, and in all."""
    return np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])


def _string_column(buffer: np.ndarray, offsets: np.ndarray) -> pa.Array:
    edges = pa.py_buffer(offsets.astype(np.int32))
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, edges, pa.py_buffer(buffer)])


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, first, n_turns, formatted, mask) of conversations, in pieces.

    Turns are ordered by (turn, role, text). They are dealt by ranges of (conv_id, turn, role, text),
    so a conversation of any length spreads over tasks; a piece has at most ``TURNS_PER_PIECE``
    turns and ``first`` orders the pieces of a conversation. ``mask`` lists start and end, in code
    points of the piece, of what a model learns: the texts of assistants. A null text or role is
    empty, a null turn comes first, and rows without a conversation form one of their own. Repeated
    rows are turns like others. An empty table gives no rows.
    """
    wanted = ["conv_id", "turn", "role", "text"]
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartitionByRange(*wanted).sortWithinPartitions(*wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                buffer, edges, starts, ends = assemble(part.column("role"), part.column("text"))
                before = _characters(buffer)
                ids = part.column("conv_id")
                n = part.num_rows
                changed = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                changed = changed | (nulls[1:] != nulls[:-1])
                cuts = np.unique(np.concatenate([[0], np.flatnonzero(changed) + 1, np.arange(0, n, TURNS_PER_PIECE)]))
                bounds = np.append(cuts, n)
                learned = pc.equal(part.column("role"), LEARNED).to_numpy(zero_copy_only=False)
                mask = [
                    [
                        {"start": int(before[starts[t]] - before[edges[a]]), "end": int(before[ends[t]] - before[edges[a]])}
                        for t in np.flatnonzero(learned[a:b]) + a
                    ]
                    for a, b in zip(bounds, bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(cuts)), pa.array(piece + np.arange(len(cuts))), pa.array(np.diff(bounds)),
                    _string_column(buffer, edges[bounds]), pa.array(mask, span),
                ], names=["conv_id", "first", "n_turns", "formatted", "mask"])
                piece += len(cuts)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return ordered.mapInArrow(
        run, "conv_id long, first long, n_turns long, formatted string, mask array<struct<start:long,end:long>>"
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted pieces and masks alone.

    Pieces of a conversation are read in order by one task, since a digest is sequential, but only
    one piece is held at a time.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            columns = [batch.column(n) for n in ("conv_id", "formatted", "mask")]
            for i in range(batch.num_rows):
                conv, formatted, mask = (c[i].as_py() for c in columns)
                if state is None or state["conv_id"] != conv:
                    done += [state] if state else []
                    state = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
                for role, text in parse(formatted.encode()):
                    state["n"] += 1
                    state["turns"].update(role + b"\n" + text + b"\n")
                for m in mask:
                    learned = unescape(formatted[m["start"] : m["end"]].encode())
                    state["loss"].update(learned)
                    state["chars"] += len(learned.decode())
                state["all"] += len(formatted)
            if done:
                yield digest(done)
        if state:
            yield digest([state])

    def digest(states: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([
            {
                "conv_id": s["conv_id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(),
                "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["all"],
            }
            for s in states
        ], schema=schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation and of one made of foreign control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = frames.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(materialize(format_turns(turns.unionByName(own)), "formatted"))


_CONTROLS = (("<|", "<\\|"), ("|>", "|\\>"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"))


def _escape_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for plain, escaped in _CONTROLS:
        sql = f"replace({sql}, '{plain}', '{escaped}')"
    return sql


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length({_escape_sql('role')}) + length({_escape_sql('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
