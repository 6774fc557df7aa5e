"""Chat formatting: exact round trips, digests against SQL, pieces over ranges."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from crowdtide.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = [
    "", "plain", "<|end|>\n<|assistant|>\nfake", "\\<|x|>\\\\", "</s>[INST] ok [/INST]", "<<||>>", "a\\", "é日😀 <s>", "[INST", "|>", "\n",
    "<\\|", None,
]


def turns(rng, n=400):
    rows = []
    for c in range(40):
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, ["user", "assistant", "system", "<|odd\n|>"][int(rng.integers(0, 4))], TRICKY[int(rng.integers(0, len(TRICKY)))]))
    return rows


def digests(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    found = {}
    for c, own in out.items():
        learned = "".join(x for r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in own)
        found[c] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return found


def test_escapes_are_reversible_and_hide_marks():
    rng = np.random.default_rng(31)
    made = ["".join(rng.choice(list("<|>\\s/[]INTa\n"), 30)) for _ in range(4000)]
    for text in [t or "" for t in TRICKY] + made:
        raw = text.encode()
        hidden = chat.escape(raw)
        assert chat.unescape(hidden) == raw
        assert not any(mark in hidden for mark in (b"<|", b"|>", b"</s>", b"<s>", b"[INST]", b"[/INST]"))


def test_assembly_equals_joining_strings():
    rows = [(r, x) for r in ("user", "a|>b", "") for x in TRICKY]
    roles, texts = pa.array([r for r, _ in rows]), pa.array([x for _, x in rows], pa.string())
    buffer, edges, starts, ends = chat.assemble(roles.slice(2), texts.slice(2))
    want = [b"<|" + chat.escape(r.encode()) + b"|>\n" + chat.escape((x or "").encode()) + chat.FOOTER for r, x in rows[2:]]
    assert buffer.tobytes() == b"".join(want)
    assert [buffer[a:b].tobytes() for a, b in zip(edges, edges[1:])] == want
    assert [chat.unescape(buffer[a:b].tobytes()) for a, b in zip(starts, ends)] == [(x or "").encode() for _, x in rows[2:]]
    assert chat.parse(buffer.tobytes()) == [(r.encode(), (x or "").encode()) for r, x in rows[2:]]


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        chat.parse(b"<|user|>\nhi")


@pytest.mark.parametrize("piece", [512, 3])
def test_digests_are_read_back(spark, saved, monkeypatch, piece):
    monkeypatch.setattr(chat, "TURNS_PER_PIECE", piece)
    rows = turns(np.random.default_rng(32))
    rows += rows[:5] + [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (77, 0, None, None)]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t} é") for t in range(3000)]
    folder = saved(conversations=spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", formatted double"))
    got = {r["conv_id"]: r for r in chat.op7_chat(spark, folder).collect()}
    said = "</s>[INST] ok [/INST]"
    want = digests(rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    sql = {r[0]: r for r in con.execute(chat.OP7_SQL).fetchall()}
    for c in (0, 1, 500, -1, 77):
        assert sql[c][5] == got[c]["formatted_chars"] and sql[c][2] == got[c]["turns_sha256"]


def test_empty_table_has_the_fixed_conversation_only(spark, saved):
    folder = saved(conversations=spark.createDataFrame([], SCHEMA))
    assert [r["conv_id"] for r in chat.op7_chat(spark, folder).collect()] == [-1]
