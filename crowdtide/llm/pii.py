"""Personal data: fixed patterns joined by a semi-Markov conditional random field.

The base spans of four kinds come from fixed patterns and checks. A semi-Markov field over tokens
then adds spans that the patterns miss, such as phone numbers without a plus sign, cards with other
separators and disguised addresses. It scores whole candidate segments: digit counts, checksums,
separators and shape of the full span, and the characters around it. A segment has at most
``LONGEST`` tokens, and dynamic programming chooses boundaries and kinds jointly; every token
outside is a segment of kind "none". The field is trained by maximum likelihood.

Only tokens near a trigger (a digit, ``@`` or a bracketed "at") can lie in a candidate, so all others
are "none" for certain and the programme runs on the islands of ``LONGEST`` tokens around triggers,
however long these tokens are: the result is that of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.llm import frames

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
REACH = 48
SAMPLE = 2000
BUCKETS = 1 << 10

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number starts where no digit stands before it; the leftmost match starts there in any case
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[(\[](?:at|AT)[)\]]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.DOTALL)
_START = re.compile(r"[A-Za-z0-9+(]")
_AT = re.compile(r"@| ?[(\[](?:at|AT)[)\]] ?")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# --- the field ----------------------------------------------------------------------------


def _side(char: str) -> str:
    return "^" if not char else "d" if char in "0123456789" else "a" if char.isalnum() else "s" if char.isspace() else char


def span_features(span: str, before: str, after: str) -> list[int]:
    """Buckets of the whole span's properties."""
    digits = "".join(c for c in span if c in "0123456789")
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "d", span))
    parts = span.split(".")
    quads = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    n = len(digits)
    names = (
        "bias", f"n{min(n, 20)}", f"l{n > 12 and luhn(digits)}{min(n, 20) // 4}", f"q{quads}",
        f"at{len(_AT.findall(span))}", f"dot{min(span.count('.'), 4)}", f"plus{span[0] == '+'}",
        f"shape{shape[:24]}", f"max{min(max(groups, default=0), 20)}", f"sep{''.join(sorted(set(shape) - {'a', 'd'}))[:6]}",
        f"b{_side(before)}", f"a{_side(after)}", f"first{_side(span[0])}", f"last{_side(span[-1])}",
        f"par{span.count('(') - span.count(')')}", f"groups{'-'.join(map(str, groups[:6]))}",
    )
    return [crc32(x.encode()) & (BUCKETS - 1) for x in names]


@dataclass
class Island:
    """Edges of the tokens of a stretch, and its candidate segments ordered by last token."""

    edges: list[int]
    first: np.ndarray
    last: np.ndarray
    features: np.ndarray

    def __len__(self) -> int:
        return len(self.edges) - 1


def _candidate(span: str) -> bool:
    digits = sum(c in "0123456789" for c in span)
    return digits >= 7 or (digits >= 4 and span.count(".") == 3) or _AT.search(span) is not None


def island(text: str, start: int, end: int) -> Island:
    """Cut a stretch of text into tokens and list its candidates.

    A candidate starts at a letter, digit, plus sign or bracket and ends at a letter or digit; it
    has seven digits, four numbers joined by dots, or an "at", and letters only around an "at".
    """
    edges = [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]
    tokens = [text[a:b] for a, b in zip(edges, edges[1:])]
    found: list[tuple[int, int, list[int]]] = []
    digits = np.cumsum([0] + [len(t) if t[0] in "0123456789" else 0 for t in tokens])
    letters = np.cumsum([0] + [t[0].isalpha() for t in tokens])
    ats = np.cumsum([0] + [t in ("@", "at", "AT") for t in tokens])
    starts = [bool(_START.match(t)) for t in tokens]
    for j, token in enumerate(tokens):
        if not token[0].isalnum() or not token.isascii():
            continue
        for i in range(max(0, j - LONGEST + 1), j + 1):
            if not starts[i] or (letters[j + 1] > letters[i] and ats[j + 1] == ats[i]):
                continue
            if digits[j + 1] - digits[i] < 4 and ats[j + 1] == ats[i]:
                continue
            span = text[edges[i] : edges[j + 1]]
            if ("\n" in span) or not _candidate(span):
                continue
            before, after = text[edges[i] - 1 : edges[i]], text[edges[j + 1] : edges[j + 1] + 1]
            found.append((i, j, span_features(span, before, after)))
    first, last = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    features = np.array([f[2] for f in found], np.int64) if found else np.zeros((0, 1), np.int64)
    return Island(edges, first, last, features)


@dataclass
class Field:
    """Weights of features by kind, and of a kind after "none" or another; "none" scores zero."""

    weights: np.ndarray
    follow: np.ndarray

    def scores(self, isle: Island) -> np.ndarray:
        return np.clip(self.weights[isle.features].sum(1), -25, 25)

    def decode(self, isle: Island) -> list[tuple[int, int, int]]:
        """The best segmentation's (kind, start offset, end offset)."""
        n, labels = len(isle), len(KINDS) + 1
        if not len(isle.first):
            return []
        scores, edges = self.scores(isle), np.searchsorted(isle.last, np.arange(n + 1))
        best = np.full((n + 1, labels), -np.inf)
        best[0, 0] = 0.0
        back = np.zeros((n + 1, labels, 2), np.int64)
        for j in range(n):
            before = best[j].argmax()
            best[j + 1, 0], back[j + 1, 0] = best[j, before], (j, before)
            ending = slice(edges[j], edges[j + 1])
            if edges[j] == edges[j + 1]:
                continue
            first = isle.first[ending]
            reach = best[first][:, :, None] + self.follow
            total = reach.max(1) + scores[ending]
            chosen = total.argmax(0)
            for kind, c in enumerate(chosen):
                best[j + 1, kind + 1] = total[c, kind]
                back[j + 1, kind + 1] = first[c], reach[c, :, kind].argmax()
        found, j, label = [], n, int(best[n].argmax())
        while j:
            i, previous = (int(x) for x in back[j, label])
            if label:
                found.append((label - 1, isle.edges[i], isle.edges[j]))
            j, label = i, previous
        return found[::-1]


def _gradient(field: Field, isle: Island, gold: dict, d_weights: np.ndarray, d_follow: np.ndarray) -> None:
    """Add expected minus observed features; ``gold`` maps (first token, last token) to a kind.

    Sums over segmentations run forwards and backwards in plain numbers: scores are bounded, and
    an island of a sample has few segments.
    """
    n, labels = len(isle), len(KINDS) + 1
    if not len(isle.first):
        return
    weight, follow = np.exp(field.scores(isle)), np.exp(field.follow)
    ending = np.searchsorted(isle.last, np.arange(n + 1))
    by_first = np.argsort(isle.first, kind="stable")
    starting = np.searchsorted(isle.first[by_first], np.arange(n + 1))
    ahead, behind = np.zeros((n + 1, labels)), np.zeros((n + 1, labels))
    ahead[0, 0], behind[n] = 1.0, 1.0
    for j in range(n):
        ahead[j + 1, 0] = ahead[j].sum()
        at = slice(ending[j], ending[j + 1])
        if ending[j] < ending[j + 1]:
            ahead[j + 1, 1:] = ((ahead[isle.first[at]] @ follow) * weight[at]).sum(0)
    for j in range(n - 1, -1, -1):
        at = by_first[starting[j] : starting[j + 1]]
        later = (weight[at] * behind[isle.last[at] + 1, 1:]).sum(0)
        behind[j] = behind[j + 1, 0] + follow @ later
    joint = ahead[isle.first][:, :, None] * follow * (weight * behind[isle.last + 1, 1:])[:, None, :] / ahead[n].sum()
    previous, stops = 0, {i: (e, kind) for (i, e), kind in gold.items()}
    at = 0
    while at < n:
        if at in stops:
            e, kind = stops[at]
            joint[np.flatnonzero((isle.first == at) & (isle.last == e))[0], previous, kind] -= 1
            previous, at = kind + 1, e + 1
        else:
            previous, at = 0, at + 1
    d_follow += joint.sum(0)
    np.add.at(d_weights, isle.features.ravel(), np.repeat(joint.sum(1), isle.features.shape[1], axis=0))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of their start; those that touch become one."""
    found: list[list[int]] = []
    for start, end in spans:
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def _ahead(text: str, at: int) -> int:
    """End of the ``LONGEST`` tokens after a token edge."""
    for m in islice(_TOKEN.finditer(text, at), LONGEST):
        at = m.end()
    return at


def _back(text: str, at: int) -> int:
    """Start of the ``LONGEST`` tokens before a token edge; tokens are the same read backwards."""
    window = 8 * LONGEST
    while True:
        low = max(0, at - window)
        ends = [m.end() for m in islice(_TOKEN.finditer(text[low:at][::-1]), LONGEST)]
        if low == 0 or ends[-1] < at - low:  # the last token does not go on before the window
            return at - ends[-1] if ends else at
        window *= 4


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of ``LONGEST`` tokens to either side of triggers; none begins or ends in a token."""
    near = _merged((m.start(), m.end() + LONGEST) for m in _TRIGGER.finditer(text))
    return _merged((_back(text, a), _ahead(text, b - LONGEST)) for a, b in near)


def _surroundings(text: str) -> list[tuple[int, int]]:
    """Stretches of ``REACH`` characters to either side of triggers, as examples of plain text."""
    return _merged((max(0, m.start() - REACH), min(len(text), m.end() + REACH)) for m in _TRIGGER.finditer(text))


def _free(spans: list[tuple[str, int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """What the base spans leave of a stretch."""
    left, at = [], start
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b <= at or a >= end:
            continue
        if a > at:
            left.append((at, a))
        at = max(at, b)
    return left + [(at, end)] if at < end else left


def add_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """The field's spans in what the base spans leave."""
    found = []
    for start, end in islands(text):
        near = [s for s in base if s[1] < end and s[2] > start]
        for a, b in _free(near, start, end):
            if _candidate(text[a:b]):
                found += [(KINDS[k], s, e) for k, s, e in field.decode(island(text, a, b))]
    return found


# --- training -----------------------------------------------------------------------------


def _variants(kind: str, span: str) -> list[str]:
    """The same datum as people write it outside the patterns."""
    if kind == "phone":
        return [span, span.lstrip("+"), span.lstrip("+").replace(" ", "-"), re.sub(r"^\+[0-9]+ ?", "", span)]
    if kind == "card":
        d = re.sub(r"[^0-9]", "", span)
        return [span, *(sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in (" ", "-", ".", "/"))]
    if kind == "email":
        return [span, span.replace("@", " (at) "), span.replace("@", " [at] "), span.replace("@", "[at]")]
    return [span]


def _examples(seed: int, count: int) -> list[tuple[str, str]]:
    """Made-up data of every kind by rule, so that the field exists without a corpus."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    made = []
    for _ in range(count):
        card = number(15)
        card += next(str(d) for d in range(10) if luhn(card + str(d)))
        word = "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
        made += [
            ("email", f"{word}.{number(2)}@mail{number(1)}.{word[:4]}.com"),
            ("ip", ".".join(str(x) for x in rng.integers(0, 256, 4))),
            ("card", card),
            ("phone", f"+{rng.integers(1, 99)} ({number(3)}) {number(3)}-{number(4)}"),
        ]
    return made


def made_up(count: int = 20) -> list[tuple[str, int, int, str]]:
    """Stretches of every kind and, as often, of numbers that are nobody's data."""
    rng = np.random.default_rng(4)
    rows = [(f"the {s} of", 4, 4 + len(s), k) for k, s in _examples(3, count)]
    for n in range(count):
        plain = "".join(map(str, rng.integers(1, 10, 7 + n % 9)))
        year, month, day = 1990 + n, 1 + n % 12, 1 + n % 28
        for text in (
            f"sum {plain} items", f"in {year} about {year * 37} of {year * 11}.{n % 10} units", f"on {year}-{month:02}-{day:02} at 10:{n + 10}:00",
            f"version {n}.{n % 7}.{month} of {plain}.{n}", f"rows {plain} {plain[::-1]} {plain[1:]}",
        ):
            rows.append((text, 0, len(text), ""))
    return rows


def fit(contexts: list[tuple[str, int, int, str]], epochs: int = 8, rate: float = 0.15, seed: int = 5) -> Field:
    """Fit on stretches (text, start, end, kind); kind "" marks a stretch without personal data.

    Every span is also shown in the ways people write it outside the patterns, in the same
    surroundings, so that the field learns from the whole span rather than from one pattern.
    """
    rng = np.random.default_rng(seed)
    data = []
    for text, start, end, kind in contexts:
        shown = _variants(kind, text[start:end]) if kind else [text[start:end]]
        for v in shown:
            made = text[:start] + v + text[end:]
            isle = island(made, 0, len(made))
            where = {o: i for i, o in enumerate(isle.edges)}
            gold = {}
            if kind and start in where and start + len(v) in where:
                gold = {(where[start], where[start + len(v)] - 1): KINDS.index(kind)}
                i, j = next(iter(gold))
                if not ((isle.first == i) & (isle.last == j)).any():
                    continue
            data.append((isle, gold))
    field = Field(np.zeros((BUCKETS, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS))))
    field.weights[crc32(b"bias") & (BUCKETS - 1)] = -2.0
    squares, follow_squares = np.full(field.weights.shape, 1e-6), np.full(field.follow.shape, 1e-6)
    for _ in range(epochs):
        for begin in range(0, len(order := rng.permutation(len(data))), 16):
            d_weights, d_follow = 1e-3 * field.weights, 1e-3 * field.follow
            for i in order[begin : begin + 16]:
                _gradient(field, *data[i], d_weights, d_follow)
            squares += d_weights**2
            follow_squares += d_follow**2
            field.weights -= rate * d_weights / np.sqrt(squares)
            field.follow -= rate * d_follow / np.sqrt(follow_squares)
    return field


def contexts(texts: list[str], most: int = 150) -> list[tuple[str, int, int, str]]:
    """Short stretches of a sample: base spans in their surroundings, and stretches without any."""
    found, clear = [], []
    for text in texts:
        spans = base_spans(text)
        for kind, a, b in spans:
            cut, stop = max(0, a - 20), min(len(text), b + 20)
            if b - a <= 64 and not any(s[1] < stop and s[2] > cut for s in spans if s != (kind, a, b)):
                found.append((text[cut:stop], a - cut, b - cut, kind))
        for a, b in _surroundings(text):
            if b - a <= 400 and not any(s[1] < b and s[2] > a for s in spans):
                clear.append((text[a:b], 0, b - a, ""))
    step = max(1, len(found) // most)
    return found[::step][:most] + clear[:: max(1, len(clear) // most)][:most]


def train(docs: DataFrame, most: int = SAMPLE, longest: int = 20_000) -> Field:
    """Fit on base spans of at most ``most`` documents of at most ``longest`` characters.

    The documents are chosen by hash among those with a digit or an at sign; made-up examples
    join them, so an empty table also gives a field.
    """
    short = docs.select("text").filter(
        F.col("text").isNotNull() & (F.length("text") <= longest) & F.col("text").rlike("[0-9@]")
    )
    return fit(contexts(frames.hashed_sample(short, F.col("text"), "text", most)) + made_up())


# --- operator -----------------------------------------------------------------------------


def find(docs: DataFrame, field: Field, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with ``base`` and ``spans``: arrays of (kind, start, end) in code points.

    ``spans`` holds the base spans and those added by the field; both are ordered by kind as
    listed, then by start. Whole texts are read; null and empty texts have none. Repeated rows are
    searched each, and an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        full = [sorted(b + add_spans(t, b, field), key=_order) for t, b in zip(texts, base)]
        rows = [[[{"kind": k, "start": a, "end": e} for k, a, e in x] for x in part] for part in (base, full)]
        return {"base": pa.array(rows[0], kind), "spans": pa.array(rows[1], kind)}

    span = "array<struct<kind:string,start:long,end:long>>"
    return frames.map_columns(docs.select(*dict.fromkeys([*keep, "text"])), work, f"base {span}, spans {span}", keep)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets.

    Overlapping spans are replaced by the kind of the first. Null texts stay null, and
    ``n_chars`` follows the new text.
    """

    def work(batch: pa.RecordBatch) -> dict:
        masked = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            spans = base + add_spans(text, base, field) if text else []
            out, at = [], 0
            for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], f"<{k}>"]
                at = max(at, b)
            masked.append(text if text is None else "".join(out) + text[at:])
        return {"masked": pa.array(masked, pa.string())}

    rows, names = frames.numbered(docs, "text", "n_chars")
    made = frames.map_columns(rows, work, "masked string", tuple(rows.columns))
    length = F.coalesce(F.length("masked").cast("long"), F.col("n_chars"))
    return made.withColumns({"text": F.col("masked"), "n_chars": length}).select(*names)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of every document, with a digest of the base ones."""
    docs = frames.table(spark, folder, "documents")
    found = find(docs, train(docs), ("doc_id",))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def mask_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: personal data is masked; every document stays."""
    return mask(docs, train(docs))
