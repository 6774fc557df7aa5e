r"""Runs of repeated words by a suffix automaton and the access operation of link-cut trees.

The words of a text are numbered and the suffix automaton over them is built. Its suffix links form a
tree in which the path from the state of a prefix to the root holds all suffixes of that prefix. The
tree's paths are kept as splay trees: *access* to the state of prefix ``i`` joins its whole path to
one preferred path, whose colour becomes ``i``, the last occurrence of all its words. Before that the
path consists of segments with older colours. A segment of colour ``j`` whose deepest state has length
``L`` says that the last ``L`` words before ``i`` also end at ``j`` and nowhere in between: with the distance
``d = i - j`` at most ``L``, words of distance ``d`` agree on ``L`` places, so that ``L + d`` words ending at ``i``
have the smallest period ``d`` and cannot be extended to the left. A square was found; the last ``i`` at
which the same start and distance show is the right end of the run. Accesses change ``O(log n)``
segments each on the average, so periodic texts cost no more than others.

Words that cannot be part of a run part the text before (``possible``): with a length of at least
``repeats`` periods, every word of a run has an equal word within a ``repeats``-th of it. This is exact,
and it leaves little of ordinary prose to the automaton.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from crowdtide.llm import frames

LEAST_LENGTH = 6
REPEATS = 4
COLUMNS = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


class SuffixTree:
    """Suffix links of the automaton of a sequence, with access to the paths of its prefixes."""

    def __init__(self, words: list[int]):
        link, length, moves, prefix = [-1], [0], [{}], []
        last = 0
        for w in words:
            new = len(link)
            link.append(0)
            length.append(length[last] + 1)
            moves.append({})
            prefix.append(new)
            p = last
            while p >= 0 and w not in moves[p]:
                moves[p][w] = new
                p = link[p]
            if p >= 0:
                q = moves[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(w) == q:
                        moves[p][w] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.length, self.prefix = length, prefix
        # splay trees of the preferred paths: shallower states to the left; a root's up is its path's parent
        self.up, self.left, self.right = link, [-1] * len(link), [-1] * len(link)
        self.colour = [-1] * len(link)  # of a path, at the root of its splay tree

    def _rotate(self, x: int, y: int) -> None:
        """Put ``x`` in the place of its splay parent ``y``."""
        up, left, right = self.up, self.left, self.right
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _splay(self, x: int) -> int:
        """Make ``x`` the root of its splay tree; gives the path's colour."""
        up, left, right = self.up, self.left, self.right
        root = x
        while (y := up[root]) >= 0 and (left[y] == root or right[y] == root):
            root = y
        colour = self.colour[root]
        outside = up[root]
        while (y := up[x]) != outside:
            z = up[y]
            if z != outside:
                self._rotate(*((y, z) if (left[z] == y) == (left[y] == x) else (x, y)))
                y = up[x]
            self._rotate(x, y)
        return colour

    def access(self, end: int) -> list[tuple[int, int]]:
        """Recolour the path of the prefix whose last word is ``end``.

        Gives the older colour and greatest length of every segment that the path consisted of.
        """
        found, below, x = [], -1, self.prefix[end]
        while x >= 0:
            colour = self._splay(x)
            if colour >= 0:
                found.append((colour, self.length[x]))
            if self.right[x] >= 0:
                self.colour[self.right[x]] = colour  # deeper states keep theirs
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = end
        return found


def runs_of(words: list[int], least: int = LEAST_LENGTH, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``repeats`` periods, sorted."""
    if repeats < 2:
        raise ValueError("a run holds at least two periods")
    tree, ends = SuffixTree(words), {}
    for i in range(len(words)):
        for j, same in tree.access(i):
            period = i - j
            if same >= (repeats - 1) * period and same + period >= least:
                ends[i - same - period + 1, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def possible(ids: np.ndarray, texts: np.ndarray, least: int = LEAST_LENGTH, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Stretches (begin, end) outside of which no run can lie, in some texts set one after the other.

    ``texts`` has the text of every word. Within a stretch every word has an equal one in its text at a
    distance of at most a ``repeats``-th of the stretch.
    """
    n = len(ids)
    order = np.sort(ids.astype(np.int64) * n + np.arange(n))
    word, place = np.divmod(order, max(n, 1))
    gap = np.where((word[1:] == word[:-1]) & (texts[place[1:]] == texts[place[:-1]]), np.diff(place), n + 1)
    near = np.full(n, n + 1)
    near[place[:-1]] = gap
    near[place[1:]] = np.minimum(near[place[1:]], gap)
    left, piece = np.arange(n), texts  # places still possible, and the stretch of each
    while len(left):
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(left) > 1) | (np.diff(piece) != 0)]))
        sizes = np.diff(np.append(starts, len(left)))
        size = np.repeat(sizes, sizes)
        stay = (near[left] * repeats <= size) & (size >= least)
        if stay.all():
            return [(int(left[s]), int(left[s]) + int(k)) for s, k in zip(starts, sizes)]
        piece = np.repeat(np.arange(len(starts)), sizes)[stay]
        left = left[stay]
    return []


def periodic_suffix(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents by crc32 of the id: word numbers that repeat from some place on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _of_texts(ids: list, texts: list[bytes], rewrite, least: int, repeats: int) -> list[dict]:
    """Runs and collapsed words of some texts."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words, codes = [], []
    for doc_id, text in zip(ids, texts):
        own = text.split()
        places = rewrite(doc_id, len(own)) if rewrite else None
        if places is not None:
            own = [own[i] for i in places.tolist()]
        words.append(own)
        codes.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    sizes = np.array([len(c) for c in codes])
    begins = np.cumsum(sizes) - sizes
    every = np.concatenate([np.zeros(0, np.int64), *codes])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for begin, end in possible(every, owner, least, repeats):
        text = int(owner[begin])
        shift = begin - int(begins[text])
        runs[text] += [(shift + s, n, p) for s, n, p in runs_of(every[begin:end].tolist(), least, repeats)]
    made = []
    for own, found in zip(words, runs):
        row = {"n_words": len(own), "n_runs": len(found), "start": None, "length": None, "period": None, "exponent_milli": None}
        if found:
            found.sort()
            best = found[0]
            for run in found[1:]:  # the first of equals stays
                if run[1] * best[2] > best[1] * run[2]:
                    best = run
            row |= {"start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2]}
            stays = np.ones(len(own), bool)
            for start, length, period in found:
                stays[start + period : start + length] = False
            own = [own[i] for i in np.flatnonzero(stays).tolist()]
        row["runs"] = [{"start": s, "length": n, "period": p} for s, n, p in found]
        row["collapsed"] = b" ".join(own).decode()
        made.append(row)
    return made


def periodic_runs(
    docs: DataFrame, least: int = LEAST_LENGTH, repeats: int = REPEATS, rewrite=None, most_bytes: int = 1 << 23
) -> DataFrame:
    """doc_id, word and run counts, the run of greatest exponent, all runs, and the ``collapsed`` text.

    A run is a stretch of words of smallest period q and length of at least ``least`` and ``repeats * q``
    that cannot be extended; ties of the exponent go to the smallest start, then period, and without
    a run the four columns are null. ``collapsed`` has what is left, joined by spaces, when of every run
    only the first q words stay. ``rewrite`` can replace a text's words: it gets the id and their
    number, and returns the numbers of the words to take instead, or None.

    Every row is searched by itself, so repeated rows give repeated rows; a null or empty text has no
    words. Texts are taken whole, and together as far as they have ``most_bytes``. Other columns are not
    read. An empty table gives no rows.
    """
    names = [c.split()[0] for c in COLUMNS.replace("struct<start:long,length:long,period:long>", "s").split(", ")]

    def work(batch: pa.RecordBatch) -> dict:
        ids, texts, made, begin, size = batch.column("doc_id").to_pylist(), frames.byte_texts(batch.column("text")), [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= most_bytes or end == len(texts):
                made += _of_texts(ids[begin:end], texts[begin:end], rewrite, least, repeats)
                begin, size = end, 0
        return {n: [row[n] for row in made] for n in names}

    return frames.map_columns(docs.select("doc_id", "text"), work, COLUMNS, ("doc_id",), rows=512)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, a tenth of them with a periodic ending, and digests of runs and rest."""
    found = periodic_runs(frames.table(spark, folder, "documents"), rewrite=periodic_suffix)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
