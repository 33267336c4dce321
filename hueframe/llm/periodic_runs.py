"""Stretches of a text's words that repeat with a period, by Lyndon roots from Baier's grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

RUNS = "array<struct<start long, length long, period long>>"
OPEN = -2
#: An odd multiplier of rolling sums modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """For each place the length of the longest Lyndon word that starts there: phase one of Baier's suffix sorter.

    `ranks` are dense numbers from 0. Places are grouped by a common prefix, at first the word itself. The groups are
    taken from the greatest down. Each place of a group points at the last place before it that belongs to a
    lower group (`before`, followed in jumps); places pointed at move to a new group just above their own, whose prefix is
    longer by as many copies of the group's prefix as point at them. When a group's turn comes its prefix is the Lyndon word looked for.
    """
    n, kinds = len(ranks), int(ranks.max()) + 1
    group = ranks.tolist()
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * kinds
    above, below = [*range(1, kinds), -1], [*range(-1, kinds - 1)]
    before = [OPEN] * (n + 1)  # the last one stands for the place before the first
    out = [0] * n
    now = kinds - 1
    while now >= 0:
        size, pointed = length[now], []
        for s in members[now]:
            if group[s] != now:
                continue
            out[s] = size
            p = s - 1
            while before[p] != OPEN:
                p = before[p]
            before[s] = p
            if p >= 0:
                if pointed and pointed[-1][0] == p:
                    pointed[-1][1] += 1
                else:
                    pointed.append([p, 1])
        made: dict[tuple[int, int], int] = {}
        for p, copies in sorted(pointed, key=lambda x: -x[1]) if len(pointed) > 1 else pointed:
            old = group[p]
            new = made.get((old, copies))
            if new is None:
                new = made[old, copies] = len(length)
                length.append(length[old] + copies * size)
                members.append([])
                over = above[old]
                above.append(over)
                below.append(old)
                above[old] = new
                if over >= 0:
                    below[over] = new
            group[p] = new
            members[new].append(p)
        members[now] = []
        now = below[now]
    return np.array(out)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values two arrays share, compared in steps that double."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        if (wrong := np.flatnonzero(x[at : at + step][: n - at] != y[at : at + step][: n - at])).size:
            return at + int(wrong[0])
        at, step = at + step, 2 * step
    return n


def _repeated(ids: np.ndarray, passage: int) -> list[tuple[int, int]]:
    """The stretches made up of passages of so many words that occur twice or more (or whose sums collide, which does no harm)."""
    n = len(ids)
    if n <= passage:
        return []
    powers = np.full(n, BASE, np.uint64)
    back = np.full(n, INVERSE, np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * powers, out=sums[1:])
    of = (sums[passage:] - sums[:-passage]) * back[: n - passage + 1]
    order = np.argsort(of, kind="stable")
    same = of[order[1:]] == of[order[:-1]]
    if not same.any():
        return []
    cover = np.zeros(n + 1, np.int64)
    at = np.union1d(order[1:][same], order[:-1][same])
    np.add.at(cover, at, 1)
    np.add.at(cover, at + passage, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def find_runs(ids: np.ndarray, least: int = 24, copies: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers whose length is at least `least` and `copies` periods, sorted.

    A run is a stretch with that smallest period that can't be made longer. Under one of the two orders of words its
    period is the length of the longest Lyndon word at two places a period apart (at least: a run has three periods). Such
    roots are extended to both sides as far as words a period apart agree. Where no passage of least - least // copies
    words recurs there can be no such run, so that only stretches with recurring passages are grouped.
    """
    if copies < 3 or least < 1:
        raise ValueError("copies must be 3 or more, least 1 or more")
    found: set[tuple[int, int, int]] = set()
    for a, b in _repeated(ids, max(1, least - least // copies)):
        part = ids[a:b]
        ranks = np.unique(part, return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            lengths = lyndon_lengths(order)
            at = np.arange(len(part))
            after = at + lengths
            roots = at[(after < len(part)) & (lengths[np.minimum(after, len(part) - 1)] == lengths) & (part[np.minimum(after, len(part) - 1)] == part)]
            ends: dict[int, int] = {}
            for i in roots.tolist():
                p = int(lengths[i])
                if i + p < ends.get(p, 0):
                    continue
                start = i - _common(part[:i][::-1], part[: i + p][::-1])
                end = ends[p] = i + p + _common(part[i:], part[i + p :])
                if end - start >= max(least, copies * p):
                    found.add((a + start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def periodic_runs(df: DataFrame, least: int = 24, copies: int = 3, id_col: str | Column = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """One row (doc_id, runs, collapsed) for each row of `df`, without any shuffle.

    `runs` has every run of the text's words (runs of anything but ASCII white space) of at least `least` words and `copies`
    periods, as (start, length, period) by start and period. `collapsed` is the text without the words that some run contains after its
    first period, words joined by one space. Null, empty and blank texts have no runs and an empty `collapsed`. Texts of any
    length are searched whole, in time and memory in proportion to their words. Repeated rows each give a row; a null id stays null;
    an empty table gives an empty one. Other columns of `df`, whatever their names, are left out.
    """
    few = df.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("doc_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                runs, left = [], []
                for text in part.column(1).to_pylist():
                    words = text.split() if text else []
                    ids = np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))
                    found = find_runs(ids, least, copies)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    if found:
                        drop = np.zeros(len(words) + 1, np.int64)
                        for s, n, p in found:
                            drop[s + p] += 1
                            drop[s + n] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                    left.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(left, pa.binary())], names=["doc_id", "runs", "collapsed"])

    return few.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))
