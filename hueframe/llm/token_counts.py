"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices


@lru_cache(maxsize=2)
def patterns(path: str) -> tuple[regex.Pattern, regex.Pattern | None]:
    """Pre-token pattern and pattern of special strings of a file; only these stay in memory."""
    with open(path, encoding="utf-8") as f:
        specials = [t["content"] for t in json.load(f).get("added_tokens", [])]
    import public_tokenizers

    special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    # \s of the library is Unicode's White_Space.
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")), special


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, int], regex.Pattern, regex.Pattern | None]:
    """Merge table (pair of ids: rank, merged id), ids of single bytes, pre-token pattern and pattern of special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    # Byte-level vocabularies write the printable bytes as themselves and the others as code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return merges, {b: vocab[c] for b, c in spelled.items()}, *patterns(path)


def merged_length(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols that are left after all merges: their first number minus the merges done.

    The heap holds (rank, place) of adjacent pairs; `after` and `before` link the live places. An entry is
    stale once its place was merged away or its pair changed, which the stored rank shows.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols = symbols.copy()
    get = merges.get
    heap = []
    for i in range(n - 1):
        if found := get((symbols[i], symbols[i + 1])):
            heap.append((found[0], i))
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = get((symbols[i], symbols[j]))
        if found is None or found[0] != rank:
            continue
        symbols[i], symbols[j] = found[1], -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := get((symbols[i], symbols[k])):
                heapq.heappush(heap, (found[0], i))
        h = before[i]
        if h >= 0 and (found := get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (found[0], h))
    return left


class TokenCounter:
    """Counts tokens of whole texts; remembers the lengths of up to `remember` pre-tokens and starts anew when full."""

    def __init__(self, path: str, remember: int = 1_000_000):
        self.merges, self.bytes, self.pattern, self.special = _model(path)
        self.known: dict[str, int] = {}
        self.remember = remember

    def _piece(self, piece: str) -> int:
        if len(self.known) >= self.remember:
            self.known.clear()
        n = merged_length([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")], self.merges)
        if len(piece) <= 64:
            self.known[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        get, piece = self.known.get, self._piece
        for part in parts:
            for p, times in Counter(self.pattern.findall(part)).items():
                total += times * (get(p) or piece(p))
        return total


@lru_cache(maxsize=1)
def _counter(path: str) -> TokenCounter:
    """One counter for each worker process, so that its memory serves every task that the process runs."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, id_col: str | Column = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) for each row of `df`, without any shuffle.

    `path` is a byte-level BPE file in the tokenizers' JSON format, readable on every machine. Special strings
    inside a text count as one token each, as is the library's default. Null text counts as empty: 0 bytes, 0
    tokens. Texts of any length are counted whole. Repeated rows each give a row; a null id stays null; an empty
    table gives an empty one. Other columns of `df`, whatever their names, are left out.
    """
    few = df.select(F.col(id_col).cast("long").alias("doc_id") if isinstance(id_col, str) else id_col.alias("doc_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    n_bytes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                    n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return few.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
