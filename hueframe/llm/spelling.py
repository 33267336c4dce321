"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

#: Odd multiplier of the words' polynomial sums modulo 2**64 and its inverse.
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Words of so many code points and more share one shard, so that the number of shards is bounded.
LAST_SHARD = 64
#: A Bloom block is 8 lanes of 32 bits; a key sets one bit in each lane.
LANES = 8
#: Blocks that one row of the stored filters holds: 64 kB.
CHUNK = 2048
#: Edits that are hashed at a time in a task.
EDITS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(length: int) -> np.ndarray:
    """BASE to the powers length - 1 down to 0."""
    out = np.full(length, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out)[::-1]


def blocks_of(words: int, bits: int) -> int:
    return max(1, math.ceil(words * bits / (32 * LANES)))


def place(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each mixed key."""
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def lane_bit(keys: np.ndarray, lane: int) -> np.ndarray:
    """The one bit that a mixed key sets in a lane."""
    low = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B1 + 2 * 0x3C6EF372 * lane) & np.uint64(0xFFFFFFFF)
    return np.uint32(1) << (low >> np.uint64(27)).astype(np.uint32)


def codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def by_length(words: list[str]) -> Iterator[list[str]]:
    """Words of one length together, in lots of bounded size."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        n = len(words[at])
        lot = max(1, min(2048, EDITS // (n * 64)))
        end = at + 1
        while end < len(words) and end - at < lot and len(words[end]) == n:
            end += 1
        yield words[at:end]
        at = end


def sums(chars: np.ndarray) -> np.ndarray:
    """The terms of the words' polynomial sums."""
    return mix(chars.astype(np.uint64) + np.uint64(1)) * powers(chars.shape[1])[None, :]


def shard_of(length: int) -> int:
    return min(length, LAST_SHARD)


Wave = list[tuple[int, int, int, int]]


def waves(counts: dict[int, int], bits: int, most: int) -> list[Wave]:
    """Which filters are broadcast together: lists of (shard, its blocks, first block, end) of at most `most` bytes each.

    A shard larger than that is cut into ranges of blocks, so that a vocabulary of any size is probed in parts of bounded size.
    """
    size, out, room = CHUNK * LANES * 4, [], 0
    for shard in sorted(counts):
        blocks = blocks_of(counts[shard], bits)
        for first in range(0, blocks, CHUNK):
            if room < size:
                out.append([])
                room = max(most, size)
            room -= size
            now = out[-1]
            if now and now[-1][0] == shard and now[-1][3] == first:
                now[-1] = (shard, blocks, now[-1][2], min(blocks, first + CHUNK))
            else:
                now.append((shard, blocks, first, min(blocks, first + CHUNK)))
    return out


class Filters:
    """The Bloom blocks of one wave."""

    def __init__(self, wave: Wave, chunks: dict[tuple[int, int], bytes]):
        self.shards: dict[int, tuple[int, int, np.ndarray]] = {}
        for shard, blocks, first, end in wave:
            lanes = np.concatenate([np.frombuffer(chunks.get((shard, c), bytes(CHUNK * LANES * 4)), np.uint32).reshape(-1, LANES) for c in range(first // CHUNK, -(-end // CHUNK))])
            self.shards[shard] = (blocks, first, lanes)

    def __contains__(self, shard: int) -> bool:
        return shard in self.shards

    def hits(self, shard: int, keys: np.ndarray) -> np.ndarray:
        """The positions of the keys that may be in a shard: lane by lane, only survivors going on."""
        blocks, first, lanes = self.shards[shard]
        keys = mix(keys)
        block = place(keys, blocks).astype(np.int64) - first
        left = np.flatnonzero((block >= 0) & (block < len(lanes))) if len(lanes) < blocks else np.arange(len(keys))
        for lane in range(LANES):
            left = left[lanes[block[left], lane] & lane_bit(keys[left], lane) != 0]
        return left


def probe(words: list[str], filters: Filters, alphabets: dict[int, np.ndarray]) -> Iterator[tuple[str, str]]:
    """Pairs (word, edit) of all deletions, and of all replacements by a greater letter, that may be words.

    Insertions are the deletions seen from the longer word, replacements by a smaller letter those seen from the other
    word, so that each pair of near words comes once. Edits are hashed from their word's sums; only hits are spelled out.
    """
    for lot in by_length(words):
        n = len(lot[0])
        chars = codes(lot)
        terms = sums(chars)
        whole = terms.sum(axis=1, dtype=np.uint64)
        if shard_of(n - 1) in filters and n > 1:
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            keys = before * INVERSE + (whole[:, None] - before - terms)
            # One deletion of each run of equal letters: the others give the same word.
            first = np.ones(chars.shape, bool)
            first[:, 1:] = chars[:, 1:] != chars[:, :-1]
            row, at = np.nonzero(first)
            for k in filters.hits(shard_of(n - 1), keys[row, at]).tolist():
                word, i = lot[row[k]], int(at[k])
                yield word, word[:i] + word[i + 1 :]
        if shard_of(n) in filters and len(letters := alphabets.get(shard_of(n), ())):
            values = mix(letters.astype(np.uint64) + np.uint64(1))
            step, factors = max(1, EDITS // (len(lot) * len(letters))), powers(n)
            for start in range(0, n, step):
                here = chars[:, start : start + step]
                rest = whole[:, None] - terms[:, start : start + step]
                row, at, letter = np.nonzero(letters[None, None, :] > here[:, :, None])
                keys = rest[row, at] + values[letter] * factors[start + at]
                for k in filters.hits(shard_of(n), keys).tolist():
                    word, i = lot[row[k]], start + int(at[k])
                    yield word, word[:i] + chr(letters[letter[k]]) + word[i + 1 :]


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each shard's words, as (shard, code point)."""
    for batch in batches:
        seen: dict[int, np.ndarray] = {}
        for lot in by_length(batch.column(0).to_pylist()):
            s = shard_of(len(lot[0]))
            seen[s] = np.union1d(seen.get(s, np.zeros(0, np.uint32)), codes(lot))
        for s, letters in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(letters), s, np.int32)), pa.array(letters.astype(np.int64))], names=["shard", "letter"])


def bloom_chunks(vocabulary: DataFrame, counts: dict[int, int], bits: int) -> DataFrame:
    """The filters as rows (shard, chunk, lanes), built by groups of some 30,000 words each (CHUNK blocks, by their hash)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, chunk, key = [], [], []
            for lot in by_length(batch.column(0).to_pylist()):
                s = shard_of(len(lot[0]))
                keys = mix(sums(codes(lot)).sum(axis=1, dtype=np.uint64))
                key.append(keys.view(np.int64))
                chunk.append((place(keys, blocks_of(counts[s], bits)) // np.uint64(CHUNK)).astype(np.int64))
                shard.append(np.full(len(lot), s, np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shard, chunk, key)], names=["shard", "chunk", "key"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        shard, chunk = key[0].as_py(), key[1].as_py()
        keys = table.column("key").to_numpy().view(np.uint64)
        block = place(keys, blocks_of(counts[shard], bits)).astype(np.int64) - chunk * CHUNK
        lanes = np.zeros((CHUNK, LANES), np.uint32)
        for lane in range(LANES):
            np.bitwise_or.at(lanes[:, lane], block, lane_bit(keys, lane))
        return pa.table({"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "lanes": pa.array([lanes.tobytes()], pa.binary())})

    return vocabulary.select("word").mapInArrow(keyed, "shard int, chunk long, key long").groupBy("shard", "chunk").applyInArrow(build, "shard int, chunk long, lanes binary")


def near_pairs(vocabulary: DataFrame, scratch: Scratch, bits: int = 16, most: int = 64 << 20) -> DataFrame:
    """Every pair of words of `vocabulary` (distinct `word`, `n`) that are one insertion, deletion or replacement apart, once: (word, n, near, near_n).

    Bloom filters of `bits` bits a word, in shards by length, are built on the executors and broadcast in waves of at most `most`
    bytes; positives of all waves are looked up in the vocabulary itself by an equality join, which removes false ones.
    """
    length = F.char_length("word")
    shard = F.least(length, F.lit(LAST_SHARD)).alias("shard")
    counts = {r.shard: r.n for r in vocabulary.groupBy(shard).agg(F.count("*").alias("n")).collect()}
    alphabets = {r.shard: np.sort(np.array(r.letters, np.uint32)) for r in vocabulary.select("word").mapInArrow(_letters, "shard int, letter long").distinct().groupBy("shard").agg(F.collect_list("letter").alias("letters")).collect()}
    chunks = scratch.keep(bloom_chunks(vocabulary, counts, bits))
    context = vocabulary.sparkSession.sparkContext
    found = []
    for wave in waves(counts, bits, most):
        inside = [(F.col("shard") == s) & (F.col("chunk") * CHUNK >= first) & (F.col("chunk") * CHUNK < end) for s, _, first, end in wave]
        rows = chunks.where(F.exists(F.array(*inside), lambda x: x)).collect()
        shared = context.broadcast(Filters(wave, {(r.shard, r.chunk): bytes(r.lanes) for r in rows}))
        del rows
        shards = [s for s, *_ in wave]
        # A shard is probed by its own words and by those one longer; words longer than the last shard's first length stay in it.
        probing = F.least(length, F.lit(LAST_SHARD)).isin(shards) | F.least(length - 1, F.lit(LAST_SHARD)).isin(shards)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0).to_pylist()
                n = dict(zip(words, batch.column(1).to_pylist()))
                lot: list[tuple[str, str]] = []
                for pair in probe(words, shared.value, alphabets):
                    lot.append(pair)
                    if len(lot) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in lot]), pa.array([n[a] for a, _ in lot], pa.int64()), pa.array([b for _, b in lot])], names=["word", "n", "near"])
                        lot = []
                if lot:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in lot]), pa.array([n[a] for a, _ in lot], pa.int64()), pa.array([b for _, b in lot])], names=["word", "n", "near"])

        found.append(vocabulary.where(probing).select("word", "n").mapInArrow(run, "word string, n long, near string"))
    if not found:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    return positives.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def spelling_variants(words: DataFrame, word_col: str = "word", min_length: int = 7, min_count: int = 2, ratio: int = 10, bits: int = 16, most: int = 64 << 20) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each distinct word of at least `min_length` code points and `min_count` occurrences.

    `words` has a row for each occurrence. Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    `form` is the near word with the largest n (ties: the smallest in code-point order) if that is at least `ratio` times the word's n, else
    null; `form_n` is its n; `root` is where forms lead from the word, itself if it has none; `n_near` counts near words. Null words are
    left out; repeated rows are occurrences; words of any length are compared whole; an empty table gives an empty one. Other columns,
    whatever their names, are left out. Rows in memory: 2,048 words with a million edits at a time, and filters of `most` bytes. The result is stored in the shared folder.
    """
    if min_length < 1 or min_count < 1 or ratio < 2:
        raise ValueError("min_length and min_count must be 1 or more, ratio 2 or more")
    scratch = Scratch(words.sparkSession)
    few = words.select(F.col(word_col).alias("word")).where(F.char_length("word") >= min_length)
    vocabulary = scratch.keep(few.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))
    pairs = scratch.keep(near_pairs(vocabulary, scratch, bits, most))
    both = pairs.select("word", F.col("near_n"), "near").unionByName(pairs.select(F.col("near").alias("word"), F.col("n").alias("near_n"), F.col("word").alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    ok = -F.col("best.less") >= ratio * F.col("n")
    rows = scratch.keep(rows.select("word", F.when(ok, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, -F.col("best.less")).alias("form_n")))
    # n grows by the ratio with each form, so that a chain of forms has few links; their number doubles with each round.
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    highest = rows.agg(F.max("form_n")).first()[0]
    depth = math.floor(math.log(max(highest, 1) / min_count, ratio) + 1e-9) if highest else 0
    for _ in range(max(0, math.ceil(math.log2(depth))) if depth > 1 else 0):
        links = scratch.keep(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    out = stored(rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.clear()
    return out
