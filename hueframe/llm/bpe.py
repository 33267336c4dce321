"""Byte-pair encoding and decoding of documents through a table of distinct words."""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices
from .token_counts import patterns

#: Words after which a block of documents closes.
BLOCK = 1 << 23
#: Distinct words after which it closes.
DISTINCT = 1 << 20
#: Places of words that are worked on at once.
PART = 1 << 18


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def split_documents(df: DataFrame, path: str, block_words: int = BLOCK) -> DataFrame:
    """Blocks of documents as rows (block, ids, counts, refs, words, ats).

    `words` are the block's distinct words in order (pre-tokens of the file's pattern, special strings as words of their own), `ats` their
    numbers, the most frequent word's first, `refs` the number of each word of each document, `counts` how many words each of the documents `ids` has.
    Words in order and numbers by frequency, packed byte plane by byte plane, take the least room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, special = patterns(path)
        block = TaskContext.get().partitionId() << 33
        numbers, refs, ids, counts = _Numbers(), array("I"), [], []

        def close() -> pa.RecordBatch:
            words, given = sorted(numbers), np.frombuffer(refs, np.uint32)
            rank = np.empty(len(words), np.uint32)
            # A part of the places at a time: they are most of a block, and numpy widens what it counts.
            parts = [given[at : at + PART] for at in range(0, len(given), PART)]
            times = np.zeros(len(words), np.int64)
            for part in parts:
                times += np.bincount(part, minlength=len(words))
            rank[np.argsort(-times, kind="stable")] = np.arange(len(words), dtype=np.uint32)
            ats = rank[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))]
            pack = zstandard.ZstdCompressor(3).compressobj(size=given.nbytes)
            packed = [pack.compress((rank[part] >> shift).astype(np.uint8).tobytes()) for shift in (0, 8, 16, 24) for part in parts]
            row = [[block], [ids], [counts], [b"".join([*packed, pack.flush()])], [words], [ats]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["block", "ids", "counts", "refs", "words", "ats"])

        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    had = len(refs)
                    if text and special and special.search(text):
                        found = chain.from_iterable(chain(pattern.findall(a), b) for a, b in zip(special.split(text), [*([s] for s in special.findall(text)), []]))
                    else:
                        found = pattern.findall(text) if text else ()
                    refs.extend(map(numbers.__getitem__, found))
                    ids.append(key)
                    counts.append(len(refs) - had)
                    if len(refs) >= block_words or len(numbers) >= DISTINCT:
                        done = close()
                        numbers, refs, ids, counts = _Numbers(), array("I"), [], []
                        yield done
                        del done
                        block += 1
        if ids:
            done = close()
            del numbers, refs, ids, counts
            yield done

    return df.mapInArrow(run, "block long, ids array<long>, counts array<long>, refs binary, words array<string>, ats array<int>")


def encode_words(places: DataFrame, path: str) -> DataFrame:
    """(block, at, ids) for rows (block, at, word): one shuffle brings equal words together in order, so that each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        last, last_ids = None, []
        for batch in batches:
            distinct, runs = [], []
            for word in batch.column(2).to_pylist():
                if distinct and word == distinct[-1]:
                    runs[-1] += 1
                else:
                    distinct.append(word)
                    runs.append(1)
            known = distinct[0] == last if distinct else False
            coded = ([last_ids] if known else []) + [e.ids for e in tokenizer.encode_batch_fast(distinct[known:], add_special_tokens=False)]
            if not coded:
                continue
            last, last_ids = distinct[-1], coded[-1]
            of = pa.array(coded, pa.list_(pa.int32())).take(pa.array(np.repeat(np.arange(len(coded)), runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), of], names=["block", "at", "ids"])

    return places.select("block", "at", "word").repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, at int, ids array<int>")


def id_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of each id of a byte-level BPE file, as (id, piece): as many rows as the file has ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is no byte-level BPE file without normalizer and prefix space")
    # Byte-level vocabularies write the printable bytes as themselves and the others as code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    own = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    pieces = own | {i: bytes(spelled[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in own}
    return spark.createDataFrame(list(pieces.items()), "id int, piece binary")


def with_pieces(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The other columns of `coded` and (nth, id, piece) for each of a row's ids, by a join with the pieces of the file.

    The table of pieces has as many rows as the file has ids (50,257), so that it's broadcast. Ids that the file doesn't have
    are left out, as the library does; rows without ids keep one row with nulls.
    """
    each = coded.select(*[c for c in coded.columns if c != ids], F.posexplode_outer(ids).alias("nth", "id"))
    return each.join(F.broadcast(id_pieces(coded.sparkSession, path)), "id", "left").select(*[c for c in coded.columns if c != ids], "nth", "id", "piece").where("id IS NULL OR piece IS NOT NULL")


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for rows of ids, of which each has an own `doc_id`: the text of the ids' joined pieces, U+FFFD for bytes that aren't UTF-8.

    Null and empty ids give an empty text; rows that share a doc_id are one text's parts in no order that is defined; a null doc_id is one more; an empty table gives an empty one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(b or b"").decode("utf-8", "replace") for b in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    got = with_pieces(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), path).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("nth", "piece")))).alias("got"))
    hexed = got.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.array_join(F.transform("got.piece", F.hex), "")).alias("bytes"))
    return hexed.mapInArrow(join, "doc_id long, decoded string")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at, nth, id, piece) to a few rows (block, pack) for each block, to move them in little room.

    A pack is an Arrow table (at, nth, id) and the pieces of its distinct ids, compressed. No order of the rows is relied on.
    """
    pack = zstandard.ZstdCompressor(3).compress
    kept: list[pa.RecordBatch] = []
    rows = 0

    def written(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).combine_chunks()
        block, at, nth, ids = (table.column(i).to_numpy() for i in range(4))
        order = np.lexsort((nth, at, block))
        edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
        blocks, packs = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            here = order[a:b]
            _, first = np.unique(ids[here], return_index=True)
            pieces = table.select(["id", "piece"]).take(here[first]).combine_chunks()
            # Places as steps: small numbers that compress well.
            steps = np.diff(at[here], prepend=0)
            table_of = pack(written(pa.table({"step": steps.astype(np.int32), "nth": nth[here], "id": ids[here]})))
            packs.append(len(table_of).to_bytes(8, "little") + table_of + pack(written(pieces)))
            blocks.append(block[here[0]])
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packs, pa.binary())], names=["block", "pack"])

    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 19:
            yield flush()
            kept, rows = [], 0
    if rows:
        yield flush()


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of `sizes` that begin at `starts`, one run after the other, and where each begins among them."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - before[:-1], sizes) + np.arange(before[-1]), before


def _joined(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, part: int = 1 << 15) -> bytes:
    """The runs of `sizes` bytes that begin at `starts`, a part at a time, since places take more room than letters."""
    return b"".join(letters[_runs(starts[i : i + part], sizes[i : i + part])[0]].tobytes() for i in range(0, len(starts), part))


class _Coded:
    """What the words of a block stand for: ids of word i are flat[offsets[i] : offsets[i + 1]], its bytes spelled[ends[i] : ends[i + 1]]."""

    def __init__(self, packs: pa.BinaryArray, words: int):
        unpack = zstandard.ZstdDecompressor().decompress
        at, nth, ids, of = [], [], [], {}
        for p in packs:
            p = p.as_buffer()
            cut = 8 + int.from_bytes(p[:8].to_pybytes(), "little")
            table = pa.ipc.open_stream(unpack(p[8:cut])).read_all()
            at.append(np.cumsum(table.column(0).to_numpy(), dtype=np.int32))
            nth.append(table.column(1).to_numpy())
            ids.append(table.column(2).to_numpy())
            pieces = pa.ipc.open_stream(unpack(p[cut:])).read_all()
            of.update(zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()))
        at, nth, ids = (np.concatenate(x) for x in (at, nth, ids))
        self.flat = ids[np.lexsort((nth, at))]
        self.sizes = np.bincount(at, minlength=words)
        del at, nth, ids
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        # Bytes of the distinct ids, then of all ids in order: no object for each word.
        known = np.array(sorted(of), np.int64)
        every = np.frombuffer(b"".join(map(of.__getitem__, known.tolist())), np.uint8)
        lengths = np.fromiter((len(of[i]) for i in known.tolist()), np.int64, len(known))
        which = np.searchsorted(known, self.flat)
        sizes = lengths[which]
        self.spelled = np.frombuffer(_joined(every, (np.cumsum(lengths) - lengths)[which], sizes), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])[self.offsets]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and what their words stand for, to documents."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield from _documents(batch, row)


def _documents(batch: pa.RecordBatch, row: int) -> Iterator[pa.RecordBatch]:
    """The documents of one block; what it needs goes when it is done."""
    ids, counts = (batch.column(i)[row].values for i in (0, 1))
    packed = zstandard.ZstdDecompressor().decompress(batch.column(2)[row].as_buffer())
    planes = np.frombuffer(packed, np.uint8).reshape(4, len(packed) // 4)
    refs = planes[3].astype(np.uint32)
    for plane in planes[2::-1]:
        refs <<= 8
        refs |= plane
    del packed, planes
    coded = _Coded(batch.column(3)[row].values, int(refs.max()) + 1) if len(refs) else None
    ends = np.cumsum(counts.to_numpy())
    # A few documents at a time: what they give stays small beside the block.
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + (1 << 17), side="right")))
        here = refs[start : int(ends[to - 1])]
        cuts = np.concatenate([[0], ends[at:to] - start])
        if len(here):
            places, before = _runs(coded.offsets[here], coded.sizes[here])
            got = coded.flat[places]
            sizes = coded.ends[here + 1] - coded.ends[here]
            text = _joined(coded.spelled, coded.ends[here], sizes)
            letters = np.concatenate([[0], np.cumsum(sizes)])[cuts].tolist()
        else:
            before, got, text, letters = np.zeros(1, np.int64), np.zeros(0, np.int32), b"", [0] * len(cuts)
        lists = pa.ListArray.from_arrays(pa.array(before[cuts].astype(np.int32)), pa.array(got.astype(np.int32)))
        texts = pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(letters[:-1], letters[1:])])
        yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), lists, texts], names=["doc_id", "ids", "decoded"])
        at = to


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK) -> DataFrame:
    """One row (doc_id, ids, decoded) for each row of `df`: the ids of its whole text as the tokenizers library gives them for the file `path`, and their text.

    Spark's tasks split texts into blocks: distinct words, and their places in the documents. The blocks' words are shuffled once, each distinct word is
    encoded once (`encode_words`) and decoded by a join of ids with pieces (`with_pieces`), and both join their blocks, which gather their documents by
    place. Blocks are a table bucketed by block, so that places, nearly as large as the texts, are written once and never shuffled. Decoded text
    has U+FFFD for bytes that aren't UTF-8. Truncation and padding of the file aren't used. Special strings inside texts are their special ids, as the
    library does. Null and empty texts have no ids and an empty text; texts of any length are taken whole (a document is never cut over blocks); repeated rows
    give a row each; a null id stays null; an empty table gives an empty one. Other columns of `df`, whatever their names, are left out.
    The stored blocks stay in the shared folder, since the result reads them.
    """
    spark = df.sparkSession
    few = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split_documents(few, path, block_words).write.bucketBy(parts, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    each = blocks.select("block", F.explode(F.arrays_zip("words", "ats")).alias("w"))
    coded = encode_words(each.select("block", F.col("w.ats").alias("at"), F.col("w.words").alias("word")), path)
    packs = with_pieces(coded, path).mapInArrow(_pack, "block long, pack binary").groupBy("block").agg(F.collect_list("pack").alias("packs"))
    return blocks.select("block", "ids", "counts", "refs").join(packs.hint("shuffle_hash"), "block", "left").select("ids", "counts", "refs", "packs").mapInArrow(_gather, "doc_id long, ids array<int>, decoded string")
