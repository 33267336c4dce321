"""Vector bin packing of examples into sequences."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


class Piece:
    """A run of one example's tokens: its key, where it starts there, its ids, and which of them bear loss (None: all)."""

    __slots__ = ("key", "total", "start", "ids", "loss")

    def __init__(self, key, total: int, start: int, ids: np.ndarray, loss: np.ndarray | None = None):
        self.key, self.total, self.start, self.ids, self.loss = key, total, start, ids, loss

    def bearing(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, at: int) -> tuple[Piece, Piece]:
        loss = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Piece(self.key, self.total, self.start, self.ids[:at], loss[0]), Piece(self.key, self.total, self.start + at, self.ids[at:], loss[1])


class Packer:
    """Places pieces, as they come, into at most `open_bins` open bins under limits on tokens, segments and loss-bearing tokens.

    A piece goes to the open bin where the dot product of its demand and the bin's free room, each dimension as a
    share of its limit, is largest among the bins that hold it whole. If none does, a new bin opens; if as many
    are open as may be, the piece is cut to fill the bin of the largest dot product, which closes, and its rest
    is placed again. A bin that its segments or loss-bearing tokens keep from filling up gives out a sequence of
    its first tokens whose number is a power of two, which needs no padding, and keeps the rest. So do all bins at the end.
    """

    def __init__(self, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, open_bins: int = 24):
        self.limits = np.array([max_tokens, max_segments, max_loss or max_tokens], float)
        self.room = np.zeros((open_bins, 3))
        self.bins: list[list[Piece] | None] = [None] * open_bins

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Yields the bins that close."""
        tokens, loss_limit = int(self.limits[0]), int(self.limits[2])
        while True:
            n, bearing = len(piece.ids), piece.bearing()
            if n >= tokens or bearing > loss_limit:
                at = min(n, tokens)
                if bearing > loss_limit:
                    at = min(at, loss_limit if piece.loss is None else int(np.searchsorted(np.cumsum(piece.loss), loss_limit, side="right")))
                head, piece = piece.cut(_goal(at, tokens))
                yield [head]
                if not len(piece.ids):
                    return
                continue
            demand = np.array([n, 1, bearing], float)
            open_ = np.array([b is not None for b in self.bins])
            fits = open_ & (self.room >= demand).all(axis=1)
            score = (self.room / self.limits) @ (demand / self.limits)
            if fits.any():
                i = int(np.where(fits, score, -1).argmax())
            elif not open_.all():
                i = int((~open_).argmax())
                self.bins[i], self.room[i] = [], self.limits
            else:
                can = (self.room[:, 1] >= 1) & (self.room[:, 0] <= n)
                i = int(np.where(can, score, -1).argmax()) if can.any() else int(self.room[:, 0].argmin())
                at = int(self.room[i, 0])
                if can.any() and piece.cut(at)[0].bearing() <= self.room[i, 2]:
                    head, piece = piece.cut(at)
                    yield [*self.bins[i], head]
                    self.bins[i], self.room[i] = None, 0
                    if not len(piece.ids):
                        return
                else:
                    yield self._part(i)
                continue
            self.bins[i].append(piece)
            self.room[i] -= demand
            if self.room[i, 0] == 0:
                yield self.bins[i]
                self.bins[i], self.room[i] = None, 0
            elif self.room[i, 1] == 0:
                yield self._part(i)
            return

    def _part(self, i: int) -> list[Piece]:
        """The first tokens of bin i, as many as the largest power of two that it holds; the rest stays in it."""
        out, rest = _first(self.bins[i], _goal(sum(len(p.ids) for p in self.bins[i]), int(self.limits[0])))
        self.bins[i] = rest or None
        self.room[i] = self.limits - [sum(len(p.ids) for p in rest), len(rest), sum(p.bearing() for p in rest)] if rest else 0
        return out

    def finish(self) -> Iterator[list[Piece]]:
        """Pours what is open into one bin after the other."""
        rest = [p for b in self.bins if b for p in b][::-1]
        self.bins = [None] * len(self.bins)
        now: list[Piece] = []
        while rest or now:
            room = self.limits - [sum(len(p.ids) for p in now), len(now), sum(p.bearing() for p in now)]
            while rest and (room[:2] >= 1).all():
                piece = rest.pop()
                head, after = piece.cut(min(len(piece.ids), int(room[0])))
                if head.bearing() > room[2]:
                    rest.append(piece)
                    break
                now.append(head)
                room -= [len(head.ids), 1, head.bearing()]
                if len(after.ids):
                    rest.append(after)
            out, now = _first(now, _goal(sum(len(p.ids) for p in now), int(self.limits[0])))
            yield out


def _first(pieces: list[Piece], goal: int) -> tuple[list[Piece], list[Piece]]:
    """The first `goal` tokens of some pieces, and the rest."""
    out: list[Piece] = []
    for i, p in enumerate(pieces):
        if goal < len(p.ids):
            head, after = p.cut(goal)
            return [*out, *([head] if goal else [])], [after, *pieces[i + 1 :]]
        out.append(p)
        goal -= len(p.ids)
    return out, []


def _goal(left: int, most: int) -> int:
    """The largest power of two that `left` tokens fill, or `most`."""
    return most if left >= most else 1 << max(left.bit_length() - 1, 0)


@lru_cache(maxsize=1)
def _encoder(path: str):
    """Encoder of a byte-level BPE file: tiktoken's merges over the file's own vocabulary, whose ids are the ranks.

    The tokenizers library itself gives the same ids at a sixth of the speed; files that aren't of this kind
    fall back to it.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merges = [("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None and [vocab[m] for m in merges] == list(range(256, 256 + len(merges))):
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(spelled[c] for c in t): i for t, i in vocab.items() if t not in added}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: enc.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)


def pack_documents(df: DataFrame, path: str, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, end_id: int = 1, open_bins: int = 24, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None) -> DataFrame:
    """Tokenises texts and packs them, each task its own partition in one pass, without a shuffle.

    Returns one row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, n_loss (loss-bearing
    tokens), ids (binary, little-endian unsigned 32-bit). A document is its ids and then `end_id`; it may be cut
    anywhere. With `loss_from_col`, an integer column, only tokens from that number on bear loss, as the answers
    of instruction data do; else all do. A sequence holds at most `max_tokens`, `max_segments` pieces and
    `max_loss` loss-bearing tokens. Memory is bounded by the open bins and one document. Null and empty texts are
    a lone `end_id`; repeated rows are packed each; a null id stays null; an empty table gives an empty one; other
    columns are left out, whatever their names.
    """
    few = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(loss_from_col).cast("long") if loss_from_col else F.lit(None).cast("long")).alias("loss_from"))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "n_loss", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(path), Packer(max_tokens, max_segments, max_loss, open_bins)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def close(bins: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for b in bins:
                offset = 0
                for p in b:
                    rows.append((p.key, p.start, len(p.ids), p.total, sequence, offset, p.bearing(), p.ids.astype("<u4").tobytes()))
                    offset += len(p.ids)
                sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 7 else pa.binary()) for i in range(8)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for key, text, loss_from in zip(*(part.column(i).to_pylist() for i in range(3))):
                    ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype(np.uint32)
                    loss = None if loss_from is None else np.arange(len(ids)) >= loss_from
                    close(packer.add(Piece(key, len(ids), 0, ids, loss)))
                if len(rows) >= 500:
                    yield flush()
        close(packer.finish())
        yield flush()

    return few.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, n_loss long, ids binary")
