"""Chat formatting with loss masks aligned by offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mark turns. A text's own ones get a backslash after their first character, one more than they have.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_REST})")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted code-point spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = ("<s>", escape(text), "</s>") if role == "assistant" else (f"[INST]{_role_out(role)}\n", escape(text), "[/INST]")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [("assistant", unescape(m[1])) if m[1] is not None else (_role_in(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that meet a span; both sorted, so that two binary searches find each span's tokens."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        firsts = np.searchsorted(offsets[:, 1], [s for s, _ in spans], side="right")
        lasts = np.searchsorted(offsets[:, 0], [e for _, e in spans], side="left")
        for a, b, (s, e) in zip(firsts, lasts, spans):
            if s < e:
                mask[a:b] = True
    return mask


def masked_runs(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code-point runs under the mask, one for each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in zip(edge[::2], edge[1::2])]


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The file's tokenizer with the marks as special tokens and offsets that keep white space.

    Special tokens are split off before anything else, so that no token reaches across the edge of a turn.
    """
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    if isinstance(tok.pre_tokenizer, pre_tokenizers.ByteLevel):
        tok.pre_tokenizer.trim_offsets = False
    return tok


def format_conversations(df: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, n_turns, input_ids (array), loss_mask (array of 0/1), loss_spans (array of code-point runs under the mask).

    Rows are dealt by conversation and sorted by turn (null first; ties by role, then text, so that reruns
    agree); a task then holds one conversation at a time, the one value its output row must hold anyway. Null
    texts and roles count as empty; a null conv_id is one conversation of its own; repeated rows are turns of
    their own; an empty table gives an empty one; other columns are left out, whatever their names.
    """
    few = df.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    few = few.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["conv_id", "formatted", "n_turns", "input_ids", "loss_mask", "loss_spans"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), spans_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, rows = _tokenizer(path), []
        started, now, turns = False, None, []

        def done() -> None:
            formatted, spans = render(turns)
            enc = tok.encode(formatted, add_special_tokens=False)
            offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
            mask = mask_tokens(offsets, spans)
            rows.append((now, formatted, len(turns), enc.ids, mask.astype(np.int8), [{"start": a, "end": b} for a, b in masked_runs(offsets, mask)]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if started and conv != now:
                    done()
                    turns = []
                started, now = True, conv
                turns.append((role, text))
                if len(rows) >= 200:
                    yield flush()
        if started:
            done()
        yield flush()

    return few.mapInArrow(run, "conv_id long, formatted string, n_turns long, input_ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<start: long, end: long>>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What `format_conversations` made, read back: turns from the template, loss text from the mask's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
