import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hueframe.llm import chat, packing, queries, token_counts

from .helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.TokenCounter(PATH)
ENCODE = packing._encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.sampled_from(["", "<|endoftext|>", "  \n\t ", "'ll don't"]))
def test_counts_and_ids_are_the_librarys(text, more):
    text = text + more + text
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert COUNTER.count(text) == len(ids)
    assert list(ENCODE(text)) == ids


def test_counts_over_awkward_rows(spark):
    df = awkward(spark)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, PATH).collect())
    want = []
    for r in df.collect():
        n = len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0


def _check_pieces(rows, texts, limit=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for key, ids in texts.items():
        pieces = sorted(by_doc[key], key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == list(np.cumsum([0] + [p["length"] for p in pieces])[:-1])
        assert np.array_equal(np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]), ids)
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == list(np.cumsum([0] + [p["length"] for p in pieces])[:-1])
        total = sum(p["length"] for p in pieces)
        assert 1 <= total <= limit and len(pieces) <= 512
        padding += limit - total if total & (total - 1) else 0
    return padding


def test_packing_keeps_every_id_once(spark):
    df = awkward(spark, repeat=False).where("doc_id IS NOT NULL")
    rows = packing.pack_documents(df.coalesce(2), PATH).collect()
    texts = {r["doc_id"]: np.array(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in df.collect()}
    padding = _check_pieces(rows, texts)
    assert padding < 0.02 * sum(map(len, texts.values()))
    assert packing.pack_documents(empty(spark), PATH).count() == 0
    assert packing.pack_documents(awkward(spark), PATH).where("doc_id = 3").selectExpr("sum(length) = 3 * max(doc_tokens) AS ok").first()["ok"]


def test_packing_limits_hold_together():
    rng = random.Random(3)
    packer = packing.Packer(max_tokens=64, max_segments=5, max_loss=20, open_bins=4)
    bins, sent = [], 0
    for i in range(400):
        n = rng.randint(1, 90)
        sent += n
        ids, loss = np.arange(n, dtype=np.uint32), np.arange(n) >= rng.randint(0, n)
        bins += packer.add(packing.Piece(i, n, 0, ids, loss))
    bins += packer.finish()
    assert sum(len(p.ids) for b in bins for p in b) == sent
    for b in bins:
        assert b and sum(len(p.ids) for p in b) <= 64 and len(b) <= 5 and sum(p.bearing() for p in b) <= 20
    seen = sorted((p.key, p.start, len(p.ids)) for b in bins for p in b)
    for (k, s, n), (k2, s2, _) in zip(seen, seen[1:]):
        assert k != k2 or s + n == s2


def test_many_tiny_documents_meet_the_segment_limit():
    packer, bins = packing.Packer(2048, 512), []
    for i in range(5000):
        bins += packer.add(packing.Piece(i, 1, 0, np.ones(1, np.uint32)))
    bins += packer.finish()
    assert sum(len(b) for b in bins) == 5000 and max(map(len, bins)) <= 512


@pytest.mark.parametrize("sizes, options", [((1, 1), {}), ((1, 3), {}), ((1, 40), {"max_segments": 7}), ((1, 900), {"max_loss": 1024}), ((1, 900), {"max_loss": 300, "loss": True})])
def test_little_padding_whatever_limit_binds(sizes, options):
    """Many tiny pieces, few segments, or few loss-bearing tokens: under 5 % of all tokens are padding."""
    rng, loss = random.Random(6), options.pop("loss", False) if (options := dict(options)) else False
    packer = packing.Packer(2048, options.get("max_segments", 512), options.get("max_loss"))
    bins, sent = [], 0
    for i in range(20_000 if sizes[1] < 10 else 3000):
        n = rng.randint(*sizes)
        sent += n
        bins += packer.add(packing.Piece(i, n, 0, np.arange(n, dtype=np.uint32), np.arange(n) >= n * 0.7 if loss else None))
    bins += packer.finish()
    sizes = [sum(len(p.ids) for p in b) for b in bins]
    assert sum(sizes) == sent and max(len(b) for b in bins) <= options.get("max_segments", 512)
    assert max(sum(p.bearing() for p in b) for b in bins) <= options.get("max_loss", 2048)
    assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.05 * sent


HARD = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool\nx", "a\\n", "", "[INST]"]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", " ", "<|endoftext|>", "|", "é", "\U0001f600"]), max_size=8).map("".join)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(HARD)
def test_templates_read_back_and_masks_hold_assistant_text(turns):
    formatted, spans = chat.render(turns)
    assert chat.read_turns(formatted) == turns
    enc = chat._tokenizer(PATH).encode(formatted, add_special_tokens=False)
    offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
    runs = chat.masked_runs(offsets, chat.mask_tokens(offsets, spans))
    assert [chat.unescape(formatted[a:b]) for a, b in runs] == [t for r, t in turns if r == "assistant" and t]


def test_conversations(spark):
    rows = [(1, 2, "assistant", "</s>ok", 9), (1, 1, "user", "hi [INST]", 9), (1, 2, "assistant", "</s>ok", 9), (2, 0, None, None, 9), (2, None, "assistant", "", 9), (None, 1, "assistant", "lost", 9), (3, 1, "assistant", "x" * 200_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c int")
    out = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df, PATH)).collect()}
    assert set(out) == {1, 2, 3, None}
    want = "user\nhi [INST]\nassistant\n</s>ok\nassistant\n</s>ok\n"
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert out[1]["loss_sha256"] == hashlib.sha256(b"</s>ok</s>ok").hexdigest() and out[1]["loss_chars"] == 12
    assert out[2]["loss_chars"] == 0 and out[2]["turns_sha256"] == hashlib.sha256(b"assistant\n\n\n\n").hexdigest()
    assert out[3]["loss_chars"] == 200_000 and out[None]["loss_chars"] == 4
    assert chat.conversation_digests(chat.format_conversations(df.limit(0), PATH)).count() == 0


def test_whole_tables(spark, sf):
    docs = queries.table(spark, sf, "documents").collect()
    texts = {r["doc_id"]: np.array(LIBRARY.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in docs}
    for r in queries.op6_packing(spark, sf).collect():
        assert r["ids_crc32"] == zlib.crc32(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert all(r["n_tokens"] == len(texts[r["doc_id"]]) - 1 for r in queries.op8_token_counts(spark, sf).collect())
    out = {r["conv_id"]: r for r in queries.op7_chat_format(spark, sf).collect()}
    turns = {}
    for r in queries.table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert out.keys() == turns.keys()
    for k, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert out[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert out[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[k]["loss_chars"] == len(loss)


@pytest.mark.parametrize("symbols,merges,left", [([], {}, 0), ([1], {}, 1), ([1, 1, 1], {(1, 1): (0, 2), (2, 1): (1, 3)}, 1), ([1, 1, 1, 1, 1], {(1, 1): (0, 2)}, 3)])
def test_ties_merge_from_the_left(symbols, merges, left):
    assert token_counts.merged_length(symbols, merges) == left
