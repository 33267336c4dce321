"""Operators 11 to 13: byte-pair round trip, spelling variants, periodic runs."""

import hashlib
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from hueframe.llm import bpe, periodic_runs, queries, spelling

from .helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def key(r):
    return tuple((v is None, str(v)) for v in r)


def like_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    got = sorted((tuple(r) for r in got.select(names).collect()), key=key)
    assert got == sorted(cursor.fetchall(), key=key) and got


# ---- byte-pair encoding and decoding


def encoded(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_bpe_query_is_the_library(spark, sf):
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, g = encoded(r["text"]), got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_awkward_rows(spark):
    df = awkward(spark)
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.encode_documents(df, PATH, block_words=300).collect()), key=key)
    want = sorted(((r["doc_id"], encoded(r["text"]), r["text"] or "") for r in df.collect()), key=key)
    assert got == want
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, bpe.encode_documents(blank, PATH).collect()), key=key) == [(1, [], ""), (2, [], ""), (None, [], "")]


def test_bpe_random_unicode(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xE9, 0x301, 0x660, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600]] + ["<|endoftext|>", "  ", "'s", "'ll"] * 4
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))) for i in range(1500)] + [(5000, "a" * 200_000), (5001, " " * 5000 + "x"), (5002, "<|endoftext|>" * 3)]
    got = {r["doc_id"]: r for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, block_words=4000).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i]["ids"] == encoded(text) and got[i]["decoded"] == text
    ids = [(i, encoded(text)) for i, text in rows] + [(6000, None), (6001, [50256, 99_999, 195, 5])]
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(spark.createDataFrame(ids, "doc_id long, ids array<int>"), PATH).collect()}
    assert all(back[i] == LIBRARY.decode(x or [], skip_special_tokens=False) for i, x in ids)


def test_bpe_wants_byte_level_files(spark):
    with pytest.raises(ValueError):
        bpe.id_pieces(spark, public_tokenizers.path("word_bpe_49k.json"))


# ---- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, min_length, min_count, ratio):
    n = {w: k for w, k in Counter(w for w in words if w and len(w) >= min_length).items() if k >= min_count}
    others = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in others.items() if vs}
    form = {w: best[w] if w in best and n[best[w]] >= ratio * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=key)


def occurrences(rng):
    words = ["".join(rng.choice("aabé\U0001f600") for _ in range(rng.randint(3, 6))) for _ in range(150)]
    words += ["x" * 300 + "y" * 5, "x" * 300 + "y" * 4, "x" * 299 + "yy" + "y" * 4, "x" * 300 + "yyzyy", "q" * 63, "q" * 64, "q" * 65, "q" * 66]
    chain = [("aaaaaaa", 1), ("aaaaaab", 3), ("aaaaabb", 9), ("aaaabbb", 27), ("aaabbbb", 81), ("aabbbbb", 243)]
    rows = [w for w in words for _ in range(rng.choice([1, 1, 2, 3, 7, 20]))] + [w for w, k in chain for _ in range(k)]
    rng.shuffle(rows)
    return [*rows, None, None, ""]


@pytest.mark.parametrize("most", [64 << 20, 1])
@pytest.mark.parametrize("bits", [16, 1])
def test_variants_are_brute_forces(spark, most, bits):
    """With filters of any size and in any number of waves."""
    rows = occurrences(random.Random(11))
    df = spark.createDataFrame([(w, "z", 7) for w in rows], "word string, near string, n int")
    for min_length, min_count, ratio in ((3, 1, 3), (5, 2, 10)):
        got = spelling.spelling_variants(df, min_length=min_length, min_count=min_count, ratio=ratio, bits=bits, most=most)
        assert sorted(map(tuple, got.collect()), key=key) == brute_variants(rows, min_length, min_count, ratio)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(None,), ("short",)], "word string")).count() == 0
    assert queries.mistyped(empty(spark)).count() == 0


def test_waves_hold_every_block_once():
    counts = {7: 500_000, 8: 3, 64: 200_000}
    for most in (1, 100_000, 1 << 18, 1 << 30):
        seen = Counter()
        for wave in spelling.waves(counts, 16, most):
            size = 0
            for shard, blocks, first, end in wave:
                assert blocks == spelling.blocks_of(counts[shard], 16)
                seen.update((shard, b) for b in range(first, end))
                size += -(-(end - first) // spelling.CHUNK) * spelling.CHUNK * spelling.LANES * 4
            assert size <= max(most, 1 << 16)
        assert set(seen.values()) == {1} and len(seen) == sum(spelling.blocks_of(n, 16) for n in counts.values())


def test_spelling_query_is_its_sql(spark, sf):
    like_sql(spark, sf, "op12_spelling_variants")


def test_mistyped_awkward_rows(spark):
    import re
    import zlib

    df, want = awkward(spark), []
    for r in df.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            low = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{low}".encode())
            want.append(low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low)
    got = [r["word"] for r in queries.mistyped(df).collect()]
    assert Counter(w for w in got if len(w) >= 7) == Counter(w for w in want if len(w) >= 7)


# ---- periodic runs


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(w, least, copies):
    out = []
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            part = w[s : s + n]
            if i > s and n >= max(least, copies * q) and not any(all(part[k] == part[k + d] for k in range(n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(n):
    rng = random.Random(1)
    for _ in range(n):
        size, kinds = rng.randint(1, 70), rng.choice([1, 2, 2, 3, 8])
        w = [rng.randrange(kinds) for _ in range(size)]
        if rng.random() < 0.6:
            a = rng.randrange(size)
            p = 1 + rng.randrange((size - a) // 3 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(size)]
        yield w


def test_lyndon_lengths_and_runs_are_brute_forces():
    for w in sequences(1500):
        ranks = np.unique(w, return_inverse=True)[1]
        assert periodic_runs.lyndon_lengths(ranks).tolist() == brute_lyndon(ranks.tolist())
        for least, copies in ((24, 3), (3, 3), (6, 4), (1, 3)):
            assert periodic_runs.find_runs(np.array(w), least, copies) == brute_runs(w, least, copies)
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.array([1, 1]), 4, 2)


def test_periodic_runs_rows(spark):
    texts = [(i, " \n\t".join(f"w{x}" for x in w)) for i, w in enumerate(sequences(120))] + [(500, None), (501, ""), (502, " \n"), (None, "a " * 30), (503, "a b " * 20_000), (503, "a b " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, start int, runs string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect()), key=key)
    want = []
    for i, t in texts:
        w = (t or "").split()
        runs = brute_runs(w, 24, 3) if len(w) < 1000 else [(0, len(w), 2)]
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, runs, " ".join(x for k, x in enumerate(w) if k not in drop)))
    assert got == sorted(want, key=key)
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_periodic_query_is_its_sql(spark, sf):
    like_sql(spark, sf, "op13_periodic_runs")


def test_looped_awkward_rows(spark):
    import zlib

    df = awkward(spark)
    for r, got in zip(df.collect(), queries.looped(df).collect()):
        w, i = (r["text"] or "").split(), r["doc_id"]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got["text"].split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        else:
            assert got["text"] == r["text"]


def test_bpe_gathers_in_little_memory():
    """A block's words are held in arrays: 200,000 of them, in a text of as many, take no object each."""
    n = 200_000
    given = pa.RecordBatch.from_arrays([pa.array(np.full(n, 5)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32) % 50_000), pa.array([b"%05d" % (i % 50_000) for i in range(n)])], names=["block", "at", "nth", "id", "piece"])
    packs = [p for b in bpe._pack(iter([given])) for p in b.column(1).to_pylist()]
    refs = zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(np.arange(n, dtype=np.uint32).view(np.uint8).reshape(n, 4).T).tobytes())
    row = pa.RecordBatch.from_arrays([pa.array([[1]], pa.list_(pa.int64())), pa.array([[n]], pa.list_(pa.int64())), pa.array([refs]), pa.array([packs], pa.list_(pa.binary()))], names=["ids", "counts", "refs", "packs"])
    tracemalloc.start()
    try:
        texts = [b.column(2).to_pylist() for b in bpe._gather(iter([row]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts == [["".join("%05d" % (i % 50_000) for i in range(n))]]
    assert peak < 145 * n, peak
