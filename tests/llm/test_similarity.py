import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hueframe.llm import components, near_duplicates as nd, nearest, queries

from .helpers import awkward, empty, prose


def brute_force(rows):
    """Component of each id by looking at every pair that shares a shingle."""
    sets = {i: nd.shingle_set(t) for i, t in rows if i is not None}
    inverted = {}
    for i, s in sets.items():
        for g in s:
            inverted.setdefault(g, []).append(i)
    shared = Counter((b, a) if b < a else (a, b) for ids in inverted.values() for x, a in enumerate(ids) for b in ids[:x])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df, **options).collect()
    want, sizes = brute_force(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_chains_and_shared_passages(spark):
    """Copies, near copies at all distances, chains of them, and a passage that many documents share."""
    rng = random.Random(11)
    passage = prose(rng, 80)
    rows, i = [], 0
    for g in range(12):
        text = prose(rng, rng.choice([6, 40, 150, 300]))
        for k in range(rng.choice([2, 5, 9])):
            rows.append((i, text))
            text = changed(rng, text, rng.choice([0, 1, 1, 2, 4])) if len(text.split()) > 20 else text
            i += 1
    for _ in range(120):
        rows.append((i, prose(rng, 60) + " " + passage + " " + prose(rng, 20)))
        i += 1
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, small=3, depth=4, block_rows=8)


def test_blocks_give_all_pairs_once():
    """Every pair of rows of different components that a node holds is tried, whatever the blocks, and from one node alone."""
    rng = np.random.default_rng(1)
    rows = [{"node": g, "ob": 0, "ab": 0, "role": 0, "component": int(rng.integers(3)), "largest": 0, "branch": 0, "mask": 1, "tokens": [0], "doc_id": 10 * g + i, "n_shingles": 5, **{c: 0 for c in nd.SKETCH}} for g in range(40) for i in range(int(rng.integers(2, 9)))]
    import pyarrow as pa

    whole = pa.Table.from_pylist(rows)
    want = {(min(a["doc_id"], b["doc_id"]), max(a["doc_id"], b["doc_id"])) for a in rows for b in rows if a["node"] == b["node"] and a["component"] != b["component"]}
    for size in (1, 3, 7, 500):
        got = []
        for table, edges in nd.whole_groups(whole.to_batches(max_chunksize=size), nd.BLOCK):
            for i, j in nd.candidates(table, edges, 85):
                ids = table["doc_id"].to_numpy()
                got += [(min(x), max(x)) for x in zip(ids[i].tolist(), ids[j].tolist())]
        assert sorted(got) == sorted(want)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    text = prose(rng, 200)
    check(spark, [(i, changed(rng, text, 2)) for i in range(150)] + [(1000 + i, prose(rng, 120)) for i in range(30)])


def test_threshold_is_exact(spark):
    """17 of 20 shingles is a link, 16 of 20 none."""
    words = [f"a{i}" for i in range(22)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[:-1] + ["zz"])), (4, " ".join(words[2:])), (5, " ".join(words[4:]))]
    check(spark, rows)


def pairs_between(rng, low, high, n, size=600):
    """n pairs of long texts without common words between pairs, each of a similarity from `low` to `high`."""
    rows = []
    for g in range(n):
        common = round(size * rng.uniform(low, high))
        own = (size - common) // 2
        words = lambda tag, m: [f"{tag}{g}x{i}" for i in range(m)]  # noqa: B023,E731
        shared = words("s", common + 4)
        rows += [(2 * g, " ".join(shared + words("a", own))), (2 * g + 1, " ".join(shared + words("b", own)))]
    return rows


def test_sketch_bound_follows_the_threshold(spark):
    """Pairs from 0.80 to 0.85 are linked at 80 and not at 85, by brute force over each pair; likewise from 0.70 at 70."""
    for percent, high, linked_at_85 in ((80, 0.81, 0), (80, 0.849, 0), (70, 0.71, 0)):
        rows = pairs_between(random.Random(percent), percent / 100, high, 200)
        sets = {i: nd.shingle_set(t) for i, t in rows}
        want = {i: i - i % 2 if 100 * len(sets[i] & sets[i ^ 1]) >= percent * len(sets[i] | sets[i ^ 1]) else i for i, _ in rows}
        assert sum(i != c for i, c in want.items()) >= 150
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df, percent=percent).collect()} == want
    assert nd.near_duplicates(df).where("NOT kept").count() == linked_at_85
    assert nd.max_different(85) == 91


def test_pipeline_stage_drops_from_080(spark, sf):
    import corpus_pipeline

    rows = pairs_between(random.Random(1), 0.805, 0.845, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_copies(spark, df, sf).collect()) == list(range(0, 40, 2))


def test_awkward_rows(spark):
    rows = nd.near_duplicates(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert len(by[3]) == 3 and all(r["kept"] for r in by[3])
    for i in (40, 41, 42):
        assert by[i][0]["n_shingles"] == 0 and by[i][0]["component_id"] == i and by[i][0]["kept"]
    assert by[43][0]["n_shingles"] > 1000
    assert nd.near_duplicates(empty(spark)).count() == 0
    kept = nd.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id IS NULL").count() == 1
    assert nd.keep_first(empty(spark)).count() == 0


def test_lower_case_is_ascii_only():
    assert nd.shingle_set("ÉA b c d e") == {("Éa".encode(), b"b", b"c", b"d", b"e")}
    assert nd.shingle_set("a b c") == {("a b".encode(), b"c")}
    assert len(nd.shingle_hashes("A b C d e F")) == 2 and (nd.shingle_hashes("A B") == nd.shingle_hashes("a b")).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 80)] + [(5, 5), (None, 4)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    want, sizes = brute_force(rows)
    got = queries.op4_near_duplicates(spark, sf).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (c, sizes[i]) for i, c in want.items()}


def exact(rows, q, k=10):
    v = {i: np.array(x, float) for i, x in rows}
    near = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in v if i != q)
    return near[:k]


def test_recall_of_neighbours(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, sf, "embeddings").collect()]
    got = {}
    for r in queries.op9_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(r)
    asked = [i for i, _ in rows if i % 100 == 0]
    assert sorted(got) == sorted(asked)
    hits = total = 0
    for q in asked:
        mine = sorted(got[q], key=lambda r: r["rank"])
        want = exact(rows, q)
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        truth = dict(rows)
        for r in mine:
            assert r["score"] == pytest.approx(np.sqrt(((np.array(truth[r["vec_id"]], float) - np.array(truth[q], float)) ** 2).sum()), rel=1e-12)
        hits += len({r["vec_id"] for r in mine} & {i for _, i in want})
        total += len(want)
    assert hits / total >= 0.9


def test_neighbours_over_many_lists(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = nearest.nearest_neighbours(df, F.col("vec_id") % 100 == 0, rows_a_block=500, queries_a_block=10).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(found[q] & {i for _, i in exact(rows, q)}) / 10 for q in range(0, 3000, 100)]
    assert np.mean(hits) >= 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (100, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, list int, code string")
    got = [tuple(r) for r in nearest.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    far = float(np.sqrt(5.0))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, far), (100, 1, 0, far), (100, 2, 1, far), (100, 3, 2, far)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<float>")
    got = nearest.nearest_neighbours(same, F.col("vec_id") % 100 == 0).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 11))
    assert nearest.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    alone = nearest.nearest_neighbours(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0)
    assert alone.count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_repeated_rows_take_no_places(spark, same):
    """Rows repeated 3, 25 and 300 times, exactly or as slightly other vectors of one id, hide no other neighbour."""
    rng = np.random.default_rng(3)
    base = {i: rng.normal(size=8) for i in range(60)}
    order = [i for _, i in exact(list(base.items()), 0, 59)]
    times = {i: 3 for i in base} | {order[0]: 25, order[1]: 300}
    rows = [(i, [float(x) for x in v + (0 if same or not i else rng.normal(size=8) * 1e-3)]) for i, v in base.items() for _ in range(times[i])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.array(base[0])
    best = {}
    for i, v in rows:
        best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(v) - q) ** 2).sum())))
    want = sorted((d, i) for i, d in best.items() if i)[:10]
    for lists in (1, 4):
        got = nearest.nearest_neighbours(df, F.col("vec_id") == 0, lists=lists, probe_share=1.0, shortlist=59).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [i for _, i in want] and np.allclose([r["score"] for r in got], [d for d, _ in want])


@pytest.mark.parametrize("shape", ["plain", "ball", "scales", "far", "copies"])
def test_no_neighbour_is_missed(spark, shape):
    """Unstructured vectors, a tight group that codes can't tell apart, very different scales, vectors far from zero, and copies."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 24))
    if shape == "ball":
        x = np.where(rng.random((4000, 1)) < 0.4, 1 + 1e-3 * x, 100 * x)
    elif shape == "scales":
        x *= 10.0 ** rng.uniform(-4, 4, size=(4000, 1))
    elif shape == "far":
        x = 1e6 + 1e-2 * x
    elif shape == "copies":
        x[rng.random(4000) < 0.5] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest_neighbours(df, F.col("vec_id") % 100 == 0, sample=600).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert len(got) == 40
    for q, mine in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(4000), d)) if i != q][:10]
        assert [mine[n + 1] for n in range(10)] == [(i, pytest.approx(d[i], rel=1e-12)) for i in want]
