"""Near duplicates by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join, slices, stored, words
from .components import connected_components

TOKENS = 512  # minwise tokens of a document, and two bits of each in its sketch
SKETCH = [f"s{i}" for i in range(16)]
#: The lower bit of each token in a long of the sketch, as a signed number.
LOW_BITS = 0x5555555555555555
#: Ids that are broadcast at most, eight bytes each.
BROADCAST_IDS = 200_000
#: Rows of a block on either side of a comparison, and shingles of their sets, in the mean.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 22
#: Pairs whose sketches a task holds at once.
PAIRS_AT_ONCE = 200_000
BLOCK = ["node", "ob", "ab"]
_MASK = (1 << 64) - 1


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_240_501))
    return rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64)


_A, _B = _constants()


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the k-word shingles of a text whose A-Z are lower-cased; with fewer words, of the whole sequence."""
    ws = words(text.lower() if text and text.isascii() else _lower(text))
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64)
    n = max(len(h) - k + 1, 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _lower(text: str | None) -> str | None:
    """A-Z alone in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else text


def shingle_set(text: str | None, k: int = 5) -> set[tuple[bytes, ...]]:
    """The shingles themselves, to confirm links on."""
    ws = [w.lower() for w in words(text)]  # bytes.lower changes A-Z only
    return set(zip(*(ws[i:] for i in range(k)))) if len(ws) >= k else {tuple(ws)} if ws else set()


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of TOKENS functions, its high 32 bits."""
    low = np.full(TOKENS, _MASK, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512]
        np.minimum(low, (_A[:, None] * part + _B[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, k: int = 5, kept: int = 32) -> DataFrame:
    """(doc_id, n_shingles, digest of the shingle set, the first `kept` tokens, sketch) of every whole text."""
    names = ["doc_id", "n_shingles", "digest", "tokens", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024):
                sizes, digests, tokens = [], [], np.zeros((part.num_rows, TOKENS), np.uint32)
                for i, text in enumerate(part.column(1).to_pylist()):
                    h = shingle_hashes(text, k)
                    sizes.append(len(h))
                    digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    if len(h):
                        tokens[i] = minwise(h)
                bits = ((tokens * np.uint32(0x85EBCA6B)) >> np.uint32(30)).reshape(-1, TOKENS // 4, 4)
                packed = np.ascontiguousarray((bits << np.array([6, 4, 2, 0], np.uint32)).sum(axis=2).astype(np.uint8)).view(np.int64).reshape(-1, len(SKETCH))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(tokens[:, :kept]).view(np.int32).ravel()), kept).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(SKETCH)))], names=names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, tokens array<int>, " + ", ".join(f"{c} long" for c in SKETCH))


def max_different(percent: int) -> int:
    """Tokens whose bits may differ in the sketches of two sets of similarity `percent`: 4.7 deviations above the mean.

    A token differs with probability 1 - percent / 100, and its two bits show that in three cases of four. A pair at
    the threshold exceeds this with probability below 5e-6.
    """
    p = 0.75 * (1 - percent / 100)
    return math.floor(TOKENS * p + 4.7 * math.sqrt(TOKENS * p * (1 - p)))


def _close(left: str, right: str, percent: int) -> Column:
    """May two rows be linked: neither set is too large for the other, and the sketches are near."""
    n, m = F.col(f"{left}n_shingles"), F.col(f"{right}n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_different(left, right) <= max_different(percent))


def _different(left: str, right: str) -> Column:
    """Tokens whose two bits differ."""
    x = [F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}")) for s in SKETCH]
    counts = [F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(LOW_BITS))) for v in x]
    return sum(counts[1:], counts[0])


def central(nodes: DataFrame, light: list[str], total: int) -> DataFrame:
    """(node, n, f_...): of each node the row that is nearest to what most of its rows have, bit by bit.

    Near copies of one text differ from each other more than each from that text, which agrees with most of them
    everywhere. Bits are summed within tasks first, one of each token's for half the tokens.
    """
    half = SKETCH[: len(SKETCH) // 2]
    one = lambda s, j: F.sum(F.shiftright(F.col(s), 2 * j).bitwiseAND(F.lit(1)))
    sums = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *(one(s, j).alias(f"{s}_{j}") for s in half for j in range(32)))
    word = lambda s: F.array(*(F.when(F.col(f"{s}_{j}") * 2 > F.col("n"), 1 << 2 * j if j < 31 else 1 << 62).otherwise(0).cast("long") for j in range(32)))
    most = sums.select("node", "n", *(F.aggregate(word(s), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias(f"m_{s}") for s in half))
    off = [F.bit_count(F.col(s).bitwiseXOR(F.col(f"m_{s}")).bitwiseAND(F.lit(LOW_BITS))) for s in half]
    near = salted_join(nodes.drop("n"), most, "node", "doc_id", total, counts=nodes.select("node", "n").distinct()).groupBy("node").agg(F.min(F.struct(sum(off[1:], off[0]).alias("off"), "doc_id")).alias("m")).select("node", F.col("m.doc_id").alias("doc_id"))
    return nodes.join(near, ["node", "doc_id"]).groupBy("node").agg(F.max("n").alias("n"), *(F.min(c).alias(f"f_{c}") for c in light))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """The pairs (a, b), a stored table, whose full shingle sets are similar enough.

    Only texts of paired documents move: the ids are broadcast if there are few, and else joined by a shuffle. An
    id with very many partners is dealt over several tasks.
    """
    total = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(ids) if total * 2 <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).join(counts, "a")
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    ready = salted_join(left, right, "a", "b", total, counts=counts).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            a, b = [], []
            for part in slices(batch, 64):
                for x, y, tx, ty in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if (x, tx) != last:
                        last, mine = (x, tx), shingle_set(tx, k)
                    if similar(mine, shingle_set(ty, k), percent):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ready.mapInArrow(run, "a long, b long")


def similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of sorted rows, and the groups' first rows with the number of rows at the end."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        end = tuple(c[-1] for c in columns)
        at = batch.num_rows - int(np.argmin(np.append(np.logical_and.reduce([c == e for c, e in zip(columns, end)])[::-1], False)))
        if waiting and (at > 0 or end != last):
            yield _grouped([*waiting, batch.slice(0, at)], keys)
            waiting = []
        elif at > 0:
            yield _grouped([batch.slice(0, at)], keys)
        waiting.append(batch.slice(at))
        last = end
    if waiting:
        yield _grouped(waiting, keys)


def _grouped(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        c = table[k].to_numpy()
        new[1:-1] |= c[1:] != c[:-1]
    return table, np.flatnonzero(new)


def candidates(table: pa.Table, edges: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers (i, j) that may be linked, all of one i together: i stands outside its node's largest component, and j in another than i's.

    Each pair comes from the first node that both share and that is compared here; sizes and sketches are near.
    """
    get = lambda c: table[c].to_numpy()
    ids, sizes, part, largest, role, branch, mask = map(get, ("doc_id", "n_shingles", "component", "largest", "role", "branch", "mask"))
    sketch = np.stack([get(c) for c in SKETCH], axis=1).view(np.uint64)
    tokens = table["tokens"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    length = np.diff(edges)
    first = np.repeat(edges[:-1], length)
    split = np.repeat(np.maximum.reduceat(role, edges[:-1]) > 0, length)
    outs = np.flatnonzero(np.where(split, role == 1, part != largest))
    width = np.repeat(length, length)[outs]
    ends = np.cumsum(width)
    at, low, most = 0, np.uint64(LOW_BITS), max_different(percent)
    while at < len(outs):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        i = np.repeat(outs[at:upto], width[at:upto])
        j = first[i] + np.arange(len(i)) - np.repeat(ends[at:upto] - width[at:upto] - (ends[at - 1] if at else 0), width[at:upto])
        at = upto
        fine = (role[j] == 0) & (part[i] != part[j]) & ((part[j] == largest[j]) | (ids[i] < ids[j])) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        i, j = i[fine], j[fine]
        x = sketch[i] ^ sketch[j]
        near = np.bitwise_count((x | (x >> np.uint64(1))) & low).sum(axis=1) <= most
        i, j = i[near], j[near]
        before = np.zeros(len(i), bool)
        for b in range(tokens.shape[1] - 1):
            before |= (branch[i] > b) & ((mask[i] >> b) & 1 == 1) & (tokens[i, b] == tokens[j, b])
        yield i[~before], j[~before]


def active_rows(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of `blocks` that are in a pair of candidates; no pair leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, BLOCK):
            hit = np.zeros(table.num_rows, bool)
            for i, j in candidates(table, edges, percent):
                hit[i] = hit[j] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).to_batches()

    return blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, blocks.schema)


def block_links(active: DataFrame, docs: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """Links (a, b) that join components of each block: as few as join all that the block's links join.

    A row's set is compared with those of all its candidates whose component isn't joined with its own yet, by
    sorted shingle hashes; what is given out is confirmed on the shingles themselves. A task holds one block.
    """
    ids = active.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if active.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    rows = active.join(texts, "doc_id").select(*active.columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many, edges in whole_groups(batches, BLOCK):
            found: list[tuple[int, int]] = []
            for start, end in zip(edges, edges[1:]):
                found += joins(many.slice(start, end - start).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], names=["a", "b"])

    def joins(table: pa.Table) -> Iterator[tuple[int, int]]:
        ids, part = table["doc_id"].to_pylist(), table["component"].to_pylist()
        sets: dict[int, np.ndarray] = {}
        root = {p: p for p in part}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        def hashes(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_hashes(table["text"][i].as_py(), k)
            return sets[i]

        for rows, others in candidates(table, np.array([0, table.num_rows]), percent):
            for i in np.unique(rows).tolist():
                js = [j for j in others[rows == i].tolist() if top(part[j]) != top(part[i])]
                if not js:
                    continue
                mine, theirs = hashes(i), [hashes(j) for j in js]
                flat = np.concatenate(theirs)
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                sizes = np.array(list(map(len, theirs)))
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                for j in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)).tolist():
                    j = js[j]
                    if top(part[j]) != top(part[i]) and similar(shingle_set(table["text"][i].as_py(), k), shingle_set(table["text"][j].as_py(), k), percent):
                        root[top(part[j])] = top(part[i])
                        yield min(ids[i], ids[j]), max(ids[i], ids[j])

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 85, k: int = 5, id_col: str = "doc_id", text_col: str = "text", trees: int = 3, width: int = 3, deeper: int = 2, small: int = 4096, depth: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of `df`.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; a component is all
    that links reach, named by its smallest id.

    1. Documents with the same set are one class, and its smallest id stands for it.
    2. `trees` independent trees branch each class by `width` of its minwise tokens: classes with an equal token
       share a node. A pair of similarity s misses a node of all three trees with probability (1 - s)^9.
    3. In each node every class is tried against the node's central class; each class's best candidate is confirmed
       on full sets. That joins large groups of copies without looking at all their pairs.
    4. Nodes that hold one component are done. Where more than `small` classes stand outside a node's largest
       component, its classes branch again by `deeper` other tokens, down to `depth` levels. In a small node,
       and whatever is left at the last level, all classes outside the largest component are compared with all
       classes of other components in the node, inside tasks, in blocks of about `block_rows` rows a side: first by
       sketch, which leaves the rows that have a candidate at all, then by full sets. A block gives out no pairs
       but the links that join its components, fewer than it has rows.

    Size and sketch of both sets go before every confirmation; neither drops a pair at the threshold but with
    probability below 5e-6. Texts without words are linked with nothing. Rows that share an id count as one
    document's; rows with a null id are linked with nothing and kept. Repeated rows each give a row; an empty
    table gives an empty one; other columns are left out, whatever their names. Joins deal a node, a document or a set
    that very many rows have over several tasks. Tables of the way are removed from the shared folder at the end.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first_level = trees * width
    signed = scratch.keep(signatures(docs, k, tokens := max(32, first_level)))
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "tokens", *SKETCH)]
    classes = scratch.keep(signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *firsts))
    light = ["doc_id", "n_shingles", *SKETCH]
    total = classes.count() * first_level

    def token(node: list[Column], at: Column) -> Column:
        return F.xxhash64(*node, at, F.element_at("tokens", (at + 1).cast("int")))

    branches = F.array(*(token([F.lit(i // width)], F.lit(i)) for i in range(first_level)))
    places = classes.select(F.posexplode(branches).alias("branch", "node"), "doc_id")
    shared = scratch.keep(places.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Most places are a node's only one; sketches follow those that aren't.
    places = scratch.keep(salted_join(places, shared.hint("merge"), "node", "doc_id", total))
    nodes = scratch.keep(places.join(classes.select(*light, F.slice("tokens", 1, first_level).alias("tokens")).hint("merge"), "doc_id"))

    large = nodes.where("n > 8").select("node", "n", *light)
    near = salted_join(large.drop("n"), scratch.keep(central(large, light, total)), "node", "doc_id", total).where((F.col("doc_id") != F.col("f_doc_id")) & _close("", "f_", percent))
    best = near.groupBy("doc_id").agg(F.min(F.struct(_different("", "f_").alias("off"), F.col("f_doc_id").alias("a"))).alias("m"))
    tried = scratch.keep(best.select(F.least("m.a", "doc_id").alias("a"), F.greatest("m.a", "doc_id").alias("b")).distinct())
    parts = connected_components(scratch.keep(confirm(tried, docs, percent, k)))

    level = nodes.drop("n").join(parts.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    links: DataFrame | None = None
    for i in range(depth):
        level = scratch.keep(level)
        by_part = level.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
        state = by_part.groupBy("node").agg(F.max(F.struct("n", "component", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        state = state.select("node", "n", "size", F.col("top.component").alias("largest"), (F.col("n") - F.col("top.n")).alias("others"), (F.col("size") - F.col("top.size")).alias("others_size")).where("others > 0")
        mixed = scratch.keep(salted_join(level, scratch.keep(state), "node", "doc_id", level.count()))
        ready = mixed if i == depth - 1 else mixed.where(F.col("others") <= small)
        if i == 0:  # a pair comes from the first of the nodes that it shares and that are compared here
            ready = ready.join(ready.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1, branch)")).alias("mask")), "doc_id")
        else:
            ready = ready.withColumns({"branch": F.lit(0), "mask": F.lit(0), "tokens": F.array(F.lit(0))})
        active = scratch.keep(active_rows(dealt(ready, light, block_rows), percent))
        more = scratch.keep(block_links(active, docs, percent, k))
        links = more if links is None else links.union(more)
        if i == depth - 1:
            break
        again = scratch.keep(mixed.where(F.col("others") > small).select("node", "component", *light))
        if again.isEmpty():
            break
        other = F.explode(F.array(*map(F.lit, range(deeper)))).alias("j")
        chosen = again.select("*", other).join(classes.select("doc_id", "tokens"), "doc_id")
        level = chosen.withColumn("at", F.pmod(F.xxhash64("node", "j"), F.lit(tokens))).select(token([F.col("node"), F.col("j")], F.col("at")).alias("node"), "component", *light)

    part_of = lambda at: parts.select(F.col("id").alias(at), F.col("component").alias(f"{at}_part"))
    joined = links.distinct().join(part_of("a"), "a", "left").join(part_of("b"), "b", "left")
    whole = connected_components(joined.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))

    named = classes.select("digest", "doc_id", F.col("copies").alias("n")).join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    named = named.join(whole.withColumnRenamed("id", "part"), "part", "left").select("digest", "n", F.coalesce("component", "part").alias("component_id"))
    rows = salted_join(signed.select("doc_id", "n_shingles", "digest"), named, "digest", "doc_id", signed.count(), "left", counts=classes.select("digest", F.col("copies").alias("n")))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    out = stored(rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    scratch.clear()
    return out


def dealt(rows: DataFrame, light: list[str], block_rows: int) -> DataFrame:
    """Rows of nodes in blocks (node, ob, ab): a node's classes outside its largest component in parts `ob`, all its classes in parts `ab`.

    Each part meets each. A node of one block has its rows once, with role 0; else rows come as one of all (role
    0) and, if outside, as such (role 1).
    """
    parts = lambda n, size: F.ceil(F.greatest(F.col(n) / block_rows, F.col(size) / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumns({"outs": parts("others", "others_size"), "alls": parts("n", "size")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    as_all = F.transform(every("outs"), lambda o: F.struct(o.alias("ob"), own(0, "alls").alias("ab"), F.lit(0).alias("role")))
    as_out = F.transform(every("alls"), lambda a: F.struct(own(1, "outs").alias("ob"), a.alias("ab"), F.lit(1).alias("role")))
    twice = (F.col("outs") * F.col("alls") > 1) & (F.col("component") != F.col("largest"))
    places = F.explode(F.when(twice, F.concat(as_all, as_out)).otherwise(as_all)).alias("p")
    return rows.select("node", "component", "largest", "branch", "mask", "tokens", *light, places).select("node", "p.*", "component", "largest", "branch", "mask", "tokens", *light)


def keep_first(df: DataFrame, percent: int = 85, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` but for near duplicates: of each component, the row of its smallest id stays; rows with a null id stay.

    The ids to drop are broadcast if they are few, and else joined by a shuffle. Where rows share an id, one of
    them stays.
    """
    found = stored(near_duplicates(df, percent, k, id_col, text_col))
    drop = found.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    out = df.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, id_col, "left_anti").select(df.columns)
    if found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(out.where(F.col(id_col).isNull()))
