"""Quality rules: base counts, and Jensen-Shannon distance from language references."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices

# The character classes of the class histogram; bytes from 0xC0 on start a non-ASCII character.
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\n\v\f\r", "sentence": ".,;:'\"()-", "stress": "!?", "markup": "#*$%&|<>", "bracket": "@[\\]^_`{}~=+/"}
N_CLASSES = len(CLASSES) + 1
_CLASS_OF = np.full(256, N_CLASSES, np.uint8)  # control and continuation bytes stand last and aren't counted
for _i, _chars in enumerate(CLASSES.values()):
    _CLASS_OF[np.frombuffer(_chars.encode(), np.uint8)] = _i
_CLASS_OF[0xC0:] = N_CLASSES - 1
# Scripts by the lead bytes of their letters in UTF-8; lead bytes of symbols and of many scripts alike have none.
SCRIPTS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)], "armenian-hebrew": [*range(0xD4, 0xD8)], "arabic": [*range(0xD8, 0xDC)], "indic": [0xE0], "georgian-ethiopic": [0xE1], "east-asian": [*range(0xE3, 0xEA)], "hangul": [*range(0xEB, 0xEE)]}
_SCRIPT_NAMES = ["", *SCRIPTS]
_SCRIPT_OF = np.zeros(256, np.uint8)
for _i, _leads in enumerate(SCRIPTS.values()):
    _SCRIPT_OF[_leads] = _i + 1
_EDGE = ".,;:!?'\"()-#*$%&|<>"
_SYMBOLS = "#*$%&|<>"


def class_histogram(raw: bytes) -> np.ndarray:
    """Characters of each class in UTF-8 text."""
    return np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def script(raw: bytes) -> str:
    """The script that most letters of UTF-8 text are of (ties: the first of SCRIPTS), empty if it has none."""
    counts = np.bincount(_SCRIPT_OF[np.frombuffer(raw, np.uint8)], minlength=len(_SCRIPT_NAMES))[1:]
    return _SCRIPT_NAMES[1 + int(counts.argmax())] if counts.any() else ""


def term(word: str) -> str:
    """A word in lower case without punctuation at its ends."""
    return word.lower().strip(_EDGE)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms; 0 where either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2
    return math.sqrt(max(d, 0.0))


def js_distances(p: np.ndarray, qs: np.ndarray) -> np.ndarray:
    """`js_distance` of a filled histogram to each row of `qs`, whose rows sum to 1; only the bins that p fills are looked at."""
    at = np.flatnonzero(p)
    p, q = p[at] / p.sum(), qs[:, at]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (p * np.log2(p / m)).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1) + np.maximum(1 - q.sum(1), 0)
    return np.sqrt(np.maximum(d / 2, 0.0))


@dataclass
class References:
    """Bins of common words, and each language's shares of character classes (all 0: none) and of words, the last bin for all other words."""

    langs: list[str]
    bins: dict[str, int]
    classes: np.ndarray
    words: np.ndarray

    def word_histogram(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.bins) + 1, np.int64)
        for word, n in Counter(words).items():
            out[self.bins.get(term(word), -1)] += n
        return out


def repeated_words(words: list[str]) -> int:
    """Places of words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def base_counts(text: str | None) -> tuple[list[str], int, int, int, int]:
    """Words, their code points, symbols, duplicated lines and repeated words of a whole text."""
    if not text:
        return [], 0, 0, 0, 0
    # On UTF-8, bytes.split cuts at exactly the six ASCII white-space characters.
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if line in seen:
                dup += 1
            seen.add(line)
    return words, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), dup, repeated_words(words)


#: Shares of a class within a document are counted by their square root, in so many steps.
STEPS = 400


#: What a reference is called that is one script's, of languages with too few documents together or of documents without a language.
POOL = "*"


def references(df: DataFrame, lang_col: str | None = "lang", text_col: str = "text", min_docs: int = 20, min_chars: int = 200, common: int = 40) -> References:
    """Common words, and class and word reference of each language, from all its documents.

    The bins are the `common` most frequent words of each language (ties: the smaller word). The word reference
    sums them over all documents. The class reference is each class's median share
    over the documents of `min_chars` bytes or more, read from counts of shares, so that a minority of broken
    documents can't bend it; it is all zero where there is no such document. Every language with `min_docs` such
    documents in a script has a reference for that script, however small its share of the table; all others make one together for each
    script, named POOL: scripts aren't blended, so that text in a rare one isn't far from all references. Documents without a language make
    a reference, named POOL as well, for scripts in which no language has one. A document without letters counts for its
    language's main script, by words, and without one makes no reference. Words and shares are counted inside
    tasks and summed by Spark; the driver gets `common` words and a row of shares for each reference. Null and empty
    texts count nothing, an empty table gives no reference, repeated rows count each, and other columns may have
    any name.
    """
    few = df.select((F.col(lang_col) if lang_col else F.lit(None)).cast("string"), F.col(text_col))
    size = N_CLASSES * (STEPS + 1)
    at = np.arange(N_CLASSES) * (STEPS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, np.ndarray] = {}
        words: dict[tuple, Counter] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        raw = text.encode("utf-8", "surrogatepass")
                        key = lang, script(raw)
                        words.setdefault(key, Counter()).update(raw.split())
                        if len(raw) >= min_chars and (c := class_histogram(raw)).any():
                            cells.setdefault(key, np.zeros(size, np.int64))[at + np.rint(STEPS * np.sqrt(c / c.sum())).astype(int)] += 1
                if sum(map(len, words.values())) > 200_000 or len(cells) > 200:
                    yield flat(cells, words)
                    cells, words = {}, {}
        yield flat(cells, words)

    def flat(cells: dict[tuple, np.ndarray], words: dict[tuple, Counter]) -> pa.RecordBatch:
        terms: Counter = Counter()
        for key, counts in words.items():
            for w, n in counts.items():
                terms[*key, term(w.decode("utf-8", "surrogatepass"))] += n
        rows = [(*key, None, n) for key, n in terms.items()] + [(*key, None, i, int(h[i])) for key, h in cells.items() for i in np.flatnonzero(h).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "script", "word", "cell", "n"])

    scratch = Scratch(df.sparkSession)
    summed = scratch.keep(few.mapInArrow(run, "lang string, script string, word string, cell int, n long").groupBy("lang", "script", "word", "cell").agg(F.sum("n").alias("n")))
    sizes = summed.where("word IS NOT NULL AND script <> ''").groupBy("lang", "script").agg(F.sum("n").alias("words"))
    main = sizes.groupBy(F.col("lang").alias("lang_")).agg(F.max_by("script", F.struct("words", "script")).alias("main"))
    # `main` and `docs` have a row for each language and script, as the references have, so that they are broadcast.
    placed = summed.join(F.broadcast(main), F.col("lang").eqNullSafe(F.col("lang_")), "left").withColumn("script", F.when(F.col("script") == "", F.col("main")).otherwise(F.col("script"))).drop("lang_", "main").where("script IS NOT NULL")
    docs = placed.groupBy(F.col("lang").alias("lang_"), F.col("script").alias("script_")).agg(F.coalesce(F.sum(F.when(F.col("cell") <= STEPS, F.col("n"))), F.lit(0)).alias("docs"))
    kind = F.when(F.col("lang").isNull(), "none").when(F.col("docs") >= min_docs, "own").otherwise("rest")
    merged = placed.join(F.broadcast(docs), F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("script") == F.col("script_"))).withColumn("kind", kind)
    merged = scratch.keep(merged.groupBy("kind", F.when(F.col("kind") == "own", F.col("lang")).otherwise(POOL).alias("lang"), "script", "word", "cell").agg(F.sum("n").alias("n")))
    totals = merged.where("word IS NOT NULL").groupBy("kind", "lang", "script").agg(F.sum("n").alias("n")).collect()
    known = {r["script"] for r in totals if r["kind"] != "none"}
    totals = sorted((r for r in totals if r["kind"] != "none" or r["script"] not in known), key=lambda r: (r["lang"], r["script"], r["kind"]))
    names = [r["lang"] for r in totals]
    langs = {f"{r['kind']} {r['script']} {r['lang']}": i for i, r in enumerate(totals)}
    merged = merged.where((F.col("kind") != "none") | ~F.col("script").isin(sorted(known))).withColumn("lang", F.concat_ws(" ", "kind", "script", "lang"))

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = merged.where("word <> ''").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common).select("word").distinct()
    bins = {r["word"]: i for i, r in enumerate(sorted(top.collect()))}
    words = np.zeros((len(langs), len(bins) + 1))
    for r in merged.join(F.broadcast(top), "word").select("lang", "word", "n").collect():
        words[langs[r["lang"]], bins[r["word"]]] = r["n"]
    words[:, -1] = np.array([r["n"] for r in totals]) - words[:, :-1].sum(axis=1)

    shares = merged.where("cell IS NOT NULL").select("lang", F.expr(f"cell div {STEPS + 1}").alias("c"), (F.col("cell") % (STEPS + 1)).alias("step"), "n")
    line = Window.partitionBy("lang", "c")
    shares = shares.withColumns({"upto": F.sum("n").over(line.orderBy("step")), "all": F.sum("n").over(line)}).where("2 * upto >= all").groupBy("lang", "c").agg(F.min("step").alias("step"))
    classes = np.zeros((len(langs), N_CLASSES))
    for r in shares.collect():
        classes[langs[r["lang"]], r["c"]] = (r["step"] / STEPS) ** 2
    scratch.clear()
    return References(names, bins, classes, words / np.maximum(words.sum(axis=1, keepdims=True), 1))


def quality_rules(df: DataFrame, lang_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text", max_class_distance: float = 0.2, max_word_distance: float = 0.6, min_chars: int = 200, min_words: int = 100, keep: bool = False) -> DataFrame:
    """Base counts and the divergence verdict for each row of `df`.

    A document's class and word histograms are compared with every language reference; it is rejected if the
    smallest class distance is above `max_class_distance` (texts of `min_chars` bytes or more) or the smallest
    word distance above `max_word_distance` (texts of `min_words` words or more). Shorter texts have too few
    counts for a distance and are left to the base rules: n_words < 50, or more than half of all words in
    repeated 3-word windows. A document's own language is no input of its verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance, nearest_lang; with `keep`, instead the rows of `df` that are kept, with
    df's own columns. Null and empty texts have no words: base_failed, distances 0, nearest_lang null.
    Repeated rows each give a row, a null id stays null, an empty table gives an empty one; other columns of
    `df` may have any name.
    """
    refs = references(df, lang_col, text_col, min_chars=min_chars)
    by_classes = np.array([c / c.sum() for c in refs.classes if c.any()])
    shared = df.sparkSession.sparkContext.broadcast(refs)

    def judge(text: str | None) -> tuple:
        words, chars, symbols, dup, rep = base_counts(text)
        n = len(words)
        failed = n < 50 or 100 * rep > 50 * n
        by_class, by_word, lang = 0.0, 0.0, None
        if n and shared.value.langs:
            raw = text.encode("utf-8", "surrogatepass")
            mine, own = class_histogram(raw), shared.value.word_histogram(words)
            by_class = float(js_distances(mine, by_classes).min()) if len(by_classes) and mine.any() else 0.0
            distances = js_distances(own, shared.value.words)
            by_word, lang = float(distances.min()), shared.value.langs[int(distances.argmin())]
            ok = (len(raw) < min_chars or by_class <= max_class_distance) and (n < min_words or by_word <= max_word_distance)
        else:
            ok = True
        return n, chars, symbols, dup, rep, failed, ok and not failed, by_class, by_word, lang

    if keep:
        at = df.columns.index(text_col)

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield part.filter(pa.array([judge(t)[6] for t in part.column(at).to_pylist()], pa.bool_()))

        return df.mapInArrow(only, df.schema)

    types = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.float64(),) * 2 + (pa.string(),)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "nearest_lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t) for part in slices(batch) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", *names])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, nearest_lang string")
