"""Language identification by compression with one raw-content dictionary for each language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters of a text with single blanks for all else; empty if it has no letter."""
    out = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return out if any(map(str.isalpha, out)) else ""


def learn_dictionaries(train: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", dict_bytes: int = 16_384, sample_docs: int = 32, segment: int = 256) -> dict[str, bytes]:
    """Dictionary of each language, from a bounded sample of its documents.

    `sample_docs` documents with letters of each language, smallest hash of the id first, are cleaned whole and cut
    into segments of about `segment` bytes, at blanks; a dictionary is the segments of smallest hash that fill
    `dict_bytes`, so that every place of every sampled text may be in it. Languages that can fill `dict_bytes` get so much, at a
    blank, so that none of them wins by size; one that can't has all of its sample, and others don't lose by it. Spark cuts and picks;
    the driver gets `dict_bytes` for each language, of which there may be any number.

    Rows whose language or text is null, and texts without a letter, teach nothing; rows that share an id and
    repeated rows may each be picked; an empty table gives no dictionary; other columns may have any name.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("string").alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k", F.xxhash64("t"))
    picked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs)  # Spark keeps so many rows a language before the shuffle

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8):
                found = [(lang, n, i, s) for lang, n, text in zip(*(part.column(i).to_pylist() for i in range(3))) for i, s in enumerate(segments(letters(text), segment))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["lang", "r", "i", "s"])

    parts = picked.select("lang", "r", "t").mapInArrow(cut, "lang string, r int, i int, s string")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("r", "i"), "r", "i")
    most = 2 * dict_bytes // segment
    raw: dict[str, bytes] = {}
    for r in parts.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= most).orderBy("lang", "at").collect():
        if len(have := raw.get(r["lang"], b"")) < dict_bytes:
            raw[r["lang"]] = have + r["s"].encode() + b" "
    return {lang: x if len(x) <= dict_bytes else x[: x.rfind(b" ", 0, dict_bytes) + 1] or x[:dict_bytes] for lang, x in sorted(raw.items())}


def segments(text: str, size: int) -> Iterator[str]:
    """A cleaned text in runs of whole words of `size` bytes or a little more; a longer word is a run of its own."""
    run, n = [], 0
    for word in text.split(" "):
        run.append(word)
        n += len(word.encode("utf-8", "surrogatepass")) + 1
        if n >= size:
            yield " ".join(run)
            run, n = [], 0
    if run and any(run):
        yield " ".join(run)


class Classifier:
    """Compresses whole texts, in chunks, with each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, chunk: int = 2048):
        self.chunk, self.by_lang = chunk, []
        for lang, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        raw = text.encode("utf-8", "surrogatepass")
        parts = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        return sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in self.by_lang)

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        """Language of the smallest size, its share of the evidence, and whether the margin is too narrow to rely on."""
        if not self.by_lang or not (clean := letters(text)):
            return "und", 0.0, True
        sizes = self.sizes(clean)
        best, lang = sizes[0]
        unit = 0.02 * best + 1
        score = 1 / sum(math.exp((best - s) / unit) for s, _ in sizes)
        margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
        return lang, score, margin < min_margin


def identify_languages(df: DataFrame, dictionaries: dict[str, bytes], id_col: str | Column = "doc_id", text_col: str = "text", min_margin: float = 0.01, level: int = 6, chunk: int = 2048) -> DataFrame:
    """One row (doc_id, lang_pred, score, rejected) for each row of `df`, without a shuffle.

    Each whole text is lower-cased, its non-letters blanked, and cut into chunks; the language whose dictionary
    gives the smallest sum of compressed sizes wins (ties: the smaller code). `rejected` marks predictions whose
    runner-up is less than `min_margin` larger; they keep the nearest language. Null, empty and letterless texts
    are `und` with score 0, as is every text if there is no dictionary. Repeated rows each give a row, a null id
    stays null, an empty table gives an empty one; other columns of `df` are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, level, chunk)
        for batch in batches:
            rows = [model.predict(t, min_margin) for part in slices(batch) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "rejected"])

    few = df.select((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
