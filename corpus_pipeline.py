"""The corpus pipeline: documents through quality rules, quality classifier, near-dedup, mixing and packing.

Every stage takes null ids, texts, languages and sources, empty and very long texts, repeated rows, empty tables and
further columns of any name. The first stage drops null, empty and short texts by its base rules. Rows with a null id
aren't near duplicates of any and stay; rows that share an id count as one document, of which near-dedup keeps one
row; a null source is one source. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hueframe.llm import mixing, near_duplicates, packing, quality_knn, quality_rules
from hueframe.llm.common import stored, table
from hueframe.llm.queries import bpe_path, quality_held_out


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence test against references from these documents."""
    return quality_rules.quality_rules(docs, keep=True)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the model learns from labelled rows of these documents."""
    held = quality_held_out()
    model = quality_knn.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality_knn.score_quality(docs, model, keep=True)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, linked from a similarity of 0.80 on."""
    return near_duplicates.keep_first(docs, percent=80)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit_mix(mixing.mix_sources(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack_documents(docs, bpe_path())


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("near_duplicates", without_copies),
    ("mixing", to_weights),
    ("packing", packed),
]

#: The classifier's nearest-neighbour votes can't be put in SQL, so neither can the rows after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
