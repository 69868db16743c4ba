"""Corpus pipeline over ``documents``: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back
as the next one's docs. The filters keep all columns of documents; the last stage returns pieces of
packed sequences. No stage can be written in SQL, so there is no ORACLE_SQL.

For every stage: columns that documents don't have are kept as they are, whatever their names (the last stage
returns its own); repeated rows and equal texts get the same decision; texts of any length are read whole; an empty
table gives an empty one; a null id is kept like any other and belongs to no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import near_dup, packing, quality, registry, toxicity
from kindred.llm.common import keep_rows, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold for quality. A null text is scored as an empty one."""
    shared = spark.sparkContext.broadcast(quality.fit(docs, registry.labelled(spark, sf_dir, 5, 0)))

    def make():
        model = shared.value
        return lambda texts: (model.score_texts(texts) >= registry.THRESHOLD).tolist()

    return keep_rows(docs, make)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold for toxicity. A null text is scored as an empty one."""
    get = toxicity.scorer(toxicity.fit(docs, registry.labelled(spark, sf_dir, 4, 2)), spark)

    def make():
        scorer = get()
        return lambda texts: [s < registry.THRESHOLD for s in scorer.score(texts)]

    return keep_rows(docs, make)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id (null before all), ties to the smallest hash of
    the text. Null is the empty text; texts without words are copies only of equal texts."""
    return near_dup.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences. A null text is an empty one and still has its end token; repeated rows are packed
    each."""
    return packing.pack(docs, registry.tokenizer_file("word_bpe_49k.json")).drop("ids")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", dedup_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
