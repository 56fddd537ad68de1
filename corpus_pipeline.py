"""The corpus pipeline: five stages, each a corpus operator on what the stage before it kept.

``STAGES`` lists them in order. Each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of ``documents``.

Cases: null and empty texts pass the stages (null texts as null) and are packed as an
end id each; repeated rows and ids are judged row by row, of equal texts one row stays; an
empty table stays empty; further columns pass all stages but the last, whatever their
names.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, line_dedup, packing, quality_knn, simhash_dedup
from tidepanel.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; ``n_chars`` follows the text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return simhash_dedup.keep_one(docs).select(*docs.columns)


#: Benchmark items of fewer words are not looked for: a document would go for a common phrase.
LEAST_ITEM_WORDS = 5


def short_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that the stage leaves aside, to be looked at by people."""
    return decontaminate.short_items(table(spark, sf_dir, "benchmark"), LEAST_ITEM_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item of at least ``LEAST_ITEM_WORDS`` words go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least_words=LEAST_ITEM_WORDS).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, every stage's result being written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
