"""From raw documents to token ids: five stages, each over all that the one before it kept.

``run`` writes each stage's rows as Parquet in the shared scratch folder and reads them back for the next, so a lost
executor costs no more than the stage at work.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from yomisaku.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from yomisaku.llm.common import table, written
from yomisaku.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of three lines go, and documents that nothing is left of."""
    cut = line_dedup.dedup_lines(docs)
    return cut.filter(F.coalesce(F.trim("text") != "", F.lit(True)) | (F.col(cut.columns[-1]) == 0)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return ngram_join.keep_first(docs, k=5, num=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more are benchmark windows go; others lose passages of 13 words or more."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_span=decontaminate.WINDOW - 1, drop=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their decoded text, and how many there are."""
    return bpe.encode_decode(docs, vocabulary_path()).selectExpr("doc_id", "size(ids) as n_tokens", "ids", "text as decoded")


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("near duplicates", dedup_documents),
          ("decontamination", remove_benchmark), ("tokens", tokenize)]

#: The suffix and pair structures have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
