"""From raw documents to token files: quality, near duplicates, benchmark passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's input.
Defined results, for every stage: an empty table passes empty; null texts are judged as empty ones (the first stage scores them, the second takes them for equal texts,
the third finds nothing in them, the fourth has their size 0, the last writes their end id); null ids are kept; of equal rows the second stage keeps one; texts of any
length are read whole; columns beyond those of documents are carried along up to the last stage, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import decontaminate, mixing, near_dup, quality, token_files
from gaugeline.llm.queries import table, tokenizer_file
from gaugeline.llm.storage import keep

QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted on all labels, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(F.col("text"), model) >= QUALITY_THRESHOLD)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return near_dup.dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item, edited or not."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix of sources says, 0 to 3 times."""
    taken = mixing.mix_rows(docs).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return what they hold of each document."""
    return token_files.token_rows(spark, docs, tokenizer_file())


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontaminate_stage), ("mix", mix_stage), ("tokens", token_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
