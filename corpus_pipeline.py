"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage works on the written rows that the stage before it kept, and its decisions take effect: toxic documents go,
repeated lines go from texts, one document of each near-duplicate group stays, documents with benchmark windows go, and
documents that the mixture takes no copy of go. The last stage adds `rate` and `copies` to the columns of documents;
`copies` is a weight that a reader applies: a document of two copies is one row.

Defined cases, in every stage: a null text is an empty one; documents without words are one near-duplicate group, are not
toxic by themselves (they score by the bias), hold no window and keep rate 1; a null doc_id is smaller than any other for
lines and goes last among near duplicates; repeated rows are near duplicates of each other; texts are read whole however
long; other columns pass through, and a column named `rate` or `copies` keeps its name while the new one gets another; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.common import bound_batches, read_table, scratch_path
from keelson.llm.decontaminate import drop_contaminated
from keelson.llm.line_dedup import drop_repeated_lines
from keelson.llm.mixing import apply_mixture
from keelson.llm.near_sets import near_duplicates
from keelson.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    bound_batches(spark)
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the document with the largest id alone."""
    bound_batches(spark)
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    SimHash fingerprints linked by vantage-point trees come first, min-wise orders find the pairs beyond their radius,
    and exact sets judge both.
    """
    bound_batches(spark)
    return near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get rates so that the quality classes' expected tokens match their target shares."""
    bound_batches(spark)
    return apply_mixture(docs, read_table(spark, sf_dir, "labels"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]

#: Classifiers, similarity and rates are beyond SQL. Tests hold the stages of lines, near duplicates and windows against
#: brute force row by row, and the operators behind toxicity and mixing against plain versions of their models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
