"""The corpus pipeline: five stages from raw documents to packed bins.

Each stage gets all that its predecessor kept and returns the columns of `documents`, but for the last,
which returns the packing's pieces. Between stages the table is written and read again.

1. quality_rules: documents that fail the rules, or whose host is rejected, go.
2. line_dedup: lines with an equal or nearly equal one earlier in the corpus go; a document of which
   nothing is left goes.
3. ngram_jaccard: of each component of near duplicates the smallest doc_id stays.
4. decontamination: documents in which a window of a benchmark item occurs go.
5. packing: the documents go into bins of a fixed capacity without conflicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm import decontaminate, lines, ngram_join, packing, quality
from loomkin.llm.common import discard, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text changes, so n_chars is counted anew."""
    out = lines.clean_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.document_items(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The edit join, the components and the packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
