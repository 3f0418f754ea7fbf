"""From raw documents to packed sequences: five stages, each of which applies one operator to all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads
it back for the next.  All stages but the last return the columns of documents.

Edge cases, in every stage: a null text is empty; extra columns are dropped by the first stage; documents that lose all
their lines stay as empty texts; labels are joined on the integer id; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushline.llm import decontaminate, line_dedup, near_copies, packing, simhash, toxicity
from hushline.llm.common import stored
from hushline.llm.queries import packed_digest, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that multiple-instance learning, fitted on the labelled ones, does not call toxic."""
    docs = docs.select(*COLUMNS)
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, weights, out="_score").where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more of them hold, except in the last of these."""
    cleaned = line_dedup.LineIndex.build(docs).clean(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of the smallest id."""
    return simhash.one_of_each(docs, near_copies.groups(docs)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed_digest(packing.pack(docs, vocabulary()))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: The first stage trains a model, which SQL cannot express; tests compare all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
