"""The corpus pipeline: stages over ``documents``, each written and read again by run().

Toxic documents go, then exact copies, then all but one of each group of near
copies; what is left is mixed to the target weights and packed into sequences.
Every stage is the production operator with its own defaults.

Defined cases, for every stage and for run(): a null or empty text is a document
like any other until the mix, which leaves rows without words out; null
identifiers stand above all others; rows that repeat an identifier and a text share
one fate up to the mix; null sources are a source of their own; extra columns, also
of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import DOCUMENT, Scratch
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.mixing import mix_documents
from corvane.llm.packing import best_fit
from corvane.llm.simhash_dedup import near_copies
from corvane.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score rejects go; clean ones and those without evidence stay, null and empty texts too unless calibration rejects the base rate."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=DOCUMENT)
    return scored.where("predicted = 0").select(*DOCUMENT)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, of a group without identifiers every row; a null text equals an empty one."""
    return exact_dedup(docs, carry=DOCUMENT).where("kept").select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of five-word shingles of 0.8 or more, checked exactly, the row with the smallest doc_id stays.

    Texts without words are one group; rows that repeat the smallest doc_id of a group all stay.
    """
    found = near_copies(docs, carry=DOCUMENT)
    return found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat, shrink to their picked blocks or go, so that each source comes to its target; n_chars follows. Rows without words go."""
    mixed = mix_documents(docs, carry=("lang",)).withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*DOCUMENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of a document in a sequence; rows with equal identifiers are packed as different documents."""
    return best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither the score nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to the table ``documents``."""
    store = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.table(stage(spark, docs, sf_dir), str(k))
        if k:
            store.drop(str(k - 1))
    return docs
