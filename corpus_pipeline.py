"""From documents to packed training sequences: five stages, each on what the one before kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.decontamination import drop_contaminated
from tabulon.llm.exact_dedup import drop_exact_copies
from tabulon.llm.packing import pack
from tabulon.llm.shared import stored
from tabulon.llm.simhash import drop_near_copies
from tabulon.llm.toxicity import drop_toxic, fit_chain, label_categories
from tabulon.queries.registry import table

VOCABULARY = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. It is fitted on the labelled ones among them."""
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), label_categories())
    return drop_toxic(docs, chain, "toxic")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return drop_exact_copies(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id."""
    return drop_near_copies(docs, size=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash),
    ("decontamination", decontamination),
    ("best-fit packing", packing),
]

# The classifier, the fingerprints and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the table between two stages is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
