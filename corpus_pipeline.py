"""Corpus pipeline: five stages over the documents table, each an operator of
``millrace.llm``. Every stage takes (spark, docs, sf_dir); ``run`` writes each
stage's result and reads it back for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import contamination, packing, quality, resemblance, secrets
from millrace.llm.common import clear, fresh, mark, store, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; a null or wordless text is rejected."""
    return quality.keep(docs)


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, so that a decision meets its
    own row whatever the ids are (null, repeated); and that column's name."""
    row = fresh("__row", docs.columns)
    return store(spark, docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, all such pairs. SimHash
    links propose, the sets decide, and a prefix filter finds what fingerprints
    leave apart. The row of the least doc_id stays, then of the least hash of the
    text. Texts without words are one group."""
    rows, row = numbered(spark, docs)
    return without(rows, resemblance.beside_another(rows, row, "doc_id"), row).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty is benchmark text."""
    rows, row = numbered(spark, docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = contamination.contaminated(rows, benchmark, id_col=row).where("contaminated").select(row)
    return without(rows, bad, row).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars brought up to date."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their token ids (little-endian, 32 bits)
    and their places in sequences of 2048 tokens."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints and tokens are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. A stage's own tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    began = mark()
    for name, stage in STAGES:
        docs = store(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        clear(spark, began, keep=1)
    return docs
