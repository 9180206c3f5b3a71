"""A corpus pipeline of five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from gridloom.llm.common import free_name, stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay, as they are, repeated rows and null ids or texts included."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.probability(model, spark) < 0.3)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; a document that has nothing left goes with them.

    Null, empty and blank texts have no line to lose and stay. Rows equal in id and text are one document: they
    lose the same lines. n_chars, where there is such a column, follows a text that changed.
    """
    name = free_name(docs, "kept")
    removed, left = F.col(f"{name}.n_removed") > 0, F.col(f"{name}.text")
    kept = line_dedup.with_kept_lines(docs, out_col=name).where(~removed | (left != ""))
    new = {"text": F.when(removed, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(removed, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links the document with the least id stays, once; so does what is linked with nothing.

    A document is an id and a text here, so texts that share an id are told apart; rows equal in both stay once. Null
    ids come after all others. Texts without words have no links: all their rows stay.
    """
    key, first = free_name(docs, "doc_key"), free_name(docs, "first_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = ngram_join.join_components(keyed, id_col=key).distinct()
    ids = keyed.select(F.col(key).alias("doc_key"), F.col("doc_id").alias("id")).distinct()
    members = found.withColumnRenamed("doc_id", "doc_key").join(ids, "doc_key")
    least = members.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "doc_key")).alias("least"))
    one = keyed.join(least.select(F.col("least.doc_key").alias(first)), F.col(key) == F.col(first), "left_semi").dropDuplicates([key])
    wordless = keyed.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return one.unionByName(wordless).drop(key)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window near a benchmark item stay, as they are, repeated rows and null ids or texts included."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequences and places; a null text is an empty one."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", reject_contaminated),
    ("best-fit packing", pack),
]

#: Toxicity scores, similarity joins and packing aren't expressible in SQL; tests check each stage on planted cases.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
