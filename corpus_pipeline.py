"""Corpus pipeline: toxicity filter, SimHash near-duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``; the last returns packed pieces.
Stages keep every row that they don't reject: rows with null columns, empty texts, repeated rows (but for the
near-duplicate stage, which keeps one) and any further columns. No stage is expressible in DuckDB SQL (a trained
classifier, XXH64 fingerprints, canonical templates, BPE ids), so ``ORACLE_SQL`` is None and the stages are tested
against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import decontam_template, packing_nnls, simhash_vptree, toxicity_nb
from tabwright.llm.common import cut_lineage, written
from tabwright.llm.queries import bpe_path, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of ``docs``, doesn't predict as toxic."""
    model = toxicity_nb.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~toxicity_nb.held_out())
    # appended columns must not hide own ones of the same name
    shown = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("score", "predicted") if c in docs.columns})
    return toxicity_nb.score(shown, model, 0.3).where("predicted = 0").drop("score", "predicted").withColumnsRenamed(
        {f"__own_{c}": c for c in ("score", "predicted") if c in docs.columns})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id (of rows with that doc_id, one)."""
    found = cut_lineage(simhash_vptree.near_duplicates(docs.select("doc_id", "text"), words=3, bits=2, seed=42)
                        .select("doc_id", "kept", "fp", "group"))
    by_id = cut_lineage(found.groupBy(F.col("doc_id").alias("__id")).agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("kept"), 1)).alias("kept")).where("rows > 1 or kept = 0"))
    same_id = docs["doc_id"].eqNullSafe(by_id["__id"])
    left = docs.join(by_id.where("kept = 0"), same_id, "left_anti")
    if by_id.where("kept > 0").isEmpty():
        return left
    # rows that share a doc_id, some of them kept: one of each group that has this doc_id as its smallest
    alone = left.join(by_id.where("kept > 0"), same_id, "left_anti")
    shared = left.join(by_id.where("kept > 0"), same_id, "left_semi")
    shared = written(shared.withColumn("__fp", simhash_vptree.fingerprint(F.col("text").cast("string"))), "shared-ids")
    groups = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__print"),
                                        F.col("group").alias("__group")).distinct()
    named = shared.join(groups, shared["doc_id"].eqNullSafe(groups["__id"]) & (F.col("__fp") == F.col("__print")))
    return alone.unionByName(named.dropDuplicates(["doc_id", "__group"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item's template: each is judged by its own text, with a null or repeated doc_id too."""
    keyed = docs.withColumn("__text_key", F.sha2(F.col("text").cast("string").cast("binary"), 256))
    return decontam_template.decontaminate(keyed, table(spark, sf_dir, "benchmark"), key="__text_key",
                                           any_case=True).drop("__text_key")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    return packing_nnls.pack_documents(docs, bpe_path(), window=2048, end_id=1).drop("ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
