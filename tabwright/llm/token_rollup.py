"""Token counts by source, language and tokenizer version, kept up by signed changes.

A rollup is a folder of the shared store with three parts:

* ``ledger/batch_id=B``: signed rows (doc_id, version, source, lang, docs, tokens);
* ``delta/batch_id=B``: the batch's additive totals (source, lang, version, docs, tokens);
* ``commits/batch_id=B``: written last; a batch counts once this exists.

An insert adds rows, a delete adds the rows that take the document's present ones back, a revised count does both. A
doc_id, null included, may stand for several rows of a table: they are counted together, by source and language.
Totals are sums of deltas, so they are exact in any order of batches and need no rewriting. Committing a batch again
does nothing; a commit that died before its marker is overwritten by the next attempt with the same batch id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.tokens import encoder

KEYS = ["source", "lang", "version"]
_LEDGER = "doc_id long, version string, source string, lang string, docs long, tokens long"
_DELTA = "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with ``n_tokens`` (ids of the whole text, no special tokens; null and empty texts: 0)."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(i) // 4 for i in encoder(tokenizer_path).stream(texts.tolist())], dtype="int64")

    return docs.withColumn("n_tokens", count(F.col("text").cast("string")))


class Rollup:
    """A rollup below ``path`` (a folder of the shared store)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch_id: int) -> bool:
        return self._exists(f"{self.path}/commits/batch_id={int(batch_id)}/_SUCCESS")

    def _part(self, part: str, schema: str) -> DataFrame:
        """Rows of the committed batches."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], f"{schema}, batch_id long")
        done = self.spark.read.schema("at long, batch_id long").parquet(f"{self.path}/commits")
        rows = self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.path}/{part}")
        return rows.join(done.select("batch_id").distinct(), "batch_id", "left_semi")

    def ledger(self) -> DataFrame:
        return self._part("ledger", _LEDGER)

    def present(self, of: DataFrame | None = None) -> DataFrame:
        """(doc_id, version, source, lang, docs, tokens) of every document that counts now; ``docs`` is the number of rows
        that share these. ``of`` (doc_id, version) leaves only those, before anything is grouped."""
        rows = self.ledger()
        if of is not None:
            k = of.select(F.col("doc_id").alias("__d"), F.col("version").alias("__v")).distinct()
            rows = rows.join(k, rows["doc_id"].eqNullSafe(k["__d"]) & (rows["version"] == k["__v"]), "left_semi")
        return (rows.groupBy("doc_id", "version", "source", "lang")
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0"))

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches; empty groups are left out."""
        return (self._part("delta", _DELTA).groupBy(*KEYS)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"))

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, op, source, lang, tokens); False if the batch was applied before.

        ``op`` is ``insert`` or ``revise`` (the batch's rows become the document's rows for that version, whatever it had)
        or ``delete`` (source, lang and tokens are not looked at). If a batch names a document and version more than
        once, deletes are applied first and all its other rows count; so do rows with a null doc_id, which are one
        document. An optional column ``docs`` says how many rows a row stands for, with ``tokens`` their sum (null: 1).
        Rows without version, or with another op, are refused before anything is written. A null count is 0; null
        sources and languages are groups of their own. Deleting what isn't there changes nothing.
        """
        if self.committed(batch_id):
            return False
        docs = F.coalesce(F.col("docs").cast("long"), F.lit(1)) if "docs" in changes.columns else F.lit(1).cast("long")
        rows = changes.select(F.col("doc_id").cast("long"), F.col("version").cast("string"), "op",
                              F.col("source").cast("string"), F.col("lang").cast("string"), docs.alias("docs"),
                              F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
        wrong = rows.where("version is null or op is null or op not in ('insert', 'revise', 'delete')").limit(1).count()
        if wrong:
            raise ValueError("changes hold rows without version or a known op")
        # a hot document's rows combine before the shuffle: one row per source and language is left
        new = (rows.where("op <> 'delete'").groupBy("doc_id", "version", "source", "lang")
               .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        old = self.present(of=rows).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
        signed = old.unionByName(new)
        at = f"{self.path}/{{}}/batch_id={int(batch_id)}"
        signed.write.mode("overwrite").parquet(at.format("ledger"))
        written = self.spark.read.schema(_LEDGER).parquet(at.format("ledger"))
        delta = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(at.format("delta"))
        self.spark.range(1).select(F.lit(int(batch_id)).cast("long").alias("at")).coalesce(1).write.mode(
            "overwrite").parquet(at.format("commits"))
        return True


def later_copies(docs: DataFrame, text_hash: str) -> DataFrame:
    """doc_ids whose text another row with a smaller doc_id has as well (hashes stand for texts)."""
    least = docs.groupBy(text_hash).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return docs.join(least, text_hash).where(F.col("doc_id") > F.col("least")).select("doc_id")
