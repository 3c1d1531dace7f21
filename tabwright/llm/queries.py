"""Registered queries of the operators, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    """The byte-level BPE vocabulary file of the public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op10_token_output")
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back: doc_id, start, n_tokens, ids_crc32."""
    from tabwright.llm.token_codec import token_output
    return token_output(table(spark, sf_dir, "documents"), bpe_path(), end_id=0)


@register("op8_simhash_vptree")
def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: doc_id, fingerprint, component_id, kept."""
    from tabwright.llm.simhash_vptree import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2, seed=42).drop("fp", "group")


@register("op4_toxicity_nb")
def op4_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted (score >= 0.3)."""
    from tabwright.llm import toxicity_nb as T
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = T.train(docs, table(spark, sf_dir, "labels"), ~T.held_out())
    return T.score(docs, model, 0.3).select("doc_id", T.held_out().alias("held_out"), "score", "predicted")


@register("op6_html_template")
def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages: page_id, url, text, n_chars."""
    from tabwright.llm.html_template import extract
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))\
        .select("page_id", "url", "text", "n_chars")


@register("op1_embedding_lattice")
def op1_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of equal labels at cosine 0.93: vec_id, n_links, component_id, kept."""
    from tabwright.llm.embedding_lattice import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


@register("op5_packing_nnls")
def op5_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens: a row per piece."""
    from tabwright.llm.packing_nnls import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), bpe_path(), window=2048, end_id=1, with_ids=False)


@register("op9_hilbert_shards")
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along a Hilbert curve, row counts at most one apart."""
    from tabwright.llm.hilbert_shards import shard
    return shard(table(spark, sf_dir, "documents"), shards=16)


@register("op7_decontam_template")
def op7_decontam_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template: doc_id, item_id, covered, item_words, doc_place, n_slots,
    exact."""
    from tabwright.llm.decontam_template import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True)


def _license_sql() -> str:
    from tabwright.llm.license_dice import scan_sql
    return scan_sql()


@register("op3_license_dice", _license_sql())
def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents: doc_id, license, dice, segment_words, n_segments."""
    from tabwright.llm.license_dice import scan
    return scan(table(spark, sf_dir, "documents"))


@register("op2_token_rollup")
def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after four commits: source, lang, version, docs, tokens.

    Batch 1 inserts every document's count; batch 2 deletes the later copies of equal texts; batch 3 adds a second
    tokenizer version, which ends documents with one more token, for the documents left; batch 4 revises the first
    version's count of documents without a token to that of the empty document, 1. Batch 2 is sent twice.
    """
    from pyspark.sql import functions as F

    from tabwright.llm.common import shared_path, written
    from tabwright.llm.token_rollup import Rollup, count_tokens, later_copies
    first, second = "byte_bpe_50k", "byte_bpe_50k+end"
    docs = written(count_tokens(table(spark, sf_dir, "documents"), bpe_path()).select(
        "doc_id", "source", "lang", F.xxhash64("text").alias("h"), "n_tokens"), "token-counts")
    rollup = Rollup(spark, shared_path(spark, "token-rollup"))
    rows = docs.select("doc_id", F.lit(first).alias("version"), F.lit("insert").alias("op"), "source", "lang",
                       F.col("n_tokens").alias("tokens"))
    rollup.commit(1, rows)
    gone = later_copies(docs, "h").select(
        "doc_id", F.lit(first).alias("version"), F.lit("delete").alias("op"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("tokens", "long"))])
    rollup.commit(2, gone)
    rollup.commit(2, gone)
    rollup.commit(3, rollup.present().select(
        "doc_id", F.lit(second).alias("version"), F.lit("insert").alias("op"), "source", "lang", "docs",
        (F.col("tokens") + F.col("docs")).alias("tokens")))
    # all rows of the ids that have a row without a token and were not deleted
    counts = docs.groupBy("doc_id", "source", "lang").agg(
        F.count("*").alias("docs"), F.sum(F.greatest("n_tokens", F.lit(1))).alias("tokens"),
        F.min("n_tokens").alias("least"))
    empty = counts.where("least = 0").select("doc_id", F.lit(first).alias("version"))
    k = rollup.present(of=empty).where(F.col("version") == first).select(F.col("doc_id").alias("__d")).distinct()
    rollup.commit(4, counts.join(k, counts["doc_id"].eqNullSafe(k["__d"]), "left_semi").select(
        "doc_id", F.lit(first).alias("version"), F.lit("revise").alias("op"), "source", "lang", "docs", "tokens"))
    return rollup.totals()


def _merkle_sql() -> str:
    from tabwright.llm.merkle_manifest import manifest_sql
    return manifest_sql()


@register("op11_merkle_octopus", _merkle_sql())
def op11_merkle_octopus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, some handed over with lower-cased texts: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified."""
    from tabwright.llm.merkle_manifest import lowered_where, manifest
    return manifest(table(spark, sf_dir, "documents"), presented=lowered_where("doc_id"))


def _collocations_sql() -> str:
    from tabwright.llm.collocations import collocations_sql
    return collocations_sql()


@register("op12_collocations_son", _collocations_sql())
def op12_collocations_son(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of all documents: lang, rank, phrase, a, l, r, n, score."""
    from tabwright.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


@register("op13_order_minhash")
def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    from tabwright.llm.order_minhash import edits
    return edits(table(spark, sf_dir, "documents"))
