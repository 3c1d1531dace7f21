"""Topic models over a text column: lda, lsi, nmf, rp. Each returns per-document topic weights
``(id, topic, weight)`` (long form).

Words are runs of letters and digits of any script, lower-cased, without stop words and words of one character.
Every word of the whole text counts: there is no vocabulary list on the driver and, unless ``min_df`` or
``max_terms`` ask for it, no cut. All work on the sparse count matrix in blocks of documents (``Counts``): a product
sends a block the factor's rows of its own terms, once each, and takes back one row a term, so what is shuffled
grows with the blocks' vocabularies and not with the counts. Only k x k matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark import TaskContext
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import stored

WORD_GAP = r"[^\p{L}\p{N}]+"


def words(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(id, words)``: the words of every document, without stop words; none for a null text."""
    plain = df.select(id_col, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    tok = RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=WORD_GAP, minTokenLength=2)
    return StopWordsRemover(inputCol="__tok", outputCol="words").transform(tok.transform(plain)).select(id_col, "words")


def term_counts(df: DataFrame, text: str, id_col: str, min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """``(doc, term, n)`` of all documents. ``min_df`` and ``max_terms`` cut rare terms, if asked for."""
    n = (words(df, text, id_col).select(F.col(id_col).alias("doc"), F.explode("words").alias("term"))
         .groupBy("doc", "term").agg(F.count(F.lit(1)).cast("double").alias("n")))
    if min_df > 1 or max_terms is not None:
        keep = n.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
        if max_terms is not None:
            keep = keep.orderBy(F.desc("df"), "term").limit(max_terms)
        n = n.join(keep, "term", "left_semi")
    return n.select("doc", "term", "n")


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """``(doc, term, w)`` with w = n log((documents + 1) / (documents with the term + 1)), zeros left out."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (counts.join(df, "term").select("doc", "term", (F.col("n") * F.log((n_docs + 1) / (F.col("df") + 1))).alias("w"))
            .where("w <> 0"))


def _uniform(key: Column, j: int, seed: int) -> Column:
    """Hash of a key to (0, 1)."""
    return (F.pmod(F.xxhash64(key, F.lit(j), F.lit(seed)), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))


def _normal(key: Column, j: int, seed: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(key, j, seed))) * F.cos(2 * np.pi * _uniform(key, j, seed + 1))


BLOCK_WORDS = 8_000_000  # words of a block at most, about
SMALL = -(1 << 62)  # keys of the rows of a small matrix count from here


class Counts:
    """The counts of all documents, in blocks.

    ``rows``: (b, at, doc, key, cols, ns), a document's terms by their position in the block, and their counts; ``terms``:
    (term, key, df); ``uses``: (b, at, key), the terms (key >= 0) and documents (key < 0) of a block by position.
    Documents that share an id are one row. The blocks are cut where the text is read; but for documents that share an
    id no text is shuffled.
    """

    def __init__(self, df: DataFrame, text: str, id_col: str):
        found = words(df, text, id_col).select(F.col(id_col).alias("doc"), "words")
        again = stored(df.groupBy(F.col(id_col).alias("again")).agg(F.count(F.lit(1)).alias("rows"))
                       .where("rows > 1").select("again"))
        same = F.col("doc").eqNullSafe(F.col("again"))
        kind = f"doc {df.schema[id_col].dataType.simpleString()}"
        schema = f"b long, at int, {kind}, cols array<int>, ns array<int>, first int, fresh array<string>, docs array<int>"
        if again.isEmpty():
            cut = found.mapInArrow(_cut_blocks(), schema)
        else:
            merged = (found.join(again, same, "left_semi").select("doc", F.explode("words").alias("term"))
                      .groupBy("doc", "term").agg(F.count(F.lit(1)).cast("int").alias("n"))
                      .groupBy("doc").agg(F.collect_list(F.struct("term", "n")).alias("s"))
                      .select("doc", F.col("s.term").alias("words"), F.col("s.n").alias("ns")))
            cut = (found.join(again, same, "left_anti").mapInArrow(_cut_blocks(), schema)
                   .withColumn("b", F.col("b") * 2).unionByName(
                       merged.mapInArrow(_cut_blocks(), schema).withColumn("b", F.col("b") * 2 + 1)))
        table = stored(cut.withColumn("key", -1 - F.monotonically_increasing_id()))
        self.rows = table.select("b", "at", "doc", "key", "cols", "ns").where(F.size("cols") > 0)
        uses = table.select("b", "first", F.posexplode(F.arrays_zip("fresh", "docs")).alias("p", "s")).select(
            "b", (F.col("first") + F.col("p")).alias("at"), F.col("s.fresh").alias("term"), F.col("s.docs").alias("docs"))
        self.terms = stored(uses.groupBy("term").agg(F.sum("docs").alias("df"))
                            .withColumn("key", F.monotonically_increasing_id()))
        self.uses = stored(uses.join(self.terms.select("term", "key"), "term").select("b", "at", "key").unionByName(
            self.rows.select("b", "at", "key")))

    def each(self, state: DataFrame, k: int, work: Callable[[Block], Iterator], schema: str) -> DataFrame:
        """What ``work`` makes of every block; ``state`` (key, v) has the rows of terms and documents that it reads."""
        import pandas as pd
        vs = [F.col("v")[j].alias(f"v{j}") for j in range(k)]
        side = self.uses.join(state, "key").select(F.col("b").alias("of"), "at", "key", *vs)

        def block(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({c: [] for c in names})
            return pd.concat([pd.DataFrame(dict(zip(names, part, strict=True))) for part in work(Block(rows, given, k))])

        names = [c.split()[0] for c in schema.split(", ")]
        return self.rows.groupBy("b").cogroup(side.groupBy("of")).applyInPandas(block, schema)

    def sums(self, state: DataFrame, k: int, work: Callable[[Block], Iterator]) -> DataFrame:
        """(key, v), stored: what ``work`` gives for terms, documents and the rows of a small matrix, summed by key."""
        vs = [f"v{j}" for j in range(k)]
        parts = self.each(state, k, work, ", ".join(["key long", *[f"{v} double" for v in vs]]))
        return stored(parts.groupBy("key").agg(*[F.sum(v).alias(v) for v in vs]).select("key", F.array(*vs).alias("v")))

    def idf(self, n_docs: int) -> DataFrame:
        """``(key, term, idf)``: log((documents + 1) / (documents with the term + 1))."""
        return self.terms.select("key", "term", F.log((n_docs + 1) / (F.col("df") + 1)).alias("idf"))

    def named(self, state: DataFrame) -> DataFrame:
        """(doc, v) of the documents in ``state``."""
        return state.where("key < 0").join(self.rows.select("key", "doc"), "key").select("doc", "v")


class Block:
    """One block in a task: entry i is ``n[i]`` times term ``col[i]`` in document ``row[i]``. ``keys`` and ``x`` belong to
    the terms, ``docs``, ``doc_keys`` and ``own`` to the documents."""

    def __init__(self, rows, given, k: int):
        self.docs, self.doc_keys, at = rows["doc"], rows["key"].to_numpy(), rows["at"].to_numpy()
        self.row = np.repeat(np.arange(len(rows)), [len(c) for c in rows["cols"]])
        self.col, self.n = np.concatenate(rows["cols"].to_numpy()), np.concatenate(rows["ns"].to_numpy()).astype(float)
        given_at, key = given["at"].to_numpy(), given["key"].to_numpy()
        values = given[[f"v{j}" for j in range(k)]].to_numpy(float)
        term = key >= 0
        width = max(int(self.col.max()), int(given_at[term].max(initial=0))) + 1
        self.x, self.keys = np.zeros((width, k)), np.full(width, -1, dtype=np.int64)
        self.x[given_at[term]], self.keys[given_at[term]] = values[term], key[term]
        place = np.full(max(int(at.max()), int(given_at[~term].max(initial=0))) + 1, len(rows))
        place[at] = np.arange(len(rows))
        self.own = np.zeros((len(rows) + 1, k))  # the last for documents that were left out
        self.own[place[given_at[~term]]] = values[~term]
        self.own = self.own[:-1]

    def by_doc(self, weights: Iterable[np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount(self.row, w, len(self.docs)) for w in weights], axis=1)

    def by_term(self, weights: Iterable[np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount(self.col, w, len(self.keys)) for w in weights], axis=1)

    def times(self, x: np.ndarray) -> np.ndarray:
        """The block times a factor of its terms."""
        return self.by_doc(self.n * x[self.col, j] for j in range(x.shape[1]))

    def turned(self, y: np.ndarray) -> np.ndarray:
        """The transposed block times a factor of its documents."""
        return self.by_term(self.n * y[self.row, j] for j in range(y.shape[1]))

    def term_part(self, z: np.ndarray) -> tuple:
        have = self.keys >= 0
        return self.keys[have], *z[have].T

    def doc_part(self, y: np.ndarray) -> tuple:
        return self.doc_keys, *y.T

    def small_part(self, g: np.ndarray) -> tuple:
        return SMALL + np.arange(len(g)), *g.T


def _cut_blocks() -> Callable:
    """Arrow batches (doc, words, any ``ns``: the words' counts, each word once) to rows of blocks. A document brings the
    terms that none before it in the block had (``fresh``, from position ``first`` on)."""
    limit = BLOCK_WORDS

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        number = TaskContext.get().partitionId() << 32

        def gathered():
            some, size = [], 0
            for batch in batches:
                some.append(batch)
                size += pc.sum(pc.list_value_length(batch.column(1))).as_py() or 0
                if size >= limit:
                    yield pa.concat_batches(some)
                    some, size = [], 0
            if some:
                yield pa.concat_batches(some)

        for whole in gathered():
            sizes = np.asarray(pc.list_value_length(whole.column(1)))
            piece = np.cumsum(sizes) // (2 * limit)
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(sizes)], strict=True):
                batch = whole.slice(lo, hi - lo)
                coded = batch.column(1).flatten().dictionary_encode()
                codes, terms = np.asarray(coded.indices).astype(np.int64), coded.dictionary
                ends = np.cumsum(sizes[lo:hi])
                row, width = np.repeat(np.arange(hi - lo), sizes[lo:hi]), max(len(terms), 1)
                key, where, n = np.unique(row * width + codes, return_index=True, return_counts=True)
                if batch.num_columns > 2:
                    n = np.asarray(batch.column(2).flatten())[where]
                col = (key % width).astype(np.int32)
                # codes are given in the order of first sight: those seen up to a row's end
                seen = np.concatenate([[0], np.maximum.accumulate(codes) + 1])[ends]
                entries = np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=hi - lo))])

                def lists(ends_, values):
                    return pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), values)
                fresh = np.concatenate([[0], seen])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(hi - lo, number)), pa.array(np.arange(hi - lo), pa.int32()), batch.column(0),
                    lists(entries, pa.array(col)), lists(entries, pa.array(n.astype(np.int32))),
                    pa.array(fresh[:-1], pa.int32()), lists(fresh, terms),
                    lists(fresh, pa.array(np.bincount(col, minlength=len(terms)).astype(np.int32)))],
                    names=["b", "at", "doc", "cols", "ns", "first", "fresh", "docs"])
                number += 1
    return cut


def _small(table: DataFrame, k: int) -> np.ndarray:
    """The small matrix (at most k rows) in a table of sums."""
    out = np.zeros((k, k))
    for r in table.where(F.col("key") < SMALL + k).collect():
        out[r["key"] - SMALL] = r["v"]
    return out


def _scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda z: z * by)


def _scores(counts: Counts, id_type: str, factor: DataFrame, k: int) -> DataFrame:
    """``(doc, v)``: the documents' rows of the counts times a factor (key, v)."""
    def work(m: Block):
        yield m.docs.to_numpy(), *m.times(m.x).T
    vs = [f"v{j}" for j in range(k)]
    return counts.each(factor, k, work, ", ".join([f"doc {id_type}", *[f"{v} double" for v in vs]])).select(
        "doc", F.array(*vs).alias("v"))


def _gram(factor: DataFrame, k: int) -> np.ndarray:
    r = factor.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g


def _times(v: Column, m: np.ndarray) -> Column:
    """Row array x a small matrix."""
    return F.array(*[sum((v[i] * F.lit(float(m[i, j])) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])])


def _long(df: DataFrame, id_col: str, found: DataFrame, k: int, empty: float = 0.0) -> DataFrame:
    """Every row's weights; documents without any term get ``empty`` for each topic."""
    zeros = F.array(*[F.lit(empty)] * k)
    ids = df.select(F.col(id_col).alias("__id"))
    return (ids.join(found.select(F.col("doc").alias("__doc"), "v"), F.col("__id").eqNullSafe(F.col("__doc")), "left")
            .select(F.col("__id").alias(id_col), F.posexplode(F.coalesce("v", zeros)).alias("topic", "weight")))


def lda_topics(df: DataFrame, text: str, id_col: str, k: int = 4, max_iter: int = 20, seed: int = 42,
               doc_prior: float | None = None, term_prior: float = 1.1):
    """Latent Dirichlet allocation by expectation-maximisation (MAP) on the sparse (document, term, count) table.

    Every word is a row of its own in the distributed term table. A round brings each count its document's and its
    term's topic weights (in blocks, see ``Counts``), deals it to the topics in proportion to (document + prior - 1) x (term + prior - 1) / (topic +
    terms x (prior - 1)), and sums the parts by document and by term; only the k topic totals reach the driver. The
    start is drawn from hashes of document and term. ``doc_prior`` is 50 / k + 1 unless given.

    Returns each document's topic shares (without any word: equal ones) and the ten heaviest terms of every topic:
    topic, rank, term, weight (ties: by term).
    """
    alpha, eta = (50.0 / k if doc_prior is None else doc_prior - 1.0), term_prior - 1.0
    ps = [f"p{j}" for j in range(k)]
    both = F.concat_ws("|", F.col("doc").cast("string"), "term")
    named = df.where(F.col(id_col).isNotNull())
    counts = Counts(named, text, id_col)

    # the start deals every occurrence by the hash of its document and term
    drawn = (words(named, text, id_col).select(F.col(id_col).alias("doc"), F.explode("words").alias("term"))
             .select("doc", "term", *[_uniform(both, j, seed).alias(p) for j, p in enumerate(ps)]))
    share = reduce(lambda x, y: x + y, [F.col(p) for p in ps])
    summed = [F.sum(F.col(p) / share).alias(p) for p in ps]
    by_term = drawn.groupBy("term").agg(*summed).join(counts.terms.select("term", "key"), "term")
    by_doc = drawn.groupBy("doc").agg(*summed).join(counts.rows.select("doc", "key"), "doc")
    state = stored(by_term.select("key", F.array(*ps).alias("v")).unionByName(by_doc.select("key", F.array(*ps).alias("v"))))
    n_terms = counts.terms.count()
    for _ in range(max_iter):
        total = state.where("key >= 0").agg(
            *[F.coalesce(F.sum(F.col("v")[j]), F.lit(0.0)).alias(p) for j, p in enumerate(ps)]).first()
        scale = np.array([total[p] for p in ps]) + n_terms * eta

        def dealt(m: Block, scale=scale):
            y, x = m.own + alpha, (m.x + eta) / scale
            parts = [y[m.row, j] * x[m.col, j] for j in range(k)]
            share = m.n / sum(parts)
            parts = [p * share for p in parts]
            yield m.doc_part(m.by_doc(parts))
            yield m.term_part(m.by_term(parts))
        state = counts.sums(state, k, dealt)
    by_doc = counts.named(state).withColumnRenamed("v", "dv")
    by_term = state.where("key >= 0").join(counts.terms.select("key", "term"), "key").select("term", F.col("v").alias("tv"))
    whole = F.aggregate("dv", F.lit(0.0), lambda acc, x: acc + x + F.lit(alpha))
    shares = by_doc.select("doc", F.transform("dv", lambda x: (x + F.lit(alpha)) / whole).alias("v"))
    top = [by_term.select(F.lit(j).alias("topic"), "term", F.col("tv")[j].alias("weight"))
           .orderBy(F.desc("weight"), "term").limit(10) for j in range(k)]
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term")) - 1  # ten rows a topic
    terms = reduce(DataFrame.unionByName, top).withColumn("rank", rank).select("topic", "rank", "term", "weight")
    return _long(df, id_col, shares, k, 1.0 / k), terms


def lsi_topics(df: DataFrame, text: str, id_col: str, k: int = 4, seed: int = 42, rounds: int = 4):
    """Rank-k singular value decomposition of the tf-idf matrix by subspace iteration: document weights are U S.

    Each round multiplies by the matrix and its transpose; the subspace (k + 6 wide) is made orthonormal by its Gram
    matrix's Cholesky factor. Signs: the largest weight of every topic is positive.
    """
    counts, wide = Counts(df, text, id_col), k + 6
    idf = counts.idf(df.count())
    weight = idf.select("key", "idf")
    x = idf.where("idf <> 0").select("key", "idf", F.array(*[_normal(F.col("term"), j, seed) for j in range(wide)]).alias("v"))

    def there_and_back(m: Block):
        y = m.times(m.x)
        yield m.small_part(y.T @ y)
        y[m.docs.isna().to_numpy()] = 0.0
        yield m.term_part(m.turned(y))
    for _ in range(rounds):
        # (A^T y) W is A^T (y W): one pass makes y, its Gram matrix and A^T y
        z = counts.sums(x.select("key", _scaled(F.col("v"), F.col("idf")).alias("v")), wide, there_and_back)
        x = z.join(weight, "key").withColumn("v", _times(_scaled(F.col("v"), F.col("idf")), _whiten(_small(z, wide))))
        x = x.withColumn("v", _times(F.col("v"), _whiten(_gram(x, wide))))
    x = x.select("key", _scaled(F.col("v"), F.col("idf")).alias("v"))
    y = stored(_scores(counts, df.schema[id_col].dataType.simpleString(), x, wide))
    vals, vecs = np.linalg.eigh(_gram(y, wide))
    turn = vecs[:, np.argsort(-vals)[:k]]
    scores = y.select("doc", _times(F.col("v"), turn).alias("v"))
    ends = scores.agg(*[F.max_by(F.col("v")[j], F.abs(F.col("v")[j])).alias(f"m{j}") for j in range(k)]).first()
    sign = np.diag([-1.0 if (ends[f"m{j}"] or 0) < 0 else 1.0 for j in range(k)])
    return _long(df, id_col, y.select("doc", _times(F.col("v"), turn @ sign).alias("v")), k)


def _whiten(gram: np.ndarray) -> np.ndarray:
    """Matrix that makes columns with this Gram matrix orthonormal (null directions go to zero)."""
    vals, vecs = np.linalg.eigh(gram)
    inv = np.where(vals > 1e-12 * max(vals.max(), 1e-300), 1 / np.sqrt(np.clip(vals, 1e-300, None)), 0.0)
    return vecs * inv


def nmf_topics(df: DataFrame, text: str, id_col: str, k: int = 4, max_iter: int = 15, seed: int = 42):
    """Non-negative factors of the count matrix (absent terms are zeros) by multiplicative updates."""
    counts = Counts(df, text, id_col)
    start = lambda key, s: F.array(*[_uniform(F.col(key), j, s) for j in range(k)]).alias("v")
    w = counts.rows.select("key", "doc", start("doc", seed))
    h = stored(counts.terms.select("key", start("term", seed + 7)))
    of_w = _gram(w, k)
    counts.rows = counts.rows.where(F.col("doc").isNotNull())
    tiny = 1e-12

    def first(m: Block):
        yield m.term_part(m.turned(m.own))
    w = w.where(F.col("doc").isNotNull()).select("key", "v")
    sums = counts.sums(h.unionByName(w), k, first)
    for _ in range(max_iter):
        down = _times(F.col("v"), of_w)
        h = stored(h.join(sums.select("key", F.col("v").alias("top")), "key").select(
            "key", F.transform(F.arrays_zip(F.col("v"), F.col("top"), down.alias("down")),
                               lambda z: z["v"] * z["top"] / (z["down"] + F.lit(tiny))).alias("v")))
        of_h = _gram(h, k)

        def update(m: Block, of_h=of_h):
            y = m.own * m.times(m.x) / (m.own @ of_h + tiny)
            yield m.doc_part(y)
            yield m.small_part(y.T @ y)
            yield m.term_part(m.turned(y))
        sums = counts.sums(h.unionByName(w), k, update)
        w, of_w = sums.where((F.col("key") < 0) & (F.col("key") >= SMALL + k)), _small(sums, k)
    return _long(df, id_col, counts.named(w), k)


def random_projection(df: DataFrame, text: str, id_col: str, k: int = 4, seed: int = 42):
    """tf-idf x a Gaussian matrix that is drawn from each term's hash."""
    counts = Counts(df, text, id_col)
    drawn = F.array(*[_normal(F.col("term"), j, seed) / F.lit(k ** 0.5) * F.col("idf") for j in range(k)]).alias("v")
    factor = counts.idf(df.count()).select("key", drawn)
    found = _scores(counts, df.schema[id_col].dataType.simpleString(), factor, k)
    return _long(df, id_col, found, k)


TOPIC_MODELS = {"lda": lambda d, t, i, **kw: lda_topics(d, t, i, **kw)[0], "lsi": lsi_topics, "nmf": nmf_topics,
                "rp": random_projection}
