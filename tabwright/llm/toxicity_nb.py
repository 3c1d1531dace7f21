"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Text is lower-cased, everything but letters and digits becomes a space, runs of spaces become one, and a space
is put around the text. Features are the n-grams of 4 to 6 characters of the whole text, hashed to 2**21
buckets, present or not. Training, on labelled rows only:

1. Spark counts, for every bucket, the toxic and the other training documents that have it (sparse partial counts
   per task, one aggregation by bucket).
2. The naive Bayes log-count ratio of a bucket is drawn towards zero by ``ERRORS`` standard errors, or not at all if
   the labels are so few that no bucket would be left.
3. A logistic regression on the scaled features is fitted on at most ``FIT_ROWS`` training documents that were
   not counted in step 1 (a third of them by hash, the lowest hashes first; all others are counted). This bounded
   sample is the only thing the driver receives beside the at most 2**21 ratios, as lists of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import cut_lineage

BITS = 21
ORDERS = (4, 5, 6)
FIT_ROWS = 8_000           # bound of the sample that the regression is fitted on
BROADCAST_LABELS = 2_000_000  # labelled rows that may be broadcast; more are joined by a shuffle
ERRORS = 2.0               # standard errors taken off a log-count ratio
L2 = 1e-4
_CHUNK = 1_000_000         # characters worked on together (one text is never cut)
_FIT_ENTRIES = 200_000     # entries of the regression's matrix worked on together


def _characters() -> np.ndarray:
    """Lower-case letters and digits as they are, the rest a space (from U+3000 on everything is kept)."""
    out = np.full(0x3000, 32, np.uint32)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_TABLE: list[np.ndarray] = []


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters of the texts, one after the other, and where each starts (and the last ends)."""
    if not _TABLE:
        _TABLE.append(_characters())
    joined = " " + " \0 ".join(texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 3)
    codes = np.where(raw < 0x3000, _TABLE[0].take(np.minimum(raw, 0x2FFF)), raw)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    # a text's border "space, zero, space": the first space closes it, the zero (now a space) opens the next
    keep[ends[:-1] - 1] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    starts = np.concatenate([[0], ends[:-1] - 1])
    return codes[keep], np.concatenate([at[starts], [at[-1]]])


def _buckets(codes: np.ndarray):
    """(order, bucket at every position) for each n-gram length."""
    h = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1:]
        if n in ORDERS:
            yield n, ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _chunks(texts):
    """Lists of texts of about ``_CHUNK`` characters."""
    held, chars = [], 0
    for t in texts:
        held.append(t or "")
        chars += len(held[-1])
        if chars >= _CHUNK:
            yield held
            held, chars = [], 0
    if held:
        yield held


_PLACE: list[np.ndarray] = []


def _hits(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct bucket with a weight in each text, text by text."""
    if not _PLACE:
        _PLACE.append(np.empty(1 << BITS, np.int32))
    pos = _PLACE[0]
    codes, starts = _codes(texts)
    orders = []
    for n, b in _buckets(codes):
        at = np.flatnonzero(weights.take(b))
        lo = np.searchsorted(at, starts[:-1])
        hi = np.maximum(lo, np.searchsorted(at, starts[1:] - n + 1))
        orders.append((b.take(at).astype(np.int32), lo.tolist(), hi.tolist()))
    found = []
    for j in range(len(texts)):
        own = np.concatenate([b[lo[j]:hi[j]] for b, lo, hi in orders]) if orders else np.zeros(0, np.int32)
        place = np.arange(len(own), dtype=np.int32)
        pos[own] = place  # the last place of a bucket stays
        found.append(own[pos[own] == place])
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    return doc, np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass
class ToxicityModel:
    bias: float
    buckets: np.ndarray  # with a weight, ascending
    weights: np.ndarray
    ratios: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.buckets] = self.weights
        return _scores(texts, dense, self.bias)


def _scores(texts, dense: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for part in _chunks(texts):
        doc, bucket = _hits(part, dense)
        total = np.bincount(doc, dense.take(bucket).astype(np.float64), len(part)) + bias
        out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def _fit(starts: np.ndarray, buckets: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression (L2) by accelerated gradient steps; row i has buckets[starts[i]:starts[i + 1]], each with its
    bucket's scale as value. Entries are worked on a block of rows at a time."""
    n, d = len(y), len(scale)
    w, bias = np.zeros(d), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not d:
        return w, bias
    size = np.diff(starts)
    filled = np.flatnonzero(size)
    entries = np.cumsum(size[filled])
    cuts = np.unique(np.concatenate([np.searchsorted(entries, np.arange(0, entries[-1], max(_FIT_ENTRIES, 2 * d))),
                                     [len(filled)]])).tolist()
    blocks = []  # rows with entries, their buckets, where each row's begin, and how many they are
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = filled[a:b]
        blocks.append((own, buckets[starts[own[0]]:starts[own[-1] + 1]], starts[own] - starts[own[0]], size[own]))

    def forward(v: np.ndarray) -> np.ndarray:
        v, z = v * scale, np.zeros(n)
        for own, x, at, _ in blocks:
            z[own] = np.add.reduceat(v.take(x), at)
        return z

    def backward(r: np.ndarray) -> np.ndarray:
        g = np.zeros(d)
        for own, x, _, m in blocks:
            g += np.bincount(x, np.repeat(r[own], m), d)
        return g * scale

    # a bound on the curvature from the matrix itself: a few power iterations
    v = np.ones(d) / np.sqrt(d)
    for _ in range(20):
        u = backward(forward(v))
        size = np.linalg.norm(u)
        if not size:
            break
        v = u / size
    step = 1 / (0.25 * size * 1.1 / n + L2) if size else min(4 / (forward(scale).max() + 1), 1.0)
    look, look_b, t = w.copy(), bias, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(forward(look) + look_b, -500, 500)))
        g = backward(p - y) / n + L2 * look
        new, new_b = look - step * g, look_b - 2.0 * (p - y).mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t_new * (new - w), new_b
        w, bias, t = new, new_b, t_new
    return w, bias


def _packed(ratios: DataFrame) -> list[tuple[bytes, bytes]]:
    """The rows (bucket, r), at most 2**21, as a pair of arrays' bytes from each task that has any."""
    def pack(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([p[k] for p in parts]).tobytes()], pa.binary())
                                              for k in (0, 1)], ["buckets", "r"])

    return [(bytes(b), bytes(r)) for b, r in ratios.mapInArrow(pack, "buckets binary, r binary").collect()]


def train(docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic") -> ToxicityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, ``label`` 0/1); ``train_rows`` is a condition on
    doc_id. Null labels and ids are left out; of repeated labels the larger counts; null texts are empty. Without
    labelled rows the score is 0 throughout; with one class only it is that class's smoothed share."""
    known = (labels.where(train_rows & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    known = cut_lineage(known.select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
                        .withColumn("fit", F.pmod("h", F.lit(3)) == 0))
    n_known, n_fit, classes, fit_classes = known.agg(
        F.count("*"), F.count(F.when(F.col("fit"), 1)), F.countDistinct("y"),
        F.countDistinct(F.when(F.col("fit"), F.col("y")))).first()
    if not n_known:
        return ToxicityModel(-500.0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if fit_classes < classes:  # few labels: the same rows are counted and fitted
        n_fit, counted = 0, known
        fit = known
    else:
        fit, counted = known.where("fit"), known.where("not fit")
    fit = cut_lineage(fit.orderBy("h", "doc_id").limit(FIT_ROWS).select("doc_id", "y"))
    if n_fit > FIT_ROWS:
        counted = known.join(F.broadcast(fit.select("doc_id")), "doc_id", "left_anti")

    def partial(batches):
        pos = np.zeros(1 << BITS, np.int32)
        counts = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
        for pdf in batches:
            labels_of = iter(pdf["y"].tolist())
            for part in _chunks(pdf["text"]):
                codes, starts = _codes(part)
                y = [next(labels_of) for _ in part]
                for n, b in _buckets(codes):
                    for j, k in enumerate(y):
                        own = b[starts[j]:max(starts[j], starts[j + 1] - n + 1)]
                        place = np.arange(len(own), dtype=np.int32)
                        pos[own] = place
                        counts[k][own[pos[own] == place]] += 1
        at = np.flatnonzero(counts[0] + counts[1])
        yield pd.DataFrame({"bucket": at, "toxic": counts[1][at].astype(np.int64),
                            "other": counts[0][at].astype(np.int64)})

    def joined(some: DataFrame, n: int) -> DataFrame:
        return texts.join(F.broadcast(some) if n <= BROADCAST_LABELS else some, "doc_id")

    totals = {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    ratio = np.zeros(1 << BITS)
    if n1 and n0:
        a, b = F.col("toxic") + 1.0, F.col("other") + float(n0 / n1)
        raw = F.log(a / float(n1 + 2)) - F.log(b / float(n0 * (1 + 2 / n1)))
        seen = (joined(counted.select("doc_id", "y"), n_known - min(n_fit, FIT_ROWS)).select("text", "y")
                .mapInPandas(partial, "bucket long, toxic long, other long")
                .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
                .select("bucket", raw.alias("r"), (F.abs(raw) - ERRORS * F.sqrt(1 / a + 1 / b)).alias("left")))
        kept = _packed(seen.where("left > 0").select("bucket", (F.signum("r") * F.col("left")).alias("r")))
        for buckets, r in kept or _packed(seen.select("bucket", "r")):
            ratio[np.frombuffer(buckets, "<i8")] = np.frombuffer(r, "<f8")
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def features(batches):
        for pdf in batches:
            y, lists = pdf["y"].tolist(), []
            for part in _chunks(pdf["text"]):
                doc, bucket = _hits(part, shared.value)
                lists += np.split(bucket, np.searchsorted(doc, np.arange(1, len(part))))
            yield pd.DataFrame({"y": y, "buckets": [x.astype("<i4").tobytes() for x in lists]})

    sample = (joined(fit, FIT_ROWS).select("text", "y")
              .mapInPandas(features, "y int, buckets binary").collect())
    if not sample:
        return ToxicityModel(-500.0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    # one order whatever the partitions gave
    lists = sorted((k, bytes(b)) for k, b in sample)
    y = np.array([k for k, _ in lists], np.float64)
    starts = np.concatenate([[0], np.cumsum([len(b) // 4 for _, b in lists])])
    column = np.frombuffer(bytearray().join([b for _, b in lists]), "<i4")
    del sample, lists
    number = np.zeros(1 << BITS, np.int32)
    number[column] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used))
    for lo in range(0, len(column), _FIT_ENTRIES):
        column[lo:lo + _FIT_ENTRIES] = number[column[lo:lo + _FIT_ENTRIES]]
    w, bias = _fit(starts, column, ratio[used], y)
    return ToxicityModel(bias, used, w * ratio[used], ratio[used])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; empty and null texts get the bias alone) and ``predicted`` (score >= threshold)
    appended; the model, at most 2**21 weights, is broadcast. Columns of those names are replaced."""
    dense = np.zeros(1 << BITS, np.float32)
    dense[model.buckets] = model.weights
    shared, bias = docs.sparkSession.sparkContext.broadcast(dense), model.bias

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(texts, shared.value, bias))

    return (docs.withColumn("score", scores(F.col("text").cast("string")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def held_out():
    """Rows whose labels are never used in training: crc32 of doc_id's text, modulo 4, is 2 (null: not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
