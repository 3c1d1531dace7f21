"""Packing: documents are cut and packed into training windows by non-negative least squares.

A document gives whole windows and a remainder. Remainders are binned by length; every combination of up to
three bins that fills a window is a pattern. Non-negative least squares finds how often to repeat each pattern so
that the patterns use up the histogram of remainders; the counts are rounded and used as far as documents last.
What is left is packed greedily, longest first, each document beginning where the one before ended and cut at
the window's end; the last, short window is split into powers of two, which need no padding.

The work is local: a task packs its own documents in groups of at most ``GROUP_IDS`` ids (the last document may
pass that), each against its own histogram. So nothing is shuffled, no task holds more than a group, every
document of any size goes the same way, and a lost task is simply run again. Padding is what the bins round up,
under half a per cent at the default bin width.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.tokens import encoder

WINDOW = 2048
BIN = 8                 # ids per length bin
GROUP_IDS = 8_000_000   # ids packed together
PASSES = 4              # solve, round and use; then again for what rounding left


@lru_cache(maxsize=4)
def patterns(bins: int) -> tuple[np.ndarray, float]:
    """Combinations of one to three of the bins 1..bins that add up to ``bins`` (rows of three bins, 0 for none), and
    a bound on the curvature of their least squares problem."""
    a, b = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    c = bins - a - b
    ok = (a <= b) & (b <= c)
    combos = np.stack([a[ok], b[ok], c[ok]], 1)
    v = np.ones(bins + 1)
    for _ in range(50):  # power iterations on uses x uses'
        v = _used(combos, v[combos].sum(1) - v[0] * (combos == 0).sum(1), bins)
        size = np.linalg.norm(v)
        v /= size
    return combos, 1.05 * float(size)


def _used(combos: np.ndarray, times: np.ndarray, bins: int) -> np.ndarray:
    """How often each bin (0 stays empty) is used when every pattern is repeated ``times``."""
    used = np.bincount(combos.ravel(), np.repeat(times, 3), bins + 1)
    used[0] = 0
    return used


def nnls(combos: np.ndarray, curvature: float, have: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |uses x - have| (have[0] = 0), by accelerated projected gradients."""
    bins = len(have) - 1
    x = look = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        gap = have - _used(combos, look, bins)
        new = np.maximum(0.0, look + gap[combos].sum(1) / curvature)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack(lengths: np.ndarray, window: int = WINDOW, width: int = BIN):
    """Pieces (document, start, length, sequence, offset) of documents with these lengths; sequences from 0 on."""
    out: list[tuple[np.ndarray, ...]] = []
    whole, rest = lengths // window, lengths % window
    n_whole = int(whole.sum())
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)
    out.append((doc, nth * window, np.full(n_whole, window), np.arange(n_whole), np.zeros(n_whole, np.int64)))
    seq = n_whole
    docs = np.flatnonzero(rest)
    bins = -(-rest[docs] // width)
    last = window // width
    order = np.argsort(bins, kind="stable")
    first = np.searchsorted(bins[order], np.arange(last + 2))
    have = np.zeros(last + 1, np.int64)  # documents of each bin that are not packed yet
    have[1:] = np.diff(first)[1:]
    taken = np.zeros(last + 1, np.int64)
    combos, curvature = patterns(last)
    for _ in range(PASSES):
        # rounding the running sum keeps the counts of neighbouring patterns, which use nearly the same bins, whole
        counts = np.diff(np.rint(np.cumsum(nnls(combos, curvature, have.astype(float)))), prepend=0).astype(np.int64)
        begun = seq
        for p in np.flatnonzero(counts):
            own_bins = [b for b in combos[p].tolist() if b]
            times = min(int(counts[p]), *(have[b] // own_bins.count(b) for b in own_bins))
            if times <= 0:
                continue
            offset, ids = np.zeros(times, np.int64), np.arange(seq, seq + times)
            for b in own_bins[::-1]:
                at = first[b] + taken[b]
                own = docs[order[at:at + times]]
                taken[b] += times
                have[b] -= times
                out.append((own, whole[own] * window, rest[own], ids, offset))
                offset = offset + rest[own]
            seq += times
        if seq == begun:
            break
    left = np.concatenate([docs[order[first[b] + taken[b]:first[b + 1]]] for b in range(last, 0, -1)])
    if len(left):
        left = left[np.argsort(-rest[left], kind="stable")]
        ends = np.cumsum(rest[left])
        total = int(ends[-1])
        full, tail = total // window, total % window
        powers = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
        edges = np.concatenate([np.arange(full + 1) * window, full * window + np.cumsum(powers, dtype=np.int64)])
        cuts = np.unique(np.concatenate([edges, ends]).astype(np.int64))
        lo, hi = cuts[:-1], cuts[1:]
        k = np.searchsorted(ends, lo, side="right")
        s = np.searchsorted(edges, lo, side="right") - 1
        own = left[k]
        out.append((own, whole[own] * window + lo - (ends[k] - rest[own]), hi - lo, seq + s, lo - edges[s]))
    return tuple(np.concatenate([np.asarray(o[k], np.int64) for o in out]) for k in range(5))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1,
                   width: int = BIN, group_ids: int = GROUP_IDS, with_ids: bool = True) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``window`` ids; a row per piece.

    A document is its text's ids and ``end_id``, so null and empty texts hold one id. Columns: doc_id, start (the
    document's ids before the piece), length, ids_crc32 (of the piece's ids as little-endian uint32), doc_tokens,
    sequence_id, offset (of the piece in its sequence, without gaps from 0), ids (binary, the piece itself; left out
    where ``with_ids`` is false, so that the pieces needn't leave their task).
    Every id of every row lies in exactly one piece; repeated rows are packed as often as they come. Only doc_id
    and text are read. Sequence ids are unique, not without gaps: task, group and sequence number.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([*((c, pa.int64()) for c in names), *([("ids", pa.binary())] if with_ids else [])])

    def groups(batches):
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        ids, raws, size = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.stream(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                raws.append(raw + end)
                size += len(raws[-1]) // 4
                if size >= group_ids:
                    yield ids, raws
                    ids, raws, size = [], [], 0
        if ids:
            yield ids, raws

    def run(batches):
        seq0 = TaskContext.get().partitionId() << 40
        for ids, raws in groups(batches):
            lengths = np.fromiter((len(r) // 4 for r in raws), np.int64, len(raws))
            doc, start, length, seq, offset = pack(lengths, window, width)
            parts = [raws[d][4 * s:4 * (s + n)]
                     for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(lengths[doc]),
                    pa.array(seq + seq0), pa.array(offset), *([pa.array(parts, pa.binary())] if with_ids else [])]
            for lo in range(0, len(doc), 10_000):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 10_000) for c in cols], schema=schema)
            seq0 += int(seq.max(initial=-1)) + 1

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, ", ".join(f"{c} long" for c in names) + (", ids binary" if with_ids else "")))
