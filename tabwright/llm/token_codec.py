"""Token-ID output: token files of independently reset, checksummed blocks, coded by an adaptive context-mixing
range coder, and the reader that decodes them.

Model of a block (all of it reset at the block's start). Three predictors look at the ids so far: order 2 (the
id that last followed this pair of ids), order 1 (the id that last followed this id) and order 0 (a frequency
table). The weights of the mixture are adaptive counts of which predictor was right, kept for each combination
of the two candidates' confidence and agreement. The arithmetic coder codes "order 2", "order 1" or "neither"
with the mixed probabilities, and after "neither" the id by the order-0 frequencies.

A block is coded as up to ``LANES`` runs side by side, each with its own range coder, that share one model:
step i codes the i-th id of every run, then the model learns those ids. So both directions are numpy operations
over the runs, and the model learns from all runs at once.

File format: a token file is the blocks of one range of documents in ascending doc_id order, stored as rows of
a Parquet data set (Spark's committer makes the write safe against lost tasks). Columns: file, block, n_ids,
payload, payload_crc32, and the block's directory of document pieces (row of the document in its file, doc_id,
start in the file, length). A payload is: magic, ids, runs, vocabulary, crc32 of the ids (five little-endian
uint32), words per run (uint16), the runs' 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import shared_path
from tabwright.llm.tokens import encoder

BLOCK_IDS = 1 << 20
LANES = 8192
MAGIC = 0x31525854
_CLASS_BITS = 14
_CLASS_MIN = 256
_COUNT = np.uint64(16)  # weight of an id seen, against 1 for every id of the vocabulary
_PAIR_BITS = 16
_SLICE_BITS = 18
_VOTERS = 1024  # runs whose hits and misses set the mixture
_U32, _LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)


class _Model:
    """Shared by both directions; every step must see the same ids in the same order.

    ``last1`` and ``last2`` hold, by id and by hashed pair of ids, four times the id that followed last plus how
    often in a row it was right (0 to 3).
    """

    def __init__(self, vocab: int, lanes: int):
        self.vocab = vocab
        none = (vocab + 1) << 2
        self.last1 = np.full(vocab + 2, none, np.int64)
        self.last2 = np.full(1 << _PAIR_BITS, none, np.int64)
        self.counts = np.zeros(vocab, np.int64)
        self.votes = np.tile(np.array([8, 4, 4], np.int64), (32, 1))
        self.prev = np.full(lanes, vocab, np.int64)
        self.pair = np.zeros(lanes, np.int64)
        self.step, self.pending, self.fresh_at = 0, [], 0
        self._weights()
        self._order0()

    def _weights(self):
        """Mixture weights from the votes: shares of 2**14, none below 256."""
        v = self.votes
        share = _CLASS_MIN + v * ((1 << _CLASS_BITS) - 3 * _CLASS_MIN) // v.sum(1, keepdims=True)
        share[:, 2] = (1 << _CLASS_BITS) - share[:, 0] - share[:, 1]
        below = np.zeros((32, 3), np.int64)
        below[:, 1:] = np.cumsum(share, 1)[:, :2]
        self.share, self.below = share.astype(np.uint64).ravel(), below.astype(np.uint64).ravel()

    def _order0(self):
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocab)[:self.vocab]
        self.pending = []
        freq = self.counts.astype(np.uint64) * _COUNT + np.uint64(1)
        self.cum = np.zeros(self.vocab + 1, np.uint64)
        np.cumsum(freq, out=self.cum[1:])
        self.total = self.cum[-1]
        self.slices = None

    def symbol(self, place: np.ndarray) -> np.ndarray:
        """The id whose frequency interval holds each place below the total: most are told by a table of equal slices,
        the rest by a search."""
        if self.slices is None:
            self.shift = np.uint64(max(0, int(self.total).bit_length() - _SLICE_BITS))
            first = (self.cum[1:-1] + ((np.uint64(1) << self.shift) - np.uint64(1))) >> self.shift
            n = (int(self.total) >> int(self.shift)) + 2
            self.slices = np.cumsum(np.bincount(first.astype(np.int64), minlength=n))
        at = (place >> self.shift).astype(np.int64)
        x = self.slices.take(at)
        open_ = np.flatnonzero(x != self.slices.take(at + 1))
        x[open_] = np.searchsorted(self.cum, place.take(open_), side="right") - 1
        return x

    def candidates(self, k: int):
        """For the first k runs: (order-2 entry, order-1 entry, their ids, 3 x mixing context)."""
        e2, e1 = self.last2.take(self.pair[:k]), self.last1.take(self.prev[:k])
        c2, c1 = e2 >> 2, e1 >> 2
        return e2, e1, c2, c1, ((e2 & 3) * 8 + (e1 & 3) * 2 + (c2 == c1)) * 3

    def learn(self, ids, k, e2, e1, hit2, hit1, vote):
        prev, entry = self.prev[:k], ids << 2
        self.last2[self.pair[:k]] = entry + _MORE.take(e2 & 3) * hit2
        self.last1[prev] = entry + _MORE.take(e1 & 3) * hit1
        self.votes += np.bincount(vote[:_VOTERS], minlength=96).reshape(32, 3)
        self.pair[:k] = ((ids * 40503 + prev * 30011) >> 3) & ((1 << _PAIR_BITS) - 1)
        self.prev[:k] = ids
        self.pending.append(ids)
        self.step += 1
        if self.step <= 16 or self.step % 8 == 0:
            self._weights()
        if self.step >= self.fresh_at:
            self._order0()
            self.fresh_at = self.step + min(max(self.step // 2, 1), 32)


_MORE = np.array([1, 2, 3, 3], np.int64)


def _runs(n: int) -> tuple[int, int]:
    """(runs, ids per run): fewer runs for short blocks, so that their ends cost little."""
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """Payload of one block; ids are integers from 0 to vocab - 1, at least one."""
    n = len(ids)
    lanes, steps = _runs(n)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    by_step = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(vocab, lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words, used = np.zeros((lanes, steps + 1), np.uint32), np.zeros(lanes, np.int64)
    bits = np.uint64(_CLASS_BITS)
    for i in range(steps):
        k = -(-(n - i) // steps)
        s = by_step[i, :k]
        e2, e1, c2, c1, vote = model.candidates(k)
        hit2, hit1 = c2 == s, c1 == s
        kind = np.where(hit2, 0, 2 - hit1)
        vote += kind
        lo, r = low[:k], rng[:k]
        part = r >> bits
        lo += part * model.below.take(vote)
        np.multiply(part, model.share.take(vote), out=r)
        lit = np.flatnonzero(kind == 2)
        x = s.take(lit)
        start = model.cum.take(x)
        part = r.take(lit) // model.total
        lo[lit] += part * start
        r[lit] = part * (model.cum.take(x + 1) - start)
        out = np.flatnonzero(r <= _LOW32)
        if len(out):
            a, b = lo[out], r[out]
            tail = (_LOW32 + np.uint64(1)) - (a & _LOW32)
            b = np.minimum(b, tail)  # a range over a word's end is cut there
            words[out, used[out]] = (a >> _U32).astype(np.uint32)
            used[out] += 1
            lo[out] = a << _U32
            r[out] = b << _U32
        model.learn(s, k, e2, e1, hit2, hit1, vote)
    end = (low + _LOW32) >> _U32  # the first word border inside the last range
    words[np.arange(lanes), used] = end.astype(np.uint32)
    used += 1
    raw = np.ascontiguousarray(ids, "<u4").tobytes()
    head = struct.pack("<5I", MAGIC, n, lanes, vocab, zlib.crc32(raw))
    body = b"".join(words[j, :used[j]].astype("<u4").tobytes() for j in range(lanes))
    return head + used.astype("<u2").tobytes() + body


def decode_block(payload: bytes) -> np.ndarray:
    """Ids of a payload as uint32; raises ValueError when they don't have the checksum that was written."""
    magic, n, lanes, vocab, crc = struct.unpack_from("<5I", payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    lanes_, steps = _runs(n)
    if lanes_ != lanes:
        raise ValueError("token block with another run layout")
    used = np.frombuffer(payload, "<u2", lanes, 20).astype(np.int64)
    flat = np.frombuffer(payload, "<u4", int(used.sum()), 20 + 2 * lanes)
    flat = np.concatenate([flat.astype(np.uint64), np.zeros(2, np.uint64)])
    at = np.concatenate([[0], np.cumsum(used)])
    end, at = at[1:], at[:-1].copy()

    def take(lanes_at, lanes_end):
        return np.where(lanes_at < lanes_end, flat[np.minimum(lanes_at, len(flat) - 1)], np.uint64(0))

    model = _Model(vocab, lanes)
    code = take(at, end) << _U32
    at += 1
    code |= take(at, end)
    at += 1
    rng = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    low = np.zeros(lanes, np.uint64)
    ids = np.zeros((steps, lanes), np.int64)
    bits = np.uint64(_CLASS_BITS)
    for i in range(steps):
        k = -(-(n - i) // steps)
        e2, e1, c2, c1, vote = model.candidates(k)
        lo, r, co = low[:k], rng[:k], code[:k]
        part = r >> bits
        place = co - lo
        not2 = place >= part * model.below.take(vote + 1)
        literal = place >= part * model.below.take(vote + 2)
        vote += not2
        vote += literal
        lo += part * model.below.take(vote)
        np.multiply(part, model.share.take(vote), out=r)
        s = np.where(not2, c1, c2)
        lit = np.flatnonzero(literal)
        part = r.take(lit) // model.total
        place = (co.take(lit) - lo.take(lit)) // part
        if len(lit) and place.max() >= model.total:
            raise ValueError("token block is damaged")
        x = model.symbol(place)
        start = model.cum.take(x)
        lo[lit] += part * start
        r[lit] = part * (model.cum.take(x + 1) - start)
        s[lit] = x
        out = np.flatnonzero(r <= _LOW32)
        if len(out):
            a, b = lo[out], r[out]
            tail = (_LOW32 + np.uint64(1)) - (a & _LOW32)
            b = np.minimum(b, tail)
            co[out] = (co[out] << _U32) | take(at[out], end[out])
            at[out] += 1
            lo[out] = a << _U32
            r[out] = b << _U32
        ids[i, :k] = s
        model.learn(s, k, e2, e1, c2 == s, c1 == s, vote)
    out = np.ascontiguousarray(ids.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(out.tobytes()) != crc:
        raise ValueError("token block fails its checksum")
    return out


BLOCKS = ("file int, block int, n_ids int, payload binary, payload_crc32 long, "
          "doc_row array<long>, doc_id array<long>, doc_at array<long>, doc_len array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                      block_ids: int = BLOCK_IDS) -> None:
    """Write ``docs`` (doc_id long, text string) as token files below ``path``.

    Ranges of doc_id become files in ascending order (repeated ids: by the text's hash; null ids first); each file is cut
    into blocks of ``block_ids`` ids. Every document ends with ``end_id``, so null and empty texts hold one id.
    Only doc_id and text are read, whatever other columns there are. A task holds one block and the texts that
    Arrow hands it, not its file.
    """
    schema = _arrow_schema()

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        file, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        held, held_ids, directory, at, block, row = [], 0, [], 0, 0, 0

        def cut(raw: bytes, pieces):
            ids = np.frombuffer(raw, "<u4")
            payload = encode_block(ids.astype(np.int64), enc.vocab_size)
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_pylist([{
                "file": file, "block": block, "n_ids": len(ids), "payload": payload,
                "payload_crc32": zlib.crc32(payload), "doc_row": cols[0], "doc_id": cols[1], "doc_at": cols[2],
                "doc_len": cols[3]}], schema=schema)

        for batch in batches:
            ids_of = enc.stream(batch.column(1).to_pylist())
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                raw += end
                while raw:
                    part, raw = raw[:4 * (block_ids - held_ids)], raw[4 * (block_ids - held_ids):]
                    held.append(part)
                    directory.append((row, doc_id, at, len(part) // 4))
                    held_ids += len(part) // 4
                    at += len(part) // 4
                    if held_ids == block_ids:
                        yield cut(b"".join(held), directory)
                        held, held_ids, directory, block = [], 0, [], block + 1
                row += 1
        if held:
            yield cut(b"".join(held), directory)

    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
     .mapInArrow(blocks, BLOCKS).write.parquet(path))


def _arrow_schema() -> pa.Schema:
    i32, i64 = pa.int32(), pa.int64()
    return pa.schema([("file", i32), ("block", i32), ("n_ids", i32), ("payload", pa.binary()),
                      ("payload_crc32", i64), ("doc_row", pa.list_(i64)), ("doc_id", pa.list_(i64)),
                      ("doc_at", pa.list_(i64)), ("doc_len", pa.list_(i32))])


def read_token_files(spark, path: str) -> DataFrame:
    """Blocks of the files below ``path``: the columns of ``BLOCKS``."""
    return spark.read.schema(BLOCKS).parquet(path)


def decode_pieces(blocks: DataFrame) -> DataFrame:
    """Decode every block: (file, doc_row, doc_id, doc_at, ids binary), a row per piece of a document."""
    schema = pa.schema([("file", pa.int32()), ("doc_row", pa.int64()), ("doc_id", pa.int64()),
                        ("doc_at", pa.int64()), ("ids", pa.binary())])

    def pieces(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = _checked(r).tobytes()
                at, ids = 0, []
                for n in r["doc_len"]:
                    ids.append(raw[at:at + 4 * n])
                    at += 4 * n
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["file"]] * len(ids), pa.int32()), pa.array(r["doc_row"], pa.int64()),
                    pa.array(r["doc_id"], pa.int64()), pa.array(r["doc_at"], pa.int64()),
                    pa.array(ids, pa.binary())], schema=schema)

    return blocks.mapInArrow(pieces, "file int, doc_row long, doc_id long, doc_at long, ids binary")


def _checked(r: dict) -> np.ndarray:
    if zlib.crc32(r["payload"]) != r["payload_crc32"]:
        raise ValueError(f"block {r['block']} of file {r['file']} fails its checksum")
    return decode_block(r["payload"])


def crc32_combine(crc1: int, crc2: int, len2: int) -> int:
    """crc32 of two byte strings joined, from their crc32s and the second's length."""
    def times(mat, vec):
        total, i = 0, 0
        while vec:
            if vec & 1:
                total ^= mat[i]
            vec >>= 1
            i += 1
        return total

    mat = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    mat = [times(mat, m) for m in mat]
    mat = [times(mat, m) for m in mat]  # four
    while len2:
        mat = [times(mat, m) for m in mat]
        if len2 & 1:
            crc1 = times(mat, crc1)
        len2 >>= 1
    return crc1 ^ crc2


def document_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``path``.

    Blocks are decoded apart from each other; a document cut by a block border is joined by its pieces'
    checksums, so a task never gathers a document. ``start`` counts the ids of all documents before.
    """
    blocks = read_token_files(spark, path)
    schema = pa.schema([("file", pa.int32()), ("doc_row", pa.int64()), ("doc_id", pa.int64()),
                        ("doc_at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def digests(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = memoryview(_checked(r).tobytes())
                ends = np.cumsum(r["doc_len"]) * 4
                crcs = [zlib.crc32(raw[e - 4 * n:e]) for e, n in zip(ends.tolist(), r["doc_len"], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["file"]] * len(crcs), pa.int32()), pa.array(r["doc_row"], pa.int64()),
                    pa.array(r["doc_id"], pa.int64()), pa.array(r["doc_at"], pa.int64()),
                    pa.array(r["doc_len"], pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    pieces = blocks.mapInArrow(digests, "file int, doc_row long, doc_id long, doc_at long, n long, crc long")

    @F.pandas_udf("long")
    def joined(parts):
        out = []
        for p in parts:
            crc = p[0]["crc"]
            for x in p[1:]:
                crc = crc32_combine(crc, x["crc"], 4 * x["n"])
            out.append(crc)
        return parts.__class__(out, dtype="int64")

    docs = pieces.groupBy("file", "doc_row").agg(
        F.first("doc_id").alias("doc_id"), F.min("doc_at").alias("doc_at"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("doc_at", "n", "crc"))).alias("parts"))
    files = blocks.groupBy("file").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    before = files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("doc_at")).alias("start"), "n_tokens",
                                            joined("parts").alias("ids_crc32"))


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return ``document_digests`` of what was read back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return document_digests(spark, path)
