"""Phrase collocations by SON partitioning: two passes over whole texts, whatever the number of phrases.

First pass: the texts' blocks are dealt to ``SHARDS`` shards, and every shard is mined completely at the support lowered
in proportion, ``ceil(least / SHARDS)``: a phrase that is frequent in all shards together reaches that in one of them
at least. A shard counts hashes (a block sends each phrase's hash as often as it occurs, up to the lowered support,
packed by hash range), so equal hashes can only add candidates. The union of the locally frequent hashes is a bitmap of
at most ``MAX_BITS`` bits, a bound that doesn't grow with the data; where it is fuller, more phrases pass it.

Second pass: all phrases that pass the bitmap are counted exactly, by their words, first inside blocks and then by one
grouped sum; those below the support are dropped there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import written

SHARDS = 8
BLOCK_BYTES = 8 << 20         # text worked on at once; one text is never cut
RANGE_ENTRIES = 1 << 22       # phrases of a hash range, about
MAX_BITS = 1 << 28            # of the bitmap of candidates
RANGE_BITS = 1 << 20          # of one hash range in it
# fixed: the bytes that end a piece, and those between words
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Block:
    """Words of lower-cased texts: ``vocabulary`` (bytes per word id), ``ids`` and ``piece`` (both per occurrence)."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes.lower() changes A-Z alone
        kind = _KIND[data]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        self.ids = np.asarray(coded.indices, np.int64)
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, start)

    def hashes(self, salt: int) -> np.ndarray:
        """A hash per word occurrence."""
        of = xxhash.xxh3_64_intdigest
        table = np.fromiter((of(w, salt) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        return table[self.ids]

    def phrases(self, hashed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word's place, hash) of all phrases of so many words inside pieces."""
        n = len(hashed) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[length - 1:])
        h = hashed[at] * _STEP[0]
        for i in range(1, length):
            h = (h ^ (h >> np.uint64(29))) * _STEP[i] + hashed[at + i]
        h = (h ^ (h >> np.uint64(32))) * _STEP[0]
        return at, h ^ (h >> np.uint64(29))


def _blocks(batches, block_bytes: int) -> Iterator[tuple[str, Block]]:
    """Texts of a task by language, in blocks of bounded size."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text")
        for name, t in zip(langs, texts, strict=True):
            raw = t.as_buffer() if t.is_valid else None
            if raw is None or not raw.size:
                continue
            held.setdefault(name, []).append(raw.to_pybytes())
            size += raw.size
            if size >= block_bytes:
                for x, t in held.items():
                    yield x, Block(t)
                held, size = {}, 0
    for name, texts in held.items():
        yield name, Block(texts)


def _salt(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _texts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    # texts travel as bytes: they are cut up as bytes, and a string column would be checked and copied
    return docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"),
                       F.encode(text.cast("string"), "UTF-8").alias("text"))


def candidates(texts: DataFrame, words: int, least: int, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES,
               range_entries: int = RANGE_ENTRIES) -> tuple[np.ndarray, int]:
    """The bitmap of locally frequent hashes (bytes) and the number of hash ranges, a power of two."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one word to five bytes, a phrase of each length to a word
    ranges = 1
    while ranges * range_entries < size * words // 5:
        ranges *= 2
    bits = min(RANGE_BITS, MAX_BITS // min(ranges, MAX_BITS // 8))
    support = -(-least // shards)
    shift = np.uint64(64 - ranges.bit_length() + 1) if ranges > 1 else None

    def mine(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for n, (name, block) in enumerate(_blocks(batches, block_bytes)):
            hashed = block.hashes(_salt(name))
            every = np.sort(np.concatenate([block.phrases(hashed, k)[1] for k in range(1, words + 1)]))
            if support < len(every):  # each hash up to the lowered support
                keep = np.ones(len(every), bool)
                keep[support:] = every[support:] != every[:-support]
                every = every[keep]
            cuts = (np.searchsorted(every, np.arange(1, ranges, dtype=np.uint64) << shift) if ranges > 1
                    else np.empty(0, np.int64))
            low = (every >> np.uint64(32 - ranges.bit_length() + 1)).astype(np.uint32)
            parts = [x.tobytes() for x in np.split(low, cuts)]
            yield pa.RecordBatch.from_pydict({
                "range": pa.array(np.arange(ranges), pa.int64()),
                "shard": pa.array(np.full(ranges, (task * 31 + n) % shards), pa.int32()),
                "hashes": pa.array(parts, pa.binary())})

    def frequent(key, group):
        found = np.zeros(bits, bool)
        for s in group["shard"].unique():
            h = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in group["hashes"][group["shard"] == s]]))
            if len(h) >= support:
                hit = h[support - 1:][h[support - 1:] == h[:len(h) - support + 1]]
                found[(hit.astype(np.uint64) * np.uint64(bits)) >> np.uint64(32)] = True
        import pandas as pd
        return pd.DataFrame({"range": [key[0]], "bits": [np.packbits(found).tobytes()]})

    mined = texts.mapInArrow(mine, "range long, shard int, hashes binary")
    rows = mined.groupBy("range").applyInPandas(frequent, "range long, bits binary").collect()  # MAX_BITS at most
    out = np.zeros((ranges, bits // 8 or 1), np.uint8)
    for r in rows:
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1), ranges


def frequencies(docs: DataFrame, words: int = 4, least: int = 30, lang: str = "lang", text: str = "text",
                shards: int = SHARDS, block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Exact counts of all phrases of 1 to ``words`` words with at least ``least`` occurrences: lang, words, phrase
    (null: all words of the language), f."""
    spark = docs.sparkSession
    texts = _texts(docs, F.col(lang), F.col(text))
    bitmap, ranges = candidates(texts, words, least, shards, block_bytes, range_entries)
    bits = len(bitmap) * 8 // ranges
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    def count(batches):
        known = np.frombuffer(shared.value, np.uint8)
        width = np.uint64(32 - ranges.bit_length() + 1)
        for name, block in _blocks(batches, block_bytes):
            hashed = block.hashes(_salt(name))
            lengths, phrases, counts = [0], [None], [len(block.ids)]
            for k in range(1, words + 1):
                at, h = block.phrases(hashed, k)
                rest = ((h >> width) & np.uint64(0xFFFFFFFF))
                top = h >> np.uint64(64 - ranges.bit_length() + 1) if ranges > 1 else np.zeros(len(h), np.uint64)
                place = top * np.uint64(bits) + ((rest * np.uint64(bits)) >> np.uint64(32))
                at = at[(known[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                for ids, n in _counted(block.ids, at, k, len(block.vocabulary)):
                    v = block.vocabulary
                    phrases.extend(b" ".join([v[i] for i in row]) for row in ids)
                    counts.extend(n)
                    lengths.extend([k] * len(n))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(counts), pa.string()), "words": pa.array(lengths, pa.int32()),
                "phrase": pa.array(phrases, pa.binary()), "f": pa.array(counts, pa.int64())})

    found = texts.mapInArrow(count, "lang string, words int, phrase binary, f long")
    return (found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
            .where((F.col("f") >= least) | F.col("phrase").isNull())
            .withColumn("phrase", F.col("phrase").cast("string")))


def _counted(ids: np.ndarray, at: np.ndarray, k: int, vocabulary: int) -> Iterator[tuple[list, list]]:
    """Distinct phrases of word ids at the places ``at``, with their numbers; by the ids themselves, not by a hash."""
    if not len(at):
        return
    key = ids[at]
    for i in range(1, k):  # number the distinct prefixes, so that a key and an id fit in 64 bits
        distinct, key = np.unique(key, return_inverse=True) if i > 1 else (None, key)
        key = key * vocabulary + ids[at + i]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    rows = ids[at[first][:, None] + np.arange(k)]
    for lo in range(0, len(rows), 100_000):
        yield rows[lo:lo + 100_000].tolist(), n[lo:lo + 100_000].tolist()


def collocations(docs: DataFrame, words: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000,
                 covered: int = 80, lang: str = "lang", text: str = "text", shards: int = SHARDS,
                 **sizes: int) -> DataFrame:
    """The best phrases of 2 to ``words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's number of occurrences (``least`` at least). Of its cuts in two, with ``l`` and ``r``
    occurrences of the parts, the one with the lowest ``floor(scale * a / (l + r))`` counts (ties: the earliest). A
    phrase whose words lie inside a longer one with ``100 * f >= covered * a`` is dropped. ``n`` counts the language's
    word occurrences. Ranks go by score and ``a`` descending, then by the phrase's bytes. A null language is ``und``,
    null and empty texts have no words, repeated rows count each, an empty table gives none; columns that aren't named
    are not read. Arithmetic is exact (38 digits). ``sizes``: ``block_bytes`` and ``range_entries``.
    """
    if words < 2:
        raise ValueError("phrases have two words at least")
    found = written(frequencies(docs, words, least, lang, text, shards, **sizes), "phrase-counts")
    totals = found.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    phrases = found.where("phrase IS NOT NULL")
    # explode each phrase's cuts and inner phrases; all of these are frequent too, so none is looked up in vain
    cand = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = (cand.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1))
                        .alias("k"), "w", "words")
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right")))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.withColumnsRenamed({"part": side, "of_part": name}), ["lang", side]).drop(side)
    score = F.expr(f"(cast(a as decimal(20, 0)) * {scale}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inner = (cand.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
             .withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
             .groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"))
             .agg(F.max("f").alias("longer")))
    inside = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {covered}")
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~inside)
    best = left.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                            "n", "score")


def collocations_sql(table: str = "documents", least: int = 30, top: int = 2000) -> str:
    """DuckDB SQL of ``collocations`` with four words: every phrase of every text counted, without shards."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS words, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, "
        f"unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in (1, 2, 3, 4))
    return f"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM {table}),
cut AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM cut),
counted AS (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= {least}),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE words > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
                (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, words)) AS k FROM cand) c
         JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
         JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.words], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, w, size, unnest(range(1, words - size + 2)) AS s
          FROM (SELECT lang, a, w, words, unnest(range(2, words)) AS size FROM cand WHERE words > 2)),
longer AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS f FROM spans GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
         WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r,
       n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= {top}
"""
