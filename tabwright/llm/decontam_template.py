"""Benchmark decontamination by templates: text whose numbers, names and units became typed placeholders.

1. Canonical words: a text is cut at white space, marks around a word are dropped, letters are lower-cased. A word
   with a digit becomes ``<num>``, a unit (a fixed list, also glued to a number) ``<unit>``, a capitalised word
   that doesn't begin a sentence ``<name>``. The word it stood for is kept as the slot's value.
2. Every window of ``WINDOW`` canonical words with enough literal words is hashed, in benchmark items and in
   documents, and the two are joined by the hash. An item shorter than a window is one window by itself. Every
   window is hashed a second time over its lower-cased words as they are, without a least number of literal words,
   so a copy is found whatever stands in it and whichever of its words begin with capitals.
3. Matches of a document and an item on one diagonal (document place less item place) are an alignment. It counts
   if its windows cover enough of the item and its slots are consistent: all places where the item repeats a
   value hold one value in the document (different values may become one). So a re-parameterised copy is caught,
   and a text that merely fills the same frame with unrelated values is not.
4. Slots decide only where the words differ: an alignment that has a window equal word for word counts as well if
   its equal words alone are enough, whatever its other slots hold.

The documents' windows are sieved by the benchmark's hashes inside the task while those are few (checked); beyond
that all windows go through the join.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import cut_lineage

WINDOW = 8
MIN_LITERALS = 4       # literal words of a window with placeholders
MIN_COVER = 0.7        # share of the item's words that an alignment must cover ...
LONG_COVER = 13        # ... or this many words in all
SIEVE_HASHES = 4_000_000  # benchmark window hashes that tasks may hold
MEMO_LIMIT = 700_000  # different words a worker remembers; beyond it only those of the texts at hand stay
_CHUNK_WORDS = 500_000

# Units of measure and currency.
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second "
    "seconds min minute minutes h hr hour hours day days week weeks month months year years k°c °c °f celsius "
    "fahrenheit kelvin % percent pct $ € £ ¥ usd eur gbp dollar dollars euro euros cent cents pence w kw mw watt watts "
    "v volt volts hz khz mhz ghz byte bytes kb mb gb tb mph kmh km/h m/s".split())

NUM, NAME, UNIT = 1, 2, 3  # codes of placeholders; literal words have 64-bit hashes
_EDGE = re.compile(r"^[^\w$€£¥%°]+|[^\w$€£¥%°]+$")
_GLUED = re.compile(r"([+\-]?[\d.,]*\d)([^\W\d_]+|[%°$€£¥].*)")
_STOPS = frozenset(".,;:!?")
_END = re.compile(r"[.!?:][\"'”’)\]]*$")
# of words seen: their number, and by number the hash as a literal (0: only marks), the code as a placeholder (or
# 0) and whether the word is capitalised (1), ends a sentence (2), has small letters (4) and capitals (8)
_MEMO: dict[str, int] = {}
_LITERAL, _CODE, _FLAGS = array("Q"), array("B"), array("B")


def _word(raw: str) -> tuple[int, int, int]:
    """(hash as a literal, code as a placeholder, flags) of a word as it stands in a text."""
    import xxhash
    core = raw[:-1] if raw[-1] in _STOPS else raw
    if core.isalpha():  # most words: letters and perhaps one mark, nothing to strip and no digits
        low, ends, digits = core.lower(), core is not raw and raw[-1] in ".!?:", False
    else:
        core = _EDGE.sub("", raw)
        low, ends, digits = core.lower(), bool(_END.search(raw)), any(map(str.isdigit, core))
    flags = 2 * ends + (4 * raw.islower() + 8 * raw.isupper() or 12 if core and raw.isascii() and core.isalpha() else
                        4 * (raw != raw.upper()) + 8 * (raw != raw.lower()))
    if not core:
        return 0, 0, flags
    literal = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) | (1 << 63)
    if digits:
        m = _GLUED.fullmatch(low)
        return literal, UNIT + 1 if m and m[2] in UNITS else NUM, flags
    if low in UNITS:
        return literal, UNIT, flags
    return literal, 0, flags + core[0].isupper()


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template codes, slot values, letter cases (4: small, 8: capital), start of each text and the end) of all words
    of the texts, marks left out."""
    memo = _MEMO
    lists = [(t or "").split() for t in texts]
    words = set().union(*lists)
    if len(memo) > MEMO_LIMIT:
        own = words.intersection(memo)
        at = np.fromiter(map(memo.__getitem__, own), np.int64, len(own))
        for kept in (_LITERAL, _CODE, _FLAGS):
            kept[:] = array(kept.typecode, np.array(kept).take(at).tobytes())
        memo.clear()
        memo.update(zip(own, range(len(own)), strict=True))
    for w in words.difference(memo):
        literal, code, flags = _word(w)
        memo[w] = len(_LITERAL)
        _LITERAL.append(literal)
        _CODE.append(code)
        _FLAGS.append(flags)
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.concatenate([[0], np.cumsum(n)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), starts
    word = np.fromiter(map(memo.__getitem__, chain.from_iterable(lists)), np.int64, int(starts[-1]))
    literal = np.array(_LITERAL, np.uint64).take(word)
    code = np.array(_CODE, np.uint64).take(word)
    flags = np.array(_FLAGS, np.uint8).take(word)
    capital, ends = flags & 1 > 0, flags & 2 > 0
    opens = np.concatenate([[True], ends[:-1]])
    opens[starts[:-1][n > 0]] = True
    name = capital & ~opens
    out = np.where(code > 0, code, np.where(name, np.uint64(NAME), literal))
    keep = literal != 0
    at = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], literal[keep], flags[keep] & 12, at[starts]


def _hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of every window of that many codes) for ascending sizes; a longer window goes on from a shorter."""
    h, done = np.zeros(len(codes), np.uint64), 0
    for size in sizes:
        n = len(codes) - size + 1
        if n <= 0:
            return
        h = h[:n].copy()
        for k in range(done, size):
            h ^= codes[k:k + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        done = size
        yield size, h


class Sieve:
    """Sorted hashes behind a table of their leading bits, which turns most others away in one look.

    The table has 4 to 8 places a hash, so at most ``8 * SIEVE_HASHES`` bytes.
    """

    def __init__(self, hashes: np.ndarray):
        self.own = np.sort(hashes)
        self.shift = np.uint64(64 - max(10, (4 * len(hashes)).bit_length()))
        self.known = np.zeros(1 << (64 - int(self.shift)), bool)
        self.known[(self.own >> self.shift).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` whose hash is one of the sieve's."""
        if not len(self.own):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.known.take((h >> self.shift).view(np.int64)))
        some = h.take(at)
        return at[self.own.take(np.searchsorted(self.own, some), mode="clip") == some]


def windows(texts: list[str | None], sizes: list[int], sieve: dict[tuple[int, bool], Sieve] | None = None,
            any_case: bool = False):
    """(text, place, size, literal, hash, codes of the window, values of the window): windows with enough literals
    by their template, and all windows by their words as they are.

    ``sizes`` ascend. ``sieve`` has, by size and kind, the hashes to keep. Unless ``any_case``, windows all in capitals are like
    each other only.
    """
    codes, values, cases, starts = canonical(texts)
    literals = np.concatenate([[0], np.cumsum(codes >= np.uint64(1 << 63))])
    small, capital = (np.concatenate([[0], np.cumsum(cases & k > 0)]) for k in (4, 8))
    for literal in (False, True):
        for size, h in _hashes(values if literal else codes, sizes):
            if literal and not any_case:
                loud = (small[size:] == small[:-size]) & (capital[size:] > capital[:-size])
                h = h ^ loud.astype(np.uint64)
            at = np.arange(len(h)) if sieve is None else sieve[size, literal].places(h)
            if not literal:
                at = at[literals[at + size] - literals[at] >= min(MIN_LITERALS, size)]
            doc = np.searchsorted(starts, at, side="right") - 1
            ok = at + size <= starts[doc + 1]
            for a, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
                yield (d, a - int(starts[d]), size, literal, int(h[a].astype(np.int64)), codes[a:a + size],
                       values[a:a + size])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, any_case: bool = False) -> DataFrame:
    """(item_id, item_words, place, size, literal, hash, codes, values): windows of every item by template and by word;
    an item with fewer words than a window is a window of its own size."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"].tolist(), pdf["text"].tolist(), strict=True):
                n = len(canonical([text])[0])
                for _, place, size, literal, h, codes, values in windows([text], [min(window, n)] if n else [],
                                                                         any_case=any_case):
                    rows.append((item, n, place, size, literal, h, codes.view(np.int64).tolist(),
                                 values.view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "item_words", "place", "size", "literal", "hash", "codes",
                                              "values"])

    return benchmark.where("item_id is not null and text is not null").select("item_id", "text").mapInPandas(
        run, f"item_id {kind}, item_words int, place int, size int, literal boolean, hash long, codes array<long>, "
             "values array<long>")


def document_windows(docs: DataFrame, key: str, sizes: list[int], sieve: dict[tuple[int, bool], Sieve] | None,
                     any_case: bool = False) -> DataFrame:
    """(key, place, size, literal, hash, codes, values): windows of ``docs`` (key, text) by template and by word,
    sieved if asked."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, words = lo, 0
                while hi < len(texts) and (hi == lo or words < _CHUNK_WORDS):
                    words += len(texts[hi] or "") // 5 + 1
                    hi += 1
                rows = list(windows(texts[lo:hi], sizes, shared.value, any_case))
                for r in range(0, len(rows), 10_000):
                    part = rows[r:r + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array([lo + x[0] for x in part])), pa.array([x[1] for x in part], pa.int32()),
                        pa.array([x[2] for x in part], pa.int32()), pa.array([x[3] for x in part], pa.bool_()),
                        pa.array([x[4] for x in part], pa.int64()),
                        pa.array([x[5].view(np.int64) for x in part], pa.list_(pa.int64())),
                        pa.array([x[6].view(np.int64) for x in part], pa.list_(pa.int64()))],
                        [key, "place", "size", "literal", "hash", "codes", "values"])
                lo = hi

    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"{key} {kind}, place int, size int, literal boolean, hash long, codes array<long>, values array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW,
                  min_cover: float = MIN_COVER, long_cover: int = LONG_COVER, any_case: bool = False) -> DataFrame:
    """Documents that hold a benchmark item's template with consistent slots, or enough of its words as they are.

    ``docs`` has ``key`` and text, ``benchmark`` item_id and text. A row per document and item: key, item_id,
    covered (words of the item in the best alignment), item_words, doc_place (canonical word where the item would
    begin), n_slots (places with a placeholder), exact (all slots hold the item's own values). Null texts, ids and
    keys match nothing; repeated rows give one result; other columns are not read. With ``any_case`` a copy all in
    capitals is found as well.
    """
    bench = cut_lineage(benchmark_windows(benchmark, window, any_case))
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())
    if not sizes:
        sizes = [window]
    sieve = None
    hashes = bench.select("size", "literal", "hash").distinct()
    if hashes.count() <= SIEVE_HASHES:
        got = hashes.toPandas()
        sieve = {(s, k): Sieve(got.loc[(got["size"] == s) & (got["literal"] == k), "hash"]
                               .to_numpy(np.int64, copy=True).view(np.uint64)) for s in sizes for k in (False, True)}
    doc = document_windows(docs.where(F.col(key).isNotNull()), key, sizes, sieve, any_case)
    b = bench.select("item_id", "item_words", F.col("place").alias("item_place"), "size", "literal", "hash",
                     F.col("codes").alias("item_codes"), F.col("values").alias("item_values"))
    both = (doc.join(b, ["size", "literal", "hash"]).where("if(literal, values = item_values, codes = item_codes)")
            .select(key, "item_id", "item_words", (F.col("place") - F.col("item_place")).alias("doc_place"),
                    (F.col("values") == F.col("item_values")).alias("same"), F.explode(F.arrays_zip(
                        F.sequence(F.col("item_place"), F.col("item_place") + F.col("size") - 1).alias("at"),
                        "item_codes", "values", "item_values")).alias("w"))
            .select(key, "item_id", "item_words", "doc_place", F.col("w.at").alias("at"),
                    (F.col("w.item_codes") >= 0).alias("slot"), F.col("w.values").alias("v"),
                    F.col("w.item_values").alias("i"), "same")
            .groupBy(key, "item_id", "item_words", "doc_place", "at", "slot", "v", "i").agg(F.max("same").alias("same")))
    # an item's words bound each group of these aggregations
    lines = both.groupBy(key, "item_id", "item_words", "doc_place").agg(
        F.count("*").alias("covered"), F.count(F.when(F.col("slot"), 1)).alias("n_slots"),
        F.countDistinct(F.when(F.col("slot"), F.col("i"))).alias("item_values"),
        F.max("same").alias("same"), F.count(F.when(F.col("i") == F.col("v"), 1)).alias("equal"),
        F.countDistinct(F.when(F.col("slot"), F.struct("i", "v"))).alias("pairs"),
        F.min(F.when(F.col("slot"), F.col("i") == F.col("v")).otherwise(True)).alias("exact"))
    # words that count: all of a consistent alignment, else the equal ones beside a window of equal words
    counted = lines.withColumn("sound", F.when(F.col("pairs") == F.col("item_values"), F.col("covered"))
                               .when(F.col("same"), F.col("equal")).otherwise(0))
    enough = counted.where((F.col("sound") >= F.least(F.lit(float(long_cover)), min_cover * F.col("item_words")))
                           & (F.col("sound") >= F.least(F.lit(window), F.col("item_words"))))
    best = enough.groupBy(key, "item_id").agg(F.max(F.struct(
        "covered", "exact", -F.col("doc_place"), "item_words", "doc_place", "n_slots")).alias("b"))
    return best.select(key, "item_id", "b.covered", "b.item_words", "b.doc_place", "b.n_slots", "b.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay, documents with a null ``key`` too."""
    found = contamination(docs.select(key, "text"), benchmark, key=key, **options).select(key).distinct()
    return docs.join(cut_lineage(found), key, "left_anti").select(docs.columns)
