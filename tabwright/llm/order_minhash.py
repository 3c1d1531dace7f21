"""Order MinHash fingerprints, whose likeness follows the edit distance of texts. DataFrame functions only.

A text is a sequence of tokens (runs of up to ``PIECE`` visible characters), its k-mers are ``K`` tokens in a row, and
a k-mer's n-th occurrence counts as another one than its first. One hash orders these numbered k-mers; its top bits
deal them to ``BINS`` ranges (one-permutation hashing in place of as many hash functions). From each range the
``TUPLE`` minimal ones are selected, put back into text order, and hashed as a tuple. Texts that hold the same k-mers
in another order thus differ, as they do in edit distance.

All of it is a chain of projections over arrays: hash and place share a 64-bit number, so that arrays sort as plain
numbers. Only the neighbour of a text, for edits across documents, needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import cut_lineage, written

PIECE, K, BINS, TUPLE = 8, 2, 64, 2
PLACE_BITS = 28  # a text of more tokens doesn't fit in a row
TUPLE_BITS = 16
BLOCK = 1 << 16  # rows of a window

_HIGH = -(1 << PLACE_BITS)
_LOW = (1 << PLACE_BITS) - 1


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def with_tuples(df: DataFrame, text: str, out: str, k: int = K, bins: int = BINS, ell: int = TUPLE) -> DataFrame:
    """Append the signature of a text column: an ascending array of ``bin << 16 | tuple hash``, one number for each
    bin that holds a k-mer. A text of fewer than ``k`` tokens is one k-mer; null and empty texts have none."""
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    top = 64 - bins.bit_length() + 1
    names = ["__t", "__p", "__s", "__n", "__m"]
    t, p, s, numbered, chosen = (F.col(c) for c in names)

    def bin_of(x):
        return F.shiftrightunsigned(x, top)

    # every step is a column of its own: an array used inside a lambda must be one that exists already
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("__t", F.regexp_extract_all(whole, F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0)))
    df = df.withColumn("__p", F.sort_array(F.transform(
        F.slice(t, F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))),
        lambda x, i: F.xxhash64(x, *[F.get(t, i + j) for j in range(1, k)]).bitwiseAND(_long(_HIGH))
        .bitwiseOR(i.cast("long")))))
    # places in the sorted array at which another k-mer begins
    df = df.withColumn("__s", F.when(F.size(p) > 0, F.filter(
        F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (_hash(F.get(p, i)) != _hash(F.get(p, i - 1)))))
        .otherwise(F.array().cast("array<int>")))
    again = F.flatten(F.transform(
        F.filter(s, lambda i: _hash(F.get(p, i)) == _hash(F.get(p, i + 1))),
        lambda i: F.transform(
            F.slice(p, i + 2, F.coalesce(F.get(s, F.array_position(s, i).cast("int")), F.size(p)) - i - 1),
            lambda x, o: F.xxhash64(_hash(x), o + 1).bitwiseAND(_long(_HIGH)).bitwiseOR(x.bitwiseAND(_long(_LOW))))))
    df = df.withColumn("__n", F.when(F.size(s) == F.size(p), p).otherwise(F.sort_array(F.concat(
        F.transform(s, lambda i: F.get(p, i)), again))))
    df = df.withColumn("__m", F.filter(
        numbered, lambda x, i: (i < ell) | (bin_of(x) != bin_of(F.get(numbered, i - ell)))))
    # a bin's chosen k-mers by place in the text, then their hashes as a tuple
    def in_order(x, i):
        same = F.filter(F.slice(chosen, i + 1, F.lit(ell)), lambda y: bin_of(y) == bin_of(x))
        by_place = F.sort_array(F.transform(same, lambda y: F.struct(
            y.bitwiseAND(_long(_LOW)).alias("place"), _hash(y).alias("hash"))))
        value = F.xxhash64(F.transform(by_place, lambda y: y["hash"]))
        return F.shiftleft(bin_of(x), TUPLE_BITS).bitwiseOR(value.bitwiseAND(_long((1 << TUPLE_BITS) - 1)))

    every = F.transform(chosen, lambda x, i: F.when(
        (i == 0) | (bin_of(x) != bin_of(F.get(chosen, i - 1))), in_order(x, i)))
    return df.withColumn(out, F.filter(every, lambda x: x.isNotNull())).drop(*names)


def as_text(signature: Column, bins: int = BINS) -> Column:
    """A signature as lower-case hex digits, each bin's number and its tuple; equal if the signatures are."""
    digits = (bins.bit_length() + 2) // 4 + TUPLE_BITS // 4
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples among the bins that either text fills; 1 if neither fills any."""
    def bins(c):
        return F.transform(c, lambda x: F.shiftright(x, TUPLE_BITS))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, bins: int = BINS, ell: int = TUPLE) -> DataFrame:
    """``docs`` with ``signature`` (array) and ``fingerprint`` (string) of the whole text (null: empty). Own columns of
    these names are replaced; all rows stay."""
    return with_tuples(docs.drop("signature", "fingerprint"), text, "signature", k, bins, ell).withColumn(
        "fingerprint", as_text(F.col("signature"), bins))


def neighbours(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``next_*`` and ``before_*`` of ``columns``, in ascending ``order`` (nulls first), the first row
    after the last. One range shuffle gives places; windows run over blocks of ``BLOCK`` rows."""
    spark = rows.sparkSession
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a task
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["n"]
    if not total:
        starts = [(0, 0)]
    at = spark.createDataFrame(starts, "part long, start long")
    ranked = (placed.withColumn("part", part).join(F.broadcast(at), "part")
              .withColumn("rank", F.col("start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))))
    # a row takes part in its block, and at its ends in the blocks beside it
    ranks = F.array_distinct(F.array(*[F.struct(
        F.pmod(F.col("rank") + d, F.lit(max(total, 1))).alias("of"), F.lit(d).alias("d")) for d in (-1, 0, 1)]))
    seen = ranked.withColumn("__near", F.explode(ranks)).withColumn(
        "__block", F.expr(f"__near.of div {BLOCK}")).withColumn("__at", F.col("rank"))
    # rank as seen from the block: the row after the last one is at `total`, the one before the first at -1
    seen = seen.withColumn("__at", F.col("__near.of") - F.col("__near.d"))
    seen = seen.dropDuplicates(["__block", "__at"]).drop("__near")
    w = Window.partitionBy("__block").orderBy("__at")
    found = seen.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}
                             | {f"before_{c}": F.lag(c).over(w) for c in columns})
    own = (F.col("__at") == F.col("rank")) & (F.expr(f"rank div {BLOCK}") == F.col("__block"))
    return found.where(own).drop("__block", "__at", "__id", "part", "start", "rank")


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of the next
    document's, in ascending order of ``key`` (null first), the first after the last. Columns: key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; the likeness of two
    empty texts is 1. Rows that share a key stand in the order of their texts' hashes; rows equal in key and text
    follow each other and each gives a row. A document alone is its own next one. Other columns are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("__key"), whole.alias("__text"))
    named = base.withColumns({"__h": F.xxhash64("__text"), "__g": F.hash("__text")})
    # rows equal in key and text are one row with a count from here on
    narrow = written(with_tuples(named.withColumn("n_chars", F.char_length("__text").cast("long")), "__text", "sig")
                     .select("__key", "__h", "__g", "n_chars", "sig"), "text-signatures")
    same = ["__key", "__h", "__g"]
    groups = narrow.groupBy(*same).agg(F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"),
                                       F.first("sig").alias("sig"))
    linked = neighbours(groups, same, ["n_chars", "sig", *same])
    linked = linked.select(
        *[F.col(c).alias(c[2:]) for c in same], "n_chars", "copies", "sig",
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"), F.floor(F.col("before_n_chars") / 2).alias("need"),
        *[F.col(f"before_{c}").alias(f"before{c[1:]}") for c in same])
    linked = written(linked, "text-neighbours")
    hit = (named["__key"].eqNullSafe(linked["key"]) & (named["__h"] == linked["h"]) & (named["__g"] == linked["g"]))
    texts = named.join(linked, hit).drop(*same)
    columns = [c for c in texts.columns if c != "__text"]
    if not linked.where("copies > 1").isEmpty():
        once = texts.where("copies > 1").groupBy(*columns).agg(F.first("__text").alias("__text"))
        texts = texts.where("copies = 1").unionByName(once)
    heads = texts.select(F.col("before_key").alias("__key"), F.col("before_h").alias("__h"),
                         F.col("before_g").alias("__g"), F.expr("substring(__text, 1, cast(need as int))").alias("head"))
    pairs = texts.join(heads, F.col("key").eqNullSafe(F.col("__key")) & (F.col("h") == F.col("__h"))
                       & (F.col("g") == F.col("__g")))
    kept, half = F.expr("substring(__text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("cast(n_chars div 2 as int)")
    # of equal rows the last is followed by the next document, the others by their like
    last = pairs.withColumn("edited", F.concat(kept, "head")).withColumn("times", F.lit(1))
    every = last
    if not linked.where("copies > 1").isEmpty():
        inner = pairs.where("copies > 1").withColumns({
            "edited": F.concat(kept, F.substring("__text", F.lit(1), half)), "near_next": F.lit(1.0),
            "times": (F.col("copies") - 1).cast("int")})
        every = last.unionByName(inner)
    made = with_tuples(every.select("key", "n_chars", "sig", "near_next", "edited", "times"), "edited", "edited_sig")
    out = made.select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), "near_next", "times")
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("__i", "times")
