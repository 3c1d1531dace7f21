"""Sharding along a Hilbert curve: rows near in several metadata dimensions share a shard, so that their files can
be skipped by any of those dimensions. DataFrame functions only.

Each dimension is quantised to ``2**bits`` cells by its quantiles, the cells' Hilbert index orders the rows (ties:
doc_id, size and checksum of the text), and the order is cut into runs. The order comes from one range shuffle of
narrow rows (no text); a row's place is its partition's count of rows before plus its place there, so no window
runs over all rows; a hot value is split by the columns after it, rows equal in all of them are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import written

BITS = 4


def string_cuts(df: DataFrame, c: str, bits: int = BITS) -> list[str]:
    """At most ``2**bits - 1`` strings that cut the rows of ``df`` into runs of about equal count in the UTF-8 byte order
    of column ``c``, each counted by its whole value; nulls count as the lowest.

    Distinct values and their counts are sorted by one range shuffle; a value's place is its partition's rows before
    plus those before it there, and only the cuts reach the driver."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    placed = written(counts.repartitionByRange(F.asc_nulls_first("value")).sortWithinPartitions(F.asc_nulls_first("value"))
                     .withColumn("part", F.spark_partition_id()), "string-places")
    parts = placed.groupBy("part").agg(F.sum("n").alias("in_part"))
    starts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("upto", F.sum("n").over(inside)).join(starts, "part").select(
        "value", (F.col("before") + F.col("upto")).alias("upto"))
    wanted = [-(-total * i // (1 << bits)) for i in range(1, 1 << bits)]
    found = upto.agg(*[F.min(F.when(F.col("upto") >= w, F.col("value"))).alias(f"c{i}") for i, w in enumerate(wanted)]).first()
    return sorted({v for v in found if v is not None})


def hilbert(df: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """Append the Hilbert index (long) of integer cells 0..2**bits - 1; every step is a projection."""
    x = [f"__x{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(d).cast("long") for a, d in zip(x, dims, strict=True)})
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the finer levels
        low = F.lit(q - 1).cast("long")
        for a in x:
            swap = F.when(F.col(a).bitwiseAND(F.lit(q)) != 0, F.lit(0).cast("long")).otherwise(
                F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(low))
            flip = F.when(F.col(a).bitwiseAND(F.lit(q)) != 0, low).otherwise(F.lit(0).cast("long"))
            df = df.withColumns({"__swap": swap, "__flip": flip})
            if a == x[0]:  # a row swapped with itself only flips
                df = df.withColumn(a, F.col(a).bitwiseXOR(F.col("__flip")))
            else:
                df = df.withColumns({x[0]: F.col(x[0]).bitwiseXOR(F.col("__swap")).bitwiseXOR(F.col("__flip")),
                                     a: F.col(a).bitwiseXOR(F.col("__swap"))})
        q >>= 1
    for before, a in zip(x, x[1:], strict=False):  # Gray code
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    turn, q = F.lit(0).cast("long"), 1 << (bits - 1)
    while q > 1:
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1).cast("long"))
                               .otherwise(F.lit(0).cast("long")))
        q >>= 1
    df = df.withColumn("__turn", turn)
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for a in x:
            one = F.shiftright(F.col(a).bitwiseXOR(F.col("__turn")), bit).bitwiseAND(F.lit(1).cast("long"))
            index = F.shiftleft(index, 1).bitwiseOR(one)
    return df.withColumn(out, index).drop(*x, "__swap", "__flip", "__turn")


def quantise(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Replace columns by the number of the column's quantile cuts below the value (0..2**bits - 1).

    The cuts, ``2**bits - 1`` constants a column, come from one mergeable sketch over all rows for numbers and from
    ``string_cuts`` for strings; null is cell 0.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = [d for d in dims if df.schema[d].dataType.simpleString() == "string"]
    found = {d: string_cuts(df, d, bits) for d in texts}
    numbers = [d for d in dims if d not in texts]
    if numbers:
        found |= df.agg(*[F.percentile_approx(d, steps, 10_000).alias(d) for d in numbers]).first().asDict()
    cells = {}
    for d in dims:
        cell = F.lit(0)
        for c in found[d] or []:
            cell = cell + F.when(F.col(d) > F.lit(c), 1).otherwise(0)
        cells[d] = cell.cast("long")
    return df.withColumns(cells)


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """Deal ``docs`` (doc_id, text, lang, source) into runs of the Hilbert order over doc_id, source, language and
    size.

    Law ``rows``: the shards' row counts differ by one at most. Columns: doc_id, size (UTF-8 bytes of the text plus
    1; null text: none), text_crc32 (of the UTF-8 bytes), law, shard, slot (without gaps from 0), grown_shard (null),
    hilbert (the curve index). Null ids, languages and sources are at the low end; repeated rows take places next to each
    other; an empty table gives none. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d_id"),
        F.col("source").cast("string").alias("d_source"),
        F.col("lang").cast("string").alias("d_lang"),
        F.octet_length(text).cast("long").alias("d_size")), "shard-rows")
    dims = ["d_lang", "d_source", "d_size", "d_id"]
    keyed = hilbert(quantise(narrow, dims, bits), dims, bits, "hilbert")
    order = ["hilbert", "doc_id", "size", "text_crc32"]
    placed = written(keyed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("__id", F.monotonically_increasing_id()), "shard-order")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = placed.count()
    # exact integer arithmetic: shard = rank * shards div total; its first rank is shard * total / shards, rounded up
    return (placed.withColumn("part", part).join(starts, "part")
            .withColumn("rank", F.col("before") + place)
            .withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
            .withColumn("slot", F.expr(f"rank - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "hilbert"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, bits: int = BITS) -> None:
    """Write all columns of ``docs`` as ``shard=N`` folders of files sorted by Hilbert index and doc_id.

    Shards are looked up by doc_id, which must be unique and not null here."""
    where = shard(docs, shards, bits).select("doc_id", "shard", "slot")
    (docs.drop("shard", "slot").join(where, "doc_id").repartitionByRange("shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
