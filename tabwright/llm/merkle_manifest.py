"""Merkle manifest of a dataset, with membership proofs of every row by an octopus multiproof.

A row's digest is a leaf; the leaves of a group (a source) form a tree of ``ARITY`` children a node, and the groups'
roots a tree above them. Leaves are put in order by one range shuffle of narrow rows (no text). A partition then holds
runs of consecutive leaves ("sections", one per group), and everything else is local to sections:

* ``plant`` computes every node a section determines alone and keeps those at its edges, whose parent it can't
  compute. A partition has two sections at most that don't hold their whole group, so the edge nodes are at most
  ``2 * 2 * (ARITY - 1)`` a level and partition, whatever the number of rows. Parents over edges are grouped level by level.
* ``expand`` lists per section the minimal union of the node coordinates that its leaves' proofs need and that the
  section can't derive (at most ``2 * (ARITY - 1)`` a level), fetches them in one join with the edge nodes, derives the
  shared interiors once, and expands each leaf's own proof from them.

Digests are lowercase hex sha256, and a node hashes its children's hex text. A tree over one leaf is that leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import cut_lineage, written

ARITY = 16
MAX_LEAVES = 1 << 17  # leaves of a partition, about
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """sha256 of the values' texts, each as UTF-8 byte count, ``:`` and value, or ``-`` for null."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _up(n: int) -> int:
    return -(-n // ARITY)


def edge_nodes(digests: list[str], start: int, total: int) -> Iterator[tuple[int, int, int, str]]:
    """Of leaves ``start``.. of a tree of ``total``: (level, index, nodes of the level, digest) of the nodes that the
    leaves determine and whose parent they don't; the root if the leaves are all."""
    level, first, nodes, count = 0, start, digests, total
    while nodes:
        end = first + len(nodes)
        lo, hi = _up(first), _up(end) if end == count else end // ARITY
        if count == 1 or lo >= hi:
            yield from ((level, first + i, count, d) for i, d in enumerate(nodes))
            return
        head, tail = lo * ARITY - first, min(hi * ARITY - first, len(nodes))
        yield from ((level, first + i, count, nodes[i]) for i in (*range(head), *range(tail, len(nodes))))
        nodes = [digest("".join(nodes[i:min(i + ARITY, tail)])) for i in range(head, tail, ARITY)]
        level, first, count = level + 1, lo, _up(count)


def missing(start: int, n: int, total: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that proofs of ``n`` leaves from ``start`` need beside what those determine."""
    level, a, b, count = 0, start, start + n, total
    while count > 1:
        lo, hi = a // ARITY * ARITY, min(_up(b) * ARITY, count)
        yield from ((level, i) for i in (*range(lo, a), *range(b, hi)))
        level, a, b, count = level + 1, a // ARITY, _up(b), _up(count)


def octopus(digests: list[str], start: int, total: int, fetched: dict[tuple[int, int], str]
            ) -> list[tuple[int, list[str]]]:
    """Per level below the root: (index of the first node, the nodes of all runs that the leaves' proofs touch)."""
    levels, a, nodes, count = [], start, digests, total
    while count > 1:
        b, level = a + len(nodes), len(levels)
        lo, hi = a // ARITY * ARITY, min(_up(b) * ARITY, count)
        runs = [*(fetched[level, i] for i in range(lo, a)), *nodes, *(fetched[level, i] for i in range(b, hi))]
        levels.append((lo, runs))
        nodes = [digest("".join(runs[i:i + ARITY])) for i in range(0, len(runs), ARITY)]
        a, count = lo // ARITY, _up(count)
    return levels


def paths(levels: list[tuple[int, list[str]]], start: int, n: int, above: list[tuple[str, str]]
          ) -> Iterator[tuple[list[tuple[str, str]], str]]:
    """Each leaf's proof, as (digests left of the node, right of it) level by level and as all digests joined."""
    shared: dict[int, tuple[list[tuple[str, str]], str]] = {}
    top = (above, "".join(x + y for x, y in above))
    spans = [(start, n)]
    for _ in levels:
        a, k = spans[-1]
        spans.append((a // ARITY, (a + k - 1) // ARITY - a // ARITY + 1))
    for depth in range(len(levels) - 1, -1, -1):
        (lo, nodes), (a, k) = levels[depth], spans[depth]
        below = {}
        for i in range(a, a + k):
            j = i - lo
            run = j // ARITY * ARITY
            left, right = "".join(nodes[run:j]), "".join(nodes[j + 1:run + ARITY])
            steps, joined = shared[i // ARITY] if shared else top
            below[i] = ([(left, right), *steps], left + right + joined)
        shared = below
    for i in range(start, start + n):
        yield shared[i] if shared else top


def fold(value: str, steps: Iterable[tuple[str, str]]) -> str:
    for left, right in steps:
        value = digest(left + value + right)
    return value


@dataclass
class Forest:
    """A tree per group over ordered leaves."""
    leaves: DataFrame    # part, at (place in the partition), grp, digest and the columns carried along; checkpointed
    sections: DataFrame  # part, grp, first (place in the partition), n, start (index in the group), total
    nodes: DataFrame     # grp, level, idx, count, digest: nodes at the edges of sections and above them
    roots: DataFrame     # grp, root


def plant(rows: DataFrame, order: list[Column | str], n_rows: int) -> Forest:
    """Trees over the ``digest`` of ``rows`` (grp, digest, ...), a tree per ``grp`` (not null), leaves ascending by
    ``order`` (ties: digest, then the order of reading, which can't be told from the result)."""
    spark = rows.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, -(-n_rows // MAX_LEAVES), min(-(-n_rows // 4096), wanted))
    keys = ["grp", *order, "digest", "__tie"]
    leaves = cut_lineage(
        rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys).withColumn("__tie", F.monotonically_increasing_id())
        .withColumns({"part": F.shiftright("__tie", 33), "at": F.col("__tie").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("__tie"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sections = cut_lineage(
        leaves.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")),
                      "total": F.sum("n").over(Window.partitionBy("grp"))}))
    # groups that lie in one partition whole start at 0 and end there, so only the first and the last section of a
    # partition can lack a part: two rows a partition tell a task all it needs
    edge = sections.where("start > 0 or start + n < total").select("part", "grp", "start", "total").collect()
    partial = {(r["part"], r["grp"]): (r["start"], r["total"]) for r in edge}

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done():
            start, total = partial.get(key, (0, len(held)))
            out = list(edge_nodes(held, start, total))
            return pd.DataFrame({"grp": [key[1]] * len(out), "level": [x[0] for x in out], "idx": [x[1] for x in out],
                                 "count": [x[2] for x in out], "digest": [x[3] for x in out]})
        for b in batches:
            for k, g in b.groupby(["part", "grp"], sort=False):
                if key is not None and k != key:
                    yield done()
                    held = []
                key = k
                held.extend(g["digest"].tolist())
        if key is not None:
            yield done()

    schema = "grp string, level int, idx long, count long, digest string"
    edges = cut_lineage(leaves.select("part", "grp", "digest").mapInPandas(climb, schema))
    height, most = 0, sections.agg(F.max("total")).first()[0] or 0
    while most > 1:
        height, most = height + 1, _up(most)
    known = edges.where("level = 0")
    nodes = known
    for level in range(height):
        run = F.expr(f"idx div {ARITY}")
        above = (known.where("count > 1").groupBy("grp", run.alias("idx"), "count")
                 .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
                 .select("grp", F.lit(level + 1).alias("level"), "idx",
                         F.expr(f"(count + {ARITY - 1}) div {ARITY}").alias("count"),
                         F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest")))
        known = edges.where(F.col("level") == level + 1).unionByName(above)
        nodes = nodes.unionByName(known)
    nodes = cut_lineage(nodes)
    return Forest(leaves, sections, nodes, nodes.where("count = 1").select("grp", F.col("digest").alias("root")))


def expand(forest: Forest, about: DataFrame, prove: Callable[..., dict], schema: str) -> DataFrame:
    """Rows of ``prove(leaves, proofs, about)`` per section: ``leaves`` is a pandas frame of consecutive leaves,
    ``proofs`` what ``paths`` gives for them, ``about`` the group's row of ``about`` (grp, above, ...), whose ``above``
    continues every proof beyond the group's root. ``schema`` names the columns returned."""
    coordinates = forest.sections.select("part", "grp", "start", "n", "total")

    def needed(batches):
        for b in batches:
            rows = [(r.part, r.grp, level, i) for r in b.itertuples(index=False)
                    for level, i in missing(r.start, r.n, r.total)]
            yield pd.DataFrame(rows, columns=["part", "grp", "level", "idx"])

    fetched = (coordinates.mapInPandas(needed, "part long, grp string, level int, idx long")
               .join(forest.nodes.drop("count"), ["grp", "level", "idx"])
               .groupBy("part", "grp").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched")))
    told = forest.sections.join(fetched, ["part", "grp"], "left").join(about, "grp")
    told = told.select(*[F.col(c).alias(c) for c in told.columns])  # other columns than those of the leaves

    def local(leaves: pd.DataFrame, sections: pd.DataFrame) -> pd.DataFrame:
        out = []
        leaves = leaves.sort_values("at", ignore_index=True)
        for s in sections.itertuples(index=False):
            mine = leaves.iloc[s.first:s.first + s.n]
            found = {(x["level"], x["idx"]): x["digest"] for x in (s.fetched if s.fetched is not None else ())}
            levels = octopus(mine["digest"].tolist(), s.start, s.total, found)
            above = [(x["left"], x["right"]) for x in s.above]
            out.append(pd.DataFrame(prove(mine, paths(levels, s.start, s.n, above), s)))
        return pd.concat(out) if out else pd.DataFrame()

    return forest.leaves.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(local, schema)


ABOVE = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             group: str = "source", order: str = "doc_id", presented: dict[str, Column] | None = None,
             with_proofs: bool = False) -> DataFrame:
    """Every row's place in the Merkle tree of ``docs``, and whether the row as presented verifies.

    ``presented`` replaces columns by what a reader was handed; it is folded with the proofs of ``docs`` as they are.
    Columns: ``order`` (doc_id), leaf, subroot (root of the row's group), root, proof_sha256 (of the proof's digests,
    from the leaf to the root, left to right), folded_root, verified; ``proof`` (array of left and right digests a
    level) with ``with_proofs``. Nulls are part of a leaf (``-``); a null group is a group of its own and the first, a
    null order value comes first. Rows that share a group and an order value stand in the order of their leaves, and
    repeated rows each have a leaf. Texts enter whole. An empty table gives no row. Columns that aren't named are not
    read; every row of the result stems from one row of ``docs``.
    """
    own = leaf(*[F.col(f) for f in fields])
    shown = leaf(*[(presented or {}).get(f, F.col(f)) for f in fields]) if presented else F.lit(None).cast("string")
    # a group's key orders like the group, null first
    rows = written(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(order).alias("key"), own.alias("digest"), shown.alias("shown")), "merkle-leaves")
    trees = plant(rows, [F.col("key").asc_nulls_first()], rows.count())
    n_groups = trees.roots.count()
    crown = plant(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("digest")),
                  [F.col("of")], n_groups)

    def above(leaves, proofs, about):
        return {"grp": leaves["of"], "subroot": leaves["digest"], "root": about.root,
                "above": [[{"left": x, "right": y} for x, y in p] for p, _ in proofs]}

    none_above = crown.roots.select("grp", "root", F.array().cast(ABOVE).alias("above"))
    about = expand(crown, none_above, above, f"grp string, subroot string, root string, above {ABOVE}")

    def prove(leaves, proofs, about):
        steps, joined = zip(*proofs, strict=True)
        given = leaves["shown"].fillna(leaves["digest"])
        folded = [fold(d, p) for d, p in zip(given, steps, strict=True)]
        out = {order: leaves["key"], "leaf": leaves["digest"], "subroot": about.subroot, "root": about.root,
               "proof_sha256": [digest(p) for p in joined], "folded_root": folded,
               "verified": [f == about.root for f in folded]}
        if with_proofs:
            out["proof"] = [[{"left": x, "right": y} for x, y in p] for p in steps]
        return out

    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean" + (f", proof {ABOVE}" if with_proofs else ""))
    return expand(trees, cut_lineage(about), prove, schema)


def lowered_where(key: str, text: str = "text", divisor: int = 5) -> dict[str, Column]:
    """A tampering: the text's A-Z in lower case in rows whose key's crc32 (as decimal text) ``divisor`` divides."""
    hit = F.crc32(F.col(key).cast("string")) % divisor == 0
    return {text: F.when(hit, F.translate(F.col(text).cast("string"), UPPER, LOWER)).otherwise(F.col(text))}


def manifest_sql(table: str = "documents") -> str:
    """DuckDB SQL of ``manifest(documents, presented=lowered_where("doc_id"))`` by plain recursion over all levels."""
    def enc(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def whole(text):
        return f"sha256(concat({', '.join(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"

    def tree(name, leaves):
        return f"""{name}(level, grp, idx, cnt, h) AS (
  SELECT 0, grp, idx, cnt, h FROM {leaves}
  UNION ALL
  SELECT level + 1, grp, idx // {ARITY}, (cnt + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY idx))
  FROM {name} WHERE cnt > 1 GROUP BY level, grp, idx // {ARITY}, cnt)"""

    def fold_up(name, nodes, start):
        return f"""{name}(level, doc_id, grp, idx, cnt, own, folded, proof) AS (
  {start}
  UNION ALL
  SELECT f.level + 1, f.doc_id, f.grp, f.idx // {ARITY}, (f.cnt + {ARITY - 1}) // {ARITY}, any_value(f.own),
         sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.folded ELSE t.h END, '' ORDER BY t.idx)),
         any_value(f.proof) || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx <> f.idx), '')
  FROM {name} f JOIN {nodes} t ON t.level = f.level AND t.grp = f.grp AND t.idx // {ARITY} = f.idx // {ARITY}
  WHERE f.cnt > 1 GROUP BY f.level, f.doc_id, f.grp, f.idx, f.cnt)"""

    bit = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),"
           f" lambda c: ascii(c)::BIGINT)), lambda r, c: {bit.replace('[x', '[xor(r, c)')}))")
    return f"""
WITH RECURSIVE shown AS (
  SELECT *, {crc} % 5 = 0 AS hit,
         CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS handed FROM {table}),
docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {whole('text')} AS h, {whole('handed')} AS given FROM shown),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
         count(*) OVER (PARTITION BY grp) AS cnt FROM docs),
{tree('nodes', 'leaves')},
roots AS (SELECT '' AS grp, grp AS of_grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS cnt, h
          FROM nodes WHERE cnt = 1),
{tree('crown', 'roots')},
{fold_up('climbed', 'nodes', "SELECT 0, doc_id, grp, idx, cnt, h, given, '' FROM leaves")},
{fold_up('topped', 'crown', '''SELECT 0, c.doc_id, r.grp, r.idx, r.cnt, c.own, c.folded, c.proof
  FROM climbed c JOIN roots r ON r.of_grp = c.grp WHERE c.cnt = 1''')}
SELECT t.doc_id, t.own AS leaf, r.h AS subroot, top.h AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root,
       t.folded = top.h AS verified
FROM topped t JOIN leaves l ON l.doc_id IS NOT DISTINCT FROM t.doc_id AND l.h = t.own
JOIN roots r ON r.of_grp = l.grp CROSS JOIN (SELECT h FROM crown WHERE cnt = 1) top
WHERE t.cnt = 1
"""
