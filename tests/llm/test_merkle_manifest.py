"""Merkle manifest: nodes and proofs against a plain tree in memory."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([sha("".join(a[i:i + 16])) for i in range(0, len(a), 16)])
    return levels


def siblings(levels, i):
    out = []
    for a in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(a[run:i]), "".join(a[i + 1:run + 16])))
        i //= 16
    return out


def plain_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                       for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_manifest(rows):
    """Rows as ``manifest`` returns them, by whole trees."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((plain_leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {s: tree([x[0] for x in groups[s]]) for s in order}
    crown = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (leaf, r) in enumerate(groups[s]):
            proof = siblings(trees[s], i) + siblings(crown, k)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf(r, text)
            for left, right in proof:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf, trees[s][-1][0], crown[-1][0], sha("".join(a + b for a, b in proof)), folded,
                        folded == crown[-1][0]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 700), st.lists(st.integers(0, 700), max_size=6))
def test_sections_give_the_plain_tree(n, cuts):
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    cuts = sorted({0, n, *[c for c in cuts if c < n]})
    sections = list(zip(cuts, cuts[1:], strict=False))
    nodes = {}
    for a, b in sections:
        for level, i, count, d in M.edge_nodes(leaves[a:b], a, n):
            assert count == len(levels[level]) and levels[level][i] == d
            assert (level, i) not in nodes
            nodes[level, i] = d
    # runs over edges come together level by level
    for level in range(len(levels) - 1):
        runs = {i // 16 for lv, i in nodes if lv == level}
        for r in runs:
            run = [nodes[level, i] for i in range(r * 16, min(r * 16 + 16, len(levels[level])))]
            nodes[level + 1, r] = sha("".join(run))
    assert nodes[len(levels) - 1, 0] == levels[-1][0]
    for a, b in sections:
        wanted = list(M.missing(a, b - a, n))
        assert len(set(wanted)) == len(wanted) <= 30 * len(levels)
        fetched = {c: nodes[c] for c in wanted}  # all of them are edge nodes
        got = list(M.paths(M.octopus(leaves[a:b], a, n, fetched), a, b - a, [("x", "y")]))
        for i, (steps, joined) in zip(range(a, b), got, strict=True):
            assert steps == [*siblings(levels, i), ("x", "y")]
            assert joined == "".join(x + y for x, y in steps)
            assert M.fold(leaves[i], steps[:-1]) == levels[-1][0]


def test_every_coordinate_is_needed():
    """No coordinate of the union can be left out: the interiors can't be derived without it."""
    leaves = [sha(str(i)) for i in range(300)]
    levels = tree(leaves)
    wanted = list(M.missing(37, 50, 300))
    for out in wanted:
        fetched = {(lv, i): levels[lv][i] for lv, i in wanted if (lv, i) != out}
        with pytest.raises(KeyError):
            M.octopus(leaves[37:87], 37, 300, fetched)


@pytest.fixture
def rows():
    sources = ["s1", None, "", "zß", "s1", "s1", "10"]
    out = [{"doc_id": i, "text": f"Text {i} Ünd A" * (i % 4), "lang": "en" if i % 7 else None, "source": sources[i % 7],
            "n_chars": i if i % 5 else None} for i in range(900)]
    out += [dict(out[3]), dict(out[3]), {**out[4], "text": "other"}, {**out[5], "doc_id": None}, {**out[6], "text": None},
            {**out[7], "doc_id": 5000, "text": "X" * 200_000}, {**out[8], "source": "alone", "doc_id": 7000}]
    return out


def test_manifest_is_the_plain_one(spark, rows, monkeypatch):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows],
                                 SCHEMA)
    docs = docs.withColumns({"leaf": F.lit("mine"), "grp": F.lit(1), "part": F.lit("p")})
    monkeypatch.setattr(M, "MAX_LEAVES", 90)  # partitions cut through groups
    got = M.manifest(docs, presented=M.lowered_where("doc_id"), with_proofs=True).collect()

    def key(r):
        return tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(plain_manifest(rows), key=key)
    assert not all(r["verified"] for r in got)
    for r in got[:50]:
        steps = [(s["left"], s["right"]) for s in r["proof"]]
        assert M.fold(r["leaf"], steps) == r["root"]


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.manifest(none).collect() == []
    one = M.manifest(spark.createDataFrame([(1, "a", None, None, 1)], SCHEMA)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"]
    assert one["proof_sha256"] == sha("")
    # a last run of one is hashed like any other
    seventeen = [(i, str(i), "en", "s", 1) for i in range(17)]
    got = M.manifest(spark.createDataFrame(seventeen, SCHEMA)).orderBy("doc_id").collect()
    leaves = [r["leaf"] for r in got]
    assert got[0]["root"] == sha(sha("".join(leaves[:16])) + sha(leaves[16]))
    assert got[16]["proof_sha256"] == sha(sha("".join(leaves[:16])))
