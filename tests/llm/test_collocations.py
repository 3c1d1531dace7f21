"""Collocations: SON candidates, exact counts and scores against plain counting."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwright.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]


def plain_counts(rows, words=4):
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, words + 1):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f


def plain(rows, least, top):
    f = plain_counts(rows)
    out = []
    for lang in {x for x, _ in f}:
        mine = {p: n for (x, p), n in f.items() if x == lang}
        n = sum(c for p, c in mine.items() if len(p) == 1)
        cand = {p: a for p, a in mine.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            cuts = [(2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k, mine[p[:k]], mine[p[k:]]) for k in range(1, len(p))]
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, b in cand.items())
            if not inside:
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s)
                for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé .,\t\n\x0b\x0c\r\x85\xa0!日😀"), max_size=30), min_size=1, max_size=5))
def test_blocks_find_the_words(texts):
    block = C.Block([t.encode() for t in texts if t])  if any(texts) else None
    if block is None:
        return
    want = [w for t in texts if t for w in pieces(t)]
    words = [block.vocabulary[i].decode() for i in block.ids]
    assert words == [x for w in want for x in w]
    h = block.hashes(7)
    for k in (1, 2, 3, 4):
        at, hashed = block.phrases(h, k)
        got = [tuple(words[i:i + k]) for i in at]
        assert got == [tuple(w[i:i + k]) for w in want for i in range(len(w) - k + 1)]
        assert len(set(zip(got, hashed.tolist(), strict=True))) == len(set(got)) == len(set(hashed.tolist()))
        counted = {tuple(block.vocabulary[i].decode() for i in row): n
                   for ids, ns in C._counted(block.ids, at, k, len(block.vocabulary)) for row, n in zip(ids, ns, strict=True)}
        assert counted == Counter(got)


ROWS = ([("en", "The cat sat. the Cat sat on, the mat")] * 12 + [("en", "new york new york new york")] * 5
        + [(None, "sin idioma aquí; sin idioma")] * 6 + [("de", "Ärger ärger ÄRGER mit mit mit mit")] * 4
        + [("en", None), ("en", ""), ("fr", "   \t"), ("de", "a" * 200_000), ("en", "x y\x85z w v " * 300)]
        + [("en", f"w{i} is w{i % 7} of w{i % 3}") for i in range(200)])


@pytest.mark.parametrize("least, shards, sizes", [(5, 4, {}), (3, 2, {"block_bytes": 200, "range_entries": 64}),
                                                  (8, 8, {"block_bytes": 1000}), (1, 3, {}), (4, 1, {})])
def test_collocations_are_the_plain_ones(spark, least, shards, sizes):
    docs = spark.createDataFrame([(t, x, 1, 2) for x, t in ROWS], "text string, lang string, n long, score long")
    got = C.collocations(docs.repartition(5), least=least, top=40, shards=shards, **sizes)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(ROWS, least, 40)


def test_no_frequent_phrase_is_missed_by_the_shards(spark):
    """Every phrase with the support is a candidate, and the bitmap does drop others."""
    rng = np.random.default_rng(1)
    rows = [("en", " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) % 5000)) for _ in range(200)]
    docs = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string").repartition(12)
    want = {(x, " ".join(p)): n for (x, p), n in plain_counts(rows).items() if n >= 30}
    sizes = {"block_bytes": 4000, "range_entries": 1 << 12}
    got = C.frequencies(docs, least=30, **sizes).where("phrase IS NOT NULL").collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in got} == want
    from pyspark.sql import functions as F
    bitmap, ranges = C.candidates(C._texts(docs, F.col("lang"), F.col("text")), 4, 30, **sizes)
    assert ranges > 1
    assert len(want) <= int(np.unpackbits(bitmap).sum()) < len(plain_counts(rows)) / 10


def test_sql_is_the_plain_one():
    con = duckdb.connect()
    con.execute("create table documents(lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r for r in ROWS if r[1] is None or len(r[1]) < 10_000])
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 10_000]
    got = con.sql(C.collocations_sql(least=5, top=40)).df()[COLUMNS]
    assert sorted(map(tuple, got.values.tolist())) == plain(rows, 5, 40)


def test_scores_beyond_64_bits(spark):
    """The score's arithmetic holds for counts whose products pass 64 bits."""
    big = 3 * 10**18
    got = spark.sql(f"select (cast({big}L as decimal(20, 0)) * 2000000) div (cast({big}L as decimal(20, 0)) + "
                    f"cast({big + 1}L as decimal(20, 0))) as s").first()["s"]
    assert got == 2_000_000 * big // (2 * big + 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(none).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []
    with pytest.raises(ValueError):
        C.collocations(none, words=1)
