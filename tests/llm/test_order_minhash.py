"""Order MinHash: signatures against a plain version, edits against plain slices, likeness against edit distance."""

import hashlib
import re
import struct
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabwright.llm import order_minhash as M

MASK = (1 << 64) - 1


def xx(data, seed):
    return xxhash.xxh64_intdigest(data, seed)


def xx_longs(values, seed=42):
    for v in values:
        seed = xx(struct.pack("<Q", v & MASK), seed)
    return seed


def signature(text, k=2, bins=64, ell=2, p=M.PLACE_BITS):
    tokens = re.findall(r"[^ \t\n\x0b\x0c\r]{1,8}", text or "")
    seen, found = {}, []
    for i in range(max(len(tokens) - k + 1, min(len(tokens), 1))):
        h = 42
        for t in tokens[i:i + k]:
            h = xx(t.encode(), h)
        gram = h >> p
        n = seen[gram] = seen.get(gram, -1) + 1
        if n:
            gram = xx(struct.pack("<i", n), xx(struct.pack("<Q", gram), 42)) >> p
        found.append((gram, i))
    # numbers are ordered as signed ones; bins go by the top bits
    found.sort(key=lambda x: ((x[0] << p | x[1]) ^ (1 << 63)))
    top = 64 - p - bins.bit_length() + 1
    out = []
    for b, run in groupby(found, key=lambda x: x[0] >> top):
        chosen = sorted(list(run)[:ell], key=lambda x: x[1])
        out.append(b << 16 | (xx_longs([g for g, _ in chosen]) & 0xFFFF))
    return out


def alike(a, b):
    filled = {x >> 16 for x in a} | {x >> 16 for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


TEXTS = ["", None, "a", "one two", "one two one two one two one two", "x " * 3000, "日本語のテキスト" * 20, "é" * 40,
         " lead and trail \n\t", "The cat sat on the mat. " * 50 + "End", "a b c"]


@pytest.mark.parametrize("k, bins, ell", [(2, 64, 2), (1, 16, 3), (3, 8, 1)])
def test_signatures_are_the_plain_ones(spark, k, bins, ell):
    rng = np.random.default_rng(k)
    texts = TEXTS + [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 300) for n in (5, 40, 400, 4000)]
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, fingerprint string, place int")
    rows = M.fingerprints(docs, k=k, bins=bins, ell=ell).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = signature(texts[r["doc_id"]], k, bins, ell)
        assert sorted(r["signature"]) == sorted(want), texts[r["doc_id"]]
        assert r["place"] == 1
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[1] == "" and len(set(prints.values())) == len(texts) - 1


def plain_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(),
                    round(alike(signature(t), signature(edited)), 9), round(alike(signature(t), signature(nxt)), 9)))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, h string, sig int")
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
            for r in M.edits(docs).collect()]


def test_edits_are_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)  # many blocks; the first row follows the last
    rows = [(10 * i - 30, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all here")]
    rows += [(1000 + i, f"some words {i} and {'more ' * (i % 5)}😀{i}") for i in range(23)]
    assert sorted(run(spark, rows), key=key) == sorted(plain_edits(rows), key=key)


def test_repeated_rows(spark):
    rows = [(1, "a b c d"), (2, "same text of two rows"), (2, "same text of two rows"), (2, "same text of two rows"),
            (3, "x y z")]
    assert sorted(run(spark, rows), key=key) == sorted(plain_edits(rows), key=key)
    assert len(run(spark, [(None, "a"), (None, "b"), (None, "a"), (7, None)])) == 4


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, "alone with itself")]) == plain_edits([(5, "alone with itself")])
    assert run(spark, [(5, "a b c d"), (6, "e f")]) == plain_edits([(5, "a b c d"), (6, "e f")]) or sorted(
        run(spark, [(5, "a b c d"), (6, "e f")])) == sorted(plain_edits([(5, "a b c d"), (6, "e f")]))


def test_likeness_falls_with_edits_and_minds_order(spark):
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.integers(0, 900, 1500)]
    versions = [words]
    for n in (5, 50, 300):
        w = list(words)
        for i in rng.integers(0, len(w), n):
            w[i] = f"new{int(i)}"
        versions.append(w)
    swapped = words[750:] + words[:750]  # the same k-mers but one, in another order
    versions += [swapped, [f"other{i}" for i in range(1500)]]
    docs = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(versions)], "doc_id long, text string")
    sigs = {r["doc_id"]: r["signature"] for r in M.fingerprints(docs).collect()}
    near = [alike(sigs[0], sigs[i]) for i in range(len(versions))]
    assert near[0] == 1 and near[1] > 0.9 and near[1] > near[2] > near[3] > near[5] == 0
    assert near[4] < 0.7  # a plain MinHash of these k-mers would say 1


def test_equal_texts_equal_fingerprints(spark):
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(44)], "doc_id long, text string")
    got = M.edits(docs).groupBy(F.col("doc_id") % len(TEXTS)).agg(F.countDistinct("fingerprint").alias("n")).collect()
    assert all(r["n"] == 1 for r in got)
