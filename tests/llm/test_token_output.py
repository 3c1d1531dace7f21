"""Encoder, range coder, token files and rollups: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabwright.llm import token_codec as C
from tabwright.llm.queries import QUERIES, bpe_path
from tabwright.llm.token_rollup import Rollup, count_tokens
from tabwright.llm.tokens import PieceEncoder, encoder

LIB = Tokenizer.from_file(bpe_path())
LIB.encode_special_tokens = True


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aBé1 .,!?\n\t'_", "  ", "'s", "\x1c", "\xa0", "日", "😀", "\u0301", "²"]), max_size=20))
def test_pieces_give_the_library_ids(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder(bpe_path()).encode_many([text])[0], "<u4").tolist() == ids(text)


def test_memo_limit_and_special_strings(monkeypatch):
    monkeypatch.setattr("tabwright.llm.tokens.MEMO_LIMIT", 10)
    enc = PieceEncoder(bpe_path())
    texts = [f"word{i} and, then. Some<|endoftext|> more {i}" for i in range(60)] + [None, "", " ", "x "]
    for lo in range(0, len(texts), 7):
        got = enc.encode_many(texts[lo:lo + 7])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts[lo:lo + 7]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", "a", " ", "  ", "b c", "\n", "."]), max_size=12))
def test_added_tokens_are_the_librarys(parts):
    texts = ["".join(parts), "a <|endoftext|> b", "plain text", None, ""]
    lib = Tokenizer.from_file(bpe_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(bpe_path()).encode_many(texts)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[1] == [64, 220, 50256, 275]


@pytest.mark.parametrize("n", [1, 63, 64, 129, 5000, 70_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for x in (rng.integers(0, 50257, n), np.full(n, 50256), np.arange(n) % 7, rng.zipf(1.3, n) % 50257):
        p = C.encode_block(x.astype(np.int64), 50257)
        assert (C.decode_block(p) == x).all()
    damaged = bytearray(p)
    damaged[20 + 2 * C._runs(n)[0] + 3] ^= 0x40  # in the first run's first word
    if n > 64:
        with pytest.raises((ValueError, IndexError)):
            C.decode_block(bytes(damaged))


def test_repeating_ids_cost_little():
    x = np.tile(np.random.default_rng(0).integers(0, 50257, 500), 100)
    assert len(C.encode_block(x, 50257)) < 0.3 * 2 * len(x)


@given(st.binary(max_size=40), st.binary(max_size=40))
def test_checksums_combine(a, b):
    assert C.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files(spark, tmp_path):
    rows = [(5, "five words stand in here " * 50), (2, None), (9, ""), (2, "again two"), (None, "no id"), (7, "x " * 9000),
            (5, "five words stand in here " * 50)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, start string, file int")
    path = str(tmp_path / "files")
    C.write_token_files(df, path, bpe_path(), end_id=0, block_ids=1000)
    got = sorted(C.document_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 5, 7, 9]
    at = 0
    want = sorted((len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 0], "<u4").tobytes())) for _, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want
    whole = {}
    for r in sorted(C.decode_pieces(C.read_token_files(spark, path)).collect(), key=lambda r: (r.file, r.doc_row, r.doc_at)):
        whole[r.file, r.doc_row] = whole.get((r.file, r.doc_row), b"") + r.ids
    assert sorted(zlib.crc32(w) for w in whole.values()) == sorted(c for _, c in want)
    empty = C.token_output(df.limit(0), bpe_path())
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_op10_is_what_the_library_gives(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op10_token_output"](spark, sf).collect()))
    at, want = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        x = np.array([*ids(r.text), 0], "<u4")
        want.append((r.doc_id, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want


CHANGE = "doc_id long, version string, op string, source string, lang string, tokens long"


def test_rollup_batches(spark, tmp_path):
    roll = Rollup(spark, str(tmp_path / "roll"))
    totals = lambda: sorted(map(tuple, roll.totals().collect()), key=str)
    assert totals() == []
    rows = [(1, "v", "insert", "a", "en", 5), (2, "v", "insert", "a", "en", 7), (3, "v", "insert", None, None, None),
            (3, "v", "insert", None, None, None), (1, "w", "insert", "a", "en", 6)]
    assert roll.commit(1, spark.createDataFrame(rows, CHANGE))
    first = [("a", "en", "v", 2, 12), ("a", "en", "w", 1, 6), (None, None, "v", 2, 0)]
    assert totals() == sorted(first, key=str)
    change = spark.createDataFrame([(2, "v", "delete", None, None, None), (9, "v", "delete", None, None, None),
                                    (1, "v", "revise", "b", "en", 4)], CHANGE)
    assert roll.commit(2, change) and not roll.commit(2, change)
    second = [("b", "en", "v", 1, 4), ("a", "en", "w", 1, 6), (None, None, "v", 2, 0)]
    assert totals() == sorted(second, key=str)
    # an attempt that died before its marker is not seen, and is overwritten by the next one
    change.write.parquet(str(tmp_path / "roll/ledger/batch_id=3"))
    assert totals() == sorted(second, key=str)
    assert roll.commit(3, spark.createDataFrame([(2, "v", "insert", "a", "en", 1)], CHANGE))
    assert totals() == sorted([*second, ("a", "en", "v", 1, 1)], key=str)
    assert roll.commit(4, spark.createDataFrame([], CHANGE)) and len(totals()) == 4
    for bad in [(1, None, "insert", "a", "en", 1), (1, "v", "put", "a", "en", 1)]:
        with pytest.raises(ValueError):
            roll.commit(5, spark.createDataFrame([bad], CHANGE))


def test_rollup_rows_that_share_an_id(spark, tmp_path):
    """All rows of one id, null included, count; a revision or delete concerns all of them."""
    roll = Rollup(spark, str(tmp_path / "roll"))
    totals = lambda: sorted(map(tuple, roll.totals().collect()), key=str)
    rows = [(None, "v", "insert", "a", "en", 3), (None, "v", "insert", "a", "en", 5), (None, "v", "insert", "b", "en", 1),
            (7, "v", "insert", "a", "en", 3), (7, "v", "insert", "a", "en", 5), (7, "w", "insert", "a", "en", 2)]
    assert roll.commit(1, spark.createDataFrame(rows, CHANGE))
    assert totals() == [("a", "en", "v", 4, 16), ("a", "en", "w", 1, 2), ("b", "en", "v", 1, 1)]
    assert roll.commit(2, spark.createDataFrame([(None, "v", "revise", "c", "en", 4)], CHANGE))
    assert totals() == [("a", "en", "v", 2, 8), ("a", "en", "w", 1, 2), ("c", "en", "v", 1, 4)]
    assert roll.commit(3, spark.createDataFrame([(7, "v", "delete", None, None, None)], CHANGE))
    assert totals() == [("a", "en", "w", 1, 2), ("c", "en", "v", 1, 4)]
    assert roll.commit(4, spark.createDataFrame([(9, "v", "insert", "a", "en", 6, 3)], CHANGE + ", docs long"))
    assert totals() == [("a", "en", "v", 3, 6), ("a", "en", "w", 1, 2), ("c", "en", "v", 1, 4)]


def test_op2_counts_rows_without_and_with_one_id(spark, tmp_path):
    rows = [(None, "one two", "en", "s"), (None, "three", "en", "s"), (4, "four five six", "en", "s"),
            (4, "", "en", "s"), (5, "three", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens)
           for r in QUERIES["op2_token_rollup"](spark, str(tmp_path)).collect()}
    n = sum(len(ids(t)) for _, t, _, _ in rows[:4])
    v, w = "byte_bpe_50k", "byte_bpe_50k+end"
    k = len(ids("three"))
    assert got == {("s", "en", v): (4, n + 1), ("s", "en", w): (4, n + 4), (None, "en", v): (1, k),
                   (None, "en", w): (1, k + 1)}


def test_op2_totals(spark):
    sf = "/root/testdata/sf0.001"
    docs = {}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        docs.setdefault(r.text, (r.source, r.lang, len(ids(r.text))))
    want = {}
    for s, lang, n in docs.values():
        for version, m in (("byte_bpe_50k", max(n, 1)), ("byte_bpe_50k+end", n + 1)):
            d, t = want.get((s, lang, version), (0, 0))
            want[s, lang, version] = (d + 1, t + m)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in QUERIES["op2_token_rollup"](spark, sf).collect()}
    assert got == want


def test_counts_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5)], "doc_id long, text string, n_tokens int")
    assert [r.n_tokens for r in count_tokens(df, bpe_path()).orderBy("doc_id").collect()] == [0, 0, 2]


def test_ends_and_repeats_of_pieces_and_little_memory():
    """First, repeated and last pieces, spaces at either end; a batch's pieces are not held one by one."""
    import tracemalloc
    enc = PieceEncoder(bpe_path())
    texts = [" ", "a", " a", "a ", " a b a ", "é 日 a, a, b.", "\ta", "a\nb a", None, "", "a  b", "x a a a"]
    assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode_many(texts)] == [ids(t) for t in texts]
    texts = ["some words, and others. " * 400 + f"{i}" for i in range(400)]
    tracemalloc.start()
    try:
        got = enc.encode_many(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.frombuffer(got[7], "<u4").tolist() == ids(texts[7])
    assert peak < 35e6
