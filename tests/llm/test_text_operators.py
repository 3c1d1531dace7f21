"""Toxicity, HTML extraction, decontamination, license scan, packing and sharding against plain versions."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tabwright.llm import decontam_template as D
from tabwright.llm import hilbert_shards as H
from tabwright.llm import html_template as W
from tabwright.llm import license_dice as Li
from tabwright.llm import packing_nnls as Pk
from tabwright.llm import toxicity_nb as T
from tabwright.llm.queries import QUERIES, bpe_path

SF = "/root/testdata/sf0.001"


# --- toxicity ---

def test_ngram_buckets_are_those_of_each_text_alone():
    texts = ["Ab, cd!", "", "x", "  wörd %% wörd ", "a\0b", "long " * 300]
    weights = np.ones(1 << T.BITS, np.float32)
    doc, bucket = T._hits(texts, weights)
    for i, t in enumerate(texts):
        _, alone = T._hits([t], weights)
        assert sorted(bucket[doc == i]) == sorted(alone)
    low = T._hits(["idiot"], weights)[1]
    assert set(low) <= set(T._hits(["such an IDIOT, really"], weights)[1])


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    clean = [f"{a}{b}" for a in "ba ke mi no tu ra".split() for b in "lon ver tis dal pen gor".split()]
    def doc(i, toxic):
        w = rng.choice(clean, rng.integers(20, 400)).tolist()
        if toxic:
            w[rng.integers(len(w))] = rng.choice(["Zugfrit!", "zugfritov", "ZUGFRITEN", "quaxol"])
        return (i, " ".join(w))
    y = [int(i % 6 == 0) for i in range(900)]
    docs = spark.createDataFrame([doc(i, y[i]) for i in range(900)] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y[i]) for i in range(900)] + [(None, 1), (5, None), (1, 0), (1, 0)],
                                   "doc_id long, toxic int")
    model = T.train(docs, labels, ~T.held_out())
    got = {r.doc_id: r for r in T.score(docs, model).select("doc_id", T.held_out().alias("held"), "score", "predicted").collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held == (i in set(held)) for i in range(900))
    assert np.mean([got[i].predicted == y[i] for i in held]) > 0.97
    assert got[9001].predicted == got[9002].predicted == 0 and got[9001].score == got[9002].score
    assert all(0 <= r.score <= 1 for r in got.values())
    # the held-out labels have no part in it
    turned = labels.withColumn("toxic", T.F.when(T.held_out(), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    again = T.train(docs, turned, ~T.held_out())
    assert np.array_equal(again.buckets, model.buckets) and np.allclose(again.weights, model.weights)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(docs, none, ~T.held_out())
    assert [r.predicted for r in T.score(docs, model).collect()] == [0, 0]
    one = T.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), ~T.held_out())
    assert T.score(docs.limit(0), one).count() == 0


def marked(n, share, per_word):
    """n documents, the first n * share of them toxic, each toxic word in ``per_word`` of them."""
    return [(i, f"plain common talk about number{i % 5} " + (f"zug{'abcdefghij'[i // per_word] * 4}" if i < n * share else "fine"))
            for i in range(n)]


@pytest.mark.parametrize("n, share, per_word", [(12, 0.5, 6), (30, 0.5, 15), (300, 0.12, 6)])
def test_rare_toxic_words_and_few_labels(spark, n, share, per_word):
    docs = marked(n, share, per_word)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.train(df, df.selectExpr("doc_id", f"int(doc_id < {n * share}) toxic"), T.F.lit(True))
    assert (model.score([t for _, t in docs]) >= 0.3).tolist() == [i < n * share for i, _ in docs]


def test_labels_beyond_the_fitted_rows_are_counted(spark, monkeypatch):
    docs = marked(300, 0.5, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.selectExpr("doc_id", "int(doc_id < 150) toxic")
    whole = T.train(df, labels, T.F.lit(True))
    monkeypatch.setattr(T, "FIT_ROWS", 20)
    few = T.train(df, labels, T.F.lit(True))
    at = T._hits(["zugaaaa"], np.ones(1 << T.BITS, np.float32))[1]
    top = lambda m: max(m.ratios[np.isin(m.buckets, at)])
    assert top(few) > top(whole)


# --- HTML ---

def page(main, i=0, extra=""):
    return (f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p><p>no';</script></head><body>"
            f"<div id=bar{i % 2}>Shop now and save{extra}</div>{main}<p>Call us at this number</p></body></html>")


def test_templates_of_a_host_go_and_shared_paragraphs_stay(spark):
    rows = [(i, f"https://www.Site.example.org:80/p{i}", page(f"<p>story {i}</p>", i)) for i in range(12)]
    rows += [(100 + i, "http://blog.example.com/x", f"<article><p>same words</p><div>Follow our channel</div><p>own {i}</p>"
              "</article>") for i in range(8)]
    rows += [(200, None, page("<p>no host</p>")), (201, "not a url", None), (202, "http://e.example", ""),
             (203, "http://lone.example", page("<p>lone</p>")), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = W.extract(df)
    assert sorted(out.columns) == ["html", "n_chars", "page_id", "text", "url"]
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == f"story {i}" for i in range(12))
    assert all(got[100 + i].text == f"same words own {i}" for i in range(8))
    assert got[200].text == "Shop now and save no host Call us at this number"
    assert got[201].text == got[202].text == ""
    assert got[203].text == "Shop now and save lone Call us at this number"
    assert W.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [W.BROADCAST_TEMPLATES, 0])
def test_boxes_of_one_section_of_a_large_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(W, "BROADCAST_TEMPLATES", broadcast)
    box = "<div>Our big autumn fair</div>"
    rows = [(i, "http://big.example/p", f"<body><p>story {i}</p>{box if i < 4 else ''}</body>") for i in range(200)]
    rows += [(1000 + i, "http://small.example/p", f"<body><p>story {i}</p>{box}</body>") for i in range(3)] + rows[:1] * 3
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text == f"story {r.page_id}" for r in got if r.page_id < 1000)
    assert all(r.text.endswith("Our big autumn fair") for r in got if r.page_id >= 1000)


@pytest.mark.parametrize("html, text", [
    ("<article><h1>A&amp;B</h1><p>x&nbsp;&lt;y&gt;<b>z</b>w<br>v<p>next</article>", "A&B x <y>zw v next"),
    ("<header>top</header><main><p>m</p><aside>s</aside><form>f</form></main><footer>b</footer>", "m"),
    ("<div class='wrap with-sidebar'><article>a<div class='ad-box'>buy</div></article><div class=sidebar>s</div></div>", "a"),
    ("<article>a<section id=comments><article class=comment>c</article></section></article>", "a"),
    ("<article>a</article><aside><article>teaser</article></aside><div id=comments><article>c</article></div>", "a"),
    ("<form><div class='layout sidebar-right'><main>m</main><div class=related><article>r</article></div></div></form>", "m"),
    ("<div class=cookie-notice>we</div><ul><li>a<li>b</ul><p>unclosed <i>it", "a b unclosed it"),
    ("<style>p{}</style><!-- <p>c</p> --><p title='a>b'>t</p><textarea>q</textarea><p", "t"),
    ("&am &copy &#x41;&#66; &quo", "&am © AB &quo"),
    ("<p>" + "<div>" * 2000 + "deep", "deep"),
    ("plain  text\n only", "plain text only"),
])
def test_page_text(html, text):
    assert W.Page(html).text(frozenset()) == text


@pytest.mark.parametrize("html, text", [
    ("<article>a<section id=discussion>d</section><section id='related-work'>r</section><h2 id=search>h</h2><h2 id=banner-1>b"
     "</h2><span class=share>s</span><div class=notice-board>n</div></article>", "a d r h b s n"),
    ("<article>a<div class=discussion>d</div><div class='share-buttons'>s</div><div id=newsletter-signup>n</div>"
     "<div class='post-body related-posts'>r</div><div class=NoticeBox>x</div></article>", "a"),
    ("<article>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>", "so x=2 holds"),
    ("<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>p<b>q<div>r</div></article>", "a b c d pq r"),
])
def test_names_inside_an_article(html, text):
    assert W.Page(html).text(frozenset()) == text


@pytest.mark.parametrize("html", [
    "<div>" * 20_000 + "</p>" * 20_000, "<div class=ad>" * 20_000 + "x", "<div>" * 20_000 + "<li></li>" * 20_000,
    "<ul><li>" + "<ul><div>" * 10_000 + "<li></li>" * 20_000, "<article>" * 20_000 + "x"])
def test_open_elements_cost_no_square(html):
    import time
    t = time.process_time()
    p = W.Page(html)
    p.subtrees(), p.text(frozenset()), p.article_hash()
    assert time.process_time() - t < 2


def test_articles_under_several_addresses_and_shared_tables(spark):
    body = "<article><h1>Title</h1><div>The body of this article</div><section>And more of it</section></article>"
    rows = [(i, f"http://mirror.example/{i}", f"<body>{body}<footer>seen {i} times</footer></body>") for i in range(5)]
    table = "<div><table><tr><td>1<td>2</table></div>"
    rows += [(100 + i, f"http://data.example/{i}", f"<article><p>part {i}</p>{table}<div>Follow us</div></article>")
             for i in range(6)]
    got = W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got if r.page_id < 100} == {"Title The body of this article And more of it"}
    assert all(r.text == f"part {r.page_id - 100} 1 2" for r in got if r.page_id >= 100)


def test_op6_is_the_article(spark):
    from html import unescape
    for r in QUERIES["op6_html_template"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"),
                                                        "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())


# --- decontamination ---

def test_reparameterised_items(spark):
    item = ("If Anna has 12 apples and gives Bob 5 apples then Anna keeps how many kg of the 12 apples in the red basket")
    copy = item.replace("Anna", "Carla").replace("Bob", "Dov").replace("12", "345").replace(" 5 ", " 6 ")
    bench = spark.createDataFrame([(1, item), (2, "short item of five words"), (3, None), (4, ""), (None, item)],
                                  "item_id long, text string")
    rows = [(1, "Before it. " + copy + " and after"), (2, copy.replace("Carla keeps", "Dov keeps")),
            (3, copy.replace("the 345", "the 346")), (4, item.upper()), (5, "so a short item of five words, yes"), (6, None),
            (7, ""), (None, item), (8, " ".join(item.split()[:9])), (9, "x " * 30_000 + item), (1, "Before it. " + copy)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, item_id string, place int")
    got = {(r.doc_id, r.item_id): r for r in D.contamination(docs, bench).collect()}
    # 4: capitals make every word a name, but in the benchmark's literal windows they aren't, so it is not found
    assert set(got) == {(1, 1), (5, 2), (9, 1)}
    assert got[9, 1].exact and not got[1, 1].exact and got[1, 1].covered == got[1, 1].item_words
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 4
    old, D.SIEVE_HASHES = D.SIEVE_HASHES, 0
    try:
        assert set(got) == {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()}
    finally:
        D.SIEVE_HASHES = old
    assert D.contamination(docs.limit(0), bench).count() == D.contamination(docs, bench.limit(0)).count() == 0


def test_altered_slots_keep_literal_matches(spark):
    words = "we saw that old house by a river near some hills where many quiet people lived and worked".split()
    passage = " ".join(f"{w}{'ly' * (i // 18)}" if i % 10 else "in 1984" for i, w in enumerate(words * 10))
    sums = "take the number 3 and add the number 5 then tell me which sum you get from both of them"
    bench = spark.createDataFrame([(1, passage), (2, sums)], "item_id long, text string")
    at = passage.index("1984", len(passage) // 2)
    rows = [(1, passage[:at] + "1985" + passage[at + 4:]), (2, sums.replace("3", "4").replace("5", "4"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contamination(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2)} and not got[1, 1].exact and got[1, 1].covered == got[1, 1].item_words


def test_copies_with_few_literal_words(spark):
    items = ["Solve 3 x 4 + 5 y - 6 = 0", "Barack Obama met Angela Merkel and Emmanuel Macron in Paris", "Tell Anna 12 kg",
             "If Anna has 12 apples and gives Bob 5 apples then Anna keeps how many kg of the 12 apples in the red basket"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [f"{a}\n{form(i)}\n{b}" for i in items for form in (str, str.upper, str.lower, str.title)
            for a, b in (("so", "yes"), ("The heading", "And more"))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contamination(docs, bench, any_case=True).collect()}
    assert got == {(d, d // 8) for d in range(len(rows))}


def test_planted_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    assert want and {(r.doc_id, r.item_id) for r in QUERIES["op7_decontam_template"](spark, SF).collect()} == want


# --- licenses ---

def test_license_scan(spark):
    mit = Li.TEMPLATES[2][1]
    rows = [(1, "intro text here\nReleased under the MIT License.\nmore"), (2, mit.replace(" to deal in", "\nto  DEAL in")),
            (3, "released under the mit"), (4, "the license of it"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."),
            (None, "All rights reserved."), (8, "word " * 20_000 + ". All rights reserved."),
            (9, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (1, "All rights reserved.")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, license string, dice double")
    got = {(r.doc_id, r.license): (r.dice, r.n_segments) for r in Li.scan(df).collect()}
    assert got[1, "MIT"] == (1.0, 1) and got[1, "proprietary"] == (1.0, 1) and got[2, "MIT"][0] == 1.0
    assert got[3, "MIT"][0] == pytest.approx(6 / 7, abs=1e-6) and got[None, "proprietary"] == got[8, "proprietary"] == (1.0, 1)
    assert got[7, "CC-BY-NC-4.0"] == (1.0, 1) and {k[1] for k in got if k[0] == 9} == {"MIT", "Apache-2.0"}
    assert not {4, 5, 6} & {k[0] for k in got}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] not in (8,)])
    want = {(r[0], r[1]): (r[2], r[4]) for r in con.execute(Li.scan_sql()).fetchall()}
    assert want == {k: v for k, v in got.items() if k[0] != 8}
    assert Li.scan(df.limit(0)).count() == 0 and Li.scan(df, templates=[]).count() == 0


# --- packing ---

@pytest.mark.parametrize("lengths", [[1], [2048, 4096, 2049, 1, 1], [1500] * 700, [100_000],
                                     np.maximum(1, np.random.default_rng(0).lognormal(6.5, 1, 1500)).astype(int).tolist()])
def test_every_id_in_one_piece_and_little_padding(lengths):
    n = np.array(lengths, np.int64)
    doc, start, length, seq, offset = Pk.pack(n)
    for key, at in ((doc, start), (seq, offset)):
        for _, rows in itertools.groupby(sorted(zip(key.tolist(), at.tolist(), length.tolist(), strict=True)), lambda r: r[0]):
            end = 0
            for _, a, m in rows:
                assert a == end and m > 0
                end += m
    assert (np.bincount(doc, length) == n).all()
    size = np.bincount(seq, length).astype(int)
    assert size.max() <= 2048
    assert sum(0 if s & (s - 1) == 0 else 2048 - s for s in size.tolist()) <= 0.006 * n.sum() + 60


def test_packed_documents(spark):
    rows = [(1, "some words " * 3000), (2, None), (2, ""), (None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, offset int").coalesce(1)
    lib = Tokenizer.from_file(bpe_path())
    got = Pk.pack_documents(df, bpe_path(), group_ids=100).collect()
    by_doc = collections.defaultdict(int)
    for r in got:
        by_doc[r.doc_id] += r.length
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    want = collections.defaultdict(int)
    for i, t in rows:
        want[i] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    assert by_doc == want
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert Pk.pack_documents(df.limit(0), bpe_path()).count() == 0


# --- sharding ---

def test_hilbert_walks_by_single_steps(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        names = [f"c{i}" for i in range(dims)]
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"{c} int" for c in names))
        walk = sorted((r.h, tuple(r[c] for c in names)) for r in H.hilbert(cells, names, bits, "h").collect())
        assert [h for h, _ in walk] == list(range(1 << dims * bits))
        assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in itertools.pairwise(walk))


def test_long_prefixes_are_told_apart(spark):
    rows = [(f"https://www.example.org/{i % 20:02d}",) for i in range(200)] + [(None,)] * 50 + [("https://é",)] * 3
    df = spark.createDataFrame(rows, "s string")
    cuts = H.string_cuts(df.repartition(5), "s", 2)
    ordered = sorted((r[0] or "").encode() for r in rows)
    assert [c.encode() for c in cuts] == sorted({ordered[-(-len(rows) * i // 4) - 1] for i in (1, 2, 3)} - {b""})
    cells = collections.Counter(r.s for r in H.quantise(df, ["s"], 2).collect())
    assert set(cells) == {0, 1, 2, 3} and max(cells.values()) < 80
    assert H.string_cuts(df.limit(0), "s") == []


def test_shards(spark, tmp_path):
    rows = [(i, f"text {i % 3}" * (i % 40), "en" if i % 3 else "de", f"src{i % 7}") for i in range(500)]
    rows += [(7, "hot", "en", "src0")] * 60 + [(None, None, None, None)] * 3 + [(1000, "", "", "")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, lang string, source string, shard int, d_id int")
    got = H.shard(df).collect()
    n = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    place = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in place] == sorted(r.hilbert for r in got)
    assert H.shard(df.limit(0)).count() == 0 and H.shard(df.limit(5)).count() == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    H.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 16
