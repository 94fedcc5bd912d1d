"""Each operator on small tables: nulls, empty and repeated rows, ties, clashing columns, brute force."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import bpe, decontaminate, embedding_dedup, html_main, licenses, ngram_join, quality
from tallyglass.llm import substring_dedup, toxicity, url_filter
from tallyglass.llm.queries import default_vocabulary
from tallyglass.llm.shared import connected_components, held_out, labelled_sample, row_ids

DOCS = "doc_id bigint, text string, label string, key string"


def docs_of(spark, *texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", "x", "y"), (0, texts[0] if texts else None, "x", "y")], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8), (5, 5), (None, 1)], "a bigint, b bigint")
    assert rows_of(connected_components(edges, "a", "b"), "node", "component") == [(2, 1), (3, 1), (8, 7), (9, 1)]
    assert connected_components(edges.where("false"), "a", "b").count() == 0


def test_components_of_hubs_and_chains(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(x), int(y)) for x, y in rng.integers(0, 900, (500, 2))]
    pairs += [(k, k + 1) for k in range(1000, 1400)] + [(2000, int(k)) for k in range(2001, 2600)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    edges = spark.createDataFrame([pairs[k] for k in rng.permutation(len(pairs))], "a bigint, b bigint").repartition(5)
    expected = sorted(((x, find(x)) for x in root if find(x) != x), key=str)
    assert rows_of(connected_components(edges, "a", "b"), "node", "component") == expected


@pytest.mark.parametrize("block", [4096, 3])
def test_ngram_join_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # 3: the members of a key are dealt into blocks
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts: list = [None, "", "  \n", "one", "ONE", "one two", "a b c d e", "A b\tc d  e"]
    for size in (7, 12, 30, 80, 200):
        base = list(rng.choice(words, size))
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 20)))):
                copy[int(rng.integers(size))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs_of(spark, *texts), n=4, num=85, den=100).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    comp = list(range(len(texts)))
    for _ in comp:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: got[i] for i in range(len(texts))} == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert got[None] == (1, None)
    assert ngram_join.ngram_join(docs_of(spark, "a").where("false")).count() == 0


@pytest.mark.parametrize("num, den", [(85, 100), (4, 5)])
def test_linked_sets_of_all_sizes_meet_in_a_key(num, den):
    rng = np.random.default_rng(4)
    lost = []
    for s in range(1, 61):
        for t in range(-(-num * s // den), s + 1):
            common = -(-num * (s + t) // (num + den))
            for least in (common, t) * 3:  # as different as linked sets can be, and nested sets
                pool = rng.integers(1, 2**63, s + t, dtype=np.int64).astype(np.uint64)
                x, y = np.sort(pool[:s]), np.sort(pool[s - least : s - least + t])
                key, flag, node = ngram_join._keys(np.r_[x, y], np.array([s, t]), np.array([0, 1]), num, den)
                sides = [{k: [] for k in key.tolist()} for _ in range(2)]
                for k, f, i in zip(key.tolist(), flag.tolist(), node.tolist(), strict=True):
                    sides[i][k].append(np.int8(f))
                if not any(ngram_join._meets(f, g) for k in sides[0] for f in sides[0][k] for g in sides[1][k]):
                    lost.append((s, t, least))
    assert not lost


def test_url_filter_against_sql(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en/b", "http://x.com", "http://a.net/fr/1", "http://b.net/en/", "ftp://c.org/é#"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls * 2)], "page_id bigint, url string, host string")
    got = rows_of(url_filter.filter_urls(pages), "page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    frame = pages.toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT page_id, url FROM frame")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE})").fetchall()
    assert got == sorted(want, key=str)
    by = {r[0]: r[1:] for r in got}
    assert by[4] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and by[5][2:] == ("example.com/en/", "block")
    assert by[6][2] is None and by[0][:3] == ("", "", None)


def test_url_filter_sends_no_side_of_a_join_through_the_driver(spark):
    urls = [f"http://{host}/{k % 7}/{'abcde'[k % 5] * 9}{k * k}" for k in range(400) for host in ("a.com", "b.net/es", "c.net/de", "d.org")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    most = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(most, "1b")  # any broadcast fails, also one of a side that is planned to be small
    try:
        got = rows_of(url_filter.filter_urls(pages), "page_id", "rule", "verdict")
    finally:
        spark.conf.unset(most)
    con = duckdb.connect()
    frame = pages.toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT page_id, url FROM frame")
    assert got == sorted(con.execute(f"SELECT page_id, rule, verdict FROM ({url_filter.ORACLE})").fetchall(), key=str)
    assert {v for _, rule, v in got if rule is None} == {"allow", "block"}


def test_classifiers(spark):
    good, bad = "The quiet river runs, past old stones and fields. ", "BUY!! BUY!! BUY!! "
    texts = [good * (k % 5 + 1) + str(k) if k % 2 else bad * (k % 7 + 3) for k in range(240)] + [None, ""]
    docs = docs_of(spark, *texts)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(240)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for found, right in ((quality.classify(docs, labels), lambda i: i % 2), (toxicity.classify(docs, labels), lambda i: 1 - i % 2)):
        rows = found.collect()
        assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 240]
        assert held and all(r.predicted == right(r.doc_id) for r in held)
    assert quality.classify(docs, labels.where("false")).select("score").distinct().count() == 1
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_a_beginning_that_comes_again_is_a_term_of_its_share():
    of = lambda text: set(toxicity.buckets(text.encode(), toxicity._Terms()).tolist())
    once, twice = of("Stemone " + "x " * 99), of("stemone stemtwo " + "x " * 98)
    assert len(of("stem")) == 2 and of("") == set() and of("STEM") == of("stem")
    # Two words of a hundred: over a 64th of the text, so all three shares have a term.
    assert len(twice - once - of("stemtwo")) == 3
    assert len(of("stemone stemtwo " + "x " * 2000) - once - of("stemtwo")) == 0


def test_licenses(spark):
    docs = docs_of(spark, "Copyright 2020 Me\nReleased under the MIT licence!", "text\nAll  rights   RESERVED\nmore", None, "", "plain")
    got = {r.doc_id: (r.license, r.n_lines, r.licenses) for r in licenses.scan_licenses(docs).collect()}
    assert got[0] == ("MIT", 1, "MIT") and got[1] == (None, 1, "LicenseRef-all-rights-reserved")
    assert got[2] == got[3] == got[4] == (None, 0, "")


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licenses_of_whole_texts_and_wrapped_notices(spark):
    header = "# Copyright 2020 Me\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"
    docs = docs_of(spark, MIT, " ".join(MIT.split("\n\n", 2)[2].split()), header + "x = 1", "text\n\nReleased under\nthe MIT License.\n\nmore")
    got = {r.doc_id: (r.license, r.n_lines, r.licenses) for r in licenses.scan_licenses(docs.where("doc_id is not null")).collect()}
    assert got == {0: ("MIT", 0, "MIT"), 1: ("MIT", 0, "MIT"), 2: (None, 1, "Apache-2.0"), 3: (None, 1, "MIT")}


def test_substring_dedup(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(str(x) for x in rng.integers(10**6, 10**7, n))
    passage, own = word(80), [word(60) for _ in range(4)]
    docs = docs_of(spark, own[0] + " " + passage, own[1] + " x " + passage + " " + own[2], own[3], None, "")
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got[0].text == own[0] + " " + passage and got[2].text == own[3] and got[3].text is None and got[4].text == ""
    assert 55 <= got[1].n_words_removed <= 80 and got[1].text.startswith(own[1]) and got[1].text.endswith(own[2])
    begin, end = got[1].spans
    whole = own[1] + " x " + passage + " " + own[2]
    assert got[1].text == whole[:begin] + whole[end:] and got[1].label == "x"


def test_chunks_resist_insertions():
    rng = np.random.default_rng(9)
    text = " ".join(str(x) for x in rng.integers(10**6, 10**7, 400)).encode()
    cut = lambda raw: {raw[a:b].rstrip() for a, b in zip([0, *substring_dedup.cuts(raw)[0][:-1].tolist()], substring_dedup.cuts(raw)[0].tolist(), strict=True)}
    assert len(cut(text) - cut(b"new words here " + text)) <= 8


@pytest.mark.parametrize("block", [200_000, 2])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PHRASES", block)
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (10, "short ONE!"), (3, None), (4, "--"), (None, "x y")], "item_id bigint, text string")
    texts = ["pre " + item.upper() + ", post", "short one short one", "alpha beta gamma delta", None, "", "a short-one b"]
    got = {r.doc_id: r for r in decontaminate.digests(decontaminate.find_contamination(docs_of(spark, *texts).where("key = 'y' and doc_id > -1").dropDuplicates(["doc_id"]), bench)).collect()}
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    want = {0: (13, 11, 1, sha("1")), 1: (4, 4, 2, sha("10", "2")), 2: (4, 0, 0, sha()), 3: (0, 0, 0, sha()), 4: (0, 0, 0, sha()), 5: (4, 2, 2, sha("10", "2"))}
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for i, r in got.items()} == want
    assert decontaminate.cut_words(texts[0], [1], [12]) == "pre , post"


@pytest.mark.parametrize("block", [200_000, 1])
def test_decontamination_takes_rows_of_one_id_or_none_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PHRASES", block)
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "eta theta")], "item_id bigint, text string")
    rows = [(7, "alpha beta x y"), (7, "x y gamma delta"), (7, "x y gamma delta"), (None, "x alpha beta y"), (None, "eta theta x y"), (8, None)]
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench)
    got = sorted(((r.doc_id, r.n_words, r.starts, r.ends, r.items) for r in found.collect()), key=str)
    want = [(7, 4, [0], [2], [1]), (7, 4, [2], [4], [2]), (7, 4, [2], [4], [2]), (None, 4, [1], [3], [1]), (None, 4, [0], [2], [3]), (8, 0, [], [], [])]
    assert got == sorted(want, key=str)


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = default_vocabulary()
    library = Tokenizer.from_file(path)
    texts = ["Hello   world\n\n  it's 12½ ²", "aaaaaaaaaaa", "<|endoftext|>x<|endoftext|>", "", None, "日本 \x1c é😀 \t_"]
    for r in bpe.tokenize(docs_of(spark, *texts), path, keep=("doc_id", "key")).collect():
        if r.doc_id is not None:
            want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.key == "y"


def test_html_main(spark):
    page = "<html><head><title>t</title><script>a='<p>'</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>Head &amp; tail </h1><p><b>One<br>two &amp;amp; <p>three<aside>no</aside><div class='comments'>me too</div></article><footer>end</footer>"
    plain = "<div class=x><p>Own text {}</p></div><div class=y><p>Same notice</p></div>"
    rows = [(0, "http://h/1", page), (1, None, None), (2, "http://h/2", "")] + [(k, f"http://g/{k}", plain.format(k)) for k in range(3, 9)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.extract_main(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0][0] == "Head & tail\nOne two &amp;\nthree" and got[1] == got[2] == ("", 0)
    assert all(got[k][0] == f"Own text {k}" for k in range(3, 9))


def main_texts(spark, *pages):
    rows = [(k, url, page) for k, (url, page) in enumerate(pages)]
    found = html_main.extract_main(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_html_main_of_copies_and_of_names_that_look_like_roles(spark):
    page = "<div class=x><p>Own {}</p></div>"
    copies = [("http://a/", page.format(1))] * 5 + [("http://a/", page.format(2))]
    assert main_texts(spark, *copies) == ["Own 1"] * 5 + ["Own 2"]
    named = ["<body class='has-sidebar'><p>Text", "<html class='nav-open'><body><p>Text", "<article class='review'><p>Text", "<main class='search'><p>Text"]
    assert main_texts(spark, *((f"http://{k}/", x) for k, x in enumerate(named))) == ["Text"] * 4
    post = "<article><header class='post-header'><h1 class='post-header'>Title</h1></header><p>Text</p><article class='comment'>me too</article></article>"
    assert main_texts(spark, ("http://b/", post)) == ["Title\nText"]


def test_html_main_judges_blocks_in_and_beside_articles(spark):
    page = "<div class=top>Site motto</div><article><p>Own {0}</p><div class=x1>Read on in our app</div></article><div class=more>Also own {0}</div>"
    pages = [("http://a/", page.format(k)) for k in range(6)]
    assert main_texts(spark, *pages) == [f"Own {k}\nAlso own {k}" for k in range(6)]
    near = "<article><h1>Title {}</h1><p>The same text</p></article>"
    assert main_texts(spark, *(("http://b/", near.format(k)) for k in range(2))) == [f"Title {k}\nThe same text" for k in range(2)]


def test_html_main_cleans_neutral_names_by_entropy_alone(spark):
    """Menus, notices and adverts that no name gives away; the same with the tree switched off shows what it does."""
    say = lambda k, n: " ".join(f"{w}{k}" for w in ("river", "stone", "window", "garden", "letter", "market", "winter")[:n])
    page = (
        "<div class=k1><ul class=k2><li>Home</li><li>News {3}</li><li>Contact</li></ul></div><div class=k3><p>We use small files to make this site work for you</p></div>"
        "<article><h1>{0}</h1><p>{1}</p><div class=k4>Buy two and pay for one at our shop</div><p>{2}</p></article><div class=k5><span>All rights kept</span></div>"
    )
    pages = [(f"http://a/{k}", page.format(say(k, 3), say(k, 7), say(-k, 6), "" if k % 2 else "today")) for k in range(12)]
    expected = [f"{say(k, 3)}\n{say(k, 7)}\n{say(-k, 6)}" for k in range(12)]
    assert main_texts(spark, *pages) == expected
    plain = [(u, p.replace("article", "section")) for u, p in pages]
    assert main_texts(spark, *plain) == expected
    rows = spark.createDataFrame([(1, *pages[0])], "page_id bigint, url string, html string")
    assert "Home" in html_main.extract_main(rows, least=0.0).first().text  # the names alone cut nothing here


def test_html_main_keeps_names_that_are_about_something(spark):
    named = "<article><section class='search-algorithms'><p>One</p></section><p id='share-prices'>Two</p><p class='noticeBoardHistory'>Three</p><div class='share-buttons'>no</div><div id='commentList'>no</div><p class='ad'>no</p></article>"
    assert main_texts(spark, ("http://a/", named)) == ["One\nTwo\nThree"]


def test_html_main_of_pages_that_differ_in_a_date(spark):
    long = "The council met again and spoke for a long time about the bridge, the school and the price of water in the valley."
    for page in ("<p class=d>2024-05-{:02}</p><p>" + long + "</p>", "<article><p class=d>2024-05-{:02}</p><p>" + long + "</p></article>"):
        pages = [(f"http://a/{k}", page.format(k)) for k in range(1, 9)]
        assert main_texts(spark, *pages) == [f"2024-05-{k:02}\n{long}" for k in range(1, 9)]


def test_html_main_of_odd_rows(spark):
    rows = [(None, "http://a/1", "<p>Text"), (4, "http://a/2", "<p>Other"), (4, "http://a/2", "<p>Other"), (5, None, None), (6, "no scheme", "")]
    docs = spark.createDataFrame([(*r, "mine", "yours") for r in rows], "page_id bigint, url string, html string, text string, page string")
    got = rows_of(html_main.extract_main(docs), "page_id", "text", "n_chars")
    assert got == sorted([(None, "Text", 4), (4, "Other", 5), (4, "Other", 5), (5, "", 0), (6, "", 0)], key=str)
    assert html_main.extract_main(docs.where("false")).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    vectors = [(base[k % 40] + rng.normal(size=8) * 0.15).tolist() for k in range(700)] + [base[0].tolist()] * 30
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None], 1), (903, [float("nan")] * 8, 1), (904, vectors[0], None), (None, vectors[0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_embeddings(df).collect()}
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    label = np.arange(len(x)) % 3
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(link, comp[None, :], len(x)).min(1)
        if (new == comp).all():
            break
        comp = new
    assert {i: got[i] for i in range(len(x))} == {i: (int(link[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i in range(900, 905)) and got[None][1] is None


def test_parity_bits_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for num, den in ((85, 100), (4, 5)):
        sets, sizes = [], []
        for size in (1, 3, 40, 400, 3000):
            for _ in range(6):
                x = rng.integers(0, 1 << 63, size).astype(np.uint64)
                y = np.r_[x[: max(1, size * num // den)], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, size // 20)))).astype(np.uint64)]
                sets += [np.unique(x), np.unique(y)]
        sizes = np.array([len(x) for x in sets])
        words, begin, length = ngram_join._lists(ngram_join._parity(np.concatenate(sets), sizes, num, den))
        a, b = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
        differ = ngram_join._differing(words, begin, length, a, b)
        true = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
        assert (differ <= true).all()
        assert (differ >= 0.6 * true - 2).all()  # and most of the difference shows


def test_a_passage_of_all_documents_makes_no_candidates(spark):
    """Documents alike in a long common passage only: what is compared by texts does not grow with their square."""
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(60))
    fetched = []

    def texts_of(pairs, docs, plain=ngram_join._texts_of):
        out = plain(pairs, docs)
        fetched[-1] += out.count()
        return out

    original, ngram_join._texts_of = ngram_join._texts_of, texts_of
    try:
        for n in (60, 240):
            fetched.append(0)
            texts = [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 60)) for _ in range(n)]
            docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
            assert ngram_join.ngram_join(docs).where("component_id <> doc_id").count() == 0
    finally:
        ngram_join._texts_of = original
    assert fetched[1] <= 4 * fetched[0] + 24


def test_row_ids(spark):
    rows = [(None, "a"), (None, "a"), (3, "b"), (3, "c"), (3, "b"), (5, "d"), (1 << 62, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = row_ids(docs, "doc_id").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None)
    assert len({r._row for r in got}) == 7 and [r._row for r in got if r.text == "d"] == [5]
    assert sorted(r._row for r in got)[:2] == [3, 5] and sorted(r._row for r in got)[2] >= 1 << 62
    plain = row_ids(docs.where("doc_id = 5"), "doc_id")
    assert [tuple(r) for r in plain.collect()] == [(5, "d", 5)]
    assert row_ids(docs.where("false"), "doc_id").count() == 0


def test_labelled_sample(spark, monkeypatch):
    n = 4000
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    odd = spark.createDataFrame([(None, 1), (0, 1), (0, 0), (0, None), (2, None)], "doc_id bigint, toxic bigint")
    both = labels.union(labels).union(odd).repartition(5)
    learnable = {r.doc_id for r in labels.where(~held_out(F.col("doc_id"))).collect()}
    whole = [tuple(r) for r in labelled_sample(both, n, "doc_id", "toxic").collect()]
    assert {i for i, _ in whole} == learnable and len(whole) == len(learnable) + (0 in learnable)
    some = {r.doc_id for r in labelled_sample(both, 100, "doc_id", "toxic").collect()}
    assert 50 <= len(some) <= 100 and some < learnable
    again = {r.doc_id for r in labelled_sample(both.repartition(2), 100, "doc_id", "toxic").collect()}
    assert some == again
    assert labelled_sample(both.where("false"), 100, "doc_id", "toxic").count() == 0


def test_toxicity_and_quality_with_odd_labels(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 12)) + (" vile slur" * 3 if k % 2 else "") for k in range(60)]
    docs = docs_of(spark, *texts)
    labels = [(k, k % 2, k % 2) for k in range(60)] + [(None, 1, 1), (4, None, None), (999, 1, 0), (5, 1, 1), (5, 1, 1)]
    made = spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    for classify in (toxicity.classify, quality.classify):
        first = rows_of(classify(docs, made), "doc_id", "score")
        assert len(first) == 62 and first == rows_of(classify(docs.repartition(5), made.repartition(4)), "doc_id", "score")
        assert all(0 <= s <= 1 for _, s in first)
        none = classify(docs, made.where("false"))
        assert len({s for _, s in rows_of(none, "doc_id", "score")}) == 1
        assert classify(docs.where("false"), made).count() == 0


def test_substring_dedup_takes_each_row_on_its_own(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 1 << 30, n))
    passage, own = say(120), [say(80) for _ in range(3)]
    rows = [(1, f"{own[0]} {passage}"), (7, f"{own[1]} {passage}"), (7, "short and different"), (None, f"{passage} {own[2]}"), (None, f"{passage} {own[2]}"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id bigint, text string, spans string").repartition(3)
    got = substring_dedup.dedup_substrings(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text) for r in got}
    assert (1, rows[0][1]) in by and (7, "short and different") in by and (2, None) in by and (3, "") in by
    cut = [r for r in got if r.doc_id == 7 and r.n_words_removed]
    assert len(cut) == 1 and cut[0].text.startswith(own[1]) and cut[0].n_words_removed > 80
    nameless = sorted(len((r.text or "").split()) for r in got if r.doc_id is None)
    assert nameless[0] < 30 and 70 < nameless[1] < 130  # of two equal rows one keeps its own part
    assert substring_dedup.dedup_substrings(docs.where("false")).count() == 0


@pytest.mark.parametrize("shard", [1, 40, 10_000])
def test_decontamination_of_texts_that_end_in_phrase_words(spark, monkeypatch, shard):
    """Few words, so that texts, shards and phrases end alike; each shard's places against brute force."""
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    rng = np.random.default_rng(shard)
    words = list("abcde")
    texts = [" ".join(rng.choice([*words, "zz"], int(rng.integers(0, 30)))) for _ in range(120)]
    items = [" ".join(rng.choice(words, int(rng.integers(1, 7)))) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for r in decontaminate.find_contamination(docs, bench, window=4).collect():
        w = texts[r.doc_id].split()
        hit, owners = set(), set()
        for k, item in enumerate(items):
            x = item.split()
            for p in [x[i : i + 4] for i in range(max(1, len(x) - 3))]:
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit |= set(range(i, i + len(p)))
                        owners.add(k)
        assert {i for a, b in zip(r.starts, r.ends, strict=True) for i in range(a, b)} == hit and r.items == sorted(owners)
