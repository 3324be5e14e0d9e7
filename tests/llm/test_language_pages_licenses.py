"""Classifiers on held-out data, and licence scans against a plain comparison."""

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from lattice.llm import extraction, langid, licenses
from lattice.llm.labelled_pages import labelled_pages

WORDS = {"en": "the and of this that which from with have been".split(), "de": "der und das nicht mit eine für über auch sich".split(), "fr": "le et des pour dans avec sur qui une être".split()}


def _labelled(spark, n=60, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(40)), lang, f"s{i % 3}") for i in range(n) for lang in [list(WORDS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy_and_rejection(spark):
    model = langid.fit(_labelled(spark))
    test = _labelled(spark, 90, 9).withColumn("lang", F.lit(None).cast("string")).withColumn("p", F.lit(1)).withColumn("ll", F.lit("x"))
    junk = spark.createDataFrame([(900, "%$#@!~^&*" * 30, None, "s0", 1, "x"), (901, None, None, None, 1, "x"), (902, "", "en", "s1", 1, "x")], test.schema)
    rows = langid.document_rows(test.unionByName(junk), F.col("doc_id"))
    got = {r.doc_id: r for r in langid.identify(spark, rows, model).collect()}
    assert len(got) == 93 and not got[900].accepted and got[901].accepted and got[902].accepted
    assert sum(got[i].lang == list(WORDS)[i % 3] for i in range(90)) >= 88
    kept = langid.accepted(spark, test.unionByName(junk), model)
    assert kept.columns == test.columns and kept.count() == 92


def _plain_posteriors(model, rows):
    """What `identify` finds for (host, declared, text) rows, written out: the best class and its posterior."""
    m, fold = len(model.langs), langid._fold()

    def score(text):
        out = [0.0] * (m + 1)
        c = [int(fold[ord(x)]) for x in f" {text} "]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
            out = [o + float(w) for o, w in zip(out, model.weights[h], strict=True)]
        return [o * min(1, 60 / max(1, len(text))) for o in out]

    ll = [score(t or "") for _, _, t in rows]
    p = [[math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v] for v in ll]
    whole = [sum(v[i] for v in p) + 1 for i in range(m)]
    base = [x / sum(whole) for x in whole]
    values = {d for _, d, _ in rows if d}
    sizes = [sum(v[i] for v, r in zip(p, rows, strict=True) if r[1]) for i in range(m)]
    out = []
    for (host, declared, _), v, mine in zip(rows, ll, p, strict=True):
        prior = base
        if host is not None:
            own = [max(0.0, sum(q[i] for q, r in zip(p, rows, strict=True) if r[0] == host) - mine[i]) for i in range(m)]
            prior = [(c + 8 * b) / (sum(own) + 8) for c, b in zip(own, base, strict=True)]
        d = [0.0] * m
        if declared:
            d = [math.log((sum(q[i] for q, r in zip(p, rows, strict=True) if r[1] == declared) + 10 / (len(values) + 1)) / (sizes[i] + 10)) for i in range(m)]
            d = [x - sum(d) / m for x in d]
        post = [math.log(prior[i]) + math.log(0.99) + v[i] + d[i] for i in range(m)] + [math.log(0.01) + v[m]]
        best = max(post)
        out.append(([*model.langs, "und"][post.index(best)], 1 / sum(math.exp(x - best) for x in post)))
    return out


def test_posteriors_against_a_plain_version(spark):
    model = langid.fit(_labelled(spark))
    rnd = random.Random(5)
    rows = [(rnd.choice(["s0", "s1", None]), rnd.choice(["en", "de", None, "xx"]), " ".join(rnd.choice(WORDS[rnd.choice(list(WORDS))]) for _ in range(rnd.randint(0, 6)))) for _ in range(40)]
    rows += [("s2", None, "#%&!" * 40), ("s0", "en", None), ("s1", "de", "der " * 30_000), *[("s0", "en", "the and of")] * 3]
    df = spark.createDataFrame([(i, t, d, h) for i, (h, d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.identify(spark, langid.document_rows(df, F.col("doc_id")), model).collect()}
    for i, (lang, confidence) in enumerate(_plain_posteriors(model, rows)):
        assert got[i].lang == lang and abs(got[i].confidence - confidence) < 1e-4 and got[i].accepted == (lang != "und")


def test_markup_without_end_takes_no_longer(spark):
    pages = [(i, "http://h/", x * (1_000_000 // len(x))) for i, x in enumerate(("<!-- a ", "<script ", "<html ", "<a <", "</script", "<style>x"))]
    began = time.monotonic()
    rows = langid.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages) and time.monotonic() - began < 30


def test_host_and_markup_decide_where_text_does_not(spark):
    model = langid.fit(_labelled(spark))
    german = " ".join(WORDS["de"] * 4)
    pages = [(i, f"http://www.host.de/{i}", f"<html lang='de'><p>{german}</p></html>") for i in range(12)] + [(50, "http://www.host.de/x", "<p>1 2 3</p>"), (51, None, None), (52, "bad", "<script>the and of</script>")]
    got = {r.page_id: r for r in langid.identify(spark, langid.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    assert got[50].lang == "de" and got[51].accepted and len(got) == 15
    assert langid.identify(spark, langid.page_rows(spark.createDataFrame([], "page_id long, url string, html string")), model).count() == 0


def test_rare_languages_have_a_class_and_copies_count_once(spark):
    rare = "ja nie mam pod przed który się dlaczego"
    rows = [(i, f"the {i} and of this", "EN") for i in range(3000)] + [(9000 + i, "der und das nicht", "de") for i in range(1500)] + [(1, rare, "pl"), (2, rare, "pl"), (3, "", "xx"), (4, None, "yy"), (5, "z", None), (6, "z", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "pl"]
    once = spark.createDataFrame([(1, rare, "pl"), (2, "der und das nicht", "de")], "doc_id long, text string, lang string")
    assert (langid.fit(once).weights[:, :2] == model.weights[:, [0, 2]]).all()
    assert langid.fit(docs, languages=1).langs == ["en"] and (langid.fit(docs, sample=10).weights[:, 1] > langid._FLOOR).sum() >= 10
    got = langid.identify(spark, langid.document_rows(docs.withColumn("lang", F.lit(None).cast("string")).where("doc_id < 3"), F.col("doc_id")), model)
    assert {r.lang for r in got.where("doc_id = 2").collect()} == {"en", "pl"}


def test_no_labels_at_all(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    model = langid.fit(empty)
    assert model.langs == [] and langid.accepted(spark, empty, model).count() == 0


def test_extraction_on_held_out_pages():
    crf = extraction.trained()
    right = wrong = missed = 0
    for page in labelled_pages(120, seed=12345):
        found = extraction.featured(page)
        for b, y in zip(found, crf.decode(crf.emissions(found)), strict=True):
            right += y and b.main
            wrong += y and not b.main
            missed += (not y) and b.main
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_extraction_of_pages(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now.</div><article><h1>A &amp;  B</h1><p>One\n two<br>three.<p>Four<script>x</script></article><footer>&copy; x</footer>"
    rows = [(1, "u", page, "k"), (2, "u", None, "k"), (3, None, "", "k"), (4, "u", "<p>" * 3000, "k"), (4, "u", "<!-- " + "x" * 50_000, "k")]
    got = extraction.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got if r.page_id == 1] == ["A & B\nOne two three.\nFour"] and len(got) == 5
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id > 1)


def test_parsing_is_linear():
    crf = extraction.trained()
    hard = ["<a " * 330_000, "<a '\"" * 200_000, "<!-- a " * 140_000, "<div>" * 80_000 + "</b>" * 150_000, "<b>" + "<div>" * 90_000 + "x</b>" * 100_000, "".join(f"<x{i}>" for i in range(100_000))]
    hard += ["".join(f"<div class='c{i} k{i}'>t" for i in range(40_000)), "<i>" * 100_000 + "<p>x</p>y" * 60_000, "<ul><li>" + "<div>" * 60_000 + "<li>a" * 100_000, "<script>" + "</script " * 100_000, "<p class" + " class" * 150_000 + ">", "<p a=" + " " * 900_000]
    for page in hard:
        began = time.monotonic()
        crf.extract(page)
        assert time.monotonic() - began < 20, page[:40]


def test_pieces_of_markup():
    texts = lambda page: [b.text for b in extraction.blocks(page)]
    assert texts("<p>a <math><mi>x</mi></math> b<p it's fine>c</p>d<p title='1 > 0'>e") == ["a x b", "c", "d", "e"]
    assert texts("<p>a<!-- open <p>b") == ["a"] and texts("<p>1 < 2 and 3 <b>4</b></p>") == ["1 < 2 and 3 4"]
    many = " ".join(f"word{chr(97 + i)}" for i in range(20))
    assert "name:wordt" in extraction.blocks(f"<div class='{many}'>x</div>")[0].features


#: Pages written by hand, not from the grammar of the labelled pages: (html, main text).
BY_HAND = [
    ("<body><div id=top><a href=/>Start</a> | <a href=/n>News</a></div><article><h1>Rain in May</h1><p>It rained on most days of the month, and the river rose.</p><p>Farmers were glad of it.</p></article><footer>Copyright 2021</footer></body>", "Rain in May\nIt rained on most days of the month, and the river rose.\nFarmers were glad of it."),
    ("<main><h2>How to bake bread</h2><ol><li>Mix flour, water and salt.</li><li>Wait for two hours.</li></ol><p>Then bake it until it is brown, for about forty minutes.</p></main><aside><h3>More recipes</h3><ul><li><a href=/1>Soup</a></li></ul></aside>", "How to bake bread\nMix flour, water and salt.\nWait for two hours.\nThen bake it until it is brown, for about forty minutes."),
    ("<header><nav><a href=/>Home</a><a href=/s>Shop</a></nav></header><div class='post'><h1>A long walk</h1><p>We set out before dawn, as the road was long.</p><blockquote>Nobody knew the way.</blockquote><p>By night we were home again.</p></div><div class='comments'><p>Nice post, thanks!</p></div>", "A long walk\nWe set out before dawn, as the road was long.\nNobody knew the way.\nBy night we were home again."),
    ("<div class='cookie-notice'>We use cookies.</div><section class='content'><h1>Council meets</h1><p>The council met on Tuesday to discuss the new bridge, which is to open in spring.</p><table><tr><td>Cost</td><td>3 million</td></tr></table></section><form><input name=q><button>Search</button></form>", "Council meets\nThe council met on Tuesday to discuss the new bridge, which is to open in spring.\nCost\n3 million"),
]


def test_pages_from_outside_the_grammar():
    right = wrong = missed = 0
    for page, expected in BY_HAND:
        got, want = Counter(extraction.trained().extract(page).split("\n")), Counter(expected.split("\n"))
        right += (got & want).total()
        wrong += (got - want).total()
        missed += (want - got).total()
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


def test_no_pages(spark):
    assert extraction.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    crf, rnd = extraction.trained(), random.Random(4)
    for _ in range(20):
        e = [rnd.uniform(-3, 3) for _ in range(6)]
        score = lambda y: crf.start[y[0]] + crf.stop[y[-1]] + sum(x for x, v in zip(e, y, strict=True) if v) + sum(crf.transitions[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert abs(score(crf.decode(e)) - max(map(score, product((0, 1), repeat=6)))) < 1e-9


def test_licences_against_every_template(spark):
    scanner = licenses.Scanner()
    line = "Released under the MIT Licence."
    texts = ["prose here\nReleased under the MIT License.\nmore of it", None, "", line, "\n".join(licenses.TEMPLATES["MIT"][3][i : i + 60] for i in range(0, 1100, 60)), "words " * 5000, "All rights reserved.\nReleased under the MIT License."]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(spark, df).collect()}
    assert got[0].license == "MIT" and texts[0][got[0].begin : got[0].begin + got[0].n_chars] == "Released under the MIT License."
    assert [got[i].n_matches for i in (1, 2, 5)] == [0, 0, 0] and got[6].licenses == ["MIT", "all-rights-reserved"]
    for i in (0, 3, 6):
        best = max((licenses.dice(Counter(zip(w, w[1:], strict=False)), g) for x in texts[i].split("\n") for w in [licenses.words(x)] for _, _, g in scanner.templates), default=0)
        assert (got[i].dice or 0) == (round(best, 6) if best >= 0.8 else 0)
    assert licenses.scan(spark, df.limit(0)).count() == 0


def test_licences_within_lines():
    texts = {
        "Foo lib. Released under the MIT License. See the docs for usage.": [("MIT", "Released under the MIT License.")],
        "(c) 2020 Foo Inc. All rights reserved.": [("all-rights-reserved", "All rights reserved.")],
        "It is long prose and then released under the MIT License, all rights reserved by nobody": [("MIT", "released under the MIT License,"), ("all-rights-reserved", "all rights reserved")],
        "x " * 300 + licenses.TEMPLATES["MIT"][3] + " y" * 300: [("MIT", licenses.TEMPLATES["MIT"][3])],
        "Released under\nNOT A WORD OF IT\nthe MIT License": [],
        "All rights reserved. " * 500: [("all-rights-reserved", "All rights reserved.")] * 500,
    }
    for text, expected in texts.items():
        assert [(m.license, text[m.begin : m.end]) for m in licenses.Scanner().scan(text)] == expected
    mit = licenses.TEMPLATES["MIT"][3].split()
    broken = "\n".join([" ".join(mit[:80]), "page 3 of 7", " ".join(mit[80:])])  # one foreign line inside a notice
    assert [(m.license, m.begin, m.end) for m in licenses.Scanner().scan(broken)] == [("MIT", 0, len(broken))]


def test_licence_stretches_against_all_stretches():
    rnd = random.Random(7)
    templates = {"A": ["a b c d e", "a b a b c"], "B": ["c d e f", "b c"], "C": ["a b c a b c d e f a b"]}
    scanner = licenses.Scanner(0.8, templates)
    for _ in range(300):
        w = [rnd.choice("abcdefx") for _ in range(rnd.randrange(40))] if rnd.random() < 0.5 else " ".join(rnd.choice(["a b c d e", "c d e f", "b c", "x", "a b", "a b c a b c"]) for _ in range(9)).split()
        every = []
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                grams = Counter(zip(w[i:j], w[i + 1 : j], strict=False))
                every += [(-d, i - j, i, name) for _, name, g in scanner.templates if (d := licenses.dice(grams, g)) >= 0.8]
        kept = []
        for d, length, i, name in sorted(every):
            if all(i - length <= o[0] or o[1] <= i for o in kept):
                kept.append((i, i - length, name, -d))
        got = [(m.begin // 2, (m.end + 1) // 2, m.license, m.dice) for m in scanner.scan(" ".join(w))]
        assert got == sorted(kept)


def test_every_licence_line_of_the_sample_is_found(spark):
    import duckdb

    name = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    lines = duckdb.sql("SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()
    lines = {x for (x,) in lines if any(k in x.lower() for k in ("licen", "rights reserved", "public domain", "copyright"))}
    assert lines == set(name)
    for line, licence in name.items():
        assert [(m.license, m.dice, line[m.begin : m.end]) for m in licenses._scanner(0.8).scan(line)] == [(licence, 1.0, line)]


def test_whole_licences_and_usual_notices_have_their_names():
    s = licenses._scanner(0.8)
    for name, text in licenses.TEXTS.items():
        assert [(m.license, m.dice) for m in s.scan("Some words. " + text + " More words.")] == [(name, 1.0)]
    notices = {"GPL-2.0": "Licensed under the GPLv2.", "LGPL-2.1-or-later": "released under the GNU Lesser General Public Licence v2.1 or later", "AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0", "BSD-3-Clause": "licensed under the 3-clause BSD license", "CC-BY-NC-SA-3.0": "see https://creativecommons.org/licenses/by-nc-sa/3.0/ for it", "CC-BY-SA-4.0": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License", "GPL": "It is licensed under the GNU General Public License of old", "MIT": "This project is licensed under the terms of the MIT license."}
    for name, text in notices.items():
        assert [(m.license, m.dice) for m in s.scan(text)] == [(name, 1.0)], text
    for text in ("This project is licensed under the terms of the Foo license.", "Licensed under the law of the land.", "SPDX-License-Identifier: LicenseRef-Foo", "The rights of all who reserved it."):
        assert s.scan(text) == []
