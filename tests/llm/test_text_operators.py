"""Operators that work on one text at a time."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinspan.llm import html_text, licences, packing, quality_classifier, quality_rules, toxicity
from twinspan.llm.ftrl import Ftrl, sigmoid
from twinspan.llm.words import hashed_words, word_count, words
from twinspan.sources.tables import table

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "a a", "A b c", "x\x0by\x0cz\rw", "word " * 5000, "über Straße İı 中文 \U0001f600 é", "#*$%&|<>", "a b c a b c", "l\nl\n\nl\n l\n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, rank int, node int"


def odd_documents(spark):
    """Nulls in every column, repeated rows, and columns with the names that operators use within."""
    rows = [(i, t, "en", "s", "x", 1, 2) for i, t in enumerate(ODD)] + [(3, "a", None, None, None, None, None)] * 2 + [(None, "a b c d", "en", None, "y", 3, 4), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words(spark):
    rows = odd_documents(spark).select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(words(r.text)) for r in rows)
    hashed = hashed_words(pa.array(ODD, pa.string()))[0]
    assert [len(h) for h in hashed] == [len(words(t)) for t in ODD]
    a, b = hashed_words(pa.array(["One two", "ONE", "tWO Ä", "two ä"]))[0][:2]
    assert a[0] == b[0]
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB \n\té.#") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    hashes: dict[bytes, int] = {}
    for t, hs in zip(texts, hashed_words(pa.array(texts))[0], strict=True):
        for w, h in zip(words(t), hs.tolist(), strict=True):
            assert hashes.setdefault(w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w), h) == h
    assert len(set(hashes.values())) == len(hashes)


def brute_rules(text):
    t = text or ""
    w = words(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, repeated = set(), 0
    for line in t.split("\n"):
        if words(line):
            repeated += line in lines
            lines.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in quality_rules.SYMBOLS for c in t), repeated, len(covered)


def test_rules_by_brute_force(spark):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))) for _ in range(60)), "x y z " * 40 + "\n" + " ".join(str(i) for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.apply_rules(docs).collect():
        n, chars, symbols, lines, repeats = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_rules_in_any_order(spark):
    docs = table(spark, DATA, "documents")
    want = {(r.doc_id, r.kept) for r in quality_rules.apply_rules(docs).collect()}
    assert {(r.doc_id, r.kept) for r in quality_rules.apply_rules(docs, quality_rules.RULES[::-1]).collect()} == want
    assert {r.name for r in quality_rules.ordered(docs)} == {r.name for r in quality_rules.RULES}


def test_rules_on_odd_rows(spark):
    assert quality_rules.apply_rules(odd_documents(spark)).count() == odd_documents(spark).count()
    assert quality_rules.apply_rules(empty_documents(spark)).count() == 0


def test_rules_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    found = con.sql(quality_rules.SQL)
    frame = quality_rules.query(spark, DATA).select(*found.columns)
    assert sorted(map(tuple, frame.collect())) == sorted(found.fetchall())


PAGE = """<html><head><title>t</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header class=site><h2>Site name here</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, please accept all of them now</div><div id="sidebar"><p>Some long sidebar text that goes on for many words and more words still</p></div>
<article><h1>The  title</h1><p>First &amp; best &eacute;&#233;&nbsp;words of the <b>art</b>icle, with a <a href=x>link</a>.<br>Next line<p>Short.</p>
<div class="ad">Buy this wonderful thing today and not tomorrow for it is cheap</div><form>Name <input name=q><button>Send</button></form>
<blockquote>Quoted words</blockquote><pre> a
 b </pre></article><!-- <p>hidden</p> --><section class="comments"><p>I am a reader and think that this article is wrong in every point</p></section>
<footer>&copy; nobody</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "The title First & best éé words of the article, with a link. Next line Short. Quoted words a b"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p><script>x") == ""
    assert html_text.main_text("<article><p>cut off in a tag <a hre") == "cut off in a tag"
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_html_without_an_article():
    long = " ".join(["word"] * 40)
    page = f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><p>{long}</p><p>{long}</p><ul><li><a href=c>Three</a></li><li><a href=d>Four five</a></li></ul></body>"
    assert html_text.main_text(page) == f"{long} {long}"


def test_html_names_that_only_hint():
    long = " ".join(["word"] * 30)
    for page, want in (
        (f'<article class="node node--type-article node--promoted"><h1>Title</h1><p>{long}</p><p>Short one.</p></article>', f"Title {long} Short one."),
        (f'<article><section id="discussion"><h2>Discussion</h2><p>{long}</p></section><h2 id="search-algorithms">Search</h2><p>{long}</p></article>', f"Discussion {long} Search {long}"),
        (f'<body><div class="post category-legal"><p>{long}</p><p>{long}</p></div></body>', f"{long} {long}"),
        (f'<article><div title="Hidden costs" data-hidden="false" data-x="class=ad"><p>{long}</p></div></article>', long),
        (f'<article><div class="sidebar">{long}</div><div hidden>{long}</div><p>{long}</p><div class="share-this">Share this page</div></article>', long),
    ):
        assert html_text.main_text(page) == want


RIVER = "The river rose slowly over the long winter and the villagers moved their stores of grain to the upper barns before the thaw came."
SPRING = "In spring the water fell again, leaving a layer of dark silt on the fields, and sowing began a month later than usual that year."
#: Pages with the text that a reader would mark as theirs.
BY_HAND = (
    (f'<div id="page" class="layout sidebar-right"><article><h1>Flood</h1><p>{RIVER}</p><p>{SPRING}</p></article></div>', f"Flood {RIVER} {SPRING}"),
    (f'<article class="search-algorithms"><h1>Search</h1><p>{RIVER}</p><p>{SPRING}</p></article>', f"Search {RIVER} {SPRING}"),
    (f'<article id="legal-news"><h1>Law</h1><p>{RIVER}</p></article>', f"Law {RIVER}"),
    (f'<article><h1>Law</h1><p>{RIVER}</p><p class="copyright-history">{SPRING}</p></article>', f"Law {RIVER} {SPRING}"),
    (f'<article><p>{RIVER}</p><p>{SPRING}</p></article><div class="user-posts"><p>Great read, thanks!</p><p>I do not agree with the author at all, my village never flooded in those years.</p></div>', f"{RIVER} {SPRING}"),
    ("<body><p>Closed on Mondays.</p></body>", "Closed on Mondays."),
    (f'<article><h2>Teaser</h2><p>Read about the flood.</p></article><div class="text"><p>{RIVER}</p><p>{SPRING}</p></div>', f"Teaser Read about the flood. {RIVER} {SPRING}"),
)


@pytest.mark.parametrize(("page", "text"), BY_HAND)
def test_html_pages_marked_by_hand(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


def test_flags_alone_do_not_decide():
    """Without what a block's surroundings are named, most situations of the table are still told right by words, links and phrases."""
    rows = np.array(html_text.LABELLED)
    same_flags = rows[(rows[:, 6] == 0) & (rows[:, 10] == 0)]
    groups = {tuple(r[[7, 8]]) for r in same_flags}
    assert all(0.2 < same_flags[(same_flags[:, [7, 8]] == g).all(1)][:, -1].mean() < 0.8 for g in groups)  # each has both kinds
    said = [html_text.is_content(tuple(r[:-1])) == bool(r[-1]) for r in same_flags]
    assert np.mean(said) >= 0.95


def test_html_words_and_links_decide():
    long = " ".join(["word"] * 30)
    links = "<ul>" + "".join(f"<li><a href=/{i}>Some link {i}</a></li>" for i in range(4)) + "</ul>"
    for page, want in (
        (f'<article><h1>Title</h1><p>{long}</p>{links}<p>{long}</p><p>Advertisement</p><p>{long}</p><p>We use cookies to give you the best experience.</p><h2>Log in</h2><p>{long}</p></article>', f"Title {long} {long} {long} Log in {long}"),
        (f'<article><p>{long}</p><p><a href=u>One linked sentence</a></p><p>{long}</p></article>', f"{long} One linked sentence {long}"),
        (f'<article><header><h1>My title</h1></header><p>{long}</p><p>Short.</p></article>', f"My title {long} Short."),
        (f'<body>{links}<h1>A title</h1><p>Five words in a row.</p><p>Yes.</p><h2>Part two</h2><p>{long}</p><p>That is the very end.</p>{links}</body>', f"A title Five words in a row. Yes. Part two {long} That is the very end."),
        ("<body><h1>My own page</h1><p>Hello to you all.</p></body>", "My own page Hello to you all."),
        (f"<body><form action=x><div><h1>Title</h1><p>{long}</p><p>{long}</p></div></form></body>", f"Title {long} {long}"),
        (f"<body>{links}{links}</body>", ""),
    ):
        assert html_text.main_text(page) == want


def test_running_text_is_kept_whatever_is_beside_it():
    beside = [(n, share) for n in (0, 1, 3, 8, 20, 70) for share in (0.0, 1.0) if n or not share]
    for before in beside:
        for after in beside:
            for article in (0, 1):
                assert all(html_text.is_content((*before, n, links, *after, 0, article, 0, 0.0, 0)) for n in (15, 30, 100) for links in (0.0, 0.2))
                assert all(html_text.is_content((*before, n, 0.0, *after, 0, article, 1, 0.0, 0)) for n in (30, 100))
                assert not any(html_text.is_content((*before, n, 1.0, 3, 1.0, 0, article, 0, 0.0, 0)) for n in (1, 3, 10))


def test_neighbours_are_in_the_tree():
    def columns(at):
        return {at[0]} | columns(at[2]) | columns(at[3]) if isinstance(at, tuple) else set()

    assert {2, 3, 4, 5} <= columns(html_text.tree()) and 1 in columns(html_text.tree())


def test_tree_learns_its_table():
    right = sum(html_text.is_content(tuple(r[:-1])) == bool(r[-1]) for r in html_text.LABELLED)
    assert right >= 0.95 * len(html_text.LABELLED)


def test_html_query(spark):
    rows = html_text.query(spark, DATA).collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) > 0 for r in rows)
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>", "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in html_text.extract(odd).collect()] == ["", "", ""]
    assert html_text.extract(odd.limit(0)).count() == 0


def test_licences(spark):
    scanner = licences.Scanner()
    names = lambda t: [(s.licence, s.kind) for s in scanner.scan(t)]
    assert names("Some prose here.\nReleased under the MIT License.\nMore prose follows.") == [("MIT", "line")]
    assert names("LICENSED  under the apache license, version 2.0") == [("Apache-2.0", "text")]
    assert names("This is no notice of any kind.") == names(None) == names("") == []
    full = dict(licences.TEMPLATES[3:4])["MIT"].replace(". ", ".\n")
    assert names(f"{'intro words ' * 60}\n\nCopyright (c) 2001 Some One\n{full}\n\nend words") == [("MIT", "paragraph")]
    found = scanner.scan("some other words\nAll rights reserved.\n")[0]
    assert (found.start, found.end, found.dice) == (17, 37, 1.0)
    rows = licences.query(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    assert rows and all(licences.tokens(texts[r.doc_id][r.start : r.end]) for r in rows)
    assert licences.scan(odd_documents(spark)).count() == licences.scan(empty_documents(spark)).count() == 0


def test_licences_across_blank_lines_and_within_lines():
    scanner = licences.Scanner()
    found = lambda t: [(s.licence, t[s.start : s.end]) for s in scanner.scan(t)]
    prose = "intro words that say nothing of licences. " * 20
    mit, gpl = (next(x for n, x in licences.TEMPLATES if n == name and len(x) > 300) for name in ("MIT", "GPL-3.0"))
    for name, text, breaks in (("MIT", mit, (" The above copyright", " THE SOFTWARE IS PROVIDED")), ("GPL-3.0", gpl, (" This program is distributed", " You should have"))):
        for cut in breaks:
            text = text.replace(cut, "\n\n" + cut[1:])
        assert text.count("\n\n") == 2
        (hit,) = scanner.scan(f"{prose}\n\nCopyright (c) 2001 Some One\n\n{text}\n\n{prose}\n")
        assert (hit.licence, hit.dice, hit.kind, hit.end - hit.start) == (name, 1.0, "words", len(text.rstrip("./>")))
        twice = f"{prose}\n\n{text}\n\n{text}"
        assert [(s.licence, s.dice) for s in scanner.scan(twice)] == [(name, 1.0)] * 2
        commented = "x = 1\n" + "".join(f"# {line}\n" for line in text.split("\n")) + "y = 2\n"
        assert [s.licence for s in scanner.scan(commented)] == [name]
    inside = f"{prose} it is Licensed under the MIT License. Read on. {prose} Released under the Apache License, Version 2.0, {prose}"
    assert found(inside) == [("MIT", "Licensed under the MIT License"), ("Apache-2.0", "Released under the Apache License, Version 2.0")]
    assert found(f"{mit}\nLicensed under CC BY 4.0.")[-1] == ("CC-BY-4.0", "Licensed under CC BY 4.0.")
    assert [x for x, _ in found("Copyright 2020 Some One. Licensed under the MIT License.\n" + prose)] == ["MIT"]
    assert found(prose) == []


@pytest.mark.parametrize("name", ["MIT", *licences.COMPLETE])
def test_complete_licences(name):
    scanner, rng = licences.Scanner(), random.Random(8)
    text = max((x for n, x in licences.TEMPLATES if n == name), key=len)
    prose = "Some words of prose that come before it and after it.\n\n" * (len(text) // 40)
    assert [(s.licence, s.dice, s.start, s.end) for s in scanner.scan(text)] == [(name, 1.0, 0, len(text))]
    (hit,) = scanner.scan(f"{prose}{text}\n\n{prose}")
    assert (hit.licence, hit.dice) == (name, 1.0) and text[:-40].strip() in f"{prose}{text}"[hit.start : hit.end + 40]
    changed = " ".join(f"x{rng.random()}".replace(".", "") if rng.random() < 0.04 else w for w in text.split())
    assert name in [s.licence for s in scanner.scan(f"{prose}{changed} {prose}")]
    assert scanner.scan(prose) == []


def test_licence_windows_lose_nothing():
    rng = random.Random(6)
    scanner = licences.Scanner(tuple(x for x in licences.TEMPLATES if len(x[1]) < 200))
    for _ in range(300):
        t = licences.tokens(rng.choice(licences.TEMPLATES[4:])[1])[:20]
        said = [rng.choice(t) if rng.random() < 0.15 else w for _ in range(2) for w in t]
        best = max(2 * sum((licences.bigrams(said[i:j]) & u.grams).values()) / (j - i - 1 + u.size) for i in range(len(said)) for j in range(i + 2, len(said) + 1) for u in scanner.templates if j - i < 60)
        assert bool(scanner.scan(" ".join(said))) == (best >= scanner.least)


def test_licence_bounds_lose_nothing():
    rng = random.Random(4)
    scanner = licences.Scanner()
    vocabulary = sorted(scanner.words)
    for _ in range(400):
        t = rng.choice(scanner.templates)
        base = licences.tokens(next(x for n, x in licences.TEMPLATES if n == t.name and len(licences.tokens(x)) - 1 == t.size))
        said = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in base][: rng.randint(2, len(base) + 1)]
        grams = licences.bigrams(said)
        dice = {(2 * sum((grams & u.grams).values()) / (len(said) - 1 + u.size)) for u in scanner.templates}
        best = scanner.best(said)
        assert (best is None) == (max(dice) < scanner.least) and (best is None or best[1] == max(dice))


def test_ftrl_learns():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        label = rng.random() < 0.3
        idx = np.unique(np.concatenate(([0], rng.integers(10, 500, 20), [5] if label else [6])))
        rows.append((idx, np.ones(len(idx))))
        y.append(float(label))
    idx, found = Ftrl(l1=1.0).fit(rows, np.array(y), 3)
    w = np.zeros(512)
    w[idx] = found[:, 0]
    assert all((sigmoid(float(w[i] @ v)) > 0.5) == bool(t) for (i, v), t in zip(rows, y, strict=True))
    assert (w == 0).mean() > 0.5


def _labels(spark, path):
    return {r.doc_id: (r.quality, r.toxic) for r in table(spark, path, "labels").collect()}


def test_quality(spark):
    path = "/root/testdata/sf0.01"
    labels = _labels(spark, path)
    rows = quality_classifier.query(spark, path).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, labels[r.doc_id][0]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in held if y == label] for label in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert np.mean([s < quality_classifier.THRESHOLD for s in bad]) >= 0.75 and np.mean([s >= quality_classifier.THRESHOLD for s in good]) >= 0.97


def test_quality_is_learnt_without_the_held_out_fifth(spark):
    path = DATA
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    rows = quality_classifier.labelled_rows(docs, labels, "quality").collect()
    texts = {r.text for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert rows and {r.text for r in rows} == texts
    twice = docs.union(docs).withColumn("text", F.concat("text", F.lit("x")))
    assert quality_classifier.labelled_rows(docs.union(twice), labels.union(labels.withColumn("quality", F.lit(0))), "quality", 10).count() == 10


def brute_weighted(text, weights, shapes):
    """The score of a text from a model's weights by feature, features by dictionary."""
    word, shape = (x[0] for x in hashed_words(pa.array([text], pa.string()), shapes=True))
    tokens = [1 if i and word[i] == word[i - 1] else int(x) for i, x in enumerate(word)]
    odd, top = 0x9E3779B97F4A7C15, 2**64
    bucket = lambda a, salt: ((a ^ salt * odd % top) * odd % top) >> (64 - quality_classifier.BITS)
    counts = Counter()
    for seq, one, two in ((tokens, 1, 3), ([int(x) for x in shape], 2, 4)):
        counts.update(bucket(x, one) for x in seq)
        counts.update(bucket(x * odd % top ^ y, two) for x, y in zip(seq, seq[1:], strict=False))
    total = weights.get(0, 0.0) + sum(weights.get(f, 0.0) * (n / len(tokens)) ** 0.5 for f, n in counts.items() if f)
    return sigmoid(total)


def test_quality_scores_by_brute_force(spark):
    rng = np.random.default_rng(4)
    idx = np.unique(np.concatenate(([0], rng.integers(1, 1 << quality_classifier.BITS, 1 << 17))))
    weights = idx, rng.normal(size=len(idx))
    by_feature = dict(zip(idx.tolist(), weights[1].tolist(), strict=True))
    texts = [r.text for r in table(spark, DATA, "documents").limit(40).collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_classifier.score(docs, weights).collect():
        assert r.score == pytest.approx(brute_weighted(texts[r.doc_id], by_feature, True), abs=1e-9)


@pytest.mark.parametrize("operator", [quality_classifier.quality_scores, toxicity.toxicity])
def test_classifiers_on_odd_rows(spark, operator):
    docs, labels = odd_documents(spark), table(spark, DATA, "labels")
    assert operator(docs, labels).count() == docs.count()
    none = operator(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert operator(empty_documents(spark), labels).count() == 0
    null = spark.createDataFrame([(None, None, None), (3, None, None), (0, 7, 7)], "doc_id long, quality int, toxic int")
    assert {r.score for r in operator(docs, null).collect()} == {0.5}


def test_toxicity(spark):
    path = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, path).collect()
    assert len(rows) == 1000
    kept = toxicity.keep(table(spark, path, "documents"), table(spark, path, "labels"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.toxic}


def test_toxicity_of_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    labels, docs = table(spark, path, "labels"), table(spark, path, "documents")
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    weights = toxicity._trained(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti"), toxicity.MAX_LABELS)
    rows = docs.join(held, "doc_id").select("text", F.col("toxic")).collect()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r.text for r in rows], pa.string())})
    toxic = np.array([r.toxic for r in rows], bool)
    found = toxicity.Scorer(spark, weights)(batch)[:, -1] > toxicity.THRESHOLD
    assert found[toxic].mean() >= 0.85 and found[~toxic].mean() <= 0.02
    alone = toxicity.Scorer(spark, [(idx[idx > 63], w[idx > 63]) if c < len(weights) - 1 else (idx[(idx == 0) | (idx > 63)], w[(idx == 0) | (idx > 63)]) for c, (idx, w) in enumerate(weights)])(batch)[:, -1] > toxicity.THRESHOLD
    assert alone[toxic].mean() < found[toxic].mean()  # the chain's features help


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for _ in range(400):
        a = rng.random() < 0.4
        rows.append(np.unique(np.concatenate(([0], rng.integers(100, 5000, 10), [64 + a]))))
        marks.append((float(a), float(a)))
    weights = toxicity.train_chain(rows, np.array(marks))
    idx, w = weights[1]
    assert w[idx.tolist().index(1)] > 0


def brute_pieces(tokenizer, text, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(i // capacity, i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i in range(0, len(ids), capacity) for p in [ids[i : i + capacity]]]


def test_packing_by_the_tokenizer(spark):
    import public_tokenizers

    tokenizer = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    docs = table(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*ODD, "it's we'll '", "<|endoftext|> a<|endoftext|>b", "ΣΑΣ ﬁ Ⅷ"])], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack_documents(docs).collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: brute_pieces(tokenizer, t, 2048) for k, t in texts.items()}
    filled: dict = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert packing.pack_documents(odd_documents(spark)).select("doc_id").count() >= odd_documents(spark).count()
    assert packing.pack_documents(empty_documents(spark)).count() == 0


def test_word_ids_equal_the_whole_tokenizer():
    import public_tokenizers

    known = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    signs = "aZ'é<>|!1 \tßÀn's.t́İ &%"
    for _ in range(2000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))
        assert np.frombuffer(known.ids(t), "<u4").tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("sizes", [(300, 900), (1, 2047), (700, 1100), (1, 1), (1024, 1024)])
def test_local_search_only_helps(sizes):
    rng = random.Random(1)
    lengths = [rng.randint(*sizes) for _ in range(800)]
    before = packing.best_fit(lengths, 2048)
    after = packing.improve(before, lengths, 2048)
    assert sorted(i for b in after for i in b) == list(range(800)) and max(sum(lengths[i] for i in b) for b in after) <= 2048
    assert -(-sum(lengths) // 2048) <= len(after) <= len(before)


def test_local_search_empties_a_bin():
    lengths = [6, 4, 5, 5, 4, 3, 3]  # 30 in bins of 10: by hand 6+4, 5+5, 4+3+3
    assert len(packing.improve([[0, 5], [1, 2], [3, 4], [6]], lengths, 10)) == 3
