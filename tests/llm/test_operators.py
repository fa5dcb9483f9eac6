"""The corpus operators against plain Python on small tables with nulls, empty and repeated rows, ties and clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import common, html_extract, near_dedup, quality, topk_search
from tidewire.llm.decontaminate import FMIndex, decontaminate
from tidewire.llm.language_id import dictionaries, identify_language
from tidewire.llm.license_scan import PHRASES, TEMPLATES, license_scan
from tidewire.llm.line_dedup import line_dedup
from tidewire.llm.mixing import mix_sources
from tidewire.llm.near_dedup import near_duplicates
from tidewire.llm.quality import score_quality
from tidewire.llm import suffix_dedup as suffix_dedup_module
from tidewire.llm.suffix_dedup import intervals, suffix_dedup

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, _x int"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]


def test_words_hash_alike_everywhere():
    column = pa.array(["Hello wörld", None, "x hello", "hellohello WÖRLD"])
    data, offsets = common.buffers(column)
    w = common.Words(data, offsets, 0, 4)
    assert w.count.tolist() == [2, 0, 2, 2]
    assert w.hash[0] == w.hash[3] == common.word_hash("hello") and w.hash[1] != w.hash[5]


def test_stack_scan_gives_nested_intervals():
    assert sorted(intervals(np.array([3, 5, 3, 0, 4]), 1)) == [(0, 3, 3), (1, 2, 5), (4, 5, 4)]


@pytest.mark.parametrize(("block", "length"), [(4096, 200), (5, 200), (1, 200), (2, 61)])
def test_suffix_dedup_is_exact(spark, corpus, monkeypatch, block, length):
    monkeypatch.setattr(suffix_dedup_module, "BLOCK", block)
    random.seed(2)
    base = corpus[0][1]
    rows = corpus[:25] + [(1, None), (None, ""), (7, "ab" * 300), (7, "ab" * 300), (8, "x" * 205), (9, "\0" * 250), (10, "y\0" * 120), (11, "short")]
    for i in range(15):
        a = random.randrange(max(len(base) - 600, 1))
        rows.append((500 + i, base[a : a + random.randrange(150, 500)] + f"q{i}" + corpus[2][1][:230]))
    # One hot anchor: the same passage between texts of each document's own, and between a few that repeat.
    hot = "".join(random.choice("abcdefgh ") for _ in range(330))
    for i in range(60):
        own = "".join(random.choice("xyz") for _ in range(random.randrange(0, 300)))
        rows.append((600 + i, own + hot[random.choice([0, 0, 40]) : random.choice([330, 330, 250])] + (own[::-1] if i % 3 else "the same end of some texts" * (i % 4))))
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = collections.Counter()
    for (key, _), t in zip(rows, texts, strict=True):
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        spans = sum(1 for i in range(len(t)) if mask[i] and (not i or not mask[i - 1]))
        want[(key, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup(spark.createDataFrame(rows, DOC), length=length).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 5, 400)
    index = FMIndex(text, 4)
    for n in (1, 2, 3, 5):
        phrases = rng.integers(1, 5, (20, n))
        first, last = index.search(phrases)
        for p, a, b in zip(phrases, first, last, strict=True):
            places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


@pytest.mark.parametrize("block_bytes", [16 << 20, 1500])
def test_decontaminate_finds_all_windows(spark, sf_dir, corpus, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).collect()]
    items += [(900, "that is"), (901, "Öoö über"), (None, "the of"), (902, None), (903, "!!"), (904, items[3][1])]
    rows = corpus + [(3, None), (None, ""), (5, "the and " * 30 + items[5][1].upper() + " x " + items[5][1]), (6, "öoö über ÖOÖ über"), (6, "that is that is that")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORDS.findall(low(t))
        for a in range(max(len(w) - 10, 0) + 1) if w and i is not None else ():
            windows[tuple(w[a : a + 10])].add(str(i))
    want = collections.Counter()
    for d, t in rows:
        w, hit, found = WORDS.findall(low(t)), set(), set()
        for a in range(len(w)):
            for n in {len(k) for k in windows}:
                if len(k := tuple(w[a : a + n])) == n and k in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        want[(d, len(w), len(hit), ",".join(sorted(found)))] += 1
    got = decontaminate(spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"], block_bytes=block_bytes).collect()
    assert collections.Counter((r.doc_id, r._n_words, r._n_hit, ",".join(r._items)) for r in got) == want


def test_license_scan_finds_every_phrase(spark, corpus):
    rows = corpus + [(1, None), (None, ""), (2, "CC-BY cc by all rights reserved"), (2, "CC-BY cc by all rights reserved"), (3, "cc"), (7, "cc by by cc by"), (8, "Licensed under the very Apache License, Version 2.0."), (9, "a mit license")]
    want = collections.Counter()
    for d, t in rows:
        w, starts, labels = WORDS.findall(low(t)), [], set()
        for p, label in PHRASES.items():
            p = p.split()
            own = [a for a in range(len(w) - len(p) + 1) if w[a : a + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        want[(d, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))] += 1
    got = license_scan(spark.createDataFrame(rows, DOC)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert [r.labels for r in got if r.doc_id == 8 and r.n_words == 9] == ["apache-2.0"]
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def best_share(words, template, drift=3):
    """The largest share of a template's grams in a span of its length and a quarter more, by trying all spans of each run of neighbouring diagonals."""
    template = template.split()
    k = 3 if len(template) >= 3 else 2
    grams = [tuple(template[i : i + k]) for i in range(len(template) - k + 1)]
    votes = sorted((i, t) for i in range(len(words) - k + 1) for t, g in enumerate(grams) if tuple(words[i : i + k]) == g)
    runs, last = [], None
    for d in sorted({i - t for i, t in votes}):
        if last is None or d - last > drift:
            runs.append(set())
        runs[-1].add(d)
        last = d
    best = 0.0
    for run in runs:
        own = [(i, t) for i, t in votes if i - t in run]
        for i, _ in own:
            best = max(best, len({t for j, t in own if i <= j <= i + int(1.25 * len(template)) - k}) / len(grams))
    return best


def test_license_labels_and_scores_against_all_spans(spark, corpus):
    random.seed(11)
    rows = [(100, "released under the released under the mit license"), (101, "the the released under the mit license and licensed under the very Apache License, Version 2.0."), (102, "SPDX-License-Identifier: Apache-2.0"), (103, "This is free and unencumbered software"), (104, " ".join(["released under the"] * 40)), (105, None), (105, "")]
    for i in range(60):
        words = random.choice(TEMPLATES)[1].split()
        for _ in range(random.randrange(0, 1 + len(words) // 3)):
            at = random.randrange(len(words))
            words[at : at + random.randrange(2)] = random.choice([["other"], [], ["the"], words[:3]])
        rows.append((200 + i, " ".join(random.choice(corpus)[1].split()[:20] + words + ["end"])))
    got = license_scan(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        words = WORDS.findall(low(t))
        shares = [(best_share(words, text), label) for label, text in TEMPLATES]
        found = [(s, label) for s, label in shares if s >= 0.6]
        base = {label for p, label in PHRASES.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        assert by[d].labels == ",".join(sorted({label for _, label in found} | base)), t
        assert by[d].score == pytest.approx(max([s for s, _ in found] + [1.0] * bool(base), default=0.0))
    assert by[100].labels == "mit" and by[102].labels == "apache-2.0" and by[104].labels == ""
    assert license_scan(spark.createDataFrame(rows, DOC).limit(0)).count() == 0


def test_html_main_text(spark):
    page = lambda body, i: f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li>home<li>about</ul></nav><div class='top ad'>buy</div><article><h1>T{i}</h1>{body}<div id='comments'>first!</div></article><aside>side</aside><form>f<input></form><footer>&copy; x</footer></body>"
    rows = [(i, f"http://h.example/{i}", page(f"<p>one  {i} &amp; <b>two<br>three<p>four\n{i}<!-- x --><ul><li>a<li>b</ul>", i)) for i in range(4)] + [(9, None, None), (10, "x", ""), (11, "http://solo/", "plain <b>text</b>")]
    got = {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].text == "T2\n\none 2 & two three\n\nfour 2\n\na\n\nb" and got[2].n_chars == len(got[2].text)
    assert (got[9].text, got[10].text, got[11].text) == ("", "", "plain text")


def test_html_style_tree_cuts_repeated_branches(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class='x'>Same words on all pages</div><div class='y'><p>own text {i} of the page</p></div></body>") for i in range(6)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"own text {r.page_id} of the page" for r in got)


@pytest.mark.parametrize(("body", "want"), [
    ('<body class="has-sidebar"><article><p>kept</p></article></body>', "kept"),
    ('<body><main class="no-sidebar"><p>kept</p></main></body>', "kept"),
    ('<article class="post share-enabled"><p>kept</p></article>', "kept"),
    ('<article><p>a <math><mi>x</mi></math> <svg><text>y</text></svg> <object>z</object></p></article>', "a x y z"),
    ('<article><p>a <span class="ad">buy <span>now</span></span> b</p></article>', "a b"),
    ('<article><div class="cookie-banner">c</div><div class="content-with-sidebar">kept</div><div class="site_footer">f</div></article>', "kept"),
    ('<article><p>kept</p></article><div id="comments"><article class="comment"><p>first!</p></article></div>', "kept"),
    ('<article><p>&lt;b&gt; &amp;amp; &#233;</p><p> </p></article>', "<b> &amp; é"),
    ("<p>unclosed <b>text", "unclosed text"),
    ('<article><div class="menu-planning-guide"><p>plan</p></div><div class="lunch-menu">soup</div></article>', "plan\n\nsoup"),
    ('<article><h2 id="related-work">Related</h2><section id="ad-hoc-networks"><p>nets</p></section><h2 id="comments">On comments</h2></article>', "Related\n\nnets\n\nOn comments"),
    ('<article><span class="ad"><p>BUY</p><div>x</div></span><p>after</p><ins class="adsbygoogle"><div>X</div></ins></article>', "after"),
    ('<article><div><span class="ad">unclosed<p>BUY</p></div><p>after</p></article>', "after"),
    ('<article><p>kept</p></article><div role="contentinfo">c</div><div role="complementary">d</div><section role="navigation">n</section>', "kept"),
    ('<body><p>kept</p><div role="contentinfo">c</div><div role="complementary">d</div><section role="note">n</section><div id="sidebar">s</div></body>', "kept\n\nn"),
])
def test_html_names_are_priors(body, want):
    assert html_extract.main_text(body, {}) == want


@pytest.mark.parametrize(("pages", "stays"), [(5, True), (49, False), (51, False)])
def test_html_unnamed_boxes_inside_articles(spark, pages, stays):
    rows = [(i, f"http://h.example/{i}", f"<article><p>own {i} text {i * i}</p><div class='x{i}'>Same words on all pages</div></article>", "clash") for i in range(pages)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, tree string")).collect()
    assert sorted(r.text for r in got) == sorted(f"own {i} text {i * i}" + ("\n\nSame words on all pages" if stays else "") for i in range(pages))


def test_html_style_tree_against_plain_python(spark, sf_dir):
    """The tree in dicts over all pages of a host, one of them hot and with repeated rows; then every page cut by it."""
    own = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60).collect()]
    box = "<div><section class='k'>Read the other pages too</section><section>{}</section></div>"
    rows = [(i, f"http://host{i % 3 if i % 2 else 0}/", (h or "") + box.format(i // 4)) for i, (_, _, h) in enumerate(own)] + [(7, "http://host0/", "<p>x</p>" + box.format(1))] * 3 + [(None, None, None), (9, "no url", "<p>solo</p>")]
    hosts = collections.defaultdict(list)
    for _, url, page in rows:
        hosts[(re.match(r"http://([^/]+)", url or "") or ["", ""])[1]].append([b for b in html_extract.blocks(page or "") if not b.noise])
    want = collections.Counter()
    for key, url, page in rows:
        pages, nodes = hosts[(re.match(r"http://([^/]+)", url or "") or ["", ""])[1]], {}
        for node in {p for blocks in pages for b in blocks for p in b.path}:
            below = [{b.text for b in blocks if node in b.path} for blocks in pages]
            below = [t for t in below if t]
            n, df = len(below), collections.Counter(t for texts in below for t in texts)
            if n > 1:
                content = 1 - sum(np.log(v) for v in df.values()) / len(df) / np.log(n)
                styles = collections.Counter(map(len, below))
                presentation = -sum(v / n * np.log(v / n) for v in styles.values()) / np.log(n)
                keep = 0.9 ** len(df)
                seen = (1 - keep) * content + keep * max(content, presentation)
                nodes[node] = 1 - np.log(n) / (1 + np.log(n)) * (1 - seen)
        want[(key, url, html_extract.main_text(page or "", nodes))] += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (100_000, 0):  # broadcast, and joined by host
        got = html_extract.extract_text(df, broadcast_rows=few).collect()
        assert collections.Counter((r.page_id, r.url, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_top_k_is_exact():
    rng = np.random.default_rng(1)
    for n, d, scale in ((200, 7, 3), (600, 64, 150), (150, 130, 40), (3, 5, 10)):
        x = np.floor(rng.normal(size=(n, d)) * scale).astype(np.int64)
        x[n // 2 : n // 2 + 8] = x[0]
        ids = rng.permutation(n) * 2
        got = collections.defaultdict(list)
        for i, row, score in zip(*topk_search.search(topk_search.Index(ids, x), x[:20], ids[:20], 5), strict=True):
            got[i].append((-score, row))
        for i in range(min(20, n)):
            assert sorted(got[i]) == sorted((-int(x[i] @ x[j]), ids[j]) for j in range(n) if j != i)[:5]


def test_bitmap_addition_gives_the_scores():
    rng = np.random.default_rng(6)
    x, q = rng.integers(-50, 90, (130, 9)), rng.integers(-40, 30, (7, 9))
    index = topk_search.Index(np.arange(130), x)
    score, offset = index.scores(q)
    for i in range(7):
        bits = [np.unpackbits(s[i].view(np.uint8), bitorder="little")[:130].astype(np.int64) << b for b, s in enumerate(score)]
        assert (sum(bits) + offset[i] == x @ q[i]).all()


def test_top_k_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-1.0]), (None, [9.0, 9.0]), (6, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 65536), (0, 2, 6, 65536), (0, 3, 5, -65536)]
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_line_dedup_removes_later_windows(spark):
    rows = [(1, "a\nb\nc\nd", "u"), (2, "x\na\nb\nc\ny", "v"), (3, "a\nb", "w"), (4, None, "n"), (5, "", "e"), (None, "a\nb\nc", "z"), (6, "\n\n\n\n", "b"), (7, "p\np\np\np\np", "r")]
    got = {r.lang: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k].text for k in "uvwnezb"] == ["a\nb\nc\nd", "x\ny", "a\nb", None, "", "", "\n\n\n\n"]
    assert got["r"].text == "p" and got["r"]._n_removed == 4 and got["n"]._n_lines == 0


def test_mix_reaches_targets(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * random.randrange(0, 40)), random.choice(["a", "b", "c", None])) for i in range(300)] + [(5, None, "a"), (5, "x y", "a"), (5, "x y", "a"), (None, "q", "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 3.0), (1, 2.0), (2, 0.1)], "doc_id long, weight double")
    got = mix_sources(df, labels).collect()
    again = mix_sources(df.repartition(7), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {(r.source_size, r.target): 0 for r in got}
    for r in got:
        by[(r.source_size, r.target)] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 and all(abs(v - t) < 1 and t <= 2 * s for (s, t), v in by.items())
    assert mix_sources(df.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark, corpus):
    random.seed(3)
    rows = corpus + [(1, None), (None, ""), (2, "aa bb"), (3, "AA, bb!"), (4, "cc"), (5, corpus[5][1]), (5, corpus[5][1])]
    base = corpus[7][1].split()
    for i in range(60):
        w = list(base)
        for _ in range(random.randrange(1, 12)):
            w[random.randrange(len(w))] = f"zz{random.randrange(1000)}"
        rows.append((20000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, DOC).repartition(5)
    idf = near_dedup.inverse_frequencies(df.select(F.coalesce("text", F.lit("")).cast("binary").alias("_text")), 5)
    texts = sorted({t or "" for _, t in rows})
    vectors = []
    for t in texts:
        data, offsets = common.buffers(pa.array([t.encode()]))
        _, h, n = near_dedup.shingles(common.Words(data, offsets, 0, 1), 5)
        vectors.append((h, n * idf[(h & np.uint64(near_dedup.FEATURES - 1)).astype(int)]))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.weighted_jaccard(*vectors[i], *vectors[j]) >= 0.8:
                top[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for d, t in rows:
        i = texts.index(t or "")
        classes[find(i) if len(vectors[i][0]) else ("alone", d, t or "")].append(d)
    want = collections.Counter()
    for members in classes.values():
        ids = [d for d in members if d is not None]
        want.update((d, min(ids) if ids else None, len(members)) for d in members)
    got = near_duplicates(df).collect()
    have = collections.Counter()
    for r in got:
        have[(r._id, r.class_id, r.class_size)] += r.copies
    assert have == want and sum(r.stays for r in got) == len(classes)


def near_classes(df):
    """The class sizes of all documents by comparing all pairs; texts differ and have five words at least."""
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    idf = near_dedup.inverse_frequencies(df.select(F.col("text").cast("binary").alias("_text")), 5)
    vectors = near_dedup.vectors(pa.array([t.encode() for _, t in rows]), 5, idf)
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if top[i] != top[j] and near_dedup.weighted_jaccard(*vectors[i], *vectors[j]) >= 0.8:
                top = [top[j] if t == top[i] else t for t in top]
    return {d: min(rows[j][0] for j in range(len(rows)) if top[j] == top[i]) for i, (d, _) in enumerate(rows)}


def replaced(words, places, tag):
    return [f"zz{tag}x{i}" if i in places else w for i, w in enumerate(words)]


def test_near_duplicates_of_a_star_in_large_buckets(spark, monkeypatch):
    random.seed(8)
    base = [f"w{i}" for i in range(800)]
    rows = [(i, " ".join(replaced(base, {5 * x for x in random.sample(range(160), 6)}, i) if i else base)) for i in range(121)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    want = near_classes(df)
    assert set(want.values()) == {0}
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    assert {r._id: r.class_id for r in near_duplicates(df).collect()} == want


def test_near_duplicates_in_a_family_just_below_the_threshold(spark):
    random.seed(9)
    base, rows = [f"w{i}" for i in range(1200)], []
    for i in range(40):
        first = replaced(base, {5 * i + 4 + 200 * k for k in range(6)}, i)
        rows += [(2 * i, " ".join(first)), (2 * i + 1, " ".join(replaced(first, {5 * x + 4 for x in random.sample(range(240), 10)}, 100 + i)))]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    want = near_classes(df)
    assert len(set(want.values())) > 25
    assert {r._id: r.class_id for r in near_duplicates(df).collect()} == want


def test_large_buckets_stay_linked(monkeypatch):
    rng = np.random.default_rng(0)
    samples = np.tile(rng.integers(0, 1000, near_dedup.SAMPLES, dtype=np.uint32), (40, 1))
    samples[:, :4] = rng.integers(0, 9, (40, 4))
    monkeypatch.setattr(near_dedup, "BUCKET", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 40, type=pa.int64()), pa.array([bytes([i]) for i in range(40)]), pa.array([None] * 40, type=pa.binary()), pa.array([s.tobytes() for s in samples])], names=["bucket", "node", "component", "samples"])
    top = {bytes([i]): bytes([i]) for i in range(40)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for part in near_dedup._links(0.6)([batch]):
        for a, b in zip(*(part.column(c).to_pylist() for c in "ab"), strict=True):
            top[find(a)] = find(b)
    assert len({find(x) for x in top}) == 1


def test_quality_learns_and_survives_odd_input(spark):
    random.seed(5)
    good = lambda: " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    bad = lambda: "!! ".join(random.choice(["BUY", "NOW", "WIN"]) for _ in range(30))
    rows = [(i, good() if i % 3 else bad(), "en", "s" if i % 3 else "t", 1, "clash", i) for i in range(120)] + [(None, None, None, None, None, None, None), (5, "", "en", "s", 0, "", 1)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 90)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = score_quality(df, labels).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 90]
    assert len(got) == len(rows) and set(df.columns) < set(got[0].asDict()) and all((r._q_score >= 0.5) == bool(r.doc_id % 3) for r in held)
    assert {r._q_score for r in score_quality(df, labels.limit(0)).collect()} == {0.5}


def test_quality_learns_from_all_unlabelled_documents(spark, sf_dir):
    """Co-training in plain Python over all rows at once: words, shapes and counts as dicts, pseudo-labels of all other documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    model = quality.co_train(docs, labels)
    hashed = docs.join(labels, "doc_id", "left").select("doc_id", "text", "source", "lang", F.col("quality").alias("q"), (F.pmod(F.xxhash64(F.xxhash64("doc_id", F.col("text").cast("binary"), F.lit(5))), F.lit(5)) == 0).alias("fifth"))
    rows = [(r.fifth, r.doc_id, r.text, r.source, r.lang, r.q) for r in hashed.collect()]
    views = [next(quality._views(pa.array([t]), pa.array([s]), pa.array([g])))[2] for _, _, t, s, g, _ in rows]
    fifth = [r[0] for r in rows]
    known = [i for i, r in enumerate(rows) if r[5] is not None]
    held = [i for i in known if fifth[i]]
    assert {rows[i][5] for i in held} == {0, 1}

    def raw_of(ratios):
        own = sorted((*views[i].odds(ratios)[:, 0].tolist(), rows[i][5]) for i in held)
        return np.array(own)[:, :2].T, np.array(own)[:, 2]

    def counted(pseudo):
        counts = [np.zeros((2, quality.TEXT_FEATURES)), np.zeros((2, quality.META_FEATURES))]
        for i, v in enumerate(views):
            for view in (0, 1):
                label = (-1 if fifth[i] else rows[i][5]) if i in known else pseudo[view][i]
                if label >= 0:
                    own = v.meta[0] if view else v.feature
                    for f in own.tolist():
                        counts[view][label, f] += 1 / len(own)
        return counts

    want = quality.CoTrained(counted([[-1] * len(rows)] * 2), raw_of)
    for _ in range(3):
        odds = np.concatenate([want.odds(v) for v in views], axis=1)
        sure = np.where(odds >= np.log(19), 1, np.where(odds <= -np.log(19), 0, -1)).tolist()
        want = quality.CoTrained(counted(sure[::-1]), raw_of)
    for a, b in zip([*model.ratios, *model.scale, model.both], [*want.ratios, *want.scale, want.both], strict=True):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_quality_words_and_shapes():
    text = np.frombuffer("Ab12 ab!! ab!! é\nX".encode() + b"  q", dtype=np.uint8)
    row, feature, again = quality.text_features(text, np.array([0, len(text) - 3, len(text)]))
    words = [common.span_hashes(common.LOWER[np.frombuffer(w, dtype=np.uint8)], np.array([0]), np.array([len(w)]))[0] for w in (b"ab12", b"ab!!", b"ab!!", "é".encode(), b"x", b"q")]
    half = np.uint64(quality.TEXT_FEATURES // 2)
    assert row.tolist() == [0] * 5 + [1] + [0] * 5 + [1] + [0] and again.tolist() == [0]
    assert feature[:6].tolist() == [int(w % half) for w in words] and feature[-1] == quality.TEXT_FEATURES - 1 and feature[7] == feature[8]


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels.where("doc_id % 3 > 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    assert got.agg(F.avg(((F.col("_q_score") >= 0.5) == (F.col("quality") > 0)).cast("double"))).first()[0] > 0.95


def test_language_by_compression(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    content = dictionaries(docs, learn=~test)
    found = identify_language(docs.where(test), content, keep=["lang"]).where("NOT rejected").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert found > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é")], DOC)
    assert [r.lang_pred for r in identify_language(odd, content, keep=["doc_id"]).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in identify_language(odd, {}, keep=["doc_id"]).collect()} == {"und"}
    assert dictionaries(docs.limit(0)) == {}


def test_language_against_plain_compression(spark, sf_dir):
    """Sizes by zstandard itself, text by text; ties go to the first name."""
    import zstandard

    from tidewire.llm import language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = dictionaries(docs)
    rows = docs.where("length(text) > 0").orderBy("lang", "doc_id").collect()
    some = [r for k, r in enumerate(rows) if k % 3 == 0][:64] + [max(rows, key=lambda r: len(r.text))]
    assert len({r.lang for r in some}) == len(content) >= 4 and max(len(r.text.encode()) for r in some) > language_id.PIECE
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame([(r.doc_id, r.text) for r in some], DOC), content, keep=["doc_id"]).collect()}
    for r in some:
        text = r.text.lower().encode()
        sizes = {}
        for lang, own in content.items():
            data = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=data, write_content_size=False).compress(text[a : a + language_id.PIECE])) for a in range(0, len(text), language_id.PIECE))
        (best, lang), (second, _) = sorted((n, k) for k, n in sizes.items())[:2]
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].margin == pytest.approx((second - best) / second) and got[r.doc_id].score == pytest.approx(second / (second + best))
    same = {"b": content["en"], "a": content["en"], "c": content["de"]}
    tied = identify_language(spark.createDataFrame([(r.doc_id, r.text) for r in some if r.lang == "en"], DOC), dict(sorted(same.items())), keep=["doc_id"]).collect()
    assert {(r.lang_pred, r.score, r.margin, r.rejected) for r in tied} == {("a", 0.5, 0.0, True)}
