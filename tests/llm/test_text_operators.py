"""BPE, FM-index decontamination, language identification, attribution, HTML and toxicity on small cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, compression_langid, decontaminate, html_layout, masked_lm, oracles, ordinal_toxicity, token_attribution
from tidemark.llm.fm_index import FMIndex, suffix_array

RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
OWN = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
#: Null, empty, blank, repeated and odd texts, with columns whose names clash with results.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same words here"), (4, "same words here"), (5, "é" * 3000), (None, "x" * 20000), (7, "1 2 3")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t else None, "s", 7, 0.5, "z", True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score double, items string, kept boolean")


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_bpe_is_tiktoken(text):
    raw = OWN.encode([text])[0]
    assert ids(raw) == TIKTOKEN.encode_ordinary(text)
    assert OWN.decode(raw) == text.encode()


def test_bpe_of_long_pieces():
    rnd = random.Random(1)
    texts = ["a" * 5000, "ab" * 3000, " " * 2000, "".join(rnd.choice("abcdefgh") for _ in range(4000)), "=-" * 700]
    assert [ids(x) for x in OWN.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_bpe_frames(spark, odd):
    rows = byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    encoded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).where("decoded is null").isEmpty()
    assert byte_bpe.round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).isEmpty()


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_suffix_array(symbols):
    text = np.array(symbols)
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])


def test_fm_index_finds_all_occurrences():
    rnd = random.Random(2)
    runs = [np.array([rnd.randint(1, 3) for _ in range(rnd.randint(1, 40))]) for _ in range(20)]
    index = FMIndex(runs, 3)
    for size in (1, 2, 4):
        phrases = np.array([[rnd.randint(1, 3) for _ in range(size)] for _ in range(20)])
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high, strict=True):
            found = sorted(index.locate(np.arange(a, b)).tolist())
            want = [int(index.start[k] + i) for k, run in enumerate(runs) for i in range(len(run) - size + 1) if (run[i : i + size] == phrase).all()]
            assert found == sorted(want)


def brute_leaks(texts, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    out = []
    for text in texts:
        own, hit, names = low(text), set(), set()
        for item, body in items:
            q = low(body)
            for s in range(max(1, len(q) - window + 1) if q else 0):
                p = q[s : s + window]
                for a in range(len(own) - len(p) + 1):
                    if own[a : a + len(p)] == p:
                        hit.update(range(a, a + len(p)))
                        names.add(item)
        out.append((len(own), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontamination_matches_brute_force(spark, block_bytes):
    rnd = random.Random(4)
    vocabulary = ["a", "B", "c9", "é", "x"]
    items = [(str(i), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 7)))) for i in range(6)] + [("6", None)]
    texts = [rnd.choice(["-", " ", "  "]).join(rnd.choice([*vocabulary, "Q"]) for _ in range(rnd.randint(0, 40))) for _ in range(25)] + [None, "", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.digest(decontaminate.find(docs, bench, window=4, block_bytes=block_bytes)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_leaks(texts, items, 4)


def test_cutting_leaks_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "Words HERE")], "item_id long, text string")
    cut = decontaminate.cut_text(odd, bench)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert {r.text for r in cut.where("doc_id = 4").collect()} == {"same "}
    assert decontaminate.find(odd.limit(0), bench).isEmpty()
    assert decontaminate.digest(decontaminate.find(odd, bench.limit(0))).where("contaminated").isEmpty()


@pytest.mark.parametrize("block_bytes", [1 << 20, 70])
def test_leaks_of_items_without_id(spark, block_bytes):
    items = [(None, "a b c d"), (1, "x y"), (None, "x y"), (2, None)]
    texts = ["q a b c d q", "x y z", "a b c", None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    con.executemany("insert into benchmark values (?, ?)", items)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find(docs, bench, block_bytes=block_bytes))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(con.sql(f"select {', '.join(names)} from ({oracles.decontamination()})").fetchall())


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fold = compression_langid.fold("doc_id")
    found = compression_langid.predict(docs, compression_langid.fit(docs.where(fold != 1))).join(docs.select("doc_id", "lang"), "doc_id").where(fold == 1)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 30 and right > 0.8
    assert found.where("score < 0 or score > 1").isEmpty()


def test_language_ties_are_rejected():
    found = compression_langid.Classifier({"aa": b"one two three four five", "bb": b"one two three four five"})("one two three")
    assert found[0] == "aa" and found[2]


def test_language_of_odd_rows(spark, odd):
    models = compression_langid.fit(odd)
    assert list(models) == ["en"]
    found = compression_langid.predict(odd, models).collect()
    assert sorted(r.lang_pred for r in found) == ["en"] * 4 + ["und"] * 4
    assert {r.lang_pred for r in compression_langid.predict(odd, compression_langid.fit(odd.limit(0))).collect()} == {"und"}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.\n|-漢 x", max_size=120))
def test_attribution_adds_up(text):
    encoder = token_attribution.Encoder(RANKS, public_tokenizers.PATTERN) if not hasattr(test_attribution_adds_up, "e") else test_attribution_adds_up.e
    test_attribution_adds_up.e = encoder
    if not text:
        return
    found = token_attribution.sections(text)
    assert found[0][1] == 0 and [s for _, s in found] == sorted({s for _, s in found})
    first, last = encoder.spans(text)
    counts = token_attribution.allocate(first, last, np.array([s for _, s in found]), len(text))
    n = len(TIKTOKEN.encode_ordinary(text))
    assert counts["start"].sum() == counts["majority"].sum() == n and counts["split"].sum() == pytest.approx(n)


def test_attribution_by_rule():
    counts = token_attribution.allocate(np.array([0, 3]), np.array([3, 6]), np.array([0, 4]), 6)
    assert counts["start"].tolist() == [2, 0] and counts["majority"].tolist() == [1, 1]
    assert counts["split"].tolist() == pytest.approx([4 / 3, 2 / 3])


def brute_attribution(text, cut):
    """Tokens of each section by rule, character by character."""
    owner = [max(k for k, (_, s) in enumerate(cut) if s <= c) for c in range(len(text))]
    byte_owner = [owner[c] for c, ch in enumerate(text) for _ in ch.encode()]
    character = [c for c, ch in enumerate(text) for _ in ch.encode()]
    start, majority, split, at = Counter(), Counter(), Counter(), 0
    for token in TIKTOKEN.encode_ordinary(text):
        size = len(TIKTOKEN.decode_single_token_bytes(token))
        own = [owner[c] for c in sorted(set(character[at : at + size]))]
        start[byte_owner[at]] += 1
        majority[max(sorted(set(own)), key=own.count)] += 1
        for k in own:
            split[k] += 1 / len(own)
        at += size
    return start, majority, split


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é.\n|-漢 x", min_size=1, max_size=80), st.sets(st.integers(1, 79), max_size=8))
def test_attribution_matches_brute_force(text, edges):
    encoder = test_attribution_adds_up.e = getattr(test_attribution_adds_up, "e", None) or token_attribution.Encoder(RANKS, public_tokenizers.PATTERN)
    for cut in (token_attribution.sections(text), [("x", s) for s in [0, *sorted(e for e in edges if e < len(text))]]):
        counts = token_attribution.allocate(*encoder.spans(text), np.array([s for _, s in cut]), len(text))
        wanted = brute_attribution(text, cut)
        for rule, own in zip(("start", "majority", "split"), wanted, strict=True):
            assert counts[rule].tolist() == pytest.approx([own[k] for k in range(len(cut))])


def test_attribution_frames(odd):
    rows = token_attribution.attribute(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id for r in rows} == {3, 4, 5, None, 7}


PAGE = """<html><head><title>no</title></head><body><h1>A &amp; B</h1><p>One<b>two</b>  three<p>Next<br>line
<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div hidden>no</div><div style="display: none">no</div>
<table><tr><th>Name<th>Qty<tr><td>apple<td>12<tr><td colspan=2>wide</table>tail<pre>  p
 q</pre><script>"</p>"</script>end<!-- c --></body>"""


def test_html_layout():
    assert html_layout.visible_text(PAGE) == "A & B\n\nOnetwo three\n\nNext\nline\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName   Qty\napple  12\nwide\n\ntail\n\n  p\n q\n\nend"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/ptdrulxa \"'=!-&", max_size=80))
def test_html_never_fails(html):
    html_layout.visible_text(html)


PIECES = ["<ol start=", "<td colspan=", "<td rowspan=", "<tr>", "<table>", "</table>", "<li>", "</ol>", "<p hidden", " style='display:none'", "<math>", "</math>", "<svg>", "<pre>", "</pre>", "'", '"', ">", "-", "2", "0", "²", "9999999999", "x", " ", "&#9;", "&lt"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_html_never_fails_on_attributes(html):
    html_layout.visible_text(html)


def test_html_numbers_that_are_none():
    for html in ('<ol start="²"><li>a</ol>', '<ol start="--5"><li>a</ol>'):
        assert html_layout.visible_text(html) == "1. a"
    assert html_layout.visible_text('<table><tr><td colspan="²">a<td>b</table>') == "a  b"


def test_html_spanned_rows_formulas_and_labels():
    html = "<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table><p>x=<math><mi>y</mi><annotation>no</annotation></math> <svg><title>no</title><text>label</text></svg>"
    assert html_layout.visible_text(html) == "aa  b\n    c\nd   e\n\nx=y label"


class Visible(HTMLParser):
    """Words of a page outside elements that are never shown; for pages without implied ends of hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        style = (found.get("style") or "").replace(" ", "").lower()
        hidden = tag in html_layout.HIDDEN or "hidden" in found or "display:none" in style or "visibility:hidden" in style
        if tag not in html_layout.VOID:
            self.open.append((tag, hidden))

    def handle_endtag(self, tag):
        tags = [t for t, _ in self.open]
        if tag in tags:
            del self.open[len(tags) - 1 - tags[::-1].index(tag) :]

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words += data.split()


def test_html_has_every_visible_word(spark, small):
    """The words of all pages, against another parser that knows nothing of layout."""
    pages = spark.read.parquet(f"{small}/pages.parquet").where("html is not null")
    html = {r.page_id: r.html for r in pages.collect()}
    marks = re.compile(r"-|\d+\.")
    for row in html_layout.extract(pages).collect():
        parser = Visible()
        parser.feed(html[row.page_id])
        parser.close()
        plain = lambda words: Counter("".join(w for w in words if not marks.fullmatch(w)))  # noqa: E731  words of inline elements may touch
        assert plain(row.text.split()) == plain(parser.words), row.page_id


def test_html_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<div>" * 30000 + "x"), (3, "<table>" * 50 + "x")], "page_id long, html string")
    assert {(r.page_id, r.text) for r in html_layout.extract(pages.withColumn("text", F.lit(1))).collect()} == {(1, None), (2, ""), (3, "x")}


def test_ordinal_grades_are_ordered():
    rnd = np.random.default_rng(0)
    grades = rnd.integers(0, 4, 600)
    features = [np.array([5, 100 + g]) if rnd.random() < 0.9 else np.array([5]) for g in grades.tolist()]
    rows = [(f, np.ones(len(f), int)) for f in features]
    model = ordinal_toxicity.train(grades, rows, np.ones(600))
    assert (np.diff(model.thresholds) >= 0).all()
    severity = [model.above(model.weights.get(100 + g, 0.0) * np.log(2)).sum() for g in range(4)]
    assert severity == sorted(severity) and severity[3] - severity[0] > 1


def test_toxicity_frames(spark, small, odd):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    grade = ordinal_toxicity.severity_grade()
    found = ordinal_toxicity.predict(docs, ordinal_toxicity.fit(docs, labels, grade)).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    mean = {r.truth: r.s for r in found.groupBy("truth").agg(F.avg("severity").alias("s")).collect()}
    assert mean[1] > mean[0] + 0.3
    grades = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 0), (None, 1), (None, 0), (1, None)], "toxic int, quality int").select("toxic", "quality", grade.alias("g"))
    assert {(r.toxic, r.quality): r.g for r in grades.collect()} == {(0, 1): 0, (0, 0): 0, (1, 1): 1, (1, 0): 2, (None, 1): None, (None, 0): None, (1, None): 1}
    empty = ordinal_toxicity.fit(odd, labels.limit(0), grade)
    assert {r.severity for r in ordinal_toxicity.predict(odd, empty).collect()} == {0.0}


def test_masked_lm_prefers_order(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    vocabulary = masked_lm.Vocabulary(masked_lm.count(docs))
    parameters = masked_lm.train(docs, vocabulary)
    assert masked_lm.count(docs).sum() == docs.select(F.size(F.expr("filter(split(lower(text), '\\\\s+'), x -> x <> '')")).alias("n")).agg(F.sum("n")).first()[0]
    scored = masked_lm.score(odd, vocabulary, parameters).collect()
    assert len(scored) == len(ODD) and all(r.log_prob == 0 and r.mean_log_prob is None for r in scored if r.n_tokens == 0)
    assert not np.array_equal(parameters, masked_lm.Network().parameters())
    assert masked_lm.fit_and_score(odd.limit(0)).isEmpty()


def test_masked_lm_is_the_same_in_any_partitioning(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scores = []
    for n in (2, 7):
        found = masked_lm.fit_and_score(docs.repartition(n, "source", "doc_id"))
        scores.append({r.doc_id: r.log_prob for r in found.collect()})
    assert all(scores[1][k] == pytest.approx(x, rel=1e-6) for k, x in scores[0].items())


def test_masked_lm_scores_are_sums_of_conditionals(spark, small):
    """Brute force over single words, repeated rows and a very long text; held-out words beat their corpus shares."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    vocabulary = masked_lm.Vocabulary(masked_lm.count(docs.where(~held)))
    parameters = masked_lm.train(docs.where(~held), vocabulary)
    network, mark = masked_lm.Network(parameters), masked_lm.CLASSES
    texts = [(1, "the of a zzz the"), (1, "the of a zzz the"), (2, "one"), (3, "the of " * 20000)]
    rows = masked_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary, parameters).collect()
    got = sorted((r.doc_id, r.n_tokens, r.log_prob) for r in rows)
    for (doc_id, text), (own_id, n, found) in zip(sorted(texts), got, strict=True):
        own = masked_lm.numbers(text)
        padded = [mark] * masked_lm.REACH + vocabulary.of[own].tolist() + [mark] * masked_lm.REACH
        contexts = [[padded[k], padded[k + 1], padded[k + 3], padded[k + 4]] for k in range(len(own))]
        logs = network.forward(np.array(contexts))[1]
        wanted = sum(float(logs[k, vocabulary.of[w]]) + float(vocabulary.share[w]) for k, w in enumerate(own.tolist()))
        assert (own_id, n) == (doc_id, len(own)) and found == pytest.approx(wanted, rel=1e-5)
    texts = [r.text for r in docs.where(held).collect() if r.text]
    context, target = masked_lm.windows([vocabulary.of[masked_lm.numbers(t)] for t in texts])
    with_context = network.forward(context)[1][np.arange(len(target)), target].mean()
    assert with_context > vocabulary.mass[target].mean() + 0.1


def test_masked_lm_learns():
    rnd = np.random.default_rng(1)
    start = rnd.integers(0, 8, 400)
    classes = [(s + np.arange(30)) % 8 for s in start]  # each word follows from its neighbours
    context, target = masked_lm.windows(classes)
    network = masked_lm.Network()
    before = network.forward(context)[1][np.arange(len(target)), target].mean()
    for _ in range(6):
        for k in range(0, len(target), 512):
            network.learn(context[k : k + 512], target[k : k + 512], 0.5)
    assert network.forward(context)[1][np.arange(len(target)), target].mean() > before + 1
