"""Document fingerprints against plain Python; extraction on held-out pages; the pipeline against plain Python."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import fingerprints, html_blocks, html_extract, html_training, queries
from scriptorium.llm.html_crf import Model
from scriptorium.tables import table
from tests.llm import plain


def test_fingerprint_query(spark, smallest):
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, smallest, "documents").collect())
    rows = {r["doc_id"]: r for r in queries.op6_document_fingerprints(spark, smallest).collect()}
    assert len(rows) == len(docs)
    better = 0
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(text).hex() and r["edited_fingerprint"] == fingerprints.fingerprint(changed).hex()
        apart = (int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).bit_count()
        assert r["near_edited"] == 1 - apart / 128
        assert r["near_next"] == fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(following))
        better += r["near_edited"] > r["near_next"]
    assert better > 0.95 * len(docs)


@pytest.mark.parametrize(("rows_a_task", "step"), [(1, 256), (1, 4), (3, 256), (1000, 256)])
def test_neighbours_in_any_number_of_ranges(spark, monkeypatch, rows_a_task, step):
    monkeypatch.setattr(fingerprints, "_STEP", step)
    r = random.Random(4)
    rows = [(i, f"text {i} " + "w " * r.randrange(5), 1, "x") for i in r.sample(range(1000), 25)] + [(500_000, None, 1, "x"), (7_000, "", 1, "x"), (None, "nameless", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int, key string").repartition(4)
    ordered = sorted(((i is not None, i or 0, t or "") for i, t, _, _ in rows))
    found = fingerprints.compared_with_next(df, rows_a_task).collect()
    wanted = sorted((fingerprints.edited(a[2], b[2]), len(a[2])) for a, b in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted((x["edited_text"], x["n_chars"]) for x in found) == wanted


def test_neighbours_of_few_rows(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    row = fingerprints.compared_with_next(one).collect()
    assert [(r["edited_text"], r["near_next"]) for r in row] == [("abab", 1.0)]
    assert fingerprints.compared_with_next(one.limit(0)).collect() == []
    same = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (6, "zz")], "doc_id long, text string")
    assert len(fingerprints.compared_with_next(same, 1).collect()) == 4


@pytest.mark.parametrize(("radius", "part_rows"), [(0, 20_000), (3, 20_000), (3, 2), (5, 7)])
def test_search_against_brute_force(spark, radius, part_rows):
    r = random.Random(2)
    base = [r.getrandbits(128) for _ in range(6)]
    values = [v ^ sum(1 << b for b in r.sample(range(128), r.randrange(0, 9))) for v in base for _ in range(12)] + base[:2] * 2
    rows = [(i if i != 7 else None, bytearray(v.to_bytes(16, "big"))) for i, v in enumerate(values)] + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    found = {int.from_bytes(x["fp"], "big"): (x["n_near"], x["least_near"]) for x in fingerprints.within_radius(df.filter("doc_id % 4 = 0"), df, radius, part_rows).collect()}
    wanted = {}
    for i, v in enumerate(values):
        if i % 4 == 0:
            near = [k for k, w in enumerate(values) if (v ^ w).bit_count() <= radius]
            wanted[v] = (len(near), min(k for k in near if k != 7))
    assert found == wanted


def test_neighbour_columns_of_the_query(spark, smallest):
    rows = queries.op6_document_fingerprints(spark, smallest).collect()
    for r in rows:
        near = [o for o in rows if (int(o["fingerprint"], 16) ^ int(r["fingerprint"], 16)).bit_count() <= 3]
        assert (r["n_near"], r["least_near"]) == ((len(near), min(o["doc_id"] for o in near)) if r["doc_id"] % 20 == 0 else (None, None))


def test_invalid_utf8_is_read_with_replacements(spark):
    df = spark.sql("select 5L as doc_id, cast(x'6162ff64' as string) as text")
    row = fingerprints.compared_with_next(df).first()
    assert row["n_chars"] == 4 and row["edited_text"] == "abab" and row["fingerprint"] == fingerprints.fingerprint("ab\ufffdd")


def test_blocks():
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;four<script>if (a<b) x('</p>')</script> five<!-- <p> --><ul><li>six<li>seven</ul>tail <a href='#'>li>nk</a></article><p>cut <a hr"
    blocks = html_blocks.leaf_blocks(page)
    assert [b.text for b in blocks] == ["Menu", "A & B", "One two.", "Three four five", "six", "seven", "tail li>nk", "cut"]
    assert blocks[0].link_chars == 4 and blocks[0].element.marks == ("nav",) and blocks[2].element.marks == ("article",) and blocks[7].element.marks == ()
    for odd in ("", "plain", "<", "<<>>", "</p></div>", "<p", "<!-- never closed", "<script>never closed", "<div " * 2000, "<b>" * 5000 + "x"):
        html_blocks.leaf_blocks(odd)


def test_held_out_pages():
    model = Model.from_json(html_extract.default_model())
    pages = html_training.labelled_pages(400, seed=4242)
    right = sum(model.decode(blocks) == labels for blocks, labels in pages)
    assert right / len(pages) > 0.97


def test_training_makes_the_model():
    small = html_training.trained(count=150)
    pages = html_training.labelled_pages(100, seed=77)
    assert sum(small.decode(b) == y for b, y in pages) / len(pages) > 0.9
    assert small.to_json() == html_training.trained(count=150).to_json()


def test_viterbi_against_all_sequences():
    import itertools

    model = Model.from_json(html_extract.default_model())
    for blocks, _ in html_training.labelled_pages(25, seed=5):
        blocks = blocks[:9]
        scores = model.scores(blocks)
        value = lambda y: sum(s for s, k in zip(scores, y) if k) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(value(y) for y in itertools.product((0, 1), repeat=len(blocks)))
        assert abs(value(model.decode(blocks)) - best) < 1e-9


#: Pages labelled by hand, not by the grammar: what holds the text, and the text.
BY_HAND = [
    ('<div class="page with-sidebar"><article><h1>T one</h1><p>Body text of the article here.</p></article></div>', "T one\nBody text of the article here."),
    ('<body class="single open-comments"><article><p>Body text of the article here.</p></article>', "Body text of the article here."),
    ("<article><header><h1>The title of it</h1></header><p>Body text of the article here.</p></article>", "The title of it\nBody text of the article here."),
    ("<article><p>Some words stand here to be read by all.</p></article><div>We use cookies to improve your experience</div>", "Some words stand here to be read by all."),
    ("<article><p>Some words stand here to be read by all.</p></article><p>Copyright 2024 Acme Inc. All rights reserved.</p>", "Some words stand here to be read by all."),
    ("<main><p>Some words stand here to be read by all.</p></main><div><p>Subscribe to our newsletter</p></div>", "Some words stand here to be read by all."),
    ("<article><p>Some words stand here to be read by all.</p></article><div><p>Bob says: great post, thanks for it!</p></div>", "Some words stand here to be read by all."),
    ("<article><p>Let <math><mi>x</mi></math> be it.</p><noscript><p>A picture of the sea stands here.</p></noscript></article>", "Let x be it.\nA picture of the sea stands here."),
    ("<p>Plain words of a page that has no containers.</p><p>And a second paragraph of it.</p><p>Copyright 2024 Acme. All rights reserved.</p>", "Plain words of a page that has no containers.\nAnd a second paragraph of it."),
    ('<nav><ul><li><a href="/">Home</a></ul></nav><main><h1>On tides</h1><p>The sea rises.</p><aside><h2>Related</h2><a href="/x">More</a></aside><p>It falls.</p></main><footer>About us</footer>', "On tides\nThe sea rises.\nIt falls."),
    ('<header><a href="/">My site</a></header><article><h1>Rye &amp; salt</h1><ol><li>Mix.<li>Wait.</ol></article><section id="comments"><h2>2 comments</h2><p>Lovely loaf, thank you.</p></section>', "Rye & salt\nMix.\nWait."),
    ('<div id="content"><h2>News of the day</h2><p>It rained in the north.</p><div class="ad-box">Buy a boat today.</div><p>It was dry in the south.</p></div><div id="sidebar"><p>Older news.</p></div>', "News of the day\nIt rained in the north.\nIt was dry in the south."),
    ('<aside><article class="teaser"><h3><a href="/a">Another story</a></h3><p>Its first words.</p></article></aside><main><p>The story itself is told here.</p></main>', "The story itself is told here."),
    ('<main><form><label>Name</label><input><button>Send</button></form><p>Write to us at any time of the day.</p></main>', "Write to us at any time of the day."),
]


@pytest.mark.parametrize(("page", "text"), BY_HAND)
def test_pages_labelled_by_hand(page, text):
    assert html_extract.main_text(page, Model.from_json(html_extract.default_model())) == text


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>x" * 60_000, "<b>" * 60_000 + "<div></div>" * 60_000 + "x", '<a ">" ' * 60_000 + "'", "<p>x</b>" * 60_000, "<ul><li>" * 40_000 + "x", "<script " * 100_000, "</script" * 100_000 + "<script>" + "</script" * 100_000])
def test_long_odd_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_blocks.leaf_blocks(page)
    assert time.perf_counter() - began < 8


def test_pages_query(spark, smallest):
    """The tables' pages have one article each; its blocks are the text."""
    import re
    from html import unescape

    rows = {r["page_id"]: r for r in queries.op10_html_extraction(spark, smallest).collect()}
    for page in table(spark, smallest, "pages").collect():
        article = page["html"].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        lines = [" ".join(unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts]
        r = rows[page["page_id"]]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"]) and r["url"] == page["url"]


def test_odd_pages(spark):
    htmls = [None, "", "<nav>only a menu</nav>", "<p>" + "long text " * 30_000 + "</p>", "plain words stand here."]
    df = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(htmls)] + [(None, "u", "<p>x y z.</p>", "t")], "page_id long, url string, html string, text string")
    rows = html_extract.extracted(df).collect()
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts[0] == texts[1] == texts[2] == "" and len(texts[3]) == 30_000 * 10 - 1 and len(rows) == 6
    assert html_extract.extracted(df.limit(0)).collect() == []


def test_pipeline_against_plain_python(spark, smallest):
    """All five stages by plain Python and the public tokenizer's library; nothing of the operators takes part."""
    docs = [r.asDict() for r in table(spark, smallest, "documents").collect()]
    kept = [{**d, "text": text} for d in docs if (text := plain.cleaned(d["text"])) is not None]
    groups = plain.classes({d["doc_id"]: plain.wide_fingerprint(d["text"]) for d in kept}, radius=50)
    kept = [{**d, "text": plain.redacted(d["text"])} for d in kept if groups[d["doc_id"]] == d["doc_id"]]
    copies = plain.draws([(d["doc_id"], d["source"]) for d in kept])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = sorted((d["doc_id"], library.encode_ordinary(d["text"])) for d, n in zip(kept, copies) for _ in range(n))
    rows = corpus_pipeline.run(spark, smallest).collect()
    assert sorted((r["doc_id"], memoryview(bytes(r["ids"])).cast("I").tolist()) for r in rows) == wanted
    assert 0 < len(kept) < len(docs)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null texts and ids, repeated ids and rows, an empty table, and columns beyond those of documents."""
    prose = "This document has words of its own, a sentence long enough to pass, and it ends well: number {}."
    rows = [(i, prose.format(" ".join(f"w{i}x{k}" for k in range(30)))) for i in (1, 2, 2, None)] + [(2, prose.format("other words under the same id")), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `TEXT.x` string")
    for name, part in (("some", df), ("none", df.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/some").select("doc_id", "n_tokens").distinct().collect()
    assert {r["doc_id"] for r in found} <= {1, 2, None} and found
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_stages_keep_the_columns(spark, smallest):
    docs = table(spark, smallest, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, smallest)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
