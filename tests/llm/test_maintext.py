"""Main text: held-out layouts, given pages, odd markup."""

import html
import re
import time

from trawlspark.llm import maintext


def test_held_out_layouts():
    field = maintext.default_field()
    pages = [maintext.blocks(p) for p in maintext.labelled_pages(300, seed=77)]
    blocks = right = exact = 0
    for page in pages:
        found, want = field.viterbi(page), [b.label or 0 for b in page]
        blocks, right, exact = blocks + len(want), right + sum(a == b for a, b in zip(found, want)), exact + (found == want)
    assert right / blocks > 0.99 and exact / len(pages) > 0.93


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        truth[r["page_id"]] = " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())
    got = maintext.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == truth
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_viterbi_is_the_best_labelling():
    from itertools import product

    field = maintext.default_field()
    for page in maintext.labelled_pages(40, seed=5):
        found = maintext.blocks(page)[:8]
        if not found:
            continue
        s = field.scores(found)

        def value(labels):
            total = field.first[labels[0]] + sum(s[i, k] for i, k in enumerate(labels))
            return total + sum(field.change[a, b] for a, b in zip(labels, labels[1:]))

        best = max(product((0, 1), repeat=len(found)), key=value)
        assert abs(value(best) - value(field.viterbi(found))) < 1e-9


def test_references_space_and_hidden_elements():
    page = """<body><nav><a href=/>Home</a></nav><main><h1>A&nbsp;&amp;\tB</h1><p>One<br>two <b>th</b>ree&#33;
      <script>var x = "<p>no</p>";</script><p>Next &lt;tag&gt; here, with more words in it.<!-- <p>gone</p> --></main>
      <section class=comments><p>Great post, thank you all very much for this.</p></section><footer>(c)</footer>"""
    assert maintext.main_text(page, maintext.default_field()) == "A & B One two three! Next <tag> here, with more words in it."


def test_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no markup at all but quite some words in a row."), (3, None, "<"), (None, "u", "<p")]
    out = maintext.extract(spark.createDataFrame([(*r, "t", 4) for r in rows], "page_id bigint, url string, html string, text string, extra int"))
    got = out.collect()
    assert len(got) == 5 and [r["text"] for r in got[:2]] == ["", ""] and out.columns == ["page_id", "url", "extra", "text", "n_chars"]
    assert maintext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_reading_is_linear():
    field = maintext.default_field()
    for part in ("<div>", '<p a="', "<!--", "<b>x<p>", "<x", "</p>", "<li>x", "<a b='", "<script>", "<", "<table><tr><td>"):
        start = time.perf_counter()
        maintext.main_text(part * 60_000, field)
        assert time.perf_counter() - start < 20, part


def test_short_articles_in_all_frames():
    """One to five paragraphs, alone or between a menu and a footer."""
    field = maintext.default_field()
    line = "The river rose by two metres on Monday, and the lower part of the town was flooded by the evening."
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li></ul></nav>"
    foot = "<footer>&copy; 2020 The Paper. All rights reserved.</footer>"
    for frame in ("<body><article>{}</article>", "<body><main>{}</main>", "<body><div class=content>{}</div>", "<body><div>{}</div>", "<body><section>{}</section>", "<body>{}"):
        for count in range(1, 6):
            want = " ".join([line] * count)
            for before, after in (("", ""), (menu, foot)):
                if (frame, count) == ("<body>{}", 1) and before:
                    continue  # one paragraph that nothing tells from what is around it
                page = "<html><head><title>T</title></head>" + frame.format(before + f"<p>{line}</p>" * count + after if frame == "<body>{}" else f"<p>{line}</p>" * count)
                if frame != "<body>{}":
                    page = page.replace("<body>", "<body>" + before) + after
                assert maintext.main_text(page, field) == want, (frame, count, bool(before))


def test_odd_attributes_and_embedded_text():
    field = maintext.default_field()
    line = "The river rose by two metres on Monday, and the lower part of the town was flooded by the evening."
    for value in ("0.5", "''", "left", "9" * 5000, "-1", "1", "0"):
        assert maintext.main_text(f"<body><article><p data-y={value}>{line}</p><p>{line}</p></article>", field) == f"{line} {line}"
    page = f"<body><article><p>{line}</p><p>Its height <math><mi>h</mi><mo>=</mo><mn>2</mn></math> was a record for this part of the river.</p><noscript><p>{line}</p></noscript><object data=x><p>{line}</p></article>"
    text = maintext.main_text(page, field)
    assert "Its height h=2 was a record" in text and text.count(line) == 3
