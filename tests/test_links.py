from pyspark.sql import functions as F

from trawlspark.operators import links as L

PAGE = "http://mill.example/flour/rye"


def parse(spark, html, content_type="text/html", uri=PAGE):
    df = spark.createDataFrame([(uri, html, content_type)], "uri string, html string, ct string")
    return L.parse_pages(df, content_type="ct").first()


def found(row):
    return {
        (x.element, x.uri_attribute, x.link_text, x.no_follow, x.uri, x.fail_message)
        for x in row.links
    }


def test_blank_addresses_give_no_link(spark):
    blank = [f'<{tag} {name}={value}>' for tag, name in (("a", "href"), ("img", "src"), ("script", "src"), ("link", "href"))
             for value in ("''", '"   "', '"\n"')]
    style = "<style>@import url(); @import url(  );</style>"
    assert found(parse(spark, "".join(blank) + "</script>" * 3 + style)) == set()


def test_one_link_of_each_element(spark):
    html = """<title>Mill</title><script src=grind.js></script><style>@import url("stone.css");</style>
      <body>Read <a href="../wheat">about wheat</a>, <img rel=nofollow src="/pic/sack.webp">"""
    assert found(parse(spark, html)) == {
        ("script", "grind.js", "", False, "http://mill.example/flour/grind.js", None),
        ("css_url", "stone.css", "", False, "http://mill.example/flour/stone.css", None),
        ("a", "../wheat", "about wheat", False, "http://mill.example/wheat", None),
        ("img", "/pic/sack.webp", "", True, "http://mill.example/pic/sack.webp", None),
    }


def test_tag_soup(spark):
    html = """<A HREF=one.html>One <img src='i.png'> &amp; <b>tw</b>o<a title="href='no' >"
      href='two.html'>Two<br>lines</a><!-- <a href="c">c</a> --><script>"<a href='s'>"</script>
      <textarea><a href="t"></textarea><a data-href="no">x</a><q cite=q.html>quo<p>te</q>
      <object data="o.swf"></object><a href="one.html">One <img src='j.png'> &#38; <b>tw</b>o</a>"""
    got = found(parse(spark, html))
    assert {(e, u, t) for e, u, t, *_ in got} == {
        ("a", "one.html", "One & two"), ("img", "i.png", ""), ("img", "j.png", ""),
        ("a", "two.html", "Two lines"), ("q", "q.html", "quo te"), ("object", "o.swf", ""),
    }


def test_entities_in_urls(spark):
    row = parse(spark, '<a href="p?a=1&amp;b=2&copy=3">&uuml;&#x41;&nosuch;</a>')
    (link,) = row.links
    assert link.uri_attribute == "p?a=1&b=2&copy=3"
    assert link.link_text == "üA&nosuch;"


def test_base_element(spark):
    def uris(html):
        return [x.uri for x in parse(spark, html).links]

    link = '<a href="bran">bran</a>'
    assert uris('<base target=_top><base href="https://cdn.example/v2/">' + link) == ["https://cdn.example/v2/bran"]
    assert uris('<base href="https://cdn.example/v2/"><a href="http://barn.example/hay">h</a>') == ["http://barn.example/hay"]
    assert uris('<base href="  ">' + link) == ["http://mill.example/flour/bran"]
    assert uris('<base href="/oats/">' + link) == ["http://mill.example/oats/bran"]
    assert uris('<base href="https://cdn.example/">') == []
    broken = parse(spark, '<base href="q?k==">' + link)
    assert broken.page_error and not broken.links


def test_style_imports(spark):
    quoted = [f"<style>p{{x:y}} @import url{gap}({q}{name}.css{q}); i{{}}</style>"
              for name, gap, q in (("grit", "", "'"), ("husk", "", '"'), ("malt", " ", "'"))]
    hidden = "<!-- <style>@import url(dust.css);</style> -->"
    assert {x[4] for x in found(parse(spark, hidden.join(quoted)))} == {
        f"http://mill.example/flour/{name}.css" for name in ("grit", "husk", "malt")
    }


def test_page_flags(spark):
    words = {"index": (False, False), "noindex": (True, False), "nofollow": (False, True), "nofollows": (False, False)}
    for first, (a, b) in words.items():
        for second, (c, d) in words.items():
            content = f"{first}, {second.upper()}"
            row = parse(spark, f"<head><meta content='{content}' name=Robots></head><body><a href=chaff>c</a>")
            assert (row.no_index, row.no_follow) == (a or c, b or d), content
            assert row.links[0].no_follow == (b or d)
    assert not parse(spark, "<body><meta name=robots content=noindex>").no_index


def test_rel_must_equal_nofollow(spark):
    row = parse(spark, '<a rel="nofollow noopener" href="a">x</a><a rel="NoFollow" href="b">x</a>')
    assert {x.uri_attribute: x.no_follow for x in row.links} == {"a": False, "b": True}


def test_bad_urls_are_kept_as_failures(spark):
    row = parse(spark, '<link href="hull?v=1"><link href="hull?v==1"><img src="germ">')
    assert {x.uri_attribute: x.fail_message for x in row.links} == {
        "hull?v=1": None, "germ": None, "hull?v==1": f"base[{PAGE}] relative[hull?v==1]",
    }


def test_css(spark):
    css = """.sack { background: url(sack.png) } .sieve { mask: url( "sieve.svg" ) }
      /* .old { background: url(old.png) } */ .barn { cursor: URL ('barn.cur'), auto }
      /* a comment over
         lines url(gone.gif) */ .x { y: url("bad?k==") } .z { y: url() }"""
    row = parse(spark, css, "text/css;charset=utf-8", "http://mill.example/css/all")
    assert {x.uri for x in row.links if x.uri} == {f"http://mill.example/css/{f}" for f in ("sack.png", "sieve.svg", "barn.cur")}
    assert {x.fail_message for x in row.links if not x.uri} == {'url("bad?k==")', "url()"}


def test_hostile_css_is_linear(spark):
    import time

    def seconds(n):
        start = time.perf_counter()
        for part in ("url(", "/*", "url( '", "@import url("):
            parse(spark, part * n, "text/css")
            parse(spark, f"<style>{part * n}</style>")
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 20


def test_other_types_give_nothing(spark):
    for content_type in ("text/plain", "html", "", None):
        assert not parse(spark, '<a href="x">y</a>', content_type).links


def test_distinct_targets_counts_and_degrees(spark):
    rows = [
        ("http://s.com/1", '<a href="2">a</a><a href="2">b</a><a href="2">b</a><a href="x?==">c</a>'),
        ("http://s.com/2", '<a href="1" rel="nofollow">a</a>'),
        ("http://s.com/3", ""),
    ]
    parsed = L.parse_pages(spark.createDataFrame(rows, "uri string, html string"))
    counts = {r.uri: r.links_extracted for r in L.link_counts(parsed, "uri").collect()}
    assert counts == {"http://s.com/1": 3, "http://s.com/2": 1, "http://s.com/3": 0}
    edges = L.targets(parsed, parsed.uri.alias("page_uri"))
    assert {(r.page_uri[-1], r.uri[-1]) for r in edges.collect()} == {("1", "2"), ("2", "1")}
    assert L.targets(parsed, "uri", follow_all=False).count() == 1
    assert L.broken_links(parsed).count() == 1
    degrees = L.degrees(edges, "page_uri", "uri").collect()
    assert {(r.node[-1], r.out_degree, r.in_degree) for r in degrees} == {("1", 1, 1), ("2", 1, 1)}


def test_large_and_hostile_pages(spark):
    many = "".join(f'<a href="p{i}" {"x" * 40}>t{i}</a>' for i in range(5000))
    attrs = "<a " + " ".join(f'a{i}="{i}"' for i in range(3000)) + ' href="deep">d</a>'
    open_ended = "<a href=q" * 3000 + "<!--" + "<" * 5000
    assert len(parse(spark, many).links) == 5000
    assert [x.uri_attribute for x in parse(spark, attrs).links] == ["deep"]
    parse(spark, open_ended)


def texts(spark, html):
    return [(x.element, x.uri_attribute, x.link_text) for x in parse(spark, html).links]


def test_text_of_nested_elements(spark):
    assert texts(spark, "<blockquote cite=v>a<blockquote>b</blockquote>c</blockquote>d") == [("blockquote", "v", "a b c")]
    assert texts(spark, "<div data=o>x<div data=i>y</div>z</div>w") == [("div", "o", "x y z"), ("div", "i", "y")]
    assert texts(spark, "<q cite=o>1<q cite=i>2</q>3</q>") == [("q", "o", "123"), ("q", "i", "2")]
    assert texts(spark, "<ins cite=v>a<b>b</ins>c</b>") == [("ins", "v", "ab")]
    assert texts(spark, "<ins cite=v>open <b>to the <i>end") == [("ins", "v", "open to the end")]
    assert texts(spark, "</ins><ins cite=v>a</del></q>b</ins>") == [("ins", "v", "ab")]
    assert texts(spark, "<a href=1>one<a href=2>two</a>") == [("a", "1", "one"), ("a", "2", "two")]


def test_elements_that_end_by_themselves(spark):
    assert texts(spark, "<ul><li><a href=1>one<li><a href=2>two<ul><li><a href=3>in</ul>out</ul>after") == [
        ("a", "1", "one"), ("a", "2", "two"), ("a", "3", "in"),
    ]
    assert texts(spark, "<table><tr><td><ins cite=1>a<td><ins cite=2>b<tr><td><ins cite=3>c</table>d") == [
        ("ins", "1", "a"), ("ins", "2", "b"), ("ins", "3", "c"),
    ]
    # a cell is not left by tags that are not its own
    assert texts(spark, "<div data=0>x<table><tr><td>y</div>z</table>w</div>v") == [("div", "0", "x yz w")]
    assert texts(spark, "<p><ins cite=1>a<p><ins cite=2>b</p>c") == [("ins", "1", "a"), ("ins", "2", "b")]


def test_text_of_raw_elements(spark):
    html = "<a href=1>x<script>no</script><style>no{}</style><textarea>&lt;b></textarea><!-- no --><iframe src=2>&lt;</iframe>y</a>"
    assert texts(spark, html) == [("a", "1", "x<b>&lt;y"), ("iframe", "2", "&lt;")]


def test_time_follows_the_number_of_open_elements(spark):
    import time

    from trawlspark.functions.markup import read

    def seconds(page):
        start = time.perf_counter()
        read(page)
        return time.perf_counter() - start

    pieces = ("<x{0} cite=a>", "<ins cite=a>", "<div><td></div>", "<ul><b><li></li>", "<p><b></p>", "</x>", "<a href='", "<!--x", "&", "<q cite=\"a' ")
    for piece in pieces:
        small, large = ("".join(piece.format(i) for i in range(n)) for n in (4_000, 32_000))
        seconds(small)
        assert seconds(large) < 20 * seconds(small) + 0.2, piece


def test_own_parser(spark):
    from trawlspark.operators import parsers

    rows = [("http://s.com/map.txt", "# map\n\n/a\r\n  http://t.com/b \n/a\nx?y==", "text/plain; charset=utf-8"), ("http://s.com/h", "<a href=c>d</a>", "text/html")]
    df = spark.createDataFrame(rows, "uri string, html string, ct string")
    got = L.parse_pages(df, content_type="ct", parsers=(*parsers.DEFAULT, parsers.LISTED))
    found = {(r.uri, r.element, r.uri_attribute, r["uri_"]) for r in got.select("uri", F.inline("links").alias("element", "uri_attribute", "t", "n", "uri_", "s", "p", "si", "f")).collect()}
    assert found == {
        ("http://s.com/map.txt", "line", "/a", "http://s.com/a"), ("http://s.com/map.txt", "line", "http://t.com/b", "http://t.com/b"),
        ("http://s.com/map.txt", "line", "x?y==", None), ("http://s.com/h", "a", "c", "http://s.com/c"),
    }
    assert not [x for r in L.parse_pages(df, content_type="ct").collect() for x in r.links if x.element == "line"]
