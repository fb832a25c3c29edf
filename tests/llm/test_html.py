import random

import pytest
from pyspark.sql import functions as F

from kestrel.llm import html as h
from kestrel.llm import queries
from tests.llm.helpers import words

SCHEMA = "page_id long, url string, html string"


def site(seed=1):
    """Pages of three hosts with different templates, and the text each should give."""
    rng = random.Random(seed)
    pages, want = [], {}
    for i in range(60):
        body = [words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
        title = words(rng, 4)
        nav = "".join(f'<li><a href="/{w}">{w}</a>' for w in words(rng, 5).split())
        head = f'<html><head><title>{title}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>'
        if i % 3 == 0:
            paras = "".join(f"<p>{b}" for b in body)
            pages.append((i, f"http://a.example/{i}", f'{head}<nav><ul>{nav}</ul></nav><div class="ad">{words(rng, 5)}</div>'
                          f"<article><h1>{title}</h1>{paras}</article><footer>&copy; x</footer></body></html>"))
            want[i] = " ".join([title, *body])
        elif i % 3 == 1:
            paras = "".join(f"<p>{b}</p>\n" for b in body)
            pages.append((i, f"https://B.example:8080/x?{i}",
                          f'{head}<div class="wrap"><div class="top">Welcome to the site</div><div id="sidebar">{nav}</div>'
                          f'<div class="post"><h2>{title}</h2>{paras}<div class="share-box">Share</div></div>'
                          f'<div class="legal">All rights reserved</div></div><form><input>Mail</form></body></html>'))
            want[i] = " ".join([title, *body])
        else:
            cells = "".join(f"<tr><td>{b}</td></tr>" for b in body)
            pages.append((i, f"http://c.example/{i}", f'{head}<div class="menu">{nav}</div><main><table>{cells}</table>'
                          f'<section class="comments"><p>{words(rng, 6)}</p></section></main><aside>x</aside>'))
            want[i] = " ".join(body)
    return pages, want


def test_hosts_of_different_templates(spark):
    pages, want = site()
    for params in (h.WrapperParams(), h.WrapperParams(broadcast_hosts=0, salts=3, broadcast_references=0)):
        d = spark.createDataFrame(pages, SCHEMA).withColumn("host", F.lit("x")).withColumn("text", F.lit(1)).repartition(4)
        got = h.main_text(d, params=params).collect()
        assert {r["page_id"]: r["text"] for r in got} == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("<div", ""), ("plain &lt;text&gt; &amp;amp; &eacute;", "plain <text> &amp; é"),
    ("<p>a<p>b<br>c", "a b c"), ("<article>x<b>y</b>z<p>  q \n r</article>", "xyz q r"),
    ("<article><p>a</p><!-- no --><script>x</p></script><p>b &am", "a b &am"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><header>H</header>", "T x"),
    ("<main><p>a <a href='x>y'>link</a>.</p><form>f</form></main>", "a link."),
    ("<article>1 < 2 <em>and</em> 3 > 2</article>", "1 < 2 and 3 > 2"),
    ("</p></div><article>odd</b></i>ly closed</article>", "odd ly closed".replace(" ", "")[:3] + "ly closed"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_single_pages(page, want):
    assert h.extract(page, None) == want


def test_matching_is_the_largest_ordered_one():
    rng = random.Random(3)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return h.Slot(rng.choice("ab"), kids=kids)

    def brute(a, b):
        if a.label != b.label:
            return 0

        def forest(x, y):
            if not x or not y:
                return 0
            return max(forest(x[1:], y), forest(x, y[1:]), brute(x[0], y[0]) + forest(x[1:], y[1:]))
        return 1 + forest(a.kids, b.kids)
    for _ in range(200):
        a, b = tree(3), tree(3)
        n, pairs = h.match(a, b)
        assert n == brute(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)


def test_odd_rows(spark):
    page = "<article><p>same</p></article>"
    rows = [(1, None, page), (1, None, page), (None, "http://x.example/", page), (3, "no url", None), (4, "http://x.example/", ""),
            (5, "http://x.example/", "<article><p>" + "word " * 100000 + "</p></article>")]
    got = h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 4, 4, 4, 499999]
    assert h.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_on_one_host_keep_their_text(spark):
    rows = [(i, "http://x.example/", "<div class=post><h1>One</h1><p>text of all</p></div>") for i in range(9)]
    got = h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["text"] for r in got} == {"One text of all"}


def test_title_lead_and_second_column_beside_a_large_body_stay(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(12):
        title, lead, side, *paras = (words(rng, n) for n in (3, 4, 5, 60, 60))
        body = f"<div class=body><div class=inner>{''.join(f'<p>{p}</p>' for p in paras)}</div></div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div class=top>Welcome</div><div class=post><h1>{title}</h1>"
                     f"<div class=lead>{lead}</div>{body}<div class=second>{side}</div></div><div class=legal>Rights</div>"))
        want[i] = " ".join([title, lead, *paras, side])
        rows.append((100 + i, f"http://b.example/{i}", f"<div>{words(rng, 3)}<article class=a><p>{paras[0]}</article>"
                     f"<article class=b><p>{side}</article></div>"))
        want[100 + i] = f"{paras[0]} {side}"
    got = h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_template_is_told_from_all_pages_of_a_host(spark):
    """References that are near copies of one page, and a second template that none of them has."""
    rng = random.Random(9)
    shared, rows, want = words(rng, 30), [], {}
    ids = [r["i"] for r in spark.range(60).select(F.col("id").alias("i")).orderBy(F.xxhash64("id"), "id").collect()]
    for k, i in enumerate(ids):
        own, lead = words(rng, 12), words(rng, 5)
        top, legal = "<div class=top>Welcome</div>", "<div class=legal>Rights</div>"
        if k < 8:
            body = f"<div class=lead>Same lead</div><div class=post><p>{shared}</p><p>{own}</p></div>"
            want[i] = f"Same lead {shared} {own}"
        elif k % 4:
            body = f"<div class=lead>{lead}</div><div class=post><p>{own}</p></div>"
            want[i] = f"{lead} {own}"
        else:
            body = f"<section><h2>{lead}</h2><p>{own}</p></section>"
            want[i] = f"{lead} {own}"
        rows.append((i, f"http://a.example/{i}", f"<body>{top}{body}{legal}</body>"))
    for params in (h.WrapperParams(), h.WrapperParams(broadcast_hosts=0, salts=3)):
        got = h.main_text(spark.createDataFrame(rows, SCHEMA).repartition(4), params=params).collect()
        assert {r["page_id"]: r["text"] for r in got} == want


def test_query_against_the_articles_of_the_table(spark):
    import html
    import re
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op7_html_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_pages_come_through_the_wrapper_of_their_host(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        via = [r["via"] for r in queries.QUERIES["op7_html_text"](spark, sf).collect()]
        assert via.count("wrapper") > 0.95 * len(via)


@pytest.mark.parametrize("page,want", [
    # names that only look like boilerplate, inside an article
    ('<article><p>a</p><section id="alert-levels"><p>b</p></section><div class="share-price">c</div><div id="social-impact">d</div></article>',
     "a b c d"),
    # the same names as boilerplate: mostly links, or reader comments
    ('<article><p>a</p><div class="related-links"><a href=x>b</a> <a href=y>c</a></div><ol class="commentlist"><li>d</ol></article>', "a"),
    ('<article><p>a</p><div class="share-box">text of the article that says what it wants</div></article>',
     "a text of the article that says what it wants"),
    # teasers beside the main element, and lists of links beside an article
    ('<main><p>a</p></main><article class=card><p>teaser text</p></article>', "a"),
    ('<article><p>a b c</p></article><article class=card><a href=x>teaser</a></article>', "a b c"),
    ('<article><a href=x>only links</a></article>', "only links"),
    # deep boilerplate
    ("<article>" + "<div>" * 210 + "x<nav>menu</nav>y<div class=comments>c</div><p>z</p>" + "</div>" * 210 + "<p>end</article>", "x y z end"),
    ("<article>" + "<div>" * 300 + "<footer>f<div>g</div>h</footer>t" + "</div>" * 300 + "u</article>v", "t u"),
])
def test_boilerplate_and_what_only_looks_like_it(page, want):
    assert h.extract(page, None) == want
    wrapper = h.induce([page])
    assert h.extracted(page, wrapper) == (want, "wrapper")


def test_notices_that_all_articles_repeat_are_template(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(20):
        text, own = words(rng, 30), words(rng, 6)
        note = '<div class="newsletter-box"><p>Sign up for our letter</p></div>'
        if i % 4 == 3:                                           # the same host's pages without article
            rows.append((i, "http://a.example/", f"<body><div class=top>Hello</div><div class=post><h1>{own}</h1><p>{text}</p></div>"))
            want[i] = f"{own} {text}"
        else:
            rows.append((i, "http://a.example/", f"<body><div class=top>Hello</div><article><h1>{own}</h1>{note}<p>{text}</p>"
                         f'<div class="alert">{own}</div></article></body>'))
            want[i] = f"{own} {text} {own}"
    for i in range(100, 103):                                    # articles of another shape than the references'
        rows.append((i, "http://a.example/", f"<body><section><div><article><p>{i} {words(rng, 9)}</p></article></div></section></body>"))
    got = {r["page_id"]: r for r in h.main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {i: got[i]["text"] for i in want} == want
    assert all(got[i]["text"].startswith(str(i)) for i in range(100, 103))
    assert sum(got[i]["via"] == "wrapper" for i in want) == len(want)


def test_matching_of_unique_labels_is_that_of_the_table():
    rng = random.Random(7)

    def tree(depth):
        labels = rng.sample("abcdefgh", rng.randint(0, 6)) if depth else []
        return [h.Slot(x, kids=tree(depth - 1)) for x in labels]
    for _ in range(300):
        a, b = tree(2), tree(2)
        assert sum(n for n, _ in h._heaviest(a, b)) == sum(n for n, _ in h._by_table(a, b))


def test_a_page_of_many_different_siblings_is_matched_at_once():
    import time
    page = "<body>" + "".join(f"<div class=c{i}>t{i}</div>" for i in range(30_000)) + "</body>"
    other = "<body>" + "".join(f"<div class=c{i}>u{i}</div>" for i in range(0, 30_000, 2)) + "</body>"
    began = time.time()
    wrapper = h.induce([page, other])
    assert len(h.extract(page, wrapper).split()) == 30_000 and time.time() - began < 20


def test_counts_come_from_all_pages_not_from_a_few(spark):
    """Eight pages (the first by hash, once the references) lack what the others repeat, and hold no sign of their template."""
    rng = random.Random(11)
    rows, want = [], {}
    ids = [r["i"] for r in spark.range(50).select(F.col("id").alias("i")).orderBy(F.xxhash64("id"), "id").collect()]
    for k, i in enumerate(ids):
        own, lead = words(rng, 12), words(rng, 5)
        note, letter = ("", "") if k < 8 else ("<p>This site moves next year</p>", '<div class="newsletter-box"><p>Sign up for our letter</p></div>')
        rows.append((i, f"http://a.example/{i}", f"<body><div class=top>Hi</div><div class=post><h1>{lead}</h1>{note}<p>{own}</p></div></body>"))
        rows.append((i + 100, f"http://b.example/{i}", f"<body><article><h1>{lead}</h1>{letter}<p>{own}</p></article></body>"))
        want[i] = want[i + 100] = f"{lead} {own}"
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for params in (h.WrapperParams(), h.WrapperParams(held=1)):
        got = h.main_text(pages, params=params).collect()
        assert {r["page_id"]: r["text"] for r in got} == want
        assert all(r["via"] == "wrapper" for r in got)


def test_a_wrapper_does_not_grow_with_the_pages_of_its_host(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(400):
        own, side = words(rng, 12), words(rng, 4)
        rows.append((i, "http://a.example/", f"<body><div class=top>Hi</div><div class=post><div class=p{i}>{side}</div><p>{own}</p></div></body>"))
        want[i] = f"{side} {own}"
    pages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    wrapper = h.induce_wrappers(pages).collect()
    assert len(wrapper) == 1 and len(wrapper[0]["wrapper"]) < 2000
    assert {r["page_id"]: r["text"] for r in h.main_text(pages).collect()} == want


def test_wrapper_of_a_host_is_that_of_its_pages_in_one_go(spark):
    import json
    pages, _ = site(3)
    got = {r["host"]: json.loads(r["wrapper"]) for r in h.induce_wrappers(spark.createDataFrame(pages, SCHEMA).repartition(5)).collect()}
    for k, host in enumerate(("a.example", "b.example", "c.example")):
        assert got[host] == json.loads(json.dumps(h.induce([p for i, _, p in pages if i % 3 == k])))
